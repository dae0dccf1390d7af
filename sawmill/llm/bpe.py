"""Byte-level BPE with ranked merges, as expressions of Spark.

A text is cut into words by a pattern; a word's bytes are its first pieces, and the two neighbours whose joined bytes have
the least rank become one piece (the leftmost of equal ones) until no two neighbours have a rank.  The merges are a fold by
higher-order functions over an array of integers, one for each piece; the rank of two neighbours is looked up by their ids
in a literal perfect hash table.  Words that have a rank need no fold.  The most frequent of the others are folded once for
all texts (``common_words``), the rest once in a task: Arrow stages cut the texts into codes of words before the fold, and
put ids in the place of codes behind it.  So that table changes the time and never the ids.  The driver passes it on as
Arrow's arrays and makes no Python strings of it.

A byte is held as the character of its number (ISO-8859-1) where Spark takes a word apart.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import json
import random
from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .arrowmap import small_batches
from .storage import held

#: Longer words (in bytes) go to a helper with a heap: the fold's time grows with the square of a word's length.
FOLD_BYTES = 96
#: Words that are folded once for all texts: at most so many, of at most FOLD_BYTES bytes each (some 40 MB in all; a task's
#: dictionary of them takes some 200 MB).
COMMON = 1 << 20
#: Words that a task remembers before it begins anew.
REMEMBERED = 1 << 19
#: Bits of an id, and of a piece's place in a word that is folded.
BITS, PLACE = 20, 12


@dataclass(frozen=True)
class Vocabulary:
    """Ranks of byte strings, which are their ids; all 256 single bytes have one.  ``pattern`` cuts a text into words and
    matches every character of it."""

    ranks: dict[bytes, int]
    pattern: str

    @staticmethod
    def from_tiktoken(path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as f:
            return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    @functools.cached_property
    def words(self) -> dict[str, int]:
        """Ranks of those that are whole characters."""
        found = ((k.decode(errors="replace"), k, v) for k, v in self.ranks.items())
        return {w: v for w, k, v in found if w.encode() == k}


def as_characters(word: Column) -> Column:
    return F.decode(word.cast("binary"), "ISO-8859-1")


def bind(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _literal(values: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values, separators=(",", ":"))), f"array<{kind}>")


def _long(n: int) -> Column:
    return F.lit(n).cast("bigint")


#: Of the table's hash functions.
_P, _Q = 40503, 30011


def _ranks(vocabulary: Vocabulary) -> Column:
    """The ranks of neighbours as a struct of literals: ``bytes``: the id of each byte, and ``shifts`` and ``slots``: a perfect
    hash of the two ids, with the masks of both.  A slot is empty or holds left id, right id and rank, from the high bits on."""
    ranks = vocabulary.ranks
    if max(ranks.values()) >= 1 << BITS:
        raise ValueError(f"ids of more than {BITS} bits")
    splits = ((ranks.get(w[:i]), ranks.get(w[i:]), r) for w, r in ranks.items() for i in range(1, len(w)))
    pairs = [(a, b, r) for a, b, r in splits if a is not None and b is not None]
    n = 1 << max(4, (2 * len(pairs)).bit_length())
    groups = defaultdict(list)
    for a, b, r in pairs:
        groups[(a + b * _P) & (n // 8 - 1)].append((a * _Q + b, (a << BITS | b) << BITS | r))
    slots: list[int | None] = [None] * n
    shifts = [0] * (n // 8)
    rng = random.Random(0)
    for g, group in sorted(groups.items(), key=lambda x: -len(x[1])):
        if len({h & (n - 1) for h, _ in group}) < len(group):
            raise ValueError("two pairs of ids have the same hashes")
        while any(slots[(h + shifts[g]) & (n - 1)] is not None for h, _ in group):
            shifts[g] = rng.randrange(n)
        for h, x in group:
            slots[(h + shifts[g]) & (n - 1)] = x
    one = [ranks[bytes([i])] for i in range(256)]
    masks = (_long(n // 8 - 1).alias("shift_mask"), _long(n - 1).alias("slot_mask"))
    return F.struct(*masks, _literal(one, "bigint").alias("bytes"), _literal(shifts, "bigint").alias("shifts"), _literal(slots, "bigint").alias("slots"))


def fold(word: Column, ranks: Column) -> Column:
    """The ids of a word (characters that stand for bytes, not empty, at most FOLD_BYTES).

    A piece is a number: from the high bits on the rank of the piece joined with its right neighbour (1 above all ranks for
    none), the place of its first byte, its id.  So the least number is the leftmost of the least rank.  A step of the fold
    is a merge; once no neighbours have a rank, the rest of the steps change nothing."""
    none, low, id_of = _long(1 << BITS), _long((1 << BITS + PLACE) - 1), _long((1 << BITS) - 1)
    places = _long((1 << BITS + PLACE) - (1 << BITS))

    def rank(a: Column, b: Column) -> Column:
        shift = F.get(ranks["shifts"], (a + b * _P).bitwiseAND(ranks["shift_mask"]).cast("int"))
        found = F.get(ranks["slots"], (a * _Q + b + shift).bitwiseAND(ranks["slot_mask"]).cast("int"))
        # what is left of a slot without its own ids is the rank; other ids leave higher bits
        return F.least(found.bitwiseXOR(F.shiftleft(F.shiftleft(a, BITS) + b, BITS)), none)

    def step(s: Column, _: Column) -> Column:
        def merged(least: Column) -> Column:
            made = F.shiftright(least, BITS + PLACE)

            def at(k: Column) -> Column:
                right = rank(made, F.get(s, k + 1).bitwiseAND(id_of))
                whole = F.shiftleft(right, BITS + PLACE) + least.bitwiseAND(places) + made
                before = lambda x: F.shiftleft(rank(x.bitwiseAND(id_of), made), BITS + PLACE) + x.bitwiseAND(low)
                rest = F.filter(s, lambda x, i: i != k)
                return F.transform(rest, lambda x, i: F.when(i == k - 1, whole).when(i == k - 2, before(x)).otherwise(x))

            return F.when(made >= none, s).otherwise(bind(F.array_position(s, least).cast("int"), at))

        return bind(F.array_min(s), merged)

    def merges(ids: Column) -> Column:
        piece = lambda x, i: F.shiftleft(rank(x, F.get(ids, i + 1)), BITS + PLACE) + F.shiftleft(i.cast("bigint"), BITS) + x
        return F.aggregate(F.slice(ids, F.lit(2), F.size(ids)), F.transform(ids, piece), step, lambda s: F.transform(s, lambda x: x.bitwiseAND(id_of).cast("int")))

    return bind(F.transform(F.sequence(F.lit(1), F.char_length(word)), lambda i: F.get(ranks["bytes"], F.ascii(F.substring(word, i, F.lit(1))))), merges)


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap of neighbours, for a long word."""
    end = list(range(1, len(word) + 1))  # of the piece that begins here
    left = list(range(-1, len(word) - 1))  # where the piece before begins
    alive = [True] * len(word)
    heap: list[tuple[int, int, int, int]] = []

    def offer(a: int) -> None:
        b = end[a]
        if b < len(word):
            r = ranks.get(word[a : end[b]])
            if r is not None:
                heapq.heappush(heap, (r, a, b, end[b]))

    for a in range(len(word)):
        offer(a)
    while heap:
        _, a, b, z = heapq.heappop(heap)
        if not (alive[a] and end[a] == b and alive[b] and end[b] == z):
            continue
        end[a], alive[b] = z, False
        if z < len(word):
            left[z] = a
        offer(a)
        if left[a] >= 0:
            offer(left[a])
    return [ranks[word[a : end[a]]] for a in range(len(word)) if alive[a]]


@functools.cache
def cutter(pattern: str) -> Callable[[str], list[str]]:
    """A function that lists the matches of the pattern, in order; classes and spaces are those of Unicode."""
    import regex

    return regex.compile(pattern).findall


def texts_in(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def common_words(df: DataFrame, vocabulary: Vocabulary, ranks: Column, text_col: str = "text", most: int = COMMON) -> tuple[pa.Array, pa.Array]:
    """At most ``most`` distinct words that need merges, those of the highest counts over all texts, and the ids of each.

    For speed a task counts what stands between spaces, and cuts each distinct piece of that once, behind a space: where a
    text begins or has other white space, the words counted may not be its words.  Counts are added up in a task before they
    are shuffled."""
    own, pattern = df.sparkSession.sparkContext.broadcast(vocabulary.words), vocabulary.pattern
    fields = T.StructType([T.StructField("w", T.StringType()), T.StructField("n", T.LongType())])
    out = to_arrow_schema(fields)

    def sent(cut: Callable[[str], list[str]], counts: dict[str, int]) -> Iterator[pa.RecordBatch]:
        known, words = own.value, defaultdict(int)
        for piece, n in counts.items():
            for w in cut(" " + piece):
                if w not in known:
                    words[w] += n
        found = [(w, n) for w, n in words.items() if len(w.encode()) <= FOLD_BYTES]
        for at in range(0, len(found), 1 << 16):
            ws, ns = zip(*found[at : at + (1 << 16)], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ws, out.field(0).type), pa.array(ns, out.field(1).type)], schema=out)

    def count(batches):
        cut, counts = cutter(pattern), Counter()
        for batch in batches:
            for text in texts_in(batch.column(0)):
                counts.update(text.split(" "))
            if len(counts) > REMEMBERED:
                yield from sent(cut, counts)
                counts.clear()
        yield from sent(cut, counts)

    counted = held(small_batches(df.select(df[f"`{text_col}`"].cast("string"))).mapInArrow(count, fields).groupBy("w").agg(F.sum("n").alias("n")))
    n_words = {r.n: r.words for r in counted.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).agg(F.count("*").alias("words")).collect()}
    least, room = (1 << 16) + 1, most
    for n in sorted(n_words, reverse=True):
        room -= n_words[n]
        if room < 0:
            break
        least = n
    top = counted.where(F.col("n") >= max(least, 2)).select("w", bind(ranks, lambda r: fold(as_characters(F.col("w")), r)).alias("ids")) if least <= 1 << 16 else None
    found = top.toArrow().combine_chunks() if top is not None else None
    counted.unpersist()
    if found is None:
        return NO_WORDS
    return _whole(found["w"]), _whole(found["ids"])


#: No common words and no ids.
NO_WORDS = pa.array([], pa.string()), pa.array([], pa.list_(pa.int32()))


def _whole(column: pa.ChunkedArray) -> pa.Array:
    a = column.combine_chunks()
    return a.chunk(0) if isinstance(a, pa.ChunkedArray) else a


@dataclass(frozen=True)
class Known:
    """Codes of words: the rank of a word that has one, and from ``first`` on the places in ``common``.  It is sent to tasks as
    Arrow's buffers; only a Python worker makes the dictionary, which is some ten times as large, once for all its tasks."""

    ranked: dict[str, int]
    first: int
    common: pa.Array

    @functools.cached_property
    def codes(self) -> dict[str, int]:
        return self.ranked | dict(zip(self.common.to_pylist(), range(self.first, self.first + len(self.common)), strict=True))


class Codes(dict):
    """Codes of words.  A word without one gets the next, and is listed in ``new``."""

    def __init__(self, known: dict[str, int], first: int):
        super().__init__(known)
        self.next, self.new = first, []

    def __missing__(self, word: str) -> int:
        self[word] = code = self.next
        self.next += 1
        self.new.append(word)
        return code


def _lists(ends: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def encode(
    df: DataFrame, vocabulary: Vocabulary, text_col: str = "text", ids_col: str = "ids", common: int = COMMON, keep: list[str] | None = None, remembered: int = REMEMBERED,
    made: tuple[list[T.StructField], Callable[[pa.ListArray], list[pa.Array]]] | None = None,
) -> DataFrame:
    """``df`` with the ids of each text: those that byte-level BPE gives to each match of the pattern by itself, without
    special tokens.

    A null or empty text has no ids; every row stays, repeated ones too; an empty table stays empty; a column named like
    the ids is replaced.  Words of any length are whole.  ``keep``: the columns that stay (all by default).  ``common`` words
    are folded once for all texts, and a task begins anew once it remembers more than ``remembered`` others: both change the
    time only.  ``made``: fields, and what makes their columns of the lists of ids; they stand in the place of the ids, which
    then needn't leave the task (``digests``).
    """
    context = df.sparkSession.sparkContext
    ranks, pattern, one = _ranks(vocabulary), vocabulary.pattern, max(vocabulary.ranks.values()) + 1
    words, folded = common_words(df, vocabulary, ranks, text_col, common) if common else NO_WORDS
    # the code of a word that has a rank is its id; those of common words follow
    own = context.broadcast(Known(vocabulary.words, one, words))
    ids_of = context.broadcast((np.concatenate([np.ones(one, np.int64), folded.value_lengths().to_numpy()]), np.concatenate([np.arange(one, dtype=np.int32), folded.flatten().to_numpy()])))
    first, by_bytes = one + len(words), context.broadcast(vocabulary.ranks)

    numbers = T.ArrayType(T.IntegerType())
    fields, make = made or ([T.StructField(ids_col, numbers)], lambda ids: [ids])
    kept = [c for c in (df.columns if keep is None else keep) if c not in {f.name for f in fields}]
    source = df.select(*[df[f"`{c}`"] for c in kept], df[f"`{text_col}`"].cast("string").alias("_text"))
    same = [source.schema[c] for c in kept]
    word = T.StructType([T.StructField("w", T.StringType()), T.StructField("ids", numbers)])
    cut_schema = T.StructType([*same, T.StructField("_codes", T.BinaryType()), T.StructField("_anew", T.BooleanType()), T.StructField("_new", T.ArrayType(word))])
    cut_out, schema = to_arrow_schema(cut_schema), T.StructType([*same, *fields])
    out = to_arrow_schema(schema)

    def fresh(words: list[str]) -> pa.Array:
        own_bytes = [w.encode() for w in words]
        short = [b.decode("latin-1") if len(b) <= FOLD_BYTES else None for b in own_bytes]
        ids = [None if w is not None else merge_long(b, by_bytes.value) for w, b in zip(short, own_bytes, strict=True)]
        kind = cut_out.field("_new").type.value_type
        return pa.StructArray.from_arrays([pa.array(short, kind.field(0).type), pa.array(ids, kind.field(1).type)], fields=list(kind))

    def cut_into_codes(batches):
        cut, codes = cutter(pattern), Codes(own.value.codes, first)
        for batch in batches:
            anew = codes.next - first > remembered
            if anew:
                codes = Codes(own.value.codes, first)
            found, ends, new_ends = array("i"), [0], [0]
            code = codes.__getitem__
            for text in texts_in(batch.column(len(kept))):
                found.extend(map(code, cut(text)))
                ends.append(len(found))
                new_ends.append(len(codes.new))
            new, codes.new = fresh(codes.new), []
            # as bytes, the codes pass through Spark in one piece a text
            packed = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.array(4 * np.array(ends, np.int64), pa.int32()).buffers()[1], pa.py_buffer(found)])
            made = [packed, pa.array([anew and i == 0 for i in range(batch.num_rows)]), _lists(new_ends, new)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).cast(cut_out.field(i).type) for i in range(len(kept))), *(a.cast(cut_out.field(len(kept) + i).type) for i, a in enumerate(made))], schema=cut_out)

    def codes_into_ids(batches):
        lengths, flat = ids_of.value
        for batch in batches:
            codes, anew, new = (batch.column(len(kept) + i) for i in range(3))
            at = [0, *(i for i in np.flatnonzero(anew.to_numpy(zero_copy_only=False)).tolist() if i), batch.num_rows]
            in_text = pc.binary_length(codes).to_numpy(zero_copy_only=False) // 4
            to = np.concatenate([[0], np.cumsum(in_text, dtype=np.int64)])
            coded = np.frombuffer(b"".join(x.as_buffer() for x in codes), np.int32)
            lists = []
            for a, b in zip(at, at[1:], strict=False):
                if b > a and anew[a].as_py():
                    lengths, flat = ids_of.value
                more = new.slice(a, b - a).flatten()
                lengths, flat = np.concatenate([lengths, more.value_lengths().to_numpy()]), np.concatenate([flat, more.flatten().to_numpy()])
                used, texts = coded[to[a] : to[b]], in_text[a:b]
                n = lengths[used]
                ends = np.concatenate([[0], np.cumsum(n)])
                begins = np.cumsum(lengths) - lengths
                ids = flat[np.repeat(begins[used] - ends[:-1], n) + np.arange(ends[-1])]
                lists.append(_lists(ends[np.concatenate([[0], np.cumsum(texts)])], pa.array(ids, pa.int32())))
            columns = [*(batch.column(i) for i in range(len(kept))), *make(pa.concat_arrays(lists))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    cut_rows = small_batches(source).mapInArrow(cut_into_codes, cut_schema)
    new = bind(ranks, lambda r: F.transform("_new", lambda x: F.coalesce(x["ids"], fold(x["w"], r))))
    return small_batches(cut_rows.withColumn("_new", new)).mapInArrow(codes_into_ids, schema)


def decode(ids: Column, vocabulary: Vocabulary) -> Column:
    """The bytes of an array of ids: its pieces, one behind the other; null for an id beyond the vocabulary."""
    pieces = [""] * (max(vocabulary.ranks.values(), default=-1) + 1)
    for k, v in vocabulary.ranks.items():
        pieces[v] = k.decode("latin-1")
    table = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    # a character that no byte stands for marks what isn't in the vocabulary
    joined = bind(table, lambda t: F.array_join(F.transform(ids, lambda i: F.get(t, i)), "", "\u0100"))
    return bind(joined, lambda x: F.when(~F.contains(x, F.lit("\u0100")), F.encode(x, "ISO-8859-1")))


def joined(ids: pa.ListArray, table: pa.Array, between: str = "") -> pa.Array:
    """For each list the table's values at its ids, one behind the other; null for an id that the table doesn't have."""
    flat = ids.flatten()
    there = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(table)))
    values = table.take(flat if pc.all(there).as_py() is not False else pc.if_else(there, flat, pa.scalar(None, flat.type)))
    ends = np.concatenate([[0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy(), dtype=np.int32)])
    return pc.binary_join(_lists(ends, values), pa.scalar(between.encode(), table.type))


def digests(vocabulary: Vocabulary) -> tuple[list[T.StructField], Callable[[pa.ListArray], list[pa.Array]]]:
    """For ``encode``: how many ids a text has, the SHA-256 of the decimal ids joined by commas, and that of the bytes which the
    ids decode to, taken from the vocabulary's pieces (null for an id that it doesn't have)."""
    n = max(vocabulary.ranks.values(), default=-1) + 1
    pieces: list[bytes | None] = [None] * n
    for k, v in vocabulary.ranks.items():
        pieces[v] = k
    decimals, pieces = pa.array([b"%d" % i for i in range(n)], pa.large_binary()), pa.array(pieces, pa.large_binary())

    def sha256(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else hashlib.sha256(x).hexdigest() for x in texts.to_pylist()], pa.string())

    def make(ids: pa.ListArray) -> list[pa.Array]:
        return [ids.value_lengths().cast(pa.int64()), sha256(joined(ids, decimals, ",")), sha256(joined(ids, pieces))]

    return [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())], make
