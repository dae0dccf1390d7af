"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ``window`` consecutive words of the benchmark items (an item of fewer words, but not none,
is one pattern).  Patterns of one length m form a searcher.  Its shift table has, for each hash of a block of B
consecutive words, how far the search may jump when that block ends at the current position: m-B+1 if the block stands in
no pattern, else its least distance to a pattern's end.  Where the jump is 0, a bucket keyed by the hash of the last
block selects the patterns that may end here, and their words are compared with the text's, byte by byte.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowmap import map_texts
from .textvec import FOLD, groups, mix, words

_WORD = re.compile(rb"[^ ]+")
BLOCK = 3
#: A shift table has 2 ** SLOTS slots at least, and eight a pattern if those are more, up to 2 ** MOST_SLOTS.
SLOTS, MOST_SLOTS = 20, 24
#: Text bytes of the benchmark items that one search holds; more items are searched in further passes.  A searcher takes
#: about seven times that, on the driver and in each Python worker.
PASS_BYTES = 8 << 20


class Searcher:
    """Patterns of m words each: windows of items, held as ranges of one text.

    ``joined`` has the items' words with single spaces between; pattern p is joined[begin[p]:end[p]], of item[p].  Patterns
    are sorted by the hash of their last block, so that a bucket is a range of them.
    """

    def __init__(self, m: int, texts: list[bytes], item: np.ndarray):
        self.m, self.b = m, min(BLOCK, m)
        begins, ends, items, hashes = [], [], [], []
        parts, size, tables = [], 0, []
        for i, j in groups(texts):
            w = words(texts[i:j])
            counts = np.diff(w.first)
            folded = [x.translate(FOLD) for x in texts[i:j]]
            joined = [b" ".join([f[s:e] for s, e in zip(w.start[a:z], w.end[a:z])]) for f, a, z in zip(folded, w.first[:-1], w.first[1:])]
            # where each word stands in the joined text: its own text's place, and a space behind each word
            lens = w.end - w.start
            at = np.cumsum(lens + 1) - lens - 1 + size
            starts = np.arange(len(w.hashes))[: max(0, len(w.hashes) - m + 1)]
            of = np.repeat(np.arange(j - i), counts)
            starts = starts[of[starts] == of[starts + m - 1]]
            h = self.blocks(w.hashes)
            begins.append(at[starts]), ends.append(at[starts + m - 1] + lens[starts + m - 1])
            items.append(item[i:j][of[starts]]), hashes.append(h[starts + m - self.b])
            tables.append((h, starts))
            parts.append(b" ".join(joined))
            size += len(parts[-1]) + 1
        n = sum(map(len, hashes))
        self.slots = min(MOST_SLOTS, max(SLOTS, (8 * n).bit_length()))
        self.shift = np.full(1 << self.slots, m - self.b + 1, np.uint8 if m < 255 else np.int64)
        for end in range(self.b - 1, m):  # the jump falls as the block comes nearer to the end
            for h, starts in tables:
                self.shift[self.slot(h[starts + end - self.b + 1])] = m - 1 - end
        self.joined = b" ".join(parts)
        self.last = np.concatenate(hashes)
        order = np.argsort(self.last, kind="stable")
        self.last = self.last[order]
        self.begin, self.end, self.item = (np.concatenate(x)[order] for x in (begins, ends, items))

    def slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.slots)).astype(np.int64)

    def blocks(self, hashes: np.ndarray) -> np.ndarray:
        """Hash of the b words that begin at each position."""
        n = max(0, len(hashes) - self.b + 1)
        acc = np.zeros(n, np.uint64)
        for i in range(self.b):
            acc = acc * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[i : i + n]
        return mix(acc)

    def search(self, blocks: np.ndarray, jumps, n: int, word) -> list[tuple[int, int]]:
        """(first word, pattern) of each occurrence; ``blocks``/``jumps`` by block start, ``word(i)`` gives word i."""
        found, m, b = [], self.m, self.b
        last, at = n - b, m - b
        while at <= last:
            jump = jumps[at]
            if jump:
                at += jump
                continue
            low, high = np.searchsorted(self.last, blocks[at], "left"), np.searchsorted(self.last, blocks[at], "right")
            if low < high:
                begin = at - m + b
                own = b" ".join([word(begin + i) for i in range(m)])
                found += [(begin, p) for p in range(low, high) if self.joined[self.begin[p] : self.end[p]] == own]
            at += 1
        return found


def searchers(items: list[tuple[object, bytes]], window: int) -> list[Searcher]:
    """A searcher for each length of pattern; they find items by their places in ``items``."""
    by_length: dict[int, list[int]] = {}
    for i, (_, text) in enumerate(items):
        n = min(window, len(_WORD.findall(text.translate(FOLD))))
        if n:
            by_length.setdefault(n, []).append(i)
    return [Searcher(m, [items[i][1] for i in found], np.array(found, np.int32)) for m, found in sorted(by_length.items())]


def scan(texts: list[bytes], found_by: list[Searcher]) -> list[tuple[int, list[list[int]], set[int]]]:
    """Of each text: number of words, merged [begin, end) word spans that occurrences cover, items by their places."""
    out = []
    for i, j in groups(texts):
        w = words(texts[i:j])
        tables = []
        for s in found_by:
            h = s.blocks(w.hashes)
            tables.append((s, h, s.shift[s.slot(h)]))
        for d in range(j - i):
            a, z = w.first[d], w.first[d + 1]
            n = int(z - a)
            spans, items, folded = [], set(), None
            for s, h, jump in tables:
                if n < s.m:
                    continue
                own = jump[a : z - s.b + 1]
                if own.all():
                    continue
                if folded is None:
                    folded = texts[i + d].translate(FOLD)
                word = lambda x, f=folded, a=a: f[w.start[a + x] : w.end[a + x]]
                for begin, p in s.search(h[a : z - s.b + 1], own.tobytes() if own.dtype == np.uint8 else own, n, word):
                    spans.append([begin, begin + s.m])
                    items.add(int(s.item[p]))
            merged: list[list[int]] = []
            for b, e in sorted(spans):
                if merged and b <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([b, e])
            out.append((n, merged, items))
    return out


def decontaminate(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, keep: list[str] | None = None, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The kept columns of ``df`` with n_words, hit_spans (merged [begin, end) word ranges that benchmark windows cover)
    and item_ids (of the benchmark items with an occurring window, as sorted strings).

    Null and empty texts have no words and no spans.  Items that are null, empty or without words match nothing; an item
    whose id is null is named ''.  Repeated items count once (they change no result), repeated rows each by
    themselves.  No benchmark, no hits.
    Input columns named like an output are replaced.  The benchmark's bytes are counted first: a benchmark beyond
    ``pass_bytes`` is searched in several passes over the same batches, each for about half of that (items are dealt by hash;
    an item is never split).
    """
    b = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{item_text_col}`").alias("text")).where("text is not null").distinct()
    size = b.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    passes = 1 if size <= pass_bytes else -(-2 * size // pass_bytes)
    fields = [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
    ]
    kinds = [pa.int64(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())]
    out, keep = df, list(df.columns if keep is None else keep)
    keep = [c for c in keep if c not in {f.name for f in fields}]
    for k in range(passes):
        part = b if passes == 1 else b.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k)
        items = [(x.item, x.text.encode()) for x in part.collect()]
        held = df.sparkSession.sparkContext.broadcast(([n for n, _ in items], searchers(items, window)))
        del items
        last = k == passes - 1

        def make(held=held):
            def f(texts):
                names, found_by = held.value
                rows = scan(texts, found_by)
                spans = [[{"begin": b, "end": e} for b, e in s] for _, s, _ in rows]
                return [pa.array(x, kind) for x, kind in zip(([n for n, _, _ in rows], spans, [sorted({names[k] for k in i}) for _, _, i in rows]), kinds, strict=True)]

            return f

        prior = [f"_pass{k - 1}_spans", f"_pass{k - 1}_items"] if k else []
        carry = list(dict.fromkeys([*keep, *([] if last else [text_col]), *prior]))
        out = map_texts(out, text_col, make, fields, carry)
        if k:
            out = out.withColumn("hit_spans", _merged(F.concat("hit_spans", prior[0]))).withColumn("item_ids", F.array_sort(F.array_union("item_ids", prior[1]))).drop(*prior)
        if not last:
            out = out.withColumnsRenamed({"hit_spans": f"_pass{k}_spans", "item_ids": f"_pass{k}_items"})
    return out.select(*keep, *[f.name for f in fields])


def _merged(spans):
    """Sorted spans with those that touch joined."""
    step = lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["begin"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["begin"].alias("begin"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(F.array_sort(spans), F.slice(spans, 1, 0), step)
