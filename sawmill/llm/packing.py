"""Packing of token sequences by Karmarkar-Karp multiway differencing.

A document's ids are cut at every ``capacity``: whole pieces fill a window each.  What is left over (1 to capacity-1 ids,
cut again into parts of at most ``part``) is gathered, in the order of the rows, into groups whose ids nearly fill
``windows`` windows.  Within a group, k-way differencing repeatedly takes the two partial partitions with the largest
imbalance (largest minus smallest window) and adds the largest window of one to the smallest of the other, so that
opposing imbalances cancel; what remains is one partition into k near-equal windows.  If its largest window exceeds the
capacity, k rises by one and the group is partitioned anew.

No rows are shuffled: each task packs its own input partition and holds one group and one batch at most.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .arrowmap import small_batches


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Partitions indices of ``sizes`` into k subsets of near-equal sums (largest differencing method, k-way).

    A partial partition holds its non-empty subsets only, largest first, as (sum, tree of indices).
    """
    if k <= 1 or len(sizes) <= 1:
        return [list(range(len(sizes)))] + [[] for _ in range(k - 1)]
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    order = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = len(a) + len(b) - k
        if over <= 0:
            merged = a + b
        else:  # the ``over`` smallest of a meet the smallest of b: largest with smallest
            alone_a, alone_b = a[: len(a) - over], b[: len(b) - over]
            meet_a, meet_b = a[len(a) - over :], b[len(b) - over :]
            merged = alone_a + alone_b + [(x[0] + y[0], (x[1], y[1])) for x, y in zip(meet_a, reversed(meet_b), strict=True)]
        merged.sort(key=lambda x: -x[0])
        low = merged[-1][0] if len(merged) == k else 0
        heapq.heappush(heap, (low - merged[0][0], order, merged))
        order += 1
    out = []
    for _, tree in heap[0][2]:
        members, stack = [], [tree]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack.extend(x)
            else:
                members.append(x)
        out.append(sorted(members))
    return out + [[] for _ in range(k - len(out))]


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of at most ``capacity``; the count starts at the least possible and rises while one overflows."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = [p for p in differencing(sizes, k) if p]
        if all(sum(sizes[i] for i in p) <= capacity for p in parts):
            return parts
        k += 1


class Packer:
    """Packs one task's documents; ``add`` and ``close`` give pieces (doc, start, ids, doc_tokens, window, offset)."""

    def __init__(self, capacity: int, windows: int, part: int, slack: int, first: int = 0):
        self.capacity, self.part, self.target = capacity, part, windows * capacity - slack
        self.next, self.rest, self.held = first, [], 0

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        n, at = len(ids), 0
        while n - at >= self.capacity:
            yield doc, at, ids[at : at + self.capacity], n, self.next, 0
            self.next += 1
            at += self.capacity
        left = n - at
        parts = -(-left // self.part)
        for i in range(parts):
            a, b = at + left * i // parts, at + left * (i + 1) // parts
            if self.held + b - a > self.target:
                cut = a + self.target - self.held
                if cut > a:
                    self.rest.append((doc, a, ids[a:cut], n))
                yield from self.close()
                a = cut
            self.rest.append((doc, a, ids[a:b], n))
            self.held += b - a

    def close(self) -> Iterator[tuple]:
        for members in windows_of([len(x[2]) for x in self.rest], self.capacity):
            offset = 0
            for i in members:
                yield *self.rest[i], self.next, offset
                offset += len(self.rest[i][2])
            self.next += 1
        self.rest, self.held = [], 0


def pack(df: DataFrame, tokenizer, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 0, windows: int = 160, part: int = 256, slack: int = 32, with_ids: bool = True) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset and (``with_ids``) ids.

    ``tokenizer`` makes, in a task, a function from a list of texts to lists of ids.  ``end_id`` follows each document.
    Null and empty texts are documents of one id (``end_id``).  Ids of rows may repeat or be null: each row is a
    document of its own.  Other columns of ``df`` are not read.  An empty table gives no pieces.  sequence_id is the
    task's partition number times 2**33 plus a count, so a task that runs again gives the same ids.
    """
    kind = df.schema[id_col].dataType
    fields = [T.StructField(id_col, kind)] + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []
    schema = T.StructType(fields)
    out = to_arrow_schema(schema)

    def table(pieces: list[tuple]) -> pa.RecordBatch:
        doc, start, ids, n, window, offset = zip(*pieces, strict=True)
        columns = [doc, start, [len(x) for x in ids], [zlib.crc32(x.tobytes()) for x in ids], n, window, offset]
        arrays = [pa.array(c, out.field(i).type) for i, c in enumerate(columns)]
        if with_ids:
            ends = np.cumsum([0, *map(len, ids)])
            arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids).astype(np.int32))).cast(out.field("ids").type))
        return pa.RecordBatch.from_arrays(arrays, schema=out)

    def run(batches):
        encode = tokenizer()
        packer = Packer(capacity, windows, part, slack, TaskContext.get().partitionId() << 33)
        pieces: list[tuple] = []
        for batch in batches:
            docs, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 256):
                rows = zip(docs[at : at + 256].to_pylist(), texts[at : at + 256].to_pylist(), strict=True)
                rows = [(d, t or "") for d, t in rows]
                for (d, _), ids in zip(rows, encode([t for _, t in rows]), strict=True):
                    pieces += packer.add(d, np.array([*ids, end_id], dtype="<u4"))
                if len(pieces) >= 4096:
                    yield table(pieces)
                    pieces = []
        pieces += packer.close()
        if pieces:
            yield table(pieces)

    return small_batches(df.select(df[f"`{id_col}`"], df[f"`{text_col}`"])).mapInArrow(run, schema)


#: The added tokens of byte_bpe_50k.json.
ADDED = {"<|endoftext|>": 50256}


def byte_bpe(path: str | None = None, added: bool = False):
    """The tokenizer of byte_bpe_50k.json, read through its rank file, which holds the same vocabulary.

    ``path``: the rank file; by default the one of the installed public_tokenizers.  With ``added``, the name of an added
    token inside a text is that one id, as the json's tokenizer has it by default; without, it is ordinary text.
    """

    def make():
        import base64

        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED)
        if not added:
            return lambda texts: [encoding.encode_ordinary(t) for t in texts]
        # the plain form is faster, and equal for a text without these names
        return lambda texts: [encoding.encode(t, allowed_special="all") if any(x in t for x in ADDED) else encoding.encode_ordinary(t) for t in texts]

    return make
