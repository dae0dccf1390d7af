"""Vector codes: a vector is cut into parts, and each part is stored as the number of its codebook's nearest entry.

The nearest entry is found with a geometric near-neighbour access tree (GNAT) over the entries of a codebook: a node has a
few split points far from each other, every other entry goes to the nearest split point, and for each pair of a split point
and a child the node keeps the range of distances between them.  A query's distances to the split points rule out whole
children: strictly, and with roots rounded to the safe side, so that equal distances are still seen; distances are compared
as integers, ties by number.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import dropped, written
from .vectors import matrix, scaled, usable

SPLITS, LEAF = 6, 8
#: Sums over labels are broadcast up to so many labels, else joined by a shuffle.
BROADCAST_ROWS = 100_000


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of y."""
    out = np.zeros((len(x), len(y)), np.int64)
    for d in range(x.shape[1]):
        step = x[:, d, None] - y[None, :, d]
        out += step * step
    return out


@dataclass
class Node:
    """``at``: numbers of the split points, or of all entries of a leaf; low, high: [split point, child]."""

    at: np.ndarray
    children: list[Node | None]
    low: np.ndarray | None = None
    high: np.ndarray | None = None


def build(entries: np.ndarray, at: np.ndarray | None = None) -> Node:
    """The tree over entries (their numbers ``at``)."""
    at = np.arange(len(entries)) if at is None else at
    if len(at) <= LEAF:
        return Node(at, [])
    d = squared(entries[at], entries[at])
    splits = [0]
    while len(splits) < SPLITS:
        splits.append(int(d[:, splits].min(1).argmax()))
        if len(set(splits)) < len(splits):  # only copies of split points are left
            splits.pop()
            break
    near = d[:, splits].argmin(1)
    rest = np.setdiff1d(np.arange(len(at)), splits)
    groups = [rest[near[rest] == j] for j in range(len(splits))]
    if max(map(len, groups)) == len(at) - 1:  # all entries are equal
        return Node(at, [])
    far = np.sqrt(d[splits].astype(np.float64))
    low = np.stack([far[:, g].min(1) if len(g) else np.full(len(splits), np.inf) for g in groups], 1)
    high = np.stack([far[:, g].max(1) if len(g) else np.full(len(splits), -np.inf) for g in groups], 1)
    return Node(at[splits], [build(entries, at[g]) if len(g) else None for g in groups], low * (1 - 1e-12), high * (1 + 1e-12))


class Nearest:
    """Numbers and squared distances of the nearest entries (the least number of equally near ones)."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.root = entries, build(entries)
        self.compared = 0

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.x = x
        self.d, self.e = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(self.entries))
        if len(x) and len(self.entries):
            self._visit(self.root, np.arange(len(x)))
        return self.e, self.d

    def _visit(self, node: Node, rows: np.ndarray) -> None:
        d = squared(self.x[rows], self.entries[node.at])
        self.compared += d.size
        order = np.argsort(node.at, kind="stable")
        first = order[d[:, order].argmin(1)]
        near, which = d[np.arange(len(rows)), first], node.at[first]
        better = (near < self.d[rows]) | ((near == self.d[rows]) & (which < self.e[rows]))
        self.d[rows[better]], self.e[rows[better]] = near[better], which[better]
        if not node.children:
            return
        far = np.sqrt(d.astype(np.float64))
        for j, child in enumerate(node.children):
            if child is None:
                continue
            best = np.sqrt(self.d[rows].astype(np.float64))[:, None] * (1 + 1e-12) + 1e-9
            out = ((far * (1 - 1e-12) - best > node.high[None, :, j]) | (far * (1 + 1e-12) + best < node.low[None, :, j])).any(1)
            if not out.all():
                self._visit(child, rows[~out])


def _nearest(books: np.ndarray):
    """f(matrix) -> entries and squared distances by part, for codebooks [part, entry, position]."""
    trees = [Nearest(b) for b in books]
    width = books.shape[2]

    def f(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        got = [t(x[:, p * width : (p + 1) * width]) for p, t in enumerate(trees)]
        return np.stack([e for e, _ in got], 1), np.stack([d for _, d in got], 1)

    return f


def _refined(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round: tasks send on sums and counts by part and entry, never rows."""
    held = rows.sparkSession.sparkContext.broadcast(books)
    parts, entries, width = books.shape

    def run(batches):
        assign = _nearest(held.value)
        sums, n = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            x = matrix(batch.column(0), parts * width)
            e, _ = assign(x)
            slot = (e + np.arange(parts)[None, :] * entries).ravel()
            np.add.at(sums, slot, x.reshape(-1, width))
            n += np.bincount(slot, minlength=len(n))
        some = np.flatnonzero(n)
        columns = [np.repeat(some, width), np.tile(np.arange(width), len(some)), sums[some].ravel(), np.repeat(n[some], width)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["slot", "pos", "s", "n"])

    got = rows.select("v").mapInArrow(run, "slot bigint, pos bigint, s bigint, n bigint").groupBy("slot", "pos").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    out = books.copy().reshape(parts * entries, width)
    for r in got:
        out[r.slot, r.pos] = r.s // r.n
    return out.reshape(books.shape)


def compress(df: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """(id, label, code, error, label_error, codebooks_sha256): the code has two hex digits a part, error is the sum of its
    squared distances, label_error the sum of errors over rows of equal label, nulls together.

    Components are floor(256 * x).  The codebooks start as the parts of the ``entries`` least ids (nulls last, equal ids by
    vector) and are refined ``rounds`` times over all rows to the floor of each entry's mean; unused entries stay.  Rows
    with a null vector or a component that is null or not finite are left out; all others stay, repeated ones too, with null
    ids and labels as they are.  Vectors whose length isn't a multiple of ``parts``, or shorter than the longest, count as
    filled with zeros.  An empty table gives no rows; with fewer rows than ``entries`` the codebooks are smaller.
    Components have to stay below 2^29, ``entries`` at most 256.
    """
    spark = df.sparkSession
    kept = df.where(usable(vector_col)).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), scaled(vector_col).alias("v"))
    rows = written(kept, "vectors")
    width = max(1, -(-rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0)).alias("n")).first().n // parts))
    start = rows.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").toArrow().column(0).combine_chunks()
    books = matrix(start, parts * width).reshape(-1, parts, width).transpose(1, 0, 2)
    for _ in range(rounds if len(start) else 0):
        books = _refined(rows, books)
    held = spark.sparkContext.broadcast(books)

    def run(batches):
        assign = _nearest(held.value)
        for batch in batches:
            e, d = assign(matrix(batch.column(2), parts * width))
            codes = [c.tobytes().hex() for c in e.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(d.sum(1), pa.int64())], names=["id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    coded = written(rows.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error bigint"), "codes")
    totals = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label"), "label-errors")
    small = totals.count() <= BROADCAST_ROWS
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    out = coded.join(F.broadcast(totals) if small else totals, coded["label"].eqNullSafe(totals["_label"]))
    result = written(out.select("id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")), "compressed")
    dropped(rows, coded, totals)
    return result
