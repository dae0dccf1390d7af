"""Hard negatives by threshold joins in the manner of L2AP.

Vectors have integer components.  Dimensions are ordered by their energy over all rows.  Each task turns a batch of rows
into an inverted index over the leading dimensions: a row is in the list of a dimension only while the norm of its rest,
times the largest norm of an anchor's rest over that anchor's threshold, reaches 1; rows that can't reach any threshold are
in no list.  Partial scores are accumulated a chunk of lists at a time and pairs are dropped once the partial score and the
product of the remaining norms stay below the anchor's threshold; what is left is scored in integers over all dimensions.

Thresholds start high and are lowered until every window is full: first for an anchor's positives, then for the negatives
below each positive.  A window that is full at a threshold is exact, since every row above it has been seen.  Anchors go in
passes of bounded size; tasks send on only the best rows of each window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import dropped, written
from .vectors import matrix, scaled, usable

#: Bytes of anchors' vectors that are searched for, and broadcast, at a time.
PASS_BYTES = 8 << 20
#: Thresholds of the rounds for positives, as shares of an anchor's product with itself; the last round has none.
LEVELS = (0.6, 0.4, 0.2, None)
#: Thresholds of the rounds for negatives, as shares of the lowest positive score, before the window's own lower end.
NEGATIVE_LEVELS = (0.95, 0.85)
CHUNK, ANCHORS, PAIRS = 8, 256, 1 << 15


def _suffix_norms(x: np.ndarray) -> np.ndarray:
    """norms[k] of x[k:], and 0 behind the last."""
    squares = np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate((squares, np.zeros((len(x), 1))), axis=1))


def pairs_above(rows: np.ndarray, anchors: np.ndarray, thresholds: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, score) of all pairs whose integer product reaches the anchor's threshold (-inf: all pairs)."""
    y, a = rows[:, order].astype(np.float64), anchors[:, order].astype(np.float64)
    d = y.shape[1]
    sy, sa = _suffix_norms(y), _suffix_norms(a)
    # rounding may only keep pairs that exact numbers would drop
    need = thresholds - 1 - 1e-9 * np.abs(thresholds)
    with np.errstate(divide="ignore", invalid="ignore"):
        reach = np.where(need[:, None] > 0, sa / need[:, None], np.inf).max(0) * (1 + 1e-9)
        covered = np.where(sy > 0, sy * reach, 0 if np.isfinite(reach).all() else np.inf) < 1
    listed = np.where(covered.any(1), covered.argmax(1), d)  # leading dimensions whose lists have the row
    whole = not np.isfinite(reach).all()
    by = np.argsort(-listed, kind="stable")
    by = by if whole else by[: np.searchsorted(-listed[by], 0)]
    y, sy, n = y[by], sy[by], listed[by]
    y = np.where(np.arange(d)[None, :] < n[:, None], y, 0)
    partial = np.zeros((len(by), len(a)))
    live = np.ones(partial.shape, bool)
    for k in range(0, d, CHUNK):
        top = len(by) if whole else int(np.searchsorted(-n, -k))  # rows whose lists go beyond k
        if not top or not live[:top].any():
            break
        z = min(d, k + CHUNK)
        partial[:top] += y[:top, k:z] @ a[:, k:z].T
        stop = np.minimum(n[:top], z)
        rest = np.take_along_axis(sy[:top], stop[:, None], 1) * sa[:, stop].T
        slack = 1e-9 * (sy[:top, :1] * sa[None, :, 0])
        live[:top] &= partial[:top] + rest + slack >= need[None, :]
    i, j = np.nonzero(live)
    i = by[i]
    score = np.concatenate([(rows[i[s : s + PAIRS]] * anchors[j[s : s + PAIRS]]).sum(1) for s in range(0, len(i), PAIRS)] or [np.zeros(0, np.int64)])
    kept = score >= thresholds[j]
    return i[kept], j[kept], score[kept]


def _first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` of each group: higher scores first, then smaller ids."""
    by = np.lexsort((ids, -score, group))
    g = group[by]
    starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, int)
    rank = np.arange(len(g)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(g)]))))
    return by[rank < most]


def _search(rows: DataFrame, width: int, order: np.ndarray, ids: np.ndarray, labels: np.ndarray, anchors: np.ndarray, thresholds: np.ndarray, windows: tuple | None, most: int) -> DataFrame:
    """(slot, other, score): each task's first ``most`` rows of each window.  Without ``windows`` an anchor's slot is its
    own place and takes rows of its label but not itself; windows (anchor, low, high) take rows of other labels."""
    held = rows.sparkSession.sparkContext.broadcast((order, ids, labels, anchors, thresholds, windows))

    def run(batches):
        order, ids, labels, anchors, thresholds, windows = held.value
        best = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            if not batch.num_rows:
                continue
            other, label, y = np.asarray(batch.column(0)), np.asarray(batch.column(1)), matrix(batch.column(2), width)
            found = [best]
            for at in range(0, len(anchors), ANCHORS):
                part = slice(at, at + ANCHORS)
                i, j, score = pairs_above(y, anchors[part], thresholds[part], order)
                j = j + at
                if windows is None:
                    ok = (label[i] == labels[j]) & (other[i] != ids[j])
                    found.append([j[ok], other[i][ok], score[ok]])
                    continue
                ok = label[i] != labels[j]
                i, j, score = i[ok], j[ok], score[ok]
                first, last = np.searchsorted(windows[0], j), np.searchsorted(windows[0], j, "right")
                for k in range(int((last - first).max(initial=0))):
                    slot = np.minimum(first + k, len(windows[0]) - 1)
                    ok = (first + k < last) & (windows[1][slot] <= score) & (score <= windows[2][slot])
                    found.append([slot[ok], other[i][ok], score[ok]])
            slot, who, score = (np.concatenate(c) for c in zip(*found, strict=True))
            keep = _first(slot, score, who, most)
            best = [slot[keep], who[keep], score[keep]]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in best], names=["slot", "other", "score"])

    out = rows.select("id", "label", "v").mapInArrow(run, "slot bigint, other bigint, score bigint")
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("score"), "other")))
    return ranked.where(F.col("rank") <= most)


def _energy(rows: DataFrame, width: int) -> np.ndarray:
    """Dimensions in order of the sum of squares over all rows, largest first."""

    def run(batches):
        total = np.zeros(width)
        for batch in batches:
            total += (matrix(batch.column(0), width).astype(np.float64) ** 2).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(total, pa.float64())], names=["d", "e"])

    got = {r.d: r.e for r in rows.select("v").mapInArrow(run, "d int, e double").groupBy("d").agg(F.sum("e").alias("e")).collect()}
    return np.array(sorted(range(width), key=lambda d: (-got.get(d, 0.0), d)), np.int64)


def mine(df: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = 5, negatives: int = 5, low_percent: int = 80, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Scores are products of the vectors' components floor(256 * x).  For each row with ``anchor`` its first ``positives``
    other rows of the same label (higher scores first, then smaller ids), and for each of those the first ``negatives`` rows
    of other labels whose score is at least ``low_percent`` of the positive's and at most all of it: none for a negative
    positive score.

    Rows with a null id, label or vector or a component that is null or not finite take no part; shorter vectors count as
    filled with zeros.  Repeated rows count each by themselves, as an anchor once; a row never is a positive of one with its
    own id.  Equal scores go by id, rows of equal id and score are interchangeable.  No anchors or no rows give no rows;
    other columns are not read.  Scores have to fit 63 bits.
    """
    spark = df.sparkSession
    kept = df.where(usable(vector_col) & F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull())
    kept = kept.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{label_col}`").cast("bigint").alias("label"), scaled(vector_col).alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = written(kept, "vectors")
    shape = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width"), F.count_if("anchor").alias("n")).first()
    width, order = shape.width, _energy(rows, shape.width)
    passes = max(1, -(-2 * shape.n * max(1, width) * 8 // pass_bytes)) if shape.n * width * 8 > pass_bytes else 1
    out: list[DataFrame] = []
    for k in range(passes):
        some = rows.where("anchor").select("id", "label", "v").distinct()
        some = some if passes == 1 else some.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == k)
        out += _mined(rows, width, order, some.toArrow(), positives, negatives, low_percent)
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    result = spark.createDataFrame([], schema)
    for part in out:
        result = result.unionByName(part)
    result = written(result, "negatives")
    dropped(rows, *out)
    return result


def _mined(rows: DataFrame, width: int, order: np.ndarray, anchors: pa.Table, positives: int, negatives: int, low: int) -> list[DataFrame]:
    """Tables of the results for one pass of anchors."""
    if not anchors.num_rows:
        return []
    spark = rows.sparkSession
    ids, labels = (np.asarray(anchors.column(c).combine_chunks(), np.int64) for c in (0, 1))
    v = matrix(anchors.column(2).combine_chunks(), width)
    by = np.lexsort((labels, ids))
    ids, labels, v = ids[by], labels[by], v[by]
    own = (v.astype(np.float64) ** 2).sum(1)
    found: dict[int, list[tuple[int, int]]] = {}
    left = np.arange(len(ids))
    for level in LEVELS:
        t = np.full(len(left), -np.inf) if level is None else level * own[left]
        got: dict[int, list[tuple[int, int]]] = {}
        for r in _search(rows, width, order, ids[left], labels[left], v[left], t, None, positives).collect():
            got.setdefault(int(left[r.slot]), []).append((-r.score, r.other))
        found.update({a: sorted(x) for a, x in got.items() if len(x) >= positives or level is None})
        left = np.array([a for a in left if a not in found], np.int64)
        if not len(left):
            break
    pairs = [(a, o, -s) for a, x in found.items() for s, o in x if s <= 0]
    # a window for each anchor and positive score
    open_ = sorted({(a, p) for a, _, p in pairs})
    out = []
    for level in (*NEGATIVE_LEVELS, None):
        if not open_:
            break
        floors = [-(-low * p // 100) for _, p in open_]
        which = sorted({a for a, _ in open_})
        place = {a: n for n, a in enumerate(which)}
        least, bottom = np.full(len(which), np.inf), np.full(len(which), np.inf)
        for (a, p), f in zip(open_, floors, strict=True):
            least[place[a]], bottom[place[a]] = min(least[place[a]], p), min(bottom[place[a]], f)
        t = bottom if level is None else np.maximum(bottom, np.floor(level * least))
        windows = (np.array([place[a] for a, _ in open_]), np.array(floors), np.array([p for _, p in open_]))
        seen = written(_search(rows, width, order, ids[which], labels[which], v[which], t, windows, negatives), "windows")
        full = {r.slot: r.n for r in seen.groupBy("slot").agg(F.count("*").alias("n")).collect()}
        done = [s for s, (a, p) in enumerate(open_) if full.get(s, 0) >= negatives or t[place[a]] <= floors[s]]
        slot_of = {open_[s]: s for s in done}
        named = [(slot_of[a, p], int(ids[a]), int(o), int(p)) for a, o, p in pairs if (a, p) in slot_of]
        if named:
            ends = F.broadcast(spark.createDataFrame(named, "slot bigint, anchor_id bigint, positive_id bigint, positive_score bigint"))
            ended = seen.join(ends, "slot").select("anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
            out.append(written(ended, "hard"))
        dropped(seen)
        open_ = [w for s, w in enumerate(open_) if s not in set(done)]
    return out
