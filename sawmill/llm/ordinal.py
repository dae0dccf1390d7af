"""Toxicity: cumulative-link ordinal regression over sparse text features.

P(grade <= k) = sigmoid(theta_k - eta), eta = sum_i w_i x_i: one weight vector serves all ordered thresholds theta_1 <
theta_2 < ...  The expected severity is sum_k P(grade >= k).  Features are the hashed words of a text and the hashed
first bytes of its words, each log(1 + count); a proximal step keeps the weights sparse.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowmap import map_texts
from .fm import training_rows
from .textvec import groups, words

BITS, PREFIX, GRADES = 18, 4, 3
#: The model is fitted on so many labelled documents at most, those of the least hash.
SAMPLE = 8192


@dataclass
class Sparse:
    bucket: np.ndarray
    count: np.ndarray
    first: np.ndarray


def features(texts: list[bytes]) -> Sparse:
    w = words(texts, PREFIX)
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(w.first)) << np.uint64(BITS)
    shift = np.uint64(64 - BITS)
    key = np.sort(np.concatenate((doc | (w.hashes >> shift), doc | (w.prefix >> shift))))
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate((new, [len(key)])))
    key = key[new]
    first = np.searchsorted(key, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(BITS))
    return Sparse((key & np.uint64((1 << BITS) - 1)).astype(np.int32), count, first)


@dataclass
class Model:
    w: np.ndarray
    theta: np.ndarray

    def tails(self, x: Sparse) -> np.ndarray:
        """P(grade >= k) for k = 1.. as columns."""
        product = self.w[x.bucket] * np.log1p(x.count, dtype=np.float32)
        total = np.zeros(len(x.first) - 1)
        some = np.flatnonzero(np.diff(x.first) > 0)
        if len(some):
            total[some] = np.add.reduceat(product, x.first[:-1][some])
        return 1 / (1 + np.exp(np.clip(self.theta[None, :] - total[:, None], -30, 30)))


def gradient(model: Model, x: Sparse, grade: np.ndarray, value: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the mean negative log-likelihood, by w and by theta.  ``value``: log1p of the counts; ``per``: their texts."""
    n, grades = len(grade), len(model.theta)
    rows = np.arange(n)
    tail = np.concatenate((np.ones((n, 1)), model.tails(x), np.zeros((n, 1))), axis=1)
    p = np.maximum(tail[rows, grade] - tail[rows, grade + 1], 1e-9)
    slope = tail * (1 - tail)  # of each tail by eta, and its negative by theta
    up, down = slope[rows, grade], slope[rows, grade + 1]
    g_theta = np.zeros((n, grades + 2))
    g_theta[rows, grade] += up / p / n
    g_theta[rows, grade + 1] -= down / p / n
    g_eta = -(up - down) / p / n
    return np.bincount(x.bucket, g_eta.astype(np.float32)[per] * value, len(model.w)), g_theta[:, 1:-1].sum(0)


def fit(x: Sparse, grade: np.ndarray, grades: int = GRADES, rounds: int = 150, rate: float = 0.3, l1: float = 2e-4) -> Model:
    """Proximal gradient with steps that shrink with the squares seen, on the cumulative-link likelihood; ``grade``: 0 to ``grades``."""
    n, size = len(grade), 1 << BITS
    shares = [(np.sum(grade >= k) + 0.5) / (n + 1) for k in range(1, grades + 1)]
    theta = np.array([-np.log(s / (1 - s)) for s in shares])
    theta = np.maximum.accumulate(theta + np.arange(grades) * 1e-3)
    model = Model(np.zeros(size), theta)
    if n == 0 or grade.min() == grade.max():
        return model
    value = np.log1p(x.count, dtype=np.float32)
    per = np.repeat(np.arange(n, dtype=np.int32), np.diff(x.first))
    free = np.concatenate(([theta[0]], np.log(np.maximum(np.diff(theta), 1e-3))))
    squares, squares_free = np.full(size, 1e-8), np.full(grades, 1e-8)
    for _ in range(rounds):
        gw, gt = gradient(model, x, grade, value, per)
        g_free = np.cumsum(gt[::-1])[::-1].copy()
        g_free[1:] *= np.exp(free[1:])
        squares += gw * gw
        squares_free += g_free * g_free
        pace = rate / (np.sqrt(squares) + 1e-3)
        moved = model.w - pace * gw
        model.w = np.sign(moved) * np.maximum(np.abs(moved) - pace * l1, 0)
        free -= rate * g_free / (np.sqrt(squares_free) + 1e-3)
        model.theta = np.concatenate(([free[0]], free[0] + np.cumsum(np.exp(free[1:]))))
    return model


def graded(x: Sparse, toxic: np.ndarray, grades: int = GRADES) -> np.ndarray:
    """Grades where only 0/1 is labelled: 0 stays 0; toxic documents get 1, 2, ... by how often they use features that
    are at least eight times as frequent among toxic documents: terciles (for three grades) of that count."""
    n1, n0 = max(1, int(toxic.sum())), max(1, int((toxic == 0).sum()))
    per = np.repeat(np.arange(len(toxic), dtype=np.int32), np.diff(x.first))
    size = 1 << BITS
    in1 = np.bincount(x.bucket, toxic[per] == 1, size)
    in0 = np.bincount(x.bucket, toxic[per] == 0, size)
    telling = (in1 >= 5) & (in1 / n1 > 8 * (in0 + 0.5) / n0)
    uses = np.bincount(per, telling[x.bucket] * x.count, len(toxic))
    bounds = np.quantile(uses[toxic == 1], np.arange(1, grades) / grades) if toxic.any() else np.zeros(grades - 1)
    return np.where(toxic == 1, 1 + (uses[:, None] > bounds[None, :]).sum(1), 0).astype(np.int64)


def train_toxicity(df: DataFrame, labels: DataFrame, usable, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", bound: int = SAMPLE, grade_col: str | None = None, grades: int = GRADES) -> Model:
    """``grade_col``: a column of ``labels`` with grades 0..grades; without it grades come from the 0/1 labels (graded())."""
    column = grade_col or label_col
    top = grades if grade_col else 1
    rows = training_rows(df, labels, [column], usable & F.col(column).between(0, top) & F.col(f"`{id_col}`").isNotNull(), id_col, text_col, bound)

    def make():
        def f(texts):
            out = [[], []]
            for i, j in groups(texts):
                x = features(texts[i:j])
                for d in range(j - i):
                    a, z = x.first[d], x.first[d + 1]
                    out[0].append(x.bucket[a:z].tobytes())
                    out[1].append(np.minimum(x.count[a:z], 65535).astype(np.uint16).tobytes())
            return [pa.array(c, pa.binary()) for c in out]

        return f

    fields = [T.StructField("_b", T.BinaryType()), T.StructField("_c", T.BinaryType())]
    got = sorted(map_texts(rows, "_text", make, fields, ["_id", column]).collect(), key=lambda r: (str(r["_id"]), r["_b"]))
    lens = [len(r["_b"]) // 4 for r in got]
    x = Sparse(np.frombuffer(b"".join(r["_b"] for r in got), np.int32), np.frombuffer(b"".join(r["_c"] for r in got), np.uint16), np.concatenate(([0], np.cumsum(lens))).astype(np.int64))
    y = np.array([r[column] for r in got], np.int64)
    del got
    return fit(x, y if grade_col else graded(x, y, grades), grades)


def score_toxicity(df: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns with p_toxic (P(grade >= 1)), expected_severity and grade (the number of thresholds passed with
    probability over one half).  Null texts count as empty; an empty text has the scores of the thresholds alone.
    Columns named like an output are replaced."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def make():
        def f(texts):
            got = [held.value.tails(features(texts[i:j])) for i, j in groups(texts)]
            t = np.concatenate(got) if got else np.zeros((0, len(held.value.theta)))
            return [pa.array(t[:, 0], pa.float64()), pa.array(t.sum(1), pa.float64()), pa.array((t > 0.5).sum(1), pa.int32())]

        return f

    fields = [T.StructField("p_toxic", T.DoubleType()), T.StructField("expected_severity", T.DoubleType()), T.StructField("grade", T.IntegerType())]
    return map_texts(df, text_col, make, fields, keep)
