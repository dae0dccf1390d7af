"""Quality classifier: a factorisation machine of second order.

score(x) = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), where the pairwise part is computed in time linear
in the non-zero features by  1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2].

Features: words hashed into 2**bits buckets (counts, divided by their norm), and dense ones: statistics of the text's
structure and its metadata (size).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowmap import map_texts
from .textvec import groups, words

BITS, RANK = 14, 8
#: The model is fitted on so many labelled documents at most, those of the least hash.
SAMPLE = 8192

_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b"\r\n", b".,;:", b"!?", b"|", b"%&$#*@^~+=<>\\", b"'\"-()[]{}/_`"]
_CLASS_OF = np.zeros((256, len(_CLASSES) + 1), np.float32)
for _c in range(256):
    _CLASS_OF[_c, next((i for i, x in enumerate(_CLASSES) if _c in x), len(_CLASSES))] = 1
DENSE = len(_CLASSES) + 1 + 8


@dataclass
class Features:
    """Sparse part by document (first[i]:first[i+1]) and dense part (a row each)."""

    bucket: np.ndarray
    value: np.ndarray
    first: np.ndarray
    dense: np.ndarray


def features(texts: list[bytes]) -> Features:
    w = words(texts)
    n = np.diff(w.first)
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), n)
    key = np.sort((doc << np.uint64(BITS)) | (w.hashes >> np.uint64(64 - BITS)))
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate((new, [len(key)]))).astype(np.float32)
    key = key[new]
    first = np.searchsorted(key, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(BITS))
    norm = np.sqrt(_sums(count * count, first))
    value = count / np.repeat(np.maximum(norm, 1), np.diff(first))
    dense = np.zeros((len(texts), DENSE), np.float32)
    m = len(_CLASSES) + 1
    length = _sums((w.end - w.start).astype(np.float32), w.first)
    short = _sums(((w.end - w.start) <= 3).astype(np.float32), w.first)
    for i, t in enumerate(texts):
        if t:
            dense[i, :m] = np.bincount(np.frombuffer(t, np.uint8), minlength=256) @ _CLASS_OF / len(t)
            lines = [x for x in t.split(b"\n") if x]
            dense[i, m + 3] = len(set(lines)) / max(1, len(lines))
            dense[i, m + 4] = np.log1p(len(t) / max(1, len(lines))) / 8
        dense[i, m] = np.log1p(len(t)) / 10
    some = np.maximum(n, 1)
    dense[:, m + 1] = length / some / 10
    dense[:, m + 2] = short / some
    dense[:, m + 5] = np.diff(first) / np.sqrt(some) / 20
    dense[:, m + 6] = n == 0
    dense[:, m + 7] = np.minimum(n, 40) / 40
    dense[:, :m] = np.sqrt(dense[:, :m])
    return Features((key & np.uint64((1 << BITS) - 1)).astype(np.int32), value, first, dense)


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of x (rows) between bounds; 0 for empty ranges."""
    out = np.zeros((len(first) - 1, *x.shape[1:]), x.dtype)
    some = np.flatnonzero(np.diff(first) > 0)
    if len(some):
        out[some] = np.add.reduceat(x, first[:-1][some], axis=0)
    return out


@dataclass
class Model:
    bias: float
    w: np.ndarray  # sparse buckets, then dense features
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def parts(self, x: Features):
        z = np.clip((x.dense - self.mean) / self.scale, -4, 4)
        b, val = x.bucket, x.value[:, None]
        k = 1 << BITS
        vx = self.v[b] * val
        linear = self.bias + _sums((self.w[b] * x.value)[:, None], x.first)[:, 0] + z @ self.w[k:]
        s = _sums(vx, x.first) + z @ self.v[k:]
        q = _sums(vx * vx, x.first) + (z * z) @ (self.v[k:] ** 2)
        return z, vx, s, linear + 0.5 * (s * s - q).sum(1)

    def score(self, x: Features) -> np.ndarray:
        """In double precision and in a fixed order of additions for each text, so that a score doesn't depend on the texts
        beside it: matrix products round differently for other numbers of rows."""
        k, val = 1 << BITS, x.value.astype(np.float64)
        z = np.clip((x.dense.astype(np.float64) - self.mean) / self.scale, -4, 4)
        w, v, b = self.w.astype(np.float64), self.v.astype(np.float64), x.bucket
        vx = v[b] * val[:, None]
        sums = _sums(np.concatenate(((w[b] * val)[:, None], vx, vx * vx), axis=1), x.first)
        linear, s, q = self.bias + sums[:, 0], sums[:, 1 : RANK + 1].copy(), sums[:, RANK + 1 :].copy()
        for d in range(z.shape[1]):
            linear += z[:, d] * w[k + d]
            s += z[:, d, None] * v[k + d]
            q += (z[:, d, None] * v[k + d]) ** 2
        pairs = np.zeros(len(z))
        for f in range(RANK):
            pairs += s[:, f] * s[:, f] - q[:, f]
        return 1 / (1 + np.exp(-np.clip(linear + 0.5 * pairs, -30, 30)))


def fit(x: Features, y: np.ndarray, epochs: int = 12, batch: int = 256, rate: float = 0.02, l2: float = 1e-5, seed: int = 7) -> Model:
    """Adam on the logistic loss; without both labels the model predicts the share of label 1."""
    rng = np.random.default_rng(seed)
    k, n = 1 << BITS, len(y)
    mean = x.dense.mean(0) if n else np.zeros(DENSE, np.float32)
    scale = x.dense.std(0) + 1e-3 if n else np.ones(DENSE, np.float32)
    share = (y.sum() + 1) / (n + 2)
    model = Model(float(np.log(share / (1 - share))), np.zeros(k + DENSE, np.float32), (rng.normal(size=(k + DENSE, RANK)) * 0.02).astype(np.float32), mean, scale)
    if n == 0 or y.min() == y.max():
        return model
    params = [np.array([model.bias], np.float32), model.w, model.v]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            pick = order[at : at + batch]
            part = take(x, pick)
            model.bias = float(params[0][0])
            z, vx, s, raw = model.parts(part)
            g = ((1 / (1 + np.exp(-np.clip(raw, -30, 30)))) - y[pick]).astype(np.float32) / len(pick)
            per = np.repeat(np.arange(len(pick)), np.diff(part.first))
            gx = g[per] * part.value
            gw = np.bincount(part.bucket, gx, k).astype(np.float32)
            gv_rows = gx[:, None] * (s[per] - vx)
            gv = np.stack([np.bincount(part.bucket, gv_rows[:, f], k) for f in range(RANK)], 1).astype(np.float32)
            gz = g[:, None] * z
            gvz = gz.T @ s - (gz * z).sum(0)[:, None] * model.v[k:]
            grads = [np.array([g.sum()], np.float32), np.concatenate((gw, gz.sum(0))) + l2 * model.w, np.concatenate((gv, gvz)) + l2 * model.v]
            step += 1
            for p, a, b, d in zip(params, m1, m2, grads, strict=True):
                a += 0.1 * (d - a)
                b += 0.01 * (d * d - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    model.bias = float(params[0][0])
    return model


def take(x: Features, pick: np.ndarray) -> Features:
    lens = np.diff(x.first)[pick]
    at = np.repeat(x.first[pick] - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(lens.sum())
    return Features(x.bucket[at], x.value[at], np.concatenate(([0], np.cumsum(lens))), x.dense[pick])


def training_rows(df: DataFrame, labels: DataFrame, label_cols: list[str], usable, id_col: str = "doc_id", text_col: str = "text", bound: int = SAMPLE) -> DataFrame:
    """(id, text, labels) of at most ``bound`` labelled documents: those with ``usable`` labels of the least id hash.

    Rows of equal id count once (the least text and the least labels), so a repeated id cannot swell the sample.
    """
    picked = labels.where(usable).groupBy(F.col(f"`{id_col}`").alias("_id")).agg(*[F.min(f"`{c}`").alias(c) for c in label_cols])
    picked = picked.orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").limit(bound)
    picked = df.sparkSession.createDataFrame(picked.collect(), picked.schema)
    docs = df.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    return docs.join(F.broadcast(picked), "_id").groupBy("_id", *label_cols).agg(F.min("_text").alias("_text"))


def collected(rows: DataFrame, label: str) -> tuple[Features, np.ndarray]:
    """Features of the (bounded) training rows, computed on the executors, and their labels, in order of id."""
    fields = [T.StructField(c, T.BinaryType()) for c in ("_b", "_v", "_d")]

    def make():
        def f(texts):
            out = [[], [], []]
            for i, j in groups(texts):
                x = features(texts[i:j])
                for d in range(j - i):
                    a, z = x.first[d], x.first[d + 1]
                    out[0].append(x.bucket[a:z].astype(np.int16).tobytes())
                    out[1].append(x.value[a:z].astype(np.float16).tobytes())
                    out[2].append(x.dense[d].tobytes())
            return [pa.array(c, pa.binary()) for c in out]

        return f

    got = sorted(map_texts(rows, "_text", make, fields, ["_id", label]).collect(), key=lambda r: (str(r["_id"]), r["_d"]))
    lens = [len(r["_b"]) // 2 for r in got]
    join = lambda c, kind: np.frombuffer(b"".join(r[c] for r in got), kind)
    x = Features(join("_b", np.int16).astype(np.int32), join("_v", np.float16).astype(np.float32), np.concatenate(([0], np.cumsum(lens))).astype(np.int64), join("_d", np.float32).reshape(-1, DENSE))
    return x, np.array([r[label] for r in got], np.float32)


def train_quality(df: DataFrame, labels: DataFrame, usable, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", bound: int = SAMPLE) -> Model:
    """A model of P(label 1) from the labelled rows for which ``usable`` holds; labels other than 0 and 1 are not used."""
    rows = training_rows(df, labels, [label_col], usable & F.col(label_col).isin(0, 1) & F.col(f"`{id_col}`").isNotNull(), id_col, text_col, bound)
    return fit(*collected(rows, label_col))


def score_quality(df: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, score_col: str = "score") -> DataFrame:
    """The kept columns with the score (0 to 1, higher: better).  Null texts count as empty; an empty text has a score
    too, from its structure alone.  Equal texts have equal scores.  A column named like the score is replaced."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def make():
        def f(texts):
            got = [held.value.score(features(texts[i:j])) for i, j in groups(texts)]
            return [pa.array(np.concatenate(got) if got else np.zeros(0), pa.float64())]

        return f

    return map_texts(df, text_col, make, [T.StructField(score_col, T.DoubleType())], keep)
