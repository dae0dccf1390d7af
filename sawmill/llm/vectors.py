"""Vectors of integers from columns of real components, and their batches as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """The vector is there and all its components are finite numbers; an empty vector is usable."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return F.col(f"`{vector}`").isNotNull() & F.coalesce(~F.exists(f"`{vector}`", bad), F.lit(False))


def scaled(vector: str, by: int = 256) -> Column:
    """floor(by * x) of each component, computed in double precision."""
    return F.transform(f"`{vector}`", lambda x: F.floor(F.lit(float(by)) * x.cast("double")).cast("bigint"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as int64, shorter ones filled with zeros."""
    lens, flat = np.diff(np.asarray(column.offsets)), np.asarray(column.flatten(), np.int64)
    if len(lens) and (lens == width).all():
        return flat.reshape(len(lens), width)
    out = np.zeros((len(lens), width), np.int64)
    out[np.arange(width)[None, :] < lens[:, None]] = flat
    return out
