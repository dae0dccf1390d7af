"""Row-wise Arrow stages: every row keeps its columns and gains the operator's, in batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


#: Rows of an Arrow batch at most: texts are long, and a batch is held by the JVM, on its way, and by Python.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after making sure that its session sends batches of at most BATCH_ROWS rows to Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(key))
    if not 0 < now <= BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; a null text counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def map_texts(df: DataFrame, text_col: str, make: Callable, fields: list[T.StructField], keep: list[str] | None = None) -> DataFrame:
    """``make()`` runs once in a task and returns ``f(texts: list[bytes]) -> list of columns`` for ``fields``.

    ``keep``: the columns that stay (all by default).  A column whose name an output takes is replaced by it.
    """
    new = {f.name for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    carried = list(dict.fromkeys([*kept, text_col]))
    source = df.select(*[df[f"`{c}`"] for c in carried])
    schema = T.StructType([source.schema[c] for c in kept] + fields)
    out = to_arrow_schema(schema)

    def run(batches):
        f = make()
        for batch in batches:
            table = pa.Table.from_batches([batch])
            columns = f(texts_of(table.column(text_col).combine_chunks()))
            arrays = [table.column(c).combine_chunks() for c in kept] + list(columns)
            arrays = [a if isinstance(a, pa.Array) else pa.array(a, out.field(i).type) for i, a in enumerate(arrays)]
            yield pa.RecordBatch.from_arrays([a.cast(out.field(i).type) for i, a in enumerate(arrays)], schema=out)

    return small_batches(source).mapInArrow(run, schema)
