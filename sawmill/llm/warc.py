"""WARC archives and their Merkle fixity audit.

A replica is a table of records (file, offset, length, record).  Its tree has the records' SHA-256 digests as leaves; a
node of the first level covers the records that begin in one range of ``RANGE`` offsets of a file, a node of each further
level ``FANOUT`` neighbouring ranges, and the last level one whole file.  Nodes digest their children's ranges and digests
in offset order.  An audit compares the file roots of two replicas and goes down only below nodes that differ, so that
the leaves that are compared are those of differing ranges.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .arrowmap import small_batches
from .storage import dropped, written

RANGE, FANOUT, FILE_BYTES = 1 << 16, 16, 1 << 28


def record(url: str | None, payload: bytes) -> bytes:
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {url or ''}\r\nContent-Type: text/html\r\nContent-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload + b"\r\n\r\n"


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """The pages as WARC records: file, offset, length, id, record.

    The rows of each partition of ``pages`` are appended, in their order, to files of its own of about ``file_bytes``, named
    after the number of that partition: a task that runs several, as behind coalesce(), has one number of its own.  Null urls and pages are empty.  Rows without an id, with repeated ids and repeated rows are records of their
    own.  Other columns are not read.
    """
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("id", pages.schema[id_col].dataType), T.StructField("record", T.BinaryType())])
    out = to_arrow_schema(schema)

    def run(batches):
        number, offset = 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                task = part.column(3)[0].as_py()
                made = [record(u, (h or "").encode()) for u, h in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                files, offsets = [], []
                for r in made:
                    if offset and offset + len(r) > file_bytes:
                        number, offset = number + 1, 0
                    files.append(f"{task:06d}-{number:05d}.warc")
                    offsets.append(offset)
                    offset += len(r)
                columns = [files, offsets, [len(r) for r in made], part.column(0), made]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, out.field(i).type) for i, c in enumerate(columns)], schema=out)

    return small_batches(pages.select(*[F.col(f"`{c}`") for c in (id_col, url_col, html_col)], F.spark_partition_id().alias("_task"))).mapInArrow(run, schema)


def leaves(replica: DataFrame) -> DataFrame:
    """file, offset, length, digest of the records and k, which numbers the rows of one file and offset; a null record has
    the digest of no bytes."""
    rows = replica.select("file", "offset", "length", F.sha2(F.coalesce("record", F.lit(b"")), 256).alias("digest"))
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("file", "offset").orderBy("digest", "length")))


def levels(leaf: DataFrame, name: str, file_bytes: int = FILE_BYTES) -> list[DataFrame]:
    """From the ranges up to the file roots, as written tables (file, at, digest): ``at`` is the range's number.

    A range of RANGE offsets holds few records, as records don't overlap; a node above has FANOUT children at most.
    """
    own = F.concat_ws(":", "offset", "length", "digest")
    node = leaf.groupBy("file", (F.col("offset") / RANGE).cast("long").alias("at")).agg(F.array_sort(F.collect_list(F.struct("offset", own.alias("x")))).alias("c"))
    digest = F.sha2(F.array_join(F.transform("c", lambda c: c["x"]), "\n").cast("binary"), 256).alias("digest")
    out = [written(node.select("file", "at", digest), f"{name}-0")]
    span = RANGE
    while span < file_bytes:
        span *= FANOUT
        node = out[-1].groupBy("file", F.floor(F.col("at") / FANOUT).alias("at")).agg(F.array_sort(F.collect_list(F.struct("at", F.concat_ws(":", "at", "digest").alias("x")))).alias("c"))
        out.append(written(node.select("file", "at", digest), f"{name}-{len(out)}"))
    node = out[-1].groupBy("file").agg(F.array_sort(F.collect_list(F.struct("at", F.concat_ws(":", "at", "digest").alias("x")))).alias("c"))
    out.append(written(node.select("file", F.lit(0).cast("long").alias("at"), digest), f"{name}-root"))
    return out


def audit(a: DataFrame, b: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """The records in which two replicas differ: file, offset, length_a/length_b, digest_a/digest_b (hex), status
    (changed, missing: only in a, extra: only in b), as a written table.  Equal replicas, empty ones included, give no rows.

    Records are compared at their file and offset.  Rows that repeat one file and offset are paired in order of their
    digests; one more of them in a replica is missing or extra.  A record that is inserted or cut short moves those behind
    it in its file, which then all differ.
    """
    leaf = [written(leaves(x), f"leaves-{n}") for x, n in ((a, "a"), (b, "b"))]
    trees = [levels(x, n, file_bytes) for x, n in zip(leaf, "ab", strict=True)]
    differing, done = None, []
    for depth in range(len(trees[0]) - 1, -1, -1):
        left, right = (t[depth] for t in trees)
        if differing is not None:
            up = F.lit(0).cast("long") if depth == len(trees[0]) - 2 else F.floor(F.col("at") / FANOUT)
            left, right = (x.withColumn("up", up).join(differing, ["file", "up"], "left_semi").drop("up") for x in (left, right))
        both = left.toDF("file", "at", "x").join(right.toDF("file", "at", "y"), ["file", "at"], "full")
        differing = written(both.where(~F.col("x").eqNullSafe(F.col("y"))).select("file", F.col("at").alias("up")), f"differing-{depth}")
        done.append(differing)
    left, right = (x.withColumn("up", (F.col("offset") / RANGE).cast("long")).join(differing, ["file", "up"], "left_semi").drop("up") for x in leaf)
    both = left.toDF("file", "offset", "length_a", "digest_a", "k").join(right.toDF("file", "offset", "length_b", "digest_b", "k"), ["file", "offset", "k"], "full").drop("k")
    status = F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra").otherwise("changed")
    out = written(both.where(~F.col("digest_a").eqNullSafe(F.col("digest_b"))).withColumn("status", status), "found")
    dropped(*leaf, *trees[0], *trees[1], *done)
    return out


def checked(data: bytes) -> str:
    """SHA-256 of a record, as the leaves have it."""
    return hashlib.sha256(data).hexdigest()
