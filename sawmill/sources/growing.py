"""Log files that grow: batches and streams that resume at byte offsets, on any file system that Arrow opens by its URI.

A file is known by the digest of its first bytes, as stores have no inodes.  It starts over when it is unknown, begins
otherwise than before (it was replaced) or is shorter than its offset (it was cut); else reading goes on where it ended.
Offsets are a table (path, offset, head_bytes, head), a row per file.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

OFFSETS = "path string, offset bigint, head_bytes int, head string"
#: Bytes of a file that one task reads; bytes of its head that are digested; bytes read at a time; lines of an Arrow batch.
CHUNK, HEAD, BLOCK, LINES = 64 << 20, 1024, 4 << 20, 20_000


def opened(uri: str) -> tuple[pfs.FileSystem, str]:
    """The file system of a path and its name there; file:/x, as Hadoop writes it, is file:///x."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pfs.FileSystem.from_uri(uri) if "://" in uri else (pfs.LocalFileSystem(), uri)


def head_of(file: pa.NativeFile, size: int) -> str:
    file.seek(0)
    return hashlib.sha256(file.read(size)).hexdigest()


def line_end(file: pa.NativeFile, start: int, size: int) -> int:
    """The position behind the last line feed in [start, size)."""
    at = size
    while at > start:
        low = max(start, at - (1 << 16))
        file.seek(low)
        found = file.read(at - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return start


def resume_at(file: pa.NativeFile, size: int, known: tuple | None) -> int:
    """Where to go on in a file of ``size`` bytes: known is (offset, head_bytes, head) or None.  A head that was never
    digested (a state from elsewhere) is trusted."""
    if not known or known[0] is None or known[0] > size:
        return 0
    offset, n, head = known
    return offset if head is None or head_of(file, n or 0) == head else 0


def lines_of(file: pa.NativeFile, start: int, stop: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(position, line) of the lines that begin in [start, stop) of a file whose lines are read up to ``end``; ``start`` is
    where a line begins or a chunk's edge, in which case the line across it belongs to the chunk before."""
    at, rest = start, b""
    file.seek(at)
    while at + len(rest) < end:
        data = rest + file.read(min(BLOCK, end - at - len(rest)))
        if len(data) == len(rest):
            break
        *whole, rest = data.split(b"\n")
        for line in whole:
            if at >= stop:
                return
            yield at, line
            at += len(line) + 1
    if rest and at < stop:
        yield at, rest


def first_line(file: pa.NativeFile, edge: int, end: int) -> int:
    """Where the first line at or behind a chunk's edge begins."""
    at = edge - 1
    file.seek(at)
    while at < end:
        data = file.read(min(1 << 16, end - at))
        found = data.find(b"\n")
        if found >= 0:
            return at + found + 1
        if not data:
            break
        at += len(data)
    return end


def text_of(line: bytes) -> str:
    return line.removesuffix(b"\r").decode("utf-8", "replace")


def listed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(idx, path, length) of the files that paths, folders or globs name; Spark lists them without reading them."""
    out = spark.createDataFrame([], "idx int, path string, length bigint")
    for i, p in enumerate(paths):
        out = out.unionByName(spark.read.format("binaryFile").load(p).select(F.lit(i).alias("idx"), "path", "length"))
    return out.groupBy("path").agg(F.min("idx").alias("idx"), F.max("length").alias("length"))


def pending(spark: SparkSession, paths: list[str], offsets: DataFrame | None = None, unfinished: str = "read") -> DataFrame:
    """A row per file: path, idx, start (where to go on), end, base (bytes to read of the files before it) and the head's
    head_bytes and head.

    ``unfinished``: a last line without a line feed is read as it is ("read") or waits until it is finished ("wait").
    """
    if unfinished not in ("read", "wait"):
        raise ValueError(unfinished)
    known = spark.createDataFrame([], OFFSETS) if offsets is None else offsets
    files = listed(spark, paths).join(known.select("path", F.struct("offset", "head_bytes", "head").alias("known")), "path", "left")
    waits = unfinished == "wait"

    def look(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                fs, name = opened(r["path"])
                size, known = r["length"], r["known"]
                with fs.open_input_file(name) as f:
                    start = resume_at(f, size, known and (known["offset"], known["head_bytes"], known["head"]))
                    end = line_end(f, start, size) if waits else size
                    n = min(HEAD, end)
                    out.append((r["path"], r["idx"], start, end, n, head_of(f, n)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 6, _FILE_TYPES, strict=True)], names=["path", "idx", "start", "end", "head_bytes", "head"])

    from pyspark.sql import Window

    looked = files.repartition(F.col("path")).mapInArrow(look, "path string, idx int, start bigint, end bigint, head_bytes int, head string")
    before = Window.orderBy("idx", "path").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return looked.withColumn("base", F.coalesce(F.sum(F.col("end") - F.col("start")).over(before), F.lit(0)))


_FILE_TYPES = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string()]


def read_pending(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(seq, path, position, value) of the lines that ``pending`` found: a task reads at most ``chunk`` bytes and the end of
    its last line.  seq follows the order of the files and of their lines; bad bytes are replaced."""
    ranges = files.where("end > start").select("path", "start", "end", "base", F.explode(F.sequence("start", F.col("end") - 1, F.lit(chunk).cast("bigint"))).alias("at"))

    def read(batches):
        for batch in batches:
            for r in batch.to_pylist():
                fs, name = opened(r["path"])
                seqs, positions, values = [], [], []
                with fs.open_input_file(name) as f:
                    begin = r["at"] if r["at"] == r["start"] else first_line(f, r["at"], r["end"])
                    for at, line in lines_of(f, begin, r["at"] + chunk, r["end"]):
                        seqs.append(r["base"] + at - r["start"])
                        positions.append(at)
                        values.append(text_of(line))
                        if len(values) >= LINES:
                            yield _lines(r["path"], seqs, positions, values)
                            seqs, positions, values = [], [], []
                yield _lines(r["path"], seqs, positions, values)

    spread = ranges.repartition(F.col("path"), F.col("at"))
    return spread.mapInArrow(read, "seq bigint, path string, position bigint, value string")


def _lines(path: str, seqs: list, positions: list, values: list) -> pa.RecordBatch:
    arrays = [pa.array(seqs, pa.int64()), pa.array([path] * len(values), pa.string()), pa.array(positions, pa.int64()), pa.array(values, pa.string())]
    return pa.RecordBatch.from_arrays(arrays, names=["seq", "path", "position", "value"])


def new_offsets(files: DataFrame) -> DataFrame:
    """The offsets after ``files`` (of ``pending``) were read."""
    return files.select("path", F.col("end").alias("offset"), "head_bytes", "head")


def incremental_append(spark: SparkSession, paths: list[str], offsets: DataFrame | None = None, unfinished: str = "read") -> tuple[DataFrame, DataFrame]:
    """The lines that came since ``offsets``, and the offsets after them.  Both stand on a stored list of files, so a file
    that grows meanwhile is read up to the same place however often the tables are computed."""
    from sawmill.plans.stored import stored

    files = stored(pending(spark, paths, offsets, unfinished), "files")
    return read_pending(files), new_offsets(files)


def write_files(lines: DataFrame, root: str) -> DataFrame:
    """Writes (name, seq, value) as text files ``root``/name, a file a task, in order of seq; (name, bytes) of each.  A file
    appears whole: it is renamed once it is closed, so a task that runs again does no harm."""

    def write(batches):
        import uuid

        fs, folder = opened(root)
        fs.create_dir(folder, recursive=True)
        name, out, tmp, done = None, None, "", []

        def close():
            done.append((name, out.tell()))
            out.close()
            fs.move(tmp, f"{folder}/{name}")

        for batch in batches:
            for n, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if n != name:
                    if out:
                        close()
                    name, tmp = n, f"{folder}/.{n}.{uuid.uuid4().hex}"
                    out = fs.open_output_stream(tmp)
                out.write(v.encode() + b"\n")
        if out:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.string()), pa.array([b for _, b in done], pa.int64())], names=["name", "bytes"])

    return lines.repartition(F.col("name")).sortWithinPartitions("name", "seq").select("name", "value").mapInArrow(write, "name string, bytes bigint")


class FileRange(InputPartition):
    def __init__(self, path: str, start: int, stop: int, end: int):
        self.path, self.start, self.stop, self.end = path, start, stop, end


def matching(pattern: str) -> list[tuple[str, int]]:
    """(path, size) of the files that a path or a glob in its last part names, in order."""
    fs, name = opened(pattern)
    prefix = pattern[: len(pattern) - len(name)]
    if not any(c in name for c in "*?["):
        info = fs.get_file_info(name)
        if info.type == pfs.FileType.Directory:
            found = fs.get_file_info(pfs.FileSelector(name))
        else:
            found = [info]
    else:
        found = fs.get_file_info(pfs.FileSelector(name.rsplit("/", 1)[0] or "/", allow_not_found=True))
        found = [i for i in found if fnmatch.fnmatch(i.base_name, name.rsplit("/", 1)[1])]
    return sorted((prefix + i.path, i.size) for i in found if i.type == pfs.FileType.File and not i.base_name.startswith("."))


class GrowingFilesReader(DataSourceStreamReader):
    """Only whole lines are read: the last one waits for its line feed."""

    def __init__(self, pattern: str):
        self.pattern = pattern
        self.known: dict[str, list] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self, *_) -> dict:
        now = {}
        for path, size in matching(self.pattern):
            fs, name = opened(path)
            with fs.open_input_file(name) as f:
                before = self.known.get(path)
                start = resume_at(f, size, before and tuple(before))
                end = line_end(f, start, size)
                now[path] = [end, min(HEAD, end), head_of(f, min(HEAD, end))]
        self.known = now
        return {"files": json.dumps(now)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        known, now = json.loads(start["files"]), json.loads(end["files"])
        out = []
        for path, (size, _, _) in now.items():
            fs, name = opened(path)
            with fs.open_input_file(name) as f:
                before = known.get(path)
                begin = at = resume_at(f, size, before and tuple(before))
                while at < size:
                    to = min(size, at + CHUNK)
                    out.append(FileRange(path, at if at == begin else first_line(f, at, size), to, size))
                    at = to
        return out

    def read(self, part: InputPartition) -> Iterator[tuple]:
        fs, name = opened(part.path)
        with fs.open_input_file(name) as f:
            for at, line in lines_of(f, part.start, part.stop, part.end):
                yield part.path, at, text_of(line)

    def commit(self, end: dict) -> None:
        pass


class GrowingFiles(DataSource):
    """spark.readStream.format("growing_files").option("path", "/logs/*.log"): path, position, value."""

    @classmethod
    def name(cls) -> str:
        return "growing_files"

    def schema(self) -> str:
        return "path string, position bigint, value string"

    def streamReader(self, schema) -> GrowingFilesReader:
        return GrowingFilesReader(self.options["path"])
