"""Files of any size: listed by Spark, opened in tasks, read as streams or by ranges."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.storage import checkpointed

#: Up to this size Spark reads a file whole into a row; larger ones are read in tasks, as streams or by ranges.
WHOLE = 64 << 20
PEEK = 1 << 16
_BLOCK = 1 << 22


def listed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, length, modificationTime and content of all files at or below a path, several or a glob; Spark reads the
    content of those files only whose content is asked for, and filters on the length before. It leaves out empty files and
    such whose names begin with a dot or underscore; `walked` does not."""
    with few_listing_tasks(spark):
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


@contextmanager
def few_listing_tasks(spark: SparkSession, most: int = 64) -> Iterator[None]:
    """While it lasts, readers list many paths in `most` tasks; Spark would start a task for each path, up to 10,000."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), most)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def spread(files: DataFrame, each: int = 500) -> DataFrame:
    """files (path and others, without content) dealt over tasks of about `each`: Spark packs some thirty small files into a
    task, so few that starting its Python worker would take longer than the work."""
    return files.repartition(max(1, -(-files.count() // each)))


def plain(file_path: Column) -> Column:
    """The path of a file as `listed` gives it, from the metadata of Spark's other readers (there it is a URL)."""
    return F.coalesce(F.try_url_decode(F.replace(file_path, F.lit("+"), F.lit("%2B"))), file_path)


def located(path: str) -> tuple[object, str]:
    """The pyarrow file system of a path as `listed` gives it, and the path there. Raises OSError for those that pyarrow has not."""
    from pyarrow import fs

    found = re.match(r"([a-z0-9+.-]+):(?://([^/]*))?(.*)", path, re.DOTALL)
    scheme, host, rest = found.groups() if found else ("file", "", path)
    if scheme == "file":
        return fs.LocalFileSystem(), rest
    try:
        where = fs.FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme)}://{host or ''}{quote(rest)}")[0]
    except (ValueError, pa.ArrowInvalid, pa.ArrowNotImplementedError) as error:
        raise OSError(f"no access to {scheme} files: {error}") from error
    return where, rest if scheme in ("hdfs", "viewfs") else f"{host}{rest}"


def opened(path: str) -> BinaryIO:
    """A file at a path as `listed` gives it, open for reading anywhere. Raises OSError, also for file systems unknown to pyarrow."""
    where, at = located(path)
    return where.open_input_file(at)


FOUND = "path string, length long, modificationTime timestamp, folder boolean"


def _children(path: str) -> Iterator[tuple]:
    """(path, length, modificationTime, folder) of what a folder holds."""
    from pyarrow import fs

    where, at = located(path)
    base = path[: len(path) - len(at)]
    for x in where.get_file_info(fs.FileSelector(at, recursive=False)):
        if x.type in (fs.FileType.File, fs.FileType.Directory):
            yield f"{base}{x.path}", x.size, x.mtime, x.type == fs.FileType.Directory


def walked(spark: SparkSession, root: str, most_tasks: int = 1000) -> DataFrame:
    """path, length, modificationTime of every file below a folder, also empty ones and such whose names begin with a dot or
    underscore, which Spark's readers leave out.

    The tree is walked level by level, the folders of a level in parallel tasks, so neither the driver nor a task holds it.
    Raises OSError if there is no such folder or pyarrow does not know its file system.
    """
    types = {"path": pa.string(), "length": pa.int64(), "modificationTime": pa.timestamp("us", "UTC"), "folder": pa.bool_()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                columns = list(zip(*_children(path), strict=True)) or [()] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], names=list(types))

    where, at = located(root)
    if where.get_file_info(at).type.name != "Directory":
        raise FileNotFoundError(root)
    base = root[: len(root) - len(at)] or "file:"
    level, found = spark.createDataFrame([(f"{base}{at.rstrip('/') or '/'}",)], "path string"), []
    while True:
        inside = checkpointed(level.mapInArrow(work, FOUND))
        found.append(inside.where("not folder").drop("folder"))
        n = inside.where("folder").count()
        if not n:
            return reduce(DataFrame.unionAll, found)
        level = inside.where("folder").select("path").repartition(min(most_tasks, n))


def named(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path and length of the files that `listed` gives, but folders are walked in tasks: the driver, which holds every file that
    Spark lists, then holds none. Globs, single files and file systems that pyarrow has not are left to Spark."""
    walks, rest = [], []
    for one in [path] if isinstance(path, str) else path:
        full = _qualified(spark, one)
        (walks if _is_folder(full) else rest).append(full)
    found = []
    for root in walks:
        files = walked(spark, root).where("length > 0").withColumn("below", F.expr(f"substring(path, {len(root.rstrip('/')) + 2})"))
        hidden = F.exists(F.split("below", "/"), lambda x: x.startswith(".") | x.endswith("._COPYING_") | x.startswith("_") & ~x.contains("="))
        found.append(files.where(~hidden).select("path", "length"))
    if rest:
        found.append(listed(spark, rest).select("path", "length"))
    return reduce(DataFrame.unionAll, found)


def _qualified(spark: SparkSession, path: str) -> str:
    """The path (or glob) with scheme and host, as `listed` gives it."""
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    return held.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(held).toString()


def _is_folder(path: str) -> bool:
    if re.search(r"[\[\]{}*?\\]", path):  # a glob
        return False
    try:
        where, at = located(path)
        return where.get_file_info(at).type.name == "Directory"
    except OSError:
        return False


def _reachable(path: str) -> bool:
    try:
        return bool(located(path))
    except OSError:
        return False


def surveyed(spark: SparkSession, path: str | list[str], whole: int = WHOLE) -> DataFrame:
    """path, length, sha256, head and tail (the first and last PEEK bytes) of the files that `listed` gives, and error, in which
    case the three are null. Every file is read once, in tasks; what pyarrow can't reach is read by Spark, up to `whole` bytes."""
    roots = [_qualified(spark, one) for one in ([path] if isinstance(path, str) else path)]
    near, far = [x for x in roots if _reachable(x)], [x for x in roots if not _reachable(x)]
    found = [_ends(named(spark, near))] if near else []
    if far:
        files = listed(spark, far)
        small = files.where(F.col("length") <= whole).select("path", "length", F.sha2("content", 256).alias("sha256"), F.substring("content", 1, PEEK).alias("head"), F.substring("content", -PEEK, PEEK).alias("tail"), F.lit(None).cast("string").alias("error"))
        found += [small, _ends(files.where(F.col("length") > whole))]
    return reduce(DataFrame.unionAll, found)


def _ends(files: DataFrame, task_bytes: int = 128 << 20, each: int = 1000) -> DataFrame:
    """files (path, length) as `surveyed` gives them, read as streams by tasks of about task_bytes and `each` files."""
    types = {"path": pa.string(), "length": pa.int64(), "sha256": pa.string(), "head": pa.binary(), "tail": pa.binary(), "error": pa.string()}

    def of(path: str) -> tuple:
        digest, head, tail = hashlib.sha256(), b"", b""
        try:
            for block in streamed(path):
                digest.update(block)
                head += block[: PEEK - len(head)]
                tail = (tail + block)[-PEEK:]
        except OSError as problem:
            return None, None, None, str(problem)
        return digest.hexdigest(), head, tail, None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for k, (path, length) in enumerate(zip(batch["path"].to_pylist(), batch["length"].to_pylist(), strict=True), 1):
                rows.append((path, length, *of(path)))
                size += len(rows[-1][3] or b"") + len(rows[-1][4] or b"")
                if size >= _BLOCK or k == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)], names=list(types))
                    rows, size = [], 0

    total, n = files.agg(F.sum("length"), F.count(F.lit(1))).first()
    dealt = files.select("path", "length").repartition(max(1, -(-(total or 0) // task_bytes), -(-n // each)))
    return dealt.mapInArrow(work, "path string, length long, sha256 string, head binary, tail binary, error string")


def read_files(files: DataFrame, whole: int = WHOLE, task_bytes: int = 128 << 20) -> DataFrame:
    """files (path, length and others) with sha256, content and error. Files are read as streams and dealt over tasks of about
    task_bytes; the content of more than `whole` bytes is null, and so is all but the error of a file that can't be read."""
    added = {"sha256": pa.string(), "content": pa.binary(), "error": pa.string()}

    def read(path: str, length: int) -> tuple[str | None, bytes | None, str | None]:
        digest, held = hashlib.sha256(), []
        try:
            for block in streamed(path):
                digest.update(block)
                if length <= whole:
                    held.append(block)
        except OSError as problem:
            return None, None, str(problem)
        return digest.hexdigest(), b"".join(held) if length <= whole else None, None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows, size = 0, [], 0
            for k, (path, length) in enumerate(zip(batch["path"].to_pylist(), batch["length"].to_pylist(), strict=True), 1):
                rows.append(read(path, length))
                size += len(rows[-1][1] or b"")
                if size >= _BLOCK or k == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*batch.slice(at, k - at).columns, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), added.values(), strict=True))], names=[*batch.schema.names, *added])
                    at, rows, size = k, [], 0

    total, n = files.agg(F.sum("length"), F.count(F.lit(1))).first()
    spread = files.repartition(max(1, (total or 0) // task_bytes, n // 1000))
    return spread.mapInArrow(work, files.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("sha256", "string"), ("content", "binary"), ("error", "string")))).schema)


def streamed(path: str) -> Iterator[bytes]:
    with opened(path) as file:
        while block := file.read(_BLOCK):
            yield block


def hashed(files: DataFrame) -> DataFrame:
    """files (path and others) with sha256, null with an `error` for a file that can't be read; files are read as streams."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, path in enumerate(batch["path"].to_pylist()):
                digest, error = hashlib.sha256(), None
                try:
                    for block in streamed(path):
                        digest.update(block)
                except OSError as problem:
                    error = str(problem)
                yield pa.RecordBatch.from_arrays([*batch.slice(k, 1).columns, pa.array([None if error else digest.hexdigest()], pa.string()), pa.array([error], pa.string())], names=[*batch.schema.names, "sha256", "error"])

    return files.mapInArrow(work, files.select("*", *(F.lit(None).cast("string").alias(c) for c in ("sha256", "error"))).schema)


def peeked(spark: SparkSession, path: str | list[str], whole: int = WHOLE) -> DataFrame:
    """path, length, head, tail: the first and the last PEEK bytes of every file; both null where they can't be read."""
    files = listed(spark, path)
    small = files.where(F.col("length") <= whole).select("path", "length", F.substring("content", 1, PEEK).alias("head"), F.substring("content", -PEEK, PEEK).alias("tail"))

    def ends(path: str, length: int) -> tuple[bytes | None, bytes | None]:
        try:
            with opened(path) as file:
                head = file.read(PEEK)
                file.seek(max(0, length - PEEK))
                return head, file.read(PEEK)
        except OSError:
            return None, None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ends(path, length) for path, length in zip(batch["path"].to_pylist(), batch["length"].to_pylist(), strict=True)]
            heads, tails = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.binary()), pa.array(tails, pa.binary())], names=[*batch.schema.names, "head", "tail"])

    large = spread(files.where(F.col("length") > whole).select("path", "length")).mapInArrow(work, "path string, length long, head binary, tail binary")
    return small.unionByName(large)
