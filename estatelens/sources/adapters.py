"""Adapters of export formats: what a data set is, what it holds, and its records (the extension surface of the readers).

A data set is a file, known by the hash of its bytes: the same bytes under two names are one data set, and records of two
data sets never meet, however their keys read. `import_all` works a ledger off batch by batch and goes on where it stopped.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.operators.changes import new_rows
from estatelens.sources import exports, workbook, xml_sections
from estatelens.sources.files import decoded, detect_format
from estatelens.sources.ranges import WHOLE, hashed, listed, peeked, spread, surveyed
from estatelens.storage import checkpointed

#: Columns that the records of every format share; what else a reader gives is left to its own callers. dataset_id is the
#: sha256 of the file, source_key and record_fingerprint are unique inside it.
RECORD = ("dataset_id", "record_type", "capability", "source_key", "record_fingerprint", "object_name")
KEYS = ["dataset_id", "record_fingerprint"]
Paths = str | list[str]


@dataclass(frozen=True)
class Adapter:
    """records: (spark, paths) to evidence records with the path of their file as `file`; manifest: (spark, paths) to a small
    table of what the files hold."""

    records: Callable[[SparkSession, Paths], DataFrame]
    manifest: Callable[[SparkSession, Paths], DataFrame]


def _texts(spark: SparkSession, path: Paths) -> DataFrame:
    return listed(spark, path).select(F.col("path").alias("file"), decoded(F.col("content")).alias("text"))


def _sizing_manifest(spark: SparkSession, path: Paths) -> DataFrame:
    return exports.parse_sizing_report(_texts(spark, path)).groupBy("record_type").agg(F.count(F.lit(1)).alias("n"))


#: By the names that detect_format gives. Callers may pass others of their own to the functions below.
ADAPTERS = {
    "sectioned_xml": Adapter(lambda spark, path: xml_sections.curate_sections(xml_sections.read_sectioned_xml(spark, path)), lambda spark, path: xml_sections.section_manifest(xml_sections.read_sectioned_xml(spark, path))),
    "usage_sheet": Adapter(lambda spark, path: workbook.read_usage_report(workbook.read_findings_sheet(spark, path)), lambda spark, path: workbook.usage_report_manifest(workbook.read_findings_sheet(spark, path))),
    "kpi_chunks": Adapter(lambda spark, path: exports.kpi_records(exports.read_kpi_chunks(exports.read_kpi_members(spark, path))), lambda spark, path: exports.kpi_manifest(exports.read_kpi_members(spark, path))),
    "sizing_report": Adapter(lambda spark, path: exports.parse_sizing_report(_texts(spark, path)), _sizing_manifest),
    "readiness_docx": Adapter(lambda spark, path: exports.parse_readiness_tables(exports.read_document_tables(spark, path)), lambda spark, path: exports.readiness_manifest(exports.read_document_tables(spark, path))),
}


def detect(spark: SparkSession, path: Paths, whole: int = WHOLE) -> DataFrame:
    """(rel_path, format) of the files at a path; format is null for those that no adapter reads. Only the first and last
    bytes of files of more than `whole` bytes are read."""
    return detect_format(peeked(spark, path, whole).withColumnRenamed("path", "rel_path")).select("rel_path", "format")


def data_sets(spark: SparkSession, path: Paths, whole: int = WHOLE) -> DataFrame:
    """(file, size_bytes, dataset_id, error) of the files at a path; what can't be read has an error and no id."""
    files = listed(spark, path)
    small = files.where(F.col("length") <= whole).select("path", "length", F.sha2("content", 256).alias("sha256"), F.lit(None).cast("string").alias("error"))
    large = hashed(spread(files.where(F.col("length") > whole).select("path", "length"), 1))
    return small.unionByName(large).select(F.col("path").alias("file"), F.col("length").alias("size_bytes"), F.col("sha256").alias("dataset_id"), "error")


def plan_batches(spark: SparkSession, path: Paths, most: int = 64) -> DataFrame:
    """(format, batch, files): the readable files of each format dealt to batches of about `most` by their paths; what is
    imported one batch at a time can be taken up again after any of them."""
    found = detect(spark, path).where("format is not null")
    dealt = _dealt(found, "rel_path", F.count(F.lit(1)) / most)
    return dealt.groupBy("format", "batch").agg(F.array_sort(F.collect_list("rel_path")).alias("files"))


def _dealt(files: DataFrame, key: str, parts) -> DataFrame:
    """files (format and others) with `batch`, from 0 below `parts` of their format, by the hash of a key."""
    counts = files.groupBy("format").agg(F.greatest(F.ceil(parts), F.lit(1)).cast("int").alias("_parts"))
    return files.join(counts, "format").withColumn("batch", F.pmod(F.xxhash64(key), F.col("_parts")).cast("int")).drop("_parts")


def inspect(spark: SparkSession, path: Paths, fmt: str, adapters: dict[str, Adapter] | None = None) -> DataFrame:
    """The manifest of the files at a path (or glob) of one format; ValueError for a format without adapter."""
    return _adapter(fmt, adapters).manifest(spark, path)


def import_batch(spark: SparkSession, path: Paths, fmt: str, existing: DataFrame, adapters: dict[str, Adapter] | None = None, sets: DataFrame | None = None) -> DataFrame:
    """The records (RECORD) of the files at a path that `existing` does not have by data set and fingerprint, one for each:
    importing a batch again gives none, and equal keys of two files give two.

    sets: the files' data sets if they are known (file, dataset_id); else the files are hashed.
    """
    made = _adapter(fmt, adapters).records(spark, path)
    known = (data_sets(spark, path) if sets is None else sets).where("dataset_id is not null").select("file", "dataset_id")
    # the files, whose paths the driver has anyway, are sent to the records; Spark takes records for the smaller side
    own = made.select("file", *(c for c in RECORD if c != "dataset_id")).join(F.broadcast(known), "file").select(*RECORD)
    return new_rows(existing, own, KEYS, [F.asc("source_key"), F.asc_nulls_last("object_name")])


LEDGER = "file string, size_bytes long, dataset_id string, format string, batch int, run int"


def _written(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """What was written into a folder, nothing if it is not there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folder)


def ledger(spark: SparkSession, target: str) -> DataFrame:
    """file, size_bytes, dataset_id, format, batch, run, state of all data sets that import_all planned; state is PLANNED or DONE."""
    done = _written(spark, f"{target}/done", "run int, format string, batch int").distinct().withColumn("_done", F.lit(True))
    planned = _written(spark, f"{target}/ledger", LEDGER)
    return planned.join(done, ["run", "format", "batch"], "left").select(*planned.columns, F.when(F.col("_done"), "DONE").otherwise("PLANNED").alias("state"))


def imported(spark: SparkSession, target: str) -> DataFrame:
    """The records (RECORD) of all batches that are done; what a stopped batch left behind is not read."""
    rows = _written(spark, f"{target}/records", ", ".join(f"{c} string" for c in RECORD) + ", run int, format string, batch int")
    done = _written(spark, f"{target}/done", "run int, format string, batch int").distinct()
    return rows.join(done, ["run", "format", "batch"], "left_semi").select(*RECORD)


def import_all(spark: SparkSession, path: Paths, target: str, adapters: dict[str, Adapter] | None = None, batch_bytes: int = 16 << 30, batch_files: int = 10_000) -> int:
    """Import all data sets at a path that `target` does not have yet; returns how many batches it imported.

    A run first adds its new data sets to the ledger, dealt to batches of about batch_bytes and batch_files, then works off
    every batch, its own and earlier ones', that is not done: the records go into a folder of the batch, which a repeated
    batch replaces, and then the batch is noted as done. A run that was stopped anywhere is taken up by the next call; files
    that have come since are planned in a new run. Of files with the same bytes the one with the smallest path is read.
    Formats without adapter stay in the ledger of no run.
    """
    before = ledger(spark, target)
    seen = detect_format(surveyed(spark, path).withColumnRenamed("path", "rel_path")).where("error is null")
    read = seen.where(F.col("format").isin(*(ADAPTERS if adapters is None else adapters))).select(F.col("sha256").alias("dataset_id"), F.col("rel_path").alias("file"), F.col("length").alias("size_bytes"), "format")
    found = checkpointed(read.groupBy("dataset_id").agg(F.min(F.struct("file", "size_bytes", "format")).alias("f")))
    # merged, since a ledger of very many files is no table for the driver, however small its packed files are
    fresh = found.join(before.select("dataset_id").hint("merge"), "dataset_id", "left_anti").select("f.file", "f.size_bytes", "dataset_id", "f.format")
    run = (before.agg(F.max("run")).first()[0] or 0) + 1
    parts = F.greatest(F.sum("size_bytes") / batch_bytes, F.count(F.lit(1)) / batch_files)
    planned = checkpointed(_dealt(fresh, "dataset_id", parts).withColumn("run", F.lit(run)).select(*before.columns[:-1]))
    if not planned.isEmpty():
        planned.write.mode("append").parquet(f"{target}/ledger")
    open_ = ledger(spark, target).where("state = 'PLANNED'")
    batches = sorted(map(tuple, open_.select("run", "format", "batch").distinct().collect()))  # a row for each batch of files
    for number, fmt, batch in batches:
        sets = checkpointed(open_.where((F.col("run") == number) & (F.col("format") == fmt) & (F.col("batch") == batch)).select("file", "dataset_id"))
        files = [_literal(r["file"]) for r in sets.select("file").collect()]  # batch_files of them at about
        none = spark.createDataFrame([], ", ".join(f"{c} string" for c in RECORD))
        records = import_batch(spark, files, fmt, none, adapters, sets)
        records.write.mode("overwrite").parquet(f"{target}/records/run={number}/format={fmt}/batch={batch}")
        spark.createDataFrame([(number, fmt, batch)], "run int, format string, batch int").coalesce(1).write.mode("append").parquet(f"{target}/done")
    return len(batches)


def _literal(path: str) -> str:
    """A path that Spark does not take for a glob."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _adapter(fmt: str, adapters: dict[str, Adapter] | None) -> Adapter:
    known = ADAPTERS if adapters is None else adapters
    if fmt not in known:
        raise ValueError(f"no adapter for {fmt!r}; known: {', '.join(sorted(known))}")
    return known[fmt]
