"""File trees, text, format detection and snapshots."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.functions.text import classify_path
from estatelens.sources.ranges import PEEK, WHOLE, read_files, walked


def scan_files(spark: SparkSession, root: str, whole: int = WHOLE) -> DataFrame:
    """rel_path, size_bytes, mtime, sha256, category and content of every file below root, hidden and empty ones included.

    An empty tree gives no rows, a missing one raises OSError. Files may have any size: they are hashed as streams, and the
    content of those of more than `whole` bytes is null. A file that can't be read has neither hash nor content.
    """
    base = "/" + re.sub(r"^[a-z0-9+.-]+:(//[^/]*)?", "", root).strip("/") + "/"
    rel = F.replace(F.substring_index(F.regexp_replace("path", r"^[a-z0-9+.-]+:(//[^/]*)?", ""), base, -1), F.lit("\\"), F.lit("/"))
    read = read_files(walked(spark, root), whole)
    return read.select(rel.alias("rel_path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"), "sha256", classify_path(rel).alias("category"), "content")


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 text, bad bytes replaced."""
    return F.make_valid_utf8(content.cast("string"))


def read_source_text(files: DataFrame) -> DataFrame:
    """Files with `content` as text."""
    return files.withColumn("content", decoded(F.col("content")))


def detect_format(files: DataFrame) -> DataFrame:
    """Add `format`, judged by name and first bytes: sectioned_xml, usage_sheet, kpi_chunks, sizing_report,
    readiness_docx, or null. files: rel_path, and head and tail (the first and last bytes, as `peeked` reads them) or content.
    A ZIP's member names stand in its directory, at its end."""
    first, last = (F.col("head"), F.col("tail")) if "head" in files.columns else (F.substring("content", 1, PEEK), F.substring("content", -PEEK, PEEK))
    low, head = F.lower("rel_path"), decoded(first)
    names = F.decode(last, "ISO-8859-1")
    is_zip = F.hex(F.substring(first, 1, 4)) == "504B0304"
    found = (
        F.when(low.endswith(".docx") & (low.contains("readiness") | is_zip & names.contains("word/document.xml")), "readiness_docx")
        .when(low.endswith(".xlsx") & is_zip, "usage_sheet").when(low.endswith(".txt") & (low.contains("sizing") | head.rlike("(?i)SIZING RESULTS IN GiB|HDB_SIZING|HANA_SIZING")), "sizing_report")
        .when(low.endswith(".json") & head.contains('"dataSet"'), "kpi_chunks").when(is_zip & names.rlike(r"(?i)\.json"), "kpi_chunks")
        .when(low.endswith(".xml") & head.rlike(r"<\w+[^>]*>\s*<[A-Z0-9_]+[^>]*>\s*<\w+ "), "sectioned_xml").when(is_zip & names.rlike(r"(?i)\.xml"), "sectioned_xml")
    )
    return files.withColumn("format", found)


#: Language of a category's files (fixed values).
LANGUAGES = {"abap_source": "abap", "xml_metadata": "xml", "cds": "cds", "ddic": "abap", "configuration": "yaml", "documentation": "markdown"}


def source_snippet(objects: DataFrame, files: DataFrame, max_bytes: int = 512_000) -> DataFrame:
    """object_id, rel_path, language, snippet, is_truncated: bounded source of each object's file; paths that leave the
    root give no row. files: id, rel_path, category, content (bytes or text)."""
    own = files.where(~F.col("rel_path").rlike(r"(^|/)\.\.(/|$)") & ~F.col("rel_path").startswith("/"))
    data = F.col("content").cast("binary")
    language = F.lit("text")
    for category, name in LANGUAGES.items():
        language = F.when(F.col("category") == category, name).otherwise(language)
    cut = own.select(F.col("id").alias("source_file_id"), "rel_path", language.alias("language"), decoded(F.substring(data, 1, max_bytes)).alias("snippet"), (F.octet_length(data) > max_bytes).alias("is_truncated"))
    return objects.select(F.col("id").alias("object_id"), "source_file_id").join(cut, "source_file_id").drop("source_file_id")


def write_snapshot(df: DataFrame, path: str, partition: str = "assessment_id") -> None:
    """Replace the written partitions of a table, and only those."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
