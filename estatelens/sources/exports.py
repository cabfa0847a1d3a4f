"""KPI chunks, sizing reports and readiness documents (S10-S13), and the registry of readers."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from estatelens.functions.text import last_wins, record_fingerprint, strip_all
from estatelens.operators.extract import lines_of
from estatelens.sources import archives
from estatelens.sources.ranges import listed

CHUNK = "dataSet struct<serviceName:string,serviceDescr:string,serviceType:string,keyFigureId:string,timestamp:string,completed:string,header:array<string>,data:array<array<string>>>"


def read_kpi_members(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, member, text, error of every JSON and XML file: members of ZIPs, or files of a directory.

    A ZIP's directory is read first and its members are dealt over tasks by their place in it, so no archive is a row or a
    task. A ZIP that can't be read gives one row with its name and the error, a damaged member one with its own.
    """
    found = archives.list_members(listed(spark, path), (".json", ".xml"), (".json", ".xml"))
    return archives.read_texts(archives.dealt(found)).withColumn("member", F.coalesce("member", F.substring_index("file", "/", -1)))


def read_kpi_chunks(members: DataFrame) -> DataFrame:
    """file, member, row_index, key_figure_id, service_name, service_descr, service_type, timestamp, header, cells, payload (map of
    header to value), warning.

    One row for each data row of a chunk; a JSON member without a data set, and a file or member that can't be read, gives
    one row with a warning. Of equal header names the last wins in the payload.
    """
    parsed = members.where(F.lower("member").endswith(".json") & F.col("error").isNull()).select("file", "member", F.from_json("text", CHUNK).alias("c")).select("file", "member", "c.dataSet")
    texts = {"key_figure_id": "keyFigureId", "service_name": "serviceName", "service_descr": "serviceDescr", "service_type": "serviceType", "timestamp": "timestamp"}
    good = parsed.where("dataSet is not null").select("file", "member", *(F.col(f"dataSet.{c}").alias(n) for n, c in texts.items()), "dataSet.header", F.posexplode("dataSet.data").alias("row_index", "cells"))
    rows = good.select("file", "member", "row_index", *texts, "header", "cells", last_wins(F.transform("header", lambda h, i: F.struct(h.alias("key"), F.get(F.col("cells"), i).alias("value")))).alias("payload"), F.lit(None).cast("string").alias("warning"))
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name not in ("file", "member", "warning")]
    bad = parsed.where("dataSet is null").select("file", "member", *empty, F.concat(F.lit("no dataSet in "), "member").alias("warning"))
    broken = members.where("error is not null").select("file", "member", *empty, F.concat_ws(": ", "member", "error").alias("warning"))
    return rows.unionByName(bad).unionByName(broken)


def kpi_records(chunks: DataFrame, assessment_id: int | None = None, dataset_id: int | None = None) -> DataFrame:
    """Evidence records of KPI rows; they name no object."""
    key = F.concat_ws(":", "member", F.col("row_index").cast("string"))
    kept = ("key_figure_id", "service_name", "service_descr", "service_type", "timestamp")
    payload = F.create_map(*(x for c in kept for x in (F.lit(c), F.col(c))), F.lit("header"), F.to_json("header"), F.lit("row"), F.to_json("cells"))
    return chunks.where("warning is null").select(
        F.lit(assessment_id).cast("long").alias("assessment_id"), F.lit(dataset_id).cast("long").alias("dataset_id"), F.lit("signavio_kpi_observation").alias("record_type"), F.lit("PROCESS_KPI").alias("capability"),
        key.alias("source_key"), record_fingerprint(key).alias("record_fingerprint"), F.lit(None).cast("string").alias("object_name"), F.lit(None).cast("string").alias("object_type"), F.lit(None).cast("string").alias("package_name"), payload.alias("payload"), "file",
    )


def kpi_manifest(members: DataFrame) -> DataFrame:
    """One row: n_chunks, n_key_figures, n_warnings (unreadable files among them), and the <KEY>/<VALUE> pairs of the XML
    members as metadata."""
    chunks = members.where(F.lower("member").endswith(".json") & F.col("error").isNull()).select(F.from_json("text", CHUNK).alias("c"))
    counts = chunks.agg(F.count_if(F.col("c.dataSet").isNotNull()).alias("n_chunks"), F.count_distinct("c.dataSet.keyFigureId").alias("n_key_figures"), F.count_if(F.col("c.dataSet").isNull()).alias("n_warnings"))
    pattern = r"<KEY>([^<]*)</KEY>\s*<VALUE>([^<]*)</VALUE>"
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("key"), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("value"))
    listed = members.where(F.lower("member").endswith(".xml")).select(F.explode(pairs).alias("p")).select(F.col("p.key").alias("key"), F.col("p.value").alias("value"))
    # a system describes itself in a few dozen pairs, so their map is a small row
    meta = listed.groupBy("key").agg(F.min("value").alias("value")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("metadata"))
    broken = members.agg(F.count_if(F.col("error").isNotNull()).alias("n_broken"))
    one = [x.withColumn("_one", F.lit(1)) for x in (counts, meta, broken)]  # three aggregates of a row each
    joined = one[0].join(one[1], "_one").join(one[2], "_one")
    return joined.select("n_chunks", "n_key_figures", (F.col("n_warnings") + F.col("n_broken")).alias("n_warnings"), "metadata")


def parsed_number(text: Column) -> Column:
    """European number: dots group, the comma is decimal; null if it is none."""
    return F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def _columns(row: Column) -> Column:
    return F.filter(F.transform(F.split(strip_all(row), r"(?U)\s{2,}"), strip_all), lambda c: c != "")


RULE = "^-{10,}$"



def _boxed_lines(files: DataFrame) -> DataFrame:
    """file, pos, line, n_rules (rule lines up to here); a box lies between an odd and the following even rule line."""
    lines = files.select("file", F.posexplode(lines_of(F.col("text"))).alias("pos", "line")).withColumn("line", strip_all(F.col("line")))
    rules = F.sum(F.col("line").rlike(RULE).cast("int")).over(Window.partitionBy("file").orderBy("pos"))
    return lines.withColumn("n_rules", rules)


def parse_sizing_report(files: DataFrame, assessment_id: int | None = None, dataset_id: int | None = None) -> DataFrame:
    """Evidence records of the boxes of ASCII sizing reports (file, text).

    Inside a box a line of dashes between bars ends the header; rows have two columns at least. A first column that looks
    like an object name makes an object row, any other a metric row. Payload: label, values as `raw`, `parsed` lists.
    """
    box = F.col("n_rules")
    inner = _boxed_lines(files).where((box % 2 == 1) & F.col("line").startswith("|") & F.col("line").endswith("|") & (F.length("line") > 1))
    inner = inner.select("file", "pos", F.expr("(n_rules - 1) div 2").alias("box_index"), F.expr("substring(line, 2, length(line) - 2)").alias("body"))
    is_rule = strip_all(F.col("body")).rlike(RULE)
    order = Window.partitionBy("file", "box_index").orderBy("pos")
    marked = inner.withColumns({"rule": is_rule, "after": F.sum(is_rule.cast("int")).over(order) > 0})
    header = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(strip_all(F.col("body")) != "", F.struct("pos", "body")))), lambda x: F.regexp_replace(strip_all(x["body"]), r"(?U)\s+", " ")), " ")
    headers = marked.where("not after").groupBy("file", "box_index").agg(header.alias("section"))
    rows = marked.where("after and not rule").withColumn("cols", _columns(F.col("body"))).where(F.size("cols") > 0)
    rows = rows.withColumn("row_index", F.row_number().over(order) - 1).where(F.size("cols") >= 2).join(headers, ["file", "box_index"], "left")
    label = F.get("cols", 0)
    named = label.rlike("^[A-Z0-9_/]{2,30}$")
    key = F.concat(F.lit("box-"), F.col("box_index").cast("string"), F.lit(":row-"), F.col("row_index").cast("string"))
    values = F.transform(F.slice("cols", 2, F.size("cols")), lambda v: F.struct(v.alias("raw"), parsed_number(v).alias("parsed")))
    return rows.select(
        F.lit(assessment_id).cast("long").alias("assessment_id"), F.lit(dataset_id).cast("long").alias("dataset_id"), F.when(named, "hana_sizing_table_metric").otherwise("hana_sizing_metric").alias("record_type"),
        F.lit("USAGE_SIGNAL").alias("capability"), key.alias("source_key"), record_fingerprint(key).alias("record_fingerprint"), F.when(named, label).alias("object_name"), label.alias("label"), values.alias("values"), "section", "file",
    )


def sizing_metadata(files: DataFrame, most: int = 50) -> DataFrame:
    """file, key, value of the two-column lines outside tables, the first `most` keys of a file; of equal keys the last wins."""
    loose = _boxed_lines(files).where(~F.col("line").startswith("|") & ~F.col("line").rlike(RULE)).withColumn("cols", _columns(F.col("line"))).where(F.size("cols") == 2)
    pairs = loose.select("file", "pos", F.rtrim(F.get("cols", 0), F.lit(":")).alias("key"), F.get("cols", 1).alias("value"))
    first = pairs.groupBy("file", "key").agg(F.min("pos").alias("at"), F.max_by("value", "pos").alias("value"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("at"))).where(F.col("n") <= most).select("file", "key", "value")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_document_tables(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, table_index, row_index (-1 for the header row), cells, error of every table of word-processor documents.

    A file that is no such document gives one row with its error and nothing else; one without tables gives none.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for file, content in zip(rows["path"], rows["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as box:
                        root = ElementTree.fromstring(box.read("word/document.xml")).find(f"{_W}body")
                    found, error = ([] if root is None else root.findall(f"{_W}tbl")), None
                except (*archives.DAMAGE, ElementTree.ParseError) as problem:
                    found, error = [], f"not a document: {problem}"
                out = []
                for t, table in enumerate(found):
                    for r, row in enumerate(table.findall(f"{_W}tr")):
                        texts = ["\n".join("".join(x.text or "" for x in p.iter(f"{_W}t")) for p in cell.findall(f"{_W}p")).strip() for cell in row.findall(f"{_W}tc")]
                        out.append((file, t, r - 1, texts, None))
                if error:
                    out.append((file, None, None, None, error))
                yield pd.DataFrame(out, columns=["file", "table_index", "row_index", "cells", "error"]).astype({"table_index": "Int32", "row_index": "Int32"})

    return listed(spark, path).select("path", "content").mapInPandas(work, "file string, table_index int, row_index int, cells array<string>, error string")


def table_kind(headers: Column) -> Column:
    """Kind of a readiness table by its headers; null if it is not recognised."""
    joined = F.array_join(headers, " | ")
    title = joined.contains("Simplification item title") | F.array_contains(headers, "Title")
    return (
        F.when(joined.contains("Check Type") & joined.contains("Number Issues Found"), "custom_code_check").when(title & (joined.contains("Effort Ranking") | joined.contains("Compatibility Scope ID")), "simplification_item")
        .when(F.array_contains(headers, "Table") & (joined.contains("Size On Disk") | joined.contains("GiB")), "table_volume").when(F.array_contains(headers, "SID") & (F.size(headers) <= 6), "system_metadata")
    )


def readiness_manifest(tables: DataFrame) -> DataFrame:
    """file, kind, n: tables of each kind; not recognised ones under `unrecognized`."""
    return tables.where("row_index = -1").groupBy("file", F.coalesce(table_kind(F.col("cells")), F.lit("unrecognized")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def parse_readiness_tables(tables: DataFrame, assessment_id: int | None = None, dataset_id: int | None = None) -> DataFrame:
    """Evidence records of the recognised tables but system metadata; rows with no text at all are left out."""
    heads = tables.where("row_index = -1").select("file", "table_index", F.col("cells").alias("headers"), table_kind(F.col("cells")).alias("kind")).where("kind is not null and kind <> 'system_metadata'")
    rows = tables.where("row_index >= 0").join(heads, ["file", "table_index"]).where(F.exists("cells", lambda c: c != ""))
    entries = F.transform("cells", lambda c, i: F.struct(F.coalesce(F.get("headers", i), F.concat(F.lit("col_"), i.cast("string"))).alias("key"), c.alias("value")))
    first = F.get("cells", 0)
    key = F.concat(F.lit("table-"), F.col("table_index").cast("string"), F.lit(":row-"), F.col("row_index").cast("string"))
    return rows.select(
        F.lit(assessment_id).cast("long").alias("assessment_id"), F.lit(dataset_id).cast("long").alias("dataset_id"), F.concat(F.lit("readiness_check_"), "kind").alias("record_type"),
        F.when(F.col("kind") == "table_volume", "USAGE_SIGNAL").otherwise("S4_CONVERSION_SIGNAL").alias("capability"), key.alias("source_key"), record_fingerprint(key).alias("record_fingerprint"),
        F.when((F.col("kind") == "table_volume") & first.rlike("^[A-Z0-9_/]{2,30}$"), first).alias("object_name"), F.lit(None).cast("string").alias("object_type"), last_wins(entries).alias("payload"), "file",
    )
