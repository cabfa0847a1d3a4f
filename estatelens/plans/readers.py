"""Readers over files that are written from the driver's tables into the shared folder: S1-S16, P1, P4, ST1, X11.

A file holds a bounded number of rows, so their number grows with the tables.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.functions import text as T
from estatelens.operators import extract as X
from estatelens.plans.base import Inputs, Registry
from estatelens.sources import adapters, exports, files, workbook, xml_sections
from estatelens.sources.ranges import WHOLE, located
from estatelens.storage import checkpointed, scratch
from estatelens.streaming.intake import stream_intake

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

_SHEET = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>%s</sheetData></worksheet>'
_BOOK = '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="data" sheetId="1" r:id="r1"/></sheets></workbook>'
_LINKS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s1.xml"/></Relationships>'
_DOCUMENT = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>%s</w:body></w:document>'


def packed(name: str, text: str) -> bytes:
    """A file's bytes: its text, for .xlsx, .docx and .zip inside the ZIP that such a file is."""
    members = {
        ".xlsx": {"xl/workbook.xml": _BOOK, "xl/_rels/workbook.xml.rels": _LINKS, "xl/worksheets/s1.xml": _SHEET % text}, ".docx": {"word/document.xml": _DOCUMENT % text},
        ".zip": {name.rsplit("/", 1)[-1][:-4] + ("" if name.endswith(".xml.zip") else ".json"): text},
    }.get(name[name.rfind(".") :])
    if members is None:
        return text.encode()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as box:
        for member, body in members.items():
            box.writestr(member, body)
    return out.getvalue()


def written(i: Inputs, made: DataFrame, folder: str | None = None) -> str:
    """Write the files (name, content text or binary) into a folder that all executors share, else a new one; returns its path."""
    folder = folder or scratch(i.spark, "files")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = located(folder)
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"], strict=True):  # one by one, so a batch's texts are not held twice
                name, content = name.as_py(), content.as_py()
                full = f"{path}/{name}"
                where.create_dir(full.rsplit("/", 1)[0], recursive=True)
                with where.open_output_stream(full) as out:
                    out.write(content if isinstance(content, bytes) else packed(name, content))
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    with small_batches(i.spark):
        made.select("name", "content").mapInArrow(work, "n long").agg(F.sum("n")).collect()
    return folder


@contextmanager
def small_batches(spark: SparkSession, most: int = 100) -> Iterator[None]:
    """While it lasts, Python gets `most` rows at a time, not 10,000: of rows that hold a whole file a batch would be hundreds of MB."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written_lines(i: Inputs, lines: DataFrame, made: Callable[[int, str], tuple[str, str]], between: str = "\n") -> str:
    """Write files of which k is the number and line a line, as made(k, the lines joined) gives name and text; returns their new folder.

    lines: k, line, with the rows of a file one after the other and in order. A task holds one file and a batch of lines.
    """
    folder = scratch(i.spark, "files")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = located(folder)
        key, held, n = None, [], 0

        def write() -> None:
            if held:
                name, text = made(key, between.join(held))
                with where.open_output_stream(f"{path}/{name}") as out:
                    out.write(packed(name, text))

        for batch in batches:
            runs = pc.run_end_encode(batch["k"])
            parts = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, *runs.run_ends.to_pylist()], pa.int32()), batch["line"]), between)
            for k, part in zip(runs.values.to_pylist(), parts.to_pylist(), strict=True):
                if k != key:
                    write()
                    key, held, n = k, [], n + 1
                held.append(part)
        write()
        yield pa.RecordBatch.from_pydict({"n": [n]})

    lines.select("k", "line").mapInArrow(work, "n long").agg(F.sum("n")).collect()
    return folder


def joined(rows: DataFrame, key: Column, order: str, line: Column, between: str = "\n") -> DataFrame:
    """(k, body): the lines of each key in order (by sort_array, since array_sort compares through a lambda)."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))), lambda x: x["line"])
    return rows.groupBy(key.alias("k")).agg(F.array_join(listed, between).alias("body"))


def blocks(column: str, size: int) -> Column:
    return F.expr(f"{column} div {size}")


def number(name: str) -> Column:
    """The number in a file's name."""
    return F.regexp_extract(name, r"(\d+)\.\w+$", 1).cast("long")


def tree(i: Inputs, whole: int = WHOLE) -> DataFrame:
    body = joined(i.sources, blocks("id", 50), "id", F.col("content"))
    name = F.concat(F.lit("a/b c/g"), F.col("k").cast("string"), F.when(F.col("k") % 2 == 0, ".abap").otherwise(".md"))
    content = F.when(F.col("k") % 3 == 0, F.concat(F.encode("body", "UTF-8"), F.unhex(F.lit("FF")))).otherwise(F.encode("body", "UTF-8"))
    return files.scan_files(i.spark, written(i, body.select(name.alias("name"), content.alias("content"))), whole)


_TREE = ", g AS (SELECT id // 50 AS k, string_agg(content, chr(10) ORDER BY id) AS body FROM sources GROUP BY 1), n AS (SELECT *, concat('a/b c/g', k, CASE WHEN k % 2 = 0 THEN '.abap' ELSE '.md' END) AS rel_path FROM g)"


@query(_TREE + " SELECT rel_path, octet_length(encode(body)) + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS size_bytes, CASE WHEN k % 3 = 0 THEN sha256(encode(body) || unhex('FF')) ELSE sha256(encode(body)) END AS sha256, CASE WHEN k % 2 = 0 THEN 'abap_source' ELSE 'documentation' END AS category FROM n", "sources")
def s1_scan_files(i):
    return tree(i).select("rel_path", "size_bytes", "sha256", "category")


@query(_TREE + " SELECT rel_path, octet_length(encode(body)) + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS size_bytes, CASE WHEN k % 3 = 0 THEN sha256(encode(body) || unhex('FF')) ELSE sha256(encode(body)) END AS sha256, true AS content_left_out FROM n", "sources")
def s1_scan_large_files(i):
    """Every file read as a stream, as files of more than WHOLE bytes are."""
    return tree(i, 0).select("rel_path", "size_bytes", "sha256", F.col("content").isNull().alias("content_left_out"))


@query(_TREE + " SELECT rel_path, CASE WHEN k % 3 = 0 THEN concat(body, chr(65533)) ELSE body END AS content FROM n", "sources")
def s2_read_source_text(i):
    return files.read_source_text(tree(i)).select("rel_path", "content")


_XML = "p AS (SELECT p_partkey // 100 AS k, * FROM part)"


def xml_files(i: Inputs) -> DataFrame:
    """(k, content): sections of 100 parts a file, a known one of all, another of every second, one that is not known."""
    part = i.table("part")

    def section(name: str, rows: DataFrame, row: Column) -> DataFrame:
        body = joined(rows, blocks("p_partkey", 100), "p_partkey", row)
        return body.select("k", F.concat(F.lit(f"<{name}>\n"), "body", F.lit(f"\n</{name}>\n")).alias("body"), F.lit(name).alias("name"))

    known = section("REPOSITORY_OBJECTS", part, F.format_string('<ROW PGMID="R3TR" OBJECT="%s" OBJ_NAME="Z &amp; %s" DEVCLASS="%s"/>', F.col("p_type"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("")))
    second = section("WHERE_USED_TABLE", part.where("p_partkey % 2 = 0"), F.format_string("<R OTYPE='X' NAME='no' INCLUDE='I%s'></R>", F.col("p_partkey").cast("string")))
    other = section("OTHER", part.where("p_partkey % 3 = 0"), F.format_string('<A B="%s&#0;"/>', F.col("p_size").cast("string")))
    whole = joined(known.unionByName(second).unionByName(other), F.col("k"), "name", F.col("body"), "")
    content = F.concat(F.lit('<?xml version="1.0"?><ROOT>\n'), "body", F.lit("</ROOT>"))
    return whole.select("k", content.alias("content"))


def xml_rows(i: Inputs, suffix: Column | None = None) -> DataFrame:
    name = F.concat(F.lit("x"), F.col("k").cast("string"), F.lit(".xml") if suffix is None else suffix)
    return xml_sections.read_sectioned_xml(i.spark, written(i, xml_files(i).select(name.alias("name"), "content")))


_XML_ROWS = f"""WITH {_XML} SELECT k, 'REPOSITORY_OBJECTS' AS section, row_number() OVER (PARTITION BY k ORDER BY p_partkey) - 1 AS row_index, concat_ws('|', 'Z & ' || p_partkey, p_type, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END) AS seen FROM p
UNION ALL SELECT k, 'WHERE_USED_TABLE', row_number() OVER (PARTITION BY k ORDER BY p_partkey) - 1, concat('I', p_partkey) FROM p WHERE p_partkey % 2 = 0
UNION ALL SELECT k, 'OTHER', row_number() OVER (PARTITION BY k ORDER BY p_partkey) - 1, CAST(p_size AS VARCHAR) FROM p WHERE p_partkey % 3 = 0"""


def seen_rows(found: DataFrame) -> DataFrame:
    seen = F.concat_ws("|", *(F.try_element_at("attrs", F.lit(a)) for a in ("OBJ_NAME", "OBJECT", "DEVCLASS", "INCLUDE", "B")))
    return found.select(F.regexp_extract("file", r"x(\d+)\.xml[^/]*$", 1).cast("long").alias("k"), "section", "row_index", seen.alias("seen"))


@query(_XML_ROWS)
def s4_sectioned_xml(i):
    return seen_rows(xml_rows(i))


@query(_XML_ROWS)
def s4_sectioned_xml_of_zips(i):
    """Every second file inside a ZIP."""
    return seen_rows(xml_rows(i, F.when(F.col("k") % 2 == 0, ".xml.zip").otherwise(".xml")))


@query(f"""WITH {_XML}, r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p_partkey) - 1 AS n FROM p), w AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p_partkey) - 1 AS n FROM p WHERE p_partkey % 2 = 0)
SELECT 'panaya_repository_object' AS record_type, 'TECHNICAL_OBJECT_METADATA' AS capability, concat('REPOSITORY_OBJECTS:', n) AS source_key, substring(sha256(concat('REPOSITORY_OBJECTS:', n)), 1, 32) AS record_fingerprint, 'Z & ' || p_partkey AS object_name, p_type AS object_type, CASE WHEN p_size % 2 = 0 THEN p_brand END AS package_name FROM r
UNION ALL SELECT 'panaya_where_used', 'DEPENDENCY_SIGNAL', concat('WHERE_USED_TABLE:', n), substring(sha256(concat('WHERE_USED_TABLE:', n)), 1, 32), concat('I', p_partkey), NULL, NULL FROM w""")
def s6_curate_sections(i):
    return xml_sections.curate_sections(xml_rows(i)).select("record_type", "capability", "source_key", "record_fingerprint", "object_name", "object_type", "package_name")


@query("""SELECT 'REPOSITORY_OBJECTS' AS section, count(*) AS n_rows, 'DEVCLASS,OBJECT,OBJ_NAME,PGMID' AS attributes, 'TECHNICAL_OBJECT_METADATA' AS capability FROM part
UNION ALL SELECT 'WHERE_USED_TABLE', count(*), 'INCLUDE,NAME,OTYPE', 'DEPENDENCY_SIGNAL' FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'OTHER', count(*), 'B', NULL FROM part WHERE p_partkey % 3 = 0""")
def s7_section_manifest(i):
    return xml_sections.section_manifest(xml_rows(i)).withColumn("attributes", F.array_join("attributes", ","))


@query(r"SELECT doc_id, concat(regexp_replace(replace(text, '&', ''), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '&#x41;') AS clean FROM documents")
def s5_sanitize_xml(i):
    dirty = F.concat(F.lit("&#0;\x1c&#xFFFE;"), F.replace("text", F.lit("&"), F.lit("")), F.lit("&#\x012;&#x41;\x7f"))
    return i.table("documents").select("doc_id", T.sanitize_xml(dirty).alias("clean"))


def cells(*values: Column) -> Column:
    """The cells of a sheet's row; nulls are left out."""
    return F.concat(*(F.coalesce(F.concat(F.lit(f'<c r="{chr(65 + n)}'), F.col("r").cast("string"), F.lit('" t="inlineStr"><is><t>'), v, F.lit("</t></is></c>")), F.lit("")) for n, v in enumerate(values)))


def sheet(i: Inputs, rows: DataFrame, key: str, headers: list[str], *values: Column, large: int = workbook.LARGE) -> DataFrame:
    """A workbook for each key of rows (key, r from 2 on), read back."""
    head = F.lit('<row r="1">' + "".join(f'<c r="{chr(65 + n)}1" t="inlineStr"><is><t>{h}</t></is></c>' for n, h in enumerate(headers)) + "</row>")
    body = joined(rows, F.col(key), "r", F.concat(F.lit('<row r="'), F.col("r").cast("string"), F.lit('">'), cells(*values), F.lit("</row>")), "")
    folder = written(i, body.select(F.concat(F.lit("w"), F.col("k").cast("string"), F.lit(".xlsx")).alias("name"), F.concat(head, "body").alias("content")))
    return workbook.read_findings_sheet(i.spark, folder, large=large)


def finding_sheets(i: Inputs, large: int = workbook.LARGE) -> DataFrame:
    rows = i.table("events").select(F.expr("event_id div 500").alias("k"), (F.col("event_id") % 500 + 2).cast("int").alias("r"), "event_id", "event_type", "user_id")
    name = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" Z"), F.col("user_id").cast("string"), F.lit(" ")))
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("event_id") % 300).cast("int")), "dd.MM.yyyy")
    return sheet(i, rows, "k", ["Priority", " Check  Title", "Object name", "First Found On", "OWN", "Priority"], F.lit("9"), F.col("event_type"), name, day, F.lit("m"), F.when(F.col("event_id") % 5 == 0, "high").otherwise((F.col("event_id") % 4).cast("string")), large=large)


_SHEET_ROWS = ("SELECT event_id // 500 AS k, CAST(event_id % 500 + 2 AS INT) AS row_number, concat_ws('|', '9', event_type, CASE WHEN event_id % 3 = 0 THEN concat(' Z', user_id, ' ') ELSE '-' END, strftime(DATE '2024-01-01' + CAST(event_id % 300 AS INT), '%d.%m.%Y'), 'm', CASE WHEN event_id % 5 = 0 THEN 'high' ELSE CAST(event_id % 4 AS VARCHAR) END) AS seen FROM events")


def seen_cells(rows: DataFrame) -> DataFrame:
    seen = F.array_join(F.transform("cells", lambda c: F.coalesce(c, F.lit("-"))), "|")
    return rows.select(number("file").alias("k"), "row_number", seen.alias("seen"))


@query(_SHEET_ROWS)
def s3_findings_sheet(i):
    return seen_cells(finding_sheets(i))


@query(_SHEET_ROWS)
def s3_large_findings_sheet(i):
    """The same sheets laid out and cut at their rows, as those of more than LARGE bytes are."""
    return seen_cells(finding_sheets(i, 0))


@query("SELECT DISTINCT event_id // 500 AS k, 4 AS n_recognized, 'OWN' AS unknown, 17 AS n_missing, 'FULL' AS status FROM events")
def p1_map_headers(i):
    found = workbook.map_headers(finding_sheets(i))
    return found.select(number("file").alias("k"), F.size("recognized").alias("n_recognized"), F.array_join("unknown", ",").alias("unknown"), F.size("missing").alias("n_missing"), "status")


@query("SELECT event_id // 500 AS k, CAST(event_id % 500 + 2 AS INT) AS source_row_number, event_type AS check_title, CASE WHEN event_id % 3 = 0 THEN concat('Z', user_id) END AS object_name_raw, CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 4 AS INT) END AS priority, CAST(DATE '2024-01-01' + CAST(event_id % 300 AS INT) AS DATE) AS first_found_on, CASE WHEN event_id % 5 = 0 THEN 'invalid priority: high' ELSE '' END AS warnings FROM events")
def p4_normalize_finding_rows(i):
    found = workbook.normalize_finding_rows(finding_sheets(i))
    return found.select(number("file").alias("k"), "source_row_number", "check_title", "object_name_raw", "priority", "first_found_on", F.array_join("warnings", ",").alias("warnings"))


def usage_sheets(i: Inputs) -> DataFrame:
    rows = i.table("part").select(F.expr("p_partkey div 400").alias("k"), (F.col("p_partkey") % 400 + 2).cast("int").alias("r"), "*")
    level = F.when(F.col("p_size") % 3 == 0, "Unused").when(F.col("p_size") % 3 == 1, "Normally Used").otherwise(" ")
    return sheet(i, rows, "k", ["Origin", "OBJECT NAME", "object  type", "USAGE LEVEL", "PACKAGE", "MODULE"], F.when(F.col("p_size") % 2 == 0, "Customer"), F.concat(F.lit("Z"), F.col("p_partkey").cast("string")), F.col("p_type"), level, F.col("p_brand"), F.lit(""))


@query("SELECT concat('usage_row:', p_partkey % 400) AS source_key, concat('Z', p_partkey) AS object_name, p_type AS object_type, p_brand AS package_name, CASE p_size % 3 WHEN 0 THEN 'Unused' WHEN 1 THEN 'Normally Used' END AS level, 4 + CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END - CASE WHEN p_size % 3 = 2 THEN 1 ELSE 0 END AS n_payload FROM part")
def s8_usage_report(i):
    found = workbook.read_usage_report(usage_sheets(i))
    return found.select("source_key", "object_name", "object_type", "package_name", F.try_element_at("payload", F.lit("USAGE LEVEL")).alias("level"), F.size("payload").alias("n_payload"))


@query("""SELECT 'ROWS' AS field, '' AS value, count(*) AS n FROM part UNION ALL SELECT 'ORIGIN', CASE WHEN p_size % 2 = 0 THEN 'Customer' ELSE '(vazio)' END, count(*) FROM part GROUP BY 2
UNION ALL SELECT 'USAGE LEVEL', CASE p_size % 3 WHEN 0 THEN 'Unused' WHEN 1 THEN 'Normally Used' ELSE '(vazio)' END, count(*) FROM part GROUP BY 2
UNION ALL SELECT 'OBJECT TYPE', p_type, count(*) FROM part GROUP BY 2 UNION ALL SELECT 'MODULE', '(vazio)', count(*) FROM part""")
def s9_usage_manifest(i):
    return workbook.usage_report_manifest(usage_sheets(i))


def kpi_members(i: Inputs) -> DataFrame:
    """Chunks of a hundred orders' lines as JSON files, every third in a ZIP; flat chunks and system data beside them."""
    lines = i.table("lineitem").select(F.expr("l_orderkey div 100").alias("k"), *(F.col(c).cast("string").alias(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")))
    row = F.to_json(F.array("l_orderkey", "l_suppkey", "l_partkey"))
    # sorted by the shuffle: sort_array would compare the lines' structs one by one
    ordered = lines.repartition("k").sortWithinPartitions("k", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").select("k", row.alias("line"))

    def chunk(k: int, rows: str) -> tuple[str, str]:
        return f"c{k}{'.json' if k % 3 else '.zip'}", f'{{"dataSet":{{"serviceName":"svc","keyFigureId":"KFFI{k % 7}","header":["BELNR","BELNR","VALUE"],"data":[{rows}]}}}}'

    folder = written_lines(i, ordered, chunk, ",")
    flat = lines.select("k").where("k % 5 = 0").distinct().select(F.concat(F.lit("flat"), F.col("k").cast("string"), F.lit(".json")).alias("name"), F.lit('{"flat": 1}').alias("content"))
    system = i.table("nation").select(F.concat(F.lit("m"), F.col("n_nationkey").cast("string"), F.lit(".xml")).alias("name"), F.concat(F.lit("<x><item><KEY>K"), F.col("n_nationkey").cast("string"), F.lit("</KEY><VALUE>"), "n_name", F.lit("</VALUE></item></x>")).alias("content"))
    return exports.read_kpi_members(i.spark, written(i, flat.unionByName(system), folder))


_CHUNKS = "WITH l AS (SELECT l_orderkey // 100 AS k, l_orderkey AS a, l_suppkey AS b, l_partkey AS c, row_number() OVER (PARTITION BY l_orderkey // 100 ORDER BY CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) - 1 AS n FROM lineitem)"


@query(_CHUNKS + " SELECT concat('c', k, '.json') AS member, CAST(n AS INT) AS row_index, concat('KFFI', k % 7) AS key_figure_id, concat(b, '|', c) AS seen, NULL AS warning FROM l UNION ALL SELECT DISTINCT concat('flat', k, '.json'), NULL, NULL, NULL, concat('no dataSet in flat', k, '.json') FROM l WHERE k % 5 = 0")
def s10_kpi_chunks(i):
    # of the two equal headers the last wins
    seen = F.concat(F.try_element_at("payload", F.lit("BELNR")), F.lit("|"), F.try_element_at("payload", F.lit("VALUE")))
    return exports.read_kpi_chunks(kpi_members(i)).select("member", "row_index", "key_figure_id", seen.alias("seen"), "warning")


@query(_CHUNKS + " SELECT count(DISTINCT k) AS n_chunks, count(DISTINCT k % 7) AS n_key_figures, count(DISTINCT k) FILTER (WHERE k % 5 = 0) AS n_warnings, (SELECT string_agg(concat('K', n_nationkey, '=', n_name), ',' ORDER BY concat('K', n_nationkey)) FROM nation) AS metadata FROM l")
def s11_kpi_manifest(i):
    pairs = F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return exports.kpi_manifest(kpi_members(i)).select("n_chunks", "n_key_figures", "n_warnings", F.array_join(pairs, ",").alias("metadata"))


def sizing_files(i: Inputs) -> DataFrame:
    part = i.table("part")
    row = F.concat(F.lit("| "), F.when(F.col("p_partkey") % 4 == 0, "- memory of ").otherwise("TAB_"), F.col("p_partkey").cast("string"), F.lit("   1."), F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit(",5   n/a |"))
    body = joined(part, blocks("p_partkey", 100), "p_partkey", row)
    text = F.concat(F.lit("SID  S"), F.col("k").cast("string"), F.lit("\nHost:  h1\n" + "-" * 20 + "\n| Table  Size  Rows |\n| " + "-" * 12 + " |\n"), "body", F.lit("\n" + "-" * 20))
    folder = written(i, body.select(F.concat(F.lit("sizing"), F.col("k").cast("string"), F.lit(".txt")).alias("name"), text.alias("content")))
    return files.read_source_text(files.scan_files(i.spark, folder)).select(F.col("rel_path").alias("file"), F.col("content").alias("text"))


@query("""SELECT p_partkey // 100 AS k, CASE WHEN p_partkey % 4 = 0 THEN 'hana_sizing_metric' ELSE 'hana_sizing_table_metric' END AS record_type, concat('box-0:row-', row_number() OVER (PARTITION BY p_partkey // 100 ORDER BY p_partkey) - 1) AS source_key,
CASE WHEN p_partkey % 4 <> 0 THEN concat('TAB_', p_partkey) END AS object_name, CAST(1000 + p_size AS DOUBLE) + 0.5 AS size, 'Table Size Rows' AS section FROM part""")
def s12_sizing_report(i):
    found = exports.parse_sizing_report(sizing_files(i))
    return found.select(number("file").alias("k"), "record_type", "source_key", "object_name", F.get("values", 0)["parsed"].alias("size"), "section")


@query("SELECT DISTINCT p_partkey // 100 AS k, unnest(['SID', 'Host']) AS key, unnest([concat('S', p_partkey // 100), 'h1']) AS value FROM part")
def s12_sizing_metadata(i):
    return exports.sizing_metadata(sizing_files(i)).select(number("file").alias("k"), "key", "value")


def documents_read(i: Inputs) -> DataFrame:
    part = i.table("part")

    def cell(v: Column) -> Column:
        return F.concat(F.lit("<w:tc><w:p><w:r><w:t>"), v, F.lit("</w:t></w:r></w:p></w:tc>"))

    def row(*values: Column) -> Column:
        return F.concat(F.lit("<w:tr>"), *map(cell, values), F.lit("</w:tr>"))

    body = joined(part, blocks("p_partkey", 100), "p_partkey", F.concat(row(F.concat(F.lit("T"), F.col("p_partkey").cast("string")), F.col("p_size").cast("string"))), "")
    head = [row(*map(F.lit, names)) for names in (("Table", "Size in GiB"), ("SID", "Host"), ("Title", "Effort Ranking"), ("Foo", "Bar"))]
    tables = [(head[0], F.col("body")), (head[1], row(F.lit("QAS"), F.lit("h"))), (head[2], F.concat(row(F.concat(F.lit("Item "), F.col("k").cast("string")), F.lit("2")), row(F.lit(""), F.lit("")))), (head[3], F.lit(""))]
    content = F.concat(*(F.concat(F.lit("<w:tbl>"), h, b, F.lit("</w:tbl>")) for h, b in tables))
    made = body.select(F.concat(F.lit("r"), F.col("k").cast("string"), F.lit(".docx")).alias("name"), content.alias("content"))
    damaged = body.select(F.concat(F.lit("bad"), F.col("k").cast("string"), F.lit(".doc")).alias("name"), F.lit("PK").alias("content"))
    return exports.read_document_tables(i.spark, written(i, made.unionByName(damaged)))


@query("""SELECT 'readiness_check_table_volume' AS record_type, concat('table-0:row-', row_number() OVER (PARTITION BY p_partkey // 100 ORDER BY p_partkey) - 1) AS source_key, concat('T', p_partkey) AS object_name, concat('Size in GiB=', p_size, ',Table=T', p_partkey) AS payload FROM part
UNION ALL SELECT DISTINCT 'readiness_check_simplification_item', 'table-2:row-0', NULL, concat('Effort Ranking=2,Title=Item ', p_partkey // 100) FROM part""")
def s13_readiness_tables(i):
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("payload")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return exports.parse_readiness_tables(documents_read(i)).select("record_type", "source_key", "object_name", pairs.alias("payload"))


@query("SELECT DISTINCT p_partkey // 100 AS k, unnest(['table_volume', 'system_metadata', 'simplification_item', 'unrecognized']) AS kind, 1 AS n FROM part")
def s13_readiness_manifest(i):
    return exports.readiness_manifest(documents_read(i)).select(number("file").alias("k"), "kind", "n")


def export_files(i: Inputs) -> DataFrame:
    """(name, content): exports of a hundred parts each in all formats, XML bare and in ZIPs, and files that nobody reads."""
    part = i.table("part")
    text = F.col("p_partkey").cast("string")

    def of(prefix: str, suffix: Column, rows: DataFrame, before: Column, after: Column) -> DataFrame:
        k = F.col("k").cast("string")
        return rows.select(F.concat(F.lit(prefix), k, suffix).alias("name"), F.concat(before, "body", after).alias("content"))

    def lines(line: Column, between: str = "") -> DataFrame:
        return joined(part, blocks("p_partkey", 100), "p_partkey", line, between)

    r = (F.col("p_partkey") % 100 + 2).cast("string")
    cell = F.concat(F.lit('<row r="'), r, F.lit('">'), *(F.concat(F.lit(f'<c r="{c}'), r, F.lit('" t="inlineStr"><is><t>'), v, F.lit("</t></is></c>")) for c, v in (("A", text), ("B", F.lit("T")), ("C", F.lit("Unused")), ("D", F.lit("Customer")))), F.lit("</row>"))
    head = '<row r="1">' + "".join(f'<c r="{c}1" t="inlineStr"><is><t>{h}</t></is></c>' for c, h in zip("ABCD", ("OBJECT NAME", "OBJECT TYPE", "USAGE LEVEL", "ORIGIN"), strict=True)) + "</row>"
    xml = lines(F.concat(F.lit('<R NAME="P'), text, F.lit('"/>')))
    rule = "-" * 20
    made = [
        of("x/p", F.when(F.col("k") % 2 == 0, ".xml").otherwise(".xml.zip"), xml, F.lit("<ROOT>\n<PROGRAMS>\n"), F.lit("</PROGRAMS></ROOT>")),
        of("u/usage", F.lit(".xlsx"), lines(cell), F.lit(head), F.lit("")),
        of("k/c", F.when(F.col("k") % 2 == 0, ".json").otherwise(".zip"), lines(F.concat(F.lit('["'), text, F.lit('"]')), ", "), F.lit('{"dataSet": {"keyFigureId": "F", "header": ["A"], "data": ['), F.lit("]}}")),
        of("s/hana_sizing", F.lit(".txt"), lines(F.concat(F.lit("| TAB_"), text, F.lit("   1,5 |")), "\n"), F.lit(f"{rule}\n| Table  Size |\n| {rule} |\n"), F.lit("\n" + rule)),
        of("r/readiness", F.lit(".docx"), lines(F.concat(F.lit("<w:tr><w:tc><w:p><w:r><w:t>T"), text, F.lit("</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc></w:tr>"))), F.lit("<w:tbl><w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{h}</w:t></w:r></w:p></w:tc>" for h in ("Table", "Size in GiB")) + "</w:tr>"), F.lit("</w:tbl>")),
        of("n/see", F.lit(".txt"), lines(text, "\n"), F.lit("see SIZING RESULTS IN GiB "), F.lit("")),
        of("n/note", F.lit(".txt"), lines(text, "\n"), F.lit("nothing "), F.lit("")),
        of("n/flat", F.lit(".json"), lines(text), F.lit("{} "), F.lit("")),
    ]
    whole = made[0]
    for more in made[1:]:
        whole = whole.unionByName(more)
    return whole


_EXPORTS = """f AS (SELECT DISTINCT p_partkey // 100 AS k FROM part), named AS (
SELECT concat('x/p', k, CASE WHEN k % 2 = 0 THEN '.xml' ELSE '.xml.zip' END) AS name, 'sectioned_xml' AS format, k FROM f UNION ALL SELECT concat('u/usage', k, '.xlsx'), 'usage_sheet', k FROM f
UNION ALL SELECT concat('k/c', k, CASE WHEN k % 2 = 0 THEN '.json' ELSE '.zip' END), 'kpi_chunks', k FROM f UNION ALL SELECT concat('s/hana_sizing', k, '.txt'), 'sizing_report', k FROM f
UNION ALL SELECT concat('r/readiness', k, '.docx'), 'readiness_docx', k FROM f UNION ALL SELECT concat('n/see', k, '.txt'), 'sizing_report', k FROM f UNION ALL SELECT concat('n/note', k, '.txt'), NULL, k FROM f UNION ALL SELECT concat('n/flat', k, '.json'), NULL, k FROM f)"""


def short_name(column: str) -> Column:
    """The last folder and the name of a path."""
    return F.regexp_extract(column, r"([^/]+/[^/]+)$", 1)


@query(f"WITH {_EXPORTS} SELECT name, format FROM named")
def s14_detect_format(i):
    scanned = files.scan_files(i.spark, written(i, export_files(i)))
    return files.detect_format(scanned).select(F.col("rel_path").alias("name"), "format")


_PAGES = "p AS (SELECT p_partkey AS id, p_partkey // 4 AS k, p_partkey % 4 AS j, p_size FROM part)"


@query(f"""WITH {_PAGES}, c AS (SELECT * FROM p WHERE j = 0), m AS (SELECT k, string_agg(concat('METHOD m', j, '_', p_size, '.', chr(10), '  x < 1.', chr(10), 'ENDMETHOD.'), concat(chr(10), chr(10)) ORDER BY j) AS body FROM p WHERE j > 0 GROUP BY 1)
SELECT concat('z', c.k, '/.assembled/ZC', c.k, '.abap') AS rel_path, concat('CLASS zc', c.k, ' DEFINITION.', chr(10), 'ENDCLASS.', coalesce(concat(chr(10), chr(10), 'CLASS ZC', c.k, ' IMPLEMENTATION.', chr(10), chr(10), m.body, chr(10), chr(10), 'ENDCLASS.'), ''), chr(10)) AS content FROM c LEFT JOIN m ON m.k = c.k""")
def s15_reassemble_listings(i):
    return X.reassemble_listings(listings(i))[0]


@query(f"WITH {_PAGES} SELECT id FROM p WHERE k IN (SELECT k FROM p WHERE j = 0)")
def s15_consumed_listings(i):
    return X.reassemble_listings(listings(i))[1]


def listings(i: Inputs) -> DataFrame:
    rows = i.sql("SELECT p_partkey AS id, p_partkey div 4 AS k, p_partkey % 4 AS j, p_size FROM part")
    k, j = F.col("k").cast("string"), F.col("j").cast("string")
    path = F.concat(F.lit("z"), k, F.when(F.col("j") == 0, "/main").when(F.col("j") == 1, "/public_methods/a").otherwise(F.concat(F.lit("/private_methods/b"), j)), F.lit(".html"))
    code = F.when(F.col("j") == 0, F.concat(F.lit("CLASS zc"), k, F.lit(" DEFINITION."))).otherwise(F.concat(F.lit("METHOD m"), j, F.lit("_"), F.col("p_size").cast("string"), F.lit(".<br />&nbsp;&nbsp;x &lt; 1.<br>ENDMETHOD.")))
    title = F.when(F.col("j") == 0, F.concat(F.lit(" class: zc"), k)).otherwise(F.concat(F.lit(": m"), j))
    return rows.select("id", path.alias("rel_path"), F.concat(F.lit("<h2>Code listing for"), title, F.lit('</h2><div class="code">'), code, F.lit("</div>")).alias("content"))


@query("SELECT p_partkey AS id, p_size % 4 AS assessment_id, CASE WHEN p_size % 4 = 1 THEN 'second' ELSE 'first' END AS run FROM part WHERE p_size % 4 <> 1 OR p_partkey % 2 = 0")
def s16_write_snapshot(i):
    folder = scratch(i.spark, "snapshot")
    rows = i.table("part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 4).alias("assessment_id"), F.lit("first").alias("run"))
    files.write_snapshot(rows, folder)
    files.write_snapshot(rows.where("assessment_id = 1 and id % 2 = 0").withColumn("run", F.lit("second")), folder)
    return i.spark.read.parquet(folder).select("id", "assessment_id", "run")


@query("SELECT id * 10 AS object_id, rel_path, 'abap' AS language, substring(content, 1, 40) AS snippet, octet_length(encode(content)) > 40 AS is_truncated FROM sources WHERE id % 4 < 3 UNION ALL SELECT id * 10, rel_path, 'abap', substring(content, 1, 40), octet_length(encode(content)) > 40 FROM sources WHERE id % 4 = 3", "sources")
def x11_source_snippet(i):
    rows = i.sources.withColumn("category", T.classify_path(F.col("rel_path")))
    outside = rows.withColumns({"id": -F.col("id") - 1, "rel_path": F.concat(F.lit("../"), "rel_path")})
    held = rows.unionByName(outside)
    return files.source_snippet(held.select((F.col("id") * 10).alias("id"), F.col("id").alias("source_file_id")), held, 40)


@query("""WITH u AS (SELECT CAST(user_id AS VARCHAR) AS name, concat('k', event_id % 2000) AS fp, event_id FROM events)
SELECT DISTINCT fp AS record_fingerprint, CASE WHEN event_id % 2000 % 3 = 0 THEN 'MATCHED_HEURISTIC' ELSE 'UNMATCHED' END AS status FROM u""")
def st1_stream_intake(i):
    folder = scratch(i.spark, "intake")
    rows = i.table("events").select((F.col("event_id") % 2000).alias("n"), F.expr("event_id div 700").alias("batch"))
    made = rows.select(F.lit(1).alias("assessment_id"), (F.col("n") % 3).cast("int").alias("dataset_id"), F.concat(F.lit("k"), F.col("n").cast("string")).alias("record_fingerprint"), F.concat(F.lit("o"), (F.col("n") % 3).cast("string")).alias("object_name"), F.lit(None).cast("string").alias("object_type"), "batch")
    objects = i.spark.range(1).select(F.lit(1).alias("assessment_id"), F.lit(1).cast("long").alias("id"), F.lit("O0").alias("object_name"), F.lit("class").alias("object_type"))
    schema = "assessment_id int, dataset_id int, record_fingerprint string, object_name string, object_type string"
    for late in (False, True):  # files come in two goes, and the second go repeats keys of the first
        made.where((F.col("batch") % 2 == 1) == late).drop("batch").write.mode("append").json(f"{folder}/landing")
        stream_intake(i.spark, f"{folder}/landing", f"{folder}/out", f"{folder}/checkpoint", schema, lambda: objects)
    return i.spark.read.parquet(f"{folder}/out/correlations").select("record_fingerprint", "status")


@query(f"WITH {_EXPORTS} SELECT name, format FROM named")
def e1_detect(i):
    """By the first and last bytes alone, as of files of more than WHOLE bytes."""
    return adapters.detect(i.spark, written(i, export_files(i)), 0).select(short_name("rel_path").alias("name"), "format")


@query(f"WITH {_EXPORTS} SELECT name, format FROM named WHERE format IS NOT NULL")
def e1_plan_batches(i):
    planned = adapters.plan_batches(i.spark, written(i, export_files(i)), 2)
    return planned.select("format", F.explode("files").alias("file")).select(short_name("file").alias("name"), "format")


_RECORDS = """r AS (SELECT p_partkey AS p, p_partkey // 100 AS k, row_number() OVER (PARTITION BY p_partkey // 100 ORDER BY p_partkey) - 1 AS n FROM part), made AS (
SELECT concat('x/p', k, CASE WHEN k % 2 = 0 THEN '.xml' ELSE '.xml.zip' END) AS name, 'sectioned_xml' AS format, k, 'panaya_program' AS record_type, concat('PROGRAMS:', n) AS source_key, concat('P', p) AS object_name FROM r
UNION ALL SELECT concat('u/usage', k, '.xlsx'), 'usage_sheet', k, 'panaya_usage_object', concat('usage_row:', p % 100), CAST(p AS VARCHAR) FROM r
UNION ALL SELECT concat('k/c', k, CASE WHEN k % 2 = 0 THEN '.json' ELSE '.zip' END), 'kpi_chunks', k, 'signavio_kpi_observation', concat('c', k, '.json:', n), NULL FROM r
UNION ALL SELECT concat('s/hana_sizing', k, '.txt'), 'sizing_report', k, 'hana_sizing_table_metric', concat('box-0:row-', n), concat('TAB_', p) FROM r
UNION ALL SELECT concat('r/readiness', k, '.docx'), 'readiness_docx', k, 'readiness_check_table_volume', concat('table-0:row-', n), concat('T', p) FROM r)"""


def imports(i: Inputs) -> str:
    """Two runs: exports of even numbers, then all of them; the second run is stopped in its first batch and taken up again."""
    every = export_files(i)
    odd = F.regexp_extract("name", r"(\d+)\.", 1).cast("long") % 2 == 1
    first, later, target = written(i, every.where(~odd)), written(i, every.where(odd)), scratch(i.spark, "imports")
    adapters.import_all(i.spark, first, target)
    stopping = adapters.ADAPTERS | {"kpi_chunks": adapters.Adapter(_stopped, adapters.ADAPTERS["kpi_chunks"].manifest)}
    try:
        adapters.import_all(i.spark, [first, later], target, stopping)
    except KeyboardInterrupt:
        pass
    adapters.import_all(i.spark, [first, later], target)
    return target


def _stopped(spark, path):
    raise KeyboardInterrupt


def of_data_sets(i: Inputs, target: str) -> DataFrame:
    names = adapters.ledger(i.spark, target).select("dataset_id", short_name("file").alias("name"), "format", "run", "state")
    return adapters.imported(i.spark, target).join(names.hint("merge"), "dataset_id")


@query(f"WITH {_RECORDS} SELECT name, format, CAST(k % 2 + 1 AS INT) AS run, record_type, source_key, object_name FROM made")
def e1_import_all(i):
    """Every record of every file of every format, once, after a second run that was stopped and taken up again."""
    return of_data_sets(i, imports(i)).select("name", "format", "run", "record_type", "source_key", "object_name")


@query(f"WITH {_EXPORTS} SELECT name, format, 1 AS run, CASE WHEN format IN ('sizing_report', 'usage_sheet') THEN 'PLANNED' ELSE 'DONE' END AS state FROM named WHERE format IS NOT NULL")
def e1_ledger(i):
    """What the ledger says of a run that was stopped when it came to the sizing reports."""
    target = scratch(i.spark, "imports")
    stopping = adapters.ADAPTERS | {"sizing_report": adapters.Adapter(_stopped, adapters.ADAPTERS["sizing_report"].manifest)}
    try:
        adapters.import_all(i.spark, written(i, export_files(i)), target, stopping)
    except KeyboardInterrupt:
        pass
    return adapters.ledger(i.spark, target).select(short_name("file").alias("name"), "format", "run", "state")


@query(f"""WITH {_RECORDS} SELECT CASE WHEN k % 2 = 0 THEN 'first' ELSE 'second' END AS run, record_type, source_key, object_name FROM made WHERE format = 'usage_sheet'""")
def e1_import_batch(i):
    """A batch of every second sheet, then all sheets: keys that are equal in several files stay apart."""
    rows = export_files(i).where("name like 'u/%'")
    folder = written(i, rows)
    empty = i.spark.createDataFrame([], ", ".join(f"{c} string" for c in adapters.RECORD))
    first = checkpointed(adapters.import_batch(i.spark, [f"{folder}/u/usage*[02468].xlsx"], "usage_sheet", empty))
    second = adapters.import_batch(i.spark, f"{folder}/u", "usage_sheet", first)
    kept = ("record_type", "source_key", "object_name")
    return first.select(F.lit("first").alias("run"), *kept).unionByName(second.select(F.lit("second").alias("run"), *kept))


@query("SELECT 'hana_sizing_table_metric' AS record_type, count(*) AS n FROM part")
def e1_inspect(i):
    return adapters.inspect(i.spark, f"{written(i, export_files(i))}/s", "sizing_report")
