import html
import json
import re
import unicodedata
import zipfile

import pytest
from estatelens.functions import text
from estatelens.functions.arrays import running
from estatelens.operators import extract
from estatelens.sources import adapters, exports, files, workbook, xml_sections
from estatelens.streaming.intake import stream_intake
from pyspark.sql import functions as F

XML = (
    '<?xml version="1.0"?><ROOT>\n<REPOSITORY_OBJECTS>' + "".join(f'<ROW PGMID="R3TR" OBJECT="CLAS" OBJ_NAME="ZCL_{n}" DEVCLASS="" T="a&amp;b&#0;\x1c&#65;"/>\n' for n in range(50))
    + "</REPOSITORY_OBJECTS><EMPTY/><WHERE_USED_TABLE><R OTYPE='X' NAME='bad' INCLUDE='ZPROG'></R></WHERE_USED_TABLE><OTHER><A B='1'/></OTHER></ROOT>"
)


@pytest.mark.parametrize("block", ["128m", "300"])
def test_sectioned_xml(spark, tmp_path, block):
    (tmp_path / "e.xml").write_text(XML)
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        rows = xml_sections.read_sectioned_xml(spark, str(tmp_path / "e.xml")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    found = {(r["section"], r["row_index"]): r["attrs"] for r in rows}
    assert len(rows) == 52 and found[("REPOSITORY_OBJECTS", 49)]["OBJ_NAME"] == "ZCL_49" and found[("REPOSITORY_OBJECTS", 0)]["T"] == "a&b&#65;"
    assert found[("WHERE_USED_TABLE", 0)]["INCLUDE"] == "ZPROG" and found[("OTHER", 0)] == {"B": "1"}


def test_curated_sections_and_zip(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as box:
        box.writestr("note.xml", "<a/>")
        box.writestr("big.xml", XML)
    rows = xml_sections.read_sectioned_xml(spark, str(tmp_path / "e.zip"))
    curated = {r["source_key"]: r for r in xml_sections.curate_sections(rows).collect()}
    assert len(curated) == 51 and curated["WHERE_USED_TABLE:0"]["object_name"] == "ZPROG"
    first = curated["REPOSITORY_OBJECTS:0"]
    assert (first["object_type"], first["package_name"], first["capability"], len(first["record_fingerprint"])) == ("CLAS", None, "TECHNICAL_OBJECT_METADATA", 32)
    manifest = {r["section"]: (r["n_rows"], r["capability"]) for r in xml_sections.section_manifest(rows).collect()}
    assert manifest == {"REPOSITORY_OBJECTS": (50, "TECHNICAL_OBJECT_METADATA"), "WHERE_USED_TABLE": (1, "DEPENDENCY_SIGNAL"), "OTHER": (1, None)}
    assert xml_sections.read_sectioned_xml(spark, str(tmp_path / "e.zip"), ["REPOSITORY_OBJECTS"], 3).count() == 3


def book(path, sheets):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as box:
        names = list(sheets)
        box.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(names)) + "</sheets></workbook>")
        box.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(len(names))) + "</Relationships>")
        for k, n in enumerate(names):
            lines = ""
            for r, cells in enumerate(sheets[n], 1):
                lines += f'<row r="{r}">' + "".join(f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{chr(65 + c)}{r}"><v>{v}</v></c>' for c, v in enumerate(cells) if v is not None) + "</row>"
            box.writestr(f"xl/worksheets/s{k}.xml", f"<worksheet {ns}><sheetData>{lines}</sheetData></worksheet>")


def test_findings_sheet(spark, tmp_path):
    book(tmp_path / "a.xlsx", {"Info": [["x"], ["y"]], "data": [["Priority", " Check  Title", "Object name", "First Found On", "MY_FIELD"], [1, "T1", " ZCL ", 46139, "m"], [None, None, None, None, None], ["INVALID", "", "ZB", "24.12.2025", None]]})
    (tmp_path / "b.xlsx").write_bytes(b"junk")
    rows = workbook.read_findings_sheet(spark, str(tmp_path / "*.xlsx"))
    found = {r["source_row_number"]: r for r in workbook.normalize_finding_rows(rows).collect()}
    assert set(found) == {2, 4} and str(found[2]["first_found_on"]) == "2026-04-27" and str(found[4]["first_found_on"]) == "2025-12-24"
    assert (found[2]["priority"], found[2]["object_name_raw"], found[2]["warnings"]) == (1, "ZCL", []) and found[4]["priority"] is None and found[4]["warnings"] and found[4]["check_title"] is None
    heads = {r["file"][-6:]: r for r in workbook.map_headers(rows).collect()}
    assert heads["a.xlsx"]["status"] == "FULL" and heads["a.xlsx"]["unknown"] == ["MY_FIELD"] and len(heads["a.xlsx"]["missing"]) == 17 and heads["b.xlsx"]["status"] == "REJECTED"


def test_usage_report(spark, tmp_path):
    head = ["ORIGIN", "Object Name", "USAGE LEVEL", "OBJECT TYPE", "MODULE"]
    book(tmp_path / "u.xlsx", {"S": [head, ["Customer", "ZCL_ORDER", "Unused", "Class", None], ["Customer", "ZPROG", "Normally Used", "Program", "SD"], ["SAP Standard", "SAPM", "Unknown", "Program", "SD"]]})
    rows = workbook.read_findings_sheet(spark, str(tmp_path / "u.xlsx"))
    records = {r["object_name"]: r for r in workbook.read_usage_report(rows).collect()}
    assert len(records) == 3 and "MODULE" not in records["ZCL_ORDER"]["payload"] and records["ZPROG"]["capability"] == "USAGE_SIGNAL"
    counts = {(r["field"], r["value"]): r["n"] for r in workbook.usage_report_manifest(rows).collect()}
    assert counts[("ORIGIN", "Customer")] == 2 and counts[("MODULE", "(vazio)")] == 1 and counts[("ROWS", "")] == 3


def test_kpi_chunks(spark, tmp_path):
    chunk = {"dataSet": {"serviceName": "s", "keyFigureId": "KFFI000202", "header": ["BELNR", "BUZEI", "VALUE"], "data": [["0400004156", "001", "42"], ["1"]]}}
    with zipfile.ZipFile(tmp_path / "k.zip", "w") as box:
        box.writestr("a.json", json.dumps(chunk))
        box.writestr("b.json", json.dumps({"flat": 1}))
        box.writestr("m.xml", "<x><item><KEY>UsageSystem</KEY><VALUE>QAS</VALUE></item></x>")
    members = exports.read_kpi_members(spark, str(tmp_path / "k.zip"))
    rows = {(r["member"], r["row_index"]): r for r in exports.read_kpi_chunks(members).collect()}
    assert rows[("a.json", 0)]["payload"] == {"BELNR": "0400004156", "BUZEI": "001", "VALUE": "42"} and rows[("a.json", 1)]["payload"]["VALUE"] is None and rows[("b.json", None)]["warning"]
    records = {r["source_key"]: r for r in exports.kpi_records(exports.read_kpi_chunks(members)).collect()}
    assert set(records) == {"a.json:0", "a.json:1"} and records["a.json:0"]["payload"]["row"] == '["0400004156","001","42"]'
    assert tuple(exports.kpi_manifest(members).first()) == (1, 1, 1, {"UsageSystem": "QAS"})


def test_repeated_and_null_headers(spark, tmp_path):
    """Headers that are equal, or mean one field, or are missing neither fail nor hide the last value."""
    book(tmp_path / "a.xlsx", {"data": [["Package", "package ", "Object name", "Object name", None], ["P1", "P2", "Z1", "Z2", "x"]]})
    rows = workbook.read_findings_sheet(spark, str(tmp_path / "a.xlsx"))
    mapped = workbook.map_headers(rows).first()
    assert mapped["status"] == "FULL" and mapped["recognized"] == {"Package": "package_name_raw", "package ": "package_name_raw", "Object name": "object_name_raw"} and mapped["unknown"] == []
    found = workbook.normalize_finding_rows(rows).first()
    assert (found["package_name_raw"], found["object_name_raw"]) == ("P2", "Z2")
    nulls = spark.createDataFrame([("f", 2, [None, "Object name"], ["a", "b"], None)], rows.schema)
    assert workbook.map_headers(nulls).first()["unknown"] == [""] and workbook.normalize_finding_rows(nulls).first()["object_name_raw"] == "b"
    assert workbook.map_headers(rows.where("false")).collect() == []


def test_damaged_exports_give_error_rows(spark, tmp_path):
    chunk = json.dumps({"dataSet": {"keyFigureId": "F", "header": ["A", "A"], "data": [["1", "2"]]}})
    with zipfile.ZipFile(tmp_path / "good.zip", "w") as box:
        box.writestr("a.json", chunk)
    (tmp_path / "cut.zip").write_bytes((tmp_path / "good.zip").read_bytes()[:60])
    members = exports.read_kpi_members(spark, str(tmp_path / "*.zip"))
    rows = {r["member"]: r for r in exports.read_kpi_chunks(members).collect()}
    assert rows["a.json"]["payload"] == {"A": "2"} and "not a ZIP" in rows["cut.zip"]["warning"]
    assert tuple(exports.kpi_manifest(members).first())[:3] == (1, 1, 1)
    for name, data in (("a.docx", b"junk"), ("b.docx", (tmp_path / "good.zip").read_bytes())):
        (tmp_path / name).write_bytes(data)
    tables = exports.read_document_tables(spark, str(tmp_path / "*.docx"))
    assert [bool(r["error"]) for r in tables.collect()] == [True, True] and exports.parse_readiness_tables(tables).count() == 0 and exports.readiness_manifest(tables).count() == 0


def test_adapters(spark, tmp_path):
    (tmp_path / "k.json").write_text(json.dumps({"dataSet": {"keyFigureId": "F", "header": ["A"], "data": [["1"], ["2"]]}}))
    assert [r["format"] for r in adapters.detect(spark, str(tmp_path)).collect()] == ["kpi_chunks"]
    empty = spark.createDataFrame([], ", ".join(f"{c} string" for c in adapters.RECORD))
    first = adapters.import_batch(spark, str(tmp_path), "kpi_chunks", empty)
    assert first.count() == 2 and adapters.import_batch(spark, str(tmp_path), "kpi_chunks", first).count() == 0
    own = {"mine": adapters.Adapter(lambda s, p: s.createDataFrame([("r", "c", "k", "f", "o", "file:/x")], ", ".join(f"{c} string" for c in (*adapters.RECORD[1:], "file"))), lambda s, p: s.range(1))}
    assert adapters.import_batch(spark, "", "mine", empty, own, spark.createDataFrame([("file:/x", "d")], "file string, dataset_id string")).count() == 1 and adapters.inspect(spark, "", "mine", own).count() == 1
    with pytest.raises(ValueError, match="no adapter"):
        adapters.inspect(spark, "", "other")


def test_references_and_accents(spark):
    texts = ["a &lt;b&gt; &amp;amp; &nbsp;x", "&#65;&#x41;&#128;&#xD800;&#x110000;&#99999999999999999999;&#0;&#13;", "&notit; &notin; &ltx &foo; &", "&&lt", "&Aacute&Aacute;&frac14x", "&#xFFFE;&#xFDD0;é&#8364;&#x1F600;", "&NotEqualTilde;&AMP&AMP;", "no", None]
    found = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", extract.unescape_html(F.col("t")).alias("u"), extract.fold_accents(F.col("t")).alias("f")).collect()
    assert {r["i"]: r["u"] for r in found} == {i: t and html.unescape(t) for i, t in enumerate(texts)}
    for q in ("Quais objetos não classificados?", "AÇÃO  İx", "ﬁn ǆ"):
        got = spark.createDataFrame([(q,)], "q string").select(extract.fold_accents(F.col("q")).alias("f")).first()["f"]
        assert q[0] == "ﬁ" or got == re.sub(r"\s+", " ", "".join(x for x in unicodedata.normalize("NFKD", q.lower()) if not unicodedata.combining(x))) + " "


def test_running_sums_and_long_texts(spark):
    for n in (0, 1, 255, 256, 257, 5000):
        values = [k % 7 for k in range(n)]
        got = spark.createDataFrame([(values,)], "v array<int>").select(running(F.col("v")).alias("s")).first()["s"]
        assert got == [sum(values[:k]) for k in range(n)] if n < 300 else got[-1] == sum(values[:-1])
    source = "".join(f"x\nCALL FUNCTION 'Z{k}'.\n" for k in range(20_000))
    files_ = spark.createDataFrame([(1, source)], "id long, content string")
    found = {r["target_name"]: r["source_line"] for r in extract.text_dependencies(files_).collect()}
    assert len(found) == 20_000 and all(found[f"Z{k}"] == 2 * k + 2 for k in range(20_000))


def test_sizing_report(spark):
    body = "SID  QAS\nHost:  h1\n" + "-" * 20 + "\n| SIZING RESULTS IN GiB |\n|" + "-" * 18 + "|\n| - Memory requirement   3.765,0 |\n" + "-" * 20 + "\n" + "-" * 20 + "\n| Table  Size  Rows |\n| " + "-" * 12 + " |\n| DBTABLOG   230,0   651.620.305 |\n|  |\n| ACDOCA   77,6   x |\n" + "-" * 20
    df = spark.createDataFrame([("f", body)], "file string, text string")
    rows = {r["label"]: r for r in exports.parse_sizing_report(df).collect()}
    assert (rows["DBTABLOG"]["object_name"], rows["DBTABLOG"]["source_key"], rows["- Memory requirement"]["object_name"]) == ("DBTABLOG", "box-1:row-0", None)
    assert [v["parsed"] for v in rows["DBTABLOG"]["values"]] == [230.0, 651620305.0] and [v["parsed"] for v in rows["ACDOCA"]["values"]] == [77.6, None] and rows["ACDOCA"]["source_key"] == "box-1:row-1"
    assert {r["key"]: r["value"] for r in exports.sizing_metadata(df).collect()} == {"SID": "QAS", "Host": "h1"}


def test_readiness_tables(spark, tmp_path):
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    tables = [[["SID", "Host"], ["QAS", "h"]], [["Title", "Effort Ranking"], ["Item", "2"], ["", ""]], [["Table", "Size in GiB"], ["ACDOCA", "7"], ["other thing", "1"]], [["Foo"], ["bar"]]]
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    body = "".join("<w:tbl>" + "".join("<w:tr>" + "".join(map(cell, row)) + "</w:tr>" for row in t) + "</w:tbl>" for t in tables)
    with zipfile.ZipFile(tmp_path / "r.docx", "w") as box:
        box.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body>{body}</w:body></w:document>')
    found = exports.read_document_tables(spark, str(tmp_path / "r.docx"))
    rows = {r["source_key"]: r for r in exports.parse_readiness_tables(found).collect()}
    assert set(rows) == {"table-1:row-0", "table-2:row-0", "table-2:row-1"} and rows["table-2:row-0"]["object_name"] == "ACDOCA" and rows["table-2:row-1"]["object_name"] is None
    assert rows["table-1:row-0"]["payload"] == {"Title": "Item", "Effort Ranking": "2"}
    assert {r["kind"]: r["n"] for r in exports.readiness_manifest(found).collect()} == {"system_metadata": 1, "simplification_item": 1, "table_volume": 1, "unrecognized": 1}


def test_scan_and_detect(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "z+ a.abap").write_bytes(b"REPORT z.\n\xff")
    (tmp_path / "sizing.txt").write_text("HDB_SIZING")
    (tmp_path / "x.xml").write_text(XML)
    scanned = files.scan_files(spark, str(tmp_path))
    rows = {r["rel_path"]: r for r in scanned.collect()}
    assert set(rows) == {"src/z+ a.abap", "sizing.txt", "x.xml"} and rows["src/z+ a.abap"]["category"] == "abap_source" and len(rows["x.xml"]["sha256"]) == 64
    assert {r["rel_path"]: r["format"] for r in files.detect_format(scanned).collect()} == {"src/z+ a.abap": None, "sizing.txt": "sizing_report", "x.xml": "sectioned_xml"}
    assert files.read_source_text(scanned.where("category = 'abap_source'")).first()["content"] == "REPORT z.\n�"
    objects = spark.createDataFrame([(5, 1)], "id long, source_file_id long")
    held = scanned.where("category = 'abap_source'").withColumn("id", F.lit(1).cast("long"))
    assert tuple(files.source_snippet(objects, held, 6).first()) == (5, "src/z+ a.abap", "abap", "REPORT", True)


SOURCES = {
    "a.abap": "CLASS zcl_a DEFINITION\n  INHERITING FROM zcl_base.\n METHODS: go, stop.\n  methods run.\nENDCLASS.\nCLASS zcl_b DEFINITION DEFERRED.\nMETHODS x.\nENDCLASS.\n\n\n  CALL FUNCTION 'Z_DO'.\nINCLUDE zinc.\n call function 'z_do'.",
    "f.abap": 'FUNCTION z_do.\n*"  IMPORTING\n*"     VALUE(IV_ID) TYPE  STRING\n*"  EXPORTING\n*"     VALUE(EV) TYPE i\nENDFUNCTION.', "r.abap": "* c\nREPORT zrep.\nTABLES: mara, marc.\nso_matnr p_date so_matnr.",
    "t.tabl": "DDIC Table Definition: ZTAB\nTable Type: TRANSP\nDelivery Class: A\nFields:\n  MANDT CLNT 3 Client\n  ID CHAR 10 The id", "d.doma": "DDIC Domain: ZDOM\nData Type: CHAR\nLength: 2\nFixed Values:\n  OP Open\n  CL Closed now", "stem.doma": "nothing", "q.cds": "CLASS c DEFINITION\nENDCLASS.",
}


def test_extraction(spark):
    df = spark.createDataFrame([(k, p, c) for k, (p, c) in enumerate(SOURCES.items())], "id long, rel_path string, content string").withColumn("category", text.classify_path(F.col("rel_path")))
    rows = {(r["object_type"], r["object_name"]): r for r in extract.extract_objects(df).collect()}
    a = rows[("class", "ZCL_A")]
    assert (a["line_start"], a["line_end"], a["attributes"]["methods"], a["attributes"]["superclass"]) == (1, 5, ["GO", "RUN"], "ZCL_BASE")
    assert rows[("class", "ZCL_B")]["attributes"]["methods"] == ["X"]
    f = rows[("function_module", "Z_DO")]
    assert (f["attributes"]["importing"], f["attributes"]["exporting"], f["line_end"]) == (["IV_ID:STRING"], ["EV:i"], 6)
    r = rows[("report", "ZREP")]
    assert (r["line_start"], r["line_end"], r["attributes"]["tables"], r["attributes"]["select_options"], r["attributes"]["parameters"]) == (2, 4, ["MARA", "MARC"], ["SO_MATNR"], ["P_DATE"])
    assert rows[("ddic_table", "ZTAB")]["attributes"]["fields"] == ["MANDT:Client", "ID:The id"] and rows[("ddic_domain", "ZDOM")]["attributes"]["fixed_values"] == ["OP:Open", "CL:Closed now"]
    assert ("ddic_domain", "STEM") in rows and len(rows) == 7
    objects = extract.extract_objects(df).withColumnRenamed("file_id", "source_file_id").withColumn("id", F.when(F.col("object_name") == "ZCL_A", 1).when(F.col("object_name") == "ZREP", 3).otherwise(9)).where("id < 9")
    deps = {(d["object_id"], d["dep_type"], d["target_name"]): d["source_line"] for d in extract.detect_dependencies(objects, df).collect()}
    # the two blank lines before the call belong to its match
    assert deps == {(1, "CALL_FUNCTION", "Z_DO"): 9, (1, "INCLUDE", "ZINC"): 12, (1, "INHERITS_FROM", "ZCL_BASE"): None, (3, "USES_TABLE", "MARA"): None, (3, "USES_TABLE", "MARC"): None}


def test_listings(spark):
    page = '<h2>Code listing for{}: {}</h2><div class="code">{}</div>x<div class="codeComment">* c&nbsp;&lt;</div>'
    rows = [(1, "zcl/zcl.html", page.format(" class", "zcl", "CLASS zcl DEFINITION.<br />METHODS <a href='x'>M</a>.")), (2, "zcl/public_methods/b.html", page.format("", "b", "METHOD b.<br>ENDMETHOD.")), (3, "zcl/private_methods/a.html", page.format("", "a", "METHOD a.\nENDMETHOD.")), (4, "other/m.html", page.format("", "m", "METHOD m.")), (5, "zcl/x.html", "<p>no</p>")]
    assembled, consumed = extract.reassemble_listings(spark.createDataFrame(rows, "id long, rel_path string, content string"))
    made = assembled.collect()
    assert [r["rel_path"] for r in made] == ["zcl/.assembled/ZCL.abap"] and sorted(r["id"] for r in consumed.collect()) == [1, 2, 3]
    assert made[0]["content"] == "CLASS zcl DEFINITION.\nMETHODS M.\n* c <\nENDCLASS.\n\nCLASS ZCL IMPLEMENTATION.\n\nMETHOD a.\nENDMETHOD.\n* c <\n\nMETHOD b.\nENDMETHOD.\n* c <\n\nENDCLASS.\n"


def test_chunks_and_intent(spark):
    source = "".join(f"METHOD m{k}.\n" + "x\n" * 40 + "ENDMETHOD.\n" for k in range(5))
    parts = extract.chunks_of(source, 150)
    assert "".join(parts) == source and len(parts) == 3 and all(p.endswith("ENDMETHOD.\n") for p in parts)
    q = spark.createDataFrame([("Quais objetos não classificados?",), ("Modernização das aplicações",), (None,)], "question string")
    rows = {r["question"]: r for r in extract.question_intent(q).collect()}
    assert rows["Quais objetos não classificados?"]["wants_objects"] and rows["Quais objetos não classificados?"]["wants_unclassified"]
    assert rows["Modernização das aplicações"]["categories"] == ["MODERNIZAR"] and not rows[None]["wants_applications"]


def test_stream_intake_neither_loses_nor_repeats(spark, tmp_path):
    landing, target = tmp_path / "in", tmp_path / "out"
    landing.mkdir()
    schema = "assessment_id int, dataset_id int, record_fingerprint string, object_name string, object_type string"
    objects = lambda: spark.createDataFrame([(1, 1, "A", "class")], "assessment_id int, id long, object_name string, object_type string")

    def put(name, *keys):
        (landing / name).write_text("\n".join(json.dumps({"assessment_id": 1, "dataset_id": 1, "record_fingerprint": k, "object_name": "a", "object_type": None}) for k in keys))
        stream_intake(spark, str(landing), str(target), str(tmp_path / "cp"), schema, objects)
        return sorted(r["record_fingerprint"] for r in spark.read.parquet(f"{target}/records").collect())

    assert put("1.json", "x", "y", "y") == ["x", "y"] and put("2.json", "y", "z") == ["x", "y", "z"]
    assert {r["status"] for r in spark.read.parquet(f"{target}/correlations").collect()} == {"MATCHED_HEURISTIC"}
