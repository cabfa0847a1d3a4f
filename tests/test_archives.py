"""Files of any size, archives by their directories, large sheets, damaged exports, and imports that can be stopped."""

import hashlib
import io
import json
import random
import zipfile

import pytest
from estatelens.sources import adapters, archives, exports, files, ranges, workbook, xml_sections
from pyspark.sql import functions as F

NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def chunk(*rows):
    return json.dumps({"dataSet": {"keyFigureId": "F", "header": ["A"], "data": [list(r) for r in rows]}})


def box_of(path, members, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as box:
        for name, text in members.items():
            box.writestr(name, text)


def workbook_of(path, rows, strings=(), sheets=None, prefix="", junk=""):
    """rows: lists of cells, a number as an index of `strings`, text inline, None left out."""
    p = f"{prefix}:" if prefix else ""
    ns = f'xmlns{":" + prefix if prefix else ""}="{NS}" xmlns:x14ac="urn:x"'
    lines = ""
    for r, cells in enumerate(rows, 1):
        inner = "".join(f'<{p}c r="{chr(65 + k)}{r}" t="s"><{p}v>{c}</{p}v></{p}c>' if isinstance(c, int) else f'<{p}c r="{chr(65 + k)}{r}" t="inlineStr"><{p}is><{p}t>{c}</{p}t></{p}is></{p}c>' for k, c in enumerate(cells) if c is not None)
        lines += f'<{p}row r="{r}" x14ac:dyDescent="0.2">{inner}</{p}row>\n' if inner else f'<{p}row r="{r}"/>'
    shared = "".join(f'<{p}si><{p}t xml:space="preserve">{s}</{p}t></{p}si>' for s in strings)
    members = {
        "xl/workbook.xml": f'<workbook xmlns="{NS}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{n}" sheetId="1" r:id="{i}"/>' for n, i in (sheets or {"data": "r1"}).items()) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s1.xml"/></Relationships>',
        "xl/worksheets/s1.xml": f'<?xml version="1.0"?>\n<{p}worksheet {ns}><{p}sheetData>{lines}{junk}</{p}sheetData><{p}rowBreaks count="0"/></{p}worksheet>', "xl/sharedStrings.xml": f'<{p}sst {ns}>{shared}</{p}sst>',
    }
    box_of(path, members)


def test_files_are_hashed_and_peeked_as_streams(spark, tmp_path):
    big = random.Random(1).randbytes(9_000_000)
    (tmp_path / "big {1}.bin").write_bytes(big)
    (tmp_path / "empty.bin").write_bytes(b"")
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / ".b").mkdir()
    (tmp_path / "a" / ".b" / "_hidden").write_bytes(b"h")
    (tmp_path / "e.xml").write_text("<ROOT>\n<A_B>\n<ROW x='1'/></A_B></ROOT>" + " " * 100_000)
    rows = {r["rel_path"]: r for r in files.scan_files(spark, str(tmp_path), 10).collect()}
    assert rows["big {1}.bin"]["sha256"] == hashlib.sha256(big).hexdigest() and rows["big {1}.bin"]["content"] is None
    assert rows["empty.bin"]["sha256"] == hashlib.sha256(b"").hexdigest() and rows["empty.bin"]["content"] == b""
    assert set(rows) == {"big {1}.bin", "empty.bin", "a/.b/_hidden", "e.xml"} and rows["a/.b/_hidden"]["content"] == b"h"
    with pytest.raises(OSError):
        files.scan_files(spark, str(tmp_path / "missing"))
    ends = {r["path"].rsplit("/", 1)[-1]: r for r in ranges.peeked(spark, str(tmp_path), 10).collect()}
    assert ends["big {1}.bin"]["head"] == big[:65536] and ends["big {1}.bin"]["tail"] == big[-65536:]
    assert {r["rel_path"].rsplit("/", 1)[-1]: r["format"] for r in adapters.detect(spark, str(tmp_path), 10).collect()} == {"big {1}.bin": None, "e.xml": "sectioned_xml"}
    with pytest.raises(OSError, match="no access to odd files"):
        ranges.opened("odd://x/y")
    lost = spark.createDataFrame([("file:/nowhere/at all",)], "path string")
    assert ranges.hashed(lost).first()["error"] and ranges.hashed(lost).first()["sha256"] is None


def test_members_of_one_archive_are_dealt_over_tasks(spark, tmp_path):
    box_of(tmp_path / "k.zip", {f"m{k}.json": chunk([str(k)]) for k in range(2000)} | {"skip.txt": "x"}, zipfile.ZIP_STORED)
    found = archives.list_members(ranges.listed(spark, str(tmp_path)), (".json",))
    dealt = archives.dealt(found, 20_000)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 2000 and len(sizes) >= 5 and max(sizes) <= 2 * 2000 // len(sizes) + 200
    texts = {r["member"]: r["text"] for r in archives.read_texts(dealt).collect()}
    assert len(texts) == 2000 and texts["m77.json"] == chunk(["77"])


def test_xml_of_archives_is_read_in_ranges(spark, tmp_path):
    rows = "".join(f'<ROW NAME="n{k}"/>\n' for k in range(3000))
    box_of(tmp_path / "a.zip", {"small.xml": "<a/>", "big.xml": f"<ROOT><PROGRAMS>{rows}</PROGRAMS></ROOT>"})
    box_of(tmp_path / "b.zip", {"big.xml": "<p:ROOT xmlns:p='u'><p:PROGRAMS><p:ROW NAME='q'/></p:PROGRAMS></p:ROOT>"})
    (tmp_path / "c.xml").write_text("<ROOT><PROGRAMS><ROW NAME='bare'/></PROGRAMS></ROOT>")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        found = xml_sections.read_sectioned_xml(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    by_file = {}
    for r in found:
        by_file.setdefault(r["file"].rsplit("/", 1)[-1], {})[r["row_index"]] = r["attrs"]["NAME"]
    assert by_file == {"a.zip": {k: f"n{k}" for k in range(3000)}, "b.zip": {0: "q"}, "c.xml": {0: "bare"}} and len(found) == 3002


@pytest.mark.parametrize("prefix", ["", "x"])
def test_large_sheets_equal_small_ones(spark, tmp_path, prefix):
    r = random.Random(4)
    strings = [f"s{k} &amp; &lt;row " for k in range(50)] + [" "]
    rows = [[], [None, " "], ["Head", 0, None, "D"], *([r.choice([None, 3, 7, 50, f"t{k} a:b", " "]) for _ in range(r.randrange(6))] for k in range(400))]
    workbook_of(tmp_path / "a.xlsx", rows, strings, prefix=prefix)
    workbook_of(tmp_path / "b.xlsx", [["x"], ["y"]], prefix=prefix)
    workbook_of(tmp_path / "empty.xlsx", [[], [None]], prefix=prefix)
    (tmp_path / "bad.xlsx").write_bytes(b"PK\3\4junk")
    small = workbook.read_findings_sheet(spark, str(tmp_path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        large = workbook.read_findings_sheet(spark, str(tmp_path), large=0).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    plain = lambda found: sorted(map(repr, found))
    assert plain(large) == plain(small.collect()) and sum(x["error"] is not None for x in large) == 1 and len(large) > 200


def damage(data, name):
    """The bytes of an archive with what is packed of a member changed."""
    with zipfile.ZipFile(io.BytesIO(data)) as box:
        inside = box.getinfo(name)
    at = inside.header_offset + 30 + len(name) + inside.compress_size // 2
    return data[:at] + bytes(b ^ 0x55 for b in data[at : at + 4]) + data[at + 4 :]


def test_damaged_exports_of_all_readers_give_error_rows(spark, tmp_path):
    good = tmp_path / "good"
    good.mkdir()
    box_of(good / "x.zip", {"x.xml": "<ROOT><PROGRAMS>" + "".join(f'<ROW NAME="{k * k}"/>' for k in range(500)) + "</PROGRAMS></ROOT>"})
    box_of(good / "k.zip", {"a.json": chunk(*([str(k * k)] for k in range(500))), "b.json": chunk(["1"])})
    box_of(good / "d.docx", {"word/document.xml": '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:tbl/></w:body></w:document>' + " " * 500})
    workbook_of(good / "w.xlsx", [["A"], *([str(k * k)] for k in range(500))], ["s"])
    members = {"x.zip": "x.xml", "k.zip": "a.json", "d.docx": "word/document.xml", "w.xlsx": "xl/worksheets/s1.xml"}
    for name, member in members.items():
        data, suffix = (good / name).read_bytes(), name.rsplit(".", 1)[1]
        (tmp_path / f"crc-{name}").write_bytes(damage(data, member))
        (tmp_path / f"cut-{name}").write_bytes(data[: len(data) // 2])
        (tmp_path / f"empty-{name}").write_bytes(b"")
        box_of(tmp_path / f"other-{name[:-len(suffix) - 1]}.{suffix}", {"readme": "nothing"})
    workbook_of(tmp_path / "broken-w.xlsx", [["A"], ["1"]], junk="<row r='9'><c><unclosed></row>")
    workbook_of(tmp_path / "unlinked-w.xlsx", [["A"], ["1"]], sheets={"data": "r9"})
    workbook_of(tmp_path / "string-w.xlsx", [["A"], [7]], ["only one"])
    errors = lambda df, name="file", error="error": {r[name].rsplit("/", 1)[-1] for r in df.where(F.col(error).isNotNull()).collect()}
    sheets = workbook.read_findings_sheet(spark, str(tmp_path / "*.xlsx"))
    assert errors(sheets) == {f"{x}-w.xlsx" for x in ("crc", "cut", "other", "broken", "unlinked", "string")}
    assert errors(workbook.read_findings_sheet(spark, str(tmp_path / "*.xlsx"), large=0)) >= {f"{x}-w.xlsx" for x in ("crc", "cut", "other", "broken", "unlinked")}
    assert errors(workbook.read_findings_sheet(spark, str(good / "w.xlsx"), "no such sheet")) == {"w.xlsx"} and workbook.read_findings_sheet(spark, str(good / "w.xlsx"), "data").count() == 500
    assert workbook.map_headers(sheets).where("status = 'REJECTED'").count() >= 4
    xml = xml_sections.read_sectioned_xml(spark, str(tmp_path / "*x.zip"))
    assert errors(xml) == {f"{x}-x.zip" for x in ("crc", "cut", "other")} and xml_sections.curate_sections(xml).count() == 0 and xml_sections.section_manifest(xml).count() == 0
    kpi = exports.read_kpi_members(spark, str(tmp_path / "*k.zip"))
    assert errors(kpi) == {f"{x}-k.zip" for x in ("crc", "cut")} and [r["member"] for r in kpi.where("error is null").collect()] == ["b.json"]
    assert exports.kpi_records(exports.read_kpi_chunks(kpi)).count() == 1
    tables = exports.read_document_tables(spark, str(tmp_path / "*d.docx"))
    assert errors(tables) == {f"{x}-d.docx" for x in ("crc", "cut", "other")}


def test_streams_without_prefixes():
    for text, wanted in (
        ("<a><b/></a>", "<a><b/></a>"), ("<p:a xmlns:p='u'><p:b c='p:d'>p:e</p:b><q:f/></p:a>", "<a xmlns:p='u'><b c='p:d'>p:e</b><q:f/></a>"), ("<?xml version='1.0'?><!-- <z:z> --><p:a><p:b/></p:a>", "<?xml version='1.0'?><!-- <z:z> --><a><b/></a>"), ("", ""), ("no xml", "no xml"),
    ):
        for size in (1, 3, 7, 1000):
            assert b"".join(archives.without_prefixes(io.BytesIO(text.encode()), size)).decode() == wanted, (text, size)


def exported(folder, k):
    """Exports of all five formats; k makes their contents differ, their keys are equal."""
    folder.mkdir()
    (folder / "p.xml").write_text(f"<ROOT>\n<PROGRAMS>\n<ROW NAME='P{k}'/><ROW NAME='Q{k}'/></PROGRAMS></ROOT>")
    workbook_of(folder / "u.xlsx", [["OBJECT NAME", "OBJECT TYPE", "USAGE LEVEL", "ORIGIN"], [f"U{k}", "T", "Unused", "Customer"]])
    box_of(folder / "k.zip", {"c.json": chunk([f"v{k}"], ["w"])})
    (folder / "sizing.txt").write_text("-" * 20 + "\n| Table  Size |\n| " + "-" * 12 + f" |\n| TAB_{k}   1,5 |\n| TAB_X   2,5 |\n" + "-" * 20)
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    box_of(folder / "readiness.docx", {"word/document.xml": f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:tbl><w:tr>{cell("Table")}{cell("Size in GiB")}</w:tr><w:tr>{cell(f"D{k}")}{cell(1)}</w:tr></w:tbl></w:body></w:document>'})
    return str(folder)


PER_FOLDER = {"sectioned_xml": 2, "usage_sheet": 1, "kpi_chunks": 2, "sizing_report": 2, "readiness_docx": 1}


def test_equal_keys_of_two_files_stay_apart_in_every_format(spark, tmp_path):
    one, two = exported(tmp_path / "1 [a]", 1).replace("[", "\\[").replace("]", "\\]"), exported(tmp_path / "2", 2)
    none = spark.createDataFrame([], ", ".join(f"{c} string" for c in adapters.RECORD))
    for fmt, n in PER_FOLDER.items():
        name = {"sectioned_xml": "*.xml", "usage_sheet": "*.xlsx", "kpi_chunks": "*.zip", "sizing_report": "*.txt", "readiness_docx": "*.docx"}[fmt]
        both = adapters.import_batch(spark, [f"{one}/{name}", f"{two}/{name}"], fmt, none)
        rows = both.collect()
        assert len(rows) == 2 * n and len({(r["dataset_id"], r["record_fingerprint"]) for r in rows}) == 2 * n and len({r["source_key"] for r in rows}) == n, fmt
        first = spark.createDataFrame([r for r in rows if r["dataset_id"] == rows[0]["dataset_id"]], both.schema)
        assert adapters.import_batch(spark, [f"{one}/{name}", f"{two}/{name}"], fmt, first).count() == n
        assert adapters.import_batch(spark, [f"{one}/{name}", f"{two}/{name}"], fmt, both).count() == 0


def test_imports_go_on_where_they_stopped(spark, tmp_path):
    one, two, target = exported(tmp_path / "a{1}", 1), exported(tmp_path / "b", 2), str(tmp_path / "target")
    one = one.replace("{", "\\{").replace("}", "\\}")
    (tmp_path / "b" / "copy.txt").write_text((tmp_path / "a{1}" / "sizing.txt").read_text())  # the same bytes: the same data set
    calls = []

    def stop(session, paths):
        calls.append(paths)
        raise RuntimeError("stopped")

    failing = adapters.ADAPTERS | {"sizing_report": adapters.Adapter(stop, adapters.ADAPTERS["sizing_report"].manifest)}
    with pytest.raises(RuntimeError, match="stopped"):
        adapters.import_all(spark, one, target, failing)
    states = {r["format"]: r["state"] for r in adapters.ledger(spark, target).collect()}
    assert states == {"kpi_chunks": "DONE", "readiness_docx": "DONE", "sectioned_xml": "DONE", "sizing_report": "PLANNED", "usage_sheet": "PLANNED"}
    assert adapters.imported(spark, target).count() == 5
    # a batch that was written but not noted as done is not read, and is written again
    spark.createDataFrame([("d", "r", "c", "k", "f", None)], ", ".join(f"{c} string" for c in adapters.RECORD)).write.parquet(f"{target}/records/run=1/format=sizing_report/batch=0")
    assert adapters.imported(spark, target).count() == 5
    assert adapters.import_all(spark, one, target) == 2 and adapters.imported(spark, target).count() == 8
    assert adapters.import_all(spark, one, target) == 0
    assert adapters.import_all(spark, [one, two], target, batch_files=1) == 5 and adapters.imported(spark, target).count() == 16
    rows = adapters.ledger(spark, target).collect()
    assert {r["state"] for r in rows} == {"DONE"} and len(rows) == 10 and {r["run"] for r in rows} == {1, 2}
