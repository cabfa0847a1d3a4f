"""What the readers do once, and over how many tasks."""

from estatelens.functions import text
from estatelens.functions.text import last_wins
from estatelens.plans import readers
from estatelens.sources import workbook
from pyspark.sql import functions as F


def test_entries_are_made_once_for_last_wins(spark):
    rows = spark.createDataFrame([(["a", "b", "a", None], ["1", "2", "3", "4"])], "h array<string>, c array<string>")
    found = rows.select(last_wins(F.transform("h", lambda h, k: F.struct(F.upper(h).alias("key"), F.get(F.col("c"), k).alias("value")))).alias("m"))
    assert found._jdf.queryExecution().analyzed().toString().count("upper(") == 1 and found.first()["m"] == {"A": "3", "B": "2"}


def test_sheets_are_dealt_by_what_they_unpack_to(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workbook, "PARSED_BYTES", 20_000)
    row = '<row r="%d"><c r="A%d" t="inlineStr"><is><t>same text in every row</t></is></c></row>'
    for n in range(4):
        (tmp_path / f"w{n}.xlsx").write_bytes(readers.packed("w.xlsx", "".join(row % (k, k) for k in range(1, 201))))
    rows = workbook.read_findings_sheet(spark, str(tmp_path))
    assert rows.select(F.spark_partition_id()).distinct().count() > 1 and rows.count() == 4 * 199


def test_finding_rows_are_normalized_without_lambda_sorts_and_vain_parses(spark):
    texts = ["2024-03-01", "01/03/2024", "13/01/2024", "01/13/2024", " 01.03.2024 ", "45352", "45352.0", "01-03-2024", "1.3.2024", "x", "", None, "2024-03-01 10:00", "-", "30.02.2024"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    found = rows.select("k", text.normalize_date(F.col("t")).alias("d"))
    plain = rows.select("k", F.coalesce(F.when(F.col("t").rlike(r"^45352(\.0)?$"), F.lit("2024-03-01").cast("date")), *(F.try_to_date(text.strip_all(F.col("t")), f) for f in text.DATE_FORMATS)).alias("d"))
    assert sorted(found.collect()) == sorted(plain.collect())
    assert {r["k"] for r in found.collect() if r["d"]} == {0, 1, 2, 3, 4, 5, 6}
    assert found._jdf.queryExecution().analyzed().toString().lower().count("contains(") >= len(text.DATE_FORMATS)
    maps = spark.createDataFrame([({"b": "1", "a": None, "ab": "2", "é": "3"},)], "m map<string,string>")
    lines = maps.select(text.payload_text(F.col("m")).alias("p"), text.short_payload(F.col("m")).alias("s"))
    assert tuple(lines.first()) == ("a=\x00\nab=2\nb=1\né=3", "a=, b=1, é=3, ab=2")
    assert "array_sort" not in lines._jdf.queryExecution().analyzed().toString()
    heads = ["  Check  \t Title　", "\n", "OWN", " a\x1cB ", None]
    assert [r["h"] for r in spark.createDataFrame([(h,) for h in heads], "h string").select(text.normalize_header(F.col("h")).alias("h")).collect()] == ["check title", "", "own", "a\x1cb", None]


def test_usage_manifest_goes_through_headers_once(spark):
    heads = ["origin", "Object  Name", "OBJECT TYPE", "Usage Level", "ORIGIN", None]
    rows = spark.createDataFrame([("a", heads, ["x", "Z1", " T ", None, " own ", "y"]), ("a", heads, ["x", "Z2", "T", "　", "own", "y"]), ("b", heads[:3], ["x", "Z", "T"]), ("c", None, None)], "file string, headers array<string>, cells array<string>")
    found = workbook.usage_report_manifest(rows)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("upper(") == 1
    assert {(r["field"], r["value"]): r["n"] for r in found.collect()} == {("ROWS", ""): 2, ("ORIGIN", "own"): 2, ("OBJECT TYPE", "T"): 2, ("USAGE LEVEL", "(vazio)"): 2, ("MODULE", "(vazio)"): 2}


def test_texts_of_cells_with_and_without_runs(spark, tmp_path):
    rows = '<row r="1"><c r="A1" t="inlineStr"><is><t>a</t></is></c><c r="B1" t="inlineStr"><is><t>b</t></is></c><c r="D1" t="inlineStr"><is><t>d</t></is></c></row><row r="2"><c r="B2" t="inlineStr"><is><r><t>x</t></r><r><t>y</t></r></is></c><c r="A2" t="inlineStr"><is><t/></is></c><c r="C2"><v>3</v></c><c r="D2" t="inlineStr"><is/></c></row>'
    (tmp_path / "w.xlsx").write_bytes(readers.packed("w.xlsx", rows))
    (row,) = workbook.read_findings_sheet(spark, str(tmp_path)).collect()
    assert (row["headers"], row["cells"]) == (["a", "b", "None", "d"], ["", "xy", "3", ""])
