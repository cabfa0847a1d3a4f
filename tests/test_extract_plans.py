"""What the extraction of objects does once, and that it moves no lines."""

from estatelens.operators import extract
from pyspark.sql import functions as F


def test_objects_are_found_in_their_row_and_texts_made_once(spark, tmp_path):
    rows = [(k, f"f{k}.abap", "abap_source", f"report z{k}.\nCLASS c{k} DEFINITION\nMETHODS go\nEND{{}}.\nFUNCTION f{k}.\n*\" IMPORTING\n*\" VALUE(a) TYPE i\nENDFUNCTION.".format("CLASS" if k % 2 else "")) for k in range(4)]
    spark.createDataFrame(rows, "id long, rel_path string, category string, text string").write.parquet(str(tmp_path / "f"))
    made = spark.read.parquet(str(tmp_path / "f")).withColumn("content", F.regexp_replace("text", "(?m)^report ", "REPORT ")).drop("text")
    found = extract.extract_objects(made)
    plan = found._jdf.queryExecution()
    assert "Exchange" not in plan.executedPlan().toString()
    # once for source files; the filter of the dictionary files, of which there are none, is a scan of its own
    source = plan.optimizedPlan().children().head().toString()
    assert source.count("(?m)^report ") == 1
    assert sorted((r["file_id"], r["object_type"], r["object_name"], r["line_start"], r["line_end"]) for r in found.collect()) == [(0, "report", "Z0", 1, 8), (1, "class", "C1", 2, 4), (2, "report", "Z2", 1, 8), (3, "class", "C3", 2, 4)]


def test_stretches_and_sections(spark):
    text = "ENDCLASS.\rMETHODS lost CLASS a DEFINITION\x85METHODS m INHERITING FROM b\nCLASS c DEFINITION INHERITING FROM d\r\nENDCLASS.\x0bCLASS open DEFINITION"
    code = 'FUNCTION f.\n*" VALUE(z) TYPE i\n*" EXPORTING\n*" VALUE(a) TYPE i\n*" IMPORTING\n*" VALUE(b) TYPE j\n*" EXPORTING\n*" VALUE(c) TYPE k\nENDFUNCTION.\nENDFUNCTION.'
    df = spark.createDataFrame([(1, "a", text), (2, "b", code), (3, "c", None), (4, "d", "")], "id long, rel_path string, content string")
    (c,), (f,) = extract.class_objects(df).collect(), extract.function_objects(df).collect()
    assert (c["object_name"], c["line_start"], c["line_end"], c["attributes"]["methods"], c["attributes"]["superclass"]) == ("A", 3, 6, ["M"], "B")
    assert (f["line_start"], f["line_end"], f["attributes"]["importing"], f["attributes"]["exporting"]) == (1, 9, ["b:j"], ["a:i", "c:k"])
    assert extract.report_objects(df).count() == 0
    lines = spark.createDataFrame([("a\n\n",), ("\n",), ("a\r\n",), ("\n\r",), ("a",), ("",), (None,)], "t string").select(extract.lines_of(F.col("t")).alias("l"))
    assert [r["l"] for r in lines.collect()] == [["a", ""], [""], ["a"], ["", ""], ["a"], [], []]
