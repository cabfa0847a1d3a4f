from estatelens.functions import text
from estatelens.operators import dashboard, evidence, validate, vectors
from pyspark.sql import functions as F


def column(spark, build, values, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in df.select("k", build(F.col("v")).alias("x")).orderBy("k").select("x").collect()]


def test_dates(spark):
    found = column(spark, text.normalize_date, ["46139", "46139.0", "2026-04-27", "27/04/2026", "27.04.2026", "04/27/2026", " 2026-04-27 ", "never", "", None])
    assert [str(x) for x in found] == ["2026-04-27"] * 7 + ["None"] * 3


def test_priorities(spark):
    found = column(spark, text.normalize_priority, ["1", " 2 ", "1.5", "x", "", None])
    assert [(x["priority"], x["warning"] is not None) for x in found] == [(1, False), (2, False), (None, True), (None, True), (None, False), (None, False)]
    assert column(spark, text.numeric_priority, [1.7, None], "double") == [1, None]


def test_names(spark):
    assert column(spark, text.is_custom_object, ["zcl", "Y1", "/ABC/X", "CL_Z", "", None]) == [True, True, True, False, False, False]
    assert column(spark, text.strip_all, ["\t a \n", "  x y", None]) == ["a", "x y", None]
    assert column(spark, text.normalize_header, [" Check \t Title "]) == ["check title"]


def test_paths(spark):
    paths = {"a/Z.abap": "abap_source", "x.clas.xml": "abap_source", "x.xml": "xml_metadata", "A.CDS": "cds", "t.tabl": "ddic", "c.yaml": "configuration", "README.md": "documentation", "Makefile": "other", ".xml": "other", "l.html": "abap_source"}
    assert column(spark, text.classify_path, list(paths)) == list(paths.values())


def test_sanitized_xml(spark):
    given = ["a\x00b\x1c\tc\x7f", "&#0;&#x1;&#9;&#x41;", "&#xD800;&#57343;&#xFFFE;&#65535;&#xFFFD;", "&#\x010;x", "&#x0000b;&#00127;"]
    assert column(spark, text.sanitize_xml, given) == ["ab\tc", "&#9;&#x41;", "&#xFFFD;", "x", ""]


def test_fingerprints(spark):
    df = spark.createDataFrame([({"b": "1", "a": None},), ({"a": None, "b": "1"},), ({"a": "", "b": "1"},)], "m map<string,string>")
    a, b, c = (r[0] for r in df.select(text.row_fingerprint(F.col("m"))).collect())
    assert a == b != c and len(a) == 16


def test_query_text(spark):
    df = spark.createDataFrame([("N", "D", "dom"), ("N", "", "dom"), ("", "", "dom"), (None, None, None)], "n string, d string, o string")
    assert [r[0] for r in df.select(text.query_text(F.col("n"), F.col("d"), F.col("o"), F.lit(7))).collect()] == ["N. D", "N", "dom", "Application 7"]


def test_bounded_evidence_keeps_the_worst(spark):
    df = spark.createDataFrame([(1, "ATC", 3, n) for n in range(100)] + [(1, "ATC", 1, 100 + n) for n in range(50)] + [(1, "OBJ", 0, n) for n in range(200)], "application_id int, pool string, severity_rank int, entity_id long")
    kept, omitted = evidence.bounded_evidence(df, {"ATC": 80})
    assert kept.where("pool = 'ATC' and severity_rank = 1").count() == 50 and kept.where("pool = 'ATC'").count() == 80 and kept.where("pool = 'OBJ'").count() == 200
    assert {r["pool"]: (r["total"], r["omitted"]) for r in omitted.collect()} == {"ATC": (150, 70), "OBJ": (200, 0)}


RESULT = "technical_risk string, technical_risk_rationale string, technical_risk_evidence_refs array<string>, business_importance string, business_importance_rationale string, business_importance_evidence_refs array<string>, recommendation string, recommendation_rationale string, recommendation_evidence_refs array<string>, technical_refs array<string>, business_refs array<string>, guidance_refs array<string>, status string"


def test_assessments(spark):
    pools = (["T1", "T2"], ["B1"], ["G1"])
    df = spark.createDataFrame([
        ("HIGH", "r", ["T2", "B1", "T2", "T1"], "LOW", "r", ["T1"], "REMEDIAR", "x", ["G1", "T1"], *pools, "COMPLETED"), (None, "why not", ["T1"], None, " ", [], None, "kept", ["T1"], *pools, "COMPLETED"),
    ], RESULT)
    assert [len(r["errors"]) for r in validate.validate_assessment(df).collect()] == [2, 3]
    first, second = validate.sanitize_assessment(df).collect()
    assert first["technical_risk_evidence_refs"] == ["T2", "T1"] and first["business_importance"] is None and first["business_importance_rationale"] == "" and first["status"] == "COMPLETED"
    assert (second["technical_risk_rationale"], second["recommendation_rationale"], second["recommendation_evidence_refs"], second["status"]) == ("", "kept", [], "INSUFFICIENT_CONTEXT")
    assert all(not r["errors"] for r in validate.validate_assessment(validate.sanitize_assessment(df)).collect())


def test_search_is_exact_and_scoped(spark):
    vectors_ = spark.createDataFrame([(1, "A", 1, [1.0, 0.0]), (1, "A", 2, [1.0, 1.0]), (1, "B", 3, [0.0, 1.0]), (1, "A", 4, [0.0, 0.0]), (2, "A", 5, [1.0, 0.0]), (1, "B", 6, [2.0, 0.0])], "assessment_id int, entity_type string, entity_id long, vector array<double>")
    asked = spark.createDataFrame([(1, 1, [1.0, 0.0])], "query_id long, assessment_id int, vector array<double>")
    assert [r["entity_id"] for r in vectors.cosine_topk(asked, vectors_, 10).orderBy("rank").collect()] == [1, 6, 2, 3, 4]
    assert [r["entity_id"] for r in vectors.cosine_topk(asked, vectors_, 10, ["B"]).orderBy("rank").collect()] == [6, 3]


def test_embedding_runs_on_changes_only(spark):
    from estatelens.operators.changes import changed_entities

    entities = spark.createDataFrame([(1, "A", 1, "x y"), (1, "A", 2, None)], "assessment_id int, entity_type string, entity_id long, content_text string")
    first = vectors.embed(changed_entities(entities, spark.createDataFrame([], "assessment_id int, entity_type string, entity_id long, content_hash string")), vectors.hash_embedder(8))
    assert first.count() == 2 and len(first.first()["vector"]) == 8
    edited = spark.createDataFrame([(1, "A", 1, "x z"), (1, "A", 2, None)], entities.schema)
    assert [r["entity_id"] for r in changed_entities(edited, first).collect()] == [1]


def test_dataset_status(spark):
    df = spark.createDataFrame([(None, 1, 5, []), (None, 1, 0, []), (None, 1, 5, ["w"]), ("boom", 1, 5, [])], "error string, n_capabilities int, n_rows int, warnings array<string>")
    assert [(r["status"], len(r["warnings"])) for r in dashboard.dataset_status(df).collect()] == [("FULL", 0), ("PARTIAL", 1), ("PARTIAL", 1), ("FAILED", 0)]
