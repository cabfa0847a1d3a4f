from estatelens.operators import changes, correlate, dashboard

OBJECTS = [(1, 1, "ZCL_EXACT", "class"), (1, 2, "ZCL_HEUR", "class"), (1, 3, "ZCL_DUP", "report"), (1, 4, "ZCL_DUP", "class"), (2, 5, "ZCL_MISSING", "class")]
RECORDS = [
    (1, "k1", " zcl_exact\t", "CLASS"), (1, "k2", "ZCL_HEUR", "REPORT"), (1, "k3", "ZCL_MISSING", None), (1, "k4", "ZCL_DUP", None), (1, "k5", None, None),
    (1, "k6", "ZCL_DUP", "CLASS"), (1, "k7", " \t", "CLASS"), (1, "k8", "ZCL_EXACT", " "),
]


def frames(spark):
    return spark.createDataFrame(RECORDS, "assessment_id int, key string, object_name string, object_type string"), spark.createDataFrame(OBJECTS, "assessment_id int, id long, object_name string, object_type string")


def test_statuses(spark):
    records, objects = frames(spark)
    found = {r["key"]: (r["status"], r["target_id"], r["method"]) for r in correlate.correlate(records, objects).collect()}
    assert found == {
        "k1": ("MATCHED_EXACT", 1, "object_name_type_exact"), "k2": ("MATCHED_HEURISTIC", 2, "object_name_only"), "k3": ("UNMATCHED", None, "object_name_only"),
        "k4": ("AMBIGUOUS", None, "object_name_only"), "k5": ("NOT_APPLICABLE", None, "no_object_identity"), "k6": ("MATCHED_EXACT", 4, "object_name_type_exact"),
        "k7": ("NOT_APPLICABLE", None, "no_object_identity"), "k8": ("MATCHED_HEURISTIC", 1, "object_name_only"),
    }
    assert {r["key"] for r in correlate.correlate_findings(records, objects).where("status = 'UNMATCHED'").collect()} == {"k3", "k5", "k7"}


def test_type_codes_are_off_by_default(spark):
    _, objects = frames(spark)
    record = spark.createDataFrame([(1, "a", "ZCL_EXACT", "CLAS")], "assessment_id int, key string, object_name string, object_type string")
    assert correlate.correlate(record, objects).first()["status"] == "MATCHED_HEURISTIC"
    assert correlate.correlate(record, objects, type_codes={"CLAS": "class"}).first()["status"] == "MATCHED_EXACT"


def test_summary_fills_zeros_and_keeps_the_count(spark):
    records, objects = frames(spark)
    summary = correlate.correlation_summary(correlate.correlate(records, objects), "assessment_id", zero_fill=True).collect()
    assert len(summary) == 5 and sum(r["n"] for r in summary) == len(RECORDS)


def test_recorrelate_returns_changes_only(spark):
    records, objects = frames(spark)
    first = correlate.correlate_findings(records, objects)
    assert not correlate.recorrelate(first, objects).collect()
    more = objects.unionByName(spark.createDataFrame([(1, 9, "zcl_missing", "class")], objects.schema))
    changed = correlate.recorrelate(first, more).collect()
    assert [(r["key"], r["target_id"]) for r in changed] == [("k3", 9)]


def test_append_twice_is_once(spark):
    old = spark.createDataFrame([(1, "a", "x")], "dataset_id int, record_fingerprint string, v string")
    new = spark.createDataFrame([(1, "a", "y"), (1, "b", "y"), (1, "b", "y"), (2, "a", "z")], old.schema)
    keys = ["dataset_id", "record_fingerprint"]
    once = changes.append_new(old, new, keys)
    assert sorted(map(tuple, once.collect())) == [(1, "a", "x"), (1, "b", "y"), (2, "a", "z")]
    assert changes.new_rows(once, new, keys).count() == 0


def test_upsert_keeps_ids_and_drop_stale_spares_other_scans(spark):
    schema = "id long, assessment_id int, canonical_key string, object_name string, source_file_id long, line_start int"
    old = spark.createDataFrame([(7, 1, "CLASS::A", "old", 1, 1), (8, 1, "CLASS::B", "b", 1, 1), (9, 1, "CLASS::C", "c", 2, 1)], schema)
    parsed = spark.createDataFrame([(1, "CLASS::A", "new", 1, 5), (1, "CLASS::A", "newer", 3, 1), (1, "CLASS::D", "d", 1, 1)], "assessment_id int, canonical_key string, object_name string, source_file_id long, line_start int")
    rows = {r["canonical_key"]: r for r in changes.upsert_objects(old, parsed).collect()}
    assert (rows["CLASS::A"]["id"], rows["CLASS::A"]["object_name"]) == (7, "newer") and rows["CLASS::B"]["object_name"] == "b" and rows["CLASS::D"]["id"] is not None
    files = spark.createDataFrame([(1, 10), (2, 11), (3, 10)], "id long, scan_id int")
    left = changes.drop_stale(old, parsed, files, 10)
    assert sorted(r["canonical_key"] for r in left.collect()) == ["CLASS::A", "CLASS::C"]


def test_curation_follows_the_log(spark):
    refs = "array<struct<ref_id:string,source_type:string,entity_id:bigint>>"
    apps = spark.createDataFrame([(n, f"app{n}", "CANDIDATE", None, [(f"R{n}", "E", n)]) for n in (1, 2, 3)], f"id long, name string, status string, merged_into_id long, evidence_refs {refs}")
    objects = spark.createDataFrame([(10, 1), (11, 2), (12, 3), (13, 1)], "id long, application_id long")
    log = spark.createDataFrame([
        (1, "rename", 2, None, None, "Two"), (2, "merge", 1, None, 2, None), (3, "merge", 2, None, 3, None), (4, "rename", 1, None, None, "late"),
        (5, "merge", 3, None, 1, None), (6, "move", 1, 13, None, None), (7, "merge", 3, None, 3, None), (8, "move", None, 12, None, None),
    ], "seq long, action string, application_id long, object_id long, target_id long, name string")
    got_apps, got_objects = changes.apply_curation(apps, objects, log)
    rows = {r["id"]: r for r in got_apps.collect()}
    assert (rows[1]["status"], rows[1]["merged_into_id"], rows[1]["name"]) == ("MERGED", 2, "app1")
    assert (rows[2]["status"], rows[2]["merged_into_id"], rows[2]["name"]) == ("MERGED", 3, "Two") and rows[3]["status"] == "CANDIDATE"
    assert dict(map(tuple, got_objects.collect())) == {10: 3, 11: 3, 12: None, 13: 1}


def test_pages_by_key_are_pages_by_number(spark):
    rows = [(k, None if k % 3 == 0 else k % 4, k % 7) for k in range(60)]
    findings = spark.createDataFrame(rows, "id long, priority int, source_row_number long")
    wanted = sorted(rows, key=lambda x: (x[1] is None, x[1] or 0, x[2], x[0]))
    got, last = [], None
    while page := [tuple(x) for x in dashboard.findings_after(findings, last, 7).select("id", "priority", "source_row_number").collect()]:
        got += page
        last = (page[-1][1], page[-1][2], page[-1][0])
    assert got == wanted
