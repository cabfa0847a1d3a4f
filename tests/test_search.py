"""Text filters with and without the index; correlations updated from the change alone; an intake that forgets no key."""

import json
import random
import shutil

import pytest
from estatelens.operators import correlate, dashboard, search
from estatelens.streaming.intake import stream_intake

SIGNS = ["ab", "Ab", "b c", "%", "_", "é", "É", "x\ny", "ZZ", "\U0001f600", "\\"]


@pytest.mark.parametrize("q", ["aba", "AB", "b cab", "ab%b c", "b_c", "zzz%", "_", "é b", "bcx", "abab", "\\%ab", None, ""])
def test_index_changes_no_result(spark, tmp_path_factory, q):
    r = random.Random(1)
    rows = [(k, 1, "U", "".join(r.choice(SIGNS) for _ in range(r.randrange(9))) if k % 7 else None, "".join(r.choice(SIGNS) for _ in range(6)), "CANDIDATE") for k in range(150)]
    rules = spark.createDataFrame(rows, "id long, assessment_id int, rule_type string, condition string, action string, status string")
    folder = str(tmp_path_factory.getbasetemp() / "grams")
    if not (tmp_path_factory.getbasetemp() / "grams").exists():
        search.write_text_index(rules, folder, "id", "condition", "action")
    plain = {x["id"] for x in dashboard.filter_rules(rules, q=q).collect()}
    assert {x["id"] for x in dashboard.filter_rules(rules, q=q, index=spark.read.parquet(folder)).collect()} == plain


def test_grams_of_search_texts():
    assert search.grams_of("abcd") == ["abc", "bcd"] and search.grams_of("ab%cd") == [] and search.grams_of("ABC_x") == ["abc"] and search.grams_of("a\\%bcde") == ["bcd", "cde"]


def test_updated_correlations_equal_full_ones(spark):
    r = random.Random(3)
    schema = "assessment_id int, id long, object_name string, object_type string"
    objects = lambda seed: spark.createDataFrame([(r.randrange(2), seed + k, f"N{r.randrange(30)}", r.choice(["class", "report", None])) for k in range(40)], schema)
    before = objects(0)
    now = before.where("id % 4 <> 1").unionByName(objects(1000).limit(12))
    records = spark.createDataFrame([(k, r.randrange(2), r.choice([None, "", " n5 ", f"n{r.randrange(35)}"]), r.choice(["CLASS", "report", ""])) for k in range(300)], "id long, assessment_id int, object_name string, object_type string")
    old = correlate.correlate(records.where("id % 3 > 0"), before)
    wanted = correlate.correlate(records, now)
    got = correlate.update_correlations(old, records.where("id % 3 = 0"), before, now)
    assert sorted(map(tuple, got.select(*wanted.columns).collect())) == sorted(map(tuple, wanted.collect()))
    findings = correlate.correlate_findings(records, before)
    assert sorted(map(tuple, correlate.recorrelate_names(findings, before, now).collect()), key=repr) == sorted(map(tuple, correlate.recorrelate(findings, now).collect()), key=repr)
    assert not correlate.changed_names(now, now).collect() and correlate.changed_names(before, now).count() < 61


def test_keys_are_remembered_without_the_history(spark, tmp_path):
    landing, target = tmp_path / "in", tmp_path / "out"
    landing.mkdir()
    schema = "assessment_id int, dataset_id int, record_fingerprint string, object_name string, object_type string"
    objects = lambda: spark.createDataFrame([(1, 1, "A", "class")], "assessment_id int, id long, object_name string, object_type string")

    def put(name, *keys):
        (landing / name).write_text("\n".join(json.dumps({"assessment_id": 1, "dataset_id": 1, "record_fingerprint": k, "object_name": "a"}) for k in keys))
        stream_intake(spark, str(landing), str(target), str(tmp_path / "cp"), schema, objects)
        return sorted(repr(x["record_fingerprint"]) for x in spark.read.schema(schema).parquet(f"{target}/records").collect())

    assert put("1.json", "x", "y", None, None) == ["'x'", "'y'", "None"]
    shutil.rmtree(target / "records" / "batch_id=0")  # what was taken in is not read again
    assert put("2.json", "y", "z", None) == ["'z'"] and put("3.json", "x", "z") == ["'z'"]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_index_splits_a_text_once(spark):
    """Not once for each of its characters, which made the work grow with the square of a text."""
    index = search.text_index(spark.createDataFrame([(1, "abcd" * 5000, "xyz")], "id long, a string, b string"), "id", "a", "b")
    assert index._jdf.queryExecution().optimizedPlan().toString().count("split(") == 2
    assert {x["gram"] for x in index.collect()} == {"abc", "bcd", "cda", "dab", "xyz"}
