"""Readers and the files they are tried on: work in proportion to what is read, not to the number of files or paths."""

import pyarrow as pa
import pytest
from estatelens.plans import readers
from estatelens.plans.base import Inputs
from estatelens.sources import adapters, archives, ranges, workbook
from pyspark.sql import functions as F


def tasks(df):
    return df.rdd.getNumPartitions()


@pytest.fixture
def many(spark, tmp_path):
    for n in range(400):
        (tmp_path / f"f{n:03d}.json").write_text("{}")
    return str(tmp_path)


def test_lines_become_files_in_order(spark, tmp_path):
    rows = spark.range(25_000).select(F.expr("id div 12000").alias("k"), "id", F.concat(F.lit("l"), F.col("id").cast("string")).alias("line"))
    ordered = rows.repartition(3, "k").sortWithinPartitions("k", F.desc("id"))
    folder = readers.written_lines(Inputs(spark, str(tmp_path)), ordered, lambda k, body: (f"n{k}.txt", f"<{body}>"), "|")
    found = {r["path"].rsplit("/", 1)[-1]: bytes(r["content"]).decode() for r in ranges.listed(spark, folder).collect()}
    assert found == {f"n{k}.txt": "<" + "|".join(f"l{n}" for n in reversed(range(k * 12000, min(25_000, (k + 1) * 12000)))) + ">" for k in range(3)}


def test_members_of_small_files_are_listed_in_few_tasks(spark, many):
    found = archives.list_members(ranges.listed(spark, many), (".json",), (".json",))
    assert found.count() == 400 and tasks(found) == 1


def test_small_members_share_tasks(spark):
    members = spark.range(300).select(F.lit("f").alias("file"), F.col("id").cast("string").alias("member"), F.lit(1000).cast("long").alias("packed"))
    large = members.withColumn("packed", F.lit(8 << 20).cast("long"))
    assert tasks(archives.one_a_task(members)) <= 8 < tasks(archives.one_a_task(large))
    assert archives.one_a_task(members).count() == archives.one_a_task(large).count() == 300


def test_many_paths_are_listed_in_few_tasks(spark, many):
    sc = spark.sparkContext
    sc.setJobGroup("listing", "")
    paths = [f"{many}/f{n:03d}.json" for n in range(400)]
    try:
        files = ranges.listed(spark, paths)
        tracker = sc.statusTracker()
        stages = [s for job in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(job).stageIds]
        assert stages and max(tracker.getStageInfo(s).numTasks for s in stages) <= 64
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert files.count() == 400
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == "10000"


def test_headers_are_mapped_in_one_pass(spark):
    passes = spark.sparkContext.accumulator(0)

    def work(batches):
        passes.add(1)
        yield pa.RecordBatch.from_pylist([{"file": "a", "headers": ["Object Name", None, "x"], "error": None}, {"file": "a", "headers": ["Object Name", None, "x"], "error": None}, {"file": "b", "headers": None, "error": "e"}, {"file": "c", "headers": [], "error": None}])

    rows = spark.range(1, numPartitions=1).mapInArrow(work, "file string, headers array<string>, error string")
    found = {r["file"]: (r["recognized"], r["unknown"], r["missing"] and len(r["missing"]), r["status"]) for r in workbook.map_headers(rows).collect()}
    assert found == {"a": ({"Object Name": "object_name_raw"}, ["", "x"], 20, "FULL"), "b": (None, None, None, "REJECTED"), "c": (None, None, None, "REJECTED")}
    assert passes.value == 1


def test_files_are_written_from_small_batches(spark, tmp_path):
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []

    class Made:
        def select(self, *columns):
            return self

        def mapInArrow(self, work, schema):
            def sizes(batches):
                for batch in batches:
                    yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

            seen.extend(r["n"] for r in spark.range(1000, numPartitions=1).mapInArrow(sizes, "n long").collect())
            return spark.range(1).select(F.col("id").alias("n"))

    before = spark.conf.get(name)
    readers.written(Inputs(spark, str(tmp_path)), Made())
    assert sum(seen) == 1000 and max(seen) <= 100 and spark.conf.get(name) == before


def test_folders_are_walked_for_the_files_that_spark_lists(spark, tmp_path):
    for name in ("a.txt", "b c%20+d.txt", "x/y/e.txt", "x/.hidden/f.txt", "_g.txt", "_h=1/i.txt", "x/.j", "_metadata", "k._COPYING_", "other/l.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "empty.txt").write_text("")
    root = str(tmp_path)
    for path in (root, f"file://{root}/", [f"{root}/x", f"{root}/other"], [f"{root}/x", f"{root}/a.txt"], f"{root}/*.txt"):
        want = sorted(map(tuple, ranges.listed(spark, path).select("path", "length").collect()))
        assert want and sorted(map(tuple, ranges.named(spark, path).collect())) == want
    seen = {r["path"].rsplit("/", 1)[-1]: r for r in ranges.surveyed(spark, root).collect()}
    for r in ranges.listed(spark, root).withColumn("sha256", F.sha2("content", 256)).collect():
        found = seen[r["path"].rsplit("/", 1)[-1]]
        assert (found["sha256"], bytes(found["head"]), bytes(found["tail"]), found["error"]) == (r["sha256"], bytes(r["content"]), bytes(r["content"]), None)


def test_imports_keep_records_and_lists_of_files_from_the_driver(spark, tmp_path, monkeypatch):
    rule, asked, plans, written = "-" * 20, [], [], adapters.import_batch
    (tmp_path / "in").mkdir()
    (tmp_path / "in/sizing.txt").write_text("\n".join([rule, "| Table  Size |", f"| {rule} |", *(f"| TAB_{n}   1,5 |" for n in range(200)), rule]))
    (tmp_path / "in/a.xml").write_text("<ROOT>\n<PROGRAMS>\n" + "".join(f'<R NAME="P{n}"/>' for n in range(200)) + "</PROGRAMS></ROOT>")

    def planned(*args):
        plans.append(written(*args))
        return plans[-1]

    monkeypatch.setattr(adapters, "import_batch", planned)
    for where in (ranges, adapters):
        monkeypatch.setattr(where, "listed", lambda spark, path, listed=ranges.listed: (asked.append(path), listed(spark, path))[1])
    assert adapters.import_all(spark, str(tmp_path / "in"), str(tmp_path / "out")) == 2
    assert adapters.imported(spark, str(tmp_path / "out")).count() == 400
    assert asked and all(isinstance(path, list) for path in asked)  # the batch's files, not the folder
    for records in plans:  # files are sent to the records, not records to the files
        assert "BuildLeft" not in records._jdf.queryExecution().executedPlan().toString()


def test_files_that_only_spark_reaches_are_surveyed(spark, tmp_path):
    (tmp_path / "a.txt").write_text("sizing")
    (tmp_path / "b.txt").write_text("more than six bytes")
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.surveyed.link./in", f"file://{tmp_path}")
    far, near = (sorted((r["length"], r["sha256"], r["head"], r["tail"]) for r in ranges.surveyed(spark, path).collect()) for path in ("viewfs://surveyed/in", str(tmp_path)))
    assert far == near and len(far) == 2
    assert [bool(r["error"]) for r in ranges.surveyed(spark, "viewfs://surveyed/in", 6).orderBy("path").collect()] == [False, True]
