"""Filters, KPIs, lists and reports: F1-F7, A1-A14, J7, W5-W8, P6, R1-R8."""

from pyspark.sql import functions as F

from estatelens.operators import dashboard as D
from estatelens.operators import reports as R
from estatelens.operators.search import write_text_index
from estatelens.plans.base import Registry
from estatelens.storage import scratch

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
_SCAN = ", current AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY assessment_id ORDER BY completed_at DESC NULLS FIRST, id DESC) AS rn FROM scans WHERE status = 'COMPLETED') WHERE rn = 1)"
_RUN = ", cur AS (SELECT f.* FROM findings f WHERE run_id = 2)"
_OWN = ", own AS (SELECT p.*, a.recommendation, a.technical_risk FROM parts p LEFT JOIN assessments a ON p.application_id = a.application_id)"


@query(_SCAN + " SELECT assessment_id, id, completed_at FROM current", "scans")
def f1_current_scan(i):
    return D.current_scan(i.scans).select("assessment_id", "id", "completed_at")


@query(", r AS (SELECT *, row_number() OVER (PARTITION BY assessment_id ORDER BY completed_at DESC NULLS FIRST, id DESC) AS rn FROM scans) SELECT assessment_id, id FROM r WHERE rn = 1", "scans")
def f2_current_run(i):
    return D.current_atc_run(i.scans.withColumnRenamed("completed_at", "imported_at")).select("assessment_id", "id")


def small_scans(i):
    return i.sql("SELECT id, CAST(1 AS INT) AS assessment_id, 'COMPLETED' AS status, TIMESTAMP '2024-01-01 00:00:00' AS completed_at FROM (SELECT DISTINCT CAST(1 + p_size % 5 % 3 AS BIGINT) AS id FROM part)")


@query("SELECT p.id FROM parts p JOIN files f ON p.source_file_id = f.id WHERE f.scan_id = (SELECT max(scan_id) FROM files)", "parts files")
def f3_current_objects(i):
    return D.current_objects(i.parts, i.files, small_scans(i)).select("id")


@query(_OWN + " SELECT id FROM own WHERE recommendation = 'MODERNIZAR' AND technical_risk IN ('HIGH', 'CRITICAL') AND regexp_matches(upper(object_name), '^[ZY/]') AND object_name ILIKE '%wid%'", "parts assessments")
def f4_filter_objects(i):
    return D.filter_objects(drilldown(i), recommendation="MODERNIZAR", high_impact=True, custom_only=True, q="wid").select("id")


@query(_RUN + " SELECT id FROM cur WHERE priority = 2 AND (check_title ILIKE '%err%' OR check_message ILIKE '%err%' OR object_name ILIKE '%err%')", "findings")
def f5_filter_findings(i):
    return D.filter_findings(i.findings, i.runs, priority=2, q="err").select("id")


@query("SELECT id FROM rules WHERE status <> 'MERGED' AND rule_type = 'user' AND (condition ILIKE '%th%' OR action ILIKE '%th%')", "rules")
def f6_filter_rules(i):
    return D.filter_rules(i.rules, rule_type="user", q="th").select("id")


@query("SELECT DISTINCT a.id, s.recommendation FROM apps a JOIN parts p ON p.application_id = a.id LEFT JOIN assessments s ON s.application_id = a.id WHERE a.status <> 'MERGED' AND s.recommendation IS NULL", "apps parts assessments")
def f7_filter_applications(i):
    return D.filter_applications(i.apps, i.parts, i.assessments, recommendation="UNCLASSIFIED").select("id", "recommendation")


def indexed(i, rows, *columns):
    """A trigram index of the columns, written and read back."""
    folder = scratch(i.spark, "index")
    write_text_index(rows, folder, "id", *columns)
    return i.spark.read.parquet(folder)


@query(_OWN + " SELECT id FROM own WHERE recommendation = 'MODERNIZAR' AND technical_risk IN ('HIGH', 'CRITICAL') AND regexp_matches(upper(object_name), '^[ZY/]') AND object_name ILIKE '%wid%'", "parts assessments")
def f4_filter_indexed_objects(i):
    index = indexed(i, i.parts, "object_name")
    return D.filter_objects(drilldown(i), recommendation="MODERNIZAR", high_impact=True, custom_only=True, q="wid", index=index).select("id")


@query(_RUN + " SELECT id FROM cur WHERE check_title ILIKE '%alue 1_2%' OR check_message ILIKE '%alue 1_2%' OR object_name ILIKE '%alue 1_2%'", "findings")
def f5_filter_indexed_findings(i):
    index = indexed(i, i.findings, "check_title", "check_message", "object_name")
    return D.filter_findings(i.findings, i.runs, q="alue 1_2", index=index).select("id")


@query("SELECT id FROM rules WHERE status <> 'MERGED' AND (condition ILIKE '% the %' OR action ILIKE '% the %')", "rules")
def f6_filter_indexed_rules(i):
    return D.filter_rules(i.rules, q=" the ", index=indexed(i, i.rules, "condition", "action")).select("id")


@query("SELECT DISTINCT a.id, s.recommendation FROM apps a JOIN parts p ON p.application_id = a.id LEFT JOIN assessments s ON s.application_id = a.id WHERE a.status <> 'MERGED' AND a.description ILIKE '%brand#1%'", "apps parts assessments")
def f7_filter_indexed_applications(i):
    return D.filter_applications(i.apps, i.parts, i.assessments, q="Brand#1", index=indexed(i, i.apps, "name", "domain", "description")).select("id", "recommendation")


@query("SELECT assessment_id, object_type, count(*) AS n FROM parts GROUP BY 1, 2", "parts")
def a2_objects_by_type(i):
    return D.objects_by_type(i.parts)


@query("SELECT assessment_id, count(*) AS objects_total, count(*) FILTER (WHERE regexp_matches(upper(object_name), '^[ZY/]')) AS objects_custom FROM parts GROUP BY 1", "parts")
def a2_count_custom(i):
    return D.count_custom(i.parts)


@query(_OWN + " SELECT assessment_id, coalesce(recommendation, 'UNCLASSIFIED') AS recommendation, count(*) AS n FROM own GROUP BY 1, 2", "parts assessments")
def a3_clean_core_objects(i):
    return D.clean_core_objects(i.parts, i.assessments)


@query("SELECT a.assessment_id, coalesce(s.recommendation, 'UNCLASSIFIED') AS recommendation, count(*) AS n FROM apps a LEFT JOIN assessments s ON s.application_id = a.id WHERE a.status <> 'MERGED' GROUP BY 1, 2", "apps assessments")
def a4_clean_core_applications(i):
    return D.clean_core_applications(i.apps, i.assessments)


@query(_RUN + " SELECT assessment_id, coalesce(CAST(priority AS VARCHAR), 'none') AS priority, count(*) AS n FROM cur GROUP BY 1, 2", "findings")
def a5_atc_by_priority(i):
    return D.atc_by_priority(i.findings, i.runs)


@query(_RUN + " SELECT target_id AS object_id, count(*) AS n_findings FROM cur WHERE target_id IS NOT NULL GROUP BY 1", "findings")
def a9_findings_per_object(i):
    return D.findings_per_object(i.findings, i.runs)


@query("SELECT p.application_id, f.priority, count(*) AS n FROM findings f JOIN parts p ON f.target_id = p.id WHERE p.application_id IS NOT NULL GROUP BY 1, 2", "findings parts")
def a11_priority_totals(i):
    return D.priority_totals(i.findings, i.parts)


@query("SELECT scan_id, category, count(*) AS n FROM files GROUP BY 1, 2", "files")
def a10_category_counts(i):
    return D.category_counts(i.files)


@query(""", ranked AS (SELECT application_id, object_name, row_number() OVER (PARTITION BY application_id ORDER BY object_name, id) AS rn FROM parts WHERE application_id IS NOT NULL)
SELECT application_id, count(*) AS n_members, string_agg(object_name, ',' ORDER BY rn) FILTER (WHERE rn <= 40) AS members, greatest(count(*) - 40, 0) AS n_more FROM ranked GROUP BY 1""", "parts")
def a12_application_members(i):
    return D.application_members(i.apps, i.parts).withColumn("members", F.array_join("members", ","))


@query("SELECT DISTINCT check_title FROM findings WHERE check_title <> ''", "findings")
def a14_check_catalog(i):
    return D.check_catalog(i.findings)


@query(_OWN + """, g AS (SELECT assessment_id, concat_ws(' — ', coalesce(b.name, '-'), coalesce(recommendation, 'UNCLASSIFIED')) AS label, object_name, o.id FROM own o LEFT JOIN (SELECT id, name FROM apps) b ON b.id = o.application_id),
r AS (SELECT *, row_number() OVER (PARTITION BY assessment_id, label ORDER BY object_name, id) AS rn FROM g)
SELECT assessment_id, 'group' AS kind, label, count(*) AS n, string_agg(object_name, ',' ORDER BY rn) FILTER (WHERE rn <= 15) AS names FROM r GROUP BY 1, 3""", "parts assessments apps")
def a13_object_catalog(i):
    return D.object_catalog(drilldown(i), full_limit=0).drop("entity_id").withColumn("names", F.array_join("names", ","))


@query(_OWN + """, g AS (SELECT assessment_id, concat_ws(' — ', coalesce(b.name, '-'), coalesce(recommendation, 'UNCLASSIFIED')) AS label, object_name, o.id FROM own o LEFT JOIN (SELECT id, name FROM apps) b ON b.id = o.application_id),
r AS (SELECT *, row_number() OVER (PARTITION BY assessment_id, label ORDER BY object_name, id) AS rn, count(*) OVER (PARTITION BY assessment_id) AS size FROM g)
SELECT assessment_id, 'group' AS kind, label, count(*) AS n, string_agg(object_name, ',' ORDER BY rn) FILTER (WHERE rn <= 15) AS names, CAST(NULL AS BIGINT) AS entity_id FROM r WHERE size > 666 GROUP BY 1, 3
UNION ALL SELECT assessment_id, 'object', object_name, 1, object_name, id FROM r WHERE size <= 666""", "parts assessments apps")
def a13_object_catalog_full(i):
    """Assessments of at most 666 objects object by object, the others in groups."""
    return D.object_catalog(drilldown(i), full_limit=666).withColumn("names", F.array_join("names", ","))


def drilldown(i):
    usage = i.sql("SELECT l_partkey AS object_id, CASE WHEN l_returnflag = 'R' THEN 'Unused' ELSE 'Normally Used' END AS usage_level FROM lineitem")
    return D.object_drilldown(i.parts, i.apps, i.assessments, i.findings, usage, runs=i.runs)


@query(_RUN + _OWN + """, u AS (SELECT l_partkey AS id, max(CASE WHEN l_returnflag = 'R' THEN 'Unused' ELSE 'Normally Used' END) AS usage_level FROM lineitem GROUP BY 1)
SELECT o.id, regexp_matches(upper(o.object_name), '^[ZY/]') AS is_custom, b.name AS application_name, o.recommendation, o.technical_risk, coalesce(c.n, 0) AS n_findings, u.usage_level
FROM own o LEFT JOIN (SELECT id, name FROM apps) b ON b.id = o.application_id LEFT JOIN (SELECT target_id, count(*) AS n FROM cur GROUP BY 1) c ON c.target_id = o.id LEFT JOIN u ON u.id = o.id""", "findings parts assessments apps")
def j7_object_drilldown(i):
    return drilldown(i).select("id", "is_custom", "application_name", "recommendation", "technical_risk", "n_findings", "usage_level")


@query("""SELECT p.assessment_id, count(DISTINCT p.id) AS n FROM parts p JOIN lineitem l ON l.l_partkey = p.id WHERE l.l_returnflag = 'R' AND regexp_matches(upper(p.object_name), '^[ZY/]') GROUP BY 1""", "parts")
def a7_unused_custom(i):
    usage = i.sql("SELECT l_partkey AS object_id, CASE WHEN l_returnflag = 'R' THEN 'Unused' ELSE 'Normally Used' END AS usage_level FROM lineitem")
    return D.unused_custom(usage, i.parts)


_SUMMARY = """SELECT 1 AS assessment_id,
  (SELECT count(*) FROM parts p JOIN files f ON p.source_file_id = f.id WHERE f.scan_id = (SELECT max(scan_id) FROM files)) AS objects_analyzed,
  (SELECT count(*) FROM apps WHERE status <> 'MERGED') AS customizations_identified, (SELECT count(*) FROM findings WHERE priority = 1) AS critical_findings,
  (SELECT count(*) FROM parts p JOIN files f ON p.source_file_id = f.id JOIN assessments a ON a.application_id = p.application_id WHERE f.scan_id = (SELECT max(scan_id) FROM files) AND a.technical_risk IN ('HIGH', 'CRITICAL')) AS high_impact_objects,
  (SELECT count(*) FROM rules WHERE status = 'CANDIDATE') AS business_rules_identified, false AS is_stale"""


@query(_SUMMARY, "parts files apps findings assessments rules")
def a1_dashboard_summary(i):
    return summary(i)


def summary(i):
    objects = i.parts.withColumn("assessment_id", F.lit(1))
    scans = small_scans(i)
    runs = scans.select(F.col("id"), F.col("id").alias("source_scan_id"), F.lit("source_processing").alias("kind"))
    stages = runs.select(F.col("id").alias("run_id"), F.lit("COMPLETED").alias("status"), F.explode(F.array(F.lit("parse"), F.lit("detect_dependencies"))).alias("stage_name"))
    return D.dashboard_summary(scans, i.files, objects, i.apps, i.assessments, D.derive_technical_findings(i.findings), i.rules, runs, stages)


@query(", c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY assessment_id ORDER BY completed_at DESC NULLS FIRST, id DESC) AS rn FROM scans WHERE status = 'COMPLETED') WHERE rn = 1) SELECT assessment_id, id AS scan_id, id % 3 = 0 AS is_processed, id % 3 <> 0 AS is_stale FROM c", "scans")
def a15_processing_status(i):
    runs = i.scans.select(F.col("id"), F.col("id").alias("source_scan_id"), F.lit("source_processing").alias("kind"))
    names = F.when(F.col("id") % 3 == 0, F.array(F.lit("parse"), F.lit("detect_dependencies"))).otherwise(F.array(F.lit("parse")))
    stages = runs.select(F.col("id").alias("run_id"), F.lit("COMPLETED").alias("status"), F.explode(names).alias("stage_name"))
    return D.processing_status(i.scans, runs, stages).select("assessment_id", "scan_id", "is_processed", "is_stale")


@query("SELECT id AS atc_finding_id, CASE priority WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'LOW' ELSE 'INFO' END AS severity, check_title AS finding_type, concat_ws(': ', check_title, check_message) AS title, target_id AS sap_object_id FROM findings", "findings")
def p6_technical_findings(i):
    return D.derive_technical_findings(i.findings).select("atc_finding_id", "severity", "finding_type", "title", "sap_object_id")


@query(_RUN + ", c AS (SELECT assessment_id, check_title, count(*) AS n FROM cur GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY assessment_id ORDER BY n DESC, check_title) AS rn FROM c) SELECT assessment_id, check_title, n FROM r WHERE rn <= 10", "findings")
def w5_top_checks(i):
    return D.top_checks(i.findings, i.runs)


@query("SELECT id AS atc_finding_id FROM findings WHERE priority = 1 ORDER BY id DESC LIMIT 5", "findings")
def w6_critical_sample(i):
    return D.critical_sample(D.derive_technical_findings(i.findings).withColumn("id", F.col("atc_finding_id"))).select("atc_finding_id")


@query("SELECT id, priority FROM findings ORDER BY priority ASC NULLS LAST, source_row_number, id LIMIT 50 OFFSET 100", "findings")
def w7_findings_page(i):
    return D.page(i.findings, D.findings_order(), offset=100).select("id", "priority")


@query("SELECT id, priority FROM findings ORDER BY priority ASC NULLS LAST, source_row_number, id LIMIT 50 OFFSET 100", "findings")
def w7_findings_after(i):
    """The third page, found from the last row of the second one."""
    last = None
    for _ in range(2):
        rows = D.findings_after(i.findings, last).select("priority", "source_row_number", "id").collect()
        last = tuple(rows[-1])
    return D.findings_after(i.findings, last).select("id", "priority")


@query("SELECT id FROM rules ORDER BY confidence DESC, id LIMIT 40", "rules")
def w8_rules_page(i):
    return D.page(i.rules, D.rules_order(), limit=40).select("id")


@query("SELECT assessment_id, referenced_object_name, count(*) AS n, count(DISTINCT target_id) AS n_objects FROM findings GROUP BY 1, 2", "findings")
def r2_findings_by_object(i):
    return R.findings_by(i.findings, "referenced_object_name")


@query("SELECT assessment_id, referenced_object_name, count(*) FILTER (WHERE change_category = 'A') AS \"A\", count(*) FILTER (WHERE change_category = 'T') AS \"T\", count(*) FILTER (WHERE change_category = 'F') AS \"F\" FROM findings GROUP BY 1, 2", "findings")
def r5_findings_by_change(i):
    return R.findings_by_change(i.findings)


@query("SELECT object_name, check_title, priority, count(*) FILTER (WHERE run_id = 1) AS n_before, count(*) FILTER (WHERE run_id = 2) AS n_after, count(*) FILTER (WHERE run_id = 2) - count(*) FILTER (WHERE run_id = 1) AS delta FROM findings GROUP BY 1, 2, 3", "findings")
def r6_run_delta(i):
    return R.run_delta(i.findings, 1, 2)


@query("SELECT DISTINCT assessment_id, target_id AS object_id FROM findings WHERE check_title IN ('error', 'purchase') AND target_id IS NOT NULL", "findings")
def r7_objects_with_checks(i):
    return R.objects_with_checks(i.findings, ["error", "purchase"])


@query("SELECT assessment_id, target_id AS object_id, count(*) AS n FROM findings WHERE priority = 1 AND change_category = 'F' AND target_id IS NOT NULL GROUP BY 1, 2", "findings")
def r8_upgrade_risk(i):
    return R.upgrade_risk(i.findings, "F")


@query(_RUN + """, own1 AS (SELECT 1 AS assessment_id, p.id, p.object_name, p.application_id, a.recommendation, b.name FROM parts p LEFT JOIN assessments a ON p.application_id = a.application_id LEFT JOIN (SELECT id, name FROM apps) b ON b.id = p.application_id),
m AS (SELECT application_id, object_name, row_number() OVER (PARTITION BY application_id ORDER BY object_name, id) AS rn FROM own1 WHERE application_id IS NOT NULL),
g AS (SELECT concat_ws(' — ', coalesce(name, '-'), coalesce(recommendation, 'UNCLASSIFIED')) AS label, object_name, id FROM own1),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY object_name, id) AS rn FROM g)
SELECT 'SUMMARY' AS ref_id, 'DASHBOARD' AS source_type, CAST(NULL AS BIGINT) AS entity_id, concat_ws(', ', concat('objects_analyzed=', objects_analyzed), concat('customizations_identified=', customizations_identified), concat('critical_findings=', critical_findings), concat('high_impact_objects=', high_impact_objects), concat('business_rules_identified=', business_rules_identified), 'is_stale=false') AS summary FROM (""" + _SUMMARY + """)
UNION ALL SELECT concat('CATEGORY-', coalesce(recommendation, 'UNCLASSIFIED')), 'CATEGORY', NULL, concat(coalesce(recommendation, 'UNCLASSIFIED'), ': ', CAST(count(*) AS VARCHAR)) FROM own1 GROUP BY recommendation
UNION ALL SELECT 'ATC', 'ATC_SUMMARY', NULL, string_agg(concat(p, '=', CAST(n AS VARCHAR)), ', ' ORDER BY p) FROM (SELECT coalesce(CAST(priority AS VARCHAR), 'none') AS p, count(*) AS n FROM cur GROUP BY 1)
UNION ALL SELECT concat('APP-', a.id), 'APPLICATION', a.id, concat_ws(' | ', a.name, max(x.names), CASE WHEN max(x.n) > 40 THEN concat('+', max(x.n) - 40) END) FROM apps a LEFT JOIN (SELECT application_id, count(*) AS n, string_agg(object_name, ', ' ORDER BY rn) FILTER (WHERE rn <= 40) AS names FROM m GROUP BY 1) x ON x.application_id = a.id WHERE a.status <> 'MERGED' GROUP BY a.id, a.name
UNION ALL SELECT concat('TF-', CAST(id AS VARCHAR)), 'TECHNICAL_FINDING', id, concat_ws(': ', check_title, check_message) FROM (SELECT * FROM findings WHERE priority = 1 ORDER BY id DESC LIMIT 5)
UNION ALL SELECT concat('OBJECT-', id), 'OBJECT_LIST', id, object_name FROM own1 WHERE (SELECT count(*) FROM own1) <= 1500
UNION ALL SELECT concat('GROUP-', label), 'OBJECT_LIST', NULL, concat(label, ': ', string_agg(object_name, ', ' ORDER BY rn) FILTER (WHERE rn <= 15), ' of ', count(*)) FROM r WHERE (SELECT count(*) FROM own1) > 1500 GROUP BY label""", "findings parts assessments apps files rules")
def a16_assessment_catalog(i):
    rows = drilldown(i).withColumn("assessment_id", F.lit(1))
    technical = D.derive_technical_findings(i.findings).withColumn("id", F.col("atc_finding_id"))
    return D.assessment_catalog(summary(i), rows, i.apps, i.findings, i.runs, technical).select("ref_id", "source_type", "entity_id", "summary")


@query("SELECT s_suppkey AS id, n_name AS client_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey WHERE s_nationkey = 3 OR s_name ILIKE '%07%'")
def f10_list_assessments(i):
    own = i.table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("client_id"), F.col("s_name").alias("name"))
    clients = i.table("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    found = D.list_assessments(own, clients, client_id=3).unionByName(D.list_assessments(own, clients, name="07").where("client_id <> 3"))
    return found.select("id", "client_name")


@query("SELECT p_partkey AS id, p_size % 4 AS scan_id FROM part WHERE p_size % 4 = 2")
def f10_list_files(i):
    files = i.table("part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 4).alias("scan_id"), F.col("p_name").alias("rel_path"))
    return D.list_files(files, 2).select("id", "scan_id")


@query("SELECT l_orderkey AS id, l_linenumber, l_shipdate FROM lineitem WHERE l_partkey = 7")
def f10_object_dependencies(i):
    deps = i.table("lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_shipdate", F.col("l_partkey").alias("source_object_id"), F.col("l_returnflag").alias("dep_type"), F.col("l_linestatus").alias("target_name"))
    return D.object_dependencies(deps, 7).select("id", "l_linenumber", "l_shipdate")


@query("""SELECT 'member' AS kind, id FROM parts WHERE application_id = 11
UNION ALL SELECT 'rule', r.id FROM rules r WHERE r.status = 'CANDIDATE' AND r.sap_object_id IN (SELECT id FROM parts WHERE application_id = 11)
UNION ALL SELECT 'finding', f.id FROM findings f WHERE f.target_id IN (SELECT id FROM parts WHERE application_id = 11)""", "parts rules findings")
def j9_application_detail(i):
    found = D.application_detail(11, i.parts, i.rules, i.findings)
    out = None
    for kind, rows in (("member", found["members"]), ("rule", found["rules"]), ("finding", found["findings"])):
        part = rows.select(F.lit(kind).alias("kind"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT user_id, CASE WHEN bad > 0 THEN 'FAILED' WHEN caps > 0 AND rows > 0 AND warned = 0 THEN 'FULL' ELSE 'PARTIAL' END AS status, warned + CASE WHEN bad = 0 AND caps > 0 AND rows = 0 THEN 1 ELSE 0 END AS n_warnings
FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'error' AND event_id % 50 = 0) AS bad, count(DISTINCT event_type) AS caps, count(*) FILTER (WHERE event_id % 7 = 0) AS rows, CASE WHEN min(event_id) % 3 = 0 THEN 1 ELSE 0 END AS warned FROM events GROUP BY 1)""")
def p13_dataset_status(i):
    counted = i.table("events").groupBy("user_id").agg(
        F.count_if((F.col("event_type") == "error") & (F.col("event_id") % 50 == 0)).alias("bad"), F.count_distinct("event_type").alias("n_capabilities"), F.count_if(F.col("event_id") % 7 == 0).alias("n_rows"), (F.min("event_id") % 3 == 0).alias("warned"),
    )
    none = F.array().cast("array<string>")
    manifest = counted.select("user_id", F.when(F.col("bad") > 0, "broken").alias("error"), "n_capabilities", "n_rows", F.when(F.col("warned"), F.array(F.lit("odd"))).otherwise(none).alias("warnings"))
    return D.dataset_status(manifest).select("user_id", "status", F.size("warnings").alias("n_warnings"))


_BY = "SELECT assessment_id, {c}, count(*) AS n, count(DISTINCT target_id) AS n_objects FROM (SELECT *, concat('NOTE', id % 21) AS sap_note_number, concat('P', id % 8) AS package_name, CASE WHEN id % 6 = 0 THEN NULL ELSE check_title END AS component FROM findings) GROUP BY 1, 2"


def noted(i):
    return i.findings.withColumns({"sap_note_number": F.concat(F.lit("NOTE"), (F.col("id") % 21).cast("string")), "package_name": F.concat(F.lit("P"), (F.col("id") % 8).cast("string")), "component": F.when(F.col("id") % 6 != 0, F.col("check_title"))})


@query(_BY.format(c="sap_note_number"), "findings")
def r1_findings_by_note(i):
    return R.findings_by(noted(i), "sap_note_number")


@query(_BY.format(c="package_name"), "findings")
def r3_findings_by_package(i):
    return R.findings_by(noted(i), "package_name")


@query(_BY.format(c="component"), "findings")
def r4_findings_by_component(i):
    return R.findings_by(noted(i), "component")


@query("SELECT DISTINCT l_suppkey AS source_object_id, l_returnflag AS dep_type FROM lineitem WHERE l_partkey % 100 = 42")
def r10_users_of(i):
    deps = i.table("lineitem").select(F.lit(1).alias("assessment_id"), F.col("l_suppkey").alias("source_object_id"), F.concat(F.lit("Tab"), (F.col("l_partkey") % 100).cast("string")).alias("target_name"), F.col("l_returnflag").alias("dep_type"))
    return R.users_of(deps, "tab42").select("source_object_id", "dep_type")
