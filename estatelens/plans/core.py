"""Correlation: J1-J5, J7, J8, J10, F8, F9 and the flagship query."""

from pyspark.sql import functions as F

from estatelens.operators import correlate as C
from estatelens.operators import dashboard as D
from estatelens.plans.base import Inputs, Registry

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

_MATCH = """, exact AS (SELECT assessment_id, upper(object_name) AS n, upper(object_type) AS t, count(*) AS c, min(id) AS target FROM objects GROUP BY 1, 2, 3),
named AS (SELECT assessment_id, upper(object_name) AS n, count(*) AS c, min(id) AS target FROM objects GROUP BY 1, 2),
keyed AS (SELECT r.*, nullif(upper(trim(object_name)), '') AS n, nullif(upper(trim(object_type)), '') AS t FROM records r),
matched AS (
  SELECT k.id, k.dataset_id, k.capability, k.usage_level, k.assessment_id,
         CASE WHEN k.n IS NULL THEN '{empty}' WHEN e.c = 1 THEN 'MATCHED_EXACT' WHEN e.c > 1 THEN 'AMBIGUOUS' WHEN m.c = 1 THEN 'MATCHED_HEURISTIC' WHEN m.c > 1 THEN 'AMBIGUOUS' ELSE 'UNMATCHED' END AS status,
         CASE WHEN e.c = 1 THEN e.target WHEN e.c IS NULL AND m.c = 1 THEN m.target END AS target_id,
         CASE WHEN k.n IS NULL THEN 'no_object_identity' WHEN e.c IS NOT NULL THEN 'object_name_type_exact' ELSE 'object_name_only' END AS method
  FROM keyed k LEFT JOIN exact e ON k.assessment_id = e.assessment_id AND k.n = e.n AND k.t = e.t LEFT JOIN named m ON k.assessment_id = m.assessment_id AND k.n = m.n)
"""
EVIDENCE_SQL = _EVIDENCE = _MATCH.replace("{empty}", "NOT_APPLICABLE")
_FINDING = _MATCH.replace("{empty}", "UNMATCHED")


def matched(i: Inputs):
    return C.correlate(i.records, i.objects)


@query(_EVIDENCE + "SELECT id, dataset_id, target_id, status, method FROM matched", "objects records")
def j1_correlate(i):
    return matched(i).select("id", "dataset_id", "target_id", "status", "method")


@query(_FINDING + "SELECT id, target_id, status FROM matched", "objects records")
def j2_correlate_findings(i):
    return C.correlate_findings(i.records, i.objects).select("id", "target_id", "status")


def earlier_objects(i: Inputs):
    """Other objects than now: some missing, some renamed, some more."""
    kept = i.objects.where("id % 7 <> 3").withColumn("object_name", F.when(F.col("id") % 11 == 5, F.concat("object_name", F.lit(" old"))).otherwise(F.col("object_name")))
    return kept.unionByName(i.objects.where("id % 13 = 2").withColumn("id", F.col("id") + 5_000_000))


@query(_EVIDENCE + "SELECT id, dataset_id, target_id, status, method FROM matched", "objects records")
def j1_update_correlations(i):
    """The correlations after a change of objects and with new records, from those before."""
    old = C.correlate(i.records.where("line % 5 <> 0"), earlier_objects(i))
    return C.update_correlations(old, i.records.where("line % 5 = 0"), earlier_objects(i), i.objects).select("id", "dataset_id", "target_id", "status", "method")


@query(_FINDING + """, before AS (SELECT id, CASE WHEN id % 11 = 5 THEN concat(object_name, ' old') ELSE object_name END AS object_name, object_type, assessment_id FROM objects WHERE id % 7 <> 3 UNION ALL SELECT id + 5000000, object_name, object_type, assessment_id FROM objects WHERE id % 13 = 2),
e0 AS (SELECT assessment_id, upper(object_name) AS n, upper(object_type) AS t, count(*) AS c, min(id) AS target FROM before GROUP BY 1, 2, 3), m0 AS (SELECT assessment_id, upper(object_name) AS n, count(*) AS c, min(id) AS target FROM before GROUP BY 1, 2),
old AS (SELECT k.id, CASE WHEN k.n IS NULL THEN 'UNMATCHED' WHEN e.c = 1 THEN 'MATCHED_EXACT' WHEN e.c > 1 THEN 'AMBIGUOUS' WHEN m.c = 1 THEN 'MATCHED_HEURISTIC' WHEN m.c > 1 THEN 'AMBIGUOUS' ELSE 'UNMATCHED' END AS status,
  CASE WHEN e.c = 1 THEN e.target WHEN e.c IS NULL AND m.c = 1 THEN m.target END AS target_id FROM keyed k LEFT JOIN e0 e ON k.assessment_id = e.assessment_id AND k.n = e.n AND k.t = e.t LEFT JOIN m0 m ON k.assessment_id = m.assessment_id AND k.n = m.n)
SELECT a.id, a.target_id, a.status FROM matched a JOIN old o ON o.id = a.id WHERE NOT (a.status IS NOT DISTINCT FROM o.status AND a.target_id IS NOT DISTINCT FROM o.target_id)""", "objects records")
def j3_recorrelate_names(i):
    old = C.correlate_findings(i.records, earlier_objects(i))
    return C.recorrelate_names(old, earlier_objects(i), i.objects).select("id", "target_id", "status")


@query(_FINDING + "SELECT id, target_id, status FROM matched WHERE id % 4 <> 0 AND NOT (status IS NOT DISTINCT FROM 'UNMATCHED' AND target_id IS NULL)", "objects records")
def j3_recorrelate(i):
    new = C.correlate_findings(i.records, i.objects)
    old = new.withColumns({"status": F.when(F.col("id") % 4 == 0, F.col("status")).otherwise("UNMATCHED"), "target_id": F.when(F.col("id") % 4 == 0, F.col("target_id"))})
    return C.recorrelate(old, i.objects).select("id", "target_id", "status")


@query(_FINDING + "SELECT id, CASE WHEN id % 3 = 0 THEN target_id ELSE -1 END AS sap_object_id FROM matched", "objects records")
def j4_propagate_targets(i):
    changed = C.correlate_findings(i.records, i.objects).where("id % 3 = 0").select("id", "target_id")
    technical = i.records.select("id", F.col("id").alias("atc_finding_id"), F.lit(-1).cast("long").alias("sap_object_id"))
    return C.propagate_targets(technical, changed).select("id", "sap_object_id")


@query(_EVIDENCE + """, statuses AS (SELECT unnest(['MATCHED_EXACT', 'MATCHED_HEURISTIC', 'UNMATCHED', 'AMBIGUOUS', 'NOT_APPLICABLE']) AS status)
SELECT d.dataset_id, s.status, count(m.id) AS n FROM (SELECT DISTINCT dataset_id FROM matched) d CROSS JOIN statuses s LEFT JOIN matched m ON m.dataset_id = d.dataset_id AND m.status = s.status GROUP BY 1, 2""", "objects records")
def j5_correlation_summary(i):
    return C.correlation_summary(matched(i), "dataset_id", zero_fill=True)


@query(_EVIDENCE + "SELECT m.id AS record_id, m.target_id, m.status, m.method, m.dataset_id, concat('set ', CAST(m.dataset_id AS VARCHAR)) AS dataset_name FROM matched m WHERE target_id IS NOT NULL", "objects records")
def j8_object_evidence(i):
    records = i.records.withColumn("record_type", F.lit("row"))
    datasets = records.select(F.col("dataset_id").alias("id"), F.concat(F.lit("set "), F.col("dataset_id").cast("string")).alias("name")).distinct()
    found = C.object_evidence(matched(i).withColumnRenamed("id", "record_id"), records, datasets)
    return found.select("record_id", "target_id", "status", "method", "dataset_id", "dataset_name")


@query("SELECT d.dataset_id, d.id AS detail_id, p.id AS issue_id FROM (SELECT * FROM records WHERE line = 2) d JOIN (SELECT * FROM records WHERE line = 1) p ON d.dataset_id = p.dataset_id AND d.order_id = p.order_id", "records")
def j10_details_to_parent(i):
    rows = i.records.select("dataset_id", "id", "line", F.create_map(F.lit("DETAILS_REF"), F.col("order_id").cast("string")).alias("payload"))
    return C.details_to_parent(rows.where("line = 2"), rows.where("line = 1")).select("dataset_id", "detail_id", "issue_id")


@query(_EVIDENCE + "SELECT usage_level, count(DISTINCT target_id) AS n FROM matched WHERE capability = 'USAGE_SIGNAL' AND usage_level IS NOT NULL AND status LIKE 'MATCHED%' GROUP BY 1", "objects records")
def a6_usage_by_level(i):
    return D.usage_by_level(usage(i), i.objects).select("usage_level", "n")


@query(_EVIDENCE + "SELECT target_id AS object_id, max(usage_level) AS usage_level FROM matched WHERE capability = 'USAGE_SIGNAL' AND usage_level IS NOT NULL AND status LIKE 'MATCHED%' GROUP BY 1", "objects records")
def a8_usage_level_per_object(i):
    return D.usage_level_per_object(usage(i))


@query(_EVIDENCE + "SELECT target_id AS object_id, usage_level FROM matched WHERE capability = 'USAGE_SIGNAL' AND usage_level IS NOT NULL AND status LIKE 'MATCHED%'", "objects records")
def f9_usage_rows(i):
    return usage(i)


@query(_EVIDENCE + "SELECT id, status FROM matched WHERE status LIKE 'MATCHED%'", "objects records")
def f8_matched_only(i):
    return D.matched_only(matched(i)).select("id", "status")


def usage(i: Inputs):
    records = i.records.withColumn("payload", F.when(F.col("usage_level").isNotNull(), F.create_map(F.lit("USAGE LEVEL"), "usage_level")).otherwise(F.create_map(F.lit("X"), F.lit("y"))))
    return D.usage_rows(matched(i).withColumnRenamed("id", "record_id"), records)
