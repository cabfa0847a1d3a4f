"""Evidence packages, references and validation: W1, W3, J11, V3-V9, U10."""

from pyspark.sql import functions as F

from estatelens.operators import dashboard as D
from estatelens.operators import evidence as E
from estatelens.operators import validate as V
from estatelens.operators import vectors
from estatelens.plans.base import Registry
from estatelens.plans.core import EVIDENCE_SQL as _EVIDENCE
from estatelens.plans.core import matched

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
_ITEMS = """WITH items AS (SELECT l_suppkey AS application_id, CASE WHEN l_linenumber % 2 = 0 THEN 'ATC' ELSE 'DEP' END AS pool,
  CASE WHEN l_linenumber % 2 = 0 THEN CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 99 END ELSE 0 END AS severity_rank, l_orderkey * 10 + l_linenumber AS entity_id FROM lineitem)"""


def items(i):
    rows = i.sql("SELECT l_suppkey AS application_id, CASE WHEN l_linenumber % 2 = 0 THEN 'ATC' ELSE 'DEP' END AS pool, CASE l_returnflag WHEN 'A' THEN '1' WHEN 'R' THEN '2' ELSE NULL END AS severity, l_orderkey * 10 + l_linenumber AS entity_id, l_partkey, l_quantity FROM lineitem")
    return rows.withColumn("severity_rank", E.severity_rank(F.col("pool"), F.col("severity")))


@query(_ITEMS + ", r AS (SELECT *, row_number() OVER (PARTITION BY application_id, pool ORDER BY severity_rank, entity_id) AS rn FROM items) SELECT application_id, pool, entity_id, CAST(rn AS INT) AS rank FROM r WHERE rn <= CASE pool WHEN 'ATC' THEN 8 ELSE 5 END")
def w1_bounded_evidence(i):
    return E.bounded_evidence(items(i).drop("l_partkey", "l_quantity"), {"ATC": 8, "DEP": 5})[0].select("application_id", "pool", "entity_id", "rank")


@query(_ITEMS + " SELECT application_id, pool, count(*) AS total, greatest(count(*) - CASE pool WHEN 'ATC' THEN 8 ELSE 5 END, 0) AS omitted FROM items GROUP BY 1, 2")
def w1_omitted(i):
    return E.bounded_evidence(items(i), {"ATC": 8, "DEP": 5})[1]


@query(", r AS (SELECT *, row_number() OVER (PARTITION BY sap_object_id ORDER BY id) AS rn FROM rules WHERE status = 'CANDIDATE') SELECT id, sap_object_id FROM r WHERE rn <= 3", "rules")
def w3_first_rules(i):
    return E.first_rules(i.rules).select("id", "sap_object_id")


@query("SELECT id, CASE capability WHEN 'USAGE_SIGNAL' THEN 'PROCESS_USAGE_EVIDENCE' WHEN 'PROCESS_KPI' THEN 'PROCESS_USAGE_EVIDENCE' ELSE 'SUPPLEMENTAL_EVIDENCE' END AS pool FROM records WHERE capability <> 'OTHER'", "records")
def v8_split_pools(i):
    return E.split_pools(i.records).select("id", "pool")


@query(_ITEMS + ", r AS (SELECT *, row_number() OVER (PARTITION BY severity_rank, application_id ORDER BY entity_id) AS rn FROM items) SELECT application_id, severity_rank, entity_id FROM r WHERE rn = 1")
def u10_dedupe_context(i):
    rows = items(i).withColumns({"ref_id": F.concat_ws("-", "application_id", "severity_rank"), "source_order": F.col("entity_id")})
    return E.dedupe_context(rows).select("application_id", "severity_rank", "entity_id")


def cited(i):
    rows = i.cited.withColumn("ref_id", F.col("ref_id"))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("pos", "ref_id")))), lambda x: x["ref_id"])
    return rows.groupBy("id").agg(listed(F.lit(True)).alias("refs"), F.array_distinct(listed(F.col("known"))).alias("known_refs"), F.max("l_returnflag").alias("flag"), F.count(F.lit(1)).alias("n"))


@query("SELECT id, coalesce(string_agg(ref_id, ',' ORDER BY pos) FILTER (WHERE known), '') AS refs FROM cited GROUP BY 1", "cited")
def j11_resolve_refs(i):
    rows = cited(i)
    package = rows.select("id", F.explode("known_refs").alias("ref_id")).withColumns({"source_type": F.lit("E"), "entity_id": F.lit(1).cast("long")})
    return E.resolve_refs(rows, package).select("id", F.array_join(F.transform("evidence_refs", lambda r: r["ref_id"]), ",").alias("refs"))


@query(""", g AS (SELECT id, coalesce(string_agg(DISTINCT ref_id, ',' ORDER BY ref_id) FILTER (WHERE NOT known), '') AS unknown, max(l_returnflag) AS flag FROM cited GROUP BY 1)
SELECT id, concat_ws(';', CASE WHEN unknown <> '' THEN concat('unknown refs: ', unknown) END, CASE WHEN flag = 'N' THEN 'summary must not be empty' END) AS errors FROM g""", "cited")
def v4_validate_refs(i):
    rows = cited(i).withColumnsRenamed({"refs": "evidence_refs"}).withColumns({"summary": F.when(F.col("flag") == "N", " ").otherwise("x"), "status": F.lit("COMPLETED")})
    return V.validate_refs(rows, ["summary"]).select("id", F.array_join("errors", ";").alias("errors"))


def assessment(i):
    none = F.array().cast("array<string>")
    rows = cited(i)
    return rows.select(
        "id", F.when(F.col("n") > 2, "HIGH").alias("technical_risk"), F.lit("why").alias("technical_risk_rationale"), F.col("refs").alias("technical_risk_evidence_refs"),
        F.lit(None).cast("string").alias("business_importance"), F.lit("").alias("business_importance_rationale"), none.alias("business_importance_evidence_refs"),
        F.when(F.col("flag") == "R", "MODERNIZAR").alias("recommendation"), F.lit("so").alias("recommendation_rationale"), F.col("refs").alias("recommendation_evidence_refs"),
        F.col("known_refs").alias("technical_refs"), none.alias("business_refs"), none.alias("guidance_refs"), F.lit("COMPLETED").alias("status"),
    )


@query(""", g AS (SELECT id, count(*) AS n, count(*) FILTER (WHERE known) AS k, max(l_returnflag) AS flag FROM cited GROUP BY 1)
SELECT id, CASE WHEN n > 2 AND k > 0 THEN 'HIGH' END AS technical_risk, CASE WHEN n > 2 AND k > 0 THEN 'why' ELSE '' END AS technical_risk_rationale, CASE WHEN flag = 'R' AND k > 0 THEN 'MODERNIZAR' END AS recommendation,
CASE WHEN k > 0 AND (n > 2 OR flag = 'R') THEN 'COMPLETED' ELSE 'INSUFFICIENT_CONTEXT' END AS status FROM g""", "cited")
def v5_sanitize_assessment(i):
    return V.sanitize_assessment(assessment(i)).select("id", "technical_risk", "technical_risk_rationale", "recommendation", "status")


@query(""", g AS (SELECT id, count(*) AS n, count(*) FILTER (WHERE NOT known) AS u, max(l_returnflag) AS flag FROM cited GROUP BY 1)
SELECT id, (CASE WHEN u > 0 THEN 2 ELSE 0 END) + (CASE WHEN n > 2 THEN 0 ELSE 1 END) + (CASE WHEN flag = 'R' THEN 0 ELSE 1 END) + (CASE WHEN n > 2 OR flag = 'R' THEN 0 ELSE 1 END) AS n_errors FROM g""", "cited")
def v6_validate_assessment(i):
    return V.validate_assessment(assessment(i)).select("id", F.size("errors").alias("n_errors"))


@query(", g AS (SELECT id, max(l_returnflag) AS flag, list_sort(list(DISTINCT ref_id) FILTER (WHERE known)) AS k FROM cited GROUP BY 1) SELECT id, CASE WHEN flag = 'N' THEN '' ELSE coalesce(array_to_string(k, ','), '') END AS refs FROM g", "cited")
def v7_sanitize_answer(i):
    rows = cited(i).withColumns({"status": F.when(F.col("flag") == "N", "INSUFFICIENT_EVIDENCE").otherwise("ANSWERED"), "navigation": F.col("refs")})
    return V.sanitize_answer(rows).select("id", F.array_join(F.array_sort("refs"), ",").alias("refs"))


@query(", g AS (SELECT id, bool_or(ref_id LIKE 'EVD-1%') AS uses FROM cited GROUP BY 1) SELECT * FROM g", "cited")
def v9_uses_process_evidence(i):
    refs = F.transform("refs", lambda r: F.struct(F.when(r.startswith("EVD-1"), "PROCESS_USAGE_EVIDENCE").otherwise("OTHER").alias("source_type")))
    return cited(i).select("id", E.uses_process_evidence(refs).alias("uses"))


_NEAREST = """WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0), s AS (
  SELECT q.vec_id AS query_id, e.vec_id AS entity_id, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) / sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) AS score FROM q, embeddings e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id) AS rank FROM s) SELECT query_id, entity_id, round(score, 6) AS score FROM r WHERE rank <= 5"""


def searched(i):
    rows = i.table("embeddings").select(F.lit(1).alias("assessment_id"), F.lit("ROW").alias("entity_type"), F.col("vec_id").alias("entity_id"), F.col("embedding").alias("vector"))
    return rows.where("entity_id % 100 = 0").select(F.col("entity_id").alias("query_id"), "assessment_id", "vector"), rows


@query(_NEAREST)
def v3_cosine_topk(i):
    return vectors.cosine_topk(*searched(i), 5).select("query_id", "entity_id", F.round("score", 6).alias("score"))


@query(_NEAREST)
def v3_search_cells(i):
    return vectors.search_cells(*searched(i), 5)[0].select("query_id", "entity_id", F.round("score", 6).alias("score"))


@query("SELECT 1 AS assessment_id, 0 AS too_few, count(*) FILTER (WHERE vec_id % 100 = 0) AS asked FROM embeddings")
def v3_opened_cells(i):
    """How many queries there are, and whether any opened fewer cells than one."""
    report = vectors.search_cells(*searched(i), 5)[1]
    return report.select("assessment_id", F.when(F.col("opened") * F.col("cells") < F.col("pairs"), 1).otherwise(0).alias("too_few"), (F.col("pairs") / F.col("cells")).cast("long").alias("asked"))


def understandings(i):
    return i.sql("SELECT CAST(1 AS INT) AS assessment_id, p_partkey AS sap_object_id, p_name AS purpose, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS description, CASE WHEN p_size % 4 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status FROM part")


def observed(i):
    """Records with the payload that says how often their object is used."""
    payload = F.create_map(F.lit("LEVEL"), F.coalesce("usage_level", F.lit("")), F.lit("LINE"), F.col("line").cast("string"))
    return i.records.withColumns({"record_type": F.lit("usage"), "payload": payload})


_ENTITIES = _EVIDENCE + """, e AS (
  SELECT 'OBJECT' AS entity_type, p_partkey AS entity_id, concat_ws(chr(10), nullif(p_name, ''), CASE WHEN p_partkey % 3 <> 0 THEN p_type END) AS content_text FROM part WHERE p_size % 4 <> 0
  UNION ALL SELECT 'APPLICATION', id, concat_ws(chr(10), nullif(name, ''), nullif(domain, ''), nullif(description, '')) FROM apps WHERE status <> 'MERGED'
  UNION ALL SELECT 'BUSINESS_RULE', id, concat_ws(chr(10), nullif(condition, ''), nullif(action, '')) FROM rules WHERE status = 'CANDIDATE'
  UNION ALL SELECT 'EVIDENCE_RECORD', r.id, concat_ws(chr(10), 'usage', r.object_name, concat('LINE=', r.line, ', LEVEL=', coalesce(r.usage_level, ''))) FROM records r WHERE r.capability IN ('USAGE_SIGNAL', 'PROCESS_KPI') AND r.id IN (SELECT id FROM matched WHERE status LIKE 'MATCHED%'))
"""


@query(_ENTITIES + "SELECT entity_type, entity_id, sha256(content_text) AS content_hash FROM e", "objects records apps rules")
def v1_embeddable_entities(i):
    links = matched(i).select(F.col("id").alias("record_id"), "status")
    return vectors.embeddable_entities(understandings(i), i.apps, i.rules, observed(i), links).select("entity_type", "entity_id", "content_hash")


@query(_ENTITIES + """, words AS (SELECT entity_type, entity_id, unnest(list_filter(string_split(lower(regexp_replace(content_text, '\\s+', ' ', 'g')), ' '), lambda x: x <> '')) AS w FROM e),
c AS (SELECT entity_type, entity_id, CAST(length(w) % 4 AS INT) AS slot, CAST(ascii(w) AS DOUBLE) AS value FROM words)
SELECT e.entity_type, e.entity_id, coalesce(sum(value) FILTER (WHERE slot = 0), 0) AS v0, coalesce(sum(value) FILTER (WHERE slot = 1), 0) AS v1, coalesce(sum(value) FILTER (WHERE slot = 2), 0) AS v2, coalesce(sum(value) FILTER (WHERE slot = 3), 0) AS v3
FROM e LEFT JOIN c ON c.entity_type = e.entity_type AND c.entity_id = e.entity_id GROUP BY 1, 2""", "objects records apps rules")
def v2_embed(i):
    """All four kinds of entities, by a model that counts a word's first character at the place of its length."""

    def model(texts):
        out = []
        for text in texts:
            vector = [0.0] * 4
            for word in text.lower().split():
                vector[len(word) % 4] += ord(word[0])
            out.append(vector)
        return out

    entities = vectors.embeddable_entities(understandings(i), i.apps, i.rules, observed(i), matched(i).select(F.col("id").alias("record_id"), "status"))
    return vectors.embed(entities, model).select("entity_type", "entity_id", *(F.get("vector", k).cast("double").alias(f"v{k}") for k in range(4)))


_CLUSTERED = _EVIDENCE + """, member AS (SELECT s_suppkey AS object_id, CAST(s_suppkey % 9 AS BIGINT) AS cluster_id FROM supplier),
sig AS (SELECT CAST(l_suppkey % 9 AS BIGINT) AS cluster_id, l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_partkey END AS dependency_id FROM lineitem),
f AS (SELECT event_id AS id, user_id AS target_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(event_id % 4 AS INT) END AS priority FROM events),
items AS (
  SELECT DISTINCT cluster_id, 'DEP' AS pool, 0 AS severity_rank, dependency_id AS entity_id FROM sig WHERE dependency_id IS NOT NULL
  UNION ALL SELECT cluster_id, 'ATC', coalesce(priority, 99), f.id FROM f JOIN member ON member.object_id = f.target_id
  UNION ALL SELECT cluster_id, 'EVD', 0, m.id FROM matched m JOIN member ON member.object_id = m.target_id WHERE m.status LIKE 'MATCHED%'
  UNION ALL SELECT cluster_id, 'SIGNALS', 0, pos FROM sig)
"""


def clustered(i):
    objects = i.table("supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 9).cast("long").alias("cluster_id"))
    signals = i.sql("SELECT CAST(l_suppkey % 9 AS BIGINT) AS cluster_id, l_orderkey * 10 + l_linenumber AS position, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_partkey END AS dependency_id FROM lineitem")
    findings = i.sql("SELECT event_id AS id, user_id AS target_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(event_id % 4 AS INT) END AS priority FROM events")
    return E.discovery_package(objects, signals, findings, matched(i).withColumnRenamed("id", "record_id"), i.records)


_CAP = "CASE pool WHEN 'EVD' THEN 60 ELSE 80 END"


@query(_CLUSTERED + f", r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, pool ORDER BY severity_rank, entity_id) AS rn FROM items) SELECT cluster_id, pool, severity_rank, entity_id FROM r WHERE rn <= {_CAP}", "objects records")
def w2_discovery_package(i):
    return clustered(i)[0].select("cluster_id", "pool", "severity_rank", "entity_id")


@query(_CLUSTERED + f" SELECT cluster_id, pool, count(*) AS total, greatest(count(*) - {_CAP}, 0) AS omitted FROM items GROUP BY 1, 2", "objects records")
def w2_discovery_omitted(i):
    return clustered(i)[1]


@query(_EVIDENCE + """, own AS (SELECT id AS object_id, object_name FROM objects),
each AS (SELECT object_id, 'SRC' AS kind, 0 AS o, object_id AS entity_id, object_name AS summary FROM own
  UNION ALL SELECT f.target_id, 'ATC', 1, f.id, concat_ws(': ', check_title, check_message) FROM findings f WHERE f.target_id IN (SELECT object_id FROM own)
  UNION ALL SELECT m.target_id, 'EVD', 2, m.id, concat_ws(' | ', concat('set ', m.dataset_id), 'usage', concat('LINE=', r.line, ', LEVEL=', coalesce(r.usage_level, ''))) FROM matched m JOIN records r ON r.id = m.id WHERE m.status LIKE 'MATCHED%'),
r AS (SELECT *, row_number() OVER (PARTITION BY object_id, kind ORDER BY entity_id) AS n FROM each)
SELECT object_id, kind || '-' || n AS ref_id, entity_id, summary FROM r""", "objects records findings")
def w4_object_package(i):
    records = observed(i)
    datasets = records.select(F.col("dataset_id").alias("id"), F.concat(F.lit("set "), F.col("dataset_id").cast("string")).alias("name")).distinct()
    found = E.object_package(i.objects, i.findings, matched(i).withColumnRenamed("id", "record_id"), records, datasets)
    return found.select("object_id", F.explode("items").alias("x")).select("object_id", "x.ref_id", "x.entity_id", "x.summary")


@query(_EVIDENCE + """, member AS (SELECT id AS object_id, object_name, id % 13 AS application_id FROM objects),
items AS (SELECT application_id, 'OBJ' AS pool, 0 AS severity_rank, object_id AS entity_id, object_name AS summary FROM member
  UNION ALL SELECT application_id, 'DEP', 0, ((l_orderkey * 8 + l_linenumber) * 20000 + l_partkey % 20000) * 10000000 + CAST(round(l_extendedprice * 100) AS BIGINT) % 10000000, concat_ws(' ', object_name, 'INCLUDE', concat('P', l_partkey)) FROM lineitem JOIN member ON member.object_id = l_suppkey
  UNION ALL SELECT application_id, 'ATC', coalesce(priority, 99), f.id, check_title FROM findings f JOIN member ON member.object_id = f.target_id
  UNION ALL SELECT application_id, 'TF', CASE priority WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 3 END, f.id, concat_ws(': ', check_title, check_message) FROM findings f JOIN member ON member.object_id = f.target_id
  UNION ALL SELECT application_id, CASE WHEN r.capability = 'SOURCE_CODE' THEN 'EVD_TECHNICAL' ELSE 'EVD_BUSINESS' END, 0, m.id, concat_ws(': ', 'usage', concat('LINE=', r.line, ', LEVEL=', coalesce(r.usage_level, ''))) FROM matched m JOIN records r ON r.id = m.id JOIN member ON member.object_id = m.target_id WHERE m.status LIKE 'MATCHED%' AND r.capability <> 'OTHER'),
r AS (SELECT *, row_number() OVER (PARTITION BY application_id, pool ORDER BY severity_rank, entity_id) AS rn FROM items)
SELECT application_id, pool, concat(split_part(pool, '_', 1), '-', rn) AS ref_id, entity_id, summary FROM r WHERE rn <= CASE pool WHEN 'DEP' THEN 80 WHEN 'ATC' THEN 80 WHEN 'TF' THEN 60 WHEN 'OBJ' THEN 1000000000 ELSE 40 END""", "objects records findings")
def w1_application_package(i):
    objects = i.objects.withColumn("application_id", F.col("id") % 13)
    deps = i.sql("SELECT ((l_orderkey * 8 + l_linenumber) * 20000 + l_partkey % 20000) * 10000000 + CAST(round(l_extendedprice * 100) AS BIGINT) % 10000000 AS id, l_suppkey AS source_object_id, 'INCLUDE' AS dep_type, concat('P', l_partkey) AS target_name FROM lineitem")
    technical = D.derive_technical_findings(i.findings).withColumn("id", F.col("atc_finding_id"))
    items = E.application_items(objects, deps, i.findings, technical, matched(i).withColumnRenamed("id", "record_id"), observed(i))
    return E.with_ref_ids(E.bounded_evidence(items, E.CAPS)[0]).select("application_id", "pool", "ref_id", "entity_id", "summary")
