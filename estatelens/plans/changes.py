"""Change handling: U1-U3, U5-U7, U9, W9, W10, J12-J14, P11."""

from pyspark.sql import functions as F

from estatelens.functions import text as T
from estatelens.operators import changes as C
from estatelens.operators import evidence as E
from estatelens.plans.base import Registry

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
_OLD = "SELECT CAST(1 AS INT) AS assessment_id, 'DOC' AS entity_type, doc_id AS entity_id, text AS content_text FROM documents WHERE doc_id % 3 <> 0"
_NEW = "SELECT CAST(1 AS INT) AS assessment_id, 'DOC' AS entity_type, doc_id AS entity_id, CASE WHEN doc_id % 10 = 1 THEN concat(text, '!') ELSE text END AS content_text FROM documents WHERE doc_id % 4 <> 0"
_FP = "substring(sha256(coalesce(content_text, '')), 1, 32)"


def slices(i):
    fp = T.record_fingerprint(F.coalesce("content_text", F.lit("")))
    return [i.sql(s).withColumns({"dataset_id": F.lit(1), "record_fingerprint": fp}) for s in (_OLD, _NEW)]


@query(f"WITH old AS (SELECT {_FP} AS f FROM ({_OLD})), new AS (SELECT {_FP} AS f, entity_id FROM ({_NEW})) SELECT f AS record_fingerprint, min(entity_id) AS entity_id FROM new WHERE f NOT IN (SELECT f FROM old) GROUP BY 1")
def u1_append_new(i):
    old, new = slices(i)
    return C.new_rows(old, new, ["dataset_id", "record_fingerprint"], [F.asc("entity_id")]).select("record_fingerprint", "entity_id")


@query("""WITH old AS (SELECT p_partkey AS id, concat('PART::', upper(p_name)) AS k, p_type AS d, p_size AS f FROM part WHERE p_partkey % 3 = 0),
dold AS (SELECT k, min(id) AS id, arg_min(d, id) AS d FROM old GROUP BY 1),
new AS (SELECT k, d FROM (SELECT concat('PART::', upper(p_name)) AS k, concat('new ', p_type) AS d, row_number() OVER (PARTITION BY upper(p_name) ORDER BY p_partkey DESC) AS rn FROM part WHERE p_partkey % 5 = 0) WHERE rn = 1)
SELECT coalesce(o.k, n.k) AS canonical_key, o.id AS old_id, coalesce(n.d, o.d) AS description FROM dold o FULL JOIN new n ON o.k = n.k""")
def u2_upsert_objects(i):
    base = i.sql("SELECT CAST(1 AS INT) AS assessment_id, p_partkey AS id, p_type AS description, p_partkey AS source_file_id, CAST(1 AS INT) AS line_start, p_name AS object_name FROM part").withColumn("canonical_key", T.canonical_key(F.lit("part"), F.col("object_name")))
    old = C.latest_per_key(base.where("id % 3 = 0"), ["canonical_key"], [F.asc("id")])
    new = base.where("id % 5 = 0").withColumn("description", F.concat(F.lit("new "), "description")).drop("id")
    out = C.upsert_objects(old, new).join(old.select(F.col("id").alias("old_id"), F.col("canonical_key").alias("_k")), F.col("canonical_key") == F.col("_k"), "left")
    return out.select("canonical_key", "old_id", "description")


@query("SELECT p_partkey AS id FROM part WHERE NOT (p_size % 2 = 0 AND p_partkey % 3 <> 0)")
def u3_drop_stale(i):
    objects = i.sql("SELECT CAST(1 AS INT) AS assessment_id, p_partkey AS id, CAST(p_size AS BIGINT) AS source_file_id, CAST(p_partkey AS STRING) AS canonical_key FROM part")
    files = objects.select(F.col("source_file_id").alias("id"), (F.col("source_file_id") % 2).alias("scan_id")).distinct()
    return C.drop_stale(objects, objects.where("id % 3 = 0"), files, 0).select("id")


@query("SELECT id FROM rules WHERE NOT (sap_object_id % 2 = 0 AND NOT user_validated) UNION ALL SELECT -id FROM rules WHERE sap_object_id % 2 = 0", "rules")
def u5_replace_candidates(i):
    done = i.rules.where("sap_object_id % 2 = 0").select("sap_object_id")
    return C.replace_candidates(i.rules, i.rules.withColumn("id", -F.col("id")), done).select("id")


@query(f"WITH old AS ({_OLD}), new AS ({_NEW}) SELECT n.entity_id, sha256(coalesce(n.content_text, '')) AS content_hash FROM new n LEFT JOIN old o ON n.entity_id = o.entity_id AND sha256(coalesce(n.content_text, '')) = sha256(coalesce(o.content_text, '')) WHERE o.entity_id IS NULL")
def u6_changed_entities(i):
    old, new = (i.sql(s) for s in (_OLD, _NEW))
    return C.changed_entities(new, old.withColumn("content_hash", F.sha2(F.coalesce("content_text", F.lit("")), 256))).select("entity_id", "content_hash")


@query(f"WITH old AS ({_OLD}), new AS ({_NEW}) SELECT concat('doc/', CAST(n.entity_id AS VARCHAR)) AS rel_path FROM new n LEFT JOIN old o ON n.entity_id = o.entity_id AND n.content_text IS NOT DISTINCT FROM o.content_text WHERE o.entity_id IS NULL")
def u7_changed_files(i):
    old, new = (i.sql(s).select(F.concat(F.lit("doc/"), F.col("entity_id").cast("string")).alias("rel_path"), F.sha2(F.coalesce("content_text", F.lit("\0")), 256).alias("sha256")) for s in (_OLD, _NEW))
    return C.changed_files(new, old).select("rel_path")


@query("SELECT l_orderkey AS id, string_agg(ref_id, ',' ORDER BY first) AS refs FROM (SELECT l_orderkey, l_suppkey % 7 AS ref_id, min((l_linenumber * 100000 + l_partkey) * 10000 + l_suppkey) AS first FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def u9_fold_refs(i):
    # every line is a rule with one ref; the order's first line survives
    lines = i.sql("SELECT l_orderkey AS survivor, (l_linenumber * 100000 + l_partkey) * 10000 + l_suppkey AS id, CAST(l_suppkey % 7 AS STRING) AS ref FROM lineitem").withColumn("evidence_refs", F.array(F.struct(F.col("ref").alias("ref_id"), F.lit("X").alias("source_type"), F.lit(1).cast("long").alias("entity_id"))))
    empty = lines.select(F.col("survivor").alias("id"), F.filter("evidence_refs", lambda r: F.lit(False)).alias("evidence_refs")).dropDuplicates(["id"])
    return C.fold_refs(empty, lines).select("id", F.array_join(F.transform("evidence_refs", lambda r: r["ref_id"]), ",").alias("refs"))


@query("SELECT arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, o_custkey FROM orders GROUP BY o_custkey")
def w10_latest_per_key(i):
    return C.latest_per_key(i.table("orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_orderkey", "o_custkey")


@query("""WITH s AS (SELECT p_partkey AS id, max(p_partkey) OVER (PARTITION BY upper(p_name)) AS survivor FROM part)
SELECT l.l_orderkey, l.l_linenumber, s.survivor AS sap_object_id FROM lineitem l LEFT JOIN s ON l.l_partkey = s.id""")
def j13_repoint_duplicates(i):
    objects = i.sql("SELECT CAST(1 AS INT) AS assessment_id, p_partkey AS id, upper(p_name) AS canonical_key, CAST(NULL AS TIMESTAMP) AS parsed_at FROM part")
    refs = i.sql("SELECT l_orderkey, l_linenumber, l_partkey AS sap_object_id FROM lineitem")
    return C.repoint_duplicates(objects, refs)[1]


@query("SELECT s_suppkey AS id, s_nationkey AS client_id, CASE WHEN s_suppkey % 4 = 0 THEN s_name WHEN s_nationkey % 2 = 0 THEN n_name ELSE concat(n_name, ' (', CAST(n_regionkey AS VARCHAR), ')') END AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def j14_backfill_owner(i):
    own = i.sql("SELECT s_suppkey AS id, CAST(NULL AS INT) AS client_id, s_nationkey AS system_id, CASE WHEN s_suppkey % 4 = 0 THEN s_name END AS name FROM supplier")
    systems = i.sql("SELECT n_nationkey AS id, n_nationkey AS client_id, n_name AS system_name, CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE CAST(n_regionkey AS STRING) END AS sid FROM nation")
    return C.backfill_owner(own, systems).select("id", "client_id", "name")


@query("""WITH t AS (SELECT c_custkey AS target_id, unnest(['a', 'b']) AS provider, lower(c_mktsegment) AS q FROM customer),
cache AS (SELECT s_suppkey AS id, s_suppkey AS target_id, 'a' AS provider, CASE WHEN s_suppkey % 2 = 0 THEN 'furniture' ELSE 'other' END AS q FROM supplier)
SELECT t.target_id, t.provider, CASE WHEN c.id IS NULL THEN 'fetch' ELSE 'reuse' END AS action, c.id AS reuse_id
FROM t LEFT JOIN (SELECT provider, q, max(id) AS id FROM cache GROUP BY 1, 2) c ON c.provider = t.provider AND c.q = t.q
WHERE NOT EXISTS (SELECT 1 FROM cache k WHERE k.target_id = t.target_id AND k.provider = t.provider)""")
def j12_plan_guidance(i):
    targets = i.sql("SELECT CAST(1 AS INT) AS assessment_id, 'APPLICATION' AS target_type, c_custkey AS target_id, c_mktsegment AS text FROM customer")
    cache = i.sql("SELECT CAST(1 AS INT) AS assessment_id, 'APPLICATION' AS target_type, s_suppkey AS id, s_suppkey AS target_id, 'a' AS provider, CASE WHEN s_suppkey % 2 = 0 THEN ' Furniture ' ELSE 'other' END AS text FROM supplier")
    cache = cache.withColumn("query_fingerprint", T.query_fingerprint(F.col("provider"), F.col("text")))
    return E.plan_guidance(targets, cache, ["a", "b"]).select("target_id", "provider", "action", "reuse_id")


@query("""SELECT l_orderkey AS record_id, l_suppkey % 5 AS dataset_id, CASE WHEN l_suppkey % 5 IN (1, 3) THEN 'new' ELSE 'old' END AS status FROM lineitem WHERE l_suppkey % 5 NOT IN (1, 3) OR l_linenumber > 2""")
def u4_replace_correlations(i):
    old = i.sql("SELECT l_orderkey AS record_id, l_suppkey % 5 AS dataset_id, 'old' AS status FROM lineitem")
    new = i.sql("SELECT l_orderkey AS record_id, l_suppkey % 5 AS dataset_id, 'new' AS status FROM lineitem WHERE l_linenumber > 2 AND l_suppkey % 5 IN (1, 3)")
    once = C.replace_partition(old, new, "dataset_id")
    return C.replace_partition(once, new, "dataset_id")


_VERDICTS = """SELECT conv_id * 100 + turn AS rule_id, turn AS moment, 'fine' AS notes FROM conversations WHERE text IS NOT NULL AND turn % 2 = 1
UNION ALL SELECT conv_id * 100 + turn, turn + 10, concat('seen ', conv_id) FROM conversations WHERE text IS NOT NULL AND turn % 4 = 1"""


@query(f""", last AS (SELECT rule_id, max(moment) AS moment, arg_max(notes, moment) AS notes FROM ({_VERDICTS}) GROUP BY 1)
SELECT r.id, r.user_validated OR l.rule_id IS NOT NULL AS user_validated, l.notes AS validation_notes, l.moment AS validated_at FROM rules r LEFT JOIN last l ON l.rule_id = r.id""", "rules")
def u11_apply_validation(i):
    log = i.sql(_VERDICTS).withColumnRenamed("moment", "at")
    return C.apply_validation(i.rules, log).select("id", "user_validated", "validation_notes", "validated_at")


@query("""SELECT 'dataset' AS kind, s_suppkey AS id FROM supplier WHERE s_suppkey <> 3 UNION ALL SELECT 'record', l_orderkey * 10 + l_linenumber FROM lineitem WHERE l_suppkey <> 3
UNION ALL SELECT 'artifact', p_partkey FROM part WHERE p_partkey % 10 <> 3
UNION ALL SELECT 'correlation', l_orderkey * 10 + l_linenumber FROM lineitem WHERE l_linenumber % 2 = 0 AND l_orderkey * 10 + l_linenumber NOT IN (SELECT l_orderkey * 10 + l_linenumber FROM lineitem WHERE l_suppkey = 3)""")
def u12_cascade_delete(i):
    tables = {
        "evidence_dataset": i.table("supplier").select(F.col("s_suppkey").alias("id")), "evidence_record": i.sql("SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS dataset_id FROM lineitem"),
        "evidence_artifact": i.sql("SELECT p_partkey AS id, p_partkey % 10 AS dataset_id FROM part"), "evidence_correlation": i.sql("SELECT l_orderkey * 10 + l_linenumber AS record_id FROM lineitem WHERE l_linenumber % 2 = 0"),
    }
    left = C.cascade_delete(tables, 3)
    out = left["evidence_dataset"].select(F.lit("dataset").alias("kind"), "id")
    for name, kind, column in (("evidence_record", "record", "id"), ("evidence_artifact", "artifact", "id"), ("evidence_correlation", "correlation", "record_id")):
        out = out.unionByName(left[name].select(F.lit(kind).alias("kind"), F.col(column).alias("id")))
    return out


_CURATED = """WITH apps AS (SELECT c_custkey AS id FROM customer),
merges AS (SELECT id, id - id % 10 + 1 AS into_id FROM apps WHERE id % 10 IN (4, 7) AND id - id % 10 + 1 IN (SELECT id FROM apps)),
moved AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN o_custkey - o_custkey % 10 + 4 ELSE o_custkey END AS application_id FROM orders)
"""


@query(_CURATED + """SELECT 'app' AS kind, a.id, m.into_id AS application_id, CASE WHEN m.id IS NOT NULL THEN 'MERGED' WHEN a.id % 3 = 0 THEN 'USER_RENAMED' ELSE 'CANDIDATE' END AS status, CASE WHEN a.id % 3 = 0 THEN concat('late ', a.id) ELSE concat('app ', a.id) END AS name FROM apps a LEFT JOIN merges m ON m.id = a.id
UNION ALL SELECT 'object', o.id, coalesce(m.into_id, o.application_id), NULL, NULL FROM moved o LEFT JOIN merges m ON m.id = o.application_id""")
def u8_apply_curation(i):
    empty = F.array().cast("array<struct<ref_id:string,source_type:string,entity_id:bigint>>")
    apps = i.table("customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("app "), F.col("c_custkey").cast("string")).alias("name"), F.lit("CANDIDATE").alias("status"), F.lit(None).cast("long").alias("merged_into_id"), empty.alias("evidence_refs"))
    objects = i.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("application_id"))
    log = i.sql("""
        SELECT 10 AS seq, 'rename' AS action, c_custkey AS application_id, CAST(NULL AS BIGINT) AS object_id, CAST(NULL AS BIGINT) AS target_id, 'early' AS name FROM customer WHERE c_custkey % 3 = 0
        UNION ALL SELECT 20, 'rename', c_custkey, NULL, NULL, concat('late ', CAST(c_custkey AS STRING)) FROM customer WHERE c_custkey % 3 = 0
        UNION ALL SELECT 30, 'move', CASE WHEN o_orderkey % 5 = 1 THEN o_custkey - o_custkey % 10 + 4 END, o_orderkey, NULL, NULL FROM orders WHERE o_orderkey % 5 < 2
        UNION ALL SELECT 40, 'merge', a.c_custkey, NULL, b.c_custkey, NULL FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey - a.c_custkey % 10 + 1 WHERE a.c_custkey % 10 IN (4, 7)
        UNION ALL SELECT 50, 'merge', c_custkey, NULL, c_custkey, NULL FROM customer
        UNION ALL SELECT 60, 'rename', c_custkey, NULL, NULL, 'too late' FROM customer a WHERE c_custkey % 10 IN (4, 7) AND EXISTS (SELECT 1 FROM customer b WHERE b.c_custkey = a.c_custkey - a.c_custkey % 10 + 1)""".replace(" customer b", " {customer} b").replace(" customer a", " {customer} a"))
    kept, placed = C.apply_curation(apps, objects, log)
    of_apps = kept.select(F.lit("app").alias("kind"), "id", F.col("merged_into_id").alias("application_id"), "status", "name")
    return of_apps.unionByName(placed.select(F.lit("object").alias("kind"), "id", "application_id", F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("name")))


@query("""SELECT canonical_key, id, description FROM (SELECT upper(concat('part::', p_name)) AS canonical_key, p_partkey AS id, p_type AS description, row_number() OVER (PARTITION BY upper(p_name) ORDER BY p_size DESC, p_partkey DESC) AS rn FROM part) WHERE rn = 1""")
def w9_last_parsed(i):
    rows = i.sql("SELECT CAST(1 AS INT) AS assessment_id, p_partkey AS id, p_name AS object_name, p_type AS description, p_size AS source_file_id, p_partkey AS line_start FROM part").withColumn("canonical_key", T.canonical_key(F.lit("part"), F.col("object_name")))
    return C.last_parsed(rows).select("canonical_key", "id", "description")
