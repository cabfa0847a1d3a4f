"""Dependency graph: J6, G1-G4, G6, G7, R9, R10."""

from pyspark.sql import functions as F

from estatelens import graph as G
from estatelens.operators import reports as R
from estatelens.plans.base import Registry
from estatelens.storage import checkpointed

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
_DEPS = """WITH o AS (SELECT p_partkey AS id, upper(concat('P', CAST(p_partkey % 300 AS VARCHAR))) AS name, p_type FROM part),
d AS (SELECT p_partkey AS id, p_partkey AS source, concat('P', CAST((p_partkey * 7) % 400 AS VARCHAR)) AS target, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS t FROM part),
k AS (SELECT upper(p_type) AS t, name, min(id) AS id FROM o GROUP BY 1, 2), n AS (SELECT name, min(id) AS id FROM o GROUP BY 1),
r AS (SELECT d.id, d.source, coalesce(k.id, n.id) AS target_id FROM d LEFT JOIN k ON upper(d.t) = k.t AND upper(d.target) = k.name LEFT JOIN n ON upper(d.target) = n.name)
"""


def objects(i):
    rows = i.sql("SELECT CAST(1 AS INT) AS assessment_id, p_partkey AS id, concat('P', CAST(p_partkey % 300 AS STRING)) AS object_name, p_type AS object_type FROM part")
    return rows.withColumn("canonical_key", G.canonical_key(F.col("object_type"), F.col("object_name")))


def deps(i):
    return i.sql("SELECT CAST(1 AS INT) AS assessment_id, p_partkey AS id, p_partkey AS source_object_id, concat('p', CAST((p_partkey * 7) % 400 AS STRING)) AS target_name, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS target_type, 'CALL_FUNCTION' AS dep_type FROM part")


def edges(i):
    """The inputs' edges, no part of which goes through the driver."""
    parts = i.table("part").select(F.col("p_partkey").alias("dst"))
    linked = i.sql("SELECT p_partkey AS src, p_partkey + 1 AS dst FROM part WHERE p_partkey % 7 <> 6")
    return linked.join(G.sorted_side(parts), "dst", "left_semi").select("src", "dst")


@query(_DEPS + "SELECT id, target_id FROM r WHERE target_id IS NOT NULL AND target_id <> source")
def j6_resolve_dependencies(i):
    return G.resolve_dependencies(deps(i), objects(i)).select("id", "target_id")


@query(_DEPS + "SELECT o.id, (SELECT count(*) FROM r WHERE r.target_id = o.id AND r.target_id <> r.source) AS n_inbound FROM o")
def g7_inbound_counts(i):
    return G.inbound_counts(objects(i), deps(i))


@query(_DEPS + "SELECT target_id AS id, count(*) AS n_inbound FROM r WHERE target_id <> source GROUP BY 1")
def r10_programs_in_use(i):
    return R.programs_in_use(objects(i), deps(i))


@query(_DEPS + ", f AS (SELECT user_id AS id, count(*) AS n_critical FROM events WHERE event_id % 5 = 1 AND user_id % 9 <> 0 GROUP BY 1) SELECT f.id, f.n_critical FROM f JOIN o ON o.id = f.id WHERE f.id NOT IN (SELECT target_id FROM r WHERE target_id IS NOT NULL AND target_id <> source)")
def r9_retire_candidates(i):
    return R.retire_candidates(objects(i), deps(i), i.findings)


@query("SELECT p_partkey AS node, (SELECT min(x.p_partkey) FROM part x WHERE x.p_partkey // 7 = part.p_partkey // 7) AS component FROM part")
def g2_connected_components(i):
    return G.connected_components(i.table("part").select(F.col("p_partkey").alias("node")), edges(i))


@query("SELECT p_partkey AS node, (SELECT min(x.p_partkey) FROM part x WHERE x.p_partkey // 7 = part.p_partkey // 7) AS component FROM part")
def g2_update_components(i):
    """From a state in which other parts were linked and a third of the present links were missing."""
    nodes, links = i.table("part").select(F.col("p_partkey").alias("node")), edges(i)
    came, went = links.where("src % 3 = 0"), i.sql("SELECT p_partkey AS src, p_partkey + 7 AS dst FROM part WHERE p_partkey % 35 = 3").join(G.sorted_side(nodes.withColumnRenamed("node", "dst")), "dst", "left_semi").select("src", "dst")
    old_nodes = nodes.where("node % 10 <> 4").unionByName(nodes.where("node % 10 = 4").select((-F.col("node") - 1).alias("node")))
    before = links.where("src % 3 <> 0").unionByName(went).join(G.sorted_side(old_nodes.withColumnRenamed("node", "src")), "src", "left_semi").join(G.sorted_side(old_nodes.withColumnRenamed("node", "dst")), "dst", "left_semi").select("src", "dst")
    labels = checkpointed(G.connected_components(old_nodes, before))
    added = came.unionByName(links.where("src % 10 = 4 or dst % 10 = 4")).distinct()
    return G.update_components(labels, nodes, added, went, links)


#: Packages from findings on every part, and from records of which two in three are matched.
_PACKAGES = "SELECT p_partkey AS id, concat(p_brand, p_type, CAST(p_size AS VARCHAR)) AS package_name FROM part"
_PACKAGED = "SELECT l_partkey AS id, concat('DAY ', CAST(CAST(l_shipdate AS DATE) AS VARCHAR), l_linestatus, CAST(floor(l_quantity) AS INT)) AS package_name FROM lineitem WHERE l_suppkey % 3 <> 0 AND l_linenumber = 1"


def packages(i):
    found = i.sql(_PACKAGES.replace("VARCHAR", "STRING")).withColumnRenamed("id", "target_id")
    rows = i.sql("SELECT ((l_orderkey * 8 + l_linenumber) * 20000 + l_partkey % 20000) * 10000000 + CAST(round(l_extendedprice * 100) AS BIGINT) % 10000000 AS id, l_partkey AS target_id, CASE WHEN l_suppkey % 3 = 0 THEN 'AMBIGUOUS' WHEN l_suppkey % 3 = 1 THEN 'MATCHED_EXACT' ELSE 'MATCHED_HEURISTIC' END AS status, concat('DAY ', CAST(CAST(l_shipdate AS DATE) AS STRING), l_linestatus, CAST(floor(l_quantity) AS INT)) AS package_name FROM lineitem WHERE l_linenumber = 1")
    return G.package_links(objects(i), found, rows.select(F.col("id").alias("record_id"), "target_id", "status"), rows.select("id", "package_name"))


_STARS = f"p AS (SELECT DISTINCT id, package_name FROM ({_PACKAGES} UNION ALL {_PACKAGED})), a AS (SELECT package_name, min(id) AS src FROM p GROUP BY 1), stars AS (SELECT a.src, p.id AS dst, p.package_name FROM p JOIN a ON p.package_name = a.package_name WHERE p.id <> a.src)"


@query(f"WITH {_STARS} SELECT src, dst, package_name FROM stars")
def g1_package_links(i):
    return packages(i)


def chain_deps(i):
    return edges(i).select(F.lit(1).alias("assessment_id"), (F.col("src")).alias("id"), F.col("src").alias("source_object_id"), F.concat(F.lit("K"), F.col("dst").cast("string")).alias("target_name"), F.lit(None).cast("string").alias("target_type"), F.lit("INCLUDE").alias("dep_type"))


def chain_objects(i):
    rows = i.sql("SELECT CAST(1 AS INT) AS assessment_id, p_partkey AS id, concat('k', CAST(p_partkey AS STRING)) AS object_name, CAST(p_partkey % 50 AS BIGINT) AS application_id FROM part")
    return rows.withColumn("canonical_key", G.canonical_key(F.lit("x"), F.col("object_name")))


def local_packages(i):
    """Stars among the parts of a block of 35, so that clusters stay apart."""
    return packages(i).where("src div 35 = dst div 35")


#: Blocks of 35 parts: runs of seven are chains, and stars join some of the runs; a run's component is the smallest it reaches in five hops.
_CLUSTERS = f"""WITH {_STARS}, local AS (SELECT * FROM stars WHERE src // 35 = dst // 35),
edges AS (SELECT p_partkey AS src, p_partkey + 1 AS dst FROM part WHERE p_partkey % 7 <> 6 AND p_partkey + 1 IN (SELECT p_partkey FROM part)),
links AS (SELECT src, dst, 'DEPENDENCY' AS signal_type, concat('INCLUDE K', dst) AS description, src AS dependency_id FROM edges UNION ALL SELECT src, dst, 'SHARED_PACKAGE', package_name, NULL FROM local),
runs AS (SELECT p_partkey AS id, p_partkey // 7 AS run FROM part),
hops AS (SELECT DISTINCT a.run AS x, b.run AS y FROM links l JOIN runs a ON a.id = l.src JOIN runs b ON b.id = l.dst WHERE a.run <> b.run),
near AS (SELECT x, y FROM hops UNION SELECT y, x FROM hops UNION SELECT run, run FROM runs),
two AS (SELECT DISTINCT a.x, b.y FROM near a JOIN near b ON a.y = b.x), four AS (SELECT DISTINCT a.x, b.y FROM two a JOIN two b ON a.y = b.x),
parts AS (SELECT r.id, (SELECT min(q.id) FROM four f JOIN runs q ON q.run = f.y WHERE f.x = r.run) AS cluster_id FROM runs r)"""


_SIGNALS = _CLUSTERS + """, inside AS (SELECT l.*, p.cluster_id, least(l.src, l.dst) AS a, greatest(l.src, l.dst) AS b, signal_type <> 'DEPENDENCY' AS late, coalesce(dependency_id, 0) AS d FROM links l JOIN parts p ON p.id = l.src),
firsts AS (SELECT a, b, min((late, d, description)) AS first FROM inside GROUP BY 1, 2)
SELECT i.cluster_id, row_number() OVER (PARTITION BY i.cluster_id ORDER BY f.first, i.a, i.b, (late, d, description)) AS position, signal_type, src, dst, description, dependency_id FROM inside i JOIN firsts f ON f.a = i.a AND f.b = i.b"""


@query(_SIGNALS)
def g3_cluster_signals(i):
    return G.build_clusters(chain_objects(i), chain_deps(i), local_packages(i))[1].withColumn("description", F.regexp_replace("description", "^INCLUDE k", "INCLUDE K"))


@query(_SIGNALS)
def g3_update_clusters(i):
    """The signals after a rerun: before it, a tenth of the links was missing and as many others were there."""
    objects, links = chain_objects(i), G.cluster_links(chain_objects(i), chain_deps(i), local_packages(i))
    others = links.where("src % 11 = 5").select("src", (F.expr("src div 35 * 35") + 34).alias("dst"), "signal_type", F.lit("gone").alias("description"), "dependency_id").where("src <> dst").join(G.sorted_side(objects.select(F.col("id").alias("dst"))), "dst", "left_semi").select(*links.columns)
    old = links.where("src % 10 <> 7").unionByName(others)
    parts = checkpointed(G.connected_components(objects.select(F.col("id").alias("node")), old).select(F.col("node").alias("id"), F.col("component").alias("cluster_id")))
    before = parts, checkpointed(G.cluster_signals(old, parts))
    return G.update_clusters(before, old, objects, links)[1].withColumn("description", F.regexp_replace("description", "^INCLUDE k", "INCLUDE K"))


@query(_CLUSTERS + ", s AS (SELECT p.cluster_id, count(*) AS n_signals FROM links l JOIN parts p ON p.id = l.src GROUP BY 1) SELECT m.cluster_id, count(*) AS n_members, max(s.n_signals) AS n_signals FROM parts m LEFT JOIN s ON s.cluster_id = m.cluster_id GROUP BY 1")
def g3_build_clusters(i):
    members, signals = G.build_clusters(chain_objects(i), chain_deps(i), local_packages(i))
    counts = signals.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_signals"))
    return members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_members")).join(counts, "cluster_id", "left")


#: Clusters are the runs of seven parts; twenty applications a thousand parts, of which some are renamed; a part's old application shifts by one run now and then.
_APPS = "SELECT DISTINCT (p_partkey // 14) * 2 AS id, CASE WHEN (p_partkey // 14) % 10 = 3 THEN 'USER_RENAMED' ELSE 'CANDIDATE' END AS status FROM part"
_OWNED = "SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_size % 5 = 0 THEN ((p_partkey + 14) // 14) * 2 ELSE (p_partkey // 14) * 2 END AS application_id FROM part"


@query(f"""WITH RECURSIVE apps AS ({_APPS}), owned AS ({_OWNED}), c AS (SELECT id, (SELECT min(q.id) FROM owned q WHERE q.id // 7 = owned.id // 7) AS cluster_id, application_id FROM owned),
free AS (SELECT * FROM c WHERE cluster_id NOT IN (SELECT cluster_id FROM c JOIN apps a ON a.id = c.application_id WHERE a.status = 'USER_RENAMED')),
sizes AS (SELECT cluster_id, count(*) AS size FROM free GROUP BY 1),
wanted AS (SELECT f.cluster_id, application_id, count(*) AS n FROM free f JOIN apps a ON a.id = f.application_id GROUP BY 1, 2),
wish AS (SELECT w.cluster_id, application_id, row_number() OVER (PARTITION BY w.cluster_id ORDER BY n DESC, application_id) AS k FROM wanted w JOIN sizes s ON s.cluster_id = w.cluster_id WHERE n * 2 >= size),
turns AS (SELECT cluster_id, row_number() OVER (ORDER BY cluster_id) AS turn, max(application_id) FILTER (WHERE k = 1) AS one, max(application_id) FILTER (WHERE k = 2) AS two FROM wish GROUP BY 1),
claimed AS (SELECT CAST(0 AS BIGINT) AS turn, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS got, CAST(NULL AS BIGINT) AS cluster_id
  UNION ALL SELECT t.turn, CASE WHEN NOT list_contains(c.taken, t.one) THEN list_append(c.taken, t.one) WHEN t.two IS NOT NULL AND NOT list_contains(c.taken, t.two) THEN list_append(c.taken, t.two) ELSE c.taken END,
    CASE WHEN NOT list_contains(c.taken, t.one) THEN t.one WHEN t.two IS NOT NULL AND NOT list_contains(c.taken, t.two) THEN t.two END, t.cluster_id FROM claimed c JOIN turns t ON t.turn = c.turn + 1)
SELECT s.cluster_id, d.got AS application_id, d.got IS NULL AS is_new FROM sizes s LEFT JOIN claimed d ON d.cluster_id = s.cluster_id""")
def g4_assign_applications(i):
    parts = G.connected_components(i.table("part").select(F.col("p_partkey").alias("node")), edges(i)).select(F.col("node").alias("id"), F.col("component").alias("cluster_id"))
    spark_sql = lambda q: i.sql(q.replace("//", "div"))
    own = spark_sql(_OWNED).withColumn("assessment_id", F.lit(1).cast("long"))
    found = G.assign_applications(parts, own, spark_sql(_APPS))
    return found.select("cluster_id", F.when(~F.col("is_new"), F.col("application_id")).alias("application_id"), "is_new")


@query("""WITH apps AS (SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 0 THEN 'MERGED' WHEN 1 THEN 'USER_RENAMED' ELSE 'CANDIDATE' END AS status FROM customer),
empty AS (SELECT id FROM apps WHERE status = 'CANDIDATE' AND id NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 5 = 0))
SELECT 'app' AS kind, id FROM apps WHERE id NOT IN (SELECT id FROM empty) UNION ALL SELECT 'embedding', id FROM apps WHERE id NOT IN (SELECT id FROM empty) UNION ALL SELECT 'other', id FROM apps""")
def g5_drop_empty_applications(i):
    apps = i.table("customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 7 == 0, "MERGED").when(F.col("c_custkey") % 7 == 1, "USER_RENAMED").otherwise("CANDIDATE").alias("status"))
    objects = i.table("orders").select(F.when(F.col("o_orderkey") % 5 == 0, F.col("o_custkey")).alias("application_id"))
    embeddings = apps.select(F.col("id").alias("entity_id"), F.explode(F.array(F.lit("APPLICATION"), F.lit("OBJECT"))).alias("entity_type"))
    left, vectors = G.drop_empty_applications(apps, objects, embeddings)
    kind = F.when(F.col("entity_type") == "APPLICATION", "embedding").otherwise("other")
    return left.select(F.lit("app").alias("kind"), "id").unionByName(vectors.select(kind.alias("kind"), F.col("entity_id").alias("id")))


_PLAIN = "lower(trim(regexp_replace({c}, '\\s+', ' ', 'g')))"
_SAME = f""", k AS (SELECT *, first_value(id) OVER (PARTITION BY rule_type, {_PLAIN.format(c="condition")}, {_PLAIN.format(c="action")} ORDER BY user_validated DESC, id) AS survivor FROM rules WHERE status <> 'MERGED')"""


def evidenced(i):
    refs = F.array(F.struct(F.concat(F.lit("R-"), (F.col("id") % 10).cast("string")).alias("ref_id"), F.lit("E").alias("source_type"), (F.col("id") % 10).alias("entity_id")), F.struct(F.lit("R-0").alias("ref_id"), F.lit("E").alias("source_type"), F.lit(0).cast("long").alias("entity_id")))
    return i.rules.withColumn("evidence_refs", refs)


@query(_SAME + """ SELECT id, CASE WHEN id <> survivor AND NOT user_validated THEN 'MERGED' ELSE status END AS status, CASE WHEN id <> survivor AND NOT user_validated THEN survivor END AS consolidated_into_id FROM k
UNION ALL SELECT id, status, consolidated_into_id FROM rules WHERE status = 'MERGED'""", "rules")
def g6_consolidate_rules(i):
    return G.consolidated_status(i.rules).select("id", "status", "consolidated_into_id")


@query(_SAME + """, refs AS (SELECT survivor, id <> survivor AS turn, id, unnest([0, 1]) AS pos, unnest([concat('R-', id % 10), 'R-0']) AS ref_id FROM k),
first AS (SELECT survivor, ref_id, min((turn, id, pos)) AS seen FROM refs GROUP BY 1, 2), folded AS (SELECT survivor, string_agg(ref_id, ',' ORDER BY seen) AS refs FROM first GROUP BY 1)
SELECT k.id, CASE WHEN k.id = k.survivor THEN f.refs ELSE concat('R-', k.id % 10, ',R-0') END AS refs FROM k JOIN folded f ON f.survivor = k.survivor UNION ALL SELECT id, concat('R-', id % 10, ',R-0') FROM rules WHERE status = 'MERGED'""", "rules")
def g6_folded_refs(i):
    return G.consolidate_rules(evidenced(i)).select("id", F.array_join(F.transform("evidence_refs", lambda r: r["ref_id"]), ",").alias("refs"))
