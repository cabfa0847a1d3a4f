import random

from estatelens import graph, storage
from estatelens.operators import dashboard
from estatelens.plans import graphs
from pyspark.sql import functions as F


def union_find(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_match_union_find(spark):
    r = random.Random(5)
    nodes = list(range(400))
    edges = [(r.choice(nodes), r.choice(nodes)) for _ in range(250)] + [(k, k + 1) for k in range(300, 399)] + [(5, 5), (5, 6), (6, 5)]
    found = graph.connected_components(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, "src long, dst long"))
    assert dict(map(tuple, found.collect())) == union_find(nodes, edges)


def test_components_without_edges(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert [tuple(r) for r in graph.connected_components(spark.createDataFrame([(3,)], "node long"), none).collect()] == [(3, 3)]
    assert not graph.connected_components(spark.createDataFrame([], "node long"), none).collect()


OBJECTS = "assessment_id int, id long, object_name string, canonical_key string"


def test_clusters_link_calls_and_packages(spark):
    objects = spark.createDataFrame([(1, n, f"Z{n}", f"CLASS::Z{n}") for n in range(1, 7)], OBJECTS)
    deps = spark.createDataFrame([(100, 1, 1, "z2", None, "CALL_FUNCTION"), (101, 1, 1, "z2", "class", "INHERITS_FROM"), (102, 1, 3, "Z3", None, "INCLUDE"), (103, 1, 3, "nope", None, "INCLUDE")], "id long, assessment_id int, source_object_id long, target_name string, target_type string, dep_type string")
    findings = spark.createDataFrame([(2, "P"), (4, "P"), (5, "p"), (6, None)], "target_id long, package_name string")
    none = spark.createDataFrame([], "record_id long, target_id long, status string"), spark.createDataFrame([], "id long, package_name string")
    members, signals = graph.build_clusters(objects, deps, graph.package_links(objects, findings, *none))
    assert dict(map(tuple, members.select("id", "cluster_id").collect())) == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5, 6: 6}
    assert [(r["position"], r["signal_type"], r["dependency_id"]) for r in signals.orderBy("position").collect()] == [(1, "DEPENDENCY", 100), (2, "DEPENDENCY", 101), (3, "SHARED_PACKAGE", None)]
    assert {r["id"]: r["n_inbound"] for r in graph.inbound_counts(objects, deps).collect()}[2] == 2


def test_assign_applications(spark):
    clusters = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 5), (7, 7), (8, 8), (9, 8)], "id long, cluster_id long")
    # 10 is split over 1 and 3; 8's members stand half in 10 and half in 11; 5 touches a renamed one; 7 had none
    objects = spark.createDataFrame([(1, 1, 10), (2, 1, 10), (3, 1, 10), (4, 1, None), (5, 1, 12), (6, 1, 11), (7, 1, None), (8, 1, 10), (9, 1, 11)], "id long, assessment_id long, application_id long")
    apps = spark.createDataFrame([(10, "CANDIDATE"), (11, "AI_NAMED"), (12, "USER_RENAMED")], "id long, status string")
    rows = {r["cluster_id"]: (r["application_id"], r["is_new"]) for r in graph.assign_applications(clusters, objects, apps).collect()}
    assert set(rows) == {1, 3, 7, 8} and rows[1] == (10, False) and rows[8] == (11, False) and rows[3][1] and rows[7][1]


def test_claims_in_rounds_as_one_after_another(spark):
    """Random wishes, one application wanted by most: the rounds give what clusters in turn would take."""
    r = random.Random(4)
    objects, clusters, old = [], [], {}
    for c in range(60):
        for k in range(r.randrange(1, 7)):
            n = len(objects)
            old[n] = r.choice([None, 0, 0, 0, r.randrange(8), r.randrange(40)])
            objects.append((n, 1, old[n]))
            clusters.append((n, c))
    apps = [(a, "CANDIDATE" if a % 9 else "MERGED") for a in range(1, 40)] + [(0, "CANDIDATE")]
    status, members = dict(apps), {}
    for n, c in clusters:
        members.setdefault(c, []).append(old[n])
    taken, wanted = set(), {}
    for c in sorted(members):
        if any(a is not None and status[a] == "MERGED" for a in members[c]):
            continue
        counts = sorted((-members[c].count(a), a) for a in set(members[c]) if a is not None)
        left = [a for n, a in counts if -n * 2 >= len(members[c]) and a not in taken]
        wanted[c] = left[0] if left else None
        taken |= set(left[:1])
    found = graph.assign_applications(spark.createDataFrame(clusters, "id long, cluster_id long"), spark.createDataFrame(objects, "id long, assessment_id long, application_id long"), spark.createDataFrame(apps, "id long, status string"))
    assert {x["cluster_id"]: None if x["is_new"] else x["application_id"] for x in found.collect()} == wanted


def test_long_chain_of_claims_in_few_rounds(spark, monkeypatch):
    """Cluster 0 takes application 0, so 1 is sent on to 1 and sends 2 on, and so forth; another chain is broken off, a ring closes."""
    n, calls = 3000, []
    monkeypatch.setattr(graph, "checkpointed", lambda df: calls.append(1) or storage.checkpointed(df))
    chain = [(1, 0, 0, None), *((1, k, k - 1, k) for k in range(1, n))]
    ring = [(1, 5000 + k, 9000 + k, 9000 + (k + 1) % 10) for k in range(10)] + [(1, 4999, 9003, None)]
    wishes = chain + ring + [(1, 6000, 9100, 9101), (1, 6001, 9100, 9101), (1, 6002, 9101, 9102), (1, 5999, 9102, None)]
    taken, wanted = {}, {}
    for _, c, one, two in sorted(wishes, key=lambda w: w[1]):
        got = next((a for a in (one, two) if a is not None and a not in taken), None)
        taken[got] = c
        wanted[c] = got
    found = graph._settle_claims(spark.createDataFrame(wishes, "assessment_id long, cluster_id long, one long, two long"))
    assert {r["cluster_id"]: r["application_id"] for r in found.collect()} == {c: a for c, a in wanted.items() if a is not None}
    assert len(calls) < 20


def frame(spark, edges):
    return spark.createDataFrame(list(edges), "src long, dst long")


def test_updated_components_equal_full_runs(spark):
    r = random.Random(9)
    nodes, edges = set(range(60)), {(r.randrange(60), r.randrange(60)) for _ in range(35)}
    as_nodes = lambda: spark.createDataFrame([(n,) for n in nodes], "node long")
    labels = storage.checkpointed(graph.connected_components(as_nodes(), frame(spark, edges)))
    for _ in range(2):
        gone = set(r.sample(sorted(edges), 6))
        come = {(r.randrange(70), r.randrange(70)) for _ in range(6)} - edges
        nodes = (nodes - set(r.sample(sorted(nodes), 3))) | {n for e in come for n in e if n >= 60}
        edges = {e for e in (edges - gone) | come if e[0] in nodes and e[1] in nodes}
        labels = storage.checkpointed(graph.update_components(labels, as_nodes(), frame(spark, come & edges), frame(spark, gone), frame(spark, edges)))
        assert dict(map(tuple, labels.collect())) == union_find(nodes, edges)
    same = graph.update_components(labels, as_nodes(), frame(spark, []), frame(spark, []), frame(spark, edges))
    assert dict(map(tuple, same.collect())) == union_find(nodes, edges)


def test_updated_clusters_equal_full_runs(spark):
    r = random.Random(2)
    ids = list(range(1, 50))
    links = [(r.choice(ids), r.choice(ids), r.choice(("DEPENDENCY", "SHARED_PACKAGE")), f"d{k % 3}", k) for k in range(40)]
    links = [(a, b, t, d, k if t == "DEPENDENCY" else None) for a, b, t, d, k in links if a != b]
    schema = "src long, dst long, signal_type string, description string, dependency_id long"
    as_links = lambda rows: spark.createDataFrame(rows, schema)
    as_objects = lambda: spark.createDataFrame([(n,) for n in ids], "id long")

    def full(rows):
        parts = graph.connected_components(as_objects().withColumnRenamed("id", "node"), as_links(rows)).selectExpr("node as id", "component as cluster_id")
        return parts, graph.cluster_signals(as_links(rows), parts)

    before = tuple(map(storage.checkpointed, full(links)))
    for turn in range(2):
        old = links
        ids = [n for n in ids if n not in r.sample(ids, 2)] + [100 + turn]
        links = [x for x in old if r.random() < 0.9 and x[0] in ids and x[1] in ids] + [(100 + turn, r.choice(ids[:-1]), "DEPENDENCY", "new", 1000 + turn)]
        after = tuple(map(storage.checkpointed, graph.update_clusters(before, as_links(old), as_objects(), as_links(links))))
        wanted = full(links)
        for got, want in zip(after, wanted, strict=True):
            assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
        before = after


def test_graph_jobs_broadcast_no_table(spark, monkeypatch):
    # numbering joins a row for each partition, which may be broadcast
    monkeypatch.setattr(graph, "numbered", lambda df, group, order: df.withColumn("position", F.lit(1)))
    name, found = "spark.sql.maxBroadcastTableSize", {}
    before = spark.conf.get(name)
    spark.conf.set(name, "1b")  # whatever is broadcast fails
    try:
        for query in ("g1_package_links", "g2_connected_components", "g2_update_components", "g3_cluster_signals", "g3_update_clusters"):
            found[query] = sorted(map(repr, graphs.QUERIES[query](spark, "/root/testdata/sf0.001").collect()))
    finally:
        spark.conf.set(name, before)
    assert all(found.values()) and found["g2_update_components"] == found["g2_connected_components"] and found["g3_update_clusters"] == found["g3_cluster_signals"]


def test_numbered_counts_within_groups(spark):
    rows = [(k % 3 if k % 50 else None, (k * 37) % 500) for k in range(500)]
    found = graph.numbered(spark.createDataFrame(rows, "g int, o int"), "g", ["o"]).collect()
    groups = {}
    for g, o in rows:
        groups.setdefault(g, []).append(o)
    assert {(x["g"], x["o"], x["position"]) for x in found} == {(g, o, n) for g, own in groups.items() for n, o in enumerate(sorted(own), 1)}
    assert graph.numbered(spark.createDataFrame([], "g int, o int"), "g", ["o"]).count() == 0


def test_catalog_keeps_objects_of_one_name(spark):
    rows = spark.createDataFrame([(1, 10, "SAME", None, None, None), (1, 11, "SAME", None, None, None)], "assessment_id int, id long, object_name string, application_id long, application_name string, recommendation string")
    single = dashboard.object_catalog(rows)
    assert sorted((x["label"], x["entity_id"]) for x in single.collect()) == [("SAME", 10), ("SAME", 11)]


def test_consolidate_rules(spark):
    ref = lambda n: [(f"R{n}", "E", n)]
    rules = spark.createDataFrame(
        [(1, 1, "T", "If  A", "do", "CANDIDATE", False, ref(1)), (2, 1, "T", "if a ", "DO", "CANDIDATE", True, ref(2)), (3, 1, "T", "if a", "do", "CANDIDATE", True, ref(3)), (4, 1, "T", "if b", "do", "CANDIDATE", False, ref(4)), (5, 1, "T", "if b", "do", "MERGED", False, ref(5))],
        "id long, assessment_id int, rule_type string, condition string, action string, status string, user_validated boolean, evidence_refs array<struct<ref_id:string,source_type:string,entity_id:bigint>>",
    ).selectExpr("*", "cast(null as long) as consolidated_into_id")
    rows = {r["id"]: r for r in graph.consolidate_rules(rules).collect()}
    assert (rows[1]["status"], rows[1]["consolidated_into_id"]) == ("MERGED", 2) and rows[3]["status"] == "CANDIDATE" and rows[4]["status"] == "CANDIDATE"
    assert [x["ref_id"] for x in rows[2]["evidence_refs"]] == ["R2", "R1", "R3"] and len(rows) == 5
