"""Graph jobs: connected components by alternating stars, and what stands on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estatelens.functions.text import canonical_key, normalize_rule_text
from estatelens.storage import checkpointed


def sorted_side(df: DataFrame) -> DataFrame:
    """df as a side of a join that is sorted and merged whatever Spark takes df's size for.

    Sizes are guessed by the packed files that rows came from, tens of times too small for keys and labels, so tables that
    grow with the graph would be broadcast, whole, through the driver.
    """
    return df.hint("merge")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u > v): every node's smallest neighbour becomes the neighbour of its other ones.

    The large star links the larger neighbours, the small star the smaller ones and the node itself. The smallest
    neighbour is aggregated before it is joined back, so a hub adds rows to neither side.
    """
    around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = around.join(sorted_side(least), "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
    return moved.where("u > v").distinct()


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) with component = the smallest node that can be reached.

    nodes: column `node`; edges: `src`, `dst`, in any direction, repeated edges and self edges allowed. Nodes without
    edges are their own component; edges with a null end, or whose ends are missing from `nodes`, only add what they
    link. Null nodes give one row with a null component. Raises if the stars are still changing after `max_rounds`.
    """
    clean = edges.where("src is not null and dst is not null and src <> dst")
    current = checkpointed(clean.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        now = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        current = checkpointed(_star(_star(current, large=True), large=False))
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    labels = current.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.select("node").distinct().join(sorted_side(labels), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def update_components(labels: DataFrame, nodes: DataFrame, added: DataFrame, removed: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) after a change, from the labels before it: what connected_components(nodes, edges) gives.

    added and removed are the edges that came and went, edges all there are now; ends that are missing from `nodes` are
    left out (an edge between other nodes links nothing). A component that lost no edge and no node stays one node of the
    graph that is walked, with its label; only the others fall apart into their nodes and take their edges with them. So the
    rounds follow the change; of the rest a label is looked up once.
    """
    known, labels = sorted_side(nodes.select("node").distinct()), sorted_side(labels)
    lost_ends = removed.select(F.explode(F.array("src", "dst")).alias("node")).join(labels, "node").select("component")
    lost_nodes = labels.join(known, "node", "left_anti").select("component")
    broken = checkpointed(lost_ends.unionByName(lost_nodes).where("component is not null").distinct())
    loose = labels.join(sorted_side(broken), "component", "left_semi").select("node")
    new = known.join(labels.select("node"), "node", "left_anti")
    single = loose.unionByName(new).where("node is not null").join(known, "node", "left_semi").distinct()
    # the graph's nodes: loose and new ones themselves, all others by their labels
    stands = checkpointed(labels.join(sorted_side(broken), "component", "left_anti").select("node", F.col("component").alias("stand")).unionByName(single.select("node", F.col("node").alias("stand"))))
    inner = edges.join(sorted_side(single.withColumnRenamed("node", "src")), "src", "left_semi").unionByName(edges.join(sorted_side(single.withColumnRenamed("node", "dst")), "dst", "left_semi").select(*edges.columns))
    links = added.select("src", "dst").unionByName(inner.select("src", "dst")).where("src is not null and dst is not null and src <> dst").distinct()
    ends = links.join(sorted_side(stands.select(F.col("node").alias("src"), F.col("stand").alias("_a"))), "src").join(sorted_side(stands.select(F.col("node").alias("dst"), F.col("stand").alias("_b"))), "dst").select(F.col("_a").alias("src"), F.col("_b").alias("dst"))
    met = checkpointed(ends.where("src <> dst").distinct())
    moved = connected_components(met.select(F.explode(F.array("src", "dst")).alias("node")), met).select(F.col("node").alias("stand"), F.col("component").alias("_to"))
    out = stands.join(sorted_side(moved), "stand", "left").select("node", F.coalesce("_to", "stand").alias("component"))
    return out.unionByName(known.where("node is null").select("node", F.lit(None).cast(labels.schema["component"].dataType).alias("component")))


def resolve_dependencies(deps: DataFrame, objects: DataFrame) -> DataFrame:
    """Dependencies with target_id: by canonical key if the target is typed, else the smallest id of that upper-case name
    in the assessment. Unresolved and self dependencies go.

    deps: id, assessment_id, source_object_id, target_name, target_type; objects: id, assessment_id, object_name, canonical_key.
    """
    by_key = objects.groupBy(F.col("assessment_id").alias("_a1"), F.col("canonical_key").alias("_key")).agg(F.min("id").alias("_by_key"))
    by_name = objects.groupBy(F.col("assessment_id").alias("_a2"), F.upper("object_name").alias("_name")).agg(F.min("id").alias("_by_name"))
    keyed = deps.withColumn("_target_key", canonical_key(F.col("target_type"), F.col("target_name")))
    joined = keyed.join(sorted_side(by_key), (F.col("assessment_id") == F.col("_a1")) & (F.col("_target_key") == F.col("_key")), "left").join(sorted_side(by_name), (F.col("assessment_id") == F.col("_a2")) & (F.upper("target_name") == F.col("_name")), "left")
    found = joined.withColumn("target_id", F.coalesce("_by_key", "_by_name")).where("target_id is not null and target_id <> source_object_id")
    return found.select(*deps.columns, "target_id")


def package_links(objects: DataFrame, findings: DataFrame, correlations: DataFrame, records: DataFrame) -> DataFrame:
    """(src, dst, package_name) stars: the smallest object of each package with every other one.

    Packages come from findings and from matched records; a star has one edge fewer than the package has objects, so a
    large package never becomes all its pairs.
    """
    of_findings = findings.where("target_id is not null").select(F.col("target_id").alias("id"), "package_name")
    matched = correlations.where("status in ('MATCHED_EXACT', 'MATCHED_HEURISTIC')").select("record_id", F.col("target_id").alias("id"))
    of_records = matched.join(sorted_side(records.select(F.col("id").alias("record_id"), "package_name")), "record_id").select("id", "package_name")
    members = of_findings.unionByName(of_records).where("package_name is not null and package_name <> ''").distinct().join(sorted_side(objects.select("id", "assessment_id")), "id")
    anchors = members.groupBy("assessment_id", "package_name").agg(F.min("id").alias("src"))
    return members.join(sorted_side(anchors), ["assessment_id", "package_name"]).where("id <> src").select("src", F.col("id").alias("dst"), "package_name")


def cluster_links(objects: DataFrame, deps: DataFrame, packages: DataFrame) -> DataFrame:
    """src, dst, signal_type, description, dependency_id: the resolved dependencies and the package stars, written once, since
    clusters go through them many times."""
    resolved = resolve_dependencies(deps, objects).select(F.col("source_object_id").alias("src"), F.col("target_id").alias("dst"), F.lit("DEPENDENCY").alias("signal_type"), F.concat_ws(" ", "dep_type", "target_name").alias("description"), F.col("id").alias("dependency_id"))
    return checkpointed(resolved.unionByName(packages.select("src", "dst", F.lit("SHARED_PACKAGE").alias("signal_type"), F.col("package_name").alias("description"), F.lit(None).cast("long").alias("dependency_id"))))


def build_clusters(objects: DataFrame, deps: DataFrame, packages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, signals): id, cluster_id of every object, and every link inside a cluster.

    Links are the resolved dependencies and the package stars; a cluster's id is its smallest object. Signals keep
    parallel links and are numbered pair by pair in the order in which a pair was first linked, dependencies before packages.
    """
    links = cluster_links(objects, deps, packages)
    parts = connected_components(objects.select(F.col("id").alias("node")), links).select(F.col("node").alias("id"), F.col("component").alias("cluster_id"))
    return parts, cluster_signals(links, parts)


def cluster_signals(links: DataFrame, parts: DataFrame) -> DataFrame:
    """Every link inside a cluster (id, cluster_id), numbered as build_clusters says."""
    inside = links.join(sorted_side(parts.withColumnRenamed("id", "src")), "src")
    pair = [F.least("src", "dst"), F.greatest("src", "dst")]
    turn = F.struct((F.col("signal_type") != "DEPENDENCY").alias("late"), F.coalesce("dependency_id", F.lit(0).cast("long")).alias("d"), F.col("description").alias("p"))
    placed = inside.withColumns({"_a": pair[0], "_b": pair[1], "_turn": turn})
    firsts = placed.groupBy("_a", "_b").agg(F.min("_turn").alias("_first"))
    signals = numbered(placed.join(sorted_side(firsts), ["_a", "_b"]), "cluster_id", ["_first", "_a", "_b", "_turn"])
    return signals.select("cluster_id", "position", "signal_type", "src", "dst", "description", "dependency_id")


def update_clusters(before: tuple[DataFrame, DataFrame], links_before: DataFrame, objects: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, signals) of build_clusters after a rerun, from those before it; links are those of cluster_links then and now.

    Clusters none of whose links and objects came or went keep members and signals as they are; the others are walked and
    numbered anew.
    """
    members, signals = before
    known = checkpointed(links.join(sorted_side(objects.select(F.col("id").alias("src"))), "src", "left_semi").join(sorted_side(objects.select(F.col("id").alias("dst"))), "dst", "left_semi").select(*links.columns))
    # links are counted, since parallel ones may be equal
    diff = links_before.withColumn("_n", F.lit(-1)).unionByName(known.withColumn("_n", F.lit(1))).groupBy(*links.columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    changed = checkpointed(diff)
    labels = members.select(F.col("id").alias("node"), F.col("cluster_id").alias("component"))
    nodes = objects.select(F.col("id").alias("node"))
    # an edge is gone if none of the links between its ends is left
    ends = ["src", "dst"]
    removed = changed.where("_n < 0").select(*ends).distinct().join(sorted_side(known.select(*ends)), ends, "left_anti")
    parts = checkpointed(update_components(labels, nodes, changed.where("_n > 0").select(*ends), removed, known.select(*ends)))
    touched = changed.select(F.explode(F.array(*ends)).alias("node")).unionByName(labels.join(sorted_side(nodes), "node", "left_anti").select("node"))
    old = checkpointed(labels.join(sorted_side(touched.distinct()), "node", "left_semi").select("component").distinct())
    again = labels.join(sorted_side(old), "component", "left_semi").select("node").unionByName(nodes.join(sorted_side(labels), "node", "left_anti")).distinct()
    renewed = checkpointed(parts.join(sorted_side(again), "node", "left_semi").select(F.col("node").alias("id"), F.col("component").alias("cluster_id")))
    kept = signals.join(sorted_side(old.withColumnRenamed("component", "cluster_id")), "cluster_id", "left_anti").select(*signals.columns)
    return parts.select(F.col("node").alias("id"), F.col("component").alias("cluster_id")), kept.unionByName(cluster_signals(known, renewed))


def numbered(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """df with `position`, counted from 1 within each group by the order, which should be total.

    The rows are sorted over ranges of group and order; a range's base is the sum of the ranges before it and a group's the
    smallest number in it, so a group of any size is dealt over many tasks.
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = checkpointed(df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumns({"_part": F.spark_partition_id(), "_row": row}))
    bases, total = [], 0
    for part, n in sorted(map(tuple, dealt.groupBy("_part").agg(F.count(F.lit(1))).collect())):  # a row for each partition
        bases.append((part, total))
        total += n
    placed = dealt.join(df.sparkSession.createDataFrame(bases, "_part int, _base long"), "_part").withColumn("_row", F.col("_row") + F.col("_base"))
    starts = checkpointed(placed.groupBy(F.col(group).alias("_group")).agg(F.min("_row").alias("_start")))
    joined = placed.join(sorted_side(starts), F.col(group).eqNullSafe(F.col("_group")))
    return joined.withColumn("position", F.col("_row") - F.col("_start") + 1).drop("_part", "_row", "_base", "_group", "_start")


def assign_applications(clusters: DataFrame, objects: DataFrame, apps: DataFrame) -> DataFrame:
    """(assessment_id, cluster_id, application_id, is_new): old applications carried over to clusters.

    A cluster that touches a USER_RENAMED or MERGED application is left out. The others, by ascending id, take the
    application with which they share most members (ties: smaller id) if that is at least half of them and no
    earlier cluster took it; else they are new, with an id made from the cluster. clusters: id, cluster_id; objects:
    id, assessment_id, application_id. At most two applications can be wanted by a cluster.
    """
    members = clusters.join(objects.select("id", "assessment_id", "application_id"), "id")
    kept = apps.where("status in ('USER_RENAMED', 'MERGED')").select(F.col("id").alias("application_id"))
    touched = members.join(kept, "application_id", "left_semi").select("assessment_id", "cluster_id").distinct()
    free = members.join(touched, ["assessment_id", "cluster_id"], "left_anti")
    sizes = free.groupBy("assessment_id", "cluster_id").agg(F.count(F.lit(1)).alias("size"))
    known = apps.where("status not in ('USER_RENAMED', 'MERGED')").select(F.col("id").alias("application_id"))
    shared = free.join(known, "application_id", "left_semi").groupBy("assessment_id", "cluster_id", "application_id").agg(F.count(F.lit(1)).alias("n"))
    wanted = checkpointed(shared.join(sizes, ["assessment_id", "cluster_id"]).where("n * 2 >= size"))  # two a cluster at most
    choice = Window.partitionBy("assessment_id", "cluster_id").orderBy(F.desc("n"), "application_id")
    wishes = wanted.withColumn("wish", F.row_number().over(choice)).groupBy("assessment_id", "cluster_id")
    claims = _settle_claims(wishes.agg(*(F.max(F.when(F.col("wish") == k, F.col("application_id"))).alias(c) for k, c in ((1, "one"), (2, "two")))))
    every = sizes.join(claims, ["assessment_id", "cluster_id"], "left")
    return every.select("assessment_id", "cluster_id", F.coalesce("application_id", F.xxhash64("assessment_id", "cluster_id")).alias("application_id"), F.col("application_id").isNull().alias("is_new"))


def _settle_claims(wishes: DataFrame) -> DataFrame:
    """(assessment_id, cluster_id, application_id) of the clusters (assessment_id, cluster_id, one, two) that get one of their
    wishes, as if they took turns by cluster_id.

    An application keeps the smallest of all that come to ask. Of those that ask it first only the smallest, its holder, can
    stay; the others go on to their second wish at once. A holder goes on if a smaller cluster comes to its application,
    and is then one that comes to the next: so holders form chains, along which it counts whether the one before is sent
    away and smaller. Whether a chain's cause reaches an application is found by pointer doubling, in rounds that grow with the
    logarithm of the longest chain.
    """
    who = F.struct("cluster_id", "assessment_id")
    asking = checkpointed(wishes.select(who.alias("who"), "one", "two"))
    held = checkpointed(asking.groupBy(F.col("one").alias("app")).agg(F.min("who").alias("holder"), F.min_by("two", "who").alias("next")))
    sent = asking.join(held, F.col("one") == F.col("app")).where("who <> holder and two is not null").groupBy(F.col("two").alias("app")).agg(F.min("who").alias("comes"))
    sent = checkpointed(sent)
    following = held.select(F.col("app").alias("_app"), F.col("holder").alias("_holder"))
    chain = held.join(sent, "app", "left").join(following, F.col("next") == F.col("_app"), "left")
    state = checkpointed(chain.select("app", F.coalesce(F.col("comes") < F.col("holder"), F.lit(False)).alias("leaves"), F.when(F.col("holder") < F.col("_holder"), F.col("next")).alias("to")))
    while not state.where("to is not null").isEmpty():
        reached = state.where("leaves and to is not null").select(F.col("to").alias("app"), F.lit(True).alias("_reached")).distinct()
        hop = state.where("to is not null").select(F.col("app").alias("to"), F.col("to").alias("_next"))
        joined = state.join(reached, "app", "left").join(hop, "to", "left")
        state = checkpointed(joined.select("app", (F.col("leaves") | F.coalesce("_reached", F.lit(False))).alias("leaves"), F.col("_next").alias("to")))
    left = held.join(state.where("leaves").select("app"), "app", "left_semi").where("next is not null").select(F.col("next").alias("app"), F.col("holder").alias("comes"))
    takers = held.select("app", F.col("holder").alias("comes")).unionByName(sent).unionByName(left).groupBy("app").agg(F.min("comes").alias("taker"))
    return takers.select("taker.assessment_id", "taker.cluster_id", F.col("app").alias("application_id"))


def drop_empty_applications(apps: DataFrame, objects: DataFrame, embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(applications, embeddings) without applications that have no members and are neither renamed nor merged."""
    used = objects.where("application_id is not null").select(F.col("application_id").alias("id")).distinct()
    empty = apps.where("status not in ('USER_RENAMED', 'MERGED')").join(used, "id", "left_anti").select("id")
    gone = empty.select(F.col("id").alias("entity_id"), F.lit("APPLICATION").alias("entity_type"))
    return apps.join(empty, "id", "left_anti").select(*apps.columns), embeddings.join(gone, ["entity_id", "entity_type"], "left_anti").select(*embeddings.columns)


def consolidate_rules(rules: DataFrame) -> DataFrame:
    """Rules with duplicates merged: same assessment, type and normalised condition and action.

    The survivor is the first user-validated rule, else the one with the smallest id; it takes over the others' refs
    (consolidated_refs has them as rows). Other rules become MERGED with consolidated_into_id, but validated ones stay as
    they are. Merged rules are not looked at again.
    """
    placed = _survivors(rules)
    refs = consolidated_refs(rules, placed)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("seen", "ref_id", "source_type", "entity_id"))), lambda x: F.struct(x["ref_id"].alias("ref_id"), x["source_type"].alias("source_type"), x["entity_id"].alias("entity_id")))
    folded = refs.groupBy(F.col("id").alias("_id")).agg(listed.alias("_refs"))
    return _pointed(rules, placed.join(folded, F.col("id") == F.col("_id"), "left").withColumn("evidence_refs", F.when(F.col("id") == F.col("_survivor"), F.coalesce("_refs", "evidence_refs")).otherwise(F.col("evidence_refs"))))


def consolidated_status(rules: DataFrame) -> DataFrame:
    """consolidate_rules without folding: refs stay where they are, and no row grows with its group."""
    return _pointed(rules, _survivors(rules))


def consolidated_refs(rules: DataFrame, placed: DataFrame | None = None) -> DataFrame:
    """(id, ref_id, source_type, entity_id, seen): the refs of every survivor, one row each; `seen` orders them, its own first."""
    placed = _survivors(rules) if placed is None else placed
    each = placed.select(F.col("_survivor").alias("id"), (F.col("id") != F.col("_survivor")).alias("turn"), F.col("id").alias("by"), F.posexplode("evidence_refs").alias("pos", "ref"))
    return each.groupBy("id", "ref.ref_id", "ref.source_type", "ref.entity_id").agg(F.min(F.struct("turn", "by", "pos")).alias("seen"))


def _survivors(rules: DataFrame) -> DataFrame:
    """The rules that are not merged with `_survivor`: the smallest of each group is aggregated before it is joined back."""
    text = F.sha2(F.concat_ws("\0", "rule_type", normalize_rule_text(F.col("condition")), normalize_rule_text(F.col("action"))), 256)
    live = rules.where("status <> 'MERGED'").withColumn("_same", F.concat_ws(":", F.col("assessment_id").cast("string"), text))
    first = checkpointed(live.groupBy("_same").agg(F.min(F.struct((~F.coalesce("user_validated", F.lit(False))).alias("open"), "id")).alias("_first")))
    return live.join(first, "_same").withColumn("_survivor", F.col("_first.id")).drop("_same", "_first")


def _pointed(rules: DataFrame, placed: DataFrame) -> DataFrame:
    loses = (F.col("id") != F.col("_survivor")) & ~F.coalesce("user_validated", F.lit(False))
    changed = placed.withColumns({"status": F.when(loses, "MERGED").otherwise(F.col("status")), "consolidated_into_id": F.when(loses, F.col("_survivor")).otherwise(F.col("consolidated_into_id"))})
    return changed.select(*rules.columns).unionByName(rules.where("status = 'MERGED'"))


def inbound_counts(objects: DataFrame, deps: DataFrame) -> DataFrame:
    """(id, n_inbound) of every object: resolved dependencies that point at it; 0 means unreferenced."""
    counts = resolve_dependencies(deps, objects).groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("n_inbound"))
    return objects.select("id").join(counts, "id", "left").select("id", F.coalesce("n_inbound", F.lit(0).cast("long")).alias("n_inbound"))
