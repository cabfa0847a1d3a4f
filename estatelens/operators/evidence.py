"""Bounded evidence packages and their references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatelens.functions.text import short_payload
from estatelens.operators.dashboard import MATCHED, first_rows

#: Most items of each kind in an application's package (fixed values); kinds not named have no cap.
CAPS = {"DEP": 80, "ATC": 80, "TF": 60, "EVD_TECHNICAL": 40, "EVD_BUSINESS": 40}
DISCOVERY_CAPS = {"DEP": 80, "ATC": 80, "EVD": 60, "SIGNALS": 80}
#: Capabilities of the two evidence pools (fixed values).
BUSINESS_POOL = ("USAGE_SIGNAL", "PROCESS_KPI", "BUSINESS_PROCESS_SIGNAL", "USER_SIGNAL", "ROLE_SIGNAL", "AUTHORIZATION_SIGNAL")
TECHNICAL_POOL = ("TECHNICAL_OBJECT_METADATA", "SOURCE_CODE", "DEPENDENCY_SIGNAL", "S4_CONVERSION_SIGNAL")


def severity_rank(kind: Column, severity: Column) -> Column:
    """Rank of an item within its kind: ATC by priority (null 99), TF by HIGH, MEDIUM, LOW, INFO (others 9), all others alike."""
    named = F.when(severity == "HIGH", 0).when(severity == "MEDIUM", 1).when(severity == "LOW", 2).when(severity == "INFO", 3).otherwise(9)
    return F.when(kind == "ATC", F.coalesce(severity.try_cast("int"), F.lit(99))).when(kind == "TF", named).otherwise(0)


def bounded_evidence(items: DataFrame, caps: dict[str, int], partition: tuple[str, str] = ("application_id", "pool"), order: tuple[str, ...] = ("severity_rank", "entity_id")) -> tuple[DataFrame, DataFrame]:
    """(kept, omitted): of each group the first items by the order up to its pool's cap, and for each group its total and
    how many were left out. Pools without a cap are kept whole. The order should be total."""
    cap = F.lit(None).cast("long")
    for pool, n in caps.items():
        cap = F.when(F.col(partition[-1]) == pool, n).otherwise(cap)
    most = max(caps.values(), default=0)
    ranked = items.where(cap.isNotNull()).withColumn("rank", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col("rank") <= most).where(F.col("rank") <= cap)
    free = items.where(cap.isNull()).withColumn("rank", F.lit(None).cast("int"))
    totals = items.groupBy(*partition).agg(F.count(F.lit(1)).alias("total"))
    return ranked.unionByName(free), totals.withColumn("omitted", F.coalesce(F.greatest(F.col("total") - cap, F.lit(0).cast("long")), F.lit(0).cast("long")))


def split_pools(records: DataFrame) -> DataFrame:
    """Records with their pool: PROCESS_USAGE_EVIDENCE or SUPPLEMENTAL_EVIDENCE; capabilities of neither pool go."""
    pool = F.when(F.col("capability").isin(*BUSINESS_POOL), "PROCESS_USAGE_EVIDENCE").when(F.col("capability").isin(*TECHNICAL_POOL), "SUPPLEMENTAL_EVIDENCE")
    return records.withColumn("pool", pool).where("pool is not null")


def uses_process_evidence(refs: Column) -> Column:
    """Whether any ref of the array is process or usage evidence; null and empty arrays have none."""
    return F.coalesce(F.exists(refs, lambda r: r["source_type"] == "PROCESS_USAGE_EVIDENCE"), F.lit(False))


def application_items(objects: DataFrame, deps: DataFrame, findings: DataFrame, technical: DataFrame, correlations: DataFrame, records: DataFrame) -> DataFrame:
    """application_id, pool, severity_rank, entity_id, source_type and summary of everything a package may cite."""
    member = objects.where("application_id is not null").select("application_id", F.col("id").alias("object_id"), "object_name")

    def shaped(df: DataFrame, kind: Column, severity: Column, entity: str, source: Column, summary: Column) -> DataFrame:
        return df.select("application_id", kind.alias("pool"), severity_rank(kind, severity.cast("string")).alias("severity_rank"), F.col(entity).alias("entity_id"), source.alias("source_type"), summary.alias("summary"))

    none = F.lit(None).cast("string")
    parts = [shaped(member, F.lit("OBJ"), none, "object_id", F.lit("SAP_OBJECT"), F.col("object_name"))]
    own = deps.withColumnRenamed("source_object_id", "object_id").join(member, "object_id")
    parts.append(shaped(own, F.lit("DEP"), none, "id", F.lit("DEPENDENCY"), F.concat_ws(" ", "object_name", "dep_type", "target_name")))
    found = findings.select(F.col("id"), F.col("target_id").alias("object_id"), "priority", "check_title").join(member, "object_id")
    parts.append(shaped(found, F.lit("ATC"), F.col("priority"), "id", F.lit("ATC_FINDING"), F.col("check_title")))
    derived = technical.select("id", F.col("sap_object_id").alias("object_id"), "severity", "title").join(member, "object_id")
    parts.append(shaped(derived, F.lit("TF"), F.col("severity"), "id", F.lit("TECHNICAL_FINDING"), F.col("title")))
    matched = correlations.where(F.col("status").isin(*MATCHED)).select("record_id", F.col("target_id").alias("object_id")).join(member, "object_id")
    evidence = split_pools(records.select(F.col("id").alias("record_id"), "capability", "record_type", "payload")).join(matched, "record_id").withColumnRenamed("pool", "source")
    kind = F.when(F.col("source") == "PROCESS_USAGE_EVIDENCE", "EVD_BUSINESS").otherwise("EVD_TECHNICAL")
    parts.append(shaped(evidence, kind, none, "record_id", F.col("source"), F.concat_ws(": ", "record_type", short_payload(F.col("payload")))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def with_ref_ids(kept: DataFrame) -> DataFrame:
    """Items with ref_id KIND-n, counted within the application and kind by rank (entity id where there is none)."""
    place = F.row_number().over(Window.partitionBy("application_id", "pool").orderBy(F.col("rank").asc_nulls_last(), "entity_id"))
    return kept.withColumn("ref_id", F.concat_ws("-", F.split("pool", "_")[0], place.cast("string")))


def discovery_package(objects: DataFrame, signals: DataFrame, findings: DataFrame, correlations: DataFrame, records: DataFrame, caps: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, omitted) for clusters: distinct dependencies of the signals, findings by priority, matched records and the
    signals in their order, each up to its cap. signals: cluster_id, position, signal_type, dependency_id, description."""
    member = objects.select("cluster_id", F.col("id").alias("object_id"))
    deps = signals.where("dependency_id is not null").select("cluster_id", "dependency_id").distinct()
    zero = F.lit(0)
    items = deps.select("cluster_id", F.lit("DEP").alias("pool"), zero.alias("severity_rank"), F.col("dependency_id").alias("entity_id"))
    found = findings.select("id", F.col("target_id").alias("object_id"), "priority").join(member, "object_id")
    items = items.unionByName(found.select("cluster_id", F.lit("ATC").alias("pool"), F.coalesce("priority", F.lit(99)).alias("severity_rank"), F.col("id").alias("entity_id")))
    matched = correlations.where(F.col("status").isin(*MATCHED)).select(F.col("record_id").alias("id"), F.col("target_id").alias("object_id")).join(records.select("id"), "id", "left_semi").join(member, "object_id")
    items = items.unionByName(matched.select("cluster_id", F.lit("EVD").alias("pool"), zero.alias("severity_rank"), F.col("id").alias("entity_id")))
    items = items.unionByName(signals.select("cluster_id", F.lit("SIGNALS").alias("pool"), zero.alias("severity_rank"), F.col("position").cast("long").alias("entity_id")))
    return bounded_evidence(items, caps or DISCOVERY_CAPS, ("cluster_id", "pool"))


def first_rules(rules: DataFrame, n: int = 3) -> DataFrame:
    """The first n CANDIDATE rules of each object by id."""
    return first_rows(rules.where("status = 'CANDIDATE'"), ["sap_object_id"], [F.asc("id")], n)


def object_package(objects: DataFrame, findings: DataFrame, correlations: DataFrame, records: DataFrame, datasets: DataFrame) -> DataFrame:
    """object_id and items (ref_id, source_type, entity_id, summary): SRC-1, all findings, all matched records."""
    src = objects.select(F.col("id").alias("object_id"), F.lit("SRC").alias("kind"), F.col("id").alias("entity_id"), F.lit("SOURCE_CODE").alias("source_type"), F.col("object_name").alias("summary"))
    ids = objects.select(F.col("id").alias("object_id"))
    atc = findings.select(F.col("target_id").alias("object_id"), F.lit("ATC").alias("kind"), F.col("id").alias("entity_id"), F.lit("ATC_FINDING").alias("source_type"), F.concat_ws(": ", "check_title", "check_message").alias("summary")).join(ids, "object_id", "left_semi")
    sets = datasets.select(F.col("id").alias("dataset_id"), F.col("name").alias("dataset_name"))
    evd = correlations.where(F.col("status").isin(*MATCHED)).select(F.col("record_id").alias("id"), F.col("target_id").alias("object_id")).join(records, "id").join(sets, "dataset_id", "left")
    evd = evd.select("object_id", F.lit("EVD").alias("kind"), F.col("id").alias("entity_id"), F.lit("EVIDENCE_RECORD").alias("source_type"), F.concat_ws(" | ", "dataset_name", "record_type", short_payload(F.col("payload"), most=300)).alias("summary"))
    ranked = src.unionByName(atc).unionByName(evd).withColumn("n", F.row_number().over(Window.partitionBy("object_id", "kind").orderBy("entity_id")))
    order = F.when(F.col("kind") == "SRC", 0).when(F.col("kind") == "ATC", 1).otherwise(2)
    item = F.struct(order.alias("o"), "n", F.concat_ws("-", "kind", F.col("n").cast("string")).alias("ref_id"), "source_type", "entity_id", "summary")
    items = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["ref_id"].alias("ref_id"), x["source_type"].alias("source_type"), x["entity_id"].alias("entity_id"), x["summary"].alias("summary")))
    return ranked.groupBy("object_id").agg(items.alias("items"))


def resolve_refs(cited: DataFrame, package: DataFrame, key: str = "id") -> DataFrame:
    """(key, evidence_refs): cited ref ids as {ref_id, source_type, entity_id} in the order cited, unknown ones dropped.

    cited: key, refs (array of ids); package: key, ref_id, source_type, entity_id. Rows without a known ref get an empty array.
    """
    each = cited.select(key, F.posexplode("refs").alias("pos", "ref_id")).join(package.select(key, "ref_id", "source_type", "entity_id"), [key, "ref_id"])
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "ref_id", "source_type", "entity_id"))), lambda x: F.struct(x["ref_id"].alias("ref_id"), x["source_type"].alias("source_type"), x["entity_id"].alias("entity_id")))
    found = each.groupBy(key).agg(listed.alias("evidence_refs"))
    empty = F.array().cast("array<struct<ref_id:string,source_type:string,entity_id:bigint>>")
    return cited.select(key).distinct().join(found, key, "left").select(key, F.coalesce("evidence_refs", empty).alias("evidence_refs"))


def dedupe_context(items: DataFrame, key: str = "ref_id", order: str = "source_order") -> DataFrame:
    """The first item of each ref_id by source order."""
    return first_rows(items, [key], [F.asc(order)], 1)


def plan_guidance(targets: DataFrame, cache: DataFrame, providers: list[str]) -> DataFrame:
    """(assessment_id, target_type, target_id, provider, query_fingerprint, action, reuse_id) for every target and provider.

    targets: assessment_id, target_type, target_id, text; cache: id, assessment_id, target_type, target_id, provider,
    query_fingerprint. A pair that has guidance is left out; else the newest cached row of the same question, of any
    assessment, is reused; else it is to be fetched.
    """
    from estatelens.functions.text import query_fingerprint

    pairs = targets.withColumn("provider", F.explode(F.array(*map(F.lit, providers))))
    keys = ["assessment_id", "target_type", "target_id", "provider"]
    missing = pairs.join(cache.select(*keys).distinct(), keys, "left_anti").withColumn("query_fingerprint", query_fingerprint(F.col("provider"), F.col("text")))
    newest = cache.groupBy("query_fingerprint", "provider").agg(F.max("id").alias("reuse_id"))
    joined = missing.join(newest, ["query_fingerprint", "provider"], "left")
    return joined.select(*keys, "query_fingerprint", F.when(F.col("reuse_id").isNull(), "fetch").otherwise("reuse").alias("action"), "reuse_id")
