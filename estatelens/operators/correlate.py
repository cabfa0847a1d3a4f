"""Correlation of evidence with objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.functions.text import strip_all

STATUSES = ("MATCHED_EXACT", "MATCHED_HEURISTIC", "UNMATCHED", "AMBIGUOUS", "NOT_APPLICABLE")


def object_lookup(objects: DataFrame, *extra: str) -> DataFrame:
    """One row for each upper-case name (and `extra`) of an assessment: how many objects bear it, and the smallest id.

    Aggregated first, so that a join with it never multiplies a record.
    """
    keys = ["assessment_id", F.upper("object_name").alias("key_name"), *(F.upper(x).alias(f"key_{x}") for x in extra)]
    return objects.where("object_name is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("target_id"))


def correlate(records: DataFrame, objects: DataFrame, empty_status: str = "NOT_APPLICABLE", type_codes: dict[str, str] | None = None) -> DataFrame:
    """Two-tier match: adds target_id, status, method and rationale to every record.

    records: assessment_id, object_name, object_type and any others; objects: assessment_id, id, object_name,
    object_type. With a type, one object of that name and type is MATCHED_EXACT, several are AMBIGUOUS; else the name
    alone decides: one MATCHED_HEURISTIC, several AMBIGUOUS, none UNMATCHED. Records without a name get
    `empty_status` and are spread over keys that match nothing, so their number skews nothing. `type_codes` maps record types to object
    types first. Records are trimmed, objects are not; case does not count.
    """
    names = [c for c in records.columns if c not in ("target_id", "status", "method", "rationale")]
    record_type = F.upper(strip_all(F.col("object_type")))
    for code, name in (type_codes or {}).items():
        record_type = F.when(record_type == code.upper(), name.upper()).otherwise(record_type)
    keyed = records.select(*names).withColumns({"_name": F.nullif(F.upper(strip_all(F.col("object_name"))), F.lit("")), "_type": F.nullif(record_type, F.lit(""))})
    exact = object_lookup(objects, "object_type").select(F.col("assessment_id").alias("_a1"), F.col("key_name").alias("_n1"), F.col("key_object_type").alias("_t1"), F.col("n").alias("_exact"), F.col("target_id").alias("_exact_id"))
    by_name = object_lookup(objects).select(F.col("assessment_id").alias("_a2"), F.col("key_name").alias("_n2"), F.col("n").alias("_named"), F.col("target_id").alias("_named_id"))
    # rows without a name get one of many keys that no object has, so they neither match nor meet in one task
    spread = F.concat(F.lit("\0"), (F.monotonically_increasing_id() % 4096).cast("string"))
    keyed = keyed.withColumn("_key", F.coalesce("_name", spread))
    both = keyed.join(exact, (F.col("assessment_id") == F.col("_a1")) & (F.col("_key") == F.col("_n1")) & (F.col("_type") == F.col("_t1")), "left")
    both = both.join(by_name, (F.col("assessment_id") == F.col("_a2")) & (F.col("_key") == F.col("_n2")), "left")
    empty = F.col("_name").isNull()
    status = (
        F.when(empty, empty_status).when(F.col("_exact") == 1, "MATCHED_EXACT").when(F.col("_exact") > 1, "AMBIGUOUS")
        .when(F.col("_named") == 1, "MATCHED_HEURISTIC").when(F.col("_named") > 1, "AMBIGUOUS").otherwise("UNMATCHED")
    )
    target = F.when(F.col("_exact") == 1, F.col("_exact_id")).when(F.col("_exact").isNull() & (F.col("_named") == 1), F.col("_named_id"))
    method = F.when(empty, "no_object_identity").when(F.col("_exact").isNotNull(), "object_name_type_exact").otherwise("object_name_only")
    rationale = (
        F.when(empty, "record has no object name").when(F.col("_exact") == 1, "one object has this name and type").when(F.col("_exact") > 1, "several objects have this name and type")
        .when(F.col("_named") == 1, "one object has this name").when(F.col("_named") > 1, "several objects have this name").otherwise("no object has this name")
    )
    return both.select(*names, target.alias("target_id"), status.alias("status"), method.alias("method"), rationale.alias("rationale"))


def correlate_findings(findings: DataFrame, objects: DataFrame) -> DataFrame:
    """The two-tier match for findings: an empty name is UNMATCHED, and there is no method."""
    return correlate(findings, objects, empty_status="UNMATCHED").drop("method", "rationale")


def recorrelate(findings: DataFrame, objects: DataFrame) -> DataFrame:
    """Findings whose (status, target_id) would change, with the new values; others are left out."""
    old = findings.withColumnsRenamed({"status": "_old_status", "target_id": "_old_target"})
    new = correlate_findings(old, objects)
    changed = ~(F.col("status").eqNullSafe(F.col("_old_status")) & F.col("target_id").eqNullSafe(F.col("_old_target")))
    return new.where(changed).drop("_old_status", "_old_target")


def changed_names(before: DataFrame, now: DataFrame) -> DataFrame:
    """(assessment_id, key_name): the upper-case names under which other objects are found now than before.

    Compared are the lookups by name and type, a row a name, so that neither side's objects meet; what is found by the
    name alone follows from them.
    """
    keys = ["assessment_id", "key_name", "key_object_type", "n", "target_id"]
    signed = object_lookup(before, "object_type").withColumn("_n", F.lit(-1)).unionByName(object_lookup(now, "object_type").withColumn("_n", F.lit(1)))
    return signed.groupBy(*keys).agg(F.sum("_n").alias("_n")).where("_n <> 0").select("assessment_id", "key_name").distinct()


def _named(records: DataFrame, names: DataFrame, how: str) -> DataFrame:
    """The records with one of the names (left_semi) or without (left_anti); those that name nothing have none of them."""
    key = F.nullif(F.upper(strip_all(F.col("object_name"))), F.lit(""))
    spread = F.concat(F.lit("\0"), (F.monotonically_increasing_id() % 4096).cast("string"))
    keyed = records.withColumn("_key", F.coalesce(key, spread))
    wanted = names.select(F.col("assessment_id").alias("_a"), F.col("key_name").alias("_k"))
    return keyed.join(wanted, (F.col("assessment_id") == F.col("_a")) & (F.col("_key") == F.col("_k")), how).drop("_key")


def update_correlations(correlated: DataFrame, added: DataFrame, before: DataFrame, now: DataFrame, **settings) -> DataFrame:
    """What correlate(all records, now) gives, from what it gave with the objects before: records whose names are found
    otherwise now, and the added ones, are settled again; all others keep what they have and meet no lookup.

    correlated: records with target_id, status, method and rationale; added: new records. settings are those of correlate.
    """
    found = ("target_id", "status", "method", "rationale")
    names = changed_names(before, now)
    again = _named(correlated, names, "left_semi").drop(*found).unionByName(added, allowMissingColumns=True)
    return _named(correlated, names, "left_anti").unionByName(correlate(again, now, **settings).select(*correlated.columns))


def recorrelate_names(findings: DataFrame, before: DataFrame, now: DataFrame) -> DataFrame:
    """recorrelate for findings that are settled with the objects before: only those with a changed name are looked at."""
    return recorrelate(_named(findings, changed_names(before, now), "left_semi"), now)


def propagate_targets(technical: DataFrame, changed: DataFrame) -> DataFrame:
    """Derived findings with the new target of the finding they came from, where that has changed."""
    moved = changed.select(F.col("id").alias("_id"), F.col("target_id").alias("_target"))
    joined = technical.join(moved, F.col("atc_finding_id") == F.col("_id"), "left")
    return joined.withColumn("sap_object_id", F.when(F.col("_id").isNotNull(), F.col("_target")).otherwise(F.col("sap_object_id"))).select(*technical.columns)


def correlation_summary(correlations: DataFrame, *keys: str, zero_fill: bool = False, unknown: str | None = None) -> DataFrame:
    """Records per status (and keys). With zero_fill every status has a row; null status counts as `unknown` if given."""
    status: Column = F.coalesce("status", F.lit(unknown)) if unknown else F.col("status")
    counts = correlations.groupBy(*keys, status.alias("status")).agg(F.count(F.lit(1)).alias("n"))
    if not zero_fill:
        return counts
    pairs = counts.select(*keys).distinct() if keys else counts.sparkSession.range(1).select()
    every = pairs.select(*keys, F.explode(F.array(*map(F.lit, STATUSES))).alias("status"))
    joined = every.join(counts, [*keys, "status"], "left")
    return joined.select(*keys, "status", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def object_evidence(correlations: DataFrame, records: DataFrame, datasets: DataFrame, object_id: int | None = None) -> DataFrame:
    """Every correlation of an object (of all objects if none is given) with its record and data set, whatever its status."""
    own = correlations.where("target_id is not null" if object_id is None else F.col("target_id") == object_id)
    recs = records.select(F.col("id").alias("record_id"), "dataset_id", "record_type", "capability")
    sets = datasets.select(F.col("id").alias("dataset_id"), F.col("name").alias("dataset_name"))
    return own.select("record_id", "target_id", "status", "method").join(recs, "record_id").join(sets, "dataset_id")


def details_to_parent(details: DataFrame, issues: DataFrame, key: str = "DETAILS_REF") -> DataFrame:
    """(detail_id, issue_id): details with the issue of the same data set that has the same reference in its payload."""
    left = details.select("dataset_id", F.col("id").alias("detail_id"), F.try_element_at("payload", F.lit(key)).alias("ref"))
    right = issues.select("dataset_id", F.col("id").alias("issue_id"), F.try_element_at("payload", F.lit(key)).alias("ref"))
    return left.join(right, ["dataset_id", "ref"]).select("dataset_id", "detail_id", "issue_id", "ref")
