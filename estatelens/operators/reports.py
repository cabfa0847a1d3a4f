"""Report queries over findings and dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.graph import inbound_counts


def findings_by(findings: DataFrame, column: str, assessment_id: int | None = None) -> DataFrame:
    """Findings, and the distinct objects they hit, for each value of a column (note, object, package, component)."""
    rows = findings if assessment_id is None else findings.where(F.col("assessment_id") == assessment_id)
    return rows.groupBy("assessment_id", column).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("target_id").alias("n_objects"))


def findings_by_change(findings: DataFrame, column: str = "referenced_object_name", categories: tuple[str, ...] = ("A", "T", "F")) -> DataFrame:
    """One row for each referenced object with a count for each change category."""
    return findings.groupBy("assessment_id", column).pivot("change_category", list(categories)).agg(F.count(F.lit(1))).na.fill(0, list(categories))


def run_delta(findings: DataFrame, run_before: int, run_after: int) -> DataFrame:
    """Change between two runs for each (object_name, check_title, priority) that either has: before, after, delta."""
    own = findings.where(F.col("run_id").isin(run_before, run_after))
    counted = own.groupBy("object_name", "check_title", "priority").agg(F.count_if(F.col("run_id") == run_before).alias("n_before"), F.count_if(F.col("run_id") == run_after).alias("n_after"))
    return counted.withColumn("delta", F.col("n_after") - F.col("n_before"))


def objects_with_checks(findings: DataFrame, titles: list[str]) -> DataFrame:
    """Objects with a finding under one of the titles (changed tables, performance and the like)."""
    return findings.where(F.col("check_title").isin(*titles) & F.col("target_id").isNotNull()).select("assessment_id", F.col("target_id").alias("object_id")).distinct()


def upgrade_risk(findings: DataFrame, change_category: str | None = None) -> DataFrame:
    """Priority-1 findings of each object; with a change category only those of it."""
    rows = findings.where("priority = 1 and target_id is not null")
    rows = rows if change_category is None else rows.where(F.col("change_category") == change_category)
    return rows.groupBy("assessment_id", F.col("target_id").alias("object_id")).agg(F.count(F.lit(1)).alias("n"))


def retire_candidates(objects: DataFrame, deps: DataFrame, findings: DataFrame) -> DataFrame:
    """Objects that nothing points at and that have priority-1 findings, with their number."""
    risky = upgrade_risk(findings).select(F.col("object_id").alias("id"), F.col("n").alias("n_critical"))
    return inbound_counts(objects, deps).where("n_inbound = 0").join(risky, "id").select("id", "n_critical")


def programs_in_use(objects: DataFrame, deps: DataFrame) -> DataFrame:
    """Objects that something points at, with how many dependencies do."""
    return inbound_counts(objects, deps).where("n_inbound > 0")


def users_of(deps: DataFrame, target_name: str) -> DataFrame:
    """Objects with a dependency on a name, in any case."""
    return deps.where(F.upper("target_name") == target_name.upper()).select("assessment_id", "source_object_id", "dep_type").distinct()
