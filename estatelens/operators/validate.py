"""Validation of model outputs against the evidence they were given (V4-V7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.functions.text import strip_all

DIMENSIONS = ("technical_risk", "business_importance", "recommendation")


def unknown_refs(cited: Column, known: Column) -> Column:
    """Cited refs that the package does not hold, sorted and once each."""
    return F.array_sort(F.array_except(F.coalesce(cited, F.array().cast("array<string>")), F.coalesce(known, F.array().cast("array<string>"))))


def filled(text: Column) -> Column:
    return F.coalesce(strip_all(text) != "", F.lit(False))


def _errors(*checks: tuple[Column, Column | str]) -> Column:
    return F.array_compact(F.array(*(F.when(wrong, F.lit(said) if isinstance(said, str) else said) for wrong, said in checks)))


def validate_refs(results: DataFrame, required_text: list[str], refs: str = "evidence_refs", known: str = "known_refs", need_refs: bool = True) -> DataFrame:
    """Add `errors`: refs outside the package, required texts that are blank, and missing refs of a COMPLETED result."""
    unknown = unknown_refs(F.col(refs), F.col(known))
    done = F.col("status") == "COMPLETED" if "status" in results.columns else F.lit(True)
    checks: list[tuple[Column, Column | str]] = [(F.size(unknown) > 0, F.concat(F.lit("unknown refs: "), F.array_join(unknown, ",")))]
    checks += [(done & ~filled(F.col(c)), f"{c} must not be empty") for c in required_text]
    if need_refs:
        checks.append((done & (F.coalesce(F.size(refs), F.lit(0)) <= 0), "at least one ref is needed"))
    return results.withColumn("errors", _errors(*checks))


def keep_known(cited: Column, pool: Column) -> Column:
    """Cited refs that lie in the pool, once each, in the order cited."""
    return F.array_distinct(F.filter(F.coalesce(cited, F.array().cast("array<string>")), lambda r: F.array_contains(pool, r)))


def sanitize_assessment(results: DataFrame) -> DataFrame:
    """Results with refs outside each dimension's pool dropped.

    Columns: for each dimension its value, `_rationale` and `_evidence_refs`; technical_refs, business_refs and
    guidance_refs (the package's pools); status. A dimension that loses all refs loses its value; risk and importance
    without a value lose rationale and refs as well, a recommendation only its refs. The status is COMPLETED if
    any dimension keeps a value.
    """
    every = F.array_union(F.array_union("technical_refs", "business_refs"), F.col("guidance_refs"))
    pools = {"technical_risk": F.col("technical_refs"), "business_importance": F.array_union("business_refs", "guidance_refs"), "recommendation": every}
    out = results.withColumns({f"{d}_evidence_refs": keep_known(F.col(f"{d}_evidence_refs"), pool) for d, pool in pools.items()})
    out = out.withColumns({d: F.when(F.size(f"{d}_evidence_refs") > 0, F.col(d)) for d in DIMENSIONS})
    cleared = {f"{d}_evidence_refs": F.when(F.col(d).isNull(), F.array().cast("array<string>")).otherwise(F.col(f"{d}_evidence_refs")) for d in DIMENSIONS}
    cleared |= {f"{d}_rationale": F.when(F.col(d).isNull(), F.lit("")).otherwise(F.col(f"{d}_rationale")) for d in DIMENSIONS[:2]}
    out = out.withColumns(cleared)
    return out.withColumn("status", F.when(F.coalesce(*DIMENSIONS).isNotNull(), "COMPLETED").otherwise("INSUFFICIENT_CONTEXT"))


def validate_assessment(results: DataFrame) -> DataFrame:
    """Add `errors`: refs outside the pools, values without rationale or refs, leftovers of null values, wrong status."""
    business = F.array_union("business_refs", "guidance_refs")
    pools = {"technical_risk": F.col("technical_refs"), "business_importance": business, "recommendation": F.array_union("technical_refs", business)}
    checks: list[tuple[Column, Column | str]] = []
    for d, pool in pools.items():
        unknown = unknown_refs(F.col(f"{d}_evidence_refs"), pool)
        checks.append((F.size(unknown) > 0, F.concat(F.lit(f"{d}_evidence_refs outside the pool: "), F.array_join(unknown, ","))))
    for d in DIMENSIONS:
        given, cited = F.col(d).isNotNull(), F.coalesce(F.size(f"{d}_evidence_refs"), F.lit(0)) > 0
        checks.append((given & ~filled(F.col(f"{d}_rationale")), f"{d} needs a rationale"))
        checks.append((given & ~cited, f"{d} needs a ref"))
        left = cited if d == "recommendation" else cited | filled(F.col(f"{d}_rationale"))
        checks.append((~given & left, f"{d} is null but has a rationale or refs"))
    wanted = F.when(F.coalesce(*DIMENSIONS).isNotNull(), "COMPLETED").otherwise("INSUFFICIENT_CONTEXT")
    checks.append((~F.col("status").eqNullSafe(wanted), "status does not fit the values"))
    return results.withColumn("errors", _errors(*checks))


def sanitize_answer(answers: DataFrame) -> DataFrame:
    """Answers (status, refs, navigation: arrays of ref ids; known_refs) without unknown refs and navigation; an
    INSUFFICIENT answer loses all."""
    none = F.array().cast("array<string>")
    short = F.col("status").startswith("INSUFFICIENT")
    return answers.withColumns({c: F.when(short, none).otherwise(keep_known(F.col(c), F.col("known_refs"))) for c in ("refs", "navigation")})
