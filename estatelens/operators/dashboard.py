"""Filters, KPIs and lists of the dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatelens.functions.text import is_custom_object, strip_all
from estatelens.operators.changes import latest_per_key
from estatelens.operators.search import narrowed

MATCHED = ("MATCHED_EXACT", "MATCHED_HEURISTIC")
HIGH = ("HIGH", "CRITICAL")


def of(df: DataFrame, assessment_id: int | None) -> DataFrame:
    return df if assessment_id is None else df.where(F.col("assessment_id") == assessment_id)


def current_scan(scans: DataFrame, assessment_id: int | None = None) -> DataFrame:
    """The latest COMPLETED scan of each assessment; one without completed_at counts as later than all (ties: larger id)."""
    return latest_per_key(of(scans, assessment_id).where("status = 'COMPLETED'"), ["assessment_id"], [F.desc_nulls_first("completed_at"), F.desc("id")])


def current_atc_run(runs: DataFrame, assessment_id: int | None = None) -> DataFrame:
    """The latest run of each assessment by imported_at (null first), then id."""
    return latest_per_key(of(runs, assessment_id), ["assessment_id"], [F.desc_nulls_first("imported_at"), F.desc("id")])


def current_objects(objects: DataFrame, files: DataFrame, scans: DataFrame, assessment_id: int | None = None) -> DataFrame:
    """Objects whose file belongs to the current scan."""
    scan = current_scan(scans, assessment_id).select(F.col("id").alias("scan_id"))
    own = files.join(scan, "scan_id", "left_semi").select(F.col("id").alias("source_file_id"))
    return objects.join(own, "source_file_id", "left_semi").select(*objects.columns)


def like(q: str | None, *columns: str) -> Column:
    """Case-insensitive substring search over any of the columns; % and _ in the text keep their meaning."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.col(c).ilike(f"%{q}%"), F.lit(False))
    return F.lit(True) if not q else found


def filter_objects(drilldown: DataFrame, object_type: str | None = None, recommendation: str | None = None, custom_only: bool = False, high_impact: bool = False, application_id: int | None = None, usage_level: str | None = None, q: str | None = None, assessment_id: int | None = None, index: DataFrame | None = None) -> DataFrame:
    """Rows of the object list that pass all given filters; recommendation UNCLASSIFIED means null.

    index, here and in the other filters: a search.text_index of the ids and the columns that are searched, which picks the
    rows that the text is looked for in; the result is the same without.
    """
    rows = narrowed(of(drilldown, assessment_id), "id", q, index).where(like(q, "object_name", "description") if "description" in drilldown.columns else like(q, "object_name"))
    for column, value in (("object_type", object_type), ("application_id", application_id), ("usage_level", usage_level)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    if recommendation is not None:
        rows = rows.where("recommendation is null" if recommendation == "UNCLASSIFIED" else F.col("recommendation") == recommendation)
    rows = rows.where("is_custom") if custom_only else rows
    return rows.where(F.col("technical_risk").isin(*HIGH)) if high_impact else rows


def filter_findings(findings: DataFrame, runs: DataFrame, priority: int | None = None, object_id: int | None = None, q: str | None = None, assessment_id: int | None = None, index: DataFrame | None = None) -> DataFrame:
    """Findings of the current run by priority, object, and text over title, message and name."""
    run = current_atc_run(runs, assessment_id).select(F.col("id").alias("run_id"))
    rows = narrowed(findings, "id", q, index).join(run, "run_id", "left_semi").where(like(q, "check_title", "check_message", "object_name"))
    rows = rows if priority is None else rows.where(F.col("priority") == priority)
    return rows if object_id is None else rows.where(F.col("target_id") == object_id)


def filter_rules(rules: DataFrame, object_id: int | None = None, include_merged: bool = False, rule_type: str | None = None, q: str | None = None, assessment_id: int | None = None, index: DataFrame | None = None) -> DataFrame:
    """Rules without the merged ones (unless asked for), by object, type, and text over condition and action."""
    rows = narrowed(of(rules, assessment_id), "id", q, index).where(like(q, "condition", "action"))
    rows = rows if include_merged else rows.where("status <> 'MERGED'")
    rows = rows if object_id is None else rows.where(F.col("sap_object_id") == object_id)
    return rows if rule_type is None else rows.where(F.col("rule_type") == rule_type)


def filter_applications(apps: DataFrame, objects: DataFrame, assessments: DataFrame, include_merged: bool = False, recommendation: str | None = None, q: str | None = None, assessment_id: int | None = None, index: DataFrame | None = None) -> DataFrame:
    """Applications that have members and are not merged (all, with include_merged), by recommendation and text."""
    rows = narrowed(of(apps, assessment_id), "id", q, index).where(like(q, "name", "domain", "description"))
    if not include_merged:
        rows = rows.where("status <> 'MERGED'").join(objects.select(F.col("application_id").alias("id")).distinct(), "id", "left_semi")
    given = assessments.select(F.col("application_id").alias("id"), "recommendation")
    rows = rows.join(given, "id", "left")
    if recommendation is None:
        return rows
    return rows.where("recommendation is null" if recommendation == "UNCLASSIFIED" else F.col("recommendation") == recommendation)


def matched_only(correlations: DataFrame) -> DataFrame:
    return correlations.where(F.col("status").isin(*MATCHED))


def usage_rows(correlations: DataFrame, records: DataFrame) -> DataFrame:
    """(object_id, usage_level) of matched usage records; a record without a usage level (a sizing row) is none."""
    level = F.try_element_at("payload", F.lit("USAGE LEVEL"))
    used = records.where("capability = 'USAGE_SIGNAL'").where(level.isNotNull()).select(F.col("id").alias("record_id"), level.alias("usage_level"))
    return matched_only(correlations).select("record_id", F.col("target_id").alias("object_id")).join(used, "record_id").select("object_id", "usage_level")


def list_assessments(assessments: DataFrame, clients: DataFrame, client_id: int | None = None, name: str | None = None, index: DataFrame | None = None) -> DataFrame:
    """Assessments with their client's name, by client and text, newest id first."""
    rows = narrowed(assessments, "id", name, index).where(like(name, "name")).join(clients.select(F.col("id").alias("client_id"), F.col("name").alias("client_name")), "client_id", "left")
    return (rows if client_id is None else rows.where(F.col("client_id") == client_id)).orderBy(F.desc("id"))


def list_files(files: DataFrame, scan_id: int | None = None) -> DataFrame:
    return (files if scan_id is None else files.where(F.col("scan_id") == scan_id)).orderBy("scan_id", "rel_path")


def object_dependencies(deps: DataFrame, object_id: int) -> DataFrame:
    return deps.where(F.col("source_object_id") == object_id).orderBy("dep_type", "target_name")


def processing_status(scans: DataFrame, runs: DataFrame, stages: DataFrame, assessment_id: int | None = None) -> DataFrame:
    """assessment_id, scan_id, run_id, is_processed, is_stale: processed if the current scan's latest source run has
    completed the stages parse and detect_dependencies."""
    scan = current_scan(scans, assessment_id).select("assessment_id", F.col("id").alias("scan_id"))
    last = latest_per_key(runs.where("kind = 'source_processing'"), ["source_scan_id"], [F.desc("id")]).select(F.col("source_scan_id").alias("scan_id"), F.col("id").alias("run_id"))
    done = stages.where("status = 'COMPLETED' and stage_name in ('parse', 'detect_dependencies')").groupBy("run_id").agg((F.count_distinct("stage_name") == 2).alias("_done"))
    joined = scan.join(last, "scan_id", "left").join(done, "run_id", "left")
    return joined.select("assessment_id", "scan_id", "run_id", F.coalesce("_done", F.lit(False)).alias("is_processed"), (~F.coalesce("_done", F.lit(False))).alias("is_stale"))


def dashboard_summary(scans: DataFrame, files: DataFrame, objects: DataFrame, apps: DataFrame, assessments: DataFrame, technical: DataFrame, rules: DataFrame, runs: DataFrame, stages: DataFrame, assessment_id: int | None = None) -> DataFrame:
    """Six figures for each assessment that has any row in scans, applications, findings or rules; missing ones are 0."""
    current = current_objects(objects, files, scans, assessment_id)
    risky = assessments.where(F.col("technical_risk").isin(*HIGH)).select("application_id").distinct()

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("assessment_id").agg(F.count(F.lit(1)).alias(name))

    parts = [
        count(current, "objects_analyzed"), count(of(apps, assessment_id).where("status <> 'MERGED'"), "customizations_identified"),
        count(of(technical, assessment_id).where("severity = 'HIGH'"), "critical_findings"), count(current.join(risky, "application_id", "left_semi"), "high_impact_objects"),
        count(of(rules, assessment_id).where("status = 'CANDIDATE'"), "business_rules_identified"),
    ]
    every = of(scans, assessment_id).select("assessment_id")
    for df in (apps, technical, rules):
        every = every.unionByName(of(df, assessment_id).select("assessment_id"))
    out = every.distinct()
    for part in parts:
        name = part.columns[1]
        out = out.join(part, "assessment_id", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    stale = processing_status(scans, runs, stages, assessment_id).select("assessment_id", "is_stale")
    return out.join(stale, "assessment_id", "left").withColumn("is_stale", F.coalesce("is_stale", F.lit(False)))


def objects_by_type(current: DataFrame, assessment_id: int | None = None) -> DataFrame:
    return of(current, assessment_id).groupBy("assessment_id", "object_type").agg(F.count(F.lit(1)).alias("n"))


def count_custom(current: DataFrame, assessment_id: int | None = None) -> DataFrame:
    """objects_total and objects_custom of each assessment."""
    return of(current, assessment_id).groupBy("assessment_id").agg(F.count(F.lit(1)).alias("objects_total"), F.count_if(is_custom_object(F.col("object_name"))).alias("objects_custom"))


def _by_recommendation(rows: DataFrame) -> DataFrame:
    return rows.groupBy("assessment_id", F.coalesce("recommendation", F.lit("UNCLASSIFIED")).alias("recommendation")).agg(F.count(F.lit(1)).alias("n"))


def clean_core_objects(current: DataFrame, assessments: DataFrame, assessment_id: int | None = None) -> DataFrame:
    """Objects per recommendation inherited from their application; without one they are UNCLASSIFIED."""
    return _by_recommendation(of(current, assessment_id).join(assessments.select("application_id", "recommendation"), "application_id", "left"))


def clean_core_applications(apps: DataFrame, assessments: DataFrame, assessment_id: int | None = None) -> DataFrame:
    """Applications that are not merged per recommendation."""
    own = of(apps, assessment_id).where("status <> 'MERGED'").select("assessment_id", F.col("id").alias("application_id"))
    return _by_recommendation(own.join(assessments.select("application_id", "recommendation"), "application_id", "left"))


def current_findings(findings: DataFrame, runs: DataFrame, assessment_id: int | None = None) -> DataFrame:
    run = current_atc_run(runs, assessment_id).select(F.col("id").alias("run_id"))
    return findings.join(run, "run_id", "left_semi").select(*findings.columns)


def atc_by_priority(findings: DataFrame, runs: DataFrame, assessment_id: int | None = None) -> DataFrame:
    """Findings of the current run per priority; null counts as `none`."""
    return current_findings(findings, runs, assessment_id).groupBy("assessment_id", F.coalesce(F.col("priority").cast("string"), F.lit("none")).alias("priority")).agg(F.count(F.lit(1)).alias("n"))


def findings_per_object(findings: DataFrame, runs: DataFrame, assessment_id: int | None = None) -> DataFrame:
    return current_findings(findings, runs, assessment_id).where("target_id is not null").groupBy(F.col("target_id").alias("object_id")).agg(F.count(F.lit(1)).alias("n_findings"))


def priority_totals(findings: DataFrame, objects: DataFrame, assessment_id: int | None = None) -> DataFrame:
    """Findings per application and priority, before any cap."""
    members = of(objects, assessment_id).where("application_id is not null").select(F.col("id").alias("target_id"), "application_id")
    return findings.select("target_id", "priority").join(members, "target_id").groupBy("application_id", "priority").agg(F.count(F.lit(1)).alias("n"))


def usage_by_level(usage: DataFrame, current: DataFrame, assessment_id: int | None = None) -> DataFrame:
    """Distinct current objects per usage level; an object may stand in two levels."""
    own = of(current, assessment_id).select(F.col("id").alias("object_id"), "assessment_id")
    return usage.join(own, "object_id").groupBy("assessment_id", "usage_level").agg(F.count_distinct("object_id").alias("n"))


def unused_custom(usage: DataFrame, current: DataFrame, level: str = "Unused", assessment_id: int | None = None) -> DataFrame:
    """Current custom objects that a usage record of the level names, counted for each assessment."""
    named = usage.where(F.col("usage_level") == level).select(F.col("object_id").alias("id")).distinct()
    own = of(current, assessment_id).where(is_custom_object(F.col("object_name")))
    return own.join(named, "id", "left_semi").groupBy("assessment_id").agg(F.count(F.lit(1)).alias("n"))


def usage_level_per_object(usage: DataFrame) -> DataFrame:
    """The greatest usage level of each object, by bytes."""
    return usage.groupBy("object_id").agg(F.max("usage_level").alias("usage_level"))


def category_counts(files: DataFrame, scan_id: int | None = None) -> DataFrame:
    return (files if scan_id is None else files.where(F.col("scan_id") == scan_id)).groupBy("scan_id", "category").agg(F.count(F.lit(1)).alias("n")).orderBy("scan_id", "category")


def check_catalog(findings: DataFrame) -> DataFrame:
    return findings.where("check_title is not null and check_title <> ''").select("check_title").distinct()


def application_members(apps: DataFrame, objects: DataFrame, shown: int = 40, assessment_id: int | None = None) -> DataFrame:
    """application_id, n_members, the first `shown` names in order and how many more there are.

    Only the names that are shown are gathered, so a large application stays a small row.
    """
    own = objects.where("application_id is not null").join(of(apps, assessment_id).select(F.col("id").alias("application_id")), "application_id", "left_semi")
    return top_names(own, ["application_id"], shown, "members")


def top_names(objects: DataFrame, keys: list[str], shown: int, name: str) -> DataFrame:
    totals = objects.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"n_{name}"))
    ranked = objects.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("object_name", "id"))).where(F.col("_rank") <= shown)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_rank", "object_name"))), lambda x: x["object_name"])
    first = ranked.groupBy(*keys).agg(listed.alias(name))
    same = [F.col(f"_{k}").eqNullSafe(F.col(k)) for k in keys]
    joined = totals.join(first.withColumnsRenamed({k: f"_{k}" for k in keys}), same, "left")
    return joined.select(*keys, f"n_{name}", name, F.greatest(F.col(f"n_{name}") - shown, F.lit(0).cast("long")).alias("n_more"))


def object_catalog(drilldown: DataFrame, full_limit: int = 1500, sample: int = 15, assessment_id: int | None = None) -> DataFrame:
    """kind, label, n, names, entity_id: one row per object for assessments of at most `full_limit` objects, else one for each
    application and recommendation with its size and first names (and no entity_id)."""
    rows = of(drilldown, assessment_id)
    small = rows.groupBy("assessment_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= full_limit).select("assessment_id")
    single = rows.join(small, "assessment_id", "left_semi").select("assessment_id", F.lit("object").alias("kind"), F.col("object_name").alias("label"), F.lit(1).cast("long").alias("n"), F.array("object_name").alias("names"), F.col("id").alias("entity_id"))
    label = F.concat_ws(" — ", F.coalesce("application_name", F.lit("-")), F.coalesce("recommendation", F.lit("UNCLASSIFIED")))
    grouped = top_names(rows.join(small, "assessment_id", "left_anti").withColumn("label", label), ["assessment_id", "label"], sample, "names")
    return single.unionByName(grouped.select("assessment_id", F.lit("group").alias("kind"), "label", F.col("n_names").alias("n"), "names", F.lit(None).cast("long").alias("entity_id")))


def object_drilldown(objects: DataFrame, apps: DataFrame, assessments: DataFrame, findings: DataFrame, usage: DataFrame, files: DataFrame | None = None, scans: DataFrame | None = None, runs: DataFrame | None = None, assessment_id: int | None = None) -> DataFrame:
    """Objects (of the current scan, if scans are given) with is_custom, application name, inherited recommendation and
    risk, findings of the current run and greatest usage level."""
    own = current_objects(objects, files, scans, assessment_id) if scans is not None else of(objects, assessment_id)
    counts = findings_per_object(findings, runs, assessment_id) if runs is not None else findings.where("target_id is not null").groupBy(F.col("target_id").alias("object_id")).agg(F.count(F.lit(1)).alias("n_findings"))
    named = apps.select(F.col("id").alias("application_id"), F.col("name").alias("application_name"))
    given = assessments.select("application_id", "recommendation", "technical_risk")
    joined = own.join(named, "application_id", "left").join(given, "application_id", "left").join(counts.withColumnRenamed("object_id", "id"), "id", "left").join(usage_level_per_object(usage).withColumnRenamed("object_id", "id"), "id", "left")
    return joined.select(*own.columns, is_custom_object(F.col("object_name")).alias("is_custom"), "application_name", "recommendation", "technical_risk", F.coalesce("n_findings", F.lit(0).cast("long")).alias("n_findings"), "usage_level")


def application_detail(application_id: int, objects: DataFrame, rules: DataFrame, findings: DataFrame) -> dict[str, DataFrame]:
    """An application's members, their CANDIDATE rules and their findings."""
    members = objects.where(F.col("application_id") == application_id)
    ids = members.select(F.col("id").alias("_id"))
    return {
        "members": members.orderBy("object_name"), "rules": rules.where("status = 'CANDIDATE'").join(ids, F.col("sap_object_id") == F.col("_id"), "left_semi"),
        "findings": findings.join(ids, F.col("target_id") == F.col("_id"), "left_semi"),
    }


def top_checks(findings: DataFrame, runs: DataFrame, n: int = 10, assessment_id: int | None = None) -> DataFrame:
    """The n most frequent check titles of each assessment's current run, ties by title."""
    counts = current_findings(findings, runs, assessment_id).where("check_title is not null").groupBy("assessment_id", "check_title").agg(F.count(F.lit(1)).alias("n"))
    return first_rows(counts, ["assessment_id"], [F.desc("n"), F.asc("check_title")], n)


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def critical_sample(technical: DataFrame, n: int = 5, assessment_id: int | None = None) -> DataFrame:
    """The n newest HIGH findings of each assessment (by id)."""
    return first_rows(of(technical, assessment_id).where("severity = 'HIGH'"), ["assessment_id"], [F.desc("id")], n)


def findings_order() -> list[Column]:
    return [F.asc_nulls_last("priority"), F.asc("source_row_number"), F.asc("id")]


def objects_order() -> list[Column]:
    return [F.asc("object_name"), F.asc("id")]


def rules_order() -> list[Column]:
    return [F.desc("confidence"), F.asc("id")]


def page(df: DataFrame, order: list[Column], offset: int = 0, limit: int = 50) -> DataFrame:
    """One page of a list in a total order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def findings_after(findings: DataFrame, last: tuple[int | None, int, int] | None, limit: int = 50) -> DataFrame:
    """The page of findings, in findings_order, that follows the one whose last row has this (priority, source_row_number, id).

    What comes before is filtered out where it is read, so a deep page gathers no more rows than the first one.
    """
    if last is not None:
        after = F.col("priority").isNull() if last[0] is None else F.col("priority").isNull() | (F.col("priority") >= last[0])
        place = F.struct(F.col("priority").isNull(), F.coalesce("priority", F.lit(0)).cast("long"), F.col("source_row_number").cast("long"), F.col("id").cast("long"))
        findings = findings.where(after & (place > F.struct(F.lit(last[0] is None), F.lit(last[0] or 0).cast("long"), F.lit(last[1]).cast("long"), F.lit(last[2]).cast("long"))))
    return page(findings, findings_order(), limit=limit)


def derive_technical_findings(findings: DataFrame) -> DataFrame:
    """One derived finding for each: severity by priority (1, 2, 3: HIGH, MEDIUM, LOW; else INFO), type, title, details."""
    severity = F.when(F.col("priority") == 1, "HIGH").when(F.col("priority") == 2, "MEDIUM").when(F.col("priority") == 3, "LOW").otherwise("INFO")
    title, message = (F.nullif(strip_all(F.col(c)), F.lit("")) for c in ("check_title", "check_message"))
    return findings.select(
        "assessment_id", F.col("id").alias("atc_finding_id"), F.col("target_id").alias("sap_object_id"), severity.alias("severity"),
        F.coalesce(title, F.lit("ATC")).alias("finding_type"), F.coalesce(F.nullif(F.concat_ws(": ", title, message), F.lit("")), F.lit("ATC finding")).alias("title"),
        F.create_map(F.lit("priority"), F.col("priority").cast("string"), F.lit("object_name"), F.col("object_name")).alias("details"),
    )


def dataset_status(manifest: DataFrame) -> DataFrame:
    """Import status from columns error, n_capabilities, n_rows and warnings (array): FAILED on error, FULL with
    capabilities, rows and no warnings, else PARTIAL, which gains a warning if capabilities came without rows."""
    hollow = (F.col("n_capabilities") > 0) & (F.col("n_rows") == 0)
    full = (F.col("n_capabilities") > 0) & (F.col("n_rows") > 0) & (F.size("warnings") == 0)
    return manifest.withColumns({
        "status": F.when(F.col("error").isNotNull(), "FAILED").when(full, "FULL").otherwise("PARTIAL"),
        "warnings": F.when(F.col("error").isNull() & hollow, F.concat("warnings", F.array(F.lit("capabilities were found but no rows")))).otherwise(F.col("warnings")),
    })


def assessment_catalog(summary: DataFrame, drilldown: DataFrame, apps: DataFrame, findings: DataFrame, runs: DataFrame, technical: DataFrame, full_limit: int = 1500, with_objects: bool = True, assessment_id: int | None = None) -> DataFrame:
    """assessment_id, ref_id, source_type, entity_id, summary: the table of all that an answer about an assessment may cite.

    One row for the KPIs (dashboard_summary), one for each recommendation's objects, one for the current findings by
    priority, one for each application that is not merged (with its first members), the newest HIGH findings, and the object list or
    its groups. Every ref_id occurs once in an assessment; objects have theirs from their id, so equal names stay apart.
    """
    none = F.lit(None).cast("long")

    def shaped(df: DataFrame, ref, kind: str, entity, text) -> DataFrame:
        return df.select("assessment_id", ref.alias("ref_id"), F.lit(kind).alias("source_type"), entity.alias("entity_id"), text.alias("summary"))

    figures = [F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in summary.columns if c != "assessment_id"]
    out = shaped(of(summary, assessment_id), F.lit("SUMMARY"), "DASHBOARD", none, F.concat_ws(", ", *figures))
    shares = _by_recommendation(of(drilldown, assessment_id))
    out = out.unionByName(shaped(shares, F.concat(F.lit("CATEGORY-"), "recommendation"), "CATEGORY", none, F.concat_ws(": ", "recommendation", F.col("n").cast("string"))))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("priority", "n"))), lambda x: F.concat_ws("=", x["priority"], x["n"].cast("string")))
    priorities = atc_by_priority(findings, runs, assessment_id).groupBy("assessment_id").agg(F.array_join(listed, ", ").alias("s"))
    out = out.unionByName(shaped(priorities, F.lit("ATC"), "ATC_SUMMARY", none, F.col("s")))
    members = application_members(apps, drilldown, assessment_id=assessment_id).withColumnRenamed("application_id", "id")
    named = of(apps, assessment_id).where("status <> 'MERGED'").join(members, "id", "left")
    more = F.when(F.col("n_more") > 0, F.concat(F.lit("+"), F.col("n_more").cast("string")))
    out = out.unionByName(shaped(named, F.concat(F.lit("APP-"), F.col("id").cast("string")), "APPLICATION", F.col("id"), F.concat_ws(" | ", "name", F.array_join("members", ", "), more)))
    worst = critical_sample(technical, assessment_id=assessment_id)
    out = out.unionByName(shaped(worst, F.concat(F.lit("TF-"), F.col("id").cast("string")), "TECHNICAL_FINDING", F.col("id"), F.col("title")))
    if with_objects:
        objects = object_catalog(drilldown, full_limit, assessment_id=assessment_id)
        text = F.when(F.col("kind") == "object", F.col("label")).otherwise(F.concat_ws(": ", "label", F.concat_ws(" of ", F.array_join("names", ", "), F.col("n").cast("string"))))
        ref = F.concat(F.upper("kind"), F.lit("-"), F.coalesce(F.col("entity_id").cast("string"), F.col("label")))
        out = out.unionByName(shaped(objects, ref, "OBJECT_LIST", F.col("entity_id"), text))
    return out
