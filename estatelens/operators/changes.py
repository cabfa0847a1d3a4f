"""Change handling with stable keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatelens.graph import connected_components


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by the given order, which has to be total; null keys are one key."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def append_new(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """existing and the incoming rows whose key it lacks, one for each key; a second run with the same rows adds none."""
    return existing.unionByName(new_rows(existing, incoming, keys, order), allowMissingColumns=True)


def new_rows(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """The rows that append_new would add; their count is what it reports."""
    first = latest_per_key(incoming, keys, order) if order else incoming.dropDuplicates(keys)
    return first.join(existing.select(*keys).distinct(), keys, "left_anti").select(*incoming.columns)


def last_parsed(parsed: DataFrame) -> DataFrame:
    """One row for each (assessment_id, canonical_key): the last file, and there the last line, wins."""
    return latest_per_key(parsed, ["assessment_id", "canonical_key"], [F.desc("source_file_id"), F.desc_nulls_last("line_start"), F.desc("object_name")])


def upsert_objects(existing: DataFrame, parsed: DataFrame) -> DataFrame:
    """Objects after a parse: known keys keep their id and take the new values, new keys get an id from their key.

    Both sides have the columns of `existing`; parsed rows are reduced to one for each key first.
    """
    keys = ["assessment_id", "canonical_key"]
    new = last_parsed(parsed)
    others = [c for c in existing.columns if c not in (*keys, "id")]
    right = new.select(*keys, F.lit(True).alias("_new"), *(F.col(c).alias(f"_{c}") for c in others if c in new.columns))
    joined = existing.join(right, keys, "full_outer")
    made = F.coalesce("id", F.xxhash64(*keys))
    taken = [F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in new.columns else F.col(c) for c in others]
    return joined.select(made.alias("id"), *keys, *taken).select(*existing.columns)


def drop_stale(objects: DataFrame, seen: DataFrame, files: DataFrame, scan_id: int) -> DataFrame:
    """Objects without those whose file is of this scan but whose key this run has not seen; other scans' stay."""
    of_scan = files.where(F.col("scan_id") == scan_id).select(F.col("id").alias("source_file_id"))
    stale = objects.join(of_scan, "source_file_id", "left_semi").join(seen.select("assessment_id", "canonical_key").distinct(), ["assessment_id", "canonical_key"], "left_anti")
    return objects.join(stale.select("id"), "id", "left_anti").select(*objects.columns)


def replace_partition(existing: DataFrame, computed: DataFrame, key: str) -> DataFrame:
    """existing with all rows of the keys that `computed` holds replaced by it; running it twice changes nothing."""
    return existing.join(computed.select(key).distinct(), key, "left_anti").select(*existing.columns).unionByName(computed.select(*existing.columns))


def replace_candidates(rules: DataFrame, new: DataFrame, done: DataFrame) -> DataFrame:
    """Rules after a rerun: for the objects in `done` new candidates replace all rules but the user-validated ones; a
    failed object (not in `done`) keeps what it had."""
    finished = done.select("sap_object_id").distinct().withColumn("_done", F.lit(True))
    kept = rules.join(finished, "sap_object_id", "left").where("_done is null or user_validated").select(*rules.columns)
    return kept.unionByName(new.join(finished, "sap_object_id", "left_semi").select(*rules.columns))


def changed_entities(entities: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Entities whose text is not embedded yet in this form: by assessment, kind, id and sha256 of the text."""
    keys = ["assessment_id", "entity_type", "entity_id", "content_hash"]
    hashed = entities.withColumn("content_hash", F.sha2(F.coalesce("content_text", F.lit("")), 256))
    return hashed.join(embeddings.select(*keys).distinct(), keys, "left_anti").select(*entities.columns, *([] if "content_hash" in entities.columns else ["content_hash"]))


def changed_files(scan: DataFrame, previous: DataFrame) -> DataFrame:
    """Files that are new or have new bytes since the previous inventory."""
    return scan.join(previous.select("rel_path", "sha256").distinct(), ["rel_path", "sha256"], "left_anti").select(*scan.columns)


def fold_refs(survivors: DataFrame, others: DataFrame, key: str = "id") -> DataFrame:
    """(key, evidence_refs): the survivor's refs and then the others', each (ref_id, source_type, entity_id) once, in the
    order in which it was first seen.

    others: column `survivor` names the row they fold into, and column `id` orders them.
    """
    own = survivors.select(F.col(key).alias("survivor"), F.lit(0).alias("turn"), F.col("id").alias("by"), F.posexplode("evidence_refs").alias("pos", "ref"))
    rest = others.select("survivor", F.lit(1).alias("turn"), F.col("id").alias("by"), F.posexplode("evidence_refs").alias("pos", "ref"))
    first = own.unionByName(rest).groupBy("survivor", "ref.ref_id", "ref.source_type", "ref.entity_id").agg(F.min(F.struct("turn", "by", "pos")).alias("seen"))
    listed = F.array_sort(F.collect_list(F.struct("seen", "ref_id", "source_type", "entity_id")))
    refs = F.transform(listed, lambda x: F.struct(x["ref_id"].alias("ref_id"), x["source_type"].alias("source_type"), x["entity_id"].alias("entity_id")))
    return first.groupBy(F.col("survivor").alias(key)).agg(refs.alias("evidence_refs"))


def apply_validation(rules: DataFrame, log: DataFrame) -> DataFrame:
    """Rules with the user's last verdict (user_validated, validation_notes, validated_at) from a log of (rule_id, at, notes)."""
    last = latest_per_key(log, ["rule_id"], [F.desc("at"), F.desc_nulls_last("notes")]).select(F.col("rule_id").alias("_id"), F.col("notes").alias("_notes"), F.col("at").alias("_at"))
    joined = rules.drop("validation_notes", "validated_at").join(last, F.col("id") == F.col("_id"), "left")
    return joined.withColumns({"user_validated": F.coalesce("user_validated", F.lit(False)) | F.col("_id").isNotNull(), "validation_notes": F.col("_notes"), "validated_at": F.col("_at")}).drop("_id", "_notes", "_at")


def cascade_delete(tables: dict[str, DataFrame], dataset_id: int) -> dict[str, DataFrame]:
    """The tables without a data set: its own row, its records and artifacts, and the records' correlations."""
    records = tables["evidence_record"].where(F.col("dataset_id") == dataset_id).select(F.col("id").alias("record_id"))
    left = dict(tables)
    left["evidence_dataset"] = tables["evidence_dataset"].where(F.col("id") != dataset_id)
    for name in ("evidence_record", "evidence_artifact"):
        if name in tables:
            left[name] = tables[name].where(F.col("dataset_id") != dataset_id)
    if "evidence_correlation" in tables:
        left["evidence_correlation"] = tables["evidence_correlation"].join(records, "record_id", "left_anti")
    return left


def repoint_duplicates(objects: DataFrame, references: DataFrame, column: str = "sap_object_id") -> tuple[DataFrame, DataFrame]:
    """(objects, references) with one object for each (assessment_id, canonical_key), the newest parsed (parsed_at, then
    id); references to the others point at the survivor."""
    order = Window.partitionBy("assessment_id", "canonical_key").orderBy(F.desc_nulls_last("parsed_at"), F.desc("id"))
    ranked = objects.withColumn("_rank", F.row_number().over(order)).withColumn("_survivor", F.first("id").over(order))
    moved = ranked.where("_rank > 1").select(F.col("id").alias("_old"), "_survivor")
    joined = references.join(moved, F.col(column) == F.col("_old"), "left").withColumn(column, F.coalesce("_survivor", column))
    return ranked.where("_rank = 1").select(*objects.columns), joined.select(*references.columns)


def backfill_owner(assessments: DataFrame, systems: DataFrame) -> DataFrame:
    """Assessments with client_id and name from their system where they lack one: the name gets the system's SID in
    brackets if there is one."""
    name = F.when(F.col("sid").isNotNull(), F.concat("system_name", F.lit(" ("), "sid", F.lit(")"))).otherwise(F.col("system_name"))
    parent = systems.select(F.col("id").alias("_sys"), F.col("client_id").alias("_client"), name.alias("_name"))
    joined = assessments.join(parent, F.col("system_id") == F.col("_sys"), "left")
    return joined.withColumns({"client_id": F.coalesce("client_id", "_client"), "name": F.coalesce("name", "_name")}).select(*assessments.columns)


def apply_curation(apps: DataFrame, objects: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(applications, objects) after a log of user actions (seq, action, application_id, object_id, target_id, name).

    rename: last one wins, status USER_RENAMED; move: an object's last one wins (no application_id: none); merge: the
    source becomes MERGED into the target, its members move and its refs fold into the target's. An action is
    rejected if it renames or merges an application that is already merged, merges it with itself, or targets a merged one. An
    application's first merge as a source decides when it is gone, so rejections need that one time only.
    """
    merges = log.where("action = 'merge' and application_id <> target_id")
    gone = merges.groupBy(F.col("application_id").alias("_src")).agg(F.min("seq").alias("_gone"))
    alive_target = merges.join(gone.withColumnsRenamed({"_src": "_t", "_gone": "_t_gone"}), F.col("target_id") == F.col("_t"), "left").where("_t_gone is null or _t_gone > seq")
    done = latest_per_key(alive_target, ["application_id"], [F.asc("seq")]).select(F.col("application_id").alias("_src"), F.col("target_id").alias("_into"), F.col("seq").alias("_merged_at"))
    renames = log.where("action = 'rename'").join(done, F.col("application_id") == F.col("_src"), "left").where("_merged_at is null or seq < _merged_at")
    named = latest_per_key(renames.select("application_id", "seq", "name"), ["application_id"], [F.desc("seq")]).select(F.col("application_id").alias("_app"), F.col("name").alias("_name"))
    kept = apps.join(done, F.col("id") == F.col("_src"), "left").join(named, F.col("id") == F.col("_app"), "left")
    refs = fold_refs(apps, apps.join(done, F.col("id") == F.col("_src")).select("id", F.col("_into").alias("survivor"), "evidence_refs")).withColumnsRenamed({"id": "_rid", "evidence_refs": "_refs"})
    kept = kept.join(refs, F.col("id") == F.col("_rid"), "left")
    columns = {
        "name": F.coalesce("_name", "name"), "status": F.when(F.col("_src").isNotNull(), "MERGED").when(F.col("_name").isNotNull(), "USER_RENAMED").otherwise(F.col("status")),
        "merged_into_id": F.coalesce("_into", "merged_into_id"), "evidence_refs": F.coalesce("_refs", "evidence_refs"),
    }
    moves = latest_per_key(log.where("action = 'move'"), ["object_id"], [F.desc("seq")]).select(F.col("object_id").alias("_obj"), F.col("application_id").alias("_to"), F.col("seq").alias("_moved_at"))
    placed = objects.join(moves, F.col("id") == F.col("_obj"), "left").withColumn("application_id", F.when(F.col("_obj").isNotNull(), F.col("_to")).otherwise(F.col("application_id")))
    # accepted merges of one chain follow each other in time, so what is in a source goes to the chain's last target
    ends = done.select(F.col("_src").alias("src"), F.col("_into").alias("dst"))
    chains = connected_components(ends.select(F.explode(F.array("src", "dst")).alias("node")), ends)
    last = chains.join(done.select(F.col("_src").alias("node")), "node", "left_anti").select("component", F.col("node").alias("_end"))
    routes = chains.join(last, "component").select(F.col("node").alias("_s"), "_end").join(done.select(F.col("_src").alias("_s"), "_merged_at"), "_s")
    placed = placed.join(routes, (F.col("application_id") == F.col("_s")) & (F.col("_moved_at").isNull() | (F.col("_merged_at") > F.col("_moved_at"))), "left")
    placed = placed.withColumn("application_id", F.coalesce("_end", "application_id"))
    return kept.withColumns(columns).select(*apps.columns), placed.select(*objects.columns)
