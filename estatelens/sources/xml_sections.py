"""Sectioned XML of any size: <ROOT><SECTION><ROW attr="..."/>...</SECTION>...</ROOT>.

Spark's text reader cuts a file at every `<` and reads byte ranges in parallel. What a tag cannot know by itself, its
depth, its section and its place there, comes from running sums inside a range and small prefix sums over the ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from estatelens.functions.text import record_fingerprint, sanitize_xml
from estatelens.sources import archives
from estatelens.sources.ranges import few_listing_tasks, listed, plain

#: Known sections and what their rows hold (fixed values): capability, record type, and the attributes of name, type and package.
SECTIONS = {
    "REPOSITORY_OBJECTS": ("TECHNICAL_OBJECT_METADATA", "panaya_repository_object", "OBJ_NAME", "OBJECT", "DEVCLASS"),
    "PROGRAMS": ("TECHNICAL_OBJECT_METADATA", "panaya_program", "NAME", None, None),
    "FUNCTIONS": ("TECHNICAL_OBJECT_METADATA", "panaya_function", "FUNCNAME", None, None),
    "MODIFICATIONS": ("SOURCE_CODE", "panaya_modification", "OBJ_NAME", "OBJ_TYPE", None),
    "NOTES_HEADER": ("S4_CONVERSION_SIGNAL", "panaya_sap_note", None, None, None),
    "SCI_HANA_ISSUES": ("S4_CONVERSION_SIGNAL", "panaya_sci_hana_issue", "OBJNAME", "OBJTYPE", "DEVCLASS"),
    "SCI_HANA_ISSUES_DETAILS": ("S4_CONVERSION_SIGNAL", "panaya_sci_hana_issue_detail", "INCLUDE", None, None),
    "WHERE_USED_TABLE": ("DEPENDENCY_SIGNAL", "panaya_where_used", "INCLUDE", None, None),
}
CONFIG = "section string, capability string, record_type string, name_attr string, type_attr string, package_attr string"


def _tags(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, block, pos, tag: everything that follows a `<`, in file order inside a block; file is a URL."""
    with few_listing_tasks(spark):
        raw = spark.read.option("lineSep", "<").option("recursiveFileLookup", True).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"), F.col("value").alias("tag"))


def _largest_members(spark: SparkSession, archives_: DataFrame) -> tuple[str, DataFrame]:
    """The largest XML member of each archive as a file that can be read in ranges: the folder, and file, name, error."""
    found = archives.list_members(archives_, (".xml",))
    every = archives_.select(F.col("path").alias("file")).join(found, "file", "left")
    size = F.struct(F.col("size"), -F.col("offset"))
    best = every.groupBy("file").agg(F.max_by(F.struct("member", "offset", "packed", "size", "error"), size).alias("m"), F.max("error").alias("broken"))
    error = F.coalesce("broken", F.when(F.col("m.member").isNull(), "no XML member"))
    folder, laid = archives.laid_out(spark, archives.one_a_task(best.select("file", "m.member", "m.offset", "m.packed", "m.size", error.alias("error"))), "xml")
    return folder, laid.select("file", "name", "error")


def _attributes(tag: Column) -> Column:
    """The attributes of a tag as a map; of equal names the last wins."""
    pattern = r"([\w:.-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
    names = F.regexp_extract_all(tag, F.lit(pattern), F.lit(1))
    values = F.zip_with(F.regexp_extract_all(tag, F.lit(pattern), F.lit(2)), F.regexp_extract_all(tag, F.lit(pattern), F.lit(3)), lambda a, b: F.concat(a, b))
    for ref, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        values = _replaced(values, ref, sign)
    last = F.filter(F.transform(names, lambda n, i: F.when(F.array_position(F.slice(names, i + 2, F.greatest(F.size(names), F.lit(1))), n) == 0, F.struct(n.alias("key"), F.get(values, i).alias("value")))), lambda e: e.isNotNull())
    return F.map_from_entries(last)


def _replaced(values: Column, ref: str, sign: str) -> Column:
    return F.transform(values, lambda v: F.replace(v, F.lit(ref), F.lit(sign)))


def read_sectioned_xml(spark: SparkSession, path: str | list[str], sections: list[str] | None = None, max_per_section: int | None = None) -> DataFrame:
    """file, section, row_index (from 0 inside its section of the file), attrs (map), error of every element at depth 3.

    Bytes that XML forbids, raw or as references, are dropped before a tag is read. Only the named sections are
    returned if any are named; max_per_section keeps the first rows of each. An empty file gives no rows. Of a ZIP the
    largest XML member is read: one task writes it into the shared folder, whence it is read in ranges like other files.
    A ZIP that is damaged or has no such member gives one row with its error and nothing else.
    """
    files = listed(spark, path).select("path", "length")
    packed = files.where(F.lower("path").endswith(".zip"))
    none = F.lit(None).cast("string")
    if packed.isEmpty():
        return _rows(_tags(spark, path), sections, max_per_section).withColumns({"file": plain(F.col("file")), "error": none})
    folder, laid = _largest_members(spark, packed)
    name = F.substring_index("file", "/", -1)
    inside = _rows(_tags(spark, folder).withColumn("file", name), sections, max_per_section)
    named = inside.withColumnRenamed("file", "name").join(F.broadcast(laid.where("error is null").select("file", "name")), "name").select("file", "section", "row_index", "attrs", none.alias("error"))
    broken = laid.where("error is not null").select("file", none.alias("section"), F.lit(None).cast("long").alias("row_index"), F.lit(None).cast("map<string,string>").alias("attrs"), "error")
    out = named.unionByName(broken)
    if packed.count() == files.count():
        return out
    bare = _tags(spark, path).where(~F.lower("file").endswith(".zip"))
    return out.unionByName(_rows(bare, sections, max_per_section).withColumns({"file": plain(F.col("file")), "error": none}))


def _rows(found: DataFrame, sections: list[str] | None, max_per_section: int | None) -> DataFrame:
    """file, section, row_index, attrs of the tags of files."""
    tag = sanitize_xml(F.col("tag"))
    clean = found.select("file", "block", "pos", tag.alias("tag")).where(F.col("tag").rlike(r"^/?[A-Za-z_]"))
    name = F.regexp_extract("tag", r"^/?([\w:.-]+)", 1)
    delta = F.when(F.col("tag").startswith("/"), -1).when(F.col("tag").rlike(r"^[^>]*/>"), 0).otherwise(1)
    tags = clean.select("file", "block", "pos", "tag", name.alias("name"), delta.alias("delta"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = tags.groupBy("file", "block").agg(F.sum("delta").alias("d")).select("file", "block", F.coalesce(F.sum("d").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file", "block").orderBy("pos")
    depth = tags.withColumn("run", F.sum("delta").over(inside)).join(bases, ["file", "block"]).withColumn("depth", F.col("base") + F.col("run") - F.col("delta"))
    opened = F.when((F.col("depth") == 1) & ~F.col("tag").startswith("/"), F.struct("block", "pos", "name"))
    lined = depth.withColumn("own", F.last(opened, ignorenulls=True).over(inside))
    carried = lined.groupBy("file", "block").agg(F.max_by("own", "pos").alias("last"))
    carried = carried.select("file", "block", F.last("last", ignorenulls=True).over(before).alias("carried"))
    rows = lined.join(carried, ["file", "block"]).withColumn("at", F.coalesce("own", "carried")).where((F.col("depth") == 2) & ~F.col("tag").startswith("/"))
    if sections is not None:
        rows = rows.where(F.col("at.name").isin(*sections))
    counts = rows.groupBy("file", "at", "block").agg(F.count(F.lit(1)).alias("c"))
    offsets = counts.select("file", "at", "block", F.coalesce(F.sum("c").over(Window.partitionBy("file", "at").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    placed = rows.withColumn("n", F.row_number().over(Window.partitionBy("file", "block", "at").orderBy("pos"))).join(offsets, ["file", "at", "block"])
    out = placed.select("file", F.col("at.name").alias("section"), (F.col("offset") + F.col("n") - 1).alias("row_index"), _attributes(F.col("tag")).alias("attrs"))
    return out if max_per_section is None else out.where(F.col("row_index") < max_per_section)


def config(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in SECTIONS.items()], CONFIG)


def curate_sections(rows: DataFrame, assessment_id: int | None = None, dataset_id: int | None = None) -> DataFrame:
    """Evidence records of the known sections; an attribute that is absent or empty gives null. Other sections give none."""
    known = rows.join(F.broadcast(config(rows.sparkSession)), "section")

    def attr(column: str) -> Column:
        return F.nullif(F.try_element_at("attrs", F.col(column)), F.lit(""))

    key = F.concat_ws(":", "section", F.col("row_index").cast("string"))
    return known.select(
        F.lit(assessment_id).cast("long").alias("assessment_id"), F.lit(dataset_id).cast("long").alias("dataset_id"), "record_type", "capability", key.alias("source_key"),
        record_fingerprint(key).alias("record_fingerprint"), attr("name_attr").alias("object_name"), attr("type_attr").alias("object_type"), attr("package_attr").alias("package_name"), F.col("attrs").alias("payload"), "file",
    )


def section_manifest(rows: DataFrame) -> DataFrame:
    """section, n_rows, attributes (sorted names), capability (null if the section is not a known one)."""
    rows = rows.where("section is not null")
    counts = rows.groupBy("section").agg(F.count(F.lit(1)).alias("n_rows"))
    names = rows.select("section", F.explode(F.map_keys("attrs")).alias("a")).groupBy("section").agg(F.array_sort(F.collect_set("a")).alias("attributes"))
    return counts.join(names, "section", "left").join(F.broadcast(config(rows.sparkSession).select("section", "capability")), "section", "left")
