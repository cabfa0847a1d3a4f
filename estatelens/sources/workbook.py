"""Spreadsheets: finding sheets and usage reports."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from functools import lru_cache
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from estatelens.functions.arrays import let
from estatelens.functions.text import blank_to_null, last_wins, normalize_date, normalize_header, normalize_priority, record_fingerprint, row_fingerprint, strip_all
from estatelens.sources import archives
from estatelens.sources.ranges import listed, opened, spread
from estatelens.storage import checkpointed

#: Known headers and their fields (fixed values).
ALIASES = {
    "priority": "priority", "check title": "check_title", "check message": "check_message", "object name": "object_name_raw", "object type": "object_type_raw",
    "exemption state": "exemption_state", "contact person": "contact_person", "package": "package_name_raw", "first found on": "first_found_on",
    "object responsible": "object_responsible", "last changed by": "last_changed_by", "sap note number": "sap_note_number", "short text": "sap_note_short_text",
    "referenced application component": "referenced_application_component", "referenced object type": "referenced_object_type", "referenced object": "referenced_object_name",
    "additional info": "additional_info", "simplification item category": "simplification_item_category", "change category of piecelist items": "change_category",
    "description of change category": "change_category_description", "remarks": "remarks",
}
#: Headers that mark a usage report (fixed values).
USAGE_SIGNATURE = ("OBJECT NAME", "OBJECT TYPE", "USAGE LEVEL", "ORIGIN")
BLANK = "(vazio)"
_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_T, _C, _V = f"{_M}t", f"{_M}c", f"{_M}v"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _texts(node: ElementTree.Element) -> str:
    return "".join([t.text or "" for t in node.iter(_T)])


@lru_cache
def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _inline(cell: ElementTree.Element) -> str:
    """_texts of a cell, without a walk if it holds a single text, as most do."""
    if len(cell) == 1 and len(cell[0]) == 1 and cell[0][0].tag == _T and not len(cell[0][0]):
        return cell[0][0].text or ""
    return _texts(cell)


def _cells(row: ElementTree.Element) -> Iterator[tuple[int, str | None, int | None]]:
    """(column, text, number of the shared string instead) of a row's cells."""
    for k, cell in enumerate(row.iter(_C)):
        ref, kind = cell.get("r"), cell.get("t")
        at = _column(ref.rstrip("0123456789")) if ref else k
        text = _inline(cell) if kind == "inlineStr" else cell.findtext(_V) or None
        yield (at, None, int(text)) if kind == "s" and text else (at, text, None)


def _sheet_rows(box: zipfile.ZipFile, part: str, shared: list[str] | _FirstStrings) -> Iterator[tuple[int, list[str | None]]]:
    """(1-based row number, cells as text) of every row of a sheet, streamed."""
    with box.open(part) as stream:
        for _, row in ElementTree.iterparse(stream):
            if row.tag == f"{_M}row":
                yield _row(row, shared)
                row.clear()


def _row(row: ElementTree.Element, shared: list[str] | _FirstStrings) -> tuple[int, list[str | None]]:
    cells: list[str | None] = []
    for at, text, number in _cells(row):
        value = text if number is None else shared[number]
        if at == len(cells):
            cells.append(value)
        else:
            cells += [None] * (at + 1 - len(cells))
            cells[at] = value
    return int(row.get("r", 0)), cells


def _every_row(box: zipfile.ZipFile, part: str, shared: list[str]) -> Iterator[tuple[int, list[str | None]]]:
    """_sheet_rows, of a small sheet by parsing it at once, which takes a fraction of the time; a damaged one is streamed up to the damage."""
    root = None
    if box.getinfo(part).file_size <= AT_ONCE:
        try:
            root = ElementTree.fromstring(box.read(part))
        except DAMAGE:
            pass
    yield from _sheet_rows(box, part, shared) if root is None else (_row(row, shared) for row in root.iter(f"{_M}row"))


#: What a damaged workbook raises.
DAMAGE = (*archives.DAMAGE, ValueError, IndexError, ElementTree.ParseError)
#: A workbook whose sheet and strings unpack to more bytes is not read by one task but laid out and cut at its rows.
LARGE = 64 << 20
#: A sheet of at most so many bytes is parsed at once.
AT_ONCE = 4 << 20
#: A task parses about so many unpacked bytes of smaller workbooks.
PARSED_BYTES = 16 << 20
_STRINGS = "xl/sharedStrings.xml"


class _FirstStrings:
    """The shared strings of a workbook, read as far as they are asked for."""

    def __init__(self, box: zipfile.ZipFile) -> None:
        self.known: list[str] = []
        self.more = iter(()) if _STRINGS not in box.namelist() else (_texts(x) for _, x in ElementTree.iterparse(box.open(_STRINGS)) if x.tag == f"{_M}si")

    def __getitem__(self, k: int) -> str:
        while len(self.known) <= k:
            self.known.append(next(self.more, None) or "")
        return self.known[k]


def _chosen_sheet(box: zipfile.ZipFile, sheet: str | None) -> str | None:
    """The part of the named sheet, else of the one called `data`, else of the first with a header; null if all are empty."""
    book, links = ElementTree.fromstring(box.read("xl/workbook.xml")), ElementTree.fromstring(box.read("xl/_rels/workbook.xml.rels"))
    targets = {x.get("Id"): x.get("Target", "").lstrip("/") for x in links}
    parts = {x.get("name", ""): (t if (t := targets[x.get(f"{_R}id")]).startswith("xl/") else f"xl/{t}") for x in book.iter(f"{_M}sheet")}
    if sheet is not None and sheet not in parts:
        raise ValueError(f"no sheet {sheet!r}")
    first = _FirstStrings(box)
    names = [sheet] if sheet is not None else [*(n for n in parts if n.lower() == "data"), *(n for n in parts if n.lower() != "data")]
    return next((parts[n] for n in names if any(_filled(cells) for _, cells in _sheet_rows(box, parts[n], first))), None)


def _filled(cells: list[str | None]) -> bool:
    return any(c and c.strip() for c in cells)


def _in_table(rows: Iterator[tuple[int, list[str | None]]]) -> Iterator[tuple[int, list[str], list[str | None]]]:
    """(row number, headers, cells) after the first row that is not blank, which is the header; blank rows are skipped."""
    headers: list[str] | None = None
    for number, cells in rows:
        if not _filled(cells):
            continue
        if headers is None:
            headers = ["None" if c is None else c for c in cells]
            continue
        yield number, headers, [*cells, *[None] * (len(headers) - len(cells))][: len(headers)]


def read_workbook(content: bytes, sheet: str | None = None) -> Iterator[tuple[int, list[str], list[str | None]]]:
    """(row number, headers, cells) of the named sheet, else the one called `data`, else the first with a header; blank
    rows are skipped. Raises one of DAMAGE if the bytes are no workbook or damaged."""
    with zipfile.ZipFile(io.BytesIO(content)) as box:
        part = _chosen_sheet(box, sheet)
        if part is not None:
            yield from _in_table(_every_row(box, part, _shared(box)))


def _shared(box: zipfile.ZipFile) -> list[str]:
    return [_texts(x) for x in ElementTree.fromstring(box.read(_STRINGS)).iter(f"{_M}si")] if _STRINGS in box.namelist() else []


_PLAN = {"file": pa.string(), "part": pa.string(), "offset": pa.int64(), "packed": pa.int64(), "size": pa.int64(), "strings_offset": pa.int64(), "strings_packed": pa.int64(), "error": pa.string()}


def _planned(files: DataFrame, sheet: str | None) -> DataFrame:
    """The sheet to read of each workbook and where it and the shared strings lie; a row with an error for what is none.

    Workbooks without rows give no row. Only the directory, the list of sheets and a sheet's first filled row are read.
    """

    def of(path: str) -> list[tuple]:
        try:
            with opened(path) as file, zipfile.ZipFile(file) as box:
                part = _chosen_sheet(box, sheet)
                if part is None:
                    return []
                inside, strings = box.getinfo(part), box.getinfo(_STRINGS) if _STRINGS in box.namelist() else None
                size = inside.file_size + (strings.file_size if strings else 0)
                return [(path, part, inside.header_offset, inside.compress_size, size, strings and strings.header_offset, strings and strings.compress_size, None)]
        except DAMAGE as error:
            return [(path, *[None] * 6, f"not a workbook: {error}")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield archives.made([row for path in batch["path"].to_pylist() for row in of(path)], _PLAN)

    schema = ", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in _PLAN.items())
    return checkpointed(spread(files.select("path"), 100).mapInArrow(work, schema))


_ROWS = {"file": pa.string(), "row_number": pa.int32(), "headers": pa.list_(pa.string()), "cells": pa.list_(pa.string()), "error": pa.string()}
_ROWS_SQL = "file string, row_number int, headers array<string>, cells array<string>, error string"


def read_findings_sheet(spark: SparkSession, path: str | list[str], sheet: str | None = None, large: int = LARGE) -> DataFrame:
    """file, row_number (as in the sheet), headers, cells (arrays of text), error of the workbooks at a path.

    Workbooks whose sheet and strings unpack to at most `large` bytes are dealt over tasks whole. Of larger ones both are
    written into the shared folder, cut there at rows and strings in ranges, and joined by the strings' numbers. A workbook
    that is damaged or lacks the named sheet gives one row with its error (after the rows before the damage, if it lies
    inside the sheet); one without rows gives none.
    """
    plan = _planned(listed(spark, path).select("path", "length"), sheet)
    small = plan.where(F.coalesce("size", F.lit(0)) <= large)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                held: list[tuple] = [] if row["error"] is None else [(row["file"], None, None, None, row["error"])]
                try:
                    with opened(row["file"]) as file, zipfile.ZipFile(file) as box:
                        for number, headers, cells in _in_table(_every_row(box, row["part"], _shared(box))) if row["error"] is None else ():
                            held.append((row["file"], number, headers, cells, None))
                            if len(held) == 5000:
                                yield archives.made(held, _ROWS)
                                held = []
                except DAMAGE as error:
                    if row["error"] is None:
                        held.append((row["file"], None, None, None, f"damaged workbook: {error}"))
                yield archives.made(held, _ROWS)

    total = small.agg(F.sum("size")).first()[0] or 0  # unpacked: a sheet packs to a tenth or less, and what is parsed is what takes time
    found = small.repartitionByRange(max(1, -(-total // PARSED_BYTES)), "file").mapInArrow(work, _ROWS_SQL)
    big = plan.where(F.col("size") > large)
    return found if big.isEmpty() else found.unionByName(_large_rows(spark, big))


def _pieces(spark: SparkSession, plan: DataFrame, part: Column, offset: str, packed: str, tag: str) -> tuple[DataFrame, DataFrame]:
    """(file, block, pos, piece: what follows each `<tag`) of a part of the planned workbooks, and (file, error) of damaged ones."""
    members = plan.where(F.col(offset).isNotNull()).select("file", part.alias("member"), F.col(offset).alias("offset"), F.col(packed).alias("packed"), F.lit(None).cast("string").alias("error"))
    folder, laid = archives.laid_out(spark, archives.one_a_task(members), "sheet")
    good = laid.where("error is null").select("file", "name")
    errors = laid.where("error is not null").select("file", "error")
    if good.isEmpty():
        return spark.createDataFrame([], "file string, block long, pos long, piece string"), errors
    name = F.substring_index("_metadata.file_path", "/", -1)
    raw = spark.read.option("lineSep", f"<{tag}").text(folder)
    pieces = raw.select(name.alias("name"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"), F.col("value").alias("piece"))
    # what stands before the first one, and longer names that begin like the tag, are no pieces
    return pieces.where(F.col("piece").rlike(r"^[\s/>]")).join(good, "name").drop("name"), errors


def _element(tag: str, piece: str) -> ElementTree.Element:
    """The element that a piece begins with; ParseError if it is not whole. Prefixes of attributes are declared around it."""
    end = piece.find(f"</{tag}>")
    close = piece.find(">") + 1
    text = piece[:close] if piece[:close].endswith("/>") else piece[: end + len(tag) + 3] if end >= 0 else piece
    prefixes = " ".join(f'xmlns:{p}="urn:{p}"' for p in {*re.findall(r"[\s<]([A-Za-z_][\w.-]*):", text)} - {"xml", "xmlns"}) if ":" in text else ""
    return ElementTree.fromstring(f'<x xmlns="{_M[1:-1]}" {prefixes}><{tag}{text}</x>')[0]


_CELLS = {"file": pa.string(), "block": pa.int64(), "pos": pa.int64(), "row_number": pa.int32(), "cells": pa.list_(pa.struct([("at", pa.int32()), ("text", pa.string()), ("shared", pa.int64())])), "error": pa.string()}


def _large_rows(spark: SparkSession, plan: DataFrame) -> DataFrame:
    """The rows of read_findings_sheet of large workbooks: no task holds a sheet or its strings."""
    rows, broken = _pieces(spark, plan, F.col("part"), "offset", "packed", "row")
    strings, unreadable = _pieces(spark, plan, F.lit(_STRINGS), "strings_offset", "strings_packed", "si")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for file, block, pos, piece in zip(*(batch[c].to_pylist() for c in ("file", "block", "pos", "piece")), strict=True):
                try:
                    row = _element("row", piece)
                    own = {at: {"at": at, "text": text, "shared": k} for at, text, k in _cells(row)}
                    made.append((file, block, pos, int(row.get("r", 0)), [*own.values()], None))
                except DAMAGE as error:
                    made.append((file, block, pos, None, None, f"damaged row: {error}"))
            yield archives.made(made, _CELLS)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for piece in batch["piece"].to_pylist():
                try:
                    made.append(_texts(_element("si", piece)))
                except DAMAGE:
                    made.append(None)
            yield pa.RecordBatch.from_arrays([batch["file"], batch["block"], batch["pos"], pa.array(made, pa.string())], names=["file", "block", "pos", "text"])

    parsed = checkpointed(rows.select("file", "block", "pos", "piece").mapInArrow(cells, "file string, block long, pos long, row_number int, cells array<struct<at:int,text:string,shared:long>>, error string"))
    listed_ = checkpointed(strings.select("file", "block", "pos", "piece").mapInArrow(texts, "file string, block long, pos long, text string"))
    sizes = listed_.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    bases = sizes.select("file", "block", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("pos")) - 1
    known = listed_.withColumn("n", inside).join(bases, ["file", "block"]).select("file", (F.col("base") + F.col("n")).alias("shared"), F.col("text").alias("found"))
    each = parsed.where("error is null").select("file", "block", "pos", "row_number", F.explode_outer("cells").alias("c")).select("file", "block", "pos", "row_number", "c.at", "c.text", "c.shared")
    own = each.where("shared is null").select("file", "block", "pos", "row_number", "at", "text")
    met = each.where("shared is not null").join(known, ["file", "shared"], "left").select("file", "block", "pos", "row_number", "at", F.col("found").alias("text"))
    whole = own.unionByName(met).groupBy("file", "block", "pos", "row_number").agg(F.map_from_entries(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "text")))).alias("m"))
    width = F.coalesce(F.array_max(F.map_keys("m")) + 1, F.lit(0))
    lines = whole.select("file", "block", "pos", "row_number", F.transform(F.slice(F.sequence(F.lit(0), width), 1, width), lambda k: F.try_element_at(F.col("m"), k)).alias("cells"))
    filled = checkpointed(lines.where(F.exists("cells", lambda c: strip_all(c) != "")))
    place = F.struct("block", "pos")
    heads = filled.groupBy("file").agg(F.min(place).alias("top"), F.min_by(F.transform("cells", lambda c: F.coalesce(c, F.lit("None"))), place).alias("headers"))
    n = F.size("headers")
    below = filled.join(heads, "file").where(F.struct("block", "pos") > F.col("top"))
    rows_ = below.select("file", "row_number", "headers", F.transform("headers", lambda h, k: F.get(F.col("cells"), k)).alias("cells"), F.lit(None).cast("string").alias("error"))
    errors = broken.unionByName(unreadable).select("file", F.concat(F.lit("damaged workbook: "), "error").alias("error")).unionByName(parsed.where("error is not null").select("file", "error")).groupBy("file").agg(F.min("error").alias("error"))
    return rows_.unionByName(errors.select("file", F.lit(None).cast("int").alias("row_number"), *(F.lit(None).cast("array<string>").alias(c) for c in ("headers", "cells")), "error"))


def map_headers(rows: DataFrame) -> DataFrame:
    """file, recognized (map of header to field), unknown, missing, status: FULL with an object name, PARTIAL without,
    REJECTED for unreadable files and such without rows. Several headers may mean one field; a null header is unknown."""
    spark = rows.sparkSession
    known = spark.createDataFrame(list(ALIASES.items()), "alias string, field string")
    # the rows are gone through once: a file without headers stays as a row with none
    headed = rows.select("file", "headers").distinct().withColumn("headed", F.coalesce(F.size("headers") > 0, F.lit(False)))
    each = headed.select("file", "headed", F.explode_outer("headers").alias("header"))
    joined = each.withColumn("header", F.when(F.col("headed"), F.coalesce("header", F.lit("")))).distinct().join(F.broadcast(known), normalize_header(F.col("header")) == F.col("alias"), "left")
    found = joined.groupBy("file").agg(
        F.map_from_entries(F.array_sort(F.collect_set(F.when(F.col("field").isNotNull(), F.struct("header", "field"))))).alias("recognized"),
        F.array_sort(F.collect_list(F.when(F.col("field").isNull(), F.col("header")))).alias("unknown"), F.collect_set("field").alias("_found"), F.max("headed").alias("_headed"),
    )
    found = found.withColumn("missing", F.array_sort(F.array_except(F.array(*map(F.lit, sorted(ALIASES.values()))), "_found")))
    status = F.when(~F.col("_headed"), "REJECTED").when(F.array_contains("_found", "object_name_raw"), "FULL").otherwise("PARTIAL")
    return found.select("file", *(F.when(F.col("_headed"), F.col(c)).alias(c) for c in ("recognized", "unknown", "missing")), status.alias("status"))


def row_payload(headers: Column, cells: Column) -> Column:
    """Header to cell; of equal headers the last wins, and a cell under a null header is left out."""
    return last_wins(F.transform(headers, lambda h, i: F.struct(h.alias("key"), F.get(cells, i).alias("value"))))


def normalize_finding_rows(rows: DataFrame) -> DataFrame:
    """Findings: source_row_number, payload, row_fingerprint, the known fields trimmed (empty: null), warnings.

    priority is an integer or null with a warning; first_found_on is a date. Of several headers of one field the last
    wins. Rows without headers (errors) give none.
    """
    payload = row_payload(F.col("headers"), F.col("cells"))
    based = rows.where("headers is not null").select("file", F.col("row_number").alias("source_row_number"), payload.alias("payload"))
    by_field = last_wins(F.transform(F.arrays_zip(F.map_keys("payload").alias("k"), F.map_values("payload").alias("v")), lambda e: F.struct(normalize_header(e["k"]).alias("key"), e["v"].alias("value"))))
    named = based.withColumn("_fields", by_field)
    fields = {field: blank_to_null(F.try_element_at("_fields", F.lit(alias))) for alias, field in ALIASES.items()}
    out = named.withColumns(fields)
    priority = normalize_priority(F.col("priority"))
    out = out.withColumns({"_p": priority, "first_found_on": normalize_date(F.col("first_found_on"))})
    return out.withColumns({"priority": F.col("_p.priority"), "warnings": F.array_compact(F.array(F.col("_p.warning"))), "row_fingerprint": row_fingerprint(F.col("payload"))}).drop("_p", "_fields")


def is_usage_report(headers: Column) -> Column:
    """Whether a header row holds the whole signature, in any order and among others."""
    return _signed(F.transform(headers, lambda h: F.upper(normalize_header(h))))


def _signed(upper: Column) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, USAGE_SIGNATURE)), upper)) == 0


def _usage_payload(rows: DataFrame) -> DataFrame:
    upper = F.transform("headers", lambda h: F.upper(normalize_header(h)))
    return rows.where("headers is not null").where(is_usage_report(F.col("headers"))).withColumn("payload", row_payload(upper, F.col("cells")))


def read_usage_report(rows: DataFrame, assessment_id: int | None = None, dataset_id: int | None = None) -> DataFrame:
    """One USAGE_SIGNAL record for each row of a usage report; blank cells are left out of the payload."""
    based = _usage_payload(rows)
    key = F.concat(F.lit("usage_row:"), (F.col("row_number") - 2).cast("string"))  # the first row after the header is 0
    payload = F.map_filter("payload", lambda k, v: F.coalesce(F.trim(v) != "", F.lit(False)))

    def cell(name: str) -> Column:
        return blank_to_null(F.try_element_at("payload", F.lit(name)))

    return based.select(
        F.lit(assessment_id).cast("long").alias("assessment_id"), F.lit(dataset_id).cast("long").alias("dataset_id"), F.lit("panaya_usage_object").alias("record_type"), F.lit("USAGE_SIGNAL").alias("capability"),
        key.alias("source_key"), record_fingerprint(key).alias("record_fingerprint"), cell("OBJECT NAME").alias("object_name"), cell("OBJECT TYPE").alias("object_type"), cell("PACKAGE").alias("package_name"), payload.alias("payload"), "file",
    )


def usage_report_manifest(rows: DataFrame) -> DataFrame:
    """field, value, n: value counts of ORIGIN, USAGE LEVEL, OBJECT TYPE and MODULE (blank: `(vazio)`), and field ROWS."""

    def pairs(upper: Column) -> Column:
        def pair(field: str) -> Column:
            # of equal headers the last wins
            at = let(F.array_position(F.reverse(upper), field), lambda n: F.when(n > 0, F.size(upper) - n).cast("int"))
            return F.struct(F.lit(field).alias("field"), F.get(F.col("cells"), at).alias("value"))

        found = F.array(F.struct(F.lit("ROWS").alias("field"), F.lit(None).cast("string").alias("value")), *map(pair, ("ORIGIN", "USAGE LEVEL", "OBJECT TYPE", "MODULE")))
        return F.when(_signed(upper), found)

    # headers are gone through once a row (explode would have Spark filter the rows by them first), cells are trimmed once a value
    each = let(F.transform("headers", lambda h: F.upper(normalize_header(h))), pairs)
    raw = rows.select(F.explode_outer(each).alias("p")).where("p is not null").groupBy("p.field", "p.value").agg(F.count(F.lit(1)).alias("n"))
    value = F.when(F.col("field") == "ROWS", "").otherwise(F.coalesce(blank_to_null(F.col("value")), F.lit(BLANK)))
    return raw.select("field", value.alias("value"), "n").groupBy("field", "value").agg(F.sum("n").alias("n"))
