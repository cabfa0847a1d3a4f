"""Objects and dependencies from source text.

Objects are found inside a file's row, so neither its text nor its lines are shuffled.
"""

from __future__ import annotations

import html
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatelens.functions.arrays import let, running
from estatelens.functions.text import strip_all

#: Where lines end: all of Unicode's line ends, as the parsers' line numbers count them.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"
ATTRIBUTES = "struct<methods:array<string>,superclass:string,importing:array<string>,exporting:array<string>,tables:array<string>,select_options:array<string>,parameters:array<string>,fields:array<string>,fixed_values:array<string>,table_type:string,delivery_class:string,data_type:string,length:string>"
FIELDS = [f.split(":") for f in ATTRIBUTES[7:-1].split(",")]
CLASS_DEF, METHOD, ENDCLASS, INHERITS = r"(?iU)^\s*CLASS\s+(\w+)\s+DEFINITION", r"(?iU)^\s*METHODS?\s*:?\s*(\w+)", r"(?iU)^\s*ENDCLASS\s*\.", r"(?iU)INHERITING\s+FROM\s+(\w+)"
FUNCTION, ENDFUNCTION = r"(?iU)^\s*FUNCTION\s+(\w+)\s*\.", r"(?iU)^\s*ENDFUNCTION\s*\."
REPORT, TABLES = r"(?iU)^\s*(?:REPORT|PROGRAM)\s+(\w+)", r"(?iU)^\s*TABLES\s*:\s*(.+)\."
PARAMETER, SECTION = r'(?iU)^\*"\s+VALUE\((\w+)\)\s+TYPE\s+(\S+)', r'(?iU)^\*"\s+(IMPORTING|EXPORTING)'


def lines_of(content: Column) -> Column:
    """A text's lines without their ends; a last line end starts no further line, an empty text has none."""
    cut = let(F.split(content, LINE_END, -1), lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, 1, F.size(x) - 1)).otherwise(x))
    return F.when(F.coalesce(content, F.lit("")) == "", F.array().cast("array<string>")).otherwise(cut)


def _attributes(**given: Column) -> Column:
    return F.struct(*(given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in FIELDS))


def _between(content: Column, start: str, end: str, made: Callable[[Column, Column, Column], Column]) -> Column:
    """What `made` makes of each stretch of a text's lines that ends with an end line and begins with the first start line
    since the end line before: of its lines, the number of the first (from 1) and that of the last. Other lines go.

    All of it stays in the text's row: a stretch is a slice of the row's lines. A text without an end is not cut into lines.
    """

    def stretches(lines: Column) -> Column:
        def each(ends: Column) -> Column:
            def own(e: Column, k: Column) -> Column:
                before = F.coalesce(F.get(ends, k - 1), F.lit(0))
                first = F.array_position(F.transform(F.slice(lines, before + 1, e - before), lambda x: x.rlike(start)), True).cast("int")
                return let(first, lambda n: F.when(n > 0, let(before + n, lambda a: made(F.slice(lines, a, e - a + 1), a, e))))

            return F.array_compact(F.transform(ends, own))

        return let(F.array_compact(F.transform(lines, lambda x, k: F.when(x.rlike(end), k + 1))), each)

    return F.when(content.rlike(end.replace(r"^\s*", "")), let(lines_of(content), stretches))


def _matches(lines: Column, pattern: str) -> Column:
    """In upper case what the pattern's first group is in those lines that it matches."""
    return F.transform(F.filter(F.transform(lines, lambda x: F.regexp_extract(x, pattern, 1)), lambda v: v != ""), lambda v: F.upper(v))


def _filled(values: Column) -> Column:
    return let(values, lambda v: F.when(F.size(v) > 0, v))


def _object(kind: str, name: Column, line_start: Column, line_end: Column, attributes: Column) -> Column:
    return F.struct(F.lit(kind).alias("object_type"), name.alias("object_name"), line_start.alias("line_start"), line_end.alias("line_end"), attributes.alias("attributes"))


def _objects(files: DataFrame, found: Column) -> DataFrame:
    # explode would have Spark filter the files by `found` first, and so find it twice
    rows = files.select(F.col("id").alias("file_id"), F.explode_outer(found).alias("o")).where("o is not null")
    return rows.select("file_id", "o.object_type", "o.object_name", "o.line_start", "o.line_end", "o.attributes")


def _classes(content: Column) -> Column:
    def made(lines: Column, a: Column, e: Column) -> Column:
        def of(own: Column) -> Column:
            attributes = _attributes(methods=_matches(F.slice(own, 2, F.size(own)), METHOD), superclass=F.get(_matches(own, INHERITS), 0))
            return _object("class", F.upper(F.regexp_extract(own[0], CLASS_DEF, 1)), a, e, attributes)

        return let(lines, of)

    return _between(content, CLASS_DEF, ENDCLASS, made)


def class_objects(files: DataFrame) -> DataFrame:
    """Classes: from CLASS x DEFINITION to the next ENDCLASS, with the first method of every METHODS line and the superclass.

    A deferred definition opens a class as well, and everything up to the next ENDCLASS belongs to it.
    """
    return _objects(files, _classes(F.col("content")))


def _functions(content: Column) -> Column:
    def parameters(own: Column, name: str) -> Column:
        at = F.transform(F.transform(own, lambda x: F.upper(F.regexp_extract(x, SECTION, 1))), lambda s, k: F.when(s != "", F.struct(s.alias("section"), (k + 1).alias("k"))))

        def listed(sections: Column) -> Column:
            def part(x: Column, k: Column) -> Column:
                upto = F.coalesce(F.get(sections, k + 1)["k"], F.size(own) + 1)
                return F.when(x["section"] == name, F.slice(own, x["k"] + 1, upto - x["k"] - 1))

            lines = F.filter(F.flatten(F.array_compact(F.transform(sections, part))), lambda x: x.rlike(PARAMETER))
            return F.transform(lines, lambda x: F.concat(F.regexp_extract(x, PARAMETER, 1), F.lit(":"), F.regexp_extract(x, PARAMETER, 2)))

        return _filled(let(F.array_compact(at), listed))

    def made(lines: Column, a: Column, e: Column) -> Column:
        def of(own: Column) -> Column:
            attributes = _attributes(importing=parameters(own, "IMPORTING"), exporting=parameters(own, "EXPORTING"))
            return _object("function_module", F.upper(F.regexp_extract(own[0], FUNCTION, 1)), a, e, attributes)

        return let(lines, of)

    return _between(content, FUNCTION, ENDFUNCTION, made)


def function_objects(files: DataFrame) -> DataFrame:
    """Function modules with their VALUE parameters (NAME:TYPE) of the importing and exporting sections."""
    return _objects(files, _functions(F.col("content")))


def _reports(content: Column) -> Column:
    def names(after: Column, prefix: str) -> Column:
        hits = F.flatten(F.transform(after, lambda x: F.regexp_extract_all(x, F.lit(rf"(?iU)\b{prefix}_(\w+)\b"), F.lit(1))))
        return F.array_distinct(F.transform(hits, lambda n: F.concat(F.lit(f"{prefix.upper()}_"), F.upper(n))))

    def tables(after: Column) -> Column:
        return F.flatten(F.transform(F.filter(after, lambda x: x.rlike(TABLES)), lambda x: F.transform(F.split(F.regexp_extract(x, TABLES, 1), ","), lambda t: F.upper(strip_all(t)))))

    def of(lines: Column) -> Column:
        def begun(start: Column) -> Column:
            def found(after: Column) -> Column:
                attributes = _attributes(tables=_filled(tables(after)), select_options=_filled(names(after, "so")), parameters=_filled(names(after, "p")))
                return _object("report", F.upper(F.regexp_extract(F.element_at(lines, start), REPORT, 1)), start, F.size(lines), attributes)

            return F.when(start > 0, let(F.slice(lines, start + 1, F.size(lines)), found))

        return let(F.array_position(F.transform(lines, lambda x: x.rlike(REPORT)), True).cast("int"), begun)

    # a text that holds no such words is not cut into lines
    return F.when(content.rlike(REPORT.replace(r"^\s*", "")), F.array_compact(F.array(let(lines_of(content), of))))


def report_objects(files: DataFrame) -> DataFrame:
    """Reports: the first REPORT or PROGRAM line; TABLES, so_ and p_ names after it; the end is the last line."""
    return _objects(files, _reports(F.col("content")))


def ddic_objects(files: DataFrame) -> DataFrame:
    """Dictionary tables and domains by their header line, else by the file's stem for .tabl and .doma."""
    table, domain = r"(?iU)DDIC Table Definition:\s*(\w+)", r"(?iU)DDIC Domain:\s*(\w+)"
    held = files.select(F.col("id").alias("file_id"), "rel_path", lines_of(F.col("content")).alias("lines"))

    def first(pattern: str) -> Column:
        return F.get(F.transform(F.filter("lines", lambda x: x.rlike(pattern)), lambda x: F.regexp_extract(x, pattern, 1)), 0)

    def last(pattern: str) -> Column:
        hits = F.filter(F.transform("lines", lambda x: strip_all(F.regexp_extract(x, pattern, 1))), lambda v: v != "")
        return F.when(F.size(hits) > 0, F.element_at(hits, -1))

    def pairs(start: Column, pattern: str) -> Column:
        after = F.slice("lines", start.cast("int") + 1, F.greatest(F.size("lines"), F.lit(1)))
        found = F.transform(F.filter(after, lambda x: x.rlike(pattern)), lambda x: F.concat(strip_all(F.regexp_extract(x, pattern, 1)), F.lit(":"), strip_all(F.regexp_extract(x, pattern, 2))))
        return F.when((start > 0) & (F.size(found) > 0), found)

    stem = F.upper(F.regexp_replace(F.regexp_extract("rel_path", r"([^/\\]*)$", 1), r"\.[^.]*$", ""))
    ext = F.lower(F.regexp_extract("rel_path", r"\.([^./\\]*)$", 1))
    kind = F.when(first(table).isNotNull(), "ddic_table").when(first(domain).isNotNull(), "ddic_domain").when(ext == "tabl", "ddic_table").when(ext == "doma", "ddic_domain")
    named = F.coalesce(first(table), first(domain)).isNotNull()
    is_table = first(table).isNotNull()
    fields_at = F.array_position(F.transform("lines", lambda x: strip_all(x).startswith("Fields:")), True)
    values_at = F.array_position(F.transform("lines", lambda x: x.contains("Fixed Values")), True)
    is_domain = ~is_table & first(domain).isNotNull()
    attributes = _attributes(
        table_type=F.when(is_table, last(r"(?iU)Table Type:\s*(.+)")), delivery_class=F.when(is_table, last(r"(?iU)Delivery Class:\s*(\w+)")), fields=F.when(is_table, pairs(fields_at, r"(?U)^\s+(\w+)\s+\w+\s+\d+\s+(.+)$")),
        data_type=F.when(is_domain, last(r"(?iU)Data Type:\s*(\w+)")), length=F.when(is_domain, last(r"(?iU)Length:\s*(\d+)")), fixed_values=F.when(is_domain, pairs(values_at, r"(?U)^\s+(\w+)\s+(.+)$")),
    )
    name = F.when(named, F.upper(F.coalesce(first(table), first(domain)))).otherwise(stem)
    return held.withColumn("kind", kind).where("kind is not null").select("file_id", F.col("kind").alias("object_type"), name.alias("object_name"), F.lit(1).alias("line_start"), F.lit(None).cast("int").alias("line_end"), attributes.alias("attributes"))


def extract_objects(files: DataFrame) -> DataFrame:
    """Objects of all files (id, rel_path, category, content): dictionary files by category or extension; source files as
    classes, else a report if it starts as one, else functions, else a report. Other categories give none."""
    ext = F.lower(F.regexp_extract("rel_path", r"\.([^./\\]*)$", 1))
    is_ddic = (F.col("category") == "ddic") | ext.isin("tabl", "doma", "dtel", "stru", "type")
    source = files.where(~is_ddic).where(F.col("category") == "abap_source")
    leads, content = F.col("content").rlike(r"(?iU)^\s*(?:REPORT|PROGRAM) "), F.col("content")
    # step by step, so that a text is looked through only for what may still count
    own = source.select("id", "content", _classes(content).alias("_found"))
    for more in (F.when(leads, _reports(content)), _functions(content), _reports(content)):
        own = own.withColumn("_found", F.when(F.size("_found") > 0, F.col("_found")).otherwise(more))
    best = _objects(own, F.col("_found"))
    return best.unionByName(ddic_objects(files.where(is_ddic)))


DEPENDENCIES = {"CALL_FUNCTION": (r"(?im)^\s*CALL\s+FUNCTION\s+'(\w+)'", "function_module"), "INCLUDE": (r"(?im)^\s*INCLUDE\s+(\w+)\s*\.", None)}


def text_dependencies(files: DataFrame, patterns: dict[str, tuple[str, str | None]] | None = None) -> DataFrame:
    """file_id, dep_type, target_name, target_type, source_line of every call and include of a file's text.

    The line is that where the match starts, and blank lines before a statement belong to the match.
    """
    out = None
    for k, (kind, (pattern, target)) in enumerate((patterns or DEPENDENCIES).items()):
        hits, gaps = F.regexp_extract_all("content", F.lit(pattern), F.lit(0)), F.split("content", pattern, -1)
        names = F.regexp_extract_all("content", F.lit(pattern), F.lit(1))

        def breaks(x: Column) -> Column:
            return F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))

        pieces = F.zip_with(F.zip_with(gaps, hits, lambda g, h: F.struct(breaks(g).alias("g"), F.coalesce(breaks(h), F.lit(0)).alias("h"))), names, lambda s, n: F.struct(s["g"].alias("g"), s["h"].alias("h"), n.alias("n")))

        def placed(steps: Column) -> Column:
            found = let(running(F.transform(steps, lambda s: s["g"] + s["h"])), lambda before: F.zip_with(steps, before, lambda s, b: F.struct(F.upper(s["n"]).alias("name"), (b + s["g"] + 1).alias("line"))))
            return F.filter(found, lambda x: x["name"].isNotNull())

        walked = let(pieces, placed)
        rows = files.select(F.col("id").alias("file_id"), F.posexplode(walked).alias("pos", "d"))
        rows = rows.select("file_id", F.lit(k).alias("turn"), "pos", F.lit(kind).alias("dep_type"), F.col("d.name").alias("target_name"), F.lit(target).cast("string").alias("target_type"), F.col("d.line").alias("source_line"))
        out = rows if out is None else out.unionByName(rows)
    return out


def detect_dependencies(objects: DataFrame, files: DataFrame) -> DataFrame:
    """object_id, dep_type, target_name, target_type, source_line: calls and includes of the object's whole file, its
    superclass and its tables; one row for each target and type, the first in that order.

    objects: id, source_file_id, object_type, attributes (as extract_objects gives them).
    """
    ids = objects.select(F.col("id").alias("object_id"), F.col("source_file_id").alias("file_id"))
    text = ids.join(text_dependencies(files), "file_id").drop("file_id")
    none = F.lit(None).cast("int")
    inherits = objects.where("object_type = 'class' and coalesce(attributes.superclass, '') <> ''").select(F.col("id").alias("object_id"), F.lit(2).alias("turn"), F.lit(0).alias("pos"), F.lit("INHERITS_FROM").alias("dep_type"), F.upper("attributes.superclass").alias("target_name"), F.lit("class").alias("target_type"), none.alias("source_line"))
    tables = objects.select(F.col("id").alias("object_id"), F.lit(3).alias("turn"), F.posexplode("attributes.tables").alias("pos", "t")).select("object_id", "turn", "pos", F.lit("USES_TABLE").alias("dep_type"), F.upper("t").alias("target_name"), F.lit("ddic_table").alias("target_type"), none.alias("source_line"))
    order = Window.partitionBy("object_id", "target_name", "dep_type").orderBy("turn", "pos")
    return text.unionByName(inherits).unionByName(tables).withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank", "turn", "pos")


def chunks_of(content: str, most: int = 6000) -> list[str]:
    """Source in pieces that end at END(METHOD|FORM|MODULE|FUNCTION) lines once they have `most` characters; whole if it
    is short or has no such line."""
    if len(content) <= most:
        return [content]
    done, held, size = [], [], 0
    for line in content.splitlines(keepends=True):
        held.append(line)
        size += len(line)
        if size >= most and re.match(r"\s*END(METHOD|FORM|MODULE|FUNCTION)\b", line, re.IGNORECASE):
            done.append("".join(held))
            held, size = [], 0
    return done + ["".join(held)] * bool(held)


def chunk_source(content: Column, most: int = 6000) -> Column:
    """Array of the chunks of a text; null gives null."""

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else chunks_of(t, most))

    return cut(content)


def code_excerpt(objects: DataFrame, files: DataFrame, budget: int = 12_000, most: int = 6000) -> DataFrame:
    """object_id, excerpt, is_truncated: the object's own lines in whole chunks until the budget; the first one always.

    A file's text meets the ranges of all its objects in one row and is cut there; only the objects' own lines go on.
    Objects without a file give no row, a null text an empty excerpt.
    """
    ranges = objects.groupBy(F.col("source_file_id").alias("_file")).agg(F.collect_list(F.struct(F.col("id").alias("object_id"), F.col("line_start").cast("int").alias("a"), F.col("line_end").cast("int").alias("b"))).alias("own"))

    def part(lines: Column) -> Column:
        return F.transform("own", lambda o: F.struct(o["object_id"].alias("object_id"), F.array_join(F.slice(lines, F.greatest(F.coalesce(o["a"], F.lit(1)), F.lit(1)), F.greatest(F.coalesce(o["b"], F.size(lines)) - F.coalesce(o["a"], F.lit(1)) + 1, F.lit(0))), "\n").alias("text")))

    held = files.select(F.col("id").alias("_file"), "content").join(ranges, "_file")
    cut = held.select(F.explode(let(lines_of(F.coalesce("content", F.lit(""))), part)).alias("o")).select("o.object_id", "o.text")

    @F.pandas_udf("struct<excerpt:string,is_truncated:boolean>")
    def fit(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                kept, size, pieces = [], 0, chunks_of(t, most)
                for piece in pieces:
                    if kept and size + len(piece) > budget:
                        break
                    kept.append(piece)
                    size += len(piece)
                rows.append(("".join(kept), len(kept) < len(pieces)))
            yield pd.DataFrame(rows, columns=["excerpt", "is_truncated"])

    return cut.select("object_id", fit("text").alias("x")).select("object_id", "x.excerpt", "x.is_truncated")


def _folded_letters() -> tuple[str, str]:
    """Characters of the basic plane that are one other character once lowered, decomposed and rid of their marks."""
    pairs = []
    for c in map(chr, (*range(0x80, 0xD800), *range(0xF900, 0x10000))):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != c:
            pairs.append((c, plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


#: Ligatures that stand for several letters (fixed values).
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ĳ": "ij"}


def fold_accents(c: Column) -> Column:
    """Lower case without accents, white space collapsed, one space at the end; null counts as empty."""
    plain = F.translate(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\p{M}+", ""), *_folded_letters())
    for sign, letters in LIGATURES.items():
        plain = F.replace(plain, F.lit(sign), F.lit(letters))
    return F.concat(F.regexp_replace(plain, r"(?U)\s+", " "), F.lit(" "))


#: Word stems of questions (fixed values).
CATEGORY_STEMS = {
    "MODERNIZAR": ("moderniz", "modernis"), "MANTER_AS_IS": ("manter", "mantid", "as-is", "as is", "retain"), "REMEDIAR": ("remedi", "remediat"),
    "DESCONTINUAR": ("descontinu", "retire", "retir", "obsolet"), "REIMPLEMENTAR_EXTENSAO": ("reimplement", "extens", "side-by-side", "btp", "replatform"),
    "SUBSTITUIR_STANDARD": ("substitu", "standard", "padrao"), "ATUALIZAR_OSS": ("oss", "nota sap", "sap note"),
}
OBJECT_STEMS = ("objeto", "object", "classe", "class", "programa", "report", "funcao", "function", "modulo", "listar", "liste", "lista", "list ")
APPLICATION_STEMS = ("aplicac", "application", "app ", "apps", "customizac", "clean core", "categor", "classific", "recomend", "recommend")
FINDING_STEMS = ("atc", "finding", "achado", "prioridade", "priority", "check", "erro", "critic")
UNCLASSIFIED_STEMS = ("nao classific", "sem classific", "unclassif")


def question_intent(df: DataFrame, question: str = "question") -> DataFrame:
    """Add wants_objects, wants_applications, wants_atc, wants_unclassified and categories (sorted) to questions."""
    folded = df.withColumn("_q", fold_accents(F.col(question)))

    def any_of(stems: tuple[str, ...]) -> Column:
        found = F.lit(False)
        for s in stems:
            found = found | F.col("_q").contains(s)
        return found

    named = F.array_sort(F.array_compact(F.array(*(F.when(any_of(s), F.lit(c)) for c, s in CATEGORY_STEMS.items()))))
    out = folded.withColumns({"categories": named, "wants_unclassified": any_of(UNCLASSIFIED_STEMS), "wants_objects": any_of(OBJECT_STEMS), "wants_atc": any_of(FINDING_STEMS)})
    return out.withColumn("wants_applications", any_of(APPLICATION_STEMS) | (F.size("categories") > 0) | F.col("wants_unclassified")).drop("_q")


#: A reference: decimal, hexadecimal or by name, with or without its semicolon.
REFERENCE = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def unescape_html(c: Column) -> Column:
    """HTML references decoded as browsers do: names with a semicolon, the older ones also without, numbers with the
    replacements for control and impossible ones; what is no reference stays."""
    names = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")
    low = F.from_json(F.lit(json.dumps({str(n): html.unescape(f"&#{n};") for n in range(160)})), "map<string,string>")
    longest = max(len(n) for n in html5 if not n.endswith(";"))

    def number(ref: Column) -> Column:
        digits = F.regexp_replace(ref, "^#[xX]?0*(?=.)|;$", "")
        value = F.when(F.length(digits) > 8, None).when(ref.rlike("^#[xX]"), F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).try_cast("long")
        sign = F.decode(F.unhex(F.lpad(F.hex(value), 8, "0")), "UTF-32")
        none = value.between(0xFDD0, 0xFDEF) | (value.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
        impossible = value.isNull() | (value > 0x10FFFF) | value.between(0xD800, 0xDFFF)
        return F.when(impossible, "\ufffd").when(value < 160, F.element_at(low, value.cast("string"))).when(none, "").otherwise(sign)

    def named(ref: Column) -> Column:
        starts = [F.concat(F.try_element_at(names, F.left(ref, F.lit(n))), F.substr(ref, F.lit(n + 1))) for n in range(longest, 1, -1)]
        return F.coalesce(F.try_element_at(names, ref), *starts, F.concat(F.lit("&"), ref))

    def decoded(gaps: Column) -> Column:
        refs = F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(1))
        return F.array_join(F.zip_with(gaps, refs, lambda g, r: F.concat(g, F.when(r.isNull(), "").when(r.startswith("#"), number(r)).otherwise(named(r)))), "")

    return F.when(c.contains("&"), let(F.split(c, REFERENCE, -1), decoded)).otherwise(c)


def listing_blocks(raw: Column) -> Column:
    """The code blocks of an HTML listing in order, line breaks kept and tags out, entities still encoded."""
    blocks = F.regexp_extract_all(raw, F.lit(r'(?is)<div class="(?:code|codeComment)">(.*?)</div>'), F.lit(1))
    return F.transform(blocks, lambda b: F.regexp_replace(F.regexp_replace(b, r"(?i)<br\s*/?>", "\n"), "<[^>]+>", ""))


def strip_listing_html(df: DataFrame, raw: str = "content", out: str = "code") -> DataFrame:
    """Add the plain text of an HTML code listing; a page without code blocks gives the empty text."""
    marked = df.withColumn("_joined", F.array_join(listing_blocks(F.col(raw)), "\x02"))
    clean = F.replace(unescape_html(F.col("_joined")), F.lit("\xa0"), F.lit(" "))
    return marked.withColumn("_joined", clean).withColumn(out, strip_all(F.array_join(F.transform(F.split("_joined", "\x02", -1), lambda b: F.regexp_replace(b, r"^\n+|\n+$", "")), "\n"))).drop("_joined")


def reassemble_listings(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assembled, consumed): source rebuilt from HTML listings, one file a class, one a method.

    files: id, rel_path, content. A class and the methods of the same folder (public_methods and private_methods belong to
    the folder above) make one text: the definition, closed if it is not, and the methods by name in an implementation. Methods
    without a class stay. assembled: rel_path, content; consumed: ids of the files that went in.
    """
    class_title, method_title = r"(?iU)<h2>\s*Code listing for class:\s*([\w/]+)\s*</h2>", r"(?iU)<h2>\s*Code listing for:\s*([\w/]+)\s*</h2>"
    pages = files.where(F.lower("rel_path").rlike(r"\.html?$") & ~F.lower("rel_path").rlike(r"(^|/)dictionary(/|$)"))
    named = pages.withColumns({"class_name": F.nullif(F.upper(F.regexp_extract("content", class_title, 1)), F.lit("")), "method_name": F.nullif(F.upper(F.regexp_extract("content", method_title, 1)), F.lit(""))})
    named = named.where("class_name is not null or method_name is not null")
    folder = F.regexp_replace(F.regexp_replace(F.replace("rel_path", F.lit("\\"), F.lit("/")), r"/?[^/]*$", ""), r"(?i)/?(?:public|private)_methods$", "")
    parts = strip_listing_html(named).select("id", folder.alias("folder"), "class_name", F.when(F.col("class_name").isNull(), F.col("method_name")).alias("method_name"), "code")
    methods = F.transform(F.array_sort(F.collect_list(F.when(F.col("method_name").isNotNull(), F.struct("method_name", "id", "code")))), lambda x: strip_all(x["code"]))
    groups = parts.groupBy("folder").agg(F.max(F.when(F.col("class_name").isNotNull(), F.struct("id", "class_name", "code"))).alias("c"), methods.alias("methods")).where("c is not null")
    body = F.regexp_replace("c.code", r"(?U)\s+$", "")
    closed = F.when(body.rlike(r"(?i)ENDCLASS\s*\.\s*$"), body).otherwise(F.concat(body, F.lit("\nENDCLASS.")))
    text = F.when(F.size("methods") == 0, F.concat(closed, F.lit("\n"))).otherwise(F.concat(closed, F.lit("\n\nCLASS "), "c.class_name", F.lit(" IMPLEMENTATION.\n\n"), F.array_join("methods", "\n\n"), F.lit("\n\nENDCLASS.\n")))
    assembled = groups.select(F.concat("folder", F.lit("/.assembled/"), "c.class_name", F.lit(".abap")).alias("rel_path"), text.alias("content"))
    used = groups.select("folder", F.col("c.id").alias("_class"))
    consumed = parts.join(used, "folder").where("method_name is not null or id = _class").select("id")
    return assembled, consumed
