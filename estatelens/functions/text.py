"""Column helpers for names, headers, cells, fingerprints and short texts. None of them raises on bad cells."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from estatelens.functions.arrays import let

#: White space as the sources' own trimming understands it: all of Unicode's, not only blanks.
_EDGES = r"(?U)^\s+|\s+$"
#: Date formats in the order in which they are tried (fixed values).
DATE_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "dd.MM.yyyy", "MM/dd/yyyy")

#: Suffixes of each file category (fixed values); double suffixes come before the last one.
DOUBLE_SUFFIXES = r"\.(clas|intf|prog|fugr)\.xml$"
CATEGORY_SUFFIXES = {
    "abap_source": (".abap", ".prog", ".fugr", ".clas", ".intf", ".meth", ".html", ".htm"), "xml_metadata": (".xml", ".xslt"), "cds": (".cds",),
    "ddic": (".tabl", ".dtel", ".doma", ".ttyp", ".msag"), "configuration": (".yaml", ".yml", ".json", ".ini", ".cfg", ".properties"),
    "documentation": (".md", ".txt", ".pdf", ".rst"),
}


def strip_all(c: Column) -> Column:
    """Trim every kind of white space from both ends."""
    return F.regexp_replace(c, _EDGES, "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip_all(c), F.lit(""))


def canonical_key(object_type: Column, object_name: Column) -> Column:
    """TYPE::NAME in capitals without surrounding white space; null if either part is null."""
    return F.concat(F.upper(strip_all(object_type)), F.lit("::"), F.upper(strip_all(object_name)))


def normalize_header(c: Column) -> Column:
    """Lower case, white space trimmed and collapsed."""
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))  # once collapsed, only blanks are left at the ends


def normalize_rule_text(c: Column) -> Column:
    """Lower case, trimmed, white space collapsed; null counts as empty."""
    return normalize_header(F.coalesce(c, F.lit("")))


def normalize_priority(c: Column) -> Column:
    """Struct (priority int, warning string): text that is no integer gives null and a warning; 1.7 as a number gives 1."""
    text = strip_all(c.cast("string"))
    value = text.try_cast("int")
    return F.struct(value.alias("priority"), F.when(text.isNotNull() & (text != "") & value.isNull(), F.concat(F.lit("invalid priority: "), text)).alias("warning"))


def numeric_priority(c: Column) -> Column:
    """Priority of a numeric cell: cut to an integer."""
    return c.try_cast("bigint").try_cast("int")


def normalize_date(c: Column) -> Column:
    """Date of a spreadsheet serial (days after 1899-12-30) or of the first format that parses; null otherwise.

    A format is tried only on texts with its separator: a failed trial costs an exception with its stack.
    """
    text = strip_all(c.cast("string"))
    serial = F.regexp_replace(text, r"\.0*$", "").try_cast("int")
    from_serial = F.when(serial.between(1, 2_958_465), F.expr("date'1899-12-30'") + serial)
    return F.coalesce(from_serial, *(F.when(text.contains(f.strip("dMy")[0]), F.try_to_date(text, f)) for f in DATE_FORMATS))


def payload_text(payload: Column) -> Column:
    """A map as key=value lines in key order, the same for equal maps."""
    entries = F.sort_array(F.map_entries(payload))  # array_sort would compare through a lambda
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("\x00")))), "\n")


def row_fingerprint(payload: Column) -> Column:
    """16 hexadecimal digits over a row's payload: equal rows share it, wherever they stand."""
    return F.substring(F.sha2(payload_text(payload), 256), 1, 16)


def record_fingerprint(source_key: Column) -> Column:
    """32 hexadecimal digits over the record's place in its source."""
    return F.substring(F.sha2(source_key, 256), 1, 32)


def is_custom_object(name: Column) -> Column:
    """Whether a name lies in the customer name space: Z, Y or a slash first."""
    return F.coalesce(F.upper(name).rlike("^[ZY/]"), F.lit(False))


def short_payload(payload: Column, n: int = 5, most: int = 200) -> Column:
    """The first n entries as k=v, keys by length and then bytes, joined by commas and cut."""
    entries = F.sort_array(F.transform(F.map_entries(payload), lambda e: F.struct(F.length(e["key"]).alias("l"), e["key"].alias("k"), e["value"].alias("v"))))
    shown = F.transform(F.slice(entries, 1, n), lambda e: F.concat(e["k"], F.lit("="), F.coalesce(e["v"], F.lit(""))))
    return F.substring(F.array_join(shown, ", "), 1, most)


def last_wins(entries: Column) -> Column:
    """Map of an array of (key, value); of equal keys the last wins, null keys are left out."""

    def last(every: Column) -> Column:
        return F.filter(every, lambda e, i: e["key"].isNotNull() & ~F.exists(F.slice(every, i + 2, F.greatest(F.size(every), F.lit(1))), lambda x: x["key"].eqNullSafe(e["key"])))

    return F.map_from_entries(let(entries, last))


def map_literal(mapping: Mapping[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))


def recode(c: Column, mapping: Mapping[str, str | None], default: Column | None = None) -> Column:
    """Old value to new one; values outside the mapping become `default` (themselves if it is None)."""
    found = F.lit(None).cast("string") if not mapping else None
    for old, new in mapping.items():
        value = F.lit(new).cast("string")
        found = F.when(c == old, value) if found is None else found.when(c == old, value)
    return found.otherwise(c if default is None else default)


#: Old taxonomy of recommendations to the new one and back (fixed values); REVIEW is null in the new one.
TAXONOMY = {"RETAIN": "MANTER_AS_IS", "REMEDIATE": "REMEDIAR", "REPLATFORM": "REIMPLEMENTAR_EXTENSAO", "RETIRE": "DESCONTINUAR", "REVIEW": None}
TAXONOMY_BACK = {
    "MANTER_AS_IS": "RETAIN", "REMEDIAR": "REMEDIATE", "MODERNIZAR": "REMEDIATE", "ATUALIZAR_OSS": "REMEDIATE",
    "REIMPLEMENTAR_EXTENSAO": "REPLATFORM", "SUBSTITUIR_STANDARD": "REPLATFORM", "DESCONTINUAR": "RETIRE",
}
#: Display labels (fixed values).
LABELS = {
    "MODERNIZAR": "Modernizar", "MANTER_AS_IS": "Manter as-is", "REMEDIAR": "Remediar", "DESCONTINUAR": "Descontinuar",
    "REIMPLEMENTAR_EXTENSAO": "Reimplementar como extensão", "SUBSTITUIR_STANDARD": "Substituir por standard", "ATUALIZAR_OSS": "Atualizar via nota OSS",
}
UNCLASSIFIED_LABEL = "Não classificado"


def recommendation_label(c: Column) -> Column:
    """Display label of a recommendation; null and unknown codes give the label of the unclassified."""
    return F.coalesce(F.try_element_at(map_literal(LABELS), c), F.lit(UNCLASSIFIED_LABEL))


def query_text(name: Column, description: Column, domain: Column, entity_id: Column) -> Column:
    """What guidance is asked for about an application: name and description, else the domain, else the id."""
    both = F.btrim(F.concat_ws(". ", F.coalesce(name, F.lit("")), F.coalesce(description, F.lit(""))), F.lit(". "))
    return F.coalesce(F.nullif(both, F.lit("")), F.nullif(domain, F.lit("")), F.concat(F.lit("Application "), entity_id.cast("string")))


def rule_query_text(condition: Column, action: Column) -> Column:
    return strip_all(F.concat_ws(" ", condition, action))


def query_fingerprint(provider: Column, text: Column) -> Column:
    """sha256 of the provider and the normalised question."""
    return F.sha2(F.concat(provider, F.lit(":"), normalize_rule_text(text)), 256)


def classify_path(path: Column) -> Column:
    """Category of a source file by its suffix; a name that only has a leading dot has none."""
    name = F.lower(F.regexp_extract(path, r"([^/\\\\]*)$", 1))
    ext = F.regexp_extract(name, r"[^.].*?(\.[^.]+)$", 1)
    found = F.when(name.rlike(DOUBLE_SUFFIXES), "abap_source")
    for category, suffixes in CATEGORY_SUFFIXES.items():
        found = found.when(ext.isin(*suffixes), category)
    return found.otherwise("other")


def sanitize_xml(c: Column) -> Column:
    """Drop control characters that XML forbids, then numeric references to them (also surrogates, FFFE and FFFF)."""
    raw = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    decimal = r"&#0*(?:[0-8]|1[124-9]|2[0-9]|3[01]|127|5529[6-9]|55[3-9][0-9]{2}|56[0-9]{3}|57[0-2][0-9]{2}|573[0-3][0-9]|5734[0-3]|6553[45]);"
    hexadecimal = r"&#x0*(?:[0-8bBcCeEfF]|1[0-9a-fA-F]|7[fF]|[dD][89a-fA-F][0-9a-fA-F]{2}|[fF]{3}[eEfF]);"
    return F.regexp_replace(F.regexp_replace(raw, decimal, ""), hexadecimal, "")
