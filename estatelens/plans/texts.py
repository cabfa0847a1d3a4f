"""Text columns and extraction: X1, X7-X9, X12-X15, P1-P3, P5, P8-P12."""

from pyspark.sql import functions as F

from estatelens.functions import text as T
from estatelens.operators import extract as X
from estatelens.plans.base import Registry

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


@query("SELECT page_id, CASE WHEN regexp_matches(url, '[^/]\\.html?$') THEN 'abap_source' ELSE 'other' END AS category FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN concat(split_part(url, '?', 1), '.html') ELSE concat('/x/', CAST(page_id AS VARCHAR)) END AS url FROM pages)")
def x1_classify_path(i):
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.substring_index("url", "?", 1), F.lit(".html"))).otherwise(F.concat(F.lit("/x/"), F.col("page_id").cast("string")))
    return i.table("pages").select("page_id", T.classify_path(url).alias("category"))


@query("SELECT p_partkey, concat(upper(trim(p_type)), '::', upper(trim(p_name))) AS canonical_key FROM part")
def x8_canonical_key(i):
    padded = F.concat(F.lit("\t "), "p_name", F.lit(" \n"))
    return i.table("part").select("p_partkey", T.canonical_key(F.col("p_type"), padded).alias("canonical_key"))


@query("SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS header FROM documents")
def x12_normalize_header(i):
    return i.table("documents").select("doc_id", T.normalize_header(F.col("text")).alias("header"))


@query("SELECT doc_id, substring(sha256(concat('a=', coalesce(lang, chr(0)), chr(10), 'b=', coalesce(source, chr(0)))), 1, 16) AS fp FROM documents")
def p5_row_fingerprint(i):
    payload = F.create_map(F.lit("b"), "source", F.lit("a"), "lang")
    return i.table("documents").select("doc_id", T.row_fingerprint(payload).alias("fp"))


@query("SELECT event_id, TRY_CAST(trim(v) AS INT) AS priority, CASE WHEN TRY_CAST(trim(v) AS INT) IS NULL THEN concat('invalid priority: ', trim(v)) END AS warning FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN concat('x', CAST(event_id AS VARCHAR)) ELSE concat(' ', CAST(event_id % 9 AS VARCHAR)) END AS v FROM events)")
def p2_normalize_priority(i):
    cell = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("x"), F.col("event_id").cast("string"))).otherwise(F.concat(F.lit(" "), (F.col("event_id") % 9).cast("string")))
    return i.table("events").select("event_id", T.normalize_priority(cell).alias("p")).select("event_id", "p.priority", "p.warning")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders")
def p3_normalize_date(i):
    day = F.col("o_orderdate").cast("date")
    serial = F.datediff(day, F.lit("1899-12-30").cast("date")).cast("string")
    cell = F.when(F.col("o_orderkey") % 6 == 0, serial)
    for k, pattern in enumerate(("yyyy-MM-dd", "dd.MM.yyyy"), 1):
        cell = cell.when(F.col("o_orderkey") % 6 == k, F.date_format(day, pattern))
    cell = cell.when(F.col("o_orderkey") % 6 == 5, F.lit("never")).otherwise(F.concat(F.lit(" "), F.date_format(day, "yyyy-MM-dd")))
    return i.table("orders").select("o_orderkey", T.normalize_date(cell).alias("day"))


@query("SELECT event_id, substring(concat('k=', CAST(user_id AS VARCHAR), ', type=', event_type, ', value=', CAST(event_id AS VARCHAR)), 1, 30) AS short FROM events")
def p8_short_payload(i):
    payload = F.create_map(F.lit("value"), F.col("event_id").cast("string"), F.lit("type"), F.col("event_type"), F.lit("k"), F.col("user_id").cast("string"))
    return i.table("events").select("event_id", T.short_payload(payload, most=30).alias("short"))


@query("SELECT p_partkey, sha256(concat('prov:', lower(trim(concat(p_name, '. ', p_type))))) AS fp FROM part")
def p10_query_fingerprint(i):
    text = T.query_text(F.col("p_name"), F.col("p_type"), F.lit(None).cast("string"), F.col("p_partkey"))
    return i.table("part").select("p_partkey", T.query_fingerprint(F.lit("prov"), text).alias("fp"))


@query("SELECT application_id, CASE recommendation WHEN 'MODERNIZAR' THEN 'REMEDIATE' WHEN 'REMEDIAR' THEN 'REMEDIATE' ELSE 'REVIEW' END AS old, CASE recommendation WHEN 'MODERNIZAR' THEN 'Modernizar' WHEN 'REMEDIAR' THEN 'Remediar' ELSE 'Não classificado' END AS label FROM assessments", "assessments")
def p11_recode(i):
    old = F.coalesce(T.recode(F.col("recommendation"), T.TAXONOMY_BACK), F.lit("REVIEW"))
    return i.assessments.select("application_id", old.alias("old"), T.recommendation_label(F.col("recommendation")).alias("label"))


def files(i):
    return i.table("documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".abap")).alias("rel_path"), F.lit("abap_source").alias("category"), F.col("text").alias("content"))


@query(r"""WITH l AS (SELECT doc_id, line_no, line FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents))
SELECT doc_id AS file_id, upper(regexp_extract(line, '^\s*(?:[Tt]he|[Dd]ie|[Ll]es|[Ll]os)\s+(\w+)', 1)) AS target_name, CAST(line_no AS INT) AS source_line FROM l WHERE regexp_matches(line, '^(?:[Tt]he|[Dd]ie|[Ll]es|[Ll]os) +[a-zA-Z]+[ ,.]')""")
def x7_text_dependencies(i):
    pattern = r"(?m)^(?:[Tt]he|[Dd]ie|[Ll]es|[Ll]os) +([a-zA-Z]+)[ ,.]"
    return X.text_dependencies(files(i), {"WORD": (pattern, None)}).select("file_id", "target_name", "source_line")


#: Texts with source-like block ends, and their lines with the characters up to each line's end.
_LINES = r"""t AS (SELECT doc_id, regexp_replace(text, '(?m)^An', 'ENDMETHOD. An', 'g') AS text FROM documents),
l AS (SELECT doc_id, i, line, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS upto
      FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM t)),
ends AS (SELECT l.doc_id, upto FROM l WHERE regexp_matches(line, '(?i)^\s*END(METHOD|FORM|MODULE|FUNCTION)\b'))"""


@query(f"""WITH RECURSIVE {_LINES},
cuts AS (SELECT doc_id, CAST(0 AS HUGEINT) AS pos, 0 AS n FROM t WHERE length(text) > 600
  UNION ALL SELECT c.doc_id, min(e.upto), c.n + 1 FROM cuts c JOIN ends e ON e.doc_id = c.doc_id AND e.upto - c.pos >= 600 GROUP BY c.doc_id, c.pos, c.n),
parts AS (SELECT c.doc_id, c.n, CAST(c.pos AS BIGINT) AS a, CAST(coalesce(d.pos, length(t.text)) AS BIGINT) AS b FROM cuts c JOIN t ON t.doc_id = c.doc_id LEFT JOIN cuts d ON d.doc_id = c.doc_id AND d.n = c.n + 1)
SELECT p.doc_id, p.n AS chunk, sha256(substring(t.text, p.a + 1, p.b - p.a)) AS chunk_sha256 FROM parts p JOIN t ON t.doc_id = p.doc_id WHERE p.a < p.b
UNION ALL SELECT doc_id, 0, sha256(text) FROM t WHERE length(text) <= 600""")
def x9_chunk_source(i):
    text = F.regexp_replace("text", r"(?m)^An", "ENDMETHOD. An")
    chunks = i.table("documents").select("doc_id", F.posexplode(X.chunk_source(text, 600)).alias("chunk", "c"))
    return chunks.select("doc_id", "chunk", F.sha2("c", 256).alias("chunk_sha256"))


def _any_of(stems):
    return "(" + " OR ".join(f"contains(q, '{s}')" for s in stems) + ")"


_CATEGORIES = "concat_ws(',', " + ", ".join(f"CASE WHEN {_any_of(s)} THEN '{c}' END" for c, s in sorted(X.CATEGORY_STEMS.items())) + ")"


@query(f"""WITH f AS (SELECT conv_id, turn, concat(regexp_replace(strip_accents(lower(coalesce(text, ''))), '\\s+', ' ', 'g'), ' ') AS q FROM conversations)
SELECT conv_id, turn, {_any_of(X.OBJECT_STEMS)} AS wants_objects, {_any_of(X.APPLICATION_STEMS)} OR {_any_of(X.UNCLASSIFIED_STEMS)} OR {_CATEGORIES} <> '' AS wants_applications, {_any_of(X.FINDING_STEMS)} AS wants_atc, {_CATEGORIES} AS categories FROM f""")
def x13_question_intent(i):
    return X.question_intent(i.table("conversations").select("conv_id", "turn", F.col("text").alias("question"))).select("conv_id", "turn", "wants_objects", "wants_applications", "wants_atc", F.array_join("categories", ",").alias("categories"))


@query(r"""WITH b AS (SELECT page_id, list_transform(regexp_extract_all(html, '(?is)<div class="ad">(.*?)</div>', 1), lambda x: regexp_replace(regexp_replace(x, '(?i)<br\s*/?>', chr(10), 'g'), '<[^>]+>', '', 'g')) AS blocks FROM pages),
d AS (SELECT page_id, list_transform(blocks, lambda x: trim(replace(replace(replace(replace(replace(replace(x, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), chr(10))) AS blocks FROM b)
SELECT page_id, coalesce(trim(array_to_string(blocks, chr(10)), concat(chr(10), ' ', chr(9))), '') AS code FROM d""")
def x14_strip_listing_html(i):
    html = F.replace("html", F.lit('<div class="ad">'), F.lit('<div class="code">'))
    return X.strip_listing_html(i.table("pages").select("page_id", html.alias("content"))).select("page_id", "code")


@query(r"""WITH t AS (SELECT doc_id, text, regexp_matches(text, '\.\n?\z') AS closed FROM documents),
l AS (SELECT doc_id, i, regexp_extract(line, '^([A-Z]\w+) ', 1) AS word FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM t WHERE closed))
SELECT l.doc_id AS file_id, 'class' AS object_type, upper(concat('z', arg_min(word, i) FILTER (WHERE word <> ''))) AS object_name, CAST(min(i) FILTER (WHERE word <> '') AS INT) AS line_start,
       CAST(max(t.n) + 1 AS INT) AS line_end, 0 AS n_methods FROM l JOIN (SELECT doc_id, len(string_split(regexp_replace(text, '\n\z', ''), chr(10))) AS n FROM t) t ON t.doc_id = l.doc_id GROUP BY 1 HAVING count(*) FILTER (WHERE word <> '') > 0""")
def x15_extract_objects(i):
    marked = files(i).withColumn("content", F.regexp_replace(F.regexp_replace("content", r"(?m)^([A-Z]\w+) ", "CLASS z$1 DEFINITION "), r"\.$", ".\nENDCLASS."))
    found = X.extract_objects(marked)
    return found.select("file_id", "object_type", "object_name", "line_start", "line_end", F.size("attributes.methods").alias("n_methods"))


def sources(i):
    return i.sources.withColumn("category", T.classify_path(F.col("rel_path")))


_LISTS = ("methods", "importing", "exporting", "tables", "select_options", "parameters", "fields", "fixed_values")
_PLAIN = ("superclass", "table_type", "delivery_class", "data_type", "length")


def _flat(found):
    lists = [F.concat(F.lit(f"{n}="), F.array_join(f"attributes.{n}", ",")) for n in _LISTS]
    plain = [F.concat(F.lit(f"{n}="), F.col(f"attributes.{n}")) for n in _PLAIN]
    return found.select("file_id", "object_type", "object_name", "line_start", "line_end", F.concat_ws("; ", *lists, *plain).alias("details"))


_CLASS = "SELECT id AS file_id, 'class' AS object_type, concat('ZCL_', id) AS object_name, 2 AS line_start, 5 AS line_end, concat('methods=RUN_', p_size, ',STOP_', id % 7, '; superclass=ZCL_BASE', p_size) AS details FROM sources WHERE id % 4 = 0"
_FUNCTION = "SELECT id AS file_id, 'function_module' AS object_type, concat('Z_F', id % 50) AS object_name, 1 AS line_start, 6 AS line_end, concat('importing=IV_', p_size, ':STRING; exporting=EV_', id % 9, ':i') AS details FROM sources WHERE id % 4 = 1"
_REPORT = "SELECT id AS file_id, 'report' AS object_type, concat('ZREP_', id) AS object_name, 2 AS line_start, CAST(5 + p_size % 3 AS INT) AS line_end, concat('tables=MARA,T', p_size, '; select_options=SO_M', p_size, '; parameters=P_DATE') AS details FROM sources WHERE id % 4 = 2"
_DDIC = "SELECT id AS file_id, CASE WHEN id % 8 = 3 THEN 'ddic_table' ELSE 'ddic_domain' END AS object_type, concat(CASE WHEN id % 8 = 3 THEN 'ZT_' ELSE 'ZD_' END, id) AS object_name, 1 AS line_start, CAST(NULL AS INT) AS line_end, CASE WHEN id % 8 = 3 THEN concat('fields=MANDT:Client,F', p_size, ':The ', p_brand, '; table_type=TRANSP; delivery_class=A') ELSE concat('fixed_values=OP:Open,C', p_size, ':Closed ', p_brand, '; data_type=CHAR; length=', p_size) END AS details FROM sources WHERE id % 4 = 3"


@query(f"{_CLASS} UNION ALL {_FUNCTION} UNION ALL {_REPORT} UNION ALL {_DDIC}", "sources")
def x2_extract_objects(i):
    return _flat(X.extract_objects(sources(i)))


@query(_CLASS, "sources")
def x3_class_objects(i):
    return _flat(X.class_objects(sources(i)))


@query(_FUNCTION, "sources")
def x4_function_objects(i):
    return _flat(X.function_objects(sources(i)))


@query(_REPORT, "sources")
def x5_report_objects(i):
    return _flat(X.report_objects(sources(i)))


@query(_DDIC, "sources")
def x6_ddic_objects(i):
    return _flat(X.ddic_objects(sources(i).where("rel_path not like '%.abap'")))


def source_objects(i):
    return X.extract_objects(sources(i)).withColumn("id", F.col("file_id") * 10).withColumnRenamed("file_id", "source_file_id")


@query("""SELECT id * 10 AS object_id, 'CALL_FUNCTION' AS dep_type, concat('Z_F', id % 50) AS target_name, 'function_module' AS target_type, CAST(CASE WHEN id % 4 = 0 THEN 6 ELSE 5 END AS INT) AS source_line FROM sources WHERE id % 4 = 0 OR (id % 4 = 2 AND p_size % 3 > 0)
UNION ALL SELECT id * 10, 'INCLUDE', concat('ZINC_', p_size), NULL, CAST(7 + p_size % 3 AS INT) FROM sources WHERE id % 4 = 0
UNION ALL SELECT id * 10, 'INHERITS_FROM', concat('ZCL_BASE', p_size), 'class', NULL FROM sources WHERE id % 4 = 0
UNION ALL SELECT id * 10, 'USES_TABLE', unnest(['MARA', concat('T', p_size)]), 'ddic_table', NULL FROM sources WHERE id % 4 = 2""", "sources")
def x7_detect_dependencies(i):
    return X.detect_dependencies(source_objects(i), sources(i))


@query("""SELECT id * 10 AS object_id, CASE WHEN id % 4 = 0 THEN array_to_string(list_slice(string_split(content, chr(10)), 2, 5), chr(10)) WHEN id % 4 = 2 THEN array_to_string(list_slice(string_split(content, chr(10)), 2, 99), chr(10)) ELSE content END AS excerpt, false AS is_truncated FROM sources
UNION ALL SELECT id * 10 + 1, content, false FROM sources""", "sources")
def x10_code_excerpt(i):
    whole = sources(i).select((F.col("id") * 10 + 1).alias("id"), F.col("id").alias("source_file_id"), F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end"))
    return X.code_excerpt(source_objects(i).select(*whole.columns).unionByName(whole), sources(i))


@query(f"""WITH RECURSIVE {_LINES},
size AS (SELECT doc_id, length(regexp_replace(coalesce(text, ''), '\\n\\z', '')) AS n FROM t),
cuts AS (SELECT doc_id, CAST(0 AS HUGEINT) AS pos, 0 AS k FROM size WHERE n > 300
  UNION ALL SELECT c.doc_id, min(e.upto), c.k + 1 FROM cuts c JOIN ends e ON e.doc_id = c.doc_id AND e.upto - c.pos >= 300 GROUP BY c.doc_id, c.pos, c.k),
edges AS (SELECT c.doc_id, least(c.pos, s.n) AS pos FROM cuts c JOIN size s ON s.doc_id = c.doc_id WHERE c.k > 0 UNION SELECT doc_id, n FROM size),
kept AS (SELECT s.doc_id, s.n, coalesce(max(e.pos) FILTER (WHERE e.pos <= 900), min(e.pos)) AS pos FROM size s JOIN edges e ON e.doc_id = s.doc_id GROUP BY 1, 2)
SELECT k.doc_id AS object_id, sha256(substring(coalesce(t.text, ''), 1, CAST(pos AS BIGINT))) AS excerpt_sha256, pos < n AS is_truncated FROM kept k JOIN t ON t.doc_id = k.doc_id""")
def x10_code_excerpt_budget(i):
    held = files(i).withColumn("content", F.regexp_replace("content", r"(?m)^An", "ENDMETHOD. An"))
    objects = held.select("id", F.col("id").alias("source_file_id"), F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end"))
    return X.code_excerpt(objects, held, budget=900, most=300).select("object_id", F.sha2("excerpt", 256).alias("excerpt_sha256"), "is_truncated")


@query("SELECT p_partkey, regexp_matches(upper(n), '^[ZY/]') AS is_custom FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN concat('z', p_name) WHEN 1 THEN concat('/', p_name) WHEN 2 THEN concat('Y', p_name) ELSE p_name END AS n FROM part)")
def p7_is_custom_object(i):
    name = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("z"), "p_name")).when(F.col("p_partkey") % 5 == 1, F.concat(F.lit("/"), "p_name")).when(F.col("p_partkey") % 5 == 2, F.concat(F.lit("Y"), "p_name")).otherwise(F.col("p_name"))
    return i.table("part").select("p_partkey", T.is_custom_object(name).alias("is_custom"))


@query("SELECT conv_id, turn, lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS plain FROM conversations")
def p9_normalize_rule_text(i):
    return i.table("conversations").select("conv_id", "turn", T.normalize_rule_text(F.concat(F.lit(" \t"), "text", F.lit("\n "))).alias("plain"))
