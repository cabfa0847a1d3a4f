"""Personal data by bootstrapped contextual extraction, with Spark SQL functions only (operator 8).

Matches of the base patterns and credentials of well-known form are the seeds. What stands around them induces lexical
patterns, and long random strings a pattern of their alphabet; patterns and instances form a graph over the whole corpus, on
which their confidences are computed in turn: a pattern is as good as the instances that it surrounds, an instance as
good as its patterns together. Identifier-like tokens that only confident patterns vouch for are the discoveries.

A text is cut at a pattern's matches once; places are running sums over the pieces and a match's context comes from the
pieces beside it, so the work grows with the text and not with its square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.functions.arrays import let, running
from estatelens.storage import checkpointed

#: Contract: the base patterns in the order of their kinds (fixed values). Quantifiers are possessive and starts are
#: anchored at a run's first character where that gives the same matches, so long runs are read once.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character that a text needs for a match of the kind.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: Kinds of spans: credentials come after the base kinds.
ALL_KINDS = [*KINDS, "secret"]
TOKEN = r"(?<!\S)\S*(?:[0-9]|(?:AKIA|ASIA)[A-Z]{16})\S*"
#: Seeds of credentials (fixed values): what is assigned to such a name, and key ids of such a form. Other names under which
#: credentials stand, `token` among them, are for the graph to find.
SECRET_NAMES = ("password", "passwd", "pwd", "secret")
SECRET_FORMS = r"^(?:AKIA|ASIA)[A-Z0-9]{16}$"
#: Alphabets of long random strings, as patterns beside the lexical ones.
SHAPES = {
    "s:hex": r"^(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{16,}$", "s:key": r"^(?=[A-Z0-9]*[0-9])(?=[A-Z0-9]*[A-Z])[A-Z0-9]{16,}$",
    "s:mixed": r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_+/-]{20,}=*$",
    "s:long": r"^(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,})$",
}
#: A seed pattern: so far a long hexadecimal string is trusted to be a credential before the graph says more. Alone it
#: vouches for nothing, commit hashes look the same.
SEED_PATTERN, TRUST = "s:long", 0.6
#: Context that a match has at either side, in characters.
BEFORE, AFTER = 60, 40
ROUNDS = 4
ACCEPT = 0.8


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, "[.]"), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=[0-9])", "").try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return F.when(F.length(_digits(hit)).between(16, 19), _luhn(_digits(hit))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(hit)).between(8, 15)
    return F.lit(True)


def _cut(text: Column, pattern: str, need: str = "") -> Column:
    """(hit, after, start) for the text's head, whose hit is null, and every match in order, by a single pass of the pattern."""
    marked = F.regexp_replace(F.translate(text, "\x01\x02", "\x03\x03"), pattern, "\x01$0\x02")
    marked = F.when(text.contains(need), marked).otherwise(text) if need else marked
    pieces = F.transform(F.split(marked, "\x01", -1), lambda p, i: F.struct(F.when(i > 0, F.substring_index(p, "\x02", 1)).alias("hit"), F.when(i > 0, F.substring_index(p, "\x02", -1)).otherwise(p).alias("after")))

    def placed(found: Column) -> Column:
        lengths = F.transform(found, lambda x: F.coalesce(F.length(x["hit"]), F.lit(0)) + F.length(x["after"]))
        return let(running(lengths), lambda starts: F.zip_with(found, starts, lambda x, s: F.struct(x["hit"].alias("hit"), x["after"].alias("after"), s.alias("start"))))

    # a text without matches, as most are, is one piece
    return let(pieces, lambda found: F.when(F.size(found) > 1, placed(found)))


def _contexts(pieces: Column) -> Column:
    """The matches of _cut with the text before and after them as far as the next match, which stands there as `#`."""

    def one(x: Column, i: Column) -> Column:
        held = F.get(pieces, i - 1)
        before = F.concat(F.when(i > 1, "#").otherwise(""), F.right(held["after"], F.lit(BEFORE)))
        after = F.concat(F.left(x["after"], F.lit(AFTER)), F.when(i + 1 < F.size(pieces), "#").otherwise(""))
        return F.struct(x["hit"].alias("hit"), x["start"].alias("start"), before.alias("before"), after.alias("after"))

    return F.slice(F.transform(pieces, one), 2, F.greatest(F.size(pieces), F.lit(1)))


def _described(kind: Column, instance: Column, start: Column, before: Column, after: Column) -> Column:
    """A mention: its kind (null if it is to be found out), place, string and patterns. Tokens with digits count as `#`."""
    left, right = (F.regexp_replace(F.lower(x), r"\S*[0-9]\S*", "#") for x in (before, after))
    parts = [("l:", F.regexp_extract(left, r"(\S+)\s*$", 1)), ("k:", F.regexp_extract(left, r"(\S+\s+\S+)\s*$", 1)), ("r:", F.regexp_extract(right, r"^\s*(\S+)", 1))]
    lexical = [F.when(x != "", F.concat(F.lit(mark), F.regexp_replace(x, r"\s+", " "))) for mark, x in parts]
    shapes = [F.when(instance.rlike(pattern), name) for name, pattern in SHAPES.items()]
    return F.struct(kind.alias("kind"), start.alias("start"), (start + F.length(instance)).alias("end"), instance.alias("instance"), F.array_compact(F.array(*lexical, *shapes)).alias("patterns"))


def _masked(text: Column, kind: str) -> Column:
    """The text with the kind's valid matches as spaces."""

    def blank(x: Column) -> Column:
        return F.concat(F.when(x["hit"].isNull(), "").when(_valid(kind, x["hit"]), F.repeat(F.lit(" "), F.length(x["hit"]))).otherwise(x["hit"]), x["after"])

    return F.coalesce(let(_cut(text, KINDS[kind]), lambda pieces: F.array_join(F.transform(pieces, blank), "")), text)


def _tokens(pieces: Column, names: tuple[str, ...]) -> Column:
    """Mentions of the tokens with a digit (or of a key id's form) and at least six characters without the name that they are assigned to and the
    punctuation around them; credentials of known form, or assigned to one of the names, are seeds."""
    assigned = rf"(?i)(?:{'|'.join(names) or '(?!)'})[\"']?\s*[=:]+\s*[\"']?$"

    def one(x: Column) -> Column:
        lead = F.regexp_extract(x["hit"], r"^(?:[\p{L}\p{N}_.-]*[=:]+)?[\"'(\[{<]*", 0)
        rest = F.substr(x["hit"], F.length(lead) + 1)
        value = F.regexp_replace(rest, r"(?<=[\p{L}\p{N}=+/_-])[\"')\]}>.,;:!?][^\p{L}\p{N}]*+$", "")

        def named(before: Column) -> Column:
            letters = value.rlike("[A-Za-z]") & (F.length(value) >= 8)
            seed = (before.rlike(assigned) & letters) | value.rlike(SECRET_FORMS)
            return _described(F.when(seed, "secret"), value, x["start"] + F.length(lead), F.regexp_replace(before, r"[\"'(\[{<]+$", ""), F.concat(F.substr(rest, F.length(value) + 1), x["after"]))

        return F.when((F.length(value) >= 6) & (value.rlike("[0-9]") | value.rlike(SECRET_FORMS)), let(F.concat(x["before"], lead), named))

    return F.array_compact(F.transform(_contexts(pieces), one))


def mentions(docs: DataFrame, names: tuple[str, ...] = SECRET_NAMES) -> DataFrame:
    """(doc_id, text_hash, email, ip, card, phone, found): span arrays of the base kinds, and every mention that takes part in
    the graph: base matches, credentials of known form, and tokens of no known kind outside base matches."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), text.alias("text"))
    cut = cut.withColumns({f"_{kind}": _cut(F.col("text"), pattern, NEEDS[kind]) for kind, pattern in KINDS.items()})
    masked = F.col("text")
    for kind in KINDS:
        # most texts have no match of a kind; the others are cut again where an earlier kind has left spaces
        cut = cut.withColumn("_masked", F.when(F.col(f"_{kind}").isNull(), masked).otherwise(_masked(masked, kind)))
        masked = F.col("_masked")
    cut = cut.withColumn("_tokens", _cut(masked, TOKEN))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,instance:string,patterns:array<string>>>")

    def seeds(kind: str) -> Column:
        valid = F.filter(_contexts(F.col(f"_{kind}")), lambda x: _valid(kind, x["hit"]))
        return F.coalesce(F.transform(valid, lambda x: _described(F.lit(kind), x["hit"], x["start"], x["before"], x["after"])), none)

    cut = cut.withColumns({kind: seeds(kind) for kind in KINDS})
    spans = [F.transform(F.col(kind), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))).alias(kind) for kind in KINDS]
    return cut.select("doc_id", "text_hash", *spans, F.concat(*KINDS, F.coalesce(_tokens(F.col("_tokens"), names), none)).alias("found"))


def discover(found: DataFrame, rounds: int = ROUNDS, accept: float = ACCEPT) -> DataFrame:
    """(instance, kind, score) of the unseen identifiers that the pattern-instance graph vouches for.

    found: column `found` of mentions(). A pattern's confidence for a kind is the sum of its distinct instances'
    scores over their number plus one; an unseen instance scores 1 - product of (1 - confidence) over its patterns. The
    rounds are fixed. SEED_PATTERN has a confidence of TRUST for credentials at least and counts as one with two seeds; a
    pattern of one instance alone links nothing and is left out. Instances are accepted at `accept` if two patterns at least
    are confident (0.5) and surround two seeds each; for credentials one of the two has to stand before them, or has to be a confident one of three instances or more
    that ends in an assignment (`token =`), seeds or none.
    """
    each = found.select(F.explode("found").alias("m")).select("m.instance", "m.kind", F.explode("m.patterns").alias("pattern"))
    edges = checkpointed(each.groupBy("instance", "pattern").agg(*(F.max(F.coalesce((F.col("kind") == k).cast("double"), F.lit(0.0))).alias(k) for k in ALL_KINDS)).withColumn("seed", F.greatest(*ALL_KINDS) > 0))
    met = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("pattern")
    edges = checkpointed(edges.join(met, "pattern", "left_semi"))
    linked, open_edges = edges, edges.where("not seed").select("instance", "pattern")
    trusted = F.col("pattern") == SEED_PATTERN
    for _ in range(rounds):
        # written first, so that a pattern of very many instances is dealt over several tasks of the join
        confidence = checkpointed(linked.groupBy("pattern").agg(*((F.sum(k) / (F.count(F.lit(1)) + 1)).alias(f"c_{k}") for k in ALL_KINDS), F.count_if("seed").alias("seeds"), F.count(F.lit(1)).alias("n")))
        confidence = confidence.withColumns({"c_secret": F.when(trusted, F.greatest("c_secret", F.lit(TRUST))).otherwise(F.col("c_secret")), "seeds": F.when(trusted, F.greatest("seeds", F.lit(2))).otherwise(F.col("seeds"))})
        scored = open_edges.join(confidence, "pattern")
        seeded = [F.count_if((F.col("seeds") >= 2) & (F.col(f"c_{k}") >= 0.5)).alias(f"b_{k}") for k in ALL_KINDS]
        assigned = F.count_if(F.col("pattern").rlike("^[lk]:.*[=:]$") & (F.col("n") >= 3) & (F.col("c_secret") >= 0.5)).alias("assigned")
        before = F.count_if(F.col("pattern").rlike("^[lk]:") & (F.col("seeds") >= 2) & (F.col("c_secret") >= 0.5)).alias("before")
        doubt = checkpointed(scored.groupBy("instance").agg(*((1 - F.exp(F.sum(F.log1p(-F.least(F.col(f"c_{k}"), F.lit(0.999)))))).alias(k) for k in ALL_KINDS), *seeded, assigned, before))
        linked = edges.where("seed").unionByName(edges.where("not seed").select("instance", "pattern", "seed").join(doubt.select("instance", *ALL_KINDS), "instance"))
    backed = {k: F.col(f"b_{k}") >= 2 for k in ALL_KINDS}
    backed["secret"] = (backed["secret"] & (F.col("before") >= 1)) | ((F.col("b_secret") >= 1) & (F.col("assigned") >= 1))
    best = F.array_max(F.array_compact(F.array(*(F.when(backed[k], F.struct(F.round(k, 9).alias("score"), F.lit(k).alias("kind"))) for k in ALL_KINDS))))
    return doubt.select("instance", best.alias("best")).select("instance", "best.kind", "best.score").where(F.col("score") >= accept)


def find_personal_data(docs: DataFrame, names: tuple[str, ...] = SECRET_NAMES) -> DataFrame:
    """doc_id, counts per base kind, base_sha256, spans, n_secret, n_spans and n_discovered of every row, base matches and what
    was found beside them together; n_discovered counts the spans that the graph vouches for and no seed.

    Spans are kind:start:end in code points, end exclusive, by kind (base kinds first, then secret) and then start. Null
    text counts as empty. Repeated rows repeat; nulls in doc_id stay. An empty table gives an empty result. `names` are
    patterns of names whose assigned values seed the credentials.
    """
    held = checkpointed(mentions(docs, names))
    ranks = {kind: i for i, kind in enumerate(ALL_KINDS)}
    ids = ["doc_id", "text_hash"]
    seen = held.select(*ids, F.explode(F.filter("found", lambda m: m["kind"].isNull())).alias("m")).select(*ids, "m.instance", "m.start", "m.end").distinct()
    known = held.select(*ids, F.explode(F.filter("found", lambda m: m["kind"] == "secret")).alias("m")).select(*ids, "m.kind", "m.start", "m.end").distinct()
    vouched = seen.join(discover(held), "instance").select(*ids, "kind", "start", "end", F.lit(1).alias("graph"))
    added = vouched.unionByName(known.withColumn("graph", F.lit(0))).groupBy(*ids, "kind", "start", "end").agg(F.min("graph").alias("graph"))
    new = added.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_list(F.struct("kind", "start", "end")).alias("new"), F.sum("graph").alias("n_discovered"))
    joined = held.drop("found").join(new, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("text_hash").eqNullSafe(F.col("_hash")), "left")
    joined = joined.withColumn("new", F.coalesce("new", F.array().cast("array<struct<kind:string,start:int,end:int>>")))

    def ranked(spans: Column, kind: str) -> Column:
        return F.transform(spans, lambda s: F.struct(F.lit(ranks[kind]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    base = F.concat(*(ranked(F.col(kind), kind) for kind in KINDS))
    found = F.concat(*(ranked(F.filter("new", _of_kind(kind)), kind) for kind in ALL_KINDS))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return joined.select(
        "doc_id", *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.concat(base, found)).alias("spans"),
        F.size(F.filter("new", _of_kind("secret"))).cast("long").alias("n_secret"), (F.size(base) + F.size("new")).cast("long").alias("n_spans"),
        F.coalesce("n_discovered", F.lit(0).cast("long")).alias("n_discovered"),
    )


def _of_kind(kind: str):
    return lambda m: m["kind"] == kind
