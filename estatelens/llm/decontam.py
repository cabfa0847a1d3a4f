"""Benchmark decontamination with Spark SQL functions only (operator 3).

Every document word position is tested, in its own row, against a bit filter of the benchmark's window hashes; only
positions that pass leave the row, with the window's words, and are verified by a join on those words with the
benchmark's windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.llm.common import WORD, words_of

WINDOW = 13
#: Windows are broadcast up to this many (each is a window of words and its items); beyond it the join shuffles.
BROADCAST_WINDOWS = 200_000
#: The bit filter has 16 bits a window, at most 2^23 bits (1 MB); past that it lets more positions through to the join.
FILTER_BITS = (12, 23)


def _let(value: Column, body) -> Column:
    """Evaluate `value` once and use it in `body`: a lambda variable is not inlined."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _slices(words: Column, size: int) -> Column:
    """Start positions (from 1) of windows of `size` words."""
    return F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - (size - 1))).otherwise(F.array().cast("array<int>"))


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(length, window, items): the distinct windows of the items, their words joined by spaces.

    An item of fewer than `size` words is one window, one without words (or null) has none; a null item_id counts as
    the empty string.
    """
    words = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(size))
    starts = words.withColumn("length", length).select("item", "length", "words", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)).alias("at"))
    cut = starts.select("item", "length", F.slice("words", F.col("at"), F.col("length")).alias("w"))
    return cut.select("item", "length", F.array_join("w", " ").alias("window"), F.xxhash64(F.transform("w", lambda x: F.xxhash64(x))).alias("hash")).groupBy("length", "window", "hash").agg(F.collect_set("item").alias("items"))


def _filter_bits(windows: DataFrame, bits: int) -> list[int]:
    """The bit filter as 2^bits / 64 longs; its size is bounded by FILTER_BITS, whatever the benchmark's."""
    at = F.col("hash").bitwiseAND(F.lit((1 << bits) - 1))
    rows = windows.select(F.shiftright(at, 6).alias("slot"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int")).alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits")).collect()
    found = [0] * (1 << bits - 6)
    for slot, value in rows:
        found[slot] = value
    return found


def find_hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per document and text: doc_id, text_hash, n_words, spans (start, end of hit windows, words from 0) and
    items (strings)."""
    windows = benchmark_windows(benchmark, size)
    counts = dict(windows.groupBy("length").count().collect())
    total = sum(counts.values())
    bits = min(max((16 * total - 1).bit_length() if total else 0, FILTER_BITS[0]), FILTER_BITS[1])
    # one string that constant folding makes an array once
    held = F.split(F.lit(",".join(map(str, _filter_bits(windows, bits)))), ",").cast("array<bigint>")

    def passing(hashes: Column, length: int) -> Column:
        """Positions (from 1) whose window of `length` words passes the filter."""
        found = F.transform(_slices(hashes, length), lambda i: F.xxhash64(F.slice(hashes, i, length)))

        def test(h: Column, i: Column) -> Column:
            slot = F.get(held, F.shiftright(h.bitwiseAND(F.lit((1 << bits) - 1)), 6).cast("int"))
            return F.when(F.getbit(slot, h.bitwiseAND(F.lit(63)).cast("int")) == 1, i + 1)

        return F.array_compact(F.transform(found, test))

    def scan(words: Column) -> Column:
        def candidates(hashes: Column) -> Column:
            def cut(n: int) -> Column:
                return F.transform(passing(hashes, n), lambda i: F.struct(F.lit(n).alias("length"), (i - 1).alias("start"), F.array_join(F.slice(words, i, n), " ").alias("window")))

            each = [cut(n) for n in sorted(counts)]
            return F.concat(*each) if each else F.array().cast("array<struct<length:int,start:int,window:string>>")

        return F.struct(F.size(words).cast("long").alias("n_words"), _let(F.transform(words, lambda w: F.xxhash64(w)), candidates).alias("found"))

    scanned = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), _let(words_of(F.col("text")), scan).alias("s"))
    rows = scanned.select("doc_id", "text_hash", F.col("s.n_words").alias("n_words"), F.explode_outer("s.found").alias("c")).select("doc_id", "text_hash", "n_words", "c.*")
    side = windows.select("length", "window", "items")
    joined = rows.join(F.broadcast(side) if total <= BROADCAST_WINDOWS else side, ["length", "window"], "left")
    hit = F.col("items").isNotNull()
    return joined.groupBy("doc_id", "text_hash", "n_words").agg(
        F.array_sort(F.collect_set(F.when(hit, F.struct(F.col("start"), (F.col("start") + F.col("length")).alias("end"))))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated (n_hit > 0 and 20 n_hit >= n_words).

    Words are the runs of digits, letters and characters above ASCII after lower-casing A-Z; a word inside any
    occurrence of a benchmark window is hit. Null texts have no words. Rows that agree in doc_id and text give one
    row; an empty benchmark hits nothing.
    """
    start = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("reach"))

    def step(acc: Column, span: Column) -> Column:
        new = F.greatest(F.lit(0), span["end"] - F.greatest(span["start"], acc["reach"]))
        return F.struct((acc["covered"] + new).alias("covered"), F.greatest(acc["reach"], span["end"]).alias("reach"))

    n_hit = F.aggregate("spans", start, step, lambda acc: acc["covered"]).cast("long")
    counted = find_hits(docs, benchmark, size).withColumn("n_hit", n_hit)
    return counted.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "text_hash",
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of docs that are not contaminated; columns and repeated rows as they were."""
    dirty = contamination(docs, benchmark, size).where("contaminated").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    return docs.join(dirty, docs["doc_id"].cast("long").eqNullSafe(dirty["_id"]) & (F.xxhash64(docs["text"]) == dirty["_hash"]), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of docs with the hit words, and what stands before each of them, cut out of the text.

    A text without hits (or null) stays as it is.
    """
    hits = find_hits(docs, benchmark, size).where(F.size("spans") > 0).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("spans").alias("_spans"))
    cased = WORD.replace(r"\x60", r"\x40\x5B-\x60")  # the word pattern before lower-casing
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"), F.col("text").cast("string").alias("words_of"))
    joined = rows.join(hits, F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left")
    words = F.regexp_extract_all(F.col("words_of"), F.lit(cased), F.lit(0))
    pairs = F.zip_with(F.split("words_of", cased, -1), words, lambda gap, word: F.struct(gap.alias("gap"), word.alias("word")))

    def hit(i: Column) -> Column:
        return F.exists("_spans", lambda s: (s["start"] <= i) & (i < s["end"]))

    inside = F.transform(pairs, lambda pair, i: F.when(pair["word"].isNull(), pair["gap"]).when(hit(i), F.lit("")).otherwise(F.concat(pair["gap"], pair["word"])))
    text = F.when(F.col("_spans").isNull(), F.col("words_of")).otherwise(F.array_join(inside, ""))
    return joined.select(*(text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))
