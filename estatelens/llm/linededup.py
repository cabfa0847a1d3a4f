"""Line dedup by content-defined chunks and minimal runs (operator 6).

A document's lines are cut into chunks where a rolling hash over the hashes of the last two lines says so, and on
both sides of every long line; the cuts depend on the lines themselves, so a passage is cut alike wherever it stands.
A passage need not hold a whole chunk, so the shortest runs of lines that reach LONG_WORDS words are counted as well:
every line of a passage of LONG_WORDS words or more lies in such a run inside the passage. What occurs more than once
in the corpus goes, but for its first occurrence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A line of so many words is a chunk of its own, and a run of lines of fewer words together is never removed.
LONG_WORDS = 20
WINDOW = 2
#: The bit filter of repeated hashes has 2^26 bits (8 MB); the more repeats, the more other units pass it to the join.
FILTER_BITS = 26
DIVISOR = 2
MAX_LINES = 16
NO_ID = -(2**63)
_MULTIPLIER = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def chunks(hashes: list[int], words: list[int]) -> list[tuple[int, int]]:
    """(start, end) of the chunks of lines with the given hashes and word counts."""
    found, start = [], 0
    for j, (h, n) in enumerate(zip(hashes, words, strict=True)):
        if n >= LONG_WORDS:
            if start < j:
                found.append((start, j))
            found.append((j, j + 1))
            start = j + 1
            continue
        rolled = 0
        for x in (*hashes[max(0, j - WINDOW + 1) : j], h):
            rolled = (rolled * _MULTIPLIER + x) & _MASK
        if (rolled >> 32) % DIVISOR == 0 or j + 1 - start >= MAX_LINES:
            found.append((start, j + 1))
            start = j + 1
    if start < len(hashes):
        found.append((start, len(hashes)))
    return found


def runs(words: list[int]) -> set[tuple[int, int]]:
    """(start, end) of the shortest runs that reach LONG_WORDS words, from each line with words on and back from it."""
    at = [j for j, n in enumerate(words) if n]
    found, first, total = set(), 0, 0
    for last, j in enumerate(at):
        total += words[j]
        while total - words[at[first]] >= LONG_WORDS:
            total -= words[at[first]]
            first += 1
        if total >= LONG_WORDS:
            found.add((at[first], j + 1))
    last, total = len(at) - 1, 0
    for j in reversed(at):
        total += words[j]
        while total - words[at[last]] >= LONG_WORDS:
            total -= words[at[last]]
            last -= 1
        if total >= LONG_WORDS:
            found.add((j, at[last] + 1))
    return found


#: The hash of a unit's bytes; tests pass one that clashes.
Digest = Callable[[bytes], int]


def units(text: str, held: bytes | None = None, unit_hash: Digest = xxhash.xxh64_intdigest) -> Iterator[tuple[int, int, int, bytes]]:
    """(hash, first line, line after the last, bytes) of all that may be found repeated in a document.

    A unit is a chunk of two lines with words or of a long line, or a minimal run. With `held`, the bits of a filter,
    only units whose hash passes it.
    """
    coded = text.encode().split(b"\n")
    digest = xxhash.xxh64_intdigest
    words = [len(x.split()) for x in text.split("\n")]
    cut = chunks([digest(x) for x in coded], words)
    mask = (1 << FILTER_BITS - 3) - 1
    for a, b in runs(words).union((a, b) for a, b in cut if words[a] >= LONG_WORDS or sum(map(bool, words[a:b])) > 1):
        unit = coded[a] if b - a == 1 else b"\n".join(coded[a:b])
        h = unit_hash(unit)
        if held is None or held[h >> 3 & mask] >> (h & 7) & 1:
            yield h, a, b, unit


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


TYPES = {"hash": pa.int64(), "check": pa.int64(), "doc_id": pa.int64(), "mark": pa.int64(), "first": pa.int32(), "last": pa.int32(), "unit": pa.binary()}
SQL_TYPES = {"hash": "long", "check": "long", "doc_id": "long", "mark": "long", "first": "int", "last": "int", "unit": "binary"}


def _unit_rows(docs: DataFrame, names: list[str], held: Broadcast | None = None, unit_hash: Digest = xxhash.xxh64_intdigest) -> DataFrame:
    """The named columns of the units of docs; with `held` of those that pass its bit filter."""

    checking = "check" in names

    def made(columns: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[n], TYPES[n]) for n in names], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held and held.value
        for batch in batches:
            columns, size = {n: [] for n in names}, 0
            for doc_id, mark, text in zip(batch["doc_id"].to_pylist(), batch["mark"].to_pylist(), batch["text"], strict=True):
                text = text.as_py() or ""
                for h, a, b, unit in units(text, bits, unit_hash):
                    row = {"hash": _signed(h), "check": _signed(xxhash.xxh64_intdigest(unit, 1)) if checking else 0, "doc_id": doc_id, "mark": mark, "first": a, "last": b, "unit": unit}
                    for n, column in columns.items():
                        column.append(row[n])
                size += len(text)
                if size > 8_000_000:
                    yield made(columns)
                    columns, size = {n: [] for n in names}, 0
            yield made(columns)

    return docs.mapInArrow(work, ", ".join(f"{n} {SQL_TYPES[n]}" for n in names))


def repeated_bits(docs: DataFrame, unit_hash: Digest = xxhash.xxh64_intdigest) -> bytes:
    """The bit filter of the unit hashes that occur more than once; its size is fixed, whatever the corpus'."""
    twice = _unit_rows(docs, ["hash"], None, unit_hash).groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    at = F.col("hash").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    slots = twice.select(F.shiftright(at, 6).alias("slot"), bit.alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    found = np.zeros(1 << FILTER_BITS - 6, "<i8")
    found[slots["slot"].to_numpy()] = slots["bits"].to_numpy()
    return found.tobytes()


def repeated_units(docs: DataFrame, held: Broadcast, unit_hash: Digest = xxhash.xxh64_intdigest) -> DataFrame:
    """(hash, check, first_doc) of the units with more than one occurrence; first_doc is the (doc_id, mark) that comes first.

    Units are grouped by their bytes and known afterwards by two hashes of 64 bits together, so units whose first hash is the
    same stay apart; should both be the same for different bytes, the unit is left out, and nothing goes on the word of
    hashes alone. A hash that occurs once can't be repeated, so what `held` stops is no loss.
    """
    alike = _unit_rows(docs, ["hash", "check", "doc_id", "mark", "unit"], held, unit_hash).groupBy("hash", "check", "unit").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "mark")).alias("first_doc"))
    by_hash = alike.groupBy("hash", "check").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"), F.min("first_doc").alias("first_doc"))
    return by_hash.where("n > 1 and texts = 1").select("hash", "check", "first_doc")


def kept_lines(text: str, spans: list[dict]) -> tuple[str, int, int]:
    """The text without its repeated units, the number of its lines, and how many went.

    A unit's smallest place in its first document (`own`) stays; removed runs of fewer than LONG_WORDS words stay too.
    Blank lines with nothing but removed lines (or the text's end) on both sides go with them.
    """
    lines = text.split("\n")
    stays: dict[tuple[int, int], int] = {}
    for s in spans:
        if s["own"]:
            unit = s["hash"], s["check"]
            stays[unit] = min(s["first"], stays.get(unit, s["first"]))
    gone = bytearray(len(lines))
    for s in spans:
        if stays.get((s["hash"], s["check"])) != s["first"]:
            gone[s["first"] : s["last"]] = b"\1" * (s["last"] - s["first"])
    at = 0
    while (at := gone.find(1, at)) >= 0:
        end = gone.find(0, at)
        end = len(gone) if end < 0 else end
        if sum(len(x.split()) for x in lines[at:end]) < LONG_WORDS:
            gone[at:end] = bytes(end - at)
        at = end
    if any(gone):
        at, before = 0, True
        for j, x in enumerate(lines):
            if gone[j] or x.split():
                if before and gone[j]:
                    gone[at:j] = b"\1" * (j - at)
                at, before = j + 1, bool(gone[j])
        if before:
            gone[at:] = b"\1" * (len(gone) - at)
    return "\n".join(x for x, g in zip(lines, gone, strict=True) if not g), len(lines), sum(gone)


def dedup_lines(df: DataFrame, unit_hash: Digest = xxhash.xxh64_intdigest) -> DataFrame:
    """df with repeated chunks and runs cut out of `text`, and the counts n_lines and n_removed; calling it counts hashes.

    Of all occurrences of a unit the one in the smallest doc_id stays (null before all others), and there the first.
    Rows that share a doc_id and the text count as one document: they keep what their first occurrence keeps. Different
    texts with one doc_id (or none) are different documents, ordered by the hash of the text. Null text stays null
    with 0 lines; an empty text is one line. Columns named n_lines or n_removed are replaced, others pass through,
    rows are neither added nor removed; a text whose lines all stand elsewhere becomes empty.
    """
    kept = [c for c in df.columns if c not in ("n_lines", "n_removed")]
    key: Column = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    # rows without an id have marks of another seed, so no id is mistaken for none
    mark = F.when(F.col("doc_id").cast("long").isNull(), F.xxhash64(F.lit(1), F.col("text").cast("string"))).otherwise(F.xxhash64(F.col("text").cast("string")))
    docs = df.select(key.alias("doc_id"), mark.alias("mark"), F.col("text").cast("string").alias("text"))
    own = (F.struct("doc_id", "mark") == F.col("first_doc")).alias("own")
    held = df.sparkSession.sparkContext.broadcast(repeated_bits(docs, unit_hash))
    found = _unit_rows(docs, ["hash", "check", "doc_id", "mark", "first", "last"], held, unit_hash).join(repeated_units(docs, held, unit_hash), ["hash", "check"])
    spans = found.groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).agg(F.collect_set(F.struct("hash", "check", "first", "last", own)).alias("_spans"))
    # the row travels as one struct, so no column of df can clash with a helper's
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), key.alias("key"), mark.alias("mark"))
    joined = rows.join(spans, (F.col("key") == F.col("_id")) & (F.col("mark") == F.col("_mark")), "left").select("row", "_spans")
    schema = df.select(*(F.col(f"`{c}`") for c in kept), F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed")).schema
    at = kept.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = batch["row"].flatten()
            made = []
            for text, found in zip(fields[at], batch["_spans"], strict=True):
                text = text.as_py()
                if text is None:
                    made.append((None, 0, 0))
                elif not found.is_valid:
                    made.append((text, text.count("\n") + 1, 0))
                else:
                    made.append(kept_lines(text, found.as_py()))
            texts, lines, removed = zip(*made, strict=True) if made else ((), (), ())
            fields[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*fields, pa.array(lines, pa.int64()), pa.array(removed, pa.int64())], names=[*kept, "n_lines", "n_removed"])

    return joined.mapInArrow(work, schema)
