"""SimHash near-duplicates by pigeonring filtering (operator 9).

Fingerprints have 64 bits on a ring of five segments. If two differ in at most four bits, then some segment i starts a
chain whose first l segments together differ in at most floor(4 l / 5) bits, for every l: none in segment i, one in
two segments, two in three, three in four. Segment i and three of the four parts of the next segment are therefore
equal, and so are, over three segments, all but two parts of which one at most is of the second segment. Either makes
the join keys (some 22 bits in 20 tables, or 32 bits in 110); the chain's other budgets are checked on every pair that
meets, before the whole distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.graph import connected_components
from estatelens.storage import checkpointed

MAX_DISTANCE = 4
SEGMENTS = 5
PARTS = 4
#: From this many distinct fingerprints on, keys span three segments: buckets stay small where 22 bits would crowd them.
LONG_KEYS = 1 << 25


def fingerprint(text: str, size: int = 4, seed: int = 42) -> int:
    """64-bit SimHash over word shingles (repeats counted), 0 without words; words part at ASCII white space."""
    words = text.encode().lower().split()  # bytes.lower and bytes.split know ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-size].tolist()]
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)], dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, none without hashes."""
    hashes, counts = hashes.astype("<u8", copy=False), np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, size: int = 4, marked: bool = False) -> DataFrame:
    """(doc_id, fp) of every row, fp as a signed long with the fingerprint's bits; null text counts as empty. With
    `marked`, `mark` as well, a hash of the text."""
    kept = ["doc_id"] + ["mark"] * marked

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py() or "", size) for t in batch["text"]), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(found.view(np.int64))], names=[*kept, "fp"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    return rows.select(*kept, "text").mapInArrow(work, ", ".join(f"{c} long" for c in (*kept, "fp")))


def _mask(low: int, high: int) -> int:
    return (1 << high) - (1 << low)


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def _segments(start: int) -> list[tuple[int, int]]:
    """Bit ranges of the ring's segments in order from `start`."""
    cuts = [64 * i // SEGMENTS for i in range(SEGMENTS + 1)]
    return [(cuts[j % SEGMENTS], cuts[j % SEGMENTS + 1]) for j in range(start, start + SEGMENTS)]


def chains() -> list[list[int]]:
    """For every start on the ring, the masks of its first one to five segments."""
    return [[sum(_mask(*x) for x in _segments(i)[: n + 1]) for n in range(SEGMENTS)] for i in range(SEGMENTS)]


def key_masks(span: int = 2) -> list[tuple[int, int]]:
    """(start, key mask) of every table: the first `span` segments of a chain without the parts in which they may differ."""
    tables = []
    for i in range(SEGMENTS):
        parts = [[_mask(low + (high - low) * d // PARTS, low + (high - low) * (d + 1) // PARTS) for d in range(PARTS)] for low, high in _segments(i)[1:span]]
        whole = sum(_mask(*x) for x in _segments(i)[:span])
        if span == 2:
            left_out = parts[0]
        else:
            left_out = [a | b for a in parts[0] for b in parts[1]] + [a | b for a, b in combinations(parts[1], 2)]
        tables += [(i, whole & ~x) for x in left_out]
    return tables


def _near(a: Column, b: Column, start: Column, distance: int = MAX_DISTANCE) -> Column:
    """Whether two fingerprints keep every budget of the chain from `start`, the last being the distance."""
    differ, found = a.bitwiseXOR(b), F.lit(True)
    for n in range(SEGMENTS):
        masks = F.array(*(F.lit(_signed(chain[n])) for chain in chains()))
        found = found & (F.bit_count(differ.bitwiseAND(F.get(masks, start))) <= (n + 1) * distance // SEGMENTS)
    return found


def within(a: Column, b: Column, distance: int) -> Column:
    """Whether two fingerprints differ in at most `distance` bits: some start on the ring has to keep all budgets, so most
    pairs fall before the whole distance is counted."""
    found = F.lit(False)
    for i in range(SEGMENTS):
        found = found | _near(a, b, F.lit(i), distance)
    return found


def link(nodes: DataFrame, span: int = 2) -> DataFrame:
    """Edges (src, dst) among distinct fingerprints `fp` that join all that are linked by chains of near pairs; `span` is
    how many segments the keys cover, 2 or 3, and changes the work but not what is linked.

    Within a key's bucket only what connectivity needs is compared: first every member with the bucket's smallest and
    largest one; what this joins is not compared again. Then, in buckets that still hold several components, the
    members outside the bucket's largest component are compared with all members of other components. No near pair
    is left in different components, and a bucket of many copies of one text costs a number of rows in proportion to it.
    """
    tables = key_masks(span)
    starts = F.array(*(F.lit(i) for i, _ in tables))
    keys = F.array(*(F.struct(F.lit(t).alias("place"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key")) for t, (_, mask) in enumerate(tables)))
    keyed = nodes.select("fp", F.explode(keys).alias("k")).select("k.place", "k.key", "fp")
    shared = keyed.groupBy("place", "key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high")
    crowded = checkpointed(keyed.join(shared, ["place", "key"]))
    ends = crowded.select("place", "fp", F.explode(F.array("low", "high")).alias("dst"))
    first = checkpointed(ends.where((F.col("fp") != F.col("dst")) & _near(F.col("fp"), F.col("dst"), F.get(starts, F.col("place")))).select(F.col("fp").alias("src"), "dst").distinct())

    held = connected_components(crowded.select(F.col("fp").alias("node")), first).withColumnRenamed("node", "fp")
    members = checkpointed(crowded.select("place", "key", "fp").join(held, "fp"))
    sizes = members.groupBy("place", "key", "component").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("place", "key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("components")).where("components > 1")
    open_rows = members.join(main.select("place", "key", "main"), ["place", "key"])
    outside = open_rows.where("component <> main").select("place", "key", "main", F.col("fp").alias("src"), F.col("component").alias("own"))
    met = outside.join(open_rows.select("place", "key", F.col("fp").alias("dst"), "component"), ["place", "key"])
    wanted = (F.col("own") != F.col("component")) & ((F.col("component") == F.col("main")) | (F.col("src") < F.col("dst")))
    second = met.where(wanted & _near(F.col("src"), F.col("dst"), F.get(starts, F.col("place")))).select("src", "dst").distinct()
    return first.unionByName(second)


def _classes(rows: DataFrame) -> DataFrame:
    """(fp, component_id) of the fingerprints of rows (doc_id, fp): the smallest doc_id of each component, null if it has none."""
    nodes = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = link(nodes.select("fp"), 3 if nodes.count() >= LONG_KEYS else 2)
    labels = connected_components(nodes.select(F.col("fp").alias("node")), edges)
    owned = checkpointed(nodes.join(labels.withColumnRenamed("node", "fp"), "fp"))
    # written first, so that a component of very many fingerprints is dealt over several tasks of the join
    smallest = checkpointed(owned.groupBy("component").agg(F.min("least").alias("component_id")))
    return owned.join(smallest, "component").select("fp", "component_id")


def near_duplicates(df: DataFrame, size: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row of df (doc_id, text, any others).

    Texts link if their fingerprints differ in at most four bits; component_id is the smallest doc_id that can be
    reached. Null text counts as empty; texts without words have fingerprint 0 and link like any other. Repeated
    rows are repeated; null doc_ids never are the smallest, so a component of only such rows has a null id.
    """
    rows = checkpointed(fingerprints(df, size))
    return rows.join(_classes(rows), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, size: int = 4) -> DataFrame:
    """The rows of df whose document is the smallest of its component; columns as they were.

    Rows with a null doc_id are kept only where their own component has no other ids, and then all of them. Rows that
    share a kept doc_id and lie in its component are one document and all stay.
    """
    mark = F.xxhash64(F.coalesce(df["text"].cast("string"), F.lit("")))
    rows = checkpointed(fingerprints(df, size, marked=True))
    kept = rows.select("fp", F.col("mark").alias("_mark")).distinct().join(_classes(rows), "fp").select("_mark", F.col("component_id").alias("_kept")).distinct()
    return df.join(kept, (mark == kept["_mark"]) & df["doc_id"].cast("long").eqNullSafe(kept["_kept"]), "left_semi")
