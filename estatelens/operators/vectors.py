"""Embedding of changed entities and exact cosine search (V1-V3)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatelens.functions.text import short_payload
from estatelens.operators.dashboard import MATCHED
from estatelens.operators.evidence import BUSINESS_POOL
from estatelens.storage import checkpointed


def _text(*columns: str):
    return F.concat_ws("\n", *(F.nullif(F.col(c), F.lit("")) for c in columns))


def embeddable_entities(understandings: DataFrame, apps: DataFrame, rules: DataFrame, records: DataFrame, correlations: DataFrame) -> DataFrame:
    """assessment_id, entity_type, entity_id, content_text and content_hash of all that is searched by meaning.

    COMPLETED object understandings; applications that are not merged and have a name or description; CANDIDATE rules;
    records of the business pool with a matched correlation, once each.
    """
    understood = understandings.where("status = 'COMPLETED'").select("assessment_id", F.lit("OBJECT").alias("entity_type"), F.col("sap_object_id").alias("entity_id"), _text("purpose", "description").alias("content_text"))
    named = apps.where("status <> 'MERGED' and (coalesce(name, '') <> '' or coalesce(description, '') <> '')").select("assessment_id", F.lit("APPLICATION").alias("entity_type"), F.col("id").alias("entity_id"), _text("name", "domain", "description").alias("content_text"))
    ruled = rules.where("status = 'CANDIDATE'").select("assessment_id", F.lit("BUSINESS_RULE").alias("entity_type"), F.col("id").alias("entity_id"), _text("condition", "action").alias("content_text"))
    matched = correlations.where(F.col("status").isin(*MATCHED)).select(F.col("record_id").alias("id"))
    seen = records.where(F.col("capability").isin(*BUSINESS_POOL)).join(matched, "id", "left_semi")
    seen = seen.select("assessment_id", F.lit("EVIDENCE_RECORD").alias("entity_type"), F.col("id").alias("entity_id"), F.concat_ws("\n", "record_type", "object_name", short_payload(F.col("payload"))).alias("content_text"))
    return understood.unionByName(named).unionByName(ruled).unionByName(seen).withColumn("content_hash", F.sha2("content_text", 256))


def embed(entities: DataFrame, model: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """Add `vector` by a model from a batch of texts to as many vectors, called on Arrow batches; null text counts as empty."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.asarray(v, dtype=np.float32) for v in model(texts.fillna("").tolist())])

    return entities.withColumn("vector", vectors("content_text"))


def hash_embedder(dims: int = 32) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic stand-in for a model: signed counts of word hashes."""
    import zlib

    def model(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            vector = [0.0] * dims
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                vector[h % dims] += 1.0 if h >> 31 else -1.0
            out.append(vector)
        return out

    return model


def _parts(rows: DataFrame, block: int, name: str) -> DataFrame:
    """(assessment_id, name): how many blocks of about `block` rows an assessment's rows make."""
    return rows.groupBy("assessment_id").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))


_FOUND = "assessment_id {a}, query_id long, entity_type string, entity_id long, score double"


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def _cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return (q @ v.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(v, axis=1)[None, :]


def _apart(df: DataFrame) -> DataFrame:
    """df with columns of their own, for a cogroup whose other side comes from the same table."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))


def _nearest(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """From a block of vectors and a block of queries the k best of the block for each query; a score that is not defined comes last, as null."""

    def work(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or found.empty:
            return pd.DataFrame(columns=["assessment_id", "query_id", "entity_type", "entity_id", "score"])
        scores = _cosines(_matrix(found["vector"]), _matrix(rows["vector"]))
        ids, kinds = rows["entity_id"].to_numpy(), rows["entity_type"].to_numpy()
        best = [np.lexsort((kinds, ids, -np.nan_to_num(line, nan=-2.0)))[:k] for line in scores]
        taken, sizes = np.concatenate(best), [len(b) for b in best]
        return pd.DataFrame({
            "assessment_id": np.repeat(found["assessment_id"].to_numpy(), sizes), "query_id": np.repeat(found["query_id"].to_numpy(), sizes), "entity_type": kinds[taken], "entity_id": ids[taken],
            "score": np.concatenate([line[b] for line, b in zip(scores, best, strict=True)]),
        })

    return work


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "entity_id", "entity_type")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "entity_type", "entity_id", "score", "rank")


#: An assessment's vectors lie in cells around as many of them as the root of their number, but no more than this.
MOST_CELLS = 1024
#: So many products of a query and a vector are cheaper than the cells' rounds.
FEW_PAIRS = 1e9
#: Slack of angles, far above rounding errors and far below what tells vectors apart.
SLACK = 1e-6


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int, types: list[str] | None = None) -> DataFrame:
    """query_id, entity_type, entity_id, score, rank: the k nearest of each query among its assessment's vectors.

    queries: query_id (unique), assessment_id, vector; vectors: assessment_id, entity_type, entity_id, vector. Exact either
    way: up to FEW_PAIRS pairs are compared all, of more the cells that may matter are, see search_cells. Ties go to the smaller entity_id; zero vectors have no score (null) and come last. A null vector is no vector;
    an assessment without queries or vectors gives no rows.
    """
    sizes = [x.where("vector is not null").groupBy("assessment_id").agg(F.count(F.lit(1)).alias(n)) for x, n in ((queries, "q"), (vectors, "v"))]
    pairs = sizes[0].join(sizes[1], "assessment_id").agg(F.sum(F.col("q").cast("double") * F.col("v"))).first()[0] or 0
    return cosine_topk_all(queries, vectors, k, types) if pairs <= FEW_PAIRS else search_cells(queries, vectors, k, types)[0]


def search_cells(queries: DataFrame, vectors: DataFrame, k: int, types: list[str] | None = None, block: int = 4096, most_cells: int = MOST_CELLS) -> tuple[DataFrame, DataFrame]:
    """(cosine_topk's rows, and assessment_id, cells, pairs, opened: how many cells there are, how many pairs of query and cell, and
    how many of them were opened).

    Every vector belongs to the cell of its nearest pivot, and a cell knows its largest angle. A query first opens its
    nearest cells until they hold k vectors; the angle of the k-th of these bounds the rest: by the triangle inequality of
    angles a cell farther away than that angle and the cell's own together holds nothing better, so only the others are opened.
    Cells are cut into blocks of vectors and of queries, so a hot cell is many groups of bounded size.
    """
    own = (vectors if types is None else vectors.where(F.col("entity_type").isin(*types))).where("vector is not null").select("assessment_id", "entity_type", "entity_id", "vector")
    asked = queries.where("vector is not null").select("assessment_id", "query_id", "vector")
    kind = own.schema["assessment_id"].dataType.simpleString()
    square = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    hashed = F.xxhash64("entity_type", "entity_id")
    own = own.withColumns({"zero": square == 0, "h": hashed})
    full = own.where("not zero")
    sizes = full.groupBy("assessment_id").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("least"))
    sizes = checkpointed(sizes.withColumns({"step": F.greatest(F.lit(1), F.floor(F.col("n") / F.least(F.sqrt("n"), F.lit(float(most_cells))))).cast("long"), "parts": F.ceil(F.col("n") / block).cast("int")}))
    sized = full.join(sizes, "assessment_id")
    pivots = checkpointed(sized.where((F.pmod("h", "step") == 0) | (F.col("h") == F.col("least"))).select("assessment_id", F.col("h").alias("cell"), F.col("vector").alias("pivot")).dropDuplicates(["assessment_id", "cell"]))

    def placed(rows: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or centres.empty:
            return rows.iloc[:0][["assessment_id", "entity_type", "entity_id", "vector"]].assign(cell=0, angle=0.0)
        cosines = _cosines(_matrix(rows["vector"]), _matrix(centres["pivot"]))
        best = cosines.argmax(axis=1)
        return rows[["assessment_id", "entity_type", "entity_id", "vector"]].assign(cell=centres["cell"].to_numpy()[best], angle=np.arccos(np.clip(cosines[np.arange(len(best)), best], -1, 1)))

    every = pivots.join(sizes.select("assessment_id", "parts"), "assessment_id").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    dealt = sized.withColumn("part", F.pmod(F.xxhash64("h"), "parts").cast("int")).select("assessment_id", "part", "entity_type", "entity_id", "vector")
    keys = ["assessment_id", "part"]
    held = checkpointed(dealt.groupBy(*keys).cogroup(_apart(every).groupBy(*keys)).applyInPandas(placed, f"assessment_id {kind}, entity_type string, entity_id long, vector {own.schema['vector'].dataType.simpleString()}, cell long, angle double"))
    cells = checkpointed(held.groupBy("assessment_id", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).join(pivots, ["assessment_id", "cell"]))

    def opening(rows: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        """The cells that each query opens: the nearest that hold k vectors, or those that its bound leaves but for these."""
        if rows.empty or around.empty:
            return pd.DataFrame(columns=["assessment_id", "query_id", "cell"])
        angles = np.arccos(np.clip(_cosines(_matrix(rows["vector"]), _matrix(around["pivot"])), -1, 1))
        n, radius, names = around["n"].to_numpy(), around["radius"].to_numpy(), around["cell"].to_numpy()
        out = []
        for query, line, bound in zip(rows["query_id"], angles, rows["bound"], strict=True):
            near = np.lexsort((names, line))
            home = near[: int(np.searchsorted(np.cumsum(n[near]), k)) + 1]
            if np.isnan(bound):
                out += [(query, c) for c in names[home]]
            else:
                left = np.setdiff1d(np.flatnonzero(line - radius <= bound + SLACK), home)
                out += [(query, c) for c in names[left]]
        return pd.DataFrame(out, columns=["query_id", "cell"]).assign(assessment_id=rows["assessment_id"].iloc[0])[["assessment_id", "query_id", "cell"]]

    q_parts = checkpointed(asked.groupBy("assessment_id").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts")))
    around = cells.join(q_parts, "assessment_id").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("assessment_id", "part", "cell", "n", "radius", "pivot")
    pointed = asked.where(square > 0).join(q_parts, "assessment_id").withColumn("part", F.pmod(F.xxhash64("query_id"), "parts").cast("int")).drop("parts")

    def opened(rows: DataFrame) -> DataFrame:
        made = rows.select("assessment_id", "part", "query_id", "vector", "bound").groupBy(*keys).cogroup(_apart(around).groupBy(*keys)).applyInPandas(opening, f"assessment_id {kind}, query_id long, cell long")
        return checkpointed(made)

    def scored(pairs: DataFrame) -> DataFrame:
        shape = pairs.groupBy("assessment_id", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("qs")).join(cells.select("assessment_id", "cell", F.ceil(F.col("n") / block).cast("int").alias("vs")), ["assessment_id", "cell"])
        shape = checkpointed(shape)
        left = held.drop("angle").join(shape, ["assessment_id", "cell"]).withColumn("v", F.pmod(F.xxhash64("entity_type", "entity_id"), "vs").cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)))
        right = pairs.join(asked, ["assessment_id", "query_id"]).join(shape, ["assessment_id", "cell"]).withColumn("q", F.pmod(F.xxhash64("query_id"), "qs").cast("int")).withColumn("v", F.explode(F.sequence(F.lit(0), F.col("vs") - 1)))
        group = ["assessment_id", "cell", "v", "q"]
        return checkpointed(left.groupBy(*group).cogroup(_apart(right).groupBy(*group)).applyInPandas(_nearest(k), _FOUND.format(a=kind)))

    home = opened(pointed.withColumn("bound", F.lit(float("nan"))))
    first = scored(home)
    best = _ranked(first, k).groupBy("query_id").agg(F.count(F.lit(1)).alias("m"), F.min("score").alias("least"))
    # with fewer than k vectors in all cells every cell was opened at once
    bound = best.where(F.col("m") == k).select("query_id", F.acos(F.greatest(F.least("least", F.lit(1.0)), F.lit(-1.0))).alias("bound"))
    rest = opened(pointed.join(bound, "query_id"))
    nothing = own.where("zero").join(asked.select("assessment_id").distinct(), "assessment_id", "left_semi")
    fill = _first_ids(nothing, k).join(asked.where(square > 0).select("assessment_id", "query_id"), "assessment_id")
    blind = _first_ids(own, k).join(asked.where(square == 0).select("assessment_id", "query_id"), "assessment_id")
    undefined = fill.unionByName(blind).select("assessment_id", "query_id", "entity_type", "entity_id", F.lit(None).cast("double").alias("score"))
    counts = cells.groupBy("assessment_id").agg(F.count(F.lit(1)).alias("cells")).join(pointed.groupBy("assessment_id").agg(F.count(F.lit(1)).alias("asked")), "assessment_id")
    report = counts.join(home.unionByName(rest).groupBy("assessment_id").agg(F.count(F.lit(1)).alias("opened")), "assessment_id").select("assessment_id", "cells", (F.col("cells") * F.col("asked")).alias("pairs"), "opened")
    return _ranked(first.unionByName(scored(rest)).unionByName(undefined), k), report


def _first_ids(rows: DataFrame, k: int) -> DataFrame:
    """assessment_id, entity_type, entity_id of the k smallest ids of each assessment; tasks reduce to k before rows meet."""
    salted = rows.withColumn("_salt", F.pmod("h", F.lit(64)))
    order = [F.asc("entity_id"), F.asc("entity_type")]
    for keys in (["assessment_id", "_salt"], ["assessment_id"]):
        salted = salted.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= k)
    return salted.select("assessment_id", "entity_type", "entity_id")


def cosine_topk_all(queries: DataFrame, vectors: DataFrame, k: int, types: list[str] | None = None, query_block: int = 1024, vector_block: int = 4096) -> DataFrame:
    """What cosine_topk gives, by comparing all: queries and vectors are dealt into blocks by hash and every pair of blocks of
    an assessment is one matrix product in a group of bounded size, which hands on at most k rows a query.
    """
    own = (vectors if types is None else vectors.where(F.col("entity_type").isin(*types))).where("vector is not null").select("assessment_id", "entity_type", "entity_id", "vector")
    asked = queries.where("vector is not null").select("assessment_id", "query_id", "vector")
    parts = _parts(asked, query_block, "q_parts").join(_parts(own, vector_block, "v_parts"), "assessment_id")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = own.join(parts, "assessment_id").withColumn("v", F.pmod(F.xxhash64("entity_type", "entity_id"), F.col("v_parts")).cast("int")).withColumn("q", every("q_parts")).drop("q_parts", "v_parts")
    right = asked.join(parts, "assessment_id").withColumn("q", F.pmod(F.xxhash64("query_id"), F.col("q_parts")).cast("int")).withColumn("v", every("v_parts")).drop("q_parts", "v_parts")

    keys = ["assessment_id", "v", "q"]
    met = left.groupBy(*keys).cogroup(_apart(right).groupBy(*keys)).applyInPandas(_nearest(k), _FOUND.format(a=own.schema["assessment_id"].dataType.simpleString()))
    return _ranked(met, k)
