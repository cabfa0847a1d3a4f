"""Toxicity grades by cumulative-link ordinal regression (operator 5).

One weight vector over sparse text features serves all ordered thresholds:
P(grade <= k) = sigmoid(threshold_k - w x). Features are words and word beginnings, by the logarithm of their counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.llm.common import cut_words, spaced_words
from estatelens.llm.encoding import blocks
from estatelens.storage import checkpointed

#: The model is fitted on at most this many labelled documents, those with the smallest hashes of their ids.
SAMPLE_ROWS = 20_000
#: It has at most so many features, each in LEAST_TEXTS documents of the sample or more.
MAX_FEATURES = 4_000
LEAST_TEXTS = 5
#: Grades: 0 not toxic, 1 to 3 mild to severe.
GRADES = 4
#: Lengths of the word beginnings that are features beside the word itself.
HEADS = (4, 5)
#: Texts are worked on in blocks of about this many bytes.
BLOCK_BYTES = 4_000_000


def occurrences(texts: pa.Array, chosen: pa.Array | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, owner, code, count, sizes): the count of every feature in every text that has it, and the texts' words.

    Features are the words and, marked, their first four and five characters if they are longer; those in `chosen`, or all
    that occur. owner and code are the places of the text and of the feature, in ascending order.
    """
    words, owner, sizes = cut_words(spaced_words(texts))
    coded = pc.dictionary_encode(words)
    distinct, length = coded.dictionary, np.asarray(pc.utf8_length(coded.dictionary))
    slots = np.full((len(distinct), 1 + len(HEADS)), -1, np.int64)
    longer = [np.flatnonzero(length > n) for n in HEADS]
    heads = [pc.binary_join_element_wise(pc.utf8_slice_codeunits(distinct.take(pa.array(at)), 0, n), "*", "") for n, at in zip(HEADS, longer, strict=True)]
    names = pa.concat_arrays([distinct, *heads])
    if chosen is None:
        found = pc.dictionary_encode(names)
        chosen, codes = found.dictionary, np.asarray(found.indices)
    else:
        codes = np.asarray(pc.fill_null(pc.index_in(names, value_set=chosen), -1))
    at = 0
    for k, rows in enumerate((np.arange(len(distinct)), *longer)):
        slots[rows, k] = codes[at : at + len(rows)]
        at += len(rows)
    words_at = np.asarray(coded.indices)
    held = (slots >= 0).any(axis=1)[words_at]
    slots, owner = slots[words_at[held]], owner[held]
    keys = (owner[:, None] * max(1, len(chosen)) + slots)[slots >= 0]
    keys, counts = np.unique(keys, return_counts=True)
    return chosen, keys // max(1, len(chosen)), keys % max(1, len(chosen)), counts, sizes


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def grades(self, scores: np.ndarray) -> np.ndarray:
        """Probability of every grade, a row for each score."""
        below = 1 / (1 + np.exp(-np.clip(np.array(self.thresholds) - scores[:, None], -500, 500)))
        ends = np.zeros((len(scores), 1))
        return np.diff(np.concatenate((ends, below, ends + 1), axis=1), axis=1)


def labelled_texts(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, toxic, text) of at most `rows` labelled documents, those with the smallest hashes of id and text.

    A document with several labels counts as toxic if one says so; labels other than 0 and 1 are none. Texts that share an
    id are documents of their own, repeated rows are one. Keys are chosen first, so no more than `rows` texts are moved.
    """
    toxic = F.col("toxic").try_cast("int")
    given = labels.where(F.col("doc_id").isNotNull() & toxic.isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(toxic).alias("toxic"))
    text = F.col("text").cast("string")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    chosen = keyed.select("doc_id", "mark").join(given, "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "mark").limit(rows)
    held = F.broadcast(checkpointed(chosen))  # at most `rows` rows of three numbers
    return keyed.join(held, ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"]).select("doc_id", "toxic", "text")


def choose_features(texts: DataFrame, most: int = MAX_FEATURES) -> tuple[list[str], np.ndarray, list[int]]:
    """The features whose document frequencies differ most between the classes, by the log odds' z score, with their two
    frequencies, and the two classes' sizes."""
    classes = [0, 0]
    for r in texts.groupBy("toxic").count().collect():
        classes[r["toxic"]] = r["count"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = np.asarray(batch["toxic"])
            at = 0
            for block in blocks(batch["text"], BLOCK_BYTES):
                names, owner, code, _, _ = occurrences(block)
                bad = toxic[at : at + len(block)][owner] == 1
                at += len(block)
                yield pa.RecordBatch.from_arrays([names, *(pa.array(np.bincount(code[part], minlength=len(names))) for part in (~bad, bad))], names=["feature", "b", "a"])

    counts = texts.select("text", "toxic").mapInArrow(work, "feature string, b long, a long").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where(F.col("a") + F.col("b") >= LEAST_TEXTS)
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    odds = F.log(a / (classes[1] + 1.0)) - F.log(b / (classes[0] + 1.0))
    best = counts.withColumn("z", F.abs(odds / F.sqrt(1 / a + 1 / b))).orderBy(F.desc("z"), "feature").limit(most).collect()
    return [r["feature"] for r in best], np.array([[r["b"], r["a"]] for r in best], dtype=float).reshape(-1, 2).T, classes


def sparse_counts(texts: DataFrame, chosen: list[str]) -> pa.Table:
    """doc_id, toxic, n_words, at and n (indexes and occurrences of the chosen features) of the sample, by doc_id."""
    held = texts.sparkSession.sparkContext.broadcast(chosen)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = pa.array(held.value, pa.string())
        for batch in batches:
            at = 0
            for block in blocks(batch["text"], BLOCK_BYTES):
                _, owner, code, n, sizes = occurrences(block, index)
                ends = pa.array(np.searchsorted(owner, np.arange(len(block) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (code, n)]
                part = batch.slice(at, len(block))
                at += len(block)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["toxic"], pa.array(sizes), *lists], names=["doc_id", "toxic", "n_words", "at", "n"])

    return texts.mapInArrow(work, "doc_id long, toxic int, n_words long, at array<int>, n array<int>").toArrow().sort_by([("doc_id", "ascending"), ("n_words", "ascending")])


def fit_ordinal(owner: np.ndarray, column: np.ndarray, value: np.ndarray, grades: np.ndarray, width: int, steps: int = 600, penalty: float = 1e-4, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds of the proportional-odds model, by full-batch Adam on the mean likelihood.

    Thresholds are a first one and positive gaps, so they stay ordered. The sparse features are (row, feature, value).
    """
    rows = len(grades)
    counts = np.maximum(np.bincount(grades, minlength=GRADES), 0.5)
    share = np.cumsum(counts / counts.sum())[:-1]
    start = np.log(share / (1 - share))
    theta = np.concatenate((np.zeros(width), start[:1], np.log(np.maximum(np.diff(start), 0.05))))
    mean, square = np.zeros_like(theta), np.zeros_like(theta)

    def logistic(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))

    for step in range(1, steps + 1):
        w, cuts = theta[:width], np.cumsum(np.concatenate((theta[width : width + 1], np.exp(theta[width + 1 :]))))
        score = np.bincount(owner, weights=value * w[column], minlength=rows)
        edges = np.concatenate(([-np.inf], cuts, [np.inf]))
        low, high = logistic(edges[grades] - score), logistic(edges[grades + 1] - score)
        low[grades == 0], high[grades == GRADES - 1] = 0, 1
        chance = np.maximum(high - low, 1e-9)
        d_low, d_high = low * (1 - low), high * (1 - high)
        by_score = (d_high - d_low) / chance / rows  # of the negative log likelihood
        by_cut = np.zeros(GRADES + 1)
        np.add.at(by_cut, grades + 1, -d_high / chance / rows)
        np.add.at(by_cut, grades, d_low / chance / rows)
        inner = by_cut[1:GRADES]
        gaps = np.cumsum(inner[::-1])[::-1]
        grad = np.concatenate((np.bincount(column, weights=value * by_score[owner], minlength=width) + penalty * w, gaps[:1], gaps[1:] * np.exp(theta[width + 1 :])))
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        theta -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return theta[:width], np.cumsum(np.concatenate((theta[width : width + 1], np.exp(theta[width + 1 :]))))


def strength(count, n_words):
    """A feature's value: growing with the logarithm of its count, so junk repeats add little, and falling slowly with
    the length of the text."""
    return 4 * np.log1p(count) / (n_words + 20) ** 0.3


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most: int = MAX_FEATURES) -> Model:
    """The model of a bounded sample of labelled documents.

    Labels only say toxic or not. Toxic documents are graded 1 to 3 by thirds of how often they use the features that
    toxic documents have ten times as often as others. Without both classes among the labels the model has no
    weights, and every document gets grade 0.
    """
    texts = checkpointed(labelled_texts(docs, labels, rows))  # at most `rows` texts, read three times
    chosen, seen, classes = choose_features(texts, most)
    if not all(classes) or not chosen:
        return Model({}, (1e3, 1e3 + 1, 1e3 + 2))
    sparse = sparse_counts(texts, chosen)
    toxic, sizes = sparse["toxic"].to_numpy(), sparse["n_words"].to_numpy()
    at, n = sparse["at"].combine_chunks(), sparse["n"].combine_chunks()
    column = at.flatten().to_numpy()
    owner = np.repeat(np.arange(len(toxic)), pc.list_value_length(at).to_numpy())
    value = strength(n.flatten().to_numpy(), sizes[owner])
    share = (seen + 0.5) / (np.array(classes)[:, None] + 1)
    strong = share[1] > 10 * share[0]
    intensity = np.bincount(owner, weights=value * strong[column], minlength=len(toxic))
    bounds = np.quantile(intensity[toxic == 1], [1 / 3, 2 / 3])
    grades = np.where(toxic == 1, 1 + (intensity[:, None] > bounds).sum(axis=1), 0)
    weights, thresholds = fit_ordinal(owner, column, value, grades, len(chosen))
    return Model({f: float(w) for f, w in zip(chosen, weights, strict=True)}, tuple(map(float, thresholds)))


def score(df: DataFrame, model: Model, reject_at: float = 0.5) -> DataFrame:
    """Add grade (the likeliest), expected_severity, p_toxic (of any grade above 0) and rejected (p_toxic >= reject_at).

    Null and wordless texts score 0. Columns of those names are replaced; other columns and repeated rows pass
    through. The model is broadcast; its size is bounded by the number of features.
    """
    new = ["grade", "expected_severity", "p_toxic", "rejected"]
    kept = [c for c in df.columns if c not in new]
    schema = df.select(*kept, F.lit(0).alias("grade"), F.lit(0.0).alias("expected_severity"), F.lit(0.0).alias("p_toxic"), F.lit(False).alias("rejected")).schema
    held = df.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        index, weights = pa.array(model.weights, pa.string()), np.fromiter(model.weights.values(), float, len(model.weights))
        for batch in batches:
            at = 0
            for block in blocks(batch["text"].cast(pa.string()), BLOCK_BYTES):
                _, owner, code, n, sizes = occurrences(block, index)
                chances = model.grades(np.bincount(owner, weights=strength(n, sizes[owner]) * weights[code], minlength=len(block)))
                p_toxic = 1 - chances[:, 0]
                columns = [np.argmax(chances, axis=1).astype(np.int32), np.round(chances @ np.arange(GRADES), 9), np.round(p_toxic, 9), p_toxic >= reject_at]
                part = batch.slice(at, len(block))
                at += len(block)
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, columns)], names=[*kept, *new])

    return df.select(*kept).mapInArrow(work, schema)
