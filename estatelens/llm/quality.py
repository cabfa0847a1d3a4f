"""Quality by weak supervision (operator 11).

Rules look at counts of a text and vote that it is good or bad, or abstain. Expectation-maximisation over the votes of all
documents estimates how often each rule votes what on good and on bad documents; the posterior probability of a good one
takes the place of a filter that every rule has to pass. What is gathered is the number of documents by votes, at most
3 ** len(RULES) rows whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.llm.encoding import blocks

BAD, ABSTAIN, GOOD = 0, 1, 2
Columns = dict[str, np.ndarray]
#: Kinds of bad documents; every rule looks for one.
KINDS = ("symbols", "repetition", "shouting", "shape")
#: (name, kind, measure, bad from, good up to): a measure of `bad from` or more is a vote for bad, one up to `good up to` for
#: good; between them a rule abstains, and where a measure is not defined (no words, letters or lines).
RULES: tuple[tuple[str, str, Callable[[Columns], np.ndarray], float, float], ...] = (
    ("symbols", "symbols", lambda c: c["n_symbols"] / c["n_words"], 0.1, 0.02),
    ("words without letters", "symbols", lambda c: 1 - c["n_letter_words"] / c["n_words"], 0.3, 0.15),
    ("marks", "symbols", lambda c: 1 - c["n_letters"] / c["word_chars"], 0.3, 0.15),
    ("repeated words", "repetition", lambda c: c["n_repeat_words"] / c["n_words"], 0.3, 0.1),
    ("repeated lines", "repetition", lambda c: c["n_dup_lines"] / c["n_lines"], 0.5, 0.05),
    ("capitals", "shouting", lambda c: c["n_capitals"] / c["n_letters"], 0.5, 0.2),
    ("exclamations", "shouting", lambda c: c["n_exclamations"] / c["n_words"], 0.25, 0.05),
    ("long words", "shape", lambda c: c["word_chars"] / c["n_words"], 13.0, 10.0),
    ("short words", "shape", lambda c: c["n_words"] / c["word_chars"], 0.4, 0.3),
    ("few words", "shape", lambda c: LEAST_WORDS / c["n_words"], 1.0, 0.5),
)
#: Words a text has to have, and the share of its words in repeated windows of three that it may have, whatever its posterior.
LEAST_WORDS, MOST_REPEATED = 50, 0.5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals", "n_exclamations", "n_letter_words")

_SPACE = np.array([b == 0x20 or 9 <= b <= 13 for b in range(256)])
_START = np.array([not 0x80 <= b <= 0xBF for b in range(256)])  # the first byte of a code point
_SYMBOL = np.array([b in b"#*$%&|<>" for b in range(256)])
_CAPITAL = np.array([0x41 <= b <= 0x5A for b in range(256)])
_LETTER = np.array([0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0xC0 for b in range(256)])  # code points above ASCII count as letters
_SHOUT = np.array([b == 0x21 for b in range(256)])


def _repeats(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether each key occurs more than once among those of its owner."""
    _, dense, times = np.unique(_paired(owner, keys), return_inverse=True, return_counts=True)
    return times[dense] > 1


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for each pair of numbers."""
    return a * (int(b.max()) + 1 if len(b) else 1) + b


def _dense(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1]


def _lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The number of lines with a word of each text, and of those that are equal to an earlier one."""
    lists = pc.split_pattern(texts, "\n")
    offsets = np.asarray(lists.offsets).astype(np.int64)
    flat = lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    filled = np.asarray(pc.binary_length(pc.ascii_trim(flat, " \t\r\x0b\x0c"))) > 0
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))[filled]
    codes = flat.filter(pa.array(filled)).dictionary_encode().indices.to_numpy().astype(np.int64)
    n_lines = np.bincount(owner, minlength=len(texts))
    size = int(codes.max()) + 1 if len(codes) else 1
    distinct = np.bincount(np.unique(owner * size + codes) // size, minlength=len(texts))
    return n_lines, n_lines - distinct


def counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each of the texts (without nulls). Words are what ASCII white space separates."""
    n = len(texts)
    texts = pa.concat_arrays([texts.cast(pa.string())])
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends -= ends[0]

    def by_text(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(mask, dtype=np.int32)))[ends]).astype(np.int64)

    space, letter = _SPACE[data], _LETTER[data]
    found = {"word_chars": by_text(_START[data] & ~space), "n_symbols": by_text(_SYMBOL[data]), "n_letters": by_text(letter), "n_capitals": by_text(_CAPITAL[data]), "n_exclamations": by_text(_SHOUT[data])}
    spaced = np.where(space, np.uint8(0x20), data)
    lists = pc.split_pattern(pa.StringArray.from_buffers(n, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(spaced)), " ")
    offsets = np.asarray(lists.offsets).astype(np.int64)
    flat = lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    sizes = np.asarray(pc.binary_length(flat)).astype(np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]  # a piece and the space after it; texts follow without one
    owner = np.repeat(np.arange(n), np.diff(offsets))
    starts -= owner
    kept = sizes > 0
    words, owner, starts, sizes = flat.filter(pa.array(kept)), owner[kept], starts[kept], sizes[kept]
    lettered = np.concatenate(([0], np.cumsum(letter, dtype=np.int32)))
    found["n_words"] = np.bincount(owner, minlength=n)
    found["n_letter_words"] = np.bincount(owner[lettered[starts + sizes] > lettered[starts]], minlength=n)
    codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    repeated = np.zeros(len(codes), bool)
    if len(codes) > 2:
        inside = owner[2:] == owner[:-2]
        windows = _dense(_paired(_dense(_paired(codes[:-2], codes[1:-1])), codes[2:]))
        again = np.flatnonzero(inside)[_repeats(windows[inside], owner[:-2][inside])]
        for k in range(3):
            repeated[again + k] = True
    found["n_repeat_words"] = np.bincount(owner[repeated], minlength=n)
    found["n_lines"], found["n_dup_lines"] = _lines(texts)
    return found


def votes(found: Columns) -> np.ndarray:
    """A column of BAD, ABSTAIN or GOOD for each rule."""
    columns = {k: v.astype(float) for k, v in found.items()}
    out = []
    with np.errstate(divide="ignore", invalid="ignore"):
        for _, _, measure, bad, good in RULES:
            value = measure(columns)
            value[~np.isfinite(value)] = np.nan
            out.append(np.where(value >= bad, BAD, np.where(value <= good, GOOD, ABSTAIN)))
    return np.stack(out, axis=1).astype(np.int64)


_POWERS = 3 ** np.arange(len(RULES))


@dataclass(frozen=True)
class LabelModel:
    """shares: of good documents and of each of KINDS; tables[rule, class, vote]: how often a rule that votes says BAD or GOOD in
    each of these classes. That a rule abstains says nothing (ABSTAIN's entries are 1)."""

    shares: np.ndarray
    tables: np.ndarray

    def classes(self, cast: np.ndarray) -> np.ndarray:
        """The probability of each class for documents with these votes, a row each."""
        log = np.log(self.shares) + sum(np.log(self.tables[j]).T[cast[:, j]] for j in range(len(RULES)))
        odds = np.exp(log - log.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True)

    def posterior(self, cast: np.ndarray) -> np.ndarray:
        """The probability that documents with these votes are good."""
        return self.classes(cast)[:, 0]

    def accuracies(self) -> dict[str, float]:
        """How often each rule is right where it votes: good documents called good, those of its kind called bad."""
        found = {}
        for (name, kind, *_), table in zip(RULES, self.tables * self.shares[:, None], strict=True):
            own = table[[0, 1 + KINDS.index(kind)]]
            found[name] = float((own[0, GOOD] + own[1, BAD]) / (own[:, BAD] + own[:, GOOD]).sum())
        return found


def _start() -> LabelModel:
    """Before any document is seen: four in five are good, and a rule says so of most; of its own kind it calls most bad."""
    tables = np.tile([0.05, 1.0, 0.95], (len(RULES), 1 + len(KINDS), 1))
    for j, (_, kind, *_) in enumerate(RULES):
        tables[j, 1 + KINDS.index(kind)] = [0.9, 1.0, 0.1]
    return LabelModel(np.array([0.8, *[0.2 / len(KINDS)] * len(KINDS)]), tables)


START = _start()
#: The start counts as so many documents beside those seen; rounds end when no share moves by more than SETTLED.
WEIGHT, ROUNDS, SETTLED = 10.0, 200, 1e-9


def estimate(cast: np.ndarray, n: np.ndarray) -> LabelModel:
    """The model that expectation-maximisation finds for n documents of each row of votes; no documents give START."""
    model = START
    for _ in range(ROUNDS):
        weights = model.classes(cast) * n[:, None] if len(cast) else np.zeros((0, 1 + len(KINDS)))
        shares = weights.sum(axis=0) + WEIGHT * START.shares
        tables = WEIGHT * START.tables * START.shares[:, None]
        for vote in (BAD, GOOD):
            tables[:, :, vote] += (cast == vote).T @ weights
        tables /= tables[:, :, [BAD, GOOD]].sum(axis=2, keepdims=True)
        tables[:, :, ABSTAIN] = 1
        settled = model
        model = LabelModel(shares / shares.sum(), tables)
        if np.abs(model.shares - settled.shares).max() <= SETTLED:
            break
    return model


def _texts(df: DataFrame) -> DataFrame:
    return df.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def fit(docs: DataFrame) -> LabelModel:
    """The label model of all documents; their votes are counted in Spark, the patterns of votes come to the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch["text"], BLOCK):
                patterns, n = np.unique(votes(counts(block)) @ _POWERS, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(patterns), pa.array(n.astype(np.int64))], names=["pattern", "n"])

    rows = _texts(docs).mapInArrow(work, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").toArrow()
    patterns = rows["pattern"].to_numpy()
    return estimate(patterns[:, None] // _POWERS % 3, rows["n"].to_numpy().astype(float))


#: Texts are worked on in blocks of about this many bytes.
BLOCK = 4_000_000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FIELDS = {**dict.fromkeys(BASE, pa.int64()), "base_failed": pa.bool_(), "kept": pa.bool_(), "quality": pa.float64(), "votes_bad": pa.int64(), "votes_good": pa.int64()}
_SQL = {pa.int64(): "long", pa.bool_(): "boolean", pa.float64(): "double"}


def judge(df: DataFrame, model: LabelModel) -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality, votes_bad, votes_good.

    word_chars are the code points in words, n_symbols counts # * $ % & | < >, n_dup_lines the lines with a word that equal
    an earlier line, n_repeat_words the words in windows of three that occur twice or more in the text. quality is the
    posterior probability of a good document; kept means 0.5 or more and not base_failed. Null text counts as empty (no
    words: base_failed). Columns of these names are replaced, others pass through, equal rows are judged alike.
    """
    kept = [c for c in df.columns if c not in FIELDS]
    named = df.select(*(F.col(f"`{c}`") for c in kept))
    schema = named.select("*", *(F.lit(None).cast(_SQL[t]).alias(n) for n, t in FIELDS.items())).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for block in blocks(batch["text"], BLOCK):
                part = batch.slice(at, len(block))
                at += len(block)
                found = counts(block)
                cast = votes(found)
                quality = model.posterior(cast)
                failed = (found["n_words"] < LEAST_WORDS) | (found["n_repeat_words"] > MOST_REPEATED * found["n_words"])
                made = [*(found[c] for c in BASE), failed, ~failed & (quality >= 0.5), quality, (cast == BAD).sum(axis=1), (cast == GOOD).sum(axis=1)]
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, t) for c, t in zip(made, FIELDS.values(), strict=True))], names=[*kept, *FIELDS])

    return named.mapInArrow(work, schema)
