"""Small helpers that the corpus operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words of the contamination and licence contracts: runs of digits, ASCII letters and anything above ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(text, UPPER, UPPER.lower())


def words_of(text: Column) -> Column:
    """Array of the words of a text; null and blank texts give an empty array."""
    lowered = lower_ascii(F.coalesce(text, F.lit("")))
    return F.filter(F.split(lowered, NOT_WORD, -1), lambda w: w != "")


#: What each UTF-8 byte becomes when words are cut: A-Z are lowered, ASCII outside words is a space.
_AS_WORDS = np.array([b + 32 if 0x41 <= b <= 0x5A else b if b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)], np.uint8)


def spaced_words(texts: pa.Array) -> pa.Array:
    """The texts (null as empty) with A-Z lowered and every other ASCII character outside words as a space, byte for byte."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(_AS_WORDS[data]))


def count_words(spaced: pa.Array) -> np.ndarray:
    """The number of words of each text from spaced_words."""
    ends = np.frombuffer(spaced.buffers()[1], np.int32)[: len(spaced) + 1] if len(spaced) else np.zeros(1, np.int32)
    inside = np.frombuffer(spaced.buffers()[2] or b"", np.uint8) != 0x20
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[ends[:-1][ends[:-1] < len(inside)]] = inside[ends[:-1][ends[:-1] < len(inside)]]  # a text's first word may follow another text's last
    return np.diff(np.concatenate(([0], np.cumsum(first)))[ends])


def cut_words(spaced: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of texts from spaced_words in order, the text that each belongs to, and the number of words of each text."""
    lists = pc.split_pattern(spaced, " ")
    offsets = np.asarray(lists.offsets)[: len(spaced) + 1].astype(np.int64)
    flat = lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    kept = np.asarray(pc.binary_length(flat)) > 0
    owner = np.repeat(np.arange(len(spaced)), np.diff(offsets))[kept]
    return flat.filter(pa.array(kept)), owner, np.bincount(owner, minlength=len(spaced))
