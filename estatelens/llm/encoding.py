"""Encoding and decoding of whole texts with a byte-level vocabulary (operator 1)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.llm import bpe

#: Texts are worked on in blocks of about this many bytes, so a batch of long texts stays small in memory.
BLOCK_BYTES = 8_000_000
_LOADED: dict[tuple, object] = {}


def once(key: tuple, make: Callable[[], object]) -> object:
    """One object per Python worker; later tasks of the worker find it again."""
    if key not in _LOADED:
        _LOADED[key] = make()
    return _LOADED[key]


def blocks(texts: pa.Array, size: int = BLOCK_BYTES) -> Iterator[pa.Array]:
    """The texts in order, null as empty, in blocks of bounded size (a longer text is a block of its own)."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield texts.slice(at, end - at)
        at = end


class Encoder:
    """Ids of texts as little-endian unsigned 16- or 32-bit integers."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.table = bpe.from_tiktoken(file.read())
        self.dtype = np.dtype("<u2" if self.table.sentinel <= 65536 else "<u4")
        self.memo = bpe.PretokenMemo(self._values)
        self.decimal = [str(i) for i in range(self.table.sentinel)]

    def _values(self, words: list[str]) -> list[bytes]:
        ids, starts = self.table.encode_many([w.encode() for w in words])
        data, cuts = ids.astype(self.dtype).tobytes(), (starts * self.dtype.itemsize).tolist()
        return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text's ids start."""
        known, codes, offsets = self.memo.values(texts)
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // self.dtype.itemsize
        ids, taken = bpe.gather(np.frombuffer(b"".join(known), dtype=self.dtype), lengths, codes)
        return ids, np.concatenate(([0], np.cumsum(taken)))[offsets]


def encoder(path: str) -> Encoder:
    return once(("encoder", path), lambda: Encoder(path))


def encode_texts(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """Add the token ids of a text column as array<int>.

    Null counts as the empty text and gives an empty array. Each pre-token is encoded separately and special tokens
    are ordinary text. Rows, other columns and repeated rows pass through; a column named like `ids` is replaced.
    """
    kept = [c for c in df.columns if c != ids]
    schema = df.select(*kept).withColumn(ids, F.lit(None).cast("array<int>")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            at = 0
            for block in blocks(batch[text]):
                values, starts = own.encode(block)
                column = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values.astype(np.int32)))
                part = batch.slice(at, len(block))
                at += len(block)
                yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*kept, ids])

    return df.select(*kept).mapInArrow(work, schema)


def decode_ids(df: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that a column of token ids stands for; null ids give null, an unknown id is an error."""
    kept = [c for c in df.columns if c != out]
    schema = df.select(*kept).withColumn(out, F.lit(None).cast("binary")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = encoder(path).table
        for batch in batches:
            column = pa.array((None if x is None else table.decode(x) for x in batch[ids].to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*kept, out])

    return df.select(*kept).mapInArrow(work, schema)


def round_trip_digests(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document, with nothing but digests leaving a task.

    Null text counts as empty: no tokens, and the digests of the empty string. Repeated rows are repeated.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            counts, coded, decoded = [], [], []
            for block in blocks(batch["text"]):
                ids, starts = own.encode(block)
                for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    listed = ids[a:b].tolist()
                    counts.append(b - a)
                    coded.append(hashlib.sha256(",".join(map(own.decimal.__getitem__, listed)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(own.table.decode(listed)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
