"""Token counts with the whole-token shortcut (operator 7).

For every string of the vocabulary it is settled once, by merging it alone, whether it comes out as one token. A
pre-token among those strings counts as one without being merged; only the others go through the merge queue.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.llm import bpe
from estatelens.llm.encoding import blocks, once


def load(path: str) -> tuple[bpe.MergeTable, dict[str, int]]:
    with open(path, encoding="utf-8") as file:
        return bpe.from_json(file.read())


def prove_whole(table: bpe.MergeTable) -> frozenset[str]:
    """The vocabulary's strings that come out as one token when they are merged alone; at most the vocabulary."""
    counts = np.diff(table.encode_many(table.vocab)[1]).tolist()
    return frozenset(token.decode() for token, n in zip(table.vocab, counts, strict=True) if n == 1 and valid(token))


class Counter:
    def __init__(self, path: str, whole: frozenset[str]):
        self.table, added = load(path)
        self.added = sorted(added, key=lambda s: (-len(s), s))
        self.whole = whole
        self.memo = bpe.PretokenMemo(self._values)

    def _values(self, words: list[str]) -> list[int]:
        counts = [int(w in self.whole) for w in words]
        rest = [i for i, n in enumerate(counts) if not n]
        for i, n in zip(rest, np.diff(self.table.encode_many([words[i].encode() for i in rest])[1]).tolist(), strict=True):
            counts[i] = n
        return counts

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; an added token's string inside a text is one token and parts the text there."""
        total, owner = np.zeros(len(texts), dtype=np.int64), np.arange(len(texts))
        for special in self.added:
            lists = pc.split_pattern(texts, special)
            pieces = np.diff(np.asarray(lists.offsets))[: len(texts)]
            np.add.at(total, owner, pieces - 1)
            owner, texts = np.repeat(owner, pieces), lists.flatten()
        known, codes, offsets = self.memo.values(texts)
        sums = np.concatenate(([0], np.cumsum(np.array(known, dtype=np.int64)[codes])))
        np.add.at(total, owner, np.diff(sums[offsets]))
        return total


def valid(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


def count_tokens(df: DataFrame, path: str, limit: int = 1024, text: str = "text") -> DataFrame:
    """Add n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) to every row.

    Null counts as the empty text: 0 bytes, 0 tokens. Columns of those names are replaced; other columns and
    repeated rows pass through.
    """
    new = ["n_bytes", "n_tokens", "over_limit"]
    kept = [c for c in df.columns if c not in new]
    whole = df.sparkSession.sparkContext.broadcast(once(("whole", path), lambda: prove_whole(load(path)[0])))
    schema = df.select(*kept, F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens"), F.lit(False).alias("over_limit")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = once(("counter", path), lambda: Counter(path, whole.value))
        for batch in batches:
            sizes, counts = [], []
            for block in blocks(batch[text]):
                sizes += pc.binary_length(block).to_pylist()
                counts += own.count(block).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], names=[*kept, *new])

    return df.select(*kept).mapInArrow(work, schema)
