"""Token ids as flat unsigned integer files with 64-bit document offsets (operator 10).

A data set is a folder of shards in ascending doc_id order. Shard k has `ids-k.bin` (the ids of its documents, end
to end), `offsets-k.bin` (n + 1 offsets in ids, unsigned 64-bit, from 0) and `docs-k.bin` (the doc_ids, signed
64-bit, 0 where there is none), all little-endian. A shard's base, the ids of all shards before it, is the prefix sum
of the shards' totals; `index.json` holds the shards with their bases, how many of their first documents have no
doc_id, and the width of an id. Files are written under a name of their own and renamed, so a task that is run again,
or twice at once, leaves whole files.
"""

from __future__ import annotations

import json
import math
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from contextlib import ExitStack
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.llm.bpe import gather, split_cuts
from estatelens.llm.encoding import blocks, once

#: The shards' number and size both grow with the root of the bytes, from UNIT bytes on, until a shard holds SHARD_BYTES.
UNIT = 1 << 16
SHARD_BYTES = 1 << 30
#: Documents that the reader takes at a time.
WINDOW = 4096


def place(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder given by path or URI."""
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub(r"^file:/*", "/", folder)
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)


def put(folder: str, name: str, data: bytes) -> None:
    fs, path = place(folder)
    draft = f"{path}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as out:
        out.write(data)
    fs.move(draft, f"{path}/{name}")


#: Latin characters whose lower case is one character that RUNS classifies as well.
PLAIN_LETTERS = "".join(c for c in map(chr, (*range(0x21, 0x7F), *range(0xA1, 0x250))) if len(c.lower()) == 1 and c.lower() < "ɐ")


class WordEncoder:
    """Ids of whole texts from a tokenizer file, by the tokenizers library.

    White space parts words for vocabularies that drop it, so texts are cut at spaces and line feeds. The distinct cuts of
    plain Latin characters are parted into the runs that the vocabulary's pre-tokenizer keeps apart, and the library is
    asked once for every new run, and for every other cut whole. A text that holds an added token's string goes to the
    library whole.
    """

    #: The pre-tokenizer's pattern for lower-cased Latin text (fixed value).
    RUNS = r"('s|'t|'re|'ve|'m|'ll|'d|[a-z\x{aa}\x{b5}\x{ba}\x{df}-\x{f6}\x{f8}-\x{24f}]+|[0-9\x{b2}\x{b3}\x{b9}\x{bc}-\x{be}]|[^a-z0-9\x{aa}\x{b2}\x{b3}\x{b5}\x{b9}\x{ba}\x{bc}-\x{be}\x{df}-\x{f6}\x{f8}-\x{24f}]+)"
    PLAIN = "^[" + "".join(f"\\x{{{ord(c):x}}}" for c in PLAIN_LETTERS) + "]*$"

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = sorted(x.content for x in self.tokenizer.get_added_tokens_decoder().values())
        self.special = "|".join(map(re.escape, added)) or r"\z\A."
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.limit = limit
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ending = None
        if suffix:
            self.ending = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
            self.ending[[n for token, n in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        self.odd: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}

    def _ask(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return [np.array(x.ids, dtype=self.dtype).tobytes() for x in found]

    def _ask_runs(self, runs: list[str]) -> list[bytes]:
        """As _ask, for runs that are one word each: asked for in long lines, which are parted after the tokens that end
        a word."""
        if self.ending is None:
            return self._ask(runs)
        lines = [runs[i : i + 2000] for i in range(0, len(runs), 2000)]
        values = []
        for line, found in zip(lines, self.tokenizer.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, dtype=self.dtype)
            ends = np.flatnonzero(self.ending[ids]) + 1
            if len(ends) == len(line):
                data, cuts = ids.tobytes(), (ends * ids.itemsize).tolist()
                values += [data[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]
            else:
                values += self._ask(line)
        return values

    def _known(self, texts: list[str], held: dict[str, bytes], ask) -> list[bytes]:
        """The ids of each text, asked for if they are not held yet."""
        if len(held) > self.limit:
            held.clear()
        held[""] = b""
        new = [t for t in texts if t not in held]
        held.update(zip(new, ask(new), strict=True))
        return [held[t] for t in texts]

    def _cut_ids(self, cuts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct cuts end to end, and how many each has."""
        plain = pc.and_not(pc.match_substring_regex(cuts, self.PLAIN), pc.match_substring_regex(cuts, self.special))
        others = cuts.filter(pc.invert(plain)).to_pylist()
        marked = pc.replace_substring_regex(pc.utf8_lower(pc.if_else(plain, cuts, "")), self.RUNS, r"\1 ")
        lists = pc.split_pattern(pc.if_else(plain, pc.utf8_rtrim(marked, " "), "x"), " ")
        coded = pc.dictionary_encode(lists.flatten())
        runs = coded.dictionary.to_pylist()
        codes = np.array(coded.indices, dtype=np.int64)
        firsts = np.asarray(lists.offsets)[: len(cuts)].astype(np.int64)
        codes[firsts[~np.asarray(plain)]] = len(runs) + np.arange(len(others))  # such a cut is one part
        known = self._known(runs, self.runs, self._ask_runs) + self._known(others, self.odd, self._ask)
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // self.dtype.itemsize
        ids, taken = gather(np.frombuffer(b"".join(known), dtype=self.dtype), lengths, codes)
        return ids, np.add.reduceat(taken, firsts) if len(firsts) else np.zeros(0, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text's ids start."""
        whole = pc.match_substring_regex(texts, self.special)
        later, firsts, codes, offsets = split_cuts(pc.if_else(whole, texts, pc.replace_substring(texts, "\n", " ")), whole)
        values, lengths = self._cut_ids(pa.concat_arrays([later, firsts]))
        ids, taken = gather(values, lengths, codes)
        return ids, np.concatenate(([0], np.cumsum(taken)))[offsets]


def shards_for(df: DataFrame) -> int:
    """How many shards the texts of df make, by their bytes: 1,000 of 64 MB for 64 GB, 100,000 of 1 GB for 100 TB."""
    total = df.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string")) + 8), F.lit(0))).first()[0]
    return max(1, -(-total // SHARD_BYTES), math.isqrt(total // UNIT))


def write_ids(df: DataFrame, folder: str, tokenizer: str, end_id: int, shards: int | None = None) -> dict:
    """Encode the texts of df, end each document with end_id and write the shards; returns the index.

    Documents are dealt to shards by ranges of doc_id (null first) and of a text hash among equal ids, then sorted, so
    one hot id is not one shard. The number of shards follows the bytes of the texts unless it is given. Null text counts
    as empty: the document is its end id alone. Repeated rows are written as often as they occur. An empty table gives an
    index without shards.
    """
    ordered = df.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = ordered.repartitionByRange(shards or shards_for(df), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    fs, path = place(folder)
    fs.create_dir(path, recursive=True)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, shard = once(("words", tokenizer), lambda: WordEncoder(tokenizer)), TaskContext.get().partitionId()
        end, total, docs, nulls = own.dtype.type(end_id), 0, 0, 0
        fs, path = place(folder)
        drafts = {n: f"{path}/.{n}-{shard}.{uuid.uuid4().hex}" for n in ("ids", "offsets", "docs")}
        with ExitStack() as stack:
            out = {n: stack.enter_context(fs.open_output_stream(draft)) for n, draft in drafts.items()}
            out["offsets"].write(np.zeros(1, "<u8").tobytes())
            for batch in batches:
                docs += batch.num_rows
                nulls += batch["doc_id"].null_count
                out["docs"].write(np.asarray(batch["doc_id"].fill_null(0)).astype("<i8").tobytes())
                for block in blocks(batch["text"]):
                    ids, starts = own.encode(block)
                    ids = np.insert(ids, starts[1:], end)
                    out["ids"].write(ids.tobytes())
                    out["offsets"].write((total + starts[1:] + np.arange(1, len(starts))).astype("<u8").tobytes())
                    total += len(ids)
        for n, draft in drafts.items():
            if docs:
                fs.move(draft, f"{path}/{n}-{shard}.bin")
            else:
                fs.delete_file(draft)
        if docs:
            yield pa.RecordBatch.from_pydict({"shard": [shard], "docs": [docs], "nulls": [nulls], "ids": [total], "width": [own.dtype.itemsize]})

    totals = sorted(tuple(r) for r in dealt.mapInArrow(work, "shard long, docs long, nulls long, ids long, width long").collect())
    bases = accumulate((row[3] for row in totals), initial=0)
    index = {"width": totals[0][4] if totals else 2, "shards": [{"shard": k, "docs": d, "nulls": m, "ids": n, "base": b} for (k, d, m, n, _), b in zip(totals, bases, strict=False)]}
    put(folder, "index.json", json.dumps(index).encode())
    return index


class Mapped:
    """A file of numbers, sliced like an array: memory-mapped where the folder is a path, read range by range otherwise."""

    def __init__(self, folder: str, name: str, dtype: str):
        fs, path = place(folder)
        self.dtype, full = np.dtype(dtype), f"{path}/{name}"
        self.file = self.array = None
        if isinstance(fs, pafs.LocalFileSystem):
            self.array = np.memmap(full, dtype=dtype, mode="r") if os.path.getsize(full) else np.zeros(0, dtype)
        else:
            self.file = fs.open_input_file(full)

    def __getitem__(self, part: slice) -> np.ndarray:
        if self.file is None:
            return self.array[part]
        return np.frombuffer(self.file.read_at((part.stop - part.start) * self.dtype.itemsize, part.start * self.dtype.itemsize), self.dtype)


def read_ids(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, the ids.

    One task reads one shard, WINDOW documents at a time; the checksum is over the ids as little-endian unsigned 32-bit
    integers. A document written without a doc_id has none again.
    """
    fs, path = place(folder)
    with fs.open_input_stream(f"{path}/index.json") as file:
        index = json.loads(file.read())
    dtype = f"<u{index['width']}"
    fields = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", token_ids array<long>" * with_ids
    rows = [(s["shard"], s["base"], s["docs"], s["nulls"]) for s in index["shards"]]
    places = spark.range(0, len(rows), 1, max(1, len(rows)))  # a slice of one place for each shard

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, base, n, nulls in (rows[k] for k in batch["id"].to_pylist()):
                ids, offsets, docs = (Mapped(folder, f"{name}-{shard}.bin", t) for name, t in (("ids", dtype), ("offsets", "<u8"), ("docs", "<i8")))
                for at in range(0, n, WINDOW):
                    end = min(at + WINDOW, n)
                    bounds = offsets[at : end + 1].astype(np.int64)
                    held = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                    own = docs[at:end].astype(np.int64)
                    columns = [pa.array(own, mask=np.arange(at, end) < nulls), pa.array(bounds[:-1] + base), pa.array(np.diff(bounds)), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in held], pa.int64())]
                    if with_ids:
                        columns.append(pa.array([x.astype(np.int64) for x in held], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "token_ids"][: len(columns)])

    return places.mapInArrow(work, fields)
