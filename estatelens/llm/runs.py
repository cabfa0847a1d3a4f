"""Periodic runs of words, found on a suffix automaton with link-cut access (operator 12).

Words are appended to a suffix automaton one by one. Its suffix links form a tree, kept as a link-cut tree whose preferred
paths are the stretches of one last occurrence. Appending a word makes the path from the root to the new node last occur
at that word; the segments that this recolours say where each suffix of the text so far occurred before. A suffix of
length n that ended q words earlier, n >= q, is the end of a square, which is extended to its run.

Automata are built for those stretches of a text alone in which a run can lie: past its first period every word of a run
of period q has occurred within the q words before it, so a text of m words holds no run of period q unless as many
words in a row have.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.llm.encoding import blocks

LEAST, REPEATS = 6, 4
#: What each byte becomes when words are cut: white space of ASCII is a space.
_SPACED = np.array([0x20 if b == 0x20 or 9 <= b <= 13 else b for b in range(256)], np.uint8)

Run = tuple[int, int, int]


class LastOccurrences:
    """A suffix automaton whose link tree is a link-cut tree: `append` returns the segments that the new word recolours."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.length, self.link, self.last = [0], [-1], 0
        # splay trees of the preferred paths: children, parent (of a root: the node its path hangs from), last occurrence (of a root)
        self.left, self.right, self.up, self.seen = [-1], [-1], [-1], [-1]

    def _node(self, length: int, link: int, follow: dict[int, int], seen: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        self.left.append(-1)
        self.right.append(-1)
        self.up.append(link)
        self.seen.append(seen)
        return len(self.length) - 1

    def _splay(self, x: int) -> None:
        left, right, up, seen = self.left, self.right, self.up, self.seen

        def rotate(x: int, p: int) -> None:
            g = up[p]
            if left[p] == x:
                b = left[p] = right[x]
                right[x] = p
            else:
                b = right[p] = left[x]
                left[x] = p
            if b >= 0:
                up[b] = p
            up[p], up[x], seen[x] = x, g, seen[p]
            if g >= 0:
                if left[g] == p:
                    left[g] = x
                elif right[g] == p:
                    right[g] = x

        while (p := up[x]) >= 0 and (left[p] == x or right[p] == x):
            g = up[p]
            if g >= 0 and (left[g] == p or right[g] == p):
                if (left[p] == x) == (left[g] == p):
                    rotate(p, g)
                else:
                    rotate(x, p)
                    p = g
            rotate(x, p)

    def _insert_above(self, node: int, length: int) -> int:
        """A clone of the node, of a smaller length, between the node and its link."""
        self._splay(node)
        above = self.left[node]
        if above >= 0:  # the part of the path above the node becomes a path of its own
            self.left[node], self.up[above], self.seen[above] = -1, self.up[node], self.seen[node]
        clone = self._node(length, self.link[node], dict(self.next[node]), self.seen[node])
        self.link[node] = self.up[node] = clone
        return clone

    def append(self, word: int) -> list[tuple[int, int]]:
        """(end of the last occurrence, greatest length of a suffix that last occurred there), longest suffixes first."""
        at, length, follow = self.last, self.length, self.next
        new = self._node(length[at] + 1, 0, {}, -1)
        while at >= 0 and word not in follow[at]:
            follow[at][word] = new
            at = self.link[at]
        if at >= 0:
            target = follow[at][word]
            if length[at] + 1 < length[target]:
                clone = self._insert_above(target, length[at] + 1)
                while at >= 0 and follow[at].get(word) == target:
                    follow[at][word] = clone
                    at = self.link[at]
                target = clone
            self.link[new] = self.up[new] = target
        self.last = new
        return self._access(new, length[new] - 1)

    def _access(self, node: int, end: int) -> list[tuple[int, int]]:
        left, right, up, seen, length = self.left, self.right, self.up, self.seen, self.length
        segments, below = [], -1
        at = node
        while at >= 0:
            self._splay(at)
            if at != node and length[at]:
                segments.append((seen[at], length[at]))
            rest = right[at]
            if rest >= 0:
                seen[rest] = seen[at]  # what hangs deeper keeps its last occurrence, on a path of its own
            right[at] = below
            below, at = at, up[at]
        self._splay(node)
        seen[node] = end
        return segments


def least_length(period: int) -> int:
    return max(LEAST, REPEATS * period)


def runs_between(words: list[int], low: int, high: int) -> set[Run]:
    """(start, length, period) of the runs that lie in words[low:high], extended as far as they go in all words."""
    tree, found, reached = LastOccurrences(), set(), {}
    for i in range(low, high):
        for last, n in tree.append(words[i]):
            period = i - low - last
            # at a run's last word the suffix of the run's length less one period last ended a period earlier
            if n >= least_length(period) - period and reached.get(period, -1) < i:
                start, end = i - n - period + 1, i + 1
                while start and words[start - 1] == words[start - 1 + period]:
                    start -= 1
                while end < len(words) and words[end] == words[end - period]:
                    end += 1
                reached[period] = end - 1
                found.add((start, end - start, period))
    return found


def stretches(codes: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, int]]:
    """(low, high) of disjoint stretches that hold all runs of the texts whose words' codes and numbers are given in order."""
    n = len(codes)
    if n < LEAST:
        return
    keys = owner * (int(codes.max()) + 1) + codes
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    back = np.full(n, n + 1, np.int64)
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    found, reach = [], 1
    while reach * REPEATS // 2 <= n:
        # periods above reach / 2 up to reach
        least = reach // 2 + 1
        breaks = np.concatenate(([-1], np.flatnonzero(back > reach), [n]))
        wide = np.flatnonzero(np.diff(breaks) - 1 >= least_length(least) - least)
        firsts = np.searchsorted(owner, owner[breaks[wide] + 1])  # where their texts start
        found += zip(np.maximum(firsts, breaks[wide] + 1 - reach).tolist(), breaks[wide + 1].tolist(), strict=True)
        reach *= 2
    low = high = -1
    for a, b in sorted(found):
        if a > high or owner[a] != owner[low]:
            if high > low:
                yield low, high
            low, high = a, b
        else:
            high = max(high, b)
    if high > low:
        yield low, high


def find_runs(codes: np.ndarray, owner: np.ndarray, n_texts: int) -> list[list[Run]]:
    """The runs of each text by start, then period; starts count from the text's first word."""
    found: list[set[Run]] = [set() for _ in range(n_texts)]
    for low, high in stretches(codes, owner):
        text = int(owner[low])
        first, end = np.searchsorted(owner, [text, text + 1])
        found[text] |= runs_between(codes[first:end].tolist(), int(low - first), int(high - first))
    return [sorted(x, key=lambda run: (run[0], run[2])) for x in found]


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and the number of the text of each; null is an empty text."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if not len(texts):
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    lists = pc.split_pattern(pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(_SPACED[data])), " ")
    offsets = np.asarray(lists.offsets).astype(np.int64)
    flat = lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    kept = np.asarray(pc.binary_length(flat)) > 0
    return flat.filter(pa.array(kept)), np.repeat(np.arange(len(texts)), np.diff(offsets))[kept]


def periodic(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word stands at each of n places as the contract changes some texts; null where it leaves them."""
    mark = 0 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if doc_id is None or mark % 10 or not n:
        return None
    start = mark // 10 % n
    period = 1 + (n - start) // (3 + mark // 10 % 8)
    places = np.arange(n)
    places[start:] = start + (places[start:] - start) % period
    return places


def _joined(words: pa.Array, counts: np.ndarray) -> pa.Array:
    """The words of each text joined by one space."""
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words), " ")


def _analysed(texts: pa.Array, ids: list | None = None) -> tuple[list[list[Run]], pa.Array]:
    """The runs of each text and its words without repetitions of periods; with `ids` the texts are changed by `periodic` first."""
    words, owner = cut(texts)
    counts = np.bincount(owner, minlength=len(texts))
    if ids is not None:
        firsts, places = np.cumsum(counts) - counts, np.arange(len(words))
        for k, doc_id in enumerate(ids):
            if (moved := periodic(doc_id, int(counts[k]))) is not None:
                places[firsts[k] : firsts[k] + counts[k]] = firsts[k] + moved
        words = words.take(pa.array(places))
    codes = words.dictionary_encode().indices.to_numpy().astype(np.int64) if len(words) else np.zeros(0, np.int64)
    found = find_runs(codes, owner, len(texts))
    kept, firsts = np.ones(len(words), bool), np.cumsum(counts) - counts
    for first, runs in zip(firsts, found, strict=True):
        for start, length, period in runs:
            kept[first + start + period : first + start + length] = False
    if not kept.all():
        words, counts = words.filter(pa.array(kept)), np.bincount(owner[kept], minlength=len(texts))
    return found, _joined(words, counts)


def collapse_runs(df: DataFrame) -> DataFrame:
    """df with `runs`, an array of (start, length, period) by start and period, and `collapsed`, the text without what
    repeats a run's first period, its words joined by one space.

    Null text has null for both; a text without words has no runs and an empty string. Columns of these names are
    replaced, others pass through; repeated rows repeat.
    """
    kept = [c for c in df.columns if c not in ("runs", "collapsed")]
    none = F.lit(None)
    schema = df.select(*(F.col(f"`{c}`") for c in kept), none.cast("array<struct<start:bigint,length:bigint,period:bigint>>").alias("runs"), none.cast("string").alias("collapsed")).schema
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for block in blocks(batch["text"]):
                part = batch.slice(at, len(block))
                at += len(block)
                known = part["text"].is_valid()
                found, texts = _analysed(block)
                runs = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] if k else None for x, k in zip(found, known.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(runs, kind), pc.if_else(known, texts, pa.scalar(None, pa.string()))], names=[*kept, "runs", "collapsed"])

    return df.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(work, schema)


def _digests(runs: list[Run], collapsed: str) -> tuple:
    start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    listed = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
    return len(runs), start, length, period, 1000 * length // period if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed.encode()).hexdigest()


def run_report(df: DataFrame, changed: bool = False) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of every text; with `changed` of
    the texts that the contract makes periodic by their ids first.

    Null text has no words, like an empty one: no runs, nulls for the longest, hashes of nothing. A null doc_id changes
    nothing. Rows neither merge nor vanish; other columns are not looked at. Memory follows the longest text.
    """
    fields = {"n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(), "exponent_milli": pa.int64(), "runs_sha256": pa.string(), "collapsed_sha256": pa.string()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for block in blocks(batch["text"]):
                ids = batch["doc_id"].slice(at, len(block))
                at += len(block)
                found, texts = _analysed(block, ids.to_pylist() if changed else None)
                columns = zip(*(_digests(runs, text) for runs, text in zip(found, texts.to_pylist(), strict=True)), strict=True)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns, fields.values(), strict=True))], names=["doc_id", *fields])

    schema = "doc_id long, " + ", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in fields.items())
    return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, schema)
