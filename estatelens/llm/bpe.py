"""Byte-level BPE by a hierarchical-bitmap rank queue.

All pre-tokens that a batch of texts needs are laid out in one linked list, separated by a sentinel that never
merges. Every mergeable pair waits in the bucket of its rank; a three-level bitmap over the ranks finds the first
bucket that holds anything, and one step merges that bucket's positions with numpy. Entries whose pair has changed
since they were queued are stale and skipped. The cost of a step follows the bucket, not the pre-token, so very long
pre-tokens are no special case.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

NONE = np.int32(2**31 - 1)
#: Contract: the pre-token pattern of the byte-level vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _known(kind: str) -> set[str]:
    """The characters of a Unicode class as the tokenizer libraries know it; both are of one Unicode version."""
    import tiktoken

    found = tiktoken.Encoding(kind, pat_str=rf"\p{{{kind}}}", mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    return set(found.decode(found.encode_ordinary(_EVERY)))


_EVERY = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))


@cache
def splitter() -> Callable[[str], list[str]]:
    """Finder of the pre-tokens of a text by PATTERN, letters and numbers being those of the libraries' Unicode version and
    not those that a later one has added."""
    pattern = PATTERN
    for kind in "LN":
        newer = sorted(map(ord, set(regex.findall(rf"\p{{{kind}}}", _EVERY)) - _known(kind)))
        firsts = [c for k, c in enumerate(newer) if not k or newer[k - 1] != c - 1]
        lasts = [c for k, c in enumerate(newer) if k + 1 == len(newer) or newer[k + 1] != c + 1]
        if newer:
            out = "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in zip(firsts, lasts, strict=True))
            pattern = pattern.replace(rf"\p{{{kind}}}", rf"[\p{{{kind}}}--[{out}]]")
    return regex.compile(pattern, regex.V1).findall


class RankBitmap:
    """Set of small integers with find-first-set over three levels of 64-bit words."""

    def __init__(self, size: int):
        self.low = [0] * (size // 64 + 1)
        self.mid = [0] * (size // 4096 + 1)
        self.top = 0

    def add(self, n: int) -> None:
        self.low[n >> 6] |= 1 << (n & 63)
        self.mid[n >> 12] |= 1 << (n >> 6 & 63)
        self.top |= 1 << (n >> 12)

    def discard(self, n: int) -> None:
        self.low[n >> 6] &= ~(1 << (n & 63))
        if not self.low[n >> 6]:
            self.mid[n >> 12] &= ~(1 << (n >> 6 & 63))
            if not self.mid[n >> 12]:
                self.top &= ~(1 << (n >> 12))

    def first(self) -> int:
        """Smallest member, -1 if empty."""
        if not self.top:
            return -1
        a = (self.top & -self.top).bit_length() - 1
        b = a << 6 | (self.mid[a] & -self.mid[a]).bit_length() - 1
        return b << 6 | (self.low[b] & -self.low[b]).bit_length() - 1


class MergeTable:
    """Merge ranks of a vocabulary: (left id, right id) -> (rank, merged id)."""

    def __init__(self, vocab: list[bytes], merges: Iterable[tuple[int, int, int, int]]):
        """vocab: bytes of each id; merges: (left, right, rank, merged)."""
        self.vocab = vocab
        self.sentinel = len(vocab)
        rows = np.array(sorted((a * (self.sentinel + 1) + b, r, m) for a, b, r, m in merges), dtype=np.int64)
        self.keys, self.rank_of, merged = rows[:, 0].copy(), rows[:, 1].astype(np.int32), rows[:, 2]
        self.ranks = int(self.rank_of.max()) + 1
        self.merged = np.zeros(self.ranks, dtype=np.int32)
        self.merged[self.rank_of] = merged
        self.byte_id = np.zeros(256, dtype=np.int32)
        for i, token in enumerate(vocab):
            if len(token) == 1:
                self.byte_id[token[0]] = i
        # A rank is plain if its token starts no pair of a lower rank: then all its places may merge in one step.
        made = np.full(self.sentinel + 1, -1, dtype=np.int64)
        made[self.merged] = np.arange(self.ranks)
        left, right = made[self.keys // (self.sentinel + 1)], made[self.keys % (self.sentinel + 1)]
        self.plain = np.ones(self.ranks, dtype=bool)
        for part in (left, right):
            self.plain[part[part > self.rank_of]] = False

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * (self.sentinel + 1) + b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank_of[at], NONE)

    def encode_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words, each merged on its own, end to end, and where each word's ids start (and the last end)."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        starts = np.concatenate(([0], np.cumsum(lengths + 1)))
        total = int(starts[-1])
        token = np.full(total + 1, self.sentinel, dtype=np.int32)
        inside = np.ones(total, dtype=bool)
        inside[starts[1:] - 1] = False
        token[:-1][inside] = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths + 1)
        after = np.arange(1, total + 2, dtype=np.int32)
        after[-1] = total
        before = np.arange(-1, total, dtype=np.int32)
        before[0] = total
        rank = np.append(self.pair_ranks(token[:-1], token[1:]), NONE).astype(np.int32)
        alive = np.append(inside, False)

        queue, buckets = RankBitmap(self.ranks), {}

        def push(places: np.ndarray) -> None:
            places = places[rank[places] != NONE]
            if len(places):
                r = rank[places]
                order = np.argsort(r, kind="stable")
                places, r = places[order], r[order]
                cuts = np.flatnonzero(np.diff(r)) + 1
                for part, n in zip(np.split(places, cuts), r[np.concatenate(([0], cuts))].tolist(), strict=True):
                    if n in buckets:
                        buckets[n].append(part)
                    else:
                        buckets[n] = [part]
                        queue.add(n)

        push(np.arange(total, dtype=np.int32))
        while (n := queue.first()) >= 0:
            queue.discard(n)
            held = buckets.pop(n)
            p = held[0] if len(held) == 1 else np.concatenate(held)
            p = np.sort(p[rank[p] == n])  # the others are stale
            p = p[np.concatenate(([True], p[1:] != p[:-1]))] if len(p) > 1 else p
            if not len(p):
                continue
            if self.plain[n]:  # leftmost first: of a run of overlapping pairs every second one merges
                joined = np.concatenate(([False], after[p[:-1]] == p[1:]))
                if joined.any():
                    order = np.arange(len(p))
                    p = p[(order - np.maximum.accumulate(np.where(joined, 0, order))) % 2 == 0]
            else:  # its token may start a pair of a lower rank, which comes before the next place in that word
                first = np.concatenate(([True], word[p[1:]] != word[p[:-1]]))
                if not first.all():
                    buckets[n] = [p[~first]]
                    queue.add(n)
                    p = p[first]
            gone = after[p]
            then = after[gone]
            token[p] = self.merged[n]
            after[p] = then
            before[then] = p
            rank[gone] = NONE
            alive[gone] = False
            touched = np.concatenate((before[p], p))
            rank[touched] = self.pair_ranks(token[touched], token[after[touched]])
            rank[total] = NONE
            push(touched)
        return token[alive], np.searchsorted(np.flatnonzero(alive), starts)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids))


def from_tiktoken(data: bytes) -> MergeTable:
    """Table of a rank file: two tokens merge if their bytes together are a token; its rank is its id."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    vocab = [b""] * (max(ranks.values()) + 1)
    for token, n in ranks.items():
        vocab[n] = token
    splits = ((ranks.get(t[:i]), ranks.get(t[i:]), n) for t, n in ranks.items() for i in range(1, len(t)))
    return MergeTable(vocab, ((a, b, n, n) for a, b, n in splits if a is not None and b is not None))


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def from_json(data: str) -> tuple[MergeTable, dict[str, int]]:
    """Table of a tokenizer file with explicit merges, and its added tokens."""
    spec, letters = json.loads(data), byte_letters()
    known = spec["model"]["vocab"]
    vocab = [b""] * (max(known.values()) + 1)
    for token, n in known.items():
        vocab[n] = bytes(letters[c] for c in token)
    pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
    table = MergeTable(vocab, ((known[a], known[b], r, known[a + b]) for r, (a, b) in enumerate(pairs)))
    return table, {x["content"]: x["id"] for x in spec.get("added_tokens", [])}


#: White space besides single spaces and line feeds, and places where a space is not between two other characters.
UNEVEN = r"[\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|  | \n|\n |\A | \z"


#: Latin characters but white space and controls; letters and digits among them (fixed by Unicode).
LATIN = r"!-~\x{a1}-\x{24f}"
LETTERS = r"A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}"
DIGITS = r"0-9\x{b2}\x{b3}\x{b9}\x{bc}-\x{be}"


def gather(values: np.ndarray, lengths: np.ndarray, codes: np.ndarray, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The runs of `values` (of the given lengths, end to end unless they have other starts) that the codes name, end to
    end, and their lengths."""
    starts = np.cumsum(lengths) - lengths if starts is None else starts
    taken = lengths[codes]
    ends = np.cumsum(taken)
    return values[np.repeat(starts[codes] - (ends - taken), taken) + np.arange(ends[-1] if len(ends) else 0)], taken


def split_cuts(texts: pa.Array, whole: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """Cut texts at single spaces, those marked `whole` not at all.

    Returns the distinct later cuts, the distinct first cuts (or whole texts), the code of every cut in order (first
    cuts count on after the later ones) and where each text's codes start.
    """
    lists = pc.split_pattern(pc.if_else(whole, "", texts), " ")
    offsets = np.asarray(lists.offsets)[: len(texts) + 1].astype(np.int64)
    cuts = lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    offsets = offsets - offsets[0]
    coded = pc.dictionary_encode(cuts)
    firsts = pc.dictionary_encode(pc.if_else(whole, texts, cuts.take(pa.array(offsets[:-1]))))
    codes = np.array(coded.indices, dtype=np.int64)
    codes[offsets[:-1]] = np.asarray(firsts.indices) + len(coded.dictionary)
    return coded.dictionary, firsts.dictionary, codes, offsets


class PretokenMemo:
    """Values of pre-tokens, kept for the texts that follow.

    A single space between two other characters always starts a pre-token, so texts are cut there first and only the
    distinct cuts of a block are matched against the pattern: those of Latin characters all at once, the others one by
    one. `value` maps the new pre-tokens of a block to their values. The memo holds at most `limit` pre-tokens besides
    those of the block in hand, and starts anew when it is full.
    """

    PLAIN = f"^ ?[{LATIN}]*$"
    #: The pattern for cuts without inner white space, with the classes written out for Latin characters.
    PARTS = f"('s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^ {LETTERS}{DIGITS}]+)"

    def __init__(self, value: Callable[[list[str]], list], limit: int = 300_000):
        self.value, self.limit = value, limit
        self.find = splitter()
        self.held: dict[str, object] = {}

    def values(self, texts: pa.Array) -> tuple[list, np.ndarray, np.ndarray]:
        """Values of the distinct pre-tokens, the code of every pre-token in order, and where each text's codes start."""
        if len(self.held) > self.limit:
            self.held.clear()
        later, firsts, codes, offsets = split_cuts(texts, pc.match_substring_regex(texts, UNEVEN))
        cuts = pa.concat_arrays([pc.binary_join_element_wise(pa.scalar(" "), later, ""), firsts])
        plain = pc.match_substring_regex(cuts, self.PLAIN)
        marked = pc.utf8_rtrim(pc.replace_substring_regex(pc.if_else(plain, cuts, ""), self.PARTS, r"\1" + "\n"), "\n")
        lists = pc.split_pattern(marked, "\n")
        starts = np.array(lists.offsets, dtype=np.int64)[: len(cuts) + 1]
        lengths, starts = np.diff(starts), starts[:-1].copy()
        coded = pc.dictionary_encode(lists.flatten())
        pieces = {p: k for k, p in enumerate(coded.dictionary.to_pylist())}
        parts = [np.asarray(coded.indices)]
        at = len(parts[0])
        for row, cut in zip(np.flatnonzero(~np.asarray(plain)).tolist(), cuts.filter(pc.invert(plain)).to_pylist(), strict=True):
            own = [pieces.setdefault(p, len(pieces)) for p in self.find(cut)]
            starts[row], lengths[row] = at, len(own)
            at += len(own)
            parts.append(own)
        pool = np.concatenate(parts).astype(np.int64)
        new = [p for p in pieces if p not in self.held]
        self.held.update(zip(new, self.value(new), strict=True))
        found, taken = gather(pool, lengths, codes, starts)
        return [self.held[p] for p in pieces], found, np.concatenate(([0], np.cumsum(taken)))[offsets]
