"""Licence scans by template markup (operator 4).

A template is licence wording with `<<beginOptional>> ... <<endOptional>>` around what may be missing and
`<<var;match="a b|c">>` (one of these wordings) or `<<var;match=".{0,5}">>` (so many words of any kind) where the
wording is free. It is compiled to an automaton over words; a text holds the licence where the automaton accepts, so
all mandatory wording has to be there exactly, word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.llm.common import UPPER, WORD, count_words, spaced_words
from estatelens.llm.encoding import blocks
from estatelens.llm.license_texts import TEMPLATES

#: Contract: phrases and the labels they give (fixed values).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

_words = re.compile(WORD).findall
_lower = str.maketrans(UPPER, UPPER.lower())
_MARKUP = re.compile(r'<<(beginOptional|endOptional|var;match="([^"]*)")>>')


def words(text: str) -> list[str]:
    return _words(text.translate(_lower))


@dataclass
class Automaton:
    """States 0 (start) to n (accepting) with word steps, steps on any word, and free steps."""

    label: str
    steps: list[dict[str, list[int]]] = field(default_factory=lambda: [{}])
    wild: list[list[int]] = field(default_factory=lambda: [[]])
    free: list[list[int]] = field(default_factory=lambda: [[]])
    closed: list[frozenset[int]] = field(default_factory=list)
    #: The longest mandatory word; texts without it can't match.
    key: str = ""

    def state(self) -> int:
        for part in (self.steps, self.wild, self.free):
            part.append({} if part is self.steps else [])
        return len(self.steps) - 1

    def line(self, at: int, sequence: list[str]) -> int:
        for word in sequence:
            new = self.state()
            self.steps[at].setdefault(word, []).append(new)
            at = new
        return at

    def finish(self) -> None:
        self.accept = len(self.steps) - 1
        for s in range(len(self.steps)):
            seen, todo = {s}, [s]
            while todo:
                for t in self.free[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            self.closed.append(frozenset(seen))
        self.first = {w for s in self.closed[0] for w in self.steps[s]}
        if any(self.wild[s] for s in self.closed[0]) or self.accept in self.closed[0]:
            raise ValueError(f"template {self.label} must start with wording")

    def longest(self, found: list[str], start: int) -> int:
        """Where the longest accepted run of words from `start` ends, -1 if there is none."""
        states, best = self.closed[0], -1
        for at in range(start, len(found)):
            word = found[at]
            after = {t for s in states for n in (*self.steps[s].get(word, ()), *self.wild[s]) for t in self.closed[n]}
            if not after:
                break
            states = after
            if self.accept in states:
                best = at + 1
        return best


def compile_template(label: str, markup: str) -> Automaton:
    """The automaton of a template. Raises ValueError for markup that does not balance or that it does not know, and for
    a template without mandatory wording or that may start with any word."""
    if "<<" in _MARKUP.sub("", markup) or ">>" in _MARKUP.sub("", markup):
        raise ValueError(f"template {label} has unknown markup")
    auto, at, opened, mandatory, last = Automaton(label), 0, [], [], 0

    def wording(text: str) -> int:
        """Literal wording; inside an option `a|b` stands for either."""
        if not opened or "|" not in text:
            if not opened:
                mandatory.extend(words(text))
            return auto.line(at, words(text))
        end = auto.state()
        for choice in text.split("|"):
            auto.free[auto.line(at, words(choice))].append(end)
        return end

    for mark in _MARKUP.finditer(markup):
        at = wording(markup[last : mark.start()])
        last = mark.end()
        if mark[1] == "beginOptional":
            opened.append(at)
        elif mark[1] == "endOptional":
            if not opened:
                raise ValueError(f"template {label} closes an option that is not open")
            end = auto.state()
            auto.free[at].append(end)
            auto.free[opened.pop()].append(end)
            at = end
        elif bounds := re.fullmatch(r"\.\{(\d+),(\d+)\}", mark[2]):
            end = None
            stops = []
            for n in range(int(bounds[2]) + 1):
                if n >= int(bounds[1]):
                    stops.append(at)
                if n < int(bounds[2]):
                    new = auto.state()
                    auto.wild[at].append(new)
                    at = new
            end = auto.state()
            for s in stops:
                auto.free[s].append(end)
            at = end
        else:
            end = auto.state()
            for choice in mark[2].split("|"):
                auto.free[auto.line(at, words(choice))].append(end)
            at = end
    at = wording(markup[last:])
    if opened or not mandatory:
        raise ValueError(f"template {label} leaves an option open" if opened else f"template {label} has no mandatory wording")
    end = auto.state()
    auto.free[at].append(end)
    auto.key = max(mandatory, key=len)
    auto.finish()
    return auto


class Scanner:
    def __init__(self, templates: list[tuple[str, str]]):
        self.automata = [compile_template(label, markup) for label, markup in templates]
        self.phrases = [(phrase.split(" "), label) for phrase, label in PHRASES.items()]

    def candidates(self, spaced: pa.Array) -> np.ndarray:
        """Places of the texts (from spaced_words) that hold all words of a phrase or the longest mandatory word of a template."""
        wanted = [phrase for phrase, _ in self.phrases] + [[key] for key in sorted({auto.key for auto in self.automata})]
        held = {w: np.asarray(pc.match_substring(spaced, w)) for w in {w for each in wanted for w in each}}
        return np.flatnonzero(np.any([np.all([held[w] for w in each], axis=0) for each in wanted], axis=0))

    def scan(self, text: str) -> dict:
        """What is found in one text; A-Z count as lower case."""
        lowered = text.translate(_lower)
        found = _words(lowered)
        starts, base, labels, covered = [], set(), set(), np.zeros(len(found), dtype=bool)
        for phrase, label in self.phrases:
            if not all(w in lowered for w in phrase):
                continue
            for i in range(len(found) - len(phrase) + 1):
                if found[i] == phrase[0] and found[i : i + len(phrase)] == phrase:
                    starts.append(i)
                    base.add(label)
                    covered[i : i + len(phrase)] = True
        matches = []
        for auto in self.automata:
            if auto.key not in lowered:
                continue
            at = 0
            while at < len(found):
                end = auto.longest(found, at) if found[at] in auto.first else -1
                if end > 0:
                    labels.add(auto.label)
                    covered[at:end] = True
                    matches.append({"label": auto.label, "start": at, "end": end})
                at = max(end, at + 1)
        return {
            "n_words": len(found), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | labels)),
            "score": round(int(covered.sum()) / len(found), 9) if found else 0.0, "matches": matches,
        }


NOTHING = {"n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0, "matches": []}
FIELDS = [("n_words", "long", pa.int64()), ("n_base", "long", pa.int64()), ("first_word", "long", pa.int64()), ("last_word", "long", pa.int64()), ("base_labels", "string", pa.string()), ("labels", "string", pa.string()), ("score", "double", pa.float64()), ("matches", "array<struct<label:string,start:long,end:long>>", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))]


def scan_licenses(df: DataFrame, templates: list[tuple[str, str]] | None = None, text: str = "text") -> DataFrame:
    """Add what phrases and templates find in every text.

    n_words; n_base, first_word, last_word and base_labels of the fixed phrases; `labels` with the templates' labels as
    well; `matches` (label, start, end in words) of the templates, leftmost and longest, not overlapping within one
    template; `score`, the share of the words that any of these cover. Null and wordless texts give zeros, empty
    labels and null places. Columns of these names are replaced; other columns and repeated rows pass through.
    """
    new = [n for n, _, _ in FIELDS]
    kept = [c for c in df.columns if c not in new]
    schema = df.select(*kept, *(F.lit(None).cast(t).alias(n) for n, t, _ in FIELDS)).schema
    given = TEMPLATES if templates is None else templates

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(given)
        for batch in batches:
            at = 0
            for block in blocks(batch[text].cast(pa.string())):
                spaced = spaced_words(block)
                rows = [{**NOTHING, "n_words": n} for n in count_words(spaced).tolist()]
                for k in scanner.candidates(spaced).tolist():
                    rows[k] = scanner.scan(block[k].as_py())
                part = batch.slice(at, len(block))
                at += len(block)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array([r[n] for r in rows], t) for n, _, t in FIELDS)], names=[*kept, *new])

    return df.select(*kept).mapInArrow(work, schema)
