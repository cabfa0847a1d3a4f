"""Operator 12 against a search of all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
from estatelens.llm import runs as R
from pyspark.sql import functions as F
from texts import documents, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """All runs by start, then period: for every period the stretches of equal words that far apart, unless a smaller period has them."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        at = 0
        while at + q < n:
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end - at + q
            if end > at and length >= max(6, 4 * q) and not any(all(words[k] == words[k + p] for k in range(at, at + length - p)) for p in range(1, q)):
                found.append((at, length, q))
            at = max(end, at + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def report(doc_id, text):
    words = WORD.findall(text or "")
    mark = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and mark % 10 == 0 and words:
        n, g = len(words), mark // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    milli = None if top[0] is None else 1000 * top[1] // top[2]
    listed = "".join("%d,%d,%d\n" % r for r in found)
    return doc_id, len(found), *top, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest()


def made(seed, n):
    """Texts of few words with repeated passages."""
    r = random.Random(seed)
    out = []
    for k in range(n):
        words = []
        while len(words) < r.randrange(1, 200):
            part = [r.choice("abc" if r.random() < 0.5 else "abcdefghijklmnop") for _ in range(r.randrange(1, 12))]
            words += (part * r.randrange(1, 9))[: r.randrange(1, 60)]
        out.append((1000 + k, r.choice((" ", "\n", "\t ")).join(words)))
    return out


def test_report_equals_search(spark):
    data = rows() + made(1, 250) + [(5000 + k, "w " * k) for k in range(12)] + [(6000, "a b c " * 300 + "x y " * 5), (6001, "a b c d " * 4), (6001, "a b c d " * 4), (6002, "a b c d " * 3 + "a b c")]
    got = R.run_report(documents(spark, data).withColumn("start", F.lit("other")), changed=True).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((report(*x) for x in data), key=repr)
    assert not R.run_report(documents(spark, []), changed=True).collect()


def test_stretches_hold_all_runs_of_many_texts():
    r = np.random.default_rng(4)
    for _ in range(60):
        counts = r.integers(0, 120, 6)
        parts = [np.tile(r.integers(0, r.integers(1, 9), max(1, n // r.integers(1, 12))), n)[:n] for n in counts]
        found = R.find_runs(np.concatenate(parts).astype(np.int64), np.repeat(np.arange(6), counts), 6)
        assert found == [brute(x.tolist()) for x in parts]


def test_segments_are_last_occurrences():
    r = random.Random(8)
    for _ in range(30):
        words = [r.randrange(3) for _ in range(80)]
        tree = R.LastOccurrences()
        for i, w in enumerate(words):
            got = tree.append(w)
            wanted = {}
            for n in range(1, i + 1):
                suffix = words[i + 1 - n : i + 1]
                last = max((e for e in range(n - 1, i) if words[e + 1 - n : e + 1] == suffix), default=None)
                if last is not None:
                    wanted[last] = n
            best = {}
            for last, n in got:
                best[last] = max(n, best.get(last, 0))
            assert best == wanted


def test_collapsed_texts_keep_rows_and_columns(spark):
    data = [(1, "go go go go go go on"), (2, None), (3, ""), (1, "go go go go go go on"), (4, " one  two ")]
    df = documents(spark, data).select("doc_id", "text", F.lit(1).alias("n_runs"), F.lit("old").alias("runs"))
    got = sorted(map(tuple, R.collapse_runs(df).select("doc_id", "collapsed", "n_runs", F.to_json("runs")).collect()), key=repr)
    run = '[{"start":0,"length":6,"period":1}]'
    assert got == sorted([(1, "go on", 1, run), (1, "go on", 1, run), (2, None, 1, None), (3, "", 1, "[]"), (4, "one two", 1, "[]")], key=repr)
