"""Operator 11: counts against plain Python, the label model against plain expectation-maximisation, held-out labels."""

import math
import os
import random
import re

import numpy as np
import pytest
from estatelens.llm import quality as Q
from pyspark.sql import functions as F
from texts import documents, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    text = text or ""
    words = WORD.findall(text)
    lines, seen = 0, set()
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = {k + d for k, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), lines, len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abdeghilmnorst") for _ in range(r.randrange(2, 9))) for _ in range(n)).capitalize() + "."


def made():
    r = random.Random(3)
    out = rows()
    out += [(2000 + k, "\n".join(" ".join(r.choice("a b c d e".split()) for _ in range(r.randrange(5))) for _ in range(20))) for k in range(40)]
    return [*out, (3000, "é ñ\x85x " * 30 + "\n\n\r\n| # <b>"), (3001, "one two three\none two three\n one two three"), (3002, "a b c a b c" + " x y z" * 60)]


def test_counts_equal_plain_python(spark):
    data = made()
    got = Q.judge(documents(spark, data).withColumn("quality", F.lit("other")), Q.START).drop("text", "kept", "quality", "votes_bad", "votes_good").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, *brute(t)) for i, t in data), key=repr)


def test_estimate_equals_plain_em():
    r = np.random.default_rng(2)
    cast = np.unique(r.choice([0, 1, 2], (40, len(Q.RULES)), p=[0.15, 0.25, 0.6]), axis=0)
    n = r.integers(1, 300, len(cast)).astype(float)
    got = Q.estimate(cast, n)
    start = Q.START
    shares, tables = start.shares.tolist(), start.tables.tolist()
    classes, rules = range(len(shares)), range(len(Q.RULES))

    def likely(row):
        odds = [shares[c] * math.prod(tables[j][c][row[j]] for j in rules) for c in classes]
        return [x / sum(odds) for x in odds]

    for _ in range(Q.ROUNDS):
        held = [likely(row) for row in cast.tolist()]
        total = [sum(m * h[c] for m, h in zip(n, held, strict=True)) + Q.WEIGHT * start.shares[c] for c in classes]
        before = shares
        fresh = [[[0, 1, 0] for _ in classes] for _ in rules]
        for j in rules:
            for c in classes:
                bad, good = (sum(m * h[c] for m, h, row in zip(n, held, cast, strict=True) if row[j] == v) + Q.WEIGHT * start.tables[j, c, v] * start.shares[c] for v in (0, 2))
                fresh[j][c] = [bad / (bad + good), 1, good / (bad + good)]
        shares, tables = [x / sum(total) for x in total], fresh
        if max(abs(a - b) for a, b in zip(shares, before, strict=True)) <= Q.SETTLED:
            break
    assert np.allclose(got.shares, shares) and np.allclose(got.tables, tables)
    assert np.allclose(got.posterior(cast), [likely(row)[0] for row in cast.tolist()])


def test_model_keeps_prose_and_drops_junk(spark):
    good = [(k, "\n".join(prose(100 * k + j, 12) for j in range(8))) for k in range(120)]
    symbols = [(1000 + k, re.sub(" ", "### ", prose(k, 90))) for k in range(12)]
    listed = [(2000 + k, re.sub(" ", " | ", prose(k, 90))) for k in range(12)]
    loud = [(3000 + k, re.sub(" ", "!! ", prose(k, 90)).upper()) for k in range(12)]
    model = Q.fit(documents(spark, good + symbols + listed + loud).repartition(3))
    kept = {r["doc_id"] for r in Q.judge(documents(spark, good + symbols + listed + loud), model).where("kept").collect()}
    assert kept == {k for k, _ in good}
    assert min(model.accuracies().values()) > 0.8


def test_no_documents(spark):
    model = Q.fit(documents(spark, []))
    assert np.allclose(model.tables, Q.estimate(np.zeros((0, len(Q.RULES)), int), np.zeros(0)).tables)
    assert not Q.judge(documents(spark, []), model).collect()
    assert not any(r["kept"] for r in Q.judge(documents(spark, [(1, None), (1, None), (None, "")]), model).collect())


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="needs the test tables")
def test_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    judged = Q.judge(docs, Q.fit(docs)).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").drop("toxic").withColumnRenamed("quality", "good"), "doc_id")
    n = judged.agg(F.expr("count_if(good = 1 and not base_failed and kept)"), F.expr("count_if(good = 1 and not base_failed)"), F.expr("count_if(good = 0 and not kept)"), F.expr("count_if(good = 0)")).first()
    assert n[0] >= 0.99 * n[1] and n[2] >= 0.95 * n[3]
