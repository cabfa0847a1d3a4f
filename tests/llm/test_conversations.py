"""Operator 13 against a shortest-path search over edits."""

import hashlib
import heapq
import random
import re
import zlib

from estatelens.llm import conversations as C

VALID = re.compile(r"(s?(ua)+)?")
LETTERS = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    """{conv_id: [(turn, role, text)]} in order, damaged as the contract says."""
    out = {}
    for conv_id, turn, role, text in rows:
        kept = out.setdefault(conv_id, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            kept += [row] * (2 if kind == 3 else 1)
    for kept in out.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    return out


def prefixes(initials):
    """Whether initials can still become a valid sequence, as its state: the valid ones are short to try."""
    return any(VALID.fullmatch(initials + tail) for tail in ("", "a", "ua"))


def brute(turns):
    faults, seen = [], set()
    for _, role, text in turns:
        marks = LETTERS.findall(text)
        faults.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, at, initials, made = heapq.heappop(heap)
        if at == len(turns) and VALID.fullmatch(initials):
            break
        state = (at, initials[-2:] if len(initials) > 1 else initials, len(initials) % 2 if "s" in initials else 2)
        if (state, initials[:1] == "s") in done:
            continue
        done.add((state, initials[:1] == "s"))
        ways = [(5, "I", 0, r, "") for r in ("user", "assistant")]
        if at < len(turns):
            _, role, text = turns[at]
            ways.append((2, "D", 1, None, None))
            if faults[at] not in ("blank", "duplicate"):
                more = 5 if faults[at] == "truncated" else 0
                ways.append((more, "K", 1, role, text))
                ways += [(1 + more, "R", 1, r, text) for r in ("user", "assistant")]
        for price, edit, step, role, text in ways:
            longer = initials if role is None else initials + role[:1]
            if prefixes(longer):
                heapq.heappush(heap, (cost + price, audit + edit, at + step, longer, made if role is None else (*made, f"{role}:{text}")))
    known = {t[0] for t in turns if t[0] is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()


TEXTS = ["A word.", "A word", "Why?", "no end", " \t\n", "", None, "Yes!\n", "x.\x1c", "é…", "A word."]


def rows(n=300, seed=3):
    r = random.Random(seed)
    made = []
    for conv in range(n):
        for turn in range(r.randrange(9)):
            role = r.choice(("user", "assistant")) if r.random() < 0.4 else ("user", "assistant")[turn % 2]
            role = r.choice(("system", "tool", None, "", "s", "User")) if r.random() < 0.15 else role
            made.append((conv, None if r.random() < 0.05 else turn * r.choice((1, 1, 1, 2)), role, r.choice(TEXTS) if r.random() < 0.5 else f"turn {turn} of {conv}."))
    made += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Hello."), (None, None, None, None), (7, 0, "user", "again."), (7, 0, "user", "again.")]
    made += [(9001, -(2**63), "user", "far."), (9001, 2**63 - 1, "assistant", "away.")]
    return made


def frame(spark, data):
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string")


def test_repair_equals_search(spark):
    data = rows()
    found = {r[0]: tuple(r)[1:] for r in C.repair_report(C.damage(frame(spark, data).repartition(5))).collect()}
    wanted = {c: brute(t) for c, t in damaged(data).items()}
    wanted[9001] = (min(wanted[9001][0], 2**63 - 1), *wanted[9001][1:])
    assert found == wanted


def test_long_conversation_and_equal_conversations(spark):
    r = random.Random(5)
    long = [(1, k, r.choice(("user", "assistant", "assistant", "system")), r.choice(("done.", "cut", f"new {k}.", f"new {k}"))) for k in range(3000)]
    copies = [(c, k, ("user", "assistant")[k % 2], f"{k}?") for c in range(100, 400) for k in range(4)]
    got = {x[0]: tuple(x)[1:] for x in C.repair_report(C.damage(frame(spark, long + copies))).collect()}
    kept = damaged(long + copies)
    assert set(got) == set(kept)
    assert all(got[c] == brute(kept[c]) for c in range(100, 400))
    assert VALID.fullmatch("".join(t["role"][0] for t in C.repaired_turns(C.damage(frame(spark, long)), C.audits(C.signatures(C.damage(frame(spark, long))))).orderBy("position").collect()))


def test_repaired_turns_without_damage(spark):
    data = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hi."), (1, 2, "user", "Are you there?"), (1, 3, "assistant", "Yes."), (2, 0, "assistant", "So."), (3, 0, "user", ""), (4, 0, "user", "cut")]
    turns = C.undamaged(frame(spark, data).withColumn("gone", C.F.lit("other")).withColumn("copy", C.F.lit(5)))
    audited = C.audits(C.signatures(turns))
    assert {r["conv_id"]: (r["cost"], r["audit"]) for r in audited.collect()} == {1: (2, "KDKK"), 2: (2, "D"), 3: (2, "D"), 4: (2, "D")}
    made = [tuple(r) for r in C.repaired_turns(turns, audited).orderBy("conv_id", "position").collect()]
    assert made == [(1, 0, "K", "system", "Be brief."), (1, 1, "K", "user", "Are you there?"), (1, 2, "K", "assistant", "Yes.")]


def test_no_conversations_and_text_ids(spark):
    assert not C.repair_report(C.damage(frame(spark, []))).collect()
    made = C.repair_report(C.damage(spark.createDataFrame([("a", 0, "user", "Hi."), ("b", 0, "user", "Ho.")], "conv_id string, turn int, role string, text string"))).collect()
    assert {r["conv_id"] for r in made} == {"a", "b"}


def test_suffixes_are_settled_once():
    suffixes = C.Suffixes()
    words = ["".join(p) for p in sorted({"EIEI", "AEIEI", "IEI", "MEIEI", "EI"}, key=lambda x: x[::-1])]
    for w in words:
        suffixes.repair(w[::-1])
    assert suffixes.n_settled == len({w[k:] for w in words for k in range(len(w))})
