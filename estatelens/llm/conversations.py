"""Conversation structure repair on a suffix-shared automaton (operator 13).

A conversation is written as its signature, one sign a turn for the initial of the role and the turn's first fault.
Signatures are read from the end: sorted by their reverse they share every suffix with a neighbour, so each suffix is one
node of the automaton, met once in a range of the sorted signatures. A node holds, for every state of the grammar, the
least cost of repairing what follows and the edit that comes first; the edits of a conversation are read off by walking
from its node to the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatelens.storage import checkpointed

SPACES = " \t\n\x0b\x0c\r"
INITIALS = "sua"
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: What edits cost; a truncated turn that is not deleted adds FAULTY.
REROLE, DELETE, INSERT, FAULTY = 1, 2, 5, 5
#: States of the grammar (s?(ua)+)?: nothing yet, after the system's turn, after the user's, after the assistant's.
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
STATES = (START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT)
NEXT_ROLE = ("user", "user", "assistant", "user")
NEXT_STATE = (AFTER_USER, AFTER_USER, AFTER_ASSISTANT, AFTER_USER)
_FAR = 1 << 60
_LEGAL = {"su", "ua", "au"}
_NO_INITIAL, _OTHER = 4, 3


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy, gone of conversations as the contract damages them.

    A row's damage follows from crc32 of `conv_id:turn`; nulls become one space first (a null conv_id or turn only in what
    is hashed). A repeated row has copies 0 and 1. Dropped rows stay with gone = true, so their conversation is known.
    """
    key = F.concat(*(x for c in ("conv_id", "turn") for x in (F.coalesce(F.col(c).cast("string"), F.lit(" ")), F.lit(":"))))
    kind = F.crc32(F.substring(key, 1, F.length(key) - 1)) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"), (kind == 0).alias("gone"),
    )


def undamaged(conversations: DataFrame) -> DataFrame:
    """conversations in the form that the other functions take, with nulls of role and text as one space."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role, text, F.lit(0).alias("copy"), F.lit(False).alias("gone"))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")


def _schema(df: DataFrame, rest: str) -> str:
    return f"conv_id {df.schema['conv_id'].dataType.simpleString()}, {rest}"


def _batch(rows: list[tuple], fields: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, fields.values(), strict=True)], names=list(fields))


def _described(conv_id: object, signs: bytes, turns: tuple[int, int, int] | None) -> tuple:
    """(conv_id, signature, gaps, blank, duplicate, truncated, illegal); turns: smallest, largest and number of distinct ones."""
    faults = [sum(s & 3 == fault for s in signs) for fault in (BLANK, DUPLICATE, TRUNCATED)]
    heads = [(INITIALS + "??")[s >> 2] for s in signs]
    illegal = sum(a + b not in _LEGAL for a, b in zip(heads, heads[1:], strict=False))
    gaps = 0 if turns is None else min(turns[1] - turns[0] + 1 - turns[2], (1 << 63) - 1)
    return conv_id, "".join(chr(65 + s) for s in signs), gaps, *faults, illegal


def signatures(turns: DataFrame) -> DataFrame:
    """conv_id, signature, gaps, blank, duplicate, truncated, illegal of every conversation of damage() or undamaged().

    Turns stand by turn (null first), then by role, hash of the text and copy. Texts are not shuffled, their hashes are; a
    conversation passes one task as a stream of which a byte a turn is kept, which is what its audit needs as well.
    """
    left = F.rtrim("text", F.lit(SPACES))
    fault = F.when(left == "", BLANK).when(F.right(left, F.lit(1)).isin(".", "!", "?"), NONE).otherwise(TRUNCATED)
    head = F.substring("role", 1, 1)
    initial = F.when(head == "", _NO_INITIAL).when(head == "s", 0).when(head == "u", 1).when(head == "a", 2).otherwise(_OTHER)
    slim = turns.select("conv_id", "turn", "role", _digest(F.col("text")).alias("digest"), "copy", "gone", initial.alias("initial"), fault.alias("fault")).repartition("conv_id")
    # the window's keys begin with conv_id, so it sorts where the rows are; it streams, and spills what a conversation holds
    seen = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "digest").orderBy(F.asc_nulls_first("turn"), "copy")) > 1
    sign = F.when(F.col("gone"), -1).otherwise(F.col("initial") * 4 + F.when((F.col("fault") != BLANK) & seen, DUPLICATE).otherwise(F.col("fault")))
    ordered = slim.withColumn("sign", sign.cast("int")).sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "digest", "copy").select("conv_id", "turn", "sign")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs, span, now, any_row, fields = bytearray(), None, None, False, {}
        for batch in batches:
            fields = {"conv_id": batch.schema.field("conv_id").type, "signature": pa.string(), **dict.fromkeys(COUNTS, pa.int64())}
            made = []
            for conv_id, turn, sign in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "sign")), strict=True):
                if any_row and conv_id != now:
                    made.append(_described(now, signs, span))
                    signs, span = bytearray(), None
                now, any_row = conv_id, True
                if sign >= 0:
                    signs.append(sign)
                    if turn is not None and (span is None or turn != span[1]):
                        span = (turn, turn, 1) if span is None else (span[0], turn, span[2] + 1)
            yield _batch(made, fields)
        if any_row:
            yield _batch([_described(now, signs, span)], fields)

    return ordered.mapInArrow(work, _schema(ordered, "signature string, " + ", ".join(f"{c} long" for c in COUNTS)))


Node = tuple[tuple[int, ...], tuple[tuple[str, int], ...]]


def _with_inserts(costs: list[int], moves: list[tuple[str, int]]) -> Node:
    """The node of these costs and first edits once a turn may be inserted before: of equal costs the edit with the smaller initial."""
    found = list(costs)
    for _ in STATES:
        found = [min(c, INSERT + found[NEXT_STATE[q]]) for q, c in enumerate(found)]
    chosen = [("I", NEXT_STATE[q]) if found[q] == INSERT + found[NEXT_STATE[q]] and (costs[q] != found[q] or moves[q][0] > "I") else moves[q] for q in STATES]
    return tuple(found), tuple(chosen)


#: The node of the empty suffix.
END = _with_inserts([0 if q in (START, AFTER_ASSISTANT) else _FAR for q in STATES], [("", q) for q in STATES])


def _after_keeping(initial: int, state: int) -> int | None:
    """The state after a turn of this initial (place in INITIALS) is kept; null where the grammar doesn't allow it."""
    if initial == _NO_INITIAL:
        return state
    allowed = {(0, START): AFTER_SYSTEM, (2, AFTER_USER): AFTER_ASSISTANT} | {(1, q): AFTER_USER for q in STATES if q != AFTER_USER}
    return allowed.get((initial, state))


@cache  # costs are relative to the smallest, so there are few of them whatever the conversations
def _settled(sign: int, below: tuple[int, ...]) -> Node:
    """The node of a turn before a node with costs `below`: least cost and first edit (its initial, the state after it) by state."""
    initial, fault = sign >> 2, sign & 3
    costs, moves = [], []
    for q in STATES:
        ways = [(DELETE + below[q], "D", q)]
        if fault not in (BLANK, DUPLICATE):
            extra = FAULTY if fault == TRUNCATED else 0
            kept = _after_keeping(initial, q)
            if kept is not None:
                ways.append((extra + below[kept], "K", kept))
            ways.append((REROLE + extra + below[NEXT_STATE[q]], "R", NEXT_STATE[q]))
        cost, edit, after = min(ways)
        costs.append(cost)
        moves.append((edit, after))
    return _with_inserts(costs, moves)


class Suffixes:
    """The nodes from the end of the current signature on; going on to the next one keeps those of the suffix both share."""

    def __init__(self) -> None:
        self.signature, self.nodes, self.bases = "", [END], [0]
        self.n_settled = 0

    def repair(self, reverse: str) -> tuple[int, str]:
        """(cost, audit) of the signature whose reverse is given."""
        shared, most = 0, min(len(reverse), len(self.signature))
        while shared < most and reverse[shared] == self.signature[shared]:
            shared += 1
        del self.nodes[shared + 1 :], self.bases[shared + 1 :]
        for sign in reverse[shared:]:
            costs = self.nodes[-1][0]
            least = min(costs)
            self.bases.append(self.bases[-1] + least)
            self.nodes.append(_settled(ord(sign) - 65, tuple(c - least for c in costs)))
            self.n_settled += 1
        self.signature = reverse
        audit, depth, state = [], len(reverse), START
        while True:
            edit, after = self.nodes[depth][1][state]
            if not edit:
                break
            audit.append(edit)
            depth, state = depth - (edit != "I"), after
        return self.bases[-1] + self.nodes[-1][0][START], "".join(audit)


def audits(signed: DataFrame) -> DataFrame:
    """signatures() with cost and audit in place of the signature.

    Of the cheapest edits the audit is the ASCII-least: D, I, K and R differ, so the first edit decides. Signatures are
    sorted by their reverse over ranges, and within equal ones by conv_id, so that one that a third of all conversations
    have is cut into many ranges; only suffixes at the bounds of ranges are settled twice.
    """
    ranged = checkpointed(signed.withColumn("reverse", F.reverse("signature")).drop("signature")).repartitionByRange("reverse", "conv_id").sortWithinPartitions("reverse", "conv_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffixes, last, found = Suffixes(), None, (0, "")
        for batch in batches:
            made = []
            for reverse in batch["reverse"].to_pylist():
                if reverse != last:
                    last, found = reverse, suffixes.repair(reverse)
                made.append(found)
            costs, texts = zip(*made, strict=True) if made else ((), ())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("conv_id", *COUNTS)), pa.array(costs, pa.int64()), pa.array(texts, pa.string())], names=["conv_id", *COUNTS, "cost", "audit"])

    return ranged.mapInArrow(work, _schema(ranged, ", ".join(f"{c} long" for c in (*COUNTS, "cost")) + ", audit string"))


_AUDIT = (*COUNTS, "cost", "audit")


def _side_by_side(turns: DataFrame, audited: DataFrame) -> DataFrame:
    """Every conversation's audit, then its turns in order: one shuffle of the texts, and no row holds a conversation."""
    nothing = [F.lit(None).cast(audited.schema[c].dataType).alias(c) for c in _AUDIT]
    heads = audited.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).alias("copy"), *_AUDIT)
    both = heads.unionByName(turns.where("not gone").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "copy", *nothing)).repartition("conv_id")
    return both.withColumn("digest", _digest(F.col("text"))).sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "role", "digest", "copy").drop("digest", "copy", "turn")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict | None, list[tuple[str, str, str]]]]:
    """(None, turns of the conversation at hand) and, at the start of each, (its audit row, turns that end the one before);
    a turn is (edit, role, text). Last comes ({}, turns that end the last one)."""
    audit, at, state = "", 0, START
    for batch in batches:
        own = ["conv_id", *_AUDIT]
        heads = iter(batch.filter(pc.equal(batch["kind"], 0)).select(own).to_pylist())
        made: list[tuple[str, str, str]] = []
        for kind, role, text in zip(batch["kind"].to_pylist(), batch["role"].to_pylist(), batch["text"].to_pylist(), strict=True):
            if kind == 0:
                for _ in audit[at:]:
                    made.append(("I", NEXT_ROLE[state], ""))
                    state = NEXT_STATE[state]
                head = next(heads)
                yield head, made
                audit, at, state, made = head["audit"], 0, START, []
                continue
            while audit[at] == "I":
                made.append(("I", NEXT_ROLE[state], ""))
                at, state = at + 1, NEXT_STATE[state]
            edit = audit[at]
            at += 1
            if edit == "K":
                made.append(("K", role, text))
                state = {"s": AFTER_SYSTEM, "u": AFTER_USER, "a": AFTER_ASSISTANT}.get(role[:1], state)
            elif edit == "R":
                made.append(("R", NEXT_ROLE[state], text))
                state = NEXT_STATE[state]
        yield None, made
    yield {}, [("I", NEXT_ROLE[q], "") for q in _inserted(state, len(audit) - at)]


def _noted(batches: Iterator[pa.RecordBatch], fields: dict[str, pa.DataType], kept: list[str], **made: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The batches; into `fields` go the types of their columns `kept` and of those that are made."""
    for batch in batches:
        fields |= {c: batch.schema.field(c).type for c in kept} | made
        yield batch


def _inserted(state: int, n: int) -> Iterator[int]:
    for _ in range(n):
        yield state
        state = NEXT_STATE[state]


def repaired_turns(turns: DataFrame, audited: DataFrame) -> DataFrame:
    """conv_id, position (from 0), edit (K, R or I), role, text of the repaired conversations; empty ones give no row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, position, fields = None, 0, {}
        for head, made in _edited(_noted(batches, fields, ["conv_id"], position=pa.int64(), edit=pa.string(), role=pa.string(), text=pa.string())):
            if made:
                yield _batch([(now, position + k, *turn) for k, turn in enumerate(made)], fields)
            position += len(made)
            if head:
                now, position = head["conv_id"], 0

    both = _side_by_side(turns, audited)
    return both.mapInArrow(work, _schema(both, "position long, edit string, role string, text string"))


def repair_report(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of damage() or undamaged() turns.

    One row a conversation, also for those of which no turn is left: zeros, an empty audit, the hash of nothing. Equal
    turns of a conversation count each; null ids are one conversation. A role without characters has no initial: kept it
    changes no state. Roles with initials but s, u and a can't be kept. Other columns are not looked at.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, text, empty, fields = None, hashlib.sha256(), True, {}
        for following, made in _edited(_noted(batches, fields, ["conv_id", *_AUDIT], repaired_sha256=pa.string())):
            for _, role, content in made:
                text.update(f"{'' if empty else chr(10)}{role}:{content}".encode())
                empty = False
            if following is not None:
                if head is not None:
                    yield _batch([(*head.values(), text.hexdigest())], fields)
                head, text, empty = following, hashlib.sha256(), True

    both = _side_by_side(turns, audits(signatures(turns)))
    return both.mapInArrow(work, _schema(both, ", ".join(f"{c} long" for c in (*COUNTS, "cost")) + ", audit string, repaired_sha256 string"))
