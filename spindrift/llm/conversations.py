"""Conversation structure repair: a forward Viterbi pass over four grammar states, conversation by conversation.

A conversation is well formed if the initials of its roles give `(s?(ua)+)?`. The states are what was said last: nothing yet,
system, user, assistant. Each carries the least (cost, audit), an audit being the initials of the edits so far: Keep, Rerole,
Delete, Insert. A turn moves every state by keeping, reroling or deleting it; then up to two insertions close the layer.
An audit tells its own cost and state, so equal costs are settled by the text of the audit at every step.

Turns come sorted within the tasks of a shuffle by conversation and stream through: edits on which all surviving audits
agree are carried out at once, so a task holds only the turns on which they still differ, however long a conversation is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
#: A state this much dearer than another is no part of any cheapest audit: the other can do the same for less, by at most two
#: insertions and a deletion.
BEHIND = 2 * INSERT + DELETE
_BLANK = " \t\n\x0b\x0c\r"
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: States from which a user turn may follow.
_BEFORE_USER = (_START, _SYSTEM, _ASSISTANT)
#: A row of the stream is a mark (this role and text came in an earlier turn), or a turn of the conversation; a conversation
#: that has lost all its turns is known by rows that are neither.
_MARK, _GONE, _TURN = 0, 1, 2
#: Undecided turns from which on a task looks for edits on which all audits agree.
PENDING = 16
#: Turns that a task takes in hand at a time, and rows that it gives out at least.
SLICE, GIVEN = 500, 1_000

Entry = tuple[int, str]


def _least(a: Entry | None, b: Entry | None) -> Entry | None:
    return b if a is None else a if b is None or a <= b else b


def closed(layer: list[Entry | None]) -> list[Entry | None]:
    """The layer with the insertions that pay: a user turn, and an assistant turn after it."""
    user = layer[_USER]
    for state in _BEFORE_USER:
        if layer[state]:
            user = _least(user, (layer[state][0] + INSERT, layer[state][1] + "I"))
    assistant = _least(layer[_ASSISTANT], user and (user[0] + INSERT, user[1] + "I"))
    out = [layer[_START], layer[_SYSTEM], user, assistant]
    bound = min(e[0] for e in out if e) + BEHIND
    return [e if e and e[0] <= bound else None for e in out]


def advanced(layer: list[Entry | None], initial: str, fault: str) -> list[Entry | None]:
    """The layer after a turn with this initial of its role; fault: blank, duplicate, truncated or none."""
    out = [e and (e[0] + DELETE, e[1] + "D") for e in layer]
    if fault in ("blank", "duplicate"):
        return closed(out)
    more = TRUNCATED if fault == "truncated" else 0
    if initial == "s" and layer[_START]:
        out[_SYSTEM] = _least(out[_SYSTEM], (layer[_START][0] + more, layer[_START][1] + "K"))
    for state in _BEFORE_USER:
        if e := layer[state]:
            out[_USER] = _least(out[_USER], (e[0] + more, e[1] + "K") if initial == "u" else (e[0] + more + REROLE, e[1] + "R"))
    if e := layer[_USER]:
        out[_ASSISTANT] = _least(out[_ASSISTANT], (e[0] + more, e[1] + "K") if initial == "a" else (e[0] + more + REROLE, e[1] + "R"))
    return closed(out)


class Repair:
    """One conversation as it streams by. `say(turn, role, text, edit)` is called for each turn of the repaired one, in order."""

    def __init__(self, say: Callable[[int | None, str, str, str], None]):
        self.say = say
        self.layer: list[Entry | None] = closed([(0, ""), None, None, None])
        self.decided: list[str] = []
        self.pending: list[tuple[int | None, str, str]] = []
        self.last = ""
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0, "none": 0}
        self.illegal = 0
        self.before: str | None = None
        self.turns = 0
        self.low = self.high = self.recent = None
        self.look = PENDING

    def turn(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        bare = text.strip(_BLANK)
        fault = "blank" if not bare else "duplicate" if repeated else "truncated" if bare[-1] not in ".!?" else "none"
        self.faults[fault] += 1
        initial = role[:1]
        if self.before is not None and (self.before, initial) not in (("s", "u"), ("u", "a"), ("a", "u")):
            self.illegal += 1
        self.before = initial
        if turn is not None and turn != self.recent:  # turns rise
            self.turns, self.recent, self.high = self.turns + 1, turn, turn
            self.low = turn if self.low is None else self.low
        self.layer = advanced(self.layer, initial, fault)
        self.pending.append((turn, role, text))
        if len(self.pending) >= self.look:
            self._settle()

    def _settle(self) -> None:
        """Carry out the edits with which all surviving audits begin."""
        audits = [e[1] for e in self.layer if e]
        low, high = min(audits), max(audits)
        same = next((i for i, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))
        if same:
            self._carry_out(low[:same])
            self.layer = [e and (e[0], e[1][same:]) for e in self.layer]
        self.look = 2 * len(self.pending) + PENDING  # so that looking costs no more than the turns themselves

    def _carry_out(self, audit: str) -> None:
        at = 0
        for edit in audit:
            turn, role, text = (None, "", "") if edit == "I" else self.pending[at]
            at += edit != "I"
            if edit == "D":
                continue
            if edit != "K":
                role = ROLES["a" if self.last == "u" else "u"]
            self.last = role[0]
            self.say(turn, role, text, edit)
        del self.pending[:at]
        self.decided.append(audit)

    def end(self) -> tuple[int, str]:
        """Cost and audit of the whole."""
        best = _least(self.layer[_START], self.layer[_ASSISTANT])
        self._carry_out(best[1])
        return best[0], "".join(self.decided)

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def _stream(rows: DataFrame) -> DataFrame:
    """Columns conv_id, turn, kind, role, text, copies: whole conversations within tasks, in order, marks before the turns."""
    # Whoever comes after the first turn of a role and text is marked; found on hashes alone.
    narrow = rows.filter("copies > 0").select("conv_id", "turn", "role", F.sha2("text", 256).alias("text"))
    place = F.dense_rank().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    marks = narrow.withColumn("place", place).filter("place > 1").select("conv_id", "turn", F.lit(_MARK).alias("kind"), "role", "text", F.lit(1).alias("copies"))
    turns = rows.select("conv_id", "turn", F.when(F.col("copies") > 0, _TURN).otherwise(_GONE).alias("kind"), "role", "text", F.col("copies").cast("int").alias("copies"))
    return turns.unionByName(marks).repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "kind", "role", "text")


def _repaired(batches: Iterator[pa.RecordBatch], begin: Callable) -> Iterator[tuple | None]:
    """(conversation, its Repair) at the end of each, and None after each slice of turns; begin(conversation): a new Repair."""
    current, repair, marks, at, before = None, None, set(), None, None
    for batch in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
        for conv, turn, kind, role, text, copies in zip(*[c.to_pylist() for c in batch.columns]):
            if repair is None or conv != current:
                if repair is not None:
                    yield current, repair
                current, repair, marks, at, before = conv, begin(conv), set(), None, None
            if turn != at:
                marks, at, before = set(), turn, None
            if kind == _MARK:
                marks.add((role, text))
            elif kind == _TURN:
                known = bool(marks) and (role, hashlib.sha256(text.encode("utf-8")).hexdigest()) in marks
                for _ in range(copies):
                    repair.turn(turn, role, text, known or before == (role, text))
                    before = (role, text)
        yield None
    if repair is not None:
        yield current, repair


def prepared(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies of `rows`; a null role or text is one blank. copies (how often a row stands; 0: it
    only tells that the conversation was there) is 1 where `rows` has no such column."""
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")], copies.cast("int").alias("copies"))


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def audit_conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation of `rows` (conv_id, turn, role, text; other columns are not looked at): its faults, the cheapest
    repair's cost and audit, and the SHA-256 of the repaired turns (`role:text`, joined by line breaks).

    Turns go by number, nulls first; rows of one turn by role and text. Rows without a conv_id are one conversation. Null and
    empty texts are blank; a repeated row is a duplicate; a turn of an empty role can't be kept; texts count whole. An empty table gives an empty one.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def begin(conv: int | None) -> Repair:
            digest, between = hashlib.sha256(), [b""]

            def say(turn: int | None, role: str, text: str, edit: str) -> None:
                digest.update(between[0] + f"{role}:{text}".encode("utf-8"))
                between[0] = b"\n"

            repair = Repair(say)
            repair.digest = digest
            return repair

        def pack() -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.string()] * 2
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [x.split()[0] for x in SUMMARY.split(", ")])
            out.clear()
            return made

        for conv, repair in filter(None, _repaired(batches, begin)):
            cost, audit = repair.end()
            out.append((conv, repair.gaps, repair.faults["blank"], repair.faults["duplicate"], repair.faults["truncated"], repair.illegal, cost, audit, repair.digest.hexdigest()))
            if len(out) >= GIVEN:
                yield pack()
        if out:
            yield pack()

    return _stream(prepared(rows)).mapInArrow(summarise, SUMMARY)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 1), turn (null: inserted), role, text, edit (K, R or I).

    Rows as in `audit_conversations`; a conversation of which nothing is left has no row.
    """

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def begin(conv: int | None) -> Repair:
            place = [0]

            def say(turn: int | None, role: str, text: str, edit: str) -> None:
                place[0] += 1
                out.append((conv, place[0], turn, role, text, edit))

            return Repair(say)

        def pack() -> pa.RecordBatch:
            kinds = [pa.int64()] * 3 + [pa.string()] * 3
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["conv_id", "place", "turn", "role", "text", "edit"])
            out.clear()
            return made

        for found in _repaired(batches, begin):
            if found:
                found[1].end()
            if len(out) >= GIVEN:
                yield pack()
        if out:
            yield pack()

    return _stream(prepared(rows)).mapInArrow(spell, "conv_id long, place long, turn long, role string, text string, edit string")


def damaged(rows: DataFrame) -> DataFrame:
    """`rows` with the faults of a check: by a hash of conversation and turn, of twenty rows one each is dropped (copies 0),
    emptied, robbed of its marks, repeated (copies 2), or made the user's."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    lot = F.crc32(key) % 20
    text, role = F.coalesce(F.col("text"), F.lit(" ")), F.coalesce(F.col("role"), F.lit(" "))
    return rows.select(
        "conv_id", "turn",
        F.when(lot == 4, "user").otherwise(role).alias("role"),
        F.when(lot.isin(0, 1), "").when(lot == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(lot == 0, 0).when(lot == 3, 2).otherwise(1).alias("copies"),
    )


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_conversations(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
