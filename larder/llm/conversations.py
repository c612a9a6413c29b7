"""Conversation structure repair by secondary-sorted streaming.

1. Rows are shuffled by conversation and sorted by (conversation, turn) inside the partitions. Whether a row
   repeats an earlier one is known before: first turns of equal (conversation, role, text) are aggregated with
   map-side combination, and only keys that occur twice join back.
2. `mapInPandas` reads the sorted partition once. For each conversation it carries, across Arrow batches, one
   state for each way a repaired conversation can stand after a row: nothing yet, after the system row, after a
   user row, after an assistant row. A state holds its cost, its rank among the states by edit letters and the
   running hash of its repaired text, so no row is kept. Two paths into a state differ in a letter before either
   ends, so ranks decide ties without looking at the letters again.
3. Per row and state two bytes of backpointer remain. Conversations of at most `BLOCK` rows are traced back at once;
   longer ones emit their backpointers as rows of `BLOCK` entries (spilled through Spark, so a lost executor costs a
   retry, not the result), and a second stream, sorted from the last block back, traces them.

A conversation's rows lie in one task, which reads them in a stream: memory holds a batch, four states and at most
one block. The audit itself has a letter for every edit and is one value of the result.

Null roles and texts are one space, so a null text is blank. Null turns sort first and do not count for gaps; rows of one
turn sort by role and text. A null conversation id is a conversation of its own. Repeated rows are duplicates. An empty
table gives an empty result. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import written

#: Rows whose backpointers one block holds.
BLOCK = 1 << 16
#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: What an inserted or reroled row becomes where a state stands, and the state after it.
NEXT = {START: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
#: A kept row's state after it, by the role's initial.
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
LEGAL = ("su", "ua", "au")
LETTERS = "DKR"
#: Inserted rows that can pay in one place: after a system row a whole exchange may be missing.
MOST_INSERTED = 2

_OUT = (
    "conv_id string, kind int, block long, pointers binary, final int, gaps long, blank long, duplicate long, truncated long, "
    "illegal long, cost long, audit string, repaired_sha256 string"
)


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the damage that crc32 of `conv_id:turn` decides; nulls of role and text are one space."""
    space = F.lit(" ")

    def named(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), space)

    code = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20
    clean = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), code.alias("code"),
    ).filter("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    return clean.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times)).drop("col")


def with_faults(rows: DataFrame) -> DataFrame:
    """Rows with `blank`, `cut` (truncated) and `again`: an equal row of the conversation has an earlier turn.

    Equal rows of the same turn stand next to each other once sorted; the stream sees those by itself.
    """
    rows = rows.select(
        "*",
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"),
        F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("digest"),
    )
    firsts = (
        rows.filter("not blank").groupBy("conv_id", "digest")
        .agg(F.count("*").alias("times"), F.min("turn").alias("first_turn"), F.bool_or(F.col("turn").isNull()).alias("first_null"))
        .filter("times > 1").select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "first_turn", "first_null")
    )
    met = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    later = F.when(F.col("first_null"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("first_turn"))
    return met.select("conv_id", "turn", "role", "text", "blank", "cut", F.coalesce(later, F.lit(False)).alias("again"))


class Stream:
    """The state of one conversation while its rows pass."""

    def __init__(self, conv_id: str | None) -> None:
        self.conv_id = conv_id
        self.states: list[tuple | None] = [(0, 0, hashlib.sha256(), False), None, None, None]  # cost, rank, hash, any row
        self.pointers, self.blocks = bytearray(), 0
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.turns: tuple[int, int, int] | None = None  # first, latest, distinct ones
        self.last: tuple | None = None

    def _reach(self) -> list[tuple]:
        """(cost, rank, inserted, state after them, state before) of every state with up to MOST_INSERTED rows inserted."""
        found = []
        for before, state in enumerate(self.states):
            if state is not None:
                at = before
                for k in range(MOST_INSERTED + 1):
                    found.append((state[0] + k * INSERT, state[1], k, at, before))
                    at = NEXT[at][0]
        return found

    def _hash(self, before: int, inserted: int, add: str | None):
        _, _, digest, some = self.states[before]
        if inserted == 0 and add is None:
            return digest, some
        digest, lines, at = digest.copy(), [], before
        for _ in range(inserted):
            at, name = NEXT[at]
            lines.append(f"{name}:")
        if add is not None:
            lines.append(add)
        digest.update((("\n" if some else "") + "\n".join(lines)).encode("utf-8"))
        return digest, True

    def push(self, turn, role: str, text: str, blank: bool, cut: bool, again: bool) -> bytes | None:
        """Takes the next row; returns a full block of backpointers when there is one."""
        if turn is not None and (self.turns is None or int(turn) != self.turns[1]):
            first, _, distinct = self.turns or (int(turn), 0, 0)
            self.turns = (first, int(turn), distinct + 1)
        again = again or self.last == (turn, role, text)
        if blank:
            self.blank += 1
        elif again:
            self.duplicate += 1
        elif cut:
            self.truncated += 1
        if self.last is not None and self.last[1][:1] + role[:1] not in LEGAL:
            self.illegal += 1
        self.last = (turn, role, text)

        extra = 0 if blank or again or not cut else TRUNCATED
        best: list[tuple | None] = [None] * 4  # cost, (rank, letters), before, inserted, letter
        kept = KEPT.get(role[:1], {})
        for cost, rank, inserted, at, before in self._reach():
            ways = [(at, DELETE, 0)]
            if not blank and not again:
                if at in kept:
                    ways.append((kept[at], extra, 1))
                ways.append((NEXT[at][0], REROLE + extra, 2))
            for after, price, letter in ways:
                way = (cost + price, (rank, "I" * inserted + LETTERS[letter]), before, inserted, letter)
                if best[after] is None or way[:2] < best[after][:2]:
                    best[after] = way
        order = sorted(way[1] for way in best if way)
        states: list[tuple | None] = [None] * 4
        packed = 0
        for after, way in enumerate(best):
            if way:
                cost, key, before, inserted, letter = way
                add = None
                if letter == 1:
                    add = f"{role}:{text}"
                elif letter == 2:
                    add = ("assistant" if after == ASSISTANT else "user") + f":{text}"
                states[after] = (cost, order.index(key), *self._hash(before, inserted, add))
                packed |= (before | inserted << 2 | letter << 4) << (8 * after)
        self.states = states
        self.pointers += packed.to_bytes(4, "little")
        if len(self.pointers) == 4 * BLOCK:
            block, self.pointers, self.blocks = bytes(self.pointers), bytearray(), self.blocks + 1
            return block
        return None

    def gaps(self) -> int:
        first, latest, distinct = self.turns or (1, 0, 0)
        return latest - first + 1 - distinct

    def end(self) -> tuple[int, int, int, str]:
        """(state before the last inserted rows, how many these are, cost, hash) of the cheapest way to end."""
        cost, _, inserted, at, before = min(
            (w for w in self._reach() if w[3] in (START, ASSISTANT)), key=lambda w: (w[0], (w[1], "I" * w[2]))
        )
        return before, inserted, cost, self._hash(before, inserted, None)[0].hexdigest()


def trace(pointers: bytes, after: int) -> tuple[str, int]:
    """(letters, state before the first row) of a block of backpointers, from the state after its last row."""
    letters = []
    for at in range(len(pointers) - 4, -1, -4):
        entry = pointers[at + after]
        letters.append(LETTERS[entry >> 4] + "I" * (entry >> 2 & 3))
        after = entry & 3
    return "".join(letters)[::-1], after


def _repair(frames) -> Iterator:
    import pandas as pd

    names = [x.split()[0] for x in _OUT.split(", ")]
    now: Stream | None = None

    def spilled(stream: Stream, block: bytes) -> list:
        return [stream.conv_id, 1, stream.blocks, block, *[0] * 7, None, None]

    def closed(stream: Stream) -> list[list]:
        before, inserted, cost, digest = stream.end()
        tail, rows, audit = "I" * inserted, [], None
        if stream.blocks:
            stream.blocks += 1
            rows.append(spilled(stream, bytes(stream.pointers)))
            audit = tail
        else:
            audit = trace(stream.pointers, before)[0] + tail
        counts = [stream.gaps(), stream.blank, stream.duplicate, stream.truncated, stream.illegal, cost]
        return [*rows, [stream.conv_id, 2 if stream.blocks else 0, stream.blocks + 1, None, before, *counts, audit, digest]]

    for part in frames:
        out = []
        for conv_id, turn, *row in zip(*(part[c] for c in ("conv_id", "turn", "role", "text", "blank", "cut", "again"))):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    out.extend(closed(now))
                now = Stream(conv_id)
            block = now.push(turn, *row)
            if block:
                out.append(spilled(now, block))
        if out:
            yield pd.DataFrame(out, columns=names)
    if now is not None:
        yield pd.DataFrame(closed(now), columns=names)


def _retrace(frames) -> Iterator:
    """Blocks of giant conversations from the last to the first: each gives its part of the audit."""
    import pandas as pd

    after = 0
    for part in frames:
        out = []
        for conv_id, kind, block, pointers, final, audit in zip(
            part["conv_id"], part["kind"], part["block"], part["pointers"], part["final"], part["audit"]
        ):
            if kind == 2:
                letters, after = audit, int(final)
            else:
                letters, after = trace(pointers, after)
            out.append((conv_id, block, letters))
        yield pd.DataFrame(out, columns=["conv_id", "block", "letters"])


def repair(rows: DataFrame) -> DataFrame:
    """Per conversation of `rows` (conv_id, turn, role, text): gaps, faults, cheapest repair, its audit and hash."""
    sorted_rows = with_faults(rows).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    exact = [F.col(name).cast("string").alias(name) for name in ("conv_id", "turn")]  # pandas has no exact nullable long
    streamed = sorted_rows.select(*exact, "role", "text", "blank", "cut", "again").mapInPandas(_repair, _OUT)
    made = written(streamed.withColumn("conv_id", F.col("conv_id").cast("long")), "conversations")
    giants = made.filter("kind > 0")
    parts = (
        giants.repartition("conv_id").sortWithinPartitions("conv_id", F.col("block").desc())
        .select(F.col("conv_id").cast("string").alias("conv_id"), "kind", "block", "pointers", "final", "audit")
        .mapInPandas(_retrace, "conv_id string, block long, letters string")
        .withColumn("conv_id", F.col("conv_id").cast("long"))
    )
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "letters"))).alias("parts"))
    audits = whole.select(F.col("conv_id").alias("g"), F.concat_ws("", F.col("parts.letters")).alias("traced"))
    ends = made.filter("kind <> 1").drop("kind", "block", "pointers", "final")
    return (
        ends.join(audits, F.col("conv_id").eqNullSafe(F.col("g")), "left").select(
            "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost",
            F.coalesce("traced", "audit").alias("audit"), "repaired_sha256",
        )
    )


def damage_and_repair(rows: DataFrame) -> DataFrame:
    """`repair` of the damaged rows, with a row for every conversation, those that lost all their rows too."""
    repaired = repair(damage(rows))
    every = rows.select(F.col("conv_id").cast("long").alias("id")).distinct()
    counts = [F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(repaired, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
