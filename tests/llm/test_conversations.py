import hashlib
import itertools
import random
import re

import duckdb
import pytest
from zlib import crc32

from larder.llm import conversations as cv
from larder.llm.queries import OP12_SQL, op12_conversation_repair


def damaged_plainly(rows):
    kept = []
    for conv, turn, role, text in rows:
        code = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code == 1:
            text = ""
        if code == 2:
            text = re.sub("[.!?]", "", text)
        if code == 4:
            role = "user"
        if code:
            kept += [(conv, turn, role, text)] * (2 if code == 3 else 1)
    return sorted(kept, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def repaired_plainly(rows):
    """Every choice of edits for a few rows, up to two inserted rows in each place."""
    seen, faults = set(), []
    for _, _, role, text in rows:
        if not re.search(r"[^\x20\x09-\x0D]", text):
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("" if re.sub(r"[\x20\x09-\x0D]", "", text)[-1] in ".!?" else "truncated")
        seen.add((role, text))
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = [()] + [(a,) for a in ("user", "assistant")] + list(itertools.product(("user", "assistant"), repeat=2))
    found = [(0, "", ())]
    for (_, _, role, text), fault in zip(rows, faults):
        step = []
        for (cost, audit, out), gap in itertools.product(found, gaps):
            here = cost + 3 * len(gap), audit + "I" * len(gap), out + tuple((g, "") for g in gap)
            step.append((here[0] + 4, here[1] + "D", here[2]))
            if fault not in ("blank", "duplicate"):
                more = here[0] + (3 if fault == "truncated" else 0)
                step.append((more, here[1] + "K", here[2] + ((role, text),)))
                step += [(more + 3, here[1] + "R", here[2] + ((r, text),)) for r in ("user", "assistant")]
        found = [x for x in step if re.fullmatch("(s?(ua)*u?)?", "".join(r[:1] or "-" for r, _ in x[2]))]
    found = [(c + 3 * len(g), a + "I" * len(g), o + tuple((r, "") for r in g)) for (c, a, o), g in itertools.product(found, gaps)]
    cost, audit, out = min((x for x in found if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in x[2]))), key=lambda x: x[:2])
    turns = [r[1] for r in rows if r[1] is not None]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
        hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
    )


def made(seed, conversations, most):
    rng, rows = random.Random(seed), []
    for conv in range(conversations):
        for turn in range(rng.randint(1, most)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "cut off", " \t", "", None, "Why? ", "Well.\n", "é…"])
            rows.append((conv, rng.choice([turn, turn, turn * 2, None, 1 << 60]), role, text))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def result(frame):
    names = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    return {r[0]: tuple(r[1:]) for r in frame.select(*names).collect()}


def test_every_choice_of_edits(spark):
    rows = made(3, 300, 3) + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (None, None, None, None)]
    got = result(cv.damage_and_repair(spark.createDataFrame(rows, SCHEMA)))
    want = {}
    for conv in {r[0] for r in rows}:
        want[conv] = repaired_plainly(damaged_plainly([r for r in rows if r[0] == conv]))
    assert got == want


@pytest.mark.parametrize("seed", [1, 2])
def test_sql_on_longer_conversations(spark, seed):
    rows = made(seed, 120, 14)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = {r[0]: tuple(r[1:]) for r in con.execute(OP12_SQL).fetchall()}
    assert result(cv.damage_and_repair(spark.createDataFrame(rows, SCHEMA))) == want


def test_giant_conversations_spill_their_backpointers(spark, monkeypatch):
    rows = made(5, 40, 30)
    frame = spark.createDataFrame(rows, SCHEMA)
    want = result(cv.damage_and_repair(frame))
    monkeypatch.setattr(cv, "BLOCK", 4)
    assert result(cv.damage_and_repair(frame)) == want


def test_state_crosses_batches_and_memory_is_bounded():
    """One conversation of 200,000 rows: nothing but states and one block stays."""
    stream, sent = cv.Stream("1"), 0
    for k in range(200_000):
        sent += len(stream.push(str(k), ("user", "assistant")[k % 2], f"Text {k}.", False, False, False) or b"")
        assert len(stream.pointers) < 4 * cv.BLOCK
    assert sent == 4 * cv.BLOCK * (200_000 // cv.BLOCK) and stream.end()[2] == 0


def test_edges(spark):
    names = "text string, conv_id long, cost string, turn long, role string, code string, audit long"
    empty = spark.createDataFrame([], names)
    assert cv.damage_and_repair(empty).collect() == []
    long = "word " * 400_000 + "end."
    rows = [(long, 7, "x", 2, "user", "y", 1), (long, 7, "x", 2, "user", "y", 1), ("Fine.", 7, "x", 3, "assistant", "z", 2)]
    assert result(cv.damage_and_repair(spark.createDataFrame(rows, names)))[7] == repaired_plainly(
        damaged_plainly([(7, 2, "user", long), (7, 2, "user", long), (7, 3, "assistant", "Fine.")])
    )


def test_query(spark):
    got = op12_conversation_repair(spark, "/root/testdata/sf0.01")
    assert got.count() == 100 and got.filter("cost > 0").count() > 20
