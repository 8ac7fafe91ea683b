"""Conversation repair against every possible list of edits, on random and odd conversations."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from placeproof.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, digest string, plan int"
FORM = re.compile(r"(s?(ua)+)?\Z")


def cheapest(rows):
    """Least (cost, audit, lines) over all edits, with up to two insertions before every row and at the end. Rows: (role, text, fault)."""
    best = None
    inserts = [()] + [(a,) for a in ("user", "assistant")] + list(itertools.product(("user", "assistant"), repeat=2))
    edits = [("D",) if fault in ("blank", "duplicate") else ("D", "K", "Ruser", "Rassistant") for _, _, fault in rows]
    for chosen in itertools.product(*edits):
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            cost, audit, lines, form = 0, "", [], ""
            for gap, edit, row in itertools.zip_longest(gaps, chosen, rows):
                for role in gap:
                    cost, audit, form = cost + 2, audit + "I", form + role[0]
                    lines.append(f"{role}:")
                if edit is None:
                    continue
                audit += edit[0]
                if edit == "D":
                    cost += 3
                    continue
                role = row[0] if edit == "K" else edit[1:]
                cost += (2 if edit[0] == "R" else 0) + (row[2] == "truncated")
                form += role[:1] or "?"
                lines.append(f"{role}:{row[1]}")
            if FORM.match(form) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, lines)
    return best


def brute(rows):
    out = {}
    for conv in dict.fromkeys(r[0] for r in rows):
        turns = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            if draw:
                text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
                turns += [(turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(t[2].encode()).digest()))
        faults, seen = [], set()
        for _, role, text in turns:
            ink = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else None)
            seen.add((role, text))
        numbers = [t[0] for t in turns if t[0] is not None]
        starts = [t[1][:1] for t in turns]
        cost, audit, lines = cheapest([(role, text, fault) for (_, role, text), fault in zip(turns, faults)])
        out[conv] = (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(starts, starts[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def result(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    found = repair.audited(df)
    return {r[0]: tuple(r)[1:] for r in found.collect()}


def test_random_conversations(spark):
    rng = random.Random(1)
    words = ["Yes.", "No", "Well!", "", "  \t", "x?  ", "more text"]
    rows = []
    for conv in range(250):
        for turn in range(rng.randint(1, 3)):
            rows.append((conv, turn * rng.choice([1, 1, 2]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool"]), rng.choice(words)))
    assert result(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None, "user", "A."), (1, None, "user", "A."), (1, 3, None, None), (None, 1, "user", "Q."), (None, None, "assistant", None), (2, 5, "", "text."),
            (2, 5, "", "text."), (2, 5, "user", "b."), (3, -4, "unknown", "long " * 50000 + "."), (3, 9, "a", "\x0b\x1f\n"), (4, 1, "system", "only."), (5, 0, "Ünter", "ü.")]
    gone = next(i for i in range(10, 500) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    twice = next(i for i in range(10, 500) if zlib.crc32(f"{i}:0".encode()) % 20 == 3)
    rows += [(gone, 0, "user", "x."), (twice, 0, "user", "x."), (twice, 1, "assistant", "y.")]
    got = result(spark, rows)
    assert got == brute(rows)
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_no_rows(spark):
    assert result(spark, [(1, 1, "user", "x.")][:0]) == {}


@pytest.mark.parametrize("seed", range(3))
def test_blocks_change_nothing(seed):
    rng = random.Random(seed)
    for _ in range(300):
        codes = bytes(rng.choice([0, 1, 2, 3, 2, 3]) | rng.choice([0, 0, 0, 4, 8]) for _ in range(rng.randint(0, 12)))
        assert repair.solve(codes, 1) == repair.solve(codes, 3) == repair.solve(codes, 100)
    long = bytes(rng.choice([1, 2, 3, 2, 3]) | rng.choice([0, 0, 4, 8]) for _ in range(5000))
    assert repair.solve(long, 64) == repair.solve(long, 256)


def test_repaired_turns(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "Hi."), (1, 1, "user", ""), (1, 2, "user", "Well"), (2, 0, "user", "x.")], "conv_id long, turn long, role string, text string")
    got = sorted(tuple(r) for r in repair.repaired(df, repair.decisions(df)).collect())
    assert [(r[0], r[1], r[2], r[4], r[5]) for r in got] == [
        (1, 1, "I", "user", ""), (1, 2, "K", "assistant", "Hi."), (2, 1, "K", "user", "x."), (2, 2, "I", "assistant", "")]
