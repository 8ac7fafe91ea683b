"""Conversation structure repair: the cheapest edits that give every conversation the form system?, (user, assistant)+.

A directed graph without cycles has a node for each row and state of the form; its edges keep, rerole or delete the row or insert an
empty turn before it. The weight of a path is one integer: its high digits are the cost, its low digits the edits' letters at
fixed positions, three bits each, with zeros behind the last one. Cheapest edits, then the letters least in ASCII order, are
then the plain minimum of integers, worked out from the last row backwards.

A conversation is cut into blocks of `BLOCK` rows, so integers stay short: what the rest costs from each state is worked out first,
backwards over the blocks, and a block's own minimum starts from those costs. That is exact, as an insertion between two blocks
belongs to the second, so that no path through a block is the beginning of another one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeproof.llm.common import stored

BLOCK = 256
SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
LETTERS = {"0": "", "1": "D", "2": "I", "3": "K", "4": "R"}
DIGITS = {letter: int(digit) for digit, letter in LETTERS.items() if letter}
# States: nothing yet, after system, after user, after assistant. A row's class: 0 other, 1 system, 2 user, 3 assistant.
AFTER = ({1: 1, 2: 2}, {2: 2}, {3: 3}, {2: 2})
NEXT = (2, 2, 3, 2)
ROLES = {2: b"user", 3: b"assistant"}
ENDS = (0, 3)
NEVER = 1 << 40
MUST_GO, CUT_SHORT = 4, 8


def backward(codes: bytes, rest: list[int], digits: int) -> list[int]:
    """Least weight from every state before the first row, if `rest` holds those after the last row; letters take `digits` places."""
    width = 3 * digits
    mask, top = (1 << width) - 1, max(0, width - 3)

    def put(letter: str, cost: int, weight: int) -> int:
        low = (DIGITS[letter] << top | (weight & mask) >> 3) if width else 0
        return ((weight >> width) + cost) << width | low

    def inserted(edits: list[int]) -> list[int]:
        once = [min(edits[s], put("I", INSERT, edits[NEXT[s]])) for s in range(4)]
        return [min(edits[s], put("I", INSERT, once[NEXT[s]])) for s in range(4)]
    now = rest
    for code in reversed(codes):
        late = TRUNCATED if code & CUT_SHORT else 0
        edits = []
        for s in range(4):
            best = put("D", DELETE, now[s])
            if not code & MUST_GO:
                if code & 3 in AFTER[s]:
                    best = min(best, put("K", KEEP + late, now[AFTER[s][code & 3]]))
                best = min(best, put("R", REROLE + late, now[NEXT[s]]))
            edits.append(best)
        now = inserted(edits)
    return now


def at_end() -> list[int]:
    """Costs after the last row: nothing in a final state, else the turns that are still wanted."""
    plain = [0 if s in ENDS else NEVER for s in range(4)]
    once = [min(plain[s], INSERT + plain[NEXT[s]]) for s in range(4)]
    return [min(plain[s], INSERT + once[NEXT[s]]) for s in range(4)]


def tail(state: int) -> str:
    """The insertions that end a conversation in this state."""
    return "" if state in ENDS else "I" + tail(NEXT[state])


def walk(letters: str, codes: bytes, state: int) -> int:
    """The state after these edits of these rows."""
    row = 0
    for letter in letters:
        if letter in "IR":
            state = NEXT[state]
        elif letter == "K":
            state = AFTER[state][codes[row] & 3]
        row += letter != "I"
    return state


def solve(codes: bytes, block: int = BLOCK) -> tuple[int, str]:
    """(cost, audit) of a conversation's rows: a byte a row with its role's class and what is wrong with it."""
    blocks = [codes[i:i + block] for i in range(0, len(codes), block)]
    rests = [at_end()]
    for part in reversed(blocks[1:]):
        rests.append(backward(part, rests[-1], 0))
    cost, state, audit = None, 0, []
    for part, rest in zip(blocks, reversed(rests)):
        digits = 3 * len(part)
        weight = backward(part, [w << 3 * digits for w in rest], digits)[state]
        cost = weight >> 3 * digits if cost is None else cost
        letters = "".join(LETTERS[d] for d in f"{weight & ((1 << 3 * digits) - 1):0{digits}o}")
        state = walk(letters, part, state)
        audit.append(letters)
    return cost or 0, "".join(audit) + tail(state)


def damage(rows: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) with faults put in by a checksum of conversation and turn; nulls become one space."""
    draw = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    text, role = F.coalesce(F.col("text").cast("string"), F.lit(" ")), F.coalesce(F.col("role").cast("string"), F.lit(" "))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), draw.alias("draw")).where(
        "draw <> 0").select(
        "conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(1), F.when(F.col("draw") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def _ordered(rows: DataFrame, first: list[str] | None = None) -> DataFrame:
    """Conversations whole in a partition and in order; memory use doesn't grow with them, as rows are streamed."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *(first or []), "turn", "role", "digest")


def _faults(turns: DataFrame) -> DataFrame:
    """Narrow rows: place in the order, class of the role, and each row's first fault, but for copies in the same turn."""
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    narrow = turns.select(
        "conv_id", "turn", "role", "digest", code.alias("code"), (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    # Only what occurs in several turns is looked up; where that is much, the join is by sorted keys and a hot one is split.
    again = narrow.groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first"), F.count("*").alias("n")).where("n > 1").select(
        F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    same: Column = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    later = F.coalesce(F.struct(F.col("turn").isNotNull(), F.col("turn")) > F.col("first"), F.lit(False))
    return narrow.join(again, same, "left").select("conv_id", "turn", "role", "digest", "code", "blank", "truncated", later.alias("later"))


DECISIONS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
LEGAL = {(1, 2), (2, 3), (3, 2)}


class Conversation:
    """What is held of a conversation while its rows go by: a byte a row, and counts."""

    def __init__(self, key: int | None):
        self.key, self.codes, self.last = key, bytearray(), None
        self.counts = dict.fromkeys(["blank", "duplicate", "truncated", "illegal", "turns"], 0)
        self.least = self.most = None

    def add(self, turn: int | None, role: str, digest: bytes, code: int, blank: bool, truncated: bool, later: bool) -> None:
        here = (turn, role, digest)
        repeated = later or here == self.last
        fault = "blank" if blank else "duplicate" if repeated else "truncated" if truncated else None
        if fault:
            self.counts[fault] += 1
        if self.codes and (self.codes[-1] & 3, code) not in LEGAL:
            self.counts["illegal"] += 1
        if turn is not None and turn != self.most:
            self.counts["turns"] += 1
            self.least = turn if self.least is None else self.least
            self.most = turn
        self.codes.append(code | (MUST_GO if blank or repeated else CUT_SHORT if fault else 0))
        self.last = here

    def decided(self) -> tuple:
        cost, audit = solve(bytes(self.codes))
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.counts["turns"]
        return (self.key, gaps, *[self.counts[c] for c in ("blank", "duplicate", "truncated", "illegal")], cost, audit)


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string())])
    now: Conversation | None = None
    for batch in batches:
        done = []
        for key, *row in zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)]):
            if now is None or now.key != key:
                if now:
                    done.append(now.decided())
                now = Conversation(key)
            now.add(*row)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)] if done else [pa.array([], f.type) for f in schema], schema=schema)
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(now.decided(), schema)], schema=schema)


def prepared(turns: DataFrame) -> DataFrame:
    """Turns with their texts' digest, which orders rows of one turn and role; null roles and texts become one space."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))


def decisions(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) for every conversation with at least one row.

    Rows are taken by turn (nulls first), then role, then the digest of the text, so ties and repeated rows have a defined order;
    rows with a null conv_id are one conversation. Texts don't travel here.
    """
    return _ordered(_faults(turns if "digest" in turns.columns else prepared(turns))).mapInArrow(_decide, DECISIONS)


def _replayed(turns: DataFrame, decided: DataFrame, begin: Callable, edit: Callable, end: Callable, schema: str) -> DataFrame:
    """Every conversation's edits replayed on its whole texts as they stream by; the decision comes before the rows."""
    names = [f.split()[0] for f in DECISIONS.split(", ")]
    stream = turns.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", "text", F.lit(None).cast(f"struct<{DECISIONS.replace(' ', ':').replace(',:', ',')}>").alias("plan")).unionByName(
        decided.select("conv_id", F.lit(0).alias("kind"), F.struct(*names).alias("plan")), allowMissingColumns=True)
    columns = [c.strip().split()[0] for c in schema.split(",")]
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    arrow = pa.schema([(c.strip().split()[0], types[c.strip().split()[1]]) for c in schema.split(",")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, at, audit, live, out = 0, 0, "", None, []

        def step(role: str | None, text: bytes, turn: int | None) -> None:
            """One letter: an insertion has no row."""
            nonlocal state, at
            letter, at = audit[at], at + 1
            if letter in "IR":
                state = NEXT[state]
                name = ROLES[state]
            elif letter == "K":
                name = role.encode()
                state = AFTER[state][{"s": 1, "u": 2, "a": 3}[role[0]]]
            else:
                name = b""
            edit(live, out, letter, name, text, turn)

        def close() -> None:
            while at < len(audit):
                step(None, b"", None)
            if live is not None:
                end(live, out)
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            for i, (kind, turn, role) in enumerate(zip(batch.column("kind").to_pylist(), batch.column("turn").to_pylist(), batch.column("role").to_pylist())):
                if kind == 0:
                    close()
                    plan = batch.column("plan")[i].as_py()
                    state, at, audit, live = 0, 0, plan["audit"], begin(plan)
                    continue
                while audit[at] == "I":
                    step(None, b"", None)
                step(role, texts[i].as_py(), turn)
                if len(out) >= 2048:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)
                    out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)
    return _ordered(stream, ["kind"]).mapInArrow(run, ", ".join(f"{c} {t.strip().split()[1]}" for c, t in zip(columns, schema.split(","))))


def repaired(turns: DataFrame, decided: DataFrame) -> DataFrame:
    """(conv_id, position, edit, turn, role, text): the turns of every repaired conversation in order, inserted ones with an empty text."""
    def begin(plan: dict) -> list:
        return [plan["conv_id"], 0]

    def edit(live: list, out: list, letter: str, role: bytes, text: bytes, turn: int | None) -> None:
        if letter != "D":
            live[1] += 1
            out.append((live[0], live[1], letter, turn, role.decode(), text.decode()))
    return _replayed(prepared(turns), decided, begin, edit, lambda live, out: None, "conv_id long, position long, edit string, turn long, role string, text string")


def structure(turns: DataFrame) -> DataFrame:
    """The decisions and `repaired_sha256`, the digest of the repaired `role:text` lines, for every conversation with a row.

    A digest is one value over a whole conversation, so one task reads its texts; it holds a batch of rows and the edits only.
    """
    rows = prepared(turns)
    decided = stored(decisions(rows), "repair")

    def begin(plan: dict) -> list:
        return [plan, hashlib.sha256(), True]

    def edit(live: list, out: list, letter: str, role: bytes, text: bytes, turn: int | None) -> None:
        if letter != "D":
            live[1].update((b"" if live[2] else b"\n") + role + b":")
            live[1].update(text)
            live[2] = False

    def end(live: list, out: list) -> None:
        out.append((*live[0].values(), live[1].hexdigest()))
    return _replayed(rows, decided, begin, edit, end, f"{DECISIONS}, repaired_sha256 string")


def audited(rows: DataFrame) -> DataFrame:
    """The structure of damaged conversations, with zeros, an empty audit and an empty text's digest where no row is left.

    Null ids, turns, roles and texts, repeated rows and other columns are fine; no rows give no rows.
    """
    found = structure(damage(rows))
    names = [f.split()[0] for f in DECISIONS.split(", ")[1:]]
    every = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    mine = found.select(F.col("conv_id").alias("_conv"), *names, "repaired_sha256")
    none = {**dict.fromkeys(names[:-1], F.lit(0).cast("long")), "audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    return every.join(mine, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select("conv_id", *[F.coalesce(F.col(c), v).alias(c) for c, v in none.items()])


def oracle() -> str:
    """The same in SQL: damage, faults, and a recursion from the last row with (cost and letters, lines) for every state."""
    def put(letter: str, cost: str, value: str, line: str = "[]") -> str:
        return f"struct_pack(w := lpad(CAST(CAST({value}.w[1:9] AS INTEGER) + {cost} AS VARCHAR), 9, '0') || '{letter}' || {value}.w[10:], t := list_concat(CAST({line} AS VARCHAR[]), {value}.t))"
    after, name = {0: {1: 1, 2: 2}, 1: {2: 2}, 2: {3: 3}, 3: {2: 2}}, {2: "user", 3: "assistant"}

    def gaps(edits: str, out: str) -> str:
        return ", ".join(f"least({edits}{s}, {put('I', '2', f'{edits}{(2, 2, 3, 2)[s]}' if out == 'g' else f'g{(2, 2, 3, 2)[s]}', repr([name[(2, 2, 3, 2)[s]] + ':']))}) AS {out}{s}" for s in range(4))
    edits = []
    for s in range(4):
        to = (2, 2, 3, 2)[s]
        cases = " ".join(f"WHEN r.code = {c} THEN {put('K', 'r.late', f'f.v{t}', '[r.role || chr(58) || r.text]')}" for c, t in after[s].items())
        rerole = put("R", "2 + r.late", f"f.v{to}", f"['{name[to]}:' || r.text]")
        edits.append(f"CASE WHEN r.gone THEN {put('D', '3', f'f.v{s}')} ELSE least({put('D', '3', f'f.v{s}')}, {rerole}, CASE {cases} ELSE {rerole} END) END AS e{s}")
    ends = ", ".join(f"struct_pack(w := '{'000000000' if s in (0, 3) else '900000000'}', t := CAST([] AS VARCHAR[])) AS e{s}" for s in range(4))
    return f"""WITH RECURSIVE k AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
  flatten(list_transform(range(1, len(key) + 1), lambda i: [CAST(ascii(substr(key, CAST(i AS INTEGER), 1)) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
  lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295) % 20 AS draw FROM k),
d AS (SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role, CASE draw WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(range(CASE draw WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c WHERE draw <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS cut FROM d),
r AS MATERIALIZED (SELECT *, CASE WHEN cut = '' THEN 1 WHEN seen > 1 THEN 2 WHEN right(cut, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
  CASE left(role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 0 END AS code, fault IN (1, 2) AS gone, CASE fault WHEN 3 THEN 1 ELSE 0 END AS late,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM o),
b AS (SELECT DISTINCT conv_id, n FROM r),
f AS (SELECT conv_id, n + 1 AS i, h0 AS v0, h1 AS v1, h2 AS v2, h3 AS v3 FROM (SELECT *, {gaps('e', 'h')} FROM (SELECT *, {gaps('e', 'g')} FROM (SELECT conv_id, n, {ends} FROM b)))
  UNION ALL
  SELECT conv_id, i, h0, h1, h2, h3 FROM (SELECT *, {gaps('e', 'h')} FROM (SELECT *, {gaps('e', 'g')} FROM (
    SELECT r.conv_id, r.i, {', '.join(edits)} FROM f JOIN r ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.i = f.i - 1)))),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
  count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(v0.w[1:9], '0') AS BIGINT) AS cost, coalesce(v0.w[10:], '') AS audit, sha256(coalesce(array_to_string(v0.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM a.conv_id AND f.i = 1"""
