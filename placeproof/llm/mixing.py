"""Mixing sources to target weights: token weights raked to source, language and topic marginals, then calibrated sampling.

Iterative proportional fitting works on a table of cells, one for each combination of named target values. Values that a
target doesn't name share the bucket `*`, so the caller's targets bound the number of cells whatever the data hold.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeproof.llm.common import stored

ROUNDS, REST, PLACES = 30, "*", 9

# Production targets of the registered query: shares of tokens; what is not named shares the rest.
TARGETS = {
    "source": {"src0": 0.10, REST: 0.90},
    "lang": {"en": 0.50, "de": 0.20, "fr": 0.18, "es": 0.10, REST: 0.02},
    "topic": {"prose": 0.62, "table": 0.12, "marked": 0.06, "shout": 0.06, "line": 0.14},
}
# The topic of the registered query is the form of the text: the first mark that occurs anywhere in it decides.
TOPICS = {"table": "instr(text, '|') > 0", "marked": "instr(text, '***') > 0", "shout": "instr(text, '!!') > 0", "prose": "instr(text, chr(10)) > 0"}
TOPIC_SQL = "CASE " + " ".join(f"WHEN {test} THEN '{name}'" for name, test in TOPICS.items()) + " ELSE 'line' END"


def rake(tokens: np.ndarray, targets: list[np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
    """Cell weights with sum 1 and the wanted marginals, as near to `tokens` as their support allows.

    A target value without tokens can't be met; the others of its marginal share its part in proportion.
    """
    weights = tokens / tokens.sum()
    wanted = []
    for axis, target in enumerate(targets):
        there = tokens.sum(axis=tuple(a for a in range(tokens.ndim) if a != axis)) > 0
        kept = np.where(there, target, 0.0)
        wanted.append(kept / kept.sum() if kept.sum() > 0 else there / there.sum())
    for _ in range(rounds):
        for axis, target in enumerate(wanted):
            others = tuple(a for a in range(tokens.ndim) if a != axis)
            now = weights.sum(axis=others, keepdims=True)
            shape = [-1 if a == axis else 1 for a in range(tokens.ndim)]
            weights = weights * np.divide(target.reshape(shape), now, out=np.zeros_like(now), where=now > 0)
    return weights


def calibrate(tokens: np.ndarray, weights: np.ndarray, budget: float) -> np.ndarray:
    """A probability for each cell, min(1, t * weight / tokens), with t such that `budget` tokens are expected."""
    some = np.flatnonzero((tokens > 0) & (weights > 0))
    out = np.zeros(len(tokens))
    if not len(some):
        return out
    ratio = weights[some] / tokens[some]
    order = some[np.argsort(-ratio, kind="stable")]
    t, w = tokens[order], weights[order]
    full = np.r_[0.0, np.cumsum(t)[:-1]]
    rest = w[::-1].cumsum()[::-1]
    scale = (budget - full) / rest
    fits = np.flatnonzero(scale * w / t <= 1)
    if not len(fits):
        out[order] = 1.0
        return out
    k = fits[0]
    out[order] = np.where(np.arange(len(order)) < k, 1.0, scale[k] * w / t)
    return out


def lumped(value: Column, target: dict[str, float]) -> Column:
    named = [v for v in target if v != REST]
    return F.when(value.isin(*named), value).otherwise(F.lit(REST)) if named else F.lit(REST)


def mix(
    docs: DataFrame, dimensions: dict[str, Column], targets: dict[str, dict[str, float]], tokens: Column, share: float, seed: str = "mix",
    id_col: str = "doc_id", rounds: int = ROUNDS,
) -> DataFrame:
    """(doc_id, the dimensions, n_tokens, weight, probability, kept) for every row.

    weight is the row's part of the raked token weights, probability that of being kept, kept whether the ticket drawn from
    a digest of id and seed is below it. Null dimensions count with `*`; a null id draws the ticket of the text "null"; equal ids
    draw equal tickets. Rows without tokens weigh nothing and are kept with the probability of their cell. With `share` 1 or
    more every row of a wanted cell is kept. An empty table gives an empty result.
    """
    names = list(targets)
    rows = stored(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), *[dimensions[n].cast("string").alias(n) for n in names], F.coalesce(tokens, F.lit(0)).cast("long").alias("n_tokens")), "mixing")
    keys = [f"_{n}" for n in names]
    keyed = rows.select("*", *[lumped(F.col(n), targets[n]).alias(k) for n, k in zip(names, keys)])
    counts = {tuple(r[:-1]): r[-1] for r in keyed.groupBy(*keys).agg(F.sum("n_tokens")).collect()}
    values = [list(dict.fromkeys([*targets[n], REST])) for n in names]
    cells = list(itertools.product(*values))
    amount = np.array([float(counts.get(c, 0)) for c in cells])
    if amount.sum() > 0:
        weights = rake(amount.reshape([len(v) for v in values]), [np.array([targets[n].get(v, 0.0) for v in vs]) for n, vs in zip(names, values)], rounds).ravel()
        chance = calibrate(amount, weights, share * amount.sum())
    else:
        weights, chance = np.zeros(len(cells)), np.full(len(cells), min(1.0, share))
    told = docs.sparkSession.createDataFrame(
        [(*c, float(w / a) if a else 0.0, round(float(p), PLACES)) for c, a, w, p in zip(cells, amount, weights, chance)],
        ", ".join(f"{k} string" for k in keys) + ", _each double, probability double")
    ticket = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":" + seed))), 1, 8), 16, 10).cast("double") / (1 << 32)
    return keyed.join(F.broadcast(told), keys).select(
        "doc_id", *names, "n_tokens", (F.col("n_tokens") * F.col("_each")).alias("weight"), "probability", (ticket < F.col("probability")).alias("kept"))


def oracle(table: str, dimensions: dict[str, str], targets: dict[str, dict[str, float]], tokens: str, share: float, seed: str = "mix", rounds: int = ROUNDS) -> str:
    """The same in plain SQL: one common table expression for each fitting step."""
    names = list(targets)
    keys = [f"k_{n}" for n in names]
    lump = lambda n: f"CASE WHEN {n} IN ({', '.join(repr(v) for v in targets[n] if v != REST)}) THEN {n} ELSE '{REST}' END"
    aim = lambda n: f"CASE k_{n} " + " ".join(f"WHEN '{v}' THEN {x}" for v, x in targets[n].items()) + " ELSE 0.0 END"
    parts = [
        f"d AS (SELECT doc_id, {', '.join(f'{e} AS {n}' for n, e in dimensions.items())}, {tokens} AS n_tokens FROM {table})",
        f"k AS (SELECT *, {', '.join(f'{lump(n)} AS k_{n}' for n in names)} FROM d)",
        f"c AS (SELECT {', '.join(keys)}, CAST(sum(n_tokens) AS DOUBLE) AS t, {', '.join(f'CAST({aim(n)} AS DOUBLE) AS a_{n}' for n in names)} FROM k GROUP BY ALL HAVING sum(n_tokens) > 0)",
        *[f"s_{n} AS (SELECT k_{n}, any_value(a_{n}) / sum(any_value(a_{n})) OVER () AS a FROM c GROUP BY k_{n})" for n in names],
        f"r0 AS (SELECT {', '.join('c.' + k for k in keys)}, t, {', '.join(f's_{n}.a AS a_{n}' for n in names)}, t / sum(t) OVER () AS w FROM c {' '.join(f'JOIN s_{n} USING (k_{n})' for n in names)})"]
    carried = ", ".join([*keys, "t", *[f"a_{n}" for n in names]])
    for i, n in enumerate(names * rounds):
        parts.append(f"r{i + 1} AS (SELECT {carried}, w * a_{n} / sum(w) OVER (PARTITION BY k_{n}) AS w FROM r{i})")
    last = f"r{len(names) * rounds}"
    parts += [
        f"o AS (SELECT *, coalesce(sum(t) OVER (ORDER BY w / t DESC, {', '.join(keys)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_t, sum(w) OVER (ORDER BY w / t DESC, {', '.join(keys)} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, row_number() OVER (ORDER BY w / t DESC, {', '.join(keys)}) AS i FROM {last})",
        f"q AS (SELECT *, ({share} * sum(t) OVER () - full_t) / rest AS sc FROM o)",
        "f AS (SELECT arg_min(sc, i) AS sc, min(i) AS i FROM q WHERE sc * w / t <= 1)",
        f"p AS (SELECT {', '.join('q.' + k for k in keys)}, q.w / q.t AS each_w, round(CASE WHEN f.i IS NULL OR q.i < f.i THEN 1.0 ELSE f.sc * q.w / q.t END, {PLACES}) AS probability FROM q CROSS JOIN f)"]
    return ("WITH " + ",\n".join(parts) + f"\nSELECT doc_id, {', '.join(names)}, n_tokens, n_tokens * coalesce(each_w, 0) AS weight, coalesce(probability, 0) AS probability, "
            f"CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':{seed}'), 1, 8) AS BIGINT) / 4294967296.0 < coalesce(probability, 0) AS kept FROM k LEFT JOIN p USING ({', '.join(keys)})")
