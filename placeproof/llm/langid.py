"""Language ID: averaged hashed subword embeddings with a linear softmax, and rejection calibrated on texts not trained on."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeproof.llm.common import as_bytes
from placeproof.llm.subwords import Model, Scorer, Shape, batches_of, softmax, train, words_of

SHAPE = Shape(shortest=1, longest=4, buckets=1 << 16, dim=16)
SAMPLE, EPOCHS, RATE, SEED = 3000, 4, 0.3, 5
FOLDS, HELD_OUT = 4, 2
LOST = 0.002
LANGUAGES, WINDOW = 200, 20_000
UNKNOWN = "und"


@dataclass(frozen=True)
class Language:
    """The table of n-gram scores has one more column: 1 where training met the n-gram."""

    model: Model
    table: np.ndarray
    temperature: float
    least_score: float
    least_known: float


def fold(id_col: str) -> F.Column:
    return F.crc32(F.col(id_col).cast("long").cast("string")) % FOLDS


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def fit(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Language | None:
    """Learn from at most `sample` texts of known language that aren't held out; a fifth of them only sets temperature and limits.

    Every language gets an equal share of the sample, and what a rare one can't fill goes to the others; beyond the `LANGUAGES` most
    frequent values none is a class. Texts are picked by a hash of the id at rates taken from the counts of all such rows, and of a
    text over `WINDOW` characters a window at a place picked by hash is learned from. The limits are the values under which
    `LOST` of the calibration texts would fall, so clean text is almost never rejected. None if there is nothing to learn.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(lang_col).cast("string").alias("_lang")).where(
        F.col("_lang").isNotNull() & F.col("_text").isNotNull() & (fold("_id") != HELD_OUT))
    counts = rows.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(LANGUAGES).collect()
    quota, left = {}, sample
    for i, r in enumerate(reversed(counts)):
        quota[r["_lang"]] = min(r["count"], max(1, left // (len(counts) - i)))
        left = max(0, left - quota[r["_lang"]])
    rates = docs.sparkSession.createDataFrame([(r["_lang"], min(1.0, 1.3 * quota[r["_lang"]] / r["count"])) for r in counts], "_lang string, _rate double")
    ticket = F.pmod(F.xxhash64("_id", F.lit(SEED)), F.lit(1 << 20)) / (1 << 20)
    begin = F.pmod(F.xxhash64("_id", F.lit(SEED + 1)), F.greatest(F.lit(1), F.length("_text") - WINDOW + 1)).cast("int") + 1
    drawn = rows.join(F.broadcast(rates), "_lang").where(ticket < F.col("_rate")).orderBy(F.xxhash64("_id", F.lit(SEED)), "_id", "_text").limit(2 * sample)
    pairs, got = [], dict.fromkeys(quota, 0)
    for text, lang in drawn.select(F.substring("_text", begin, F.lit(WINDOW)), "_lang").toLocalIterator():
        if got[lang] < quota[lang] and has_letter(text):
            got[lang] += 1
            pairs.append((text, lang))
    if not pairs:
        return None
    labels = sorted({lang for _, lang in pairs})
    number = {lang: i for i, lang in enumerate(labels)}
    checked = pairs[::5] if len(pairs) >= 50 else pairs
    taught = [p for i, p in enumerate(pairs) if i % 5] if len(pairs) >= 50 else pairs
    model = train([t for t, _ in taught], np.array([number[lang] for _, lang in taught]), labels, SHAPE, EPOCHS, RATE, SEED)
    met = np.zeros((SHAPE.buckets, 1), dtype=np.float32)
    for t, _ in taught:
        if words := words_of(t):
            ids = SHAPE.grams(words)[0]
            met[ids[ids >= 0]] = 1
    table = np.hstack([model.gram_scores(), met])
    out = Scorer(SHAPE, table, np.r_[model.bias, np.float32(0)]).logits([t for t, _ in checked])
    target = np.array([number[lang] for _, lang in checked])
    heats = np.geomspace(0.25, 8, 41)
    loss = [-np.log(softmax(out[:, :-1] / h)[np.arange(len(target)), target] + 1e-12).mean() for h in heats]
    heat = float(heats[int(np.argmin(loss))])
    p = softmax(out[:, :-1] / heat).max(axis=1)
    return Language(model, table, heat, min(0.5, float(np.quantile(p, LOST))), 0.9 * float(np.quantile(out[:, -1], LOST)))


def identify(docs: DataFrame, language: Language | None, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row, over its whole text.

    A null text or one without a letter is `und` with score 0 and rejected. Others get the likeliest language; they are rejected
    if its probability or the share of n-grams that training met is under its limit. Without a model all is `und`.
    With carried columns the result is (row, found): two structs, so that no names can clash.
    """
    carry = carry or []
    names = ["doc_id", "held_out", "lang_pred", "score", "rejected"]
    shared = docs.sparkSession.sparkContext.broadcast(language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        scorer = Scorer(known.model.shape, known.table, np.r_[known.model.bias, np.float32(0)]) if known else None
        for batch in batches:
            texts = [t.decode(errors="replace") for t in as_bytes(batch.column(2))]
            lang, value, out = [], [], []
            for part in batches_of(texts):
                found = scorer.logits(part) if known else np.zeros((len(part), 2))
                p = softmax(found[:, :-1] / (known.temperature if known else 1))
                for text, row, share, best in zip(part, p, found[:, -1], p.argmax(axis=1)):
                    if known is None or not has_letter(text):
                        lang.append(UNKNOWN), value.append(0.0), out.append(True)
                    else:
                        top = float(row[best])
                        lang.append(known.model.labels[best]), value.append(top), out.append(top < known.least_score or share < known.least_known)
            columns = [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(value, pa.float64()), pa.array(out, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns[3:]], [*names, *(f"c{i}" for i in range(len(carry)))])
    wide = "".join(f", c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    found = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(fold(id_col) == HELD_OUT, F.lit(False)).alias("held_out"),
        F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]).mapInArrow(
        run, f"doc_id long, held_out boolean, lang_pred string, score double, rejected boolean{wide}")
    if not carry:
        return found
    return found.select(F.struct(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)]).alias("row"), F.struct(*names).alias("found"))
