"""Language identification with string kernels.

The kernel of two texts is the number of n-grams of code points, n from 1 to
4, present in both, over the geometric mean of their own numbers: a blended
spectrum of presences. Landmarks drawn from a bounded training sample give a
Nyström approximation, and one ridge regression per language is solved in it.
The kernel is linear in presences, so landmarks and weights fold into one
matrix, and a batch of texts is scored by one product of its presence matrix
with it. n-grams are known by 18 bits of a hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rule_quality import held_out

ORDERS, BITS = 4, 18
#: Training texts, and landmarks. Every language has an even share of the
#: sample; of more languages than SAMPLE those with most documents are in it.
SAMPLE, LANDMARKS = 1600, 240
#: Bytes of a training text; longer ones are not drawn, so that the driver holds
#: no more than 2 * SAMPLE times as many.
LONGEST = 1 << 16
RIDGE, SHARPNESS = 1e-3, 4.0
#: Texts of a scored batch, and code points hashed at a time.
BATCH, CHUNK = 64, 1 << 20
UNKNOWN = "und"


def ngram_buckets(text: str) -> Iterator[np.ndarray]:
    """The hash buckets of all n-grams of the whole lower-cased text, by chunks."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, len(code), CHUNK):
        part = code[at : at + CHUNK + ORDERS - 1]
        run = np.zeros(len(part), np.uint32)
        for n in range(1, ORDERS + 1):
            run = run[: len(part) - n + 1] * np.uint32(0x01000193) + (part[n - 1 :] + np.uint32(n)) * np.uint32(0x9E3779B1)
            if run.size:
                mixed = run ^ (run >> np.uint32(15))
                yield (mixed * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)


def presence(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), 1 << BITS), np.bool_)
    for row, text in zip(out, texts, strict=True):
        for buckets in ngram_buckets(text):
            row[buckets] = True
    return out


class KernelModel:
    """columns: buckets any landmark has; weights: columns by languages."""

    def __init__(self, languages: list[str], columns: np.ndarray, weights: np.ndarray):
        self.languages, self.columns, self.weights = languages, columns, weights

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        told = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.languages else []
        for at in range(0, len(told), BATCH):
            rows = told[at : at + BATCH]
            seen = presence([texts[i] for i in rows])
            own = np.sqrt(np.maximum(np.count_nonzero(seen, axis=1), 1))[:, None]
            scores = (seen[:, self.columns].astype(np.float32) @ self.weights) / own
            odds = np.exp(SHARPNESS * (scores - scores.max(axis=1, keepdims=True)))
            best = scores.argmax(axis=1)
            for i, b, p in zip(rows, best, odds[np.arange(len(rows)), best] / odds.sum(axis=1), strict=True):
                out[i] = (self.languages[b], float(p))
        return out


def fit_kernel(texts: list[str], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> KernelModel:
    """Deterministic in its input. Landmarks are taken in turn from each
    language, in the order given, one at least."""
    names = sorted(set(languages))
    if not names:
        return KernelModel([], np.empty(0, np.int64), np.empty((0, 0), np.float32))
    turn, seen = [], dict.fromkeys(names, 0)
    for i, name in enumerate(languages):
        turn.append((seen[name], i))
        seen[name] += 1
    marks = [i for _, i in sorted(turn)][: max(landmarks, len(names))]
    base = presence([texts[i] for i in marks])
    columns = np.flatnonzero(base.any(axis=0))
    z = base[:, columns].astype(np.float32)
    z /= np.sqrt(np.maximum(base.sum(axis=1), 1))[:, None]
    k = []
    for at in range(0, len(texts), BATCH):
        part = presence(texts[at : at + BATCH])
        k.append((part[:, columns].astype(np.float32) @ z.T) / np.sqrt(np.maximum(part.sum(axis=1), 1))[:, None])
    knm, kmm = np.concatenate(k).astype(np.float64), (z @ z.T).astype(np.float64)
    target = np.where(np.array(languages)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    weights = np.linalg.solve(knm.T @ knm + ridge * len(texts) * kmm + 1e-8 * np.eye(len(kmm)), knm.T @ target)
    return KernelModel(names, columns, (z.T.astype(np.float64) @ weights).astype(np.float32))


def train(docs: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE) -> KernelModel:
    """Fits on about ``sample`` documents of at most LONGEST bytes for which
    ``learn`` holds: those of a language are drawn by a hash of the id at a rate
    that gives each language an even share, or all that it has."""
    known = docs.where(learn & F.col(lang_col).isNotNull() & (F.octet_length(text_col) <= LONGEST) & F.col(id_col).isNotNull())
    counts = known.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(sample).collect()
    if not counts:
        return fit_kernel([], [])
    each = sample / len(counts)
    draw = F.pmod(F.xxhash64(F.lit(11), id_col), F.lit(1 << 30)) / float(1 << 30)
    rates = F.create_map(*[F.lit(x) for r in counts for x in (r[lang_col], min(1.0, each / r["count"]))])
    rows = known.where(draw < F.coalesce(F.element_at(rates, F.col(lang_col)), F.lit(0.0)))
    rows = rows.select(id_col, lang_col, text_col).orderBy(F.xxhash64(F.lit(11), id_col), id_col, lang_col, text_col).limit(2 * sample).collect()
    rows = [r for r in rows if any(map(str.isalpha, r[text_col]))]
    return fit_kernel([r[text_col] for r in rows], [r[lang_col] for r in rows])


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id_col, held_out, lang_pred, score) for every row of docs.

    Null texts and texts without a letter are ``und`` with score 0, as are all
    if nothing could be learnt. Repeated ids keep a row each. An empty table
    gives an empty result; other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(docs, ~held_out(id_col, 3, 1), id_col, text_col, lang_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = model.value.predict(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col, 3, 1).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)
