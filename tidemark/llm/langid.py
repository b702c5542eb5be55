"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the average of the embeddings of its hashed letter pairs and triples,
word ends included. Embeddings and softmax are trained by stochastic gradient
descent in numpy on at most ``sample`` labelled documents, a temperature and a
rejection threshold are fitted on a part that isn't trained on. Because the model
is linear in the average, scoring adds one row of BUCKETS x languages per subword.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fold, lean, texts_of

BUCKETS, DIMS, SAMPLE, EPOCHS, SEED = 4096, 16, 6000, 12, 11
MODULUS, HELD, UNKNOWN = 5, 0, "und"
#: Share of right predictions that the rejection threshold accepts.
ACCEPT = 0.99
BLOCK = 1 << 20


@functools.cache
def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def subwords(text: str) -> tuple[np.ndarray, bool]:
    """Buckets of the letter pairs and triples of a text, and whether it has a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    is_letter = letters()[points]
    if not is_letter.any():
        return np.zeros(0, np.int64), False
    c = np.where(is_letter, points, 32).astype(np.uint64)
    c = np.concatenate([[np.uint64(32)], c[np.concatenate([[True], is_letter[1:] | is_letter[:-1]])], [np.uint64(32)]])
    two = c[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    three = two[:-1] * np.uint64(0x165667B19E3779F9) + c[2:] * np.uint64(0x27D4EB2F165667C5)
    h = np.concatenate([two, three])
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % BUCKETS, True


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # BUCKETS x languages: embeddings times softmax weights
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def probabilities(self, average: np.ndarray) -> np.ndarray:
        z = (average + self.bias) / self.temperature
        e = np.exp(z - z.max(-1, keepdims=True))
        return e / e.sum(-1, keepdims=True)

    def average(self, buckets: np.ndarray) -> np.ndarray:
        return sum(self.table[buckets[at : at + BLOCK]].sum(0) for at in range(0, len(buckets), BLOCK)) / len(buckets)


def fit_model(langs: list[str], counts: np.ndarray, y: np.ndarray, seed: int = SEED) -> Model:
    """counts: documents x BUCKETS shares of each subword."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    cut = len(y) // 8 if len(y) >= 40 else 0
    held, train = order[:cut], order[cut:]
    emb, out, bias = rng.normal(0, 0.1, (BUCKETS, DIMS)), rng.normal(0, 0.1, (DIMS, len(langs))), np.zeros(len(langs))
    rate = 20.0
    for epoch in range(EPOCHS):
        rng.shuffle(train)
        for at in range(0, len(train), 64):
            rows = train[at : at + 64]
            x = counts[rows].astype(np.float64)
            a = x @ emb
            z = a @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            grad_out, grad_emb = a.T @ p, x.T @ (p @ out.T)
            step = rate * (1 - epoch / EPOCHS)
            emb -= step * grad_emb
            out -= 0.05 * step * grad_out
            bias -= 0.05 * step * p.sum(0)
    model = Model(langs, (emb @ out).astype(np.float32), bias)
    if cut:
        z, true = counts[held] @ model.table, y[held]

        def loss(t: float) -> float:
            model.temperature = t
            return float(-np.log(model.probabilities(z)[np.arange(cut), true] + 1e-12).mean())

        model.temperature = float(min(np.geomspace(0.1, 4, 40), key=loss))
        p = model.probabilities(z)
        right = p.max(1)[p.argmax(1) == true]
        model.reject_below = float(np.quantile(right, 1 - ACCEPT)) if len(right) else 0.0
    return model


def fit(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """From at most ``sample`` rows with a language outside the held-out fold; None without any."""
    chosen = (
        docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"))
        .where(F.col("lang").isNotNull() & (fold("id", MODULUS) != HELD))
        .groupBy("id", "lang")
        .agg(F.lit(1).alias("one"))
        .orderBy(F.xxhash64("id"), "id", "lang")
        .limit(sample)
        .select(F.col("id").alias("_id"), F.col("lang").alias("_lang"))
    )
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null")
    rows = rows.join(F.broadcast(chosen), (F.col("id") == F.col("_id")) & (F.col("lang") == F.col("_lang")), "left_semi").groupBy("id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select(F.col("id").cast("string").alias("id"), "text", "lang")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in texts_of(batches):
            found = [subwords(t)[0] for t in texts]
            share = [(np.bincount(b, minlength=BUCKETS) / max(1, len(b))).astype(np.float32).tobytes() for b in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([_sparse(s) for s in share], pa.binary())], ["id", "lang", "x"])

    got = sorted(rows.mapInArrow(lean(features), "id string, lang string, x binary").collect())  # ``sample`` rows of a few KB
    langs = sorted({r[1] for r in got})
    if not langs:
        return None
    counts = np.zeros((len(got), BUCKETS), np.float32)
    for i, r in enumerate(got):
        pairs = np.frombuffer(bytes(r[2]), np.dtype([("at", "<u2"), ("v", "<f4")]))
        counts[i, pairs["at"]] = pairs["v"]
    place = {x: i for i, x in enumerate(langs)}
    return fit_model(langs, counts, np.array([place[r[1]] for r in got]))


def _sparse(share: bytes) -> bytes:
    v = np.frombuffer(share, np.float32)
    out = np.zeros(np.count_nonzero(v), np.dtype([("at", "<u2"), ("v", "<f4")]))
    out["at"], out["v"] = np.flatnonzero(v), v[v != 0]
    return out.tobytes()


def identify(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every row.

    A text that is null or has no letter is ``und`` with score 0 and rejected, as is
    every text if there is nothing to learn from. ``rejected`` marks predictions
    whose calibrated probability is under the threshold that keeps ACCEPT of the right ones. Very long texts
    are taken whole; a null id isn't held out; rows repeated whole get the same result, each its own row. An
    empty table gives an empty result. Further columns, whatever their names, aren't looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, sample, id_col, text_col, lang_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(fold(id_col, MODULUS) == HELD, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch, texts in texts_of(batches):
            langs, scores, rejected = [], [], []
            for text in texts:
                buckets, has_letter = subwords(text)
                if model is None or not has_letter:
                    langs.append(UNKNOWN), scores.append(0.0), rejected.append(True)
                    continue
                p = model.probabilities(model.average(buckets))
                langs.append(model.langs[int(p.argmax())]), scores.append(float(p.max())), rejected.append(float(p.max()) < model.reject_below)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(langs), pa.array(scores, pa.float64()), pa.array(rejected)], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(lean(predict), f"doc_id {rows.dtypes[0][1]}, held_out boolean, lang_pred string, score double, rejected boolean")
