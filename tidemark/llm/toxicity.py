"""Toxicity by a noisy-channel reading of disguised words.

A character language model (triples of letters) is counted over all documents.
What is written with digits or signs for letters, drawn out, or spaced letter by
letter becomes a lattice of possible letters; Viterbi decoding under the language
model and the channel's costs restores the text. Plain words have one reading and
need no lattice. Restored texts are scored by a logistic model on hashed words and
word beginnings that tell toxic from other texts among labelled documents.
"""

from __future__ import annotations

import functools
import os
import re
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fold, labelled_sample, lean, texts_of

MODULUS, HELD, THRESHOLD = 4, 2, 0.3
SAMPLE, FEATURES, BUCKETS, SEED = 30_000, 1024, 1 << 22, 5
EPOCHS, PENALTY = 40, 1e-4
#: Least log-likelihood ratio with which a feature is taken up.
LEAST_RATIO = 14.0
PREFIXES = (4, 5, 6)
SYMBOLS = 28  # boundary, a to z, any other letter
CACHE_WORDS = 300_000
#: Runs of a character after which decoding sets aside what is settled.
FLUSH = 64

#: The letters that a sign may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l"}
#: Costs (natural log) of the channel: sign for a letter, sign put in, separator put in, separator as a word's end, letter drawn out, letter doubled.
SIGN, PUT_IN, SEPARATOR, SPACE, DRAWN_OUT, DOUBLED = -1.0, -12.0, -0.5, -3.0, -0.5, -4.0
SPACED = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$!|+€£])(?:[ ._*\-]{1,2}(?:[^\W_]|[@$!|+€£])){3,}(?![^\W_])")
LETTERS = re.compile(r"[^\W\d_]+")
EDGE, TAIL = ".,;:?\"'()[]{}<>#%&*/\\`~^=-_", re.compile(r"(?:!+|[$@+|]{2,})$")
RUN, DRAWN = re.compile(r"(.)\1*", re.S), re.compile(r"(.)\1\1", re.S)


@functools.cache
def symbols() -> np.ndarray:
    """For each code point its symbol."""
    out = np.fromiter((27 if chr(i).isalpha() else 0 for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    out[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return out


def symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


def language_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(triple, n) of all documents' letters; SYMBOLS ** 3 rows at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, table = np.zeros(SYMBOLS**3, np.int64), symbols()
        for _, texts in texts_of(batches):
            joined = "  ".join(texts).lower()
            for at in range(0, len(joined), 1 << 21):
                points = np.frombuffer(joined[max(0, at - 2) : at + (1 << 21)].encode("utf-32-le", "replace"), np.uint32)
                s = table[points].astype(np.int32)
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["triple", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(count), "triple long, n long").groupBy("triple").agg(F.sum("n").alias("n"))


def language_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """log P(third | first, second), smoothed by the pair's frequency."""
    counts = np.zeros(SYMBOLS**3)
    for triple, n in language_counts(docs, text_col).collect():
        counts[triple] = n
    counts = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    pairs = counts.sum(0) + 0.5
    pairs /= pairs.sum(1, keepdims=True)
    return np.log((counts + 5 * pairs[None]) / (counts.sum(2, keepdims=True) + 5))


@functools.lru_cache(maxsize=CACHE_WORDS)
def channel(c: str, n: int) -> tuple[tuple[str, tuple[int, ...], float], ...]:
    """Readings of a run of ``n`` of a character (3 stands for any more), their symbols and costs."""
    if c in LEET:
        out = [(x * k, SIGN * k) for x in LEET[c] for k in ((1,) if n == 1 else (1, 2))] + [("", PUT_IN)]
    elif c.isalpha():
        out = [(c, 0.0)] if n == 1 else [(c + c, 0.0), (c, DOUBLED)] if n == 2 else [(c, DRAWN_OUT), (c + c, DRAWN_OUT)]
    else:
        out = [("", SEPARATOR), (" ", SPACE)]
    return tuple((x, tuple(map(symbol, x)), cost) for x, cost in out)


def lattice(text: str) -> Iterator[tuple[tuple[str, tuple[int, ...], float], ...]]:
    """For each run of a character its readings."""
    for m in RUN.finditer(text):
        yield channel(m[1], min(m.end() - m.start(), 3))
    yield ((" ", (0,), 0.0),)


def decode(text: str, model: np.ndarray | list) -> str:
    """The likeliest reading (Viterbi over the last two symbols; ties go to the greater text).

    ``text`` may be of any length: every FLUSH runs, what all states have in common is set aside,
    which leaves their order as it is.
    """
    states, settled = {(0, 0): (0.0, "")}, []
    for i, readings in enumerate(lattice(text), 1):
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, so_far) in states.items():
            for letters, codes, cost in readings:
                x, y, s = a, b, score + cost
                for z in codes:
                    s += model[x][y][z]
                    x, y = y, z
                best = after.get((x, y))
                if best is None or s > best[0] or s == best[0] and so_far + letters > best[1]:
                    after[x, y] = (s, so_far + letters)
        states = after
        if not i % FLUSH:
            common = os.path.commonprefix([t for _, t in states.values()])
            settled.append(common)
            states = {k: (s, t[len(common) :]) for k, (s, t) in states.items()}
    return ("".join(settled) + max(states.values())[1]).strip()


def is_plain(word: str) -> bool:
    return word.isalpha() and not DRAWN.search(word)


def readings(token: str, model: np.ndarray | list) -> list[str]:
    """The words that a token (lower case, no white space) stands for."""
    core = TAIL.sub("", token.strip(EDGE)).strip(EDGE)
    if is_plain(core):
        return [core]
    return [*LETTERS.findall(core), *decode(core, model).split()]


def spaced(text: str, model: np.ndarray | list) -> list[str]:
    """Words that are spelt letter by letter in a text (lower case)."""
    return [w for m in SPACED.finditer(text) for w in decode(m[0], model).split()] if text else []


def hashed(word: str) -> list[int]:
    """Buckets of the whole word and of its beginnings, each hash carried on from the shorter one's."""
    if len(word) < 3:
        return []
    out, crc, at = [], zlib.crc32(b"<"), 0
    for k in PREFIXES:
        if len(word) < k:
            break
        crc, at = zlib.crc32(word[at:k].encode("utf-8", "replace"), crc), k
        out.append(crc % BUCKETS)
    out.append(zlib.crc32(f"{word[at:]}>".encode("utf-8", "replace"), crc) % BUCKETS)
    return out


class Restored(dict):
    """Features of a token, those in ``wanted`` alone if that is given."""

    def __init__(self, model: np.ndarray, wanted: dict[int, int] | None = None):
        self.model, self.wanted = model.tolist(), wanted  # lists are faster to index

    def of_words(self, words: list[str]) -> tuple[int, ...]:
        found = {x for w in words for x in hashed(w)}
        return tuple(sorted(found if self.wanted is None else (self.wanted[x] for x in found if x in self.wanted)))

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[token] = out = self.of_words(readings(token, self.model))
        return out

    def text(self, text: str) -> set[int]:
        text = text.lower()
        out: set[int] = set()
        out.update(*filter(None, map(self.__getitem__, set(text.split()))))
        if words := spaced(text, self.model):
            out.update(self.of_words(words))
        return out


@dataclass
class Scorer:
    language: np.ndarray
    wanted: dict[int, int]
    weights: np.ndarray
    bias: float

    def score(self, features: set[int]) -> float:
        z = self.bias + float(self.weights[list(features)].sum()) if features else self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Adam on the log loss with a small penalty on the weights; x holds 0 and 1."""
    share = np.clip(y.mean() if len(y) else 0.05, 0.01, 0.99)
    w = np.append(np.zeros(x.shape[1]), np.log(share / (1 - share)))
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    rng = np.random.default_rng(SEED)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 512):
            rows = order[at : at + 512]
            xs = x[rows].astype(np.float32)
            g = 1 / (1 + np.exp(-np.clip(xs @ w[:-1].astype(np.float32) + w[-1], -50, 50))) - y[rows]
            grad = np.append(xs.T @ g.astype(np.float32) / len(rows) + PENALTY * w[:-1], g.mean())
            step += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            w -= 0.1 / (1 + epoch / 8) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    """Language model of all documents, scorer of at most ``sample`` labelled ones."""
    context = docs.sparkSession.sparkContext
    language = language_model(docs, text_col)
    sent = context.broadcast(language)
    rows = labelled_sample(docs.select(F.col(id_col).cast("string").alias(id_col), text_col), labels, label, sample, MODULUS, HELD, id_col, text_col)
    of_kind = dict.fromkeys((0, 1), 0) | {int(r[0] > 0): int(r[1]) for r in rows.groupBy("y").count().collect()}

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, n = Restored(sent.value), {0: np.zeros(BUCKETS, np.int32), 1: np.zeros(BUCKETS, np.int32)}
        for batch, texts in texts_of(batches):
            for text, y in zip(texts, batch.column(2).to_pylist()):
                n[int(y > 0)][list(tokens.text(text))] += 1
        seen = np.flatnonzero(n[1] >= 1)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n[1][seen].astype(np.int64)), pa.array(n[0][seen].astype(np.int64))], ["feature", "with1", "with0"])
        rest = np.flatnonzero((n[1] == 0) & (n[0] > 0))
        yield pa.RecordBatch.from_arrays([pa.array(rest), pa.array(np.zeros(len(rest), np.int64)), pa.array(n[0][rest].astype(np.int64))], ["feature", "with1", "with0"])

    counted = rows.mapInArrow(lean(tell), "feature long, with1 long, with0 long").groupBy("feature").agg(F.sum("with1").alias("a"), F.sum("with0").alias("b"))
    n1, n0 = max(1, of_kind[1]), max(1, of_kind[0])
    share = (F.col("a") + F.col("b")) / (n1 + n0)
    term = lambda n, e: F.when(n > 0, n * F.log(n / e)).otherwise(0.0)
    ratio = term(F.col("a"), share * n1) + term(F.col("b"), share * n0) + term(n1 - F.col("a"), (1 - share) * n1) + term(n0 - F.col("b"), (1 - share) * n0)
    best = counted.where(F.col("a") / n1 > F.col("b") / n0).withColumn("ratio", 2 * ratio).where(F.col("ratio") > LEAST_RATIO).orderBy(F.desc("ratio"), "feature").limit(FEATURES)
    wanted = {int(r[0]): i for i, r in enumerate(best.select("feature").collect())}
    picked = context.broadcast(wanted)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Restored(sent.value, picked.value)
        for batch, texts in texts_of(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([sorted(tokens.text(t)) for t in texts], pa.list_(pa.int32()))], ["id", "y", "hits"])

    got = sorted((str(r[0]), int(r[1] > 0), list(r[2])) for r in rows.mapInArrow(lean(hits), "id string, y int, hits array<int>").collect()) if wanted else []  # ``sample`` rows
    x = np.zeros((len(got), len(wanted)), np.uint8)
    for i, (_, _, found) in enumerate(got):
        x[i, found] = 1
    y = np.array([r[1] for r in got], np.float64)
    weights, bias = fit_logistic(x, y)
    if not wanted:
        bias = float(np.log(max(of_kind[1], 0.5) / max(of_kind[0], 0.5))) if sum(of_kind.values()) else 0.0
    return Scorer(language, wanted, weights, bias)


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Null or empty text has no features: its score is the model's base rate. A null
    id is not held out. Very long texts are taken whole; rows repeated whole get the same score, each its own
    row. An empty table gives an empty result. Further columns, whatever their names, aren't looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, "toxic", sample, id_col, text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(fold(id_col, MODULUS) == HELD, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        tokens = Restored(model.language, model.wanted)
        for batch, texts in texts_of(batches):
            s = np.array([model.score(tokens.text(t)) for t in texts])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(lean(score), f"doc_id {rows.dtypes[0][1]}, held_out boolean, score double, predicted int")
