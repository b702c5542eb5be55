"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Random indexing: each of ``BUCKETS`` hashed words has a fixed sparse random index
vector; a word's vector is the sum of the index vectors of its neighbours over
all documents. Tasks add up what they see, Spark sums it by word. The table of
vectors is BUCKETS x DIMS whatever the input's size, which bounds what is sent to
the tasks. A document is the mean and the spread of its words' vectors, and a
two-layer network, fitted in numpy on at most ``sample`` labelled documents, scores
it; a temperature fitted on a part left out of training calibrates the score.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fold, in_chunks, labelled_sample, lean, run_hashes, texts_of

BUCKETS, DIMS, NONZERO, REACH = 8192, 32, 2, 2
#: The bucket of a repeated word.
AGAIN = 0
#: What the network sees of a text: mean and spread of its word vectors, and its length.
INPUTS = 2 * DIMS + 1
SAMPLE, HIDDEN, EPOCHS, SEED = 20_000, 32, 40, 7
MODULUS, HELD, THRESHOLD = 5, 0, 0.3
#: Words that are pooled at once.
BLOCK = 200_000


@functools.cache
def byte_classes() -> np.ndarray:
    """Letters (in their case, all beyond ASCII among them), digits, signs; 0 for white space."""
    out = np.full(256, 3, np.uint8)
    out[:33], out[ord("0") : ord("9") + 1], out[128:] = 0, 2, 1
    out[ord("A") : ord("Z") + 1] = out[ord("a") : ord("z") + 1] = 1
    return out


def word_buckets(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, buckets of the words, first word of each text), chunk by chunk.

    A word is a run of letters, digits or signs; one that repeats the word before it counts as AGAIN.
    """
    for at, chunk in in_chunks([t.encode("utf-8", "replace") for t in texts]):
        hashes, first = run_hashes(chunk, byte_classes())
        ids = (hashes % np.uint64(BUCKETS - 1)).astype(np.int64) + 1
        again = np.append(False, hashes[1:] == hashes[:-1])[: len(ids)]
        again[first[first < len(ids)]] = False  # the word before it is another text's
        ids[again] = AGAIN
        yield at, ids, first


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the NONZERO entries of each word's index vector."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, DIMS, (BUCKETS, NONZERO)), rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def context_sums(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, d0 ... ) sums of the neighbours' index vectors over all documents."""
    columns = [f"d{i}" for i in range(DIMS)]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (place, sign), total = index_vectors(), np.zeros(BUCKETS * DIMS)
        for _, texts in texts_of(batches):
            for _, ids, first in word_buckets(texts):
                text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
                for k in range(1, REACH + 1):
                    same = np.flatnonzero(text_of[k:] == text_of[:-k])
                    for left, right in ((ids[same], ids[same + k]), (ids[same + k], ids[same])):
                        for j in range(NONZERO):
                            total += np.bincount(left * DIMS + place[right, j], sign[right, j], BUCKETS * DIMS)
        sums = total.reshape(BUCKETS, DIMS).astype(np.int64)
        seen = np.flatnonzero(sums.any(1))
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.array(seen), *(pa.array(sums[seen, i]) for i in range(DIMS))], ["word", *columns])

    sums = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(lean(gather), "word long, " + ", ".join(f"{c} long" for c in columns))
    return sums.groupBy("word").agg(*(F.sum(c).alias(c) for c in columns))


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """BUCKETS x DIMS vectors of length 1; a word without neighbours keeps zeros."""
    got = context_sums(docs, text_col).toPandas().to_numpy(np.float64)  # BUCKETS rows at most
    vectors = np.zeros((BUCKETS, DIMS))
    if len(got):
        vectors[got[:, 0].astype(int)] = np.sign(got[:, 1:]) * np.log1p(np.abs(got[:, 1:]))
        vectors -= vectors[vectors.any(1)].mean(0) * vectors.any(1)[:, None]
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors of each text, and the log of its words' number; zeros without words."""
    total, squares, number = np.zeros((len(texts), DIMS)), np.zeros((len(texts), DIMS)), np.zeros(len(texts))
    for begin, ids, first in word_buckets(texts):
        number[begin : begin + len(first) - 1] = np.diff(first)
        text_of = np.repeat(np.arange(begin, begin + len(first) - 1), np.diff(first))
        for at in range(0, len(ids), BLOCK):
            v, of = vectors[ids[at : at + BLOCK]], text_of[at : at + BLOCK]
            heads = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1])
            total[of[heads]] += np.add.reduceat(v, heads)
            squares[of[heads]] += np.add.reduceat(v * v, heads)
    n = np.maximum(number, 1)[:, None]
    mean = total / n
    return np.column_stack([mean, np.sqrt(np.maximum(squares / n - mean * mean, 0)), np.log1p(number)]).astype(np.float32)


@dataclass
class Network:
    """score = sigmoid((tanh(x W1 + b1) W2 + b2) / temperature) of standardised x."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def fit_network(x: np.ndarray, y: np.ndarray, seed: int = SEED) -> Network:
    """Adam on the log loss; the temperature comes from a tenth that isn't trained on.

    Without labels of both kinds the score is the share of label 1, or 0.5.
    """
    d = x.shape[1]
    if not len(y) or y.min() == y.max():
        share = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        return Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    cut = max(1, len(y) // 10) if len(y) >= 20 else 0
    calibrate, train = order[:cut], order[cut:]
    net = Network(x[train].mean(0), x[train].std(0) + 1e-3, rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    xs = (x - net.centre) / net.scale
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        rng.shuffle(train)
        for at in range(0, len(train), 128):
            rows = train[at : at + 128]
            h = np.tanh(xs[rows] @ params[0] + params[1])
            g = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -50, 50))) - y[rows]) / len(rows)
            back = np.outer(g, params[2]) * (1 - h * h)
            step += 1
            for i, grad in enumerate((xs[rows].T @ back + 1e-4 * params[0], back.sum(0), h.T @ g + 1e-4 * params[2], np.array([g.sum()]))):
                first[i] = 0.9 * first[i] + 0.1 * grad
                second[i] = 0.999 * second[i] + 0.001 * grad * grad
                params[i] -= 3e-3 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    if cut:
        z = net.logits(x[calibrate])
        net.temperature = float(min(np.geomspace(0.5, 8, 40), key=lambda t: loss(z / t, y[calibrate])))
    return net


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, Network]:
    """Word vectors of all documents and the network of at most ``sample`` labelled ones."""
    vectors = word_vectors(docs, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in texts_of(batches):
            x = pooled(texts, sent.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([v.tobytes() for v in x], pa.binary())], ["id", "y", "x"])

    rows = labelled_sample(docs.select(F.col(id_col).cast("string").alias(id_col), text_col), labels, label, sample, MODULUS, HELD, id_col, text_col)
    got = sorted(rows.mapInArrow(lean(features), "id string, y int, x binary").collect())  # ``sample`` rows of 256 bytes
    x = np.frombuffer(b"".join(bytes(r[2]) for r in got), np.float32).reshape(len(got), INPUTS).astype(np.float64)
    return vectors, fit_network(x, np.array([r[1] for r in got], np.float64))


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, and the columns ``carry``.

    Null or empty text is scored as a text without words; a null id is not held out. Very long texts
    are taken whole. Rows repeated whole get the same score, each its own row. An empty table gives an empty
    result. Further columns, whatever their names, aren't looked at unless ``carry`` names them.
    """
    vectors, net = fit(docs, labels, "quality", sample, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast((vectors, net))
    rows = docs.select(
        F.col(text_col).cast("string").alias("_text"), F.col(id_col).alias("doc_id"), F.coalesce(fold(id_col, MODULUS) == HELD, F.lit(False)).alias("held_out"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(carry))
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, model = sent.value
        for batch, texts in texts_of(batches, "_text"):
            s = model.score(pooled(texts, table).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*batch.schema.names[1:], "score", "predicted"])

    kept = rows.drop("_text")
    out = rows.mapInArrow(lean(score), ", ".join(f"`{c}` {t}" for c, t in kept.dtypes) + ", score double, predicted int")
    return out.select("doc_id", "held_out", "score", "predicted", *(F.col(f"_{i}").alias(c) for i, c in enumerate(carry)))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that aren't predicted to be of low quality, columns as they were."""
    scored = score_quality(docs, labels, carry=tuple(docs.columns), **options)
    base = len(scored.columns) - len(docs.columns)
    renamed = scored.toDF(*(f"c{i}" for i in range(len(scored.columns))))
    return renamed.where("c3 = 1").select(*(F.col(f"c{base + i}").alias(c) for i, c in enumerate(docs.columns)))
