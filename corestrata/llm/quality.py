"""A quality classifier from trusted positives and unlabelled texts: non-negative unbiased risk."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corestrata.llm.common import batches, bounded_batches, pair, texts

#: Bounds of the training sample: rows of trusted positives and of unlabelled texts, chosen by a hash of doc_id. The README has figures for other bounds.
MOST_POSITIVE, MOST_UNLABELLED = 4000, 6000
HASHED = 1024
SHAPES = 14
#: Texts of fewer bytes than about this have their pair frequencies shrunk: few pairs tell little.
SHRINK = 256
THRESHOLD = 0.3
_CELL = ((np.arange(65536, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.int64)
_SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
_PLAIN = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8))


def features(text: str) -> np.ndarray:
    """Of the whole text: hashed frequencies of byte pairs, and a few shares that tell its shape."""
    raw = np.frombuffer(text.encode(), np.uint8)
    out = np.zeros(HASHED + SHAPES, np.float32)
    if not len(raw):
        return out
    if len(raw) > 1:
        pairs = raw[:-1].astype(np.uint16) << 8 | raw[1:]
        out[:HASHED] = np.sqrt(np.bincount(_CELL[pairs], minlength=HASHED) / (len(pairs) + SHRINK))
    kinds = np.bincount(raw, minlength=256)
    words = text.split()
    lines = [x for x in text.split("\n") if x]
    n = len(raw)
    out[HASHED:] = (
        kinds[65:91].sum() / n,
        kinds[48:58].sum() / n,
        kinds[_PLAIN].sum() / n,
        kinds[128:].sum() / n,
        (kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum()) / n,
        kinds[10] / n,
        min(1.0, len(words) / n),
        len(set(words)) / max(1, len(words)),
        len(set(lines)) / max(1, len(lines)),
        np.log1p(len(words)) / 10,
        (kinds[46] + kinds[44]) / max(1, len(words)),
        kinds[124] / (len(words) + 8),
        sum(map(str.__eq__, words, words[1:])) / (len(words) + 8),
        sum(map(str.isupper, words)) / (len(words) + 8),
    )
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


def _adam(step, size: int, rounds: int, rate: float) -> np.ndarray:
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, rounds + 1):
        g = step(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, by best-bin estimation: the ratio of upper tails where its upper bound is least, under a classifier of the one from the other, on the halves that did not train it."""
    p1, p2, u1, u2 = positive[::2], positive[1::2], unlabelled[::2], unlabelled[1::2]

    def step(w):
        v = w[:-1].astype(np.float32)
        e1, e0 = 0.5 / max(1, len(p1)) * (_sigmoid(p1 @ v + w[-1]) - 1), 0.5 / max(1, len(u1)) * _sigmoid(u1 @ v + w[-1])
        return np.r_[e1.astype(np.float32) @ p1 + e0.astype(np.float32) @ u1 + 1e-3 * w[:-1], e1.sum() + e0.sum()]

    w = _adam(step, positive.shape[1] + 1, 150, 0.05)
    a, b = np.sort(p2 @ w[:-1]), np.sort(u2 @ w[:-1])
    best, prior = np.inf, 1.0
    slack = lambda n: np.sqrt(np.log(40) / (2 * max(1, n)))
    for c in np.quantile(a, np.linspace(0.0, 0.9, 91)):
        tail_p, tail_u = 1 - np.searchsorted(a, c) / len(a), 1 - np.searchsorted(b, c) / len(b)
        if tail_p and (bound := (tail_u + slack(len(a)) + slack(len(b))) / tail_p) < best:
            best, prior = bound, tail_u / tail_p
    return float(np.clip(prior, 0.05, 0.97))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, rounds: int = 400, decay: float = 2e-4) -> Model:
    """Least non-negative risk (Kiryo et al., 2017) of a linear model on standardised features.

    risk = prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]), with l(z) = log(1 + exp(-z)). Where the
    second part falls below 0 the model overfits the positives, and the step goes against it instead.
    """
    n = len(positive) + len(unlabelled)
    mean = (positive.sum(axis=0, dtype=np.float64) + unlabelled.sum(axis=0, dtype=np.float64)) / n
    spread = np.sqrt((((positive - mean.astype(np.float32)) ** 2).sum(axis=0, dtype=np.float64) + ((unlabelled - mean.astype(np.float32)) ** 2).sum(axis=0, dtype=np.float64)) / n)
    spread = np.where(spread < 1e-6, np.inf, spread + 2e-3)
    p, u = (((x - mean) / spread).astype(np.float32) for x in (positive, unlabelled))  # single precision halves what the driver holds
    prior = estimate_prior(p, u) if prior is None else prior

    def step(w):
        v = w[:-1].astype(np.float32)
        zp, zu = p @ v + w[-1], u @ v + w[-1]
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp, gu = np.zeros(len(p)), np.zeros(len(u))
        sp, su = _sigmoid(zp), _sigmoid(zu)
        if negative >= 0:
            gp = prior * (sp - 1) / len(p) - prior * sp / len(p)
            gu = su / len(u)
        else:
            gp, gu = prior * sp / len(p), -su / len(u)
        return np.r_[gp.astype(np.float32) @ p + gu.astype(np.float32) @ u + decay * w[:-1], gp.sum() + gu.sum()]

    w = _adam(step, p.shape[1] + 1, rounds, 0.02)
    scale = w[:-1] / spread
    return Model(scale, float(w[-1] - mean @ scale), prior)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def _vectors(source):
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.binary())])
    yield from batches(source, lambda b: [b.column(0), [features(t).tobytes() for t in texts(b.column(1))]], schema)


def _gather(rows: DataFrame) -> np.ndarray:
    """Features of a bounded sample, in the order of doc_id; rows that repeat a doc_id count once."""
    got = sorted(rows.mapInArrow(_vectors, "doc_id long, x binary").groupBy("doc_id").agg(F.min("x").alias("x")).collect())
    return np.array([np.frombuffer(r.x, np.float32) for r in got], np.float32).reshape(-1, HASHED + SHAPES)


def _share(column: Column, most: int, n: int) -> Column:
    """True for about most of n rows, whichever way they are stored."""
    return F.pmod(F.xxhash64(column, F.lit(7)), F.lit(1 << 20)) < int(min(1.0, most / max(1, n)) * (1 << 20))


def fit(docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """A model from rows of docs that labels trusts (quality = 1) and from docs without regard to labels; held-out rows serve for neither.

    Both samples are bounded by their parameters, all else by them: about most_positive ids meet the texts by a
    broadcast join, and features, not texts, come to the driver. None where there are no positives or no texts.
    """
    rows = pair(docs, id_col, text_col).selectExpr("cast(_id as long) as _id", "_value").where(F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    trusted = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("_id")).distinct()
    chosen = trusted.where(_share(F.col("_id"), most_positive, trusted.count())).limit(2 * most_positive)
    positive = _gather(rows.join(F.broadcast(chosen), "_id", "left_semi"))
    unlabelled = _gather(rows.where(_share(F.col("_id"), most_unlabelled, rows.select("_id").count())))
    return train(positive, unlabelled) if len(positive) > 1 and len(unlabelled) > 1 else None


def _score(model: Model | None):
    def run(source):
        def make(batch):
            x = np.array([features(t) for t in texts(batch.column(1))], np.float64).reshape(-1, HASHED + SHAPES)
            return [batch.column(0), np.full(len(x), 0.5) if model is None else model.scores(x)]

        for batch in source:
            for k in range(0, batch.num_rows, 256):
                yield from batches([batch.slice(k, 256)], make, _SCORES)

    return run


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    Scores come from texts alone, whole ones of any length; equal texts score the same. Null texts count as empty,
    and empty ones get the score of zero features; a score of threshold itself is predicted 1; null doc_ids are
    never held out; repeated rows each get a row; without positives all score 0.5; an empty table gives no rows.
    Further columns are not read, whatever they are called. No shuffle but for the bounded sample.
    """
    model = model or fit(docs, labels, id_col=id_col, text_col=text_col)
    scored = pair(docs, id_col, text_col).selectExpr("cast(_id as long)", "_value").mapInArrow(_score(model), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", model: Model | None = None) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores threshold or more, repeated rows included.

    Nulls, empty and long texts score as in score_documents(); without positives all stay; an empty table gives
    no rows; columns may have any names.
    """
    bounded_batches(docs.sparkSession)
    model = model or fit(docs, labels, text_col=text_col)
    at = docs.columns.index(text_col)

    def run(source):
        for batch in source:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                x = np.array([features(t) for t in texts(part.column(at))], np.float64)
                yield part.filter(pa.array(np.full(len(x), True) if model is None else model.scores(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
