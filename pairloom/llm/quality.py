"""Quality by positive-unlabelled learning with a non-negative risk.

Trusted positives are texts labelled of good quality; unlabelled are any texts of the corpus' training fold, good
and bad mixed, whose labels are never read. A two-layer network on ``N_FEATURES`` shape features of the whole text is
trained in numpy on the non-negative unbiased risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))

with the sigmoid loss; where the second part goes under zero, its gradient is turned round, so that the network can't
win by calling every unlabelled text bad. The class prior is estimated first: a network that tells positives from
unlabelled texts is scored on kept-back parts of both, and the prior is the least share of unlabelled over positives
above any score (the best bin), with a margin for small bins.

Scores are calibrated on the kept-back parts, so that ``CUT`` lies where the share of unlabelled texts at or above it
is the prior, within the range where nearly all positives stay above. Both samples are bounded (``POSITIVES``,
``UNLABELLED``). Texts stream whole through their tasks; nothing is shuffled, and only text is an input of a score.

Defined cases: null and empty texts have the features of no words and get a score like any text; without trusted
positives or unlabelled texts every score is 0.5; an empty table gives no rows; repeated rows repeat.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import words as W
from pairloom.llm.samples import balanced_sample, labelled_ids, with_sample
from pairloom.llm.tables import held_out, id_and_text, read

CUT = 0.7
POSITIVES = 6000
UNLABELLED = 12000
HIDDEN = 24
EPOCHS = 60
RATE = 0.01
BATCH = 256
KEEP_POSITIVES = 0.995

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_PROSE = np.isin(_BYTES, list(b".,;:?'\"-()"))
_SYMBOL = (_BYTES > 32) & (_BYTES < 127) & ~W.ALNUM & ~_PROSE
_CLASSES = np.stack([W.ALNUM, _UPPER, _DIGIT, _PROSE, _SYMBOL, _BYTES == 10, _BYTES == 32, _BYTES < 32, _BYTES >= 128]).T
# Class of a byte in the pair histogram: lower case, upper case, digit, beyond ASCII, line end, other space, prose mark, symbol.
_KIND = np.select([_BYTES >= 128, _UPPER, _DIGIT, W.ALNUM, _BYTES == 10, W._SPACE, _PROSE], [3, 1, 2, 0, 4, 5, 6], 7).astype(np.uint8)
N_FEATURES = 64 + 9


def features(column) -> np.ndarray:
    """(text, feature): shares of pairs of byte classes, and measures of words and lines."""
    raw, bounds = W.text_buffer(column)
    out = np.zeros((len(bounds) - 1, N_FEATURES), np.float32)
    for row, (low, high) in enumerate(zip(bounds[:-1], bounds[1:])):
        pairs = np.zeros(64, np.int64)
        for at in range(low, high, W.SLICE):
            kind = _KIND[raw[at : min(high, at + W.SLICE + 1)]]
            if len(kind) > 1:
                pairs += np.bincount(kind[:-1] * 8 + kind[1:], minlength=64)
        out[row, :64] = np.sqrt(pairs / max(1, high - low - 1))
    for group in W.iter_words(column, W.VISIBLE):
        for i in range(group.rows):
            a, b = group.bounds[i], group.bounds[i + 1]
            out[group.first + i, 64:] = _word_measures(raw, group, int(bounds[group.first]), a, b)
    return out


def _word_measures(raw, group: W.Words, base: int, a: int, b: int) -> np.ndarray:
    n = b - a
    if not n:
        return np.zeros(9)
    own, length = group.hashes[a:b], (group.ends[a:b] - group.starts[a:b])
    last = raw[group.ends[a:b] - 1 + base]
    first = raw[group.starts[a:b] + base]
    distinct, often = np.unique(own, return_counts=True)
    bigrams = W.windows(own, 3)
    return np.array(
        [
            np.log1p(n) / 10,
            min(length.mean() / 10, 5),
            min(length.std() / 10, 5),
            len(distinct) / n,
            often.max() / n,
            1 - len(np.unique(bigrams)) / max(1, len(bigrams)),
            _PROSE[last].mean(),
            _SYMBOL[last].mean(),
            _UPPER[first].mean(),
        ]
    )


class Net(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: tuple


def _forward(net: Net, x: np.ndarray) -> np.ndarray:
    w1, b1, w2, b2 = net.weights
    return np.tanh((x - net.mean) / net.scale @ w1 + b1) @ w2 + b2[0]


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _train(positive: np.ndarray, unlabelled: np.ndarray, slope, seed: int) -> Net:
    """Adam over batches of both; slope(z of positives, z of unlabelled) gives the loss gradient of either."""
    rng = np.random.default_rng(seed)
    every = np.concatenate([positive, unlabelled])
    mean, scale = every.mean(0), every.std(0) + 1e-3
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    w = [rng.normal(0, 0.2, (p.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(EPOCHS):
        rounds = max(1, len(u) // BATCH)
        for pi, ui in zip(np.array_split(rng.permutation(len(p)), rounds), np.array_split(rng.permutation(len(u)), rounds)):
            if not len(pi):
                pi = rng.integers(0, len(p), min(len(p), BATCH))
            x = np.concatenate([p[pi], u[ui]])
            hidden = np.tanh(x @ w[0] + w[1])
            z = hidden @ w[2] + w[3][0]
            g = np.concatenate(slope(z[: len(pi)], z[len(pi) :]))
            back = np.outer(g, w[2]) * (1 - hidden**2)
            grads = [x.T @ back + 1e-4 * w[0], back.sum(0), hidden.T @ g + 1e-4 * w[2], np.array([g.sum()])]
            step += 1
            for k, grad in enumerate(grads):
                m[k] += 0.1 * (grad - m[k])
                v[k] += 0.001 * (grad**2 - v[k])
                w[k] = w[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Net(mean, scale, tuple(w))


def _tell_apart(zp, zu):
    """Logistic loss of positives against unlabelled texts."""
    return (_sigmoid(zp) - 1) / len(zp) / 2, _sigmoid(zu) / len(zu) / 2


def _non_negative(prior: float):
    """Gradient of the non-negative risk with the sigmoid loss."""

    def slope(zp, zu):
        sp, su = _sigmoid(zp), _sigmoid(zu)
        dp, du = sp * (1 - sp) / len(zp), su * (1 - su) / len(zu)
        rest = su.mean() - prior * sp.mean()
        if rest >= 0:
            return -prior * dp - prior * dp, du
        return prior * dp, -du

    return slope


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Least ratio of unlabelled over positive texts at or above a score, over scores with enough positives."""
    cuts = np.unique(np.quantile(positive, np.linspace(0, 0.9, 91)))
    p = np.array([(positive >= c).mean() for c in cuts])
    u = np.array([(unlabelled >= c).mean() for c in cuts])
    margin = np.sqrt(1 / max(1, len(unlabelled))) + np.sqrt(1 / max(1, len(positive)))
    return float(np.clip(((u + margin * np.sqrt(p * (1 - p) + 1e-4)) / p).min(), 0.05, 0.99))


class Model(NamedTuple):
    net: Net
    prior: float
    cut: float


def train(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 3) -> Model:
    kp, ku = len(positive) // 4, len(unlabelled) // 4
    first = _train(positive[kp:], unlabelled[ku:], _tell_apart, seed)
    own_p, own_u = (positive[:kp], unlabelled[:ku]) if min(kp, ku) >= 20 else (positive, unlabelled)
    prior = estimate_prior(_forward(first, own_p), _forward(first, own_u))
    net = _train(positive[kp:], unlabelled[ku:], _non_negative(prior), seed + 1)
    zp, zu = _forward(net, own_p), _forward(net, own_u)
    cut = min(float(np.quantile(zu, 1 - prior)), float(np.quantile(zp, 1 - KEEP_POSITIVES)))
    return Model(net, prior, cut)


def scores(model: Model, x: np.ndarray) -> np.ndarray:
    """Network outputs moved so that the calibrated cut scores CUT."""
    return _sigmoid(_forward(model.net, x) - model.cut + np.log(CUT / (1 - CUT)))


def fit_quality(documents: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | None:
    """Train on bounded samples of the training fold; only the positive labels are read."""
    docs = id_and_text(documents)
    trusted = labelled_ids(labels.where("quality = 1"), "quality", positives).select("doc_id", F.lit(1).alias("y"))
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out()).withColumn("y", F.lit(0))
    mixed = balanced_sample(ids, "y", unlabelled).distinct()

    def run(batches):
        for batch in batches:
            x = features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float32()))], names=["doc_id", "x"])

    def gather(sample):
        rows = with_sample(docs, sample).select("doc_id", "text").mapInArrow(run, "doc_id long, x array<float>").toArrow().sort_by("doc_id")
        x = np.asarray(rows.column("x").combine_chunks().flatten()).reshape(-1, N_FEATURES).astype(np.float64)
        return x[np.random.default_rng(5).permutation(len(x))]

    p, u = gather(trusted), gather(mixed)
    return train(p, u) if len(p) and len(u) else None


def score_quality(documents: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row; CUT is the calibrated threshold."""
    docs = id_and_text(documents, id_col, text_col)
    if model is None:
        return docs.select("doc_id", F.lit(0.5).alias("score"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(model, features(batch.column(1))))], names=["doc_id", "score"])

    return docs.mapInArrow(run, "doc_id long, score double")


def op3(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents")
    found = score_quality(documents, fit_quality(documents, read(spark, folder, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


QUERIES = {"op3_quality": (op3, None)}
