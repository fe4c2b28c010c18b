"""Language identification: averaged hashed subword embeddings with a linear softmax.

Subwords are the runs of ``ORDERS`` bytes (A-Z lower-cased) of a text, hashed to ``BUCKETS`` embeddings of ``DIM``
numbers. A text is the mean of its subwords' embeddings; a linear softmax maps it to the languages. Embeddings and
softmax are trained together by stochastic gradient descent in numpy on at most about ``PER_LANGUAGE`` training
texts a language (a bounded, documented sample). A fifth of the sample is kept back for calibration: it fits a
temperature, so that the score is a calibrated probability, and the least lead of the best language over the next
that a rightly named text has. A text is rejected if its best probability is under ``REJECT`` (more likely misnamed
than not) or its lead is under half that least lead. Subwords never seen in training have zero embeddings, so text
of another language drifts towards a small lead.

For scoring, the product of embeddings and softmax is a table of one row a bucket, so a text costs one lookup a
subword; texts stream whole through their tasks and nothing is shuffled. Only text is an input of a prediction.

Defined cases: null text, or text without any letter, is ``und`` with score 0 and is rejected; with no labelled
training text every row is ``und``; an empty table gives no rows; ties go to the language first in sort order.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import words as W
from pairloom.llm.samples import balanced_sample, with_sample
from pairloom.llm.tables import held_out, id_and_text, read

ORDERS = (2, 3, 4)
BUCKETS = 1 << 16
DIM = 16
PER_LANGUAGE = 500
EPOCHS = 8
RATE = 4.0
REJECT = 0.5
PIECE = 1 << 19

_MULTIPLIER = np.uint32(2654435761)


def _buckets(codes: np.ndarray, order: int) -> np.ndarray:
    """Bucket of each run of ``order`` bytes, by its first byte."""
    key = codes[: len(codes) - order + 1].astype(np.uint32)
    for i in range(1, order):
        key = (key << np.uint32(8)) | codes[i : len(codes) - order + 1 + i]
    return (key + np.uint32(order * 0x1F123BB5)) * _MULTIPLIER >> np.uint32(32 - BUCKETS.bit_length() + 1)


def _pieces(raw: np.ndarray, low: int, high: int):
    """A text in pieces of bounded size; a piece repeats the last bytes of the one before, so no run is lost."""
    for at in range(low, max(high, low + 1), PIECE):
        yield W.LOWER[raw[at : min(high, at + PIECE + max(ORDERS) - 1)]], min(high - at, PIECE)


def subwords(raw: np.ndarray, low: int, high: int) -> np.ndarray:
    """How often each bucket occurs in one whole text."""
    counts = np.zeros(BUCKETS, np.int64)
    for codes, firsts in _pieces(raw, low, high):
        for order in ORDERS:
            if len(codes) >= order:
                counts += np.bincount(_buckets(codes, order)[:firsts], minlength=BUCKETS)
    return counts


class Model(NamedTuple):
    languages: list[str]
    table: np.ndarray  # of embeddings times softmax weights
    bias: np.ndarray
    temperature: float
    least_lead: float


def _lead(logits: np.ndarray) -> np.ndarray:
    """Of the best language over the next; the best alone where there is one language."""
    top = np.sort(logits, 1)
    return top[:, -1] - top[:, -2] if logits.shape[1] > 1 else top[:, -1]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(texts: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, languages: list[str], seed: int = 7) -> Model:
    """Fit on (buckets, counts) of each text by stochastic gradient descent, then fit the temperature."""
    rng = np.random.default_rng(seed)
    n, k = len(texts), len(languages)
    embedding = np.zeros((BUCKETS, DIM), np.float32)
    order = rng.permutation(n)
    kept, fit = (order[: n // 5], order[n // 5 :]) if n >= 50 else (order, order)
    seen = np.unique(np.concatenate([texts[i][0] for i in fit] or [np.zeros(0, np.int64)]))
    embedding[seen] = rng.uniform(-1 / DIM, 1 / DIM, (len(seen), DIM))
    softmax = rng.uniform(-0.5, 0.5, (DIM, k)).astype(np.float32)
    bias = np.zeros(k, np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(fit):
            bucket, count = texts[i]
            if not len(bucket):
                continue
            share = (count / count.sum()).astype(np.float32)
            mean = share @ embedding[bucket]
            error = _softmax(mean @ softmax + bias)
            error[target[i]] -= 1
            back = softmax @ error
            softmax -= rate * 0.25 * np.outer(mean, error)
            bias -= rate * 0.01 * error
            embedding[bucket] -= rate * np.minimum(1, 50 * share)[:, None] * back * 0.2
    table = embedding @ softmax
    logits = np.array([(c / max(1, c.sum())) @ table[b] + bias for b, c in (texts[i] for i in kept)], np.float64).reshape(-1, k)
    grid = np.geomspace(0.25, 16, 49)
    loss = [-np.log(_softmax(logits / t)[np.arange(len(kept)), target[kept]] + 1e-12).sum() for t in grid]
    right = logits.argmax(1) == target[kept]
    least = float(_lead(logits[right]).min()) / 2 if right.any() else 0.0
    return Model(languages, table.astype(np.float32), bias, float(grid[int(np.argmin(loss))]), least)


def fit_language_model(documents: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Train on the training fold of documents(doc_id, text, lang); rows without id, text or language teach nothing."""
    named = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"))
    rows = named.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    sample = balanced_sample(rows, "lang", per_language).groupBy("doc_id").agg(F.min("lang").alias("lang"))
    docs = with_sample(id_and_text(documents), sample).where("text is not null").select("doc_id", "text", "lang")

    def count(batches):
        for batch in batches:
            raw, bounds = W.text_buffer(batch.column(1))
            bags = [subwords(raw, int(a), int(b)) for a, b in zip(bounds[:-1], bounds[1:])]
            filled = [np.flatnonzero(bag) for bag in bags]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array([f.astype(np.int32) for f in filled], pa.list_(pa.int32())),
                    pa.array([bag[f].astype(np.int32) for bag, f in zip(bags, filled)], pa.list_(pa.int32())),
                ],
                names=["doc_id", "lang", "bucket", "n"],
            )

    found = docs.mapInArrow(W.tidy(count), "doc_id long, lang string, bucket array<int>, n array<int>").toArrow().sort_by("doc_id")
    if not found.num_rows:
        return None
    lang = found.column("lang").to_pylist()
    languages = sorted(set(lang))
    texts = [(np.asarray(b.values), np.asarray(n.values)) for b, n in zip(found.column("bucket"), found.column("n"))]
    return train(texts, np.array([languages.index(x) for x in lang]), languages)


def score_texts(model: Model, column) -> np.ndarray:
    """Logits (text, language) of a text column."""
    raw, bounds = W.text_buffer(column)
    rows, k = len(bounds) - 1, len(model.languages)
    total, counts, row = np.zeros((rows, k)), np.zeros(rows), 0
    table = np.concatenate([model.table, np.zeros((1, k), np.float32)])
    while row < rows:
        last = max(row + 1, int(np.searchsorted(bounds, bounds[row] + PIECE, "right")) - 1)
        low, high = int(bounds[row]), int(bounds[last])
        if last == row + 1:
            for codes, firsts in _pieces(raw, low, high):
                for order in ORDERS:
                    if len(codes) >= order:
                        bucket = _buckets(codes, order)[:firsts]
                        total[row] += table[bucket].sum(0, dtype=np.float64)
                        counts[row] += len(bucket)
        else:
            codes, own = W.LOWER[raw[low:high]], bounds[row : last + 1] - low
            filled = np.flatnonzero(np.diff(own))
            for order in ORDERS:
                if len(codes) < order:
                    continue
                bucket = np.full(len(codes), BUCKETS, np.uint32)
                bucket[: len(codes) - order + 1] = _buckets(codes, order)
                for back in range(1, order):  # runs that would leave their text
                    ends = own[1:] - back
                    bucket[ends[ends >= own[:-1]]] = BUCKETS
                total[row + filled] += np.add.reduceat(table[bucket], own[filled], axis=0)
                counts[row:last] += np.maximum(0, np.diff(own) - order + 1)
        row = last
    return total / np.maximum(1, counts)[:, None] + model.bias


def _decide(model: Model, column, letters: np.ndarray, reject: float):
    """Best language number, score and rejection of each text."""
    logits = score_texts(model, column)
    probability, lead = _softmax(logits / model.temperature), _lead(logits)
    score = np.where(letters, probability.max(1, initial=0), 0.0)
    return probability.argmax(1), score, ~letters | (score < reject) | (lead < model.least_lead)


def _has_letter(text_col: str):
    return F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False))


def identify_language(documents: DataFrame, model: Model | None, reject: float = REJECT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row."""
    docs = id_and_text(documents, id_col, text_col).select("doc_id", "text", _has_letter("text").alias("letters"))
    if model is None:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))

    def run(batches):
        for batch in batches:
            letters = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool)
            best, score, rejected = _decide(model, batch.column(1), letters, reject)
            names = [model.languages[b] if ok else "und" for b, ok in zip(best, letters)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"]
            )

    return docs.mapInArrow(W.tidy(run), "doc_id long, lang_pred string, score double, rejected boolean")


def keep_identified(documents: DataFrame, model: Model | None, reject: float = REJECT, text_col: str = "text") -> DataFrame:
    """The rows of documents, with all their columns, that are not rejected."""
    if model is None:
        return documents.limit(0)
    text, width = documents.columns.index(text_col), len(documents.columns)

    def run(batches):
        for batch in batches:
            letters = np.asarray(batch.column(width).to_numpy(zero_copy_only=False), bool)
            _, _, rejected = _decide(model, batch.column(text), letters, reject)
            kept = batch.filter(pa.array(~rejected))
            yield pa.RecordBatch.from_arrays(kept.columns[:width], names=kept.schema.names[:width])

    return documents.withColumn("_letters_of_" + text_col, _has_letter(text_col)).mapInArrow(W.tidy(run), documents.schema)


def op2(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents")
    found = identify_language(documents, fit_language_model(documents))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op2_language_id": (op2, None)}
