"""Benchmark decontamination: short test items found inside long documents.

Containment of an item in a document is the share of the item's distinct five-word shingles that the document
holds. Items are partitioned by their number of shingles. Each size partition keeps, of every item, the bottom
``k`` shingles by hash (a min-wise sketch), with ``k = n - ceil(share * n) + 1`` for an item of n shingles: a
document that holds the wanted share of the item holds at least one of these, so the sketch misses nothing.
Documents of any length probe the sketches with all their shingles, and candidates are verified by counting
exact shingles. A sketch of the document instead would lose short items in long texts: a 30-shingle item in
10,000 shingles has a Jaccard similarity of 0.003.

Items go through in blocks of at most ``block_shingles`` shingles, which bounds what is sent to the executors;
documents stream through their tasks and are never shuffled.

Defined cases: null or empty texts hold nothing and items without words match nothing; an item of fewer words
than a shingle is one shingle of all its words; repeated items and repeated documents give repeated rows; empty
tables give no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import words as W
from pairloom.llm.tables import cut, id_and_text, read

SHINGLE = 5
SHARE = 0.8
BLOCK_SHINGLES = 2_000_000
_MATCHES = "doc_id long, item_id long, n_item long, n_found long"


def needed(n, share: float):
    """Shingles a document must hold of an item of n, in exact integers of a thousandth."""
    per_mille = round(share * 1000)
    return -(-(n * per_mille) // 1000)


def item_shingles(items: DataFrame, width: int) -> DataFrame:
    """(item, item_id, width, hashes, size_class): one row per item with words. ``item`` numbers the rows."""

    def run(batches):
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for group in W.iter_words(batch.column(1), W.ALNUM):
                for i, hashes in enumerate(W.shingle_sets(group, width)):
                    n_words = int(group.bounds[i + 1] - group.bounds[i])
                    if n_words:
                        size = len(hashes)
                        out.append((ids[group.first + i], min(width, n_words), hashes.view(np.int64).tolist(), size.bit_length()))
            columns = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int32()))],
                names=["item_id", "width", "hashes", "size_class"],
            )

    return items.mapInArrow(W.tidy(run), "item_id long, width int, hashes array<long>, size_class int")


def _blocks(items: DataFrame, block_shingles: int):
    """The items in blocks of at most block_shingles shingles (a single larger item makes a block of its own)."""
    block, total = [], 0
    for row in items.orderBy("size_class", "item_id").toLocalIterator():
        if block and total + len(row.hashes) > block_shingles:
            yield block
            block, total = [], 0
        block.append((row.item_id, row.width, np.array(row.hashes, np.int64).view(np.uint64)))
        total += len(row.hashes)
    if block:
        yield block


def _pack(block, share: float) -> list[tuple]:
    """Per shingle width: sketch keys sorted with their items, and all (shingle, item) entries sorted by shingle."""
    packed = []
    for width in sorted({w for _, w, _ in block}):
        own = [(i, h) for i, w, h in block if w == width]
        sizes = np.array([len(h) for _, h in own])
        bottom = sizes - needed(sizes, share) + 1
        sketch = np.concatenate([h[:k] for (_, h), k in zip(own, bottom)])
        owner = np.repeat(np.arange(len(own)), bottom)
        order = np.argsort(sketch, kind="stable")
        every = np.concatenate([h for _, h in own])
        owners = np.repeat(np.arange(len(own)), sizes)
        by_hash = np.argsort(every, kind="stable")
        packed.append((width, np.array([i for i, _ in own], object), sizes, sketch[order], owner[order], every[by_hash], owners[by_hash]))
    return packed


def _hits(keys: np.ndarray, owners: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Owners of every key that is among found; both sorted."""
    low, high = np.searchsorted(keys, found, "left"), np.searchsorted(keys, found, "right")
    some = np.flatnonzero(high > low)
    if not len(some):
        return owners[:0]
    counts = (high - low)[some]
    at = np.repeat(low[some] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    return owners[at]


def contained_items(
    documents: DataFrame,
    items: DataFrame,
    share: float = SHARE,
    width: int = SHINGLE,
    block_shingles: int = BLOCK_SHINGLES,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, n_item, n_found): every document and item with n_found >= share * n_item."""
    spark = documents.sparkSession
    docs = id_and_text(documents, id_col, text_col)
    prepared = cut(item_shingles(items.select(F.col(item_col).cast("long"), F.col(item_text).cast("string")), width))
    parts = []
    for block in _blocks(prepared, block_shingles):
        sent = spark.sparkContext.broadcast(_pack(block, share))
        parts.append(docs.mapInArrow(W.tidy(_probe(sent, share)), _MATCHES))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], _MATCHES)


def keep_clean(
    documents: DataFrame,
    items: DataFrame,
    share: float = SHARE,
    width: int = SHINGLE,
    block_shingles: int = BLOCK_SHINGLES,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """The rows of documents, with all their columns, that contain no item; each block of items is a filter."""
    prepared = cut(item_shingles(items.select(F.col(item_col).cast("long"), F.col(item_text).cast("string")), width))
    text, kept = documents.columns.index(text_col), documents
    for block in _blocks(prepared, block_shingles):
        kept = kept.mapInArrow(W.tidy(_sift(documents.sparkSession.sparkContext.broadcast(_pack(block, share)), share, text)), documents.schema)
    return kept


def _sift(sent, share: float, text: int):
    def run(batches):
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            clean[[row for row, *_ in _matches(sent.value, batch.column(text), share)]] = False
            yield batch.filter(pa.array(clean))

    return run


def _matches(packed, column, share: float):
    """(row, item, its shingles, found) of every containment in a text column."""
    for group in W.iter_words(column, W.ALNUM):
        for width, names, sizes, sketch, owner, every, owners in packed:
            hashes = W.windows(group.hashes, width)
            low = np.minimum(np.searchsorted(sketch, hashes), len(sketch) - 1)
            touched = np.flatnonzero(sketch[low] == hashes)
            row_of = np.searchsorted(group.bounds, touched, "right") - 1
            inside = touched + width <= group.bounds[row_of + 1]
            for r in np.unique(row_of[inside]):
                found = np.unique(hashes[group.bounds[r] : group.bounds[r + 1] - width + 1])
                candidates = np.unique(_hits(sketch, owner, found))
                counts = np.bincount(_hits(every, owners, found), minlength=len(names))
                for c in candidates[counts[candidates] >= needed(sizes[candidates], share)]:
                    yield group.first + int(r), names[c], int(sizes[c]), int(counts[c])


def _probe(sent, share: float):
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "item_id", "n_item", "n_found")])

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [(ids[row], *rest) for row, *rest in _matches(sent.value, batch.column(1), share)]
            columns = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    return run


def op9(spark: SparkSession, folder: str) -> DataFrame:
    found = contained_items(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return found.withColumn("containment", F.col("n_found") / F.col("n_item"))


_SQL_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)

OP9_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
iw AS (SELECT item_id, w, least(len(w), {SHINGLE}) AS width FROM i WHERE len(w) > 0),
igram AS (SELECT DISTINCT item_id, width, array_to_string(w[p:p + width - 1], ' ') AS g
  FROM (SELECT item_id, w, width, unnest(range(1, len(w) - width + 2)) AS p FROM iw)),
widths AS (SELECT DISTINCT width FROM iw),
dgram AS (SELECT DISTINCT doc_id, width, array_to_string(w[p:p + width - 1], ' ') AS g
  FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS p FROM d, widths WHERE len(w) >= width)),
size AS (SELECT item_id, count(*) AS n_item FROM igram GROUP BY item_id),
hit AS (SELECT doc_id, item_id, count(*) AS n_found FROM dgram JOIN igram USING (width, g) GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_found, n_found / n_item AS containment
FROM hit JOIN size USING (item_id) WHERE n_found * 1000 >= n_item * {round(SHARE * 1000)}
"""

QUERIES = {"op9_benchmark_decontamination": (op9, OP9_SQL)}
