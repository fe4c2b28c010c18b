"""Exact top-k by inner product: norm-sorted blocks, rotated partial sums and Cauchy-Schwarz bounds.

Components become integers floor(scale * x). Vectors are range-partitioned by descending length and packed into
blocks of ``BLOCK`` rows, so a block spans a narrow range of lengths. The rotation comes from the singular vectors of
the whole corpus (eigenvectors of the summed products of components); it gathers most of a product in the first
``HEAD`` coordinates. Queries are packed into blocks of ``QUERIES_PER_BLOCK`` rows, and every query block meets every
vector block; that is the stated query set against all rows, in blocks. Query blocks are broadcast, at most
``SENT_BYTES`` at a time; a larger query set goes in several parts of that size.

A query first meets the longest vectors (``SEED``, a fixed number), which gives a floor under its k-th best score.
Then, for a query q and a vector v:

* |q| * |v| under the floor: no vector of a block whose longest is v can enter, the block is left for q;
* partial sum of HEAD coordinates plus |rest of q| * |rest of v| under the floor: v is left.

What remains is scored in exact integers; floors rise within a block. A block hands on its k best for each query,
and the ranks come from a window over these, limited to k rows before the shuffle.

Defined cases: null vectors, vectors with null or non-finite components and rows without id take no part; shorter vectors count as
zeros beyond their end; a query never meets its own row, but does meet other rows that carry its id; ties go to the
smaller id; fewer than k candidates give fewer rows; empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.llm.tables import cut, read

SCALE = 1024
BLOCK = 4096
QUERIES_PER_BLOCK = 512
SENT_BYTES = 64 << 20
SEED = 4096
HEAD = 16


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v array<long>, size): rows that take part."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where("id is not null and x is not null").where(~bad)
    whole = rows.select("id", F.transform("x", lambda c: F.floor(F.lit(float(scale)) * c)).alias("v"))
    return whole.withColumn("size", F.aggregate("v", F.lit(0).cast("double"), lambda a, c: a + c.cast("double") * c.cast("double")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix, zeros beyond a row's end."""
    lengths = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten(), np.int64)
    out = np.zeros((len(column), width), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Singular vectors of all rows, strongest first: a sum of products in the tasks, width * width numbers here."""

    def products(batches):
        total = np.zeros((width, width))
        for batch in batches:
            m = _matrix(batch.column(0), width).astype(np.float64)
            total += m.T @ m
        cells = np.arange(width * width)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total.ravel())], names=["cell", "p"])

    gram = np.zeros(width * width)
    for row in vectors.select("v").mapInArrow(products, "cell int, p double").groupBy("cell").agg(F.sum("p").alias("p")).collect():
        gram[row.cell] = row.p
    return np.linalg.eigh(gram.reshape(width, width))[1][:, ::-1].copy()


def _pack(rows_in_block: int, width: int):
    """Rows (id, row, v) to blocks: ids, rows and integer matrix as bytes, and the longest length."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows_in_block):
                part = batch.slice(at, rows_in_block)
                m = _matrix(part.column(2), width)
                norm = float(np.sqrt((m.astype(np.float64) ** 2).sum(1).max()))
                values = [part.column(0).to_numpy().tobytes(), part.column(1).to_numpy().tobytes(), m.tobytes(), norm]
                types = (pa.binary(), pa.binary(), pa.binary(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=["ids", "rows", "m", "longest"])

    return run


def _unpack(ids: bytes, rows: bytes, m: bytes, width: int):
    return np.frombuffer(ids, np.int64), np.frombuffer(rows, np.int64), np.frombuffer(m, np.int64).reshape(-1, width)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= floor)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _floors(seed, width: int, k: int):
    """Adds to each query block the k-th best score of each query among the longest vectors (the least score if fewer)."""
    seed_rows, seed_m = seed

    def run(batches):
        for batch in batches:
            out = []
            for ids, rows, m in zip(*(batch.column(i).to_pylist() for i in range(3))):
                _, own, q = _unpack(ids, rows, m, width)
                scores = q @ seed_m.T
                scores[own[:, None] == seed_rows[None, :]] = np.iinfo(np.int64).min
                enough = len(seed_rows) > k
                out.append((np.partition(scores, -k, axis=1)[:, -k] if enough else np.full(len(q), np.iinfo(np.int64).min)).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(out, pa.binary())], names=["q_ids", "q_rows", "q_m", "floors"])

    return run


def _search(basis: np.ndarray, width: int, head: int, k: int):
    """Scores pairs of blocks (q_ids, q_rows, q_m, floors, ids, rows, m)."""
    slack = 1 + 1e-9

    def pair(q_ids, q_rows, q_m, floors, ids, rows, m):
        q_ids, q_rows, q = _unpack(q_ids, q_rows, q_m, width)
        floors = np.frombuffer(floors, np.int64).astype(np.float64)
        ids, rows, v = _unpack(ids, rows, m, width)
        v_norm, q_norm = np.sqrt((v.astype(np.float64) ** 2).sum(1)), np.sqrt((q.astype(np.float64) ** 2).sum(1))
        order = np.argsort(-v_norm, kind="stable")
        ids, rows, v, v_norm = ids[order], rows[order], v[order], v_norm[order]
        alive = np.flatnonzero(q_norm * v_norm[:1] * slack >= floors) if len(v_norm) else np.zeros(0, np.int64)
        if not len(alive):
            return []
        vr, qr = v @ basis, q[alive] @ basis
        v_rest, q_rest = np.sqrt((vr[:, head:] ** 2).sum(1)), np.sqrt((qr[:, head:] ** 2).sum(1))
        partial = qr[:, :head] @ vr[:, :head].T
        found = []
        for j, i in enumerate(alive):
            reach = int(np.searchsorted(-v_norm * q_norm[i] * slack, -floors[i], "right"))
            bound = partial[j, :reach] + q_rest[j] * v_rest[:reach]
            at = np.flatnonzero(bound + 1e-6 * (1 + np.abs(bound)) >= floors[i])
            at = at[rows[at] != q_rows[i]]
            scores = v[at] @ q[i]
            best = _best(scores, ids[at], k)
            keep = best[scores[best] >= floors[i]]
            found += [(int(q_ids[i]), int(q_rows[i]), int(ids[at[b]]), int(rows[at[b]]), int(scores[b])) for b in keep]
        return found

    def run(batches):
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(7))):
                columns = list(zip(*pair(*row))) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "q_row", "vec_id", "v_row", "score"])

    return run


def top_k_inner(
    vectors: DataFrame, is_query: Column, k: int = 10, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", head: int = HEAD
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each row for which is_query(id) holds."""
    spark = vectors.sparkSession
    whole = integer_vectors(vectors, id_col, vector_col, scale)
    rows = cut(
        whole.repartitionByRange(F.col("size").desc(), "id").sortWithinPartitions(F.col("size").desc(), "id").withColumn("row", F.monotonically_increasing_id())
    )
    width = rows.agg(F.max(F.size("v"))).first()[0]
    schema = "query_id long, rank int, vec_id long, score long"
    if not width:
        return spark.createDataFrame([], schema)
    basis = rotation(rows, width)
    seed = rows.orderBy(F.col("size").desc(), "id", "row").limit(SEED).select("row", "v").toArrow()
    seed = (seed.column(0).to_numpy(), _matrix(seed.column(1).combine_chunks(), width))
    packed = "ids binary, rows binary, m binary, longest double"
    blocks = rows.select("id", "row", "v").mapInArrow(_pack(BLOCK, width), packed)
    asked = rows.where(is_query).select("id", "row", "v")
    n_queries = asked.count()
    queries = asked.repartition(max(1, -(-n_queries // QUERIES_PER_BLOCK))).mapInArrow(_pack(QUERIES_PER_BLOCK, width), packed)
    with_floor = queries.select("ids", "rows", "m").mapInArrow(_floors(seed, width, k), "q_ids binary, q_rows binary, q_m binary, floors binary")
    parts = max(1, -(-n_queries * (width + 3) * 8 // SENT_BYTES))
    with_floor = cut(with_floor)
    sent = (with_floor.where(F.pmod(F.xxhash64("q_rows"), F.lit(parts)) == i) for i in range(parts))
    met = reduce(DataFrame.unionByName, (blocks.select("ids", "rows", "m").crossJoin(F.broadcast(part)) for part in sent))
    found = met.select("q_ids", "q_rows", "q_m", "floors", "ids", "rows", "m").mapInArrow(_search(basis, width, head, k), "query_id long, q_row long, vec_id long, v_row long, score long")
    ranked = Window.partitionBy("q_row").orderBy(F.col("score").desc(), "vec_id", "v_row")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6(spark: SparkSession, folder: str) -> DataFrame:
    return top_k_inner(read(spark, folder, "embeddings"), F.col("id") % 100 == 0)


OP6_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

QUERIES = {"op6_exact_topk": (op6, OP6_SQL)}
