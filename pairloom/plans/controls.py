"""Surface-matched controls and hard negatives: labelled documents whose words overlap most with those of the other label."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pairloom.functions import measures as M
from pairloom.functions import text as T
from pairloom.operators.nearest import nearest_by_overlap
from pairloom.plans import bindings as B
from pairloom.plans import statistics as X
from pairloom.plans.pairs import SURFACE_LENGTH
from pairloom.plans.statistics import D
from pairloom.session import cut_lineage
from pairloom.sources.tables import table

QUERIES: dict = {}

CONTROLS = 3
OVERLAP_UNIT, LENGTH_UNIT = 0.03, 0.15
HARD = 0.8


def surfaces(spark, folder):
    """(id, lang, quality, n, entries) of the labelled documents: words of some length as hashes, and the number of tokens."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "lang", T.word_tokens(F.col("text")).alias("tokens"))
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("id"), "quality")
    words = F.array_distinct(F.filter("tokens", lambda t: F.length(t) >= SURFACE_LENGTH))
    rows = docs.join(labels, "id").select("id", "lang", "quality", F.size("tokens").cast("bigint").alias("n"), F.transform(words, lambda w: F.xxhash64(w)).alias("entries"))
    return cut_lineage(rows)


SQL_SURFACES = f"""tk AS (SELECT d.doc_id AS id, lang, quality, {B.sql_tokens('text')} AS tokens FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
su AS (SELECT id, lang, quality, CAST(len(tokens) AS BIGINT) AS n, list_distinct(list_filter(tokens, lambda t: len(t) >= {SURFACE_LENGTH})) AS w FROM tk),
ov AS (SELECT x.id AS p, y.id AS c, x.lang, x.n AS np, y.n AS nc, {D('len(list_intersect(x.w, y.w))')} / greatest(len(x.w) + len(y.w) - len(list_intersect(x.w, y.w)), 1) AS overlap
  FROM su x JOIN su y ON x.lang = y.lang AND x.quality = 1 AND y.quality = 0)"""


def surface_matched_controls(spark, folder):
    """For every positive the controls of its language that share most of its surface at about its length."""
    rows = surfaces(spark, folder)
    found = nearest_by_overlap(rows.where("quality = 1"), rows.where("quality = 0"), "lang", CONTROLS, OVERLAP_UNIT, LENGTH_UNIT)
    return found.select(F.col("query").alias("positive"), F.col("candidate").alias("control"), "rank", F.col("overlap").alias("surface_jaccard"), "cost")


QUERIES["surface_matched_controls"] = (
    surface_matched_controls,
    f"""WITH {SQL_SURFACES}, co AS (SELECT *, ({D(1)} - overlap) / {D(OVERLAP_UNIT)} + {D('abs(nc - np)')} / {D('greatest(np, 1)')} / {D(LENGTH_UNIT)} AS cost FROM ov),
r AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY cost, c) AS rank FROM co)
SELECT p AS positive, c AS control, CAST(rank AS BIGINT) AS rank, overlap AS surface_jaccard, cost FROM r WHERE rank <= {CONTROLS}""",
)


def hard_negatives(spark, folder):
    """Negatives that share at least HARD of their surface with a positive of their language: count, mean score, rate at
    the cut. Languages without any keep a row."""
    rows = surfaces(spark, folder)
    # Without a length in the cost, a negative's nearest positive is the one it shares most with.
    nearest = nearest_by_overlap(rows.where("quality = 0"), rows.where("quality = 1"), "lang", 1, OVERLAP_UNIT, math.inf)
    hard = nearest.where(F.col("overlap") >= HARD).select(F.col("query").alias("id"), F.lit(True).alias("hard"))
    negatives = X.scored(spark, folder).where("quality = 0").select("id", "lang", "p1").join(hard, "id", "left")
    is_hard, cents = F.col("hard").isNotNull(), F.floor(F.col("p1") * 100 + F.lit(0.5)).cast("bigint")
    n = F.count_if(is_hard)
    return negatives.groupBy("lang").agg(
        F.count(F.lit(1)).alias("negatives"), n.alias("n"), (F.sum(F.when(is_hard, cents)).cast("double") / 100.0 / n).alias("mean_p"),
        M.rate(F.count_if(is_hard & (F.col("p1") >= X.CUT)), n).alias("at_cut"),
    )


QUERIES["hard_negatives"] = (
    hard_negatives,
    f"""WITH {SQL_SURFACES}, hd AS (SELECT DISTINCT c AS id FROM ov WHERE overlap >= {D(HARD)}), {X.SQL_S},
ng AS (SELECT s.lang, p1, hd.id IS NOT NULL AS hard FROM s LEFT JOIN hd ON hd.id = s.id WHERE quality = 0)
SELECT lang, CAST(count(*) AS BIGINT) AS negatives, CAST(count_if(hard) AS BIGINT) AS n,
  CASE WHEN count_if(hard) > 0 THEN {D(f'sum(CASE WHEN hard THEN CAST(floor(p1 * 100 + {D(0.5)}) AS BIGINT) END)')} / {D(100)} / count_if(hard) END AS mean_p,
  CASE WHEN count_if(hard) > 0 THEN {D(f'count_if(hard AND p1 >= {D(X.CUT)})')} / count_if(hard) END AS at_cut FROM ng GROUP BY lang""",
)
