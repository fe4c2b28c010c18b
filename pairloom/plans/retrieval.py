"""Retrieval checked against planted rewritten copies, slice by slice."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom import constants as K
from pairloom.operators import retrieval as R
from pairloom.plans import bindings as B
from pairloom.plans.pairs import SURFACE_LENGTH

QUERIES: dict = {}

SHARE = 0.1
# Copies get ids beyond those of the documents.
SHIFT = 1_000_000_000_000


def planted_profiles(spark, folder):
    units = B.units(spark, folder).where(F.size("tokens") > 0).select("id", "lines", "tokens")
    return R.profiled(R.with_planted_copies(R.dealt(units), SHARE, SHIFT), SURFACE_LENGTH)


SQL_PLANTED = f"""{B.SQL_UNITS}, nat AS (SELECT id, lines, tokens FROM units WHERE len(tokens) > 0),
sl AS (SELECT CAST(greatest(1, (count(*) + {R.SLICE_UNITS - 1}) // {R.SLICE_UNITS}) AS DOUBLE) AS k FROM nat),
de AS (SELECT id, lines, tokens, CAST(floor({B.sql_unit_hash("'slice'", 'id')} * k) AS BIGINT) AS slice FROM nat, sl),
al AS (SELECT slice, id, lines, tokens, CAST(NULL AS BIGINT) AS original FROM de UNION ALL
  SELECT slice, id + {SHIFT}, lines, list_transform(tokens, lambda t: CASE WHEN (ascii(t) + len(t)) % 4 = 0 THEN reverse(t) ELSE t END), id FROM de
  WHERE {B.sql_unit_hash("'plant'", 'id')} < CAST({SHARE} AS DOUBLE)),
pf AS (SELECT slice, id, original, lines, list_distinct(list_filter(tokens, lambda t: len(t) >= {SURFACE_LENGTH})) AS surface,
  list_distinct({B.sql_kgrams('tokens', K.SHINGLE_WIDTH)}) AS items, tokens FROM al)"""

_SHAPE = """(SELECT x.slice, x.id AS a, y.id AS b, sum(least(x.n, y.n)) AS lo FROM hist x JOIN hist y ON x.slice = y.slice AND x.k = y.k JOIN met ON met.a = x.id AND met.b = y.id GROUP BY 1, 2, 3)"""
_D = lambda x: f"CAST({x} AS DOUBLE)"


def retrieval_planted(spark, folder):
    return R.validated(planted_profiles(spark, folder))


QUERIES["retrieval_planted"] = (
    retrieval_planted,
    f"""WITH {SQL_PLANTED}, hist AS (SELECT slice, id, len(t) AS k, count(*) AS n FROM (SELECT slice, id, unnest(tokens) AS t FROM pf) GROUP BY 1, 2, 3),
tot AS (SELECT id, sum(n) AS n FROM hist GROUP BY id), fr AS (SELECT slice, name FROM (SELECT slice, unnest(surface) AS name FROM pf) GROUP BY 1, 2 HAVING count(*) > {K.MAX_DOCUMENT_FREQUENCY}),
frl AS (SELECT slice, list(name) AS frequent FROM fr GROUP BY slice),
ab AS (SELECT * FROM pf WHERE lines >= {K.MIN_LINES} AND len(surface) >= {K.MIN_SURFACE}),
me0 AS (SELECT x.slice, x.id AS a, y.id AS b, x.original IS NULL AND y.original IS NULL AS nat, coalesce(y.original = x.id, false) AS planted, x.items AS ia, y.items AS ib,
  len(x.surface) AS na, len(y.surface) AS nb, list_intersect(x.surface, y.surface) AS common FROM ab x JOIN ab y ON x.slice = y.slice AND x.id < y.id
  WHERE {_D('least(x.lines, y.lines)')} / greatest(x.lines, y.lines) >= {_D(K.MIN_SIZE_RATIO)} AND {_D('least(len(x.surface), len(y.surface))')} / greatest(len(x.surface), len(y.surface)) >= {_D(2 * K.MIN_SCORE - 1 - 1e-6)}),
met AS (SELECT *, {_D('len(common)')} / greatest(na + nb - len(common), 1) AS sj FROM me0 WHERE {_D('len(common)')} / greatest(na + nb - len(common), 1) >= {_D(2 * K.MIN_SCORE - 1 - 1e-6)}),
lo AS {_SHAPE},
sc AS (SELECT met.*, (sj + {_D('coalesce(lo, 0)')} / {_D('tp.n + tq.n - coalesce(lo, 0)')}) / {_D(2)} AS score FROM met JOIN tot tp ON tp.id = met.a JOIN tot tq ON tq.id = met.b LEFT JOIN lo ON lo.a = met.a AND lo.b = met.b),
ok AS (SELECT sc.slice, CAST(floor(score * {R.SCORE_STEPS} + {_D(0.5)}) AS BIGINT) AS step, nat, planted, len(list_filter(common, lambda c: NOT list_contains(coalesce(frequent, []), c))) > 0 AS rare
  FROM sc LEFT JOIN frl ON frl.slice = sc.slice WHERE score >= {_D(K.MIN_SCORE)}
  AND {_D('len(list_intersect(ia, ib))')} / greatest(len(ia) + len(ib) - len(list_intersect(ia, ib)), 1) < {_D(K.MIN_JACCARD)}),
rk AS (SELECT p.slice, 1 + (SELECT count(*) FROM ok q WHERE q.slice = p.slice AND q.rare AND q.step > p.step) AS rank FROM ok p WHERE planted AND rare),
ra AS (SELECT slice, count(*) AS retrieved, count_if(rank <= {K.LOW_OVERLAP_CAP}) AS found, min(rank) AS best_rank, max(rank) FILTER (WHERE rank <= {K.LOW_OVERLAP_CAP}) AS worst_rank, max(rank) AS worst_rank_uncapped FROM rk GROUP BY slice),
pa AS (SELECT slice, count_if(rare) AS proposed, count_if(nat) AS passing, count_if(nat AND rare) AS found_by_index FROM ok GROUP BY slice),
po AS (SELECT slice, count_if(original IS NULL AND lines >= {K.MIN_LINES}) AS pool, count_if(original IS NOT NULL) AS planted FROM pf GROUP BY slice)
SELECT po.slice, CAST(pool AS BIGINT) AS pool, CAST(planted AS BIGINT) AS planted, CAST(coalesce(proposed, 0) AS BIGINT) AS proposed, CAST(coalesce(passing, 0) AS BIGINT) AS passing,
  CAST(coalesce(found_by_index, 0) AS BIGINT) AS found_by_index, CAST(coalesce(retrieved, 0) AS BIGINT) AS retrieved, CAST(coalesce(found, 0) AS BIGINT) AS found, CAST(best_rank AS BIGINT) AS best_rank,
  CAST(worst_rank AS BIGINT) AS worst_rank, CAST(worst_rank_uncapped AS BIGINT) AS worst_rank_uncapped, CAST(pool * (pool - 1) // 2 AS BIGINT) AS pairs,
  CASE WHEN pool > 1 THEN {_D('coalesce(passing, 0)')} / (pool * (pool - 1) // 2) END AS pass_rate,
  CASE WHEN coalesce(proposed, 0) > 0 THEN {_D('coalesce(found, 0)')} / least(proposed, {K.LOW_OVERLAP_CAP}) END AS precision_lower_bound
FROM po LEFT JOIN pa ON pa.slice = po.slice LEFT JOIN ra ON ra.slice = po.slice""",
)


def planted_reasons(spark, folder):
    """Which test decides each planted pair on its own, with the range of scores."""
    step = F.floor(F.col("score") * R.SCORE_STEPS + F.lit(0.5)).cast("bigint")
    return R.planted_decisions(planted_profiles(spark, folder)).groupBy("reason").agg(
        F.count(F.lit(1)).alias("pairs"), F.min(step).alias("least_score_steps"), F.max(step).alias("most_score_steps")
    )


QUERIES["planted_reasons"] = (
    planted_reasons,
    f"""WITH {SQL_PLANTED}, pr AS (SELECT y.id AS b, x.id AS a, x.lines AS la, y.lines AS lb, x.surface AS sa, y.surface AS sb, x.items AS ia, y.items AS ib, x.tokens AS ta, y.tokens AS tb
  FROM pf y JOIN pf x ON y.original = x.id),
fa AS (SELECT *, {_D('len(list_intersect(sa, sb))')} / greatest(len(sa) + len(sb) - len(list_intersect(sa, sb)), 1) AS sj,
  {_D('len(list_intersect(ia, ib))')} / greatest(len(ia) + len(ib) - len(list_intersect(ia, ib)), 1) AS jac FROM pr),
sc AS (SELECT *, (sj + {_D(1)}) / {_D(2)} AS score FROM fa),
r AS (SELECT score, CASE WHEN least(la, lb) < {K.MIN_LINES} THEN 'short' WHEN least(len(sa), len(sb)) < {K.MIN_SURFACE} THEN 'small_surface' WHEN {_D('least(la, lb)')} / greatest(la, lb) < {_D(K.MIN_SIZE_RATIO)} THEN 'size_ratio'
  WHEN jac >= {_D(K.MIN_JACCARD)} THEN 'high_overlap' WHEN score >= {_D(K.MIN_SCORE)} THEN 'proposed' ELSE 'score' END AS reason FROM sc)
SELECT reason, CAST(count(*) AS BIGINT) AS pairs, CAST(min(floor(score * {R.SCORE_STEPS} + {_D(0.5)})) AS BIGINT) AS least_score_steps, CAST(max(floor(score * {R.SCORE_STEPS} + {_D(0.5)})) AS BIGINT) AS most_score_steps FROM r GROUP BY reason""",
)
