"""Similar pairs, their decisions, omissions, clusters and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom import constants as K
from pairloom.functions import measures as M
from pairloom.functions import text as T
from pairloom.operators import similarity as S
from pairloom.operators.components import connected_components
from pairloom.operators.ordered import ranked
from pairloom.operators.skew import semi_join
from pairloom.plans import bindings as B
from pairloom.session import cut_lineage, written

QUERIES: dict = {}


def similar_pairs(spark, folder):
    return B.similar(spark, folder).select("a", "b", "jaccard", "size_ratio", "pairs")


QUERIES["similar_pairs"] = (
    similar_pairs,
    f"WITH {B.SQL_CLASS_PAIRS} SELECT a, b, jaccard, size_ratio, CAST(pairs AS BIGINT) AS pairs FROM sims",
)


def similar_pairs_ranked(spark, folder):
    """Per language, by Jaccard; banded by a hash score against the question's cut and floor."""
    _, _, _, _, cut, floor, _ = K.SIGNALS[0]
    language = B.units(spark, folder).select(F.col("id").alias("a"), "lang")
    score = T.two_decimals(T.unit_hash(F.lit("pair"), F.col("a"), F.col("b")))
    rows = B.similar(spark, folder).join(language, "a").withColumn("p", score)
    order = [F.col("jaccard").desc(), "a", "b"]
    return ranked(rows.select("lang", "a", "b", "jaccard", "p"), ["lang"], order).withColumn(
        "band", M.band(F.col("p"), F.lit(cut), F.lit(floor))
    )


QUERIES["similar_pairs_ranked"] = (
    similar_pairs_ranked,
    f"""WITH {B.SQL_CLASS_PAIRS}, r AS (SELECT u.lang, a, b, jaccard, {B.sql_two(B.sql_unit_hash("'pair'", 'a', 'b'))} AS p
  FROM sims JOIN units u ON u.id = a)
SELECT lang, a, b, jaccard, p, CAST(row_number() OVER (PARTITION BY lang ORDER BY jaccard DESC, a, b) AS BIGINT) AS rank,
  CASE WHEN p >= CAST({K.SIGNALS[0][4]} AS DOUBLE) THEN 'worth_a_look' WHEN p >= CAST({K.SIGNALS[0][5]} AS DOUBLE) THEN 'uncertain'
  ELSE 'below' END AS band FROM r""",
)

CANDIDATE_CAP = K.MAX_CANDIDATES


def pair_omissions(spark, folder):
    """Every candidate beyond the cap is a row that says so."""
    rows = ranked(B.similar(spark, folder).select("a", "b", "pairs"), [], ["a", "b"])
    return rows.withColumn("disposition", F.when(F.col("rank") <= CANDIDATE_CAP, "kept").otherwise("candidate_limit"))


QUERIES["pair_omissions"] = (
    pair_omissions,
    f"""WITH {B.SQL_CLASS_PAIRS}, r AS (SELECT a, b, pairs, row_number() OVER (ORDER BY a, b) AS rank FROM sims)
SELECT a, b, CAST(pairs AS BIGINT) AS pairs, CAST(rank AS BIGINT) AS rank,
  CASE WHEN rank <= {CANDIDATE_CAP} THEN 'kept' ELSE 'candidate_limit' END AS disposition FROM r""",
)

COMPARISON_BUDGET = K.MAX_COMPARISONS


def comparison_budget(spark, folder):
    """Exact number of pool comparisons per language, and whether a budget would have cut them short."""
    pool = B.units(spark, folder).where(F.col("lines") >= K.MIN_LINES).groupBy("lang").agg(F.count(F.lit(1)).alias("pool"))
    n = F.col("pool")
    total = F.floor(n * (n - 1) / 2).cast("bigint")
    return pool.select(
        "lang", "pool", total.alias("comparisons"), (total > COMPARISON_BUDGET).alias("budget_exceeded"),
        F.greatest(total - COMPARISON_BUDGET, F.lit(0)).cast("bigint").alias("remaining_unknown"),
    )


QUERIES["comparison_budget"] = (
    comparison_budget,
    f"""WITH {B.SQL_UNITS}, p AS (SELECT lang, count(*) AS pool FROM units WHERE lines >= {K.MIN_LINES} GROUP BY lang)
SELECT lang, CAST(pool AS BIGINT) AS pool, CAST(pool * (pool - 1) // 2 AS BIGINT) AS comparisons,
  pool * (pool - 1) // 2 > {COMPARISON_BUDGET} AS budget_exceeded,
  CAST(greatest(pool * (pool - 1) // 2 - {COMPARISON_BUDGET}, 0) AS BIGINT) AS remaining_unknown FROM p""",
)


# --- second source: shared vocabulary ---------------------------------------------------------------

SURFACE_LENGTH = 4
LOW_SCORE = K.MIN_SCORE


def profiles(spark, folder):
    """Clone pool with shingles, surface names and the token-length histogram as shape."""
    return shaped(B.classes(spark, folder).where(F.col("lines") >= K.MIN_LINES))


def shaped(classes):
    words = F.array_distinct(F.filter("tokens", lambda t: F.length(t) >= SURFACE_LENGTH))
    # Only tokens are written; the rest is made from them where it is read.
    kept = written(classes.select("cid", "lines", "copies", "tokens")).withColumn("lengths", F.transform("tokens", lambda t: F.length(t)))
    return kept.select("cid", "lines", "copies", T.shingle_hashes(F.col("tokens")).alias("items"), words.alias("surface"), S.length_shape(F.col("lengths")).alias("shape"))


SQL_PROFILES = f"""{B.SQL_CLASSES},
pool AS (SELECT cid, lines, copies, items, list_distinct(list_filter(tokens, lambda t: len(t) >= {SURFACE_LENGTH})) AS surface, tokens
  FROM classes WHERE lines >= {K.MIN_LINES}),
names AS (SELECT cid, copies, unnest(surface) AS name FROM pool WHERE len(surface) >= {K.MIN_SURFACE}),
rare AS (SELECT name FROM names GROUP BY name HAVING sum(copies) <= {K.MAX_DOCUMENT_FREQUENCY}),
post AS (SELECT cid, name FROM names JOIN rare USING (name)),
cand AS (SELECT DISTINCT x.cid AS a, y.cid AS b FROM post x JOIN post y ON x.name = y.name AND x.cid < y.cid),
sf AS (SELECT x.cid AS a, y.cid AS b, count(*) AS common FROM names x JOIN names y ON x.name = y.name AND x.cid < y.cid GROUP BY 1, 2),
shi AS (SELECT cid, unnest(items) AS item FROM pool),
sc AS (SELECT x.cid AS a, y.cid AS b, count(*) AS common FROM shi x JOIN shi y ON x.item = y.item AND x.cid < y.cid GROUP BY 1, 2),
hist AS (SELECT cid, len(t) AS k, count(*) AS n FROM (SELECT cid, unnest(tokens) AS t FROM pool) GROUP BY 1, 2),
tot AS (SELECT cid, sum(n) AS n FROM hist GROUP BY cid),
lo AS (SELECT c.a, c.b, sum(least(x.n, y.n)) AS lo FROM cand c JOIN hist x ON x.cid = c.a JOIN hist y ON y.cid = c.b AND y.k = x.k GROUP BY 1, 2),
facts AS (SELECT c.a, c.b, p.copies * q.copies AS pairs, CAST(least(p.lines, q.lines) AS DOUBLE) / CAST(greatest(p.lines, q.lines) AS DOUBLE) AS size_ratio,
  coalesce(sc.common, 0) / CAST(greatest(len(p.items) + len(q.items) - coalesce(sc.common, 0), 1) AS DOUBLE) AS jaccard,
  coalesce(sf.common, 0) / CAST(greatest(len(p.surface) + len(q.surface) - coalesce(sf.common, 0), 1) AS DOUBLE) AS surface_jaccard,
  CAST(coalesce(lo.lo, 0) AS DOUBLE) / CAST(tp.n + tq.n - coalesce(lo.lo, 0) AS DOUBLE) AS shape_similarity
  FROM cand c JOIN pool p ON p.cid = c.a JOIN pool q ON q.cid = c.b JOIN tot tp ON tp.cid = c.a JOIN tot tq ON tq.cid = c.b
  LEFT JOIN sc ON sc.a = c.a AND sc.b = c.b LEFT JOIN sf ON sf.a = c.a AND sf.b = c.b LEFT JOIN lo ON lo.a = c.a AND lo.b = c.b),
between AS (SELECT *, (surface_jaccard + shape_similarity) / CAST(2 AS DOUBLE) AS score,
  CASE WHEN size_ratio < CAST({K.MIN_SIZE_RATIO} AS DOUBLE) THEN 'size_ratio' WHEN jaccard >= CAST({K.MIN_JACCARD} AS DOUBLE) THEN 'high_overlap'
  WHEN (surface_jaccard + shape_similarity) / CAST(2 AS DOUBLE) >= CAST({LOW_SCORE} AS DOUBLE) THEN 'proposed' ELSE 'score' END AS reason FROM facts),
decided AS (SELECT a, b, pairs, size_ratio, jaccard, surface_jaccard, shape_similarity, score, reason FROM between UNION ALL
  SELECT cid, cid, copies * (copies - 1) // 2, CAST(1 AS DOUBLE), CAST(0 AS DOUBLE), CAST(1 AS DOUBLE), CAST(1 AS DOUBLE), CAST(1 AS DOUBLE), CASE WHEN len(items) > 0 THEN 'high_overlap' ELSE 'proposed' END
  FROM pool WHERE copies > 1 AND cid IN (SELECT cid FROM post))"""


def pair_decision_reasons(spark, folder):
    """How many candidate pairs of the second source end at each reason, of classes and of the units they stand for."""
    decided = S.low_overlap_decisions(profiles(spark, folder), min_score=LOW_SCORE)
    return decided.groupBy("reason").agg(F.count(F.lit(1)).alias("class_pairs"), F.sum("pairs").alias("pairs"))


QUERIES["pair_decision_reasons"] = (
    pair_decision_reasons,
    f"WITH {SQL_PROFILES} SELECT reason, CAST(count(*) AS BIGINT) AS class_pairs, CAST(sum(pairs) AS BIGINT) AS pairs FROM decided GROUP BY reason",
)

FACTS = ["a", "b", "jaccard", "size_ratio", "surface_jaccard", "shape_similarity", "score"]


def low_overlap_pairs(spark, folder):
    """Best pairs of the second source; the ones beyond the cap stay as rows marked so."""
    found = S.low_overlap_pairs(profiles(spark, folder), min_score=LOW_SCORE).select(*FACTS, "pairs")
    rows = ranked(found, [], [F.col("score").desc(), "a", "b"])
    return rows.withColumn(
        "disposition", F.when(F.col("rank") <= K.LOW_OVERLAP_CAP, "kept").otherwise("low_overlap_cap")
    )


QUERIES["low_overlap_pairs"] = (
    low_overlap_pairs,
    f"""WITH {SQL_PROFILES}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, a, b) AS rank FROM decided WHERE reason = 'proposed')
SELECT {', '.join(FACTS)}, CAST(pairs AS BIGINT) AS pairs, CAST(rank AS BIGINT) AS rank,
  CASE WHEN rank <= {K.LOW_OVERLAP_CAP} THEN 'kept' ELSE 'low_overlap_cap' END AS disposition FROM r""",
)


def rarest_names(spark, folder):
    """Surface names the second source may use, rarest first."""
    names = profiles(spark, folder).where(F.size("surface") >= K.MIN_SURFACE).select("copies", F.explode("surface").alias("name"))
    counts = names.groupBy("name").agg(F.sum("copies").alias("df")).where(F.col("df") <= K.MAX_DOCUMENT_FREQUENCY)
    return ranked(counts, [], ["df", "name"])


QUERIES["rarest_names"] = (
    rarest_names,
    f"""WITH {SQL_PROFILES}, n AS (SELECT name, sum(copies) AS df FROM names GROUP BY name HAVING sum(copies) <= {K.MAX_DOCUMENT_FREQUENCY})
SELECT name, CAST(df AS BIGINT) AS df, CAST(row_number() OVER (ORDER BY df, name) AS BIGINT) AS rank FROM n""",
)


def pair_sources(spark, folder):
    """Both sources in one table; their Jaccard ranges are disjoint, so no pair comes twice. Copies are the row with a = b."""
    found = cut_lineage(B.similar(spark, folder).select("a", "b", "jaccard", "pairs"))
    first = found.withColumn("provenance", F.lit("token_shingles_not_semantic_equivalence"))
    # The pairs of high overlap among the profiles are among those just found, which are more.
    close = found.where(F.col("a") != F.col("b")).select("a", "b")
    second = S.low_overlap_pairs(profiles(spark, folder), min_score=LOW_SCORE, close=close).select(
        "a", "b", "jaccard", "pairs", F.lit("shared_surface_not_semantic_equivalence").alias("provenance")
    )
    return first.unionByName(second)


QUERIES["pair_sources"] = (
    pair_sources,
    f"""WITH {SQL_PROFILES}, {B.SQL_SIMS}
SELECT a, b, jaccard, CAST(pairs AS BIGINT) AS pairs, 'token_shingles_not_semantic_equivalence' AS provenance FROM sims
UNION ALL SELECT a, b, jaccard, CAST(pairs AS BIGINT), 'shared_surface_not_semantic_equivalence' FROM decided WHERE reason = 'proposed'""",
)


# --- clusters ---------------------------------------------------------------------------------------

def _class_clusters(spark, folder):
    """(cid, copies, cluster) of classes that are similar to another or hold copies, and the edges between classes."""
    edges = cut_lineage(B.similar(spark, folder).select("a", "b"))
    links = edges.where(F.col("a") != F.col("b")).select(F.col("a").alias("u"), F.col("b").alias("v"))
    members = connected_components(links)
    own = B.classes(spark, folder).where(B.shingled()).select("cid", "copies").join(members, F.col("cid") == F.col("member"), "left")
    found = own.where(F.col("member").isNotNull() | (F.col("copies") > 1)).select("cid", "copies", F.coalesce("cluster", "cid").alias("cluster"))
    return cut_lineage(found), links


def similarity_clusters(spark, folder):
    """Connected components of similar units, long form: one row per unit, exact copies included."""
    clusters, _ = _class_clusters(spark, folder)
    written = cut_lineage(B.units(spark, folder).select("id", F.xxhash64("tokens").alias("key"), "lines"))
    first = written.groupBy("key", "lines").agg(F.min("id").alias("cid"))
    members = written.join(first, ["key", "lines"]).select(F.col("id").alias("member"), "cid")
    return members.join(clusters, "cid").select("member", "cluster")


_SQL_CLASS_CLUSTERS = f"""WITH RECURSIVE {B.SQL_CLASS_PAIRS},
e AS (SELECT a AS u, b AS v FROM sims WHERE a <> b UNION ALL SELECT b, a FROM sims WHERE a <> b),
reach(member, other) AS (SELECT u, u FROM e UNION SELECT r.member, e.v FROM reach r JOIN e ON e.u = r.other),
m AS (SELECT member, min(other) AS cluster FROM reach GROUP BY member
  UNION ALL SELECT cid, cid FROM classes WHERE copies > 1 AND len(items) > 0 AND cid NOT IN (SELECT u FROM e))"""
QUERIES["similarity_clusters"] = (
    similarity_clusters,
    f"{_SQL_CLASS_CLUSTERS} SELECT u.id AS member, cluster FROM m JOIN classes c ON c.cid = m.member JOIN units u ON u.tokens = c.tokens AND u.lines = c.lines",
)


def cluster_sizes(spark, folder):
    """Classes, units, links between classes and unit pairs those links and the copies stand for, per cluster."""
    clusters, links = _class_clusters(spark, folder)
    copies = F.col("copies")
    sizes = clusters.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("members"), F.sum("copies").alias("units"), F.sum(F.floor(copies * (copies - 1) / 2).cast("bigint")).alias("copy_pairs")
    )
    counts = links.join(clusters, F.col("u") == F.col("cid")).groupBy("cluster").agg(F.count(F.lit(1)).alias("edges"))
    return sizes.join(counts, "cluster", "left").withColumn("edges", F.coalesce("edges", F.lit(0).cast("bigint")))


QUERIES["cluster_sizes"] = (
    cluster_sizes,
    f"""{_SQL_CLASS_CLUSTERS},
c AS (SELECT cluster, count(*) AS edges FROM sims JOIN m ON m.member = a WHERE a <> b GROUP BY cluster)
SELECT cluster, CAST(count(*) AS BIGINT) AS members, CAST(sum(copies) AS BIGINT) AS units, CAST(sum(copies * (copies - 1) // 2) AS BIGINT) AS copy_pairs,
  CAST(coalesce(any_value(edges), 0) AS BIGINT) AS edges FROM m JOIN classes ON cid = member LEFT JOIN c USING (cluster) GROUP BY cluster""",
)


# --- pair features ----------------------------------------------------------------------------------

def pair_features(spark, folder):
    """Features of every similar pair; a class of copies is the row with a = b, and pairs counts what a row stands for."""
    pairs = cut_lineage(B.similar(spark, folder).select("a", "b", "jaccard", "pairs"))
    # Only members of a pair are shuffled to their pairs.
    words = semi_join(B.classes(spark, folder), S.members(pairs), "cid").select("cid", "lines", T.token_hashes(F.col("tokens")).alias("tokens"))
    rows = S.attach(pairs, words)
    a, b = F.col("tokens_a"), F.col("tokens_b")
    a_small = F.size(a) <= F.size(b)
    base = rows.select(
        "a", "b", "pairs", F.col("jaccard").alias("shingle_jaccard"), M.jaccard(F.array_distinct(a), F.array_distinct(b)).alias("vocab_jaccard"),
        F.least("lines_a", "lines_b").alias("min_lines"), M.size_ratio(F.col("lines_a"), F.col("lines_b")).alias("size_ratio"),
        F.least(F.size(a), F.size(b)).cast("bigint").alias("min_tokens"),
        F.when(a_small, a).otherwise(b).alias("small"), F.when(a_small, b).otherwise(a).alias("other"),
    )
    return S.with_coverage(base, {"coverage_10": K.COVERAGE_WIDTH, "coverage_50": K.COVERAGE_WIDTH_WIDE})


def _sql_cover(k: int) -> str:
    return f"""g{k} AS (SELECT a, b, i, array_to_string(sm[i:i+{k - 1}], ' ') AS g FROM
  (SELECT a, b, sm, unnest(range(1, len(sm) - {k - 2})) AS i FROM feat WHERE len(sm) >= {k})),
o{k} AS (SELECT DISTINCT a, b, array_to_string(ot[i:i+{k - 1}], ' ') AS g FROM
  (SELECT a, b, ot, unnest(range(1, len(ot) - {k - 2})) AS i FROM feat WHERE len(ot) >= {k})),
c{k} AS (SELECT a, b, count(DISTINCT p) AS covered FROM
  (SELECT a, b, unnest(range(i, i + {k})) AS p FROM g{k} JOIN o{k} USING (a, b, g)) GROUP BY a, b)"""


QUERIES["pair_features"] = (
    pair_features,
    f"""WITH {B.SQL_CLASS_PAIRS},
feat AS (SELECT s.a, s.b, s.pairs, s.jaccard, s.size_ratio, p.lines AS la, q.lines AS lb, p.tokens AS ta, q.tokens AS tb,
  CASE WHEN len(p.tokens) <= len(q.tokens) THEN p.tokens ELSE q.tokens END AS sm,
  CASE WHEN len(p.tokens) <= len(q.tokens) THEN q.tokens ELSE p.tokens END AS ot
  FROM sims s JOIN classes p ON p.cid = s.a JOIN classes q ON q.cid = s.b),
{_sql_cover(10)}, {_sql_cover(50)}
SELECT f.a, f.b, CAST(f.pairs AS BIGINT) AS pairs, f.jaccard AS shingle_jaccard,
  len(list_intersect(ta, tb)) / CAST(greatest(len(list_distinct(ta)) + len(list_distinct(tb)) - len(list_intersect(ta, tb)), 1) AS DOUBLE) AS vocab_jaccard,
  CASE WHEN len(sm) > 0 THEN CAST(coalesce(c10.covered, 0) AS DOUBLE) / len(sm) ELSE CAST(0 AS DOUBLE) END AS coverage_10,
  CASE WHEN len(sm) > 0 THEN CAST(coalesce(c50.covered, 0) AS DOUBLE) / len(sm) ELSE CAST(0 AS DOUBLE) END AS coverage_50,
  CAST(least(la, lb) AS BIGINT) AS min_lines, f.size_ratio, CAST(len(sm) AS BIGINT) AS min_tokens
FROM feat f LEFT JOIN c10 USING (a, b) LEFT JOIN c50 USING (a, b)""",
)


def shape_similarity_pairs(spark, folder):
    """Histogram similarity of the similar pairs; a class of copies is the row with a = b."""
    # The pairs are counted for hot members and joined on both sides, so they are found once and written.
    rows = cut_lineage(B.similar(spark, folder).select("a", "b", "pairs"))
    profiles = semi_join(B.classes(spark, folder).select("cid", "tokens"), S.members(rows), "cid")
    joined = S.attach(rows, S.with_length_shape(profiles).select("cid", "shape"))
    return joined.select("a", "b", "pairs", M.shape_similarity(F.col("shape_a"), F.col("shape_b")).alias("shape_similarity"))


QUERIES["shape_similarity_pairs"] = (
    shape_similarity_pairs,
    f"""WITH {B.SQL_CLASS_PAIRS},
hist AS (SELECT cid, len(t) AS k, count(*) AS n FROM (SELECT cid, unnest(tokens) AS t FROM classes) GROUP BY 1, 2),
tot AS (SELECT cid, sum(n) AS n FROM hist GROUP BY cid),
lo AS (SELECT a, b, any_value(pairs) AS pairs, sum(least(x.n, y.n)) AS lo FROM sims JOIN hist x ON x.cid = a JOIN hist y ON y.cid = b AND y.k = x.k GROUP BY 1, 2)
SELECT a, b, CAST(pairs AS BIGINT) AS pairs, CAST(lo AS DOUBLE) / CAST(tp.n + tq.n - lo AS DOUBLE) AS shape_similarity FROM lo JOIN tot tp ON tp.cid = a JOIN tot tq ON tq.cid = b""",
)


def tail_pairs(spark, folder):
    """Pairs in a half-open Jaccard range, no line ratio asked."""
    sets = B.classes(spark, folder).where(B.shingled()).select("cid", "lines", "copies", "items")
    return S.bounded_pairs(sets, 0.3, 0.8)


QUERIES["tail_pairs"] = (
    tail_pairs,
    f"WITH {B.SQL_CLASS_PAIRS} SELECT a, b, jaccard, CAST(pairs AS BIGINT) AS pairs FROM pj WHERE jaccard >= CAST(0.3 AS DOUBLE) AND jaccard < CAST(0.8 AS DOUBLE)",
)
