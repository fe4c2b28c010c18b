"""Ranking, agreement, resampling and threshold statistics on documents and their labels.

``quality`` and ``toxic`` stand for two labelers, hash scores for two runs of a scorer, ``source`` for the
project and ``lang`` for the set or question.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom import constants as K
from pairloom.functions import measures as M
from pairloom.functions import text as T
from pairloom.operators import stats as S
from pairloom.operators.ordered import first_n
from pairloom.plans import bindings as B
from pairloom.session import cut_lineage
from pairloom.sources.tables import table

QUERIES: dict = {}
CUT = K.DEFAULT_CUT
RESAMPLES = K.BOOTSTRAP_RESAMPLES


def D(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def run_scores(df, key="id"):
    """Two runs of a scorer in hundredths, and the choices they would record."""
    first = T.two_decimals(T.unit_hash(F.lit("run1"), F.col(key)))
    shifted = F.col("p1") + (T.unit_hash(F.lit("run2"), F.col(key)) - F.lit(0.5)) * F.lit(0.2)
    out = df.withColumn("p1", first)
    out = out.withColumn("p2", T.two_decimals(F.greatest(F.lit(0.0), F.least(F.lit(1.0), shifted))))
    for n in ("1", "2"):
        skip = T.unit_hash(F.lit(f"ins{n}"), F.col(key)) < 0.05
        out = out.withColumn(
            f"choice{n}", F.when(skip, "insufficient").when(F.col(f"p{n}") >= 0.5, "present").otherwise("absent")
        )
    return out


def scored(spark, folder):
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), "lang", "source", "n_chars", T.line_count(F.col("text")).alias("lines")
    )
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    return run_scores(docs.join(labels, "id"))


def _sql_run(key="id"):
    h = lambda tag: B.sql_unit_hash(f"'{tag}'", key)
    return f"""s1 AS (SELECT *, {B.sql_two(h('run1'))} AS p1 FROM s0),
s2 AS (SELECT *, {B.sql_two(f"greatest({D(0)}, least({D(1)}, p1 + ({h('run2')} - {D(0.5)}) * {D(0.2)}))")} AS p2 FROM s1),
s AS (SELECT *, CASE WHEN {h('ins1')} < {D(0.05)} THEN 'insufficient' WHEN p1 >= {D(0.5)} THEN 'present' ELSE 'absent' END AS choice1,
  CASE WHEN {h('ins2')} < {D(0.05)} THEN 'insufficient' WHEN p2 >= {D(0.5)} THEN 'present' ELSE 'absent' END AS choice2 FROM s2)"""


SQL_S = f"""s0 AS (SELECT d.doc_id AS id, lang, source, n_chars, {B.sql_lines('text')} AS lines, quality, toxic
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id), {_sql_run()}"""

SCORERS = ("hash", "rerun", "lines", "n_chars", "oracle", "inverse")


def by_scorer(df):
    """Long form: one row per item and scorer."""
    values = {
        "hash": F.col("p1"), "rerun": F.col("p2"), "lines": F.col("lines").cast("double"), "n_chars": F.col("n_chars").cast("double"),
        "oracle": F.when(F.col("quality") == 1, F.lit(0.9)).otherwise(F.lit(0.1)),
        "inverse": F.when(F.col("quality") == 1, F.lit(0.1)).otherwise(F.lit(0.9)),
    }
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("scorer"), v.alias("score")) for n, v in values.items()]))
    return df.select("*", pairs.alias("_x")).select(*df.columns, "_x.scorer", "_x.score")


SQL_LONG = f"""{SQL_S}, lg AS (SELECT *, 'hash' AS scorer, p1 AS score FROM s UNION ALL SELECT *, 'rerun', p2 FROM s
 UNION ALL SELECT *, 'lines', CAST(lines AS DOUBLE) FROM s UNION ALL SELECT *, 'n_chars', CAST(n_chars AS DOUBLE) FROM s
 UNION ALL SELECT *, 'oracle', CASE WHEN quality = 1 THEN {D(0.9)} ELSE {D(0.1)} END FROM s
 UNION ALL SELECT *, 'inverse', CASE WHEN quality = 1 THEN {D(0.1)} ELSE {D(0.9)} END FROM s)"""


def _sql_auc(source: str, keys: str, label: str = "quality", score: str = "score") -> str:
    """Pair-counting AUC, a different route than the ordered histogram."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    sel = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"""(SELECT {sel}, sum(CASE WHEN a.{score} > b.{score} THEN {D(1)} WHEN a.{score} = b.{score} THEN {D(0.5)} ELSE {D(0)} END) / count(*) AS auc
  FROM {source} a JOIN {source} b ON {on} WHERE a.{label} = 1 AND b.{label} <> 1 GROUP BY {sel})"""


def auc_by_lang(spark, folder):
    return S.auc(by_scorer(scored(spark, folder)), ["lang", "scorer"], "score", "quality")


QUERIES["auc_by_lang"] = (
    auc_by_lang,
    f"""WITH {SQL_LONG} SELECT lang, scorer, CAST(count_if(quality = 1) AS BIGINT) AS positives, CAST(count_if(quality <> 1) AS BIGINT) AS negatives,
  any_value(x.auc) AS auc FROM lg LEFT JOIN {_sql_auc('lg', 'lang, scorer')} x USING (lang, scorer) GROUP BY lang, scorer""",
)


def _equal_k(rows):
    return rows.groupBy("lang").agg(F.count_if(F.col("p1") >= CUT).cast("bigint").alias("k")).where(F.col("k") > 0)


def precision_at_k_ties(spark, folder):
    """Each scorer judged at as many rows as the first run puts above the cut."""
    rows = scored(spark, folder)
    k = by_scorer(_equal_k(rows).withColumn("quality", F.lit(0)).withColumn("p1", F.lit(0.0)).withColumn("p2", F.lit(0.0)).withColumn("lines", F.lit(0)).withColumn("n_chars", F.lit(0)))
    return S.precision_at_k(by_scorer(rows), ["lang", "scorer"], "score", "quality", k.select("lang", "scorer", "k"))


SQL_PK = f"""kk AS (SELECT lang, count_if(p1 >= {D(CUT)}) AS k FROM s GROUP BY lang),
o AS (SELECT lg.lang, scorer, score, quality, k, row_number() OVER (PARTITION BY lg.lang, scorer ORDER BY score DESC, id) AS rn FROM lg JOIN kk ON kk.lang = lg.lang WHERE k > 0),
ed AS (SELECT lang, scorer, score AS edge FROM o WHERE rn = k),
pk AS (SELECT o.lang, scorer, any_value(k) AS k, (CAST(count_if(score > edge AND quality = 1) AS DOUBLE) + CAST((any_value(k) - count_if(score > edge)) * count_if(score = edge AND quality = 1) AS DOUBLE)
  / count_if(score = edge)) / any_value(k) AS precision FROM o JOIN ed USING (lang, scorer) GROUP BY o.lang, scorer)"""
QUERIES["precision_at_k_ties"] = (
    precision_at_k_ties,
    f"WITH {SQL_LONG}, {SQL_PK} SELECT lang, scorer, CAST(k AS BIGINT) AS k, precision FROM pk",
)


def wilson_by_lang(spark, folder):
    rows = scored(spark, folder).groupBy("lang").agg(
        F.count_if(F.col("quality") == 1).cast("bigint").alias("k"), F.count(F.lit(1)).alias("n")
    )
    low, high = M.wilson(F.col("k"), F.col("n"))
    return rows.select(
        "lang", "k", "n", M.rate(F.col("k"), F.col("n")).alias("rate"), low.alias("lo"), high.alias("hi"),
        M.noise_floor(F.col("n")).alias("noise_floor"), M.with_noise(F.col("k"), F.col("n")).alias("text"),
    )


def sql_wilson(k: str, n: str) -> tuple[str, str]:
    p, z2 = f"({D(k)} / {D(n)})", D(K.WILSON_Z * K.WILSON_Z)
    den = f"({D(1)} + {z2} / {D(n)})"
    center = f"(({p} + {z2} / ({D(2)} * {D(n)})) / {den})"
    half = f"({D(K.WILSON_Z)} * sqrt(({p} * ({D(1)} - {p})) / {D(n)} + {z2} / ({D(4)} * {D(n)} * {D(n)})) / {den})"
    return (
        f"CASE WHEN {n} > 0 THEN greatest({D(0)}, {center} - {half}) END",
        f"CASE WHEN {n} > 0 THEN least({D(1)}, {center} + {half}) END",
    )


def sql_pct(x: str) -> str:
    return f"(CAST(CAST(floor({x} * 100 + {D(0.5)}) AS BIGINT) AS VARCHAR) || '%')"


_lo, _hi = sql_wilson("k", "n")
QUERIES["wilson_by_lang"] = (
    wilson_by_lang,
    f"""WITH {SQL_S}, c AS (SELECT lang, count_if(quality = 1) AS k, count(*) AS n FROM s GROUP BY lang)
SELECT lang, CAST(k AS BIGINT) AS k, CAST(n AS BIGINT) AS n, {D('k')} / {D('n')} AS rate, {_lo} AS lo, {_hi} AS hi, {D(1)} / sqrt({D('n')}) AS noise_floor,
  k || '/' || n || ' = ' || {sql_pct(f"{D('k')} / {D('n')}")} || ' ±' || {sql_pct(f"({D(1)} / sqrt({D('n')}))")} || ' noise floor' AS text FROM c""",
)


def kappa_quality_toxic(spark, folder):
    rows = scored(spark, folder).select("lang", F.col("quality").alias("first"), F.col("toxic").alias("second"))
    return S.cohen_kappa(rows, ["lang"], "first", "second")


QUERIES["kappa_quality_toxic"] = (
    kappa_quality_toxic,
    f"""WITH {SQL_S}, n AS (SELECT lang, count(*) AS n, count_if(quality = toxic) AS agree FROM s GROUP BY lang),
a AS (SELECT lang, quality AS l, count(*) AS c FROM s GROUP BY 1, 2), b AS (SELECT lang, toxic AS l, count(*) AS c FROM s GROUP BY 1, 2),
e AS (SELECT lang, sum(a.c * b.c) AS pr FROM a JOIN b USING (lang, l) GROUP BY lang),
o AS (SELECT n.lang, n, agree, agree / {D('n')} AS observed, CAST(coalesce(pr, 0) AS DOUBLE) / ({D('n')} * {D('n')}) AS expected FROM n LEFT JOIN e ON e.lang = n.lang)
SELECT lang, CAST(n AS BIGINT) AS n, CAST(agree AS BIGINT) AS agree, observed AS agreement,
  CASE WHEN expected = 1 THEN {D(1)} ELSE (observed - expected) / ({D(1)} - expected) END AS kappa FROM o""",
)


def confusion_quality_toxic(spark, folder):
    return S.confusion(scored(spark, folder), ["lang"], "quality", "toxic")


QUERIES["confusion_quality_toxic"] = (
    confusion_quality_toxic,
    f"WITH {SQL_S} SELECT lang, quality, toxic, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY 1, 2, 3",
)


def binary_metrics(spark, folder):
    return S.binary_metrics(scored(spark, folder), ["lang"], F.col("p1") >= CUT, F.col("quality") == 1)


def _sql_rates() -> str:
    out = []
    for name, k, n in (("recall", "tp", "(tp + fn)"), ("false_positive_rate", "fp", "(tn + fp)"), ("precision", "tp", "(tp + fp)"), ("accuracy", "(tp + tn)", "(tp + fp + tn + fn)")):
        lo, hi = sql_wilson(k, n)
        out.append(f"CASE WHEN {n} > 0 THEN {D(k)} / {D(n)} END AS {name}, {lo} AS {name}_lo, {hi} AS {name}_hi")
    return ", ".join(out)


SQL_BINARY = f"""c AS (SELECT lang, count_if(p1 >= {D(CUT)} AND quality = 1) AS tp, count_if(p1 >= {D(CUT)} AND quality <> 1) AS fp,
  count_if(p1 < {D(CUT)} AND quality <> 1) AS tn, count_if(p1 < {D(CUT)} AND quality = 1) AS fn FROM s GROUP BY lang)
SELECT lang, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn, {_sql_rates()},
  {D('greatest(tp + fn, tn + fp)')} / {D('(tp + fp + tn + fn)')} AS majority_baseline, {D(1)} / sqrt({D('(tp + fp + tn + fn)')}) AS noise_floor FROM c"""
QUERIES["binary_metrics"] = (binary_metrics, f"WITH {SQL_S}, {SQL_BINARY}")


# --- repeats ----------------------------------------------------------------------------------------

THRESHOLD, RULE = K.VARIANCE["threshold"], K.VARIANCE["rule"]


def repeat_cells(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    p1, p2 = F.col("p1"), F.col("p2")
    return run_scores(docs).select(
        "id", "lang", "source", "p1", "p2", F.abs(p1 - p2).alias("delta"), (F.col("choice1") != F.col("choice2")).alias("flip"),
        ((p1 >= CUT) != (p2 >= CUT)).alias("crosses_cut"),
        ((F.col("choice1") == "insufficient") != (F.col("choice2") == "insufficient")).alias("insufficient_once"),
    )


SQL_REPEAT = f"""s0 AS (SELECT doc_id AS id, lang, source FROM documents), {_sql_run()},
rc AS (SELECT id, lang, source, p1, p2, abs(p1 - p2) AS delta, choice1 <> choice2 AS flip, (p1 >= {D(CUT)}) <> (p2 >= {D(CUT)}) AS crosses_cut,
  (choice1 = 'insufficient') <> (choice2 = 'insufficient') AS insufficient_once FROM s)"""
QUERIES["variance_cells"] = (repeat_cells, f"WITH {SQL_REPEAT} SELECT * FROM rc")


def variance_summary(spark, folder):
    """Per set: cells over the threshold, flips, crossings, and whether the repeat rule fires."""
    over = F.col("delta") > THRESHOLD + K.DELTA_EPSILON
    hundredths = F.floor(F.col("delta") * 100 + F.lit(0.5)).cast("bigint")
    rows = repeat_cells(spark, folder).groupBy("lang").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(over).cast("bigint").alias("over"), F.max("delta").alias("max_delta"),
        F.sum(hundredths).alias("_sum"), F.count_if("flip").cast("bigint").alias("flips"),
        F.count_if("crosses_cut").cast("bigint").alias("crossings"), F.count_if("insufficient_once").cast("bigint").alias("insufficient_once"),
    )
    n = F.col("cells")
    return rows.select(
        "lang", "cells", "over", M.rate(F.col("over"), n).alias("share_over"), "max_delta",
        (F.col("_sum").cast("double") / F.lit(100.0) / n).alias("mean_delta"), "flips", "crossings", "insufficient_once",
        M.noise_floor(n).alias("noise_floor"), (M.rate(F.col("over"), n) > RULE).alias("rule_triggered"),
    )


QUERIES["variance_summary"] = (
    variance_summary,
    f"""WITH {SQL_REPEAT}, c AS (SELECT lang, count(*) AS cells, count_if(delta > {D(THRESHOLD + K.DELTA_EPSILON)}) AS over, max(delta) AS max_delta,
  sum(CAST(floor(delta * 100 + {D(0.5)}) AS BIGINT)) AS sm, count_if(flip) AS flips, count_if(crosses_cut) AS crossings, count_if(insufficient_once) AS io FROM rc GROUP BY lang)
SELECT lang, CAST(cells AS BIGINT) AS cells, CAST(over AS BIGINT) AS over, {D('over')} / {D('cells')} AS share_over, max_delta, {D('sm')} / {D(100)} / cells AS mean_delta,
  CAST(flips AS BIGINT) AS flips, CAST(crossings AS BIGINT) AS crossings, CAST(io AS BIGINT) AS insufficient_once, {D(1)} / sqrt({D('cells')}) AS noise_floor,
  {D('over')} / {D('cells')} > {D(RULE)} AS rule_triggered FROM c""",
)


def variance_worst(spark, folder):
    """The five cells per set that moved most."""
    return first_n(repeat_cells(spark, folder).select("lang", "id", "p1", "p2", "delta"), ["lang"], [F.col("delta").desc(), "id"], 5).withColumn(
        "rank", F.col("rank").cast("bigint")
    )


QUERIES["variance_worst"] = (
    variance_worst,
    f"""WITH {SQL_REPEAT}, r AS (SELECT lang, id, p1, p2, delta, CAST(row_number() OVER (PARTITION BY lang ORDER BY delta DESC, id) AS BIGINT) AS rank FROM rc)
SELECT * FROM r WHERE rank <= 5""",
)


def retest_summary(spark, folder):
    """Change between two runs per set and over all sets."""
    rows = repeat_cells(spark, folder)
    x, y = (F.floor(F.col(c) * 100 + F.lit(0.5)).cast("bigint") for c in ("p1", "p2"))
    rows = rows.withColumn("x", x).withColumn("y", y)
    def crossing(t):
        return F.count_if((F.col("p1") >= t) != (F.col("p2") >= t)).cast("bigint")

    sums = rows.rollup("lang").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.abs(F.col("y") - F.col("x"))).alias("_abs"), F.max(F.abs(F.col("y") - F.col("x"))).alias("_max"),
        F.sum(F.col("y") - F.col("x")).alias("_signed"), F.count_if(F.abs(F.col("y") - F.col("x")) > 5).cast("bigint").alias("over_005"),
        F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("y")).alias("sxy"),
        F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("y") * F.col("y")).alias("syy"),
        F.count_if("flip").cast("bigint").alias("flips"), crossing(0.5).alias("crossing_05"), crossing(0.7).alias("crossing_07"),
    )
    d = lambda c: F.col(c).cast("double")
    cov = d("n") * d("sxy") - d("sx") * d("sy")
    var = F.sqrt(d("n") * d("sxx") - d("sx") * d("sx")) * F.sqrt(d("n") * d("syy") - d("sy") * d("sy"))
    return sums.select(
        F.coalesce("lang", F.lit("all")).alias("lang"), "n", (d("_abs") / 100.0 / d("n")).alias("mean_abs_change"), (d("_max") / 100.0).alias("max_abs_change"),
        (d("_signed") / 100.0 / d("n")).alias("mean_signed_change"), "over_005", F.when(var > 0, cov / var).alias("correlation"),
        "flips", "crossing_05", "crossing_07",
    )


QUERIES["retest_summary"] = (
    retest_summary,
    f"""WITH {SQL_REPEAT}, q AS (SELECT *, CAST(floor(p1 * 100 + {D(0.5)}) AS BIGINT) AS x, CAST(floor(p2 * 100 + {D(0.5)}) AS BIGINT) AS y FROM rc),
g AS (SELECT lang, count(*) AS n, sum(abs(y - x)) AS ab, max(abs(y - x)) AS mx, sum(y - x) AS sg, count_if(abs(y - x) > 5) AS o5, sum(x) AS sx, sum(y) AS sy, sum(x * y) AS sxy,
  sum(x * x) AS sxx, sum(y * y) AS syy, count_if(flip) AS fl, count_if((p1 >= {D(0.5)}) <> (p2 >= {D(0.5)})) AS c5, count_if((p1 >= {D(0.7)}) <> (p2 >= {D(0.7)})) AS c7 FROM q GROUP BY ROLLUP (lang)),
v AS (SELECT *, {D('n')} * {D('sxy')} - {D('sx')} * {D('sy')} AS cov, sqrt({D('n')} * {D('sxx')} - {D('sx')} * {D('sx')}) * sqrt({D('n')} * {D('syy')} - {D('sy')} * {D('sy')}) AS var FROM g)
SELECT coalesce(lang, 'all') AS lang, CAST(n AS BIGINT) AS n, {D('ab')} / {D(100)} / {D('n')} AS mean_abs_change, {D('mx')} / {D(100)} AS max_abs_change, {D('sg')} / {D(100)} / {D('n')} AS mean_signed_change,
  CAST(o5 AS BIGINT) AS over_005, CASE WHEN var > 0 THEN cov / var END AS correlation, CAST(fl AS BIGINT) AS flips, CAST(c5 AS BIGINT) AS crossing_05, CAST(c7 AS BIGINT) AS crossing_07 FROM v""",
)


def sign_test(spark, folder):
    """Per project: how often the rerun scored higher or lower, and the exact test of that."""
    rows = repeat_cells(spark, folder).groupBy("source").agg(
        F.count_if(F.col("p2") > F.col("p1")).cast("bigint").alias("higher"), F.count_if(F.col("p2") < F.col("p1")).cast("bigint").alias("lower"),
        F.count_if(F.col("p2") == F.col("p1")).cast("bigint").alias("tied"),
    )
    return S.sign_test(cut_lineage(rows), ["source"], "higher", "lower").withColumn("sign_test_p", M.rounded(F.col("sign_test_p"), 9))


QUERIES["sign_test"] = (
    sign_test,
    f"""WITH {SQL_REPEAT}, c AS (SELECT source, count_if(p2 > p1) AS hi, count_if(p2 < p1) AS lo, count_if(p2 = p1) AS ti FROM rc GROUP BY source),
t AS (SELECT source, hi + lo AS n, hi AS k, unnest(range(0, CAST(hi + lo + 1 AS BIGINT))) AS i FROM c),
m AS (SELECT source, i, k, exp(lgamma({D('n')} + 1) - lgamma({D('i')} + 1) - lgamma({D('n')} - i + 1) - n * ln({D(2)})) AS p FROM t),
o AS (SELECT source, p AS seen FROM m WHERE i = k),
z AS (SELECT source, least({D(1)}, sum(p)) AS sp FROM m JOIN o USING (source) WHERE p <= seen + {D('1e-9')} * seen + {D('1e-12')} GROUP BY source)
SELECT source, CAST(hi AS BIGINT) AS higher, CAST(lo AS BIGINT) AS lower, CAST(ti AS BIGINT) AS tied, floor(sp * {D('1e9')} + {D(0.5)}) / {D('1e9')} AS sign_test_p FROM c LEFT JOIN z USING (source)""",
)


# --- bootstrap --------------------------------------------------------------------------------------

def sql_mulberry(seed: str, draw: str) -> str:
    """Subquery-free text of the 32-bit generator, as nested lateral selects on one row."""
    m = "4294967295"
    imul = lambda a, b: f"((({a} & 65535) * ({b}) + (((({a} >> 16) * ({b})) & 65535) << 16)) & {m})"
    a = f"((({seed} & {m}) + (((({draw}) + 1) & {m}) * 1831565813 & {m})) & {m})"
    t1 = lambda x: imul(f"xor({x}, {x} >> 15)", f"({x} | 1)")
    t2 = lambda x: f"xor({x}, ({x} + {imul(f'xor({x}, {x} >> 7)', f'({x} | 61)')}) & {m})"
    return a, t1, t2


def sql_draws(items: str, keys: str, seed: int, resamples: int) -> str:
    """CTEs it, dr, w: items numbered per group, draws and weights."""
    a, t1, t2 = sql_mulberry(str(seed), "CAST(replicate AS BIGINT) * n + j")
    return f"""sz AS (SELECT {keys}, count(*) AS n FROM {items} GROUP BY {keys}),
d0 AS (SELECT {keys}, n, replicate, unnest(range(0, CAST(n AS BIGINT))) AS j FROM (SELECT {keys}, n, unnest(range(0, {resamples})) AS replicate FROM sz)),
d1 AS (SELECT *, CAST({a} AS BIGINT) AS x FROM d0), d2 AS (SELECT *, {t1('x')} AS y FROM d1), d3 AS (SELECT *, {t2('y')} AS z FROM d2),
w AS (SELECT {keys}, replicate, CAST(floor(CAST(xor(z, z >> 14) AS DOUBLE) / {D(4294967296)} * n) AS BIGINT) AS idx, count(*) AS weight FROM d3 GROUP BY ALL)"""


def sql_boot_auc(rows: str, keys: str) -> str:
    """CTE ba: weighted AUC per group and replicate, by ordered histogram."""
    return f"""hh AS (SELECT {keys}, replicate, score, sum(CASE WHEN y = 1 THEN weight ELSE 0 END) AS pos, sum(CASE WHEN y <> 1 THEN weight ELSE 0 END) AS neg FROM {rows} GROUP BY ALL),
hc AS (SELECT *, sum(neg) OVER (PARTITION BY {keys}, replicate ORDER BY score) - neg AS below FROM hh),
ba AS (SELECT {keys}, replicate, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN CAST(sum(pos * (2 * below + neg)) AS DOUBLE) / ({D('sum(pos)')} * {D('sum(neg)')} * {D(2)}) END AS auc FROM hc GROUP BY {keys}, replicate)"""


def sql_interval(values: str, keys: str, value: str, lo: str, hi: str, cond: str = "TRUE") -> str:
    return f"""SELECT {keys}, CAST(count(*) AS BIGINT) AS draws, CASE WHEN {cond} THEN list_sort(list({value}))[CAST({lo} AS BIGINT) + 1] END AS lo,
  CASE WHEN {cond} THEN list_sort(list({value}))[CAST({hi} AS BIGINT) + 1] END AS hi FROM {values} WHERE {value} IS NOT NULL GROUP BY {keys}"""


LOOSE = (f"least(count(*) - 1, floor(count(*) * {D(0.025)}))", f"least(count(*) - 1, floor(count(*) * {D(0.975)}))")
STRICT = (f"floor((count(*) - 1) * {D(0.025)})", f"ceil((count(*) - 1) * {D(0.975)})")


def bootstrap_auc_ci(spark, folder):
    """Percentile interval of the AUC per set, from the seeded generator."""
    draws = S.bootstrap_auc(scored(spark, folder).withColumnRenamed("p1", "score"), ["lang"], "score", "quality", RESAMPLES, F.lit(K.BOOTSTRAP_SEED))
    return S.percentile_interval_strict(cut_lineage(draws), ["lang"], "auc")


SQL_BOOT = f"""{SQL_S}, it AS (SELECT lang, p1 AS score, quality AS y, row_number() OVER (PARTITION BY lang ORDER BY quality, p1) - 1 AS idx FROM s),
{sql_draws('it', 'lang', K.BOOTSTRAP_SEED, RESAMPLES)}, rw AS (SELECT * FROM w JOIN it USING (lang, idx)), {sql_boot_auc('rw', 'lang')}"""
QUERIES["bootstrap_auc_ci"] = (bootstrap_auc_ci, f"WITH {SQL_BOOT} {sql_interval('ba', 'lang', 'auc', *STRICT, cond='count(*) >= 20')}")


def clustered_bootstrap(spark, folder):
    """Resamples whole projects: every row of a drawn project comes along."""
    rows = cut_lineage(scored(spark, folder).select("lang", "source", F.col("p1").alias("score"), "quality"))
    clusters = rows.select("lang", "source").distinct()
    weights = S.resample_weights(clusters, ["lang"], ["source"], RESAMPLES, F.lit(K.BOOTSTRAP_SEED))
    cells = rows.groupBy("lang", "source", "score", "quality").agg(F.count(F.lit(1)).alias("_rows"))
    draws = S.auc(weights.join(cells, ["lang", "source"]), ["lang", "replicate"], "score", "quality", weight=F.col("weight") * F.col("_rows"))
    return S.percentile_interval(cut_lineage(draws.select("lang", "replicate", "auc")), ["lang"], "auc")


QUERIES["clustered_bootstrap"] = (
    clustered_bootstrap,
    f"""WITH {SQL_S}, it AS (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY source) - 1 AS idx FROM (SELECT DISTINCT lang, source FROM s)),
{sql_draws('it', 'lang', K.BOOTSTRAP_SEED, RESAMPLES)},
rw AS (SELECT w.lang, replicate, weight, s.p1 AS score, s.quality AS y FROM w JOIN it USING (lang, idx) JOIN s ON s.lang = w.lang AND s.source = it.source), {sql_boot_auc('rw', 'lang')}
{sql_interval('ba', 'lang', 'auc', *LOOSE)}""",
)


def paired_bootstrap(spark, folder):
    """Mean change per pair with its interval; sums stay integers, in hundredths."""
    rows = repeat_cells(spark, folder)
    delta = F.floor(F.col("p2") * 100 + F.lit(0.5)).cast("bigint") - F.floor(F.col("p1") * 100 + F.lit(0.5)).cast("bigint")
    items = cut_lineage(rows.select("lang", "id", delta.alias("delta")))
    weights = S.resample_cells(items, ["lang"], ["delta"], RESAMPLES, F.lit(K.BOOTSTRAP_SEED))
    means = weights.groupBy("lang", "replicate").agg(
        (F.sum(F.col("weight") * F.col("delta")).cast("double") / F.lit(100.0) / F.sum("weight")).alias("mean_delta")
    )
    whole = items.groupBy("lang").agg(
        (F.sum("delta").cast("double") / F.lit(100.0) / F.count(F.lit(1))).alias("mean_delta"),
        F.count_if(F.col("delta") > 0).cast("bigint").alias("higher"), F.count_if(F.col("delta") < 0).cast("bigint").alias("lower"),
        F.count_if(F.col("delta") == 0).cast("bigint").alias("tied"),
    )
    return whole.join(S.percentile_interval(cut_lineage(means), ["lang"], "mean_delta"), "lang")


QUERIES["paired_bootstrap"] = (
    paired_bootstrap,
    f"""WITH {SQL_REPEAT}, it AS (SELECT lang, CAST(floor(p2 * 100 + {D(0.5)}) AS BIGINT) - CAST(floor(p1 * 100 + {D(0.5)}) AS BIGINT) AS delta,
  row_number() OVER (PARTITION BY lang ORDER BY p2_p1) - 1 AS idx FROM (SELECT *, CAST(floor(p2 * 100 + {D(0.5)}) AS BIGINT) - CAST(floor(p1 * 100 + {D(0.5)}) AS BIGINT) AS p2_p1 FROM rc)), {sql_draws('it', 'lang', K.BOOTSTRAP_SEED, RESAMPLES)},
mm AS (SELECT w.lang, replicate, {D('sum(weight * delta)')} / {D(100)} / sum(weight) AS md FROM w JOIN it USING (lang, idx) GROUP BY 1, 2),
ci AS ({sql_interval('mm', 'lang', 'md', *LOOSE)}),
wh AS (SELECT lang, {D('sum(delta)')} / {D(100)} / count(*) AS mean_delta, CAST(count_if(delta > 0) AS BIGINT) AS higher, CAST(count_if(delta < 0) AS BIGINT) AS lower, CAST(count_if(delta = 0) AS BIGINT) AS tied FROM it GROUP BY lang)
SELECT lang, mean_delta, higher, lower, tied, draws, lo, hi FROM wh JOIN ci USING (lang)""",
)


# --- analyses ---------------------------------------------------------------------------------------

def contrast_sets(spark, folder):
    """Per set and scorer: AUC with interval; whether the scorer is matched (interval holds one half)."""
    rows = cut_lineage(by_scorer(scored(spark, folder)).where(F.col("scorer").isin("hash", "lines")).select("lang", "scorer", "id", "score", "quality"))
    point = S.auc(rows, ["lang", "scorer"], "score", "quality")
    draws = cut_lineage(S.bootstrap_auc(rows, ["lang", "scorer"], "score", "quality", RESAMPLES, F.lit(K.BOOTSTRAP_SEED)))
    interval = S.percentile_interval(draws, ["lang", "scorer"], "auc")
    return point.join(interval.drop("draws"), ["lang", "scorer"]).withColumn("holds_half", (F.col("lo") <= 0.5) & (F.col("hi") >= 0.5))


def _sql_contrast(order: str) -> str:
    return f"""{SQL_LONG}, it AS (SELECT lang, scorer, score, quality AS y, row_number() OVER (PARTITION BY lang, scorer ORDER BY {order}) - 1 AS idx FROM lg WHERE scorer IN ('hash', 'lines')),
{sql_draws('it', 'lang, scorer', K.BOOTSTRAP_SEED, RESAMPLES)}, rw AS (SELECT * FROM w JOIN it USING (lang, scorer, idx)), {sql_boot_auc('rw', 'lang, scorer')},
ci AS ({sql_interval('ba', 'lang, scorer', 'auc', *LOOSE)}),
pt AS (SELECT lang, scorer, CAST(count_if(quality = 1) AS BIGINT) AS positives, CAST(count_if(quality <> 1) AS BIGINT) AS negatives, any_value(x.auc) AS auc
  FROM lg LEFT JOIN {_sql_auc('lg', 'lang, scorer')} x USING (lang, scorer) GROUP BY lang, scorer)"""


SQL_CONTRAST, SQL_CONTRAST_PAIRED = _sql_contrast("quality, score"), _sql_contrast("id")
QUERIES["contrast_sets"] = (
    contrast_sets,
    f"WITH {SQL_CONTRAST} SELECT lang, scorer, positives, negatives, auc, lo, hi, lo <= {D(0.5)} AND hi >= {D(0.5)} AS holds_half FROM pt JOIN ci USING (lang, scorer)",
)


def contrast_means(spark, folder):
    """Mean score per class, rates at the cut, and the AUC without insufficient answers."""
    rows = scored(spark, folder)
    cents = F.floor(F.col("p1") * 100 + F.lit(0.5)).cast("bigint")
    pos = F.col("quality") == 1
    base = rows.withColumn("c", cents).groupBy("lang").agg(
        F.count_if(pos).cast("bigint").alias("positives"), F.count_if(~pos).cast("bigint").alias("controls"),
        (F.sum(F.when(pos, F.col("c"))).cast("double") / 100.0 / F.count_if(pos)).alias("mean_positive"),
        (F.sum(F.when(~pos, F.col("c"))).cast("double") / 100.0 / F.count_if(~pos)).alias("mean_control"),
        (F.count_if(pos & (F.col("p1") >= CUT)).cast("double") / F.count_if(pos)).alias("positive_rate"),
        (F.count_if(~pos & (F.col("p1") >= CUT)).cast("double") / F.count_if(~pos)).alias("control_rate"),
    )
    kept = rows.where(F.col("choice1") != "insufficient")
    strict = S.auc(kept, ["lang"], "p1", "quality").select("lang", (F.col("positives") + F.col("negatives")).alias("n_sufficient"), F.col("auc").alias("auc_sufficient"))
    return base.join(strict, "lang", "left")


QUERIES["contrast_means"] = (
    contrast_means,
    f"""WITH {SQL_S}, k AS (SELECT * FROM s WHERE choice1 <> 'insufficient'), b AS (SELECT lang, count_if(quality = 1) AS po, count_if(quality <> 1) AS co,
  sum(CASE WHEN quality = 1 THEN CAST(floor(p1 * 100 + {D(0.5)}) AS BIGINT) END) AS sp, sum(CASE WHEN quality <> 1 THEN CAST(floor(p1 * 100 + {D(0.5)}) AS BIGINT) END) AS sc,
  count_if(quality = 1 AND p1 >= {D(CUT)}) AS pc, count_if(quality <> 1 AND p1 >= {D(CUT)}) AS cc FROM s GROUP BY lang)
SELECT b.lang, CAST(po AS BIGINT) AS positives, CAST(co AS BIGINT) AS controls, {D('sp')} / {D(100)} / po AS mean_positive, {D('sc')} / {D(100)} / co AS mean_control,
  {D('pc')} / po AS positive_rate, {D('cc')} / co AS control_rate, n.n_sufficient, x.auc AS auc_sufficient
FROM b LEFT JOIN (SELECT lang, CAST(count(*) AS BIGINT) AS n_sufficient FROM k GROUP BY lang) n ON n.lang = b.lang LEFT JOIN {_sql_auc('k', 'lang', score='p1')} x ON x.lang = b.lang""",
)


def baseline_signal_analysis(spark, folder):
    """Score against cheap features: AUC, precision at equal k, and the differences."""
    rows = cut_lineage(scored(spark, folder))
    aucs = S.auc(by_scorer(rows), ["lang", "scorer"], "score", "quality").select("lang", "scorer", "auc")
    k = _equal_k(rows)
    spread = k.select("lang", "k", F.explode(F.array(*[F.lit(x) for x in SCORERS])).alias("scorer"))
    precision = S.precision_at_k(by_scorer(rows), ["lang", "scorer"], "score", "quality", spread)
    both = cut_lineage(aucs.join(precision, ["lang", "scorer"], "left"))
    own = both.where(F.col("scorer") == "hash").select("lang", F.col("auc").alias("_auc"), F.col("precision").alias("_precision"))
    rounded = lambda c: M.rounded(c, 3)
    return both.where(F.col("scorer").isin("lines", "n_chars")).join(own, "lang").select(
        "lang", F.col("scorer").alias("feature"), rounded(F.col("auc")).alias("auc"), rounded(F.col("_auc") - F.col("auc")).alias("delta_auc"),
        rounded(F.col("precision")).alias("precision"), rounded(F.col("_precision") - F.col("precision")).alias("delta_precision"),
    )


def _r3(x):
    return f"floor(({x}) * {D(1000)} + {D(0.5)}) / {D(1000)}"


QUERIES["baseline_signal_analysis"] = (
    baseline_signal_analysis,
    f"""WITH {SQL_LONG}, {SQL_PK}, au AS (SELECT * FROM {_sql_auc('lg', 'lang, scorer')}),
bo AS (SELECT au.lang, au.scorer, auc, precision FROM au LEFT JOIN pk ON pk.lang = au.lang AND pk.scorer = au.scorer)
SELECT f.lang, f.scorer AS feature, {_r3('f.auc')} AS auc, {_r3('o.auc - f.auc')} AS delta_auc, {_r3('f.precision')} AS precision, {_r3('o.precision - f.precision')} AS delta_precision
FROM bo f JOIN bo o ON o.lang = f.lang AND o.scorer = 'hash' WHERE f.scorer IN ('lines', 'n_chars')""",
)

VIEWS = ("agreement_only", "first_labeler", "second_labeler", "first_labeler_lenient", "second_labeler_lenient")


def label_views(spark, folder):
    """Five readings of two labelers' four-way labels, scored and summarised."""
    def label(tag, base):
        h = T.unit_hash(F.lit(tag), F.col("id"))
        return F.when(h < 0.05, "cannot_tell").when(base == 1, F.when(h < 0.3, "imprecise").otherwise("fits")).otherwise("mismatch")

    rows = scored(spark, folder).withColumn("first", label("lab1", F.col("quality"))).withColumn("second", label("lab2", F.when(T.unit_hash(F.lit("dis"), F.col("id")) < 0.2, 1 - F.col("quality")).otherwise(F.col("quality"))))
    def strict(c):
        return F.when(F.col(c) != "cannot_tell", (F.col(c) == "mismatch").cast("int"))

    def lenient(c):
        return F.when(F.col(c) != "cannot_tell", F.col(c).isin("mismatch", "imprecise").cast("int"))

    agreed = F.when((F.col("first") != "cannot_tell") & (F.col("second") != "cannot_tell") & (strict("first") == strict("second")), strict("first"))
    values = dict(zip(VIEWS, (agreed, strict("first"), strict("second"), lenient("first"), lenient("second"))))
    long = rows.select("id", "p1", F.explode(F.array(*[F.struct(F.lit(n).alias("view"), v.alias("y")) for n, v in values.items()])).alias("x")).select("id", "p1", "x.*").where(F.col("y").isNotNull())
    long = cut_lineage(long)
    aucs = S.auc(long, ["view"], "p1", "y")
    flagged = long.where(F.col("p1") >= CUT).groupBy("view").agg(F.count(F.lit(1)).alias("flagged"), F.sum("y").cast("bigint").alias("hits"))
    low, high = M.wilson(F.col("hits"), F.col("flagged"))
    small = (F.col("positives") < K.MIN_CLASS) | (F.col("negatives") < K.MIN_CLASS)
    return aucs.join(flagged, "view", "left").select(
        "view", "positives", "negatives", small.alias("underpowered"), "auc", F.coalesce("flagged", F.lit(0)).alias("flagged"),
        F.coalesce("hits", F.lit(0)).alias("hits"), low.alias("precision_lo"), high.alias("precision_hi"),
    )


def _sql_label(tag, base):
    h = B.sql_unit_hash(f"'{tag}'", "id")
    return f"CASE WHEN {h} < {D(0.05)} THEN 'cannot_tell' WHEN {base} = 1 THEN CASE WHEN {h} < {D(0.3)} THEN 'imprecise' ELSE 'fits' END ELSE 'mismatch' END"


_dis = f"(CASE WHEN {B.sql_unit_hash(chr(39) + 'dis' + chr(39), 'id')} < {D(0.2)} THEN 1 - quality ELSE quality END)"
_lo, _hi = sql_wilson("coalesce(hits, 0)", "coalesce(flagged, 0)")
SQL_VIEWS = f"""{SQL_S}, lb AS (SELECT id, p1, {_sql_label('lab1', 'quality')} AS first, {_sql_label('lab2', _dis)} AS second FROM s),
vw AS (SELECT id, p1, 'agreement_only' AS view, CAST(first = 'mismatch' AS INTEGER) AS y FROM lb WHERE first <> 'cannot_tell' AND second <> 'cannot_tell' AND (first = 'mismatch') = (second = 'mismatch')
 UNION ALL SELECT id, p1, 'first_labeler', CAST(first = 'mismatch' AS INTEGER) FROM lb WHERE first <> 'cannot_tell'
 UNION ALL SELECT id, p1, 'second_labeler', CAST(second = 'mismatch' AS INTEGER) FROM lb WHERE second <> 'cannot_tell'
 UNION ALL SELECT id, p1, 'first_labeler_lenient', CAST(first IN ('mismatch', 'imprecise') AS INTEGER) FROM lb WHERE first <> 'cannot_tell'
 UNION ALL SELECT id, p1, 'second_labeler_lenient', CAST(second IN ('mismatch', 'imprecise') AS INTEGER) FROM lb WHERE second <> 'cannot_tell'),
fl AS (SELECT view, count(*) AS flagged, sum(y) AS hits FROM vw WHERE p1 >= {D(CUT)} GROUP BY view),
cl AS (SELECT view, count_if(y = 1) AS po, count_if(y <> 1) AS ne FROM vw GROUP BY view)"""
QUERIES["label_views"] = (
    label_views,
    f"""WITH {SQL_VIEWS} SELECT cl.view, CAST(po AS BIGINT) AS positives, CAST(ne AS BIGINT) AS negatives, po < {K.MIN_CLASS} OR ne < {K.MIN_CLASS} AS underpowered, x.auc,
  CAST(coalesce(flagged, 0) AS BIGINT) AS flagged, CAST(coalesce(hits, 0) AS BIGINT) AS hits, {_lo} AS precision_lo, {_hi} AS precision_hi
FROM cl LEFT JOIN {_sql_auc('vw', 'view', label='y', score='p1')} x ON x.view = cl.view LEFT JOIN fl ON fl.view = cl.view""",
)


# --- thresholds -------------------------------------------------------------------------------------

GRID_FLAGS = ("positives", "controls", "hardened")


def _grid(rows):
    pos, hard = F.col("quality") == 1, F.col("toxic") == 1
    return S.grid_counts(rows, ["lang"], "p1", K.FLOOR_GRID, {"positives": pos, "controls": ~pos, "hardened": ~pos & hard, "labeled": F.lit(True)})


def threshold_grid(spark, folder):
    """Rows of each kind at or above every grid point."""
    return _grid(scored(spark, folder)).withColumn("point", F.col("at").cast("bigint")).drop("at")


_at = f"p1 >= {D('g')} / {D(100)} - {D('1e-9')}"
SQL_GRID = f"""gr AS (SELECT lang, g AS point, count_if({_at} AND quality = 1) AS positives, count_if({_at} AND quality <> 1) AS controls,
  count_if({_at} AND quality <> 1 AND toxic = 1) AS hardened, count_if({_at}) AS labeled FROM s, (SELECT unnest([{', '.join(map(str, K.FLOOR_GRID))}]) AS g) GROUP BY lang, g)"""
QUERIES["threshold_grid"] = (
    threshold_grid,
    f"WITH {SQL_S}, {SQL_GRID} SELECT lang, CAST(point AS BIGINT) AS point, CAST(positives AS BIGINT) AS positives, CAST(controls AS BIGINT) AS controls, CAST(hardened AS BIGINT) AS hardened, CAST(labeled AS BIGINT) AS labeled FROM gr",
)

CUT_ALARM, HARD_ALARM, FLOOR_ALARM, YIELD = (K.CUT_RULE[k] for k in ("cut_primary", "cut_hardened", "floor_primary", "cut_real"))


def derived_cuts(spark, folder):
    """Smallest grid points that meet the false-alarm and yield limits, else the defaults."""
    rows = scored(spark, folder)
    grid = _grid(rows)
    totals = rows.groupBy("lang").agg(
        F.count_if(F.col("quality") != 1).cast("bigint").alias("n"), F.count_if((F.col("quality") != 1) & (F.col("toxic") == 1)).cast("bigint").alias("m")
    )
    r = lambda k, n: M.rounded(M.rate(F.col(k), F.col(n)), 4)
    real = (F.col("labeled") > 0) & (M.rate(F.col("positives"), F.col("labeled")) >= YIELD)
    cut_ok = F.col("at").isin(*K.CUT_GRID) & (r("controls", "n") <= CUT_ALARM) & ((F.col("m") == 0) | (r("hardened", "m") <= HARD_ALARM)) & real
    joined = grid.join(totals, "lang")
    cuts = joined.groupBy("lang").agg(F.coalesce(F.min(F.when(cut_ok, F.col("at"))), F.lit(70)).alias("_cut"))
    floor_ok = (F.col("at") <= F.col("_cut")) & (r("controls", "n") <= FLOOR_ALARM) & real
    return (
        joined.join(cuts, "lang").groupBy("lang", "_cut").agg(F.coalesce(F.min(F.when(floor_ok, F.col("at"))), F.lit(50)).alias("_floor"))
        .select("lang", (F.col("_cut").cast("double") / 100.0).alias("cut"), (F.least("_floor", "_cut").cast("double") / 100.0).alias("floor"))
    )


def _r4(k, n):
    return f"floor({D(k)} / {D(n)} * {D(10000)} + {D(0.5)}) / {D(10000)}"


QUERIES["derived_cuts"] = (
    derived_cuts,
    f"""WITH {SQL_S}, {SQL_GRID}, t AS (SELECT lang, count_if(quality <> 1) AS n, count_if(quality <> 1 AND toxic = 1) AS m FROM s GROUP BY lang),
j AS (SELECT gr.*, n, m, labeled > 0 AND {D('positives')} / {D('labeled')} >= {D(YIELD)} AS real_ok FROM gr JOIN t USING (lang)),
c AS (SELECT lang, coalesce(min(point) FILTER (WHERE point IN ({', '.join(map(str, K.CUT_GRID))}) AND {_r4('controls', 'n')} <= {D(CUT_ALARM)} AND (m = 0 OR {_r4('hardened', 'm')} <= {D(HARD_ALARM)}) AND real_ok), 70) AS cut FROM j GROUP BY lang),
f AS (SELECT j.lang, any_value(cut) AS cut, coalesce(min(point) FILTER (WHERE point <= cut AND {_r4('controls', 'n')} <= {D(FLOOR_ALARM)} AND real_ok), 50) AS fl FROM j JOIN c USING (lang) GROUP BY j.lang)
SELECT lang, {D('cut')} / {D(100)} AS cut, {D('least(fl, cut)')} / {D(100)} AS floor FROM f""",
)


def cue_summary(spark, folder):
    """Flagged and strict counts at floor and cut, over all rows and over those the cue lets through."""
    rows = scored(spark, folder).withColumn("cue", T.unit_hash(F.lit("cue"), F.col("id")) < 0.3)
    sets = rows.withColumn("slice", F.explode(F.when(F.col("cue"), F.array(F.lit("all"), F.lit("name_cue"))).otherwise(F.array(F.lit("all")))))
    points = sets.withColumn("point", F.explode(F.array(F.struct(F.lit("none").alias("name"), F.lit(-1.0).alias("from")), F.struct(F.lit("floor").alias("name"), F.lit(0.2).alias("from")), F.struct(F.lit("cut").alias("name"), F.lit(0.5).alias("from")))))
    at = points.where(F.col("p1") >= F.col("point.from") - F.lit(1e-9))
    return at.groupBy("slice", F.col("point.name").alias("point")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("bigint").alias("flagged"),
        F.count_if((F.col("quality") == 0) & (F.col("toxic") == 1)).cast("bigint").alias("strict"),
    )


QUERIES["cue_summary"] = (
    cue_summary,
    f"""WITH {SQL_S}, sl AS (SELECT *, 'all' AS slice FROM s UNION ALL SELECT *, 'name_cue' FROM s WHERE {B.sql_unit_hash("'cue'", 'id')} < {D(0.3)}),
pt AS (SELECT * FROM {B.sql_values([('none', -1.0), ('floor', 0.2), ('cut', 0.5)], 'point, frm')})
SELECT slice, point, CAST(count(*) AS BIGINT) AS n, CAST(count_if(quality = 0 OR toxic = 1) AS BIGINT) AS flagged, CAST(count_if(quality = 0 AND toxic = 1) AS BIGINT) AS strict
FROM sl JOIN pt ON p1 >= frm - {D('1e-9')} GROUP BY slice, point""",
)


def fake_scores(spark, folder):
    """Known-answer scorers: random, oracle, inverse, and a feature scaled to its set's range."""
    rows = scored(spark, folder)
    spans = rows.groupBy("lang").agg(F.min("n_chars").alias("_lo"), F.max("n_chars").alias("_hi"))
    scaled = F.when(F.col("_lo") == F.col("_hi"), F.lit(0.5)).otherwise((F.col("n_chars") - F.col("_lo")).cast("double") / (F.col("_hi") - F.col("_lo")).cast("double"))
    return rows.join(spans, "lang").select(
        "id", F.col("p1").alias("random"), F.when(F.col("quality") == 1, F.lit(0.9)).otherwise(F.lit(0.1)).alias("oracle"),
        F.when(F.col("quality") == 1, F.lit(0.1)).otherwise(F.lit(0.9)).alias("inverse"), scaled.alias("feature"),
    )


QUERIES["fake_scores"] = (
    fake_scores,
    f"""WITH {SQL_S}, m AS (SELECT lang, min(n_chars) AS lo, max(n_chars) AS hi FROM s GROUP BY lang)
SELECT id, p1 AS random, CASE WHEN quality = 1 THEN {D(0.9)} ELSE {D(0.1)} END AS oracle, CASE WHEN quality = 1 THEN {D(0.1)} ELSE {D(0.9)} END AS inverse,
  CASE WHEN lo = hi THEN {D(0.5)} ELSE {D('n_chars - lo')} / {D('hi - lo')} END AS feature FROM s JOIN m USING (lang)""",
)
