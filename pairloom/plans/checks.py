"""Known-answer scorer checks, rate windows, listings, conclusions and page scripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom import constants as K
from pairloom.operators import code_index as C
from pairloom.operators import scoring
from pairloom.operators import stats as S
from pairloom.operators.ordered import ranked
from pairloom.plans import bindings as B
from pairloom.plans import statistics as P
from pairloom.plans.statistics import D
from pairloom.session import cut_lineage
from pairloom.sources.tables import table

QUERIES: dict = {}
CHECKS = ("oracle", "null_negative", "null_positive", "abstain", "error", "wrong_model")


def grader_checks(spark, folder):
    """Six fake scorers through the same grading; each has one right outcome."""
    rows = P.scored(spark, folder).select("id", "lang", "quality")
    spread = rows.withColumn("check", F.explode(F.array(*[F.lit(c) for c in CHECKS])))
    check = F.col("check")
    p = F.when(check == "oracle", scoring.offline("oracle", label="quality")).when(check == "null_negative", 0.0).when(check == "null_positive", 1.0)
    graded = spread.withColumn("p", p).withColumn("fired", F.col("p") >= K.DEFAULT_CUT)
    right = F.col("fired") == (F.col("quality") == 1)
    out = graded.groupBy("check").agg(
        F.count(F.lit(1)).alias("cases"), F.count("p").alias("graded"), F.count_if(right).cast("bigint").alias("correct"),
        F.count_if(check == "abstain").cast("bigint").alias("abstained"), F.count_if(check.isin("error", "wrong_model")).cast("bigint").alias("errors"),
    )
    failure = F.when(check == "abstain", "abstained").when(check == "error", "serving_error").when(check == "wrong_model", "served_model_mismatch").otherwise("none")
    return out.withColumn("failure_class", failure)


QUERIES["grader_checks"] = (
    grader_checks,
    f"""WITH {P.SQL_S}, c AS (SELECT unnest(['oracle', 'null_negative', 'null_positive', 'abstain', 'error', 'wrong_model']) AS "check"),
g AS (SELECT "check", quality, CASE "check" WHEN 'oracle' THEN CASE WHEN quality = 1 THEN {D(0.9)} ELSE {D(0.1)} END WHEN 'null_negative' THEN {D(0)} WHEN 'null_positive' THEN {D(1)} END AS p FROM s, c)
SELECT "check", CAST(count(*) AS BIGINT) AS cases, CAST(count(p) AS BIGINT) AS graded, CAST(count_if(coalesce((p >= {D(K.DEFAULT_CUT)}) = (quality = 1), FALSE)) AS BIGINT) AS correct,
  CAST(count_if("check" = 'abstain') AS BIGINT) AS abstained, CAST(count_if("check" IN ('error', 'wrong_model')) AS BIGINT) AS errors,
  CASE "check" WHEN 'abstain' THEN 'abstained' WHEN 'error' THEN 'serving_error' WHEN 'wrong_model' THEN 'served_model_mismatch' ELSE 'none' END AS failure_class FROM g GROUP BY "check\"""",
)


def known_answer_auc(spark, folder):
    """AUC of the oracle is 1, of its inverse 0, of a constant one half."""
    rows = P.scored(spark, folder).select("id", "lang", "quality")
    kinds = ("oracle", "inverse", "constant")
    long = rows.select("lang", "quality", F.explode(F.array(*[F.struct(F.lit(k).alias("scorer"), scoring.offline(k, label="quality").alias("score")) for k in kinds])).alias("x"))
    return S.auc(long.select("lang", "quality", "x.*"), ["lang", "scorer"], "score", "quality").select("lang", "scorer", "auc")


QUERIES["known_answer_auc"] = (
    known_answer_auc,
    f"""WITH {P.SQL_S}, k AS (SELECT lang, bool_or(quality = 1) AND bool_or(quality <> 1) AS ok FROM s GROUP BY lang)
SELECT lang, scorer, CASE WHEN ok THEN v END AS auc FROM k, (VALUES ('oracle', {D(1)}), ('inverse', {D(0)}), ('constant', {D(0.5)})) AS t(scorer, v)""",
)


def signal_fixture_check(spark, folder):
    """Per question: best positive at or above the cut and best negative below it."""
    rows = P.scored(spark, folder)
    out = rows.groupBy("source").agg(F.max(F.when(F.col("quality") == 1, F.col("p1"))).alias("max_positive"), F.max(F.when(F.col("quality") != 1, F.col("p1"))).alias("max_negative"))
    return out.withColumn("passes", F.coalesce((F.col("max_positive") >= K.DEFAULT_CUT) & (F.col("max_negative") < K.DEFAULT_CUT), F.lit(False)))


QUERIES["signal_fixture_check"] = (
    signal_fixture_check,
    f"""WITH {P.SQL_S}, m AS (SELECT source, max(p1) FILTER (WHERE quality = 1) AS max_positive, max(p1) FILTER (WHERE quality <> 1) AS max_negative FROM s GROUP BY source)
SELECT *, coalesce(max_positive >= {D(K.DEFAULT_CUT)} AND max_negative < {D(K.DEFAULT_CUT)}, FALSE) AS passes FROM m""",
)

HOURLY_REQUESTS, HOURLY_TOKENS = 4, 20_000


def rate_windows(spark, folder):
    """Requests and tokens per hour of the log against paced limits (80% of a nominal rate)."""
    e = table(spark, folder, "events").where(F.col("event_type").isin("click", "purchase", "error"))
    hour = F.date_format(F.date_trunc("hour", F.col("ts")), "yyyy-MM-dd HH")
    rows = e.groupBy(hour.alias("hour")).agg(
        F.count_if(F.col("event_type") == "click").cast("bigint").alias("requests"), F.sum(F.when(F.col("event_type") != "click", F.floor(F.col("value") * 100)).otherwise(0)).cast("bigint").alias("tokens"),
    )
    return rows.select("hour", "requests", "tokens", (F.col("requests") > HOURLY_REQUESTS * 0.8).alias("requests_over"), (F.col("tokens") > HOURLY_TOKENS * 0.8).alias("tokens_over"))


QUERIES["rate_windows"] = (
    rate_windows,
    f"""WITH w AS (SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, CAST(count_if(event_type = 'click') AS BIGINT) AS requests, CAST(sum(CASE WHEN event_type <> 'click' THEN floor(value * 100) ELSE 0 END) AS BIGINT) AS tokens
  FROM events WHERE event_type IN ('click', 'purchase', 'error') GROUP BY 1)
SELECT *, requests > {HOURLY_REQUESTS} * {D(0.8)} AS requests_over, tokens > {HOURLY_TOKENS} * {D(0.8)} AS tokens_over FROM w""",
)


def flagged_listing(spark, folder):
    """Units a labeler marked or the score flags, best score first; a missing score sorts last."""
    docs = P.run_scores(table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "source"))
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    marked = docs.join(labels, "id").where((F.col("quality") == 0) | (F.col("toxic") == 1) | (F.col("p1") >= K.DEFAULT_CUT))
    scored = marked.withColumn("p", F.when(F.col("choice1") != "insufficient", F.col("p1")))
    return ranked(scored.select("id", "source", "p", "quality", "toxic", F.coalesce("p", F.lit(-1.0)).alias("_p")), [], [F.col("_p").desc(), "id"]).drop("_p")


QUERIES["flagged_listing"] = (
    flagged_listing,
    f"""WITH {P.SQL_S}, m AS (SELECT id, source, CASE WHEN choice1 <> 'insufficient' THEN p1 END AS p, quality, toxic FROM s WHERE quality = 0 OR toxic = 1 OR p1 >= {D(K.DEFAULT_CUT)})
SELECT *, CAST(row_number() OVER (ORDER BY coalesce(p, {D(-1)}) DESC, id) AS BIGINT) AS rank FROM m""",
)


def contrast_difference(spark, folder):
    """AUC of the score minus that of length on the same resamples, with the verdict the interval gives."""
    rows = cut_lineage(P.by_scorer(P.scored(spark, folder)).where(F.col("scorer").isin("hash", "lines")).select("lang", "scorer", "id", "score", "quality"))
    point = S.auc(rows, ["lang", "scorer"], "score", "quality").groupBy("lang").agg(
        (F.max(F.when(F.col("scorer") == "hash", F.col("auc"))) - F.max(F.when(F.col("scorer") == "lines", F.col("auc")))).alias("value")
    )
    # Equal seeds and order give both scorers the same draws.
    draws = S.bootstrap_auc_in_order(rows, ["lang", "scorer"], "score", "quality", ["id"], P.RESAMPLES, F.lit(K.BOOTSTRAP_SEED))
    paired = draws.groupBy("lang", "replicate").agg(
        (F.max(F.when(F.col("scorer") == "hash", F.col("auc"))) - F.max(F.when(F.col("scorer") == "lines", F.col("auc")))).alias("difference")
    )
    interval = S.percentile_interval(cut_lineage(paired), ["lang"], "difference")
    verdict = F.when(F.col("lo") > 0, "score_ahead").when(F.col("hi") < 0, "baseline_ahead").otherwise("no_detectable_difference")
    return point.join(interval, "lang").withColumn("verdict", verdict)


QUERIES["contrast_difference"] = (
    contrast_difference,
    f"""WITH {P.SQL_CONTRAST_PAIRED}, df AS (SELECT lang, replicate, max(auc) FILTER (WHERE scorer = 'hash') - max(auc) FILTER (WHERE scorer = 'lines') AS difference FROM ba GROUP BY 1, 2),
ii AS ({P.sql_interval('df', 'lang', 'difference', *P.LOOSE)}), pv AS (SELECT lang, max(auc) FILTER (WHERE scorer = 'hash') - max(auc) FILTER (WHERE scorer = 'lines') AS value FROM pt GROUP BY lang)
SELECT lang, value, draws, lo, hi, CASE WHEN lo > 0 THEN 'score_ahead' WHEN hi < 0 THEN 'baseline_ahead' ELSE 'no_detectable_difference' END AS verdict FROM pv JOIN ii USING (lang)""",
)


def view_conclusion(spark, folder):
    """What the label views allow to say: none, mixed, or separated, from the primary views."""
    v = P.label_views(spark, folder).where(F.col("view").isin("agreement_only", "first_labeler", "second_labeler"))
    one = v.agg(
        F.count_if("underpowered").cast("bigint").alias("underpowered_views"),
        F.max(F.when(F.col("view") == "agreement_only", ~F.col("underpowered"))).alias("_power"), F.max(F.when(F.col("view") == "agreement_only", F.col("auc"))).alias("agreement_auc"),
    )
    said = F.when(F.col("underpowered_views") == 3, "no_conclusion").when(F.col("_power") & (F.col("agreement_auc") > 0.6), "separates").otherwise("mixed")
    return one.select("underpowered_views", "agreement_auc", said.alias("conclusion"))


QUERIES["view_conclusion"] = (
    view_conclusion,
    f"""WITH {P.SQL_VIEWS}, v AS (SELECT cl.view, po < {K.MIN_CLASS} OR ne < {K.MIN_CLASS} AS u, x.auc FROM cl LEFT JOIN {P._sql_auc('vw', 'view', label='y', score='p1')} x ON x.view = cl.view WHERE cl.view IN ('agreement_only', 'first_labeler', 'second_labeler')),
o AS (SELECT count_if(u) AS n, bool_or(NOT u) FILTER (WHERE view = 'agreement_only') AS pw, max(auc) FILTER (WHERE view = 'agreement_only') AS a FROM v)
SELECT CAST(n AS BIGINT) AS underpowered_views, a AS agreement_auc, CASE WHEN n = 3 THEN 'no_conclusion' WHEN pw AND a > {D(0.6)} THEN 'separates' ELSE 'mixed' END AS conclusion FROM o""",
)


def page_scripts(spark, folder):
    scripts = F.array_join(F.regexp_extract_all("html", F.lit(r"<script>((?s:.*?))</script>"), 1), "\n")
    return table(spark, folder, "pages").select(F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("path"), scripts.alias("text"))


def script_tokens(spark, folder):
    """Significant tokens of the pages' scripts by kind."""
    return C.tokens(page_scripts(spark, folder)).groupBy("kind").agg(F.count(F.lit(1)).alias("tokens"), F.count_distinct("path").alias("scripts"))


# The lexer pattern has no counterpart in the comparison engine; tests check it on fixtures.
QUERIES["script_tokens"] = (script_tokens, None)


def script_calls(spark, folder):
    """Calls in the pages' scripts by callee and whether a function owns them."""
    t = cut_lineage(C.tokens(page_scripts(spark, folder)))
    return C.calls(t, C.functions(t)).groupBy("callee", "member", F.col("owner_id").isNotNull().alias("owned")).agg(F.count(F.lit(1)).alias("calls"))


QUERIES["script_calls"] = (
    script_calls,
    r"""WITH s AS (SELECT unnest(regexp_extract_all(html, '<script>((?s:.*?))</script>', 1)) AS t FROM pages), c AS (SELECT unnest(regexp_extract_all(regexp_replace(t, '"[^"]*"', '""', 'g'), '([A-Za-z_][A-Za-z0-9_]*)\(', 1)) AS callee FROM s)
SELECT callee, FALSE AS member, FALSE AS owned, CAST(count(*) AS BIGINT) AS calls FROM c GROUP BY 1""",
)
