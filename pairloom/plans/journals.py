"""Event-log queries. ``events`` stands for a log: click reserves, purchase and error finish, user is the unit."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom import constants as K
from pairloom.functions import text as T
from pairloom.operators import journal as J
from pairloom.operators.ordered import ranked
from pairloom.plans import bindings as B
from pairloom.plans.statistics import D
from pairloom.session import cut_lineage
from pairloom.sources.tables import table

QUERIES: dict = {}
BODY = ["seq", "type", "unit_id", "status", "input_tokens", "output_tokens"]


def log(spark, folder):
    e = table(spark, folder, "events")
    kind = F.col("event_type")
    finished = kind.isin("purchase", "error")
    k = F.get_json_object("props", "$.k").cast("bigint")
    rows = ranked(e.select("event_id", "ts", "user_id", "event_type", "value", "props"), [], ["ts", "event_id"], name="seq")
    return rows.select(
        (F.col("seq") - 1).alias("seq"), "ts", F.col("user_id").alias("unit_id"),
        F.when(kind == "click", "reserved").when(finished, "finished").when(kind == "signup", "initialized").otherwise("note").alias("type"),
        F.when(kind == "purchase", "succeeded").when(kind == "error", "failed").alias("status"),
        F.when(finished & (F.col("value") >= 1), F.floor(F.col("value") * 100).cast("bigint")).alias("input_tokens"),
        F.when(finished, k).alias("output_tokens"), k.alias("k"), F.to_date("ts").alias("run"),
    )


SQL_LOG = f"""lg AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS seq, ts, user_id AS unit_id,
  CASE WHEN event_type = 'click' THEN 'reserved' WHEN event_type IN ('purchase', 'error') THEN 'finished' WHEN event_type = 'signup' THEN 'initialized' ELSE 'note' END AS type,
  CASE WHEN event_type = 'purchase' THEN 'succeeded' WHEN event_type = 'error' THEN 'failed' END AS status,
  CASE WHEN event_type IN ('purchase', 'error') AND value >= 1 THEN CAST(floor(value * 100) AS BIGINT) END AS input_tokens,
  CASE WHEN event_type IN ('purchase', 'error') THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS output_tokens,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(ts AS DATE) AS run FROM events)"""


def stored_log(spark, folder):
    """The log as it would be stored: own hash, link to the event before, and a few broken ones."""
    rows = cut_lineage(log(spark, folder).withColumn("event_hash", J.event_hash(*BODY)))
    before = rows.select((F.col("seq") + 1).alias("seq"), F.col("event_hash").alias("previous_hash"))
    linked = rows.join(before, "seq", "left")
    fault = T.unit_hash(F.lit("fault"), F.col("seq"))
    return linked.withColumn("event_hash", F.when(fault < 0.01, F.sha2(F.lit("x"), 256)).otherwise(F.col("event_hash"))).withColumn(
        "previous_hash", F.when(fault > 0.99, F.sha2(F.lit("y"), 256)).otherwise(F.col("previous_hash"))
    )


_body = " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in BODY)
_fault = B.sql_unit_hash("'fault'", "seq")
SQL_STORED = f"""{SQL_LOG}, hs AS (SELECT *, sha256({_body}) AS true_hash FROM lg),
ln AS (SELECT *, lag(true_hash) OVER (ORDER BY seq) AS true_prev FROM hs),
st AS (SELECT seq, type, unit_id, true_hash, CASE WHEN {_fault} < {D(0.01)} THEN sha256('x') ELSE true_hash END AS event_hash, CASE WHEN {_fault} > {D(0.99)} THEN sha256('y') ELSE true_prev END AS previous_hash FROM ln),
ck AS (SELECT *, lag(event_hash) OVER (ORDER BY seq) AS before FROM st),
vi AS (SELECT seq, unit_id, type, CASE WHEN event_hash <> true_hash THEN 'event_hash' WHEN previous_hash IS DISTINCT FROM before THEN 'previous_hash' END AS problem FROM ck)"""


def journal_chain_check(spark, folder):
    stored = cut_lineage(stored_log(spark, folder))
    return J.chain_violations(stored, BODY).select("seq", "unit_id", "type", "problem")


QUERIES["journal_chain_check"] = (
    journal_chain_check,
    f"WITH {SQL_STORED} SELECT CAST(seq AS BIGINT) AS seq, unit_id, type, problem FROM vi WHERE problem IS NOT NULL",
)


def journal_lifecycle(spark, folder):
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    rows = log(spark, folder).select("seq", "unit_id", "type", us.alias("us"), "status")
    last = rows.agg(F.max("us").alias("m")).first()["m"]
    late = F.col("us") > last - 24 * 3600 * 1_000_000
    marked = rows.withColumn("type", F.when((F.col("type") == "note") & late, "stopped").otherwise(F.col("type")))
    return J.lifecycle_violations(marked).select("seq", "unit_id", "type", "problem")


QUERIES["journal_lifecycle"] = (
    journal_lifecycle,
    f"""WITH {SQL_LOG}, m AS (SELECT seq, unit_id, CASE WHEN type = 'note' AND ts > (SELECT max(ts) FROM lg) - INTERVAL 1 DAY THEN 'stopped' ELSE type END AS type FROM lg),
r AS (SELECT *, coalesce(sum(CAST(type = 'reserved' AS INTEGER)) OVER w, 0) AS rs, coalesce(sum(CAST(type = 'finished' AS INTEGER)) OVER w, 0) AS fi FROM m
  WINDOW w AS (PARTITION BY unit_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT seq, unit_id, type, CASE WHEN seq > (SELECT min(seq) FROM m WHERE type = 'stopped') THEN 'after_terminal' WHEN type = 'reserved' AND rs > 0 THEN 'duplicate_reservation'
  WHEN type = 'finished' AND rs = 0 THEN 'finish_without_reservation' WHEN type = 'finished' AND fi > 0 THEN 'duplicate_finish' END AS problem FROM r)
SELECT CAST(seq AS BIGINT) AS seq, unit_id, type, problem FROM p WHERE problem IS NOT NULL""",
)


def plain_log(spark, folder):
    """The log without positions, for order-free accounting."""
    e = table(spark, folder, "events")
    kind, finished = F.col("event_type"), F.col("event_type").isin("purchase", "error")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(
        F.col("event_id").alias("seq"), "ts", F.col("user_id").alias("unit_id"), F.to_date("ts").alias("run"), k.alias("k"),
        F.when(kind == "click", "reserved").when(finished, "finished").when(kind == "signup", "initialized").otherwise("note").alias("type"),
        F.when(kind == "purchase", "succeeded").when(kind == "error", "failed").alias("status"),
        F.when(finished & (F.col("value") >= 1), F.floor(F.col("value") * 100).cast("bigint")).alias("input_tokens"),
        F.when(finished, k).alias("output_tokens"),
    )


_known = f"(type = 'finished' AND input_tokens IS NOT NULL AND output_tokens IS NOT NULL AND input_tokens BETWEEN 0 AND {K.MAX_INPUT_TOKENS} AND output_tokens >= 0)"


def sql_accounting(keys: str, planned: str, source: str = "lg") -> str:
    k = f"{keys}, " if keys else ""
    g = f"GROUP BY {keys}" if keys else ""
    return f"""ac0 AS (SELECT {k}count_if(type = 'reserved') AS reserved, count_if(type = 'finished') AS finished, count_if(coalesce(status = 'succeeded', FALSE)) AS succeeded, count_if({_known}) AS known,
  coalesce(sum(CASE WHEN {_known} THEN input_tokens END), 0) AS input_tokens, coalesce(sum(CASE WHEN {_known} THEN output_tokens END), 0) AS output_tokens, {planned} AS planned FROM {source} {g}),
ac AS (SELECT {k}CAST(planned AS BIGINT) AS planned, CAST(reserved AS BIGINT) AS reserved, CAST(finished AS BIGINT) AS finished, CAST(succeeded AS BIGINT) AS succeeded, CAST(finished - succeeded AS BIGINT) AS failed,
  CAST(greatest(reserved - known, 0) AS BIGINT) AS unknown, CAST(planned - reserved AS BIGINT) AS unattempted, CAST(input_tokens AS BIGINT) AS input_tokens, CAST(output_tokens AS BIGINT) AS output_tokens,
  {D('input_tokens')} * {D(K.USD_PER_MILLION)} / {D('1e6')} AS known_usd, {D('input_tokens')} * {D(K.USD_PER_MILLION)} / {D('1e6')} + {D('greatest(reserved - known, 0)')} * {D(K.RESERVATION_USD)} AS budget_accounted_usd,
  succeeded = planned AND reserved <= known AS complete FROM ac0)"""


def journal_accounting(spark, folder):
    return J.accounting(plain_log(spark, folder), F.count(F.lit(1)))


QUERIES["journal_accounting"] = (journal_accounting, f"WITH {SQL_LOG}, {sql_accounting('', 'count(*)')} SELECT * FROM ac")


def combined_accounting(spark, folder):
    """Accounting per run (day)."""
    return J.accounting(plain_log(spark, folder).withColumn("run", F.col("run").cast("string")), F.count(F.lit(1)), "run")


QUERIES["combined_accounting"] = (
    combined_accounting,
    f"WITH {SQL_LOG}, ls AS (SELECT * REPLACE (CAST(run AS VARCHAR) AS run) FROM lg), {sql_accounting('run', 'count(*)', 'ls')} SELECT * FROM ac",
)


def wall_clock(spark, folder):
    """Per run: milliseconds from the first event to the last finished one."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    rows = plain_log(spark, folder).groupBy(F.col("run").cast("string").alias("run")).agg(
        F.min(us).alias("a"), F.max(F.when(F.col("type") == "finished", us)).alias("b")
    )
    return rows.select("run", F.floor((F.col("b") - F.col("a")) / 1000).cast("bigint").alias("wall_clock_ms"))


QUERIES["wall_clock"] = (
    wall_clock,
    f"WITH {SQL_LOG} SELECT CAST(run AS VARCHAR) AS run, CAST(floor((max(epoch_us(ts)) FILTER (WHERE type = 'finished') - min(epoch_us(ts))) / {D(1000)}) AS BIGINT) AS wall_clock_ms FROM lg GROUP BY 1",
)


def served_models(spark, folder):
    """Finished events per served version, and how many name none; aliases do not count as versions."""
    k = F.col("k")
    model = F.when(k % 7 == 0, "scorer-latest").otherwise(F.concat(F.lit("scorer-1."), (k % 3).cast("string"), F.lit(".0")))
    rows = plain_log(spark, folder).where(F.col("type") == "finished").withColumn("served", F.when(model.rlike(J.CONCRETE_MODEL), model))
    return rows.groupBy(F.coalesce("served", F.lit("(none)")).alias("served")).agg(F.count(F.lit(1)).alias("finished"))


QUERIES["served_models"] = (
    served_models,
    f"""WITH {SQL_LOG} SELECT CASE WHEN k % 7 = 0 THEN '(none)' ELSE 'scorer-1.' || (k % 3) || '.0' END AS served, CAST(count(*) AS BIGINT) AS finished FROM lg WHERE type = 'finished' GROUP BY 1""",
)


def served_model_check(spark, folder):
    """Problem codes of the reported version against the requested one."""
    k = F.col("k")
    requested = F.when(k % 2 == 0, "scorer-1.1.0").otherwise("scorer-latest")
    reported = F.when(k % 11 == 0, F.lit(None).cast("string")).when(k % 5 == 0, "scorer-latest").when(k % 3 == 0, "scorer-1.1.0").otherwise("scorer-1.2.0")
    rows = plain_log(spark, folder).where(F.col("type") == "finished").withColumn("requested", requested).withColumn("reported", reported)
    return rows.withColumn("problem", F.coalesce(J.served_model_problem(F.col("requested"), F.col("reported")), F.lit("none"))).groupBy("requested", "problem").agg(F.count(F.lit(1)).alias("n"))


QUERIES["served_model_check"] = (
    served_model_check,
    f"""WITH {SQL_LOG}, r AS (SELECT CASE WHEN k % 2 = 0 THEN 'scorer-1.1.0' ELSE 'scorer-latest' END AS requested,
  CASE WHEN k % 11 = 0 THEN NULL WHEN k % 5 = 0 THEN 'scorer-latest' WHEN k % 3 = 0 THEN 'scorer-1.1.0' ELSE 'scorer-1.2.0' END AS reported FROM lg WHERE type = 'finished')
SELECT requested, CASE WHEN requested = 'scorer-latest' THEN CASE WHEN reported IS NULL OR reported = 'scorer-latest' THEN 'unresolved_model' ELSE 'none' END
  WHEN reported IS DISTINCT FROM requested THEN 'unexpected_model' ELSE 'none' END AS problem, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY 1, 2""",
)


def resume_set(spark, folder):
    """Units that reserved but never finished on the day of the reservation."""
    rows = plain_log(spark, folder).withColumn("unit_id", F.concat_ws("|", F.col("unit_id").cast("string"), F.col("run").cast("string")))
    return J.resume_set(rows.where(F.col("type") == "reserved").select("unit_id").distinct(), rows)


QUERIES["resume_set"] = (
    resume_set,
    f"""WITH {SQL_LOG}, u AS (SELECT unit_id || '|' || CAST(run AS VARCHAR) AS unit_id, type FROM lg)
SELECT DISTINCT unit_id FROM u WHERE type = 'reserved' AND unit_id NOT IN (SELECT unit_id FROM u WHERE type = 'finished')""",
)
CAP_USD = 0.2


def budget_replay(spark, folder):
    return J.budget_replay(log(spark, folder).select("seq", "unit_id", "type", "input_tokens", "output_tokens"), CAP_USD)


_need = f"{D('tokens_before')} * {D(K.USD_PER_MILLION)} / {D('1e6')} + {D('greatest(inflight_before, 0) + 1')} * {D(K.RESERVATION_USD)}"
QUERIES["budget_replay"] = (
    budget_replay,
    f"""WITH {SQL_LOG}, r AS (SELECT seq, unit_id, type, coalesce(sum(CASE WHEN {_known} THEN input_tokens ELSE 0 END) OVER w, 0) AS tokens_before,
  coalesce(sum(CASE WHEN type = 'reserved' THEN 1 WHEN {_known} THEN -1 ELSE 0 END) OVER w, 0) AS inflight_before FROM lg WINDOW w AS (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT CAST(seq AS BIGINT) AS seq, unit_id, CAST(tokens_before AS BIGINT) AS tokens_before, CAST(inflight_before AS BIGINT) AS inflight_before, {_need} AS needed_usd, {_need} <= {D(CAP_USD)} AS dispatched,
  CASE WHEN {_need} > {D(CAP_USD)} THEN 'budget_reservation_exceeds_cap' END AS stop_reason FROM r WHERE type = 'reserved'""",
)


def stop_at_first_error(spark, folder):
    """Per run: what finished before the first failure, and what a run that stops there leaves out."""
    rows = plain_log(spark, folder).withColumn("run", F.col("run").cast("string"))
    first = rows.where(F.col("status") == "failed").groupBy("run").agg(F.min("seq").alias("stop_seq"))
    done = (F.col("type") == "finished") & (F.col("seq") <= F.col("stop_seq"))
    # One row per day: the build side is bounded by the calendar.
    return rows.join(first, "run").groupBy("run", "stop_seq").agg(
        F.count_if(done).cast("bigint").alias("finished_before_stop"), F.count_if((F.col("type") == "reserved") & (F.col("seq") > F.col("stop_seq"))).cast("bigint").alias("left_out"),
    ).withColumn("stop_reason", F.lit("first_error"))


QUERIES["stop_at_first_error"] = (
    stop_at_first_error,
    """WITH e AS (SELECT event_id AS seq, CAST(CAST(ts AS DATE) AS VARCHAR) AS run, event_type FROM events), f AS (SELECT run, min(seq) AS stop_seq FROM e WHERE event_type = 'error' GROUP BY run)
SELECT run, stop_seq, CAST(count_if(event_type IN ('purchase', 'error') AND seq <= stop_seq) AS BIGINT) AS finished_before_stop, CAST(count_if(event_type = 'click' AND seq > stop_seq) AS BIGINT) AS left_out,
  'first_error' AS stop_reason FROM e JOIN f USING (run) GROUP BY run, stop_seq""",
)


def merge_runs(spark, folder):
    """Outcome per unit over daily runs."""
    rows = plain_log(spark, folder).where(F.col("type") == "finished").select("unit_id", F.col("run").cast("string").alias("run"), "seq", "status")
    return J.merge_runs(rows)


QUERIES["merge_runs"] = (
    merge_runs,
    """WITH f AS (SELECT user_id AS unit_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS run, arg_max(CASE WHEN event_type = 'purchase' THEN 'succeeded' ELSE 'failed' END, event_id) AS status
  FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1, 2)
SELECT unit_id, arg_max(status, run) AS status, max(run) AS run, CAST(count(*) - 1 AS BIGINT) AS superseded, CAST(count_if(status = 'succeeded') AS BIGINT) AS successes, count_if(status = 'succeeded') > 1 AS answered_twice FROM f GROUP BY unit_id""",
)


def superseded_failures(spark, folder):
    """Failures a later run made obsolete."""
    rows = plain_log(spark, folder).where(F.col("type") == "finished").select("unit_id", F.col("run").cast("string").alias("run"), "seq", "status")
    per_run = rows.groupBy("unit_id", "run").agg(F.max_by("status", "seq").alias("status"))
    final = per_run.groupBy("unit_id").agg(F.max("run").alias("_last"))
    return per_run.join(final, "unit_id").where((F.col("run") < F.col("_last")) & (F.col("status") == "failed")).select("unit_id", "run")


QUERIES["superseded_failures"] = (
    superseded_failures,
    """WITH f AS (SELECT user_id AS unit_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS run, arg_max(CASE WHEN event_type = 'purchase' THEN 'succeeded' ELSE 'failed' END, event_id) AS status
  FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1, 2)
SELECT unit_id, run FROM f QUALIFY status = 'failed' AND run < max(run) OVER (PARTITION BY unit_id)""",
)


def continuation_plan(spark, folder):
    """Orders as units, lines as their parts: whole units are continued, partly answered ones refused."""
    parts = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("unit_id"), (F.col("l_linestatus") == "F").alias("succeeded"))
    return J.continuation(parts)


QUERIES["continuation_plan"] = (
    continuation_plan,
    """WITH p AS (SELECT l_orderkey AS unit_id, count(*) AS parts, count_if(l_linestatus = 'F') AS done FROM lineitem GROUP BY 1)
SELECT unit_id, CAST(parts AS BIGINT) AS parts, CAST(done AS BIGINT) AS done, CASE WHEN done = parts THEN 'complete' WHEN done = 0 THEN 'continue' ELSE 'partial_refused' END AS disposition FROM p""",
)


def outcome_join(spark, folder):
    """Every planned request with its last outcome, or none."""
    plan = table(spark, folder, "customer").select(F.col("c_custkey").alias("unit_id"), "c_mktsegment")
    joined = plan.join(J.last_outcomes(plain_log(spark, folder)), "unit_id", "left")
    return joined.select("unit_id", "c_mktsegment", F.coalesce("status", F.lit("unattempted")).alias("outcome"), "outcome_seq")


QUERIES["outcome_join"] = (
    outcome_join,
    """WITH o AS (SELECT user_id, arg_max(CASE WHEN event_type = 'purchase' THEN 'succeeded' ELSE 'failed' END, event_id) AS status, max(event_id) AS outcome_seq FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1)
SELECT c_custkey AS unit_id, c_mktsegment, coalesce(status, 'unattempted') AS outcome, outcome_seq FROM customer LEFT JOIN o ON user_id = c_custkey""",
)

OPTIONS = ("present", "absent", "insufficient")


def answers(spark, folder):
    """One answer per document, with a fault of each kind in some of them."""
    u = lambda tag: T.unit_hash(F.lit(tag), F.col("id"))
    rows = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "lang").withColumn("f", F.floor(u("fault") * 24).cast("int")).withColumn("p", T.two_decimals(u("p")))
    f, p = F.col("f"), F.col("p")
    q = T.two_decimals((F.lit(1.0) - p) * F.lit(0.7))
    r = T.two_decimals((F.lit(1.0) - p) * F.lit(0.3))
    rows = rows.withColumn("q", q).withColumn("r", r)
    top = F.greatest("p", "q", "r")
    best = F.when(p == top, "present").when(F.col("q") == top, "absent").otherwise("insufficient")
    worst = F.when(p == F.least("p", "q", "r"), "present").when(F.col("q") == F.least("p", "q", "r"), "absent").otherwise("insufficient")
    keys = F.when(f == 9, F.array(F.lit("present"), F.lit("absent"), F.lit("other"))).otherwise(F.array(*[F.lit(o) for o in OPTIONS]))
    values = F.array(F.when(f == 10, F.lit(1.2)).when(f == 11, p + F.lit(0.2)).otherwise(p), F.col("q"), F.when(f == 10, F.lit(-0.2)).otherwise(F.col("r")))
    answer = F.struct(
        F.when(f == 6, "score").otherwise("choice").alias("type"),
        F.when(f == 5, F.lit(None).cast("string")).when(f == 7, "maybe").when(f == 12, worst).otherwise(best).alias("choice"),
        F.when(f == 8, F.lit(1.5)).otherwise(top).alias("confidence"), F.map_from_arrays(keys, values).alias("probabilities"),
    )
    return rows.select(
        "id", "lang", F.lit("scorer-1.1.0").alias("requested_model"),
        F.when(f == 0, F.lit(None).cast("string")).when(f == 1, "scorer-1.2.0").otherwise("scorer-1.1.0").alias("model"),
        F.when(f == 2, F.lit(None).cast("bigint")).when(f == 3, F.lit(70000).cast("bigint")).otherwise(F.lit(1000).cast("bigint")).alias("input_tokens"), F.lit(10).cast("bigint").alias("output_tokens"),
        F.when(f != 4, answer).alias("answer"),
    )


_hf = lambda tag: B.sql_unit_hash(f"'{tag}'", "doc_id")
SQL_ANSWERS = f"""an0 AS (SELECT doc_id AS id, lang, CAST(floor({_hf('fault')} * 24) AS INTEGER) AS f, {B.sql_two(_hf('p'))} AS p FROM documents),
an1 AS (SELECT *, {B.sql_two(f'({D(1)} - p) * {D(0.7)}')} AS q, {B.sql_two(f'({D(1)} - p) * {D(0.3)}')} AS r FROM an0),
an2 AS (SELECT *, greatest(p, q, r) AS top, CASE WHEN f = 10 THEN {D(1.2)} WHEN f = 11 THEN p + {D(0.2)} ELSE p END AS vp, CASE WHEN f = 10 THEN {D(-0.2)} ELSE r END AS vr FROM an1),
an3 AS (SELECT *, CASE WHEN f <> 12 THEN top WHEN p = least(p, q, r) THEN vp ELSE least(p, q, r) END AS chosen FROM an2),
an4 AS (SELECT *, CASE WHEN f = 12 THEN least(p, q, r) WHEN p = top THEN vp ELSE top END AS picked, greatest(vp, q, vr) AS vmax, vp + q + vr AS total FROM an3)"""


def answer_validation_codes(spark, folder):
    code = J.answer_problem(F.array(*[F.lit(o) for o in OPTIONS]))
    return answers(spark, folder).select("id", F.coalesce(code, F.lit("ok")).alias("code"))


QUERIES["answer_validation_codes"] = (
    answer_validation_codes,
    f"""WITH {SQL_ANSWERS} SELECT id, CASE WHEN f = 0 THEN 'model_required' WHEN f = 1 THEN 'unexpected_model' WHEN f = 2 THEN 'usage_field_required' WHEN f = 3 THEN 'usage_value_invalid'
  WHEN f = 4 THEN 'answer_set_mismatch' WHEN f = 5 THEN 'choice_field_required' WHEN f = 6 THEN 'choice_type_invalid' WHEN f = 7 THEN 'choice_enum_invalid' WHEN f = 8 THEN 'choice_confidence_range'
  WHEN f = 9 THEN 'choice_distribution_keys' WHEN vp > 1 OR vr < 0 THEN 'choice_probability_range' WHEN abs(total - {D(1)}) > {D(K.SUM_TOLERANCE)} THEN 'choice_distribution_sum'
  WHEN picked < vmax - {D(K.WINNER_TOLERANCE)} - {D('1e-9')} THEN 'choice_winner_mismatch' ELSE 'ok' END AS code FROM an4""",
)


def distribution_checks(spark, folder):
    """Each distribution's sum, maximum and range check."""
    p = F.col("answer.probabilities")
    v = F.map_values(p)
    return answers(spark, folder).where(F.col("answer").isNotNull()).select(
        "id", F.aggregate(v, F.lit(0.0), lambda a, x: a + x).alias("total"), F.array_max(v).alias("maximum"), F.forall(v, lambda x: (x >= 0) & (x <= 1)).alias("in_range"),
    )


QUERIES["distribution_checks"] = (
    distribution_checks,
    f"WITH {SQL_ANSWERS} SELECT id, {D(0)} + vp + q + vr AS total, vmax AS maximum, vp BETWEEN 0 AND 1 AND q BETWEEN 0 AND 1 AND vr BETWEEN 0 AND 1 AS in_range FROM an4 WHERE f <> 4",
)


def answer_set_difference(spark, folder):
    """Options missing from an answer and unexpected ones, by array difference."""
    asked = F.array(*[F.lit(o) for o in OPTIONS])
    keys = F.map_keys("answer.probabilities")
    return answers(spark, folder).where(F.col("answer").isNotNull()).select(
        "id", F.array_join(F.array_except(asked, keys), ",").alias("missing"), F.size(F.array_except(keys, asked)).cast("bigint").alias("unexpected"),
    )


QUERIES["answer_set_difference"] = (
    answer_set_difference,
    f"WITH {SQL_ANSWERS} SELECT id, CASE WHEN f = 9 THEN 'insufficient' ELSE '' END AS missing, CAST(CASE WHEN f = 9 THEN 1 ELSE 0 END AS BIGINT) AS unexpected FROM an4 WHERE f <> 4",
)


def value_redaction(spark, folder):
    """What an error report may show of each property value."""
    return table(spark, folder, "events").select("event_id", J.redacted(F.get_json_object("props", "$.k"), []).alias("shown"))


QUERIES["value_redaction"] = (
    value_redaction,
    """SELECT event_id, CASE WHEN abs(CAST(json_extract_string(props, '$.k') AS DOUBLE)) <= 2 THEN 'number:' || CAST(CAST(json_extract_string(props, '$.k') AS DOUBLE) AS VARCHAR) ELSE 'number:redacted' END AS shown FROM events""",
)
