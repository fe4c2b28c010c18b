"""Checks and accounting over an event log: hash chain, lifecycle, budget, resume and merge.

A log has seq, type (initialized, reserved, finished, stopped, complete), unit_id and, on finished events,
status, input_tokens and output_tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom import constants as K
from pairloom.operators.ordered import running

CONCRETE_MODEL = r"^[a-z][a-z0-9]*-\d+\.\d+\.\d+$"


def event_hash(*body: str) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in body]), 256)


def chain_violations(log: DataFrame, body: list[str]) -> DataFrame:
    """Rows whose own hash or link to the event before is wrong; an intact log gives none.

    Each event meets its predecessor by an equi-join on seq, so the log is never put in one ordered task.
    """
    before = log.select((F.col("seq") + 1).alias("seq"), F.col("event_hash").alias("_before"))
    problem = (
        F.when(F.col("event_hash") != event_hash(*body), "event_hash")
        .when((F.col("seq") > 0) & F.col("_before").isNull(), "sequence_gap")
        .when(~F.col("previous_hash").eqNullSafe(F.col("_before")), "previous_hash")
    )
    return log.join(before, "seq", "left").withColumn("problem", problem).where(F.col("problem").isNotNull()).drop("_before")


def lifecycle_violations(log: DataFrame) -> DataFrame:
    """Events that break reserve-then-finish per unit or come after the terminal event."""
    is_reserved, is_finished = F.col("type") == "reserved", F.col("type") == "finished"
    seen = running(
        log, ["unit_id"], ["seq"], exclusive=True,
        sums={"_reserved": is_reserved.cast("bigint"), "_finished": is_finished.cast("bigint")},
    )
    terminal = log.where(F.col("type").isin("stopped", "complete")).agg(F.min("seq").alias("_terminal"))
    end = terminal.first()["_terminal"]
    problem = (
        F.when(F.col("seq") > (F.lit(end) if end is not None else F.lit(None).cast("bigint")), "after_terminal")
        .when(is_reserved & (F.col("_reserved") > 0), "duplicate_reservation")
        .when(is_finished & (F.col("_reserved") == 0), "finish_without_reservation")
        .when(is_finished & (F.col("_finished") > 0), "duplicate_finish")
    )
    return seen.withColumn("problem", problem).where(F.col("problem").isNotNull()).drop("_reserved", "_finished")


def known_usage(input_tokens: Column, output_tokens: Column) -> Column:
    """Both counts are non-negative integers and the input stays under the cap."""
    return (
        input_tokens.isNotNull() & output_tokens.isNotNull() & (input_tokens >= 0) & (input_tokens <= K.MAX_INPUT_TOKENS) & (output_tokens >= 0)
    )


def accounting(log: DataFrame, planned: Column, *keys: str) -> DataFrame:
    """One row per group: outcomes, tokens, money known and reserved, time."""
    reserved, finished = F.col("type") == "reserved", F.col("type") == "finished"
    known = finished & known_usage(F.col("input_tokens"), F.col("output_tokens"))
    n = lambda c: F.count_if(c).cast("bigint")
    rows = log.groupBy(*keys) if keys else log.groupBy()
    total = rows.agg(
        n(reserved).alias("reserved"), n(finished).alias("finished"), n(finished & (F.col("status") == "succeeded")).alias("succeeded"),
        n(known).alias("known"), F.coalesce(F.sum(F.when(known, F.col("input_tokens"))), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum(F.when(known, F.col("output_tokens"))), F.lit(0)).alias("output_tokens"), planned.alias("planned"),
    )
    unknown = F.greatest(F.col("reserved") - F.col("known"), F.lit(0))
    usd = F.col("input_tokens").cast("double") * F.lit(K.USD_PER_MILLION) / F.lit(1e6)
    return total.select(
        *keys, "planned", "reserved", "finished", "succeeded", (F.col("finished") - F.col("succeeded")).alias("failed"),
        unknown.alias("unknown"), (F.col("planned") - F.col("reserved")).alias("unattempted"), "input_tokens", "output_tokens",
        usd.alias("known_usd"), (usd + unknown.cast("double") * F.lit(K.RESERVATION_USD)).alias("budget_accounted_usd"),
        ((F.col("succeeded") == F.col("planned")) & (unknown == 0)).alias("complete"),
    )


def budget_replay(log: DataFrame, cap_usd: float) -> DataFrame:
    """Reserve events with the money bound before them and whether one more reservation fits the cap.

    Known spending and requests in flight are running sums over the whole log, carried across slices.
    """
    known = (F.col("type") == "finished") & known_usage(F.col("input_tokens"), F.col("output_tokens"))
    flight = F.when(F.col("type") == "reserved", 1).when(known, -1).otherwise(0).cast("bigint")
    tokens = F.when(known, F.col("input_tokens")).otherwise(0).cast("bigint")
    state = running(log, [], ["seq"], exclusive=True, sums={"tokens_before": tokens, "inflight_before": flight})
    bound = (F.greatest(F.col("inflight_before"), F.lit(0)) + 1).cast("double") * F.lit(K.RESERVATION_USD)
    need = F.col("tokens_before").cast("double") * F.lit(K.USD_PER_MILLION) / F.lit(1e6) + bound
    return state.where(F.col("type") == "reserved").select(
        "seq", "unit_id", "tokens_before", "inflight_before", need.alias("needed_usd"), (need <= cap_usd).alias("dispatched"),
        F.when(need > cap_usd, "budget_reservation_exceeds_cap").alias("stop_reason"),
    )


def last_outcomes(log: DataFrame) -> DataFrame:
    """The last finished event per unit, by a combinable maximum."""
    return log.where(F.col("type") == "finished").groupBy("unit_id").agg(
        F.max_by(F.struct("status", "seq"), "seq").alias("o")
    ).select("unit_id", F.col("o.status").alias("status"), F.col("o.seq").alias("outcome_seq"))


def merge_runs(finished: DataFrame) -> DataFrame:
    """One outcome per unit over several runs; earlier failures are superseded, two successes are an error.

    ``finished`` has unit_id, run, seq and status.
    """
    per_run = finished.groupBy("unit_id", "run").agg(F.max_by("status", "seq").alias("status"))
    return per_run.groupBy("unit_id").agg(
        F.max_by("status", "run").alias("status"), F.max("run").alias("run"),
        (F.count(F.lit(1)) - 1).alias("superseded"), F.count_if(F.col("status") == "succeeded").cast("bigint").alias("successes"),
    ).withColumn("answered_twice", F.col("successes") > 1)


def resume_set(requests: DataFrame, log: DataFrame) -> DataFrame:
    """Requests without a finished event."""
    return requests.join(log.where(F.col("type") == "finished").select("unit_id"), "unit_id", "left_anti")


def continuation(parts: DataFrame) -> DataFrame:
    """Per unit: complete, to continue, or refused because only some of its parts succeeded."""
    done = F.count_if(F.col("succeeded")).cast("bigint")
    rows = parts.groupBy("unit_id").agg(F.count(F.lit(1)).alias("parts"), done.alias("done"))
    state = F.when(F.col("done") == F.col("parts"), "complete").when(F.col("done") == 0, "continue").otherwise("partial_refused")
    return rows.withColumn("disposition", state)


def served_model_problem(requested: Column, reported: Column) -> Column:
    """A pinned request needs that very version back; an alias needs some pinned version."""
    return F.when(
        requested.rlike(CONCRETE_MODEL), F.when(~requested.eqNullSafe(reported), "unexpected_model")
    ).otherwise(F.when(~F.coalesce(reported.rlike(CONCRETE_MODEL), F.lit(False)), "unresolved_model"))


def answer_problem(expected: Column) -> Column:
    """First failing check of an answer, in the order the checks apply; null when it is sound.

    Reads requested_model, model, input_tokens, output_tokens, answer (struct of type, choice, confidence
    and probabilities map).
    """
    a = F.col("answer")
    p = a["probabilities"]
    values = F.map_values(p)
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    in_range = F.forall(values, lambda v: (v >= 0) & (v <= 1))
    bad_input = (F.col("input_tokens") < 0) | (F.col("input_tokens") > K.MAX_INPUT_TOKENS) | (F.col("output_tokens") < 0)
    return (
        F.when(F.col("model").isNull(), "model_required")
        .when(served_model_problem(F.col("requested_model"), F.col("model")).isNotNull(), served_model_problem(F.col("requested_model"), F.col("model")))
        .when(F.col("input_tokens").isNull() | F.col("output_tokens").isNull(), "usage_field_required")
        .when(bad_input, "usage_value_invalid")
        .when(a.isNull(), "answer_set_mismatch")
        .when(a["type"].isNull() | a["choice"].isNull() | a["confidence"].isNull() | p.isNull(), "choice_field_required")
        .when(a["type"] != "choice", "choice_type_invalid")
        .when(~F.array_contains(expected, a["choice"]), "choice_enum_invalid")
        .when((a["confidence"] < 0) | (a["confidence"] > 1), "choice_confidence_range")
        .when(
            (F.size(F.array_except(expected, F.map_keys(p))) > 0) | (F.size(F.array_except(F.map_keys(p), expected)) > 0), "choice_distribution_keys"
        )
        .when(~in_range, "choice_probability_range")
        .when(F.abs(total - F.lit(1.0)) > F.lit(K.SUM_TOLERANCE), "choice_distribution_sum")
        .when(p[a["choice"]] < F.array_max(values) - F.lit(K.WINNER_TOLERANCE) - F.lit(K.WINNER_EPSILON), "choice_winner_mismatch")
    )


def redacted(value: Column, allowed: list[str]) -> Column:
    """What may be shown of a JSON value: its type, small numbers, listed strings, otherwise only a size."""
    v = F.try_parse_json(value)
    kind = F.schema_of_variant(v)
    number = F.try_variant_get(v, "$", "double")
    text = F.try_variant_get(v, "$", "string")
    return (
        F.when(value.isNull(), "missing")
        .when(v.isNull(), "invalid")
        .when(kind == "VOID", "null")
        .when(kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), F.when(F.abs(number) <= 2, F.concat(F.lit("number:"), number.cast("string"))).otherwise("number:redacted"))
        .when(kind == "STRING", F.when(text.isin(*allowed), F.concat(F.lit("enum:"), text)).otherwise(F.concat(F.lit("string:"), F.length(text).cast("string"))))
        .when(kind.startswith("ARRAY"), "array")
        .otherwise("object")
    )
