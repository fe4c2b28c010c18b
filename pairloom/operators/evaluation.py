"""Gate, calibration, label import and reconciliation, as conditional aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom import constants as K
from pairloom.functions import measures as M
from pairloom.operators import stats as S

LABELS = ("actionable", "no_action", "uncertain")


def _n(c: Column) -> Column:
    return F.count_if(c).cast("bigint")


def gate_signals(joined: DataFrame, labeler_ok: bool, rule: dict = K.GATE) -> DataFrame:
    """Verdict per question from reviewed cells: ``joined`` has signal_id, stratum, project and label.

    Sample size and project checks come before the rates; a missing below-cut rate counts as beaten.
    """
    above = F.col("stratum") == "above_cut_random"
    below = F.col("stratum").isin("below_cut_near", "below_cut_random")
    hit = F.col("label") == "actionable"
    g = joined.where(F.col("label").isNotNull()).groupBy("signal_id").agg(
        _n(above).alias("n"), _n(above & hit).alias("actionable"), _n(above & (F.col("label") == "uncertain")).alias("uncertain"),
        _n(below).alias("below_n"), _n(below & hit).alias("below_actionable"),
        F.count_distinct(F.when(above, F.col("project"))).alias("projects"), _n(F.col("stratum") == "above_cut_top").alias("top_ignored"),
    )
    rate, below_rate = M.rate(F.col("actionable"), F.col("n")), M.rate(F.col("below_actionable"), F.col("below_n"))
    low, high = M.wilson(F.col("actionable"), F.col("n"))
    beats = below_rate.isNull() | (rate > below_rate)
    enough = F.lit(labeler_ok) & (F.col("n") >= rule["min_reviewed"]) & (F.col("projects") >= rule["min_projects"])
    verdict = (
        F.when(~enough, "experimental")
        .when((rate >= rule["actionable"]) & beats, "default")
        .when((rate >= rule["low_precision"]) & beats, "default_low_precision")
        .otherwise("experimental")
    )
    reason = (
        F.when(~F.lit(labeler_ok), "labels are not from a human or a calibrated judge")
        .when(F.col("n") < rule["min_reviewed"], "too few random above-cut cells reviewed")
        .when(F.col("projects") < rule["min_projects"], "too few projects")
        .when(verdict == "experimental", F.when(beats, "actionable rate is below the bar").otherwise("actionable rate does not beat the below-cut rate"))
    )
    noise = M.noise_floor(F.col("n"))
    near = F.coalesce((F.abs(rate - rule["actionable"]) <= noise) | (F.abs(rate - rule["low_precision"]) <= noise), F.lit(False))
    return g.select(
        "signal_id", "n", "actionable", "uncertain", "projects", "top_ignored", rate.alias("rate"), below_rate.alias("below_rate"),
        low.alias("lo"), high.alias("hi"), verdict.alias("verdict"), reason.alias("reason"), near.alias("within_noise_of_bar"),
    )


def gate_release(signals: DataFrame, labeler_ok: bool, rule: dict = K.GATE) -> DataFrame:
    """How many questions passed, and what that decides."""
    passed = _n(F.col("verdict").isin("default", "default_low_precision"))
    outcome = (
        F.when(~F.lit(labeler_ok), "not_decidable")
        .when(F.col("default_signals") >= rule["stable_at"], "stable")
        .when(F.col("default_signals") <= rule["pivot_at"], "pivot")
        .otherwise("stay_alpha")
    )
    return signals.agg(passed.alias("default_signals")).withColumn("outcome", outcome)


def calibrate(pairs: DataFrame, keys: list[str], rule: dict = K.CALIBRATION) -> DataFrame:
    """Judge against reference labels: ``pairs`` has keys, human and judge. Only clear human labels count."""
    shared = pairs.where(F.col("human").isNotNull() & F.col("judge").isNotNull())
    clear = shared.where(F.col("human") != "uncertain")
    counts = shared.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("overlap"), _n(F.col("human") != "uncertain").alias("clear_cases"),
        _n((F.col("human") != "uncertain") & (F.col("judge") == "uncertain")).alias("judge_uncertain_on_clear"),
    )
    kappa = S.cohen_kappa(clear, keys, "human", "judge").drop("n")
    low, high = M.wilson(F.coalesce(F.col("agree"), F.lit(0)), F.col("clear_cases"))
    ok = (F.col("clear_cases") >= rule["min_clear"]) & (F.col("agreement") >= rule["target"])
    return counts.join(kappa, keys, "left").select(
        *keys, "overlap", "clear_cases", (F.col("overlap") - F.col("clear_cases")).alias("human_uncertain"), "judge_uncertain_on_clear",
        F.coalesce("agree", F.lit(0)).alias("agree"), "agreement", low.alias("lo"), high.alias("hi"), "kappa", F.coalesce(ok, F.lit(False)).alias("calibrated"),
    )


def import_problems(tasks: DataFrame, rows: DataFrame) -> DataFrame:
    """Problem rows of a label file: ``tasks(task_id)`` and ``rows(task_id, position, label, rationale)``."""
    good = F.col("label").isin(*LABELS) & (F.length(F.trim(F.coalesce("rationale", F.lit("")))) > 0)
    known = rows.join(tasks.select("task_id", F.lit(True).alias("_known")), "task_id", "left")
    # The first acceptable row of a task counts; later rows of that task are duplicates.
    first = known.where(F.col("_known") & good).groupBy("task_id").agg(F.min("position").alias("_first"))
    checked = known.join(first, "task_id", "left")
    problem = (
        F.when(F.col("_known").isNull(), "unknown_task")
        .when(F.col("position") > F.col("_first"), "duplicate_task")
        .when(~F.coalesce(F.col("label").isin(*LABELS), F.lit(False)), "invalid_label")
        .when(F.length(F.trim(F.coalesce("rationale", F.lit("")))) == 0, "missing_rationale")
    )
    bad = checked.withColumn("problem", problem).where(F.col("problem").isNotNull()).select("task_id", "position", "problem")
    missing = tasks.join(first, "task_id", "left_anti").select("task_id", F.lit(None).cast("bigint").alias("position"), F.lit("no_label").alias("problem"))
    return bad.unionByName(missing)


def normalise_labels(files: DataFrame) -> DataFrame:
    """Three label-file schemas to (file, card_id, signal_id, label, note, source_type, who).

    ``files`` has path, schema, and the nested columns cards (with evaluations) and labels.
    """
    nested = files.where(F.col("schema") == "blind-relational-reference/1").select(
        "path", F.lit("llm_reviewer").alias("source_type"), F.col("who"), F.explode("cards").alias("c")
    ).select("path", "source_type", "who", F.col("c.card_id").alias("card_id"), F.explode("c.evaluations").alias("e")).select(
        "path", "card_id", F.col("e.signal_id").alias("signal_id"), F.col("e.label").alias("label"), F.col("e.rationale").alias("note"), "source_type", "who"
    )
    flat = files.where(F.col("schema").isin("human-labels/1", "eval-labels/1")).select(
        "path", F.when(F.col("schema") == "human-labels/1", "human").otherwise(F.col("source_type")).alias("source_type"), "who", F.explode("labels").alias("l")
    ).select("path", "l.card_id", "l.signal_id", "l.label", "l.note", "source_type", "who")
    rows = nested.unionByName(flat)
    return rows.where(F.col("label").isNotNull() & (F.col("label") != ""))


def label_problems(labels: DataFrame) -> DataFrame:
    """Invalid labels, duplicate keys, and "human" files whose labeler names a model."""
    looks_like_model = F.col("who").rlike(r"(?i)\b(?:llm|gpt|gemini|model|not human)\b")
    bad = labels.where(~F.col("label").isin(*LABELS)).select("path", "card_id", "signal_id", F.lit("invalid_label").alias("problem"))
    twice = labels.groupBy("path", "card_id", "signal_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("path", "card_id", "signal_id", F.lit("duplicate_label").alias("problem"))
    model = labels.where((F.col("source_type") == "human") & looks_like_model).select("path", "card_id", "signal_id", F.lit("labeler_is_a_model").alias("problem"))
    return bad.unionByName(twice).unionByName(model)
