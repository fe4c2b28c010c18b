"""From packs, answers and thresholds to cells, bands, views, queues and the length baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom import constants as K
from pairloom.functions import measures as M
from pairloom.operators.ordered import ranked
from pairloom.session import cut_lineage


def signal_table(spark: SparkSession) -> DataFrame:
    """The question dimension: nine fixed rows."""
    rows = [(i, *s) for i, s in enumerate(K.SIGNALS)]
    return spark.createDataFrame(
        rows, "position int, signal_id string, kinds array<string>, presence string, status string, cut double, floor double, has_filter boolean"
    )


def signal_array(kind: str | None = None) -> Column:
    """The same dimension as an array literal, to explode next to each unit without a join."""
    picked = [(i, s) for i, s in enumerate(K.SIGNALS) if kind is None or kind in s[1]]
    return F.array(
        *[
            F.struct(
                F.lit(i).cast("bigint").alias("position"), F.lit(s[0]).alias("signal_id"), F.lit(s[2]).alias("presence"),
                F.lit(s[3]).alias("signal_status"), F.lit(s[4]).alias("cut"), F.lit(s[5]).alias("floor"), F.lit(s[6]).alias("has_filter"),
            )
            for i, s in picked
        ]
    )


def resolve_thresholds(signals: DataFrame, cuts: dict[str, float], floors: dict[str, float]) -> DataFrame:
    """Overrides over per-question defaults; a default floor is lowered to the cut, an explicit one is checked."""
    known = {s[0] for s in K.SIGNALS}
    for name, value in [*cuts.items(), *floors.items()]:
        if name not in known:
            raise ValueError(f"unknown signal {name}")
        if not 0 <= value <= 1:
            raise ValueError("thresholds and floors lie within [0, 1]")
    for s in K.SIGNALS:
        cut = cuts.get(s[0], s[4])
        if s[0] in floors and floors[s[0]] > cut:
            raise ValueError(f"floor for {s[0]} is above its cut")

    def override(values: dict[str, float]) -> Column:
        chosen = F.lit(None).cast("double")
        for name, value in values.items():
            chosen = F.when(F.col("signal_id") == name, F.lit(value)).otherwise(chosen)
        return chosen

    cut = F.coalesce(override(cuts), F.col("cut"))
    return signals.withColumn("_cut", cut).withColumn(
        "floor", F.coalesce(override(floors), F.least("floor", "_cut"))
    ).withColumn("cut", F.col("_cut")).drop("_cut")


def missing_reasons(omitted: Column) -> Column:
    """Distinct sorted reasons of the decisive omissions; empty means the question may be asked."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(omitted, lambda o: o["decisive"]), lambda o: o["reason"])))


def cell_status(missing: Column, event_status: Column, choice: Column) -> Column:
    return (
        F.when(F.size(missing) > 0, "insufficient_context")
        .when(event_status.isNull(), "unattempted")
        .when(event_status == "failed", "error")
        .when(choice.isNull(), "unanswered")
        .when(choice == "insufficient", "model_insufficient")
        .otherwise("scored")
    )


def finish_cells(df: DataFrame) -> DataFrame:
    """Add status, score, band and near-tie facts.

    Needs missing (array), event_status, choice, confidence, probabilities (map), presence, cut and floor.
    An answer counts only for an eligible question of a request that succeeded.
    """
    usable = (F.size("missing") == 0) & (F.col("event_status") == "succeeded")
    rows = df.withColumn("choice", F.when(usable, F.col("choice"))).withColumn("confidence", F.when(usable, F.col("confidence")))
    rows = rows.withColumn("cell_status", cell_status(F.col("missing"), F.col("event_status"), F.col("choice")))
    answered = F.col("choice").isNotNull()
    tie = F.when(answered, M.near_tie(F.col("probabilities"), F.col("choice"))).otherwise(F.lit(False))
    score = F.when(F.col("cell_status") == "scored", F.col("probabilities")[F.col("presence")])
    return (
        rows.withColumn("near_tie", tie)
        .withColumn("p_positive", score)
        .withColumn("band", M.band(F.col("p_positive"), F.col("cut"), F.col("floor")))
        .withColumn("shown", F.coalesce(F.col("p_positive") >= F.col("cut"), F.lit(False)))
    )


def views(cells: DataFrame) -> DataFrame:
    """Scored cells per question, best first."""
    return ranked(cells.where(F.col("cell_status") == "scored"), ["signal_id"], [F.col("p_positive").desc(), "pack_id"])


def queue(cells: DataFrame) -> DataFrame:
    """Findings then uncertain cells, by question position, score and id; numbering runs on."""
    listed = cells.where(F.col("band").isin("worth_a_look", "uncertain")).withColumn(
        "part", F.when(F.col("band") == "worth_a_look", 0).otherwise(1).cast("bigint")
    )
    # Dealing rows by range reads them twice, so cells are made once and written.
    return ranked(cut_lineage(listed), [], ["part", "position", F.col("p_positive").desc(), "pack_id"], name="number")


def queue_runs(cells: DataFrame) -> DataFrame:
    """(part, signal_id, items, first_number, last_number): the runs of equal question in the queue.

    The queue is ordered by part and position first, and a question has one position, so counts settle where a run begins;
    no cell is ordered. There are at most twice as many runs as questions.
    """
    listed = cells.where(F.col("band").isin("worth_a_look", "uncertain"))
    part = F.when(F.col("band") == "worth_a_look", 0).otherwise(1).cast("bigint").alias("part")
    runs = listed.groupBy(part, "position", "signal_id").agg(F.count(F.lit(1)).alias("items"))
    last = F.sum("items").over(Window.orderBy("part", "position", "signal_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return runs.select("part", "signal_id", "items", (last - F.col("items") + 1).alias("first_number"), last.alias("last_number"))


def length_and_score_ranks(units: DataFrame) -> DataFrame:
    """``units(unit_id, lines, p)``: length rank for all, score rank for scored ones only."""
    by_length = ranked(units, [], [F.col("lines").desc(), "unit_id"], name="length_rank")
    scored = units.where(F.col("p").isNotNull()).select("unit_id", "p")
    by_score = ranked(scored, [], [F.col("p").desc(), "unit_id"], name="score_rank").select("unit_id", "score_rank")
    return by_length.join(by_score, "unit_id", "left")
