"""Similarity and rate arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom import constants as K


def jaccard_counts(common: Column, size_a: Column, size_b: Column) -> Column:
    """Intersection over union from counts; two empty sets give 0."""
    return common.cast("double") / F.greatest(size_a + size_b - common, F.lit(1)).cast("double")


def jaccard(a: Column, b: Column) -> Column:
    return jaccard_counts(F.size(F.array_intersect(a, b)), F.size(a), F.size(b))


def size_ratio(a: Column, b: Column) -> Column:
    return F.least(a, b).cast("double") / F.greatest(a, b).cast("double")


def shape_similarity(a: Column, b: Column) -> Column:
    """Sum of minima over sum of maxima of two histograms; 0 when both are empty."""
    merged = F.map_values(
        F.map_zip_with(
            a,
            b,
            lambda _, x, y: F.struct(
                F.least(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))).cast("bigint").alias("lo"),
                F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))).cast("bigint").alias("hi"),
            ),
        )
    )
    zero = F.lit(0).cast("bigint")
    least = F.aggregate(merged, zero, lambda acc, v: acc + v["lo"])
    most = F.aggregate(merged, zero, lambda acc, v: acc + v["hi"])
    return F.when(most > 0, least.cast("double") / most.cast("double")).otherwise(F.lit(0.0))


def rate(k: Column, n: Column) -> Column:
    return F.when(n > 0, k.cast("double") / n.cast("double"))


def noise_floor(n: Column) -> Column:
    return F.when(n > 0, F.lit(1.0) / F.sqrt(n.cast("double")))


def wilson(k: Column, n: Column, z: float = K.WILSON_Z) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson interval; null without trials."""
    kk, nn = k.cast("double"), F.when(n > 0, n.cast("double"))
    z2 = F.lit(z * z)
    p = kk / nn
    denominator = F.lit(1.0) + z2 / nn
    center = (p + z2 / (F.lit(2.0) * nn)) / denominator
    half = F.lit(z) * F.sqrt((p * (F.lit(1.0) - p)) / nn + z2 / (F.lit(4.0) * nn * nn)) / denominator
    low = F.when(nn.isNotNull(), F.greatest(F.lit(0.0), center - half))
    high = F.when(nn.isNotNull(), F.least(F.lit(1.0), center + half))
    return low, high


def percent(x: Column) -> Column:
    return F.when(x.isNull(), F.lit("n/a")).otherwise(
        F.concat(F.floor(x * 100 + F.lit(0.5)).cast("bigint").cast("string"), F.lit("%"))
    )


def with_noise(k: Column, n: Column) -> Column:
    text = F.concat(
        k.cast("string"), F.lit("/"), n.cast("string"), F.lit(" = "), percent(rate(k, n)),
        F.lit(" ±"), percent(noise_floor(n)), F.lit(" noise floor"),
    )
    return F.when(n > 0, text).otherwise(F.lit("n/a"))


def rounded(x: Column, digits: int) -> Column:
    """Half toward plus infinity, unlike SQL ``round``."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def band(p: Column, cut: Column, floor: Column) -> Column:
    return (
        F.when(p.isNull(), F.lit(None).cast("string"))
        .when(p >= cut, "worth_a_look")
        .when(p >= floor, "uncertain")
        .otherwise("below")
    )


def near_tie(probabilities: Column, choice: Column) -> Column:
    """The chosen option lies below the maximum by more than the winner epsilon."""
    return probabilities[choice] < F.array_max(F.map_values(probabilities)) - F.lit(K.WINNER_EPSILON)


def imul32(a: Column, b: Column) -> Column:
    """Low 32 bits of the product of two unsigned 32-bit numbers held in bigint."""
    low = F.lit(65535).cast("bigint")
    high = F.shiftleft((F.shiftright(a, 16) * b).bitwiseAND(low), 16)
    return (a.bitwiseAND(low) * b + high).bitwiseAND(F.lit(4294967295))


def with_mulberry32(df: DataFrame, seed: Column, draw: Column, name: str) -> DataFrame:
    """Add draw number ``draw`` (from 0) of the 32-bit generator: its state is a counter, so any draw stands alone.

    Each mixing step is its own column, so no step is computed twice.
    """
    mask = F.lit(4294967295)
    one, sixty_one = F.lit(1).cast("bigint"), F.lit(61).cast("bigint")
    step = (draw.cast("bigint") + 1).bitwiseAND(mask) * F.lit(0x6D2B79F5)
    a, t, z = F.col("_m0"), F.col("_m1"), F.col("_m2")
    return (
        df.withColumn("_m0", (seed.cast("bigint").bitwiseAND(mask) + step.bitwiseAND(mask)).bitwiseAND(mask))
        .withColumn("_m1", imul32(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(one)))
        .withColumn("_m2", t.bitwiseXOR((t + imul32(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(sixty_one))).bitwiseAND(mask)))
        .withColumn(name, z.bitwiseXOR(F.shiftright(z, 14)).cast("double") / F.lit(4294967296.0))
        .drop("_m0", "_m1", "_m2")
    )
