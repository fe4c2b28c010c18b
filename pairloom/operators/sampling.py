"""Seeded samples, matching and renames as rounds of joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom import constants as K
from pairloom.operators.ordered import first_n, ranked
from pairloom.session import cut_lineage, written


def seeded_order(seed: str, key: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256)


def hash_sample(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """The ``n`` rows with the smallest seeded hash: a top-k, so no full sort."""
    return df.withColumn("_o", seeded_order(seed, key)).orderBy("_o", key).limit(n).drop("_o")


def hash_shuffle(df: DataFrame, keys: list[str], key: str, seed: str) -> DataFrame:
    """A seeded order per group, as a position."""
    return ranked(df.withColumn("_o", seeded_order(seed, key)), keys, ["_o", key], name="place").drop("_o")


def stratified_sample(
    items: DataFrame, conflicts: DataFrame, seed: str, per_stratum: int = K.STRATUM_SIZE, per_file: int = K.STRATUM_PER_FILE
) -> DataFrame:
    """Up to ``per_stratum`` items per (repo, stratum) in seeded order, with a cap per file and no near copies.

    ``items`` has id, repo, stratum (ordinal), file, content and class (the id if left out); ``conflicts(a, b)`` lists
    classes of near copies in both directions, with a = b where the members of a class are near copies of each other. An
    item is refused when its file is used up, its content was chosen in the repo, or a near copy was chosen in its
    stratum. Strata go one after the other. Each round looks at the next few candidates per repo only and settles them
    in order; the rest stays distributed.
    """
    batch = per_stratum * 2
    if "class" not in items.columns:
        items = items.withColumn("class", F.col("id"))
    placed = cut_lineage(hash_shuffle(items, ["repo", "stratum"], "id", seed))
    conflicts = cut_lineage(conflicts)
    chosen = placed.limit(0).select("id", "repo", "stratum", "file", "content", "class")
    strata = [r[0] for r in placed.select("stratum").distinct().orderBy("stratum").collect()]
    for stratum in strata:
        mine = placed.where(F.col("stratum") == stratum)
        refused = mine.limit(0).select("id")
        while True:
            have = chosen.where(F.col("stratum") == stratum).groupBy("repo").agg(F.count(F.lit(1)).alias("_have"))
            open_rows = mine.join(chosen.select("id"), "id", "left_anti").join(refused, "id", "left_anti").join(have, "repo", "left")
            open_rows = open_rows.where(F.coalesce("_have", F.lit(0)) < per_stratum)
            near_chosen = chosen.where(F.col("stratum") == stratum).select("repo", F.col("class").alias("a")).distinct()
            blocked_by = near_chosen.join(conflicts, "a").select(F.col("repo").alias("_repo"), F.col("b").alias("_class")).distinct()
            used = chosen.groupBy("repo", "file").agg(F.count(F.lit(1)).alias("_used"))
            content = chosen.select("repo", "content").distinct()
            blocked = F.col("repo").eqNullSafe(F.col("_repo")) & (F.col("class") == F.col("_class"))
            free = open_rows.join(blocked_by, blocked, "left_anti").join(content, ["repo", "content"], "left_anti").join(used, ["repo", "file"], "left")
            free = free.where(F.coalesce("_used", F.lit(0)) < per_file)
            ahead = first_n(free, ["repo"], ["place"], batch, name="_r")
            ahead = cut_lineage(ahead.select("id", "repo", "file", "content", "class", "place", F.coalesce("_have", F.lit(0)).alias("have"), F.coalesce("_used", F.lit(0)).alias("used")))
            if ahead.isEmpty():
                break
            classes = ahead.select("class").distinct()
            edges = conflicts.join(classes.select(F.col("class").alias("a")), "a").join(classes.select(F.col("class").alias("b")), "b")
            near = edges.groupBy(F.col("a").alias("class")).agg(F.collect_set("b").alias("near"))
            ready = ahead.join(near, "class", "left")
            settled = cut_lineage(ready.groupBy("repo").applyInPandas(_settle(per_stratum, per_file), "id long, repo string, file string, content string, class long, taken boolean"))
            taken = settled.where("taken").select("id", "repo", F.lit(stratum).cast(placed.schema["stratum"].dataType).alias("stratum"), "file", "content", "class")
            chosen = cut_lineage(chosen.unionByName(taken))
            refused = cut_lineage(refused.unionByName(settled.where(~F.col("taken")).select("id")))
    return chosen.select("id", "repo", "stratum", "file")


def _settle(per_stratum: int, per_file: int):
    """Greedy choice over one bounded batch (twice the stratum size) of a repo."""

    def settle(pdf):
        pdf = pdf.sort_values("place")
        count = int(pdf["have"].max())
        files = dict(zip(pdf["file"], pdf["used"]))
        seen, picked, taken = set(), set(), []
        # ``class`` is no name of a tuple's field.
        for row, kind in zip(pdf.itertuples(), pdf["class"]):
            near = set(row.near) if row.near is not None else set()
            ok = count < per_stratum and files[row.file] < per_file and row.content not in seen and not (near & picked)
            if ok:
                count += 1
                files[row.file] += 1
                seen.add(row.content)
                picked.add(kind)
            taken.append(ok)
        return pdf.assign(taken=taken)[["id", "repo", "file", "content", "class", "taken"]]

    return settle


def donor_names(named: DataFrame, rounds: int = 6) -> DataFrame:
    """A donor for each name that shares no word with it: the next such name in a fixed circular order.

    ``named`` has id, place (1..n) and words. The first rounds try the next place each by an equi-join and keep only the
    unmatched names. Of those left, who share words with all names near them, the gaps to names with a common word are
    joined by word; the first gap missing among them is the donor's. Names that meet all others get none.
    """
    n = named.count()
    ring = named.select(F.col("place").alias("_place"), F.col("id").alias("donor"), F.col("words").alias("_words"))
    left, done = cut_lineage(named), []
    for offset in range(1, min(n, rounds + 1)):
        step = left.withColumn("_place", F.pmod(F.col("place") + (offset - 1), F.lit(n)) + 1).join(ring, "_place").drop("_place")
        step = cut_lineage(step.withColumn("_ok", ~F.arrays_overlap("words", "_words")))
        done.append(step.where("_ok").select("id", "donor", F.lit(offset).cast("bigint").alias("offset")))
        left = step.where(~F.col("_ok")).select(*named.columns)
        if left.isEmpty():
            break
    else:
        first = min(n, rounds + 1)
        word = lambda rows, *columns: rows.select(*columns, F.explode(F.array_distinct("words")).alias("w"))
        met = word(left, "id", "place").join(word(named.select(F.col("place").alias("other"), "words"), "other"), "w")
        gap = F.pmod(F.col("other") - F.col("place"), F.lit(n))
        gaps = met.select("id", gap.alias("gap")).where(F.col("gap") >= first).distinct()
        unbroken = ranked(gaps, ["id"], ["gap"], name="rn").where(F.col("gap") == F.col("rn") + (first - 1)).groupBy("id").agg(F.count(F.lit(1)).alias("run"))
        placed = left.join(unbroken, "id", "left").withColumn("offset", (F.coalesce("run", F.lit(0)) + first).cast("bigint")).where(F.col("offset") < n)
        target = F.pmod(F.col("place") + F.col("offset") - 1, F.lit(n)) + 1
        done.append(placed.withColumn("_place", target).join(ring, "_place").select("id", "donor", "offset"))
    return reduce(DataFrame.unionByName, done)


def exclusive_match(edges: DataFrame) -> DataFrame:
    """Each positive, in priority order, gets its cheapest control that no earlier positive took.

    ``edges`` has positive, priority, control and cost; priorities are distinct. A proposal by an earlier positive means
    that somebody no later than it will hold the control, so in each round a positive passes over the controls that
    earlier ones have proposed to. Positives with the same order of preference form a class, in which the r-th one
    also passes over r - 1 controls for the others of its class, beside those that positives earlier than the whole class
    proposed to. The true choice is never passed over. Rounds go on until no proposal changes: then nobody proposes to
    the same control, and that is the one-after-the-other choice. Equal positives, however many, settle at once; the
    number of rounds grows with chains between classes.
    """
    order = Window.partitionBy("positive").orderBy("at")
    listed = edges.select("positive", "priority", "control", "cost").withColumn("at", F.row_number().over(Window.partitionBy("positive").orderBy("cost", "control")))
    listed = written(listed)
    kinds = listed.groupBy("positive", "priority").agg(
        F.bit_xor(F.xxhash64("at", "control")).alias("k1"), F.bit_xor(F.xxhash64("control", "at", F.lit(1))).alias("k2"), F.count(F.lit(1)).alias("k3")
    )
    kinds = written(kinds.select("positive", "priority", F.concat_ws(",", "k1", "k2", "k3").alias("kind")))
    first = kinds.groupBy("kind").agg(F.min("priority").alias("first"))
    turns = ranked(kinds, ["kind"], ["priority"], name="turn").join(first, "kind").select("positive", "first", "turn")
    listed = written(listed.join(turns, "positive"))
    claims, before = listed.select("control", F.col("priority").alias("by")).where(F.lit(False)), None
    while True:
        rows = listed.join(claims, "control", "left")
        untaken = F.coalesce(F.col("by") >= F.col("first"), F.lit(True)).cast("int")
        # How many controls the positives before the class have left, up to each place of the list.
        rows = rows.withColumn("left", F.sum(untaken).over(order)).where((F.col("left") >= F.col("turn")) & F.coalesce(F.col("by") >= F.col("priority"), F.lit(True)))
        offers = rows.groupBy("positive", "priority").agg(F.min(F.struct("at", "control", "cost")).alias("o"))
        offers = written(offers.select("positive", "priority", F.col("o.control").alias("control"), F.col("o.cost").alias("cost")))
        if before is not None and offers.join(before, ["positive", "control"], "left_anti").isEmpty():
            return offers.select("positive", "control", "cost")
        claims = written(claims.unionByName(offers.select("control", F.col("priority").alias("by"))).groupBy("control").agg(F.min("by").alias("by")))
        before = offers.select("positive", "control")
