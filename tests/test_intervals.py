"""Range joins against brute force, with one hot group, long, empty, equal and negative ranges."""

import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators import intervals as I
from test_nearest import shuffled_records


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = []
    for i in range(400):
        group = "hot" if i % 3 == 0 else rng.choice("abc")
        start = rng.randint(-300, 300)
        out.append((i, group, start, start + rng.choice([0, 1, 2, 7, 50, 64, 500, 2000])))
    out += [(400, "hot", 10, 20), (401, "hot", 10, 20), (402, None, 0, 900), (403, None, 5, 6)]
    return out


def pairs_of(rows, test):
    return {(x[0], y[0]) for x in rows for y in rows if x[1] is not None and x[1] == y[1] and test(x, y)}


@pytest.mark.parametrize("level", [None, 0, 3, 11])
def test_containment_and_overlap_equal_brute_force(spark, rows, level):
    table = spark.createDataFrame(rows, "id long, file string, start long, end long")
    inside = I.containing(table, table, "file", level).select("id", "r_id").collect()
    expected = pairs_of(rows, lambda x, y: y[2] < y[3] and y[2] <= x[2] < y[3] and x[3] <= y[3])
    assert len(inside) == len(expected) and {tuple(r) for r in inside} == expected
    met = I.overlapping_pairs(table, "file", "id", level).select("a", "b").collect()
    expected = pairs_of(rows, lambda x, y: x[0] < y[0] and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3])
    assert len(met) == len(expected) and {tuple(r) for r in met} == expected


def test_owners_and_outermost(spark, rows):
    table = spark.createDataFrame(rows, "id long, file string, start long, end long")
    got = {r.id: (r.owners, r.innermost, r.outermost) for r in I.owners(table, table, "file", "id", "id").collect()}
    assert len(got) == len(rows)
    for i, group, start, end in rows:
        around = [y for y in rows if group is not None and y[1] == group and y[2] <= start < y[3] and end <= y[3]]
        inner = min(around, key=lambda y: (y[3] - y[2], y[0]), default=(None,))[0]
        outer = min(around, key=lambda y: (y[2] - y[3], y[0]), default=(None,))[0]
        assert got[i] == (len(around), inner, outer)
    kept = {r.id for r in I.outermost(table, "file", "id").collect()}
    for i, group, start, end in rows:
        inside = any(y[0] != i and y[1] == group and group is not None and y[2] <= start < y[3] and end <= y[3] and ((y[2], y[3]) != (start, end) or y[0] < i) for y in rows)
        assert (i in kept) == (not inside)


def test_cells_stay_short_where_points_are_dense(spark):
    ranges = spark.range(100).selectExpr("id", "'f' AS file", "0L AS start", "1048576L AS end")
    points = spark.range(100_000).selectExpr("id", "'f' AS file", "id * 10 AS start", "id * 10 + 1 AS end")
    level = I.longest_level(ranges, points, "file", cell_rows=1000)
    assert level <= 13
    largest = points.selectExpr(f"shiftright(start, {level}) AS cell").groupBy("cell").count().agg({"count": "max"}).first()[0]
    assert largest <= 1000


def test_empty_tables(spark):
    table = spark.createDataFrame([], "id long, file string, start long, end long")
    assert I.containing(table, table, "file").count() == 0 and I.overlapping_pairs(table, "file", "id").count() == 0
    assert I.owners(table, table, "file", "id", "id").count() == 0


def test_cells_are_never_broadcast(spark, rows):
    table = spark.createDataFrame(rows, "id long, file string, start long, end long")
    plan = I.stabbed(table, table, "file", 11)._jdf.queryExecution().executedPlan().toString()
    # The only broadcast is that of the levels in use, for the semi join.
    assert "SortMergeJoin" in plan and plan.count("BroadcastExchange") == 1 and "BroadcastHashJoin [_c" in plan and "Inner, BuildRight" not in plan and "Inner, BuildLeft" not in plan


def test_owners_move_each_row_once(spark):
    """every row was shuffled once a level of its cells, and again to be joined with its owners."""
    inner = spark.range(2000).selectExpr("id", "id % 50 AS file", "id * 7 % 900 AS start", "id * 7 % 900 + 3 AS end").localCheckpoint()
    outer = spark.range(500).selectExpr("id", "id % 50 AS file", "id * 11 % 900 AS start", "id * 11 % 900 + id % 300 AS end").localCheckpoint()
    assert shuffled_records(spark, lambda: I.owners(inner, outer, "file", "id", "id", density=outer, distinct=True).collect()) < 2000 + 3 * 500


def test_owners_of_keys_that_repeat_and_of_dense_groups(spark, rows, monkeypatch):
    table = spark.createDataFrame(rows, "id long, file string, start long, end long")
    whole = sorted(map(repr, I.owners(table, table, "file", "id", "id").collect()))
    assert sorted(map(repr, I.owners(table, table, "file", "id", "id", distinct=True).collect())) == whole
    several = table.withColumn("key", F.when(F.col("id") % 9 > 0, F.col("id") % 40)).unionByName(table.where("id < 30").withColumn("key", F.col("id") % 40))
    inside = pairs_of(rows, lambda x, y: y[2] <= x[2] < y[3] and x[3] <= y[3])
    length = {r[0]: r[3] - r[2] for r in rows}
    listed, met = [], {}
    for r in several.collect():
        listed.append(r.key)
        met.setdefault(r.key, []).extend(y for x, y in inside if x == r.id)
    want = []
    for k in listed:
        own = met[k] if k is not None else []
        want.append((k, len(own), min(own, key=lambda y: (length[y], y), default=None), min(own, key=lambda y: (-length[y], y), default=None)))
    for rows_a_cell in (I.CELL_ROWS, 20):
        monkeypatch.setattr(I.dense_levels, "__defaults__", (rows_a_cell,))
        got = [tuple(r) for r in I.owners(several.drop("id"), table, "file", "key", "id").collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))
