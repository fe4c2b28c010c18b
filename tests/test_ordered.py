import random

from pyspark.sql import functions as F

from pairloom.operators.admission import admit_in_order
from pairloom.operators.ordered import merge_intervals, ranked, running


def skewed(spark, n=400):
    """One group holds most rows."""
    rng = random.Random(7)
    return [("hot" if rng.random() < 0.7 else rng.choice("abc"), i, rng.randrange(20)) for i in range(n)]


def test_running_equals_a_loop_on_a_hot_group(spark):
    rows = skewed(spark)
    out = running(spark.createDataFrame(rows, "g string, k int, v int"), ["g"], ["k"], sums={"s": F.col("v")}, maxes={"m": F.col("v")})
    got = {(r.g, r.k): (r.s, r.m) for r in out.collect()}
    seen = {}
    for g, k, v in sorted(rows):
        s, m = seen.get(g, (0, -1))
        seen[g] = (s + v, max(m, v))
        assert got[(g, k)] == seen[g]


def test_exclusive_running_leaves_the_row_out(spark):
    rows = skewed(spark, 100)
    out = running(spark.createDataFrame(rows, "g string, k int, v int"), ["g"], ["k"], sums={"s": F.col("v")}, exclusive=True)
    total = {}
    got = {(r.g, r.k): r.s for r in out.collect()}
    for g, k, v in sorted(rows):
        assert got[(g, k)] == total.get(g, 0)
        total[g] = total.get(g, 0) + v


def test_global_rank(spark):
    rows = [(i, (i * 37) % 101) for i in range(101)]
    out = ranked(spark.createDataFrame(rows, "id int, v int"), [], [F.col("v").desc(), "id"])
    assert [r.v for r in sorted(out.collect(), key=lambda r: r.rank)] == sorted((v for _, v in rows), reverse=True)


def brute_islands(rows):
    out, last = {}, {}
    for path, s, e, i in sorted(rows):
        if path not in last or s > last[path][1]:
            last[path] = [last.get(path, [0, 0])[0] + 1, e]
        last[path][1] = max(last[path][1], e)
        out[i] = last[path][0]
    return out


def test_touching_nested_and_disjoint_intervals(spark):
    rows = [("p", 0, 5, 0), ("p", 5, 7, 1), ("p", 9, 20, 2), ("p", 10, 12, 3), ("p", 21, 22, 4), ("q", 0, 1, 5), ("q", 0, 1, 6)]
    out = merge_intervals(spark.createDataFrame(rows, "path string, s long, e long, i long"), ["path"], "s", "e", ["i"])
    assert {r.i: r.island for r in out.collect()} == brute_islands(rows)


def test_random_intervals(spark):
    rng = random.Random(3)
    rows = [(rng.choice("xy"), s := rng.randrange(500), s + rng.randrange(9), i) for i in range(300)]
    out = merge_intervals(spark.createDataFrame(rows, "path string, s long, e long, i long"), ["path"], "s", "e", ["i"])
    assert {r.i: r.island for r in out.collect()} == brute_islands(rows)


def test_admission_skips_and_goes_on(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([1, 3, 8, 20, 60])) for i in range(80)]
    used = n = 0
    want = []
    for i, size in rows:
        ok = size <= 50 and n < 30 and used + size <= 130
        want.append(ok)
        used, n = used + size * ok, n + ok
    out = admit_in_order(spark.createDataFrame(rows, "id int, size long"), ["id"], "size", 130, 30, 50)
    assert [r.admitted for r in sorted(out.collect(), key=lambda r: r.id)] == want
