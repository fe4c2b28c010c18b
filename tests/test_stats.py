import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.functions import measures as M
from pairloom.operators import stats as S


def frame(spark, scores, labels):
    return spark.createDataFrame([("g", i, float(s), int(y)) for i, (s, y) in enumerate(zip(scores, labels))], "g string, id int, s double, y int")


def brute_auc(scores, labels):
    pairs = [(a > b) + 0.5 * (a == b) for a, x in zip(scores, labels) for b, y in zip(scores, labels) if x and not y]
    return sum(pairs) / len(pairs) if pairs else None


@pytest.mark.parametrize(
    "scores, labels, want", [((0.9, 0.8, 0.3, 0.2), (1, 0, 1, 0), 0.75), ((0.5,) * 4, (1, 0, 1, 0), 0.5), ((0.1, 0.2), (1, 1), None)]
)
def test_auc_known_values(spark, scores, labels, want):
    assert S.auc(frame(spark, scores, labels), ["g"], "s", "y").first().auc == want


def test_auc_brute_force(spark):
    rng = random.Random(1)
    scores, labels = [rng.randrange(8) for _ in range(80)], [rng.random() < 0.4 for _ in range(80)]
    assert S.auc(frame(spark, scores, labels), ["g"], "s", "y").first().auc == pytest.approx(brute_auc(scores, labels), abs=1e-12)


def test_precision_shares_edge_ties(spark):
    k = spark.createDataFrame([("g", 2)], "g string, k long")
    assert S.precision_at_k(frame(spark, (5, 4, 4, 1), (1, 1, 0, 0)), ["g"], "s", "y", k).first().precision == 0.75


def test_kappa_from_a_table(spark):
    rows = [("g", "a", "a")] * 20 + [("g", "a", "b")] * 5 + [("g", "b", "a")] * 10 + [("g", "b", "b")] * 15
    assert S.cohen_kappa(spark.createDataFrame(rows, "g string, x string, y string"), ["g"], "x", "y").first().kappa == pytest.approx(0.4)


def test_wilson_edges(spark):
    low, high = M.wilson(F.col("k"), F.col("n"))
    rows = spark.createDataFrame([(0, 0), (0, 10), (10, 10), (5, 10)], "k long, n long").select(low.alias("lo"), high.alias("hi")).collect()
    assert rows[0].lo is None and rows[1].lo == 0 and rows[2].hi == 1
    assert rows[3].lo == pytest.approx(0.2366, abs=1e-4)


def mulberry(seed):
    a = seed & 0xFFFFFFFF
    while True:
        a = (a + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((a ^ (a >> 15)) * (a | 1)) & 0xFFFFFFFF
        t ^= (t + (((t ^ (t >> 7)) * (t | 61)) & 0xFFFFFFFF)) & 0xFFFFFFFF
        yield ((t ^ (t >> 14)) & 0xFFFFFFFF) / 4294967296


def test_generator_is_a_counter(spark):
    for seed in (0, 1, 20260930, 4294967295):
        stream = mulberry(seed)
        got = [r.u for r in M.with_mulberry32(spark.range(50), F.lit(seed), F.col("id"), "u").orderBy("id").collect()]
        assert got == [next(stream) for _ in range(50)]


@pytest.mark.parametrize("in_order", [True, False])
def test_bootstrap_replays_the_sequential_stream(spark, in_order):
    """Items by id, or by label and score, where draws are counted by cell."""
    rng = random.Random(2)
    scores, labels = [rng.randrange(6) for _ in range(25)], [rng.random() < 0.5 for _ in range(25)]
    items = frame(spark, scores, labels)
    if in_order:
        draws = S.bootstrap_auc_in_order(items, ["g"], "s", "y", ["id"], 30, F.lit(9))
    else:
        draws = S.bootstrap_auc(items, ["g"], "s", "y", 30, F.lit(9))
        order = sorted(range(25), key=lambda i: (labels[i], scores[i]))
        scores, labels = [scores[i] for i in order], [labels[i] for i in order]
    got = {r.replicate: r.auc for r in draws.collect()}
    stream = mulberry(9)
    for b in range(30):
        at = [int(next(stream) * 25) for _ in range(25)]
        want = brute_auc([scores[i] for i in at], [labels[i] for i in at])
        assert (got[b] is None and want is None) or got[b] == pytest.approx(want, abs=1e-12)


def test_two_percentile_rules(spark):
    values = spark.createDataFrame([("g", i, float(i)) for i in range(40)] + [("few", i, float(i)) for i in range(10)], "g string, replicate int, v double")
    loose = {r.g: (r.lo, r.hi) for r in S.percentile_interval(values, ["g"], "v").collect()}
    strict = {r.g: (r.lo, r.hi) for r in S.percentile_interval_strict(values, ["g"], "v").collect()}
    assert loose == {"g": (1.0, 39.0), "few": (0.0, 9.0)}
    assert strict == {"g": (0.0, 39.0), "few": (None, None)}


def test_sign_test(spark):
    from math import comb

    rows = [("a", 9, 1), ("b", 5, 5), ("c", 0, 0), ("d", 900, 800)]
    got = {r.k: r.sign_test_p for r in S.sign_test(spark.createDataFrame(rows, "k string, up long, down long"), ["k"], "up", "down").collect()}
    for k, up, down in rows:
        n = up + down
        if n == 0:
            assert got[k] is None
            continue
        pmf = [comb(n, i) / 2**n for i in range(n + 1)]
        assert got[k] == pytest.approx(min(1, sum(p for p in pmf if p <= pmf[up] + 1e-12)), abs=1e-9)


def test_grid_counts(spark):
    rng = np.random.default_rng(0)
    rows = [("g", float(round(x, 2))) for x in rng.random(200)]
    got = {r["at"]: r.n for r in S.grid_counts(spark.createDataFrame(rows, "g string, p double"), ["g"], "p", (5, 50, 70), {"n": F.lit(True)}).collect()}
    assert got == {g: sum(p >= g / 100 - 1e-9 for _, p in rows) for g in (5, 50, 70)}


def _counted_draws(items, resamples, seed):
    """{(replicate, cell): weight} of cells given in the order of the items, from the generator in plain Python."""
    mask, n, out = 0xFFFFFFFF, len(items), {}
    for draw in range(resamples * n):
        a = (seed + (draw + 1) * 0x6D2B79F5) & mask
        t = ((a ^ (a >> 15)) * (a | 1)) & mask
        t ^= (t + (t ^ (t >> 7)) * (t | 61)) & mask
        key = (draw // n, items[int((t ^ (t >> 14)) / 4294967296 * n)])
        out[key] = out.get(key, 0) + 1
    return out


def test_resamples_of_many_cells_are_planned_and_counted(spark):
    """the plan grew threefold with every doubling of the cells, so thousands of scores were never planned."""
    rows = [("a", i % 2, float(i // 3)) for i in range(6000)] + [("b", 1, 0.5)]
    items = spark.createDataFrame(rows, "g string, y int, s double")
    found = {(r.replicate, (r.y, r.s)): r.weight for r in S.resample_cells(items, ["g"], ["y", "s"], 3, F.lit(9)).where("g = 'a'").collect()}
    assert found == _counted_draws(sorted(r[1:] for r in rows if r[0] == "a"), 3, 9)


def test_resamples_in_order_count_draws_block_by_block(spark, monkeypatch):
    """draws are counted by cell where they are made; cells with a null are drawn but left out."""
    monkeypatch.setattr(S, "BLOCK_ITEMS", 7)
    rows = [("a", i, i % 2, None if i % 5 == 0 else float(i * 7 % 11)) for i in range(40)]
    items = spark.createDataFrame(rows, "g string, id int, y int, s double")
    drawn = S.resample_cells_in_order(items, ["g"], ["y", "s"], ["id"], 60, F.lit(9)).collect()
    right = {k: n for k, n in _counted_draws([r[2:] for r in rows], 60, 9).items() if k[1][1] is not None}
    assert {(r.replicate, (r.y, r.s)): r.weight for r in drawn} == right
