"""Exclusive matching and donor names against the one-after-the-other rules."""

import random

from pairloom.operators import sampling as G


def greedy(edges):
    taken, out = set(), {}
    for positive in sorted({e[0] for e in edges}, key=lambda p: next(e[1] for e in edges if e[0] == p)):
        free = sorted((e[3], e[2]) for e in edges if e[0] == positive and e[2] not in taken)
        if free:
            taken.add(free[0][1])
            out[positive] = free[0][1]
    return out


def matched(spark, edges):
    rows = G.exclusive_match(spark.createDataFrame(edges, "positive long, priority long, control long, cost double")).collect()
    return {r.positive: r.control for r in rows}


def test_equals_greedy_choice(spark):
    rng = random.Random(8)
    for _ in range(4):
        kinds = [{c: float(rng.randrange(6)) for c in rng.sample(range(25), rng.randint(1, 12))} for _ in range(6)]
        order = rng.sample(range(100), 30)
        edges = [(p, order[p], c, cost) for p in range(30) for c, cost in rng.choice(kinds).items()]
        assert matched(spark, edges) == greedy(edges)


def test_many_equal_positives_settle(spark):
    positives, controls = spark.range(5000).toDF("positive"), spark.range(400).toDF("control")
    near = positives.selectExpr("positive", "positive AS priority", "explode(sequence(positive div 100 * 8, positive div 100 * 8 + 40)) AS control")
    edges = near.join(controls, "control").selectExpr("positive", "priority", "control", "CAST(control AS DOUBLE) AS cost").cache()
    got = {r.positive: r.control for r in G.exclusive_match(edges).collect()}
    taken, want = set(), {}
    for p in range(5000):
        base = p // 100 * 8
        free = next((c for c in range(base, base + 41) if c < 400 and c not in taken), None)
        if free is not None:
            want[p] = free
            taken.add(free)
    assert got == want


def test_no_controls(spark):
    assert matched(spark, [(1, 1, 5, 1.0), (2, 2, 5, 1.0)]) == {1: 5}
    assert G.exclusive_match(spark.createDataFrame([], "positive long, priority long, control long, cost double")).count() == 0


def test_donors_skip_names_with_a_common_word(spark):
    rng = random.Random(1)
    names = [["all", f"w{i}"] if i < 40 else [f"w{i}", f"x{rng.randrange(3)}"] for i in range(60)]
    names[50] = sorted({w for n in names for w in n})  # shares a word with every other name
    rows = [(1000 + i, i + 1, words) for i, words in enumerate(names)]
    got = {r.id: (r.donor, r.offset) for r in G.donor_names(spark.createDataFrame(rows, "id long, place long, words array<string>"), rounds=3).collect()}
    for i, words in enumerate(names):
        gap = next((g for g in range(1, 60) if not set(words) & set(names[(i + g) % 60])), None)
        assert got.get(1000 + i) == (None if gap is None else (1000 + (i + gap) % 60, gap))
