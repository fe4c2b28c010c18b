"""Top-k by overlap and length against brute force, with ties, empty sets and small groups."""

import random

import pytest

from pairloom.operators import nearest
from pairloom.operators.nearest import nearest_by_overlap


@pytest.mark.parametrize(("k", "vocabulary"), [(1, 30), (3, 30), (3, 400), (7, 12)])
def test_equals_brute_force(spark, k, vocabulary):
    rng = random.Random(k * vocabulary)
    rows = []
    for i in range(160):
        own = sorted({rng.randrange(vocabulary) if rng.random() < 0.5 else rng.randrange(4) for _ in range(rng.choice([0, 1, 5, 12, 30]))})
        rows.append((i, rng.choice(["x", "x", "y"]), rng.choice([1, 10, 10, 11, 50, 51, 300]), own))
    rows += [(500, "lonely", 3, [1]), (501, "few", 3, [1]), (502, "few", 9, [2]), (503, "few", 0, [1]), (504, None, 3, [1])]
    q, c = rows[::3] + [rows[-5], rows[-4], rows[-1]], [r for i, r in enumerate(rows[:160]) if i % 3] + [rows[-3], rows[-2]]
    schema = "id long, g string, n long, entries array<long>"
    got = nearest_by_overlap(spark.createDataFrame(q, schema).dropDuplicates(["id"]), spark.createDataFrame(c, schema), "g", k).collect()
    want = {}
    for i, g, n, own in {r[0]: r for r in q}.values():
        costs = []
        for j, h, m, other in c:
            if g is not None and g == h:
                union = len(set(own) | set(other))
                overlap = len(set(own) & set(other)) / max(union, 1)
                costs.append(((1.0 - overlap) / 0.03 + abs(m - n) / max(n, 1) / 0.15, j, overlap))
        for rank, (cost, j, overlap) in enumerate(sorted(costs)[:k], 1):
            want[i, rank] = (j, overlap, cost)
    assert {(r.query, r.rank): (r.candidate, r.overlap, r.cost) for r in got} == want


def shuffled_records(spark, action):
    """Rows written to shuffles while ``action`` runs."""
    context, jvm, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm, spark.sparkContext._gateway

    def total():
        context.listenerBus().waitUntilEmpty()
        none = jvm.java.util.ArrayList()
        stages = context.statusStore().stageList(none, False, False, gateway.new_array(jvm.double, 0), none)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    action()
    return total() - before


def test_no_pair_is_shuffled(spark):
    """rows that all share common entries were met as rows, 90,000 of them here, and joined with both sets."""
    schema = "id long, g string, n long, entries array<long>"
    rows = [(i, "x", 10 + i % 7, [1, 2, 3, 100 + i % 50]) for i in range(600)]
    q, c = spark.createDataFrame(rows[:300], schema), spark.createDataFrame(rows[300:], schema)
    assert shuffled_records(spark, lambda: nearest_by_overlap(q, c, "g", 3).collect()) < 5_000


def test_blocks_and_steps_equal_one_block(spark, monkeypatch):
    """queries and candidates dealt into many blocks, counted in small steps, by lists and by product."""
    rng = random.Random(5)
    schema = "id long, g string, n long, entries array<long>"
    rows = [(i, "x", rng.choice([5, 9, 40]), sorted(rng.sample(range(60), rng.choice([0, 3, 20])))) for i in range(200)]
    q, c = spark.createDataFrame(rows[:80], schema), spark.createDataFrame(rows[80:], schema)
    whole = sorted(nearest_by_overlap(q, c, "g", 4).collect())
    assert len(whole) == 80 * 4
    assert sorted(nearest_by_overlap(q, c, "g", 4, query_rows=7, candidate_rows=11).collect()) == whole
    for name, value in (("STEP_QUERIES", 3), ("STEP_CANDIDATES", 10), ("STEP_MEETINGS", 5), ("MOST_COMMON", 2)):
        monkeypatch.setattr(nearest, name, value)
    assert sorted(nearest_by_overlap(q, c, "g", 4).collect()) == whole
    monkeypatch.setattr(nearest, "COMMON_SHARE", 2.0)
    assert sorted(nearest_by_overlap(q, c, "g", 4, query_rows=9).collect()) == whole


def test_hard_negatives_list_no_pair(spark, folder):
    """pairs of all labelled texts were met by their words; 36,380 rows were shuffled here."""
    from pairloom.plans.controls import hard_negatives

    documents = spark.read.parquet(f"{folder}/documents.parquet").count()
    found = shuffled_records(spark, lambda: hard_negatives(spark, folder).collect())
    assert found < 20 * documents, found
