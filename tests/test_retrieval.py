import itertools
import math
import random

from pairloom.operators import retrieval as R

SCHEMA = "slice long, id long, original long, lines long, items array<long>, surface array<long>, frequent array<long>, shape map<int,long>"


def test_slices_are_decided_in_one_task_and_equal_brute_force(spark):
    """every pair of a slice was a row that carried both units' names, shingles and shapes through a join."""
    rng = random.Random(2)
    rows = []
    for i in range(90):
        slice_ = 2 if i == 89 else i % 2
        own = sorted({rng.randrange(25) for _ in range(rng.choice([2, 12, 18]))})
        shape = {k: rng.randrange(1, 5) for k in range(rng.choice([3, 4]))}
        rows.append((slice_, i, i - 2 if i % 10 == 5 else None, rng.choice([3, 10, 12, 30]), [rng.randrange(10**6) for _ in range(4)] + [7] * (i % 3 == 0), own, [1, 2, 3], shape))
    for i in range(5, 89, 10):
        rows[i] = (*rows[i][:3], *rows[i - 2][3:4], rows[i][4], *rows[i - 2][5:])
    df = spark.createDataFrame(rows, SCHEMA)
    want = {}
    for x, y in itertools.combinations(rows, 2):
        if x[0] != y[0] or min(x[3], y[3]) < 8 or min(len(x[5]), len(y[5])) < 3 or min(x[3], y[3]) / max(x[3], y[3]) < 0.5:
            continue
        common = set(x[5]) & set(y[5])
        least = sum(min(x[7].get(k, 0), y[7].get(k, 0)) for k in range(4))
        score = (len(common) / len(set(x[5]) | set(y[5])) + least / (sum(x[7].values()) + sum(y[7].values()) - least)) / 2.0
        if score >= 0.6 and len(set(x[4]) & set(y[4])) / len(set(x[4]) | set(y[4])) < 0.12:
            key = (x[0], math.floor(score * R.SCORE_STEPS + 0.5), bool(common - {1, 2, 3}), x[2] is None and y[2] is None, y[2] == x[1])
            want[key] = want.get(key, 0) + 1
    found = R.decided_pairs(df, min_jaccard=0.12)
    assert {tuple(r)[:5]: r.n for r in found.collect()} == want and any(k[4] for k in want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "HashJoin" not in plan and "MergeJoin" not in plan
