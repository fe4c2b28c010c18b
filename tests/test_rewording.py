import hashlib
import random

from pairloom.operators.rewording import reworded
from pairloom.plans.sampling import rewrite_chain

STEPS = (0.1, 0.4, 0.7)


def test_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([0.0, 0.2, 0.5, 1.0]), [rng.choice(["id", "é", *(f"w{j}" for j in range(40))]) for _ in range(rng.choice([0, 3, 4, 5, 30, 200]))]) for i in range(80)]
    share = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:4], 16) / 65536
    grams = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    want = {}
    for i, stop, tokens in rows:
        want[i] = (None, None)
        for step in STEPS:
            x, y = grams(tokens), grams(["id" if share(w) < step else w for w in tokens])
            j = len(x & y) / max(len(x | y), 1)
            if j <= stop:
                want[i] = (step, j)
                break
    got = reworded(spark.createDataFrame(rows, "id long, stop double, tokens array<string>"), STEPS).collect()
    assert {r.id: (r.step, r.jaccard) for r in got} == want
    assert len({step for step, _ in want.values()}) > 2


def test_no_step_is_written(spark, folder):
    """every step's words and shingles were checkpointed, then read, compared and joined back."""
    plan = rewrite_chain(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert not any(node in plan for node in ("hashpartitioning", "HashJoin", "MergeJoin", "Scan ExistingRDD")), plan
