import itertools
import random

from pyspark.sql import functions as F

from pairloom.functions import text as T
from pairloom.operators import similarity as S
from pairloom.operators import vocabulary
from pairloom.operators.components import connected_components
from pairloom.operators.skew import blocked_self_join_sides, lookup_join, semi_join
from test_nearest import shuffled_records


def jaccard(a, b):
    return len(a & b) / max(len(a | b), 1)


def random_sets(seed, n=60):
    """Near copies, exact copies and one entry present in nearly every set."""
    rng = random.Random(seed)
    base = [set(rng.sample(range(200), 20)) for _ in range(6)]
    out = {}
    for i in range(n):
        s = set(rng.choice(base))
        for _ in range(rng.randrange(12)):
            s.discard(rng.choice(sorted(s)))
            s.add(rng.randrange(200))
        out[i] = s | ({999} if rng.random() < 0.9 else set())
    out[n] = set()
    return out


def test_pairs_equal_brute_force_with_tiny_blocks_and_hot_keys(spark):
    for seed in (1, 2):
        sets = random_sets(seed)
        lines = {i: 10 + i % 9 for i in sets}
        df = spark.createDataFrame([(i, lines[i], 1, sorted(s)) for i, s in sets.items()], "cid long, lines long, copies long, items array<long>")
        got = {(r.a, r.b): r.jaccard for r in S.similar_class_pairs(df, block_rows=4, hot_rows=5).collect()}
        want = {
            (a, b): jaccard(sets[a], sets[b])
            for a, b in itertools.combinations(sorted(sets), 2)
            if jaccard(sets[a], sets[b]) >= 0.45 and min(lines[a], lines[b]) / max(lines[a], lines[b]) >= 0.5
        }
        assert got == want and want


def test_copies_are_one_row_with_a_count(spark):
    words = "one two three four five six seven".split()
    rows = [(i, words, 9) for i in range(50)] + [(99, ["x"], 9)]
    classes = S.content_classes(spark.createDataFrame(rows, "id long, tokens array<string>, lines long"))
    from pairloom.functions import text as T

    out = S.similar_class_pairs(classes.select("cid", "lines", "copies", T.shingle_hashes(F.col("tokens")).alias("items"))).collect()
    assert [(r.a, r.b, r.pairs, r.jaccard) for r in out] == [(0, 0, 50 * 49 // 2, 1.0)]


def test_low_overlap_decisions_equal_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(40):
        topic = rng.randrange(5)
        surface = {f"w{topic}_{rng.randrange(12)}" for _ in range(10)} | {f"c{rng.randrange(4)}" for _ in range(3)}
        shape = {k: rng.randrange(1, 6) for k in range(4)}
        items = {topic * 100 + rng.randrange(10) for _ in range(rng.randrange(2, 8))}
        rows.append((i, 10 + rng.randrange(20), sorted(items), sorted(surface), shape))
    df = spark.createDataFrame(rows, "cid long, lines long, items array<long>, surface array<string>, shape map<int,long>")
    got = {(r.a, r.b): (r.reason, r.score) for r in S.low_overlap_decisions(df, min_score=0.6).collect()}
    want = {}
    for x, y in itertools.combinations(rows, 2):
        sx, sy = set(x[3]), set(y[3])
        if not sx & sy:
            continue
        shape = sum(min(x[4][k], y[4][k]) for k in x[4]) / sum(max(x[4][k], y[4][k]) for k in x[4])
        score = (jaccard(sx, sy) + shape) / 2
        if min(x[1], y[1]) / max(x[1], y[1]) < 0.5:
            reason = "size_ratio"
        elif jaccard(set(x[2]), set(y[2])) >= 0.45:
            reason = "high_overlap"
        else:
            reason = "proposed" if score >= 0.6 else "score"
        want[(x[0], y[0])] = (reason, score if reason == "proposed" else None)
    assert got == want
    assert {r for r, _ in want.values()} == {"size_ratio", "high_overlap", "proposed", "score"}


def test_blocks_meet_each_pair_once(spark):
    df = spark.createDataFrame([("hot", i) for i in range(37)] + [("cold", i) for i in range(3)], "k string, m long")
    left, right = blocked_self_join_sides(df, "k", "m", 5)
    pairs = left.alias("l").join(right.alias("r"), ["k", "_cell"]).where("l.m < r.m").select("k", F.col("l.m"), F.col("r.m")).collect()
    assert len(pairs) == len(set(pairs)) == 37 * 36 // 2 + 3


def test_lookup_join_equals_join(spark):
    big = spark.createDataFrame([(i % 3 if i < 90 else i, i) for i in range(120)], "k long, v long")
    small = spark.createDataFrame([(k, f"n{k}") for k in range(100)], "k long, n string")
    assert sorted(lookup_join(big, small, "k", min_rows=5).collect()) == sorted(big.join(small, "k").select("k", "v", "n").collect())


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200)]
    out = connected_components(spark.createDataFrame(edges, "u long, v long"), hot_rows=10).collect()
    assert {r.member: r.cluster for r in out} == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 140)}, **{i: 200 for i in (200, 201, 202)}}


def test_coverage_counts_union_of_windows(spark):
    small, other = list("abcdefghij"), list("zzabcdxxefghij")
    df = spark.createDataFrame([(1, 2, small, other)], "a long, b long, small array<string>, other array<string>")
    assert S.token_coverage(df, 3, "c").first().c == 1.0
    assert S.token_coverage(df, 5, "c").first().c == 0.6


def test_coverage_equals_brute_force_without_a_shuffle(spark):
    rng = random.Random(7)
    rows = []
    for i in range(60):
        small = [rng.choice("abcd") for _ in range(rng.choice([0, 1, 9, 10, 30, 80]))]
        other = small[rng.randint(0, 9):] + [rng.choice("abcd") for _ in range(rng.randint(0, 40))]
        rows.append((i, i + 100, small, other))
    df = spark.createDataFrame(rows, "a long, b long, small array<string>, other array<string>")
    hashed = df.select("a", "b", *[T.token_hashes(F.col(c)).alias(c) for c in ("small", "other")])
    found = S.with_coverage(hashed, {"c3": 3, "c10": 10})
    got = {r.a: (r.c3, r.c10) for r in found.collect()}
    for a, _, small, other in rows:
        for k, value in zip((3, 10), got[a]):
            known = {tuple(other[i : i + k]) for i in range(len(other) - k + 1)}
            covered = {p for i in range(len(small) - k + 1) if tuple(small[i : i + k]) in known for p in range(i, i + k)}
            assert value == (len(covered) / len(small) if small else 0.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    plan = S.token_coverage(df, 3, "c")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_only_shared_entries_travel(spark):
    """entries of one set only were shuffled again for every check; now they count in the size alone."""
    sets = spark.createDataFrame([(1, 4, [10, 11, 12, 13]), (2, 4, [12, 13, 14]), (3, 4, [13, 20]), (4, 4, [30, 31])], "cid long, lines int, items array<long>")
    got = {r.cid: (r.size, r.shared) for r in S.shared_entries(sets).collect()}
    assert got == {1: (4, [12, 13]), 2: (3, [12, 13]), 3: (2, [13]), 4: (2, [])}
    index = {(r.cid, r.h, r.pos) for r in S.prefix_index(S.shared_entries(sets), 0.4).collect()}
    assert index == {(1, 12, 3), (2, 12, 2), (3, 13, 2)}
    assert {(r.a, r.b): r.jaccard for r in S.bounded_pairs(sets, 0.4, 2.0).collect()} == {(1, 2): 2 / 5}


def many_sharing(spark, n=240):
    """Profiles that all have one rare name in common and enough others to be near the score."""
    rng = random.Random(9)
    rows = []
    for i in range(n):
        surface = ["shared"] + [f"w{j}" for j in range(8) if rng.random() < 0.6] + [f"x{i}"] + [f"f{j}" for j in range(30) if rng.random() < 0.3]
        rows.append((i, 10 + rng.randrange(12), rng.choice([1, 1, 3]), [i * 100 + j for j in range(5)], surface, {k: rng.randrange(1, 4) for k in range(4)}))
    return spark.createDataFrame(rows, "cid long, lines long, copies long, items array<long>, surface array<string>, shape map<int,long>")


def test_pairs_with_a_rare_name_are_not_shuffled(spark):
    """Each of these 28,680 pairs was shuffled, and joined with both members' names where its bound was open."""
    profiles = many_sharing(spark).withColumn("copies", F.lit(1).cast("bigint"))
    found = shuffled_records(spark, lambda: S.low_overlap_pairs(profiles, min_score=0.7).collect())
    assert found < 28_680, found


def test_reasons_are_settled_where_pairs_meet(spark):
    """the same where all reasons are counted."""
    profiles = many_sharing(spark).withColumn("copies", F.lit(1).cast("bigint"))
    found = shuffled_records(spark, lambda: S.low_overlap_decisions(profiles, min_score=0.7).groupBy("reason").count().collect())
    assert found < 28_680, found


def test_blocks_and_steps_decide_alike(spark, monkeypatch):
    """Names too frequent to pair by, copies, and blocks, steps and bit tables of a few rows."""
    profiles = many_sharing(spark, 150)
    text = lambda rows: sorted(map(repr, rows))
    whole = text(S.low_overlap_decisions(profiles, min_score=0.6).collect())
    assert len({r.split("reason='")[1].split("'")[0] for r in whole}) > 1
    for name, value in (("STEP_ROWS", 7), ("STEP_PAIRS", 5), ("STEP_NAMES", 64), ("BLOCK_NAMES", 100)):
        monkeypatch.setattr(vocabulary, name, value)
    assert text(S.low_overlap_decisions(profiles, min_score=0.6).collect()) == whole


def test_a_known_jaccard_needs_no_shingles(spark):
    """shingles and names of every known pair were attached again to decide it; the old code asked for items here."""
    shape = "map(1, 2L, 2, 2L)"
    pairs = spark.sql(f"select 1L a, 2L b, j jaccard, 10L lines_a, 12L lines_b, array(1, 2, 3, 4) surface_a, array(1, 2, 3, 5) surface_b, {shape} shape_a, {shape} shape_b from values (0.5D), (0.35D) as t(j)")
    got = {r.jaccard: (r.reason, r.score) for r in S.decide(pairs, min_score=0.6).collect()}
    assert got == {0.5: ("high_overlap", 0.8), 0.35: ("proposed", 0.8)}


def units_with_copies(spark):
    """Units some of whose ids repeat, with and without the same tokens, or are null."""
    rng = random.Random(11)
    rows = [(rng.choice([i, i, i // 3, None]), [f"w{rng.randrange(3)}" for _ in range(rng.randrange(4))], rng.randrange(2) + 1) for i in range(300)]
    return spark.createDataFrame(rows + [(400, None, 1), (401, None, 1), (402, ["lone"], None)], "id long, tokens array<string>, lines long")


def test_classes_are_found_without_shuffling_tokens(spark):
    """The tokens of every unit were shuffled to combine copies, more than twice the input."""
    units = units_with_copies(spark)
    found = S.content_classes(units.where("id is not null").dropDuplicates(["id"]).localCheckpoint())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("BroadcastExchange") > 0


def test_classes_equal_a_grouping(spark):
    units = units_with_copies(spark)
    want = {}
    for r in units.collect():
        want.setdefault((tuple(r.tokens) if r.tokens is not None else None, r.lines), []).append(r.id)
    want = {k: (min((i for i in ids if i is not None), default=None), len(ids)) for k, ids in want.items()}
    for sent in (S.SENT_CLASSES, 0):
        rows = S.content_classes(units, sent).collect()
        got = {(tuple(r.tokens) if r.tokens is not None else None, r.lines): (r.cid, r.copies) for r in rows}
        assert len(rows) == len(got) and got == want


def test_only_members_are_shuffled_to_their_pairs(spark):
    """All classes were shuffled with their tokens to be joined with the pairs or their members."""
    rows, keys = spark.range(100).selectExpr("id AS cid", "id * 2 AS v"), spark.createDataFrame([(3,), (3,), (None,), (500,)], "cid long")
    few = semi_join(rows, keys, "cid")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("BroadcastExchange") == 1
    assert [tuple(r) for r in few.collect()] == [tuple(r) for r in semi_join(rows, keys, "cid", sent=0).collect()] == [(3, 6)]


def test_rows_are_shuffled_once_whatever_the_blocks(spark):
    """every row was shuffled once a block, so that the disk needed grew with the square of the input."""
    rng = random.Random(5)
    rows = []
    for i in range(300):
        rare = sorted({rng.randrange(60) for _ in range(4)})
        others = sorted({100 + rng.randrange(20) for _ in range(5)})
        rows.append((i, 10 + rng.randrange(8), rng.choice([1, 2]), 12, len(rare) + len(others), rare, others, [3, 4], [rng.choice([5, 6]), 6]))
    rows = spark.createDataFrame(rows, "cid long, lines long, copies long, mass long, names long, rare array<long>, others array<long>, lengths array<int>, counts array<long>")
    close = spark.createDataFrame([(i, i + 1) for i in range(0, 200, 3)] + [(7, 9000)], "a long, b long")
    decide = lambda blocks: sorted(map(repr, vocabulary.decided_by_names(rows, close, 0.6, 0.6, least_blocks=blocks).collect()))
    whole = decide(1)
    assert {r.split("reason='")[1].split("'")[0] for r in whole} == {"size_ratio", "high_overlap", "proposed", "score"}
    found = []
    assert shuffled_records(spark, lambda: found.extend(decide(16))) < 2 * 300
    assert found == whole


def test_rare_names_are_split_off_without_a_shuffle_of_rows(spark):
    """every name of every row was shuffled twice to tell the rare from the frequent."""
    rows = [(i, 9, 1 + i % 3, 4, [1, 2, 10 + i] if i % 2 else [1, 2], [4], [4]) for i in range(20)] + [(30, 9, 1, 4, [], [4], [4])]
    rows = spark.createDataFrame(rows, "cid long, lines long, copies long, mass long, names array<long>, lengths array<int>, counts array<long>")
    for max_df, rare, others in ((3, lambda r: [n for n in r.names if n >= 10], lambda r: [1, 2]), (10**6, lambda r: r.names, lambda r: [])):
        want = [(r.cid, r.copies, len(r.names), rare(r), others(r)) for r in rows.collect() if rare(r)]
        assert sorted(tuple(r) for r in vocabulary.split_by_frequency(rows, max_df).select("cid", "copies", "names", "rare", "others").collect()) == sorted(want)
    plan = vocabulary.split_by_frequency(rows, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
