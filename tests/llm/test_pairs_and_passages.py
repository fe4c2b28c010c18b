import hashlib
import random

import pytest
from helpers import AWKWARD, alnum, documents, fold, groups, shingles, visible

from pairloom.llm import components, decontaminate, jaccard, substrings, words


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng, text, edits):
    own = text.split()
    for _ in range(edits):
        own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
    return " ".join(own)


@pytest.fixture(scope="module")
def corpus():
    """Near copies in a large group at the edge of the threshold, exact copies, a common passage, awkward texts."""
    rng = random.Random(3)
    base, passage = prose(rng, 120), prose(rng, 60)
    rows = [(100 + i, edited(rng, base, rng.randrange(0, 5))) for i in range(60)]
    rows += [(300 + i, base.upper()) for i in range(20)]
    rows += [(400 + i, prose(rng, 40) + " " + passage + "\n" + prose(rng, rng.randrange(5, 60))) for i in range(40)]
    rows += [(500 + i, t) for i, t in enumerate(AWKWARD)] + [(520 + i, t) for i, t in enumerate(AWKWARD)]
    rows += [(7, prose(rng, 30000, 10**6)), (None, base), (None, None)]
    rows += [rows[0], (100, "another text of the same id that is long enough")]
    return rows


def brute_components(rows, k, per_cent):
    sets = [(d, shingles(visible(fold(t)), k)) for d, t in rows if d is not None]
    links = []
    for i, (a, s) in enumerate(sets):
        for b, t in sets[i + 1 :]:
            if a == b or (s and t and min(len(s), len(t)) * 100 >= per_cent * max(len(s), len(t)) and len(s & t) * 100 >= per_cent * len(s | t)):
                links.append((a, b))
    return groups(links, {d for d, _ in sets})


@pytest.mark.parametrize("k, per_cent", [(4, 85), (5, 80)])
def test_jaccard_equals_brute_force(spark, corpus, k, per_cent):
    want = brute_components(corpus, k, per_cent)
    got = jaccard.similar_documents(documents(spark, corpus), k, per_cent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in got) == sorted(
        (str(d), len(shingles(visible(fold(t)), k)), want.get(d)) for d, t in corpus
    )
    assert want[100] == 100 and len({want[d] for d, _ in corpus if d and 100 <= d < 360}) < 50


def test_leader_rounds_lose_nothing(spark, corpus):
    docs = documents(spark, corpus)
    held = jaccard.similar_documents(docs).groupBy("component_id").count().collect()
    try:
        jaccard.links_between.__defaults__ = (0,)
        assert sorted(map(str, jaccard.similar_documents(docs).groupBy("component_id").count().collect())) == sorted(map(str, held))
    finally:
        jaccard.links_between.__defaults__ = (jaccard.LEADER_ROUNDS,)


def test_a_leader_that_fits_nobody_hides_no_link(spark):
    """The third text leads every bucket of the first two and is too long for either."""
    rng = random.Random(11)
    common, passage = prose(rng, 103, 10**6), prose(rng, 103, 10**6)
    rows = [(1, common + " " + prose(rng, 6, 10**6)), (2, common + " " + prose(rng, 6, 10**6)), (3, common + " " + passage)]
    rows += [(10 + i, passage + " " + prose(rng, 40, 10**6)) for i in range(6)]
    want = brute_components(rows, 4, 85)
    assert want[2] == 1 and want[3] == 3
    assert {r.doc_id: r.component_id for r in jaccard.similar_documents(documents(spark, rows)).collect()} == want


def test_each_text_of_an_id_links(spark):
    """Two texts of one id, each a near copy of another document."""
    rng = random.Random(12)
    one, two = prose(rng, 100, 10**6), prose(rng, 100, 10**6)
    rows = [(1, one), (1, two), (2, one + " and more"), (3, two + " and more"), (4, prose(rng, 100, 10**6))]
    assert {r.doc_id: r.component_id for r in jaccard.similar_documents(documents(spark, rows)).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_jaccard_empty_table(spark):
    assert jaccard.similar_documents(documents(spark, [])).collect() == []


def brute_removed(rows, window):
    first = {}
    for d, t in rows:
        own = visible(t)
        for i in range(len(own) - window + 1):
            if d is not None:
                key = tuple(own[i : i + window])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, t in rows:
        own = visible(t)
        gone = set()
        for i in range(len(own) - window + 1):
            if d is not None and first[tuple(own[i : i + window])] < d:
                gone |= set(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(own) if i not in gone)
        out.append((str(d), len(own), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("window", [50, 8])
def test_substrings_equal_brute_force(spark, corpus, window):
    rows = corpus + [(900, "loop " * 300), (901, "loop " * 200), (902, "loop " * 55 + "end")]
    got = substrings.remove_repeats(documents(spark, rows), window).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_removed(rows, window)
    assert sum(r.n_removed for r in got) > 0
    for r in got:
        assert sum(b - a for a, b in r.removed) == r.n_removed and all(x[1] < y[0] for x, y in zip(r.removed, r.removed[1:]))


@pytest.mark.parametrize("header", [49, 120])
def test_a_header_of_many_documents_fills_no_key(spark, header):
    rng = random.Random(header)
    top = " ".join(f"h{i}" for i in range(header))
    rows = [(i, f"{top} {prose(rng, 60, 5000)}") for i in range(3000)] + [(5000 + i, prose(rng, 80)) for i in range(20)]
    docs = documents(spark, rows).repartition(4).cache()
    most = substrings.window_runs(docs).groupBy("anchor").count().agg({"count": "max"}).first()[0]
    assert most <= 200, most  # one row a task and window, or a share too small to be noticed
    got = substrings.remove_repeats(docs).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_removed(rows, 50)


def test_without_repeats_keeps_columns_and_other_texts(spark, corpus):
    docs = documents(spark, corpus)
    got = substrings.without_repeats(docs)
    assert got.columns == docs.columns and got.count() == len(corpus)
    texts = {r.doc_id: r.text for r in got.where("doc_id between 500 and 510").collect()}
    assert [texts[500 + i] for i in range(len(AWKWARD))] == AWKWARD
    assert substrings.remove_repeats(documents(spark, [])).collect() == []


def test_decontamination_equals_brute_force(spark, corpus):
    rng = random.Random(5)
    item = corpus[0][1].split()[10:40]
    items = [(1, " ".join(item)), (2, " ".join(item[:20]).upper() + "!!"), (3, prose(rng, 30)), (4, None), (5, ""), (6, "one two"), (6, "one two"), (7, " ".join(item[:12]) + " a b")]
    rows = corpus + [(800, "x " * 4000 + ", ".join(item) + " y" * 900), (801, "zero one-two three")]
    table = spark.createDataFrame(items, "item_id long, text string")

    def hits(text):
        own, out = alnum(text), []
        for i, item_text in items:
            words_of = alnum(item_text)
            need, k = shingles(words_of, 5), min(5, len(words_of))
            found = len(need & {tuple(own[p : p + k]) for p in range(len(own) - k + 1)}) if k else 0
            if need and found * 10 >= len(need) * 8:
                out.append((i, len(need), found))
        return out

    want = sorted((str(d), *h) for d, t in rows for h in hits(t))
    assert {"800", "801"} <= {w[0] for w in want} < {str(d) for d, _ in rows}
    for block in (2_000_000, 10):
        got = decontaminate.contained_items(documents(spark, rows), table, block_shingles=block).collect()
        assert sorted((str(r.doc_id), r.item_id, r.n_item, r.n_found) for r in got) == want
    clean = decontaminate.keep_clean(documents(spark, rows), table)
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(d) for d, t in rows if not hits(t))
    assert decontaminate.contained_items(documents(spark, []), table).collect() == []
    assert decontaminate.contained_items(documents(spark, rows), table.limit(0)).collect() == []


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    got = components.connected_components(spark.createDataFrame([*edges, (None, 5), (7, 7), (40, 39)], "u long, v long")).collect()
    want = groups(edges, {n for a, b in edges if a != b for n in (a, b)})
    assert {r.member: r.component for r in got} == want and len(got) == len(want)
    assert components.connected_components(spark.createDataFrame([], "u string, v string")).collect() == []


def test_long_texts_are_hashed_in_pieces():
    import pyarrow as pa

    text = "word " * 700_000 + "x" * 3_000_000 + " end"
    group = [g for g in words.iter_words(pa.array(["a b", text, None, "c"]))]
    assert [(g.first, g.rows) for g in group] == [(0, 1), (1, 1), (2, 2)]
    assert len(group[1].hashes) == 700_002 and len(set(group[1].hashes.tolist())) == 3
    short = next(words.iter_words(pa.array(["word end"]))).hashes
    assert group[1].hashes[0] == short[0] and group[1].hashes[-1] == short[1]
