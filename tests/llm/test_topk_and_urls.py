import math
import random

from helpers import groups
from pyspark.sql import functions as F

from pairloom.llm import topk, urls


def test_topk_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) * (1 + i % 7) for _ in range(12)]) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(30)] + [(100, [0.5] * 12), (200, [0.25] * 3)]
    rows += [(300, None), (301, [1.0, None]), (302, [math.nan] * 12), (303, [math.inf] * 12), (500, [0.0] * 12), (None, [9.0] * 12)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, score string, rank int")
    got = topk.top_k_inner(table, F.col("id") % 100 == 0, k=10).collect()
    kept = [(i, r.vec_id, [math.floor(1024 * x) for x in r.embedding]) for i, r in enumerate(table.collect()) if r.vec_id is not None and r.embedding and all(x is not None and math.isfinite(x) for x in r.embedding)]
    want = []
    for i, q, v in kept:
        if q % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), d, j) for j, d, w in kept if j != i)[:10]
            want += [(q, k + 1, d, -s) for k, (s, d, _) in enumerate(scores)]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_topk_small_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k_inner(empty, F.col("id") % 100 == 0).collect() == []
    three = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k_inner(three, F.col("id") == 0).orderBy("rank").collect()] == [(0, 1, 1, 1024 * 2048), (0, 2, 2, 1024 * 2048)]


def test_query_sets_go_in_parts(spark, monkeypatch):
    rng = random.Random(4)
    table = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(300)], "vec_id long, embedding array<float>")
    whole = topk.top_k_inner(table, F.col("id") % 3 == 0).collect()
    monkeypatch.setattr(topk, "SENT_BYTES", 1000)
    monkeypatch.setattr(topk, "QUERIES_PER_BLOCK", 7)
    assert sorted(map(tuple, topk.top_k_inner(table, F.col("id") % 3 == 0).collect())) == sorted(map(tuple, whole))


CANONICAL = '<head><LINK href="{}" REL=canonical></head>'
REFRESH = "<meta content='5; URL={}' http-equiv=\"refresh\">"


def test_urls(spark):
    rows = [
        (1, "http://WWW.Example.com/en/1?x#y", None),
        (2, "https://a.example.com/en/1", ""),
        (3, "http://mirror.org/1", CANONICAL.format("https://a.example.com/en/1")),
        (4, "http://mirror.org/2", REFRESH.format("http://mirror.org/1")),
        (5, "https://www.mirror.org:443/2?utm_source=a#z", None),
        (6, "http://both.org/1", CANONICAL.format("http://mirror.org/1") + REFRESH.format("//www.example.com/en/9")),
        (7, "http://far.org/a/b", CANONICAL.format("../x") + "canonical"),
        (8, "http://rel.org/a/b", CANONICAL.format("c")),
        (9, "http://rel.org/a/c", CANONICAL.format("http://x.net/fr/1")),
        (10, None, CANONICAL.format("http://x.net/fr/1")),
        (11, "no scheme", CANONICAL.format("http://x.net/fr/1")),
        (12, "http://x.net", None),
        (13, "http://x.net/es/", None),
        (14, "http://xnet/es/", None),
        (15, "http://a.com/", None),
        (16, "http://evil.net/es/1", CANONICAL.format("http://good.org/")),
        (17, "http://good.org", None),
        (None, "http://good.org/", None),
        (1, "http://WWW.Example.com/en/1?x#y", None),
        *((1000 + i, f"http://spoke.org/{i}", CANONICAL.format("http://hub.org/")) for i in range(200)),
        (2000, "http://hub.org/", REFRESH.format("http://hub.net/es/")),
    ]
    table = spark.createDataFrame([(*r, "x", "x") for r in rows], "page_id long, url string, html string, rule string, key string")
    got = urls.filter_urls(table).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got}
    verdict = {i: (r.rule, r.verdict, r.via) for i, r in by_id.items()}
    assert verdict[1] == ("www.example.com/en/", "allow", "rule") and (by_id[1].host, by_id[1].path) == ("www.example.com", "/en/1")
    assert verdict[2] == ("example.com/en/", "block", "rule")
    # One component of 2-6: 6 reaches an allowed address, so those without a rule of their own are allowed.
    assert all(verdict[i] == (None, "allow", "alias") for i in (3, 4, 5, 6))
    assert verdict[7] == (None, "allow", "default")
    assert verdict[8] == verdict[9] == (None, "block", "alias")
    assert verdict[10] == verdict[11] == (None, "allow", "default") and by_id[10].host == by_id[11].path == ""
    assert verdict[12] == (None, "allow", "default") and verdict[13][0] == "net/es/" and verdict[14][2] == "default" and verdict[15][0] == "com/"
    assert verdict[17] == verdict[None] == (None, "block", "alias")
    assert all(verdict[1000 + i] == (None, "block", "alias") for i in range(200)) and verdict[2000][1] == "block"
    assert urls.filter_urls(table.limit(0)).collect() == []


def test_urls_without_an_allowed_alias_are_blocked(spark):
    rows = [(1, "http://a.example.com/en/1", None), (2, "http://m.org/1", CANONICAL.format("http://a.example.com/en/1")), (3, "http://m.org/2", CANONICAL.format("http://m.org/1"))]
    got = {r.page_id: r.verdict for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "block"}
    assert groups([(1, 2), (2, 3)], {1, 2, 3}) == {1: 1, 2: 1, 3: 1}


def test_every_tag_of_a_page_is_an_edge(spark):
    link, meta = '<link rel="{}" href="{}">', '<meta http-equiv="refresh" content="0; url={}">'
    bad = "http://a.example.com/en/1"
    rows = [
        (1, "http://m.org/1", link.format("canonical", "http://m.org/x") + link.format("canonical", bad)),
        (2, "http://m.org/2", meta.format("http://m.org/y") + meta.format(bad)),
        (3, "http://m.org/3", link.format("shortlink canonical", bad)),
        (4, "http://m.org/4", f"<LINK href={bad} REL='alternate  canonical'>"),
        (5, "http://m.org/5", link.format("shortlink", bad)),
        (6, "http://m.org/6", '<link rel="canonical">' + link.format("canonical", bad)),
    ]
    got = {r.page_id: r.verdict for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "block"}


def test_urls_run_no_python_on_executors(spark, folder):
    plan = urls.op10(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
