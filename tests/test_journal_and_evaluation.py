import json

from pyspark.sql import functions as F

from pairloom.operators import evaluation as E
from pairloom.operators import journal as J
from pairloom.operators import report as R
from pairloom.operators import resolution as X
from pairloom.operators import sampling as G
from pairloom.sources import files as S
from pairloom.streaming import journal_stream


def good_log(spark):
    rows = [(0, "initialized", None, None), (1, "reserved", 7, None), (2, "finished", 7, "succeeded"), (3, "reserved", 8, None), (4, "finished", 8, "failed"), (5, "complete", None, None)]
    return spark.createDataFrame(rows, "seq long, type string, unit_id long, status string")


def chained(df):
    rows = df.withColumn("event_hash", J.event_hash("seq", "type", "unit_id", "status"))
    before = rows.select((F.col("seq") + 1).alias("seq"), F.col("event_hash").alias("previous_hash"))
    return rows.join(before, "seq", "left")


def test_chain(spark):
    body = ["seq", "type", "unit_id", "status"]
    log = chained(good_log(spark))
    assert J.chain_violations(log, body).count() == 0
    edited = log.withColumn("status", F.when(F.col("seq") == 4, "succeeded").otherwise(F.col("status")))
    assert [(r.seq, r.problem) for r in J.chain_violations(edited, body).collect()] == [(4, "event_hash")]
    torn = log.where("seq <> 3")
    assert [(r.seq, r.problem) for r in J.chain_violations(torn, body).collect()] == [(4, "sequence_gap")]


def test_lifecycle(spark):
    assert J.lifecycle_violations(good_log(spark)).count() == 0
    extra = spark.createDataFrame([(6, "reserved", 9, None), (7, "finished", 7, "failed")], good_log(spark).schema)
    bad = J.lifecycle_violations(good_log(spark).where("seq < 5").union(extra)).collect()
    assert [(r.seq, r.problem) for r in bad] == [(7, "duplicate_finish")]
    assert {r.problem for r in J.lifecycle_violations(good_log(spark).union(extra)).collect()} == {"after_terminal"}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, i % 3, ("reserved", "finished", "note")[(i * 7) % 3], None) for i in range(60)]
    df = spark.createDataFrame(rows, "seq long, unit_id long, type string, status string")
    for part in range(3):
        df.where((F.col("seq") >= part * 20) & (F.col("seq") < part * 20 + 20)).coalesce(1).write.json(str(tmp_path / "in" / f"p{part}"))
    stream = spark.readStream.schema(journal_stream.EVENTS).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
    journal_stream.run_available(journal_stream.lifecycle_problems(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r.seq, r.problem) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r.seq, r.problem) for r in J.lifecycle_violations(df).collect()} and got


def test_merge(spark):
    rows = [(1, 0, 1, "failed"), (1, 1, 9, "succeeded"), (2, 0, 2, "succeeded"), (2, 1, 8, "succeeded"), (3, 1, 7, "failed")]
    got = {r.unit_id: (r.status, r.superseded, r.answered_twice) for r in J.merge_runs(spark.createDataFrame(rows, "unit_id long, run int, seq long, status string")).collect()}
    assert got == {1: ("succeeded", 1, False), 2: ("succeeded", 1, True), 3: ("failed", 0, False)}


def test_gate_boundaries(spark):
    def verdict(above, below, projects):
        rows = [("s", "above_cut_random", f"p{i % projects}", a) for i, a in enumerate(above)] + [("s", "below_cut_near", "p0", b) for b in below]
        return E.gate_signals(spark.createDataFrame(rows, "signal_id string, stratum string, project string, label string"), True).first()

    yes, no = "actionable", "no_action"
    assert verdict([yes] * 4 + [no] * 4, [], 2).verdict == "default"
    assert verdict([yes] * 3 + [no] * 5, [no], 2).verdict == "default_low_precision"
    assert verdict([yes] * 7, [], 2).reason.startswith("too few random")
    assert verdict([yes] * 8, [], 1).reason == "too few projects"
    assert verdict([yes] * 4 + [no] * 4, [yes], 2).reason.endswith("does not beat the below-cut rate")
    assert verdict([yes] * 2 + [no] * 6, [no], 2).reason == "actionable rate is below the bar"


def test_labels_of_three_schemas(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"schema": "human-labels/1", "labelerKind": "human", "labeler": "R. Roe", "labels": [{"cardId": "c1", "signalId": "s", "label": "actionable"}, {"cardId": "c1", "signalId": "s", "label": "no_action"}, {"cardId": "c2", "signalId": "s", "label": ""}]}))
    (tmp_path / "b.json").write_text(json.dumps({"schema": "eval-labels/1", "sourceType": "author", "who": "x", "labels": [{"cardId": "c3", "signalId": "s", "label": "perhaps"}]}))
    (tmp_path / "c.json").write_text(json.dumps({"schema": "blind-relational-reference/1", "reviewer": "m", "cards": [{"cardId": "c4", "evaluations": [{"signalId": "s", "label": "uncertain", "rationale": "r"}]}]}))
    labels = E.normalise_labels(S.read_label_files(spark, str(tmp_path)))
    assert sorted((r.card_id, r.label, r.source_type) for r in labels.collect()) == [("c1", "actionable", "human"), ("c1", "no_action", "human"), ("c3", "perhaps", "author"), ("c4", "uncertain", "llm_reviewer")]
    assert sorted((r.card_id, r.problem) for r in E.label_problems(labels).collect()) == [("c1", "duplicate_label"), ("c3", "invalid_label")]


def test_snapshot_statuses(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    for name, text in {"src/a.ts": "let a = 1;\n", "src/gen.ts": "// @generated\nlet b;\n", "src/key.js": "const password = 'abcdefghijklmnop';\n", "src/readme.md": "x", "node_modules/m.js": "y"}.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "src/bin.ts").write_bytes(b"a\x00b")
    (tmp_path / "src/bad.ts").write_bytes(b"\xff\xfe")
    got = {r.path: r.status for r in S.snapshot(spark, str(tmp_path)).collect()}
    assert got == {
        "src/a.ts": "read", "src/gen.ts": "generated", "src/key.js": "potential_secret_no_content_stored", "src/readme.md": "non_source",
        "node_modules/m.js": "excluded_path", "src/bin.ts": "binary_or_invalid_utf8", "src/bad.ts": "binary_or_invalid_utf8",
    }


def test_inherited_options(spark):
    rows = [("a", "b", {"x": "1"}), ("b", "c", {"x": "2", "y": "2"}), ("c", None, {"y": "3", "z": "3"}), ("l", "m", {}), ("m", "l", {}), ("o", "gone", {})]
    got = {r.path: (r.options, r.state) for r in X.inherited_options(spark.createDataFrame(rows, "path string, extends string, options map<string,string>")).collect()}
    assert got["a"] == ({"x": "1", "y": "2", "z": "3"}, "complete")
    assert got["l"][1] == "cycle" and got["o"][1] == "missing_base"


def test_callbacks_and_spreads(spark):
    rows = [(1, 0, "onClick", "f"), (1, 1, "onClick", "g"), (2, 0, "onSave", "h"), (2, 1, None, None), (3, 0, None, None), (3, 1, "onX", "k"), (3, 2, "title", "t")]
    got = {(r.element, r.name): (r.target, r.reason) for r in X.attribute_callbacks(spark.createDataFrame(rows, "element long, position long, name string, target string")).collect()}
    assert got == {(1, "onClick"): ("g", "resolved"), (2, "onSave"): (None, "voided_by_spread"), (3, "onX"): ("k", "resolved")}


def test_exclusive_match_equals_one_after_the_other(spark):
    import random

    rng = random.Random(8)
    edges = [(p, p, c, rng.randrange(6)) for p in range(25) for c in range(100, 120) if rng.random() < 0.5]
    used, want = set(), {}
    for p in range(25):
        options = sorted((cost, c) for q, _, c, cost in edges if q == p and c not in used)
        if options:
            want[p] = options[0][1]
            used.add(options[0][1])
    got = {r.positive: r.control for r in G.exclusive_match(spark.createDataFrame(edges, "positive long, priority long, control long, cost long")).collect()}
    assert got == want


def test_stratified_sample_equals_a_loop(spark):
    import hashlib
    import random

    rng = random.Random(6)
    items = [(i, rng.choice("rs"), rng.randrange(2), f"f{rng.randrange(14)}", f"c{rng.randrange(60)}") for i in range(160)]
    near = {(a, b) for a in range(160) for b in range(a + 1, 160) if rng.random() < 0.01}
    both = sorted(near | {(b, a) for a, b in near})
    order = lambda i: (hashlib.sha256(f"s|{i}".encode()).hexdigest(), i)
    want = set()
    for repo in "rs":
        files, seen = {}, set()
        for stratum in (0, 1):
            chosen = []
            for i, _, _, f, c in sorted((x for x in items if x[1] == repo and x[2] == stratum), key=lambda x: order(x[0])):
                if len(chosen) >= 6:
                    break
                if c in seen or files.get(f, 0) >= 2 or any((o, i) in near or (i, o) in near for o in chosen):
                    continue
                chosen.append(i)
                seen.add(c)
                files[f] = files.get(f, 0) + 1
            want |= set(chosen)
    df = spark.createDataFrame(items, "id long, repo string, stratum int, file string, content string")
    got = {r.id for r in G.stratified_sample(df, spark.createDataFrame(both, "a long, b long"), "s", per_stratum=6, per_file=2).collect()}
    assert got == want


def test_threshold_overrides(spark):
    import pytest

    signals = R.signal_table(spark)
    got = {r.signal_id: (r.cut, r.floor) for r in R.resolve_thresholds(signals, {"deep_nesting": 0.3}, {"unreachable_code": 0.1}).collect()}
    assert got["deep_nesting"] == (0.3, 0.3) and got["unreachable_code"] == (0.7, 0.1) and got["name_vs_behavior"] == (0.5, 0.2)
    with pytest.raises(ValueError):
        R.resolve_thresholds(signals, {}, {"deep_nesting": 0.9})
