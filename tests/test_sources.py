import json

import pytest

from pairloom.operators import resolution as X
from pairloom.sources import files as S


def test_once_only_sink(spark, tmp_path):
    df = spark.range(3)
    S.write_once(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    with pytest.raises(Exception, match="(?i)exists"):
        S.write_once(df, str(tmp_path / "out"))


def test_journal_source_fails_on_a_torn_line(spark, tmp_path):
    good = {"seq": 0, "type": "initialized", "answers": {}, "usage": {"input_tokens": 1, "output_tokens": 2}}
    (tmp_path / "a.jsonl").write_text(json.dumps(good) + "\n")
    assert S.read_journal(spark, str(tmp_path / "a.jsonl")).first().usage.input_tokens == 1
    (tmp_path / "b.jsonl").write_text(json.dumps(good) + '\n{"seq": 1, "ty')
    with pytest.raises(Exception):
        S.read_journal(spark, str(tmp_path / "b.jsonl")).collect()


def test_cases_and_malformed_lines(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id": "x", "signalId": "s", "files": {"a.ts": "1"}}\n{"id": \n')
    cases, bad = S.read_cases(spark, str(tmp_path / "c.jsonl"))
    assert [r.id for r in cases.select("id", "files").collect()] == ["x"]
    assert len(bad.collect()) == 1


def test_catalog_differences(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"id": name, "kinds": ["function"]}, indent=1))
    order = spark.createDataFrame([("a",), ("c",)], "id string")
    got = {(r.id, r.problem) for r in S.catalog_differences(S.read_signals(spark, str(tmp_path)), order).collect()}
    assert got == {("b", "not_in_catalog"), ("c", "file_missing")}


def test_external_config_problems(spark, tmp_path):
    sri = "sha512-" + "A" * 86 + "=="
    rows = {
        "ok": dict(specifier="ok", package="p", version="1.2.3", integrity=sri, entry="t.json", files={"t.json": "{}"}),
        "v": dict(specifier="v", package="p", version="^1", integrity=sri, entry="t.json", files={"t.json": "{}"}),
        "e": dict(specifier="e", package="p", version="1.0.0", integrity=sri, entry="x.json", files={"t.json": "{}"}),
        "u": dict(specifier="u", package="p", version="1.0.0", integrity=sri, entry="../t", files={"../t": "{}"}),
    }
    for name, row in rows.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(row))
    got = {(r.specifier, r.problem) for r in S.external_config_problems(spark, str(tmp_path)).collect()}
    assert got == {("v", "version_not_exact"), ("e", "entry_missing"), ("u", "path_not_contained")}


def test_written_global_fetch_voids_routes(spark):
    uses = spark.createDataFrame([("/a", "GET"), (None, "GET")], "url string, method string")
    routes = spark.createDataFrame([("/a", "GET", 1)], "url string, method string, target long")
    assert {r.reason for r in X.route_join(uses, routes).collect()} == {"resolved", "dynamic_url"}
    assert {r.reason for r in X.route_join(uses, routes, disabled=True).collect()} == {"global_fetch_written"}


def test_lines_of_split_files_are_numbered(spark, tmp_path):
    from pairloom.sources.lines import numbered_lines

    for name, gap in (("a.jsonl", 7), ("b.jsonl", 1000)):
        lines = []
        for i in range(3000):
            lines += [json.dumps({"id": f"{name}-{i}", "signalId": "s", "files": {}})] + ([""] if i % gap == 0 else [])
        lines[2500] = '{"id": "torn'
        lines[2800] = '{"signalId": "s"}'
        lines[2900] = "[1]"
        (tmp_path / name).write_text("\n".join(lines))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = numbered_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path / "a.jsonl")).rdd.getNumPartitions() >= 3
        got = sorted((r.file.rsplit("/", 1)[1], r.line, r.entry, r.value) for r in found.collect())
        cases, bad = S.read_cases(spark, str(tmp_path))
        places = {(r.file.rsplit("/", 1)[1], r.line) for r in bad.collect()}
        first = cases.where("id = 'a.jsonl-0'").first()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    want = []
    for name in ("a.jsonl", "b.jsonl"):
        entry = 0
        for number, line in enumerate((tmp_path / name).read_text().split("\n"), 1):
            if line.strip():
                entry += 1
                want.append((name, number, entry, line))
    assert got == sorted(want)
    assert places == {(n, line) for n in ("a.jsonl", "b.jsonl") for line in (2501, 2801, 2901)} and first.line == 1


def test_torn_journal_line_is_named(spark, tmp_path):
    (tmp_path / "j.jsonl").write_text('{"seq": 0, "type": "initialized"}\n\n{"seq": 1, "ty\n{"type": "x"}\n')
    assert {(r.line, r.entry) for r in S.journal_line_problems(spark, str(tmp_path / "j.jsonl")).collect()} == {(3, 2), (4, None)}
