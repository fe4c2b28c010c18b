import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from oracle_compare import compare, connect
from pairloom.functions import text as T
from pairloom.operators import code_index as C

SOURCE = '''import base, { alpha as a, beta } from "./lib";
import type { Kind } from './kind';
// function ghost() {}
export function total(items: number[], rate = 2): number {
  let sum = 0;
  for (const item of items) {
    if (item > rate && item !== 3) { sum += item; }
  }
  return helper(sum, "text { with brace");
}
const arrow = (x) => {
  return x.map((y) => { return beta(y); });
};
class Box {
  open(key) { return `tpl ${key} }`; }
}
export default arrow;
main();
'''


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([("src/a.ts", SOURCE)], "path string, text string")


def test_functions(files):
    found = {(r["name"], r.start_line, r.lines, r.nested) for r in C.functions(C.tokens(files)).collect()}
    assert found == {("total", 4, 7, False), ("arrow", 11, 3, False), (None, 12, 1, True), ("open", 15, 1, False)}


def test_offsets_cut_the_source(files):
    for r in C.functions(C.tokens(files)).where("name = 'total'").collect():
        assert SOURCE[r.start : r.end].startswith("function total") and SOURCE[r.start : r.end].endswith("}")


def test_profiles(files):
    t = C.tokens(files)
    p = {r["name"]: r for r in C.profiles(t, C.functions(t)).collect()}
    assert set(p["total"].surface) == {"helper", '"text { with brace"'}
    assert p["total"].cyclomatic == 4 and p["arrow"].returns == 2 and not p["total"].recursion


def test_calls_imports_exports(files):
    t = C.tokens(files)
    names = {r.id: r["name"] for r in C.functions(t).collect()}
    assert {(r.callee, names.get(r.owner_id)) for r in C.calls(t, C.functions(t)).collect()} == {("helper", "total"), ("map", "arrow"), ("beta", None), ("main", None)}
    assert {(r["name"], r.imported, r.type_only) for r in C.imports(files).collect()} == {("a", "alpha", False), ("beta", "beta", False), ("Kind", "Kind", True), ("base", "default", False)}
    assert {r["name"] for r in C.exports(files).collect()} == {"total", "default"}


def test_name_words_and_cue(spark):
    rows = spark.createDataFrame([("parseHTTPEntries", "const entry = 1"), ("getData", "x"), ("loadUsers", "nothing here"), (None, "x")], "name string, body string")
    w, b = T.name_words(F.coalesce("name", F.lit(""))), F.array_distinct(T.split_words(F.col("body")))
    got = [(r.w, r.c) for r in rows.select(w.alias("w"), T.name_cue_absent(w, b).alias("c")).collect()]
    assert got == [(["entry", "http", "parse"], False), ([], False), (["load", "user"], True), ([], False)]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["lang", "a", "b", "jaccard", "p", "rank", "band"] and df.count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


SMALL = "auc_by_lang kappa_quality_toxic gate_verdicts cells_status_ladder findings_queue journal_chain_check merged_intervals line_windows question_bins similar_pairs"


@pytest.mark.parametrize("name", SMALL.split())
def test_query_against_sql(spark, folder, name):
    problem, _ = compare(spark, connect(folder), folder, name, entry.queries()[name], entry.oracle_sql()[name])
    assert problem is None, problem
