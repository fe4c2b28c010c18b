import pytest
from helpers import documents
from oracle_compare import compare, connect

import __spark_entry__ as entry
import corpus_pipeline
from pairloom.llm import decontaminate, jaccard, language, pieces, queries, substrings
from pairloom.llm.tables import one_row_per_id, read, split_by_ids


@pytest.mark.parametrize("name", [n for n, (_, sql) in queries.registry().items() if sql])
def test_query_equals_its_sql(spark, folder, name):
    query, sql = queries.registry()[name]
    assert compare(spark, connect(folder), folder, name, query, sql)[0] is None


def test_all_are_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14)) and "pipeline" in entry.queries()


def test_pipeline_equals_its_steps(spark, folder):
    docs = read(spark, folder, "documents")
    found = {r.doc_id: r for r in language.identify_language(docs, language.fit_language_model(docs)).collect()}
    left = docs.where(docs.doc_id.isin([d for d, r in found.items() if not r.rejected]))
    group = {r.doc_id: r.component_id for r in jaccard.similar_documents(left, 5, 80).collect()}
    left = left.where(left.doc_id.isin([d for d, c in group.items() if d == c]))
    texts = {r.doc_id: r.text for r in substrings.without_repeats(left).collect()}
    bad = {r.doc_id for r in decontaminate.contained_items(substrings.without_repeats(left), read(spark, folder, "benchmark")).collect()}
    ids, counts = pieces.encode_texts(pieces.load_model(), pieces.Pairs(pieces.load_model()), [t for d, t in sorted(texts.items()) if d not in bad])
    got = corpus_pipeline.run(spark, folder).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == [d for d in sorted(texts) if d not in bad]
    assert [r.n_pieces for r in got] == counts.tolist() and [i for r in got for i in r.ids] == ids.tolist()
    assert 0 < len(got) < docs.count()


def test_stages_keep_columns_and_survive_awkward_rows(spark, folder):
    long = "alpha beta gamma delta epsilon " * 30
    rows = [(1, "the quick brown fox jumps over the lazy dog again and again", "en"), (2, None, "en"), (3, "", None), (None, long, "en"), (4, long, "en"), (4, long, "en"), (5, "zeta " + long, "en")]
    docs = documents(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for table in (docs, docs.limit(0)):
            got = stage(spark, table, folder)
            assert got.columns == docs.columns and got.count() <= table.count(), name
    assert sorted(str(r.doc_id) for r in corpus_pipeline.drop_near_copies(spark, docs, folder).collect()) == ["1", "2", "3", "4", "None"]


def test_split_by_ids(spark, monkeypatch):
    import pairloom.llm.tables as tables

    docs = documents(spark, [(1, "a"), (2, "b"), (None, "c"), (2, "b"), (2, "a")])
    ids = spark.createDataFrame([(2,), (2,), (None,)], "x long")
    for limit in (10, 0):
        monkeypatch.setattr(tables, "SENT_IDS", limit)
        assert sorted(str(r.doc_id) for r in split_by_ids(docs, ids, "left_anti").collect()) == ["1", "None"]
        assert split_by_ids(docs, ids, "left_semi").count() == 3
        assert sorted((str(r.doc_id), r.text) for r in one_row_per_id(docs).collect()) == [("1", "a"), ("2", "a"), ("None", "c")]
