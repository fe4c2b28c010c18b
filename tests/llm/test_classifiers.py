import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from helpers import AWKWARD, alnum, documents
from pyspark.sql import functions as F

from pairloom.llm import language, licenses, quality, toxicity
from pairloom.llm.tables import held_out, read

PROSE = {
    "en": "the house of the old man stands by the river and the children play there in the evening",
    "de": "das haus des alten mannes steht am fluss und die kinder spielen dort jeden abend",
    "fr": "la maison du vieil homme se trouve au bord de la rivière et les enfants y jouent le soir",
}


@pytest.fixture(scope="module")
def labelled(spark):
    """Texts of three languages; odd ids are toxic, every fifth is shouted."""
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        lang = ("en", "de", "fr")[i % 3]
        own = PROSE[lang].split() * 2
        rng.shuffle(own)
        if i % 2:
            own[rng.randrange(len(own))] = rng.choice(["nasty", "vile"])
        text = " ".join(own)
        if i % 5 == 0:
            text = "!! ".join(text.upper().split())
        rows.append((i, text, lang))
        labels.append((i, int(i % 5 != 0), i % 2))
    rows += [(1000 + i, t) for i, t in enumerate(AWKWARD)] + [(None, "the house"), (0, rows[0][1], "en")]
    labels += [(0, 0, 0), (None, 1, 1), (5, None, None), (99999, 1, 1)]
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {r[0]: r for r in rows}


def test_held_out_is_crc32_of_the_id(spark):
    import zlib

    got = spark.range(50).select(F.col("id").alias("doc_id")).withColumn("h", held_out()).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_language(spark, labelled):
    docs, _, rows = labelled
    model = language.fit_language_model(docs)
    got = language.identify_language(docs, model).collect()
    assert len(got) == len(rows) + 1
    named = {r.doc_id: r for r in got}
    assert all(named[i].lang_pred == rows[i][2] and not named[i].rejected and named[i].score > 0.5 for i in range(600))
    for i, text in enumerate(AWKWARD):
        letters = any(c.isalpha() for c in text or "")
        assert (named[1000 + i].lang_pred == "und") == (not letters)
        assert letters or (named[1000 + i].score == 0 and named[1000 + i].rejected)
    kept = language.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r.rejected for r in got)
    nothing = documents(spark, [(1, "text"), (2, None)])
    assert language.fit_language_model(nothing) is None
    assert {r.lang_pred for r in language.identify_language(nothing, None).collect()} == {"und"}
    assert language.identify_language(docs.limit(0), model).collect() == []


def test_language_scores_do_not_depend_on_batching():
    texts = [PROSE["en"], "", None, PROSE["fr"] * 20000, "a", "ab", PROSE["de"]]
    raw, bounds = language.W.text_buffer(pa.array(texts))
    bags = [language.subwords(raw, int(a), int(b)) for a, b in zip(bounds[:-1], bounds[1:])]
    model = language.Model(["x", "y"], np.random.default_rng(0).normal(size=(language.BUCKETS, 2)).astype(np.float32), np.zeros(2, np.float32), 1.0, 0.0)
    want = [b @ model.table.astype(np.float64) / max(1, b.sum()) for b in bags]
    assert np.allclose(language.score_texts(model, pa.array(texts)), want, atol=1e-5)


def test_toxicity(spark, labelled):
    docs, labels, rows = labelled
    model = toxicity.fit_toxicity(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    assert sum((got[i] >= toxicity.CUT) == bool(i % 2) for i in range(600)) > 590
    assert all(0 <= got[1000 + i] <= 1 for i in range(len(AWKWARD)))
    assert toxicity.score_toxicity(docs.limit(0), model).collect() == []
    for few in (labels.limit(0), labels.where("toxic = 1")):
        flat = toxicity.fit_toxicity(docs, few)
        assert {r.score for r in toxicity.score_toxicity(docs, flat).collect()} == {float(few.count() > 0)}


def test_quality(spark, labelled):
    docs, labels, rows = labelled
    model = quality.fit_quality(docs, labels)
    got = {r.doc_id: r.score for r in quality.score_quality(docs, model).collect()}
    assert sum((got[i] >= quality.CUT) == (i % 5 != 0) for i in range(600)) > 570
    assert 0.6 < model.prior < 0.95
    assert all(0 <= got[1000 + i] <= 1 for i in range(len(AWKWARD)))
    assert quality.fit_quality(docs, labels.limit(0)) is None
    assert {r.score for r in quality.score_quality(docs, None).collect()} == {0.5}


@pytest.mark.parametrize("query, label", [(toxicity.op1, "toxic"), (quality.op3, "quality")])
def test_held_out_accuracy_on_given_tables(spark, query, label):
    folder = "/root/testdata/sf0.1"
    got = query(spark, folder).where("held_out").join(read(spark, folder, "labels"), "doc_id")
    right, n = got.agg(F.sum((F.col("predicted") == F.col(label)).cast("int")), F.count(F.lit(1))).first()
    assert right / n > 0.93


def test_held_out_language_on_given_tables(spark):
    folder = "/root/testdata/sf0.01"
    got = language.op2(spark, folder).where("held_out").join(read(spark, folder, "documents").select("doc_id", "lang"), "doc_id")
    assert got.where("lang = lang_pred and not rejected").count() / got.count() > 0.98


def brute_license(text):
    own = alnum(text)
    return [(i, label) for phrase, label in licenses.BASE_PHRASES for i in range(len(own)) if own[i : i + len(phrase.split())] == phrase.split()]


def test_licenses(spark, folder, tmp_path):
    isc = licenses.TEMPLATES[12][1]
    rows = [
        (1, "x. MIT license; the Mit  License"),
        (2, "Released under the GNU General-Public License and the Apache/License."),
        (3, "Preface " * 3000 + isc.upper()),
        (4, isc.replace("fee", "cost")),
        (5, isc.replace("copy", "clone")),
        (6, "mit licenses, emit license"),
        (7, "Licensed under the Apache License, Version 2.0"),
        *((100 + i, t) for i, t in enumerate(AWKWARD)),
        (None, "mit license"),
        (1, "x. MIT license; the Mit  License"),
    ]
    path = str(tmp_path / "documents.parquet")
    documents(spark, rows).write.parquet(path)
    got = licenses.op4(spark, str(tmp_path)).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    for d, text in rows:
        base, r = brute_license(text), by_id[d]
        places = [i for i, _ in base]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(alnum(text)), len(base), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in base})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert [by_id[i].labels for i in (3, 4, 5, 7)] == ["isc", "", "isc", "apache"]
    assert by_id[3].template_spans[0].start == 3000 and by_id[6].labels == "" and by_id[5].score < 1
    for r in licenses.op4(spark, folder).join(read(spark, folder, "documents"), "doc_id").collect():
        assert r.n_base == len(brute_license(r.text))


def test_any_three_words_outside_the_key_phrase_may_differ(spark):
    template = next(t for t in licenses.TEMPLATES if t[1].startswith("redistribution"))
    own, fixed = template[1].split(), len(template[2].split())
    changed = list(combinations(range(fixed, len(own)), 3))
    texts = [" ".join("other" if i in c else w for i, w in enumerate(own)) for c in changed]
    got = licenses.scan_licenses(documents(spark, list(enumerate(texts))), [template]).collect()
    assert len(got) == len(texts) and all([(s.label, s.start) for s in r.spans] == [("bsd", 0)] for r in got)


def test_a_template_without_key_phrase_needs_its_share_of_words(spark):
    own = [f"w{i}" for i in range(10)]
    texts = [" ".join("other" if i in c else w for i, w in enumerate(own)) for n in (2, 3) for c in combinations(range(10), n)]
    got = licenses.scan_licenses(documents(spark, list(enumerate(texts))), [("x", " ".join(own), "")]).collect()
    assert {r.doc_id for r in got if r.spans} == set(range(45))


def test_license_empty_table(spark):
    assert licenses.scan_licenses(documents(spark, [])).collect() == []
