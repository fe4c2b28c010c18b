"""Spelling variants against brute force: near pairs, forms and roots; counted words against a regular expression."""

import random
import re
import zlib
from collections import Counter

import pytest

from pairloom.llm import spelling


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(rng, word, letters):
    i = rng.randrange(len(word) + 1)
    kind = rng.randrange(3)
    if kind == 0:
        return word[:i] + rng.choice(letters) + word[i:]
    return word[:i] + (rng.choice(letters) if kind == 1 else "") + word[i + 1 :]


def vocabulary(seed, letters, size):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(size // 3)}
    words |= {variants(rng, w, letters) for w in rng.choices(sorted(words), k=size // 2)}
    words |= {variants(rng, w, letters) for w in rng.choices(sorted(words), k=size // 3)}
    return {w: rng.choice([1, 2, 3, 10, 25, 100, 1000, 5000]) for w in sorted(words) if w}


def expected(counts, ratio=10):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda v: (-counts[v], v))
            if counts[best] >= ratio * counts[w]:
                form[w] = best
    rows = set()
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        rows.add((w, counts[w], len(near[w]), form.get(w), counts[form[w]] if w in form else None, root))
    return rows


@pytest.mark.parametrize(("letters", "frequent", "few"), [("ab", 1024, 1), ("abcé", 1024, 8), ("abcdefghijÀÿ", 40, 2), ("abcß漢😀", 1024, 1)])
def test_forms_equal_brute_force(spark, letters, frequent, few):
    counts = vocabulary(len(letters), letters, 400)
    words = spark.createDataFrame([(w, n, 1) for w, n in counts.items()], "word string, n long, root int")
    got = {tuple(r) for r in spelling.spelling_forms(words, 10, frequent, few).select("word", "n", "n_near", "form", "form_n", "root").collect()}
    assert got == expected(counts)


def test_an_edit_touches_no_more_grams_than_bounded(spark):
    rng = random.Random(3)
    counts = vocabulary(9, "abcd", 500)
    words = spark.createDataFrame([(w,) for w in counts], "word string")
    index = spelling.GramIndex(spelling.gram_dictionary(words, 60, 2))
    assert sum(len(c) for c in index.codes.values()) > 20
    for w in list(counts)[:200]:
        for _ in range(20):
            v = variants(rng, w, "abcde")
            if v == w:
                continue
            d = index.decompose([w, v])
            a, b = (Counter(d.gram[d.owner == i].tolist()) for i in (0, 1))
            assert sum((a & b).values()) >= max(d.grams - d.most), (w, v)
            number, keys, weak = index.keys([w, v])
            assert set(keys[number == 0]) & set(keys[number == 1]) or weak.all(), (w, v)


def test_counted_words_with_planted_errors(spark, folder):
    texts = [(1, "Straße straße ÀÉÎÕÜß×÷ résumés it's foo-bar"), (2, None), (3, ""), (None, "Thousands thousands"), (5, "x" * 300000 + " zzz漢zzzzzzzz")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").unionByName(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    counts = Counter()
    for doc_id, text in docs.collect():
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{w}".encode())
            if doc_id is not None and h % 31 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            if len(w) >= 7:
                counts[w] += 1
    assert dict(map(tuple, spelling.count_words(docs, 7, 31).collect())) == counts


def test_defined_cases(spark):
    empty = spark.createDataFrame([], "word string, n long")
    assert spelling.spelling_forms(empty).count() == 0
    assert spelling.count_words(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    words = spark.createDataFrame([("letters", 5), ("letters", 5), (None, 9), ("lettrs", 1), ("lettars", 1), ("lettur", 1)], "word string, n long")
    got = {r.word: tuple(r)[1:] for r in spelling.spelling_forms(words).select("word", "n", "n_near", "form", "form_n", "root").collect()}
    assert got == {
        "letters": (10, 2, None, None, "letters"),
        "lettrs": (1, 2, "letters", 10, "letters"),
        "lettars": (1, 2, "letters", 10, "letters"),
        "lettur": (1, 0, None, None, "lettur"),
    }
    tie = spark.createDataFrame([("zaaaaaa", 50), ("baaaaaa", 50), ("caaaaaa", 2), ("x" * 5000, 3), ("x" * 5001, 30)], "word string, n long")
    got = {r.word: r.form for r in spelling.spelling_forms(tie).collect()}
    assert got["caaaaaa"] == "baaaaaa" and got["x" * 5000] == "x" * 5001
