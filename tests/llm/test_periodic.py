"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from pairloom.llm import periodic


def brute_runs(words, least=24, repeats=3):
    found = {}
    for q in range(1, len(words) // repeats + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, repeats * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((start, end - start, q) for (start, end), q in found.items())


def random_texts(seed, count=120):
    rng = random.Random(seed)
    for _ in range(count):
        words = []
        for _ in range(rng.randint(0, 6)):
            unit = [rng.choice("ab") for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 33, 64, 100]))]
            words += (unit * rng.randint(1, 30))[: rng.randint(1, 400)]
            words += [rng.choice("abc") for _ in range(rng.randint(0, 40))]
        yield words
    yield []
    yield ["x"] * 23
    yield ["x"] * 24
    yield ["x"] * 1000
    yield ["a"] * 100 + ["c"] + ["a"] * 100
    yield [bin(i).count("1") % 2 and "m" or "n" for i in range(600)] * 3


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_equal_brute_force(seed):
    texts = list(random_texts(seed))
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    _, numbers = np.unique(np.array([w for t in texts for w in t]), return_inverse=True)
    start, end, period = periodic.runs_of(numbers.astype(np.uint64), bounds)
    text = np.searchsorted(bounds, start, "right") - 1
    for t, words in enumerate(texts):
        mine = [(int(s - bounds[t]), int(e - s), int(p)) for s, e, p in zip(start[text == t], end[text == t], period[text == t])]
        assert mine == brute_runs(words), (t, len(words))


def test_transform_is_exact():
    rng = np.random.default_rng(5)
    for b in (8, 32, 256):
        numbers = rng.integers(0, 3, 12 * b).astype(np.uint64)
        numbers[5 * b : 6 * b] = numbers[3 * b : 4 * b]
        for shift in (0, 1):
            blocks, distances = periodic.block_occurrences(numbers, b, shift)
            expected = {
                (j, d)
                for j in range(len(numbers) // b)
                for d in range(max(1, shift * b), (shift + 1) * b)
                if j * b + d + b <= len(numbers) and (numbers[j * b : j * b + b] == numbers[j * b + d : j * b + d + b]).all()
            }
            inside = {(int(j), int(d)) for j, d in zip(blocks, distances) if j * b + d + b <= len(numbers)}
            assert inside == expected


def expected_row(doc_id, text):
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = set()
    for start, length, q in runs:
        gone.update(range(start + q, start + length))
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id,
        len(runs),
        *(best or (None,) * 3),
        1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)),
        sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_query_equals_brute_force_on_whole_small_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in periodic.op13(spark, folder).collect())
    short = [d for d in docs if len((d.text or "").split()) <= 3000]
    found = {r[0]: r for r in got}
    assert len(got) == len(docs)
    for d in short:
        assert found[d.doc_id] == expected_row(d.doc_id, d.text)
    assert sum(r[1] > 0 for r in got) >= len(docs) // 20


def test_defined_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a " * 30, "x"), (4, "é b\t" * 50 + " end", "x"), (4, "é b\t" * 50 + " end", "x"), (5, "w " * 40000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = {(r.doc_id, r.n_words): r for r in periodic.periodic_runs(docs).collect()}
    assert got[1, 0].runs == [] and got[1, 0].collapsed == "" and got[2, 0].collapsed == ""
    assert [tuple(r) for r in got[None, 30].runs] == [(0, 30, 1)] and got[None, 30].collapsed == "a"
    assert [tuple(r) for r in got[4, 51].runs] == [(0, 50, 1)] and got[4, 51].collapsed == "é b end"
    assert [tuple(r) for r in got[5, 40000].runs] == [(0, 40000, 1)]
    assert periodic.periodic_runs(docs).count() == 6
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, 10)
