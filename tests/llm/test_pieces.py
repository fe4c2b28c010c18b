import hashlib

import numpy as np
import pytest
import sentencepiece
from helpers import AWKWARD, documents

from pairloom.llm import pieces
from pairloom.llm.tables import read

HARD = [
    "a  b   c", "\n\n x\t", "▁ mark ▁▁", "a" * 90, "=" * 75, "ab" * 200, "    indented\n        more", "http://x.y/z?q=1 1234567890",
    "ﬁ™ＡＢ ééé", "x" * 400 + " " * 33 + "y", "The quick brown fox, the lazy dog.", "संस्कृत العربية 한국어 ​﻿",
]


@pytest.fixture(scope="module")
def model():
    return pieces.load_model()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_FILE)


def test_equals_the_library_and_decodes(spark, folder, model, library):
    texts = [r.text for r in read(spark, folder, "documents").collect()] + HARD
    rows = list(enumerate(texts)) + [(1000 + i, t) for i, t in enumerate(AWKWARD)] + [(None, "a b"), (0, texts[0])]
    docs = documents(spark, rows)
    encoded = pieces.encode_documents(docs, model)
    got = sorted(((str(r.doc_id), r.ids) for r in encoded.collect()), key=str)
    assert got == sorted(((str(d), None if t is None else library.encode(t)) for d, t in rows), key=str)
    back = pieces.decode_documents(encoded, model).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in back) == sorted((str(d), str(t and t.replace("▁", " "))) for d, t in rows)
    for r in pieces.encoding_digests(docs, model).where("doc_id is not null").collect():
        text = dict(rows)[r.doc_id]
        want = library.encode(text) if text is not None else None
        assert (r.n_pieces, r.round_trip) == ((None, None) if want is None else (len(want), True))
        assert want is None or r.ids_sha256 == hashlib.sha256(np.array(want, "<i4").tobytes()).hexdigest()
    assert pieces.encode_documents(docs.limit(0), model).collect() == []


def best_score(text, scores):
    """Highest sum over all segmentations into pieces."""
    best = [0.0]
    for j in range(1, len(text) + 1):
        best.append(max((best[i] + scores[text[i:j]] for i in range(max(0, j - 16), j) if text[i:j] in scores), default=-np.inf))
    return best[-1]


def test_unigram_is_the_best_segmentation(spark, folder):
    data = bytearray(open(pieces.MODEL_FILE, "rb").read())
    at = data.rfind(b"\x18\x02\x20\x80\xfa\x01")  # the model type in the trainer's part
    data[at + 1] = pieces.UNIGRAM
    model, library = pieces.Model(bytes(data)), sentencepiece.SentencePieceProcessor(model_proto=bytes(data))
    assert model.kind == pieces.UNIGRAM
    scores = {library.id_to_piece(i): library.get_score(i) for i in range(259, library.get_piece_size())}
    # Lines without characters that have no piece.
    lines = [t for r in read(spark, folder, "documents").collect() for t in r.text.split("\n") if t and set(t.replace(" ", "▁")) <= set(scores)]
    ids, counts = pieces.encode_texts(model, pieces.Pairs(model), lines)
    for line, own in zip(lines, np.split(ids, np.cumsum(counts)[:-1])):
        assert model.score[own].sum() == pytest.approx(best_score("▁" + line.replace(" ", "▁"), scores))
        assert model.score[own].sum() >= model.score[library.encode(line)].sum()


def test_slices_do_not_matter(model, library):
    texts = HARD * 3
    pairs = pieces.Pairs(model)
    whole, counts = pieces.encode_texts(model, pairs, texts)
    parts = [pieces.encode_texts(model, pairs, [t])[0] for t in texts]
    assert (whole == np.concatenate(parts)).all() and counts.tolist() == [len(p) for p in parts]


def test_slices_keep_to_the_size_asked_for():
    texts = ["x" * n for n in (10, 50, 40, 200, 5)]
    for size in (60, 100):
        runs = [run for _, run in pieces._slices(pieces.pa.array(texts), size)]
        assert [t for run in runs for t in run] == texts
        assert all(len(run) == 1 or sum(map(len, run)) <= size for run in runs)
