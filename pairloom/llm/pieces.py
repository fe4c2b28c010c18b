"""SentencePiece encoding and decoding by batched Viterbi in numpy.

A text (with the model's space mark) is cut wherever no piece holds both neighbours, which no segmentation can cross;
the distinct words of a slice of texts are encoded once. Words of one length form a matrix and advance together: at
each place all substrings that end there are hashed from prefix hashes and probed among the sorted hashes of the
pieces (a directory over the leading bits leads to the few keys to compare), and a vectorised maximum over the
candidates stores the backpointer.

* Unigram models: the maximum is over summed scores.
* BPE models: sums of scores don't give what the model's merges give. Here a candidate counts only if it may follow the
  best piece that ends where it begins, that is if merging the two pieces' characters by rank leaves exactly these two
  pieces; for each place exactly one candidate does, and the path of the last place is the merge result. Whether a
  pair may stand together is found by merging many pairs at once and is remembered for the task.

Characters without a piece become byte pieces (or the unknown id where the model has none). Decoding is one gather of
bytes. Texts stream whole through their tasks and nothing is shuffled; the model, a file of bounded size, goes along
with the task's code.

Defined cases: null text has null ids, empty text none; the space mark itself decodes as a space; repeated rows
repeat; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pairloom.llm import words as W
from pairloom.llm.tables import id_and_text, read

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
MARK = 0x2581
UNIGRAM, BPE = 1, 2
SLICE = 1 << 22
REMEMBERED = 4_000_000
CELLS = 1 << 20

_B = np.uint64(0xD1342543DE82EF95)
_M = np.uint64(0x9E3779B97F4A7C15)
_BITS = 18


def _fields(data: bytes):
    """(number, value) of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            yield number, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield number, data[at : at + size]
            at += size


class Model:
    """Pieces of a model file as arrays. Types of pieces: 1 normal, 2 unknown, 3 control, 4 user-defined, 6 byte."""

    def __init__(self, data: bytes):
        pieces, self.kind, prefix = [], UNIGRAM, True
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                score = float(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0])
                pieces.append((own[1].decode(), score, own.get(3, 1)))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                prefix = bool(dict(_fields(value)).get(3, 1))
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are encoded")
        self.prefix = prefix
        self.size = len(pieces)
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == 2), 0)
        self.byte = np.full(256, self.unknown, np.int32)
        text = {i: p for i, (p, _, t) in enumerate(pieces) if t in (1, 4) and p}
        for i, (p, _, t) in enumerate(pieces):
            if t == 6:
                self.byte[int(p[3:5], 16)] = i
        # A character inside a piece that is none itself gets a number beyond the pieces.
        loose = sorted({c for p in text.values() for c in p} - set(text.values()))
        strings = [*text.items(), *((self.size + k, c) for k, c in enumerate(loose))]
        least = min((s for _, s, t in pieces if t == 1), default=0.0)
        self.score = np.array([s for _, s, _ in pieces] + [least - 10] * len(loose))
        ranked = np.argsort(-self.score, kind="stable")
        self.rank = np.empty(len(ranked), np.int64)
        self.rank[ranked] = np.cumsum(np.concatenate([[0], self.score[ranked][1:] != self.score[ranked][:-1]]))
        self.longest = max((len(p) for _, p in strings), default=1)
        self.length = np.zeros(len(self.score), np.int64)
        self.chars = np.zeros((len(self.score), self.longest), np.uint64)
        keys = np.zeros(len(strings), np.uint64)
        for k, (i, p) in enumerate(strings):
            codes = np.array([ord(c) for c in p], np.uint64)
            self.length[i], self.chars[i, : len(p)] = len(p), codes
            keys[k] = _hash_rows(codes[None])[0, -1]
        order = np.argsort(keys * _M)
        self.keys, self.ids = (keys * _M)[order], np.array([i for i, _ in strings], np.int64)[order]
        self.directory = np.searchsorted(self.keys >> np.uint64(64 - _BITS), np.arange((1 << _BITS) + 1, dtype=np.uint64)).astype(np.int32)
        self.widest = int(np.diff(self.directory).max(initial=0))
        self.hash = np.zeros(len(self.score), np.uint64)
        self.hash[[i for i, _ in strings]] = keys
        self.powers = W.powers(_B, self.longest + 1)
        pairs = np.unique(np.array([(ord(a) << 21) | ord(b) for _, p in strings for a, b in zip(p, p[1:])] or [0], np.int64))
        self.pairs = pairs
        self.low_pairs = np.zeros((256, 256), bool)
        # In the table of neighbours the space mark stands at 0.
        slot = lambda c: np.where(c == MARK, 0, c)
        a, b = slot(pairs >> 21), slot(pairs & 0x1FFFFF)
        small = (a < 256) & (b < 256)
        self.low_pairs[a[small], b[small]] = True
        out = [b"" if t in (2, 3) else bytes([int(p[3:5], 16)]) if t == 6 else p.replace(chr(MARK), " ").encode() for p, _, t in pieces]
        self.out_start = np.concatenate([[0], np.cumsum([len(x) for x in out])])
        self.out_bytes = np.frombuffer(b"".join(out), np.uint8)

    def probe(self, hashes: np.ndarray) -> np.ndarray:
        """Piece number of each substring hash, or -1."""
        key = hashes.ravel() * _M
        bucket = (key >> np.uint64(64 - _BITS)).astype(np.int64)
        low, n = self.directory[bucket], self.directory[bucket + 1] - self.directory[bucket]
        out = np.full(len(key), -1, np.int64)
        at = np.flatnonzero(n)
        for k in range(self.widest):
            at = at[n[at] > k]
            hit = self.keys[low[at] + k] == key[at]
            out[at[hit]] = self.ids[low[at[hit]] + k]
        return out.reshape(hashes.shape)


@lru_cache(maxsize=4)
def load_model(path: str = MODEL_FILE) -> Model:
    with open(path, "rb") as file:
        return Model(file.read())


def _hash_rows(codes: np.ndarray) -> np.ndarray:
    """Hashes of the prefixes of each row, the empty one first."""
    out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
    for j in range(codes.shape[1]):
        out[:, j + 1] = out[:, j] * _B + codes[:, j] + np.uint64(1)
    return out


class Pairs:
    """Which pieces may follow each other under the merges of a BPE model; answers are remembered."""

    def __init__(self, model: Model):
        self.model = model
        self.keys, self.answers = np.zeros(0, np.int64), np.zeros(0, bool)

    def allowed(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        wanted, inverse = np.unique((first << 20) | second, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, wanted), max(0, len(self.keys) - 1))
        known = self.keys[at] == wanted if len(self.keys) else np.zeros(len(wanted), bool)
        answers = np.zeros(len(wanted), bool)
        answers[known] = self.answers[at[known]]
        fresh = wanted[~known]
        if len(fresh):
            answers[~known] = found = np.concatenate([self._stand(part) for part in np.array_split(fresh, len(fresh) // 65536 + 1)])
            if len(self.keys) > REMEMBERED:
                self.keys, self.answers = self.keys[:0], self.answers[:0]
            keys = np.concatenate([self.keys, fresh])
            order = np.argsort(keys, kind="stable")
            self.keys, self.answers = keys[order], np.concatenate([self.answers, found])[order]
        return answers[inverse]

    def _stand(self, pairs: np.ndarray) -> np.ndarray:
        """Merge the characters of each pair by rank, leftmost first; true where the two pieces are what is left."""
        m = self.model
        a, b = pairs >> 20, pairs & 0xFFFFF
        n = m.length[a] + m.length[b]
        place = np.arange(int(n.max()))[None]
        codes = np.where(place < m.length[a][:, None], m.chars[a][:, np.minimum(place[0], m.longest - 1)], 0)
        from_b = (place >= m.length[a][:, None]) & (place < n[:, None])
        codes[from_b] = m.chars[np.repeat(b, from_b.sum(1)), (place - m.length[a][:, None])[from_b]]
        symbols = m.probe(codes + np.uint64(1))
        symbols[place >= n[:, None]] = -1
        out, rows = np.zeros(len(pairs), bool), np.arange(len(pairs))
        far = np.iinfo(np.int64).max
        while len(rows):
            left, right = symbols[:, :-1], symbols[:, 1:]
            both = (left >= 0) & (right >= 0)
            merged = np.full(left.shape, -1, np.int64)
            l, r = left[both], right[both]
            fits = m.length[l] + m.length[r] <= m.longest
            found = np.full(len(l), -1, np.int64)
            found[fits] = m.probe(m.hash[l[fits]] * m.powers[m.length[r[fits]]] + m.hash[r[fits]])
            found[found >= m.size] = -1
            merged[both] = found
            rank = np.where(merged >= 0, m.rank[merged], far)
            at = rank.argmin(1) if rank.shape[1] else np.zeros(len(rows), np.int64)
            going = rank[np.arange(len(rows)), at] < far if rank.shape[1] else np.zeros(len(rows), bool)
            done = ~going
            if done.any():
                left_over = symbols[done]
                out[rows[done]] = (left_over[:, 0] == a[rows[done]]) & (left_over[:, 1] == b[rows[done]])
            symbols, rows, at, merged = symbols[going], rows[going], at[going], merged[going]
            if len(rows):
                k = np.arange(len(rows))
                symbols[k, at] = merged[k, at]
                shift = np.arange(symbols.shape[1])[None] + (np.arange(symbols.shape[1])[None] > at[:, None])
                padded = np.concatenate([symbols, np.full((len(rows), 1), -1)], 1)
                symbols = np.take_along_axis(padded, shift, 1)
        return out


def _segment(model: Model, pairs: Pairs, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of equal-length words (word, character): all pieces in order of words, and their number for each word."""
    n_words, n = codes.shape
    prefix = _hash_rows(codes)
    last = np.full((n_words, n + 1), -1, np.int64)
    best = np.full((n_words, n + 1), -np.inf)
    best[:, 0] = 0
    for j in range(1, n + 1):
        lengths = np.arange(1, min(j, model.longest) + 1)
        piece = model.probe(prefix[:, [j]] - prefix[:, j - lengths] * model.powers[lengths])
        w, k = np.nonzero(piece >= 0)
        own, begin = piece[w, k], j - lengths[k]
        value = np.full(piece.shape, -np.inf)
        if model.kind == UNIGRAM:
            value[w, k] = best[w, begin] + model.score[own]
        else:
            ok = begin == 0
            inner = np.flatnonzero(~ok)
            ok[inner] = pairs.allowed(last[w[inner], begin[inner]], own[inner])
            value[w[ok], k[ok]] = lengths[k[ok]]
        at = value.argmax(1)
        rows = np.arange(n_words)
        best[:, j], last[:, j] = value[rows, at], piece[rows, at]
    out, at, rows = np.zeros((n_words, n), np.int64), np.full(n_words, n), np.arange(n_words)
    count = np.zeros(n_words, np.int64)
    while len(rows):
        own = last[rows, at[rows]]
        count[rows] += 1
        out[rows, n - count[rows]] = own
        at[rows] -= model.length[own]
        rows = rows[at[rows] > 0]
    return out[np.arange(n)[None] >= (n - count)[:, None]], count


def _gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of ragged runs, one after the other."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())


def _bytes_of(code: int) -> list[int]:
    return list(chr(code).encode())


def encode_texts(model: Model, pairs: Pairs, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and the number of ids of each text."""
    mark = chr(MARK) if model.prefix else ""
    joined = "".join([mark + t if t else "" for t in texts])
    sizes = np.array([len(t) + len(mark) if t else 0 for t in texts], np.int64)
    counts = np.zeros(len(texts), np.int64)
    if not joined:
        return np.zeros(0, np.int32), counts
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
    codes[codes == 32] = MARK
    # Words begin where a text does, and between neighbours that no piece holds together.
    slot = np.where(codes == MARK, 0, codes)
    begins = np.ones(len(codes), bool)
    low = (slot[:-1] < 256) & (slot[1:] < 256)
    begins[1:][low] = ~model.low_pairs[slot[:-1][low], slot[1:][low]]
    key = (codes[:-1][~low] << 21) | codes[1:][~low]
    at = np.minimum(np.searchsorted(model.pairs, key), len(model.pairs) - 1)
    begins[1:][~low] = model.pairs[at] != key
    text_start = np.cumsum(sizes) - sizes
    begins[text_start[sizes > 0]] = True
    starts = np.flatnonzero(begins)
    lengths = np.diff(np.append(starts, len(codes)))
    # Distinct words.
    place = np.arange(len(codes)) - np.repeat(starts, lengths)
    longest = int(lengths.max())
    power = W._POWERS if longest <= len(W._POWERS) else W.powers(W._BASE, longest)
    word_hash = W.mix(np.add.reduceat(W.mix(codes.astype(np.uint64)) * power[place], starts) + lengths.astype(np.uint64) * W._STEP)
    _, first, word = np.unique(word_hash, return_index=True, return_inverse=True)
    own_start, own_length = starts[first], lengths[first]
    n_ids, chunks, where, held = np.zeros(len(first), np.int64), [], np.zeros(len(first), np.int64), 0

    def put(which, ids, count):
        nonlocal held
        where[which] = held + np.cumsum(count) - count
        n_ids[which] = count
        chunks.append(ids)
        held += len(ids)

    for length in np.unique(own_length).tolist():
        group = np.flatnonzero(own_length == length)
        for part in np.array_split(group, max(1, len(group) * length * min(length, model.longest) // CELLS)):
            matrix = codes[own_start[part][:, None] + np.arange(length)].astype(np.uint64)
            if length == 1:
                ids = model.probe(matrix + np.uint64(1)).ravel()
                count = np.ones(len(part), np.int64)
                ids[ids < 0] = -1 - matrix.ravel()[ids < 0].astype(np.int64)
            else:
                ids, count = _segment(model, pairs, matrix)
            put(part, *_with_bytes(model, ids, count))
    every = np.concatenate(chunks)
    ids = every[_gather(where[word], n_ids[word])]
    total = np.concatenate([[0], np.cumsum(n_ids[word])])
    edges = np.searchsorted(starts, np.append(text_start, len(codes)))
    return ids.astype(np.int32), total[edges[1:]] - total[edges[:-1]]


def _with_bytes(model: Model, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters without a piece (below zero, or beyond the pieces) as byte pieces; few words have any."""
    odd = np.flatnonzero((ids < 0) | (ids >= model.size))
    if not len(odd):
        return ids, count
    has_bytes = (model.byte != model.unknown).any()
    extra = {int(i): [int(model.byte[b]) for b in _bytes_of(-1 - int(ids[i]) if ids[i] < 0 else int(model.chars[ids[i], 0]))] if has_bytes else [model.unknown] for i in odd}
    n = np.ones(len(ids), np.int64)
    n[odd] = [len(extra[int(i)]) for i in odd]
    out = np.repeat(ids, n)
    begin = np.cumsum(n) - n
    for i, own in extra.items():
        out[begin[i] : begin[i] + len(own)] = own
    word = np.repeat(np.arange(len(count)), count)
    return out, np.bincount(word, weights=n, minlength=len(count)).astype(np.int64)


def decode_ids(model: Model, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and the offsets of the texts."""
    lengths = (model.out_start[1:] - model.out_start[:-1])[ids]
    raw = model.out_bytes[_gather(model.out_start[:-1][ids], lengths)]
    total = np.concatenate([[0], np.cumsum(lengths)])
    ends = np.concatenate([[0], np.cumsum(counts)])
    offsets = total[ends]
    if model.prefix and len(raw):  # the space put before each text
        head = offsets[:-1][counts > 0]
        head = head[raw[head] == 32]
        keep = np.ones(len(raw), bool)
        keep[head] = False
        raw = raw[keep]
        offsets = offsets - np.searchsorted(head, offsets)
    return raw, offsets


def _slices(column: pa.Array, size: int = SLICE):
    """(first row, texts) of runs of rows of about ``size`` bytes; only one run's texts are Python strings at a time."""
    _, bounds = W.text_buffer(column)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + size, "right")) - 1)
        yield low, column.slice(low, high - low).to_pylist()
        low = high


def encode_documents(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE) -> DataFrame:
    """(doc_id, ids): the piece ids of every whole text. Smaller slices hold less at a time and encode words more often."""

    def run(batches):
        pairs = Pairs(model)
        for batch in batches:
            for low, texts in _slices(batch.column(1), slice_bytes):
                ids, counts = encode_texts(model, pairs, texts)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                given = pa.array([t is None for t in texts])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids), mask=given)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(texts)), lists], names=["doc_id", "ids"])

    return id_and_text(documents, id_col, text_col).mapInArrow(W.tidy(run), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model: Model, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): the text of every row of ids; null ids give null."""

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            counts = np.diff(np.asarray(column.offsets))
            raw, offsets = decode_ids(model, np.asarray(column.flatten(), np.int64), counts)
            text = pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes()))
            if column.null_count:
                text = pa.compute.if_else(column.is_null(), pa.scalar(None, pa.large_string()), text)
            yield pa.RecordBatch.from_arrays([batch.column(0), text.cast(pa.string())], names=["doc_id", "text"])

    return encoded.selectExpr(f"`{id_col}` as doc_id", f"`{ids_col}` as ids").mapInArrow(W.tidy(run), "doc_id long, text string")


def encoding_digests(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pieces, n_byte_pieces, ids_sha256, round_trip) of every row; the hash is of little-endian 32-bit ids,
    round_trip says that decoding the ids gives the text (with space marks as spaces)."""
    is_byte = np.zeros(model.size, bool)
    is_byte[model.byte] = True

    def run(batches):
        pairs = Pairs(model)
        for batch in batches:
            for low, texts in _slices(batch.column(1)):
                ids, counts = encode_texts(model, pairs, texts)
                ends = np.concatenate([[0], np.cumsum(counts)])
                raw, offsets = decode_ids(model, ids, counts)
                plain, data = np.concatenate([[0], np.cumsum(is_byte[ids])]), raw.tobytes()
                rows = []
                for i, text in enumerate(texts):
                    if text is None:
                        rows.append((None, None, None, None))
                        continue
                    a, b = ends[i], ends[i + 1]
                    same = data[offsets[i] : offsets[i + 1]] == text.replace(chr(MARK), " ").encode()
                    rows.append((int(b - a), int(plain[b] - plain[a]), hashlib.sha256(ids[a:b].astype("<i4").tobytes()).hexdigest(), same))
                columns = list(zip(*rows)) or [[]] * 4
                arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, len(texts)), *arrays], names=["doc_id", "n_pieces", "n_byte_pieces", "ids_sha256", "round_trip"]
                )

    return id_and_text(documents, id_col, text_col).mapInArrow(
        W.tidy(run), "doc_id long, n_pieces long, n_byte_pieces long, ids_sha256 string, round_trip boolean"
    )


def op5(spark: SparkSession, folder: str) -> DataFrame:
    return encoding_digests(read(spark, folder, "documents"), load_model())


QUERIES = {"op5_sentencepiece": (op5, None)}
