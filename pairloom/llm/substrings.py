"""Substring dedup: windows of WINDOW words that also start in a document with a smaller id are removed.

Every window of a text gets a Rabin-Karp hash (a polynomial over word hashes modulo 2^64, from prefix sums). Windows
are counted in Spark under an anchor: the least of the Rabin-Karp hashes of the ``ANCHOR``-word runs inside the
window. Equal windows have equal anchors, and neighbouring windows mostly share theirs, so windows travel packed: one
row per run of windows with one anchor (about thirteen), holding the document, the first place and the window hashes.
Each window is shuffled once, as eight bytes.

A map task first settles what it can: of equal windows it has seen, only the document with the smallest id needs an
answer from elsewhere, the others are removed already. So a window, however common, reaches its reducer at most once
a flush of a task, and runs of a text of which a task has seen every window in a smaller document are not sent.

Windows that run over the end of a passage many documents share are each the only one of their kind, but have the
passage's anchor in common. Anchors that stand in many documents are found beforehand, by counting those of one
document in SAMPLE_ONE_IN; windows under them travel by their own hash instead, one row each, so that only equal windows
meet. At most MOST_HOT anchors are sent to the tasks. Which way a window goes changes no result.

Reducers read rows sorted by anchor, a few thousand at a time, and compare hashes; what they return are runs of removed
windows, merged into maximal intervals for each document.

Words stay unchanged; the kept words of a document are joined by one space.

Defined cases: null and empty texts have no words; texts shorter than a window lose nothing; repeats inside one
document stay; documents of one id never remove from each other, and a null id neither removes nor loses; repeated
rows are judged alike; empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import words as W
from pairloom.llm.tables import cut, discard, id_and_text, read

WINDOW = 50
ANCHOR = 25
FLUSH = 1 << 18
# An anchor is hot from HOT_DOCUMENTS runs of the documents looked at, or from the share that leaves MOST_HOT of them.
SAMPLE_ONE_IN, HOT_DOCUMENTS, MOST_HOT = 16, 64, 50_000

_B = np.uint64(0x9E3779B97F4A7C15)
_RUNS = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int32()), ("hashes", pa.binary())])
_RUNS_SQL = "anchor long, doc_id long, text_key long, start int, hashes binary"
_CUTS_SQL = "doc_id long, text_key long, start int, n int"
_CUTS = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of each run of width words, by its first word.

    The polynomial of all words up to a place is summed in blocks, so that powers stay few whatever the length.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, block = np.empty(n, np.uint64), 1 << 16
    power = W.powers(_B, min(len(hashes), block + width))
    inverse = W.powers(np.uint64(pow(int(_B), -1, 1 << 64)), min(n, block))
    for at in range(0, n, block):
        own = hashes[at : at + block + width - 1]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * power[: len(own)], dtype=np.uint64)])
        m = len(own) - width + 1
        out[at : at + m] = (total[width : width + m] - total[:m]) * inverse[:m]
    return W.mix(out)


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each width values in a row, by doubling."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _settle(docs: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For windows (document, hash): which are equal to one of a smaller document, and which are of the smallest."""
    order = np.lexsort((docs, key))
    k, d = key[order], docs[order]
    first = np.concatenate([[True], k[1:] != k[:-1]])
    least = d[np.flatnonzero(first)][np.cumsum(first) - 1]
    later = np.empty(len(docs), bool)
    later[order] = d > least
    return later, ~later


def _cut_runs(docs, text_keys, place, removed):
    """Runs of removed windows as rows; the windows come in order of document and place."""
    at = np.flatnonzero(removed)
    if not len(at):
        return pa.RecordBatch.from_arrays([pa.array([], t) for t in _CUTS.types], schema=_CUTS)
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (docs[at[1:]] != docs[at[:-1]]) | (text_keys[at[1:]] != text_keys[at[:-1]]) | (place[at[1:]] != place[at[:-1]] + 1)])
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(at)))
    first = at[head]
    return pa.RecordBatch.from_arrays(
        [pa.array(docs[first]), pa.array(text_keys[first]), pa.array(place[first].astype(np.int32)), pa.array(n.astype(np.int32))], schema=_CUTS
    )


def _pack_runs(anchors, docs, text_keys, place, hashes, wanted):
    """Rows of _RUNS for the wanted windows: neighbours of one text under one anchor share a row."""
    at = np.flatnonzero(wanted)
    if not len(at):
        return pa.RecordBatch.from_arrays([pa.array([], t) for t in _RUNS.types], schema=_RUNS)
    same = (at[1:] == at[:-1] + 1) & (anchors[at[1:]] == anchors[at[:-1]]) & (place[at[1:]] == place[at[:-1]] + 1) & (docs[at[1:]] == docs[at[:-1]])
    head = np.flatnonzero(np.concatenate([[True], ~same]))
    offsets = (np.append(head, len(at)) * 8).astype(np.int32)
    packed = pa.BinaryArray.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(hashes[at].tobytes())])
    first = at[head]
    return pa.RecordBatch.from_arrays(
        [pa.array(anchors[first].view(np.int64)), pa.array(docs[first]), pa.array(text_keys[first]), pa.array(place[first].astype(np.int32)), packed],
        schema=_RUNS,
    )


def _as_runs(cuts: pa.RecordBatch) -> pa.RecordBatch:
    """Settled cuts travel among the runs, marked by missing hashes and spread by their place."""
    n = cuts.num_rows
    spread = W.mix(cuts.column(1).to_numpy().view(np.uint64) + cuts.column(2).to_numpy().astype(np.uint64)).view(np.int64)
    # A run's length of removed windows stands in the anchor's stead; the row needs no partner.
    return pa.RecordBatch.from_arrays(
        [pa.array(spread), cuts.column(0), cuts.column(1), cuts.column(2), pa.array([int(x).to_bytes(4, "little") for x in cuts.column(3).to_pylist()] if n else [], pa.binary())],
        schema=_RUNS,
    )


def _anchor_rows(window: int, anchor: int):
    """(anchor) for every run of windows of a text that share it."""

    def run(batches):
        for batch in batches:
            for group in W.iter_words(batch.column(0), W.VISIBLE, W.SAME):
                sizes = np.diff(group.bounds) - window + 1
                if not (sizes > 0).any():
                    continue
                least = _sliding_least(rolling(group.hashes, anchor), window - anchor + 1)
                rows = np.flatnonzero(sizes > 0)
                n = sizes[rows]
                at = np.repeat(group.bounds[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
                found = least[at]
                new = np.ones(len(found), bool)
                new[1:] = found[1:] != found[:-1]
                new[np.cumsum(n)[:-1]] = True
                yield pa.RecordBatch.from_arrays([pa.array(found[new].view(np.int64))], names=["anchor"])

    return run


def hot_anchors(docs: DataFrame, window: int, anchor: int) -> np.ndarray:
    """Sorted anchors under which windows of many documents would meet; docs has doc_id and text."""
    some = docs.where(F.pmod(F.xxhash64(F.lit("hot"), "doc_id", "text"), F.lit(SAMPLE_ONE_IN)) == 0)
    counts = some.select("text").mapInArrow(W.tidy(_anchor_rows(window, anchor)), "anchor long").groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    often = cut(counts.where(F.col("n") >= HOT_DOCUMENTS))
    least = max(HOT_DOCUMENTS, -(-(often.agg(F.sum("n")).first()[0] or 0) // MOST_HOT))
    found = [row[0] for row in often.where(F.col("n") >= least).select("anchor").collect()]
    discard(often)
    return np.sort(np.array(found, np.int64).view(np.uint64))


def _map_windows(window: int, anchor: int, hot: np.ndarray):
    def flush(parts):
        docs, keys, place, anchors, hashes = (np.concatenate(x) for x in zip(*parts))
        later, first = _settle(docs, hashes)
        if len(hot):
            common = hot[np.minimum(np.searchsorted(hot, anchors), len(hot) - 1)] == anchors
            anchors = np.where(common, hashes, anchors)
        yield _pack_runs(anchors, docs, keys, place, hashes, first)
        cuts = _cut_runs(docs, keys, place, later)
        if cuts.num_rows:
            yield _as_runs(cuts)

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for group in W.iter_words(batch.column(2), W.VISIBLE, W.SAME):
                sizes = np.diff(group.bounds) - window + 1
                if not (sizes > 0).any():
                    continue
                whole, inner = rolling(group.hashes, window), rolling(group.hashes, anchor)
                least = _sliding_least(inner, window - anchor + 1)
                rows = np.flatnonzero(sizes > 0)
                n = sizes[rows]
                own = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(group.bounds[rows], n) + own
                row = np.repeat(rows + group.first, n)
                parts.append((ids[row], keys[row], own, least[at], whole[at]))
                held += len(at)
                if held >= FLUSH:
                    yield from flush(parts)
                    parts, held = [], 0
        if parts:
            yield from flush(parts)

    return run


def _match_windows(batches):
    """Removed windows among runs sorted by anchor; rows of one anchor are held only while they may still be compared."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        if rest.num_rows < 4096:
            continue
        anchors = rest.column("anchor").to_numpy()
        whole = int(np.searchsorted(anchors, anchors[-1]))  # the last anchor may go on in the next batch
        if whole:
            yield _match(rest.slice(0, whole).combine_chunks())
            rest = rest.slice(whole)
    if rest is not None and rest.num_rows:
        yield _match(rest.combine_chunks())


def _match(rows: pa.Table) -> pa.RecordBatch:
    anchors, docs, keys, start = (rows.column(i).to_numpy() for i in range(4))
    blobs = rows.column(4).combine_chunks() if isinstance(rows.column(4), pa.ChunkedArray) else rows.column(4)
    blobs = pa.concat_arrays([blobs]) if isinstance(blobs, pa.Array) else blobs
    _, offsets, data = blobs.buffers()
    offsets = np.frombuffer(offsets, np.int32)[blobs.offset : blobs.offset + len(blobs) + 1].astype(np.int64)
    size = np.diff(offsets)
    settled = size % 8 == 4
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    done = np.flatnonzero(settled)
    lengths = raw[offsets[done][:, None] + np.arange(4)].copy().view("<i4").ravel() if len(done) else np.zeros(0, np.int32)
    # Only anchors with rows of two documents can hold equal windows.
    new = np.concatenate([[True], anchors[1:] != anchors[:-1]])
    group = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    differs = np.minimum.reduceat(docs, head) != np.maximum.reduceat(docs, head)
    at = np.flatnonzero(differs[group] & ~settled)
    n = size[at] // 8
    own = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    byte = np.repeat(offsets[at], n) + own * 8
    hashes = raw[byte[:, None] + np.arange(8)].copy().view("<u8").ravel() if len(byte) else np.zeros(0, np.uint64)
    w_docs, w_keys, w_place = np.repeat(docs[at], n), np.repeat(keys[at], n), np.repeat(start[at], n) + own
    later, _ = _settle(w_docs, hashes) if len(hashes) else (np.zeros(0, bool), None)
    found = _cut_runs(w_docs, w_keys, w_place, later)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([docs[done], found.column(0).to_numpy()])),
            pa.array(np.concatenate([keys[done], found.column(1).to_numpy()])),
            pa.array(np.concatenate([start[done], found.column(2).to_numpy()]).astype(np.int32)),
            pa.array(np.concatenate([lengths, found.column(3).to_numpy()]).astype(np.int32)),
        ],
        schema=_CUTS,
    )


def window_runs(documents: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(anchor, doc_id, text_key, start, hashes): packed windows that only a comparison with other documents settles."""
    anchor = max(1, min(ANCHOR, window // 2))
    docs = id_and_text(documents, id_col, text_col).where("doc_id is not null and text is not null")
    hot = hot_anchors(docs, window, anchor)
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(W.tidy(_map_windows(window, anchor, hot)), _RUNS_SQL)


def repeated_windows(documents: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, start, n): runs of n windows, from word start on, that also start in a smaller document."""
    runs = window_runs(documents, window, id_col, text_col)
    return runs.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(W.tidy(_match_windows), _CUTS_SQL)


def removed_intervals(cuts: DataFrame) -> DataFrame:
    """(doc_id, text_key, cuts array<struct<start, n>>): all runs of a document; a document's runs are bounded by its words."""
    return cuts.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "n")).alias("cuts"))


def _removed_words(n_words: int, cuts, window: int) -> np.ndarray:
    """Which words lie in a removed window: maximal intervals as steps up and down."""
    step = np.zeros(n_words + 1, np.int32)
    for cut in cuts or ():
        step[cut["start"]] += 1
        step[cut["start"] + cut["n"] + window - 1] -= 1
    return np.cumsum(step[:-1]) > 0


def _kept_rows(texts, cut_lists, window: int):
    """(words, removed words, maximal removed intervals, kept words joined by one space) of each text of a column."""
    raw, bounds = W.text_buffer(texts)
    for group in W.iter_words(texts, W.VISIBLE, W.SAME):
        base = int(bounds[group.first])
        for i in range(group.rows):
            a, b = group.bounds[i], group.bounds[i + 1]
            gone = _removed_words(int(b - a), cut_lists[group.first + i].as_py(), window)
            starts, ends = group.starts[a:b] + base, group.ends[a:b] + base
            kept = b" ".join(raw[s:e].tobytes() for s, e in zip(starts[~gone].tolist(), ends[~gone].tolist()))
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
            yield int(b - a), int(gone.sum()), edge.reshape(-1, 2).tolist(), kept


def _joined_cuts(documents: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """Documents with all their columns, then the removed runs of each."""
    cuts = removed_intervals(repeated_windows(documents, window, id_col, text_col)).select(
        F.col("doc_id").alias("_cut_id"), F.col("text_key").alias("_cut_key"), F.col("cuts").alias("_cuts")
    )
    same = (F.col(id_col).cast("long") == F.col("_cut_id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("_cut_key"))
    return documents.join(cuts, same, "left").drop("_cut_id", "_cut_key")


def remove_repeats(documents: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, removed, kept_sha256) of every row; removed lists maximal intervals of words [from, to)."""
    docs = _joined_cuts(id_and_text(documents, id_col, text_col), window, "doc_id", "text")

    def run(batches):
        for batch in batches:
            rows = [(n, gone, cuts, hashlib.sha256(kept).hexdigest()) for n, gone, cuts, kept in _kept_rows(batch.column(1), batch.column(2), window)]
            columns = list(zip(*rows)) or [[]] * 4
            types = (pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=["doc_id", "n_words", "n_removed", "removed", "kept_sha256"]
            )

    return docs.mapInArrow(W.tidy(run), "doc_id long, n_words long, n_removed long, removed array<array<long>>, kept_sha256 string")


def without_repeats(documents: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with all their columns and the kept text: unchanged where nothing is removed, else the kept words joined
    by one space. A null text stays null."""
    docs, text, width = _joined_cuts(documents, window, id_col, text_col), documents.columns.index(text_col), len(documents.columns)

    def run(batches):
        for batch in batches:
            own, cuts = batch.column(text), batch.column(width)
            cut = np.flatnonzero(np.asarray(cuts.is_valid()))
            new = own.to_pylist()
            for row, (*_, kept) in zip(cut.tolist(), _kept_rows(own.take(pa.array(cut)), cuts.take(pa.array(cut)), window)):
                new[row] = kept.decode()
            columns = list(batch.columns[:width])
            columns[text] = pa.array(new, own.type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:width])

    return docs.mapInArrow(W.tidy(run), documents.schema)


def op8(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(read(spark, folder, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP8_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, md5(array_to_string(w[p:p + {WINDOW - 1}], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS p FROM d)),
cut AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY h) AS least FROM win) WHERE least < doc_id),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
last AS (SELECT word.doc_id, word.p, x, max(cut.p) OVER (PARTITION BY word.doc_id ORDER BY word.p) AS c FROM word LEFT JOIN cut ON cut.doc_id = word.doc_id AND cut.p = word.p),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM last WHERE c IS NULL OR c < p - {WINDOW - 1} GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

QUERIES = {"op8_substring_dedup": (op8, OP8_SQL)}
