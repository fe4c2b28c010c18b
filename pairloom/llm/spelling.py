"""Spelling variants: words that differ by exactly one inserted, deleted or replaced code point, and their usual forms.

Words are counted over whole texts and then joined among themselves by a variable-length gram index:

* Gram dictionary. Grams of LEAST_GRAM code points all belong to it; a longer one, up to MOST_GRAM, belongs to it if its
  prefix does and that prefix is frequent, so rare grams stay short and frequent ones grow. Counts are made in Spark
  over all distinct words. A gram is frequent above the FREQUENT-th part of all gram places, so at most FREQUENT grams of
  a length are, each with at most 127 longer ones: the dictionary is bounded whatever the vocabulary, and it is sent
  to the tasks.
* Decomposition. At each place of a word, marked at both ends, stands the longest gram of the dictionary; grams inside an
  earlier one are left out.
* Affected grams. An edit at a place touches the grams that hold it, the earlier ones whose longest match may grow over it
  (what precedes the place begins a longer gram) and the later ones that a new gram may swallow (what follows the
  place ends a gram). All others stand in both words of a pair.
* List merging. As one edit parts a pair, both words agree on all up to the last shared gram before it and on all from the
  first shared gram after it. The bound of a place says which grams these can be: none farther off than the nearest
  that an edit there leaves untouched. A word enters one list for each such pair of grams, named by what stands before
  and after; near words share one, and the long lists of single grams are never merged. A word of which one edit may
  touch all grams is short; two such words also meet by what is left of them after a deletion.
* Verification by edit distance.

The decomposition sees 127 letters; code points beyond a-z and the Latin-1 letters share some of them, which only adds
candidates.

Defined cases: null and empty texts have no words; a null id deletes nothing (the query's planted errors); repeated
rows count again; an empty table gives no rows; extra columns are ignored. Words of any length are compared. Ties for a
form go to the smallest word in code-point order. Forms grow by the ratio in count, so chains end.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import words as W
from pairloom.llm.tables import cut, discard, id_and_text, read

LEAST_GRAM, MOST_GRAM = 2, 4
FREQUENT = 1024
# A gram of fewer places is never made longer.
FEW = 8
RATIO = 10
LEAST_LETTERS = 7
LEAST_COUNT = 2
# Words of up to so many letters travel with their lists; letters of words that a task decomposes at once.
LONG, LETTERS_AT_ONCE = 64, 1 << 16

_BITS = 7
_BASE = np.uint64(0x9E3779B97F4A7C15)
_START, _END = "^", "$"


def _letters() -> np.ndarray:
    """Number of each code point below 65,536 in the index: marks 1 and 2, a-z from 3, Latin-1 letters from 29, others from 93."""
    out = 93 + np.arange(1 << 16, dtype=np.int64) % 35
    out[ord("a") : ord("z") + 1] = np.arange(3, 29)
    out[0xC0:0x100] = np.arange(29, 93)
    out[[ord(_START), ord(_END)]] = 1, 2
    return out


# ---------------------------------------------------------------- words of texts

_LETTER = ((np.arange(256) >= 65) & (np.arange(256) <= 90)) | ((np.arange(256) >= 97) & (np.arange(256) <= 122))


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


def _crc_on(state: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of bytes that begin with what gave state and go on with raw[starts:ends]."""
    order = np.argsort(starts - ends, kind="stable")
    c, at, size = state[order] ^ np.uint32(0xFFFFFFFF), starts[order], (ends - starts)[order]
    for k in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -k))
        c[:n] = _CRC[(c[:n] ^ raw[at[:n] + k]) & 255] ^ (c[:n] >> 8)
    out = np.empty_like(c)
    out[order] = c ^ np.uint32(0xFFFFFFFF)
    return out


def _gather(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = ends - starts
    to = np.cumsum(size)
    return raw[np.arange(to[-1] if len(to) else 0) + np.repeat(starts - (to - size), size)], np.concatenate([[0], to])


def _count_words(batches, least: int, one_in: int | None):
    for batch in batches:
        ids = batch.column(0).to_pylist() if one_in else None
        raw_all, bounds_all = W.text_buffer(batch.column(1))
        row, rows = 0, len(bounds_all) - 1
        while row < rows:
            last = max(row + 1, int(np.searchsorted(bounds_all, bounds_all[row] + W.SLICE, "right")) - 1)
            raw = W.LOWER[raw_all[bounds_all[row] : bounds_all[last]]]
            bounds = bounds_all[row : last + 1] - bounds_all[row]
            # A Latin-1 letter is the byte C3 and one more.
            lead = raw == 0xC3
            inside = _LETTER[raw] | lead
            inside[1:] |= lead[:-1]
            edge = np.ones(len(raw) + 1, bool)
            np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
            edge[bounds] = True
            cuts = np.flatnonzero(edge)
            word = inside[cuts[:-1]] if len(raw) else np.zeros(0, bool)
            starts, ends = cuts[:-1][word], cuts[1:][word]
            two = np.concatenate([[0], np.cumsum(lead)])
            letters = (ends - starts) - (two[ends] - two[starts])
            long = letters >= least
            starts, ends, letters = starts[long], ends[long], letters[long]
            flat, offsets = _gather(raw, starts, ends)
            if one_in and len(starts):
                owner = np.searchsorted(bounds, starts, "right") - 1
                known = np.array([ids[row + i] is not None for i in range(last - row)])
                state = np.array([zlib.crc32(f"{ids[row + i]}:".encode()) for i in range(last - row)], np.uint32)
                h = _crc_on(state[owner], raw, starts, ends)
                hit = np.flatnonzero((h % one_in == 0) & known[owner])
                # The byte where the code point to delete begins, and one more for a Latin-1 letter.
                begins = np.cumsum(~np.concatenate([[False], flat[:-1] == 0xC3])) if len(flat) else flat
                drop = np.searchsorted(begins, begins[offsets[hit]] + h[hit] % letters[hit])
                keep = np.ones(len(flat), bool)
                keep[drop] = False
                pair = drop[flat[drop] == 0xC3]
                keep[pair + 1] = False
                left = np.concatenate([[0], np.cumsum(keep)])
                flat, offsets = flat[keep], left[offsets]
                letters = letters.copy()
                letters[hit] -= 1
            found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat)))
            if one_in:
                found = found.filter(pa.array(letters >= least))
            counted = pc.value_counts(found)
            yield pa.RecordBatch.from_arrays([counted.field(0), counted.field(1)], names=["word", "n"])
            row = last


def count_words(documents: DataFrame, least_letters: int = LEAST_LETTERS, one_in: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): runs of A-Z, a-z and U+00C0-U+00FF with A-Z lower-cased, of at least so many code points.

    With ``one_in``, errors are planted first: where h, the crc32 of ``<id>:<word>``, is a multiple of it, the word loses
    its code point h modulo its length. Words are counted by slice of text, then by task, then over all.
    """
    rows = id_and_text(documents, id_col, text_col).where("text is not null")
    return rows.mapInArrow(lambda batches: _count_words(batches, least_letters, one_in), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- gram index


def gram_dictionary(vocabulary: DataFrame, frequent: int = FREQUENT, few: int = FEW) -> dict[int, np.ndarray]:
    """Longer grams of the dictionary by length, as sorted codes.

    Reaches the driver: the grams of two letters, and at most frequent * 127 of each length above; never words.
    """
    marked = F.concat(F.lit(_START), F.col("word"), F.lit(_END))
    codes: dict[int, np.ndarray] = {}
    extensible: list[str] | None = None
    for size in range(LEAST_GRAM, MOST_GRAM + 1):
        gram = F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("m") - size + 1, F.lit(1))), lambda i: F.substring("m", i, F.lit(size))))
        grams = vocabulary.select(marked.alias("m")).select(gram.alias("g")).where(F.length("g") == size)
        if extensible is not None:
            if not extensible:
                break
            grams = grams.where(F.substring("g", 1, size - 1).isin(extensible))
        rows = grams.groupBy("g").count().collect()
        if size == LEAST_GRAM:
            least = max(few, sum(r[1] for r in rows) / frequent)
        else:
            codes[size] = np.array(sorted({encode_gram(g) for g, _ in rows}), np.int64)
        extensible = [g for g, n in rows if n > least]
    return codes


def encode_gram(gram: str) -> int:
    code, letter = 0, _letters()
    for c in gram:
        code = code << _BITS | int(letter[min(ord(c), 65535)])
    return code


def _among(values: np.ndarray, sorted_codes: np.ndarray) -> np.ndarray:
    if not len(sorted_codes):
        return np.zeros(len(values), bool)
    return sorted_codes[np.minimum(np.searchsorted(sorted_codes, values), len(sorted_codes) - 1)] == values


class Decomposed(NamedTuple):
    """Letters of marked words end to end; per word where it begins, its length, its grams and the most of them that one edit
    touches; per gram its word, place, size and code; then pairs of contexts: all of a word up to one place and since another."""

    value: np.ndarray
    begin: np.ndarray
    length: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    size: np.ndarray
    gram: np.ndarray
    grams: np.ndarray
    most: np.ndarray
    upto: np.ndarray
    since: np.ndarray


class GramIndex:
    """Decomposition of words by a dictionary, and what one edit of a word leaves untouched."""

    def __init__(self, codes: dict[int, np.ndarray]):
        none = np.zeros(0, np.int64)
        self.codes = {size: codes.get(size, none) for size in range(LEAST_GRAM + 1, MOST_GRAM + 1)}
        # What begins or ends a longer gram, by length.
        self.heads = {n: np.unique(np.concatenate([self.codes[k] >> (_BITS * (k - n)) for k in self.codes if k > n] or [none])) for n in range(LEAST_GRAM, MOST_GRAM)}
        self.tails = {n: np.unique(np.concatenate([self.codes[k] & ((1 << (_BITS * n)) - 1) for k in self.codes if k > n] or [none])) for n in range(LEAST_GRAM, MOST_GRAM)}
        self.letter = _letters()

    def decompose(self, words: list[str]) -> Decomposed:
        text = "".join(f"{_START}{w}{_END}" for w in words)
        points = np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 65535)
        value = self.letter[points]
        length = np.array([len(w) + 2 for w in words], np.int64)
        end = np.cumsum(length)
        begin = end - length
        n = len(value)
        owner = np.repeat(np.arange(len(words)), length)
        room = end[owner] - np.arange(n)
        code = {1: value}
        for size in range(2, MOST_GRAM + 1):
            follow = np.zeros(n, np.int64)
            follow[: n - size + 1] = value[size - 1 :]
            code[size] = code[size - 1] << _BITS | follow
        size_at = np.where(room >= LEAST_GRAM, LEAST_GRAM, 0)
        for size in range(LEAST_GRAM + 1, MOST_GRAM + 1):
            size_at[(room >= size) & _among(code[size], self.codes[size])] = size
        stop = np.where(size_at > 0, np.arange(n) + size_at, 0)
        before = np.concatenate([[0], np.maximum.accumulate(stop)[:-1]])
        at = np.flatnonzero(stop > before)
        # Counts of grams that start before a place and of grams that end at or before it.
        starts = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=n + 1))])
        ends = np.cumsum(np.bincount(stop[at], minlength=n + 1))
        first = starts[begin]
        grams = starts[end] - first
        place = np.arange(n)
        reach = place - 1
        swallow = np.minimum(place + 2, end[owner])
        for size in range(LEAST_GRAM, MOST_GRAM):
            head = np.zeros(n, bool)
            head[size:] = _among(code[size], self.heads[size])[: n - size]
            head &= place - size >= begin[owner]
            reach = np.where(head, place - size, reach)
            tail = np.zeros(n, bool)
            tail[: n - 1] = _among(code[size], self.tails[size])[1:]
            tail &= room > size
            swallow = np.where(tail, place + 1 + size, swallow)
        # Of the grams in order, those before ``low`` and from ``high`` on are untouched by an edit at a place.
        low = np.minimum(ends[place], starts[np.maximum(reach, begin[owner])])
        high = np.maximum(starts[place + 1], ends[swallow])
        touched = high - low
        touched[begin] = 0
        most = np.maximum.reduceat(touched, begin)
        # The last gram before an edit that still stands is one of low - 1 .. ends - 1, the first after it one of starts .. high;
        # what is inserted at a place comes before it, so that a gram which begins there may stand.
        edit = np.flatnonzero(place > begin[owner])
        n_left, n_right = (ends[place] - low + 1)[edit], (high - starts[place] + 1)[edit]
        which = np.repeat(edit, n_left * n_right)
        step = np.arange(len(which)) - np.repeat(np.cumsum(n_left * n_right) - n_left * n_right, n_left * n_right)
        across = np.repeat(n_right, n_left * n_right)
        left, right = low[which] - 1 + step // across, starts[which] + step % across
        o = owner[which]
        upto = np.where(left >= first[o], stop[at[np.maximum(left, 0)]], begin[o])
        since = np.where(right < first[o] + grams[o], at[np.minimum(right, len(at) - 1)], end[o])
        some = (upto > begin[o]) | (since < end[o])
        pairs = np.unique(upto[some] * (n + 1) + since[some])
        sizes = size_at[at]
        gram = np.select([sizes == size for size in range(LEAST_GRAM, MOST_GRAM + 1)], [code[size][at] for size in range(LEAST_GRAM, MOST_GRAM + 1)])
        return Decomposed(value, begin, length, owner[at], at - begin[owner[at]], sizes, gram, grams, most, pairs // (n + 1), pairs % (n + 1))

    def keys(self, words: list[str]):
        """Lists that words enter: word number and list key; and which words one edit may touch whole."""
        d = self.decompose(words)
        # Hashes of all up to a place of a word and of all from it on, by prefix sums of a polynomial from either end.
        own = np.repeat(d.length, d.length)
        place = np.arange(len(d.value)) - np.repeat(d.begin, d.length)
        power = W.powers(_BASE, int(d.length.max()))
        letter = W.mix(d.value.astype(np.uint64))
        forth = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letter * power[place], dtype=np.uint64)])
        back = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letter * power[own - 1 - place], dtype=np.uint64)])
        number = np.searchsorted(d.begin, d.upto, "right") - 1
        begin, end = d.begin[number], d.begin[number] + d.length[number]
        left = W.mix(forth[d.upto] - forth[begin])
        right = W.mix(back[end] - back[d.since])
        return number, W.mix(left * _BASE + right).view(np.int64), d.grams <= d.most


def _entries(sent):
    """Rows (number, words) to (key, number, ...): the lists each word enters; a missing key for words that may lose all grams."""

    def run(batches):
        index = GramIndex(sent.value)
        for batch in batches:
            length = np.cumsum([len(w) for w in batch.column(0).to_pylist()])
            low = 0
            while low < batch.num_rows:
                done = length[low - 1] if low else 0
                high = max(low + 1, int(np.searchsorted(length, done + LETTERS_AT_ONCE, "right")))
                part = batch.slice(low, high - low)
                number, keys, weak = index.keys(part.column(0).to_pylist())
                lost = np.flatnonzero(weak)
                which = pa.array(np.concatenate([number, lost]))
                key = pa.array(np.concatenate([keys, np.zeros(len(lost), np.int64)]), mask=np.arange(len(which)) >= len(number))
                names = batch.schema.names[1:]
                yield pa.RecordBatch.from_arrays([key, *(part.column(name).take(which) for name in names)], names=["key", *names])
                low = high

    return run


def near_words(vocabulary: DataFrame, frequent: int = FREQUENT, few: int = FEW) -> DataFrame:
    """(a, n_a, b, n_b): each pair of words of ``vocabulary(word, n)`` that one edit parts, once. Words are distinct.

    A word enters some lists a letter. Words of up to LONG letters travel along and are compared where they meet; of longer
    ones only a number travels, and the words are joined to the pairs found.
    """
    sent = vocabulary.sparkSession.sparkContext.broadcast(gram_dictionary(vocabulary, frequent, few))

    def met(rows: DataFrame, *columns: str) -> DataFrame:
        first, second = (rows.select("key", *[F.col(c).alias(f"{c}_{side}") for c in columns]) for side in "ab")
        return first.join(second, "key").where(F.col(f"{columns[0]}_a") < F.col(f"{columns[0]}_b"))

    def one_edit(pairs: DataFrame) -> DataFrame:
        return pairs.where(F.levenshtein("word_a", "word_b", 1) == 1).select(F.col("word_a").alias("a"), "n_a", F.col("word_b").alias("b"), "n_b")

    words = vocabulary.select("word", F.col("n").cast("long").alias("n"))
    usual = words.where(F.length("word") <= LONG)
    entries = cut(usual.select("word", F.col("word").alias("w"), "n").mapInArrow(_entries(sent), "key long, w string, n long").withColumnRenamed("w", "word"))
    rest = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, F.length("word"))))
    left = entries.where("key is null").select(F.explode(F.array_distinct(F.concat(F.array("word"), rest))).alias("key"), "word", "n")
    # Of two words a letter apart in length the shorter may be a usual one, so words of LONG letters stand in both parts.
    long = cut(words.where(F.length("word") >= LONG).withColumn("id", F.monotonically_increasing_id()))
    numbers = met(long.select("word", "id").mapInArrow(_entries(sent), "key long, id long"), "id").select("id_a", "id_b").distinct()
    side = lambda s: long.select(F.col("id").alias(f"id_{s}"), F.col("word").alias(f"word_{s}"), F.col("n").alias(f"n_{s}"))
    apart = one_edit(numbers.join(side("a"), "id_a").join(side("b"), "id_b"))
    swap = F.col("a") > F.col("b")
    apart = apart.select(F.least("a", "b").alias("a"), F.when(swap, F.col("n_b")).otherwise(F.col("n_a")).alias("n_a"), F.greatest("a", "b").alias("b"), F.when(swap, F.col("n_a")).otherwise(F.col("n_b")).alias("n_b"))
    near = one_edit(met(entries.where("key is not null"), "word", "n")).unionByName(one_edit(met(left, "word", "n")))
    return near.unionByName(apart).distinct()


def spelling_forms(words: DataFrame, ratio: int = RATIO, frequent: int = FREQUENT, few: int = FEW) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of ``words(word, n)``; counts of repeated words add up.

    The form is the near word of largest count, if that is at least ratio times the word's; the root is the end of the
    chain of forms, the word itself without a form.
    """
    vocabulary = cut(words.where("word is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n")))
    pairs = near_words(vocabulary, frequent, few)
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("m"))))
    near = pairs.select(both.alias("r")).groupBy("r.word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("r.m")).alias("m"), F.col("r.near").alias("w"))).alias("best"))
    good = -F.col("best.m") >= ratio * F.col("n")
    formed = cut(
        vocabulary.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("best.w")).alias("form"), F.when(good, -F.col("best.m")).alias("form_n")
        )
    )
    # Each round doubles the length of the chains that are followed.
    chain = cut(formed.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        further = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = cut(chain.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        done = longer.where("moved").isEmpty()
        discard(chain)
        chain = longer
        if done:
            break
    return formed.join(chain.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op11(spark: SparkSession, folder: str) -> DataFrame:
    words = count_words(read(spark, folder, "documents"), LEAST_LETTERS, one_in=31).where(F.col("n") >= LEAST_COUNT)
    return spelling_forms(words).select("word", "form", "root", "n", "n_near", "form_n")


_LATIN = "".join(map(chr, range(0xC0, 0x100)))
# One-byte stands-ins for the 64 Latin-1 letters, since DuckDB's edit distance counts bytes.
_ONE_BYTE = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.islower() and c != "'")[:64]

OP11_SQL = f"""
WITH RECURSIVE crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)),
run AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
few AS (SELECT doc_id, w, count(*) AS m FROM run WHERE length(w) >= {LEAST_LETTERS} GROUP BY doc_id, w),
bytes AS (SELECT doc_id, w, m, flatten(list_transform(string_split(doc_id || ':' || w, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)]
  ELSE [192 | (unicode(x) >> 6), 128 | (unicode(x) & 63)] END)) AS b FROM few),
hashed AS (SELECT w, m, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), CAST(b AS BIGINT[])), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
planted AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w, m FROM hashed),
v AS (SELECT w AS word, CAST(sum(m) AS BIGINT) AS n, translate(w, '{_LATIN}', '{_ONE_BYTE}') AS z FROM planted WHERE length(w) >= {LEAST_LETTERS} GROUP BY w HAVING sum(m) >= {LEAST_COUNT}),
key AS (SELECT DISTINCT word, z, n, z[:i] || z[i + 2:] AS k FROM (SELECT *, unnest(range(length(z) + 1)) AS i FROM v)),
near AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS m FROM key a JOIN key b ON a.k = b.k WHERE a.word <> b.word AND levenshtein(a.z, b.z) = 1),
best AS (SELECT word, count(*) AS n_near, arg_min(other, row(-m, other)) AS form, max(m) AS form_n FROM near GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {RATIO} * v.n THEN form END AS form, CASE WHEN form_n >= {RATIO} * v.n THEN form_n END AS form_n FROM v LEFT JOIN best ON best.word = v.word),
walk AS (SELECT word, word AS root, form AS following FROM f UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN f ON f.word = walk.following)
SELECT f.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM f JOIN walk ON walk.word = f.word WHERE walk.following IS NULL
"""

QUERIES = {"op11_spelling_variants": (op11, OP11_SQL)}
