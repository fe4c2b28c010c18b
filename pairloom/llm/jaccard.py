"""N-gram Jaccard join by filters under several global token orders.

Two documents link when 100 * |common| >= per_cent * |union| of their distinct word shingles. Under any one order of
all shingles, linked documents share k of their first ``n - ceil(n * per_cent / 100) + k`` shingles, for any k, so a
pair may be dropped as soon as one order's prefixes do not meet. Three orders are used:

* by hash, with prefixes of about twice the least length: one pass counts how many prefix shingles of a set stand in
  the prefix of another, and sets with too few, by the least k a partner of fitting size can have, end here. A common
  passage is not enough to stay, so most of a corpus ends here;
* by document frequency among those left, rarest first: its prefixes are the index that proposes pairs. Shingles of
  passages that many documents share come last and propose nothing unless a document is little else;
* by a second hash: pairs proposed by the index must also share prefix shingles in both hash orders.

What passes all three is verified on whole sets (64-bit shingle hashes). Documents with one set are one class, held
by its smallest id, before anything is compared.

Components need no link inside one component twice, so the members of an index bucket first meet one leader each, for
``LEADER_ROUNDS`` rounds with other leaders among what is still apart; then all proposed pairs that lie in different
components are verified, those of the largest component of a bucket only against the others. A pair is proposed only
if the shingles that either shares with anyone can make up the overlap the pair needs. A bucket of any size
costs about its size unless its members truly differ, and no link between components is missed: the last round is run
whatever the leaders propose. There a pair must also be near enough by parities: of each set, the parity of the tokens
that fall into each of ``PARITIES`` places; each place where two sets differ holds a token that only one of them has.

Before the first shuffle a map task counts shingles it has seen in two sets itself, so a frequent shingle is sent once
a task. Texts are not shuffled where the ids of the sets left are few enough to be broadcast (``tables.SENT_IDS``).
Joins are of checkpointed sides that Spark splits where a key is hot.

Defined cases: null or empty texts have the empty set and are alone; fewer words than a shingle make one shingle; a
row without id has no component; rows of one id are one document, whatever their texts, and linked by it; an empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import words as W
from pairloom.llm.components import connected_components
from pairloom.llm.tables import SENT_IDS, cut, discard, id_and_text, one_row_per_id, read

SHINGLE = 4
PER_CENT = 85
LEADER_ROUNDS = 2
FLUSH = 1 << 20
PARITIES = 256

_SECOND = np.uint64(0xA5A5A5A55A5A5A5A)


def _prefix(n, per_cent: int):
    return n + (-n * per_cent) // 100 + 1


def _identity(own: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    size = np.uint64(len(own))
    a, b = W.mix(own + W._STEP).sum(dtype=np.uint64), W.mix(own ^ _SECOND).sum(dtype=np.uint64)
    return int((a + size).view(np.int64)), int((b ^ size).view(np.int64))


def _signatures(width: int):
    def run(batches):
        for batch in batches:
            n, one, two = [], [], []
            for group in W.iter_words(batch.column(1)):
                for own in W.shingle_sets(group, width):
                    a, b = _identity(own)
                    n.append(len(own))
                    one.append(a)
                    two.append(b)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (n, one, two))], names=["doc_id", "n_shingles", "s1", "s2"]
            )

    return run


def _prefix_rows(width: int, per_cent: int):
    """(token, s1, known): tokens of the long prefix by hash order. known is 0 for a token that one set of this task
    has, -1 for one that several have, sent for one of them; those sets' own count goes as a row with known above 0."""

    def flush(tokens, sets):
        token, owner = np.concatenate(tokens), np.concatenate(sets)
        order = np.lexsort((owner, token))
        token, owner = token[order], owner[order]
        fresh = np.concatenate([[True], (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])])
        token, owner = token[fresh], owner[fresh]
        head = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        holders = np.diff(np.append(head, len(token)))
        counted, times = np.unique(owner[np.repeat(holders > 1, holders)], return_counts=True)
        columns = (
            np.concatenate([token[head], counted.view(np.uint64)]).view(np.int64),
            np.concatenate([owner[head], counted]),
            np.concatenate([np.where(holders > 1, -1, 0), times]).astype(np.int32),
        )
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "s1", "known"])

    def run(batches):
        tokens, sets, held = [], [], 0
        for batch in batches:
            for group in W.iter_words(batch.column(0)):
                for own in W.shingle_sets(group, width):
                    if len(own):
                        tokens.append(own[: 2 * _prefix(len(own), per_cent) - 1])
                        sets.append(np.full(len(tokens[-1]), _identity(own)[0], np.int64))
                        held += len(tokens[-1])
                if held >= FLUSH:
                    yield flush(tokens, sets)
                    tokens, sets, held = [], [], 0
        if held:
            yield flush(tokens, sets)

    return run


def _shared_counts(batches):
    """(s1, n): prefix tokens a set shares, from rows sorted by token; a set in several tasks may be counted more often."""

    def settle(token, owner, known):
        counted, times = owner[known > 0], known[known > 0].astype(np.int64)
        token, owner, known = token[known <= 0], owner[known <= 0], known[known <= 0]
        if len(token):
            head = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            shared = (np.minimum.reduceat(owner, head) != np.maximum.reduceat(owner, head)) | (np.minimum.reduceat(known, head) < 0)
            own = owner[np.repeat(shared, np.diff(np.append(head, len(token)))) & (known == 0)]
            counted, times = np.concatenate([counted, own]), np.concatenate([times, np.ones(len(own), np.int64)])
        sets, inverse = np.unique(counted, return_inverse=True)
        n = np.bincount(inverse, weights=times, minlength=len(sets)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(sets.astype(np.int64)), pa.array(n)], names=["s1", "n"])

    rest = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
    for batch in batches:
        rest = [np.concatenate([old, batch.column(i).to_numpy()]) for i, old in enumerate(rest)]
        whole = int(np.searchsorted(rest[0], rest[0][-1])) if len(rest[0]) else 0  # the last token may go on
        if whole:
            yield settle(*(x[:whole] for x in rest))
            rest = [x[whole:] for x in rest]
    yield settle(*rest)


def _parities(own: np.ndarray) -> np.ndarray:
    odd = np.bincount((own % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sets(width: int, per_cent: int):
    """Rows (key, text, s1, s2) to whole sets in hash order with the second prefix and the parities, where the text has the set (s1, s2)."""

    def run(batches):
        for batch in batches:
            ids, wanted = batch.column(0).to_pylist(), list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()))
            types = (pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3)
            for group in W.iter_words(batch.column(1)):
                rows = []
                for i, own in enumerate(W.shingle_sets(group, width)):
                    row = group.first + i
                    if _identity(own) == wanted[row]:
                        second = own[np.argsort(W.mix(own ^ _SECOND), kind="stable")][: _prefix(len(own), per_cent)]
                        rows.append((ids[row], len(own), own.view(np.int64), second.view(np.int64), _parities(own)))
                columns = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["id", "n", "tokens", "second", "odd"])

    return run


def _first(n: Column, per_cent: int) -> Column:
    return (n - F.ceil(n * per_cent / 100) + 1).cast("int")


def _index(sets: DataFrame, per_cent: int) -> DataFrame:
    """(token, id, n, k): prefix tokens, rarest first, of sets that can have a partner. A token of one set takes a place
    only; k tokens of the set stand in another at all."""
    rows = sets.select("id", F.explode("tokens").alias("token"))
    often = cut(rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    known = rows.join(often, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t")).join(sets.select("id", "n"), "id")
    places = _first(F.col("n"), per_cent) - (F.col("n") - F.size("t")).cast("int")
    chosen = known.withColumn("places", places).where("places > 0").withColumn("k", F.size("t").cast("long"))
    return cut(chosen.select("id", "n", "k", F.explode(F.expr("transform(slice(t, 1, places), x -> x.token)")).alias("token")))


def _verify(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """(u, v): pairs (a, b) that pass both hash orders' prefixes and link by their whole sets."""
    one = sets.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("t_a"), F.col("second").alias("s_a"))
    two = sets.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("t_b"), F.col("second").alias("s_b"))
    met = pairs.join(one, "a").join(two, "b")
    first_orders = F.arrays_overlap("s_a", "s_b") & F.arrays_overlap(
        F.slice("t_a", F.lit(1), _first(F.col("n_a"), per_cent)), F.slice("t_b", F.lit(1), _first(F.col("n_b"), per_cent))
    )
    common = F.size(F.array_intersect("t_a", "t_b"))
    linked = met.where(F.when(first_orders, common * 100 >= (F.col("n_a") + F.col("n_b") - common) * per_cent).otherwise(False))
    return linked.select(F.col("a").alias("u"), F.col("b").alias("v"))


def _fits(n: Column, k: Column, m: Column, j: Column, per_cent: int) -> Column:
    """Sizes n and m fit, and the tokens that others share, k and j of them, can make up the overlap the pair needs."""
    return (F.least(n, m) * 100 >= F.greatest(n, m) * per_cent) & (F.least(k, j) * (100 + per_cent) >= (n + m) * per_cent)


def _near(n: Column, odd: Column, m: Column, other: Column, per_cent: int) -> Column:
    """The places where parities differ are no more than the tokens that only one set of a linked pair may have."""
    apart = sum((F.bit_count(odd[i].bitwiseXOR(other[i])) for i in range(PARITIES // 64)), F.lit(0))
    return apart * (100 + per_cent) <= (n + m) * (100 - per_cent)


def _labelled(index: DataFrame, links: list[DataFrame]) -> DataFrame:
    """The index with each id's component so far."""
    if not links:
        return index.withColumn("label", F.col("id"))
    found = cut(connected_components(reduce(DataFrame.unionByName, links)))
    return cut(
        index.join(found, F.col("id") == F.col("member"), "left").select("token", "id", "n", "k", F.coalesce("component", "id").alias("label"))
    )


def links_between(sets: DataFrame, per_cent: int, rounds: int = LEADER_ROUNDS) -> list[DataFrame]:
    """Edge tables (u, v) over sets(id, n, tokens, second, odd) that join the same ids as all links do."""
    index, links, tried = _index(sets, per_cent), [], []
    for turn in range(rounds + 1):
        rows = _labelled(index, links)
        if turn < rounds:
            # The member with the fewest tokens of its own is nearest to all others; where it is not, another leads next.
            own = F.col("n") - F.col("k") if turn == 0 else F.lit(0).cast("long")
            lead = F.min(F.struct(own.alias("own"), F.xxhash64(F.lit(turn), "id").alias("x"), "id", "n", "k", "label")).alias("lead")
            mixed = cut(rows.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), lead).where("low <> high").select("token", "lead"))
            met = rows.join(mixed, "token").where((F.col("label") != F.col("lead.label")) & _fits(F.col("n"), F.col("k"), F.col("lead.n"), F.col("lead.k"), per_cent))
            pairs = met.select(F.col("lead.id").alias("a"), F.col("id").alias("b"))
        else:
            shares = rows.groupBy("token", "label").agg(F.count(F.lit(1)).alias("k"))
            mixed = cut(shares.groupBy("token").agg(F.max(F.struct("k", "label")).alias("most"), F.count(F.lit(1)).alias("labels")).where("labels > 1").select("token", F.col("most.label").alias("major")))
            prefixes = index.groupBy("id").agg(F.sort_array(F.collect_list("token")).alias("prefix"))
            apart = cut(rows.join(mixed, "token").join(prefixes.join(sets.select("id", "odd"), "id"), "id"))
            minor = apart.where("label <> major").select("token", F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("k").alias("k_a"), F.col("label").alias("label_a"), F.col("prefix").alias("prefix_a"), F.col("odd").alias("odd_a"))
            met = minor.join(apart, "token").where(
                (F.col("label_a") != F.col("label")) & ((F.col("label") == F.col("major")) | (F.col("a") < F.col("id"))) & _fits(F.col("n"), F.col("k"), F.col("n_a"), F.col("k_a"), per_cent)
                & _near(F.col("n"), F.col("odd"), F.col("n_a"), F.col("odd_a"), per_cent)
                # A pair is proposed in the bucket of its first common prefix token alone.
                & (F.try_element_at(F.array_intersect("prefix_a", "prefix"), F.lit(1)) == F.col("token"))
            )
            pairs = met.select("a", F.col("id").alias("b"))
        pairs = pairs.distinct()
        for earlier in tried:
            back = earlier.select(F.col("b").alias("a"), F.col("a").alias("b"))
            pairs = pairs.join(earlier, ["a", "b"], "left_anti").join(back, ["a", "b"], "left_anti")
        pairs = cut(pairs)
        if pairs.isEmpty():
            continue
        tried.append(pairs)
        links.append(cut(_verify(pairs, sets, per_cent)))
    return links


def similar_documents(
    documents: DataFrame, width: int = SHINGLE, per_cent: int = PER_CENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; component_id is the smallest id reachable by links."""
    docs = id_and_text(documents, id_col, text_col)
    signed = cut(docs.mapInArrow(W.tidy(_signatures(width)), "doc_id long, n_shingles long, s1 long, s2 long"))
    named = signed.where("doc_id is not null and n_shingles > 0")
    classes = cut(named.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n")))

    some = docs.where("doc_id is not null and text is not null")
    prefixes = some.select("text").mapInArrow(W.tidy(_prefix_rows(width, per_cent)), "token long, s1 long, known int")
    shared = prefixes.repartition("token").sortWithinPartitions("token").mapInArrow(W.tidy(_shared_counts), "s1 long, n long").groupBy("s1").agg(F.sum("n").alias("shared"))
    enough = F.ceil(F.col("n") * per_cent / 100)  # of the shortest partner, whose least k holds
    left = classes.join(shared, "s1").where(F.col("shared") >= enough - F.ceil(enough * per_cent / 100) + 1)
    # A document whose rows differ has several sets, so sets go by a key of their own.
    held = cut(left.select(F.col("rep").alias("held_id"), "s1", "s2", F.monotonically_increasing_id().alias("key")))
    sent = F.broadcast(held) if held.count() <= SENT_IDS else held
    texts = some.join(sent, F.col("doc_id") == F.col("held_id")).select("key", "text", "s1", "s2")
    sets = cut(texts.mapInArrow(W.tidy(_sets(width, per_cent)), "id long, n long, tokens array<long>, second array<long>, odd array<long>"))
    sets = one_row_per_id(sets, "id")

    member = cut(named.join(classes.select("s1", "s2", "rep"), ["s1", "s2"]).select("doc_id", "n_shingles", "rep"))
    own = member.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high")
    one_id = member.join(cut(own), "doc_id").where("rep <> low").select(F.col("rep").alias("u"), F.col("low").alias("v"))
    links, rep = links_between(sets, per_cent), held.select("key", "held_id")
    by_rep = [x.join(rep.toDF("u", "rep_u"), "u").join(rep.toDF("v", "rep_v"), "v").select(F.col("rep_u").alias("u"), F.col("rep_v").alias("v")) for x in links]
    links.append(cut(one_id))
    by_rep.append(links[-1])
    found = cut(connected_components(reduce(DataFrame.unionByName, by_rep)))
    discard(sets, held, *links)
    grouped = member.join(found, F.col("rep") == F.col("member"), "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    alone = signed.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return grouped.unionByName(alone)


def op7(spark: SparkSession, folder: str) -> DataFrame:
    return similar_documents(read(spark, folder, "documents"))


OP7_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, md5(array_to_string(w[p:p + k - 1], ' ')) AS h
  FROM (SELECT doc_id, w, least({SHINGLE}, len(w)) AS k, unnest(range(1, len(w) - least({SHINGLE}, len(w)) + 2)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM g a JOIN g b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE i * 100 >= (a.n + b.n - i) * {PER_CENT}),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(y) FROM r WHERE r.x = d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id)
"""

QUERIES = {"op7_ngram_jaccard": (op7, OP7_SQL)}
