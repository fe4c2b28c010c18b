"""Small tables with every awkward case, and plain-Python forms of what the operators compute."""

import re

from pyspark.sql import types as T

DOC = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that the operators use themselves.
        T.StructField("ids", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("component_id", T.StringType()),
        T.StructField("token", T.StringType()),
    ]
)


def documents(spark, rows):
    """(doc_id, text) or (doc_id, text, lang) to a documents table with clashing extra columns."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, len(r[1] or ""), "x", "x", "x", "x") for r in rows]
    return spark.createDataFrame(full, DOC)


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def visible(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def alnum(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", fold(text))


def shingles(words, k):
    if not words:
        return set()
    k = min(k, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def groups(links, nodes):
    """Smallest reachable node of each."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


AWKWARD = ["", " \n\t ", None, "one", "one two", "É ß 日本語 𝄞", "\x00\x01", "A" * 5000]
