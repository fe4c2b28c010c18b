"""How the data folder's tables stand for units, cells, labels and journals.

Each DataFrame here has a twin SQL text of the same meaning, used by the comparison SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom import constants as K
from pairloom.functions import text as T
from pairloom.sources.tables import table


# --- SQL fragments -----------------------------------------------------------------------------------

def sql_unit_hash(*parts: str) -> str:
    joined = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST(CAST('0x' || substr(sha256({joined}), 1, 8) AS UBIGINT) AS DOUBLE) / CAST(4294967296 AS DOUBLE))"


def sql_two(expr: str) -> str:
    return f"(floor({expr} * 100 + CAST(0.5 AS DOUBLE)) / CAST(100 AS DOUBLE))"


SQL_TOKENS = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: x <> '')"
SQL_LINES = "CAST(length({0}) - length(replace({0}, chr(10), '')) + 1 AS BIGINT)"


def sql_tokens(text: str) -> str:
    return SQL_TOKENS.format(text)


def sql_lines(text: str) -> str:
    return SQL_LINES.format(text)


def sql_kgrams(tokens: str, k: int, separator: str = "' '") -> str:
    return (
        f"CASE WHEN len({tokens}) >= {k} THEN list_transform(range(1, len({tokens}) - {k - 2}), "
        f"lambda i: array_to_string({tokens}[i:i+{k - 1}], {separator})) ELSE [] END"
    )


def sql_gram_rows(source: str, keys: str, tokens: str, k: int) -> str:
    """One row (keys, g) per window of k tokens, by looking ahead instead of slicing lists."""
    ahead = " || ' ' || ".join(["w", *[f"lead(w, {d}) OVER win" for d in range(1, k)]])
    return f"""(SELECT * FROM (SELECT {keys}, {ahead} AS g FROM (SELECT {keys}, unnest({tokens}) AS w, generate_subscripts({tokens}, 1) AS i FROM {source})
  WINDOW win AS (PARTITION BY {keys} ORDER BY i)) WHERE g IS NOT NULL)"""


def sql_values(rows: list[tuple], columns: str) -> str:
    def lit(v):
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        return f"'{v}'" if isinstance(v, str) else f"CAST({v} AS BIGINT)"

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS v({columns})"


# --- units -------------------------------------------------------------------------------------------

def units(spark: SparkSession, folder: str) -> DataFrame:
    """One unit per document: id, path, lang, lines and normalised tokens."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"),
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"),
        "lang",
        T.line_count(F.col("text")).alias("lines"),
        T.word_tokens(F.col("text")).alias("tokens"),
    )


SQL_UNITS = f"""units AS (SELECT doc_id AS id, source || '/' || doc_id AS path, lang,
  {sql_lines('text')} AS lines, {sql_tokens('text')} AS tokens FROM documents)"""

SQL_CLASSES = f"""{SQL_UNITS},
classes AS (SELECT min(id) AS cid, count(*) AS copies, tokens, lines,
  list_distinct({sql_kgrams('tokens', K.SHINGLE_WIDTH)}) AS items FROM units GROUP BY tokens, lines)"""

SQL_SIMS = f"""sh AS (SELECT cid, unnest(items) AS item FROM classes),
co AS (SELECT x.cid AS a, y.cid AS b, count(*) AS common FROM sh x JOIN sh y ON x.item = y.item AND x.cid < y.cid
  GROUP BY 1, 2),
pj AS (SELECT a, b, common / CAST(greatest(len(p.items) + len(q.items) - common, 1) AS DOUBLE) AS jaccard,
  CAST(least(p.lines, q.lines) AS DOUBLE) / CAST(greatest(p.lines, q.lines) AS DOUBLE) AS size_ratio,
  p.copies * q.copies AS pairs FROM co JOIN classes p ON p.cid = a JOIN classes q ON q.cid = b),
sims AS (SELECT * FROM pj WHERE jaccard >= CAST({K.MIN_JACCARD} AS DOUBLE) AND size_ratio >= CAST({K.MIN_SIZE_RATIO} AS DOUBLE)
  UNION ALL SELECT cid, cid, CAST(1 AS DOUBLE), CAST(1 AS DOUBLE), copies * (copies - 1) // 2 FROM classes
  WHERE copies > 1 AND len(items) > 0)"""
SQL_CLASS_PAIRS = f"{SQL_CLASSES}, {SQL_SIMS}"


def content_key(tokens: Column) -> Column:
    """What units of one class share beside their lines: their tokens, as a hash."""
    return F.xxhash64(tokens)


def class_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(key, lines, cid) of each class; no token is shuffled."""
    keyed = units(spark, folder).select("id", content_key(F.col("tokens")).alias("key"), "lines")
    return keyed.groupBy("key", "lines").agg(F.min("id").alias("cid"))


def shingled() -> Column:
    """Whether a class has a shingle. Asked of the items, they would be made again below the filter."""
    return F.size("tokens") >= K.SHINGLE_WIDTH


def classes(spark: SparkSession, folder: str) -> DataFrame:
    from pairloom.operators.similarity import content_classes

    return content_classes(units(spark, folder)).withColumn("items", T.shingle_hashes(F.col("tokens")))


def similar(spark: SparkSession, folder: str) -> DataFrame:
    from pairloom.operators.similarity import similar_class_pairs

    return similar_class_pairs(classes(spark, folder).select("cid", "lines", "copies", "items"))
