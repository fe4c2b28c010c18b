"""Range joins: owners, outermost units, overlap exclusion and section coverage.

An order stands for a function's range in its customer's file: days from the order on, as many as its price says. Line
items are what has to be owned or covered, from their shipping day on.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.operators import intervals as I
from pairloom.sources.tables import table
from pairloom.session import cut_lineage

QUERIES: dict = {}


def _day(column: str):
    return F.datediff(F.col(column), F.lit("1970-01-01").cast("date")).cast("bigint")


def units(spark, folder):
    """(file, id, start, end, role) per order."""
    orders = table(spark, folder, "orders")
    start = _day("o_orderdate")
    return orders.select(
        F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("id"), start.alias("start"),
        (start + 1 + F.floor("o_totalprice") % 700).cast("bigint").alias("end"), F.col("o_orderstatus").alias("role"),
    )


# Line numbers below this one give each line item of an order a number that no other order has.
LINES = 100


def references(spark, folder, distinct=False):
    """(file, ref, start, end, role) per line item; ref is order and line number in one number.

    ``distinct`` says that every order comes once and has line numbers below LINES, so that all rows of a reference are
    in the task that joins its order.
    """
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_linestatus", _day("l_shipdate").alias("start"))
    files = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("file"))
    # An item may come twice under one number; each number is one reference.
    within = ["l_orderkey"] if distinct else []
    one = items.join(files.hint("merge"), "l_orderkey").groupBy(*within, "file", (F.col("l_orderkey") * LINES + F.col("l_linenumber")).alias("ref")).agg(
        F.min(F.struct("start", F.col("l_quantity").cast("bigint").alias("q"), F.col("l_linestatus").alias("role"))).alias("r")
    )
    return one.select("file", "ref", F.col("r.start").alias("start"), (F.col("r.start") + F.col("r.q")).alias("end"), F.col("r.role").alias("role"))


SQL_UNITS = """un AS (SELECT o_custkey AS file, o_orderkey AS id, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS s,
  CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 1 + CAST(floor(o_totalprice) AS BIGINT) % 700 AS BIGINT) AS e, o_orderstatus AS role FROM orders)"""
SQL_REFS = """it AS (SELECT o_custkey AS file, CAST(l_orderkey * 100 + l_linenumber AS BIGINT) AS ref, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS s,
  CAST(l_quantity AS BIGINT) AS q, l_linestatus AS role FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
rf AS (SELECT file, ref, s, s + q AS e, role FROM (SELECT *, row_number() OVER (PARTITION BY file, ref ORDER BY s, q, role) AS k FROM it) WHERE k = 1)"""


def range_owners(spark, folder):
    """The shortest and the longest unit that contains each reference."""
    numbers = F.col("l_linenumber").between(0, LINES - 1)
    distinct = table(spark, folder, "lineitem").where(~F.coalesce(numbers, F.lit(False))).isEmpty()
    distinct = distinct and table(spark, folder, "orders").groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    all_units = units(spark, folder)
    # A file's references stand as dense as its orders, of which each has a few.
    return I.owners(references(spark, folder, distinct), all_units, "file", "ref", "id", density=all_units, distinct=distinct)


QUERIES["range_owners"] = (
    range_owners,
    f"""WITH {SQL_UNITS}, {SQL_REFS}, p AS (SELECT ref, id, un.e - un.s AS n FROM rf JOIN un ON un.file = rf.file AND un.s <= rf.s AND rf.e <= un.e)
SELECT rf.ref, CAST(count(id) AS BIGINT) AS owners, arg_min(id, (n, id)) AS innermost, arg_min(id, (-n, id)) AS outermost FROM rf LEFT JOIN p ON p.ref = rf.ref GROUP BY rf.ref""",
)


def outermost_units(spark, folder):
    """Units that lie in no other unit of their file."""
    return I.outermost(cut_lineage(units(spark, folder)), "file", "id").select("file", "id", "start", "end")


QUERIES["outermost_units"] = (
    outermost_units,
    f"""WITH {SQL_UNITS} SELECT file, id, s AS start, e AS "end" FROM un x WHERE NOT EXISTS (SELECT 1 FROM un y WHERE y.file = x.file AND y.id <> x.id
  AND y.s <= x.s AND x.e <= y.e AND (y.s <> x.s OR y.e <> x.e OR y.id < x.id))""",
)


def overlap_exclusions(spark, folder):
    """Per file: pairs of units, those left out because their ranges meet, and the units concerned."""
    rows = cut_lineage(units(spark, folder))
    pairs = cut_lineage(I.overlapping_pairs(rows, "file", "id"))
    met = pairs.groupBy("file").agg(F.count(F.lit(1)).alias("overlapping"))
    touched = pairs.select("file", F.explode(F.array("a", "b")).alias("id")).distinct().groupBy("file").agg(F.count(F.lit(1)).alias("units_met"))
    totals = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    every = F.floor(F.col("n") * (F.col("n") - 1) / 2).cast("bigint")
    return totals.join(met, "file", "left").join(touched, "file", "left").fillna(0, ["overlapping", "units_met"]).select(
        "file", every.alias("pairs"), "overlapping", (every - F.col("overlapping")).alias("admitted"), "units_met"
    )


QUERIES["overlap_exclusions"] = (
    overlap_exclusions,
    f"""WITH {SQL_UNITS}, p AS (SELECT x.file, x.id AS a, y.id AS b FROM un x JOIN un y ON x.file = y.file AND x.id < y.id AND x.s < y.e AND y.s < x.e),
m AS (SELECT file, count(*) AS k FROM p GROUP BY file), t AS (SELECT file, count(DISTINCT id) AS u FROM (SELECT file, a AS id FROM p UNION ALL SELECT file, b FROM p) GROUP BY file),
n AS (SELECT file, count(*) AS n FROM un GROUP BY file)
SELECT n.file, CAST(n * (n - 1) // 2 AS BIGINT) AS pairs, CAST(coalesce(k, 0) AS BIGINT) AS overlapping, CAST(n * (n - 1) // 2 - coalesce(k, 0) AS BIGINT) AS admitted,
  CAST(coalesce(u, 0) AS BIGINT) AS units_met FROM n LEFT JOIN m ON m.file = n.file LEFT JOIN t ON t.file = n.file""",
)


def section_coverage(spark, folder):
    """Per role: references that a section of their file and role contains, that only one of another role does, and the rest."""
    refs, sections = cut_lineage(references(spark, folder)), cut_lineage(units(spark, folder).drop("id"))
    pairs = I.containing(refs, sections, "file")
    own = pairs.groupBy("ref").agg(F.bool_or(F.col("role") == F.col("r_role")).alias("own"))
    state = F.when(F.col("own"), "covered").when(F.col("own").isNotNull(), "other_role").otherwise("uncovered")
    return refs.join(own, "ref", "left").groupBy("role", state.alias("state")).agg(F.count(F.lit(1)).alias("refs"), F.min("ref").alias("first_ref"))


QUERIES["section_coverage"] = (
    section_coverage,
    f"""WITH {SQL_UNITS}, {SQL_REFS}, o AS (SELECT ref, bool_or(un.role = rf.role) AS own FROM rf JOIN un ON un.file = rf.file AND un.s <= rf.s AND rf.e <= un.e GROUP BY ref)
SELECT role, CASE WHEN own THEN 'covered' WHEN own IS NOT NULL THEN 'other_role' ELSE 'uncovered' END AS state, CAST(count(*) AS BIGINT) AS refs, min(rf.ref) AS first_ref
FROM rf LEFT JOIN o ON o.ref = rf.ref GROUP BY 1, 2""",
)
