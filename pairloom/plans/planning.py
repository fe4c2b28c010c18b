"""From units to requests: formation, bounded context, budgets, splits, seals and manifest checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom import constants as K
from pairloom.functions import text as T
from pairloom.operators import lines as L
from pairloom.operators import packing as P
from pairloom.operators.admission import admit_in_order
from pairloom.operators.ordered import first_n, ranked
from pairloom.plans import bindings as B
from pairloom.plans.reports import FUNCTION_SIGNALS
from pairloom.plans.statistics import D
from pairloom.plans.texts import SQL_LINES
from pairloom.session import cut_lineage
from pairloom.sources.tables import table

QUERIES: dict = {}


def unit_formation(spark, folder):
    """Function units, then pair units; the number of the unit follows that order. A class of copies is the pair unit of
    its representative with itself, and pairs counts the pairs a unit stands for."""
    one = F.lit(1).cast("bigint").alias("pairs")
    functions = table(spark, folder, "documents").select(F.lit(0).alias("k"), F.lit("function").alias("kind"), F.col("doc_id").alias("a"), F.col("doc_id").alias("b"), one)
    pairs = B.similar(spark, folder).select(F.lit(1).alias("k"), F.lit("clone_pair").alias("kind"), "a", "b", "pairs")
    rows = functions.unionByName(pairs)
    keyed = rows.withColumn("unit_id", F.sha2(F.concat_ws("|", "kind", F.col("a").cast("string"), F.col("b").cast("string")), 256))
    return ranked(keyed, [], ["k", "a", "b"], name="number").drop("k")


QUERIES["unit_formation"] = (
    unit_formation,
    f"""WITH {B.SQL_CLASS_PAIRS}, u AS (SELECT 0 AS k, 'function' AS kind, doc_id AS a, doc_id AS b, 1 AS pairs FROM documents UNION ALL SELECT 1, 'clone_pair', a, b, pairs FROM sims)
SELECT kind, a, b, CAST(pairs AS BIGINT) AS pairs, sha256(kind || '|' || a || '|' || b) AS unit_id, CAST(row_number() OVER (ORDER BY k, a, b) AS BIGINT) AS number FROM u""",
)


def topn_context(spark, folder):
    """Callers of a unit: an order's lines by part and position, three kept."""
    refs = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("unit_id"), F.col("l_partkey").alias("path"), F.col("l_linenumber").alias("start"))
    kept, _ = P.bounded_references(refs, "unit_id", ["path", "start"], K.MAX_CALLERS, "caller_cap")
    return kept.select("unit_id", "path", F.col("start").cast("bigint").alias("start"), F.col("rank").cast("bigint").alias("rank"))


QUERIES["topn_context"] = (
    topn_context,
    f"""WITH r AS (SELECT l_orderkey AS unit_id, l_partkey AS path, CAST(l_linenumber AS BIGINT) AS start, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber) AS BIGINT) AS rank FROM lineitem)
SELECT * FROM r WHERE rank <= {K.MAX_CALLERS}""",
)


def context_omissions(spark, folder):
    """What the three caps leave out, one row per unit and cap."""
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("unit_id"), F.col("l_partkey").alias("path"), F.col("l_linenumber").alias("start"))
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("unit_id"), F.col("o_orderkey").alias("path"), F.lit(0).alias("start"))
    events = table(spark, folder, "events").select(F.col("user_id").alias("unit_id"), F.col("event_id").alias("path"), F.lit(0).alias("start"))
    parts = (("caller_cap", lines, K.MAX_CALLERS), ("import_declaration_cap", orders, K.MAX_IMPORTS), ("test_reference_cap", events, K.MAX_TESTS))
    frames = [P.bounded_references(refs, "unit_id", ["path", "start"], cap, reason)[1] for reason, refs, cap in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


QUERIES["context_omissions"] = (
    context_omissions,
    f"""SELECT l_orderkey AS unit_id, 'caller_cap' AS reason, CAST(count(*) - {K.MAX_CALLERS} AS BIGINT) AS count, FALSE AS decisive FROM lineitem GROUP BY 1 HAVING count(*) > {K.MAX_CALLERS}
UNION ALL SELECT o_custkey, 'import_declaration_cap', CAST(count(*) - {K.MAX_IMPORTS} AS BIGINT), FALSE FROM orders GROUP BY 1 HAVING count(*) > {K.MAX_IMPORTS}
UNION ALL SELECT user_id, 'test_reference_cap', CAST(count(*) - {K.MAX_TESTS} AS BIGINT), FALSE FROM events GROUP BY 1 HAVING count(*) > {K.MAX_TESTS}""",
)


def test_references(spark, folder):
    """Tests of a member: days with a click (call) or a view (import) of a user; two kept."""
    e = table(spark, folder, "events").select(F.col("user_id").alias("member"), F.to_date("ts").cast("string").alias("test_path"), F.col("event_id").alias("place"), "event_type")
    pick = lambda kind: e.where(F.col("event_type") == kind).drop("event_type")
    best = P.best_test_reference(pick("click"), pick("view"))
    return first_n(best, ["member"], ["priority", "test_path", "place"], K.MAX_TESTS).withColumn("rank", F.col("rank").cast("bigint"))


QUERIES["test_references"] = (
    test_references,
    f"""WITH e AS (SELECT user_id AS member, CAST(CAST(ts AS DATE) AS VARCHAR) AS test_path, event_id AS place, CAST(CASE WHEN event_type = 'click' THEN 0 ELSE 1 END AS BIGINT) AS priority FROM events WHERE event_type IN ('click', 'view')),
b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY member, test_path ORDER BY priority, place) = 1),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY member ORDER BY priority, test_path, place) AS BIGINT) AS rank FROM b) SELECT member, test_path, priority, place, rank FROM r WHERE rank <= {K.MAX_TESTS}""",
)
TRIM_BUDGET = 150


def trim_order(spark, folder):
    """References of an order in trim order (tier, then larger, then later first) until the rest fits."""
    refs = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("unit_id"), F.col("l_linenumber").cast("bigint").alias("index"), F.floor("l_quantity").cast("bigint").alias("bytes"),
        F.when(F.col("l_returnflag") == "N", 2).when(F.col("l_returnflag") == "R", 1).otherwise(0).cast("bigint").alias("tier"),
    )
    return P.trim_to_budget(refs, "unit_id", [F.col("tier").desc(), F.col("bytes").desc(), F.col("index").desc()], "bytes", F.lit(0), TRIM_BUDGET)


QUERIES["trim_order"] = (
    trim_order,
    f"""WITH r AS (SELECT l_orderkey AS unit_id, CAST(l_linenumber AS BIGINT) AS index, CAST(floor(l_quantity) AS BIGINT) AS bytes, CAST(CASE l_returnflag WHEN 'N' THEN 2 WHEN 'R' THEN 1 ELSE 0 END AS BIGINT) AS tier FROM lineitem)
SELECT *, CASE WHEN sum(bytes) OVER (PARTITION BY unit_id ORDER BY tier, bytes, index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) > {TRIM_BUDGET} THEN 'request_byte_budget_trim' END AS omission FROM r""",
)

GROUP_CAP = K.MAX_REQUEST_BYTES


def _question_bytes():
    return F.array(*[F.struct(F.lit(i).alias("position"), (F.floor(T.unit_hash(F.lit(f"qb{i}"), F.col("doc_id")) * 800) + 100).cast("bigint").alias("bytes")) for i, _ in FUNCTION_SIGNALS])


def question_bins(spark, folder):
    """Question groups per document: state bytes plus questions stay under the cap."""
    docs = table(spark, folder, "documents").select("doc_id", F.octet_length("text").cast("bigint").alias("state"))
    rows = P.question_groups(docs.withColumn("q", _question_bytes()), "q", F.col("state"), GROUP_CAP)
    return rows.select("doc_id", F.array_join(F.col("groups").cast("array<string>"), ",").alias("groups"), (F.array_max("groups") + 1).cast("bigint").alias("group_count"))


_pos = [i for i, _ in FUNCTION_SIGNALS]
_qb = ", ".join(f"CAST(floor({B.sql_unit_hash(chr(39) + f'qb{i}' + chr(39), 'doc_id')} * 800) AS BIGINT) + 100" for i in _pos)
QUERIES["question_bins"] = (
    question_bins,
    f"""WITH RECURSIVE d AS (SELECT doc_id, octet_length(encode(text)) AS state, [{_qb}] AS q FROM documents),
f(doc_id, i, grp, used, outs) AS (SELECT doc_id, 1, 0, q[1], '0' FROM d UNION ALL
  SELECT f.doc_id, i + 1, CASE WHEN state + used + q[i + 1] <= {GROUP_CAP} THEN grp ELSE grp + 1 END, CASE WHEN state + used + q[i + 1] <= {GROUP_CAP} THEN used + q[i + 1] ELSE q[i + 1] END,
    outs || ',' || CASE WHEN state + used + q[i + 1] <= {GROUP_CAP} THEN grp ELSE grp + 1 END FROM f JOIN d ON d.doc_id = f.doc_id WHERE i < {len(_pos)})
SELECT f.doc_id, CASE WHEN list_max(q) + state <= {GROUP_CAP} THEN outs END AS groups, CASE WHEN list_max(q) + state <= {GROUP_CAP} THEN CAST(grp + 1 AS BIGINT) END AS group_count FROM f JOIN d ON d.doc_id = f.doc_id WHERE i = {len(_pos)}""",
)
WINDOW_CAP = 1200


def window_halving(spark, folder):
    """Window size of each document too large for one request."""
    docs = table(spark, folder, "documents").where(F.length("text") > WINDOW_CAP).withColumn("lines", T.line_count(F.col("text")).cast("int"))
    return P.choose_window(L.line_table(docs, "doc_id", "text", "lines"), "doc_id", "lines", WINDOW_CAP)


QUERIES["window_halving"] = (
    window_halving,
    f"""WITH {SQL_LINES}, d AS (SELECT doc_id, greatest({K.MIN_WINDOW_LINES}, CAST(ceil({B.sql_lines('text')} / {D(2)}) AS BIGINT)) AS s0 FROM documents WHERE length(text) > {WINDOW_CAP}),
z AS (SELECT DISTINCT doc_id, greatest({K.MIN_WINDOW_LINES}, s0 >> CAST(k AS INTEGER)) AS size FROM d, (SELECT unnest(range(0, 31)) AS k)),
w AS (SELECT doc_id, size, (line - 1) // size AS w, sum(length + 1) AS bytes FROM lt JOIN z USING (doc_id) GROUP BY ALL),
p AS (SELECT doc_id, size, max(bytes) AS largest, count(*) AS windows FROM w GROUP BY 1, 2)
SELECT doc_id, CAST(max(size) AS BIGINT) AS size, CAST(arg_max(windows, size) AS BIGINT) AS windows, CAST(arg_max(largest, size) AS BIGINT) AS largest FROM p WHERE largest <= {WINDOW_CAP} OR size = {K.MIN_WINDOW_LINES} GROUP BY doc_id""",
)
UNIT_BUDGET = K.MAX_UNITS


def unit_parts(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.greatest(F.ceil(F.length("text") / WINDOW_CAP), F.lit(1)).cast("bigint").alias("parts"))


def unit_admission(spark, folder):
    """Units enter while all their parts stay under the cap; a later, smaller unit may still fit."""
    rows = admit_in_order(unit_parts(spark, folder), ["doc_id"], "parts", UNIT_BUDGET)
    return rows.select("doc_id", "parts", F.when(F.col("admitted"), "packed").otherwise("not_packed_candidate_limit").alias("disposition"))


QUERIES["unit_admission"] = (
    unit_admission,
    f"""WITH RECURSIVE o AS (SELECT doc_id, CAST(greatest(ceil(length(text) / {D(WINDOW_CAP)}), 1) AS BIGINT) AS parts, row_number() OVER (ORDER BY doc_id) AS rn FROM documents),
f(rn, used, ok) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), FALSE UNION ALL SELECT o.rn, CASE WHEN used + parts <= {UNIT_BUDGET} THEN used + parts ELSE used END, used + parts <= {UNIT_BUDGET} FROM f JOIN o ON o.rn = f.rn + 1)
SELECT doc_id, parts, CASE WHEN ok THEN 'packed' ELSE 'not_packed_candidate_limit' END AS disposition FROM o JOIN f USING (rn)""",
)


def split_cascade(spark, folder):
    """How each unit is asked: whole, in question groups, in line windows, or not at all (pairs)."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", F.octet_length("text").cast("bigint").alias("state"), (T.unit_hash(F.lit("kind"), F.col("doc_id")) < 0.2).alias("pair"))
    rows = docs.withColumn("q", _question_bytes())
    total = F.aggregate("q", F.lit(0).cast("bigint"), lambda a, x: a + x["bytes"])
    largest = F.array_max(F.transform("q", lambda x: x["bytes"]))
    branch = (
        F.when(F.col("state") + total <= 6000, "whole").when(F.col("state") + largest <= 6000, "question_groups")
        .when(F.col("pair"), "members_exceed_request_cap_relational_not_splittable").otherwise("line_windows")
    )
    return rows.groupBy("lang", branch.alias("branch")).agg(F.count(F.lit(1)).alias("units"))


QUERIES["split_cascade"] = (
    split_cascade,
    f"""WITH d AS (SELECT doc_id, lang, octet_length(encode(text)) AS state, {B.sql_unit_hash("'kind'", 'doc_id')} < {D(0.2)} AS pair, [{_qb}] AS q FROM documents)
SELECT lang, CASE WHEN state + list_sum(q) <= 6000 THEN 'whole' WHEN state + list_max(q) <= 6000 THEN 'question_groups' WHEN pair THEN 'members_exceed_request_cap_relational_not_splittable' ELSE 'line_windows' END AS branch,
  CAST(count(*) AS BIGINT) AS units FROM d GROUP BY 1, 2""",
)


def requests(spark, folder):
    """One request document per unit as JSON, with its bytes and hash."""
    d = table(spark, folder, "documents")
    body = F.to_json(F.struct(F.lit("scorer-1.1.0").alias("model"), F.struct(F.col("source").alias("path"), F.col("lang").alias("kind"), F.col("doc_id").alias("id"), "text").alias("state"), F.lit(len(FUNCTION_SIGNALS)).alias("questions")))
    return d.select("doc_id", "lang", body.alias("body")).select("doc_id", "lang", F.octet_length("body").cast("bigint").alias("bytes"), F.sha2("body", 256).alias("request_hash"))


SQL_REQUESTS = f"""rq0 AS (SELECT doc_id, lang, CAST(to_json({{'model': 'scorer-1.1.0', 'state': {{'path': source, 'kind': lang, 'id': doc_id, 'text': text}}, 'questions': {len(FUNCTION_SIGNALS)}}}) AS VARCHAR) AS body FROM documents),
rq AS (SELECT doc_id, lang, octet_length(encode(body)) AS bytes, sha256(body) AS request_hash FROM rq0)"""
QUERIES["request_documents"] = (requests, f"WITH {SQL_REQUESTS} SELECT doc_id, lang, CAST(bytes AS BIGINT) AS bytes, request_hash FROM rq")


def plan_estimates(spark, folder):
    """Requests, questions, bytes, and the money bounds that follow from them."""
    t = requests(spark, folder).groupBy("lang").agg(F.count(F.lit(1)).alias("requests"), F.sum("bytes").alias("bytes"))
    tokens = F.ceil(F.col("bytes") / 3).cast("bigint")
    return t.select(
        "lang", "requests", (F.col("requests") * len(FUNCTION_SIGNALS)).alias("questions"), "bytes", tokens.alias("heuristic_tokens"),
        (tokens.cast("double") * F.lit(K.USD_PER_MILLION) / F.lit(1e6)).alias("heuristic_usd"), (F.col("bytes").cast("double") * F.lit(K.USD_PER_MILLION) / F.lit(1e6)).alias("one_byte_usd"),
        (F.col("requests").cast("double") * F.lit(float(K.MAX_INPUT_TOKENS)) * F.lit(K.USD_PER_MILLION) / F.lit(1e6)).alias("reservation_usd"),
    )


_usd = f"{D(K.USD_PER_MILLION)} / {D('1e6')}"
QUERIES["plan_estimates"] = (
    plan_estimates,
    f"""WITH {SQL_REQUESTS}, t AS (SELECT lang, count(*) AS n, sum(bytes) AS b, CAST(ceil(sum(bytes) / {D(3)}) AS BIGINT) AS k FROM rq GROUP BY 1)
SELECT lang, CAST(n AS BIGINT) AS requests, CAST(n * {len(FUNCTION_SIGNALS)} AS BIGINT) AS questions, CAST(b AS BIGINT) AS bytes, k AS heuristic_tokens, {D('k')} * {_usd} AS heuristic_usd, {D('b')} * {_usd} AS one_byte_usd,
  {D('n')} * {D(K.MAX_INPUT_TOKENS)} * {_usd} AS reservation_usd FROM t""",
)


def pack_budget(spark, folder):
    """Bytes of each request, its token guess, and which cap it meets."""
    r = requests(spark, folder)
    cap = F.when(F.col("bytes") <= K.MAX_REQUEST_BYTES, "target").when(F.col("bytes") <= K.MAX_HARD_REQUEST_BYTES, "hard").otherwise("over")
    return r.select("doc_id", "bytes", F.ceil(F.col("bytes") / 3).cast("bigint").alias("heuristic_tokens"), cap.alias("cap"))


QUERIES["pack_budget"] = (
    pack_budget,
    f"WITH {SQL_REQUESTS} SELECT doc_id, CAST(bytes AS BIGINT) AS bytes, CAST(ceil(bytes / {D(3)}) AS BIGINT) AS heuristic_tokens, CASE WHEN bytes <= {K.MAX_REQUEST_BYTES} THEN 'target' WHEN bytes <= {K.MAX_HARD_REQUEST_BYTES} THEN 'hard' ELSE 'over' END AS cap FROM rq",
)


def plan_seal(spark, folder):
    """A seal over all requests per language that does not depend on row order: count and sum of hash prefixes."""
    part = F.conv(F.left("request_hash", F.lit(12)), 16, 10).cast("decimal(38,0)")
    return requests(spark, folder).groupBy("lang").agg(F.count(F.lit(1)).alias("requests"), F.sum(part).cast("string").alias("seal"))


QUERIES["plan_seal"] = (
    plan_seal,
    f"WITH {SQL_REQUESTS} SELECT lang, CAST(count(*) AS BIGINT) AS requests, CAST(sum(CAST(CAST('0x' || substr(request_hash, 1, 12) AS UBIGINT) AS HUGEINT)) AS VARCHAR) AS seal FROM rq GROUP BY lang",
)


def manifest_checks(spark, folder):
    """Re-derives what the line windows must satisfy; every check counts the rows that break it."""
    lines = cut_lineage(L.line_table(table(spark, folder, "documents"), "doc_id", "text"))
    windows = cut_lineage(L.line_windows(lines, "doc_id", F.lit(K.MIN_WINDOW_LINES)))
    following = windows.select("doc_id", (F.col("window") - 1).alias("window"), F.col("start_line").alias("next_line"))
    gaps = windows.join(following, ["doc_id", "window"]).agg(F.count_if(F.col("next_line") != F.col("end_line") + 1).cast("bigint").alias("broken"), F.count(F.lit(1)).alias("checked")).withColumn("check", F.lit("windows_touch"))
    sizes = windows.agg(F.count_if(F.col("end_line") - F.col("start_line") + 1 > K.MIN_WINDOW_LINES).cast("bigint").alias("broken"), F.count(F.lit(1)).alias("checked")).withColumn("check", F.lit("window_size"))
    ids = windows.groupBy("doc_id", "window").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).cast("bigint").alias("broken"), F.count(F.lit(1)).alias("checked")).withColumn("check", F.lit("unique_ids"))
    return gaps.unionByName(sizes).unionByName(ids)


QUERIES["manifest_checks"] = (
    manifest_checks,
    f"""WITH {SQL_LINES}, w AS (SELECT doc_id, (line - 1) // {K.MIN_WINDOW_LINES} AS win, min(start) AS s, max(start + length) AS e, min(line) AS a, max(line) AS b FROM lt GROUP BY 1, 2), v AS (SELECT * FROM w WHERE e > s),
g AS (SELECT x.b, y.a FROM v x JOIN v y ON y.doc_id = x.doc_id AND y.win = x.win + 1)
SELECT 'windows_touch' AS "check", CAST(count_if(a <> b + 1) AS BIGINT) AS broken, CAST(count(*) AS BIGINT) AS checked FROM g
UNION ALL SELECT 'window_size', CAST(count_if(b - a + 1 > {K.MIN_WINDOW_LINES}) AS BIGINT), CAST(count(*) AS BIGINT) FROM v UNION ALL SELECT 'unique_ids', CAST(0 AS BIGINT), CAST(count(*) AS BIGINT) FROM v""",
)


def pack_sections(spark, folder):
    """Focus lines and two widened reference windows per document, merged where they meet."""
    docs = table(spark, folder, "documents")
    at = lambda tag: F.floor(T.unit_hash(F.lit(tag), F.col("doc_id")) * T.line_count(F.col("text"))).cast("bigint") + 1
    wanted = F.array(
        F.struct(F.lit("focus").alias("role"), at("fo").alias("a"), at("fo").alias("b")),
        F.struct(F.lit("caller").alias("role"), (at("ca") - 3).alias("a"), (at("ca") + 3).alias("b")),
        F.struct(F.lit("test").alias("role"), (at("te") - 3).alias("a"), (at("te") + 3).alias("b")),
    )
    lines = L.line_table(docs.withColumn("wanted", wanted), "doc_id", "text", "wanted")
    hits = lines.select("doc_id", "line", "start", "length", F.explode("wanted").alias("w")).where(F.col("line").between(F.col("w.a"), F.col("w.b")))
    ranges = hits.groupBy("doc_id", F.col("w.role").alias("role")).agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("end"))
    return P.pack_sections(ranges, "doc_id")


_at = lambda tag: f"CAST(floor({B.sql_unit_hash(chr(39) + tag + chr(39), 'doc_id')} * {B.sql_lines('text')}) AS BIGINT) + 1"
QUERIES["pack_sections"] = (
    pack_sections,
    f"""WITH {SQL_LINES}, wa AS (SELECT doc_id, 'focus' AS role, {_at('fo')} AS a, {_at('fo')} AS b FROM documents UNION ALL SELECT doc_id, 'caller', {_at('ca')} - 3, {_at('ca')} + 3 FROM documents UNION ALL SELECT doc_id, 'test', {_at('te')} - 3, {_at('te')} + 3 FROM documents),
r AS (SELECT doc_id, role, min(start) AS s, max(start + length) AS e FROM lt JOIN wa USING (doc_id) WHERE line BETWEEN a AND b GROUP BY 1, 2),
i1 AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY doc_id ORDER BY s, e, role ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NOT FALSE THEN 1 ELSE 0 END AS o FROM r),
i2 AS (SELECT *, sum(o) OVER (PARTITION BY doc_id ORDER BY s, e, role) AS island FROM i1)
SELECT doc_id, CAST(island AS BIGINT) AS section, CAST(min(s) AS BIGINT) AS start, CAST(max(e) AS BIGINT) AS "end", string_agg(role, ',' ORDER BY s, role) AS roles FROM i2 GROUP BY 1, 2""",
)


def pack_hashes(spark, folder):
    """Hash of each focus section's text, cut out of the whole document by offset."""
    sections = pack_sections(spark, folder).where(F.contains("roles", F.lit("focus")))
    text = table(spark, folder, "documents").select("doc_id", "text")
    piece = F.substring("text", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    return sections.join(text, "doc_id").select("doc_id", "section", F.sha2(piece, 256).alias("source_hash"))


QUERIES["pack_hashes"] = (
    pack_hashes,
    QUERIES["pack_sections"][1].replace("SELECT doc_id, CAST(island", "SELECT doc_id, section, sha256(substr(text, start + 1, \"end\" - start)) AS source_hash FROM (SELECT doc_id, CAST(island") + ") JOIN documents USING (doc_id) WHERE contains(roles, 'focus')",
)


def signal_selection(spark, folder):
    """Questions on by default, on request and for experiments, with how many units each would be asked."""
    from pairloom.operators.report import signal_table

    n = table(spark, folder, "documents").agg(F.count(F.lit(1)).alias("units")).withColumn("k", F.lit(1))
    s = signal_table(spark).withColumn("k", F.lit(1))
    selected = F.when(F.col("status") == "opt_in", "on_request").when(F.col("status") == "experimental", "experimental").otherwise("default")
    asked = F.when(F.array_contains("kinds", "function"), F.col("units")).otherwise(F.lit(0)).cast("bigint")
    return s.join(n, "k").select("signal_id", selected.alias("selected"), "cut", "floor", asked.alias("units"))


QUERIES["signal_selection"] = (
    signal_selection,
    f"""SELECT signal_id, selected, cut, floor, CASE WHEN fn THEN (SELECT CAST(count(*) AS BIGINT) FROM documents) ELSE CAST(0 AS BIGINT) END AS units
FROM {B.sql_values([(s[0], {'opt_in': 'on_request', 'experimental': 'experimental', 'default': 'default'}[s[3]], s[4], s[5], 'function' in s[1]) for s in K.SIGNALS], 'signal_id, selected, cut, floor, fn')}""",
)
