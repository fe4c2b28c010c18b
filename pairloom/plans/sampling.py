"""Samples, matching, resolution and dataset construction on the data folder's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom import constants as K
from pairloom.functions import text as T
from pairloom.operators import resolution as R
from pairloom.operators import sampling as G
from pairloom.operators import similarity as S
from pairloom.operators.matching import exclusive_nearest
from pairloom.operators.rewording import reworded
from pairloom.plans import bindings as B
from pairloom.plans.statistics import D
from pairloom.plans.texts import SQL_NAMED, named_pages
from pairloom.session import cut_lineage
from pairloom.sources.tables import table

QUERIES: dict = {}
SEED = str(K.BOOTSTRAP_SEED)


def seeded_hash_sample(spark, folder):
    """One hundred succeeded requests to repeat, by seeded hash."""
    rows = table(spark, folder, "events").where(F.col("event_type") == "purchase").select("event_id", "user_id")
    return G.hash_sample(rows, "event_id", SEED, 100)


QUERIES["seeded_hash_sample"] = (seeded_hash_sample, f"SELECT event_id, user_id FROM events WHERE event_type = 'purchase' ORDER BY sha256('{SEED}|' || event_id), event_id LIMIT 100")


def seeded_shuffle(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "lang")
    return G.hash_shuffle(rows, ["lang"], "doc_id", SEED)


QUERIES["seeded_shuffle"] = (
    seeded_shuffle,
    f"SELECT doc_id, lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY sha256('{SEED}|' || doc_id), doc_id) AS BIGINT) AS place FROM documents",
)


def stratified_sample(spark, folder):
    """25 documents per language and length band, at most three per source, no near copies."""
    lines = T.line_count(F.col("text"))
    band = F.lit(None).cast("int")
    for i, (low, high) in enumerate(K.STRATA):
        band = F.when(lines.between(low, high), F.lit(i)).otherwise(band)
    file = F.concat("source", F.lit("/"), F.floor(F.col("doc_id") / 7).cast("string"))
    items = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("repo"), band.alias("stratum"), file.alias("file"), F.sha2("text", 256).alias("content"), lines.alias("lines"), B.content_key(T.word_tokens(F.col("text"))).alias("key"))
    # Every member of a class stands for it: texts of the same tokens may differ in case or signs.
    classed = items.join(B.class_ids(spark, folder).withColumnRenamed("cid", "class"), ["key", "lines"]).where(F.col("stratum").isNotNull()).drop("key", "lines")
    sets = B.classes(spark, folder).where(B.shingled()).select("cid", "copies", F.lit(1).alias("lines"), "items")
    pairs = cut_lineage(S.bounded_pairs(sets.drop("copies"), K.STRATUM_NEAR, 1.1).select("a", "b"))
    same = sets.where(F.col("copies") > 1).select(F.col("cid").alias("a"), F.col("cid").alias("b"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(same)
    return G.stratified_sample(cut_lineage(classed), both, SEED).withColumn("stratum", F.col("stratum").cast("bigint"))


# Sequential refusals have no short SQL; tests compare this query with a plain loop.
QUERIES["stratified_sample"] = (stratified_sample, None)


def nearest_controls(spark, folder):
    """Every labelled positive with a control of like length of its source, no control twice."""
    docs = table(spark, folder, "documents").select("doc_id", "source", T.line_count(F.col("text")).alias("lines"), "n_chars")
    rows = cut_lineage(docs.join(table(spark, folder, "labels").select("doc_id", "quality"), "doc_id").distinct())
    rows = rows.select(F.col("doc_id").alias("id"), "source", F.col("lines").alias("first"), F.col("n_chars").alias("second"), "quality")
    reach = F.greatest(F.lit(2), F.floor(F.col("first") * F.lit(0.1) + F.lit(0.5))).cast("bigint")
    positives = rows.where(F.col("quality") == 0).withColumn("reach", reach).withColumn("priority", F.col("id"))
    return exclusive_nearest(positives, rows.where(F.col("quality") == 1), "source")


QUERIES["nearest_controls"] = (
    nearest_controls,
    f"""WITH RECURSIVE r AS (SELECT d.doc_id, source, {B.sql_lines('text')} AS lines, n_chars, quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
e AS (SELECT p.doc_id AS positive, c.doc_id AS control, {D('abs(c.lines - p.lines)')} / greatest(p.lines, 8) * 4 + {D('abs(c.n_chars - p.n_chars)')} / greatest(p.n_chars, 50) AS cost
  FROM r p JOIN r c ON p.source = c.source AND p.quality = 0 AND c.quality = 1 AND abs(c.lines - p.lines) <= greatest(2, CAST(floor(p.lines * {D(0.1)} + {D(0.5)}) AS BIGINT))),
o AS (SELECT positive, row_number() OVER (ORDER BY positive) AS rn FROM (SELECT DISTINCT positive FROM e)),
f(rn, positive, control, taken) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
  SELECT o.rn, o.positive, x.c, CASE WHEN x.c IS NULL THEN f.taken ELSE list_append(f.taken, x.c) END FROM f JOIN o ON o.rn = f.rn + 1,
  LATERAL (SELECT arg_min(control, (cost, control)) AS c FROM e WHERE e.positive = o.positive AND NOT list_contains(f.taken, e.control)) x)
SELECT f.positive, f.control, e.cost FROM f JOIN e ON e.positive = f.positive AND e.control = f.control""",
)


def donor_rename(spark, folder):
    """Each page title swapped for one that shares no word, and whether the cue then fires."""
    pages = cut_lineage(named_pages(spark, folder).where(F.size("words") > 0).withColumnRenamed("page_id", "id"))
    placed = cut_lineage(G.hash_shuffle(pages.select("id", "words").withColumn("g", F.lit(0)), ["g"], "id", SEED).drop("g"))
    donors = cut_lineage(G.donor_names(placed.select("id", "place", "words")))
    renamed = donors.join(pages.select(F.col("id").alias("donor"), F.col("words").alias("_w")), "donor").join(pages.select("id", "body_words"), "id")
    return renamed.select("id", "donor", "offset", T.name_cue_absent(F.col("_w"), F.col("body_words")).alias("absent"))


QUERIES["donor_rename"] = (
    donor_rename,
    f"""WITH {SQL_NAMED}, p AS (SELECT page_id AS id, words, body_words, row_number() OVER (ORDER BY sha256('{SEED}|' || page_id), page_id) AS place, count(*) OVER () AS n FROM np WHERE len(words) > 0),
c AS (SELECT x.id, y.id AS donor, (y.place - x.place + x.n) % x.n AS gap, NOT list_has_any(y.words, x.body_words) AS absent FROM p x JOIN p y ON x.id <> y.id AND NOT list_has_any(x.words, y.words))
SELECT id, arg_min(donor, gap) AS donor, CAST(min(gap) AS BIGINT) AS "offset", arg_min(absent, gap) AS absent FROM c GROUP BY id""",
)


def chimera_units(spark, folder):
    """Two unrelated documents of one source joined end to end: neighbours in a seeded order, ids from a hash."""
    rows = G.hash_shuffle(table(spark, folder, "documents").select("doc_id", "source", "text"), ["source"], "doc_id", SEED)
    half = rows.withColumn("pair", F.floor((F.col("place") - 1) / 2).cast("bigint"))
    first = half.where(F.col("place") % 2 == 1).select("source", "pair", F.col("doc_id").alias("a"), F.col("text").alias("_a"))
    second = half.where(F.col("place") % 2 == 0).select("source", "pair", F.col("doc_id").alias("b"), F.col("text").alias("_b"))
    body = F.concat("_a", F.lit("\n"), "_b")
    joined = first.join(second, ["source", "pair"])
    return joined.select("a", "b", T.line_count(body).alias("lines"), F.left(F.sha2(F.concat_ws("|", F.lit(SEED), F.lit("A"), F.col("a").cast("string"), F.col("b").cast("string")), 256), F.lit(8)).alias("unit_id"), F.sha2(body, 256).alias("text_hash"))


QUERIES["chimera_units"] = (
    chimera_units,
    f"""WITH o AS (SELECT doc_id, source, text, row_number() OVER (PARTITION BY source ORDER BY sha256('{SEED}|' || doc_id), doc_id) - 1 AS place FROM documents)
SELECT x.doc_id AS a, y.doc_id AS b, {B.sql_lines("(x.text || chr(10) || y.text)")} AS lines, substr(sha256('{SEED}|A|' || x.doc_id || '|' || y.doc_id), 1, 8) AS unit_id, sha256(x.text || chr(10) || y.text) AS text_hash
FROM o x JOIN o y ON x.source = y.source AND x.place // 2 = y.place // 2 AND x.place % 2 = 0 AND y.place % 2 = 1""",
)


def assembled_units(spark, folder):
    """Evaluation units with stable ids, ordered by set, label (positives first) and place."""
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    rows = docs.join(table(spark, folder, "labels").select("doc_id", "quality"), "doc_id")
    from pairloom.operators.ordered import ranked

    placed = ranked(rows, [], ["lang", F.col("quality").desc(), "doc_id"], name="position")
    return placed.select("doc_id", "lang", "quality", "position", F.left(F.sha2(F.concat_ws("|", F.lit(SEED), "lang", F.col("doc_id").cast("string")), 256), F.lit(8)).alias("unit_id"))


QUERIES["assembled_units"] = (
    assembled_units,
    f"""SELECT d.doc_id, lang, quality, CAST(row_number() OVER (ORDER BY lang, quality DESC, d.doc_id) AS BIGINT) AS position, substr(sha256('{SEED}|' || lang || '|' || d.doc_id), 1, 8) AS unit_id FROM documents d JOIN labels l ON l.doc_id = d.doc_id""",
)

STEPS = (0.1, 0.2, 0.4, 0.6)


def rewrite_chain(spark, folder):
    """Documents reworded in growing steps until few shingles are left, and the step that got there.

    A step renames the words whose hash falls under its share; the stop level is drawn per document.
    """
    docs = B.units(spark, folder).select("id", "tokens").where(F.size("tokens") >= 20)
    stop = T.unit_hash(F.lit("stop"), F.col("id")) * 0.4 + 0.2
    rows = docs.select("id", stop.alias("stop"), "tokens")
    return reworded(rows, STEPS)


QUERIES["rewrite_chain"] = (
    rewrite_chain,
    f"""WITH {B.SQL_UNITS}, d AS (SELECT id, tokens, {B.sql_unit_hash("'stop'", 'id')} * {D(0.4)} + {D(0.2)} AS stop FROM units WHERE len(tokens) >= 20),
r AS (SELECT id, s, list_transform(tokens, lambda w: CASE WHEN CAST(CAST('0x' || substr(md5(w), 1, 4) AS UBIGINT) AS DOUBLE) / {D(65536)} < s THEN 'id' ELSE w END) AS ch FROM d, (SELECT unnest([{', '.join(D(s) for s in STEPS)}]) AS s)),
x AS (SELECT DISTINCT id, g FROM {B.sql_gram_rows('d', 'id', 'tokens', 5)}), y AS (SELECT DISTINCT id, s, g FROM {B.sql_gram_rows('r', 'id, s', 'ch', 5)}),
nx AS (SELECT id, count(*) AS n FROM x GROUP BY 1), ny AS (SELECT id, s, count(*) AS n FROM y GROUP BY 1, 2), c AS (SELECT y.id, s, count(*) AS n FROM x JOIN y ON x.id = y.id AND x.g = y.g GROUP BY 1, 2),
j AS (SELECT ny.id, ny.s, stop, coalesce(c.n, 0) / CAST(greatest(nx.n + ny.n - coalesce(c.n, 0), 1) AS DOUBLE) AS j FROM ny JOIN nx ON nx.id = ny.id JOIN d ON d.id = ny.id LEFT JOIN c ON c.id = ny.id AND c.s = ny.s),
o AS (SELECT id, min(s) AS step, arg_min(j, s) AS jaccard FROM j WHERE j <= stop GROUP BY id)
SELECT d.id, step, jaccard FROM d LEFT JOIN o ON o.id = d.id""",
)


# --- resolution -------------------------------------------------------------------------------------

def module_resolution(spark, folder):
    """Imports by alias or plain path against the files of the corpus."""
    d = table(spark, folder, "documents")
    endings = F.array(F.lit(".ts"), F.lit(".tsx"), F.lit("/index.ts"), F.lit(".md"))
    pick = F.floor(T.unit_hash(F.lit("e"), F.col("doc_id")) * 4).cast("int")
    files = d.select(F.concat("source", F.lit("/m"), (F.col("doc_id") % 40).cast("string"), F.get(endings, pick)).alias("path"))
    number = (F.floor(T.unit_hash(F.lit("i"), F.col("doc_id")) * 45)).cast("bigint").cast("string")
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("@app/m"), number)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("@app/ui/m"), number)).otherwise(F.concat("source", F.lit("/m"), number))
    imports = d.select(F.col("doc_id").alias("import_id"), R.apply_alias(raw, {"@app/": "src1/", "@app/ui/": "src2/"}).alias("specifier"))
    return R.resolve_modules(imports, files)


_end = f"(['.ts', '.tsx', '/index.ts', '.md'])[CAST(floor({B.sql_unit_hash(chr(39) + 'e' + chr(39), 'doc_id')} * 4) AS BIGINT) + 1]"
_num = f"CAST(floor({B.sql_unit_hash(chr(39) + 'i' + chr(39), 'doc_id')} * 45) AS BIGINT)"
QUERIES["module_resolution"] = (
    module_resolution,
    f"""WITH fi AS (SELECT DISTINCT source || '/m' || (doc_id % 40) || {_end} AS path FROM documents),
im AS (SELECT doc_id AS import_id, CASE doc_id % 3 WHEN 0 THEN 'src1/m' || {_num} WHEN 1 THEN 'src2/m' || {_num} ELSE source || '/m' || {_num} END AS specifier FROM documents),
h AS (SELECT import_id, count(*) AS hits, min(path) AS path FROM im JOIN fi ON path IN (specifier || '', specifier || '.ts', specifier || '.tsx', specifier || '/index.ts') GROUP BY 1)
SELECT im.import_id, specifier, CASE WHEN hits = 1 THEN path END AS path, CASE WHEN hits IS NULL THEN 'missing' WHEN hits > 1 THEN 'ambiguous' ELSE 'resolved' END AS reason FROM im LEFT JOIN h ON h.import_id = im.import_id""",
)


def one_hop_resolution(spark, folder):
    """Orders refer to customers: a local declaration, else one hop to the customer's nation."""
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("ref_id"), F.col("o_orderstatus").alias("module"), F.col("o_custkey").cast("string").alias("name"))
    c = table(spark, folder, "customer")
    own = c.where(F.col("c_mktsegment") == "BUILDING").select(F.explode(F.array(F.lit("O"), F.lit("F"), F.lit("P"))).alias("module"), F.col("c_custkey").cast("string").alias("name"), F.col("c_name").alias("target"), (F.col("c_acctbal") > 0).alias("stable"))
    imports = c.where(F.col("c_mktsegment") != "MACHINERY").select(F.explode(F.array(F.lit("O"), F.lit("F"), F.lit("P"))).alias("module"), F.col("c_custkey").cast("string").alias("name"), F.lit("nations").alias("source"), F.col("c_nationkey").cast("string").alias("imported"))
    n = table(spark, folder, "nation")
    exports = n.where(F.col("n_nationkey") % 7 != 0).select(F.lit("nations").alias("module"), F.col("n_nationkey").cast("string").alias("name"), F.col("n_name").alias("target"), (F.col("n_regionkey") == 0).alias("reexport"))
    return R.resolve_symbols(orders, own, imports, exports)


QUERIES["one_hop_resolution"] = (
    one_hop_resolution,
    """WITH j AS (SELECT o_orderkey AS ref_id, o_orderstatus AS module, CAST(o_custkey AS VARCHAR) AS name, c_name, c_mktsegment AS sg, c_acctbal > 0 AS stable, CASE WHEN n_nationkey % 7 <> 0 THEN n_name END AS n_name, n_regionkey = 0 AS re,
  c_custkey IS NULL AS lost, o_orderstatus IN ('O', 'F', 'P') AS known FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey),
r AS (SELECT *, CASE WHEN lost OR NOT known THEN 'unbound' WHEN sg = 'BUILDING' AND stable THEN 'local' WHEN sg = 'BUILDING' THEN 'unstable_binding' WHEN sg = 'MACHINERY' THEN 'unbound' WHEN n_name IS NULL THEN 'not_exported' WHEN re THEN 'reexport_not_followed' ELSE 'import' END AS reason FROM j)
SELECT ref_id, module, name, CASE reason WHEN 'local' THEN c_name WHEN 'import' THEN n_name END AS target, reason FROM r""",
)


def incoming_edges(spark, folder):
    """Calls and distinct callers per part: lines call parts, suppliers are the callers."""
    calls = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("target"), F.col("l_suppkey").alias("caller"))
    return R.incoming_edges(calls)


QUERIES["incoming_edges"] = (incoming_edges, "SELECT l_partkey AS target, CAST(count(*) AS BIGINT) AS calls, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS callers FROM lineitem GROUP BY 1")


def binding_stability(spark, folder):
    """Names bound once, never written and constant: users and their event types."""
    b = table(spark, folder, "events").select(F.col("user_id").alias("module"), F.get_json_object("props", "$.k").alias("name"), (F.col("event_type") == "error").alias("mutated"), (F.col("value") < 100).alias("constant"))
    return R.stable_bindings(b)


QUERIES["binding_stability"] = (
    binding_stability,
    """SELECT user_id AS module, json_extract_string(props, '$.k') AS name, CAST(count(*) AS BIGINT) AS bindings, bool_or(event_type = 'error') AS mutated, bool_and(value < 100) AS constant,
  count(*) = 1 AND NOT bool_or(event_type = 'error') AND bool_and(value < 100) AS stable FROM events GROUP BY 1, 2""",
)


def link_routes(spark, folder):
    """Links of all pages against the pages' own paths: resolved, ambiguous, external or without a route."""
    pages = table(spark, folder, "pages")
    path = F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1)
    routes = pages.select(F.regexp_extract(path, r"^(/[^/]*)", 1).alias("url"), F.lit("GET").alias("method"), F.col("page_id").alias("target"))
    uses = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1)).alias("position", "url")).withColumn("method", F.when(F.col("position") % 5 == 4, "TRACE").otherwise("GET"))
    return R.route_join(uses, routes).groupBy("reason", "method").agg(F.count(F.lit(1)).alias("uses"), F.count("target").alias("resolved"))


QUERIES["link_routes"] = (
    link_routes,
    r"""WITH rt AS (SELECT regexp_extract(regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1), '^(/[^/]*)', 1) AS url, count(DISTINCT page_id) AS n FROM pages GROUP BY 1),
x AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages), u AS (SELECT page_id, unnest(l) AS url, unnest(range(0, len(l))) AS position FROM x),
m AS (SELECT url, CASE WHEN position % 5 = 4 THEN 'TRACE' ELSE 'GET' END AS method FROM u),
r AS (SELECT method, CASE WHEN NOT starts_with(m.url, '/') THEN 'external_url' WHEN method = 'TRACE' THEN 'unknown_method' WHEN n IS NULL THEN 'no_route' WHEN n > 1 THEN 'ambiguous_route' ELSE 'resolved' END AS reason FROM m LEFT JOIN rt ON rt.url = m.url)
SELECT reason, method, CAST(count(*) AS BIGINT) AS uses, CAST(count_if(reason = 'resolved') AS BIGINT) AS resolved FROM r GROUP BY 1, 2""",
)


def outside_roots(spark, folder):
    """Files below none of the static roots."""
    d = table(spark, folder, "documents")
    files = d.select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"))
    roots = d.where(F.col("doc_id") % 5 == 0).select(F.concat_ws("/", "source", "lang").alias("root")).distinct()
    return R.outside_roots(files, roots)


QUERIES["outside_roots"] = (
    outside_roots,
    "WITH r AS (SELECT DISTINCT source || '/' || lang AS root FROM documents WHERE doc_id % 5 = 0) SELECT source || '/' || lang || '/' || doc_id AS path FROM documents WHERE source || '/' || lang NOT IN (SELECT root FROM r)",
)


def constant_chains(spark, folder):
    """Documents alias others by hash, some of them ids that aren't there; follow the aliases to a literal."""
    d = cut_lineage(table(spark, folder, "documents").select("doc_id", "source"))
    last = d.agg(F.max("doc_id")).first()[0] or 0
    literal = F.when(T.unit_hash(F.lit("lit"), F.col("doc_id")) < 0.15, F.col("source"))
    # One in fifty aliases leads past the last id.
    alias = F.floor(T.unit_hash(F.lit("al"), F.col("doc_id")) * ((last + 1) * 1.02)).cast("bigint").cast("string")
    return R.constant_strings(d.select(F.col("doc_id").cast("string").alias("name"), literal.alias("literal"), alias.alias("alias")))


QUERIES["constant_chains"] = (
    constant_chains,
    f"""WITH RECURSIVE m AS (SELECT CAST(max(doc_id) + 1 AS DOUBLE) * {D(1.02)} AS k FROM documents),
c AS (SELECT CAST(doc_id AS VARCHAR) AS name, CASE WHEN {B.sql_unit_hash("'lit'", 'doc_id')} < {D(0.15)} THEN source END AS literal, CAST(CAST(floor({B.sql_unit_hash("'al'", 'doc_id')} * k) AS BIGINT) AS VARCHAR) AS al FROM documents, m),
w(name, cur, literal, nxt, hops, seen) AS (SELECT name, name, literal, CASE WHEN literal IS NULL THEN al END, CAST(0 AS BIGINT), [name] FROM c UNION ALL
  SELECT w.name, w.nxt, c.literal, CASE WHEN c.name IS NOT NULL AND c.literal IS NULL THEN c.al END, w.hops + 1, list_append(seen, w.nxt) FROM w LEFT JOIN c ON c.name = w.nxt WHERE w.nxt IS NOT NULL AND NOT list_contains(seen[:-2], w.cur)),
e AS (SELECT name, cur, literal, nxt, hops, list_contains(seen[:-2], cur) AS loop, row_number() OVER (PARTITION BY name ORDER BY hops DESC) AS k FROM w)
SELECT name, CASE WHEN NOT loop AND hops <= 8 THEN literal END AS value, CASE WHEN NOT loop THEN hops END AS hops,
  CASE WHEN loop THEN 'cycle' WHEN literal IS NULL THEN 'unresolved' WHEN hops > 8 THEN 'depth_limit' ELSE 'resolved' END AS state FROM e WHERE k = 1""",
)
