"""Path and file checks, name cues, lines and windows, interval merging, and text audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom import constants as K
from pairloom.functions import measures as M
from pairloom.functions import text as T
from pairloom.operators import lines as L
from pairloom.operators import similarity as S
from pairloom.operators.admission import admit_in_order
from pairloom.operators.ordered import merge_intervals
from pairloom.plans import bindings as B
from pairloom.plans.statistics import D
from pairloom.session import cut_lineage
from pairloom.sources.tables import table

QUERIES: dict = {}


def sql_str(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- content checks ---------------------------------------------------------------------------------

def secret_hits(spark, folder):
    """Documents with text shaped like a credential and the patterns that matched."""
    rows = table(spark, folder, "documents").select("doc_id", T.secret_kinds(F.col("text")).alias("kinds"))
    return rows.where(F.size("kinds") > 0).select("doc_id", F.array_join("kinds", ",").alias("kinds"))


_PLACEHOLDER = r"""(?i)\b[a-z][a-z0-9+.-]{1,20}://[^\s:/@'"`${}<>]+:(?:pass|password|secret|changeme)@[^\s'"`/]+"""
_ANYURL = r"""(?i)\b[a-z][a-z0-9+.-]{1,20}://[^\s:/@'"`${}<>]+:[^\s:/@'"`${}<>]{3,}@[^\s'"`/]+"""
_hits = ", ".join(f"CASE WHEN regexp_matches(text, {sql_str(p)}) THEN '{i}' END" for i, p in enumerate(K.SECRET_PATTERNS[:6], 1))
QUERIES["secret_hits"] = (
    secret_hits,
    f"""WITH h AS (SELECT doc_id, array_to_string(list_filter([{_hits}, CASE WHEN regexp_matches(regexp_replace(text, {sql_str(_PLACEHOLDER)}, ' ', 'g'), {sql_str(_ANYURL)}) THEN '7' END],
  lambda x: x IS NOT NULL), ',') AS kinds FROM documents) SELECT * FROM h WHERE kinds <> ''""",
)


def generated_hits(spark, folder):
    """Per source: texts whose opening comment says they are generated, and texts with a licence line anywhere."""
    rows = table(spark, folder, "documents").select("source", T.is_generated(F.col("text")).alias("g"), F.rlike("text", F.lit(r"(?i)(?:^|\n)\s*(?:copyright|licen[cs]e|licensed)")).alias("l"))
    return rows.groupBy("source").agg(F.count_if("g").cast("bigint").alias("generated"), F.count_if("l").cast("bigint").alias("with_licence_line"))


QUERIES["generated_hits"] = (
    generated_hits,
    r"""SELECT source, CAST(count_if(regexp_matches(substr(text, 1, 4096), '(?i)(?:^|\n)\s*(?://|/\*|\*)[^\n]*(?:@generated|auto.generated|do not edit)')) AS BIGINT) AS generated,
  CAST(count_if(regexp_matches(text, '(?i)(?:^|\n)\s*(?:copyright|licen[cs]e|licensed)')) AS BIGINT) AS with_licence_line FROM documents GROUP BY source""",
)


def utf8_checks(spark, folder):
    """Per language: texts that are no valid UTF-8 or hold a NUL, with characters and bytes."""
    rows = table(spark, folder, "documents")
    return rows.groupBy("lang").agg(
        F.count_if(~F.is_valid_utf8("text") | F.contains("text", F.lit("\0"))).cast("bigint").alias("binary_or_invalid"),
        F.sum(F.length("text")).cast("bigint").alias("characters"), F.sum(F.octet_length("text")).cast("bigint").alias("bytes"),
    )


QUERIES["utf8_checks"] = (
    utf8_checks,
    """SELECT lang, CAST(count_if(contains(text, chr(0))) AS BIGINT) AS binary_or_invalid, CAST(sum(length(text)) AS BIGINT) AS characters, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents GROUP BY lang""",
)


# --- paths ------------------------------------------------------------------------------------------

FOLDERS = ("app", "lib/util", "tests/unit", "node_modules/x", "src/.cache", "dist", "a/../b", "pkg/core/deep/er", "secret", "vendor/z")
ENDINGS = (".ts", ".tsx", ".d.ts", ".test.ts", ".md", ".min.js", ".mjs", "")
EXCLUDED = ["src1", "src2/app"]
SCOPE = ["src3", "src4/app", "src5/lib", "src6", "src7", "src8", "src9"]


def paths(spark, folder):
    """A path per document, its folder and ending picked by hash, with size in bytes."""
    pick = lambda values, tag: F.get(F.array(*[F.lit(v) for v in values]), F.floor(T.unit_hash(F.lit(tag), F.col("doc_id")) * len(values)).cast("int"))
    return table(spark, folder, "documents").select(
        "doc_id", F.concat("source", F.lit("/"), pick(FOLDERS, "dir"), F.lit("/f"), F.col("doc_id").cast("string"), pick(ENDINGS, "ext")).alias("path"),
        F.octet_length("text").cast("bigint").alias("bytes"),
    )


def _sql_pick(values, tag):
    return f"(['{chr(39).join([]) + (chr(39) + ', ' + chr(39)).join(values)}'])[CAST(floor({B.sql_unit_hash(chr(39) + tag + chr(39), 'doc_id')} * {len(values)}) AS BIGINT) + 1]"


def _sql_under(prefixes):
    return "(" + " OR ".join(f"path = '{p}' OR starts_with(path, '{p}/')" for p in prefixes) + ")"


SQL_PATHS = rf"""pa AS (SELECT doc_id, source || '/' || {_sql_pick(FOLDERS, 'dir')} || '/f' || doc_id || {_sql_pick(ENDINGS, 'ext')} AS path, octet_length(encode(text)) AS bytes FROM documents),
ps AS (SELECT *, NOT regexp_matches(path, '(^|/)\.') AND NOT {_sql_under(EXCLUDED)} AND NOT regexp_matches(path, '(^|/)({'|'.join(K.EXCLUDED_DIRECTORIES)})(/|$)')
  AND NOT regexp_matches(path, '(?i)(secret|credential|\.min\.|\.generated\.)') AS admissible,
  regexp_matches(path, '\.([cm]?[jt]s|[jt]sx)$') AND NOT regexp_matches(path, '\.d\.[cm]?ts$') AS is_source,
  regexp_matches(path, '(^|/)(tests?|__tests__)(/|$)|\.(test|spec)\.[cm]?[jt]sx?$') AS is_test, {_sql_under(SCOPE)} AS in_scope FROM pa),
pst AS (SELECT *, CASE WHEN NOT is_source THEN 'non_source' WHEN NOT in_scope THEN 'outside_paths' WHEN NOT admissible THEN 'excluded_path' WHEN bytes > 4000 THEN 'file_or_byte_limit' ELSE 'read' END AS status FROM ps)"""


def path_status(spark, folder):
    """Exactly one status per entry."""
    p = F.col("path")
    rows = paths(spark, folder).select(
        "doc_id", "path", "bytes", T.is_admissible(p, EXCLUDED).alias("admissible"), T.is_source_path(p).alias("is_source"),
        T.is_test_path(p).alias("is_test"), T.under_any(p, SCOPE).alias("in_scope"),
    )
    status = (
        F.when(~F.col("is_source"), "non_source").when(~F.col("in_scope"), "outside_paths").when(~F.col("admissible"), "excluded_path")
        .when(F.col("bytes") > 4000, "file_or_byte_limit").otherwise("read")
    )
    return rows.withColumn("status", status)


QUERIES["path_status"] = (path_status, f"WITH {SQL_PATHS} SELECT doc_id, path, CAST(bytes AS BIGINT) AS bytes, admissible, is_source, is_test, in_scope, status FROM pst")


def coverage_totals(spark, folder):
    """Files in project, in scope, read and left unread by a cap, with the percentage line."""
    s = path_status(spark, folder)
    row = s.agg(
        F.count_if("is_source").cast("bigint").alias("in_project"), F.count_if(F.col("is_source") & F.col("in_scope")).cast("bigint").alias("in_scope"),
        F.count_if(F.col("status") == "read").cast("bigint").alias("read"), F.count_if(F.col("status") == "file_or_byte_limit").cast("bigint").alias("unread_by_cap"),
    )
    share = F.when(F.col("in_scope") > 0, M.percent(M.rate(F.col("read"), F.col("in_scope")))).otherwise(F.lit("100%"))
    return row.withColumn("line", F.concat(F.lit("Coverage: read "), F.col("read").cast("string"), F.lit(" of "), F.col("in_scope").cast("string"), F.lit(" source files in scope ("), share, F.lit(").")))


QUERIES["coverage_totals"] = (
    coverage_totals,
    f"""WITH {SQL_PATHS}, c AS (SELECT CAST(count_if(is_source) AS BIGINT) AS in_project, CAST(count_if(is_source AND in_scope) AS BIGINT) AS in_scope, CAST(count_if(status = 'read') AS BIGINT) AS read,
  CAST(count_if(status = 'file_or_byte_limit') AS BIGINT) AS unread_by_cap FROM pst)
SELECT *, 'Coverage: read ' || read || ' of ' || in_scope || ' source files in scope (' || CAST(CAST(floor({D('read')} / {D('in_scope')} * 100 + {D(0.5)}) AS BIGINT) AS VARCHAR) || '%).' AS line FROM c""",
)


def path_rollup(spark, folder):
    """Unread files per directory prefix, worst first."""
    s = path_status(spark, folder).where(F.col("status") == "file_or_byte_limit")
    return s.groupBy(T.directory_key(F.col("path"), 3).alias("directory")).agg(F.count(F.lit(1)).alias("files"))


QUERIES["path_rollup"] = (
    path_rollup,
    f"""WITH {SQL_PATHS}, d AS (SELECT string_split(path, '/') AS seg FROM pst WHERE status = 'file_or_byte_limit')
SELECT CASE WHEN len(seg) > 1 THEN array_to_string(seg[1:least(3, len(seg) - 1)], '/') ELSE '.' END AS directory, CAST(count(*) AS BIGINT) AS files FROM d GROUP BY 1""",
)


def skipped_files(spark, folder):
    """Files a reader should know were not read, with the reason in words."""
    words = F.create_map(F.lit("excluded_path"), F.lit("excluded by path or policy"), F.lit("file_or_byte_limit"), F.lit("over the file or size cap"))
    s = path_status(spark, folder).where(~F.col("status").isin("read", "non_source", "outside_paths"))
    return s.select(F.concat("path", F.lit("  ("), F.coalesce(words[F.col("status")], F.replace(F.col("status"), F.lit("_"), F.lit(" "))), F.lit(")")).alias("line"))


QUERIES["skipped_files"] = (
    skipped_files,
    f"""WITH {SQL_PATHS} SELECT path || '  (' || CASE status WHEN 'excluded_path' THEN 'excluded by path or policy' WHEN 'file_or_byte_limit' THEN 'over the file or size cap' END || ')' AS line
FROM pst WHERE status NOT IN ('read', 'non_source', 'outside_paths')""",
)

ADMIT_TOTAL, ADMIT_COUNT, ADMIT_EACH = K.MAX_TOTAL_BYTES, K.MAX_FILES, K.MAX_FILE_BYTES


def file_admission(spark, folder):
    """Admit files in path order under a total, a count and a per-file cap; skipped ones stay as rows."""
    return admit_in_order(paths(spark, folder).select("path", "bytes"), ["path"], "bytes", ADMIT_TOTAL, ADMIT_COUNT, ADMIT_EACH)


QUERIES["file_admission"] = (
    file_admission,
    f"""WITH RECURSIVE {SQL_PATHS}, o AS (SELECT path, CAST(bytes AS BIGINT) AS bytes, row_number() OVER (ORDER BY path) AS rn FROM pa),
fold(rn, used, n, admitted) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), FALSE UNION ALL
  SELECT o.rn, CASE WHEN n < {ADMIT_COUNT} AND bytes <= {ADMIT_EACH} AND used + bytes <= {ADMIT_TOTAL} THEN used + bytes ELSE used END,
    CASE WHEN n < {ADMIT_COUNT} AND bytes <= {ADMIT_EACH} AND used + bytes <= {ADMIT_TOTAL} THEN n + 1 ELSE n END, n < {ADMIT_COUNT} AND bytes <= {ADMIT_EACH} AND used + bytes <= {ADMIT_TOTAL}
  FROM fold JOIN o ON o.rn = fold.rn + 1)
SELECT path, bytes, admitted FROM o JOIN fold USING (rn)""",
)


# --- names ------------------------------------------------------------------------------------------

def named_pages(spark, folder):
    """Title as the name, the page text without its title as the body."""
    h = F.col("html")
    rows = table(spark, folder, "pages").select(
        "page_id", F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("name"),
        F.regexp_replace(F.regexp_replace(h, "<title>[^<]*</title>", " "), "<[^>]*>", " ").alias("body"),
    )
    return rows.select("page_id", "name", T.name_words(F.col("name")).alias("words"), F.array_distinct(T.split_words(F.col("body"))).alias("body_words"))


def _sql_words(expr: str) -> str:
    stop = ", ".join(f"'{w}'" for w in K.NAME_STOPWORDS)
    spaced = f"regexp_replace(regexp_replace({expr}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"
    return f"""list_filter(list_transform(list_filter(regexp_split_to_array(lower({spaced}), '[^a-z0-9]+'), lambda w: len(w) >= 3),
  lambda w: CASE WHEN len(w) > 4 AND ends_with(w, 'ies') THEN w[1:len(w) - 3] || 'y' WHEN len(w) > 3 AND ends_with(w, 's') THEN w[1:len(w) - 1] ELSE w END), lambda w: w NOT IN ({stop}))"""


SQL_NAMED = f"""np0 AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS name, regexp_replace(regexp_replace(html, '<title>[^<]*</title>', ' ', 'g'), '<[^>]*>', ' ', 'g') AS body FROM pages),
np AS (SELECT page_id, name, list_sort(list_distinct({_sql_words('name')})) AS words, list_distinct({_sql_words('body')}) AS body_words FROM np0)"""


def name_words(spark, folder):
    return named_pages(spark, folder).select("page_id", "name", F.array_join("words", ",").alias("words"))


QUERIES["name_words"] = (name_words, f"WITH {SQL_NAMED} SELECT page_id, name, array_to_string(words, ',') AS words FROM np")


def name_cue(spark, folder):
    """Whether no name word occurs in the body, with missing and present shares."""
    w, b = F.col("words"), F.col("body_words")
    return named_pages(spark, folder).select(
        "page_id", T.name_cue_absent(w, b).alias("absent"), T.missing_share(w, b).alias("missing_share"), T.overlap_share(w, b).alias("overlap_share"),
    )


QUERIES["name_cue"] = (
    name_cue,
    f"""WITH {SQL_NAMED} SELECT page_id, len(words) > 0 AND NOT list_has_any(words, body_words) AS absent,
  CASE WHEN len(words) > 0 THEN {D('len(words) - len(list_intersect(words, body_words))')} / len(words) ELSE {D(0)} END AS missing_share,
  CASE WHEN len(words) > 0 THEN {D('len(list_intersect(words, body_words))')} / len(words) END AS overlap_share FROM np""",
)


def part_name_cue(spark, folder):
    """The same cue on part names against part types."""
    rows = table(spark, folder, "part").select("p_partkey", T.name_words(F.col("p_name")).alias("w"), F.array_distinct(T.split_words(F.concat_ws(" ", "p_type", "p_brand"))).alias("b"))
    return rows.select("p_partkey", F.array_join("w", ",").alias("words"), T.name_cue_absent(F.col("w"), F.col("b")).alias("absent"))


QUERIES["part_name_cue"] = (
    part_name_cue,
    f"""WITH p AS (SELECT p_partkey, list_sort(list_distinct({_sql_words('p_name')})) AS w, list_distinct({_sql_words("p_type || ' ' || p_brand")}) AS b FROM part)
SELECT p_partkey, array_to_string(w, ',') AS words, len(w) > 0 AND NOT list_has_any(w, b) AS absent FROM p""",
)


def cue_selectivity(spark, folder):
    """Share of named pages the cue lets through, per first letter of the host."""
    rows = named_pages(spark, folder).where(F.size("words") > 0).withColumn("absent", T.name_cue_absent(F.col("words"), F.col("body_words")))
    out = rows.groupBy((F.size("words")).cast("bigint").alias("words")).agg(F.count(F.lit(1)).alias("named"), F.count_if("absent").cast("bigint").alias("through"))
    low, high = M.wilson(F.col("through"), F.col("named"))
    return out.select("words", "named", "through", M.rounded(M.rate(F.col("through"), F.col("named")), 4).alias("rate"), M.rounded(low, 4).alias("lo"), M.rounded(high, 4).alias("hi"))


def _cue_sql():
    from pairloom.plans.statistics import sql_wilson

    lo, hi = sql_wilson("through", "named")
    r = lambda x: f"floor(({x}) * {D(10000)} + {D(0.5)}) / {D(10000)}"
    return f"""WITH {SQL_NAMED}, c AS (SELECT len(words) AS words, count(*) AS named, count_if(NOT list_has_any(words, body_words)) AS through FROM np WHERE len(words) > 0 GROUP BY 1)
SELECT CAST(words AS BIGINT) AS words, CAST(named AS BIGINT) AS named, CAST(through AS BIGINT) AS through, {r(f"{D('through')} / {D('named')}")} AS rate, {r(lo)} AS lo, {r(hi)} AS hi FROM c"""


QUERIES["cue_selectivity"] = (cue_selectivity, _cue_sql())


# --- lines ------------------------------------------------------------------------------------------

def line_table(spark, folder):
    return L.line_table(table(spark, folder, "documents"), "doc_id", "text")


SQL_LINES = """ls AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
lt AS (SELECT doc_id, line, length(t) AS length, coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM ls)"""
QUERIES["line_table"] = (
    line_table,
    f"WITH {SQL_LINES} SELECT doc_id, CAST(line AS BIGINT) AS line, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length FROM lt",
)


def line_windows(spark, folder):
    return L.line_windows(line_table(spark, folder), "doc_id", F.lit(K.MIN_WINDOW_LINES))


QUERIES["line_windows"] = (
    line_windows,
    f"""WITH {SQL_LINES}, w AS (SELECT doc_id, (line - 1) // {K.MIN_WINDOW_LINES} AS win, min(start) AS start, max(start + length) AS fin, min(line) AS a, max(line) AS b FROM lt GROUP BY 1, 2)
SELECT doc_id, CAST(win AS BIGINT) AS "window", CAST(start AS BIGINT) AS start, CAST(fin AS BIGINT) AS "end", CAST(a AS BIGINT) AS start_line, CAST(b AS BIGINT) AS end_line FROM w WHERE fin > start""",
)


def context_windows(spark, folder):
    """Fifteen lines either side of one anchor line per document."""
    docs = table(spark, folder, "documents").withColumn("anchor", F.floor(T.unit_hash(F.lit("anchor"), F.col("doc_id")) * T.line_count(F.col("text"))).cast("bigint") + 1)
    return L.context_windows(L.line_table(docs, "doc_id", "text", "anchor"), "doc_id", F.col("anchor"), K.CONTEXT_LINES)


QUERIES["context_windows"] = (
    context_windows,
    f"""WITH {SQL_LINES}, an AS (SELECT doc_id, CAST(floor({B.sql_unit_hash("'anchor'", 'doc_id')} * {B.sql_lines('text')}) AS BIGINT) + 1 AS anchor FROM documents)
SELECT doc_id, CAST(min(start) AS BIGINT) AS start, CAST(max(start + length) AS BIGINT) AS "end", CAST(min(line) AS BIGINT) AS start_line, CAST(max(line) AS BIGINT) AS end_line
FROM lt JOIN an USING (doc_id) WHERE line BETWEEN anchor - {K.CONTEXT_LINES} AND anchor + {K.CONTEXT_LINES} GROUP BY doc_id""",
)


def kgram_counts(spark, folder):
    """Windows and distinct windows per document for the widths in use."""
    units = B.units(spark, folder).select("id", "tokens")
    written = units.select("id", F.explode(F.array(F.lit(3), F.lit(5), F.lit(10))).alias("k"), "tokens")
    hashes = F.when(F.col("k") == 3, T.shingle_hashes(F.col("tokens"), 3)).when(F.col("k") == 5, T.shingle_hashes(F.col("tokens"), 5)).otherwise(T.shingle_hashes(F.col("tokens"), 10))
    return written.select("id", F.col("k").cast("bigint").alias("k"), F.greatest(F.size("tokens") - F.col("k") + 1, F.lit(0)).cast("bigint").alias("windows"), F.size(hashes).cast("bigint").alias("shingles"))


QUERIES["kgram_counts"] = (
    kgram_counts,
    f"""WITH {B.SQL_UNITS}, k AS (SELECT id, tokens, unnest([3, 5, 10]) AS k FROM units),
c AS ({' UNION ALL '.join(f"SELECT id, {k} AS k, count(DISTINCT g) AS shingles FROM {B.sql_gram_rows('units', 'id', 'tokens', k)} GROUP BY 1" for k in (3, 5, 10))})
SELECT k.id, CAST(k.k AS BIGINT) AS k, CAST(greatest(len(tokens) - k.k + 1, 0) AS BIGINT) AS windows, CAST(coalesce(shingles, 0) AS BIGINT) AS shingles FROM k LEFT JOIN c ON c.id = k.id AND c.k = k.k""",
)


# --- intervals --------------------------------------------------------------------------------------

HALF_HOUR = 30 * 60 * 1_000_000


def intervals(spark, folder):
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return table(spark, folder, "events").select("user_id", "event_id", "event_type", us.alias("start"), (us + HALF_HOUR).alias("end"))


def merged_intervals(spark, folder):
    """Overlapping or touching stays per user, their event types in order of first sight."""
    rows = cut_lineage(merge_intervals(intervals(spark, folder), ["user_id"], "start", "end", ["event_id"]))
    spans = rows.groupBy("user_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("ranges"))
    roles = rows.groupBy("user_id", "island", "event_type").agg(F.min(F.struct("start", "event_id")).alias("first"))
    # At most one entry per event type.
    named = roles.groupBy("user_id", "island").agg(F.array_sort(F.collect_list(F.struct("first", "event_type"))).alias("r"))
    text = F.array_join(F.transform("r", lambda x: x["event_type"]), ",")
    return spans.join(named.select("user_id", "island", text.alias("roles")), ["user_id", "island"])


SQL_ISLANDS = f"""iv AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS s, epoch_us(ts) + {HALF_HOUR} AS e FROM events),
i1 AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY user_id ORDER BY s, e, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NOT FALSE THEN 1 ELSE 0 END AS o FROM iv),
i2 AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY s, e, event_id) AS island FROM i1)"""
QUERIES["merged_intervals"] = (
    merged_intervals,
    f"""WITH {SQL_ISLANDS}, rl AS (SELECT user_id, island, event_type, min(s) AS f, arg_min(event_id, (s, event_id)) AS fe FROM i2 GROUP BY 1, 2, 3),
rr AS (SELECT user_id, island, string_agg(event_type, ',' ORDER BY f, fe) AS roles FROM rl GROUP BY 1, 2)
SELECT user_id, CAST(island AS BIGINT) AS island, CAST(min(s) AS BIGINT) AS start, CAST(max(e) AS BIGINT) AS "end", CAST(count(*) AS BIGINT) AS ranges, any_value(roles) AS roles FROM i2 JOIN rr USING (user_id, island) GROUP BY 1, 2""",
)


# --- audits -----------------------------------------------------------------------------------------

def case_audit_exact(spark, folder):
    """Identical texts within a question, and whether their labels contradict."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("h"))
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    rows = docs.join(labels, "doc_id", "left").groupBy("lang", "h").agg(
        F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.min("quality").alias("_lo"), F.max("quality").alias("_hi"),
    )
    return rows.where(F.col("copies") > 1).select("lang", "first_id", "copies", F.coalesce(F.col("_lo") != F.col("_hi"), F.lit(False)).alias("contradictory"))


QUERIES["case_audit_exact"] = (
    case_audit_exact,
    """SELECT lang, min(d.doc_id) AS first_id, CAST(count(*) AS BIGINT) AS copies, coalesce(min(quality) <> max(quality), FALSE) AS contradictory
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY lang, sha256(text) HAVING count(*) > 1""",
)


def case_audit_near(spark, folder):
    """Near-duplicate texts within a question by word triples; exact copies are one class."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    classes = (
        docs.withColumn("h", F.sha2("text", 256)).groupBy("lang", "h").agg(F.min("doc_id").alias("cid"), F.first("text").alias("text"))
        .select("cid", "lang", T.case_tokens(F.col("text")).alias("tokens"))
    )
    grams = F.col("tokens")
    # The language is hashed in, so texts of different questions never share a triple.
    window = lambda i: F.xxhash64("lang", *[F.get(grams, i + d) for d in range(K.CASE_WIDTH)])
    items = F.when(F.size(grams) >= K.CASE_WIDTH, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(grams) - K.CASE_WIDTH), window))).otherwise(F.array().cast("array<bigint>"))
    written = cut_lineage(classes)
    sets = written.select("cid", F.lit(1).alias("lines"), items.alias("items")).where(F.size("items") > 0)
    return S.bounded_pairs(sets, K.CASE_NEAR_DUPLICATE, 2.0)


QUERIES["case_audit_near"] = (
    case_audit_near,
    f"""WITH c AS (SELECT min(doc_id) AS cid, lang, text FROM documents GROUP BY lang, text),
t AS (SELECT cid, lang, list_filter(regexp_split_to_array(text, '[^A-Za-z0-9_]+'), lambda x: x <> '') AS tk FROM c),
u AS (SELECT DISTINCT cid, lang, g AS item FROM {B.sql_gram_rows('t', 'cid, lang', 'tk', 3)}), s AS (SELECT cid, count(*) AS n FROM u GROUP BY 1),
p AS (SELECT x.cid AS a, y.cid AS b, count(*) AS common FROM u x JOIN u y ON x.item = y.item AND x.lang = y.lang AND x.cid < y.cid GROUP BY 1, 2),
j AS (SELECT a, b, common / CAST(greatest(m.n + n.n - common, 1) AS DOUBLE) AS jaccard FROM p JOIN s m ON m.cid = a JOIN s n ON n.cid = b)
SELECT * FROM j WHERE jaccard >= CAST({K.CASE_NEAR_DUPLICATE} AS DOUBLE)""",
)


def case_audit_summary(spark, folder):
    """Per question: cases by label, majority baseline, text sizes, and whether one class is missing."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", F.length("text").cast("bigint").alias("size"))
    rows = docs.join(table(spark, folder, "labels"), "doc_id", "left").groupBy("lang").agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(F.col("quality") == 1).cast("bigint").alias("actionable"), F.count_if(F.col("quality") == 0).cast("bigint").alias("no_action"),
        F.count_if(F.col("quality").isNull()).cast("bigint").alias("uncertain"), F.min("size").alias("min_size"), F.max("size").alias("max_size"),
    )
    a, n = F.col("actionable"), F.col("no_action")
    return rows.select("*", M.rate(F.greatest(a, n), a + n).alias("majority_baseline"), ((a == 0) | (n == 0)).alias("one_class"))


QUERIES["case_audit_summary"] = (
    case_audit_summary,
    f"""WITH c AS (SELECT lang, count(*) AS cases, count_if(coalesce(quality = 1, FALSE)) AS a, count_if(coalesce(quality = 0, FALSE)) AS n, count_if(quality IS NULL) AS u, min(length(text)) AS mi, max(length(text)) AS ma
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY lang)
SELECT lang, CAST(cases AS BIGINT) AS cases, CAST(a AS BIGINT) AS actionable, CAST(n AS BIGINT) AS no_action, CAST(u AS BIGINT) AS uncertain, CAST(mi AS BIGINT) AS min_size, CAST(ma AS BIGINT) AS max_size,
  CASE WHEN a + n > 0 THEN {D('greatest(a, n)')} / {D('a + n')} END AS majority_baseline, a = 0 OR n = 0 AS one_class FROM c""",
)


def label_leakage(spark, folder):
    """Texts that name their own question or the expected answer; the pattern is built per row."""
    docs = table(spark, folder, "documents")
    pattern = F.concat(F.lit("(?i)"), F.col("source"), F.lit(r"|\bthe "), F.col("lang"), F.lit(r"|\bexpected\b|\b(?:positive|negative) case\b"))
    return docs.where(F.rlike("text", pattern)).groupBy("lang").agg(F.count(F.lit(1)).alias("leaking"))


QUERIES["label_leakage"] = (
    label_leakage,
    r"""SELECT lang, CAST(count(*) AS BIGINT) AS leaking FROM documents WHERE regexp_matches(text, '(?i)' || source || '|\bthe ' || lang || '|\bexpected\b|\b(?:positive|negative) case\b') GROUP BY lang""",
)


def benchmark_leakage(spark, folder):
    """Documents sharing word triples with a held-out item: common triples and the item's covered share."""
    def triples(name, key):
        rows = table(spark, folder, name).select(F.col(key).alias("k"), T.word_tokens(F.col("text")).alias("t"))
        return rows.select("k", F.explode(T.shingle_hashes(F.col("t"), K.CASE_WIDTH)).alias("h"))

    items = cut_lineage(triples("benchmark", "item_id").select(F.col("k").alias("item_id"), "h"))
    sizes = items.groupBy("item_id").agg(F.count(F.lit(1)).alias("size"))
    # Spark broadcasts the item side only while its measured size allows it.
    common = triples("documents", "doc_id").select(F.col("k").alias("doc_id"), "h").join(items, "h").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("common"))
    return common.join(sizes, "item_id").select("doc_id", "item_id", "common", (F.col("common").cast("double") / F.col("size")).alias("share")).where(F.col("share") >= 0.5)


QUERIES["benchmark_leakage"] = (
    benchmark_leakage,
    f"""WITH d AS (SELECT doc_id, {B.sql_tokens('text')} AS t FROM documents), b AS (SELECT item_id, {B.sql_tokens('text')} AS t FROM benchmark),
dg AS (SELECT DISTINCT doc_id, g FROM {B.sql_gram_rows('d', 'doc_id', 't', 3)}), bg AS (SELECT DISTINCT item_id, g FROM {B.sql_gram_rows('b', 'item_id', 't', 3)}),
z AS (SELECT item_id, count(*) AS size FROM bg GROUP BY 1), c AS (SELECT doc_id, item_id, count(*) AS common FROM dg JOIN bg USING (g) GROUP BY 1, 2)
SELECT doc_id, item_id, CAST(common AS BIGINT) AS common, {D('common')} / size AS share FROM c JOIN z USING (item_id) WHERE {D('common')} / size >= {D(0.5)}""",
)
