"""URL filter with redirect equivalence: decisions reach the aliases of a page. DataFrame functions only.

Rules allow or block a host with all its subdomains below a path prefix; the longest fitting rule decides a URL.
Aliases are URLs joined by

* a redirect: the target of any ``<meta http-equiv="refresh">`` of the page,
* a canonical link: the target of any ``<link>`` with ``canonical`` among its ``rel`` tokens,
* being one address: equal but for scheme, ``www.``, default port, fragment and tracking parameters.

Connected components over these edges carry decisions: a URL without a rule of its own is allowed if any alias is
explicitly allowed, else blocked if any alias is blocked, else allowed. A URL's own rule always stands.

Pages are scanned for tags only where the literal occurs. Only URLs with an edge to another address enter the
components; a page with a rule of its own is not joined with anything.

Defined cases: a null URL or one without ``://`` has empty host and path, no rule and no alias, and is allowed; null
html has no edges; relative targets are resolved against the page; repeated pages give repeated rows; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.components import connected_components
from pairloom.llm.tables import cut, read

# The rules of the query, (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRACKING = r"(utm_[a-z]+|gclid|fbclid|ref)"
_LINK = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
_CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*(?:[\"']?canonical\b|\"[^\">]*\scanonical\b|'[^'>]*\scanonical\b)[^>]*>"
_META = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
_HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_URL = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to / ? # or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ? or # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Longest fitting rule as struct(rule, verdict), or null. Rules are a short parameter list."""
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        hit = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        fits = F.when(hit, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    return fits


def address(url: Column) -> Column:
    """One key for a URL and its trivial variants; null where there is no host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)$", "")
    query = F.regexp_replace(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), rf"(^|&){TRACKING}=[^&]*", "")
    path = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    query = F.regexp_replace(query, "^&", "")
    return F.when(host_of(url) != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def resolved(target: Column, url: Column) -> Column:
    """A target found on a page, as an absolute URL."""
    target = F.replace(target, F.lit("&amp;"), F.lit("&"))
    site = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.substring_index(site, "//", 1), target))
        .when(target.startswith("/"), F.concat(site, target))
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), target))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """(url, target): redirects and canonical links of pages(url, html)."""
    html = F.col("html")
    low = F.lower(html)
    of_tags = lambda tag, target: F.transform(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda t: F.regexp_extract(t, target, 1))
    none = F.array().cast("array<string>")
    canonical = F.when(F.contains(low, F.lit("canonical")), of_tags(_CANONICAL, _HREF)).otherwise(none)
    redirect = F.when(F.contains(low, F.lit("http-equiv")), of_tags(_META, _URL)).otherwise(none)
    found = pages.where((F.contains(low, F.lit("canonical")) | F.contains(low, F.lit("http-equiv"))) & F.contains(F.col("url"), F.lit("://")))
    targets = found.select("url", F.explode(F.array_union(canonical, redirect)).alias("target")).where("target <> ''")
    return targets.select("url", resolved(F.col("target"), F.col("url")).alias("target"))


def filter_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, via): via is rule, alias or default."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    url = F.col("url")
    judged = rows.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path")).withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    out = ("page_id", "host", "path", F.col("own.rule").alias("rule"))
    ruled = judged.where("own is not null").select(*out, F.col("own.verdict").alias("verdict"), F.lit("rule").alias("via"))

    edges = cut(alias_edges(rows.select("url", "html")))
    links = edges.select(address(url).alias("u"), address(F.col("target")).alias("v"))
    members = connected_components(links)
    # What rules say of each address, known from pages or from targets.
    named = rows.select("url").unionByName(edges.select(F.col("target").alias("url")))
    said = named.select(address(url).alias("member"), rule_of(host_of(url), path_of(url), rules)["verdict"].alias("verdict")).where("member is not null and verdict is not null")
    said = cut(said.groupBy("member").agg(F.min("verdict").alias("verdict")))  # allow before block
    # An address in no component is one of its own.
    of = cut(members).withColumnRenamed("member", "_m")
    known = said.join(of, F.col("member") == F.col("_m"), "left").select(F.coalesce("component", "member").alias("component"), "verdict")
    decided = cut(known.groupBy("component").agg(F.min("verdict").alias("verdict")))
    reached = of.join(decided, "component").select(F.col("_m").alias("key"), "verdict")
    alone = decided.withColumnRenamed("component", "key").join(of.select("_m"), F.col("key") == F.col("_m"), "left_anti")
    by_address = cut(reached.unionByName(alone))

    open_pages = judged.where("own is null").withColumn("_key", address(url))
    lost = open_pages.where("_key is null").select(*out, F.lit("allow").alias("verdict"), F.lit("default").alias("via"))
    alias = open_pages.where("_key is not null").join(by_address, F.col("_key") == F.col("key"), "left").select(
        *out, F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.when(F.col("verdict").isNull(), "default").otherwise("alias").alias("via")
    )
    return ruled.unionByName(alias).unionByName(lost)


def op10(spark: SparkSession, folder: str) -> DataFrame:
    return filter_urls(read(spark, folder, "pages"))


def _sql_address(u: str) -> str:
    host = f"regexp_replace(regexp_replace({_sql_host(u)}, '^www\\.', ''), ':(80|443)$', '')"
    query = f"regexp_replace(regexp_replace(regexp_extract({u}, '(?s)^.*?://[^?#]*\\?([^#]*)', 1), '(^|&){TRACKING}=[^&]*', '', 'g'), '^&', '')"
    path = f"(CASE WHEN {_sql_path(u)} = '' THEN '/' ELSE {_sql_path(u)} END)"
    return f"(CASE WHEN {_sql_host(u)} <> '' THEN {host} || {path} || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END END)"


def _sql_host(u: str) -> str:
    return f"coalesce(translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '')"


def _sql_path(u: str) -> str:
    return f"coalesce(regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"


_SQL_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
_SQL_SITE = "regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1)"

OP10_SQL = f"""
WITH RECURSIVE rules(verdict, h, p) AS (VALUES {_SQL_RULES}),
raw AS (SELECT url, replace(unnest([regexp_extract(regexp_extract(html, '{_LINK.replace("'", "''")}'), '{_HREF.replace("'", "''")}', 1),
  regexp_extract(regexp_extract(html, '{_META.replace("'", "''")}'), '{_URL.replace("'", "''")}', 1)]), '&amp;', '&') AS t FROM pages WHERE contains(url, '://')),
edges AS (SELECT url, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t
  WHEN starts_with(t, '//') THEN split_part({_SQL_SITE}, '//', 1) || t WHEN starts_with(t, '/') THEN {_SQL_SITE} || t
  ELSE {_SQL_SITE} || CASE WHEN regexp_extract({_sql_path("url")}, '(?s)^(.*/)', 1) = '' THEN '/' ELSE regexp_extract({_sql_path("url")}, '(?s)^(.*/)', 1) END || t END AS target
  FROM raw WHERE t <> ''),
named AS (SELECT DISTINCT url FROM (SELECT url FROM pages UNION ALL SELECT target FROM edges)),
fit AS (SELECT n.url, arg_max(verdict, length(h || p)) AS verdict, arg_max(h || p, length(h || p)) AS rule FROM named n JOIN rules
  ON ({_sql_host("n.url")} = h OR ends_with({_sql_host("n.url")}, '.' || h)) AND starts_with({_sql_path("n.url")}, p) GROUP BY n.url),
keyed AS (SELECT url, {_sql_address("url")} AS k FROM named),
link AS (SELECT {_sql_address("url")} AS a, {_sql_address("target")} AS b FROM edges),
both_ways AS (SELECT a, b FROM link WHERE a <> b UNION SELECT b, a FROM link WHERE a <> b),
reach AS (SELECT DISTINCT k AS a, k AS b FROM keyed WHERE k IS NOT NULL UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b),
said AS (SELECT k, min(verdict) AS verdict FROM keyed JOIN fit USING (url) GROUP BY k),
decided AS (SELECT r.a AS k, min(verdict) AS verdict FROM reach r JOIN said s ON s.k = r.b GROUP BY r.a)
SELECT page_id, {_sql_host("p.url")} AS host, {_sql_path("p.url")} AS path, f.rule, coalesce(f.verdict, d.verdict, 'allow') AS verdict,
  CASE WHEN f.rule IS NOT NULL THEN 'rule' WHEN d.verdict IS NOT NULL THEN 'alias' ELSE 'default' END AS via
FROM pages p LEFT JOIN fit f ON f.url = p.url LEFT JOIN keyed k ON k.url = p.url LEFT JOIN decided d ON d.k = k.k
"""

QUERIES = {"op10_url_filter": (op10, OP10_SQL)}
