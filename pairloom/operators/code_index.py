"""JavaScript and TypeScript sources to functions, calls, imports and exports, with built-in expressions.

A lexer pattern cuts each file into tokens inside the JVM; brackets are matched by depth. What a full parser
would see and this does not: regular-expression literals, templates inside templates, arrows without braces.
Windows are per file, and a snapshot caps a file at 512 KiB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions import text as T

LEXER = "|".join(
    (
        r"//[^\n]*+",
        r"/\*(?s:.*?)\*/",
        r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"?+',
        r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'?+",
        r"`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`?+",
        r"\d[\w.]*+",
        r"[\p{L}_$#][\p{L}\p{N}_$]*+",
        r"=>|===|!==|==|!=|<=|>=|&&=|\|\|=|\?\?=|&&|\|\||\?\?|\.\.\.|\+\+|--|\?\.",
        r"\s++",
        r"[\s\S]",
    )
)
CONTROL = ("if", "for", "while", "switch", "catch", "with", "return", "typeof", "await", "super", "do", "else")
KEYWORDS = CONTROL + tuple(
    "function const let var class new in of case default break continue try finally throw delete void instanceof this null true false "
    "import export from as async static get set extends yield".split()
)
BRANCHES = ("if", "for", "while", "case", "catch", "?", "&&", "||", "??")


def kind_of(token: Column) -> Column:
    return (
        F.when(token.rlike(r"^(?://|/\*|\s)"), "space")
        .when(token.rlike("^[\"']"), "string")
        .when(token.startswith("`"), "template")
        .when(token.rlike(r"^\d"), "num")
        .when(token.isin(*KEYWORDS), "keyword")
        .when(token.rlike(r"^[\p{L}_$#]"), "name")
        .otherwise("punct")
    )


def tokens(files: DataFrame) -> DataFrame:
    """(path, i, token, kind, start, line, depth): significant tokens with offsets, lines and bracket depth."""
    raw = files.select("path", F.posexplode(F.regexp_extract_all("text", F.lit(LEXER), 0)).alias("_at", "token"))
    before = Window.partitionBy("path").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    breaks = F.length("token") - F.length(F.replace("token", F.lit("\n"), F.lit("")))
    placed = raw.select(
        "path", "_at", "token", kind_of(F.col("token")).alias("kind"),
        F.coalesce(F.sum(F.length("token")).over(before), F.lit(0)).cast("bigint").alias("start"),
        (F.coalesce(F.sum(breaks).over(before), F.lit(0)) + 1).cast("bigint").alias("line"),
    ).where(F.col("kind") != "space")
    order = Window.partitionBy("path").orderBy("_at")
    opens, closes = F.col("token").isin("(", "[", "{"), F.col("token").isin(")", "]", "}")
    level = F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return placed.select(
        "path", F.row_number().over(order).alias("i"), "token", "kind", "start", "line", F.when(opens, level - 1).otherwise(level).alias("depth")
    )


def matched(toks: DataFrame) -> DataFrame:
    """Bracket pairs: (path, open_i, close_i, token, end, end_line); an open bracket ends at the next close of its depth."""
    brackets = toks.where(F.col("token").isin("(", "[", "{", ")", "]", "}"))
    w = Window.partitionBy("path", "depth").orderBy("i")
    paired = brackets.select("*", F.lead(F.struct("i", "start", "line")).over(w).alias("c"))
    return paired.where(F.col("token").isin("(", "[", "{") & F.col("c").isNotNull()).select(
        "path", F.col("i").alias("open_i"), F.col("c.i").alias("close_i"), "token", (F.col("c.start") + 1).alias("end"), F.col("c.line").alias("end_line")
    )


def functions(toks: DataFrame) -> DataFrame:
    """One row per braced function: path, name, start and end offset, lines, token range, nested flag, id."""
    order = Window.partitionBy("path").orderBy("i")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    seen = toks.select(
        "*", *[F.lag("token", n).over(order).alias(f"t{n}") for n in (1, 2, 3)], *[F.lag("kind", n).over(order).alias(f"k{n}") for n in (1, 2, 3)],
        *[F.lag("start", n).over(order).alias(f"s{n}") for n in (1, 2, 3)],
        F.max(F.when(F.col("token") == ")", F.col("i"))).over(past).alias("last_close"),
        F.max(F.when(F.col("token").isin(";", "{", "}", "=", "=>", "(", ","), F.col("i"))).over(past).alias("last_stop"),
        F.lead("token").over(order).alias("next"),
    )
    pairs = matched(toks)
    # A body is a brace after ")", after a return type that follows ")", or after "=>".
    typed = (F.col("last_close") > F.col("last_stop")) & F.col("last_close").isNotNull()
    arrow = F.col("t1") == "=>"
    body = seen.where((F.col("token") == "{") & (arrow | typed)).select(
        "path", F.col("i").alias("body_i"), arrow.alias("arrow"), F.when(arrow, F.when(F.col("t2") == ")", F.col("i") - 2)).otherwise(F.col("last_close")).alias("close_i"),
        F.when(arrow & (F.col("k2") == "name"), F.col("i") - 2).alias("single_i"),
    )
    parens = pairs.where(F.col("token") == "(").select("path", "close_i", F.col("open_i").alias("paren_i"))
    headed = body.join(parens, ["path", "close_i"], "left").withColumn("head_i", F.coalesce("paren_i", "single_i")).where(F.col("head_i").isNotNull())
    before = seen.select("path", F.col("i").alias("head_i"), F.col("start").alias("s0"), F.col("line").alias("l0"), "t1", "t2", "t3", "k1", "k2", "k3", "s1", "s2")
    at = headed.join(before, ["path", "head_i"])
    t1, t2, k1, k2 = (F.col(c) for c in ("t1", "t2", "k1", "k2"))
    plain = ~F.col("arrow")
    declared = plain & (k1 == "name") & t2.isin("function", "*")
    anonymous = plain & (t1 == "function")
    method = plain & (k1 == "name") & ~declared
    bound = F.col("arrow") & (t1 == "=") & (k2 == "name")
    name = F.when(declared | method | (plain & t1.isin("get", "set", "static")), t1).when(bound, t2).when(anonymous & (t2 == "=") & (F.col("k3") == "name"), F.col("t3"))
    start = F.when(declared, F.col("s2")).when(anonymous | method, F.col("s1")).otherwise(F.col("s0"))
    first = F.when(declared, F.col("head_i") - 2).when(anonymous | method, F.col("head_i") - 1).otherwise(F.col("head_i"))
    kept = at.where(F.col("arrow") | declared | anonymous | method)
    ends = pairs.where(F.col("token") == "{").select("path", F.col("open_i").alias("body_i"), F.col("close_i").alias("last_i"), "end", "end_line")
    rows = kept.select("path", "body_i", "paren_i", "close_i", "head_i", name.alias("name"), start.alias("start"), first.alias("first_i"), F.col("l0").alias("start_line")).join(ends, ["path", "body_i"])
    outer = F.max("end").over(Window.partitionBy("path").orderBy("start", F.col("end").desc()).rowsBetween(Window.unboundedPreceding, -1))
    return rows.select(
        F.sha2(F.concat_ws("|", "path", F.col("start").cast("string"), F.col("end").cast("string")), 256).alias("id"), "path", "name", "start", "end", "start_line", "end_line",
        (F.col("end_line") - F.col("start_line") + 1).alias("lines"), "first_i", "last_i", "body_i", "paren_i", "close_i", T.is_test_path(F.col("path")).alias("is_test"),
        F.coalesce(outer >= F.col("end"), F.lit(False)).alias("nested"),
    )


def profiles(toks: DataFrame, funcs: DataFrame) -> DataFrame:
    """Shingles, surface, token-kind shape and metrics per function, from its slice of the file's tokens.

    The token list of a file is bounded by the file cap.
    """
    lists = toks.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("i", "token", "kind"))).alias("all"))
    params = F.slice("all", F.coalesce("paren_i", F.col("first_i")), F.coalesce(F.col("close_i") - F.col("paren_i") + 1, F.lit(1)))
    own = funcs.join(lists, "path").select(
        "id", "path", "name", "lines", F.slice("all", F.col("first_i"), F.col("last_i") - F.col("first_i") + 1).alias("ts"),
        F.transform(F.filter(params, lambda t: t["kind"] == "name"), lambda t: t["token"]).alias("params"),
    )
    label = lambda t: T.normalised_token(t["kind"], t["token"])
    is_name = lambda t: t["kind"] == "name"
    declares = F.filter(F.transform("ts", lambda t, n: F.when((t["kind"] == "name") & F.get(F.col("ts"), n - 1)["token"].isin("const", "let", "var", "function"), t["token"])), lambda x: x.isNotNull())
    count = lambda f: F.size(F.filter("ts", f)).cast("bigint")
    of_kind = lambda k: lambda t: t["kind"] == k
    kinds = ("name", "keyword", "string", "template", "num", "punct")
    normal = own.withColumn("normal", F.transform("ts", label)).withColumn("locals", F.array_union(F.array_union(declares, F.col("params")), F.array_compact(F.array("name"))))
    names = F.array_distinct(F.transform(F.filter("ts", is_name), lambda t: t["token"]))
    strings = F.transform(F.filter("ts", lambda t: t["kind"].isin("string", "template") & (F.length(t["token"]) >= 4)), lambda t: t["token"])
    return normal.select(
        "id", "path", "name", "lines", T.shingles(F.col("normal")).alias("items"), F.array_distinct(F.concat(F.array_except(names, F.col("locals")), strings)).alias("surface"),
        F.map_filter(F.create_map(*[x for k in kinds for x in (F.lit(k), count(of_kind(k)))]), lambda k, n: n > 0).alias("shape"),
        F.sha2(F.array_join("normal", " "), 256).alias("body_hash"), F.size("ts").cast("bigint").alias("tokens"),
        (count(lambda t: t["token"].isin(*BRANCHES)) + 1).alias("cyclomatic"), count(lambda t: t["token"] == "return").alias("returns"), count(lambda t: t["token"] == ";").alias("statements"),
        F.coalesce(F.exists("ts", lambda t: t["token"] == F.col("name")) & (F.size(F.filter("ts", lambda t: t["token"] == F.col("name"))) > 1), F.lit(False)).alias("recursion"),
    )


def calls(toks: DataFrame, funcs: DataFrame) -> DataFrame:
    """Named calls with the innermost function around them; module-level calls have no owner."""
    order = Window.partitionBy("path").orderBy("i")
    sites = toks.select("*", F.lead("token").over(order).alias("next"), F.lag("token").over(order).alias("prev"))
    heads = funcs.select("path", F.col("paren_i").alias("_p")).where(F.col("_p").isNotNull())
    named = sites.where((F.col("kind") == "name") & (F.col("next") == "(") & (F.col("prev").isNull() | (F.col("prev") != "function")))
    sites = named.join(heads, (named.path == heads.path) & (named.i + 1 == heads._p), "left_anti")
    around = funcs.select("path", "id", F.col("start").alias("_s"), F.col("end").alias("_e"))
    # Joined per file and cut to the innermost range; both sides are bounded by the file cap.
    owned = sites.join(around, "path").where((F.col("_s") <= F.col("start")) & (F.col("start") < F.col("_e"))).groupBy("path", "i").agg(F.max_by("id", "_s").alias("owner_id"))
    return sites.join(owned, ["path", "i"], "left").select("path", "owner_id", F.col("token").alias("callee"), F.when(F.col("prev").isin(".", "?."), True).otherwise(False).alias("member"), "line")


def imports(files: DataFrame) -> DataFrame:
    """(module, name, imported, specifier, type_only): named, default and namespace imports."""
    found = lambda pattern, *groups: F.arrays_zip(*[F.regexp_extract_all("text", F.lit(pattern), g).alias(f"g{g}") for g in groups])
    braces = files.select(F.col("path").alias("module"), F.explode(found(r"""\bimport\s+(type\s+)?(?:[\w$]+\s*,\s*)?\{([^}]*)\}\s*from\s*['"]([^'"]+)['"]""", 1, 2, 3)).alias("x"))
    each = braces.select("module", F.col("x.g3").alias("specifier"), (F.length("x.g1") > 0).alias("type_only"), F.explode(F.split("x.g2", ",")).alias("part")).where(F.trim("part") != "")
    words = F.split(F.trim("part"), r"\s+as\s+")
    named = each.select("module", F.trim(F.element_at(words, -1)).alias("name"), F.trim(F.element_at(words, 1)).alias("imported"), "specifier", "type_only")
    whole = files.select(F.col("path").alias("module"), F.explode(found(r"""\bimport\s+(\*\s+as\s+)?([\w$]+)\s*(?:,\s*\{[^}]*\}\s*)?from\s*['"]([^'"]+)['"]""", 1, 2, 3)).alias("x"))
    single = whole.select("module", F.col("x.g2").alias("name"), F.when(F.length("x.g1") > 0, "*").otherwise("default").alias("imported"), F.col("x.g3").alias("specifier"), F.lit(False).alias("type_only"))
    return named.unionByName(single.where(F.col("name") != "type"))


def exports(files: DataFrame) -> DataFrame:
    """(module, name, reexport): declared, listed and default exports."""
    declared = files.select(F.col("path").alias("module"), F.explode(F.regexp_extract_all("text", F.lit(r"\bexport\s+(?:async\s+)?(?:function\*?|const|let|var|class)\s+([\w$]+)"), 1)).alias("name")).withColumn("reexport", F.lit(False))
    listed = files.select(F.col("path").alias("module"), F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(r"\bexport\s*\{([^}]*)\}(\s*from)?"), 1).alias("n"), F.regexp_extract_all("text", F.lit(r"\bexport\s*\{([^}]*)\}(\s*from)?"), 2).alias("f"))).alias("x"))
    parts = listed.select("module", F.explode(F.split("x.n", ",")).alias("p"), (F.length("x.f") > 0).alias("reexport")).where(F.trim("p") != "")
    names = parts.select("module", F.trim(F.element_at(F.split(F.trim("p"), r"\s+as\s+"), -1)).alias("name"), "reexport")
    default = files.where(F.rlike("text", F.lit(r"\bexport\s+default\b"))).select(F.col("path").alias("module"), F.lit("default").alias("name"), F.lit(False).alias("reexport"))
    return declared.unionByName(names).unionByName(default)
