"""Names to files and declarations: candidate explode, equi-joins, and a reason for every failure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.chains import follow_chains
from pairloom.operators.skew import lookup_join
from pairloom.session import written

# Endings tried for a specifier without one, in order.
MODULE_ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")


def apply_alias(specifier: Column, aliases: dict[str, str]) -> Column:
    """Rewrite by the alias whose literal prefix is longest; others stay as they are."""
    out = specifier
    # The longest prefix is tested first because it is nested outermost.
    for prefix, target in sorted(aliases.items(), key=lambda kv: len(kv[0])):
        out = F.when(specifier.startswith(prefix), F.concat(F.lit(target), F.substring(specifier, F.lit(len(prefix) + 1), F.length(specifier)))).otherwise(out)
    return out


def resolve_modules(imports: DataFrame, files: DataFrame, endings: tuple = MODULE_ENDINGS) -> DataFrame:
    """``imports(import_id, specifier)`` against ``files(path)``: exactly one hit resolves."""
    tried = imports.withColumn("path", F.explode(F.array(*[F.concat("specifier", F.lit(e)) for e in endings])))
    hits = tried.join(files.select("path").distinct(), "path").groupBy("import_id").agg(F.count(F.lit(1)).alias("hits"), F.min("path").alias("path"))
    return imports.join(hits, "import_id", "left").select(
        "import_id", "specifier", F.when(F.col("hits") == 1, F.col("path")).alias("path"),
        F.when(F.col("hits").isNull(), "missing").when(F.col("hits") > 1, "ambiguous").otherwise("resolved").alias("reason"),
    )


def stable_bindings(bindings: DataFrame) -> DataFrame:
    """Names bound exactly once in their module and never written: ``bindings(module, name, mutated, constant)``."""
    return bindings.groupBy("module", "name").agg(
        F.count(F.lit(1)).alias("bindings"), F.bool_or("mutated").alias("mutated"), F.bool_and("constant").alias("constant")
    ).withColumn("stable", (F.col("bindings") == 1) & ~F.col("mutated") & F.col("constant"))


def resolve_symbols(refs: DataFrame, declarations: DataFrame, imports: DataFrame, exports: DataFrame) -> DataFrame:
    """Local declaration first, else one hop over import and export.

    refs(ref_id, module, name); declarations(module, name, target, stable); imports(module, name, source,
    imported); exports(module, name, target, reexport). Each side has unique (module, name).
    """
    local = declarations.select("module", "name", F.col("target").alias("_local"), F.col("stable").alias("_stable"))
    incoming = imports.select("module", "name", F.col("source").alias("_source"), F.col("imported").alias("_imported"))
    outgoing = exports.select(F.col("module").alias("_source"), F.col("name").alias("_imported"), F.col("target").alias("_export"), F.col("reexport").alias("_reexport"))
    joined = refs.join(local, ["module", "name"], "left").join(incoming, ["module", "name"], "left").join(outgoing, ["_source", "_imported"], "left")
    reason = (
        F.when(F.col("_stable"), "local").when(F.col("_stable").isNotNull(), "unstable_binding")
        .when(F.col("_source").isNull(), "unbound").when(F.col("_export").isNull(), "not_exported")
        .when(F.col("_reexport"), "reexport_not_followed").otherwise("import")
    )
    target = F.when(reason == "local", F.col("_local")).when(reason == "import", F.col("_export"))
    return joined.select("ref_id", "module", "name", target.alias("target"), reason.alias("reason"))


def incoming_edges(calls: DataFrame) -> DataFrame:
    """How often and from how many callers each resolved function is called."""
    return calls.where(F.col("target").isNotNull()).groupBy("target").agg(F.count(F.lit(1)).alias("calls"), F.count_distinct("caller").alias("callers"))


def route_join(uses: DataFrame, routes: DataFrame, disabled: bool = False) -> DataFrame:
    """Literal URL and method of a use against routes(url, method, target); every failure has a reason.

    ``disabled`` voids all of them: the global fetch is written somewhere.
    """
    table = routes.groupBy("url", "method").agg(F.count_distinct("target").alias("_n"), F.min("target").alias("_target"))
    reason = (
        F.when(F.lit(disabled), "global_fetch_written").when(F.col("url").isNull(), "dynamic_url").when(~F.col("url").startswith("/"), "external_url")
        .when(~F.col("method").isin("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"), "unknown_method")
        .when(F.col("_n").isNull(), "no_route").when(F.col("_n") > 1, "ambiguous_route").otherwise("resolved")
    )
    return uses.join(table, ["url", "method"], "left").withColumn("reason", reason).withColumn(
        "target", F.when(F.col("reason") == "resolved", F.col("_target"))
    ).drop("_n", "_target")


def attribute_callbacks(attributes: DataFrame) -> DataFrame:
    """JSX callbacks: the last attribute of a name wins, and a later spread voids it.

    ``attributes`` has element, position, name (null for a spread) and target.
    """
    named = attributes.where(F.col("name").isNotNull()).groupBy("element", "name").agg(F.max_by(F.struct("position", "target"), "position").alias("l"))
    spreads = attributes.where(F.col("name").isNull()).groupBy("element").agg(F.max("position").alias("_spread"))
    return named.join(spreads, "element", "left").where(F.col("name").rlike("^on[A-Z]")).select(
        "element", "name", F.when(F.coalesce(F.col("_spread") > F.col("l.position"), F.lit(False)), F.lit(None)).otherwise(F.col("l.target")).alias("target"),
        F.when(F.coalesce(F.col("_spread") > F.col("l.position"), F.lit(False)), "voided_by_spread").otherwise("resolved").alias("reason"),
    )


def outside_roots(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Test files under none of the static roots. A file explodes into its own prefixes, so this is an equi-join."""
    parts = F.split("path", "/")
    prefixes = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("root"))
    covered = prefixes.join(roots, "root").select("path").distinct()
    return files.join(covered, "path", "left_anti")


def constant_strings(constants: DataFrame, hops: int = 8) -> DataFrame:
    """(name, value, hops, state): the literal that ``constants(name, literal, alias)`` leads to.

    A name with a literal stands for itself. state is ``resolved``; ``depth_limit`` where the literal is more than
    ``hops`` aliases away; ``unresolved`` where the chain ends without one; or ``cycle``, with null hops.
    """
    kept = written(constants.select("name", "literal", F.when(F.col("literal").isNull(), F.col("alias")).alias("next")))
    found = follow_chains(kept.select("name", "next"))
    literals = kept.where(F.col("literal").isNotNull()).select(F.col("name").alias("end"), "literal")
    joined = lookup_join(found.where(F.col("end").isNotNull()), literals, "end", how="left")
    far = F.col("steps") > hops
    state = F.when(F.col("literal").isNull(), "unresolved").when(far, "depth_limit").otherwise("resolved")
    rows = joined.select("name", F.when(~far, F.col("literal")).alias("value"), F.col("steps").alias("hops"), state.alias("state"))
    loops = found.where(F.col("end").isNull()).select("name", F.lit(None).cast("string").alias("value"), F.col("steps").alias("hops"), "state")
    return rows.unionByName(loops)


def inherited_options(configs: DataFrame, depth: int = 8) -> DataFrame:
    """Effective options per config: nearest definition over the ``extends`` chain wins, cycles are flagged.

    ``configs`` has path, extends and options (map).
    """
    base = configs.select("path", F.col("extends").alias("next"), "options", F.array("path").alias("seen"), F.lit("complete").alias("state"))
    parent = configs.select(F.col("path").alias("next"), F.col("extends").alias("_next"), F.col("options").alias("_options"))
    for _ in range(depth):
        joined = base.join(parent, "next", "left")
        cycle = F.array_contains("seen", F.col("next"))
        follow = F.col("next").isNotNull() & ~F.coalesce(cycle, F.lit(False)) & F.col("_options").isNotNull()
        merged = F.map_concat(F.map_filter("_options", lambda k, v: ~F.map_contains_key("options", k)), F.col("options"))
        base = joined.select(
            "path", F.when(follow, merged).otherwise(F.col("options")).alias("options"),
            F.when(follow, F.concat("seen", F.array("next"))).otherwise(F.col("seen")).alias("seen"),
            F.when(F.col("state") != "complete", F.col("state")).when(F.coalesce(cycle, F.lit(False)), "cycle")
            .when(F.col("next").isNotNull() & F.col("_options").isNull(), "missing_base").otherwise("complete").alias("state"),
            F.when(follow, F.col("_next")).alias("next"),
        )
    return base.select("path", "options", "seen", F.when((F.col("state") == "complete") & F.col("next").isNotNull(), "depth_limit").otherwise(F.col("state")).alias("state"))
