"""Source trees, JSON documents and logs as DataFrames, and sinks that never overwrite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom import constants as K
from pairloom import schemas
from pairloom.functions import text as T
from pairloom.operators.admission import admit_in_order
from pairloom.sources.lines import parsed_lines


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def snapshot(
    spark: SparkSession,
    root: str,
    excluded: list[str] = (),
    scope: list[str] = (),
    include_content: bool = True,
    max_total_bytes: int | None = None,
    max_files: int | None = None,
    max_file_bytes: int | None = None,
) -> DataFrame:
    """One row per file below ``root`` with exactly one status; text only where the status is ``read``.

    The listing is filtered by path before any content is read; executors read and check the rest. Caps, where given
    (constants.py has the usual ones), admit or skip files in path order; without caps every file is read.
    """
    prefix = root.rstrip("/") + "/"
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    place = F.instr("path", prefix)
    path = F.when(place > 0, F.expr(f"substring(path, instr(path, {_literal(prefix)}) + {len(prefix)})")).otherwise(F.col("path"))
    listed = listing.select(path.alias("path"), F.col("length").alias("bytes"), "content")
    p = F.col("path")
    in_scope = T.under_any(p, list(scope)) if scope else F.lit(True)
    early = F.when(~T.is_source_path(p), "non_source").when(~in_scope, "outside_paths").when(~T.is_admissible(p, list(excluded)), "excluded_path")
    entries = listed.withColumn("early", early)
    if max_total_bytes is None and max_files is None and max_file_bytes is None:
        checked = entries.withColumn("admitted", F.col("early").isNull())
    else:
        most = (1 << 62) if max_total_bytes is None else max_total_bytes
        fits = admit_in_order(entries.where(F.col("early").isNull()).select("path", "bytes"), ["path"], "bytes", most, max_files, max_file_bytes)
        checked = entries.join(fits.select("path", "admitted"), "path", "left")
    raw = F.col("content")
    text = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    read = checked.withColumn("text", F.when(F.col("admitted"), text))
    status = (
        F.when(F.col("early").isNotNull(), F.col("early"))
        .when(~F.col("admitted"), "file_or_byte_limit")
        .when(F.col("text").isNull() | F.contains("text", F.lit("\0")), "binary_or_invalid_utf8")
        .when(F.size(T.secret_kinds(F.col("text"))) > 0, "potential_secret_no_content_stored")
        .when(T.is_generated(F.col("text")), "generated")
        .otherwise("read")
    )
    out = read.withColumn("status", status)
    kept = F.col("status") == "read"
    columns = ["path", "status", F.when(kept, F.sha2("content", 256)).alias("sha256"), F.when(kept, F.col("bytes")).alias("bytes")]
    if include_content:
        columns.append(F.when(kept, F.col("text")).alias("text"))
    return out.select(*columns)


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """A JSONL event log; a line that does not parse fails the read."""
    return spark.read.schema(schemas.JOURNAL).option("mode", "FAILFAST").json(path)


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    """One question per JSON file."""
    return spark.read.schema(schemas.SIGNAL).option("multiLine", "true").json(path)


def catalog_differences(signals: DataFrame, order: DataFrame) -> DataFrame:
    """Ids on one side only of the question files and the catalog order."""
    both = signals.select("id", F.lit(True).alias("f")).join(order.select("id", F.lit(True).alias("o")), "id", "full")
    return both.where(F.col("f").isNull() | F.col("o").isNull()).select("id", F.when(F.col("f").isNull(), "file_missing").otherwise("not_in_catalog").alias("problem"))


def journal_line_problems(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, entry, value) of the lines of JSONL event logs that are no events."""
    rows, torn = parsed_lines(spark, path, schemas.JOURNAL)
    unnamed = rows.where(F.col("seq").isNull() | F.col("type").isNull())
    blank = F.lit(None).cast("bigint"), F.lit(None).cast("string")
    return torn.unionByName(unnamed.select("file", "line", blank[0].alias("entry"), blank[1].alias("value")))


def read_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Evaluation cases of JSONL files with file and line, and the malformed lines: (file, line, entry, value).

    A case without an id is malformed too; its entry and value are null.
    """
    rows, torn = parsed_lines(spark, path, schemas.CASE)
    unnamed = rows.where(F.col("id").isNull()).select("file", "line", F.lit(None).cast("bigint").alias("entry"), F.lit(None).cast("string").alias("value"))
    return rows.where(F.col("id").isNotNull()), torn.unionByName(unnamed)


def read_label_files(spark: SparkSession, path: str) -> DataFrame:
    """Label files of all three schemas, ready for ``normalise_labels``."""
    rows = spark.read.schema(schemas.LABEL_FILE).option("multiLine", "true").json(path)
    who = F.when(F.col("schema") == "human-labels/1", F.col("labeler")).when(F.col("schema") == "eval-labels/1", F.col("who")).otherwise(F.coalesce("reviewer", F.lit("unknown")))
    cards = F.transform("cards", lambda c: F.struct(c["cardId"].alias("card_id"), F.transform(c["evaluations"], lambda e: F.struct(e["signalId"].alias("signal_id"), e["label"].alias("label"), e["rationale"].alias("rationale"))).alias("evaluations")))
    labels = F.transform("labels", lambda l: F.struct(l["cardId"].alias("card_id"), l["signalId"].alias("signal_id"), l["label"].alias("label"), l["note"].alias("note")))
    return rows.select(F.col("_metadata.file_path").alias("path"), "schema", F.col("sourceType").alias("source_type"), who.alias("who"), cards.alias("cards"), labels.alias("labels"))


def external_config_problems(spark: SparkSession, path: str) -> DataFrame:
    """Caller-supplied configuration artifacts that may not be used, with the reason."""
    rows = spark.read.schema(schemas.EXTERNAL_CONFIG).option("multiLine", "true").json(path)
    escapes = F.exists(F.map_keys("files"), lambda p: ~T.is_safe_relative(p))
    problem = (
        F.when(F.col("package").isNull() | F.col("specifier").isNull(), "identity_missing")
        .when(~F.coalesce(F.rlike("version", F.lit(r"^\d+\.\d+\.\d+(?:[-+][0-9A-Za-z.-]+)?$")), F.lit(False)), "version_not_exact")
        .when(~F.coalesce(F.rlike("integrity", F.lit(r"^sha512-[A-Za-z0-9+/]{86}==$")), F.lit(False)), "integrity_invalid")
        .when(escapes, "path_not_contained")
        .when(~F.map_contains_key("files", F.col("entry")), "entry_missing")
    )
    conflict = rows.groupBy("specifier").agg(F.count_distinct("package", "version", "integrity").alias("n")).where(F.col("n") > 1)
    own = rows.withColumn("problem", problem).where(F.col("problem").isNotNull()).select("specifier", "problem")
    return own.unionByName(conflict.select("specifier", F.lit("identity_conflict").alias("problem")))


def write_once(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Write a new output; an existing one is an error, never replaced."""
    df.write.mode("errorifexists").format(fmt).save(path)


def write_report(folder: str, cells: DataFrame, queue: DataFrame, summary: DataFrame) -> None:
    """Report tables below one folder; the queue keeps its numbering."""
    write_once(cells, f"{folder}/cells", "parquet")
    write_once(queue, f"{folder}/queue", "parquet")
    write_once(summary, f"{folder}/summary", "json")
