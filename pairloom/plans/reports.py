"""Report views over cells: one document is one pack, each function question one cell.

Run outcomes and answers are derived from hashes, so every rung of the status ladder occurs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom import constants as K
from pairloom.functions import measures as M
from pairloom.functions import text as T
from pairloom.operators import report as R
from pairloom.operators.ordered import ranked
from pairloom.plans import bindings as B
from pairloom.plans.statistics import D
from pairloom.session import cut_lineage
from pairloom.sources.tables import table

QUERIES: dict = {}
FUNCTION_SIGNALS = [(i, s) for i, s in enumerate(K.SIGNALS) if "function" in s[1]]


def packs(spark, folder):
    """One pack per document with its omissions and the outcome of its request."""
    u = lambda tag: T.unit_hash(F.lit(tag), F.col("unit_id"))
    omission = lambda reason, decisive: F.struct(F.lit(reason).alias("reason"), F.lit(decisive).alias("decisive"))
    omitted = F.array_compact(
        F.array(
            F.when(F.col("bytes") > K.MAX_REQUEST_BYTES, omission("request_byte_cap", True)),
            F.when(u("om1") < 0.05, omission("import_declaration_cap", True)),
            F.when(u("om2") < 0.10, omission("caller_cap", False)),
        )
    )
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").alias("unit_id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"),
        "lang", T.line_count(F.col("text")).alias("lines"), F.octet_length("text").cast("bigint").alias("bytes"),
    )
    run = F.when(u("run") < 0.1, F.lit(None).cast("string")).when(u("run") < 0.2, "failed").otherwise("succeeded")
    return docs.withColumn("omitted", omitted).withColumn("event_status", run).withColumn("pack_id", F.col("unit_id"))


def with_answers(rows):
    """Three-way answers per (pack, question), near ties included."""
    h = lambda tag: T.unit_hash(F.lit(tag), F.col("unit_id"), F.col("signal_id"))
    p = F.col("p")
    out = rows.withColumn("p", T.two_decimals(h("p")))
    out = out.withColumn("q0", T.two_decimals((F.lit(1.0) - p) * F.lit(0.71))).withColumn("r0", T.two_decimals((F.lit(1.0) - p) * F.lit(0.29)))
    out = out.withColumn("swap", h("swap") < 0.15)
    out = out.withColumn("q", F.when(F.col("swap"), F.col("r0")).otherwise(F.col("q0"))).withColumn("r", F.when(F.col("swap"), F.col("q0")).otherwise(F.col("r0")))
    top = F.greatest("p", "q", "r")
    choice = (
        F.when(h("ans") < 0.03, F.lit(None).cast("string"))
        .when(F.col("p") >= top - F.lit(0.011), F.col("presence"))
        .when(F.col("q") >= top, "absent")
        .otherwise("insufficient")
    )
    probabilities = F.create_map(F.col("presence"), F.col("p"), F.lit("absent"), F.col("q"), F.lit("insufficient"), F.col("r"))
    return out.withColumn("choice", choice).withColumn("confidence", top).withColumn("probabilities", probabilities).drop("q0", "r0", "swap")


def cells(spark, folder):
    asked = packs(spark, folder).withColumn("missing", R.missing_reasons(F.col("omitted")))
    spread = asked.select("*", F.explode(R.signal_array("function")).alias("s")).select(
        "pack_id", "unit_id", "path", "lang", "lines", "event_status", "missing", "s.*"
    )
    return R.finish_cells(with_answers(spread))


_h = lambda tag: B.sql_unit_hash(f"'{tag}'", "unit_id", "signal_id")
_u = lambda tag: B.sql_unit_hash(f"'{tag}'", "unit_id")
SQL_SIGNALS = B.sql_values([(i, s[0], s[2], s[3], s[4], s[5], s[6]) for i, s in FUNCTION_SIGNALS], "position, signal_id, presence, signal_status, cut, floor, has_filter")
SQL_CELLS = f"""pk0 AS (SELECT doc_id AS unit_id, doc_id AS pack_id, source || '/' || doc_id AS path, lang, {B.sql_lines('text')} AS lines,
  octet_length(encode(text)) AS bytes FROM documents),
pk AS (SELECT *, bytes > {K.MAX_REQUEST_BYTES} AS o0, {_u('om1')} < {D(0.05)} AS o1, {_u('om2')} < {D(0.1)} AS o2,
  CASE WHEN {_u('run')} < {D(0.1)} THEN NULL WHEN {_u('run')} < {D(0.2)} THEN 'failed' ELSE 'succeeded' END AS event_status FROM pk0),
sg AS (SELECT * FROM {SQL_SIGNALS}),
c0 AS (SELECT pk.*, sg.*, {B.sql_two(_h('p'))} AS p FROM pk, sg),
c1 AS (SELECT *, {B.sql_two(f'({D(1)} - p) * {D(0.71)}')} AS q0, {B.sql_two(f'({D(1)} - p) * {D(0.29)}')} AS r0, {_h('swap')} < {D(0.15)} AS sw FROM c0),
c2 AS (SELECT *, CASE WHEN sw THEN r0 ELSE q0 END AS q, CASE WHEN sw THEN q0 ELSE r0 END AS r FROM c1),
c3 AS (SELECT *, greatest(p, q, r) AS top, o0 OR o1 AS blocked,
  array_to_string(list_filter([CASE WHEN o1 THEN 'import_declaration_cap' END, CASE WHEN o0 THEN 'request_byte_cap' END], lambda x: x IS NOT NULL), ',') AS missing_reasons FROM c2),
c4 AS (SELECT *, CASE WHEN blocked OR event_status IS NULL OR event_status = 'failed' THEN NULL WHEN {_h('ans')} < {D(0.03)} THEN NULL
  WHEN p >= top - {D(0.011)} THEN presence WHEN q >= top THEN 'absent' ELSE 'insufficient' END AS choice FROM c3),
c5 AS (SELECT *, CASE WHEN blocked THEN 'insufficient_context' WHEN event_status IS NULL THEN 'unattempted' WHEN event_status = 'failed' THEN 'error'
  WHEN choice IS NULL THEN 'unanswered' WHEN choice = 'insufficient' THEN 'model_insufficient' ELSE 'scored' END AS cell_status,
  CASE WHEN choice IS NULL THEN FALSE ELSE (CASE WHEN choice = presence THEN p WHEN choice = 'absent' THEN q ELSE r END) < top - {D('1e-9')} END AS near_tie FROM c4),
c6 AS (SELECT *, CASE WHEN cell_status = 'scored' THEN p END AS p_positive FROM c5),
cells AS (SELECT *, CASE WHEN p_positive IS NULL THEN NULL WHEN p_positive >= cut THEN 'worth_a_look' WHEN p_positive >= floor THEN 'uncertain' ELSE 'below' END AS band,
  coalesce(p_positive >= cut, FALSE) AS shown FROM c6)"""


def cells_status_ladder(spark, folder):
    return cells(spark, folder).select(
        "unit_id", "signal_id", "cell_status", "choice", "near_tie", F.when(F.col("choice").isNotNull(), F.col("confidence")).alias("confidence"),
        "p_positive", "cut", "floor", "band", "shown", F.array_join("missing", ",").alias("missing_reasons"),
    )


QUERIES["cells_status_ladder"] = (
    cells_status_ladder,
    f"""WITH {SQL_CELLS} SELECT unit_id, signal_id, cell_status, choice, near_tie, CASE WHEN choice IS NOT NULL THEN top END AS confidence, p_positive, cut, floor, band, shown, missing_reasons FROM cells""",
)


def status_counts(spark, folder):
    return cells(spark, folder).groupBy("cell_status").agg(F.count(F.lit(1)).alias("cells"))


QUERIES["status_counts"] = (status_counts, f"WITH {SQL_CELLS} SELECT cell_status, CAST(count(*) AS BIGINT) AS cells FROM cells GROUP BY 1")


def band_counts(spark, folder):
    """Three bands, zero when empty."""
    one = cells(spark, folder).agg(*[F.count_if(F.col("band") == b).cast("bigint").alias(b) for b in ("worth_a_look", "uncertain", "below")])
    return one.select(F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).alias("cells")) for b in ("worth_a_look", "uncertain", "below")])).alias("x")).select("x.*")


QUERIES["band_counts"] = (
    band_counts,
    f"WITH {SQL_CELLS} SELECT b.band, CAST(count(cells.unit_id) AS BIGINT) AS cells FROM (VALUES ('worth_a_look'), ('uncertain'), ('below')) AS b(band) LEFT JOIN cells ON cells.band = b.band GROUP BY b.band",
)


def signal_summary(spark, folder):
    return cells(spark, folder).groupBy("signal_id").agg(
        F.count_if(F.col("cell_status") == "scored").cast("bigint").alias("scored"), F.count_if("shown").cast("bigint").alias("at_or_above_cut"),
        F.count_if(F.col("band") == "uncertain").cast("bigint").alias("uncertain"),
        F.count_if(F.col("cell_status").isin("insufficient_context", "model_insufficient")).cast("bigint").alias("insufficient"),
    )


QUERIES["signal_summary"] = (
    signal_summary,
    f"""WITH {SQL_CELLS} SELECT signal_id, CAST(count_if(cell_status = 'scored') AS BIGINT) AS scored, CAST(count_if(shown) AS BIGINT) AS at_or_above_cut,
  CAST(count_if(coalesce(band = 'uncertain', FALSE)) AS BIGINT) AS uncertain, CAST(count_if(cell_status IN ('insufficient_context', 'model_insufficient')) AS BIGINT) AS insufficient FROM cells GROUP BY 1""",
)


def near_ties(spark, folder):
    c = cells(spark, folder).where("near_tie")
    return c.select("unit_id", "signal_id", "cell_status", "choice", F.col("probabilities")[F.col("choice")].alias("choice_probability"), F.col("confidence").alias("maximum_probability"), "p_positive", "shown")


QUERIES["near_ties"] = (
    near_ties,
    f"""WITH {SQL_CELLS} SELECT unit_id, signal_id, cell_status, choice, CASE WHEN choice = presence THEN p WHEN choice = 'absent' THEN q ELSE r END AS choice_probability,
  top AS maximum_probability, p_positive, shown FROM cells WHERE near_tie""",
)


def abstentions(spark, folder):
    return cells(spark, folder).where(F.col("cell_status") != "scored").select("unit_id", "signal_id", "cell_status", F.array_join("missing", ",").alias("missing_reasons"))


QUERIES["abstentions"] = (abstentions, f"WITH {SQL_CELLS} SELECT unit_id, signal_id, cell_status, missing_reasons FROM cells WHERE cell_status <> 'scored'")


def views_per_signal(spark, folder):
    return R.views(cells(spark, folder).select("signal_id", "pack_id", "p_positive", "choice", "band", "cell_status")).drop("cell_status")


QUERIES["views_per_signal"] = (
    views_per_signal,
    f"""WITH {SQL_CELLS} SELECT signal_id, pack_id, p_positive, choice, band, CAST(row_number() OVER (PARTITION BY signal_id ORDER BY p_positive DESC, pack_id) AS BIGINT) AS rank
FROM cells WHERE cell_status = 'scored'""",
)


def findings_queue(spark, folder):
    return R.queue(cells(spark, folder).select("signal_id", "position", "pack_id", "path", "p_positive", "band"))


SQL_QUEUE = f"""{SQL_CELLS}, qu AS (SELECT signal_id, position, pack_id, path, p_positive, band, CAST(CASE WHEN band = 'worth_a_look' THEN 0 ELSE 1 END AS BIGINT) AS part FROM cells WHERE band IN ('worth_a_look', 'uncertain'))"""
QUERIES["findings_queue"] = (
    findings_queue,
    f"WITH {SQL_QUEUE} SELECT *, CAST(row_number() OVER (ORDER BY part, position, p_positive DESC, pack_id) AS BIGINT) AS number FROM qu",
)


def queue_groups(spark, folder):
    """Runs of equal question in the queue: after ordering they are plain groups."""
    return R.queue_runs(cells(spark, folder).select("signal_id", "position", "band"))


QUERIES["queue_groups"] = (
    queue_groups,
    f"""WITH {SQL_QUEUE}, n AS (SELECT *, row_number() OVER (ORDER BY part, position, p_positive DESC, pack_id) AS number FROM qu)
SELECT part, signal_id, CAST(count(*) AS BIGINT) AS items, CAST(min(number) AS BIGINT) AS first_number, CAST(max(number) AS BIGINT) AS last_number FROM n GROUP BY 1, 2""",
)


def findings(spark, folder):
    """Shown cells with the omissions of their pack and what a reader should verify."""
    shown = cells(spark, folder).where("shown").select("unit_id", "pack_id", "signal_id", "signal_status", "presence", "choice", "p_positive", "cut", "floor", "band")
    extra = packs(spark, folder).select("pack_id", "path", "bytes", F.array_join(F.transform("omitted", lambda o: o["reason"]), ",").alias("context_omissions"))
    return shown.join(extra, "pack_id")


QUERIES["findings"] = (
    findings,
    f"""WITH {SQL_CELLS} SELECT unit_id, pack_id, signal_id, signal_status, presence, choice, p_positive, cut, floor, band, path, CAST(bytes AS BIGINT) AS bytes,
  array_to_string(list_filter([CASE WHEN o0 THEN 'request_byte_cap' END, CASE WHEN o1 THEN 'import_declaration_cap' END, CASE WHEN o2 THEN 'caller_cap' END], lambda x: x IS NOT NULL), ',') AS context_omissions
FROM cells WHERE shown""",
)


def blocks_nested(spark, folder):
    """One nested row per unit: its questions with status and band, in catalog order (at most eight)."""
    rows = cells(spark, folder)
    entry = F.struct("position", "signal_id", "cell_status", "band")
    blocks = rows.groupBy("unit_id", "path").agg(F.array_sort(F.collect_list(entry)).alias("signals"))
    text = F.array_join(F.transform("signals", lambda s: F.concat_ws(":", s["signal_id"], s["cell_status"], F.coalesce(s["band"], F.lit("-")))), ";")
    return blocks.select("unit_id", "path", F.size("signals").cast("bigint").alias("n"), text.alias("signals"))


QUERIES["blocks_nested"] = (
    blocks_nested,
    f"""WITH {SQL_CELLS} SELECT unit_id, path, CAST(count(*) AS BIGINT) AS n, string_agg(signal_id || ':' || cell_status || ':' || coalesce(band, '-'), ';' ORDER BY position) AS signals FROM cells GROUP BY 1, 2""",
)

NEW_CUTS = {"deep_nesting": 0.4, "unreachable_code": 0.9}
NEW_FLOORS = {"deep_nesting": 0.1}


def rescore_bands(spark, folder):
    """Stored scores under other cuts and floors."""
    stored = cells(spark, folder).select("unit_id", "signal_id", "p_positive")
    bounds = R.resolve_thresholds(R.signal_table(spark), NEW_CUTS, NEW_FLOORS).select("signal_id", "cut", "floor")
    # The dimension has nine rows.
    return stored.join(F.broadcast(bounds), "signal_id").withColumn("band", M.band(F.col("p_positive"), F.col("cut"), F.col("floor")))


def _case(values: dict, default: str) -> str:
    return "CASE signal_id " + " ".join(f"WHEN '{k}' THEN {D(v)}" for k, v in values.items()) + f" ELSE {default} END"


QUERIES["rescore_bands"] = (
    rescore_bands,
    f"""WITH {SQL_CELLS}, t AS (SELECT unit_id, signal_id, p_positive, {_case(NEW_CUTS, 'cut')} AS nc, floor FROM cells), f AS (SELECT *, {_case(NEW_FLOORS, 'least(floor, nc)')} AS nf FROM t)
SELECT unit_id, signal_id, p_positive, nc AS cut, nf AS floor, CASE WHEN p_positive IS NULL THEN NULL WHEN p_positive >= nc THEN 'worth_a_look' WHEN p_positive >= nf THEN 'uncertain' ELSE 'below' END AS band FROM f""",
)


def resolved_thresholds(spark, folder):
    """Bounds in force per question, with the number of stored scores each one shows."""
    shown = rescore_bands(spark, folder).groupBy("signal_id", "cut", "floor").agg(F.count_if(F.col("band") == "worth_a_look").cast("bigint").alias("shown"))
    return shown


QUERIES["resolved_thresholds"] = (
    resolved_thresholds,
    f"""WITH {SQL_CELLS}, t AS (SELECT signal_id, p_positive, {_case(NEW_CUTS, 'cut')} AS nc, floor FROM cells), f AS (SELECT *, {_case(NEW_FLOORS, 'least(floor, nc)')} AS nf FROM t)
SELECT signal_id, nc AS cut, nf AS floor, CAST(count_if(coalesce(p_positive >= nc, FALSE)) AS BIGINT) AS shown FROM f GROUP BY 1, 2, 3""",
)


# --- question to pack -------------------------------------------------------------------------------

def question_eligibility(spark, folder):
    """Per pack: missing reasons, and whether any question may be asked."""
    rows = packs(spark, folder).withColumn("missing", R.missing_reasons(F.col("omitted")))
    return rows.select("pack_id", F.when(F.size("missing") > 0, "insufficient_context").otherwise("eligible").alias("eligibility"), F.array_join("missing", ",").alias("missing_reasons"))


QUERIES["question_eligibility"] = (
    question_eligibility,
    f"WITH {SQL_CELLS} SELECT DISTINCT pack_id, CASE WHEN blocked THEN 'insufficient_context' ELSE 'eligible' END AS eligibility, missing_reasons FROM cells",
)


def pack_signals(spark, folder):
    """Which questions apply: by kind, by the three-valued cue, and by an optional subset of a split pack."""
    u = lambda tag: T.unit_hash(F.lit(tag), F.col("pack_id"))
    rows = packs(spark, folder).select(
        "pack_id", F.when(F.col("lines") >= 40, "function_chunk").otherwise("function").alias("kind"),
        F.when(u("cue") < 0.3, F.lit(None).cast("boolean")).otherwise(u("cue") < 0.6).alias("absent"), (u("sub") < 0.1).alias("split"),
    )
    kinds = F.create_map(*[x for s in K.SIGNALS for x in (F.lit(s[0]), F.array(*[F.lit(k) for k in s[1]]))])
    spread = rows.select("*", F.explode(R.signal_array()).alias("s")).where(
        F.array_contains(kinds[F.col("s.signal_id")], F.col("kind")) & T.applies_to_unit(F.col("s.has_filter"), F.col("absent"))
        & (~F.col("split") | (F.col("s.position") < 4))
    )
    return spread.select("pack_id", "kind", F.col("s.signal_id").alias("signal_id"))


QUERIES["pack_signals"] = (
    pack_signals,
    f"""WITH p AS (SELECT doc_id AS pack_id, CASE WHEN {B.sql_lines('text')} >= 40 THEN 'function_chunk' ELSE 'function' END AS kind,
  CASE WHEN {B.sql_unit_hash("'cue'", 'doc_id')} < {D(0.3)} THEN NULL ELSE {B.sql_unit_hash("'cue'", 'doc_id')} < {D(0.6)} END AS absent, {B.sql_unit_hash("'sub'", 'doc_id')} < {D(0.1)} AS split FROM documents),
k AS (SELECT * FROM {B.sql_values([(i, s[0], k, s[6]) for i, s in enumerate(K.SIGNALS) for k in s[1]], 'position, signal_id, kind, has_filter')})
SELECT pack_id, kind, signal_id FROM p JOIN k USING (kind) WHERE (NOT has_filter OR coalesce(absent, TRUE)) AND (NOT split OR position < 4)""",
)


def unpacked_units(spark, folder):
    """Units beyond the unit cap still show up, one cell per question with that disposition."""
    order = ranked(packs(spark, folder).select("unit_id"), [], ["unit_id"], name="place")
    over = order.where(F.col("place") > UNIT_CAP).select("unit_id", F.explode(R.signal_array("function")).alias("s"))
    return over.select("unit_id", F.col("s.signal_id").alias("signal_id"), F.lit("not_packed_candidate_limit").alias("cell_status"))


UNIT_CAP = K.MAX_UNITS
QUERIES["unpacked_units"] = (
    unpacked_units,
    f"""WITH o AS (SELECT doc_id AS unit_id, row_number() OVER (ORDER BY doc_id) AS place FROM documents)
SELECT unit_id, signal_id, 'not_packed_candidate_limit' AS cell_status FROM o, {SQL_SIGNALS} WHERE place > {UNIT_CAP}""",
)


def first_failure(spark, folder):
    """Earliest failed request per language."""
    failed = packs(spark, folder).where(F.col("event_status") == "failed")
    return failed.groupBy("lang").agg(F.min_by(F.struct("unit_id", "path", "bytes"), "unit_id").alias("f")).select("lang", "f.*")


QUERIES["first_failure"] = (
    first_failure,
    f"WITH {SQL_CELLS} SELECT lang, min(unit_id) AS unit_id, arg_min(path, unit_id) AS path, CAST(arg_min(bytes, unit_id) AS BIGINT) AS bytes FROM pk WHERE event_status = 'failed' GROUP BY lang",
)


# --- length baseline --------------------------------------------------------------------------------

BASELINE_SIGNAL = "function_should_split"


def baseline_units(spark, folder):
    return cells(spark, folder).where(F.col("signal_id") == BASELINE_SIGNAL).select("unit_id", "lines", F.col("p_positive").alias("p"), "cell_status")


def length_vs_score_ranks(spark, folder):
    return R.length_and_score_ranks(cut_lineage(baseline_units(spark, folder).drop("cell_status")))


SQL_RANKS = f"""{SQL_CELLS}, bu AS (SELECT unit_id, lines, p_positive AS p, cell_status FROM cells WHERE signal_id = '{BASELINE_SIGNAL}'),
lr AS (SELECT *, row_number() OVER (ORDER BY lines DESC, unit_id) AS length_rank FROM bu), sr AS (SELECT unit_id, row_number() OVER (ORDER BY p DESC, unit_id) AS score_rank FROM bu WHERE p IS NOT NULL),
rk AS (SELECT lr.*, score_rank FROM lr LEFT JOIN sr USING (unit_id))"""
QUERIES["length_vs_score_ranks"] = (
    length_vs_score_ranks,
    f"WITH {SQL_RANKS} SELECT unit_id, lines, p, CAST(length_rank AS BIGINT) AS length_rank, CAST(score_rank AS BIGINT) AS score_rank FROM rk",
)


def topn_overlap(spark, folder):
    """Units among both the longest and the best scored."""
    ranks = length_vs_score_ranks(spark, folder)
    return ranks.where((F.col("length_rank") <= TOP) & (F.col("score_rank") <= TOP)).select("unit_id", "length_rank", "score_rank")


TOP = 100
QUERIES["topn_overlap"] = (
    topn_overlap,
    f"WITH {SQL_RANKS} SELECT unit_id, CAST(length_rank AS BIGINT) AS length_rank, CAST(score_rank AS BIGINT) AS score_rank FROM rk WHERE length_rank <= {TOP} AND score_rank <= {TOP}",
)


def baseline_census(spark, folder):
    rows = baseline_units(spark, folder)
    return rows.agg(
        F.count(F.lit(1)).alias("function_blocks"), F.count_if(F.col("lines") >= 1).cast("bigint").alias("located"),
        F.count("p").alias("scored"), F.count_if(F.col("p").isNull()).cast("bigint").alias("gaps"),
    )


QUERIES["baseline_census"] = (
    baseline_census,
    f"WITH {SQL_RANKS} SELECT CAST(count(*) AS BIGINT) AS function_blocks, CAST(count_if(lines >= 1) AS BIGINT) AS located, CAST(count(p) AS BIGINT) AS scored, CAST(count_if(p IS NULL) AS BIGINT) AS gaps FROM bu",
)


def baseline_gaps(spark, folder):
    rows = baseline_units(spark, folder).where(F.col("p").isNull())
    return rows.select("unit_id", F.concat(F.lit(f"{BASELINE_SIGNAL} not scored ("), "cell_status", F.lit("); no P imputed")).alias("reason"))


QUERIES["baseline_gaps"] = (
    baseline_gaps,
    f"WITH {SQL_RANKS} SELECT unit_id, '{BASELINE_SIGNAL} not scored (' || cell_status || '); no P imputed' AS reason FROM bu WHERE p IS NULL",
)


def eval_cell_reduction(spark, folder):
    """Per case (project and question): best score of its scored cells, any near tie, else a status."""
    rows = cells(spark, folder).withColumn("case_id", F.split("path", "/")[0])
    scored = F.col("cell_status") == "scored"
    return rows.groupBy("case_id", "signal_id").agg(
        F.when(F.count_if(scored) > 0, "scored").otherwise(F.min("cell_status")).alias("case_status"),
        F.max("p_positive").alias("p"), F.coalesce(F.bool_or(F.when(scored, F.col("near_tie"))), F.lit(False)).alias("near_tie"),
    )


QUERIES["eval_cell_reduction"] = (
    eval_cell_reduction,
    f"""WITH {SQL_CELLS} SELECT split_part(path, '/', 1) AS case_id, signal_id, CASE WHEN count_if(cell_status = 'scored') > 0 THEN 'scored' ELSE min(cell_status) END AS case_status,
  max(p_positive) AS p, coalesce(bool_or(CASE WHEN cell_status = 'scored' THEN near_tie END), FALSE) AS near_tie FROM cells GROUP BY 1, 2""",
)


def display_lines(spark, folder):
    """Queue lines as text: number, safe path, question and score."""
    q = R.queue(cells(spark, folder).select("signal_id", "position", "pack_id", "path", "p_positive", "band"))
    head = T.safe_display(F.concat(F.col("path"), F.lit("`<"), F.col("signal_id"), F.lit(">")))
    return q.select("number", F.concat_ws(" ", F.concat(F.col("number").cast("string"), F.lit(".")), head, M.percent(F.col("p_positive"))).alias("line"))


QUERIES["display_lines"] = (
    display_lines,
    f"""WITH {SQL_QUEUE}, n AS (SELECT *, row_number() OVER (ORDER BY part, position, p_positive DESC, pack_id) AS number FROM qu)
SELECT CAST(number AS BIGINT) AS number, number || '. ' || path || '  ' || signal_id || '  ' || CAST(CAST(floor(p_positive * 100 + {D(0.5)}) AS BIGINT) AS VARCHAR) || '%' AS line FROM n""",
)
