"""Aggregations, sessions and whole runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from partloom.functions import rules
from partloom.functions.vectors import stand_in_embedding
from partloom.operators import analytics, corrections, reuse, sessions
from partloom.operators.classify import classify_by_similarity, classify_existing
from partloom.operators.mapping import file_verdicts
from partloom.plans import references as reference_plans
from partloom.plans.enrich import enrich
from partloom.plans.process import file_status, process_files, written_sides
from partloom.plans.review import correct, review_candidates
from partloom.plans.standardize import standardize
from partloom.session import scratch_path, written
from partloom.sources.side_tables import crosses_by_mpn
from partloom.streaming.sessions import session_stream
from partloom.streaming.uploads import review_stream, upload_stream
from registry import sqlx
from registry.core import num, query, sql_stamp, stamp
from registry.relational import _LEVELS
from registry.scans import landed_sheets


def _enriched(d):
    return enrich(d.lines, d.quotes, d.aml, d.crosses)


_CATEGORY = {
    "in_scope_total": "inside",
    "previously_quoted": "inside AND item_quoted",
    "meeting_threshold": "inside AND met",
    "crosses_threshold": "inside AND met AND active_cross",
}


def _analytics_joined(enriched: str) -> str:
    parts = []
    for name, test in _CATEGORY.items():
        parts.append(
            f"""SELECT f.file_id, '{name}' AS category, coalesce(c.n, 0) AS parts, CAST(coalesce(s.ear, 0) AS DOUBLE) AS ear
      FROM (SELECT DISTINCT file_id FROM {enriched}) f
      LEFT JOIN (SELECT file_id, count(*) AS n FROM {enriched} WHERE duplication_flag = 'Unique' AND {test} GROUP BY 1) c ON f.file_id = c.file_id
      LEFT JOIN (SELECT file_id, sum(coalesce(ear, 0)) AS ear FROM {enriched} WHERE {test} AND (file_id, item) IN
        (SELECT (file_id, item) FROM {enriched} WHERE duplication_flag = 'Unique' AND {test}) GROUP BY 1) s ON f.file_id = s.file_id"""
        )
    return " UNION ALL ".join(parts)


@query("A1_file_analytics", _analytics_joined("enriched"), "enriched")
def file_analytics(d):
    return analytics.file_analytics(_enriched(d)).withColumn("ear", num("ear"))


@query(
    "A2_category_ear",
    f"SELECT category, CAST(sum(parts) AS BIGINT) AS parts, round(sum(ear), 2) AS ear FROM ({_analytics_joined('enriched')}) GROUP BY 1",
    "enriched",
)
def category_ear(d):
    figures = analytics.file_analytics(_enriched(d)).groupBy("category")
    return figures.agg(F.sum("parts").alias("parts"), F.round(num(F.sum("ear")), 2).alias("ear"))


@query("A3_unique_items", "SELECT file_id, count(DISTINCT item) AS items FROM lines GROUP BY 1", "lines")
def unique_items(d):
    return analytics.unique_item_count(d.lines)


@query(
    "A4_unique_by_scope",
    f"SELECT file_id, {sqlx.norm_scope('scope')} AS scope, count(*) AS items FROM enriched WHERE duplication_flag = 'Unique' GROUP BY 1, 2",
    "enriched",
)
def unique_by_scope(d):
    return analytics.unique_items_by_scope(d.lines)


@query(
    "A5_ear_by_scope",
    f"SELECT file_id, {sqlx.norm_scope('scope')} AS scope, CAST(sum(coalesce(ear, 0)) AS DOUBLE) AS ear FROM enriched GROUP BY 1, 2",
    "enriched",
)
def ear_by_scope(d):
    return analytics.ear_by_scope(_enriched(d)).withColumn("ear", num("ear"))


@query("A6_total_ear", "SELECT file_id, CAST(sum(coalesce(ear, 0)) AS DOUBLE) AS ear FROM enriched GROUP BY 1", "enriched")
def total_ear(d):
    return analytics.total_ear(_enriched(d)).withColumn("ear", num("ear"))


@query(
    "A7_threshold_ear",
    "SELECT file_id, CAST(sum(CASE WHEN inside AND met THEN ear ELSE 0 END) AS DOUBLE) AS ear FROM enriched GROUP BY 1",
    "enriched",
)
def threshold_ear(d):
    return analytics.threshold_ear(_enriched(d)).withColumn("ear", num("ear"))


_LEVEL1 = f"""
SELECT file_id, level1, parts, CAST(total_ear AS DOUBLE) AS total_ear, CAST(in_scope_ear AS DOUBLE) AS in_scope_ear, CAST(threshold_ear AS DOUBLE) AS threshold_ear,
  p AS percent, {sqlx.band('p')} AS band
FROM (SELECT *, {sqlx.percent('total_ear', 'sum(total_ear) OVER (PARTITION BY file_id)')} AS p FROM grouped)
UNION ALL SELECT file_id, 'Total', CAST(sum(parts) AS BIGINT), CAST(sum(total_ear) AS DOUBLE), CAST(sum(in_scope_ear) AS DOUBLE), CAST(sum(threshold_ear) AS DOUBLE), 100.0::DOUBLE, NULL FROM grouped GROUP BY file_id
"""


def _level1_sql() -> str:
    return f"""SELECT * FROM (WITH levels AS ({_LEVELS}), grouped AS (SELECT e.file_id, v.level1, count(DISTINCT trim(item)) AS parts, sum(coalesce(ear, 0)) AS total_ear,
      sum(CASE WHEN inside THEN coalesce(ear, 0) ELSE 0 END) AS in_scope_ear, sum(CASE WHEN inside AND met THEN ear ELSE 0 END) AS threshold_ear
      FROM enriched e JOIN levels v ON e.file_id = v.file_id AND e.commodity IS NOT DISTINCT FROM v.commodity GROUP BY 1, 2) {_LEVEL1})"""


@query("A8_level1_summary", _level1_sql(), "enriched", "ref_last")
def level1(d):
    money = ["total_ear", "in_scope_ear", "threshold_ear"]
    return analytics.level1_summary(_enriched(d), d.refs_plain).withColumns({c: num(c) for c in money})


@query(
    "K6_ranked_levels",
    "SELECT file_id, level1, row_number() OVER (PARTITION BY file_id ORDER BY total_ear DESC, level1) AS rank FROM ("
    + _level1_sql()
    + ") WHERE band IS NOT NULL",
    "enriched",
    "ref_last",
)
def ranked_levels(d):
    ranked = analytics.ranked_levels(analytics.level1_summary(_enriched(d), d.refs_plain))
    return ranked.select("file_id", "level1", F.col("rank").cast("bigint").alias("rank"))


@query("A9_lines_per_commodity", "SELECT file_id, commodity, count(*) AS lines FROM lines GROUP BY 1, 2", "lines")
def per_commodity(d):
    return analytics.lines_per_commodity(d.lines)


@query("A9_distinct_commodities", "SELECT DISTINCT file_id, commodity FROM lines WHERE commodity IS NOT NULL", "lines")
def distinct_commodities(d):
    return analytics.distinct_commodities(d.lines)


@query(
    "A10_scope_shares",
    f"SELECT file_id, scope, CAST(ear AS DOUBLE) AS ear, {sqlx.percent('ear', 'sum(ear) OVER (PARTITION BY file_id)')} AS percent FROM "
    f"(SELECT file_id, {sqlx.norm_scope('scope')} AS scope, sum(coalesce(ear, 0)) AS ear FROM enriched GROUP BY 1, 2)",
    "enriched",
)
def scope_shares(d):
    return analytics.scope_shares(analytics.ear_by_scope(_enriched(d)), "ear").withColumn("ear", num("ear"))


def _user_summary(d):
    return sessions.user_summary(d.users, d.files, sessions.sessions_from_events(d.logins))


@query(
    "A11_user_counters",
    "SELECT user_id, count(file_id) AS uploaded, count(CASE WHEN status = 'completed' THEN 1 END) AS processed FROM users LEFT JOIN files USING (user_id) GROUP BY 1",
    "users",
    "files",
)
def user_counters(d):
    return _user_summary(d).select("user_id", "uploaded", "processed")


@query(
    "A12_last_activity",
    f"""SELECT user_id, {sql_stamp('greatest(last_sign_in_at, f, s)')} AS last_activity FROM users
    LEFT JOIN (SELECT user_id, max(updated_at) AS f FROM files GROUP BY 1) USING (user_id) LEFT JOIN (SELECT user_id, max(started_at) AS s FROM sessions GROUP BY 1) USING (user_id)""",
    "users",
    "files",
    "sessions",
)
def last_activity(d):
    return _user_summary(d).select("user_id", stamp("last_activity").alias("last_activity"))


@query(
    "A13_session_times",
    "SELECT user_id, round(avg(duration_seconds), 6) AS average_seconds, CAST(coalesce(sum(duration_seconds), 0) AS BIGINT) AS total_seconds FROM sessions WHERE ended_at IS NOT NULL GROUP BY 1",
    "sessions",
)
def session_times(d):
    times = sessions.session_times(sessions.sessions_from_events(d.logins))
    return times.withColumn("average_seconds", F.round("average_seconds", 6))


@query(
    "A14_coverage_rates",
    f"""SELECT file_id, rate, part, whole, {sqlx.percent('part', 'whole')} AS percent FROM (
    SELECT NULL::BIGINT AS file_id, 'embedding_coverage' AS rate, count(CASE WHEN id % 3 > 0 THEN 1 END) AS part, count(*) AS whole FROM refs_plain
    UNION ALL SELECT file_id, 'assignment', count(CASE WHEN commodity NOT IN ('Unknown', '') THEN 1 END), count(*) FROM lines GROUP BY 1
    UNION ALL SELECT file_id, 'in_scope', count(CASE WHEN scope = 'In scope' THEN 1 END), count(*) FROM lines GROUP BY 1)""",
    "refs_plain",
    "lines",
)
def coverage(d):
    partly = d.refs.withColumn("embedding", F.when(F.col("id") % 3 > 0, F.col("embedding")))
    return analytics.coverage_rates(d.lines, partly)


@query(
    "A15_run_summary",
    """SELECT file_id, count(CASE WHEN should_correct AND confidence_level = 'high' THEN 1 END) AS corrected, count(*) AS reviewed, round(avg(CAST(eau AS DOUBLE)), 2) AS average_ms,
    CAST(max(eau) AS DOUBLE) AS longest_ms, arg_max(item_id, (eau, item_id)) AS slowest_item
    FROM (SELECT l.file_id, l.item_id, coalesce(eau, 0) AS eau, should_correct, confidence_level FROM lines l JOIN decisions USING (item_id)) GROUP BY 1""",
    "lines",
    "decisions",
)
def run_summary(d):
    _, audit = correct(d.lines, d.responses)
    timed = audit.join(d.lines.select("item_id", F.col("eau").cast("double").alias("analysis_ms")), "item_id")
    return corrections.run_summary(timed)


@query(
    "A16_classified",
    "SELECT file_id, count(*) AS lines, count(CASE WHEN commodity <> 'Unknown' THEN 1 END) AS classified FROM existing GROUP BY 1",
    "existing",
)
def classified(d):
    return analytics.classified_count(_existing(d))


@query(
    "A17_export_count",
    f"SELECT count(*) AS lines FROM lines WHERE {sqlx.norm_scope('scope')} = 'In scope' AND scope IS NOT NULL AND eau > 0",
    "lines",
)
def export_count(d):
    return analytics.export_filter(d.lines, ["In scope"], data=["with_demand"]).agg(F.count("*").alias("lines"))


# Minutes are filled one request after the other; a text of a million characters is a request over the budget.
_PLAN = """
SELECT * FROM (WITH RECURSIVE todo AS (SELECT DISTINCT trim(text, E' \\t\\n\\x0B\\f\\r') AS text FROM documents UNION SELECT repeat('long ', 240000) || 'text'), numbered AS (
  SELECT text, row_number() OVER (ORDER BY sha256(text)) - 1 AS position FROM todo WHERE text <> ''),
 batches AS (SELECT position // 20 AS batch, count(*) AS texts, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS tokens FROM numbered GROUP BY 1),
 filled AS (SELECT batch, texts, tokens, tokens AS used, 0 AS minute FROM batches WHERE batch = 0 UNION ALL
  SELECT b.batch, b.texts, b.tokens, CASE WHEN f.used + b.tokens > 250000 THEN b.tokens ELSE f.used + b.tokens END,
   CASE WHEN f.used + b.tokens > 250000 THEN f.minute + 1 ELSE f.minute END FROM filled f JOIN batches b ON b.batch = f.batch + 1)
SELECT batch, texts, tokens, CAST(minute AS BIGINT) AS minute FROM filled)
"""


@query("A18_work_plan", _PLAN)
def work_plan(d):
    texts = d.table("documents").select("text")
    return reuse.work_plan(reuse.distinct_texts(texts.union(texts.sparkSession.range(1).select(F.concat(F.repeat(F.lit("long "), 240_000), F.lit("text"))))))


_LINE_TEXTS = "SELECT DISTINCT trim(concat_ws(' ', raw_description, item_id), E' \\t\\n\\x0B\\f\\r') AS text FROM raw"


@query(
    "A18_work_plan_of_lines",
    _PLAN.replace("SELECT DISTINCT trim(text, E' \\t\\n\\x0B\\f\\r') AS text FROM documents UNION SELECT repeat('long ', 240000) || 'text'", _LINE_TEXTS)
    .replace("position // 20", "position // 10")
    .replace("250000", "5000"),
    "raw",
)
def work_plan_of_lines(d):
    """A text of its own for every line: more requests than one span holds."""
    texts = d.raw.select(F.concat_ws(" ", "raw_description", "item_id").alias("text"))
    return reuse.work_plan(reuse.distinct_texts(texts), per_request=10, tokens_per_minute=5000)


# --- sessions -----------------------------------------------------------------------------------------

_SESSION_COLUMNS = ["session_id", "user_id", "started_at", "ended_at", "duration_seconds", "sign_out_reason"]
_SESSION_SQL = f"session_id, user_id, {sql_stamp('started_at')} AS started_at, {sql_stamp('ended_at')} AS ended_at, duration_seconds, sign_out_reason"


def _shown(df):
    return df.select(*_SESSION_COLUMNS).withColumns({c: stamp(c) for c in ("started_at", "ended_at")})


@query("ST1_sessions", f"SELECT {_SESSION_SQL} FROM sessions", "sessions")
def session_table(d):
    return _shown(sessions.sessions_from_events(d.logins))


@query(
    "ST1_sessions_stream",
    f"""SELECT {_SESSION_SQL} FROM (SELECT session_id, user_id, started_at, coalesce(ended_at, started_at + INTERVAL 24 HOURS) AS ended_at, duration_seconds,
    coalesce(sign_out_reason, 'orphaned') AS sign_out_reason FROM sessions WHERE ended_at IS NOT NULL OR
    started_at + INTERVAL 24 HOURS <= (SELECT max(ts) - INTERVAL 10 MINUTES FROM logins WHERE kind <> 'other'))""",
    "sessions",
    "logins",
)
def session_table_stream(d):
    """The log replayed as a stream: sessions closed by events, and by age once they are too old."""
    target = _replayed(d, d.spark.readStream.schema(d.table("events").schema).option("pathGlobFilter", "events.parquet").parquet(d.sf_dir))
    return _shown(d.spark.read.parquet(f"{target}/sessions"))


def _replayed(d, raw):
    """Folder of the tables that the session stream leaves."""
    kind = F.when(F.col("event_type") == "signup", "login").when(F.col("event_type") == "error", "logout").otherwise("other")
    events = raw.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"))
    target = scratch_path(d.spark, "session-stream")
    session_stream(events, target, scratch_path(d.spark, "session-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return target


@query(
    "ST1_late_events",
    f"""SELECT event_id, user_id, {sql_stamp('ts')} AS ts, kind, batch FROM (SELECT *, event_id % 3 AS batch,
    max(ts) FILTER (WHERE kind <> 'other') OVER (ORDER BY event_id % 3 RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM logins)
  WHERE kind <> 'other' AND ts < seen - INTERVAL 10 MINUTES""",
    "logins",
)
def late_events(d):
    """The log arrives in three batches by event id, so that most of the later ones is late."""
    path, log = scratch_path(d.spark, "events"), d.table("events")
    for batch in range(3):
        log.where(F.pmod("event_id", F.lit(3)) == batch).coalesce(1).write.mode("append").parquet(path)
    target = _replayed(d, d.spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(path))
    return d.spark.read.parquet(f"{target}/late").select("event_id", "user_id", stamp("ts").alias("ts"), "kind", F.col("batch").cast("bigint").alias("batch"))


@query(
    "ST2_close_sessions",
    f"""SELECT {_SESSION_SQL} FROM (SELECT session_id, user_id, started_at, coalesce(ended_at, greatest(TIMESTAMP '2024-01-15', started_at)) AS ended_at,
    CASE WHEN ended_at IS NULL THEN CAST(floor(epoch_us(greatest(TIMESTAMP '2024-01-15', started_at)) / 1000000.0 - epoch_us(started_at) / 1000000.0) AS BIGINT) ELSE duration_seconds END AS duration_seconds,
    coalesce(sign_out_reason, 'forced') AS sign_out_reason FROM sessions)""",
    "sessions",
)
def close(d):
    at = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return _shown(sessions.close_sessions(sessions.sessions_from_events(d.logins), at, sessions.FORCED))


@query(
    "ST3_close_abandoned",
    f"""SELECT {_SESSION_SQL} FROM (SELECT * REPLACE (CASE WHEN old THEN TIMESTAMP '2024-01-30' ELSE ended_at END AS ended_at,
    CASE WHEN old THEN 'orphaned' ELSE sign_out_reason END AS sign_out_reason) FROM (SELECT *, ended_at IS NULL AND started_at < TIMESTAMP '2024-01-29' AS old FROM sessions))""",
    "sessions",
)
def abandoned(d):
    as_of = F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
    return _shown(sessions.close_abandoned(sessions.sessions_from_events(d.logins), as_of))


_UPLOAD_FILE_PATTERN = r"file_id=(\d+)"
_HEADER_ONLY, _OTHER_FORMAT = 900_001, 900_002


def upload_file():
    return F.regexp_extract("file", _UPLOAD_FILE_PATTERN, 1).cast("bigint")


def _uploaded(d, *steps):
    """All sheets land in a folder, one CSV file each, with a file of another format and one that is a header alone.

    Every file gets the options and the approved mapping of its own file. Returns the folder of the stored tables after
    the upload stream and the given later streams have run.
    """
    landing, target = landed_sheets(d, _HEADER_ONLY, _OTHER_FORMAT), scratch_path(d.spark, "uploads")
    own = written(d.mapped_files.select(F.col("file_id").alias("own_id"), "auto_mode", "demand_lookup", "volume_multiplier", F.transform_values("mapping", lambda _, header: F.trim(header)).alias("approved")), "file-options")
    # The side tables do not change while the stream runs: no batch reduces them again.
    sides = written_sides(d.sides)

    def options(files):
        named = files.withColumn("own_id", upload_file()).join(own, "own_id", "left")
        return named.withColumns({"mapping": F.coalesce("approved", "mapping"), "auto_mode": F.coalesce("auto_mode", F.lit(False)), "demand_lookup": F.coalesce("demand_lookup", F.lit(False))}).drop("own_id", "approved")

    streams = [lambda: upload_stream(d.spark, landing, target, lambda: sides, scratch_path(d.spark, "upload-checkpoint"), stand_in_embedding, options, max_columns=16), *[lambda s=s: s(target) for s in steps]]
    for stream in streams:
        stream().trigger(availableNow=True).start().awaitTermination()
    return target


def _stored(d, target, table):
    """A stored table with the number of the file each upload came from."""
    files = d.spark.read.parquet(f"{target}/status").select(F.col("file_id").alias("upload"), upload_file().alias("file_id"))
    rows = d.spark.read.parquet(f"{target}/{table}").withColumnRenamed("file_id", "upload")
    return rows.drop("file_id").join(files, "upload")


_UPLOAD_LINES = "quote_no, item, mfg_partno, mfg_name, description, site, eau, commodity, scope"


@query(
    "ST4_upload_stream",
    f"SELECT file_id, {_UPLOAD_LINES}, CAST(std_cost AS DOUBLE) AS std_cost, CAST(last_purchase_price AS DOUBLE) AS last_purchase_price, CAST(last_po AS DOUBLE) AS last_po "
    "FROM (SELECT * REPLACE (coalesce(quote_no, '') AS quote_no, coalesce(mfg_partno, '') AS mfg_partno, coalesce(mfg_name, '') AS mfg_name, coalesce(site, '') AS site) FROM processed)",
    "processed",
)
def upload(d):
    """The stored lines of all files that completed; empty cells of a sheet are compared as empty texts."""
    lines = _stored(d, _uploaded(d), "lines")
    texts = {c: F.coalesce(c, F.lit("")) for c in ("quote_no", "mfg_partno", "mfg_name", "site")}
    return lines.withColumns(texts | {c: num(c) for c in _MONEY}).select("file_id", *_UPLOAD_LINES.split(", "), *_MONEY)


@query(
    "ST4_upload_status",
    f"""SELECT DISTINCT file_id, CASE WHEN file_id IN (SELECT file_id FROM bad_files) THEN 'failed' ELSE 'completed' END AS status,
    CASE WHEN file_id IN (SELECT file_id FROM bad_files) THEN 'item missing' END AS error_message FROM standard
  UNION ALL SELECT {_HEADER_ONLY}, 'completed', NULL UNION ALL SELECT {_OTHER_FORMAT}, 'failed', 'Unsupported file format'""",
    "bad_files",
)
def upload_status(d):
    """The status row of every upload, with the reason of a failure (less the name of the refused file)."""
    status = d.spark.read.parquet(f"{_uploaded(d)}/status")
    return status.select(upload_file().alias("file_id"), "status", F.regexp_replace("error_message", ": .*", "").alias("error_message"))


@query(
    "ST4_review_queue",
    f"""SELECT t.file_id, t.item, t.commodity AS current_commodity, t.scope AS current_scope, n.found AS nearest FROM
  (SELECT p.*, e.txt, row_number() OVER (PARTITION BY p.file_id ORDER BY p.eau * {sqlx.lowest_price()} DESC, p.line_no) AS rk FROM processed p
    LEFT JOIN texted e USING (item_id) WHERE p.eau > 0 AND {sqlx.lowest_price()} IS NOT NULL) t
  LEFT JOIN nearest_text n ON {sqlx.strip('t.txt')} = n.txt WHERE rk <= 10""".replace("std_cost", "p.std_cost").replace("last_purchase_price", "p.last_purchase_price").replace("last_po", "p.last_po"),
    "processed",
    "nearest_text",
)
def review_queue(d):
    """The review records that completed uploads have started, with the nearest commodity of searched lines."""
    catalogue = written(d.refs, "catalogue")
    reviews = lambda target: review_stream(d.spark, target, lambda: catalogue, scratch_path(d.spark, "review-checkpoint"))
    target = _uploaded(d, reviews)
    lines = _stored(d, target, "lines").select("item_id", "item")
    return _stored(d, target, "reviews").join(lines, "item_id").select(
        "file_id", "item", "current_commodity", "current_scope", F.get("similar", F.lit(0))["name"].alias("nearest")
    )


@query(
    "ST5_latest_status",
    f"SELECT user_id AS file_id, {sql_stamp('ts')} AS ts, event_type AS status FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC) = 1",
)
def latest_status(d):
    log = d.table("events").select(
        F.col("user_id").alias("file_id"), "ts", F.col("event_type").alias("status"), F.lit(None).cast("string").alias("error_message")
    )
    return sessions.latest_status(log).select("file_id", stamp("ts").alias("ts"), "status")


_STEPS = """steps AS (SELECT user_id AS file_id, ts, event_id, (['pending', 'column_preview', 'queued', 'processing', 'completed', 'failed', 'lost'])[1 + event_id % 7] AS status FROM events),
  -- equal times go by the order of the life cycle
  placed AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ts, list_position(['lost', 'pending', 'column_preview', 'queued', 'processing', 'completed', 'failed'], status)) AS n FROM steps),
  walk AS (SELECT file_id, ts, event_id, status, n, CAST(NULL AS VARCHAR) AS before, status = 'pending' AS legal FROM placed WHERE n = 1 UNION ALL
    SELECT p.file_id, p.ts, p.event_id, p.status, p.n, CASE WHEN w.legal THEN w.status ELSE w.before END,
      coalesce(list_contains(CASE CASE WHEN w.legal THEN w.status ELSE w.before END WHEN 'pending' THEN ['column_preview', 'queued', 'failed'] WHEN 'column_preview' THEN ['queued', 'failed']
        WHEN 'queued' THEN ['processing', 'failed'] WHEN 'processing' THEN ['completed', 'failed'] WHEN 'completed' THEN ['queued'] WHEN 'failed' THEN ['queued'] ELSE ['pending'] END, p.status), false)
    FROM walk w JOIN placed p ON p.file_id = w.file_id AND p.n = w.n + 1)"""


def _steps(d):
    """Every event as a status of a file; one in seven is no status at all."""
    names = F.array(*[F.lit(x) for x in [*rules.FILE_STATUSES, "lost"]])
    return d.table("events").select(F.col("user_id").alias("file_id"), "ts", "event_id", F.get(names, F.pmod("event_id", F.lit(7)).cast("int")).alias("status"))


@query("ST5_status_history", f"SELECT * FROM (WITH RECURSIVE {_STEPS} SELECT event_id, before, legal FROM walk)")
def status_history(d):
    return sessions.status_history(_steps(d)).select("event_id", "before", "legal")


@query("ST5_legal_status", f"SELECT * FROM (WITH RECURSIVE {_STEPS} SELECT file_id, arg_max(status, n) AS status FROM walk WHERE legal GROUP BY 1)")
def legal_status(d):
    return sessions.legal_status(_steps(d))[0]


# --- whole runs ---------------------------------------------------------------------------------------


def _standard(d):
    return standardize(d.sheets, d.mapped_files, d.manufacturers)


def _existing(d):
    lines = _standard(d).where(F.col("path") != "similarity")
    return classify_existing(lines, d.refs_plain, crosses_by_mpn(d.crosses))


_MONEY = ["std_cost", "last_purchase_price", "last_po"]
_STANDARD_SQL = "item_id, quote_no, item, mfg_partno, mfg_name, description, site, eau, " + ", ".join(
    f"CAST({c} AS DOUBLE) AS {c}" for c in _MONEY
)


@query("Q1_standardize", f"SELECT {_STANDARD_SQL} FROM standard", "standard")
def standard(d):
    columns = ["item_id", "quote_no", "item", "mfg_partno", "mfg_name", "description", "site", "eau"]
    return _standard(d).select(*columns, *[num(c).alias(c) for c in _MONEY])


@query("Q2_classify_existing", "SELECT item_id, commodity, scope FROM existing", "existing")
def existing(d):
    return _existing(d).select("item_id", "commodity", "scope")


@query("Q3_classify_by_similarity", "SELECT item_id, commodity, scope FROM searched", "searched")
def searched(d):
    lines = written(_standard(d).where(F.col("path") == "similarity"), "standard")
    return classify_by_similarity(lines, d.refs, crosses_by_mpn(d.crosses), stand_in_embedding).select("item_id", "commodity", "scope")


_ENRICHED_SQL = f"""item_id, commodity, final_scope, duplication_flag, cross_mpn, CAST(ear AS DOUBLE) AS ear, ear_status, previously_quoted,
  {sql_stamp('quote_date')} AS quote_date, previous_quote_number, quoted_mpn, demand AS total_demand, CAST(min_price AS DOUBLE) AS min_price, ear_fallback"""


def _shown_enriched(df):
    return df.select(
        "item_id", "commodity", "final_scope", "duplication_flag", "cross_mpn", num("ear").alias("ear"), "ear_status", "previously_quoted",
        stamp("quote_date").alias("quote_date"), "previous_quote_number", "quoted_mpn", "total_demand", num("min_price").alias("min_price"), "ear_fallback",
    )


@query("Q4_enrich", f"SELECT {_ENRICHED_SQL} FROM enriched", "enriched")
def enriched(d):
    return _shown_enriched(_enriched(d))


@query("Q0_process_files", f"SELECT {_ENRICHED_SQL} FROM processed_enriched", "processed_enriched")
def process(d):
    return _shown_enriched(process_files(d.sheets, d.mapped_files, d.sides, stand_in_embedding).enriched)


@query(
    "Q0_file_status",
    "SELECT DISTINCT file_id, CASE WHEN file_id IN (SELECT file_id FROM bad_files) THEN 'failed' ELSE 'completed' END AS status, "
    "CASE WHEN file_id IN (SELECT file_id FROM bad_files) THEN 'item missing' END AS error_message FROM standard",
    "bad_files",
)
def status_of_files(d):
    return file_status(file_verdicts(_standard(d))).select("file_id", "status", "error_message")


@query("Q5_file_analytics_of_run", _analytics_joined("processed_enriched"), "processed_enriched")
def run_analytics(d):
    result = process_files(d.sheets, d.mapped_files, d.sides, stand_in_embedding)
    return analytics.file_analytics(result.enriched).withColumn("ear", num("ear"))


def _embedded_lines(d):
    return d.lines.withColumn("embedding", stand_in_embedding(F.col("description")))


_TOP = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY eau * {sqlx.lowest_price()} DESC, line_no) AS rk FROM lines
  WHERE eau > 0 AND {sqlx.lowest_price()} IS NOT NULL) WHERE rk <= 10)"""


@query(
    "Q6_review_candidates",
    f"""SELECT item_id, commodity AS current_commodity, string_agg(level3 || ' ' || pct, '; ' ORDER BY rank) AS similar FROM (
    SELECT item_id, commodity, level3, CAST(CAST(round(sim * 100, 2) AS DECIMAL(10,2)) AS VARCHAR) AS pct, row_number() OVER (PARTITION BY item_id ORDER BY sim DESC, id) AS rank
    FROM (SELECT t.item_id, t.commodity, r.level3, r.id, round({sqlx.cosine('t.v', 'r.embedding')}, 12) AS sim
      FROM (SELECT *, {sqlx.stand_in('description')} AS v FROM {_TOP}) t CROSS JOIN refs r)) WHERE rank <= 10 GROUP BY 1, 2""",
    "lines",
    "refs",
)
def review(d):
    shown = F.transform("similar", lambda r: F.concat_ws(" ", r["name"], r["percent"].cast("decimal(10,2)")))
    return review_candidates(_embedded_lines(d), d.refs).select(
        "item_id", "current_commodity", F.array_join(shown, "; ").alias("similar")
    )


@query(
    "T13_review_prompts",
    f"""SELECT item_id, true AS has_text, 10 AS candidates, true AS asks_decision FROM {_TOP}""",
    "lines",
)
def prompts(d):
    """What each prompt of a top line carries: its own text, ten candidates, the decision form."""
    records = review_candidates(_embedded_lines(d), d.refs)
    return records.select(
        "item_id",
        F.contains("analysis_prompt", "embedding_text").alias("has_text"),
        (F.size(F.split("analysis_prompt", " percent alike\n")) - 1).alias("candidates"),
        (F.contains("correction_prompt", F.lit('"should_correct"')) & ~F.contains("analysis_prompt", F.lit('"should_correct"'))).alias(
            "asks_decision"
        ),
    )


_CANDIDATE = f"""rank || ') ' || level3 || ', ' || CAST(CAST(round(sim * 100, 2) AS DECIMAL(10,2)) AS VARCHAR) || ' percent alike' || chr(10)
    || '   ' || coalesce(base_scope, 'no scope') || '; parts ' || coalesce(array_to_string(list_slice(string_split(typical_mpns, ','), 1, 3), ', '), 'None')
    || chr(10) || '   ' || replace(ref_text, chr(10), chr(10) || '   ')"""


@query(
    "T13_whole_prompts",
    f"""SELECT item_id, concat_ws(chr(10) || chr(10), 'Review the commodity assigned to this electronic component.', 'Line: ' || item_id,
    'Description: ' || coalesce(description, ''), 'Manufacturer: ' || coalesce(mfg_name, ''), 'MPN: ' || coalesce(mfg_partno, ''),
    'Assigned commodity: ' || coalesce(commodity, ''), 'Assigned scope: ' || coalesce(scope, ''), 'Embedded text:' || chr(10) || own,
    'Most similar commodities:' || chr(10) || string_agg({_CANDIDATE}, chr(10) || chr(10) ORDER BY rank),
    'State whether the assignment is right and why, which parts of MPN, description or manufacturer support it, whether to keep or change it, which keywords the catalogue lacks, and how sure you are.') AS prompt
  FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY sim DESC, id) AS rank FROM (
    SELECT t.* EXCLUDE (v), r.id, r.level3, r.base_scope, r.typical_mpns, {sqlx.ref_text('r.')} AS ref_text, round({sqlx.cosine('t.v', 'r.embedding')}, 12) AS sim
    FROM (SELECT item_id, description, mfg_name, mfg_partno, commodity, scope, {sqlx.stored_text()} AS own, {sqlx.stand_in('description')} AS v FROM {_TOP}) t CROSS JOIN refs r))
  WHERE rank <= 10 GROUP BY item_id, description, mfg_name, mfg_partno, commodity, scope, own""",
    "lines",
    "refs",
)
def whole_prompts(d):
    return review_candidates(_embedded_lines(d), d.refs).select("item_id", F.col("analysis_prompt").alias("prompt"))


@query(
    "Q6_correction_audit",
    """SELECT item_id, a AS correction_applied, commodity AS old_commodity, scope AS old_scope, CASE WHEN a THEN recommended_commodity END AS new_commodity,
    CASE WHEN a THEN recommended_scope END AS new_scope FROM (SELECT *, should_correct AND confidence_level = 'high' AS a FROM decisions) JOIN lines USING (item_id)""",
    "lines",
    "decisions",
)
def audit(d):
    _, rows = correct(d.lines, d.responses)
    return rows.select("item_id", "correction_applied", "old_commodity", "old_scope", "new_commodity", "new_scope")


@query(
    "Q6_review_outcomes",
    """SELECT item_id, e IS NULL AS success, e AS error, e IS NULL AND a AS correction_applied, commodity AS old_commodity, CASE WHEN e IS NULL AND a THEN recommended_commodity END AS new_commodity FROM (
    SELECT q.item_id, l.commodity, d.recommended_commodity, coalesce(d.should_correct AND d.confidence_level = 'high', false) AS a,
      CASE WHEN l.item_id IS NULL THEN 'line not found' WHEN r.item_id IS NULL THEN 'no response' WHEN regexp_matches(r.response_text, '(?s)\\{.*\\}') THEN NULL ELSE 'unreadable response' END AS e
    FROM (SELECT item_id FROM lines UNION ALL SELECT 'x' || item_id FROM lines WHERE eau < 5) q LEFT JOIN lines l USING (item_id)
    LEFT JOIN decisions d ON d.item_id = q.item_id AND NOT l.auto_mode
    LEFT JOIN (SELECT * FROM responses QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY response_no DESC) = 1) r ON r.item_id = q.item_id AND NOT l.auto_mode)""",
    "lines",
    "decisions",
)
def outcomes(d):
    """All lines are asked, and some that are not stored; lines of files in auto mode get no response."""
    stored, unknown = F.col("item_id"), F.concat(F.lit("x"), "item_id")
    asked = d.lines.select(F.explode(F.when(F.col("eau") < 5, F.array(stored, unknown)).otherwise(F.array(stored))).alias("item_id"))
    answered = d.responses.join(d.lines.where("NOT auto_mode").select("item_id"), "item_id", "left_semi")
    found = corrections.review_outcomes(asked, d.lines, answered)
    return found.select("item_id", "success", "error", "correction_applied", "old_commodity", "new_commodity")


@query(
    "Q6_corrected_sheet",
    f"""SELECT {_ENRICHED_SQL} FROM (SELECT * REPLACE (CASE WHEN a THEN recommended_commodity ELSE commodity END AS commodity,
    CASE WHEN previously_quoted = 'YES' THEN 'In scope' WHEN a THEN recommended_scope ELSE scope END AS final_scope)
    FROM enriched JOIN (SELECT *, should_correct AND confidence_level = 'high' AS a FROM decisions) USING (item_id))""",
    "enriched",
    "decisions",
)
def corrected_sheet(d):
    lines, _ = correct(d.lines, d.responses)
    return _shown_enriched(enrich(lines, d.quotes, d.aml, d.crosses))


@query("Q7_loaded_references", f"SELECT id, sha256({sqlx.ref_text('c.')}) AS text_hash FROM (SELECT * FROM refs_plain) c WHERE level1 <> level3", "refs_plain")
def loaded(d):
    return reference_plans.loaded_references(d.refs_plain).select("id", "text_hash")


@query(
    "Q8_refresh_references",
    f"""SELECT id, round(CAST(v[1] AS DOUBLE), 5) AS head, stale FROM (SELECT *, CASE WHEN stale THEN {sqlx.stand_in(sqlx.ref_text())}
    ELSE {sqlx.stand_in('level3')} END AS v FROM (SELECT * REPLACE (CASE WHEN keyword LIKE '%5' THEN keyword || ' new' ELSE keyword END AS keyword),
    keyword LIKE '%5' OR length(level3) % 4 = 0 AS stale FROM refs_plain))""",
    "refs_plain",
)
def refresh(d):
    """New keywords for the brands ending in 5 and missing vectors for some names; the rest keep their vector."""
    old = d.refs_plain
    vector = F.when(F.length("level3") % 4 != 0, stand_in_embedding(F.col("level3")))
    ends = F.col("keyword").endswith("5")
    new = old.withColumns({"embedding": vector, "keyword": F.when(ends, F.concat("keyword", F.lit(" new"))).otherwise(F.col("keyword"))})
    stale = reference_plans.stale_references(new, old).select("id", F.lit(True).alias("stale"))
    fresh = reference_plans.refresh_embeddings(new, old, stand_in_embedding)
    return fresh.join(stale, "id", "left").select(
        "id", F.round(F.col("embedding")[0].cast("double"), 5).alias("head"), F.coalesce("stale", F.lit(False)).alias("stale")
    )
