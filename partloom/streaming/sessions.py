"""Sessions kept from a stream of login events.

Every batch is a join of the open sessions with its events by the batch operators, so events are ordered by Spark inside
(user, hour) and no task holds all events of a user. Between batches the open sessions and the latest time seen lie in
tables below the target, one version per batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from partloom.functions import rules
from partloom.operators.sessions import ORPHANED, sessions_from_events
from partloom.session import delete, scratch, written

SESSION_SCHEMA = (
    "user_id bigint, session_id bigint, started_at timestamp, ended_at timestamp, "
    "duration_seconds bigint, sign_out_reason string"
)
_OPEN_SCHEMA = "user_id bigint, session_id bigint, started_at timestamp"
_SEEN_SCHEMA = "seen timestamp"
_EVENT_COLUMNS = ["event_id", "user_id", "ts", "kind"]


def _before(spark: SparkSession, target: str, name: str, schema: str, batch_id: int) -> DataFrame:
    """A state table as the batch before has left it."""
    if batch_id == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{target}/{name}/{batch_id - 1}")


def advance(
    events: DataFrame, open_sessions: DataFrame, seen: DataFrame, late: str, max_age_hours: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One step: sessions (closed and still open), late events, and the latest time seen.

    ``seen`` has at most one row. Events more than ``late`` behind it are late and change nothing. Sessions still open when the time
    seen, less ``late``, is ``max_age_hours`` past their start end there as orphaned.
    """
    moves = events.where(F.col("kind").isin("login", "logout")).select(*_EVENT_COLUMNS)
    border = F.col("border.seen") - F.expr(f"INTERVAL {late}")
    # One row at most: the latest time of all batches before.
    marked = moves.join(F.broadcast(seen.alias("border")), F.lit(True), "left").withColumn("is_late", F.coalesce(F.col("ts") < border, F.lit(False)))
    own = marked.where(~F.col("is_late")).select(*_EVENT_COLUMNS)
    running = open_sessions.select(F.col("session_id").alias("event_id"), "user_id", F.col("started_at").alias("ts"), F.lit("login").alias("kind"))
    found = sessions_from_events(running.unionByName(own))
    now = seen.unionByName(moves.select(F.col("ts").alias("seen"))).agg(F.max("seen").alias("seen"))
    limit = F.col("started_at") + F.expr(f"INTERVAL {max_age_hours} HOURS")
    old = F.col("ended_at").isNull() & (limit <= F.col("seen") - F.expr(f"INTERVAL {late}"))
    aged = found.join(F.broadcast(now), F.lit(True), "left").withColumns(
        {"sign_out_reason": F.when(old, F.lit(ORPHANED)).otherwise(F.col("sign_out_reason")), "ended_at": F.when(old, limit).otherwise(F.col("ended_at"))}
    )
    return aged.drop("seen"), marked.where("is_late").select(*_EVENT_COLUMNS), now


def session_stream(
    events: DataFrame, target: str, checkpoint: str, late: str = "10 minutes", max_age_hours: int = rules.MAX_SESSION_AGE_HOURS
) -> DataStreamWriter:
    """Writer that keeps the sessions of a stream of ``event_id, user_id, ts, kind``.

    Closed sessions arrive in ``target/sessions``. An event more than ``late`` behind the latest time of the batches
    before arrives in ``target/late`` instead and changes no session; a session that was stored as closed stays so.
    Events of one batch count in the order of their time, then id. A batch replaces its own folders and starts from
    those of the batch before, so a batch repeated after a failure gives the same tables. The state is one row per user
    with an open session.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        put = lambda df, name: df.write.mode("overwrite").parquet(f"{target}/{name}")
        with scratch(spark):
            moves = written(batch.select(*_EVENT_COLUMNS), "moves")
            state = _before(spark, target, "open", _OPEN_SCHEMA, batch_id), _before(spark, target, "seen", _SEEN_SCHEMA, batch_id)
            found, missed, now = advance(moves, *state, late, max_age_hours)
            found = written(found, "session-step")
            put(found.where(F.col("ended_at").isNotNull()).select(*[c.split()[0] for c in SESSION_SCHEMA.split(", ")]), f"sessions/batch={batch_id}")
            put(missed, f"late/batch={batch_id}")
            put(found.where(F.col("ended_at").isNull()).select("user_id", "session_id", "started_at"), f"open/{batch_id}")
            put(now, f"seen/{batch_id}")
        for name in ("open", "seen"):
            delete(spark, f"{target}/{name}/{batch_id - 2}")

    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
