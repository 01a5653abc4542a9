"""Login sessions from an event log, and figures per user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partloom.functions import rules

MANUAL, TIMEOUT, ORPHANED, FORCED = rules.SIGN_OUT_REASONS


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end)


def next_event(events: DataFrame, span: str = "hour") -> DataFrame:
    """Adds ``next_ts, next_kind``: the following event of the same user, by time then id.

    A user can own much of the log, so no window covers a whole user. Events are ordered inside
    (user, span); only the last event of a span looks further, at the first event of the user's next span.
    That second window has a row per span.
    """
    keyed = events.withColumn("span", F.date_trunc(span, "ts"))
    inside = Window.partitionBy("user_id", "span").orderBy("ts", "event_id")
    local = keyed.withColumns({"l_ts": F.lead("ts").over(inside), "l_kind": F.lead("kind").over(inside)})
    heads = keyed.groupBy("user_id", "span").agg(F.min(F.struct("ts", "event_id", "kind")).alias("head"))
    across = Window.partitionBy("user_id").orderBy("span")
    following = heads.select("user_id", "span", F.lead("head").over(across).alias("following"))
    return (
        local.join(following, ["user_id", "span"])
        .withColumns(
            {
                "next_ts": F.coalesce("l_ts", "following.ts"),
                "next_kind": F.coalesce("l_kind", "following.kind"),
            }
        )
        .drop("span", "l_ts", "l_kind", "following")
    )


def sessions_from_events(events: DataFrame, span: str = "hour") -> DataFrame:
    """Session table of a log of ``event_id, user_id, ts, kind`` with kind login or logout.

    A logout closes the running session by hand; a login closes it as orphaned, without duration, and opens
    the next one. A logout without a running session does nothing.
    """
    moves = next_event(events.where(F.col("kind").isin("login", "logout")), span)
    by_logout = F.col("next_kind") == "logout"
    return moves.where(F.col("kind") == "login").select(
        F.col("event_id").alias("session_id"),
        "user_id",
        F.col("ts").alias("started_at"),
        F.col("next_ts").alias("ended_at"),
        F.when(by_logout, seconds_between(F.col("ts"), F.col("next_ts"))).alias("duration_seconds"),
        F.when(by_logout, MANUAL).when(F.col("next_kind") == "login", ORPHANED).alias("sign_out_reason"),
    )


def close_sessions(sessions: DataFrame, at: Column, reason: str = MANUAL, where: Column | None = None) -> DataFrame:
    """Close open sessions; closed ones stay as they are and no duration is negative."""
    hit = F.col("ended_at").isNull() & (F.lit(True) if where is None else where)
    end = F.greatest(at, F.col("started_at"))
    return sessions.withColumns(
        {
            "duration_seconds": F.when(hit, seconds_between(F.col("started_at"), end)).otherwise(F.col("duration_seconds")),
            "sign_out_reason": F.when(hit, F.lit(reason)).otherwise(F.col("sign_out_reason")),
            "ended_at": F.when(hit, end).otherwise(F.col("ended_at")),
        }
    )


def close_abandoned(sessions: DataFrame, as_of: Column, hours: int = rules.MAX_SESSION_AGE_HOURS) -> DataFrame:
    """Open sessions older than the limit end now, without duration."""
    old = F.col("ended_at").isNull() & (F.col("started_at") < as_of - F.expr(f"INTERVAL {hours} HOURS"))
    return sessions.withColumns(
        {
            "sign_out_reason": F.when(old, F.lit(ORPHANED)).otherwise(F.col("sign_out_reason")),
            "ended_at": F.when(old, as_of).otherwise(F.col("ended_at")),
        }
    )


def active(sessions: DataFrame) -> DataFrame:
    return sessions.where(F.col("ended_at").isNull())


def finished(sessions: DataFrame) -> DataFrame:
    return sessions.where(F.col("ended_at").isNotNull())


def in_range(sessions: DataFrame, start: Column, end: Column) -> DataFrame:
    """Sessions started in a range, both ends included."""
    return sessions.where(F.col("started_at").between(start, end))


def recent(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy(F.desc("started_at"), F.desc("session_id"))


def with_duration(sessions: DataFrame, now: Column) -> DataFrame:
    """Running duration of open sessions, stored one of the others."""
    running = seconds_between(F.col("started_at"), now)
    return sessions.withColumn("duration", F.when(F.col("ended_at").isNull(), running).otherwise(F.col("duration_seconds")))


def current_sessions(sessions: DataFrame) -> DataFrame:
    """Latest open session of each user."""
    pick = F.max(F.struct("started_at", "session_id")).alias("pick")
    return active(sessions).groupBy("user_id").agg(pick).select("user_id", "pick.*")


def session_times(sessions: DataFrame) -> DataFrame:
    """Average and total seconds over finished sessions; null durations do not count."""
    return finished(sessions).groupBy("user_id").agg(
        F.avg("duration_seconds").alias("average_seconds"),
        F.coalesce(F.sum("duration_seconds"), F.lit(0)).alias("total_seconds"),
    )


def user_summary(users: DataFrame, files: DataFrame, sessions: DataFrame) -> DataFrame:
    """File counters, last activity and session times of every user.

    Files and sessions are aggregated per user before they are joined.
    """
    per_files = files.groupBy("user_id").agg(
        F.count("*").alias("uploaded"),
        F.count(F.when(F.col("status") == "completed", 1)).alias("processed"),
        F.max("updated_at").alias("last_file"),
    )
    per_sessions = sessions.groupBy("user_id").agg(F.max("started_at").alias("last_start"))
    return (
        users.join(per_files, "user_id", "left")
        .join(per_sessions, "user_id", "left")
        .join(session_times(sessions), "user_id", "left")
        .select(
            "user_id",
            F.coalesce("uploaded", F.lit(0)).alias("uploaded"),
            F.coalesce("processed", F.lit(0)).alias("processed"),
            F.greatest("last_sign_in_at", "last_file", "last_start").alias("last_activity"),
            "average_seconds",
            F.coalesce("total_seconds", F.lit(0)).alias("total_seconds"),
        )
    )


def latest_status(status_rows: DataFrame) -> DataFrame:
    """Current status of each file from its status log."""
    return status_rows.groupBy("file_id").agg(F.max(F.struct("ts", "status", "error_message")).alias("s")).select(
        "file_id", "s.ts", "s.status", "s.error_message"
    )


def status_history(status_rows: DataFrame, span: str = "day") -> DataFrame:
    """Adds ``before`` and ``legal`` to the status events ``file_id, ts, status`` of files, in the order of their time.

    A status that may not follow the one a file is in changes nothing. Equal times go by the order of the life cycle.
    A file may own much of the log, so no task folds a whole file: the events of a (file, span) are reduced to the status they lead to
    from every status, spans are folded per file, and the entry of each span is handed back to its events.
    """
    names = rules.FILE_STATUSES
    n = len(names)
    after = F.array(*[F.array(*[F.lit(f in rules.STATUS_AFTER[s]) for f in names]) for s in [None, *names]])
    code = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in names]), F.col("status")), F.lit(0)).cast("int")
    step = lambda state, c: F.when((c > 0) & F.get(F.get(after, state), c - 1), c).otherwise(state)
    coded = status_rows.withColumns({"code": code, "span": F.date_trunc(span, "ts")})
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("ts", "code"))), lambda e: e["code"])
    spans = coded.groupBy("file_id", "span").agg(ordered.alias("codes"))
    every = F.sequence(F.lit(0), F.lit(n))
    leads = F.aggregate("codes", every, lambda states, c: F.transform(states, lambda s: step(s, c)))
    folded = spans.select("file_id", F.struct("span", leads.alias("leads")).alias("s")).groupBy("file_id").agg(F.sort_array(F.collect_list("s")).alias("spans"))
    start = F.array(F.struct(F.lit(None).cast("timestamp").alias("span"), F.lit(0).alias("state")))
    # The state before every span, and the state it leads to as the entry of the next.
    entries = F.aggregate("spans", start, lambda acc, s: F.concat(acc, F.array(F.struct(s["span"].alias("span"), F.get(s["leads"], F.element_at(acc, -1)["state"]).alias("state")))))
    entered = folded.select("file_id", F.explode(F.arrays_zip(F.transform("spans", lambda s: s["span"]).alias("span"), F.transform(entries, lambda e: e["state"]).alias("state"))).alias("e"))
    known = entered.select("file_id", "e.span", F.col("e.state").alias("state")).where("span IS NOT NULL")
    # Inside a span: state before each event, by its place in the order.
    walked = spans.join(known, ["file_id", "span"]).select(
        "file_id", "span", F.aggregate("codes", F.array("state"), lambda acc, c: F.concat(acc, F.array(step(F.element_at(acc, -1), c)))).alias("states")
    )
    place = F.row_number().over(Window.partitionBy("file_id", "span").orderBy("ts", "code"))
    placed = coded.withColumn("place", place).join(walked, ["file_id", "span"])
    before = F.get("states", F.col("place") - 1)
    named = placed.withColumns({"before": F.get(F.array(F.lit(None).cast("string"), *[F.lit(x) for x in names]), before), "legal": (F.col("code") > 0) & F.get(F.get(after, before), F.col("code") - 1)})
    return named.select(*[F.col(f"`{c}`") for c in status_rows.columns], "before", F.coalesce("legal", F.lit(False)).alias("legal"))


def legal_status(status_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The status every file is in by its legal events (``file_id, status``), and the events that were not legal."""
    history = status_history(status_rows)
    now = F.max_by("status", F.struct("ts", F.array_position(F.array(*[F.lit(x) for x in rules.FILE_STATUSES]), F.col("status"))))
    return history.where("legal").groupBy("file_id").agg(now.alias("status")), history.where(~F.col("legal"))
