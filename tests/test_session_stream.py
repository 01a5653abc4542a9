"""Sessions of events that arrive in several batches."""

from partloom.streaming.sessions import session_stream

EVENTS = "event_id bigint, user_id bigint, ts timestamp, kind string"


def test_sessions_over_batches_and_late_events(spark, tmp_path):
    inbox, target = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(*events):
        rows = spark.createDataFrame(events, "event_id bigint, user_id bigint, ts string, kind string")
        rows.selectExpr("event_id", "user_id", "cast(ts AS timestamp) AS ts", "kind").coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(EVENTS).parquet(inbox)
        session_stream(stream, target, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    def sessions():
        rows = spark.read.parquet(f"{target}/sessions").selectExpr("session_id", "user_id", "date_format(ended_at, 'dd HH:mm') AS e", "duration_seconds", "sign_out_reason")
        return sorted(tuple(r) for r in rows.collect())

    def late():
        return sorted(r.event_id for r in spark.read.parquet(f"{target}/late").collect())

    arrive((1, 7, "2024-01-01 10:00:00", "login"), (2, 8, "2024-01-01 10:20:00", "login"), (3, 9, "2024-01-01 10:30:00", "other"))
    assert sessions() == [] and late() == []
    # The latest login is of 10:20: an event of 10:09 is 11 minutes late, one of 10:11 is not.
    arrive((4, 7, "2024-01-01 10:09:00", "logout"), (5, 8, "2024-01-01 10:25:00", "logout"), (6, 6, "2024-01-01 10:11:00", "login"))
    assert sessions() == [(2, 8, "01 10:25", 300, "manual")] and late() == [4]
    # Within a batch events count by time, however they are stored.
    arrive((9, 7, "2024-01-01 11:30:00", "login"), (8, 7, "2024-01-01 11:00:00", "logout"), (7, 6, "2024-01-01 10:40:00", "login"))
    assert sessions() == [(1, 7, "01 11:00", 3600, "manual"), (2, 8, "01 10:25", 300, "manual"), (6, 6, "01 10:40", None, "orphaned")]
    # A day later what is still open ends, by age and without a duration.
    arrive((10, 5, "2024-01-02 11:00:00", "login"))
    assert sessions()[-1] == (7, 6, "02 10:40", None, "orphaned") and len(sessions()) == 4 and late() == [4]
