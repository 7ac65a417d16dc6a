"""Queries that read the events as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import ledgers
from .registry import query


@query("stream_ledger_latest", "SELECT user_id, event_id, event_type FROM events WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stream_ledger_latest(spark, folder):
    e = ledgers.read_stream(spark, f"{folder}/events.parquet").select("user_id", "event_id", "event_type", "ts")
    return ledgers.run_to_end(ledgers.latest_rows(e, "user_id", ["ts", "event_id"]), "update", "latest", ["user_id"]).select("user_id", "event_id", "event_type")


@query("stream_window_counts", "SELECT date_trunc('hour', ts) AS begins, event_type, count(*) AS rows FROM events GROUP BY ALL")
def stream_window_counts(spark, folder):
    e = ledgers.read_stream(spark, f"{folder}/events.parquet")
    counted = ledgers.window_counts(e, "ts", "1 hour", "2 days", F.col("event_type"))
    return ledgers.run_to_end(counted, "update", "windows", ["begins", "event_type"]).select(F.col("begins").cast("timestamp_ntz").alias("begins"), "event_type", "rows")
