"""Streaming forms: feedback counts, latest job states, arriving segments.

Each takes a streaming (or batch) DataFrame and returns one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.maintenance import USER_EVENTS
from ..sources.transcripts import filter_speech


def feedback_counts(events: DataFrame, *, window: str = "1 hour", late: str = "10 minutes", allowed: tuple[str, ...] = USER_EVENTS) -> DataFrame:
    """(start, end, project_id, event, n): accepted events in tumbling windows of event time; later than `late` are dropped."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).filter(F.col("event").isin(*allowed))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", window), "project_id", "event").agg(F.count(F.lit(1)).alias("n"))
    return out.select("window.start", "window.end", "project_id", "event", "n")


def job_latest(updates: DataFrame) -> DataFrame:
    """(job_id, ts, status, progress): the last update of each job; of equal times the larger sequence number. State is one row a job."""
    last = F.max(F.struct("ts", "seq", "status", "progress")).alias("u")
    return updates.withColumn("ts", F.col("ts").cast("timestamp")).groupBy("job_id").agg(last).select("job_id", "u.ts", "u.status", "u.progress")


def segments_stream(segments: DataFrame) -> DataFrame:
    """Arriving segments (video_id, segment_id, start, end, text, words) without empty and non-speech ones; words cleaned. Ids stay as they came."""
    return filter_speech(segments, renumber=False)
