"""Tables of projects, jobs, clips and feedback: replace, update, list, count, purge, report."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Feedback that users may send.
USER_EVENTS = ("clip_selected", "clip_rejected", "clip_downloaded", "boundary_adjusted")


def replace_partition(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old without the keys that new has, and new."""
    return old.join(new.select(key).distinct().hint("merge"), key, "left_anti").unionByName(new)


def update_by_key(rows: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """rows with the non-null values of changes (unique by keys) in columns; unmatched changes are ignored."""
    new = changes.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    out = rows.join(new.hint("merge"), keys, "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).select(rows.columns)


def list_projects(projects: DataFrame, created: str, limit: int = 50) -> DataFrame:
    """The newest projects, 1 to 200 of them; ties to the larger id."""
    return projects.orderBy(F.desc(created), F.desc("project_id")).limit(max(1, min(200, limit)))


def list_clips(clips: DataFrame, project: int, ids: list[int] | None = None) -> DataFrame:
    """A project's clips by index, or those of them with given ids."""
    rows = clips.filter(F.col("project_id") == project)
    return (rows if ids is None else rows.filter(F.col("clip_id").isin(ids))).orderBy("index")


def lookup_clip(clips: DataFrame, wanted: DataFrame) -> DataFrame:
    """The clip of each wanted (project_id, clip_id); a key with more than one clip is an error when the rows are read."""
    found = clips.join(wanted.distinct().hint("merge"), ["project_id", "clip_id"], "left_semi")
    n = F.count(F.lit(1)).over(Window.partitionBy("project_id", "clip_id"))
    return found.withColumn("_n", n).filter(F.when(F.col("_n") > 1, F.raise_error(F.lit("more than one clip for a key")).cast("boolean")).otherwise(True)).drop("_n")


def count_unrendered(clips: DataFrame, project: str = "project_id", status: str = "status") -> DataFrame:
    """(project_id, n): clips whose status is not completed."""
    return clips.groupBy(project).agg(F.count_if(~F.col(status).eqNullSafe("completed")).alias("n"))


def accepted_feedback(events: DataFrame, allowed: tuple[str, ...] = USER_EVENTS) -> DataFrame:
    """Only events users may send."""
    return events.filter(F.col("event").isin(*allowed))


def purge_project(rows: DataFrame, deleted: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """rows without deleted projects; a project with a running job stays."""
    gone = deleted.select("project_id").distinct()
    if jobs is not None:
        gone = gone.join(jobs.filter("status = 'running'").select("project_id").distinct().hint("merge"), "project_id", "left_anti")
    return rows.join(gone.hint("merge"), "project_id", "left_anti")


def project_progress(jobs: DataFrame) -> DataFrame:
    """(project_id, progress, running): mean of finished (1), running (its progress) and other (0) jobs; the first running job's type."""
    share = F.when(F.col("status").isin("completed", "skipped"), 1.0).when(F.col("status") == "running", F.col("progress")).otherwise(0.0)
    first = F.min_by(F.when(F.col("status") == "running", F.col("type")), F.when(F.col("status") == "running", F.col("position")))
    return jobs.groupBy("project_id").agg(F.round(F.round(F.least(F.lit(1.0), F.avg(share)), 10), 4).alias("progress"), first.alias("running"))


def job_durations(jobs: DataFrame) -> DataFrame:
    """(type, n, mean_s, most_s) of finished_at - started_at; jobs without either don't count."""
    seconds = F.col("finished_at").cast("timestamp").cast("double") - F.col("started_at").cast("timestamp").cast("double")
    return jobs.withColumn("s", seconds).filter("s is not null").groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s"), 3).alias("mean_s"), F.max("s").alias("most_s"))


def rerender_retry(clips: DataFrame, status: str = "render_status") -> DataFrame:
    """Clips whose rendering failed, queued again."""
    return clips.filter(F.col(status) == "failed").withColumn(status, F.lit("pending"))


def adjust_request(start: Column, end: Column, duration: Column) -> Column:
    """Why an adjustment is refused; null if it is fine."""
    return F.when(start < 0, "start before the beginning").when(end <= start, "end before start").when(end > duration, "end after the end of the video")


def transcript_diff(pairs: DataFrame, least_share: float = 0.8) -> DataFrame:
    """(video_id, old_words, new_words, kept, changed) of pairs (video_id, old_text, new_text).

    The new transcript is kept if it has least_share of the old one's words; changed sums the larger side of
    each block that differs.  Pairs are one row a video, diffed in Arrow batches.
    """
    @F.pandas_udf("bigint")
    def changed(old: pd.Series, new: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        def blocks(a: str, b: str) -> int:
            ops = SequenceMatcher(None, a.split(), b.split(), autojunk=False).get_opcodes()
            return sum(max(i2 - i1, j2 - j1) for tag, i1, i2, j1, j2 in ops if tag != "equal")

        return pd.Series([blocks(a or "", b or "") for a, b in zip(old, new, strict=True)])

    n = lambda c: F.size(F.filter(F.split(F.trim(F.coalesce(F.col(c), F.lit(""))), r"\s+"), lambda w: w != ""))
    rows = pairs.withColumn("old_words", n("old_text")).withColumn("new_words", n("new_text"))
    return rows.select("video_id", "old_words", "new_words", (F.col("new_words") >= least_share * F.col("old_words")).alias("kept"), changed("old_text", "new_text").alias("changed"))
