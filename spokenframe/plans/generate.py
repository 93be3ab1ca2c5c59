"""Whole stages: candidates of a library of videos, validation, manual re-cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..operators import boundaries as B
from ..operators import candidates as C
from ..operators import maintenance as M
from ..operators import ranges as R
from ..operators import segments as S
from ..operators import signals as G
from ..operators.joins import dealt
from ..sources.shared import written

KEYS = ["video_id", "window_id"]


def _points(words: DataFrame, segments: DataFrame, scenes: DataFrame) -> DataFrame:
    """The points that boundaries snap to, computed once."""
    return written(B.boundary_points(words, segments, scenes), "points")


def _starts(points: DataFrame) -> DataFrame:
    return points.filter("kind = 'start'").select("video_id", "point")


def generate_candidates(words: DataFrame, segments: DataFrame, turns: DataFrame, audio_frames: DataFrame, frames: DataFrame, scenes: DataFrame, media: DataFrame, *, hop_ms: int, min_ms: int = 20_000, max_ms: int = 60_000, pool: int = 80, triggers=L.TRIGGERS, low_value: str = L.LOW_VALUE, confrontation=L.CONFRONTATION) -> DataFrame:
    """The best windows of each video: sentences, windows, boundary repair, scores, and the best few of each anchor.

    Columns: video_id, window_id, anchor_id, rank, name, start_ms, end_ms, trigger, text, factors, punch, conflict, heuristic_score, before, after, kinds.
    """
    segments, audio_frames = written(segments, "segments"), written(audio_frames, "loudness")
    turns, scenes, media = written(turns, "turns"), written(scenes, "scenes"), written(media, "media")
    words = written(R.timed_words(words, segments), "words")
    anchored = C.anchored_sentences(S.build_sentences(words, segments), triggers, low_value)
    raw = C.candidate_windows(anchored, min_ms=min_ms, max_ms=max_ms).withColumn("window_id", F.col("i") * 100_000 + F.col("j"))
    raw = written(raw, "windows")
    refined = B.refine_boundaries(raw.select(*KEYS, "start_ms", "end_ms"), words, segments, _points(words, segments, scenes), media=media, min_ms=min_ms, max_ms=max_ms, read=False)
    refined = refined.filter(F.col("end_ms") - F.col("start_ms") >= min_ms).select(*KEYS, "start_ms", "end_ms")
    windows = written(refined.join(raw.select(*KEYS, F.col("i").alias("anchor_id"), "anchor", "trigger").hint("merge"), KEYS), "refined-windows")
    events = written(G.audio_events(audio_frames, hop_ms), "events")
    scored = C.score_windows(windows, words, segments, turns, audio_frames, events, frames, scenes, hop_ms=hop_ms, triggers=triggers, low_value=low_value, confrontation=confrontation)
    scored = written(scored, "scored")
    best = C.top_variants(scored, pool=pool)
    rows = written(best.join(scored.drop("anchor_id").hint("merge"), KEYS), "best")
    kept = rows.select(*KEYS, "start_ms", "end_ms")
    return rows.join(R.surrounding_context(kept, segments).hint("merge"), KEYS).join(G.event_kinds(kept, events).hint("merge"), KEYS)


def apply_validation(clips: DataFrame, verdicts: DataFrame, words: DataFrame, segments: DataFrame, turns: DataFrame, scenes: DataFrame, media: DataFrame, *, min_ms: int = 20_000, max_ms: int = 60_000) -> DataFrame:
    """clips (video_id, window_id, start_ms, end_ms) after verdicts (video_id, window_id, verdict, shift_ms): rejected ones go, others are expanded, trimmed, refined and completed.

    Columns: video_id, window_id, index (by start), start_ms, end_ms, text, speakers.  A video of which nothing is left has no row.
    However many clips of a video have the same range and verdict, one of them is repaired and read for all.
    """
    segments, media = written(segments, "segments"), written(media, "media")
    words = written(R.timed_words(words, segments), "words")
    points = _points(words, segments, scenes)
    rows = clips.join(verdicts.hint("merge"), KEYS, "left").withColumn("verdict", F.coalesce("verdict", F.lit("accept"))).filter("verdict <> 'reject'")
    rows = rows.withColumn("shift_ms", F.coalesce("shift_ms", F.lit(0)))
    rows = written(rows.select(*KEYS, "start_ms", "end_ms", "verdict", "shift_ms", F.struct("start_ms", "end_ms", "verdict", "shift_ms").alias("_alike")), "verdicts")
    first = rows.groupBy("video_id", "_alike").agg(F.min("window_id").alias("window_id"))
    first = written(first.select(*KEYS, "_alike.start_ms", "_alike.end_ms", "_alike.verdict", "_alike.shift_ms", "_alike"), "ranges")
    clips = written(dealt(rows.select(*KEYS, "_alike"), first.select("video_id", "_alike", F.col("window_id").alias("_first")), ["video_id", "_alike"]).drop("_alike"), "clips")
    rows = first.drop("_alike")
    wider = rows.filter("verdict = 'expand' or shift_ms < 0")
    own = F.when(F.col("shift_ms") < 0, -F.col("shift_ms")).otherwise(12_000)
    moved = B.expand_for_context(wider.withColumn("lookback_ms", own), words, segments, _starts(points), max_ms=max_ms)
    same = rows.join(wider.select(KEYS).hint("merge"), KEYS, "left_anti").select(*KEYS, "start_ms", "end_ms")
    moved = written(moved.unionByName(same), "expanded")
    trimmed = written(B.trim_filler_opening(moved, written(S.build_sentences(words, segments), "sentences"), media=media, min_ms=min_ms, max_ms=max_ms), "trimmed")
    floored = trimmed.withColumn("floor_ms", F.when(F.col("trimmed"), F.col("start_ms")))
    refined = B.refine_boundaries(floored.drop("trimmed"), words, segments, points, media=media, min_ms=min_ms, max_ms=max_ms)
    opens = refined.filter("opens_mid_sentence").select(*KEYS, "start_ms", "end_ms")
    refined = written(B.expand_for_context(opens, words, segments, _starts(points), max_ms=max_ms).unionByName(refined.filter("not opens_mid_sentence").select(*KEYS, "start_ms", "end_ms")), "reopened")
    done = written(B.complete_ending(refined, words, segments, S.sentence_ends(words, segments, punctuated_only=True), media=media, min_ms=min_ms, max_ms=max_ms), "completed")
    said = written(R.text_in_window(done, words, segments).join(R.speakers_between(done, turns).hint("merge"), KEYS), "said")
    named = lambda table: table.withColumnRenamed("window_id", "_first")
    index = F.row_number().over(Window.partitionBy("video_id").orderBy("start_ms", "window_id"))
    out = written(dealt(clips, named(done), ["video_id", "_first"]).withColumn("index", index), "indexed")
    return dealt(out, named(said), ["video_id", "_first"]).select(*KEYS, "start_ms", "end_ms", "index", "text", "speakers")


def adjust_clips(adjustments: DataFrame, clips: DataFrame, words: DataFrame, segments: DataFrame, scenes: DataFrame, media: DataFrame, *, min_ms: int = 20_000, max_ms: int = 60_000) -> tuple[DataFrame, DataFrame]:
    """(clips, feedback) after manual adjustments (video_id, window_id, start_ms, end_ms): each is refused or snapped within 1.2 s.

    clips: (video_id, window_id, start_ms, end_ms, refused) with the adjusted ranges and why any was refused; feedback: a boundary_adjusted event with the
    old and new range of each clip that moved.
    """
    asked = adjustments.join(media.hint("merge"), "video_id").withColumn("refused", M.adjust_request(F.col("start_ms"), F.col("end_ms"), F.col("duration_ms")))
    fine = asked.filter("refused is null").select(*KEYS, "start_ms", "end_ms")
    segments = written(segments, "segments")
    words = written(R.timed_words(words, segments), "words")
    new = B.refine_boundaries(fine, words, segments, _points(words, segments, scenes), media=media, min_ms=min_ms, max_ms=max_ms, search_ms=1200)
    new = written(new.select(*KEYS, F.col("start_ms").alias("new_start"), F.col("end_ms").alias("new_end")), "adjusted")
    rows = clips.join(new.hint("merge"), KEYS, "left").join(asked.select(*KEYS, "refused").hint("merge"), KEYS, "left")
    out = rows.select(*KEYS, F.coalesce("new_start", "start_ms").alias("start_ms"), F.coalesce("new_end", "end_ms").alias("end_ms"), "refused")
    payload = F.to_json(F.struct(F.struct("start_ms", "end_ms").alias("from"), F.struct(F.col("new_start").alias("start_ms"), F.col("new_end").alias("end_ms")).alias("to")))
    feedback = rows.filter("new_start is not null").select(*KEYS, F.lit("boundary_adjusted").alias("event"), payload.alias("payload"))
    return out, feedback
