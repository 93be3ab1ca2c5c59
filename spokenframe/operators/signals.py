"""Loudness and frame statistics for videos and windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import _all, energy_between, events_between, overlapping, points_in
from .segments import mask_runs


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))


def percentile_where(value: str, cond: Column, p: float) -> Column:
    return F.percentile(F.when(cond, F.col(value)), F.lit(p))


def loudness_frames(pcm: DataFrame, *, rate: int, window_s: float = 0.10, hop_s: float = 0.05) -> DataFrame:
    """(video_id, frame_idx, rms_db) from samples (video_id, sample_idx, value).

    Each sample goes to every frame that covers it; a series shorter than a frame counts as
    filled with zeros.
    """
    size, hop = int(rate * window_s), int(rate * hop_s)
    n = pcm.groupBy("video_id").agg((F.max("sample_idx") + 1).alias("n"))
    frames = F.greatest(F.lit(1), F.floor((F.col("n") - size) / hop) + 1)
    rows = pcm.join(n.hint("merge"), "video_id").withColumn("last", F.least(F.floor(F.col("sample_idx") / hop), frames - 1)).withColumn("first", F.greatest(F.lit(0), F.ceil((F.col("sample_idx") - size + 1) / hop)))
    rows = rows.filter("first <= last").withColumn("frame_idx", F.explode(F.sequence("first", "last")))
    rms = F.sqrt(F.sum(F.col("value") * F.col("value")) / size)
    return rows.groupBy("video_id", "frame_idx").agg((20 * F.log10(F.greatest(rms, F.lit(1e-7)))).alias("rms_db"))


def envelope_modulation(frames: DataFrame, *, hop_s: float = 0.05, reach_s: float = 0.6) -> DataFrame:
    """(video_id, frame_idx, modulation): share of 3 to 8 Hz in the spectrum of the loudness around each frame.

    The frame sees half = int(reach / hop) frames before it and half - 1 after it.  0 for series shorter
    than 2 * half, fewer than 4 frames in sight, or a flat envelope.  frames: (video_id, frame_idx, rms).
    """
    half = int(reach_s / hop_s)
    v = Window.partitionBy("video_id").orderBy("frame_idx")
    rows = frames.select("video_id", "frame_idx", F.collect_list("rms").over(v.rowsBetween(-half, half - 1)).alias("seen"), F.count(F.lit(1)).over(Window.partitionBy("video_id")).alias("n"))

    @F.pandas_udf("double")
    def band_share(seen: pd.Series) -> pd.Series:
        """Rows of one length are transformed together."""
        sizes = seen.map(len).to_numpy()
        out = np.zeros(len(sizes))
        for size in np.unique(sizes[sizes >= 4]):
            at = np.flatnonzero(sizes == size)
            x = np.stack(seen.iloc[at].to_list()).astype(float)
            mag = np.abs(np.fft.rfft(x - x.mean(axis=1, keepdims=True), axis=1))
            f, total = np.arange(mag.shape[1]) / (size * hop_s), mag.sum(axis=1)
            band = mag[:, (f >= 3) & (f <= 8)].sum(axis=1)
            out[at] = np.divide(band, total, out=np.zeros(len(at)), where=total > 1e-9)
        return pd.Series(out)

    return rows.select("video_id", "frame_idx", F.when(F.col("n") >= 2 * half, band_share("seen")).otherwise(0.0).alias("modulation"))


def loudness_baseline(frames: DataFrame, *, below_top_db: float = 35) -> DataFrame:
    """(video_id, median_db, p95_db) of the voiced frames: those within below_top_db of the loudest."""
    top = frames.groupBy("video_id").agg(F.max("rms_db").alias("top"))
    return frames.join(top.hint("merge"), "video_id").filter(F.col("rms_db") > F.col("top") - below_top_db).groupBy("video_id").agg(F.percentile("rms_db", F.lit(0.5)).alias("median_db"), F.percentile("rms_db", F.lit(0.95)).alias("p95_db"))


def reaction_thresholds(frames: DataFrame) -> DataFrame:
    """(video_id, median_db, flat_thresh, gate_db): what counts as loud and noise-like in each video."""
    base = frames.groupBy("video_id").agg(F.percentile("rms_db", F.lit(0.5)).alias("median_db"), F.percentile("rms_db", F.lit(0.05)).alias("floor_db"))
    flat = frames.join(base.hint("merge"), "video_id").groupBy("video_id", "median_db", "floor_db").agg(percentile_where("flatness", F.col("rms_db") > F.col("median_db") - 12, 0.9).alias("p90"))
    return flat.select("video_id", "median_db", clip(3 * F.coalesce("p90", F.lit(0.0)), 0.12, 0.45).alias("flat_thresh"), F.greatest(F.col("floor_db") + 12, F.col("median_db") - 30).alias("gate_db"))


def audio_events(frames: DataFrame, hop_ms: int) -> DataFrame:
    """(video_id, kind, start_ms, end_ms, strength): silence, emphasis, and laughter or applause.

    frames: (video_id, frame_idx, rms_db, flatness, modulation).
    """
    known = frames.join(reaction_thresholds(frames).hint("merge"), "video_id")
    quiet = mask_runs(known, F.col("rms_db") < F.col("median_db") - 22, hop_ms, 450).withColumn("kind", F.lit("silence")).withColumn("strength", F.lit(1.0))
    loud = mask_runs(known, F.col("rms_db") > F.col("median_db") + 5, hop_ms, 350, clip((F.max("rms_db") - F.first("median_db")) / 15, 0, 1).alias("strength")).withColumn("kind", F.lit("emphasis"))
    kind = F.when(F.avg("modulation") > 0.32, "laughter").otherwise("applause").alias("kind")
    noise = mask_runs(known, (F.col("rms_db") > F.col("gate_db")) & (F.col("flatness") > F.col("flat_thresh")), hop_ms, 800, clip(F.avg("flatness") / F.first("flat_thresh") / 2, 0.2, 1).alias("strength"), kind)
    return quiet.unionByName(loud).unionByName(noise).select("video_id", "kind", "start_ms", "end_ms", "strength")


def loudness_levels(frames: DataFrame) -> DataFrame:
    """(video_id, median_db, voiced_db, loud_db): median of all frames, median and 95th percentile of the voiced ones."""
    middle = frames.groupBy("video_id").agg(F.percentile("rms_db", F.lit(0.5)).alias("median_db"))
    voiced = loudness_baseline(frames).select("video_id", F.col("median_db").alias("voiced_db"), F.col("p95_db").alias("loud_db"))
    return middle.join(voiced.hint("merge"), "video_id")


def rise(db: Column, voiced_db: Column, loud_db: Column) -> Column:
    """How far a frame rises from the usual loudness towards the loud one."""
    return clip((db - voiced_db) / F.greatest(F.lit(3.0), loud_db - voiced_db), 0, 1.5)


def shouting(above: Column) -> Column:
    """Aggregate of a window's rises; null without any."""
    return 0.6 * F.avg((above > 0.75).cast("int")) + 0.4 * clip(F.percentile(above, F.lit(0.95)), 0, 1)


def dynamics(db: Column, quiet: Column) -> Column:
    """Aggregate of a window's loudness and of which frames are silent; null without any."""
    spread = clip((F.percentile(db, F.lit(0.9)) - F.percentile(db, F.lit(0.1))) / 25, 0, 1)
    return clip(0.35 + 0.65 * spread - clip((F.avg(quiet.cast("int")) - 0.25) * 1.6, 0, 0.6), 0, 1)


def sorted_percentile(values: Column, p: float) -> Column:
    """percentile() of a sorted array without nulls, by the same arithmetic; null if it is empty."""
    at = (F.size(values) - 1) * F.lit(p)
    lo, hi = F.floor(at), F.ceil(at)
    low, high = F.get(values, lo.cast("int")), F.get(values, hi.cast("int"))
    return F.when(low == high, low).otherwise((hi - at) * low + (at - lo) * high)


def share_of(values: Column, holds) -> Column:
    """Share of the values of an array for which `holds`; null if it is empty."""
    n = F.size(values)
    return F.when(n > 0, F.size(F.filter(values, holds)).cast("double") / n)


def shouting_of(db: Column, voiced_db: Column, loud_db: Column) -> Column:
    """shouting() of the rises of a sorted array of loudness."""
    above = F.transform(db, lambda x: rise(x, voiced_db, loud_db))
    return 0.6 * share_of(above, lambda x: x > 0.75) + 0.4 * clip(sorted_percentile(above, 0.95), 0, 1)


def dynamics_of(db: Column, median_db: Column) -> Column:
    """dynamics() of a sorted array of loudness, frames 22 dB under the median being silent."""
    spread = clip((sorted_percentile(db, 0.9) - sorted_percentile(db, 0.1)) / 25, 0, 1)
    return F.when(F.size(db) > 0, clip(0.35 + 0.65 * spread - clip((share_of(db, lambda x: x < median_db - 22) - 0.25) * 1.6, 0, 0.6), 0, 1))


def shouting_score(windows: DataFrame, frames: DataFrame, hop_ms: int) -> DataFrame:
    """(video_id, window_id, shouting): how far, and how often, the window rises above the video's usual loudness."""
    heard = energy_between(windows, frames, hop_ms).join(loudness_baseline(frames).hint("merge"), "video_id")
    found = heard.withColumn("above", rise(F.col("rms_db"), F.col("median_db"), F.col("p95_db"))).groupBy("video_id", "window_id").agg(shouting(F.col("above")).alias("shouting"))
    return _all(windows, found, shouting=0.0)


def switches(turns: Column) -> Column:
    """How often the speaker changes in an ordered array of turns; a turn without a speaker changes nothing."""
    n = F.size(turns)
    at = F.filter(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda k: (k <= n) & F.coalesce(F.try_element_at(turns, k)["speaker"] != F.try_element_at(turns, k - 1)["speaker"], F.lit(False)))
    return F.size(at)


def exchange_rate(turns: Column, ms: Column) -> Column:
    """Speaker changes of an ordered array of turns, 12 a minute being 1; 0 for fewer than two turns."""
    return F.when((F.size(turns) >= 2) & (ms > 0), clip(switches(turns) / (ms / 60_000) / 12, 0, 1)).otherwise(0.0)


def exchange_rate_score(windows: DataFrame, turns: DataFrame) -> DataFrame:
    """(video_id, window_id, exchange): speaker switches among the overlapping turns, 12 a minute being 1."""
    said = F.array_sort(F.collect_list(F.struct("turn_idx", "speaker")))
    found = overlapping(windows, turns).groupBy("video_id", "window_id", "w_start", "w_end").agg(said.alias("turns"))
    return _all(windows, found.select("video_id", "window_id", exchange_rate(F.col("turns"), F.col("w_end") - F.col("w_start")).alias("exchange")), exchange=0.0)


def dynamics_score(windows: DataFrame, frames: DataFrame, hop_ms: int) -> DataFrame:
    """(video_id, window_id, dynamics): range of loudness, less long silences; 0.3 without frames."""
    median = frames.groupBy("video_id").agg(F.percentile("rms_db", F.lit(0.5)).alias("median_db"))
    heard = energy_between(windows, frames, hop_ms).join(median.hint("merge"), "video_id")
    found = heard.groupBy("video_id", "window_id").agg(dynamics(F.col("rms_db"), F.col("rms_db") < F.col("median_db") - 22).alias("dynamics"))
    return _all(windows, found, dynamics=0.3)


def reaction_score(windows: DataFrame, events: DataFrame) -> DataFrame:
    """(video_id, window_id, reaction): strengths of the overlapping events, weighted by kind."""
    weight = F.when(F.col("kind").isin("laughter", "cheer"), 0.45).when(F.col("kind") == "applause", 0.35).when(F.col("kind") == "emphasis", 0.12).otherwise(0.0)
    found = events_between(windows, events).groupBy("video_id", "window_id").agg(clip(F.sum(F.col("strength") * weight), 0, 1).alias("reaction"))
    return _all(windows, found, reaction=0.0)


def event_kinds(windows: DataFrame, events: DataFrame) -> DataFrame:
    """(video_id, window_id, kinds): sorted distinct kinds of overlapping events but silence."""
    found = events_between(windows, events.filter("kind <> 'silence'")).groupBy("video_id", "window_id").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))
    return _all(windows, found, kinds=F.array().cast("array<string>"))


def visual_interest(windows: DataFrame, frames: DataFrame) -> DataFrame:
    """(video_id, window_id, interest) from frames (t_ms, n_faces, motion, sharpness, brightness); 0.4 without frames."""
    light = F.avg("brightness")
    score = 0.30 + 0.30 * F.avg((F.col("n_faces") > 0).cast("int")) + 0.20 * clip(F.avg("motion") / 0.08, 0, 1) + 0.10 * clip(F.avg("sharpness") / 0.5, 0, 1) - F.when((light < 0.12) | (light > 0.94), 0.20).otherwise(0.0)
    found = points_in(windows, frames).groupBy("video_id", "window_id").agg(clip(score, 0, 1).alias("interest"))
    return _all(windows, found, interest=0.4)


def dominant_face_count(windows: DataFrame, frames: DataFrame) -> DataFrame:
    """(video_id, window_id, faces): whole part of the median number of faces a frame; 0 without frames."""
    found = points_in(windows, frames).groupBy("video_id", "window_id").agg(F.floor(F.percentile("n_faces", F.lit(0.5))).cast("bigint").alias("faces"))
    return _all(windows, found, faces=0)


def face_track(windows: DataFrame, frames: DataFrame, faces: DataFrame) -> DataFrame:
    """(video_id, window_id, t_ms, faces): the boxes of each frame of each window, by face_no; frames without faces have none."""
    boxes = faces.groupBy("video_id", "t_ms").agg(F.array_sort(F.collect_list(F.struct("face_no", "x", "y", "w", "h"))).alias("faces"))
    seen = points_in(windows, frames).join(boxes.hint("merge"), ["video_id", "t_ms"], "left")
    return seen.select("video_id", "window_id", "t_ms", F.coalesce("faces", F.array().cast(boxes.schema["faces"].dataType)).alias("faces"))


def subtitle_band(rows: DataFrame, *, least_profiles: int = 8) -> DataFrame:
    """(video_id, band_top): where a burnt-in caption band begins, as a share of the height.

    rows: (video_id, profile_idx, row, n_rows, density), glyph density of each image row of a sample of frames.
    Needs least_profiles profiles.  The peak lies in the lower 40 %, has 0.018 and 1.6 times the 90th percentile of
    the upper 60 %.  The band grows up from it over rows above max(1.2 * that, 0.25 * peak), over gaps of up to 8 %.
    """
    enough = rows.groupBy("video_id").agg(F.countDistinct("profile_idx").alias("k")).filter(F.col("k") >= least_profiles).select("video_id")
    mean = rows.join(enough.hint("merge"), "video_id").groupBy("video_id", "row", "n_rows").agg(F.avg("density").alias("d"))
    lower = F.col("row") >= F.floor(F.col("n_rows") * 0.6)
    base = mean.groupBy("video_id", "n_rows").agg(
        F.percentile(F.when(~lower, F.col("d")), F.lit(0.9)).alias("base"),
        F.max(F.when(lower, F.col("d"))).alias("peak"), F.max_by(F.when(lower, F.col("row")), F.when(lower, F.struct("d", -F.col("row")))).alias("at"),
    )
    base = base.filter((F.col("peak") >= 0.018) & (F.col("peak") >= 1.6 * F.col("base"))).withColumn("least", F.greatest(1.2 * F.col("base"), 0.25 * F.col("peak")))
    over = mean.join(base.hint("merge"), ["video_id", "n_rows"]).filter((F.col("d") >= F.col("least")) & (F.col("row") <= F.col("at")))
    up = Window.partitionBy("video_id").orderBy(F.desc("row"))
    gap = over.withColumn("gap", F.coalesce(F.lag("row").over(up) - F.col("row") - 1 > F.col("n_rows") * 0.08, F.lit(False)).cast("int"))
    first = gap.withColumn("cut", F.sum("gap").over(up.rowsBetween(Window.unboundedPreceding, 0))).filter("cut = 0").groupBy("video_id", "n_rows").agg(F.min("row").alias("top"))
    return first.select("video_id", clip(F.col("top") / F.col("n_rows") - 0.015, 0.80, 0.97).alias("band_top"))


def token_counts(segments: DataFrame) -> DataFrame:
    """(video_id, token, n): lower-cased words of the transcript."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z']+)"), F.lit(1)))
    return segments.select("video_id", words.alias("token")).groupBy("video_id", "token").agg(F.count(F.lit(1)).alias("n"))

