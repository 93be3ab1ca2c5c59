"""Interval and as-of joins over time ranges inside each video.

Times are whole milliseconds.  Spark has no interval join, so both sides are cut into
bins of a fixed width and meet by (video_id, bin); the exact predicate is tested after
that, in the first bin that a pair shares, so that no pair comes twice.  The
cost follows the pairs that share a bin, and a long video spreads over its bins.
A range of hours or days has many bins; where ranges may be so long, `long` keeps each
row to some 70 bins by wider bins for longer ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

BIN_MS = 30_000
#: With `long`, a range of more than FAN bins goes to bins FAN times as wide, at most LEVELS - 1 times.
FAN, LEVELS = 64, 4


def _bins(df: DataFrame, lo: Column, hi: Column, width: int) -> DataFrame:
    first = F.floor(lo / width)
    return df.withColumn("_first", first).withColumn("_bin", F.explode(F.sequence(first, F.greatest(first, F.floor(hi / width)))))


def _levelled(df: DataFrame, lo: Column, hi: Column, width: int, *, left: bool) -> DataFrame:
    """A row for each bin of a range at the level of its length (its own), and for each that it visits at the levels above, where it has few.

    Tag 0 is for own bins of the left side and all bins of the right one, tag 1 for visited bins of the left side and own bins of the right one.
    """
    spans = F.floor(F.greatest(lo, hi) / width) - F.floor(lo / width)
    level = F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        level = F.when(spans <= FAN ** (k + 1), k).otherwise(level)

    def places(k: int, tag: int, holds: Column) -> Column:
        first = F.floor(lo / (width * FAN**k))
        bins = F.sequence(first, F.greatest(first, F.floor(hi / (width * FAN**k))))
        return F.when(holds, F.transform(bins, lambda b: F.struct(F.lit(k).alias("_level"), F.lit(tag).alias("_tag"), b.alias("_bin"), first.alias("_first"))))

    found = []
    for k in range(LEVELS):
        tags = (level == k, level < k) if left else (level <= k, level == k)
        found += [places(k, tag, holds) for tag, holds in enumerate(tags) if k or not tag]  # nothing visits the lowest level
    return df.withColumn("_place", F.explode(F.flatten(F.array_compact(F.array(*found))))).select(*df.columns, "_place.*")


def range_join(left: DataFrame, right: DataFrame, left_range: tuple[str, str], right_range: tuple[str, str], on: Column, *, key: str = "video_id", width: int = BIN_MS, long: bool = False) -> DataFrame:
    """Pairs of rows of the same key whose closed ranges share a moment and for which `on` holds.

    Apart from the key, the sides have no column in common.  Reversed ranges count as
    their first moment.  Rows without a partner are not returned.  With `long`, a pair meets at the level
    of its longer range: the left one's own bins meet all bins of the right (tag 0), bins
    that it visits meet the right one's own (tag 1).
    """
    if long:
        a = _levelled(left, F.col(left_range[0]), F.col(left_range[1]), width, left=True).withColumnRenamed("_first", "_a")
        b = _levelled(right, F.col(right_range[0]), F.col(right_range[1]), width, left=False).withColumnRenamed("_first", "_b")
        joined = a.join(b.hint("merge"), [key, "_level", "_tag", "_bin"])
        return joined.filter((F.col("_bin") == F.greatest("_a", "_b")) & on).drop("_level", "_tag", "_bin", "_a", "_b")
    a = _bins(left, F.col(left_range[0]), F.col(left_range[1]), width).withColumnRenamed("_first", "_a")
    b = _bins(right, F.col(right_range[0]), F.col(right_range[1]), width).withColumnRenamed("_first", "_b")
    joined = a.join(b.hint("merge"), [key, "_bin"])  # sizes after explode are not known, so no automatic broadcast
    return joined.filter((F.col("_bin") == F.greatest("_a", "_b")) & on).drop("_bin", "_a", "_b")


def _window(windows: DataFrame) -> DataFrame:
    return windows.select("video_id", "window_id", F.col("start_ms").alias("w_start"), F.col("end_ms").alias("w_end"))


def _all(windows: DataFrame, found: DataFrame, **defaults) -> DataFrame:
    """Every window once, with what was found, or the defaults."""
    out = windows.select("video_id", "window_id").join(found.hint("merge"), ["video_id", "window_id"], "left")
    for name, value in defaults.items():
        out = out.withColumn(name, F.coalesce(F.col(name), value if isinstance(value, Column) else F.lit(value)))
    return out


def overlapping(windows: DataFrame, items: DataFrame, *, closed: bool = False, long: bool = False) -> DataFrame:
    """Pairs of windows and items (start_ms, end_ms) that overlap: strictly, or with shared ends if closed."""
    cond = (F.col("end_ms") > F.col("w_start")) & (F.col("start_ms") < F.col("w_end"))
    if closed:
        cond = (F.col("end_ms") >= F.col("w_start")) & (F.col("start_ms") <= F.col("w_end"))
    return range_join(_window(windows), items, ("w_start", "w_end"), ("start_ms", "end_ms"), cond, long=long)


def points_in(windows: DataFrame, points: DataFrame, at: str = "t_ms", *, long: bool = False) -> DataFrame:
    """Pairs of windows and points inside their closed range."""
    return range_join(_window(windows), points, ("w_start", "w_end"), (at, at), F.col(at).between(F.col("w_start"), F.col("w_end")), long=long)


def joined_text(order: list[str], text: str, separator: str = " ") -> Column:
    """Texts of a group in order, blanks left out."""
    pairs = F.array_sort(F.collect_list(F.struct(*order, F.trim(F.col(text)).alias("_t"))))
    return F.concat_ws(separator, F.filter(F.transform(pairs, lambda x: x["_t"]), lambda t: t != ""))


def text_between(windows: DataFrame, segments: DataFrame, *, long: bool = False) -> DataFrame:
    """(video_id, window_id, text, n_segments): texts of the segments that strictly overlap each window."""
    found = overlapping(windows, segments, long=long).groupBy("video_id", "window_id").agg(joined_text(["segment_id"], "text").alias("text"), F.count(F.lit(1)).alias("n_segments"))
    return _all(windows, found, text="", n_segments=0)


def timed_words(words: DataFrame, segments: DataFrame) -> DataFrame:
    """words with seg_start and seg_end, the times of their segment; words that have them already stay as they are."""
    if "seg_start" in words.columns:
        return words
    seg = segments.select("video_id", "segment_id", F.col("start_ms").alias("seg_start"), F.col("end_ms").alias("seg_end"))
    return words.join(seg.hint("merge"), ["video_id", "segment_id"])


def _spoken(lo: Column, hi: Column) -> Column:
    """Whether a timed word's midpoint lies in a range and its segment strictly overlaps it."""
    middle = F.col("start_ms") + F.col("end_ms")
    return (middle >= 2 * lo) & (middle <= 2 * hi) & (F.col("seg_end") > lo) & (F.col("seg_start") < hi)


def words_in_windows(windows: DataFrame, words: DataFrame, segments: DataFrame, *, long: bool = False) -> DataFrame:
    """A row for each word whose midpoint lies in a window and whose segment strictly overlaps it."""
    return range_join(_window(windows), timed_words(words, segments), ("w_start", "w_end"), ("start_ms", "end_ms"), _spoken(F.col("w_start"), F.col("w_end")), long=long)


def _words_said(reach: DataFrame, words: DataFrame, spans: list[str]) -> DataFrame:
    """(video_id, window_id, <name>, <name>_first for each span <name>_lo to <name>_hi of reach): the words spoken in it, null where there are none.

    The words of a bin, each in that of its midpoint, meet a window as one array, from which each span takes its own: a window has a row for each
    of its bins, not for each of its words.
    """
    c = F.col
    middle = c("start_ms") + c("end_ms")
    word = F.struct("word_idx", F.trim("word").alias("t"), middle.alias("middle"), "start_ms", "seg_start", "seg_end")
    binned = words.select("video_id", F.floor(middle / (2 * BIN_MS)).alias("_bin"), word.alias("w")).groupBy("video_id", "_bin").agg(F.collect_list("w").alias("words"))
    met = _bins(reach, c("w_start"), c("w_end"), BIN_MS).drop("_first", "w_start", "w_end").join(binned.hint("merge"), ["video_id", "_bin"])

    def inside(n: str) -> Column:
        lo, hi = c(f"{n}_lo"), c(f"{n}_hi")
        return F.filter("words", lambda w: (w["middle"] >= 2 * lo) & (w["middle"] <= 2 * hi) & (w["seg_end"] > lo) & (w["seg_start"] < hi))

    met = met.select("video_id", "window_id", *[inside(n).alias(n) for n in spans])
    short = lambda n: F.transform(n, lambda w: F.struct(w["word_idx"], w["t"]))
    met = met.select("video_id", "window_id", *[short(n).alias(n) for n in spans], *[F.array_min(F.transform(n, lambda w: w["start_ms"])).alias(f"{n}_first") for n in spans])
    met = met.groupBy("video_id", "window_id").agg(*[F.flatten(F.collect_list(n)).alias(n) for n in spans], *[F.min(f"{n}_first").alias(f"{n}_first") for n in spans])
    joined = lambda n: F.concat_ws(" ", F.filter(F.transform(F.array_sort(n), lambda w: w["t"]), lambda t: t != ""))
    return met.select("video_id", "window_id", *[F.when(F.size(n) > 0, joined(n)).alias(n) for n in spans], *[f"{n}_first" for n in spans])


def texts_in(windows: DataFrame, words: DataFrame, segments: DataFrame, **spans: tuple[Column, Column]) -> DataFrame:
    """(video_id, window_id, <name>, <name>_first for each span): what is said in several ranges of each window, and when the first word starts.

    spans: name=(from, to) over the columns of windows.  One pass over the words serves all
    spans.  A span without words takes the texts of the segments that strictly overlap
    it; only windows that have such a span meet the segments.
    """
    keys = ["video_id", "window_id"]
    reach = windows.select(*keys, *[c.cast("bigint").alias(f"{n}_{end}") for n, span in spans.items() for end, c in zip(("lo", "hi"), span, strict=True)])
    edges = {end: [F.col(f"{n}_{end}") for n in spans] for end in ("lo", "hi")}
    reach = reach.withColumn("w_start", F.least(*edges["lo"]) if len(spans) > 1 else edges["lo"][0]).withColumn("w_end", F.greatest(*edges["hi"]) if len(spans) > 1 else edges["hi"][0])
    bounds = [c for c in reach.columns if c not in keys]

    def found(rows: DataFrame, table: DataFrame, order: str, text: str, holds) -> DataFrame:
        """The texts of each span by order, null where there is none."""
        inside = {n: holds(F.col(f"{n}_lo"), F.col(f"{n}_hi")) for n in spans}
        any_span = None
        for cond in inside.values():
            any_span = cond if any_span is None else any_span | cond
        item = F.struct(order, F.trim(F.col(text)).alias("_t"))
        out = []
        for n, cond in inside.items():
            parts = F.array_sort(F.collect_list(F.when(cond, item)))
            joined = F.concat_ws(" ", F.filter(F.transform(parts, lambda x: x["_t"]), lambda t: t != ""))
            out += [F.when(F.count(F.when(cond, 1)) > 0, joined).alias(n), F.min(F.when(cond, F.col("start_ms"))).alias(f"{n}_first")]
        return range_join(rows, table.select("video_id", order, text, *[c for c in table.columns if c in ("start_ms", "end_ms", "seg_start", "seg_end")]), ("w_start", "w_end"), ("start_ms", "end_ms"), any_span).groupBy(*keys).agg(*out)

    said = written(reach.join(_words_said(reach, timed_words(words, segments), list(spans)).hint("merge"), keys, "left"), "said")
    silent = said.filter(" or ".join(f"{n} is null" for n in spans)).select(*keys, *bounds)
    strictly = lambda lo, hi: (F.col("end_ms") > lo) & (F.col("start_ms") < hi)
    whole = found(silent, segments, "segment_id", "text", strictly).select(*keys, *[F.col(n).alias(f"{n}_seg") for n in spans])
    rows = said.join(whole.hint("merge"), keys, "left")
    return rows.select(*keys, *[F.coalesce(n, f"{n}_seg", F.lit("")).alias(n) for n in spans], *[f"{n}_first" for n in spans])


def words_between(windows: DataFrame, words: DataFrame, segments: DataFrame, *, long: bool = False) -> DataFrame:
    """(video_id, window_id, n_words, words): the words of each window in order."""
    found = words_in_windows(windows, words, segments, long=long).groupBy("video_id", "window_id").agg(
        F.count(F.lit(1)).alias("n_words"), F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "word"))), lambda x: x["word"]).alias("words")
    )
    return _all(windows, found, n_words=0, words=F.array().cast("array<string>"))


def text_in_window(windows: DataFrame, words: DataFrame, segments: DataFrame) -> DataFrame:
    """(video_id, window_id, text): the window's words, or the segment texts where it has none."""
    return texts_in(windows, words, segments, text=(F.col("start_ms"), F.col("end_ms"))).drop("text_first")


def speaker_at(probes: DataFrame, turns: DataFrame) -> DataFrame:
    """(video_id, probe_id, speaker): first turn in list order with start <= t < end, else null."""
    t = probes.select("video_id", "probe_id", F.col("t_ms").alias("p"))
    hit = range_join(t, turns, ("p", "p"), ("start_ms", "end_ms"), (F.col("start_ms") <= F.col("p")) & (F.col("p") < F.col("end_ms")))
    found = hit.groupBy("video_id", "probe_id").agg(F.min_by("speaker", "turn_idx").alias("speaker"))
    return probes.select("video_id", "probe_id").join(found.hint("merge"), ["video_id", "probe_id"], "left")


def speakers_between(windows: DataFrame, turns: DataFrame, *, long: bool = False) -> DataFrame:
    """(video_id, window_id, speakers): distinct speakers of strictly overlapping turns by first appearance."""
    first = overlapping(windows, turns, long=long).groupBy("video_id", "window_id", "speaker").agg(F.min("turn_idx").alias("turn_idx"))
    found = first.groupBy("video_id", "window_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn_idx", "speaker"))), lambda x: x["speaker"]).alias("speakers"))
    return _all(windows, found, speakers=F.array().cast("array<string>"))


def frames_between(windows: DataFrame, frames: DataFrame, *, long: bool = False) -> DataFrame:
    """A row for each frame at a time inside a closed window."""
    return points_in(windows, frames, long=long)


def events_between(windows: DataFrame, events: DataFrame, *, long: bool = False) -> DataFrame:
    """A row for each event that strictly overlaps a window."""
    return overlapping(windows, events, long=long)


def energy_between(windows: DataFrame, audio_frames: DataFrame, hop_ms: int, *, long: bool = False) -> DataFrame:
    """A row for each loudness frame of a window: from int(start / hop) up to, not including, int(end / hop)."""
    w = _window(windows).withColumn("lo", F.greatest(F.lit(0), F.floor(F.col("w_start") / hop_ms))).withColumn("hi", F.floor(F.col("w_end") / hop_ms) - 1)
    return range_join(w, audio_frames, ("lo", "hi"), ("frame_idx", "frame_idx"), F.col("frame_idx").between(F.col("lo"), F.col("hi")), width=max(1, BIN_MS // hop_ms), long=long)


def in_any_span(probes: DataFrame, spans: DataFrame, *, long: bool = False) -> DataFrame:
    """(video_id, probe_id, inside): whether t lies in any closed span."""
    t = probes.select("video_id", "probe_id", F.col("t_ms").alias("p"))
    hit = range_join(t, spans, ("p", "p"), ("start_ms", "end_ms"), F.col("p").between(F.col("start_ms"), F.col("end_ms")), long=long).select("video_id", "probe_id").distinct().withColumn("inside", F.lit(True))
    return probes.select("video_id", "probe_id").join(hit.hint("merge"), ["video_id", "probe_id"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def scene_count_between(windows: DataFrame, scenes: DataFrame, *, long: bool = False) -> DataFrame:
    """(video_id, window_id, scene_count): scenes that strictly overlap each window."""
    return _all(windows, overlapping(windows, scenes, long=long).groupBy("video_id", "window_id").agg(F.count(F.lit(1)).alias("scene_count")), scene_count=0)


def scene_edges(scenes: DataFrame) -> DataFrame:
    return scenes.select("video_id", F.explode(F.array("start_ms", "end_ms")).alias("point")).distinct()


def near_points(probes: DataFrame, points: DataFrame, before_ms: int, after_ms: int) -> DataFrame:
    """Pairs of probes and points with t - before <= point <= t + after."""
    t = probes.select("video_id", "probe_id", F.col("t_ms").alias("p")).withColumn("lo", F.col("p") - before_ms).withColumn("hi", F.col("p") + after_ms)
    return range_join(t, points, ("lo", "hi"), ("point", "point"), F.col("point").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def _probed(probes: DataFrame, found: DataFrame) -> DataFrame:
    return probes.select("video_id", "probe_id").join(found.hint("merge"), ["video_id", "probe_id"], "left")


def scene_boundaries_near(probes: DataFrame, scenes: DataFrame, window_ms: int = 1500) -> DataFrame:
    """(video_id, probe_id, edges): distinct scene edges within the window, sorted."""
    found = near_points(probes, scene_edges(scenes), window_ms, window_ms).groupBy("video_id", "probe_id").agg(F.sort_array(F.collect_set("point")).alias("edges"))
    return _probed(probes, found).withColumn("edges", F.coalesce("edges", F.array().cast("array<bigint>")))


def nearest_boundary(probes: DataFrame, points: DataFrame, window_ms: int) -> DataFrame:
    """(video_id, probe_id, point): the nearest point within the window; of two as near, the later."""
    found = near_points(probes, points, window_ms, window_ms).groupBy("video_id", "probe_id").agg(F.min_by("point", F.struct(F.abs(F.col("point") - F.col("p")), -F.col("point"))).alias("point"))
    return _probed(probes, found)


def word_at(probes: DataFrame, words: DataFrame) -> DataFrame:
    """(video_id, probe_id, word_idx, word, mid_word): the first word whose closed range holds t; mid_word: more than 20 ms inside it."""
    t = probes.select("video_id", "probe_id", F.col("t_ms").alias("p"))
    hit = range_join(t, words, ("p", "p"), ("start_ms", "end_ms"), F.col("p").between(F.col("start_ms"), F.col("end_ms")))
    inner = (F.col("p") > F.col("start_ms") + 20) & (F.col("p") < F.col("end_ms") - 20)
    found = hit.groupBy("video_id", "probe_id").agg(F.min_by(F.struct("word_idx", "word", inner.alias("mid_word")), F.struct("start_ms", "word_idx")).alias("w"))
    return _probed(probes, found).select("video_id", "probe_id", "w.word_idx", "w.word", F.coalesce("w.mid_word", F.lit(False)).alias("mid_word"))


def next_boundary(probes: DataFrame, points: DataFrame, limit_ms: int) -> DataFrame:
    """(video_id, probe_id, point): the first point after t, at most limit away."""
    found = near_points(probes, points, 0, limit_ms).filter(F.col("point") > F.col("p")).groupBy("video_id", "probe_id").agg(F.min("point").alias("point"))
    return _probed(probes, found)


def previous_boundary(probes: DataFrame, points: DataFrame, lookback_ms: int) -> DataFrame:
    """(video_id, probe_id, point): the last point before t, at most lookback away."""
    found = near_points(probes, points, lookback_ms, 0).filter(F.col("point") < F.col("p")).groupBy("video_id", "probe_id").agg(F.max("point").alias("point"))
    return _probed(probes, found)


def surrounding_context(windows: DataFrame, segments: DataFrame, reach_ms: int = 25_000, chars: int = 600) -> DataFrame:
    """(video_id, window_id, before, after): texts around each window, cut to the chars next to it."""
    def shifted(lo: Column, hi: Column) -> DataFrame:
        return text_between(windows.select("video_id", "window_id", lo.alias("start_ms"), hi.alias("end_ms")), segments)

    before = shifted(F.greatest(F.lit(0), F.col("start_ms") - reach_ms), F.col("start_ms")).select("video_id", "window_id", F.right("text", F.lit(chars)).alias("before"))
    after = shifted(F.col("end_ms"), F.col("end_ms") + reach_ms).select("video_id", "window_id", F.left("text", F.lit(chars)).alias("after"))
    return before.join(after.hint("merge"), ["video_id", "window_id"])


def time_overlap_ratio(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Overlap divided by the shorter duration; 0 if disjoint or empty."""
    overlap = F.least(a_end, b_end) - F.greatest(a_start, b_start)
    shorter = F.least(a_end - a_start, b_end - b_start)
    return F.when((overlap > 0) & (shorter > 0), overlap / shorter).otherwise(F.lit(0.0))


def trailing_silence(probes: DataFrame, silences: DataFrame, lookahead_ms: int = 2000) -> DataFrame:
    """(video_id, probe_id, silence_ms): what is left of the first silence at t (a quarter second of grace), at most lookahead."""
    t = probes.select("video_id", "probe_id", F.col("t_ms").alias("p")).withColumn("q", F.col("p") + 250)
    wide = silences.withColumn("late", F.col("end_ms") + 250)
    hit = range_join(t, wide, ("q", "q"), ("start_ms", "late"), F.col("q").between(F.col("start_ms"), F.col("late")))
    found = hit.groupBy("video_id", "probe_id").agg(F.min_by(F.struct("end_ms", "p"), "start_ms").alias("x"))
    left = F.least(F.col("x.end_ms"), F.col("x.p") + lookahead_ms) - F.col("x.p")
    return _probed(probes, found).select("video_id", "probe_id", F.coalesce(left, F.lit(0)).alias("silence_ms"))
