"""Boundary repair: proposed windows move to sentence starts and ends, pauses and scene cuts.

Windows are (video_id, window_id, start_ms, end_ms) with the optional columns min_ms,
max_ms, total_ms and floor_ms; limits given as parameters fill what is missing.
Points are found by bucketed joins once for all windows, decisions are column expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.text import is_low_value, starts_dependently, words_of
from ..sources.shared import written
from .ranges import near_points, overlapping, range_join, text_in_window, texts_in, timed_words, words_in_windows
from .segments import ends_sentence, pause_points, sentence_ends, sentence_starts

LEAD_IN, LEAD_OUT = 180, 350
FORWARD_START, FORWARD_END = 6000, 8000
#: How far a scene cut may lie.
CUT_REACH = 1200
KEYS = ["video_id", "window_id"]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _with_limits(windows: DataFrame, min_ms: int, max_ms: int, media: DataFrame | None) -> DataFrame:
    for name, value in (("min_ms", min_ms), ("max_ms", max_ms)):
        windows = windows if name in windows.columns else windows.withColumn(name, F.lit(value).cast("bigint"))
    if "total_ms" not in windows.columns:
        windows = windows.join(media.select("video_id", F.col("duration_ms").alias("total_ms")).hint("merge"), "video_id", "left") if media is not None else windows.withColumn("total_ms", F.lit(None).cast("bigint"))
    return windows if "floor_ms" in windows.columns else windows.withColumn("floor_ms", F.lit(None).cast("bigint"))


def boundary_points(words: DataFrame, segments: DataFrame, scenes: DataFrame) -> DataFrame:
    """(video_id, point, kind): all points that edges snap to: sentence starts and ends, pauses and scene cuts."""
    kinds = {"start": sentence_starts(words, segments), "end": sentence_ends(words, segments), "pause": pause_points(words), "cut": scenes.select("video_id", F.col("start_ms").alias("point")).distinct()}
    out = None
    for kind, points in kinds.items():
        rows = points.select("video_id", "point", F.lit(kind).alias("kind"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _edges(windows: DataFrame, start: str, end: str) -> DataFrame:
    """Two rows of each window: (keys, edge, p, floor_ms)."""
    edge = F.explode(F.array(F.struct(F.lit("start").alias("edge"), F.col(start).cast("bigint").alias("p")), F.struct(F.lit("end").alias("edge"), F.col(end).cast("bigint").alias("p"))))
    return windows.select(*KEYS, "floor_ms", edge.alias("x")).select(*KEYS, "floor_ms", "x.edge", "x.p")


def _snapped(windows: DataFrame, points: DataFrame, search_ms: int) -> DataFrame:
    """(keys, ss_near, ss_next, sc_near, sp_near, es_near, es_next, ep_near, ec_near), one join for both edges and all kinds of points.

    near: the nearest point within reach, of equals the later; next: the first point ahead.
    """
    c = F.col
    probes = _edges(windows, "start_ms", "end_ms").withColumn("lo", c("p") - max(search_ms, CUT_REACH)).withColumn("hi", c("p") + F.when(c("edge") == "start", max(search_ms, CUT_REACH, FORWARD_START)).otherwise(max(search_ms, CUT_REACH, FORWARD_END)))
    hit = range_join(probes, points, ("lo", "hi"), ("point", "point"), c("point").between(c("lo"), c("hi")))
    free = c("floor_ms").isNull() | (c("point") >= c("floor_ms") - 50)
    off = F.abs(c("point") - c("p"))

    def near(edge: str, kind: str, reach: int, more: Column | None = None) -> Column:
        ok = (c("edge") == edge) & (c("kind") == kind) & (off <= reach)
        ok = ok if more is None else ok & more
        return F.min_by(F.when(ok, c("point")), F.when(ok, F.struct(off, -c("point"))))

    def following(edge: str, kind: str, reach: int, more: Column | None = None) -> Column:
        ok = (c("edge") == edge) & (c("kind") == kind) & (c("point") > c("p")) & (c("point") <= c("p") + reach)
        return F.min(F.when(ok if more is None else ok & more, c("point")))

    return hit.groupBy(*KEYS).agg(
        near("start", "start", search_ms, free).alias("ss_near"), following("start", "start", FORWARD_START, free).alias("ss_next"), near("start", "cut", CUT_REACH).alias("sc_near"), near("start", "pause", search_ms).alias("sp_near"),
        near("end", "end", search_ms).alias("es_near"), following("end", "end", FORWARD_END).alias("es_next"), near("end", "pause", search_ms).alias("ep_near"), near("end", "cut", CUT_REACH).alias("ec_near"),
    )


def _whole_words(windows: DataFrame, words: DataFrame) -> DataFrame:
    """(keys, s1_ws, e1_we): where the word at s1 starts, and where the word at e1 ends."""
    c = F.col
    hit = range_join(_edges(windows, "s1", "e1"), words.select("video_id", "word_idx", "start_ms", "end_ms"), ("p", "p"), ("start_ms", "end_ms"), c("p").between(c("start_ms"), c("end_ms")))
    first = lambda edge, value: F.min_by(F.when(c("edge") == edge, c(value)), F.when(c("edge") == edge, F.struct("start_ms", "word_idx")))
    return hit.groupBy(*KEYS).agg(first("start", "start_ms").alias("s1_ws"), first("end", "end_ms").alias("e1_we"))


def refine_boundaries(windows: DataFrame, words: DataFrame, segments: DataFrame, points: DataFrame, *, media: DataFrame | None = None, min_ms: int = 20_000, max_ms: int = 60_000, search_ms: int = 2500, read: bool = True) -> DataFrame:
    """(keys, start_ms, end_ms, start_kind, end_kind, opens_mid_sentence, ends_mid_sentence); points as from boundary_points.

    Unless read, the last two are left out, and the words aren't read for them.

    Starts prefer a sentence start near by, the next one ahead, a scene cut, a pause; ends a
    sentence end near by, the next one ahead, a pause, a scene cut.  Then no word is cut, a
    little is added, short windows grow and long ones lose their front.
    """
    w = _with_limits(windows, min_ms, max_ms, media)
    w = w.join(_snapped(w, points, search_ms).hint("merge"), KEYS, "left")
    c = F.col
    ahead = F.when(c("end_ms") - c("ss_next") >= c("min_ms"), c("ss_next"))
    w = w.withColumn("s1", F.coalesce("ss_near", ahead, "sc_near", "sp_near", "start_ms")).withColumn(
        "sk", F.when(c("ss_near").isNotNull(), "sentence").when(ahead.isNotNull(), "sentence(forward)").when(c("sc_near").isNotNull(), "scene").when(c("sp_near").isNotNull(), "pause").otherwise("requested"))
    late = F.when(c("es_next") - c("s1") <= c("max_ms"), c("es_next"))
    w = w.withColumn("e1", F.coalesce("es_near", late, "ep_near", "ec_near", "end_ms")).withColumn(
        "ek", F.when(c("es_near").isNotNull(), "sentence").when(late.isNotNull(), "sentence(forward)").when(c("ep_near").isNotNull(), "pause").when(c("ec_near").isNotNull(), "scene").otherwise("requested"))
    w = written(w.select(*KEYS, "min_ms", "max_ms", "total_ms", "floor_ms", "s1", "sk", "e1", "ek"), "snapped")
    w = w.join(_whole_words(w, words).hint("merge"), KEYS, "left")
    in_s, in_e = F.coalesce(c("s1") > c("s1_ws") + 20, F.lit(False)), F.coalesce(c("e1") < c("e1_we") - 20, F.lit(False))
    total = F.when(c("total_ms") > 0, c("total_ms").cast("double"))
    first = F.struct(
        F.greatest(F.lit(0.0), F.when(in_s, c("s1_ws")).otherwise(c("s1")) - LEAD_IN, c("floor_ms") - LEAD_IN).cast("double").alias("s"),
        F.least(F.when(in_e, c("e1_we")).otherwise(c("e1")) + LEAD_OUT, total).cast("double").alias("e"),
    )

    def grown(x: Column) -> Column:
        """Short windows grow, three fifths at the start; what passes the end of the video goes to the start."""
        lack = F.greatest(F.lit(0.0), c("min_ms") - (x["e"] - x["s"]))
        front = F.least(lack * 0.6, x["s"])
        return F.struct((x["s"] - front).alias("s"), (x["e"] + lack - front).alias("e"), (lack > 0).alias("grew"))

    def inside(x: Column) -> Column:
        over = F.when(x["grew"] & (x["e"] > total), x["e"] - total)
        return F.struct(F.when(over.isNotNull(), F.greatest(F.lit(0.0), x["s"] - over)).otherwise(x["s"]).alias("s"), F.when(over.isNotNull(), total).otherwise(x["e"]).alias("e"))

    w = w.select(*KEYS, "min_ms", "max_ms", "floor_ms", F.concat("sk", F.when(in_s, "+word").otherwise("")).alias("start_kind"), F.concat("ek", F.when(in_e, "+word").otherwise("")).alias("end_kind"), _let(_let(first, grown), inside).alias("r"))
    w = w.select(*KEYS, "min_ms", "max_ms", "floor_ms", "start_kind", "end_kind", "r.s", "r.e")
    w = written(w.withColumn("cut", F.when(c("e") - c("s") > c("max_ms"), c("e") - c("max_ms"))), "grown")
    # too long: the front goes, to the first sentence start that leaves enough
    long = w.filter("cut is not null")
    probes = long.select(*KEYS, "cut", "e", "min_ms", "floor_ms", (F.ceil("cut") - 2000).alias("lo"), (F.ceil("cut") + c("max_ms")).alias("hi"))
    reach = range_join(probes, points.filter("kind = 'start'").drop("kind"), ("lo", "hi"), ("point", "point"), c("point").between(c("lo"), c("hi")))
    reach = reach.filter(c("floor_ms").isNull() | (c("point") >= c("floor_ms") - 50))
    off = F.abs(c("point") - c("cut"))
    trims = reach.groupBy(*KEYS).agg(
        F.min(F.when((c("point") >= c("cut")) & (c("e") - c("point") >= c("min_ms")), c("point"))).alias("t_next"),
        F.min_by(F.when(off <= 2000, c("point")), F.when(off <= 2000, F.struct(off, -c("point")))).alias("t_near"))
    w = w.join(trims.hint("merge"), KEYS, "left")
    w = w.withColumn("s", F.when(c("cut").isNull(), c("s")).otherwise(F.coalesce(c("t_next"), F.when(c("t_near") < c("e"), c("t_near")), c("cut"))))
    out = written(w.select(*KEYS, F.round(F.greatest(F.lit(0.0), "s")).cast("bigint").alias("start_ms"), F.round("e").cast("bigint").alias("end_ms"), "start_kind", "end_kind"), "refined")
    if not read:
        return out
    said = texts_in(out, words, segments, opening=(c("start_ms"), c("start_ms") + 6000), ending=(F.greatest(F.lit(0), c("end_ms") - 6000), c("end_ms")))
    out = out.join(said.select(*KEYS, "opening", "ending").hint("merge"), KEYS, "left")
    return out.withColumn("opens_mid_sentence", starts_dependently(c("opening"))).withColumn("ends_mid_sentence", (F.coalesce("ending", F.lit("")) != "") & ~ends_sentence(c("ending"))).drop("opening", "ending")


def expand_for_context(windows: DataFrame, words: DataFrame, segments: DataFrame, starts: DataFrame, *, max_ms: int = 60_000, lookback_ms: int = 12_000) -> DataFrame:
    """(keys, start_ms, end_ms): the start moves back to the latest sentence start whose first 6 s don't lean on what came before.

    A column lookback_ms of windows, where there is one, takes the parameter's place.
    """
    reach = F.coalesce("lookback_ms", F.lit(lookback_ms)) if "lookback_ms" in windows.columns else F.lit(lookback_ms)
    w = windows.select(*KEYS, "start_ms", "end_ms", (F.col("start_ms") - reach).alias("lo"))
    back = range_join(w, starts, ("lo", "start_ms"), ("point", "point"), (F.col("point") >= F.col("lo")) & (F.col("point") < F.col("start_ms")) & (F.col("end_ms") - F.col("point") <= max_ms))
    w, back = w.drop("lo"), back.select(*KEYS, "point")
    # openings belong to points, not windows: each is read once
    points = back.select("video_id", F.col("point").alias("window_id"), F.col("point").alias("start_ms"), (F.col("point") + 6000).alias("end_ms")).distinct()
    clean = text_in_window(points, words, segments).filter((F.col("text") != "") & ~starts_dependently(F.col("text"))).select("video_id", F.col("window_id").alias("point"))
    best = back.join(clean.hint("merge"), ["video_id", "point"]).groupBy(*KEYS).agg(F.max("point").alias("point"))
    return w.join(best.hint("merge"), KEYS, "left").select(*KEYS, F.when(F.col("point").isNull(), F.col("start_ms")).otherwise(F.greatest(F.lit(0), F.col("point") - LEAD_IN)).alias("start_ms"), "end_ms")


def complete_ending(windows: DataFrame, words: DataFrame, segments: DataFrame, punctuated: DataFrame, *, media: DataFrame | None = None, min_ms: int = 0, max_ms: int = 60_000, ahead_ms: int = 8000, trim_ms: int = 1500) -> DataFrame:
    """(keys, start_ms, end_ms): an end inside a sentence moves to its end, else back to the last ended one, else off trailing connectives."""
    if "seg_start" not in words.columns:
        words = written(timed_words(words, segments), "words")
    w = written(_with_limits(windows, min_ms, max_ms, media), "windows")
    tail = text_in_window(w.select(*KEYS, F.greatest(F.lit(0), F.col("end_ms") - 6000).alias("start_ms"), "end_ms"), words, segments).withColumnRenamed("text", "tail")
    w = w.join(tail.hint("merge"), KEYS, "left").withColumn("open", (F.coalesce("tail", F.lit("")) != "") & ~ends_sentence(F.col("tail")))
    w = written(w.drop("tail"), "tails")
    probes = w.filter("open").select("video_id", F.col("window_id").alias("probe_id"), F.col("end_ms").alias("t_ms"))
    hit = near_points(probes, punctuated, max_ms, ahead_ms).groupBy("video_id", F.col("probe_id").alias("window_id")).agg(
        F.min(F.when(F.col("point") > F.col("p"), F.col("point"))).alias("after"), F.max(F.when(F.col("point") < F.col("p"), F.col("point"))).alias("before"))
    w = w.join(hit.hint("merge"), KEYS, "left")
    later = F.least(F.col("after") + LEAD_OUT, F.when(F.col("total_ms") > 0, F.col("total_ms")))
    later = F.when(F.col("after").isNotNull() & (later - F.col("start_ms") <= F.col("max_ms")), later)
    sooner = F.when(F.col("before") + LEAD_OUT - F.col("start_ms") >= F.col("min_ms"), F.col("before") + LEAD_OUT)
    w = written(w.withColumn("moved", F.coalesce(later, sooner)), "moved-ends")
    # trailing connectives: the last words of what is still open
    stuck = w.filter("open and moved is null")
    last = words_in_windows(stuck.select(*KEYS, "start_ms", "end_ms"), words, segments).groupBy(*KEYS).agg(F.expr("array_sort(collect_list(struct(word_idx, word, end_ms)), (a, b) -> case when a.word_idx > b.word_idx then -1 else 1 end)").alias("last"))
    dangling = "lower(trim(both ',.!?\"'')' from trim(element_at(last, i).word))) in (" + ", ".join(f"'{x}'" for x in L.DANGLING) + ")"
    fold = f"""aggregate(sequence(1, greatest(1, size(last) - 1)), struct(end_ms as e, true as go), (a, i) ->
      if(a.go and i < size(last) and {dangling} and element_at(last, i + 1).end_ms - start_ms >= min_ms and element_at(last, i + 1).end_ms >= end_ms - {trim_ms},
        struct(element_at(last, i + 1).end_ms as e, true as go), struct(a.e as e, false as go))).e"""
    shaved = stuck.join(last.hint("merge"), KEYS).select(*KEYS, F.expr(fold).alias("shaved"))
    return w.join(shaved.hint("merge"), KEYS, "left").select(*KEYS, "start_ms", F.when(~F.col("open"), F.col("end_ms")).otherwise(F.coalesce("moved", "shaved", "end_ms")).alias("end_ms"))


def trim_filler_opening(windows: DataFrame, sentences: DataFrame, *, media: DataFrame | None = None, min_ms: int = 20_000, max_ms: int = 60_000, low_value: str = L.LOW_VALUE) -> DataFrame:
    """(keys, start_ms, end_ms, trimmed): leading sentences that are logistics go; the end moves on where the rest would be too short.

    sentences: (video_id, start_ms, end_ms, text).
    """
    w = _with_limits(windows, min_ms, max_ms, media)
    s = sentences.select("video_id", "start_ms", "end_ms", is_low_value(F.col("text"), low_value).alias("low"), F.size(words_of(F.col("text"))).alias("n"))
    # sentences up to where the longest extension may end
    wide = w.select(*KEYS, "start_ms", (F.col("end_ms") + F.col("max_ms")).alias("end_ms"))
    seen = overlapping(wide, s).groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct(F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), "low", "n"))).alias("near"))
    w = w.join(seen.hint("merge"), KEYS, "left").withColumn("near", F.expr("coalesce(near, array())"))
    w = w.withColumn("over", F.expr("filter(near, x -> x.e > start_ms + 200 and x.s < end_ms)"))
    need = "(x.e + min_ms)"
    first = f"aggregate(near, cast(null as bigint), (m, y) -> if(y.e >= {need} and (m is null or y.e < m), y.e, m))"
    longer = f"least(coalesce({first}, {need}), coalesce(nullif(total_ms, 0), 9223372036854775807))"
    fold = f"""aggregate(sequence(1, greatest(1, size(over))), struct(start_ms as s, end_ms as e, false as hit, true as go), (a, i) ->
      if(not a.go or i > size(over), a,
        if(not over[i - 1].low, struct(a.s as s, a.e as e, a.hit as hit, over[i - 1].n <= 3 and i < size(over) and coalesce(get(over, i).low, false) as go),
          transform(array(struct(over[i - 1].e as e)), x -> if(a.e - x.e >= min_ms, struct(x.e as s, a.e as e, true as hit, true as go),
            if({longer} - x.e > max_ms or {longer} - x.e < min_ms, struct(a.s as s, a.e as e, a.hit as hit, false as go), struct(x.e as s, {longer} as e, true as hit, true as go))))[0])))"""
    return w.withColumn("r", F.expr(fold)).select(*KEYS, F.col("r.s").alias("start_ms"), F.col("r.e").alias("end_ms"), F.col("r.hit").alias("trimmed"))
