"""Candidate windows over sentences, their scores, and the best of each video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.text import anchor_score, confrontation_score, is_low_value, lexical_density, starts_dependently, words_of
from ..sources.shared import written
from .joins import dealt
from .ranges import BIN_MS, range_join, scene_count_between, texts_in
from .segments import ends_sentence
from .signals import clip, dynamics_of, exchange_rate, loudness_levels, reaction_score, shouting_of, visual_interest

#: The share of each factor in a window's score.
WEIGHTS = {
    "content_clarity": 0.20, "standalone_completeness": 0.20, "narrative_structure": 0.15, "visual_interest": 0.10, "audio_dynamics": 0.10,
    "emotional_reaction": 0.10, "information_density": 0.05, "opening_strength": 0.05, "ending_payoff": 0.05,
}
#: How well each trigger carries a story.
STRUCTURE = (("story", 0.9), ("confrontation", 0.85), ("lesson", 0.85), ("challenge", 0.8), ("question", 0.8), ("disagreement", 0.8), ("conclusion", 0.75), ("number", 0.6), ("claim", 0.55), ("explanation", 0.45))
KEYS = ["video_id", "window_id"]


def anchored_sentences(sentences: DataFrame, triggers=L.TRIGGERS, low_value: str = L.LOW_VALUE) -> DataFrame:
    """sentences (video_id, start_ms, end_ms, text, ...) with their index i in the video, anchor and trigger."""
    v = Window.partitionBy("video_id").orderBy("start_ms", "end_ms", "text")
    rows = sentences.withColumn("i", (F.row_number().over(v) - 1).cast("bigint")).withColumn("following", F.concat_ws(" ", F.collect_list("text").over(v.rowsBetween(1, 3))))
    scored = rows.withColumn("a", anchor_score(F.col("text"), F.col("following"), triggers, low_value))
    return scored.withColumn("anchor", F.col("a.score")).withColumn("trigger", F.col("a.trigger")).drop("a", "following")


def candidate_windows(anchored: DataFrame, *, min_ms: int = 20_000, max_ms: int = 60_000, reach: int = 40, least_anchor: float = 0.3, every: int = 4) -> DataFrame:
    """(video_id, i, j, start_ms, end_ms, anchor, trigger): runs of sentences i..j of allowed length.

    Sentences under least_anchor start a window only at every `every`-th place.  Windows grow until the first
    that is too long.  Of windows whose edges fall into the same quarter seconds the first (by i, then j) stays.
    """
    ahead = F.collect_list("end_ms").over(Window.partitionBy("video_id").orderBy("i").rowsBetween(0, reach - 1))
    first = anchored.select("video_id", "i", "start_ms", "anchor", "trigger", ahead.alias("ends")).filter((F.col("anchor") >= least_anchor) | (F.col("i") % every == 0))
    long = F.array_position(F.transform("ends", lambda e: e - F.col("start_ms") > max_ms), F.lit(True))
    ends = F.when(long > 0, F.slice("ends", F.lit(1), long.cast("int") - 1)).otherwise(F.col("ends"))
    rows = first.select("video_id", "i", "start_ms", "anchor", "trigger", F.posexplode(ends).alias("k", "end_ms")).filter(F.col("end_ms") - F.col("start_ms") >= min_ms).withColumn("j", F.col("i") + F.col("k"))
    nth = F.row_number().over(Window.partitionBy("video_id", F.floor(F.col("start_ms") / 250), F.floor(F.col("end_ms") / 250)).orderBy("i", "j"))
    return rows.withColumn("nth", nth).filter("nth = 1").select("video_id", "i", "j", "start_ms", "end_ms", "anchor", "trigger")


def opening_and_ending(windows: DataFrame, words: DataFrame, segments: DataFrame, opening_ms: int = 6000, ending_ms: int = 7000) -> DataFrame:
    """(keys, opening, ending): what is said in the first and last seconds of each window."""
    c = F.col
    return texts_in(windows, words, segments, opening=(c("start_ms"), c("start_ms") + opening_ms), ending=(F.greatest(F.lit(0), c("end_ms") - ending_ms), c("end_ms"))).select(*KEYS, "opening", "ending")


def places(x: Column, n: int = 4) -> Column:
    """x to n places; decided on nine, so that the last bits of a sum don't move a tie."""
    return F.round(F.round(x, 9), n)


def window_factors(*, text: Column, opening: Column, ending: Column, ms: Column, trigger: Column, n_speakers: Column, scene_count: Column, visual: Column, dynamics: Column, reaction: Column, triggers=L.TRIGGERS, low_value: str = L.LOW_VALUE) -> Column:
    """The nine factors of a window as a struct; missing visual, dynamics and reaction count .45, .5 and 0.

    A trigger that triggers doesn't name matches nothing.
    """
    pace = F.size(words_of(text)) / F.greatest(ms / 1000.0, F.lit(0.001))
    paced = F.element_at(F.transform(F.array(pace), lambda x: clip(x / 2.6, 0, 1) * F.when(x < 0.9, 0.6).otherwise(1.0)), 1)  # the text is split once
    clarity = paced * F.when(is_low_value(text, low_value), 0.35).otherwise(1.0)
    dependent, ended = starts_dependently(opening), ends_sentence(ending)
    complete = 0.5 + F.when(~dependent, 0.25).otherwise(0.0) + F.when(ended, 0.25).otherwise(0.0)
    structure = F.lit(0.3)
    for name, value in STRUCTURE:
        structure = F.when(trigger == name, value).otherwise(structure)
    structure = F.least(F.lit(1.0), structure + F.when(n_speakers > 1, 0.1).otherwise(0.0))
    seen = F.coalesce(visual, F.lit(0.45)) * F.when(scene_count > 6, 0.8).otherwise(1.0)
    heard = F.coalesce(reaction, F.lit(0.0))
    pattern = {name: f"(?i){p}" for name, _, p in triggers}
    matches = lambda c, *names: F.greatest(F.lit(False), F.lit(False), *[c.rlike(pattern[n]) for n in names if n in pattern])
    tells = matches(opening, "story") | opening.rlike(r"\?\s*$")
    strong = F.when(tells, 0.9).when(matches(opening, *pattern), 0.7).otherwise(0.35) * F.when(dependent, 0.5).otherwise(1.0)
    lands = matches(ending, "conclusion", "lesson", "number")
    payoff = F.when(lands, 0.95).when(ended, 0.7).otherwise(0.35)
    payoff = F.least(F.lit(1.0), payoff + F.when(heard > 0.25, 0.2).otherwise(0.0))
    values = (clarity, complete, structure, seen, F.coalesce(dynamics, F.lit(0.5)), heard, lexical_density(text), strong, payoff)
    return F.struct(*[places(v).alias(n) for n, v in zip(WEIGHTS, values, strict=True)])


def opening_punch(*, shouting: Column, confrontation: Column, exchange: Column, lead_in_ms: Column, silent: Column) -> Column:
    """How hard the first seconds hit, to four places; 0.05 if nothing is said in them.  No lead_in_ms: no word begins, which earns nothing."""
    prompt = F.coalesce(0.15 * clip(1 - lead_in_ms / 1200.0, 0, 1), F.lit(0.0))
    return places(F.when(silent, 0.05).otherwise(clip(0.40 * shouting + 0.30 * confrontation + 0.15 * exchange + prompt, 0, 1)))


def conflict_profile(*, shouting: Column, exchange: Column, confrontation: Column, punch: Column) -> Column:
    """(intensity, note) of a window; measures count to four places in the note."""
    over = lambda c, limit: places(c) > limit
    note = F.concat_ws(", ", F.when(over(shouting, 0.5), "raised voices"), F.when(over(exchange, 0.5), "rapid back-and-forth"), F.when(over(confrontation, 0.4), "direct confrontation"), F.when(over(punch, 0.6), "strong opening"))
    return F.struct(places(clip(0.34 * shouting + 0.28 * exchange + 0.38 * confrontation, 0, 1)).alias("intensity"), note.alias("note"))


def raised_factors(factors: Column, punch: Column, intensity: Column) -> Column:
    """factors with the opening's strength and the emotional reaction raised by the first seconds and by the conflict."""
    strength = places(F.least(F.lit(1.0), 0.45 * factors["opening_strength"] + 0.55 * punch))
    feeling = places(F.least(F.lit(1.0), F.greatest(factors["emotional_reaction"], intensity)))
    return factors.withField("opening_strength", strength).withField("emotional_reaction", feeling)


def heuristic_score(factors: Column, anchor: Column, punch: Column, intensity: Column, weights: dict[str, float] = WEIGHTS, opening_weight: float = 0.22, conflict_weight: float = 0.18) -> Column:
    """One number from the (raised) factors, the anchor, the opening and the conflict."""
    total = sum(weights.values()) or 1.0
    base = sum((F.lit(w / total) * factors[n] for n, w in weights.items()), F.lit(0.0))
    base = 0.82 * base + 0.18 * clip(anchor, 0, 1)
    return places(max(0.0, 1 - opening_weight - conflict_weight) * base + opening_weight * punch + conflict_weight * intensity)


def window_measures(windows: DataFrame, words: DataFrame, segments: DataFrame, turns: DataFrame, audio_frames: DataFrame, events: DataFrame, frames: DataFrame, scenes: DataFrame, *, hop_ms: int, head_ms: int = 3000, least_words: int = 18) -> DataFrame:
    """windows with everything that scores need: texts, speakers, scene count, and measures of loudness, turns, frames and events.

    Each source meets the windows in one range join, whose conditional aggregates serve the whole window, its
    opening, its ending and its first seconds; the narrow results are written and joined once.
    Windows with fewer than least_words words are left out.
    """
    c = F.col
    head = c("start_ms") + head_ms
    said = texts_in(windows, words, segments, text=(c("start_ms"), c("end_ms"))).filter(F.size(words_of(c("text"))) >= least_words).select(*KEYS, "text")
    rows = windows.join(said.hint("merge"), KEYS)
    # openings belong to starts, endings to ends, which many windows share
    edge = lambda at: windows.select("video_id", c(at).alias("window_id"), at).distinct()
    opened = texts_in(edge("start_ms"), words, segments, opening=(c("start_ms"), c("start_ms") + 6000), head=(c("start_ms"), head)).select("video_id", c("window_id").alias("start_ms"), "opening", "head", "head_first")
    ended = texts_in(edge("end_ms"), words, segments, ending=(F.greatest(F.lit(0), c("end_ms") - 7000), c("end_ms"))).select("video_id", c("window_id").alias("end_ms"), "ending")
    rows = rows.join(opened.hint("merge"), ["video_id", "start_ms"]).join(ended.hint("merge"), ["video_id", "end_ms"])
    rows = written(rows, "spoken-windows")
    spans = rows.select(*KEYS, "start_ms", "end_ms")

    # loudness: frames of the window and of its first seconds
    # they meet as one array for each bin, not as rows
    width = max(1, BIN_MS // hop_ms)
    own = spans.select(*KEYS, F.greatest(F.lit(0), F.floor(c("start_ms") / hop_ms)).alias("lo"), (F.floor(c("end_ms") / hop_ms) - 1).alias("hi"), (F.floor((c("start_ms") + head_ms) / hop_ms) - 1).alias("head_hi"))
    own = own.withColumn("_bin", F.explode(F.sequence(F.floor(c("lo") / width), F.floor(F.greatest("lo", "hi", "head_hi") / width))))
    binned = audio_frames.filter("rms_db is not null").groupBy("video_id", F.floor(c("frame_idx") / width).alias("_bin")).agg(F.collect_list(F.struct("frame_idx", "rms_db")).alias("heard"))
    between = lambda hi: F.transform(F.filter("heard", lambda x: (x["frame_idx"] >= c("lo")) & (x["frame_idx"] <= c(hi))), lambda x: x["rms_db"])
    heard = own.join(binned.hint("merge"), ["video_id", "_bin"]).select(*KEYS, between("hi").alias("db"), between("head_hi").alias("head_db"))
    heard = heard.groupBy(*KEYS).agg(*[F.array_sort(F.flatten(F.collect_list(x))).alias(x) for x in ("db", "head_db")]).join(loudness_levels(audio_frames).hint("merge"), "video_id")
    loud = heard.select(
        *KEYS, shouting_of(c("db"), c("voiced_db"), c("loud_db")).alias("shouting"), shouting_of(c("head_db"), c("voiced_db"), c("loud_db")).alias("head_shouting"),
        dynamics_of(c("db"), c("median_db")).alias("dynamics"),
    )

    # turns: who speaks, and how often that changes
    long = spans.select(*KEYS, c("start_ms").alias("w_start"), c("end_ms").alias("own_end"), (c("start_ms") + head_ms + 2000).alias("head_end")).withColumn("w_end", F.greatest("own_end", "head_end"))
    near = range_join(long, turns.select("video_id", "turn_idx", "speaker", "start_ms", "end_ms"), ("w_start", "w_end"), ("start_ms", "end_ms"), (c("end_ms") > c("w_start")) & (c("start_ms") < c("w_end")))
    turn = F.struct("turn_idx", "speaker")
    talk = near.groupBy(*KEYS, "w_start", "own_end", "head_end").agg(F.array_sort(F.collect_list(F.when(c("start_ms") < c("own_end"), turn))).alias("own"), F.array_sort(F.collect_list(F.when(c("start_ms") < c("head_end"), turn))).alias("first"))
    talk = talk.select(*KEYS, F.array_compact(F.array_distinct(F.transform("own", lambda x: x["speaker"]))).alias("speakers"), exchange_rate(c("own"), c("own_end") - c("w_start")).alias("exchange"), exchange_rate(c("first"), c("head_end") - c("w_start")).alias("head_exchange"))

    tables = {"loud": loud, "talk": talk, "cuts": scene_count_between(spans, scenes), "seen": visual_interest(spans, frames), "heard": reaction_score(spans, events)}
    for name, table in tables.items():
        rows = rows.join(written(table, name).hint("merge"), KEYS, "left")
    defaults = {"shouting": 0.0, "head_shouting": 0.0, "dynamics": 0.3, "exchange": 0.0, "head_exchange": 0.0}
    rows = rows.withColumns({n: F.coalesce(c(n), F.lit(v)) for n, v in defaults.items()})
    return rows.withColumn("speakers", F.coalesce("speakers", F.array().cast("array<string>")))


def score_windows(windows: DataFrame, words: DataFrame, segments: DataFrame, turns: DataFrame, audio_frames: DataFrame, events: DataFrame, frames: DataFrame, scenes: DataFrame, *, hop_ms: int, least_words: int = 18, triggers=L.TRIGGERS, low_value: str = L.LOW_VALUE, confrontation=L.CONFRONTATION) -> DataFrame:
    """windows (keys, start_ms, end_ms, anchor, trigger, ...) with text, speakers, scene_count, factors (raised by opening and conflict), punch, conflict and heuristic_score.

    Windows with fewer than least_words words are left out.  However many windows have the same range, it is measured once for each trigger.
    """
    c = F.col
    windows = written(windows.withColumn("_trigger", F.coalesce("trigger", F.lit(""))), "windows")
    # windows of one range and trigger share all but the anchor: one of them is measured for all
    alike = ["video_id", "start_ms", "end_ms", "_trigger"]
    first = written(windows.groupBy(*alike).agg(F.min("window_id").alias("window_id")), "ranges")
    rows = window_measures(first, words, segments, turns, audio_frames, events, frames, scenes, hop_ms=hop_ms, least_words=least_words)
    factors = window_factors(text=c("text"), opening=c("opening"), ending=c("ending"), ms=c("end_ms") - c("start_ms"), trigger=c("_trigger"), n_speakers=F.size("speakers"), scene_count=c("scene_count"), visual=c("interest"), dynamics=c("dynamics"), reaction=c("reaction"), triggers=triggers, low_value=low_value)
    punch = opening_punch(shouting=c("head_shouting"), confrontation=confrontation_score(c("head"), confrontation), exchange=c("head_exchange"), lead_in_ms=c("head_first") - c("start_ms"), silent=F.trim("head") == "")
    # from a generator: texts are searched once for each window, however often the results are used
    rows = rows.select("*", F.inline(F.array(F.struct(factors.alias("factors"), punch.alias("punch"), confrontation_score(c("text"), confrontation).alias("_fights")))))
    rows = rows.withColumn("conflict", conflict_profile(shouting=c("shouting"), exchange=c("exchange"), confrontation=c("_fights"), punch=c("punch")))
    rows = rows.withColumn("factors", raised_factors(c("factors"), c("punch"), c("conflict.intensity")))
    rows = dealt(windows, rows.select(*alike, "text", "speakers", "scene_count", "factors", "punch", "conflict"), alike)
    rows = rows.withColumn("heuristic_score", heuristic_score(c("factors"), c("anchor"), c("punch"), c("conflict.intensity")))
    return rows.select(*windows.drop("_trigger").columns, "text", "speakers", "scene_count", "factors", "punch", "conflict", "heuristic_score")


#: SQL: the share of the shorter of two windows x and k that both cover.
_SHARE = "greatest(0, least(x.e, k.e) - greatest(x.s, k.s)) / cast(least(x.e - x.s, k.e - k.s) as double)"


def top_variants(candidates: DataFrame, *, most_overlap: float = 0.92, variants: int = 3, pool: int = 80) -> DataFrame:
    """(video_id, anchor_id, window_id, rank, name): the best few differing windows of each anchor, then the best `pool` of each video.

    candidates: (video_id, anchor_id, window_id, start_ms, end_ms, heuristic_score).  Ties go to the smaller anchor, start, end.
    """
    item = F.struct((-F.col("heuristic_score")).alias("neg"), F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), F.col("window_id").alias("id"))
    groups = candidates.groupBy("video_id", "anchor_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    fold = f"aggregate(items, slice(items, 1, 0), (kept, x) -> if(exists(kept, k -> {_SHARE} > {most_overlap}), kept, concat(kept, array(x))))"
    kept = groups.select("video_id", "anchor_id", F.explode(F.slice(F.expr(fold), 1, variants)).alias("k"))
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy("k.neg", "anchor_id", "k.s", "k.e", "k.id"))
    rows = kept.withColumn("rank", rank).filter(F.col("rank") <= pool)
    return rows.select("video_id", "anchor_id", F.col("k.id").alias("window_id"), "rank", F.format_string("candidate_%03d", "rank").alias("name"))


def shortlist(candidates: DataFrame, most: int = 32) -> DataFrame:
    """The first candidates of each video by score, ties by start, end and id."""
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("heuristic_score"), "start_ms", "end_ms", "candidate_id"))
    return candidates.withColumn("rank", rank).filter(F.col("rank") <= most)


def sample_times(windows: DataFrame, n: int) -> DataFrame:
    """(keys, times): n evenly spaced moments, kept from the edges by a tenth, at most 0.8 s."""
    inset = F.least(F.lit(800.0), (F.col("end_ms") - F.col("start_ms")) * 0.1)
    lo, hi = F.col("start_ms") + inset, F.col("end_ms") - inset
    times = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.round(lo + (hi - lo) * k / max(1, n - 1), 3)) if n > 1 else F.array(F.round((lo + hi) / 2, 3))
    return windows.select(*KEYS, times.alias("times"))

