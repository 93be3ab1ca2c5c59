"""Selection: evaluations meet candidates, duplicates go, the best of each video stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_tokens, token_similarity
from ..sources.shared import written
from .duplicates import OVERLAP, SIMILAR, duplicate_reason, outdone
from .ranges import time_overlap_ratio

FLOOR = 0.42


def blended_score(heuristic: Column, quality: Column, recommended: Column, dependency: Column, complete: Column) -> Column:
    """Evaluated quality and heuristic together; without an evaluation the heuristic alone."""
    score = 0.62 * quality + 0.38 * heuristic + F.when(recommended, 0.10).otherwise(0.0) - F.when(dependency == "high", 0.12).otherwise(0.0) - F.when(~complete, 0.10).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(quality.isNull(), heuristic).otherwise(score)))


def is_duplicate(pairs: DataFrame, **limits) -> DataFrame:
    """pairs (a_start, a_end, a_text, b_start, b_end, b_text, ...) with duplicate and reason."""
    c = F.col
    overlap = time_overlap_ratio(c("a_start"), c("a_end"), c("b_start"), c("b_end"))
    reason = duplicate_reason(overlap, token_similarity(content_tokens(c("a_text")), content_tokens(c("b_text"))), **limits)
    return pairs.withColumn("reason", F.coalesce(reason, F.lit(""))).withColumn("duplicate", F.col("reason") != "")


def scored(candidates: DataFrame, evaluations: DataFrame, *, model_answered: bool = True) -> DataFrame:
    """candidates with blended score and the evaluated range; unevaluated ones go if the model answered.

    evaluations hold one row for each candidate_id, or for each video_id and candidate_id where they have both.
    """
    keys = [c for c in ("video_id", "candidate_id") if c in evaluations.columns]
    given = [F.col(c).alias(f"_{c}") for c in ("start_ms", "end_ms") if c in evaluations.columns]
    judged = evaluations.select(*keys, "quality_score", "recommended", "context_dependency", "complete_thought", *given)
    rows = candidates.join(judged.hint("merge"), keys, "inner" if model_answered else "left")
    if given:
        rows = rows.withColumns({c: F.coalesce(f"_{c}", c) for c in ("start_ms", "end_ms")}).drop("_start_ms", "_end_ms")
    for name, default in (("context_dependency", F.lit("medium")), ("complete_thought", F.lit(True)), ("recommended", F.lit(False))):
        rows = rows.withColumn(name, F.coalesce(F.col(name), default))
    return rows.withColumn("blended", blended_score(F.col("heuristic_score"), F.col("quality_score"), F.col("recommended"), F.col("context_dependency"), F.col("complete_thought")))


def select_clips(candidates: DataFrame, evaluations: DataFrame, requested: int, *, overlap_at: float = OVERLAP, similar_at: float = SIMILAR, floor: float = FLOOR, model_answered: bool = True) -> DataFrame:
    """(video_id, candidate_id, index, start_ms, end_ms, score, strong, duplicates, below_floor): the clips of each video.

    Best first, a clip stays unless it duplicates one that stays (by time or by words);
    the first `requested` are put in order of time.  candidates: (video_id, candidate_id, start_ms, end_ms, text,
    heuristic_score), ids unique within a video; evaluations as clamp_evaluation gives them, whose range then counts, or without video_id and range.
    Ties go to the smaller id.  A video's rows need not fit a task: the choice is made in blocks of clips, each in
    rounds.  Clips of the same range and words count as one for that, the best of them.
    """
    rows = scored(candidates, evaluations, model_answered=model_answered).select("video_id", "candidate_id", "start_ms", "end_ms", "text", "blended")
    above = F.col("blended") >= floor
    rows = written(rows.select("video_id", "candidate_id", "start_ms", "end_ms", "blended", above.alias("above"), F.when(above, content_tokens(F.col("text"))).alias("tokens")), "scored-clips")
    counts = rows.groupBy("video_id").agg(F.count_if("above").alias("above"), F.count_if(~F.col("above")).alias("below_floor"))
    alone = F.when((F.col("end_ms") <= F.col("start_ms")) & (F.size("tokens") == 0), F.col("candidate_id"))  # such clips duplicate nothing
    kinds = rows.filter("above").groupBy("video_id", "start_ms", "end_ms", F.array_sort("tokens").alias("tokens"), alone.alias("alone"))
    clips = kinds.agg(F.min(F.struct((-F.col("blended")).alias("neg"), "candidate_id")).alias("best")).select("video_id", F.col("best.candidate_id").alias("candidate_id"), "start_ms", "end_ms", "tokens", (-F.col("best.neg")).alias("blended"))
    clips = written(clips, "clips")
    place = F.struct((-F.col("blended")).alias("neg"), "candidate_id")
    gone = outdone(clips.select("video_id", place.alias("id"), "start_ms", "end_ms", "tokens"), overlap_at=overlap_at, similar_at=similar_at)
    kept = written(clips.withColumn("id", place).join(gone.hint("merge"), ["video_id", "id"], "left_anti"), "kept-clips")
    counts = counts.join(kept.groupBy("video_id").agg(F.count(F.lit(1)).alias("strong")).hint("merge"), "video_id")
    best = kept.withColumn("nth", F.row_number().over(Window.partitionBy("video_id").orderBy("id"))).filter(F.col("nth") <= requested)
    best = best.withColumn("index", F.row_number().over(Window.partitionBy("video_id").orderBy("start_ms", "nth")))
    return best.join(counts.hint("merge"), "video_id").select(
        "video_id", "candidate_id", "index", "start_ms", "end_ms", F.round("blended", 4).alias("score"), F.col("strong").cast("int").alias("strong"), (F.col("above") - F.col("strong")).cast("int").alias("duplicates"), "below_floor"
    )


def selection_report(clips: DataFrame, requested: int) -> DataFrame:
    """(video_id, selected, strong, duplicates, below_floor, fell_short, notes) from select_clips."""
    by = clips.groupBy("video_id").agg(F.count(F.lit(1)).alias("selected"), *[F.max(c).alias(c) for c in ("strong", "duplicates", "below_floor")])
    few = F.when(F.col("strong") < requested, F.format_string(f"Only %d genuinely strong moment%s found, fewer than the {requested} requested.", F.col("strong"), F.when(F.col("strong") == 1, " was").otherwise("s were")))
    merged = F.when(F.col("duplicates") > 0, F.format_string("%d near-duplicate moment(s) were merged.", F.col("duplicates")))
    return by.withColumn("fell_short", F.col("selected") < requested).withColumn("notes", F.array_compact(F.array(few, merged)))


def evaluation_requests(shortlisted: DataFrame, contexts: DataFrame, *, batch: int = 6, context_chars: int = 200, opening_chars: int = 110) -> DataFrame:
    """(video_id, batch, n, prompt): evidence blocks of each batch of ranked candidates.

    shortlisted: (video_id, candidate_id, rank, start_ms, end_ms, text); contexts: (video_id, window_id, before, after).
    """
    rows = shortlisted.join(contexts.withColumnRenamed("window_id", "candidate_id").hint("merge"), ["video_id", "candidate_id"], "left")
    seconds = lambda c: F.format_string("%.1f", F.col(c) / 1000.0)
    block = F.concat_ws(
        "\n", F.concat(F.lit("id: "), F.col("candidate_id").cast("string")), F.concat(F.lit("range: "), seconds("start_ms"), F.lit("-"), seconds("end_ms"), F.lit("s")),
        F.concat(F.lit("before: "), F.right(F.coalesce("before", F.lit("")), F.lit(context_chars))), F.concat(F.lit("opens: "), F.left("text", F.lit(opening_chars))),
        F.concat(F.lit("text: "), F.col("text")), F.concat(F.lit("after: "), F.left(F.coalesce("after", F.lit("")), F.lit(context_chars))),
    )
    rows = rows.withColumn("batch", F.floor((F.col("rank") - 1) / batch)).withColumn("block", block)
    return rows.groupBy("video_id", "batch").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n\n").alias("prompt"))


_ANSWER = "array<struct<candidate_id:string,recommended:string,start:string,end:string,reason:string,context_dependency:string,quality_score:string,topic:string,complete_thought:string>>"


def collect_evaluations(responses: DataFrame, candidates: DataFrame) -> DataFrame:
    """(video_id, candidate_id, raw) from responses (video_id, batch, response): unknown ids and repeats in a batch are dropped; broken answers give none."""
    items = F.from_json(F.get_json_object("response", "$.evaluations"), _ANSWER)
    rows = responses.select("video_id", "batch", F.posexplode(items).alias("pos", "raw")).withColumn("candidate_id", F.expr("try_cast(raw.candidate_id as bigint)"))
    known = rows.join(candidates.select("video_id", "candidate_id").hint("merge"), ["video_id", "candidate_id"], "left_semi")
    nth = F.row_number().over(Window.partitionBy("video_id", "batch", "candidate_id").orderBy("pos"))
    return known.withColumn("nth", nth).filter("nth = 1").select("video_id", "candidate_id", "raw")


def clamp_evaluation(raw: DataFrame, candidates: DataFrame, *, min_ms: int, max_ms: int, media: DataFrame | None = None, most_shift_ms: int = 15_000) -> DataFrame:
    """Answers as typed evaluations inside what the candidate and the limits allow; those without a number for quality are dropped.

    raw: (video_id, candidate_id, raw) with times in seconds; candidates: (video_id, candidate_id, start_ms, end_ms).
    """
    c = F.col
    rows = raw.join(candidates.select("video_id", "candidate_id", c("start_ms").alias("c_start"), c("end_ms").alias("c_end")).hint("merge"), ["video_id", "candidate_id"])
    rows = rows.join(media.select("video_id", c("duration_ms").alias("total")).hint("merge"), "video_id", "left") if media is not None else rows.withColumn("total", F.lit(None).cast("bigint"))
    sec = lambda name: (F.expr(f"try_cast(raw.{name} as double)") * 1000)
    rows = rows.withColumn("q", F.expr("try_cast(raw.quality_score as double)")).filter(c("q").isNotNull() & ~F.isnan("q"))
    fine = sec("start").isNotNull() & sec("end").isNotNull() & (sec("end") > sec("start"))
    near = lambda x, edge: F.greatest(edge - most_shift_ms, F.least(edge + most_shift_ms, x))
    rows = rows.withColumn("s", near(F.when(fine, sec("start")).otherwise(c("c_start")), c("c_start"))).withColumn("e", near(F.when(fine, sec("end")).otherwise(c("c_end")), c("c_end")))
    total = F.when(c("total") > 0, c("total"))
    rows = rows.withColumn("s", F.greatest(F.lit(0.0), "s")).withColumn("e", F.least(c("e"), total))
    rows = rows.withColumn("e", F.when(c("e") - c("s") < min_ms, F.least(c("s") + min_ms, total)).otherwise(c("e"))).withColumn("e", F.least(c("e"), c("s") + max_ms)).filter("e > s")
    text = lambda name: F.coalesce(c(f"raw.{name}"), F.lit(""))
    level = F.lower(F.coalesce(c("raw.context_dependency"), F.lit("medium")))
    return rows.select(
        "video_id", "candidate_id", (F.lower(text("recommended")) == "true").alias("recommended"), F.round("s").cast("bigint").alias("start_ms"), F.round("e").cast("bigint").alias("end_ms"),
        F.left(text("reason"), F.lit(500)).alias("reason"), F.when(level.isin("low", "medium", "high"), level).otherwise("medium").alias("context_dependency"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), "q")).alias("quality_score"),
        F.left(F.trim(F.regexp_replace(text("topic"), r"[_\-]+", " ")), F.lit(200)).alias("topic"), (F.lower(F.coalesce(c("raw.complete_thought"), F.lit("true"))) == "true").alias("complete_thought"),
    )


def normalise_verdict(rows: DataFrame) -> DataFrame:
    """rows (..., verdict, shift_s, reason, context, error) with a known verdict, a shift of -20 to 0 s, cut strings; a failed request is accepted and marked degraded."""
    verdict = F.lower(F.trim(F.coalesce("verdict", F.lit(""))))
    shift = F.coalesce(F.expr("try_cast(shift_s as double)"), F.lit(0.0))
    bad = F.col("error").isNotNull()
    return (
        rows.withColumn("verdict", F.when(~bad & verdict.isin("accept", "expand", "reject"), verdict).otherwise("accept")).withColumn("shift_ms", F.when(bad, 0).otherwise(F.round(F.least(F.lit(0.0), F.greatest(F.lit(-20.0), shift)) * 1000)).cast("bigint"))
        .withColumn("reason", F.left(F.coalesce("reason", F.lit("")), F.lit(400))).withColumn("context", F.left(F.coalesce("context", F.lit("")), F.lit(300))).withColumn("degraded", bad).drop("shift_s", "error")
    )


def merge_vision(factors: DataFrame, observations: DataFrame) -> DataFrame:
    """factors (video_id, window_id, visual_interest, ...) averaged with observations (video_id, window_id, seen_interest) where there is one."""
    seen = observations.select("video_id", "window_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("seen_interest"))).alias("_seen"))
    rows = factors.join(seen.hint("merge"), ["video_id", "window_id"], "left")
    return rows.withColumn("visual_interest", F.coalesce(F.round((F.col("visual_interest") + F.col("_seen")) / 2, 4), "visual_interest")).drop("_seen")
