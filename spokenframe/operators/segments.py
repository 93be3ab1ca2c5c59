"""Sentences, pauses, turns, cues and chunks: windows, islands and ordered folds inside a video."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import written
from .joins import prefix_sums
from .ranges import in_any_span

#: A word or text that ends a sentence.
SENTENCE_END = r"""[.!?]["')\]]*\s*$"""


def ends_sentence(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(SENTENCE_END)


def _by_video(*order: str):
    return Window.partitionBy("video_id").orderBy(*order)


def _in_segment():
    return Window.partitionBy("video_id", "segment_id").orderBy("word_idx")


def build_sentences(words: DataFrame, segments: DataFrame) -> DataFrame:
    """(video_id, segment_id, part, start_ms, end_ms, text, n_words): sentences of each segment.

    A sentence ends after a word with final punctuation, and with its segment.  It
    starts with its segment's first word, else where the previous word ended.  A segment
    without words is one sentence.
    """
    w = _in_segment()
    marked = words.withColumn("part", F.coalesce(F.sum(F.lag(ends_sentence(F.col("word")).cast("int")).over(w)).over(w), F.lit(0)))
    marked = marked.withColumn("from_ms", F.coalesce(F.lag("end_ms").over(w), F.col("start_ms")))
    spoken = marked.groupBy("video_id", "segment_id", "part").agg(
        F.min("from_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
        F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("word_idx", F.trim("word").alias("t")))), lambda x: x["t"])).alias("text"), F.count(F.lit(1)).alias("n_words"),
    )
    silent = segments.join(words.select("video_id", "segment_id").distinct().hint("merge"), ["video_id", "segment_id"], "left_anti").filter(F.trim("text") != "")
    return spoken.unionByName(silent.select("video_id", "segment_id", F.lit(0).cast("bigint").alias("part"), "start_ms", "end_ms", F.trim("text").alias("text"), F.lit(0).cast("bigint").alias("n_words")))


def sentence_starts(words: DataFrame, segments: DataFrame, gap_ms: int = 600) -> DataFrame:
    """(video_id, point): where sentences begin.

    A segment counts if it is the first, follows a finished one, or follows a pause of gap_ms;
    so does every word after a sentence's last word inside a segment.
    """
    v, w = _by_video("segment_id"), _in_segment()
    seg = segments.withColumn("prev_end", F.lag("end_ms").over(v)).withColumn("done", ends_sentence(F.trim(F.lag("text").over(v))))
    opened = seg.filter(F.col("prev_end").isNull() | F.col("done") | (F.col("start_ms") - F.col("prev_end") >= gap_ms)).select("video_id", F.col("start_ms").alias("point"))
    inner = words.withColumn("point", F.lead("start_ms").over(w)).filter(ends_sentence(F.col("word")) & F.col("point").isNotNull()).select("video_id", "point")
    return opened.union(inner).distinct()


def sentence_ends(words: DataFrame, segments: DataFrame, *, punctuated_only: bool = False) -> DataFrame:
    """(video_id, point): ends of words with final punctuation; unless punctuated_only also each segment's last end."""
    points = words.filter(ends_sentence(F.col("word"))).select("video_id", F.col("end_ms").alias("point"))
    if not punctuated_only:
        last = words.groupBy("video_id", "segment_id").agg(F.max("end_ms").alias("last"))
        points = points.union(segments.join(last.hint("merge"), ["video_id", "segment_id"], "left").select("video_id", F.coalesce("last", "end_ms").alias("point")))
    return points.distinct()


def pause_points(words: DataFrame, min_gap_ms: int = 350) -> DataFrame:
    """(video_id, point): the middle of each pause between words, at most 0.4 s after the word before it."""
    gap = F.lead("start_ms").over(_by_video("start_ms", "word_idx")) - F.col("end_ms")
    return words.withColumn("gap", gap).filter(F.col("gap") >= min_gap_ms).select("video_id", (F.col("end_ms") + F.least(F.col("gap") / 2, F.lit(400))).cast("bigint").alias("point"))


def mask_runs(frames: DataFrame, mask: Column, hop_ms: int, min_ms: int, *measures: Column) -> DataFrame:
    """(video_id, start_ms, end_ms, measures): runs of neighbouring frames where mask holds, min_ms or longer."""
    hit = frames.filter(mask).withColumn("island", F.col("frame_idx") - F.row_number().over(_by_video("frame_idx")))
    runs = hit.groupBy("video_id", "island").agg((F.min("frame_idx") * hop_ms).alias("start_ms"), ((F.max("frame_idx") + 1) * hop_ms).alias("end_ms"), *measures)
    return runs.filter(F.col("end_ms") - F.col("start_ms") >= min_ms).drop("island")


def _islands(rows: DataFrame, new: Column, *order: str) -> DataFrame:
    return rows.withColumn("island", F.sum(new.cast("int")).over(_by_video(*order).rowsBetween(Window.unboundedPreceding, 0)))


def merge_turns(segments: DataFrame, *, short_ms: int = 600, gap_ms: int = 1200) -> DataFrame:
    """(video_id, turn_idx, speaker, start_ms, end_ms).

    Segments under short_ms, or without a speaker, take the previous speaker, or the first
    known one; neighbours of one speaker less than gap_ms apart become one turn.
    """
    v = _by_video("segment_id")
    known = F.when(F.col("end_ms") - F.col("start_ms") >= short_ms, F.col("speaker"))
    rows = segments.withColumn("own", known)
    rows = rows.withColumn("speaker", F.coalesce(F.last("own", True).over(v.rowsBetween(Window.unboundedPreceding, 0)), F.first("own", True).over(v.rowsBetween(0, Window.unboundedFollowing))))
    new = F.coalesce(~F.lag("speaker").over(v).eqNullSafe(F.col("speaker")) | (F.col("start_ms") - F.lag("end_ms").over(v) >= gap_ms), F.lit(True))
    rows = _islands(rows.withColumn("new", new), F.col("new"), "segment_id")
    turns = rows.groupBy("video_id", "island").agg(F.first("speaker").alias("speaker"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return turns.select("video_id", (F.col("island") - 1).alias("turn_idx"), "speaker", "start_ms", "end_ms")


def caption_spans(frames: DataFrame, *, interval_ms: int = 1000, merge_gap_ms: int = 1500) -> DataFrame:
    """(video_id, start_ms, end_ms): stretches where burnt-in captions show.

    A video needs 8 frames and a 97th percentile of caption_score of 0.008; frames at
    max(0.006, 0.45 * percentile) or more count, each for one interval around it (the first may begin before 0).
    """
    peak = frames.groupBy("video_id").agg(F.percentile("caption_score", F.lit(0.97)).alias("peak"), F.count(F.lit(1)).alias("n")).filter("n >= 8 and peak >= 0.008")
    hit = frames.join(peak.hint("merge"), "video_id").filter(F.col("caption_score") >= F.greatest(F.lit(0.006), 0.45 * F.col("peak")))
    spans = hit.select("video_id", (F.col("t_ms") - interval_ms / 2).cast("bigint").alias("start_ms"), (F.col("t_ms") + interval_ms / 2).cast("bigint").alias("end_ms"))
    new = F.coalesce(F.col("start_ms") - F.lag("end_ms").over(_by_video("start_ms")) > merge_gap_ms, F.lit(True))
    return _islands(spans.withColumn("new", new), F.col("new"), "start_ms").groupBy("video_id", "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("island")


def cover_scenes(scenes: DataFrame, media: DataFrame, slack_ms: int = 500) -> DataFrame:
    """(video_id, scene_idx, start_ms, end_ms): scenes cut to the duration; the last one stretched to it if it ends over slack_ms early; a video without scenes is one scene."""
    last = F.lead("scene_idx").over(_by_video("scene_idx")).isNull()
    cut = F.least("end_ms", "duration_ms")
    rows = media.join(scenes.withColumn("last", last).hint("merge"), "video_id", "left")
    end = F.when(F.col("scene_idx").isNull() | (F.col("last") & (F.col("duration_ms") - cut > slack_ms)), F.col("duration_ms")).otherwise(cut)
    return rows.select("video_id", F.coalesce("scene_idx", F.lit(0)).cast("bigint").alias("scene_idx"), F.coalesce("start_ms", F.lit(0)).cast("bigint").alias("start_ms"), end.alias("end_ms"))


def caption_cues(words: DataFrame, *, max_chars: int = 22, gap_ms: int = 550, span_ms: int = 3200) -> DataFrame:
    """(video_id, clip_id, cue_idx, start_ms, end_ms, text) from the words of clips.

    words: (video_id, clip_id, word_idx, word, start_ms, end_ms, speaker, clip_start, clip_end).  A new
    cue begins before a word after a gap, when the cue would last or grow too long, or when
    its known speaker differs from the known speaker of the cue's first word, and after final
    punctuation.  Times count from the clip's start; a cue that would end where it starts lasts 0.4 s, and
    every cue ends before the next one.

    Gaps and punctuation cut a clip into stretches by windows; only inside a stretch is the rest an ordered fold.
    """
    v = Window.partitionBy("video_id", "clip_id").orderBy("start_ms", "word_idx")
    rows = words.withColumn("word", F.trim("word")).filter("word <> ''")
    ended = F.coalesce(F.lag("word").over(v).rlike("[.!?]$"), F.lit(True))
    rows = rows.withColumn("new", ended | (F.col("start_ms") - F.lag("end_ms").over(v) > gap_ms)).withColumn("stretch", F.sum(F.col("new").cast("int")).over(v.rowsBetween(Window.unboundedPreceding, 0)))
    item = F.struct("start_ms", "word_idx", "word", "end_ms", "speaker")
    runs = rows.groupBy("video_id", "clip_id", "stretch").agg(F.array_sort(F.collect_list(item)).alias("items"), F.first("clip_start").alias("clip_start"), F.first("clip_end").alias("clip_end"))
    fold = f"""aggregate(items, cast(array() as array<struct<s:bigint,e:bigint,t:string,sp:string>>), (acc, x) ->
      if(size(acc) = 0 or x.end_ms - element_at(acc, -1).s > {span_ms} or length(element_at(acc, -1).t) + 1 + length(x.word) > {max_chars * 2}
         or coalesce(x.speaker <> element_at(acc, -1).sp, false),
        concat(acc, array(struct(x.start_ms as s, x.end_ms as e, x.word as t, x.speaker as sp))),
        concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).s as s, x.end_ms as e, concat(element_at(acc, -1).t, ' ', x.word) as t, element_at(acc, -1).sp as sp)))))"""
    cues = runs.select("video_id", "clip_id", "clip_start", "clip_end", "stretch", F.posexplode(F.expr(fold)).alias("pos", "c"))
    order = Window.partitionBy("video_id", "clip_id").orderBy("stretch", "pos")
    start = F.greatest(F.lit(0), F.col("c.s") - F.col("clip_start"))
    end = F.least(F.col("c.e"), F.col("clip_end")) - F.col("clip_start")
    rows = cues.select("video_id", "clip_id", (F.row_number().over(order) - 1).alias("cue_idx"), start.alias("start_ms"), F.when(end <= start, start + 400).otherwise(end).alias("end_ms"), F.col("c.t").alias("text"))
    following = F.lead("start_ms").over(Window.partitionBy("video_id", "clip_id").orderBy("cue_idx"))
    return rows.withColumn("end_ms", F.when(F.col("end_ms") > following, F.greatest(F.col("start_ms") + 200, following - 20)).otherwise(F.col("end_ms")))


def suppress_cues(cues: DataFrame, spans: DataFrame) -> DataFrame:
    """cues (video_id, cue_id, start_ms, end_ms in source time, ...) whose midpoint lies in no caption span."""
    mid = cues.select("video_id", F.col("cue_id").alias("probe_id"), ((F.col("start_ms") + F.col("end_ms")) / 2).alias("t_ms"))
    hidden = in_any_span(mid, spans).filter("inside").select("video_id", F.col("probe_id").alias("cue_id"))
    return cues.join(hidden.hint("merge"), ["video_id", "cue_id"], "left_anti")


#: Segments of a video up to which one task streams it.
STREAM_ROWS = 1_000_000


def number_chunks(segments: DataFrame, budget: int = 5000, *, stream_rows: int = STREAM_ROWS) -> DataFrame:
    """segments without blank ones, with chunk_idx: in order, a chunk closes once its texts, with one more character each, reach the budget.

    Where a chunk closes depends on where the last one did.  A video's rows stream by in order and only the running length is
    held; videos of more than stream_rows segments are cut by pointers instead, by as many tasks as there are.
    """
    rows = segments.filter(F.trim("text") != "").withColumn("_n", (F.length(F.trim("text")) + 1).cast("bigint"))
    long = rows.groupBy("video_id").count().filter(F.col("count") > stream_rows).select("video_id")
    if long.isEmpty():
        return _streamed_chunks(rows, budget)
    long = written(long, "long-videos")
    short = _streamed_chunks(rows.join(long.hint("merge"), "video_id", "left_anti"), budget)
    return short.unionByName(_pointed_chunks(rows.join(long.hint("merge"), "video_id", "left_semi"), budget))


def _streamed_chunks(rows: DataFrame, budget: int) -> DataFrame:
    rows = rows.repartition("video_id").sortWithinPartitions("video_id", "segment_id")
    fields = [f for f in rows.schema.fields if f.name != "_n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video, chunk, total = None, 0, 0
        for b in batches:
            out = []
            for v, n in zip(b.column("video_id").to_pylist(), b.column("_n").to_pylist(), strict=True):
                if v != video:
                    video, chunk, total = v, 0, 0
                elif total >= budget:
                    chunk, total = chunk + 1, 0
                total += n
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in fields], pa.array(out, pa.int64())], [*[f.name for f in fields], "chunk_idx"])

    return rows.mapInArrow(run, T.StructType([*fields, T.StructField("chunk_idx", T.LongType())]))


def _pointed_chunks(rows: DataFrame, budget: int) -> DataFrame:
    """Chunks by pointer doubling: every row points at the row that would open the next chunk if it opened one.

    A row stands at the length of all text before it.  Its pointer leads to the first row at its place plus the budget or later; places are
    cut into stretches of one budget, so that row is in the next stretch, or follows the last row of that one or of
    the row's own.  In round k the openings known so far are followed 2**k chunks on, and pointers are
    doubled.  A row's chunk opened less than a budget before it, in its own stretch or the one before.
    """
    at = prefix_sums(rows.select("video_id", "segment_id", "_n"), ["video_id"], "segment_id", ["_n"]).withColumnRenamed("before__n", "p")
    at = written(at.withColumn("b", F.floor(F.col("p") / budget)), "places")
    stretch = written(at.groupBy("video_id", "b").agg(F.array_sort(F.collect_list("p")).alias("ps"), F.max(F.col("p") + F.col("_n")).alias("after")), "stretches")  # at most half a budget of rows each
    own = stretch.select("video_id", "b", F.col("after").alias("own_after"))
    ahead = stretch.select("video_id", (F.col("b") - 1).alias("b"), "ps", "after")
    to = at.join(own.hint("merge"), ["video_id", "b"]).join(ahead.hint("merge"), ["video_id", "b"], "left")
    first = F.get(F.filter("ps", lambda x: x >= F.col("p") + budget), F.lit(0))
    jump = written(to.select("video_id", "p", F.coalesce(first, "after", "own_after").alias("to")), "pointers")
    opens, step = written(at.filter("p = 0").select("video_id", "p", F.lit(0).cast("long").alias("chunk_idx")), "openings"), 1
    while True:
        more = opens.join(jump.hint("merge"), ["video_id", "p"]).select("video_id", F.col("to").alias("p"), (F.col("chunk_idx") + step).alias("chunk_idx"))
        more = written(more.join(at.select("video_id", "p").hint("merge"), ["video_id", "p"], "left_semi"), "openings")  # the end of a video is no row
        if more.isEmpty():
            break
        opens, step = opens.union(more), 2 * step
        jump = written(jump.join(jump.select("video_id", F.col("p").alias("to"), F.col("to").alias("next")).hint("merge"), ["video_id", "to"]).select("video_id", "p", F.col("next").alias("to")), "pointers")
    opens = opens.withColumn("b", F.floor(F.col("p") / budget))
    here = opens.select("video_id", "b", F.col("p").alias("open_p"), F.col("chunk_idx").alias("open_idx"))
    before = opens.select("video_id", (F.col("b") + 1).alias("b"), F.col("chunk_idx").alias("last_idx"))
    found = at.join(here.hint("merge"), ["video_id", "b"], "left").join(before.hint("merge"), ["video_id", "b"], "left")
    found = found.select("video_id", "segment_id", F.coalesce(F.when(F.col("open_p") <= F.col("p"), F.col("open_idx")), "last_idx").alias("chunk_idx"))
    return rows.drop("_n").join(found.hint("merge"), ["video_id", "segment_id"])


def chunk_by_budget(segments: DataFrame, budget: int = 5000, *, stream_rows: int = STREAM_ROWS) -> DataFrame:
    """(video_id, chunk_idx, start_ms, n_segments, chars) of the chunks that number_chunks makes."""
    rows = number_chunks(segments.select("video_id", "segment_id", "start_ms", "text"), budget, stream_rows=stream_rows)
    return rows.groupBy("video_id", "chunk_idx").agg(F.min_by("start_ms", "segment_id").alias("start_ms"), F.count(F.lit(1)).alias("n_segments"), F.sum(F.length(F.trim("text")) + 1).alias("chars"))


def sample_middle(chunks: DataFrame, most: int = 14, middle: int = 12) -> DataFrame:
    """Chunks of a video: all if at most `most`, else the first, the last, and every (m // middle)-th of the m between, at most `middle`."""
    n = F.count(F.lit(1)).over(Window.partitionBy("video_id"))
    rows = chunks.withColumn("n", n).withColumn("k", F.row_number().over(_by_video("chunk_idx")) - 1)
    step = F.greatest(F.lit(1), F.floor((F.col("n") - 2) / middle))
    inner = (F.col("k") > 0) & (F.col("k") < F.col("n") - 1) & ((F.col("k") - 1) % step == 0) & ((F.col("k") - 1) / step < middle)
    return rows.filter((F.col("n") <= most) | (F.col("k") == 0) | (F.col("k") == F.col("n") - 1) | inner).drop("n", "k")
