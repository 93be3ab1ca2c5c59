"""Interval and as-of lookups over the sample tables."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ranges as R
from .registry import query

_SEG = "from windows w left join segments s on s.video_id = w.video_id and s.end_ms > w.start_ms and s.start_ms < w.end_ms"
_WORD = "from windows w left join (select x.*, s.start_ms as s_start, s.end_ms as s_end from words x join segments s on s.video_id = x.video_id and s.segment_id = x.segment_id) x on x.video_id = w.video_id and x.start_ms + x.end_ms between 2 * w.start_ms and 2 * w.end_ms and x.s_end > w.start_ms and x.s_start < w.end_ms"
_KEYS = "w.video_id, w.window_id"


@query("b01_text_between", "windows segments", f"select {_KEYS}, coalesce(string_agg(trim(s.text), ' ' order by s.segment_id), '') as text, count(s.segment_id) as n_segments {_SEG} group by all")
def _(windows, segments):
    return R.text_between(windows, segments)


@query("b02_words_between", "windows words segments", f"select {_KEYS}, count(x.word) as n_words, coalesce(list(x.word order by x.word_idx) filter (x.word is not null), []) as words {_WORD} group by all")
def _(windows, words, segments):
    return R.words_between(windows, words, segments)


@query("b03_text_in_window", "windows words segments", f"with a as (select {_KEYS}, string_agg(x.word, ' ' order by x.word_idx) as spoken {_WORD} group by all), b as (select {_KEYS}, coalesce(string_agg(trim(s.text), ' ' order by s.segment_id), '') as text {_SEG} group by all) select video_id, window_id, coalesce(spoken, text) as text from a join b using (video_id, window_id)")
def _(windows, words, segments):
    return R.text_in_window(windows, words, segments)


@query("b04_speaker_at", "probes turns", "select p.video_id, p.probe_id, arg_min(t.speaker, t.turn_idx) as speaker from probes p left join turns t on t.video_id = p.video_id and t.start_ms <= p.t_ms and p.t_ms < t.end_ms group by all")
def _(probes, turns):
    return R.speaker_at(probes, turns)


@query("b05_speakers_between", "windows turns", f"with f as (select {_KEYS}, t.speaker, min(t.turn_idx) as k from windows w left join turns t on t.video_id = w.video_id and t.end_ms > w.start_ms and t.start_ms < w.end_ms group by all) select video_id, window_id, coalesce(list(speaker order by k) filter (speaker is not null), []) as speakers from f group by all")
def _(windows, turns):
    return R.speakers_between(windows, turns)


@query("b06_frames_between", "windows frames", f"select {_KEYS}, count(*) as n_frames, round(avg(f.motion), 6) as motion from windows w join frames f on f.video_id = w.video_id and f.t_ms between w.start_ms and w.end_ms group by all")
def _(windows, frames):
    return R.frames_between(windows, frames).groupBy("video_id", "window_id").agg(F.count(F.lit(1)).alias("n_frames"), F.round(F.avg("motion"), 6).alias("motion"))


@query("b07_events_between", "windows silences", f"select {_KEYS}, e.start_ms as event_start, e.end_ms as event_end from windows w join silences e on e.video_id = w.video_id and e.end_ms > w.start_ms and e.start_ms < w.end_ms")
def _(windows, silences):
    return R.events_between(windows, silences).select("video_id", "window_id", F.col("start_ms").alias("event_start"), F.col("end_ms").alias("event_end"))


_AT = "(epoch_us(ts) - min(epoch_us(ts)) over (partition by project_id)) // 1000"


@query("b07_events_between_long", "feedback", f"""with p as (select project_id, event_id, event, {_AT} as t from feedback),
q as (select *, coalesce(lead(t) over (partition by project_id order by t, event_id), t) as next from p),
w as (select project_id, event_id, t as s, t + 864000000 as e from q where event = 'boundary_adjusted')
select w.project_id as video_id, w.event_id as window_id, count(q.t) as n_spans, coalesce(sum(least(w.e, q.next) - greatest(w.s, q.t)) filter (q.t is not null), 0)::bigint as shared_ms
from w left join q on q.project_id = w.project_id and q.event = 'clip_selected' and q.next > w.s and q.t < w.e group by all""")
def _(feedback):
    """Ten days from each adjustment of a project, and the spans between a selection and what follows it, often hours."""
    t = F.timestamp_diff("MILLISECOND", F.min("ts").over(Window.partitionBy("project_id")), F.col("ts"))
    rows = feedback.select(F.col("project_id").alias("video_id"), "event_id", "event", t.alias("start_ms"))
    after = F.lead("start_ms").over(Window.partitionBy("video_id").orderBy("start_ms", "event_id"))
    rows = rows.withColumn("end_ms", F.coalesce(after, "start_ms"))
    windows = rows.filter("event = 'boundary_adjusted'").select("video_id", F.col("event_id").alias("window_id"), "start_ms", (F.col("start_ms") + 864_000_000).alias("end_ms"))
    spans = rows.filter("event = 'clip_selected'").select("video_id", "start_ms", "end_ms")
    shared = F.least("w_end", "end_ms") - F.greatest("w_start", "start_ms")
    found = R.events_between(windows, spans, long=True).groupBy("video_id", "window_id").agg(F.count(F.lit(1)).alias("n_spans"), F.sum(shared).alias("shared_ms"))
    return windows.select("video_id", "window_id").join(found.hint("merge"), ["video_id", "window_id"], "left").fillna(0, ["n_spans", "shared_ms"])


@query("b08_energy_between", "windows audio_frames", f"select {_KEYS}, count(*) as n_frames, round(avg(a.rms_db), 6) as mean_db from windows w join audio_frames a on a.video_id = w.video_id and a.frame_idx >= w.start_ms // 400 and a.frame_idx < w.end_ms // 400 group by all")
def _(windows, audio_frames):
    return R.energy_between(windows, audio_frames, 400).groupBy("video_id", "window_id").agg(F.count(F.lit(1)).alias("n_frames"), F.round(F.avg("rms_db"), 6).alias("mean_db"))


@query("b09_in_any_span", "probes silences", "select p.video_id, p.probe_id, coalesce(bool_or(s.start_ms is not null), false) as inside from probes p left join silences s on s.video_id = p.video_id and p.t_ms between s.start_ms and s.end_ms group by all")
def _(probes, spans):
    return R.in_any_span(probes, spans)


@query("b10_scene_count", "windows scenes", f"select {_KEYS}, count(s.scene_idx) as scene_count from windows w left join scenes s on s.video_id = w.video_id and s.end_ms > w.start_ms and s.start_ms < w.end_ms group by all")
def _(windows, scenes):
    return R.scene_count_between(windows, scenes)


@query("b11_scene_boundaries_near", "probes scenes", "with e as (select distinct video_id, point from (select video_id, start_ms as point from scenes union all select video_id, end_ms from scenes) x) select p.video_id, p.probe_id, coalesce(list(e.point order by e.point) filter (e.point is not null), []) as edges from probes p left join e on e.video_id = p.video_id and abs(e.point - p.t_ms) <= 1500 group by all")
def _(probes, scenes):
    return R.scene_boundaries_near(probes, scenes)


@query("b12_nearest_boundary", "probes starts", "with d as (select p.video_id, p.probe_id, s.point, row_number() over (partition by p.probe_id order by abs(s.point - p.t_ms), s.point desc) as r from probes p left join starts s on s.video_id = p.video_id and abs(s.point - p.t_ms) <= 2500) select video_id, probe_id, point from d where r = 1")
def _(probes, starts):
    return R.nearest_boundary(probes, starts, 2500)


@query("b13_word_at", "probes words", "with d as (select p.video_id, p.probe_id, x.word_idx, x.word, coalesce(p.t_ms > x.start_ms + 20 and p.t_ms < x.end_ms - 20, false) as mid_word, row_number() over (partition by p.probe_id order by x.start_ms, x.word_idx) as r from probes p left join words x on x.video_id = p.video_id and p.t_ms between x.start_ms and x.end_ms) select video_id, probe_id, word_idx, word, mid_word from d where r = 1")
def _(probes, words):
    return R.word_at(probes, words)


@query("b14_next_boundary", "probes starts", "select p.video_id, p.probe_id, min(s.point) as point from probes p left join starts s on s.video_id = p.video_id and s.point > p.t_ms and s.point <= p.t_ms + 6000 group by all")
def _(probes, starts):
    return R.next_boundary(probes, starts, 6000)


@query("b15_previous_boundary", "probes starts", "select p.video_id, p.probe_id, max(s.point) as point from probes p left join starts s on s.video_id = p.video_id and s.point < p.t_ms and s.point >= p.t_ms - 12000 group by all")
def _(probes, starts):
    return R.previous_boundary(probes, starts, 12_000)


@query("b16_surrounding_context", "windows segments", """with a as (select w.video_id, w.window_id, right(coalesce(string_agg(trim(s.text), ' ' order by s.segment_id), ''), 600) as before from windows w left join segments s on s.video_id = w.video_id and s.end_ms > greatest(0, w.start_ms - 25000) and s.start_ms < w.start_ms group by all),
b as (select w.video_id, w.window_id, left(coalesce(string_agg(trim(s.text), ' ' order by s.segment_id), ''), 600) as after from windows w left join segments s on s.video_id = w.video_id and s.end_ms > w.end_ms and s.start_ms < w.end_ms + 25000 group by all)
select * from a join b using (video_id, window_id)""")
def _(windows, segments):
    return R.surrounding_context(windows, segments)


@query("b17_time_overlap_ratio", "windows", """with l as (select *, lag(start_ms) over (partition by video_id order by start_ms, window_id) as p_start, lag(end_ms) over (partition by video_id order by start_ms, window_id) as p_end from windows)
select video_id, window_id, round(case when least(end_ms, p_end) > greatest(start_ms, p_start) then (least(end_ms, p_end) - greatest(start_ms, p_start)) / least(end_ms - start_ms, p_end - p_start) else 0 end, 6) as ratio from l where p_start is not null""")
def _(windows: DataFrame):
    w = Window.partitionBy("video_id").orderBy("start_ms", "window_id")
    pairs = windows.withColumn("p_start", F.lag("start_ms").over(w)).withColumn("p_end", F.lag("end_ms").over(w)).filter("p_start is not null")
    ratio = R.time_overlap_ratio(F.col("start_ms"), F.col("end_ms"), F.col("p_start"), F.col("p_end"))
    return pairs.select("video_id", "window_id", F.round(ratio, 6).alias("ratio"))


@query("b18_trailing_silence", "probes silences", "with d as (select p.video_id, p.probe_id, case when s.end_ms is null then 0 else least(s.end_ms, p.t_ms + 2000) - p.t_ms end as silence_ms, row_number() over (partition by p.probe_id order by s.start_ms) as r from probes p left join silences s on s.video_id = p.video_id and p.t_ms + 250 between s.start_ms and s.end_ms + 250) select video_id, probe_id, silence_ms from d where r = 1")
def _(probes, silences):
    return R.trailing_silence(probes, silences)
