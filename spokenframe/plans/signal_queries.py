"""Segmentation and signal statistics over the sample tables."""

from pyspark.sql import functions as F

from ..operators import segments as S
from ..operators import signals as G
from ..sources.shared import written
from .registry import query

HOP = 400
_R = "r.video_id, r.window_id"
_HEARD = f"heard as (select w.video_id, w.window_id, a.rms_db from windows w join audio_frames a on a.video_id = w.video_id and a.frame_idx >= w.start_ms // {HOP} and a.frame_idx < w.end_ms // {HOP})"
_BASE = "base as (select a.video_id, quantile_cont(a.rms_db, 0.5) as median_db, quantile_cont(a.rms_db, 0.95) as p95_db from audio_frames a join (select video_id, max(rms_db) as top from audio_frames group by 1) t on t.video_id = a.video_id where a.rms_db > t.top - 35 group by 1)"
_EVENTS = """thr as (select b.video_id, b.median_db, least(greatest(3 * coalesce(quantile_cont(a.flatness, 0.9) filter (a.rms_db > b.median_db - 12), 0), 0.12), 0.45) as flat_thresh, greatest(b.floor_db + 12, b.median_db - 30) as gate_db
  from audio_frames a join (select video_id, quantile_cont(rms_db, 0.5) as median_db, quantile_cont(rms_db, 0.05) as floor_db from audio_frames group by 1) b on b.video_id = a.video_id group by all),
known as (select a.*, t.* exclude (video_id) from audio_frames a join thr t on t.video_id = a.video_id),
q as (select video_id, 'silence' as kind, frame_idx, frame_idx - row_number() over (partition by video_id order by frame_idx) as island, rms_db, flatness, modulation, median_db, flat_thresh from known where rms_db < median_db - 22
  union all select video_id, 'emphasis', frame_idx, frame_idx - row_number() over (partition by video_id order by frame_idx), rms_db, flatness, modulation, median_db, flat_thresh from known where rms_db > median_db + 5
  union all select video_id, 'noise', frame_idx, frame_idx - row_number() over (partition by video_id order by frame_idx), rms_db, flatness, modulation, median_db, flat_thresh from known where rms_db > gate_db and flatness > flat_thresh),
runs as (select video_id, kind, min(frame_idx) * 400 as start_ms, (max(frame_idx) + 1) * 400 as end_ms, max(rms_db) as top, avg(modulation) as modulation, avg(flatness) as flatness, any_value(median_db) as median_db, any_value(flat_thresh) as flat_thresh from q group by video_id, kind, island),
ev as (select video_id, case when kind <> 'noise' then kind when modulation > 0.32 then 'laughter' else 'applause' end as kind, start_ms, end_ms,
  case kind when 'silence' then 1.0 when 'emphasis' then least(greatest((top - median_db) / 15, 0), 1) else least(greatest(flatness / flat_thresh / 2, 0.2), 1) end as strength
  from runs where end_ms - start_ms >= case kind when 'silence' then 450 when 'emphasis' then 350 else 800 end)"""


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 8) for n in names})


_SENT = """with m as (select *, coalesce(sum(before) over (partition by video_id, segment_id order by word_idx), 0) as part, coalesce(prev, start_ms) as from_ms from
 (select *, lag(case when ends then 1 else 0 end) over (partition by video_id, segment_id order by word_idx) as before, lag(end_ms) over (partition by video_id, segment_id order by word_idx) as prev from marked) x)
select video_id, segment_id, part, min(from_ms) as start_ms, max(end_ms) as end_ms, string_agg(trim(word), ' ' order by word_idx) as text, count(*) as n_words from m group by 1, 2, 3"""


@query("c01_sentences", "words segments", _SENT)
def _(words, segments):
    return S.build_sentences(written(words, "words"), segments)  # else one task sorts for the words' times and for the sentences at once


@query("c02_sentence_starts", "words segments", "select video_id, point from starts")
def _(words, segments):
    return S.sentence_starts(words, segments)


@query("c03_sentence_ends", "words segments", "select 'any' as kind, video_id, point from ends union all select 'punctuated', video_id, point from punctuated")
def _(words, segments):
    both = [S.sentence_ends(words, segments).withColumn("kind", F.lit("any")), S.sentence_ends(words, segments, punctuated_only=True).withColumn("kind", F.lit("punctuated"))]
    return both[0].union(both[1])


@query("c04_pause_points", "words", "select video_id, point from pauses")
def _(words):
    return S.pause_points(words)


@query("c05_mask_runs", "loudness", "select video_id, start_ms, end_ms from silences")
def _(loudness):
    return S.mask_runs(loudness, F.col("rms_db") < F.col("median_db") - 22, HOP, 450)


_TURNS = """with k as (select *, case when end_ms - start_ms >= 600 then speaker end as own from segments),
f as (select video_id, segment_id, start_ms, end_ms, coalesce(last_value(own ignore nulls) over (partition by video_id order by segment_id rows between unbounded preceding and current row), first_value(own ignore nulls) over (partition by video_id order by segment_id rows between current row and unbounded following)) as speaker from k),
n as (select *, case when lag(segment_id) over v is null or lag(speaker) over v is distinct from speaker or start_ms - lag(end_ms) over v >= 1200 then 1 else 0 end as new from f window v as (partition by video_id order by segment_id)),
i as (select *, sum(new) over (partition by video_id order by segment_id) as island from n)
select video_id, (island - 1)::bigint as turn_idx, any_value(speaker) as speaker, min(start_ms) as start_ms, max(end_ms) as end_ms from i group by video_id, island"""


@query("c06_merge_turns", "segments", _TURNS)
def _(segments):
    return S.merge_turns(segments)


@query("c07_caption_spans", "frames", """with p as (select video_id, quantile_cont(caption_score, 0.97) as peak from frames group by 1 having count(*) >= 8),
h as (select f.video_id, f.t_ms - 500 as s, f.t_ms + 500 as e from frames f join p on p.video_id = f.video_id where peak >= 0.008 and f.caption_score >= greatest(0.006, 0.45 * peak)),
n as (select *, case when lag(e) over (partition by video_id order by s) is null or s - lag(e) over (partition by video_id order by s) > 1500 then 1 else 0 end as new from h),
i as (select *, sum(new) over (partition by video_id order by s) as k from n) select video_id, min(s) as start_ms, max(e) as end_ms from i group by video_id, k""")
def _(frames):
    return S.caption_spans(frames)


@query("c08_cover_scenes", "scenes media", """with l as (select m.video_id, s.scene_idx, s.start_ms, s.end_ms, m.duration_ms, lead(s.scene_idx) over (partition by m.video_id order by s.scene_idx) is null as last from media m left join scenes s on s.video_id = m.video_id)
select video_id, coalesce(scene_idx, 0) as scene_idx, coalesce(start_ms, 0) as start_ms, case when scene_idx is null or (last and duration_ms - least(end_ms, duration_ms) > 500) then duration_ms else least(end_ms, duration_ms) end as end_ms from l""")
def _(scenes, media):
    return S.cover_scenes(scenes, media)


_BRK = "(c.done or w.start_ms - c.e > 550 or w.end_ms - c.s > 3200 or c.len + 1 + length(w.word) > 44 or coalesce(w.speaker <> c.sp, false))"


@query("c09_caption_cues", "words segments media", f"""with recursive w as (select x.*, case when s.segment_id % 5 <> 1 then s.speaker end as speaker, m.duration_ms, row_number() over (partition by x.video_id order by x.start_ms, x.word_idx) as r from words x join segments s on s.video_id = x.video_id and s.segment_id = x.segment_id join media m on m.video_id = x.video_id),
c as (select video_id, r, word, start_ms, end_ms, duration_ms, 0 as cue, start_ms as s, end_ms as e, length(word) as len, speaker as sp, regexp_matches(word, '[.!?]$') as done from w where r = 1
 union all select w.video_id, w.r, w.word, w.start_ms, w.end_ms, w.duration_ms, c.cue + {_BRK}::int, case when {_BRK} then w.start_ms else c.s end, w.end_ms, case when {_BRK} then length(w.word) else c.len + 1 + length(w.word) end, case when {_BRK} then w.speaker else c.sp end, regexp_matches(w.word, '[.!?]$') from c join w on w.video_id = c.video_id and w.r = c.r + 1),
g as (select video_id, cue as cue_idx, min(start_ms) as start_ms, least(arg_max(end_ms, r), any_value(duration_ms)) as end_ms, string_agg(word, ' ' order by r) as text from c group by 1, 2),
h as (select video_id, cue_idx, start_ms, case when end_ms <= start_ms then start_ms + 400 else end_ms end as end_ms, text from g)
select video_id, 0 as clip_id, cue_idx, start_ms, case when end_ms > lead(start_ms) over v then greatest(start_ms + 200, lead(start_ms) over v - 20) else end_ms end as end_ms, text from h window v as (partition by video_id order by cue_idx)""")
def _(words, segments, media):
    known = F.when(F.col("segment_id") % 5 != 1, F.col("speaker")).alias("speaker")
    rows = words.join(segments.select("video_id", "segment_id", known).hint("merge"), ["video_id", "segment_id"]).join(media.hint("merge"), "video_id")
    return S.caption_cues(rows.withColumn("clip_id", F.lit(0)).withColumn("clip_start", F.lit(0).cast("bigint")).withColumn("clip_end", F.col("duration_ms")))


@query("c10_suppress_cues", "segments scenes", "select video_id, segment_id as cue_id, start_ms, end_ms from segments c where not exists (select 1 from scenes s where s.video_id = c.video_id and s.scene_idx % 2 = 1 and (c.start_ms + c.end_ms) / 2 between s.start_ms and s.end_ms)")
def _(segments, scenes):
    return S.suppress_cues(segments.select("video_id", F.col("segment_id").alias("cue_id"), "start_ms", "end_ms"), scenes.filter("scene_idx % 2 = 1"))


_CHUNKS = """with recursive s as (select video_id, start_ms, length(trim(text)) + 1 as n, row_number() over (partition by video_id order by segment_id) as r from segments where trim(text) <> ''),
c as (select video_id, r, start_ms, 0 as chunk, n as total, start_ms as chunk_start from s where r = 1
 union all select s.video_id, s.r, s.start_ms, case when c.total >= 500 then c.chunk + 1 else c.chunk end, case when c.total >= 500 then s.n else c.total + s.n end, case when c.total >= 500 then s.start_ms else c.chunk_start end from c join s on s.video_id = c.video_id and s.r = c.r + 1),
k as (select video_id, chunk::bigint as chunk_idx, min(chunk_start) as start_ms, count(*) as n_segments, max(total)::bigint as chars from c group by 1, 2)"""


@query("c11_chunk_by_budget", "segments", _CHUNKS + " select video_id, chunk_idx, start_ms, n_segments, chars from k")
def _(segments):
    return S.chunk_by_budget(segments, 500)


@query("c11_chunks_by_pointers", "segments", _CHUNKS + " select video_id, chunk_idx, start_ms, n_segments, chars from k")
def _(segments):
    """Every video in the way of very long ones."""
    return S.chunk_by_budget(segments, 500, stream_rows=0)


@query("c12_sample_middle", "segments", """with n as (select video_id, segment_id, count(*) over (partition by video_id) as n, row_number() over (partition by video_id order by segment_id) - 1 as k from segments)
select video_id, segment_id as chunk_idx from n where n <= 4 or k = 0 or k = n - 1 or (k > 0 and k < n - 1 and (k - 1) % greatest(1, (n - 2) // 2) = 0 and (k - 1) / greatest(1, (n - 2) // 2) < 2)""")
def _(segments):
    return S.sample_middle(segments.select("video_id", F.col("segment_id").alias("chunk_idx")), 4, 2)


@query("c13_loudness_frames", "frames", """with p as (select video_id, t_ms // 1000 as i, brightness - 0.5 as v, count(*) over (partition by video_id) as n from frames),
k as (select video_id, unnest(range(0, greatest(1, (any_value(n) - 10) // 5 + 1))) as frame_idx from p group by 1)
select k.video_id, k.frame_idx, round(20 * log10(greatest(sqrt(sum(v * v) / 10), 1e-7)), 6) as rms_db from k join p on p.video_id = k.video_id and p.i between 5 * k.frame_idx and 5 * k.frame_idx + 9 group by 1, 2""")
def _(frames):
    pcm = frames.select("video_id", F.floor(F.col("t_ms") / 1000).alias("sample_idx"), (F.col("brightness") - 0.5).alias("value"))
    return G.loudness_frames(pcm, rate=100).withColumn("rms_db", F.round("rms_db", 6))


@query("d11_subtitle_band", "frames", """with r as (select video_id, t_ms // 20000 as profile_idx, t_ms // 1000 % 20 as line, case when t_ms // 1000 % 20 >= 14 + video_id % 4 then caption_score * 4 else motion / 100 end as density from frames),
e as (select video_id from r group by 1 having count(distinct profile_idx) >= 7), m as (select video_id, line, avg(density) as d from r where video_id in (select video_id from e) group by 1, 2),
b as (select video_id, quantile_cont(d, 0.9) filter (line < 12) as base, max(d) filter (line >= 12) as peak, arg_max(line, struct_pack(d := d, l := -line)) filter (line >= 12) as at from m group by 1),
o as (select m.video_id, m.line, lag(m.line) over (partition by m.video_id order by m.line desc) - m.line - 1 as hole from m join b on b.video_id = m.video_id where peak >= 0.018 and peak >= 1.6 * base and d >= greatest(1.2 * base, 0.25 * peak) and m.line <= b.at),
c as (select *, sum(case when hole > 1.6 then 1 else 0 end) over (partition by video_id order by line desc) as cut from o)
select video_id, round(least(greatest(min(line) / 20 - 0.015, 0.80), 0.97), 6) as band_top from c where cut = 0 group by 1""")
def _(frames):
    line = F.floor(F.col("t_ms") / 1000) % 20
    rows = frames.select("video_id", F.floor(F.col("t_ms") / 20_000).alias("profile_idx"), line.alias("row"), F.lit(20).alias("n_rows"), F.when(line >= 14 + F.col("video_id") % 4, F.col("caption_score") * 4).otherwise(F.col("motion") / 100).alias("density"))
    return G.subtitle_band(rows, least_profiles=7).withColumn("band_top", F.round("band_top", 6))


_WAVE = "list_sum(list_transform(x, lambda v, i: v * {f}(2 * pi() * k * (i - 1) / len(x))))"


@query("c14_envelope_modulation", "audio_frames", f"""with s as (select video_id, frame_idx, list(pow(10.0, rms_db / 20)) over (partition by video_id order by frame_idx rows between 11 preceding and 10 following) as seen, count(*) over (partition by video_id) as n from audio_frames),
m as (select video_id, frame_idx, n, list_transform(seen, lambda v: v - list_avg(seen)) as x from s),
d as (select video_id, frame_idx, n, len(x) as size, list_transform(range(0, len(x) // 2 + 1), lambda k: struct_pack(f := k / (len(x) * 0.05), m := sqrt(pow({_WAVE.format(f='cos')}, 2) + pow({_WAVE.format(f='sin')}, 2)))) as mag from m),
t as (select video_id, frame_idx, n, size, list_sum(list_transform(mag, lambda b: b.m)) as total, coalesce(list_sum(list_transform(list_filter(mag, lambda b: b.f >= 3 and b.f <= 8), lambda b: b.m)), 0) as band from d)
select video_id, frame_idx, round(case when n >= 22 and size >= 4 and total > 1e-9 then band / total else 0 end, 8) as modulation from t""")
def _(audio_frames):
    return _rounded(G.envelope_modulation(audio_frames.withColumn("rms", F.pow(F.lit(10.0), F.col("rms_db") / 20))), "modulation")


@query("d01_loudness_baseline", "audio_frames", f"with {_BASE} select video_id, round(median_db, 8) as median_db, round(p95_db, 8) as p95_db from base")
def _(audio_frames):
    return _rounded(G.loudness_baseline(audio_frames), "median_db", "p95_db")


@query("d02_reaction_thresholds", "audio_frames", f"with {_EVENTS} select video_id, round(median_db, 8) as median_db, round(flat_thresh, 8) as flat_thresh, round(gate_db, 8) as gate_db from thr")
def _(audio_frames):
    return _rounded(G.reaction_thresholds(audio_frames), "median_db", "flat_thresh", "gate_db")


@query("d03_audio_events", "audio_frames", f"with {_EVENTS} select video_id, kind, start_ms, end_ms, round(strength, 8) as strength from ev")
def _(audio_frames):
    return _rounded(G.audio_events(audio_frames, HOP), "strength")


@query("d04_shouting_score", "windows audio_frames", f"with {_HEARD}, {_BASE}, x as (select h.video_id, window_id, least(greatest((rms_db - median_db) / greatest(3, p95_db - median_db), 0), 1.5) as above from heard h join base b on b.video_id = h.video_id), r as (select video_id, window_id, 0.6 * avg((above > 0.75)::int) + 0.4 * least(greatest(quantile_cont(above, 0.95), 0), 1) as s from x group by 1, 2) select w.video_id, w.window_id, round(coalesce(s, 0), 8) as shouting from windows w left join r on r.video_id = w.video_id and r.window_id = w.window_id")
def _(windows, audio_frames):
    return _rounded(G.shouting_score(windows, audio_frames, HOP), "shouting")


@query("d05_exchange_rate", "windows turns", "with o as (select w.video_id, w.window_id, w.start_ms, w.end_ms, t.speaker, lag(t.speaker) over (partition by w.video_id, w.window_id order by t.turn_idx) as prev from windows w join turns t on t.video_id = w.video_id and t.end_ms > w.start_ms and t.start_ms < w.end_ms), r as (select video_id, window_id, count(*) as n, count(*) filter (prev <> speaker) as switches, any_value(end_ms - start_ms) as ms from o group by 1, 2) select w.video_id, w.window_id, round(case when n >= 2 then least(switches / (ms / 60000) / 12, 1) else 0 end, 8) as exchange from windows w left join r on r.video_id = w.video_id and r.window_id = w.window_id")
def _(windows, turns):
    return _rounded(G.exchange_rate_score(windows, turns), "exchange")


@query("d06_dynamics_score", "windows audio_frames", f"with {_HEARD}, m as (select video_id, quantile_cont(rms_db, 0.5) as median_db from audio_frames group by 1), r as (select h.video_id, h.window_id, least(greatest(0.35 + 0.65 * least(greatest((quantile_cont(rms_db, 0.9) - quantile_cont(rms_db, 0.1)) / 25, 0), 1) - least(greatest((avg((rms_db < median_db - 22)::int) - 0.25) * 1.6, 0), 0.6), 0), 1) as d from heard h join m on m.video_id = h.video_id group by 1, 2) select w.video_id, w.window_id, round(coalesce(d, 0.3), 8) as dynamics from windows w left join r on r.video_id = w.video_id and r.window_id = w.window_id")
def _(windows, audio_frames):
    return _rounded(G.dynamics_score(windows, audio_frames, HOP), "dynamics")


@query("d07_reaction_score", "windows audio_frames", f"with {_EVENTS}, r as (select w.video_id, w.window_id, least(coalesce(sum(strength * case when kind in ('laughter', 'cheer') then 0.45 when kind = 'applause' then 0.35 when kind = 'emphasis' then 0.12 else 0 end), 0), 1) as s from windows w left join ev on ev.video_id = w.video_id and ev.end_ms > w.start_ms and ev.start_ms < w.end_ms group by 1, 2) select video_id, window_id, round(coalesce(s, 0), 8) as reaction from r")
def _(windows, audio_frames):
    return _rounded(G.reaction_score(windows, G.audio_events(audio_frames, HOP)), "reaction")


_FACED = "faced as (select f.*, coalesce(n, 0) as n_faces from frames f left join (select video_id, t_ms, count(*) as n from faces group by 1, 2) c on c.video_id = f.video_id and c.t_ms = f.t_ms)"


def _faced(frames, faces):
    n = faces.groupBy("video_id", "t_ms").agg(F.count(F.lit(1)).alias("n_faces"))
    return frames.join(n.hint("merge"), ["video_id", "t_ms"], "left").withColumn("n_faces", F.coalesce("n_faces", F.lit(0)))


@query("d08_visual_interest", "windows frames faces", f"with {_FACED}, r as (select w.video_id, w.window_id, least(greatest(0.30 + 0.30 * avg((n_faces > 0)::int) + 0.20 * least(avg(motion) / 0.08, 1) + 0.10 * least(avg(sharpness) / 0.5, 1) - case when avg(brightness) < 0.12 or avg(brightness) > 0.94 then 0.20 else 0 end, 0), 1) as s from windows w join faced f on f.video_id = w.video_id and f.t_ms between w.start_ms and w.end_ms group by 1, 2) select w.video_id, w.window_id, round(coalesce(s, 0.4), 8) as interest from windows w left join r on r.video_id = w.video_id and r.window_id = w.window_id")
def _(windows, frames, faces):
    return _rounded(G.visual_interest(windows, _faced(frames, faces)), "interest")


@query("d09_dominant_face_count", "windows frames faces", f"with {_FACED} select w.video_id, w.window_id, coalesce(floor(quantile_cont(n_faces, 0.5)), 0)::bigint as faces from windows w left join faced f on f.video_id = w.video_id and f.t_ms between w.start_ms and w.end_ms group by 1, 2")
def _(windows, frames, faces):
    return G.dominant_face_count(windows, _faced(frames, faces))


@query("d12_token_counts", "segments", "with t as (select video_id, unnest(regexp_extract_all(lower(text), '[a-z'']+')) as w from segments) select video_id, w as token, count(*) as n from t group by 1, 2")
def _(segments):
    return G.token_counts(segments)


@query("d13_event_kinds", "windows audio_frames", f"with {_EVENTS} select w.video_id, w.window_id, coalesce(list(distinct kind order by kind) filter (kind is not null), []) as kinds from windows w left join ev on ev.video_id = w.video_id and ev.end_ms > w.start_ms and ev.start_ms < w.end_ms and kind <> 'silence' group by 1, 2")
def _(windows, audio_frames):
    return G.event_kinds(windows, G.audio_events(audio_frames, HOP))
