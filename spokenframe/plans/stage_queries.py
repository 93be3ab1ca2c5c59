"""Whole stages over the sample tables."""

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..operators import segments as S
from . import generate
from . import stage_sql as Q
from .registry import query
from .selection_queries import _ANCHORS, _real
from .signal_queries import HOP, _faced
from .text_queries import _CONF, _LOW, _OPEN, _TRIG


@query("f00_generate_candidates", "words segments audio_frames frames faces scenes media", f"""with recursive {_ANCHORS}, raw as (select video_id, i * 100000 + j as window_id, i as anchor_id, start_ms, end_ms, anchor, trigger from cw where nth = 1), {Q.CUTS}, {Q.refine('raw', 'fine')},
own as (select f.video_id, f.window_id, f.start_ms, f.end_ms, w.anchor_id, w.anchor, w.trigger from fine f join raw w on w.video_id = f.video_id and w.window_id = f.window_id where f.end_ms - f.start_ms >= 20000), {Q.scores('own', 'scored')}, {Q.variants('scored', 'best')}
select b.video_id, b.rank, b.name, s.start_ms, s.end_ms, s.trigger, s.heuristic_score from best b join scored s on s.video_id = b.video_id and s.window_id = b.window_id""")
def _(words, segments, audio_frames, frames, faces, scenes, media):
    rows = generate.generate_candidates(words, segments, S.merge_turns(segments), audio_frames, _faced(frames, faces), scenes, media, hop_ms=HOP, triggers=_TRIG, low_value=_LOW, confrontation=_CONF)
    return rows.select("video_id", "rank", "name", "start_ms", "end_ms", "trigger", "heuristic_score")


@query("f19_apply_validation", "windows words segments scenes media", f"""with recursive v0 as (select w.*, case window_id % 5 when 0 then 'reject' when 1 then 'expand' else 'accept' end as verdict, case when window_id % 5 = 2 then -4000 else 0 end as shift_ms from windows w join media m on m.video_id = w.video_id), {Q.CUTS}, {Q.SPOKE},
v1 as (select *, case when shift_ms < 0 then -shift_ms else 12000 end as reach from v0 where verdict = 'expand' or shift_ms < 0), {Q.expand('v1', 'v2', 'w.reach')},
v3 as (select video_id, window_id, start_ms, end_ms from v2 union all select video_id, window_id, start_ms, end_ms from v0 where verdict = 'accept' and shift_ms >= 0), {Q.trim_opening('v3', 'v4', logistics=L.LOW_VALUE)}, v5 as (select *, case when trimmed then start_ms end as floor_ms from v4), {Q.refine('v5', 'v6', floor=True)},
v7 as (select r.*, {Q.TEXT.format(a='r.start_ms', b='r.start_ms + 6000')} as text from v6 r), v8 as (select video_id, window_id, start_ms, end_ms, {_OPEN} as opens from v7), v9 as (select * from v8 where opens), {Q.expand('v9', 'va')},
vb as (select video_id, window_id, start_ms, end_ms from va union all select video_id, window_id, start_ms, end_ms from v8 where not opens), {Q.complete('vb', 'r', low=20_000)}
select r.video_id, r.window_id, r.start_ms, r.end_ms, row_number() over (partition by r.video_id order by r.start_ms, r.window_id) as index, {Q.TEXT.format(a='r.start_ms', b='r.end_ms')} as text,
 coalesce((select list(speaker order by k) from (select t.speaker, min(t.turn_idx) as k from spoke t where t.video_id = r.video_id and t.end_ms > r.start_ms and t.start_ms < r.end_ms group by 1) y), []) as speakers from r""")
def _(windows, words, segments, scenes, media):
    verdict = F.when(F.col("window_id") % 5 == 0, "reject").when(F.col("window_id") % 5 == 1, "expand").otherwise("accept")
    verdicts = windows.select("video_id", "window_id", verdict.alias("verdict"), F.when(F.col("window_id") % 5 == 2, -4000).otherwise(0).alias("shift_ms"))
    return generate.apply_validation(_real(windows, media), verdicts, words, segments, S.merge_turns(segments), scenes, media)


_ASKED = f"""with {Q.CUTS}, ask as (select w.video_id, w.window_id, w.start_ms + 700 as start_ms, w.end_ms, m.duration_ms as total from windows w join media m on m.video_id = w.video_id where w.window_id % 3 = 0),
why as (select *, case when start_ms < 0 then 'start before the beginning' when end_ms <= start_ms then 'end before start' when end_ms > total then 'end after the end of the video' end as refused from ask),
fit as (select video_id, window_id, start_ms, end_ms from why where refused is null), {Q.refine('fit', 'new', search=1200)}, own as (select w.* from windows w join media m on m.video_id = w.video_id)"""


def _adjusted(windows, words, segments, scenes, media):
    asked = windows.filter("window_id % 3 = 0").withColumn("start_ms", F.col("start_ms") + 700)
    return generate.adjust_clips(asked, _real(windows, media), words, segments, scenes, media)


@query("f28_adjust_clip", "windows words segments scenes media", f"{_ASKED} select o.video_id, o.window_id, coalesce(n.start_ms, o.start_ms) as start_ms, coalesce(n.end_ms, o.end_ms) as end_ms, y.refused from own o left join new n on n.video_id = o.video_id and n.window_id = o.window_id left join why y on y.video_id = o.video_id and y.window_id = o.window_id")
def _(*tables):
    clips, _feedback = _adjusted(*tables)
    return clips


_MOVE = "concat('{{\"start_ms\":', {0}.start_ms, ',\"end_ms\":', {0}.end_ms, '}}')"


@query("f28_adjust_feedback", "windows words segments scenes media", f"{_ASKED} select o.video_id, o.window_id, 'boundary_adjusted' as event, concat('{{\"from\":', {_MOVE.format('o')}, ',\"to\":', {_MOVE.format('n')}, '}}') as payload from own o join new n on n.video_id = o.video_id and n.window_id = o.window_id")
def _(*tables):
    _clips, feedback = _adjusted(*tables)
    return feedback
