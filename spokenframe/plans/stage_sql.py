"""DuckDB SQL of boundary repair, scores and whole stages, in pieces that several queries put together.

Each function gives common table expressions over a table of windows (video_id, window_id, start_ms, end_ms), the
last of them under the given name.
"""

from ..functions import lexicons as L
from .signal_queries import _BASE, _EVENTS, _FACED, _SENT, _TURNS, HOP
from .text_queries import _CONF, _FUNC, _LOW, _OPEN, _TRIG, _conf, _has

#: What is said between a and b of window r: its words, or the texts of the segments.
TEXT = "coalesce((select string_agg(x.word, ' ' order by x.word_idx) from words x join segments s on s.video_id = x.video_id and s.segment_id = x.segment_id where x.video_id = r.video_id and x.start_ms + x.end_ms between 2 * ({a}) and 2 * ({b}) and s.end_ms > ({a}) and s.start_ms < ({b})), (select string_agg(trim(s.text), ' ' order by s.segment_id) from segments s where s.video_id = r.video_id and s.end_ms > ({a}) and s.start_ms < ({b})), '')"
ENDED = "regexp_matches({}, '[.!?][\"'')\\]]*\\s*$')"
CUTS = "cutpoints as (select distinct video_id, start_ms as point from scenes)"
NEAR = "(select arg_min(point, struct_pack(d := abs(point - {t}), p := -point)) from {p} q where q.video_id = w.video_id and abs(point - {t}) <= {n})"


#: Who speaks when: neighbouring segments of one speaker merged.
SPOKE = f"spoke as ({_TURNS})"


def _opens(text: str) -> str:
    return _OPEN.replace("trim(text)", f"trim({text})")


def refine(src: str, name: str = "r", *, low: int = 20_000, high: int = 60_000, search: int = 2500, floor: bool = False) -> str:
    """Windows snapped to boundaries, with start_kind and end_kind; with floor, src has floor_ms."""
    free = " and (w.floor_ms is null or q.point >= w.floor_ms - 50)" if floor else ""
    starts = NEAR.format(t="w.start_ms", p="starts", n=search)[:-1] + free + ")"
    floor_ms, lead = ("w.floor_ms", ", floor_ms - 180") if floor else ("null::bigint as floor_ms", "")
    return f"""a as (select w.video_id, w.window_id, w.start_ms, w.end_ms, {floor_ms}, m.duration_ms as total, {starts} as ss, (select min(point) from starts q where q.video_id = w.video_id and point > w.start_ms and point <= w.start_ms + 6000{free}) as sf, {NEAR.format(t='w.start_ms', p='cutpoints', n=1200)} as sc, {NEAR.format(t='w.start_ms', p='pauses', n=search)} as sp,
  {NEAR.format(t='w.end_ms', p='ends', n=search)} as es, (select min(point) from ends q where q.video_id = w.video_id and point > w.end_ms and point <= w.end_ms + 8000) as ef, {NEAR.format(t='w.end_ms', p='pauses', n=search)} as ep, {NEAR.format(t='w.end_ms', p='cutpoints', n=1200)} as ec from {src} w left join media m on m.video_id = w.video_id),
b as (select *, coalesce(ss, case when end_ms - sf >= {low} then sf end, sc, sp, start_ms) as s1, case when ss is not null then 'sentence' when end_ms - sf >= {low} then 'sentence(forward)' when sc is not null then 'scene' when sp is not null then 'pause' else 'requested' end as sk from a),
c as (select *, coalesce(es, case when ef - s1 <= {high} then ef end, ep, ec, end_ms) as e1, case when es is not null then 'sentence' when ef - s1 <= {high} then 'sentence(forward)' when ep is not null then 'pause' when ec is not null then 'scene' else 'requested' end as ek from b),
d as (select c.*, (select arg_min(x.start_ms, struct_pack(a := x.start_ms, b := x.word_idx)) from words x where x.video_id = c.video_id and c.s1 between x.start_ms and x.end_ms) as sw, (select arg_min(x.end_ms, struct_pack(a := x.start_ms, b := x.word_idx)) from words x where x.video_id = c.video_id and c.e1 between x.start_ms and x.end_ms) as ew from c),
f as (select video_id, window_id, total, floor_ms, greatest(0, case when s1 > sw + 20 then sw else s1 end - 180{lead})::double as s, least(case when e1 < ew - 20 then ew else e1 end + 350, total)::double as e, sk || case when s1 > sw + 20 then '+word' else '' end as start_kind, ek || case when e1 < ew - 20 then '+word' else '' end as end_kind from d),
g as (select *, greatest(0, {low} - (e - s)) as lack, least(greatest(0, {low} - (e - s)) * 0.6, s) as grow from f),
h as (select *, s - grow as s2, e + lack - grow as e2 from g),
i as (select *, case when lack > 0 and e2 > total then greatest(0, s2 - (e2 - total)) else s2 end as s3, case when lack > 0 and e2 > total then total else e2 end as e3 from h),
j as (select video_id, window_id, floor_ms, start_kind, end_kind, e3, s3, case when e3 - s3 > {high} then e3 - {high} end as cut from i),
w2 as (select *, (select min(point) from starts q where q.video_id = w.video_id and point >= w.cut and w.e3 - point >= {low}{free}) as tn, {NEAR.format(t='w.cut', p='starts', n=2000)[:-1]}{free}) as tr from j w),
{name} as (select video_id, window_id, start_kind, end_kind, round(greatest(0, case when cut is null then s3 else coalesce(tn, case when tr < e3 then tr end, cut) end))::bigint as start_ms, round(e3)::bigint as end_ms from w2)"""


def expand(src: str, name: str, lookback: str = "12000", high: int = 60_000) -> str:
    """Windows whose start moves back to the latest sentence start that stands on its own."""
    return f"""{name}_p as (select distinct w.video_id, w.window_id, w.start_ms, w.end_ms, s.point from {src} w left join starts s on s.video_id = w.video_id and s.point >= w.start_ms - {lookback} and s.point < w.start_ms and w.end_ms - s.point <= {high}),
{name}_d as (select distinct video_id, point from {name}_p where point is not null), {name}_o as (select r.video_id, r.point, {TEXT.format(a='r.point', b='r.point + 6000')} as text from {name}_d r), {name}_k as (select video_id, point from {name}_o where text <> '' and not {_OPEN}),
{name} as (select p.video_id, p.window_id, case when max(k.point) is null then any_value(p.start_ms) else greatest(0, max(k.point) - 180) end as start_ms, any_value(p.end_ms) as end_ms from {name}_p p left join {name}_k k on k.video_id = p.video_id and k.point = p.point group by 1, 2)"""


def trim_opening(src: str, name: str, *, low: int = 20_000, high: int = 60_000, logistics: str = _LOW) -> str:
    """Windows without leading sentences that are logistics, with `trimmed`.  Needs `with recursive`."""
    return f"""{name}_s as (select video_id, start_ms as a, end_ms as b, {_has('text', logistics)} as low, len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '')) as n from ({_SENT}) x),
{name}_w as (select w.video_id, w.window_id, w.start_ms, w.end_ms, m.duration_ms as total from {src} w left join media m on m.video_id = w.video_id),
{name}_n as (select w.*, s.a, s.b, s.low, s.n, row_number() over (partition by w.video_id, w.window_id order by s.a, s.b, s.low, s.n) as k from {name}_w w join {name}_s s on s.video_id = w.video_id and s.b > w.start_ms + 200 and s.a < w.end_ms),
{name}_l as (select *, lead(low) over (partition by video_id, window_id order by k) as next_low, least(coalesce((select min(q.b) from {name}_s q where q.video_id = y.video_id and q.b >= y.b + {low} and q.b > y.start_ms and q.a < y.end_ms + {high}), b + {low}), coalesce(nullif(total, 0), 9223372036854775807)) as longer from {name}_n y),
{name}_f as (select video_id, window_id, 0::bigint as k, start_ms as s, end_ms as e, false as hit, true as go from {name}_w
 union all select f.video_id, f.window_id, l.k, case when l.low and (f.e - l.b >= {low} or l.longer - l.b between {low} and {high}) then l.b else f.s end, case when l.low and f.e - l.b < {low} and l.longer - l.b between {low} and {high} then l.longer else f.e end,
  f.hit or (l.low and (f.e - l.b >= {low} or l.longer - l.b between {low} and {high})), case when l.low then f.e - l.b >= {low} or l.longer - l.b between {low} and {high} else l.n <= 3 and coalesce(l.next_low, false) end
  from {name}_f f join {name}_l l on l.video_id = f.video_id and l.window_id = f.window_id and l.k = f.k + 1 where f.go),
{name} as (select video_id, window_id, arg_max(s, k) as start_ms, arg_max(e, k) as end_ms, arg_max(hit, k) as trimmed from {name}_f group by 1, 2)"""


def complete(src: str, name: str, *, low: int = 0, high: int = 60_000) -> str:
    """Windows whose end leaves no sentence open, or at least no connective."""
    dangling = ", ".join(f"'{x}'" for x in L.DANGLING)
    return f"""{name}_t as (select r.*, m.duration_ms as total, {TEXT.format(a='greatest(0, r.end_ms - 6000)', b='r.end_ms')} as tail from {src} r left join media m on m.video_id = r.video_id),
{name}_o as (select *, tail <> '' and not {ENDED.format('tail')} as open from {name}_t),
{name}_h as (select r.*, (select min(point) from punctuated q where q.video_id = r.video_id and q.point > r.end_ms and q.point <= r.end_ms + 8000) as after, (select max(point) from punctuated q where q.video_id = r.video_id and q.point < r.end_ms and q.point >= r.end_ms - {high}) as before from {name}_o r),
{name}_m as (select *, coalesce(case when after is not null and least(after + 350, nullif(total, 0)) - start_ms <= {high} then least(after + 350, nullif(total, 0)) end, case when before + 350 - start_ms >= {low} then before + 350 end) as moved from {name}_h),
{name}_x as (select r.video_id, r.window_id, r.start_ms, r.end_ms as cut, x.word_idx, lower(trim(trim(x.word), ',.!?"'')')) in ({dangling}) as loose, lag(x.end_ms) over (partition by r.video_id, r.window_id order by x.word_idx) as sooner, row_number() over (partition by r.video_id, r.window_id order by x.word_idx desc) as k
  from {name}_m r join words x on x.video_id = r.video_id and x.start_ms + x.end_ms between 2 * r.start_ms and 2 * r.end_ms join segments s on s.video_id = x.video_id and s.segment_id = x.segment_id and s.end_ms > r.start_ms and s.start_ms < r.end_ms where r.open and r.moved is null),
{name}_g as (select *, bool_and(loose and sooner is not null and sooner - start_ms >= {low} and sooner >= cut - 1500) over (partition by video_id, window_id order by k) as goes from {name}_x),
{name}_e as (select video_id, window_id, coalesce(arg_max(sooner, k) filter (goes), any_value(cut)) as shaved from {name}_g group by 1, 2),
{name} as (select r.video_id, r.window_id, r.start_ms, case when not r.open then r.end_ms else coalesce(r.moved, e.shaved, r.end_ms) end as end_ms from {name}_m r left join {name}_e e on e.video_id = r.video_id and e.window_id = r.window_id)"""


def _any(column: str, *names: str) -> str:
    found = [_has(column, p) for n, _, p in _TRIG if n in names]
    return f"({' or '.join(found)})" if found else "false"


def scores(src: str, name: str) -> str:
    """Factors, punch, conflict and heuristic score of windows that have anchor and trigger as well."""
    loud = "0.6 * avg((above > 0.75)::int) filter ({0}) + 0.4 * least(greatest(quantile_cont(above, 0.95) filter ({0}), 0), 1)"
    words = "len(list_filter(regexp_split_to_array(trim({}), '\\s+'), lambda w: w <> ''))"
    kinds = " ".join(f"when '{n}' then {v}" for n, v in (("story", 0.9), ("confrontation", 0.85), ("lesson", 0.85), ("challenge", 0.8), ("question", 0.8), ("disagreement", 0.8), ("conclusion", 0.75), ("number", 0.6), ("claim", 0.55), ("explanation", 0.45)))
    weights = "0.20 * content_clarity + 0.20 * standalone_completeness + 0.15 * narrative_structure + 0.10 * visual_interest + 0.10 * audio_dynamics + 0.10 * emotional_reaction + 0.05 * information_density + 0.05 * opening_strength + 0.05 * ending_payoff"
    return f"""{_BASE}, {_EVENTS}, {_FACED}, {SPOKE},
t0 as (select r.*, {TEXT.format(a='r.start_ms', b='r.end_ms')} as text from {src} r),
t1 as (select r.*, {TEXT.format(a='r.start_ms', b='r.start_ms + 6000')} as opening, {TEXT.format(a='greatest(0, r.end_ms - 7000)', b='r.end_ms')} as ending, {TEXT.format(a='r.start_ms', b='r.start_ms + 3000')} as head,
  (select min(x.start_ms) from words x join segments s on s.video_id = x.video_id and s.segment_id = x.segment_id where x.video_id = r.video_id and x.start_ms + x.end_ms between 2 * r.start_ms and 2 * (r.start_ms + 3000) and s.end_ms > r.start_ms and s.start_ms < r.start_ms + 3000) as head_first from t0 r where {words.format('text')} >= 18),
md as (select video_id, quantile_cont(rms_db, 0.5) as middle from audio_frames group by 1),
ab as (select r.video_id, r.window_id, a.rms_db, a.rms_db < md.middle - 22 as quiet, a.frame_idx < r.end_ms // {HOP} as whole, a.frame_idx < (r.start_ms + 3000) // {HOP} as first, least(greatest((a.rms_db - b.median_db) / greatest(3, b.p95_db - b.median_db), 0), 1.5) as above
  from t1 r join audio_frames a on a.video_id = r.video_id and a.frame_idx >= r.start_ms // {HOP} and a.frame_idx < greatest(r.end_ms, r.start_ms + 3000) // {HOP} join base b on b.video_id = r.video_id join md on md.video_id = r.video_id),
ld as (select video_id, window_id, {loud.format('whole')} as shouting, {loud.format('first')} as head_shouting, least(greatest(0.35 + 0.65 * least(greatest((quantile_cont(rms_db, 0.9) filter (whole) - quantile_cont(rms_db, 0.1) filter (whole)) / 25, 0), 1) - least(greatest((avg(quiet::int) filter (whole) - 0.25) * 1.6, 0), 0.6), 0), 1) as dynamics from ab group by 1, 2),
tk as (select video_id, window_id, kind, ms, speaker, lag(speaker) over (partition by video_id, window_id, kind order by turn_idx) as prev from (select r.video_id, r.window_id, k.kind, case when k.kind = 'own' then r.end_ms - r.start_ms else 5000 end as ms, t.speaker, t.turn_idx from t1 r cross join (values ('own'), ('head')) k(kind) join spoke t on t.video_id = r.video_id and t.end_ms > r.start_ms and t.start_ms < case when k.kind = 'own' then r.end_ms else r.start_ms + 5000 end) y),
ex as (select video_id, window_id, kind, count(distinct speaker) as speakers, case when count(*) >= 2 then least(count(*) filter (prev <> speaker) / (any_value(ms) / 60000) / 12, 1) else 0 end as rate from tk group by 1, 2, 3),
sc as (select r.video_id, r.window_id, count(*) as scene_count from t1 r join scenes s on s.video_id = r.video_id and s.end_ms > r.start_ms and s.start_ms < r.end_ms group by 1, 2),
vi as (select r.video_id, r.window_id, least(greatest(0.30 + 0.30 * avg((n_faces > 0)::int) + 0.20 * least(avg(motion) / 0.08, 1) + 0.10 * least(avg(sharpness) / 0.5, 1) - case when avg(brightness) < 0.12 or avg(brightness) > 0.94 then 0.20 else 0 end, 0), 1) as interest from t1 r join faced f on f.video_id = r.video_id and f.t_ms between r.start_ms and r.end_ms group by 1, 2),
re as (select r.video_id, r.window_id, least(sum(strength * case when kind in ('laughter', 'cheer') then 0.45 when kind = 'applause' then 0.35 when kind = 'emphasis' then 0.12 else 0 end), 1) as reaction from t1 r join ev on ev.video_id = r.video_id and ev.end_ms > r.start_ms and ev.start_ms < r.end_ms group by 1, 2),
m0 as (select r.*, coalesce(shouting, 0) as shouting, coalesce(head_shouting, 0) as head_shouting, coalesce(dynamics, 0.3) as dynamics, coalesce(o.rate, 0) as exchange, coalesce(o.speakers, 0) as n_speakers, coalesce(h.rate, 0) as head_exchange, coalesce(scene_count, 0) as scene_count, coalesce(interest, 0.4) as interest, coalesce(reaction, 0) as reaction,
  {words.format('r.text')} / greatest((r.end_ms - r.start_ms) / 1000, 0.001) as pace, {_opens('r.opening')} as dependent, {ENDED.format('r.ending')} as ended, regexp_extract_all(lower(r.text), '[a-z'']+') as toks, {_conf(_CONF, 'r.text')} as fight, {_conf(_CONF, 'r.head')} as head_fight
  from t1 r left join ld on ld.video_id = r.video_id and ld.window_id = r.window_id left join ex o on o.video_id = r.video_id and o.window_id = r.window_id and o.kind = 'own' left join ex h on h.video_id = r.video_id and h.window_id = r.window_id and h.kind = 'head'
  left join sc on sc.video_id = r.video_id and sc.window_id = r.window_id left join vi on vi.video_id = r.video_id and vi.window_id = r.window_id left join re on re.video_id = r.video_id and re.window_id = r.window_id),
m1 as (select *, round((least(pace / 2.6, 1) * case when pace < 0.9 then 0.6 else 1 end * case when {_has('text', _LOW)} then 0.35 else 1 end)::decimal(18, 9), 4)::double as content_clarity, round((0.5 + case when dependent then 0 else 0.25 end + case when ended then 0.25 else 0 end)::decimal(18, 9), 4)::double as standalone_completeness,
  round((least(1, case trigger {kinds} else 0.3 end + case when n_speakers > 1 then 0.1 else 0 end))::decimal(18, 9), 4)::double as narrative_structure, round((interest * case when scene_count > 6 then 0.8 else 1 end)::decimal(18, 9), 4)::double as visual_interest, round((dynamics)::decimal(18, 9), 4)::double as audio_dynamics, round((reaction)::decimal(18, 9), 4)::double as reaction4,
  round((case when len(toks) = 0 then 0 else least(1, len(list_filter(toks, lambda x: length(x) > 2 and x not in ({_FUNC}))) / len(toks) / 0.55) end)::decimal(18, 9), 4)::double as information_density,
  round((case when {_any('opening', 'story')} or regexp_matches(opening, '\\?\\s*$') then 0.9 when {_any('opening', *[n for n, _, _ in _TRIG])} then 0.7 else 0.35 end * case when dependent then 0.5 else 1 end)::decimal(18, 9), 4)::double as opening4,
  round((least(1, case when {_any('ending', 'conclusion', 'lesson', 'number')} then 0.95 when ended then 0.7 else 0.35 end + case when reaction > 0.25 then 0.2 else 0 end))::decimal(18, 9), 4)::double as ending_payoff,
  round((case when trim(head) = '' then 0.05 else least(greatest(0.40 * head_shouting + 0.30 * head_fight + 0.15 * head_exchange + coalesce(0.15 * least(greatest(1 - (head_first - start_ms) / 1200, 0), 1), 0), 0), 1) end)::decimal(18, 9), 4)::double as punch,
  round((least(greatest(0.34 * shouting + 0.28 * exchange + 0.38 * fight, 0), 1))::decimal(18, 9), 4)::double as intensity from m0),
m2 as (select *, round((least(1, 0.45 * opening4 + 0.55 * punch))::decimal(18, 9), 4)::double as opening_strength, round((least(1, greatest(reaction4, intensity)))::decimal(18, 9), 4)::double as emotional_reaction,
  concat_ws(', ', case when round((shouting)::decimal(18, 9), 4)::double > 0.5 then 'raised voices' end, case when round((exchange)::decimal(18, 9), 4)::double > 0.5 then 'rapid back-and-forth' end, case when round((fight)::decimal(18, 9), 4)::double > 0.4 then 'direct confrontation' end, case when punch > 0.6 then 'strong opening' end) as note from m1),
{name} as (select *, round((0.6 * (0.82 * ({weights}) + 0.18 * least(greatest(anchor, 0), 1)) + 0.22 * punch + 0.18 * intensity)::decimal(18, 9), 4)::double as heuristic_score from m2)"""


def variants(src: str, name: str, *, pool: int = 80) -> str:
    """The best three differing windows of each anchor, then the best of each video.  Needs `with recursive`."""
    return f"""vo as (select video_id, anchor_id, window_id as id, start_ms as s, end_ms as e, heuristic_score as h, row_number() over (partition by video_id, anchor_id order by -heuristic_score, start_ms, end_ms, window_id) as r from {src}),
vf as (select video_id, anchor_id, r, [struct_pack(id := id, s := s, e := e, h := h)] as kept from vo where r = 1 union all select o.video_id, o.anchor_id, o.r, case when len(list_filter(f.kept, lambda k: greatest(0, least(o.e, k.e) - greatest(o.s, k.s)) / least(o.e - o.s, k.e - k.s) > 0.92)) > 0 then f.kept else list_append(f.kept, struct_pack(id := o.id, s := o.s, e := o.e, h := o.h)) end from vf f join vo o on o.video_id = f.video_id and o.anchor_id = f.anchor_id and o.r = f.r + 1),
vl as (select video_id, anchor_id, unnest(kept[1:3]) as k from (select *, row_number() over (partition by video_id, anchor_id order by r desc) as last from vf) x where last = 1),
vn as (select video_id, anchor_id, k.id as window_id, row_number() over (partition by video_id order by -k.h, anchor_id, k.s, k.e, k.id) as rank from vl),
{name} as (select video_id, anchor_id, window_id, rank, 'candidate_' || lpad(rank::varchar, 3, '0') as name from vn where rank <= {pool})"""
