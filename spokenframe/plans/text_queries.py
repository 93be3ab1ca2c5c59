"""Text predicates and scalar functions over the sample tables.

The sample text holds few of the built-in phrases, so the lexicon functions run with a
lexicon of common words beside the built-in one.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..operators import lexicon_tables as H
from ..operators.candidates import places
from ..sources.shared import written
from .registry import query

_TRIG = (("story", 0.9, r"\b(then|this|to the)\b"), ("lesson", 0.85, r"\b(of the|it)\b"), ("claim", 0.5, r"\b(and|he)\b"), ("explanation", 0.35, r"\b(or)\b"))
_CONF = ((1.0, r"\b(the|a)\b.{0,28}\b(of|on)\b"), (0.45, r"\b(and|that)\b"), (0.2, r"\b(in|or)\b"))
_LOW = r"\b(then|onto|of the)\b"
_OPEN = "regexp_matches(regexp_replace(regexp_replace(lower(trim(text)), '^[\\s-]+', ''), '^(?:(?:" + "|".join(L.LEADING_FILLERS) + ")[ ,]*)*', ''), '^(?:" + "|".join(L.DEPENDENT_OPENERS) + ")')"
_NW = "len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> ''))"
#: A text whose letters and digits beyond ASCII are underscores: to DuckDB a word ends before such a letter, to the functions it doesn't.
_PLAIN = r"regexp_replace({}, '[^\x00-\x7F\P{{L}}]|[^\x00-\x7F\P{{Nd}}]|[^\x00-\x7F\P{{Mn}}]', '_', 'g')"
_STOP = ", ".join(f"'{w}'" for w in L.STOP_WORDS)
_FUNC = ", ".join(f"'{w}'" for w in L.FUNCTION_WORDS)
_TOK = f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({{}}, '')), '[a-z0-9'']+'), lambda w: length(w) > 2 and w not in ({_STOP})))"


def _has(column: str, pattern: str) -> str:
    return f"regexp_matches({_PLAIN.format(column)}, '(?i){pattern}')"


@query("e01_starts_dependently", "segments", f"select video_id, segment_id, {_OPEN} as dependent from segments")
def _(segments):
    return segments.select("video_id", "segment_id", T.starts_dependently(F.col("text")).alias("dependent"))


def _case(values: list, otherwise) -> str:
    return "case " + " ".join(f"when {_has('text', p)} then {v}" for (_, _, p), v in zip(_TRIG, values, strict=True)) + f" else {otherwise} end"


_W = _case([w for _, w, _ in _TRIG], 0)
_N = _case([f"'{n}'" for n, _, _ in _TRIG], "'generic'")


@query("e02_anchor_score", "segments", f"""with f as (select *, coalesce(string_agg(trim(text), ' ') over (partition by video_id order by segment_id rows between 1 following and 3 following), '') as following from segments),
a as (select video_id, segment_id, {_W} as w, {_N} as t, regexp_matches(text, '\\?\\s*$') and len(list_filter(regexp_split_to_array(trim(following), '\\s+'), lambda w: w <> '')) > 12 and {_W} < 0.75 as asks, {_has('text', _LOW)} as low, {_OPEN} as dep from f)
select video_id, segment_id, round(case when asks then 0.75 else w end - case when low then 0.6 else 0 end - case when dep then 0.25 else 0 end, 6)::double as score, case when asks then 'question' else t end as trigger from a""")
def _(segments):
    w = Window.partitionBy("video_id").orderBy("segment_id").rowsBetween(1, 3)
    scored = segments.withColumn("following", F.concat_ws(" ", F.collect_list(F.trim("text")).over(w))).withColumn("a", T.anchor_score(F.col("text"), F.col("following"), _TRIG, _LOW))
    return scored.select("video_id", "segment_id", F.round("a.score", 6).alias("score"), "a.trigger")


@query("e03_is_low_value", "segments", f"select video_id, segment_id, {_has('text', _LOW)} as low, {_has('text', L.LOW_VALUE)} as builtin from segments")
def _(segments):
    return segments.select("video_id", "segment_id", T.is_low_value(F.col("text"), _LOW).alias("low"), T.is_low_value(F.col("text")).alias("builtin"))


def _conf(patterns, column="text"):
    hits = " + ".join(f"{w} * len(regexp_extract_all({_PLAIN.format(column)}, '(?i){p.replace(chr(39), chr(39) * 2)}'))" for w, p in patterns)
    return f"case when trim({column}) = '' then 0 else least(1, ({hits}) / (greatest(8, {_NW.replace('trim(text)', f'trim({column})')}) / 40) / 3) end"


@query("e04_confrontation_score", "segments", f"select video_id, segment_id, round(({_conf(_CONF)})::decimal(18, 9), 6)::double as score, round(({_conf(L.CONFRONTATION)})::decimal(18, 9), 6)::double as builtin from segments")
def _(segments):
    """Scores to six places, decided on nine."""
    c = F.col("text")
    return segments.select("video_id", "segment_id", places(T.confrontation_score(c, _CONF), 6).alias("score"), places(T.confrontation_score(c), 6).alias("builtin"))


@query("e05_lexical_density", "segments", f"with t as (select video_id, segment_id, regexp_extract_all(lower(text), '[a-z'']+') as w from segments) select video_id, segment_id, round(case when len(w) = 0 then 0 else least(1, len(list_filter(w, lambda x: length(x) > 2 and x not in ({_FUNC}))) / len(w) / 0.55) end, 6) as density from t")
def _(segments):
    return segments.select("video_id", "segment_id", F.round(T.lexical_density(F.col("text")), 6).alias("density"))


@query("e06_text_similarity", "candidates", f"with n as (select *, lead(text) over (partition by video_id order by candidate_id) as other from candidates), t as (select video_id, candidate_id, {_TOK.format('text')} as a, {_TOK.format('other')} as b from n) select video_id, candidate_id, round(case when len(a) = 0 or len(b) = 0 then 0 else len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) end, 6) as similarity from t")
def _(candidates):
    other = F.lead("text").over(Window.partitionBy("video_id").orderBy("candidate_id"))
    return candidates.withColumn("other", other).select("video_id", "candidate_id", F.round(T.text_similarity(F.col("text"), F.col("other")), 6).alias("similarity"))


def _unstopped(segments):
    """Without full stops, so that capitals stand inside sentences and count as names."""
    return segments.withColumn("text", F.replace("text", F.lit("."), F.lit("")))


_NAMES = r"""tok as (select video_id, segment_id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z''’-]*')) as token, generate_subscripts(regexp_extract_all(text, '[A-Za-z][A-Za-z''’-]*'), 1) as pos, text from (select video_id, segment_id, replace(text, '.', '') as text from segments) u),
pre as (select *, regexp_split_to_array(text, '[A-Za-z][A-Za-z''’-]*')[pos] as before from tok),
names as (select distinct video_id, lower(token) as token from pre where pos > 1 and regexp_matches(token, '^[A-Z]') and not regexp_matches(before, '[.!?]["'')\]]*\s*$'))"""


@query("e07_proper_nouns", "segments", f"with {_NAMES} select video_id, token from names")
def _(segments):
    return T.proper_nouns(_unstopped(segments))


_TRUNCATED = f"""with {_NAMES}, n as (select video_id, lower(token) as token, count(*) as n, min(segment_id * 100000 + pos) as seen from tok group by 1, 2), k as (select n.* from n join names using (video_id, token) where length(token) >= 2),
p as (select s.video_id, s.token as short, l.token as long, row_number() over (partition by s.video_id, s.token order by length(l.token), l.seen) as r from k s join k l on l.video_id = s.video_id and length(l.token) > length(s.token) and ends_with(l.token, s.token) where l.n >= 1 and l.n >= 1.0 * s.n)"""


@query("e08_find_truncations", "segments", f"{_TRUNCATED} select video_id, short, long from p where r = 1")
def _(segments):
    return T.find_truncations(_unstopped(segments), least_length=2, dominance=1.0, least_count=1)


@query("e09_apply_truncations", "segments")
def _(segments):
    mapping = T.find_truncations(_unstopped(segments), least_length=2, dominance=1.0, least_count=1)
    return T.apply_truncations(segments.select("video_id", "segment_id", "text"), mapping, "segment_id")


@query("e09_truncated_words", "segments words", rf"""{_TRUNCATED}, q as (select w.*, regexp_extract(word, '[A-Za-z][A-Za-z''’-]*') as bare from words w),
z as (select q.*, case when upper(bare) = bare then upper(long) when upper(left(bare, 1)) = left(bare, 1) then upper(left(long, 1)) || lower(substr(long, 2)) else long end as new from q join p on p.video_id = q.video_id and p.short = lower(q.bare) and p.r = 1)
select video_id, segment_id, word_idx, left(word, instr(word, bare) - 1) || new || substr(word, instr(word, bare) + length(bare)) as word from z""")
def _(segments, words):
    mapping = T.find_truncations(_unstopped(segments), least_length=2, dominance=1.0, least_count=1)
    return T.truncated_words(words, written(mapping, "mapping"))


@query("e10_clean_label_text", "segments", r"""select video_id, segment_id, trim(regexp_replace(regexp_replace(concat(speaker, ' said: ', text), '(?i)\bspeakers?\s+[A-Z]\b', 'someone', 'g'), '\s+', ' ', 'g')) as cleaned, concat(upper(left(trim(text), 1)), substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 2)) as opened from segments""")
def _(segments):
    return segments.select("video_id", "segment_id", T.clean_label_text(F.concat("speaker", F.lit(" said: "), "text")).alias("cleaned"), T.clean_label_text(F.concat(F.lit("Summary: "), "text")).alias("opened"))


@query("e11_clean_hook", "segments", r"""select video_id, segment_id, regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '[ .]+$', '') as hook from segments""")
def _(segments):
    return segments.select("video_id", "segment_id", T.clean_hook(F.concat(F.lit("3) Best hook: Irony - \""), "text", F.lit("\""))).alias("hook"))


_BANNED = " ".join(f"when contains(lower(bare), '{p.replace(chr(39), chr(39) * 2)}') then 'generic phrase {(chr(34) + p + chr(34)).replace(chr(39), chr(39) * 2) if chr(39) in p else chr(39) * 2 + p + chr(39) * 2}'" for p in L.BANNED_HOOKS)
_QUOTED = r"""'["“”''‘’][^"“”]*["“”]'"""


@query("e12_hook_is_usable", "segments", rf"""with b as (select *, trim(regexp_replace(regexp_replace(text, '{T.EMOJI}', '', 'g'), '\s+', ' ', 'g')) as bare from segments), h as (select *, {_NW.replace('trim(text)', 'trim(bare)')} as n, {_PLAIN.format(f"regexp_replace(text, {_QUOTED}, ' ', 'g')")} as unquoted from b)
select video_id, segment_id, case when text = '' then 'empty' when n < 4 then format('too short ({{}} words)', n) when n > 12 then format('too long ({{}} words)', n) {_BANNED} when regexp_matches(unquoted, '(?i)\b(i|i''m|im|me|my|mine|we|we''re|our|ours|us)\b') then 'first person' when regexp_matches(text, '{T.NON_LATIN}') then 'not English' else '' end as reason from h""")
def _(segments):
    return segments.select("video_id", "segment_id", T.hook_reason(F.col("text")).alias("reason"))


@query("e13_ensure_emoji", "segments", "select video_id, segment_id, case when trim(text) = '' then '' else concat(case segment_id % 3 when 0 then '😳' when 1 then '🔥' else '🚨' end, ' ', trim(text)) end as hook from segments")
def _(segments):
    category = F.when(F.col("segment_id") % 3 == 0, "Shock").when(F.col("segment_id") % 3 == 1, "High-Share Potential").otherwise("none")
    return segments.select("video_id", "segment_id", T.ensure_emoji(F.col("text"), category).alias("hook"))


@query("e14_normalise_hashtags", "segments", "with t as (select video_id, segment_id, regexp_split_to_array(text, ' ') as w from segments), h as (select video_id, segment_id, list_transform(list_filter(list_transform(w, lambda x: regexp_replace(x, '[^0-9A-Za-z]', '', 'g')), lambda x: x <> ''), lambda x: '#' || x) as h from t) select video_id, segment_id, list_filter(h, lambda x, i: list_position(h, x) = i)[1:5] as tags from h")
def _(segments):
    return segments.select("video_id", "segment_id", T.normalise_hashtags(F.split("text", " ")).alias("tags"))


@query("e19_safe_name", "segments", r"""with n as (select video_id, segment_id, regexp_replace(trim(regexp_replace(text, '[<>:"/\\|?*\x00-\x1f]', '_', 'g')), '^\.+|\.+$', '', 'g') as s from segments) select video_id, segment_id, concat(coalesce(nullif(trim(left(regexp_replace(s, '\.', '_', 'g'), 120)), ''), 'video'), '.mp4') as name from n""")
def _(segments):
    name = F.concat(F.lit("a/b\\"), F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace("text", r'[<>:"/\\|?*\x00-\x1f]', "_")), r"^\.+|\.+$", ""), r"\.", "_"), F.lit(".mp4"))
    return segments.select("video_id", "segment_id", T.safe_name(name).alias("name"))


@query("e20_timecode", "segments", "select video_id, segment_id, format('{:02d}:{:02d}:{:02d}', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60) as code, format('{:d}:{:02d}:{:02d}.{:02d}', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000 // 10) as cue, case when start_ms >= 3600000 then format('{:d}:{:02d}:{:02d}', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60) else format('{:02d}:{:02d}', start_ms // 60000, start_ms // 1000 % 60) end as clock from segments")
def _(segments):
    c = F.col("start_ms")
    return segments.select("video_id", "segment_id", T.timecode(c).alias("code"), T.cue_timecode(c).alias("cue"), T.clock(c).alias("clock"))


@query("e21_caption_layout", "faces", "select video_id, t_ms, face_no, case when x <= 0 or w <= 0 then 22 else least(42, greatest(12, (x * 43) // (w * 31))) end::int as chars from faces")
def _(faces):
    return faces.select("video_id", "t_ms", "face_no", T.chars_per_line(F.col("x"), F.col("w")).alias("chars"))


@query("e22_cue_lines", "segments", r"""select video_id, segment_id, concat('Dialogue: 0,', format('{:d}:{:02d}:{:02d}.{:02d}', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000 // 10), ',', format('{:d}:{:02d}:{:02d}.{:02d}', end_ms // 3600000, end_ms // 60000 % 60, end_ms // 1000 % 60, end_ms % 1000 // 10), ',Default,,0,0,0,,', trim(replace(replace(replace(text, '\', '\\'), '{', '\{'), '}', '\}'))) as line from segments""")
def _(segments):
    return segments.select("video_id", "segment_id", T.cue_line(F.col("start_ms"), F.col("end_ms"), T.escape_markup(F.col("text"))).alias("line"))


@query("e24_media_shape", "faces", "select video_id, t_ms, face_no, x >= y as landscape, round(case when y > 0 then x / y else 0 end, 6) as ratio from faces")
def _(faces):
    return faces.select("video_id", "t_ms", "face_no", T.is_landscape(F.col("x"), F.col("y")).alias("landscape"), F.round(T.aspect_ratio(F.col("x"), F.col("y")), 6).alias("ratio"))


@query("e04_lexicon_table", "segments benchmark", r"""with x as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) as pattern from benchmark),
w as (select video_id, segment_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) as word from segments), h as (select video_id, segment_id, word, count(*) as hits from w join x on x.pattern = w.word group by 1, 2, 3)
select video_id, segment_id, count(*) as entries, sum(hits)::bigint as hits, round(sum(hits * length(word) / 10.0), 6)::double as score, arg_min(word, (-length(word), word)) as best from h group by 1, 2""")
def _(segments, benchmark):
    """Thousands of words of the benchmark as a lexicon, heavier the longer they are."""
    names = benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), F.lit(1))).alias("name")).distinct()
    lexicon = names.select(F.lit("benchmark").alias("lexicon"), "name", F.col("name").alias("pattern"), (F.length("name") / 10.0).alias("weight"), F.lit(True).alias("literal"))
    keys = ["video_id", "segment_id"]
    hits = written(H.lexicon_hits(segments, lexicon, keys), "hits")
    counts = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("entries"), F.sum("hits").alias("hits"))
    scores = H.weighted_hits(hits, keys).select(*keys, F.round("score", 6).alias("score"))
    return counts.join(scores.hint("merge"), keys).join(H.best_entries(hits, keys).select(*keys, F.col("name").alias("best")).hint("merge"), keys)
