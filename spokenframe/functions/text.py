"""Column functions over transcript, hook and caption text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.segments import ends_sentence
from ..operators.joins import dealt
from . import lexicons as L

EMOJI = "[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{2B00}-\\x{2BFF}\\x{FE0F}\\x{200D}]"
NON_LATIN = "[\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{AC00}-\\x{D7AF}\\x{0400}-\\x{04FF}\\x{0600}-\\x{06FF}\\x{0590}-\\x{05FF}\\x{0900}-\\x{097F}]"
FIRST_PERSON = r"(?i)\b(i|i'm|im|me|my|mine|we|we're|our|ours|us)\b"
SPEAKER_LABEL = r"(?i)\bspeakers?\s+[A-Z]\b"
TOKEN = r"[A-Za-z][A-Za-z'’-]*"


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def opener_pattern(openers: tuple[str, ...] = L.DEPENDENT_OPENERS, fillers: tuple[str, ...] = L.LEADING_FILLERS) -> str:
    """Fillers, as often as they come, then an opener. No filler may give way to an opener (possessive)."""
    return f"^(?:(?:{'|'.join(fillers)})[ ,]*+)*+(?:{'|'.join(openers)})"


def starts_dependently(c: Column, **lexicon) -> Column:
    """Whether a text opens on words that lean on something said before; fillers in front don't count."""
    return F.regexp_replace(F.lower(F.trim(text(c))), r"^[\s-]+", "").rlike(opener_pattern(**lexicon))


def words_of(c: Column) -> Column:
    return F.filter(F.split(F.trim(text(c)), r"\s+"), lambda w: w != "")


def best_trigger(c: Column, triggers=L.TRIGGERS) -> Column:
    """(weight, trigger) of the best matching pattern, the first of equals; (0, 'generic') without one."""
    found = F.array(*[F.when(text(c).rlike(f"(?i){p}"), F.struct(F.lit(w).alias("weight"), F.lit(n).alias("trigger"))) for n, w, p in triggers])
    none = F.struct(F.lit(0.0).alias("weight"), F.lit("generic").alias("trigger"))
    return F.aggregate(F.array_compact(found), none, lambda a, x: F.when(x["weight"] > a["weight"], x).otherwise(a))


def anchor_score(c: Column, following: Column, triggers=L.TRIGGERS, low_value: str = L.LOW_VALUE) -> Column:
    """(score, trigger) of a sentence: its best trigger; a question with a long answer counts 0.75; less for logistics and dependent openings."""
    best = best_trigger(c, triggers)
    asks = text(c).rlike(r"\?\s*$") & (F.size(words_of(following)) > 12) & (best["weight"] < 0.75)
    score = F.when(asks, 0.75).otherwise(best["weight"])
    score = score - F.when(is_low_value(c, low_value), 0.6).otherwise(0.0) - F.when(starts_dependently(c), 0.25).otherwise(0.0)
    return F.struct(score.alias("score"), F.when(asks, F.lit("question")).otherwise(best["trigger"]).alias("trigger"))


def is_low_value(c: Column, pattern: str = L.LOW_VALUE) -> Column:
    return text(c).rlike(f"(?i){pattern}")


def confrontation_score(c: Column, patterns=L.CONFRONTATION) -> Column:
    """Weighted pattern hits for each 40 words, three being 1; 0 for a blank text."""
    hits = sum((F.lit(w) * F.regexp_count(text(c), F.lit(f"(?i){p}")) for w, p in patterns), F.lit(0.0))
    n = F.size(words_of(c))
    return F.when(F.trim(text(c)) == "", 0.0).otherwise(F.least(F.lit(1.0), hits / (F.greatest(F.lit(8), n) / 40) / 3))


def lexical_density(c: Column, stop_words: tuple[str, ...] = L.FUNCTION_WORDS) -> Column:
    """Share of words over two letters that are not stop words; 0.55 being 1."""
    all_words = F.regexp_extract_all(F.lower(text(c)), F.lit("([a-z']+)"), F.lit(1))
    content = lambda words: F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*stop_words))
    share = lambda words: F.when(F.size(words) == 0, 0.0).otherwise(F.least(F.lit(1.0), F.size(content(words)) / F.size(words) / 0.55))
    return F.element_at(F.transform(F.array(all_words), share), 1)


def content_tokens(c: Column, stop_words: tuple[str, ...] = L.STOP_WORDS) -> Column:
    tokens = F.regexp_extract_all(F.lower(text(c)), F.lit("([a-z0-9']+)"), F.lit(1))
    return F.array_distinct(F.filter(tokens, lambda w: (F.length(w) > 2) & ~w.isin(*stop_words)))


def token_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def text_similarity(a: Column, b: Column) -> Column:
    return token_similarity(content_tokens(a), content_tokens(b))


def _tokens(segments: DataFrame) -> DataFrame:
    """(video_id, segment_id, pos, token, before): tokens with the text between each and the one before."""
    cut = F.split(F.regexp_replace("text", f"({TOKEN})", "\u0001$1\u0002"), "\u0001")
    rows = segments.select("video_id", "segment_id", F.posexplode(cut).alias("pos", "piece"))
    part = rows.select("video_id", "segment_id", "pos", F.substring_index("piece", "\u0002", 1).alias("token"), F.when(F.col("piece").contains("\u0002"), F.substring_index("piece", "\u0002", -1)).otherwise(F.col("piece")).alias("after"), F.col("piece").contains("\u0002").alias("word"))
    w = Window.partitionBy("video_id", "segment_id").orderBy("pos")
    return part.withColumn("before", F.lag("after").over(w)).filter("word")


def proper_nouns(segments: DataFrame) -> DataFrame:
    """(video_id, token): lower-cased tokens that stand capitalised somewhere but at a sentence's start."""
    inner = (F.col("pos") > 1) & ~ends_sentence(F.rtrim("before"))
    return _tokens(segments).filter(inner & F.col("token").rlike("^[A-Z]")).select("video_id", F.lower("token").alias("token")).distinct()


def find_truncations(segments: DataFrame, *, least_length: int = 4, dominance: float = 2.0, least_count: int = 2) -> DataFrame:
    """(video_id, short, long): rare names that end another, much commoner name of the same video; the shortest such name wins, then the first in order.

    Candidates meet by the last least_length letters, so that names only meet names of like endings.
    """
    counts = _tokens(segments).groupBy("video_id", F.lower("token").alias("token")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("segment_id", "pos")).alias("seen"))
    names = counts.join(proper_nouns(segments).hint("merge"), ["video_id", "token"]).filter(F.length("token") >= least_length).withColumn("tail", F.right("token", F.lit(least_length)))
    short = names.select("video_id", "tail", F.col("token").alias("short"), F.col("n").alias("short_n"))
    long = names.filter(F.col("n") >= least_count).select("video_id", "tail", F.col("token").alias("long"), F.col("n").alias("long_n"), "seen")
    pairs = short.join(long.hint("merge"), ["video_id", "tail"]).filter((F.length("long") > F.length("short")) & F.col("long").endswith(F.col("short")) & (F.col("long_n") >= dominance * F.col("short_n")))
    return pairs.groupBy("video_id", "short").agg(F.min_by("long", F.struct(F.length("long"), "seen")).alias("long"))


def match_case(replacement: Column, original: Column) -> Column:
    upper = (F.upper(original) == original) & (F.lower(original) != original)
    first = F.left(original, F.lit(1))
    title = F.concat(F.upper(F.left(replacement, F.lit(1))), F.lower(F.substr(replacement, F.lit(2))))
    return F.when(upper, F.upper(replacement)).when((F.upper(first) == first) & (F.lower(first) != first), title).otherwise(replacement)


def apply_truncations(rows: DataFrame, mapping: DataFrame, key: str, column: str = "text") -> DataFrame:
    """rows with every mapped token of the column replaced, keeping its case. rows: (video_id, key, column, ...); mapping: (video_id, short, long).

    A video's mapping (a handful of names) travels as one map beside its rows.
    """
    known = mapping.groupBy("video_id").agg(F.map_from_entries(F.collect_list(F.struct("short", "long"))).alias("_map"))
    pieces = F.split(F.regexp_replace(F.col(column), f"({TOKEN})", "\u0001$1\u0001"), "\u0001")

    def swap(x: Column) -> Column:
        new = F.try_element_at(F.col("_map"), F.lower(x))
        return F.when(new.isNotNull(), match_case(new, x)).otherwise(x)

    fixed = F.when(F.col("_map").isNull(), F.col(column)).otherwise(F.array_join(F.transform(pieces, swap), ""))
    return rows.join(known.hint("merge"), "video_id", "left").withColumn(column, fixed).drop("_map")


def truncated_words(words: DataFrame, mapping: DataFrame) -> DataFrame:
    """(video_id, segment_id, word_idx, word): the words whose first token is mapped, with that token replaced in its case; their number is how many words a mapping changes.

    words: (video_id, segment_id, word_idx, word, ...); mapping: (video_id, short, long).  Times stay those of the words.
    """
    bare = F.regexp_extract("word", TOKEN, 0)
    rows = words.select("video_id", "segment_id", "word_idx", "word", bare.alias("bare"), F.lower(bare).alias("short")).filter("bare <> ''")
    hit = dealt(rows, mapping.select("video_id", "short", "long"), ["video_id", "short"])
    at = F.instr("word", F.col("bare"))
    fixed = F.concat(F.left("word", at - 1), match_case(F.col("long"), F.col("bare")), F.substr("word", at + F.length("bare")))
    return hit.select("video_id", "segment_id", "word_idx", fixed.alias("word"))


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text(c), SPEAKER_LABEL, "someone"), r"\s+", " "))


def clean_label_text(c: Column, openers: tuple[str, ...] = L.TASK_OPENERS) -> Column:
    """Speaker labels become "someone", spaces collapse, openings that restate the task go, the next letter rises."""
    def without(acc: Column, opener: Column) -> Column:
        rest = F.trim(F.substr(acc, F.length(opener) + 1))
        return F.when(F.startswith(F.lower(acc), opener), F.concat(F.upper(F.left(rest, F.lit(1))), F.substr(rest, F.lit(2)))).otherwise(acc)

    return F.aggregate(F.array(*[F.lit(o) for o in openers]), _squeezed(c), without)


def clean_hook(c: Column) -> Column:
    """A hook without list number, label, category, wrapping quotes and trailing stops."""
    out = F.regexp_replace(F.regexp_replace(_squeezed(c), r"^\s*\d+[.)]\s*", ""), r"(?i)^(hook|best hook)\s*[:\-]\s*", "")
    for name, _ in L.HOOK_CATEGORIES:
        out = F.regexp_replace(out, rf"(?i)^\Q{name}\E\s*[:\-]\s*", "")
    quoted = out.rlike("(?s)^[\"'“‘].*[\"'”’]$") & (F.length(out) > 1)
    out = F.when(quoted, F.trim(F.substr(out, F.lit(2), F.length(out) - 2))).otherwise(out)
    return F.regexp_replace(out, r"[ .]+$", "")


def has_emoji(c: Column) -> Column:
    return text(c).rlike(EMOJI)


def strip_emoji(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text(c), EMOJI, ""), r"\s+", " "))


def ensure_emoji(c: Column, category: Column) -> Column:
    """The text with its category's sign in front, unless it is blank or holds one."""
    sign = F.lit(L.DEFAULT_EMOJI)
    for name, e in L.HOOK_CATEGORIES:
        sign = F.when(category == name, F.lit(e)).otherwise(sign)
    t = F.trim(text(c))
    return F.when((t == "") | has_emoji(t), t).otherwise(F.concat(sign, F.lit(" "), t))


def is_first_person(c: Column) -> Column:
    return F.regexp_replace(text(c), "[\"“”'‘’][^\"“”]*[\"“”]", " ").rlike(FIRST_PERSON)


def hook_reason(c: Column, banned: tuple[str, ...] = L.BANNED_HOOKS) -> Column:
    """Why a hook can't be used; '' if it can."""
    bare = strip_emoji(c)
    n = F.size(words_of(bare))
    out = F.when(text(c) == "", "empty").when(n < 4, F.format_string("too short (%d words)", n)).when(n > 12, F.format_string("too long (%d words)", n))
    for p in banned:
        shown = f'"{p}"' if "'" in p else f"'{p}'"
        out = out.when(F.contains(F.lower(bare), F.lit(p)), F.lit(f"generic phrase {shown}"))
    return out.when(is_first_person(c), "first person").when(text(c).rlike(NON_LATIN), "not English").otherwise("")


def hook_is_usable(c: Column) -> Column:
    return F.struct((hook_reason(c) == "").alias("ok"), hook_reason(c).alias("reason"))


def normalise_hashtags(tags: Column, most: int = 5) -> Column:
    """Letters and digits with # in front, distinct in order, at most five."""
    bare = F.transform(tags, lambda t: F.regexp_replace(text(t.cast("string")), "[^0-9A-Za-z]", ""))
    return F.slice(F.array_distinct(F.transform(F.filter(bare, lambda t: t != ""), lambda t: F.concat(F.lit("#"), t))), 1, most)


def safe_name(c: Column, fallback: str = "video", most: int = 120) -> Column:
    """A file name without folders, forbidden characters and reserved device names; the stem is cut to `most`."""
    name = F.substring_index(F.replace(text(c), F.lit("\\"), F.lit("/")), "/", -1)
    name = F.regexp_replace(F.trim(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_")), r"^\.+|\.+$", "")
    name = F.regexp_replace(F.regexp_replace(name, r"\s+", " "), "_{3,}", "__")
    dotted = F.contains(name, F.lit("."))
    stem = F.when(dotted, F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)).otherwise(name)
    ext = F.when(dotted, F.concat(F.lit("."), F.substring_index(name, ".", -1))).otherwise("")
    stem = F.when(F.upper(stem).isin(*L.RESERVED_NAMES), F.concat(F.lit("_"), stem)).otherwise(stem)
    stem = F.trim(F.left(stem, F.lit(most)))
    return F.concat(F.when(stem == "", fallback).otherwise(stem), F.when(ext == ".", "").otherwise(ext))


def safe_stem(c: Column, fallback: str = "video") -> Column:
    return F.regexp_replace(safe_name(c, fallback), r"(?<=.)\.[^.]*$", "")


def timecode(ms: Column) -> Column:
    """HH:MM:SS, fractions cut off."""
    s = F.floor(F.greatest(F.lit(0), ms) / 1000)
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def cue_timecode(ms: Column) -> Column:
    """H:MM:SS.cc."""
    cs = F.round(F.greatest(F.lit(0), ms) / 10).cast("bigint")
    return F.format_string("%d:%02d:%02d.%02d", F.floor(cs / 360_000), F.floor(cs / 6000) % 60, F.floor(cs / 100) % 60, cs % 100)


def clock(ms: Column) -> Column:
    """H:MM:SS from an hour on, else MM:SS."""
    s = F.floor(F.greatest(F.lit(0), ms) / 1000)
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)).otherwise(F.format_string("%02d:%02d", F.floor(s / 60), s % 60))


def file_size(n: Column) -> Column:
    """A size in B, KB, MB or GB."""
    out = F.format_string("%d B", n)
    for k, unit in enumerate(("KB", "MB", "GB"), 1):
        out = F.when(n >= 1024**k, F.format_string(f"%.1f {unit}", n / float(1024**k))).otherwise(out)
    return out


def chars_per_line(width: Column, font: Column, usual: int = 22) -> Column:
    """Characters that fit into 86 % of the width at 0.62 of the font size each, 12 to 42; exact for whole numbers."""
    fits = F.floor(width * 43 / (font * 31))
    return F.when((width <= 0) | (font <= 0), usual).otherwise(F.least(F.lit(42), F.greatest(F.lit(12), fits))).cast("int")


def font_size(size: Column, height: Column) -> Column:
    return F.greatest(F.lit(12), F.bround(size * height / 1920)).cast("int")


def wrap_caption(words: Column, chars: int = 22, lines: int = 2) -> Column:
    """Words in lines of at most chars characters; what is over joins the last line; line breaks as \\N."""
    empty = F.array().cast("array<string>")

    def add(acc: Column, w: Column) -> Column:
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (F.length(last) + 1 + F.length(w) <= chars)
        return F.when((F.size(acc) > 0) & joins, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat_ws(" ", last, w)))).otherwise(F.concat(acc, F.array(w)))

    made = F.aggregate(words, empty, lambda acc, w: F.when(F.size(acc) == 0, F.array(w)).otherwise(add(acc, w)))
    over = F.concat(F.slice(made, 1, lines - 1), F.array(F.array_join(F.slice(made, lines, 1 << 20), " ")))
    return F.array_join(F.when(F.size(made) > lines, over).otherwise(made), "\\N")


def escape_markup(c: Column) -> Column:
    out = F.replace(text(c), F.lit("\\"), F.lit("\\\\"))
    return F.trim(F.replace(F.replace(out, F.lit("{"), F.lit("\\{")), F.lit("}"), F.lit("\\}")))


def cue_line(start_ms: Column, end_ms: Column, c: Column, style: str = "Default") -> Column:
    """One dialogue line of a subtitle file."""
    return F.concat(F.lit("Dialogue: 0,"), cue_timecode(start_ms), F.lit(","), cue_timecode(end_ms), F.lit(f",{style},,0,0,0,,"), c)


def is_landscape(width: Column, height: Column) -> Column:
    return width >= height


def aspect_ratio(width: Column, height: Column) -> Column:
    return F.when(height > 0, width / height).otherwise(0.0)
