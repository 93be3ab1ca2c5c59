"""Hooks, captions and rendered texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.text import NON_LATIN, clean_hook, ensure_emoji, hook_reason, normalise_hashtags, strip_emoji, text, words_of
from ..sources.shared import written

_ORDER = {name: k for k, (name, _) in enumerate(L.HOOK_CATEGORIES)}
_NAMES = "array(" + ", ".join(f"'{n}'" for n in _ORDER) + ")"


def _usable_items(proposed: DataFrame) -> DataFrame:
    """(clip_id, items): each clip's usable hooks in the order of proposal."""
    rows = proposed.withColumn("text", clean_hook(F.col("text"))).filter(hook_reason(F.col("text")) == "")
    return rows.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.lower(F.trim(text(F.col("category")))).alias("c"), "text", F.lower(strip_emoji(F.col("text"))).alias("key")))).alias("items"))


def _chosen(items: DataFrame, have: str, named: str) -> DataFrame:
    """(clip_id, category, text): items folded over the hooks a clip has; named: which categories an item may name, the first free one stands for others."""
    match = f"coalesce(get(filter({_NAMES}, n -> lower(n) = x.c and {named}), 0), get(filter({_NAMES}, n -> not exists(kept, k -> k.category = n)), 0))"
    fold = f"""aggregate(items, {have}, (kept, x) -> if(exists(kept, k -> k.key = x.key) or {match} is null or exists(kept, k -> k.category = {match}),
      kept, concat(kept, array(struct({match} as category, x.text as text, x.key as key)))))"""
    kept = items.select("clip_id", F.explode(F.expr(fold)).alias("k"))
    return kept.select("clip_id", "k.category", ensure_emoji(F.col("k.text"), F.col("k.category")).alias("text"))


def assemble_hooks(proposed: DataFrame) -> DataFrame:
    """(clip_id, category, text): at most one usable hook a category, in the order of proposal.

    proposed: (clip_id, pos, category, text).  Unusable hooks and repeats of a kept text are dropped.  A category is
    matched without case; an unknown one stands for the first free one.
    """
    return _chosen(_usable_items(proposed), "cast(array() as array<struct<category:string,text:string,key:string>>)", "true")


def missing_hooks(clips: DataFrame, hooks: DataFrame) -> DataFrame:
    """(clip_id, category): categories for which a clip has no hook."""
    names = clips.select("clip_id", F.explode(F.expr(_NAMES)).alias("category"))
    return names.join(hooks.select("clip_id", "category").hint("merge"), ["clip_id", "category"], "left_anti")


def fill_requests(clips: DataFrame, hooks: DataFrame) -> DataFrame:
    """(clip_id, missing, existing): for clips without a full set, the categories that they lack and the hooks that they have, both in print order."""
    place = F.array_position(F.expr(_NAMES), F.col("category"))
    texts = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("place", c))), lambda x: x[c])
    lack = missing_hooks(clips, hooks).withColumn("place", place).groupBy("clip_id").agg(texts("category").alias("missing"))
    have = hooks.withColumn("place", place).groupBy("clip_id").agg(texts("text").alias("existing"))
    return lack.join(have.hint("merge"), "clip_id", "left").select("clip_id", "missing", F.coalesce("existing", F.array().cast("array<string>")).alias("existing"))


def merge_fill(hooks: DataFrame, filled: DataFrame) -> DataFrame:
    """hooks with the answers (clip_id, pos, category, text) to a request for missing ones merged in.

    An answer may name a category that the clip lacks; any other name stands for the first one that
    is still free, so a good hook under a filled category isn't lost.
    """
    old = hooks.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("category", "text", F.lower(strip_emoji(F.col("text"))).alias("key")))).alias("old"))
    items = _usable_items(filled).join(old.hint("merge"), "clip_id", "left").withColumn("old", F.expr("coalesce(old, cast(array() as array<struct<category:string,text:string,key:string>>))"))
    rest = hooks.join(items.select("clip_id").hint("merge"), "clip_id", "left_anti").select("clip_id", "category", "text")
    return _chosen(items, "old", "not exists(old, k -> k.category = n)").unionByName(rest)


def complete_hooks(clips: DataFrame, hooks: DataFrame, ask: Callable[[DataFrame], DataFrame], *, rounds: int = 3) -> DataFrame:
    """hooks (clip_id, category, text) after up to `rounds` follow-up requests for what the clips lack.

    ask takes fill_requests' rows and returns proposals (clip_id, pos, category, text).  A clip that is complete, or got
    nothing from the round before, is not asked for again.  Every round's hooks are written, so that
    an answer is asked for once; the rounds end when no clip is left to ask for.
    """
    hooks, open_ = written(hooks.select("clip_id", "category", "text"), "hooks"), clips.select("clip_id")
    for _ in range(rounds):
        requests = written(fill_requests(open_, hooks.join(open_.hint("merge"), "clip_id", "left_semi")), "fill-requests")
        if requests.isEmpty():
            break
        merged = written(merge_fill(hooks, written(ask(requests), "fill-answers")), "hooks")
        count = lambda h: h.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"))
        grown = count(merged).join(count(hooks).withColumnRenamed("n", "was").hint("merge"), "clip_id", "left").filter("n > coalesce(was, 0)")
        open_ = written(grown.join(requests.select("clip_id").hint("merge"), "clip_id", "left_semi").select("clip_id"), "filled-clips")
        hooks = merged
    return hooks


def repair_ranking(hooks: DataFrame, rankings: DataFrame) -> DataFrame:
    """hooks (clip_id, category, text) with rank: places named by rankings (clip_id, ranking array of 1-based numbers), first mentions first, the others after them in print order."""
    order = F.lit(len(_ORDER))
    for name, k in _ORDER.items():
        order = F.when(F.col("category") == name, k).otherwise(order)
    rows = hooks.withColumn("number", F.row_number().over(Window.partitionBy("clip_id").orderBy(order, "category")))
    named = rankings.select("clip_id", F.posexplode("ranking").alias("pos", "number")).groupBy("clip_id", "number").agg(F.min("pos").alias("pos"))
    rows = rows.join(named.hint("merge"), ["clip_id", "number"], "left")
    rank = F.row_number().over(Window.partitionBy("clip_id").orderBy(F.col("pos").asc_nulls_last(), "number"))
    return rows.withColumn("rank", rank).drop("pos")


def best_hook(best: Column, first: Column) -> Column:
    """The model's best hook if usable, else the first of the set, with a sign."""
    cleaned = clean_hook(best)
    return ensure_emoji(F.when(hook_reason(cleaned) == "", cleaned).otherwise(text(first)), F.lit(""))


def trim_to_words(paragraphs: Column, question: Column, limit: int = 190) -> Column:
    """While the paragraphs hold more than limit less the question's words, the last sentence of the longest goes; it ends where that has only one."""
    budget = F.lit(limit) - F.size(words_of(question))
    split = lambda p: F.split(F.trim(text(p)), r"(?<=[.!?])\s+")

    def step(acc: Column, _: Column) -> Column:
        total = F.aggregate(acc, F.lit(0), lambda a, p: a + p["n"])
        words = F.transform(acc, lambda p: p["n"])
        longest = F.array_position(words, F.array_max(words)).cast("int") - 1
        shorter = F.transform(acc, lambda p, i: F.when(i == longest, F.struct(F.slice(p["c"], F.lit(1), F.size(p["c"]) - 1).alias("c"), (p["n"] - F.element_at(p["c"], -1)).alias("n"))).otherwise(p))
        return F.when((total > budget) & (F.size(F.get(acc, longest)["c"]) > 1), shorter).otherwise(acc)

    # texts are split once; the fold sees only how many words each sentence has
    counts = F.transform(paragraphs, lambda p: F.transform(split(p), lambda s: F.size(words_of(s))))
    state = F.transform(counts, lambda c: F.struct(c.alias("c"), F.aggregate(c, F.lit(0), lambda a, x: a + x).alias("n")))
    most = F.greatest(F.lit(1), F.aggregate(paragraphs, F.lit(0), lambda a, p: a + F.size(split(p))))
    left = F.aggregate(F.sequence(F.lit(1), most), state, step)
    return F.zip_with(paragraphs, left, lambda p, s: F.when(F.size(s["c"]) == F.size(split(p)), p).otherwise(F.array_join(F.slice(split(p), F.lit(1), F.size(s["c"])), " ")))


def assemble_caption(*, headline: Column, paragraphs: Column, question: Column, location: Column, hashtags: Column, limit: int = 190) -> Column:
    """The caption in its fixed layout; null if a part is missing, drifts out of Latin letters, or the question is cut off."""
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(text(c), r"(?i)\bspeakers?\s+[A-Z]\b", "someone"), r"\s+", " "))
    head = F.trim(F.regexp_replace(clean(headline), "^[🚨 ]+|[🚨 ]+$", ""))
    asks = F.trim(F.regexp_replace(clean(question), "^[👇 ]+", ""))
    paras = F.filter(F.transform(paragraphs, clean), lambda p: p != "")
    drift = F.exists(F.concat(F.array(head, asks), paras), lambda p: p.rlike(NON_LATIN))
    ok = (head != "") & (F.size(paras) > 0) & asks.endswith("?") & ~drift
    place = clean(location)
    body = F.array_join(F.transform(trim_to_words(paras, asks, limit), lambda p: F.concat(p, F.lit("\n\n"))), "")
    tags = normalise_hashtags(hashtags)
    layout = F.concat(
        F.lit("🚨 "), head, F.lit(" 🚨\n\n"), body, F.lit("👇 "), asks,
        F.when(place.rlike(r"^[A-Za-z .'-]+,\s*[A-Za-z .]+$"), F.concat(F.lit("\n\n📍 "), place)).otherwise(""), F.when(F.size(tags) > 0, F.concat(F.lit("\n\n"), F.array_join(tags, " "))).otherwise(""),
    )
    return F.when(ok, layout)


def render_hooks(hooks: DataFrame, bests: DataFrame) -> DataFrame:
    """(clip_id, content): best hook, numbered list in print order, ranking (unranked last, then by category)."""
    item = F.struct("number", F.format_string("%d. %s: %s", F.col("number"), F.col("category"), F.col("text")).alias("line"))
    ranked = F.struct(F.when(F.col("rank") > 0, F.col("rank")).otherwise(1 << 30).alias("r"), "category", "text")
    lines = hooks.groupBy("clip_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["line"]).alias("list"), F.transform(F.array_sort(F.collect_list(ranked)), lambda x: x["text"]).alias("order"))
    rank = F.transform("order", lambda t, i: F.format_string("%d. %s", i + 1, t))
    rows = lines.join(bests.hint("merge"), "clip_id")
    return rows.select("clip_id", F.concat(F.lit("🏆 BEST HOOK\n\n"), F.col("best_hook"), F.lit("\n\n---\n\n"), F.array_join("list", "\n"), F.lit("\n\n---\n\n🏆 FINAL RANKING\n\n"), F.array_join(rank, "\n"), F.lit("\n")).alias("content"))


def render_context(*, setting: Column, participants: Column, subject: Column, summary: Column, terms: Column) -> Column:
    """Labelled lines for what is known of a video."""
    line = lambda label, c: F.when(F.trim(text(c)) != "", F.concat(F.lit(f"{label}: "), F.trim(c)))
    return F.concat_ws("\n", line("Setting", setting), line("Participants", participants), line("Subject", subject), line("Summary", summary), line("Key terms", F.array_join(terms, ", ")))


def merge_vocabulary(*lists: Column) -> Column:
    """Terms of all lists, white space around them cut off, blanks dropped, joined by commas."""
    return F.concat_ws(", ", F.filter(F.transform(F.concat(*lists), lambda t: F.trim(text(t), F.lit(" \t\n\x0b\f\r"))), lambda t: t != ""))
