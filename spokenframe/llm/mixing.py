"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks.

Every source gets a target: its weight's share of the mix, at most `most` times
its own size, the excess shared again among the others.  The mix is cut into blocks of
`block` words.  Blocks go to the sources by highest quotients target / (2k + 1), and
each source's blocks to its shards likewise by the shards' sizes, so that a shard has a
whole number of blocks to give.  A shard's documents follow each other in a seeded
order; its text is cut into blocks; a seeded phase chooses which of them are taken once
more than the others, evenly spread.  How many blocks were chosen before a place has a
closed form, so blocks never become rows.  What blocks leave over or short of a source's
target (less than a block a shard) is taken from, or added to, the first documents in
the seeded order, never beyond `most` times a document.

Sources and shards may be many: ranks, quotients and sums over them are tables of Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import meet, prefix_sums, ranked
from .shared import written

#: Words of a block.
BLOCK = 1024
#: Words and rows that a shard holds on average, at most.
SHARD_WORDS, SHARD_ROWS = 1 << 18, 1 << 11
SEED = "mix"


def word_count(text: Column) -> Column:
    """Runs of characters other than [\\x20\\x09-\\x0D]; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def seeded(*parts: Column) -> Column:
    """60 bits of the md5 of the parts, joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary")), 1, 15), 16, 10).cast("long")


def apportion(items: DataFrame, name: str) -> DataFrame:
    """Seats by Sainte-Lague: items (grp, item, weight, seats) with `won`; seats is the number of a group's seats, repeated on its items.

    The seats of a group go to its highest quotients weight / (2k + 1), ties to the smaller item.
    Seats won lie within share * items / 2 + 1/2 of the exact share, so only the quotients in that
    range become rows (about five for each item); those below are won for certain.
    Items of weight 0 win nothing.
    """
    items = items.filter("weight > 0")
    totals = items.groupBy("grp").agg(F.sum("weight").alias("_all"), F.count(F.lit(1)).alias("_n"))
    rows = items.join(totals.hint("merge"), "grp").withColumn("_near", F.ceil(F.col("weight") / F.col("_all") * F.col("_n") / 2) + 2)
    exact = F.floor(F.col("weight") / F.col("_all") * F.col("seats"))
    rows = written(rows.select("grp", "item", "weight", "seats", F.greatest(F.lit(0), exact - F.col("_near")).cast("long").alias("sure"), (exact + F.col("_near")).cast("long").alias("top")), name)
    quotients = rows.select("grp", "item", F.explode(F.sequence("sure", "top")).alias("k"), "weight").select("grp", "item", (F.col("weight") / (2 * F.col("k") + 1)).alias("quotient"))
    order = ranked(quotients, [F.asc("grp"), F.desc("quotient"), F.asc("item")], name)
    open_ = rows.groupBy("grp").agg((F.max("seats") - F.sum("sure")).alias("left"), F.sum(F.col("top") - F.col("sure") + 1).alias("n"))
    first = order.groupBy("grp").agg(F.min("rank").alias("first"))
    won = order.join(first.join(open_.hint("merge"), "grp").hint("merge"), "grp").filter(F.col("rank") - F.col("first") < F.col("left"))
    won = won.groupBy("grp", "item").agg(F.count(F.lit(1)).alias("more"))
    return rows.join(won.hint("merge"), ["grp", "item"], "left").select("grp", "item", (F.col("sure") + F.coalesce("more", F.lit(0))).alias("won"))


def targets(sources: DataFrame, budget: float, most: float) -> DataFrame:
    """sources (source_size, weight, ...) with `target`.

    A level rises until the sources' weight * level, each at most `most` times its size,
    add up to the budget: every round shares what capped sources leave among the others.
    """
    wish, cap = lambda level: F.col("weight") * level, F.col("source_size") * most
    level, capped = 0.0, -1
    while True:
        over = wish(level) > cap
        n, used, weight = sources.agg(F.sum(over.cast("int")), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        if n is None or n == capped or not weight:
            break
        level, capped = (budget - (used or 0.0)) / weight, n
    return sources.withColumn("target", F.when(wish(level) > cap, cap).otherwise(wish(level)))


def mix(docs: DataFrame, *, share: float = 1.5, weights: tuple[float, ...] = (3, 1, 2), most: int = 2, block: int = BLOCK, seed: str = SEED, shard_words: int = SHARD_WORDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken), one for each row of docs.

    Sources in code point order, the null source last, have the weights in turn; together they
    share `share` times all words.  taken counts the words that the mix takes of a document,
    repeats included, at most `most` times its size; those of a source add up to its target, rounded
    to a whole word.  Null texts count as empty and are never taken.  Null ids, repeated rows
    and ties are rows like any other; rows that agree in all of source, id and text are
    interchangeable.  Other columns aren't read.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    key = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source")))
    rows = written(docs.select("doc_id", key.alias("sk"), word_count(F.col("text")).alias("size"), seeded(F.lit(seed), F.col("doc_id"), F.col("text")).alias("h")), "sizes")
    sums = rows.groupBy("sk").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    turn = F.col("rank") % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    sources = written(ranked(sums, [(F.col("sk") == "").asc(), F.asc("sk")], "sources").withColumn("weight", weight), "sources")
    n_sources, total = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    budget = share * total
    sources = written(targets(sources, budget, most).withColumn("grp", F.lit("")), "targets")
    blocks = int(budget / block + 0.5)
    seats = apportion(sources.select("grp", F.col("sk").alias("item"), F.col("target").alias("weight"), F.lit(blocks).cast("long").alias("seats")), "source-blocks")
    split = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words), F.ceil(F.col("n_rows") / shard_rows)).cast("long")
    sources = written(sources.join(seats.select(F.col("item").alias("sk"), F.col("won").alias("blocks")).hint("merge"), "sk", "left").select("sk", "source_size", "target", F.coalesce("blocks", F.lit(0)).alias("blocks"), split.alias("n_shards")), "source-blocks")

    rows = meet(rows, sources.select("sk", "n_shards"), "sk", n_sources).select("doc_id", "sk", "size", "h", F.pmod("h", "n_shards").alias("shard"))
    shards = written(rows.groupBy("sk", "shard").agg(F.sum("size").alias("words")), "shards")
    shards = meet(shards, sources.select("sk", "blocks"), "sk", n_sources)
    won = apportion(shards.select(F.col("sk").alias("grp"), F.col("shard").alias("item"), F.col("words").cast("double").alias("weight"), F.col("blocks").alias("seats")), "shard-blocks")
    own = shards.join(won.select(F.col("grp").alias("sk"), F.col("item").alias("shard"), "won").hint("merge"), ["sk", "shard"], "left")
    n = F.greatest(F.lit(1), F.ceil(F.col("words") / block)).cast("long")
    own = own.select("sk", "shard", n.alias("n"), F.least(F.coalesce("won", F.lit(0)), most * n).alias("quota"), F.pmod(seeded(F.lit(seed), F.col("sk"), F.col("shard")), n).alias("phase"))
    own = written(own.select("sk", "shard", "n", F.expr("quota div n").alias("each"), (F.col("quota") % F.col("n")).alias("extra"), "phase"), "quotas")

    def once_more(k: Column) -> Column:
        """How many of a shard's first k blocks are taken once more than the others."""
        return F.floor((k * F.col("extra") + F.col("phase")) / F.col("n"))

    def taken_before(at: Column) -> Column:
        """Words taken of a shard's first `at` words."""
        k = F.floor(at / block)
        return F.col("each") * at + once_more(k) * block + (once_more(k + 1) - once_more(k)) * (at % block)

    order = Window.partitionBy("sk", "shard").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = rows.withColumn("start", F.coalesce(F.sum("size").over(order), F.lit(0).cast("long"))).join(own.hint("merge"), ["sk", "shard"])
    at = written(at.select("doc_id", "sk", "shard", "h", "size", (taken_before(F.col("start") + F.col("size")) - taken_before(F.col("start"))).cast("long").alias("taken")), "taken")

    # what blocks leave over (negative) or short, a whole number of words for each source
    short = at.groupBy("sk").agg(F.sum("taken").alias("got")).join(sources.hint("merge"), "sk").select("sk", "source_size", "target", (F.floor(F.col("target") + 0.5) - F.col("got")).alias("short"))
    short = written(short, "short")
    room = F.when(F.col("short") > 0, most * F.col("size") - F.col("taken")).otherwise(F.col("taken")).alias("room")
    at = meet(at, short, "sk", n_sources).select("*", room)
    base = prefix_sums(at.groupBy("sk", "shard").agg(F.sum("room").alias("room")), ["sk"], "shard", ["room"]).select("sk", "shard", F.col("before_room").alias("base"))
    before = F.coalesce(F.sum("room").over(order), F.lit(0).cast("long")) + F.col("base")
    placed = at.join(written(base, "room").hint("merge"), ["sk", "shard"]).withColumn("before", before)
    moved = F.greatest(F.lit(0), F.least("room", F.abs("short") - F.col("before"))) * F.signum("short").cast("long")
    return placed.select("doc_id", "size", "source_size", "target", (F.col("taken") + moved).cast("long").alias("taken"))
