"""Exact deduplication by a tree-merge of sorted digest runs.

Every document becomes a row (digest, length, ids).  The rows are dealt into
`fan_in ** rounds` runs, each sorted by digest.  In every round `fan_in` sibling runs
exchange and merge.  As in a butterfly network, a merged run is held in `fan_in` times as many
slices of the digests as before, so a round moves rows between siblings only and no cell
(run and slice) grows: at the root every cell holds one slice of all digests.  Cells are
sorted by digest, and one pass over neighbours keeps the smallest verified identifier and
the summed count of each digest, verified by a second hash of the text.  A cell has at
most `fan_in` rows of a digest to merge, however many copies a text has, so a hot
text never lands in one task.  The root's answers go back down the same tree,
again at most `fan_in` rows for each key, until every row knows its keeper.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, parts, written

FAN_IN = 16
#: Parts that a cell's digests are dealt into, so that tasks are even.
SPLIT = 64
KEY = ["cell", "part", "sha", "chk"]


def normalised(text: Column) -> Column:
    """The text without the characters of [\\x20\\x09-\\x0D]; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    for c in SPACE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _order() -> Column:
    """Keeper order: longest original text, then smallest id (null ids last), then first row."""
    return F.struct((-F.col("len")).alias("neg"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("uid").alias("uid"))


def _cell(run: Column, level: int, fan_in: int) -> Column:
    """Where a digest of a leaf run lies after `level` rounds: the merged run, and its slice of the digests."""
    wide = fan_in**level
    return F.floor(run / wide) * wide + F.pmod("chk", F.lit(wide))


def _sorted(table: DataFrame) -> DataFrame:
    """table with every cell as sorted runs: dealt out by cell and part, sorted by digest."""
    return table.repartition("cell", "part").sortWithinPartitions(*KEY)


def _merged(table: DataFrame, best: Column, n: Column) -> DataFrame:
    """One pass over sorted cells: equal neighbours become one row.  The grouping's order is that of the runs, so nothing is sorted or dealt out again."""
    return _sorted(table).groupBy(*KEY).agg(F.min("run").alias("run"), best.alias("best"), n.alias("n"))


def _decided(docs: DataFrame, fan_in: int, runs: int | None) -> DataFrame:
    """Rows (doc_id, text_hash, keep_id, group_size, kept, sha), one for each row of docs; text_hash is xxhash64(text)."""
    want = runs or max(fan_in, parts(docs.sparkSession))
    rounds = 1
    while fan_in**rounds < want:
        rounds += 1
    leaf = docs.select(
        "doc_id", F.length(F.coalesce("text", F.lit(""))).alias("len"), F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("uid"), normalised(F.col("text")).alias("bare"),
    ).select("doc_id", "len", "text_hash", "uid", F.unhex(F.sha2("bare", 256)).alias("sha"), F.xxhash64("bare").alias("chk"))
    leaf = leaf.withColumn("run", F.pmod(F.xxhash64("uid"), F.lit(fan_in**rounds))).withColumn("part", F.pmod(F.shiftright("chk", 40), F.lit(SPLIT)))
    leaf = written(leaf, "digests")
    rows = leaf.withColumn("cell", _cell(F.col("run"), 0, fan_in))
    levels = [written(_merged(rows, F.min(_order()), F.count(F.lit(1))), "runs")]
    for level in range(1, rounds + 1):
        merged = _merged(levels[-1].withColumn("cell", _cell(F.col("run"), level, fan_in)), F.min("best"), F.sum("n"))
        levels.append(written(merged, "runs") if level < rounds else merged)
    # the way down: a cell's digests take the answer of the cell they merged into
    answer = levels[-1].select(*KEY, F.col("best.id").alias("keep_id"), F.col("best.uid").alias("keep_uid"), F.col("n").alias("group_size"))
    for level in range(rounds, 0, -1):
        child = levels[level - 1].select(F.col("cell").alias("own"), _cell(F.col("run"), level, fan_in).alias("cell"), "part", "sha", "chk")
        answer = child.join(answer.hint("merge"), KEY).drop("cell").withColumnRenamed("own", "cell")
    return rows.join(answer.hint("merge"), KEY).select("doc_id", "text_hash", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), "sha")


def exact_dedup(docs: DataFrame, *, fan_in: int = FAN_IN, runs: int | None = None) -> DataFrame:
    """Rows (doc_id, keep_id, group_size, kept, text_sha256), one for each row of docs.

    Texts are equal when they are identical without white space.  Of equal texts
    the row with the most code points in its original text stays, then the one
    with the smallest doc_id (null ids last), then the first of repeated rows.
    Null texts count as empty; empty texts form a group like any other.  Only doc_id
    and text are read, so further columns don't matter.  An empty table gives
    an empty result.
    """
    return _decided(docs, fan_in, runs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def keep_first(docs: DataFrame, *, fan_in: int = FAN_IN, runs: int | None = None) -> DataFrame:
    """The documents that exact_dedup keeps, with all their columns.

    Rows that repeat a kept (doc_id, text) count once: the first by the other columns stays.  Whole
    rows are dealt out once, by id and a hash of the text as it is.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("\0")).alias("key")
    kept = _decided(docs, fan_in, runs).filter("kept").select("text_hash", key)
    mine = docs.select(F.xxhash64("text").alias("text_hash"), key, F.concat_ws("\0", *[F.col(c).cast("string") for c in docs.columns if c != "text"]).alias("tie"), F.struct("*").alias("d"))
    # the join and the choice have the same keys
    return mine.join(kept.hint("merge"), ["text_hash", "key"]).groupBy("text_hash", "key").agg(F.min_by("d", "tie").alias("d")).select("d.*")
