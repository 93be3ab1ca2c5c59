"""Merkle manifest of a documents table, with leaf coordinates by bitmap ranks.

Leaves of a language ascend by doc_id, but are never sorted.  A language's ids become a
compressed bitmap: one row for each 64 neighbouring ids of which any occurs, holding
a 64-bit word, merged from all tasks' partial words by bitwise or.  Popcounts of the
words, summed over blocks, blocks of blocks and so on, are the directory.  A leaf's place is its
word's base plus the set bits below its own.  Ids that occur more than once are
counted in the directory; such rows are placed among each other by their digests.

Nodes are keyed by (language, place).  A block of 8**3 places is a small group whose
slots are reduced three levels at a time to one node of the next table, until each language
has one node, its subroot; the subroots, placed by the order of the languages, are reduced
likewise to the root.  The way back down hands every block the siblings above it,
so each leaf gets its proof and folds its digest with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import dealt, meet, prefix_sums, ranked
from .shared import id_crc, small_batches, written

FAN = 8
#: Levels that one pass over a table of nodes reduces, and the places of a block: 8**3.
DEPTH = 3
BITS = 3 * DEPTH
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Where null ids lie: before all others.
_NO_WORD = -(1 << 57) - 1


def framed(value: Column) -> Column:
    """UTF-8 byte count, colon, value; - for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    return F.sha2(F.concat(*[framed(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], framed(text)).cast("binary"), 256)


def bitmap_words(leaves: DataFrame) -> DataFrame:
    """Rows (lk, word, bits, n): the compressed bitmap of each language's ids; n counts rows, repeats included."""
    return leaves.groupBy("lk", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"), F.count(F.lit(1)).alias("n"))


def placed(leaves: DataFrame) -> DataFrame:
    """leaves (lk, word, bit, digest, ...) with `pos`, the place of each among its language's leaves, and `n`, how many these are."""
    words = written(bitmap_words(leaves), "bitmap")
    base = prefix_sums(words, ["lk"], "word", ["n"]).withColumnRenamed("before_n", "base")
    total = words.groupBy("lk").agg(F.sum("n").alias("total"))
    directory = written(dealt(base.select("lk", "word", "bits", "base", (F.col("n") > F.bit_count("bits")).alias("again")), total, ["lk"]), "directory")
    found = dealt(leaves, directory, ["lk", "word"])
    below = F.bit_count(F.col("bits").bitwiseAND(F.expr("~shiftleft(-1L, bit)"))).cast("long")
    if directory.filter("again").isEmpty():
        return found.select(*leaves.columns, F.col("total").alias("n"), (F.col("base") + below).alias("pos"))
    # words whose ids occur more than once: counts of their ids, and of the digests' first bytes within an id
    found = written(found, "found")
    again = found.filter("again").withColumn("slice", F.conv(F.substring("digest", 1, 4), 16, 10).cast("int"))
    slices = written(again.groupBy("lk", "word", "bit", "slice").agg(F.count(F.lit(1)).alias("m")), "repeats")
    ids = slices.groupBy("lk", "word", "bit").agg(F.sum("m").alias("m"))
    first = prefix_sums(ids, ["lk", "word"], "bit", ["m"]).select("lk", "word", "bit", F.col("before_m").alias("first"))
    inner = prefix_sums(slices, ["lk", "word", "bit"], "slice", ["m"]).select("lk", "word", "bit", "slice", F.col("before_m").alias("inner"))
    inner = written(dealt(inner, first, ["lk", "word", "bit"]), "repeats")
    # rows that agree in their digests are alike in all columns, so any order among them will do
    nth = F.row_number().over(Window.partitionBy("lk", "word", "bit", "slice").orderBy("digest", "tampered")) - 1
    again = dealt(again, inner, ["lk", "word", "bit", "slice"]).withColumn("nth", nth)
    some = found.filter("not again").select(*leaves.columns, F.col("total").alias("n"), (F.col("base") + below).alias("pos"))
    return some.unionByName(again.select(*leaves.columns, F.col("total").alias("n"), (F.col("base") + F.col("first") + F.col("inner") + F.col("nth")).alias("pos")))


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _levels(digests: list[str], nodes: int) -> list[list[str]]:
    """The levels of a block, its own nodes first, the last being what it hands on.  nodes: those of the whole tree at the lowest level."""
    levels = [digests]
    for _ in range(DEPTH):
        if nodes <= 1:
            break
        levels.append([_hash("".join(levels[-1][k : k + FAN])) for k in range(0, len(levels[-1]), FAN)])
        nodes = -(-nodes // FAN)
    return levels


def _up(grp: pa.Table) -> pa.Table:
    """One row (lk, pos, n, digest) for a block: its node in the next table."""
    grp = grp.sort_by("pos")
    n = grp["n"][0].as_py()
    top = _levels(grp["digest"].to_pylist(), n)[-1][0]
    for _ in range(DEPTH):
        n = -(-n // FAN)
    return pa.table({"lk": grp["lk"].slice(0, 1).cast(pa.string()), "pos": pa.array([grp["pos"][0].as_py() >> BITS], pa.int64()), "n": pa.array([n], pa.int64()), "digest": [top]})


def _paths(levels: list[list[str]], above: str) -> list[str]:
    """For each node of a block's lowest level its siblings up to the root: `left,right;` for each level, above being the block's own."""
    paths = [above]
    for below in reversed(levels[:-1]):
        made = []
        for k in range(len(below)):
            lo = k - k % FAN
            made.append(f"{''.join(below[lo:k])},{''.join(below[k + 1 : lo + FAN])};{paths[k // FAN]}")
        paths = made
    return paths


def fold(digest: str, path: str) -> str:
    """The root that a digest gives with its siblings."""
    for level in path.split(";")[:-1]:
        left, right = level.split(",")
        digest = _hash(left + digest + right)
    return digest


_PLAIN = str.maketrans("", "", ",;")


def _one(table: pa.Table, column: str) -> str | None:
    return table[column][0].as_py()


def _down(grp: pa.Table, above: pa.Table) -> pa.Table:
    """Rows (lk, block, path): the siblings above each node of a block, for the block of the table below that it stands for."""
    grp = grp.sort_by("pos")
    paths = _paths(_levels(grp["digest"].to_pylist(), grp["n"][0].as_py()), _one(above, "path"))
    return pa.table({"lk": grp["lk"].cast(pa.string()), "block": grp["pos"].cast(pa.int64()), "path": pa.array(paths, pa.string())})


def _proofs(schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(grp: pa.Table, above: pa.Table) -> pa.Table:
        grp = grp.sort_by("pos")
        digests, tampered = grp["digest"].to_pylist(), grp["tampered"].to_pylist()
        paths = _paths(_levels(digests, grp["n"][0].as_py()), _one(above, "path"))
        proofs = [_hash(p.translate(_PLAIN)) for p in paths]
        folded = [fold(t, p) for t, p in zip(tampered, paths, strict=True)]
        return pa.table([grp["doc_id"], grp["digest"], grp["lk"], pa.array(proofs), pa.array(folded)], names=schema.names)

    return run


def _blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("pos", BITS))


def _climb(nodes: DataFrame, most: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """(tables of nodes from the lowest on, rows (lk, digest) of the one node that each tree has at its end)."""
    tables = [nodes]
    while most > 1:
        tables.append(written(_blocks(tables[-1].select("lk", "pos", "n", "digest")).groupBy("lk", "block").applyInArrow(_up, "lk string, pos bigint, n bigint, digest string"), name))
        most = -(-most // FAN**DEPTH)
    return tables, tables[-1].select("lk", "digest")


def _descend(tables: list[DataFrame], paths: DataFrame) -> DataFrame:
    """Rows (lk, block, path) for the blocks of the lowest table; paths has them for the one node of each tree."""
    for nodes in reversed(tables[1:-1] if len(tables) > 1 else []):
        own = _blocks(nodes.select("lk", "pos", "n", "digest"))
        paths = written(own.groupBy("lk", "block").cogroup(paths.groupBy("lk", "block")).applyInArrow(_down, "lk string, block bigint, path string"), "paths")
    return paths


def manifest(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one for each row of docs.

    Null ids come first among a language's leaves, repeated ids follow each other by leaf
    digest (repeated rows in any order: they are alike).  Where 3 divides the crc32 of the id
    (null: of the empty text), the leaf is recomputed from a text whose A-Z are lower-cased, and folded
    with the original siblings.  Null texts stay null.  Other columns aren't
    read.  An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    lk = F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("lang")))
    leaf = docs.select(
        "doc_id", lk.alias("lk"), F.coalesce(F.shiftright(F.col("doc_id").cast("long"), 6), F.lit(_NO_WORD)).alias("word"), F.coalesce(F.col("doc_id").cast("long").bitwiseAND(63), F.lit(0)).cast("int").alias("bit"),
        leaf_digest(F.col("text")).alias("digest"), F.when(id_crc(F.col("doc_id")) % 3 == 0, leaf_digest(F.translate("text", UPPER, LOWER))).alias("tampered"),
    )
    leaf = written(leaf.withColumn("tampered", F.coalesce("tampered", "digest")), "leaves")
    nodes = written(placed(leaf).select("doc_id", "lk", "pos", "n", "digest", "tampered"), "placed")
    most = nodes.agg(F.max("n")).first()[0] or 0
    tables, subroots = _climb(nodes, most, "nodes")
    # the languages' subroots are the leaves of one more tree
    order = written(ranked(subroots, [F.asc("lk")], "subroots").withColumnRenamed("rank", "pos"), "subroots")
    langs = order.count()
    top = order.select(F.lit("").alias("lk"), "pos", F.lit(langs).cast("long").alias("n"), "digest")
    upper, roots = _climb(top, langs, "roots")
    start = roots.select("lk", F.lit(0).cast("long").alias("block"), F.lit("").alias("path"))
    if langs > 1:
        own = _descend([top, *upper[1:]], start)
        own = _blocks(top).groupBy("lk", "block").cogroup(own.groupBy("lk", "block")).applyInArrow(_down, "lk string, block bigint, path string")
        paths = written(order.join(own.select(F.col("block").alias("pos"), "path").hint("merge"), "pos").select("lk", F.lit(0).cast("long").alias("block"), "path"), "paths")
    else:
        paths = order.select("lk", F.lit(0).cast("long").alias("block"), F.lit("").alias("path"))
    paths = _descend(tables, paths)
    kind = nodes.schema["doc_id"].dataType.simpleString()
    schema = pa.schema([("doc_id", nodes.select("doc_id").limit(0).toArrow().schema.field(0).type), ("leaf", pa.string()), ("lk", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string())])
    done = _blocks(nodes).groupBy("lk", "block").cogroup(paths.groupBy("lk", "block")).applyInArrow(_proofs(schema), f"doc_id {kind}, leaf string, lk string, proof_sha256 string, folded_root string")
    root = roots.first()  # one digest
    ends = order.select("lk", F.col("digest").alias("subroot"), F.lit(root["digest"] if root else None).alias("root"))
    done = meet(done, ends, "lk", langs)
    return done.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
