"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of word shingles.  Those with equal sets form one class, which
takes part once.  MinHash bands propose candidates.  A candidate pair's MinHash
values are compared a few at a time; it is dropped as soon as the posterior
probability that its Jaccard similarity reaches the threshold falls below the
tolerance.  The pairs that survive are verified exactly, block by block, with the sets
of the classes that have one.  A pair counts in the first band that its two classes
share, so it is looked at once.  Pairs never become rows: buckets are dealt out in
blocks of bounded size, every pair of blocks is one piece of work, and only counts of
links and spanning edges leave it, so a large group of near copies costs
neither one large task nor a table of all its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, spread_join
from .shared import parts, release, slices_of, small_batches, written
from .words import flat, mix, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
#: MinHash values, how many form a band, and how many bands there are: a pair at the threshold meets in some
#: band but for 1 in 20,000; of pairs at 0.4 one in 4 meets, at 0.3 one in 17.
VALUES, ROWS, BANDS = 128, 5, 25
#: A pair is dropped below this posterior probability of reaching the threshold.
TOLERANCE = 1e-6
#: After so many MinHash values the posterior is looked at.
STEPS = (16, 32, 64, 128)
#: Most members of a block.
BLOCK = 256


def shingles(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of `size` consecutive words; a shorter text is one shingle, an empty one has none."""
    if not len(hashes):
        return hashes
    n = max(1, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(size, len(hashes))):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n])
    return np.unique(out)


def _permutations(values: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_229)
    return rng.integers(0, 1 << 32, values, np.uint32), rng.integers(0, 1 << 32, values, np.uint32) | np.uint32(1)


def signature(shingle: np.ndarray, values: int = VALUES) -> np.ndarray:
    """The least of each permuted hash over the set."""
    flip, factor = _PERM if values == VALUES else _permutations(values)
    x = (shingle >> np.uint64(32)).astype(np.uint32) ^ shingle.astype(np.uint32)
    out = np.full(values, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 512):
        h = (x[lo : lo + 512, None] ^ flip) * factor
        h ^= h >> np.uint32(15)
        np.minimum(out, h.min(0), out=out)
    return out


_PERM = _permutations(VALUES)


def least_matches(threshold: float, tolerance: float, steps: tuple[int, ...] = STEPS) -> dict[int, int]:
    """After n values, the fewest matches that keep a pair: with a uniform prior the posterior is Beta(m + 1, n - m + 1)."""
    out = {}
    x = (np.arange(200_000) + 0.5) / 200_000
    for n in steps:
        for m in range(n + 1):
            log = m * np.log(x) + (n - m) * np.log1p(-x)
            p = np.exp(log - log.max())
            if p[x >= threshold].sum() / p.sum() >= tolerance:
                out[n] = m
                break
    return out


def surviving(sig: np.ndarray, i: np.ndarray, j: np.ndarray, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) of rows of sig that no step drops."""
    keep_i, keep_j = [], []
    for lo in range(0, len(i), 100_000):
        a, b = i[lo : lo + 100_000], j[lo : lo + 100_000]
        same, at = np.zeros(len(a), np.int32), 0
        for n, m in least.items():
            same = same + (sig[a, at:n] == sig[b, at:n]).sum(1, dtype=np.int32)
            ok = same >= m
            a, b, same, at = a[ok], b[ok], same[ok], n
        keep_i.append(a)
        keep_j.append(b)
    return np.concatenate(keep_i) if keep_i else i, np.concatenate(keep_j) if keep_j else j


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row of each row's component."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label


def _pairs(size: int, side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a block, or of a member of one block (side 0) with one of another (side 1)."""
    if side is None:
        return np.triu_indices(size, 1)
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    return np.repeat(a, len(b)), np.tile(b, len(a))


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of whole groups from batches that are sorted by their first columns; a group may span batches."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        # the last group of a batch may go on in the next one
        change = np.zeros(len(b) - 1, bool)
        for k in range(keys):
            c = b.column(k).to_numpy(zero_copy_only=False)
            change |= c[1:] != c[:-1]
        cut = np.flatnonzero(change)
        last = int(cut[-1]) + 1 if len(cut) else 0
        goes_on = bool(held) and all(held[-1].column(k)[len(held[-1]) - 1] == b.column(k)[0] for k in range(keys))
        if held and not goes_on:
            yield pa.Table.from_batches(held)
            held = []
        if last:
            yield pa.Table.from_batches([*held, b.slice(0, last)])
            held = []
        held.append(b.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _bounds(table: pa.Table, keys: int) -> np.ndarray:
    change = np.ones(table.num_rows + 1, bool)
    change[1:-1] = False
    for k in range(keys):
        c = table.column(k).to_numpy()
        change[1:-1] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def _dealt(rows: DataFrame, group: str, size: str, key: str) -> DataFrame:
    """rows with columns grp, a, b, side: every pair of blocks of a group gets the rows of both."""
    blocks = F.ceil(F.col(size) / BLOCK).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select(
        F.col(group).alias("grp"), F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"),
        F.when(F.col("mine") > F.col("other"), 1).otherwise(0).alias("side"), *[c for c in rows.columns if c not in (group, "mine", "other", size)],
    )


def _sorted_by_group(rows: DataFrame) -> DataFrame:
    return rows.repartition(parts(rows.sparkSession), "grp", "a", "b").sortWithinPartitions("grp", "a", "b")


def _sets(docs: DataFrame) -> DataFrame:
    """Rows (uid, doc_id, text_hash, digest, n, sig) of docs."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in (x for y in batches for x in slices_of(y, "text")):
            h, w = word_hashes(*flat(b.column("text")))
            sets = [shingles(h[w[k] : w[k + 1]]) for k in range(len(b))]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array([signature(s).tobytes() for s in sets], pa.binary())],
                ["uid", "doc_id", "text_hash", "digest", "n", "sig"],
            )

    small_batches(docs.sparkSession)
    return rows.mapInArrow(run, f"uid bigint, doc_id {kind}, text_hash bigint, digest binary, n int, sig binary")


def band_keys(sig: np.ndarray) -> np.ndarray:
    """The bucket of each band of each signature."""
    part = sig[:, : BANDS * ROWS].reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), part.shape[:2])
    for k in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + part[:, :, k])
    return h


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, VALUES)


def _bands(classes: DataFrame) -> DataFrame:
    """Rows (bucket, cid): a bucket for each band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield pa.RecordBatch.from_arrays([pa.array(band_keys(_signatures(b.column("sig"))).reshape(-1).view(np.int64)), pa.array(np.repeat(b.column("cid").to_numpy(), BANDS))], ["bucket", "cid"])

    return classes.filter("n > 0").select("cid", "sig").mapInArrow(run, "bucket bigint, cid bigint")


def _first_shared(keys: np.ndarray, band: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that meet in no band before this one."""
    for k in range(band):
        other = keys[i, k] != keys[j, k]
        i, j = i[other], j[other]
    return i, j


def _survivors(bucket: int, sig: np.ndarray, side: np.ndarray | None, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a block's members that meet in this bucket first and that the pruning leaves."""
    keys = band_keys(sig)
    band = int(np.flatnonzero(keys[0].view(np.int64) == bucket)[0])
    return surviving(sig, *_first_shared(keys, band, *_pairs(len(sig), side)), least)


def _propose(dealt: DataFrame, least: dict[int, int]) -> DataFrame:
    """Rows (grp, a, b, side, cid) for the members of each block that have a surviving pair in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, 3):
            at = _bounds(t, 3)
            grp, a, b, side = (t.column(c).to_numpy() for c in ("grp", "a", "b", "side"))
            sig = _signatures(t.column("sig"))
            need = []
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                i, j = _survivors(grp[lo], sig[lo:hi], side[lo:hi] if a[lo] != b[lo] else None, least)
                need.append(lo + np.unique(np.concatenate([i, j])))
            k = np.concatenate(need) if need else np.empty(0, np.int64)
            if len(k):
                yield t.select(["grp", "a", "b", "side", "cid"]).take(pa.array(k)).combine_chunks().to_batches()[0]

    return _sorted_by_group(dealt).mapInArrow(run, "grp bigint, a int, b int, side int, cid bigint")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    n = len(sets)
    value = np.concatenate(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(value, kind="stable")
    value, row = value[order], row[order]
    first = np.ones(len(value), bool)
    first[1:] = value[1:] != value[:-1]
    column = np.cumsum(first) - 1
    often = np.bincount(column)[column] > 1
    row, column = row[often], column[often]
    out = np.zeros((n, n), np.float32)
    if len(column):
        column = np.cumsum(np.r_[0, column[1:] != column[:-1]])
        for lo in range(0, int(column[-1]) + 1, 8192):
            s, e = np.searchsorted(column, (lo, lo + 8192))
            dense = np.zeros((n, min(8192, int(column[-1]) + 1 - lo)), np.float32)
            dense[row[s:e], column[s:e] - lo] = 1
            out += dense @ dense.T
    return out


def _verify(needed: DataFrame, least: dict[int, int], threshold: float) -> DataFrame:
    """Rows (cid, root, texts, docs) for classes with links in a block: how many other classes, and documents of them, reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, 3):
            at = _bounds(t, 3)
            grp, a, b, side, all_cid, copies = (t.column(c).to_numpy() for c in ("grp", "a", "b", "side", "cid", "copies"))
            sig, data = _signatures(t.column("sig")), t.column("set").to_pylist()
            out: list[np.ndarray] = []
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                i, j = _survivors(grp[lo], sig[lo:hi], side[lo:hi] if a[lo] != b[lo] else None, least)
                sets = [np.frombuffer(x, np.uint64) for x in data[lo:hi]]
                size = np.array([len(x) for x in sets])
                both = overlaps(sets)[i, j]
                link = both / (size[i] + size[j] - both) >= threshold
                i, j = i[link], j[link]
                cid, n = all_cid[lo:hi], copies[lo:hi]
                texts = np.bincount(np.concatenate([i, j]), minlength=len(cid))
                docs = np.bincount(np.concatenate([i, j]), np.concatenate([n[j], n[i]]), len(cid)).astype(np.int64)
                k = np.flatnonzero(texts)
                out.append(np.stack([cid[k], cid[roots(len(cid), i, j)[k]], texts[k], docs[k]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in np.concatenate(out, 1)], ["cid", "root", "texts", "docs"])

    return _sorted_by_group(needed).mapInArrow(run, "cid bigint, root bigint, texts bigint, docs bigint")


def near_join(docs: DataFrame, *, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """Rows (doc_id, text_hash, class_id, n_links, n_texts, kept), one for each row of docs.

    n_links: other documents with a Jaccard similarity of at least the threshold,
    copies included; n_texts: differing shingle sets among them.  class_id: the
    smallest doc_id that links lead to (null ids count as largest); its row is kept, of
    repeated rows the first.  Words end at white space, A-Z count as a-z.
    A text of under five words is one shingle.  Null and empty texts have no shingle: they
    equal each other, but link to nothing else.  text_hash is xxhash64(text).
    Further columns are not read; an empty table gives an empty result.
    """
    sets = written(_sets(docs), "sets")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("uid").alias("uid"), F.col("text_hash").alias("hash")))
    classes = written(
        sets.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"))
        .withColumn("cid", F.col("first.uid")), "classes",
    )
    least = least_matches(threshold, tolerance)
    # buckets with company; every pair of their blocks compares signatures
    bands = _bands(classes)
    buckets = written(bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "buckets")
    members = spread_join(bands, buckets, "bucket").join(classes.select("cid", "sig").hint("merge"), "cid")
    needed = written(_propose(_dealt(members, "bucket", "size", "cid"), least), "needed")
    # the sets of the classes that some pair needs, from the text of each class's first row
    wanted = needed.select("cid").distinct().join(classes.select("cid", "digest", "copies", "sig", F.col("first.id").alias("id"), F.col("first.hash").alias("hash")).hint("merge"), "cid")
    wanted = written(wanted, "wanted")
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("hash"), key("doc_id").alias("key"))
    texts = texts.join(wanted.select("cid", "digest", "hash", key("id").alias("key")).hint("merge"), ["hash", "key"]).select("cid", "digest", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for y in batches for x in slices_of(y, "text")):
            h, w = word_hashes(*flat(b.column("text")))
            data = [shingles(h[w[k] : w[k + 1]]).tobytes() for k in range(len(b))]
            ok = pa.array([hashlib.blake2b(d, digest_size=16).digest() == x for d, x in zip(data, b.column("digest").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("cid"), pa.array(data, pa.binary())], ["cid", "set"]).filter(ok)

    own = texts.mapInArrow(run, "cid bigint, set binary").groupBy("cid").agg(F.first("set").alias("set"))  # repeated rows give the same set
    own = written(own.join(wanted.select("cid", "copies", "sig").hint("merge"), "cid"), "wanted-sets")
    blocks = needed.join(own.hint("merge"), "cid").select("grp", "a", "b", "side", "cid", "copies", "sig", "set")
    links = written(_verify(blocks, least, threshold), "links")
    root = components(links.select(F.col("cid").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("cid"), "root")
    count = links.groupBy("cid").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    linked = written(root.join(count.hint("merge"), "cid"), "linked")
    known = classes.drop("sig", "n").join(linked.hint("merge"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    known = written(known, "known")
    heads = known.groupBy("root").agg(F.min("first").alias("head"))
    known = spread_join(known, heads, "root").select(
        "digest", F.col("head.id").alias("class_id"), F.col("head.uid").alias("head"),
        (F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("texts", F.lit(0)).cast("long").alias("n_texts"),
    )
    known = written(known, "classes-linked")
    return sets.drop("sig").join(known.hint("merge"), "digest").select(
        "doc_id", "text_hash", "class_id", F.when(F.col("n") > 0, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"), "n_texts", (F.col("uid") == F.col("head")).alias("kept")
    )


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """The documents that near_join keeps, one of each group, with all their columns.

    Where a kept id and text stand in several rows, the first by the other columns stays.
    """
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    kept = near_join(docs, **params).filter("kept").select(F.col("text_hash").alias("hash"), key("doc_id").alias("key"))
    mine = docs.select(F.xxhash64("text").alias("hash"), key("doc_id").alias("key"), F.concat_ws("\0", *[F.col(c).cast("string") for c in docs.columns if c != "text"]).alias("tie"), F.struct("*").alias("d"))
    # the join and the choice have the same keys, so that texts are dealt out once
    found = mine.join(kept.hint("merge"), ["hash", "key"]).groupBy("hash", "key").agg(F.min_by("d", "tie").alias("d"))
    return found.select("d.*")
