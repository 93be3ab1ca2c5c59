"""Best-fit packing of documents into sequences, with Martello-Toth dominance reduction.

Lengths are whole numbers up to the capacity, so the instance is a histogram with
at most `capacity` rows, however many documents there are; only that histogram
reaches the driver.  The reduction fixes sets that provably dominate all others with
the same document (alone, exact pairs, pairs where no third fits or where no two
others use more).  Best-fit decreasing packs the remainder.  The plan is a list of
runs: the documents of one length with ranks lo..hi go to consecutive sequences.
Ranks come from Spark: salted counts, prefix sums, row numbers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import parts, small_batches, written
from .tokens import encoder, slices

CAPACITY = 4096


def dominated_sets(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Fix dominating sets, largest documents first: [(lengths of a set, how often)]; counts (by length) is reduced in place."""
    cap, fixed = len(counts) - 1, []

    def smallest(k: int, without: int) -> list[int]:
        out: list[int] = []
        for s in np.flatnonzero(counts[:] > 0):
            out += [int(s)] * min(k - len(out), int(counts[s]) - (s == without))
            if len(out) >= k:
                break
        return out

    def fix(lengths: tuple[int, ...], times: int) -> None:
        for s in lengths:
            counts[s] -= times
        fixed.append((lengths, times))

    for j in range(cap, 0, -1):
        while counts[j] > 0:
            low = smallest(3, j)
            if not low or j + low[0] > cap:
                fix((j,), int(counts[j]))
                break
            fits = counts[: cap - j + 1] > 0
            if cap - j >= j and counts[j] < 2:
                fits[j] = False
            best = int(np.flatnonzero(fits)[-1])
            times = int(counts[j] // 2 if best == j else min(counts[j], counts[best]))
            if j + best == cap or len(low) < 2 or j + low[0] + low[1] > cap:
                fix((j, best), times)
            elif (len(low) < 3 or j + sum(low) > cap) and best >= _best_pair(counts, j, cap - j):
                fix((j, best), times)
            else:
                break
    return fixed


def _best_pair(counts: np.ndarray, j: int, room: int) -> int:
    """The largest sum of two documents besides one of length j that fits into room."""
    have = counts.copy()
    have[j] -= 1
    sizes = np.flatnonzero(have > 0)
    lo, hi, best = 0, len(sizes) - 1, 0
    while lo <= hi:
        if sizes[lo] + sizes[hi] > room or (lo == hi and have[sizes[lo]] < 2):
            hi -= 1
        else:
            best = max(best, int(sizes[lo] + sizes[hi]))
            lo += 1
    return best


def plan(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """(runs, number of sequences) for counts[length]; a run: length, first rank, end rank, first sequence, documents a sequence, offset."""
    cap = len(counts) - 1
    counts = counts.copy()
    used = np.zeros(cap + 1, np.int64)
    runs: list[tuple[int, ...]] = []
    made = 0

    def put(s: int, n: int, seq: int, per: int, offset: int) -> None:
        runs.append((s, used[s], used[s] + n, seq, per, offset))
        used[s] += n

    for lengths, times in dominated_sets(counts):
        if len(lengths) == 2 and lengths[0] == lengths[1]:
            put(lengths[0], 2 * times, made, 2, 0)
        else:
            at = 0
            for s in lengths:
                put(s, times, made, 1, at)
                at += s
        made += times
    room: list[list[tuple[int, int]]] = [[] for _ in range(cap + 1)]  # by free tokens: (first sequence, how many)
    open_ = np.zeros(cap + 1, bool)
    for s in range(cap, 0, -1):
        left = int(counts[s])
        while left:
            free = np.flatnonzero(open_[s:])
            if len(free):
                r = int(free[0]) + s
                seq, bins = room[r].pop()
                open_[r] = bool(room[r])
            else:
                r, seq, bins = cap, made, -(-left // (cap // s))
                made += bins
            per = r // s
            full, rest = (bins, 0) if left >= bins * per else divmod(left, per)
            put(s, min(left, bins * per), seq, per, cap - r)
            left -= min(left, bins * per)
            for first, n, free_now in ((seq, full, r - per * s), (seq + full, 1 if rest else 0, r - rest * s), (seq + full + (rest > 0), bins - full - (rest > 0), r)):
                if n and free_now:
                    room[free_now].append((first, n))
                    open_[free_now] = True
    return np.array(runs, np.int64).reshape(-1, 6), made


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): each document's ids and end_id, cut only where longer than capacity."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in slices(texts):
                take, rows = [], []
                for k, x in enumerate(enc.ids(texts[lo:hi]), lo):
                    x += end
                    for piece, at in enumerate(range(0, len(x), 4 * capacity)):
                        y = x[at : at + 4 * capacity]
                        take.append(k)
                        rows.append((piece, at // 4, len(y) // 4, zlib.crc32(y)))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(take)), pa.array(cols[0], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[1:]]],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset.

    pieces needs doc_id, piece, start, length (1 to capacity) and ids_crc32.  Equal
    lengths are interchangeable, so ties and repeated rows each get a place
    of their own.  An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    pieces = written(pieces, "pieces").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts(spark))))
    by = written(pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for r in by.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[r["length"]] = r["n"]
    runs, _ = plan(counts)
    order = np.lexsort((runs[:, 1], runs[:, 0]))
    runs = spark.sparkContext.broadcast(runs[order])  # bounded by the capacity, not by the documents
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = by.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))).drop("n")
    place = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (
        pieces.withColumn("nth", F.row_number().over(place) - 1)
        .join(base.hint("merge"), ["length", "salt"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = runs.value
        key = (table[:, 0] << 44) + table[:, 1]
        for b in batches:
            s, r = b.column("length").to_numpy(), b.column("rank").to_numpy()
            t = table[np.searchsorted(key, (s << 44) + r, "right") - 1]
            nth = r - t[:, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(t[:, 3] + nth // t[:, 4]), pa.array(t[:, 5] + nth % t[:, 4] * s)], [*b.schema.names[:5], "sequence_id", "offset"])

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
