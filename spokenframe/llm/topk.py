"""Exact top-k inner products with an impact-ordered index, scored segment by segment.

Vectors are whole numbers.  A block of vectors is stored as postings (row, value)
in segments of one dimension and one quantised impact.  A query weighs a segment by its own
component there: it takes the segments of a block by descending weight times impact and adds
weight times value to the rows they hold.  Queries of a block advance together, turn by turn,
each through its own segments.  What a row may still get is at most the smaller of two
bounds: the sum over dimensions of weight times the highest impact not yet read, and the product of the
norms of what is unread of the query and of the row.  Reading stops only when the bounds
prove that few rows can still reach the best k; those are rescored exactly.

Every index block is shuffled once; the queries, a small stated set, are copied to the
blocks and stream by there in blocks of their own, and no pair becomes a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import parts, written

LEVELS = 4
BLOCK = 4096
QUERY_BLOCK = 512
#: Share of a block's rows that may be left for exact scoring.
LEFT = 0.02
#: The bounds are looked at when such shares of a query's postings are read.
TURNS = (0.5, 0.65, 0.75, 0.82, 0.9, 1.0)


def _matrix(column: pa.ChunkedArray, scale: int) -> np.ndarray:
    rows = [np.floor(scale * np.asarray(v, np.float64)) for v in column.to_pylist()]
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def index_block(x: np.ndarray, levels: int = LEVELS) -> dict[str, bytes | int]:
    """Postings by dimension and descending level, where each segment ends, and the highest magnitude in it."""
    n, d = x.shape
    top = np.abs(x).max(initial=0) + 1
    level = np.floor(np.abs(x) * levels / top).astype(np.int64)
    row, dim = np.nonzero(x)
    segment = dim * levels + (levels - 1 - level[row, dim])
    order = np.lexsort((row, segment))
    row, dim, segment = row[order], dim[order], segment[order]
    value = x[row, dim]
    most = np.zeros(d * levels)
    np.maximum.at(most, segment, np.abs(value))
    return {"n": n, "d": d, "rows": row.astype("<u4").tobytes(), "vals": value.astype("<f8").tobytes(), "ends": np.searchsorted(segment, np.arange(d * levels), "right").astype("<i8").tobytes(), "most": most.astype("<f8").tobytes()}


class Block:
    """A block's postings, ready for queries: each level of impacts as a matrix (dimension, row) that is zero elsewhere."""

    def __init__(self, index: dict, levels: int = LEVELS):
        self.n, self.d, self.levels = index["n"], index["d"], levels
        rows, vals = np.frombuffer(index["rows"], "<u4").astype(np.int64), np.frombuffer(index["vals"], "<f8")
        ends = np.frombuffer(index["ends"], "<i8")
        self.size = np.diff(ends, prepend=0)
        self.most = np.frombuffer(index["most"], "<f8").reshape(self.d, levels)
        segment = np.repeat(np.arange(self.d * levels), self.size)
        self.level = np.zeros((levels, self.d, self.n))
        self.level[segment % levels, segment // levels, rows] = vals
        self.square = self.level * self.level

    def search(self, q: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, float]]:
        """For each query (rows, exact scores) of all rows but its own that may be among its best k, and the share of its postings that it read.

        own: (query, row) pairs that don't count.  Queries advance together, each through its own order of segments.
        """
        q = np.pad(q, ((0, 0), (0, max(0, self.d - q.shape[1]))))[:, : self.d]
        m = len(q)
        impact = (np.abs(q)[:, :, None] * self.most).reshape(m, -1)
        order = np.argsort(-impact, axis=1, kind="stable")
        size = np.where(np.take_along_axis(impact, order, 1) > 0, self.size[order], 0)
        share = np.cumsum(size, 1) / np.maximum(1, size.sum(1, keepdims=True))
        turn = np.empty_like(order)
        np.put_along_axis(turn, order, np.minimum(np.searchsorted(np.array(TURNS), share - 1e-12, "left"), len(TURNS) - 1), 1)
        turn = turn.reshape(m, self.d, self.levels)
        acc, out, live = np.zeros((m, self.n)), [None] * m, np.arange(m)
        mine = np.zeros((m, self.n), bool)
        mine[own[:, 0], own[:, 1]] = True
        for t in range(len(TURNS)):
            some, asked = turn[live], q[live]
            for v in range(self.levels):
                acc += (asked * (some[:, :, v] == t)) @ self.level[v]
            unread = (some > t) & (np.abs(asked)[:, :, None] * self.most > 0)
            top = (unread * self.most).max(2)
            rest = (np.abs(asked) * top).sum(1, keepdims=True)
            open_q = np.sqrt((asked * asked * (top > 0)).sum(1, keepdims=True))
            left = np.zeros_like(acc)
            for v in range(self.levels):
                if unread[:, :, v].any():
                    left += unread[:, :, v].astype(float) @ self.square[v]
            bound = np.minimum(rest, open_q * np.sqrt(left)) * (1 + 1e-9) + np.where(rest > 0, 1e-6, 0.0)
            low = np.where(mine, -np.inf, acc - bound)
            cut = np.partition(low, -k, axis=1)[:, -k] if self.n >= k else np.full(len(live), -np.inf)
            may = (acc + bound >= cut[:, None]) & ~mine
            done = (may.sum(1) <= max(LEFT * self.n, k)) | (t == len(TURNS) - 1)
            for i in np.flatnonzero(done):
                found = np.flatnonzero(may[i])
                read = float((self.size.reshape(self.d, -1) * ~unread[i])[np.abs(asked[i]) > 0].sum() / max(1, int(size[live[i]].sum())))
                out[live[i]] = (found, asked[i] @ self.level[:, :, found].sum(0), read)
            live, acc, mine = live[~done], acc[~done], mine[~done]
            if not len(live):
                break
        return out


def _usable(vectors: DataFrame) -> DataFrame:
    inf = F.lit(float("inf"))
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & whole).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")


def _blocks(rows: DataFrame, size: int, scale: int, *, index: bool) -> tuple[DataFrame, int]:
    """Rows (blk, ids, ...) of about `size` vectors each; rows of a repeated id are spread like others."""
    n = max(1, -(-rows.count() // size))

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("vec_id")
        x = _matrix(t.column("embedding"), scale)
        row = {"blk": t.column("blk")[0].as_py(), "ids": t.column("vec_id").to_numpy().astype("<i8").tobytes()}
        if index:
            row |= index_block(x)
        else:
            row |= {"q_n": x.shape[0], "q_d": x.shape[1], "q": x.astype("<f8").tobytes()}
        return pa.Table.from_pylist([row])

    more = "n bigint, d bigint, rows binary, vals binary, ends binary, most binary" if index else "q_n bigint, q_d bigint, q binary"
    dealt = rows.withColumn("blk", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(n)))
    return written(dealt.groupBy("blk").applyInArrow(build, f"blk bigint, ids binary, {more}"), "index" if index else "queries"), n


def exact_topk(vectors: DataFrame, queries: DataFrame, *, k: int = 5, scale: int = 256) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): each query's k best vectors by inner product of floor(scale * x), ties to the smaller vec_id.

    Vectors and queries are rows (vec_id, embedding).  Null ids, null vectors and vectors
    with null or non-finite components take no part; shorter vectors count as filled with
    zeros.  A query isn't compared with vectors of its own id; an id that occurs more
    than once among the queries is one query with all its vectors.  Fewer
    candidates than k give fewer rows.  Products must stay below 2**53.
    """
    return _found(vectors, queries, k, scale).select("query_id", "rank", "vec_id", "score")


def shares_read(vectors: DataFrame, queries: DataFrame, *, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, vec_id, score, read) before the blocks' answers are put together: read is the share of its block's postings that the query took."""
    return _scored(vectors, queries, k, scale)


def _scored(vectors: DataFrame, queries: DataFrame, k: int, scale: int) -> DataFrame:
    spark = vectors.sparkSession
    index, n = _blocks(_usable(vectors), BLOCK, scale, index=True)
    asked, _ = _blocks(_usable(queries), QUERY_BLOCK, scale, index=False)
    copies = asked.withColumnRenamed("blk", "qblk").withColumn("blk", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("blk", F.col("blk").cast("long"))
    rows = index.withColumn("qblk", F.lit(-1).cast("long")).unionByName(copies, allowMissingColumns=True)
    # an index block comes first, the queries after it
    rows = rows.repartition(parts(spark), "blk").sortWithinPartitions("blk", "qblk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block, ids = None, None, np.empty(0, np.int64)
        for b in batches:
            for r in (x for i in range(len(b)) for x in b.slice(i, 1).to_pylist()):
                if r["qblk"] < 0:
                    at, block, ids = r["blk"], Block(r), np.frombuffer(r["ids"], "<i8")
                    continue
                if r["blk"] != at:
                    continue  # a block without vectors
                out, asked = [], np.frombuffer(r["ids"], "<i8")
                place = np.argsort(ids, kind="stable")
                lo, hi = np.searchsorted(ids[place], asked, "left"), np.searchsorted(ids[place], asked, "right")
                many = hi - lo
                own = np.stack([np.repeat(np.arange(len(asked)), many), place[np.arange(many.sum()) + np.repeat(lo - np.cumsum(many) + many, many)]], 1)
                for q_id, (found, scores, read) in zip(asked.tolist(), block.search(np.frombuffer(r["q"], "<f8").reshape(r["q_n"], r["q_d"]), own, k), strict=True):
                    first = np.lexsort((ids[found], -scores))[:k]
                    out.append((np.full(len(first), q_id), ids[found][first], scores[first].astype(np.int64), np.full(len(first), read)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score", "read"])

    return rows.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint, read double")


def _found(vectors: DataFrame, queries: DataFrame, k: int, scale: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return _scored(vectors, queries, k, scale).withColumn("rank", place).filter(F.col("rank") <= k)
