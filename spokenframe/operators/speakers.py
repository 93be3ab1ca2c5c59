"""Speakers from feature vectors: standardise, choose how many, cluster.

Ward's clustering of a video with many segments goes in rounds over a table of centres and
sizes: every cluster finds its nearest one, and pairs that are each other's nearest
merge at once, which makes the same tree as merging the closest pair each time.  Nearest
clusters, and the distance sums that silhouettes need, come from a grid of block pairs: a
task holds two blocks of rows, never a video.  Once a video has few clusters left, one
small task makes the last merges.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def segment_embedding(frames: DataFrame, least: int = 5) -> DataFrame:
    """(video_id, segment_id, embedding): mean and deviation of each coefficient but the first over a segment's frames (coeffs); null under `least` frames."""
    rows = frames.select("video_id", "segment_id", "frame_idx", F.posexplode("coeffs").alias("k", "v")).filter("k > 0")
    by = rows.groupBy("video_id", "segment_id", "k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.count(F.lit(1)).alias("n"))
    out = by.groupBy("video_id", "segment_id").agg(F.array_sort(F.collect_list(F.struct("k", "m", "s"))).alias("x"), F.max("n").alias("n"))
    vector = F.concat(F.transform("x", lambda e: e["m"]), F.transform("x", lambda e: e["s"]))
    return out.select("video_id", "segment_id", F.when(F.col("n") >= least, vector).alias("embedding"))


def standardise(embeddings: DataFrame) -> DataFrame:
    """(video_id, segment_id, embedding): each place centred and scaled over its video."""
    rows = embeddings.filter("embedding is not null").select("video_id", "segment_id", F.posexplode("embedding").alias("k", "v"))
    w = Window.partitionBy("video_id", "k")
    rows = rows.withColumn("z", (F.col("v") - F.avg("v").over(w)) / (F.stddev_pop("v").over(w) + 1e-6))
    return rows.groupBy("video_id", "segment_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "z"))), lambda e: e["z"]).alias("embedding"))


#: Distances that a task holds at once: they fit into a core's cache.
CELLS = 1 << 20
#: So many clusters of a video are left to one task, as rounds of large videos merge few of a hundred; blocks have at most so many rows, a quarter where a video has no more than four of those.
BLOCK = 16_384


def ward_labels(x: np.ndarray, most: int, sizes: np.ndarray | None = None) -> dict[int, np.ndarray]:
    """Labels of Ward's agglomerative clustering at every k from most down to 1; sizes: how many rows each row of x stands for.

    Chains of nearest neighbours merge where two are each other's nearest, which makes the same tree as merging
    the closest pair each time.  Distances are computed from centres when they are needed, so memory is that of x.
    """
    n = len(x)
    centre, size, alive = x.astype(float).copy(), np.ones(n) if sizes is None else sizes.astype(float), np.ones(n, bool)
    norm, slack = (centre * centre).sum(1), (x.shape[1] + 16) * 2.0**-52
    merges: list[tuple[float, int, int]] = []
    chain: list[int] = []

    def costs(i: int, js: np.ndarray | int) -> np.ndarray:
        return ((centre[js] - centre[i]) ** 2).sum(-1) * (size[js] * size[i] / (size[js] + size[i]))

    while len(merges) < n - 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        i = chain[-1]
        # a product gives bounds that no cost is below; those not above the cost of some cluster are computed in full
        both = norm + norm[i]
        bound = (both - 2 * (centre @ centre[i]) - slack * both) * (size * size[i] / (size + size[i]))
        bound[~alive] = np.inf
        bound[i] = np.inf
        near = np.flatnonzero(bound <= costs(i, int(bound.argmin())))
        cost = costs(i, near)
        j, least = int(near[cost.argmin()]), float(cost.min())
        if len(chain) > 1 and costs(i, chain[-2]) <= least:
            j = chain[-2]
            chain = chain[:-2]
            lo, hi = min(i, j), max(i, j)
            merges.append((float(costs(i, j)), lo, hi))
            centre[lo] = (centre[i] * size[i] + centre[j] * size[j]) / (size[i] + size[j])
            size[lo] += size[hi]
            norm[lo] = (centre[lo] * centre[lo]).sum()
            alive[hi] = False
        else:
            chain.append(j)
    label, parent = np.arange(n), np.arange(n)

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = int(parent[k])
        return k

    out = {n: label.copy()} if n <= most else {}
    for done, (_, i, j) in enumerate(sorted(merges, key=lambda m: m[0]), 1):
        i, j = root(i), root(j)
        parent[max(i, j)] = min(i, j)
        if n - done <= most:
            out[n - done] = np.array([root(k) for k in range(n)])
    return {k: np.unique(v, return_inverse=True)[1] for k, v in out.items()}


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Arrays of one length as the rows of a matrix."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], rows.ravel())


def _grid(rows: DataFrame, block: int, found: Callable[[dict, pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """What `found` makes of every pair of blocks (rows, others) of each video; rows: (video_id, id, ...).

    Two blocks meet in one group for both orders, so a row goes to as many groups as its video has blocks.
    """
    count = F.count(F.lit(1))
    blocks = rows.groupBy("video_id").agg(F.least(F.ceil(4 * count / block), F.greatest(F.lit(4), F.ceil(count / block))).alias("_n"))
    rows = rows.join(blocks.hint("merge"), "video_id").withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_n")))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    rows = rows.withColumns({"_row": F.least("_own", "_other"), "_col": F.greatest("_own", "_other"), "_left": F.col("_own") <= F.col("_other")})

    def run(group: pa.Table) -> pa.Table:
        key, side = {"video_id": group["video_id"][0].as_py()}, group["_left"].combine_chunks()
        if group["_row"][0] == group["_col"][0]:
            return found(key, group, group)
        a, b = group.filter(side), group.filter(pa.compute.invert(side))
        return pa.concat_tables([found(key, a, b), found(key, b, a)])

    return rows.drop("_n", "_own", "_other").groupBy("video_id", "_row", "_col").applyInArrow(run, schema)


def _beside(x: np.ndarray, scale: float, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Two forms of the rows x: the product of one with the other of further rows holds scale * (|p|^2 + |q|^2) - 2 p q."""
    norm, one = scale * (x * x).sum(1, keepdims=True), np.ones((len(x), 1))
    return np.hstack([-2 * x, norm, one]).astype(kind), np.hstack([x, one, norm]).astype(kind)


def _nearest(key: dict, a: pa.Table, b: pa.Table) -> pa.Table:
    """(video_id, id, cost, lo, hi): the pair of least Ward cost of each cluster in a with one in b.

    A product of matrices in single precision gives a cost that no pair is below, whatever it rounds; pairs whose bound is
    not above the cost of some pair are computed in full, so that both clusters of a pair get the same number, and equal
    costs go by ids.
    """
    out: dict[str, list] = {"id": [], "cost": [], "lo": [], "hi": []}
    if a.num_rows and b.num_rows:
        x, y, m, n = _matrix(a["x"]), _matrix(b["x"]), a["w"].to_numpy(), b["w"].to_numpy()
        i, j = a["id"].to_numpy(), b["id"].to_numpy()
        scale = 1 - (x.shape[1] + 16) * 2.0**-23  # the product's rounding is below (places + 2) * 2^-24 * 2 (|p|^2 + |q|^2)
        left, right = _beside(x, scale, np.float32)[0], np.ascontiguousarray(_beside(y, scale, np.float32)[1].T)
        per_w, per_n = (1 / m).astype(np.float32), (1 / n).astype(np.float32)

        def costs(r: np.ndarray, c: np.ndarray) -> np.ndarray:
            parts = [slice(k, k + CELLS // 16) for k in range(0, len(r), CELLS // 16)]
            return np.concatenate([((x[r[s]] - y[c[s]]) ** 2).sum(1) * ((m[r[s]] * n[c[s]]) / (m[r[s]] + n[c[s]])) for s in parts])

        step = max(1, CELLS // len(y))
        for lo in range(0, len(x), step):
            own = np.arange(lo, min(lo + step, len(x)))
            least = left[own] @ right
            least /= per_w[own, None] + per_n
            if a is b:
                least[own - lo, own] = np.inf
            some = costs(own, least.argmin(1))
            if a is b and len(x) == 1:
                break  # a cluster alone
            at = np.flatnonzero(least <= np.nextafter(some.astype(np.float32), np.float32(np.inf))[:, None])
            r, c = own[at // len(y)], at % len(y)
            if not len(r):
                continue
            exact = costs(r, c)
            small, large = np.minimum(i[r], j[c]), np.maximum(i[r], j[c])
            order = np.lexsort((large, small, exact, r))
            first = order[np.unique(r[order], return_index=True)[1]]
            for name, values in zip(out, (i[r[first]], exact[first], small[first], large[first]), strict=True):
                out[name].append(values)
    made = {k: pa.array(np.concatenate(v) if v else [], pa.float64() if k == "cost" else pa.int64()) for k, v in out.items()}
    return pa.table({"video_id": pa.array([key["video_id"]] * len(made["id"]), pa.int64()), **made})


def merge_round(active: DataFrame, most: int, block: int) -> DataFrame:
    """(video_id, lo, hi): pairs of clusters (video_id, id, x, w) that are each other's nearest, for one round.

    The most - 1 costliest pairs of a video wait, so that what is merged can't be among the last most - 1
    merges of the tree, which are cut; the cheapest pair always merges.
    """
    near = _grid(active, block, _nearest, "video_id bigint, id bigint, cost double, lo bigint, hi bigint")
    near = near.groupBy("video_id", "id").agg(F.min(F.struct("cost", "lo", "hi")).alias("p")).select("video_id", "p.*")
    pairs = written(near.groupBy("video_id", "lo", "hi").agg(F.count(F.lit(1)).alias("n"), F.min("cost").alias("cost")).filter("n = 2").drop("n"), "nearest-pairs")
    cheapest = pairs.groupBy("video_id").agg(F.min(F.struct("cost", "lo", "hi")).alias("least"))
    last = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("cost"), F.desc("lo"), F.desc("hi")))
    wait = pairs.withColumn("nth", last).filter(F.col("nth") < most).join(cheapest.hint("merge"), "video_id").filter(F.struct("cost", "lo", "hi") != F.col("least"))
    return written(pairs.join(wait.select("video_id", "lo", "hi").hint("merge"), ["video_id", "lo", "hi"], "left_anti").select("video_id", "lo", "hi"), "merges")


def _merged(active: DataFrame, merges: DataFrame) -> DataFrame:
    """active after merges: the weighted mean of both centres under the smaller id."""
    moved = active.join(merges.select("video_id", F.col("hi").alias("id"), "lo").hint("merge"), ["video_id", "id"], "left").withColumn("to", F.coalesce("lo", "id"))
    two = F.array_sort(F.collect_list(F.struct("id", "x", "w")))  # two rows at most
    by = moved.groupBy("video_id", "to").agg(two.alias("two"))
    a, b = F.col("two")[0], F.get("two", F.lit(1))
    mean = F.zip_with(a["x"], b["x"], lambda u, v: (u * a["w"] + v * b["w"]) / (a["w"] + b["w"]))
    return by.select("video_id", F.col("to").alias("id"), F.when(F.size("two") > 1, mean).otherwise(a["x"]).alias("x"), F.when(F.size("two") > 1, a["w"] + b["w"]).otherwise(a["w"]).alias("w"))


def _last_merges(most: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        labels = ward_labels(np.stack(pdf["x"].to_numpy()), most, pdf["w"].to_numpy())
        cut = [labels.get(k, np.zeros(len(pdf), int)) for k in range(2, most + 1)]
        return pd.DataFrame({"video_id": pdf["video_id"], "cluster": pdf["id"], "labels": np.stack(cut, 1).tolist(), "n_clusters": len(pdf)})

    return run


def ward_cuts(rows: DataFrame, most: int, *, block: int = BLOCK) -> DataFrame:
    """(video_id, id, labels, n_clusters): the cluster of each row when its video is cut into 2, 3 .. most clusters.

    rows: (video_id, id, x, w), differing vectors that stand for w rows each.  A video with fewer than k of them has no cut
    into k; n_clusters says up to how many there are, if under `block`.
    """
    active, members = rows, rows.select("video_id", "id", F.col("id").alias("cluster"))
    while True:
        large = active.groupBy("video_id").count().filter(F.col("count") > max(block, most)).select("video_id")
        if large.isEmpty():
            break
        big = active.join(large.hint("merge"), "video_id", "left_semi")
        merges = merge_round(big, most, block)
        active = written(_merged(active, merges), "centres")
        to = merges.select("video_id", F.col("hi").alias("cluster"), "lo")
        members = written(members.join(to.hint("merge"), ["video_id", "cluster"], "left").select("video_id", "id", F.coalesce("lo", "cluster").alias("cluster")), "members")
    cuts = active.groupBy("video_id").applyInPandas(_last_merges(most), "video_id bigint, cluster bigint, labels array<int>, n_clusters bigint")
    return members.join(cuts.hint("merge"), ["video_id", "cluster"]).drop("cluster")


def _sums(most: int) -> Callable[[dict, pa.Table, pa.Table], pa.Table]:
    def run(key: dict, a: pa.Table, b: pa.Table) -> pa.Table:
        """Each row's summed distances to the clusters of every cut, as far as they lie in b."""
        total = np.empty((0, most * (most + 1) // 2 - 1))
        if a.num_rows and b.num_rows:
            x, y, w, labels = _matrix(a["x"]), _matrix(b["x"]), b["w"].to_numpy(), _matrix(b["labels"])
            member = np.concatenate([(labels[:, k - 2, None] == np.arange(k)) * w[:, None] for k in range(2, most + 1)], 1)
            left, right = _beside(x, 1.0, float)[0], np.ascontiguousarray(_beside(y, 1.0, float)[1].T)
            total, step = np.empty((len(x), member.shape[1])), max(1, CELLS // len(y))
            for lo in range(0, len(x), step):
                d = left[lo : lo + step] @ right
                np.sqrt(np.maximum(d, 0, out=d), out=d)
                if a is b:
                    d[np.arange(len(d)), np.arange(lo, lo + len(d))] = 0
                total[lo : lo + step] = d @ member
        return pa.table({"video_id": pa.array([key["video_id"]] * len(total), pa.int64()), "id": a["id"] if len(total) else pa.array([], pa.int64()), "sums": _lists(total)})

    return run


def silhouettes(rows: DataFrame, most: int, *, block: int = BLOCK) -> DataFrame:
    """(video_id, k, score): the mean silhouette of every cut of each video; rows in clusters of one count 0.

    rows: (video_id, id, x, w, labels, n_clusters), labels counted from 0 for each cut.
    """
    places = [(k, c) for k in range(2, most + 1) for c in range(k)]
    sums = _grid(rows.select("video_id", "id", "x", "w", "labels"), block, _sums(most), "video_id bigint, id bigint, sums array<double>")
    sums = sums.groupBy("video_id", "id").agg(F.array(*[F.sum(F.col("sums")[n]) for n in range(len(places))]).alias("sums"))
    by = rows.select("video_id", "w", F.posexplode("labels").alias("k", "label")).groupBy("video_id", "k", "label").agg(F.sum("w").alias("n"))
    count = by.groupBy("video_id").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("k", "label"), "n"))).alias("sizes"))  # as many entries as there are places
    rows = rows.select("video_id", "id", "w", "labels", "n_clusters").join(sums.hint("merge"), ["video_id", "id"]).join(count.hint("merge"), "video_id")
    scores = []
    for k in range(2, most + 1):
        at = places.index((k, 0))
        size = [F.coalesce(F.col("sizes")[F.struct(F.lit(k - 2).alias("k"), F.lit(c).alias("label"))], F.lit(0)) for c in range(k)]
        own = F.col("labels")[k - 2]
        pick = lambda values, own=own: F.element_at(F.array(*values), own + 1)
        a = pick([F.col("sums")[at + c] for c in range(k)]) / F.greatest(F.lit(1), pick(size) - 1)
        b = F.array_min(F.array(*[F.when((own != c) & (size[c] > 0), F.col("sums")[at + c] / F.greatest(F.lit(1), size[c])) for c in range(k)]))
        value = F.when(pick(size) > 1, (b - a) / F.greatest(a, b, F.lit(1e-12))).otherwise(0.0)
        scores.append(F.struct(F.lit(k).alias("k"), F.when(F.col("n_clusters") >= k, value).alias("v")))
    rows = rows.select("video_id", "w", F.explode(F.array(*scores)).alias("s")).filter("s.v is not null")
    return rows.groupBy("video_id", F.col("s.k").alias("k")).agg((F.sum(F.col("s.v") * F.col("w")) / F.sum("w")).alias("score"), F.sum("w").alias("n"))


def choose_k(scores: DataFrame) -> DataFrame:
    """(video_id, k): the smallest k within .01 of the best silhouette; 1 if that is under .08.  A k must be smaller than the number of rows."""
    scores = scores.filter("k < n")
    best = scores.groupBy("video_id").agg(F.max("score").alias("best"))
    fine = scores.join(best.hint("merge"), "video_id").filter(F.col("score") >= F.col("best") - 0.01)
    return fine.groupBy("video_id").agg(F.when(F.max("best") < 0.08, 1).otherwise(F.min("k")).alias("k"))


def cluster_speakers(embeddings: DataFrame, most: int = 6, *, block: int = BLOCK) -> DataFrame:
    """(video_id, segment_id, speaker): standardised embeddings clustered in each video; A, B, C by first appearance.

    Segment ids are unique within a video.  Equal embeddings are one row that counts as often.  Fewer than two differing
    embeddings are one speaker.
    """
    rows = written(standardise(embeddings), "standardised")
    kinds = rows.groupBy("video_id", "embedding").agg(F.min("segment_id").alias("id"), F.count(F.lit(1)).cast("double").alias("w"))
    kinds = written(kinds.select("video_id", "id", F.col("embedding").alias("x"), "w"), "embeddings")
    cut = written(kinds.join(ward_cuts(kinds, most, block=block).hint("merge"), ["video_id", "id"]), "cuts")
    k = choose_k(written(silhouettes(cut, most, block=block), "silhouettes"))
    label = F.when(F.coalesce("k", F.lit(1)) > 1, F.get("labels", F.col("k") - 2)).otherwise(0)
    found = cut.join(k.hint("merge"), "video_id", "left").select("video_id", F.col("x").alias("embedding"), label.alias("label"))
    named = written(rows.join(found.hint("merge"), ["video_id", "embedding"]).select("video_id", "segment_id", "label"), "labels")
    first = named.groupBy("video_id", "label").agg(F.min("segment_id").alias("first"))
    letter = F.chr(F.lit(64) + F.row_number().over(Window.partitionBy("video_id").orderBy("first")))
    return named.join(first.select("video_id", "label", F.concat(F.lit("Speaker "), letter).alias("speaker")).hint("merge"), ["video_id", "label"]).select("video_id", "segment_id", "speaker")
