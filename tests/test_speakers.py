"""Speaker clustering in rounds and silhouettes by blocks against plain versions."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spokenframe.operators import speakers as K


def plain_silhouette(x, label):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    total = 0.0
    for k in range(len(x)):
        own = (label == label[k]) & (np.arange(len(x)) != k)
        if own.any():
            a, b = d[k][own].mean(), min(d[k][label == c].mean() for c in set(label.tolist()) - {int(label[k])})
            total += (b - a) / max(a, b)
    return total / len(x)


def plain_speakers(x, most=6):
    """Speaker letters of standardised rows in order of their ids."""
    label = np.zeros(len(x), int)
    if len(np.unique(x, axis=0)) >= 2:
        labels = K.ward_labels(x, most)
        scores = {k: plain_silhouette(x, labels[k]) for k in range(2, min(most, len(np.unique(x, axis=0)), len(x) - 1) + 1)}
        if scores and max(scores.values()) >= 0.08:
            label = labels[min(k for k, s in scores.items() if s >= max(scores.values()) - 0.01)]
    order = {c: n for n, c in enumerate(dict.fromkeys(label.tolist()))}
    return [f"Speaker {chr(65 + order[c])}" for c in label.tolist()]


def voices(seed, n, k, spread=0.6, d=5):
    r = np.random.default_rng(seed)
    return r.normal(size=(n, d)) * spread + 6 * r.normal(size=(k, d))[r.integers(0, k, n)]


def table(spark, videos):
    rows = [(v, i, [float(z) for z in e]) for v, x in videos.items() for i, e in enumerate(x)]
    return spark.createDataFrame(rows, "video_id long, segment_id long, embedding array<double>")


def standard(x):
    return (x - x.mean(0)) / (x.std(0) + 1e-6)


def by_video(rows):
    out: dict = {}
    for x in sorted(rows, key=lambda x: (x.video_id, x.segment_id)):
        out.setdefault(x.video_id, []).append(x.speaker)
    return out


@pytest.mark.parametrize("block", [K.BLOCK, 40])
def test_speakers_like_the_plain_way(spark, block):
    """With blocks of 40 rows the larger videos go through rounds and grids of several blocks."""
    r = np.random.default_rng(0)
    videos = {1: voices(1, 90, 3), 2: voices(2, 45, 2), 3: voices(3, 1, 1), 4: voices(4, 2, 1), 5: r.normal(size=(60, 4)), 6: voices(6, 70, 5, 0.2), 7: np.concatenate([voices(7, 60, 2), [[300.0] * 5, [-500.0] * 5]])}
    got = by_video(K.cluster_speakers(table(spark, videos), block=block).collect())
    for v, x in videos.items():
        assert got[v] == plain_speakers(standard(x)), v


@pytest.mark.parametrize("block", [60])
def test_rounds_make_the_same_tree(spark, block):
    r = np.random.default_rng(5)
    x = np.concatenate([voices(9, 120, 7, 1.5), np.arange(20)[:, None] ** 2 * np.ones(5), 40 + r.normal(size=(3, 5))])
    rows = spark.createDataFrame([(1, i, e.tolist(), 1.0) for i, e in enumerate(x)], "video_id long, id long, x array<double>, w double")
    cuts = np.array([c.labels for c in K.ward_cuts(rows, 6, block=block).orderBy("id").collect()])
    want = K.ward_labels(x, 6)
    for k in range(2, 7):
        same = lambda a: {frozenset(np.flatnonzero(a == c)) for c in set(a.tolist())}
        assert same(cuts[:, k - 2]) == same(want[k]), k


def test_silhouettes_of_blocks(spark):
    x = voices(3, 130, 3, 2.0)
    labels = K.ward_labels(x, 6)
    rows = spark.createDataFrame([(1, i, e.tolist(), 1.0, [int(labels[k][i]) for k in range(2, 7)], 130) for i, e in enumerate(x)], "video_id long, id long, x array<double>, w double, labels array<int>, n_clusters long")
    for block in (30, 4096):
        got = {s.k: s.score for s in K.silhouettes(rows, 6, block=block).collect()}
        assert got == pytest.approx({k: plain_silhouette(x, labels[k]) for k in range(2, 7)})


def test_equal_embeddings_and_no_rows(spark):
    two = np.array([[0.0, 1.0], [5.0, -3.0]])
    videos = {1: two[np.arange(60) % 2], 2: np.ones((50, 2))}
    for block in (4096, 1):
        got = by_video(K.cluster_speakers(table(spark, videos), block=block).collect())
        assert got == {1: ["Speaker A", "Speaker B"] * 30, 2: ["Speaker A"] * 50}
    empty = table(spark, {1: two}).filter("segment_id < 0")
    assert K.cluster_speakers(empty).count() == 0
    nothing = table(spark, {1: two}).withColumn("embedding", F.lit(None).cast("array<double>"))
    assert K.cluster_speakers(nothing).count() == 0


def test_thousands_of_segments_need_no_rounds(spark, monkeypatch):
    """Rounds merge few clusters of a hundred, so videos of some thousand segments are left to one task each."""
    def round_of(*_):
        raise AssertionError("a round")

    monkeypatch.setattr(K, "merge_round", round_of)
    x = voices(11, 5000, 3, d=3)
    rows = spark.createDataFrame([(1, i, e.tolist(), 1.0) for i, e in enumerate(x)], "video_id long, id long, x array<double>, w double")
    cuts = K.ward_cuts(rows, 6).collect()
    assert len(cuts) == 5000 and {len(set(c.labels[1] for c in cuts))} == {3}


def test_nearest_is_exact_beside_far_and_equal_ones():
    """Single precision only proposes: a far row, near copies and ties leave the nearest ones as they are."""
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(size=(300, 8)), r.normal(size=(1, 8)) + 1e-7 * r.normal(size=(50, 8)), [[1e5] * 8], [[4.0] * 8, [6.0] * 8, [8.0] * 8]])
    w = r.integers(1, 4, len(x)).astype(float)
    table = pa.table({"id": np.arange(len(x)), "x": K._lists(x), "w": w})
    got = K._nearest({"video_id": 1}, table, table).to_pylist()
    assert [g["id"] for g in got] == list(range(len(x)))
    for g in got:
        k = g["id"]
        cost = ((x - x[k]) ** 2).sum(1) * (w * w[k] / (w + w[k]))
        cost[k] = np.inf
        assert (g["cost"], g["lo"], g["hi"]) == min((cost[j], min(j, k), max(j, k)) for j in range(len(x)))
