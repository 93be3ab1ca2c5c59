import math

import numpy as np

from spokenframe.llm import topk


def brute(rows, k, wanted):
    vec = {i: np.floor(256 * np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q in [i for i in vec if wanted(i)]:
        best = sorted((-int(vec[q] @ vec[c]), c) for c in vec if c != q)[:k]
        out |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(best)}
    return out


def test_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    r = np.random.default_rng(4)
    rows = [(k, [float(np.float32(x)) for x in r.normal(size=16) * (3 if k % 7 == 0 else 0.4)]) for k in range(500)]
    rows += [(500 + k, rows[k % 5][1]) for k in range(30)]  # ties
    rows += [(600, None), (650, [float("nan")] * 16), (700, [None] * 16), (None, [1.0] * 16), (750, [0.0] * 16)]
    data = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = topk.exact_topk(data, data.filter("vec_id % 50 = 0")).collect()
    assert {(x.query_id, x.rank, x.vec_id, x.score) for x in got} == brute(rows, 5, lambda i: i % 50 == 0)


def test_stops_early_on_proof():
    r = np.random.default_rng(5)
    x = np.floor(256 * r.normal(size=(2000, 16)) * np.where(r.random((2000, 16)) < 0.1, 1.0, 0.002))  # few components matter
    block = topk.Block(topk.index_block(x))
    for k, (found, scores, read) in enumerate(block.search(x[:20], np.array([(k, k) for k in range(20)]), 5)):
        assert read < 1
        want = sorted((-float(x[k] @ x[c]), c) for c in range(2000) if c != k)[:5]
        assert sorted(zip((-scores).tolist(), found.tolist()))[:5] == want


def test_the_stop_fires_on_the_sample_vectors(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    read = [x.read for x in topk.shares_read(vectors, vectors.filter("vec_id % 50 = 0")).collect()]
    assert read and np.mean(read) < 1


def test_few_rows(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert topk.exact_topk(empty, empty).count() == 0
    two = spark.createDataFrame([(0, [1.0, 2.0], "x"), (1, [3.0], "y")], "vec_id bigint, embedding array<float>, score string")
    assert [(x.query_id, x.vec_id, x.score) for x in topk.exact_topk(two, two.filter("vec_id = 0")).collect()] == [(0, 1, 3 * 65536)]


def test_more_than_65536_rows_of_an_id(spark):
    rows = [(7, [1.0, 0.0])] * 69_000 + [(7, [0.0, 5.0])] + [(k, [float(k % 11), 1.0]) for k in range(100, 160)]
    data = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    vec = dict(rows[69_001:])
    want = set()
    for q in (100, 150):
        best = sorted((-int(65536 * sum(a * b for a, b in zip(vec[q], v, strict=True))), i) for i, v in rows[68_990:] if i != q)[:5]
        want |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(best)}
    assert {(x.query_id, x["rank"], x.vec_id, x.score) for x in topk.exact_topk(data, data.filter("vec_id in (100, 150)")).collect()} == want


def test_a_block_of_more_than_65536_rows():
    x = np.zeros((70_000, 2))
    x[69_999] = [3.0, 4.0]
    (found, scores, _), = topk.Block(topk.index_block(x)).search(np.array([[1.0, 1.0]]), np.empty((0, 2), np.int64), 1)
    assert found[np.argmax(scores)] == 69_999 and scores.max() == 7.0
