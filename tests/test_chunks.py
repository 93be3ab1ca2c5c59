"""Chunks of very long videos by pointer doubling, against the plain pass."""

import random

import pytest

from spokenframe.operators import segments as S


def plain(rows, budget):
    out, state = {}, {}
    for v, k, text in sorted(rows, key=lambda r: r[:2]):
        if not text.strip():
            continue
        chunk, total = state.get(v, (0, 0))
        if total >= budget:
            chunk, total = chunk + 1, 0
        state[v] = chunk, total + len(text.strip()) + 1
        out[v, k] = chunk
    return out


@pytest.mark.parametrize("budget", [40])
def test_pointers_like_the_plain_pass(spark, budget):
    r = random.Random(budget)
    rows = [(v, 3 * k - 50, "x" * r.choice([0, 1, 2, 9, 39, 200]) + " " * r.randrange(2)) for v, n in ((1, 700), (2, 1), (3, 60)) for k in range(n)]
    rows += [(4, k, "") for k in range(5)]
    segments = spark.createDataFrame(rows, "video_id long, segment_id long, text string")
    want = plain(rows, budget)
    for stream_rows in (0, 100):
        found = S.number_chunks(segments, budget, stream_rows=stream_rows)
        got = [((x.video_id, x.segment_id), x.chunk_idx) for x in found.collect()]
        assert len(got) == len(want) and dict(got) == want
    assert S.number_chunks(segments.limit(0), budget, stream_rows=0).count() == 0
