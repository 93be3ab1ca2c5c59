import random

from pyspark.sql import functions as F

from spokenframe.operators import ranges as R

HOUR = 3_600_000
SIDE = "video_id long, {0}_id long, {0}_start long, {0}_end long"


def sides(spark):
    """Ranges from moments to months, at bin edges, reversed, before zero, repeated and null, on two keys."""
    rnd = random.Random(5)
    edges = [0, 30_000, 64 * 30_000, 65 * 30_000, 64**2 * 30_000, -30_000, 24 * HOUR]

    def rows(n):
        out = []
        for k in range(n):
            lo = rnd.choice(edges) if rnd.random() < 0.4 else rnd.randrange(-HOUR, 2000 * HOUR)
            hi = lo + rnd.choice([0, 1, -500, 29_999, 64 * 30_000, HOUR, 30 * HOUR, 64**2 * 30_000, 3000 * HOUR])
            out.append((k % 2, k, lo, hi))
        return [*out, (0, n, 5, 9), (0, n + 1, 5, 9), (0, n + 2, None, 9), (1, n + 3, 5, None), (None, n + 4, 5, 9)]

    left, right = rows(90), rows(110)
    return left, right, spark.createDataFrame(left, SIDE.format("a")), spark.createDataFrame(right, SIDE.format("b"))


def test_long_and_short_ranges_meet_once(spark):
    left, right, a, b = sides(spark)
    got = R.range_join(a, b, ("a_start", "a_end"), ("b_start", "b_end"), F.lit(True), long=True)
    assert got.columns == ["video_id", "a_id", "a_start", "a_end", "b_id", "b_start", "b_end"]

    def closed(lo, hi):
        return lo, max(lo, hi if hi is not None else lo)

    def meet(x, y):
        if x[0] is None or x[0] != y[0] or x[2] is None or y[2] is None:
            return False
        (s, e), (t, f) = closed(*x[2:]), closed(*y[2:])
        return s <= f and t <= e

    pairs = [(r.a_id, r.b_id) for r in got.collect()]
    assert len(pairs) == len(set(pairs))
    # pairs that share a bin come; of them those that share a moment are asked for
    exact = {(x[1], y[1]) for x in left for y in right if meet(x, y)}
    assert exact <= set(pairs) and len(exact) > 1000
    strict = (F.col("a_start") <= F.greatest("b_start", "b_end")) & (F.col("b_start") <= F.greatest("a_start", "a_end"))
    got = R.range_join(a, b, ("a_start", "a_end"), ("b_start", "b_end"), strict, long=True)
    assert sorted((r.a_id, r.b_id) for r in got.collect()) == sorted(exact)


def test_a_row_has_few_bins(spark):
    *_, a, _ = sides(spark)
    for left in (True, False):
        most = R._levelled(a, F.col("a_start"), F.col("a_end"), R.BIN_MS, left=left).groupBy("a_id").count().agg(F.max("count")).first()[0]
        assert most <= 2 * (R.FAN + 1) + 2 * R.LEVELS
