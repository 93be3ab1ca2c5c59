"""Faces and crops: boxes, paths and keyframes for each clip."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import range_join


def face_geometry(faces: DataFrame) -> DataFrame:
    """(video_id, t_ms, cx, cy, left, right): area-weighted centre and span of each frame's faces (x, y, w, h)."""
    area = F.col("w") * F.col("h")
    return faces.groupBy("video_id", "t_ms").agg(
        (F.sum((F.col("x") + F.col("w") / 2) * area) / F.sum(area)).alias("cx"), (F.sum((F.col("y") + F.col("h") / 2) * area) / F.sum(area)).alias("cy"),
        F.min("x").alias("left"), F.max(F.col("x") + F.col("w")).alias("right"),
    )


def dedupe_faces(faces: DataFrame, most_iou: float = 0.35) -> DataFrame:
    """faces (video_id, t_ms, face_no, x, y, w, h) without boxes that overlap a larger kept one; equal areas by face_no."""
    item = F.struct((-(F.col("w") * F.col("h"))).alias("neg"), "face_no", "x", "y", "w", "h")
    frames = faces.groupBy("video_id", "t_ms").agg(F.array_sort(F.collect_list(item)).alias("items"))
    inter = "greatest(0, least(b.x + b.w, k.x + k.w) - greatest(b.x, k.x)) * greatest(0, least(b.y + b.h, k.y + k.h) - greatest(b.y, k.y))"
    fold = f"aggregate(items, slice(items, 1, 0), (kept, b) -> if(exists(kept, k -> {inter} / cast(greatest(1, b.w * b.h + k.w * k.h - {inter}) as double) > {most_iou}), kept, concat(kept, array(b))))"
    return frames.select("video_id", "t_ms", F.explode(F.expr(fold)).alias("k")).select("video_id", "t_ms", "k.face_no", "k.x", "k.y", "k.w", "k.h")


def face_means(faces: DataFrame) -> DataFrame:
    """(video_id, mean_cx, mean_cy): mean centre over all faces of a video, each counting once."""
    return faces.groupBy("video_id").agg(F.avg(F.col("x") + F.col("w") / 2).alias("mean_cx"), F.avg(F.col("y") + F.col("h") / 2).alias("mean_cy"))


def hold_last(centres: DataFrame, means: DataFrame) -> DataFrame:
    """centres (video_id, t_ms, cx, cy nullable): the last known centre fills gaps, means (as of face_means) those before the first."""
    v = Window.partitionBy("video_id").orderBy("t_ms").rowsBetween(Window.unboundedPreceding, 0)
    rows = centres.join(means.hint("merge"), "video_id", "left")
    return rows.withColumns({c: F.coalesce(F.last(c, True).over(v), F.col(f"mean_{c}")) for c in ("cx", "cy")}).drop("mean_cx", "mean_cy")


def smooth_path(path: DataFrame, column: str = "cx", window: int = 7, mean: int = 5) -> DataFrame:
    """path (video_id, t_ms, column): a running median, then a running mean, the edges repeated; series under 3 stay.

    The median's window shrinks to the largest odd number the series allows, the mean's to the
    series' length (of an even window, one more value before the middle than after it).
    """
    v = Window.partitionBy("video_id").orderBy("t_ms")
    rows = path.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("video_id"))).withColumn("k", F.row_number().over(v))

    def padded(col: str, half: int):
        """The values at -half .. half, the first or last one where the series ends."""
        first = F.first(col).over(v.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        last = F.last(col).over(v.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        return F.array(*[F.coalesce(F.lag(col, -d).over(v) if d < 0 else F.lead(col, d).over(v) if d else F.col(col), first if d < 0 else last) for d in range(-half, half + 1)])

    rows = rows.withColumn("odd", F.least(F.lit(window), F.col("n") - (1 - F.col("n") % 2)))
    half = window // 2
    rows = rows.withColumn("near", padded(column, half))
    rows = rows.withColumn("near", F.expr(f"array_sort(slice(near, {half + 1} - cast((odd - 1) / 2 as int), cast(odd as int)))")).withColumn("med", F.expr("near[cast((odd - 1) / 2 as int)]"))
    rows = rows.withColumn("around", padded("med", mean // 2)).withColumn("smooth", F.expr(f"aggregate(slice(around, {mean // 2 + 1} - cast(floor(least(n, {mean}) / 2) as int), cast(least(n, {mean}) as int)), 0d, (a, b) -> a + b) / least(n, {mean})"))
    return rows.withColumn(column, F.when(F.col("n") < 3, F.col(column)).otherwise(F.col("smooth"))).drop("n", "k", "odd", "near", "med", "around", "smooth")


def crop_keyframes(path: DataFrame, least_move: int = 24) -> DataFrame:
    """path (video_id, t_ms, x, y) thinned to keyframes: the first (and one at 0 with its place, if it is later), then each that is least_move away in x or y from the last kept.

    Frames stream by in order; only the last keyframe is held.
    """
    rows = path.select("video_id", F.col("t_ms").cast("bigint").alias("t_ms"), F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"))
    rows = rows.repartition("video_id").sortWithinPartitions("video_id", "t_ms", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video, at = None, None
        for b in batches:
            out = []
            for v, t, x, y in zip(*[b.column(k).to_pylist() for k in range(4)], strict=True):
                if at is None or v != video:
                    if t > 0:
                        out.append((v, 0, x, y))
                elif abs(x - at[0]) < least_move and abs(y - at[1]) < least_move:
                    continue
                out.append((v, t, x, y))
                video, at = v, (x, y)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, b.schema.field(k).type) for k, c in enumerate(zip(*out, strict=True))], ["video_id", "t_ms", "x", "y"])

    return rows.mapInArrow(run, rows.schema)


def crop_size(source_w: int, source_h: int, target_w: int = 1080, target_h: int = 1920) -> tuple[int, int]:
    """The largest crop of the target's shape, both sides even."""
    if source_w * target_h > source_h * target_w:
        h = source_h
        w = round(source_h * target_w / target_h)
    else:
        w = source_w
        h = round(source_w * target_h / target_w)
    return min(source_w, w) // 2 * 2, min(source_h, h) // 2 * 2


def crop_path(frames: DataFrame, faces: DataFrame, source_w: int, source_h: int, *, target_w: int = 1080, target_h: int = 1920, bias: float = 0.42) -> DataFrame:
    """(video_id, strategy, t_ms, x, y, w, h): whole if the source has the target's shape, centred without faces, fixed if 92 % of the crop holds all of them, else following them both ways.

    frames: (video_id, t_ms), relative to the clip; faces: (video_id, t_ms, x, y, w, h).  Places are rounded, halves to even numbers.
    """
    w, h = crop_size(source_w, source_h, target_w, target_h)
    most_x, most_y = max(0, source_w - w), max(0, source_h - h)
    videos = frames.select("video_id").distinct()
    sized = lambda rows: rows.withColumn("w", F.lit(w)).withColumn("h", F.lit(h))
    if w >= source_w and h >= source_h:
        zero = F.lit(0).cast("bigint")
        return sized(videos.select("video_id", F.lit("whole").alias("strategy"), zero.alias("t_ms"), zero.alias("x"), zero.alias("y")))
    at = face_geometry(faces)
    span = at.groupBy("video_id").agg(F.min("left").alias("left"), F.max("right").alias("right")).join(face_means(faces).hint("merge"), "video_id")
    videos = videos.join(span.hint("merge"), "video_id", "left")
    strategy = F.when(F.col("left").isNull(), "centre").when(F.col("right") - F.col("left") <= 0.92 * w, "static").otherwise("track")
    videos = videos.withColumn("strategy", strategy)

    def fit(place: Column, most: int) -> Column:
        return F.bround(F.least(F.lit(float(most)), F.greatest(F.lit(0.0), place))).cast("bigint")

    fit_x, fit_y = (lambda c: fit(c - w / 2, most_x)), (lambda c: fit(c - h * bias, most_y))
    centre = F.col("strategy") == "centre"
    still = videos.filter("strategy <> 'track'").select(
        "video_id", "strategy", F.lit(0).cast("bigint").alias("t_ms"),
        F.when(centre, F.lit(most_x // 2)).otherwise(fit_x((F.col("left") + F.col("right")) / 2)).cast("bigint").alias("x"),
        F.when(centre, F.lit(int(min(most_y, max(0, source_h * bias - h / 2))))).otherwise(fit_y(F.col("mean_cy"))).cast("bigint").alias("y"),
    )
    moving = videos.filter("strategy = 'track'").select("video_id", "mean_cx", "mean_cy")
    path = frames.select("video_id", "t_ms").join(moving.select("video_id").hint("merge"), "video_id").join(at.select("video_id", "t_ms", "cx", "cy").hint("merge"), ["video_id", "t_ms"], "left")
    path = smooth_path(smooth_path(hold_last(path, moving), "cx"), "cy").select("video_id", "t_ms", fit_x(F.col("cx")).alias("x"), fit_y(F.col("cy")).alias("y"))
    return sized(still.unionByName(crop_keyframes(path).withColumn("strategy", F.lit("track"))))


def crop_at(probes: DataFrame, keyframes: DataFrame) -> DataFrame:
    """(video_id, probe_id, x, y): the crop's place at t, on the line between neighbouring keyframes; still before the first and after the last."""
    v = Window.partitionBy("video_id").orderBy("t_ms")
    spans = keyframes.select("video_id", F.col("t_ms").alias("t0"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("t_ms").over(v).alias("t1"), F.lead("x").over(v).alias("x1"), F.lead("y").over(v).alias("y1"))
    spans = spans.withColumn("until", F.coalesce("t1", "t0"))
    ends = keyframes.groupBy("video_id").agg(F.min("t_ms").alias("first"), F.max("t_ms").alias("last"))
    p = probes.select("video_id", "probe_id", F.col("t_ms").alias("p")).join(ends.hint("merge"), "video_id").withColumn("p", F.greatest("first", F.least("last", "p"))).drop("first", "last")
    hit = range_join(p, spans, ("p", "p"), ("t0", "until"), (F.col("p") >= F.col("t0")) & (F.col("t1").isNull() | (F.col("p") < F.col("t1"))))
    part = F.coalesce((F.col("p") - F.col("t0")) / (F.col("t1") - F.col("t0")), F.lit(0.0))
    return hit.select("video_id", "probe_id", (F.col("x0") + part * F.coalesce(F.col("x1") - F.col("x0"), F.lit(0))).alias("x"), (F.col("y0") + part * F.coalesce(F.col("y1") - F.col("y0"), F.lit(0))).alias("y"))
