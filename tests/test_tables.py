import json
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from spokenframe.operators import maintenance as M
from spokenframe.operators import models as X
from spokenframe.operators import speakers as K
from spokenframe.sources import transcripts as A
from spokenframe.streaming import feeds


def test_read_transcripts(spark, tmp_path):
    doc = {"video_id": 7, "language": "en", "duration": 9.0, "segments": [
        {"id": 0, "start": 0.0, "end": 1.0, "text": " [Applause] ", "words": []},
        {"id": 1, "start": 1.0, "end": 2.5, "text": " Hello there. ", "words": [{"word": " Hello", "start": 1.0, "end": 1.35}, {"word": None, "start": 1.4, "end": 1.5}, {"word": " there.", "start": 1.6, "end": 2.5}]},
        {"id": 2, "start": 3.0, "end": 4.0, "text": "", "words": None}, {"id": 3, "start": 5.0, "end": 6.0, "text": "Bye", "words": None}]}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    segs, words = A.read_transcripts(spark, str(tmp_path))
    assert [(x.segment_id, x.start_ms, x.text) for x in segs.orderBy("segment_id").collect()] == [(0, 1000, "Hello there."), (1, 5000, "Bye")]
    assert [(x.word_idx, x.word, x.end_ms) for x in words.orderBy("word_idx").collect()] == [(0, "Hello", 1350), (1, "there.", 2500)]
    assert A.full_text(segs).first().text == "Hello there. Bye"


def test_exported_paths_stay_apart_from_the_hundredth_clip_on(spark):
    clips = spark.range(1, 1101).select(F.lit(1).alias("video_id"), F.lit("v").alias("stem"), "id", F.col("id").cast("int").alias("index"), (F.col("id") * 1000).alias("start_ms"), (F.col("id") * 1000 + 500).alias("end_ms"), F.lit("t").alias("text"), F.lit("c").alias("context"), F.lit("").alias("hooks"), F.lit(None).cast("string").alias("caption"))
    abouts = spark.createDataFrame([(1, "v", "about")], "video_id long, stem string, about string")
    paths = [x.path for x in A.export_files(clips, abouts).collect()]
    assert sorted(paths) == sorted([f"v/Clip_{k:02d}/{name}.txt" for k in range(1, 1101) for name in ("Info", "Context")] + ["v/About.txt"])


def test_artifacts_replace_only_their_videos(spark, tmp_path):
    path = str(tmp_path / "art")
    A.write_artifact(spark.createDataFrame([(1, "a"), (2, "b")], "video_id long, x string"), path)
    A.write_artifact(spark.createDataFrame([(2, "c")], "video_id long, x string"), path)
    assert {(x.video_id, x.x) for x in spark.read.parquet(path).collect()} == {(1, "a"), (2, "c")}


def test_updates(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "k long, s string, n long")
    got = M.update_by_key(rows, spark.createDataFrame([(1, None, 3), (9, "z", 1)], "k long, s string, n long"), ["k"], ["s", "n"])
    assert {tuple(x) for x in got.collect()} == {(1, "a", 3), (2, "b", 5)}


def test_adjustments(spark):
    rows = spark.createDataFrame([(-1, 5), (5, 5), (0, 99), (0, 5)], "a long, b long").select(M.adjust_request(F.col("a"), F.col("b"), F.lit(50)).alias("why")).collect()
    assert [x.why is None for x in rows] == [False, False, False, True]


def test_json_repair(spark):
    answers = ['{"a": [{"x": 1}, {"x": 2}]}', 'Sure:\n```json\n{"a": [{"x": 3}]}\n``` ok', '{"a": [{"x": 4}, {"x": "brace } in', 'note {"a": [{"x": 5}]} end', "nothing", None]
    rows = spark.createDataFrame(list(enumerate(answers)), "k int, s string")
    got = {x.k: [y.x for y in x.parsed.a] if x.parsed and x.parsed.a else None for x in X.parse_model_json(rows, "s", "a array<struct<x:int>>").collect()}
    assert got == {0: [1, 2], 1: [3], 2: [4], 3: [5], 4: None, 5: None}


def test_model_calls_fail_alone(spark):
    asked = spark.createDataFrame([(k, "s", f"p{k}", "") for k in range(6)], "request_id long, system string, prompt string, schema string")

    def call(system, prompt, schema):
        if prompt.startswith("p3"):
            raise RuntimeError("no")
        return prompt.upper()

    got = {x.request_id: x for x in X.model_map(asked, call, concurrency=2).collect()}
    assert got["1"].response == "P1" and got["1"].error is None and got["3"].error == "RuntimeError: no"
    assert all(x.error == "no model" for x in X.model_map(asked, None).collect())


def test_diffs(spark):
    rows = spark.createDataFrame([(1, "a b c d e", "a x c d e f"), (2, "a b c d e f", "a b")], "video_id long, old_text string, new_text string")
    got = {x.video_id: (x.kept, x.changed) for x in M.transcript_diff(rows).collect()}
    assert got == {1: (True, 2), 2: (False, 4)}


def test_speakers(spark):
    r = np.random.default_rng(1)
    rows = [(v, s, [float(x) for x in r.normal(size=8) * 0.2 + (3 if (s % 2 and v == 1) else -3 if v == 1 else 0)]) for v in (1, 2) for s in range(20)]
    rows.append((3, 0, [1.0] * 8))
    got = {(x.video_id, x.segment_id): x.speaker for x in K.cluster_speakers(spark.createDataFrame(rows, "video_id long, segment_id long, embedding array<double>")).collect()}
    assert {got[1, s] for s in range(0, 20, 2)} == {"Speaker A"} and {got[1, s] for s in range(1, 20, 2)} == {"Speaker B"}
    assert got[3, 0] == "Speaker A"
    frames = spark.createDataFrame([(1, s, k, [9.0, float(k), 1.0]) for s, n in ((0, 6), (1, 3)) for k in range(n)], "video_id long, segment_id long, frame_idx long, coeffs array<double>")
    out = {x.segment_id: x.embedding for x in K.segment_embedding(frames).collect()}
    assert out[1] is None and out[0][0] == 2.5 and len(out[0]) == 4


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "clip_selected", "2024-01-01 00:10:00"), (1, "clip_selected", "2024-01-01 00:50:00"), (1, "unknown", "2024-01-01 00:20:00"), (1, "clip_selected", "2024-01-01 05:00:00"), (2, "clip_rejected", "2024-01-01 09:00:00")], "project_id long, event string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    assert stream.isStreaming
    q = feeds.feedback_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((x.project_id, x.n) for x in spark.table("counts").collect()) == [(1, 1), (1, 2), (2, 1)]
    seg = spark.createDataFrame([(1, 0, 0.0, 1.0, " (music) ", None), (1, 1, 1.0, 2.0, " Hi ", [(" Hi", 1.0, 1.2)])], "video_id long, segment_id long, start double, end double, text string, words array<struct<word:string,start:double,end:double>>")
    seg.write.parquet(str(tmp_path / "seg"))
    q = feeds.segments_stream(spark.readStream.schema(seg.schema).parquet(str(tmp_path / "seg"))).writeStream.format("memory").queryName("segs").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert [(x.segment_id, x.text, x.words[0].word) for x in spark.table("segs").collect()] == [(1, "Hi", "Hi")]
    updates = spark.createDataFrame([(1, "2024-01-01", 1, "running", 0.1), (1, "2024-01-01", 2, "running", 0.5), (2, "2024-01-02", 1, "completed", 1.0)], "job_id long, ts string, seq long, status string, progress double")
    assert {(x.job_id, x.progress) for x in feeds.job_latest(updates).collect()} == {(1, 0.5), (2, 1.0)}


def test_the_shared_folder(spark):
    """A folder without a scheme belongs to the default store; on one machine a folder is made, a cluster must name one."""
    from spokenframe.sources import shared

    def session(master: str, folder: str | None):
        get = lambda name, default=None: folder
        context = SimpleNamespace(master=master, applicationId=f"app-{master}", getConf=lambda: SimpleNamespace(get=get), _jvm=spark.sparkContext._jvm, _jsc=spark.sparkContext._jsc)
        return SimpleNamespace(conf=SimpleNamespace(get=get), sparkContext=context)

    assert shared.shared_dir(session("spark://x:7077", "/shared/x")) == "file:/shared/x"
    assert shared.shared_dir(session("spark://x:7077", "hdfs://n/x")) == "hdfs://n/x"
    made = shared.shared_dir(session("local[2]", None))
    assert made.startswith("file:///") and shared.shared_dir(session("local[2]", None)) == made
    with pytest.raises(ValueError):
        shared.shared_dir(session("spark://x:7077", None))
    assert shared.written(spark.range(3), "x").count() == 3


def test_clusterings_like_merging_the_closest_pair(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(40, 3)) + 4 * (np.arange(40) % 3)[:, None]
    groups = {k: [k] for k in range(40)}
    cost = lambda a, b: ((x[a].mean(0) - x[b].mean(0)) ** 2).sum() * len(a) * len(b) / (len(a) + len(b))
    labels = K.ward_labels(x, 6)
    while len(groups) > 1:
        i, j = min(((i, j) for i in groups for j in groups if i < j), key=lambda p: cost(groups[p[0]], groups[p[1]]))
        groups[i] += groups.pop(j)
        if len(groups) <= 6:
            assert {frozenset(np.flatnonzero(labels[len(groups)] == c)) for c in set(labels[len(groups)])} == {frozenset(g) for g in groups.values()}
