"""Transcript folders as a data source: whole, and as a stream that starts anew."""

import json

from spokenframe.sources import arrivals
from spokenframe.sources.transcripts import filter_speech, split_words


def put(folder, video, n):
    segments = [{"id": k, "start": k, "end": k + 0.5, "text": f" text {video} {k} ", "words": [{"word": " a", "start": k, "end": k + 0.2}, {"word": "b", "start": None, "end": 1}], "speaker": None} for k in range(n)]
    (folder / f"v{video}.json.part").write_text(json.dumps({"video_id": video, "segments": segments}))
    (folder / f"v{video}.json.part").rename(folder / f"v{video}.json")


def keys(df):
    return sorted((x.video_id, x.segment_id) for x in df.select("video_id", "segment_id").collect())


def test_a_folder(spark, tmp_path):
    spark.dataSource.register(arrivals.TranscriptFiles)
    folder = tmp_path / "in"
    folder.mkdir()
    assert spark.read.format("transcripts").load(f"file://{folder}").count() == 0
    for v, n in ((1, 3), (2, 0), (3, 2)):
        put(folder, v, n)
    (folder / "_notes.json").write_text("no transcript")
    rows = spark.read.format("transcripts").load(f"file://{folder}")
    assert keys(rows) == [(1, 0), (1, 1), (1, 2), (3, 0), (3, 1)]
    segments, words = split_words(filter_speech(rows))
    assert sorted((x.video_id, x.segment_id, x.start_ms, x.text) for x in segments.collect())[4] == (3, 1, 1000, "text 3 1")
    assert sorted((x.video_id, x.word_idx, x.word, x.start_ms) for x in words.collect())[-1] == (3, 1, "a", 1000)


def test_a_stream_that_starts_anew(spark, tmp_path):
    spark.dataSource.register(arrivals.TranscriptFiles)
    folder = tmp_path / "in"
    folder.mkdir()

    def go():
        rows = spark.readStream.format("transcripts").load(f"file://{folder}")
        query = rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").start()
        query.processAllAvailable()
        query.stop()
        return keys(spark.read.schema(rows.schema).parquet(f"{tmp_path}/out"))

    put(folder, 1, 2)
    put(folder, 2, 1)
    assert go() == [(1, 0), (1, 1), (2, 0)]
    assert go() == [(1, 0), (1, 1), (2, 0)]
    put(folder, 3, 2)
    assert go() == [(1, 0), (1, 1), (2, 0), (3, 0), (3, 1)]
    # a batch whose offsets were logged, but whose commit was lost, is read again from the same offsets
    commits = sorted((tmp_path / "state" / "commits").glob("[0-9]*"))
    commits[-1].unlink()
    for crc in (tmp_path / "state" / "commits").glob(f".{commits[-1].name}.crc"):
        crc.unlink()
    put(folder, 4, 1)
    assert go() == [(1, 0), (1, 1), (2, 0), (3, 0), (3, 1), (4, 0)]


def test_many_small_documents_are_dealt_to_many_tasks():
    folder = arrivals._Folder({"path": "file:///none"})
    parts = folder.parts([(k, f"v{k}.json", 10) for k in range(2000)])
    assert len(parts) > 4 and [p for x in parts for p in x.paths] == [f"v{k}.json" for k in range(2000)]
