"""Upserts of a stream: batches that come again, that died before their commit, and a query that starts anew."""

import random

from pyspark.sql import functions as F

from spokenframe.functions import text as T
from spokenframe.streaming import upserts

SCHEMA = "job int, ts bigint, status string"


def plain(rows):
    best = {}
    for r in rows:
        if r[0] not in best or (r[1], r[2]) > (best[r[0]][1], best[r[0]][2]):
            best[r[0]] = r
    return sorted(best.values())


def table_rows(spark, table):
    return sorted(map(tuple, upserts.read_table(spark, table, SCHEMA).collect()))


def test_batches_again_and_batches_that_died(spark, tmp_path):
    r = random.Random(1)
    rows = [[(r.randrange(60), r.randrange(1000), r.choice("abc")) for _ in range(80)] for _ in range(4)]
    table = f"file://{tmp_path}/table"
    put = upserts.upsert_into(table, ["job"], ["ts", "status"], buckets=4)
    batch = lambda k: spark.createDataFrame(rows[k], SCHEMA)
    assert table_rows(spark, table) == []
    put(batch(0), 0)
    put(batch(1), 1)
    seen = table_rows(spark, table)
    assert seen == plain(rows[0] + rows[1])
    put(batch(2), 1)  # a number that was committed changes nothing
    put(batch(0), 0)
    assert table_rows(spark, table) == seen
    # an attempt that wrote rows and half a list, but no commit
    batch(3).withColumn("bucket", F.lit(1)).write.partitionBy("bucket").parquet(f"{table}/data/2")
    spark.createDataFrame([(1, 2)], "bucket int, batch bigint").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{table}/commits/2")
    assert table_rows(spark, table) == seen
    put(batch(2), 2)
    assert table_rows(spark, table) == plain(rows[0] + rows[1] + rows[2])
    put(spark.createDataFrame([], SCHEMA), 3)
    put(spark.createDataFrame([(1, 5000, "z")], SCHEMA), 4)
    assert table_rows(spark, table) == plain(rows[0] + rows[1] + rows[2] + [(1, 5000, "z")])


def test_a_query_that_starts_anew(spark, tmp_path):
    r = random.Random(2)
    rows = [[(r.randrange(30), r.randrange(1000), r.choice("ab")) for _ in range(40)] for _ in range(5)]
    folder, table = f"file://{tmp_path}", f"file://{tmp_path}/table"

    def go(put):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{folder}/in")
        return stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()

    put = upserts.upsert_into(table, ["job"], ["ts", "status"])
    for k in range(3):
        spark.createDataFrame(rows[k], SCHEMA).coalesce(1).write.mode("append").json(f"{folder}/in")
    left = [2]

    def dies_after_its_commit(batch, number):
        put(batch, number)
        left[0] -= 1
        if not left[0]:
            raise RuntimeError("lost")

    try:
        go(dies_after_its_commit).awaitTermination()
    except Exception as e:  # noqa: BLE001
        assert "lost" in str(e)
    for k in range(3, 5):
        spark.createDataFrame(rows[k], SCHEMA).coalesce(1).write.mode("append").json(f"{folder}/in")
    seen: list = []
    go(lambda batch, number: (seen.append(number), put(batch, number))).awaitTermination()
    assert seen[0] == 1  # the committed batch came again
    assert table_rows(spark, table) == plain([x for part in rows for x in part])


def test_truncated_words_are_counted(spark):
    words = spark.createDataFrame([(1, 0, 0, '"Tifa,'), (1, 0, 1, "the"), (1, 1, 2, "TIFA's"), (1, 1, 3, "tifa"), (2, 0, 0, "Tifa"), (1, 1, 4, "--"), (1, 1, 5, "x-tifa")], "video_id long, segment_id long, word_idx long, word string")
    mapping = spark.createDataFrame([(1, "tifa", "antifa")], "video_id long, short string, long string")
    got = {(x.video_id, x.word_idx): x.word for x in T.truncated_words(words, mapping).collect()}
    assert got == {(1, 0): '"Antifa,', (1, 3): "antifa"}
