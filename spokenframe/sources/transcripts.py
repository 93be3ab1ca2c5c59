"""Transcript documents as tables, and tables as artifacts and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lexicons import NON_SPEECH
from ..functions.text import clock, text, timecode

WORD = "struct<word:string,start:double,end:double,probability:double>"
TRANSCRIPT = f"video_id bigint, language string, language_probability double, duration double, model string, segments array<struct<id:bigint,start:double,end:double,text:string,words:array<{WORD}>,avg_logprob:double,no_speech_prob:double,speaker:string>>"


def ms(seconds: Column) -> Column:
    return F.round(seconds * 1000).cast("bigint")


def read_transcripts(spark: SparkSession, path: str, *, one_per_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """(segments, words) of JSON documents, one a video, each a file or a line; times become whole milliseconds."""
    docs = spark.read.schema(TRANSCRIPT).option("multiLine", not one_per_line).json(path)
    segments = docs.select("video_id", F.explode("segments").alias("s")).select("video_id", F.col("s.id").alias("segment_id"), "s.start", "s.end", "s.text", "s.words", "s.speaker")
    return split_words(filter_speech(segments))


def filter_speech(segments: DataFrame, *, renumber: bool = True) -> DataFrame:
    """segments without blank texts and mere sound tags; words without text or time go, others are trimmed; ids count from 0 again."""
    words = F.transform(F.filter("words", lambda w: (F.trim(text(w["word"])) != "") & w["start"].isNotNull() & w["end"].isNotNull()), lambda w: w.withField("word", F.trim(w["word"])))
    rows = segments.filter((F.trim(text(F.col("text"))) != "") & ~F.col("text").rlike(NON_SPEECH)).withColumn("text", F.trim("text")).withColumn("words", F.coalesce(words, F.array().cast(segments.schema["words"].dataType)))
    if renumber:
        rows = rows.withColumn("segment_id", (F.row_number().over(Window.partitionBy("video_id").orderBy("start", "segment_id")) - 1).cast("bigint"))
    return rows


def split_words(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, words) in milliseconds from nested segments in seconds; word_idx counts a video's words."""
    flat = segments.select("video_id", "segment_id", ms(F.col("start")).alias("start_ms"), ms(F.col("end")).alias("end_ms"), "text", *(["speaker"] if "speaker" in segments.columns else []))
    words = segments.select("video_id", "segment_id", F.posexplode("words").alias("word_pos", "w")).select("video_id", "segment_id", F.col("word_pos").cast("bigint").alias("word_pos"), "w.word", ms(F.col("w.start")).alias("start_ms"), ms(F.col("w.end")).alias("end_ms"), "w.probability")
    index = F.row_number().over(Window.partitionBy("video_id").orderBy("segment_id", "word_pos")) - 1
    return flat, words.withColumn("word_idx", index.cast("bigint"))


def full_text(segments: DataFrame) -> DataFrame:
    """(video_id, text): the segments' texts, trimmed, in order."""
    parts = F.array_sort(F.collect_list(F.struct("segment_id", F.trim("text").alias("t"))))
    return segments.groupBy("video_id").agg(F.array_join(F.filter(F.transform(parts, lambda x: x["t"]), lambda t: t != ""), " ").alias("text"))


def write_artifact(rows: DataFrame, path: str, key: str = "video_id") -> None:
    """A result for each video, in a folder of its own; a job's files appear together."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def evolve_schema(rows: DataFrame, schema: T.StructType, defaults: dict[str, object]) -> DataFrame:
    """rows with every column of schema: those missing, and nulls in them, take their default."""
    for f in schema.fields:
        have = F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)
        rows = rows.withColumn(f.name, F.coalesce(have, F.lit(defaults[f.name]).cast(f.dataType)) if f.name in defaults else have)
    return rows.select(*[f.name for f in schema.fields], *[c for c in rows.columns if c not in schema.names])


def export_files(clips: DataFrame, abouts: DataFrame) -> DataFrame:
    """(path, content): Info, Context, Hooks and Caption of each clip, one About for each source; empty contents give no file.

    clips: (video_id, stem, index, start_ms, end_ms, text, context, hooks, caption); abouts: (video_id, stem, about).
    """
    folder = F.concat("stem", F.lit("/Clip_"), F.format_string("%02d", F.col("index")))
    info = F.concat(F.lit("Start: "), timecode(F.col("start_ms")), F.lit("\nEnd: "), timecode(F.col("end_ms")), F.lit("\nLength: "), clock(F.col("end_ms") - F.col("start_ms")), F.lit("\n\n"), F.when(F.trim(text(F.col("text"))) == "", "(no speech detected)").otherwise(F.trim("text")), F.lit("\n"))
    files = F.array(*[F.struct(F.concat(folder, F.lit(f"/{name}.txt")).alias("path"), content.alias("content")) for name, content in (("Info", info), ("Context", F.col("context")), ("Hooks", F.col("hooks")), ("Caption", F.col("caption")))])
    each = clips.select(F.explode(files).alias("f")).select("f.path", "f.content")
    about = abouts.select(F.concat("stem", F.lit("/About.txt")).alias("path"), F.col("about").alias("content"))
    return each.unionByName(about).filter(F.trim(text(F.col("content"))) != "")
