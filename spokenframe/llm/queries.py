"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import curation_queries, ngram_lm, shared
from .exact_dedup import exact_dedup
from .langid import identify
from .pii import BASE_KINDS, joined, pii_spans
from .near import near_join
from .packing import pack, token_pieces
from .pieces import round_trip
from .token_files import read_tokens, write_tokens
from .tokens import tokenizer_file
from .topk import exact_topk
from .toxicity import toxicity


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(shared.read(spark, sf_dir, "documents").select("doc_id", "text"))


OP7_SQL = r"""
with t as (select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as s from documents),
k as (select *, row_number() over (partition by s order by n desc, doc_id) as r, count(*) over (partition by s) as c, first_value(doc_id) over (partition by s order by n desc, doc_id) as k from t)
select doc_id, k as keep_id, c as group_size, r = 1 as kept, s as text_sha256 from k
"""



def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_spans(shared.read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter(F.transform(base, lambda s: s["kind"]), (lambda k: lambda x: x == k)(k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(shared.read(spark, sf_dir, "documents"))
    return found.select("doc_id", (shared.id_crc(F.col("doc_id")) % 4 == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.read(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity(docs, shared.read(spark, sf_dir, "labels"))
    return found.select("doc_id", (shared.id_crc(F.col("doc_id")) % 5 == 0).alias("held_out"), "score", "predicted")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_tokens(shared.read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), 2)
    return read_tokens(files)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_pieces(shared.read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), 1))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join(shared.read(spark, sf_dir, "documents")).drop("text_hash")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.read(spark, sf_dir, "documents")
    model = ngram_lm.train(docs, shared.id_crc(F.col("doc_id")) % 10 != 0)
    found = ngram_lm.score(docs, model)
    return found.withColumn("held_out", shared.id_crc(F.col("doc_id")) % 10 == 0)


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = shared.read(spark, sf_dir, "embeddings")
    return exact_topk(vectors, vectors.filter("vec_id % 50 = 0"))


OP5_SQL = r"""
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""

def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(shared.read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


QUERIES = {"op1_pii": op1_pii, "op2_token_files": op2_token_files, "op3_lm_score": op3_lm_score, "op4_language_id": op4_language_id, "op5_exact_topk": op5_exact_topk, "op6_best_fit_packing": op6_best_fit_packing, "op7_exact_dedup": op7_exact_dedup, "op8_sentencepiece": op8_sentencepiece, "op9_jaccard_join": op9_jaccard_join, "op10_toxicity": op10_toxicity}
SQL = {"op5_exact_topk": OP5_SQL, "op7_exact_dedup": OP7_SQL}
QUERIES |= curation_queries.QUERIES
SQL |= curation_queries.SQL
