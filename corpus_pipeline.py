"""A corpus pipeline of five operators of spokenframe.llm, in this order: toxic
documents go, exact copies go, near copies go, personal data is masked, and
what is left is packed into training sequences.

Each stage works on all rows its predecessor kept; all but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spokenframe.llm import exact_dedup, near, packing, pii, shared, tokens, toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores under one half stay."""
    labels = shared.read(spark, sf_dir, "labels")
    score, toxic = (shared.free_name(docs, name) for name in ("toxicity", "toxic"))
    return toxicity.toxicity(docs, labels, names=(score, toxic)).filter(F.col(toxic) == 0).select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that word-shingle similarity links stays."""
    return near.keep_one(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is masked; n_chars follows."""
    return pii.masked(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: its place in a sequence of at most 4096 tokens."""
    pieces = packing.token_pieces(docs, tokens.tokenizer_file("word_bpe_49k.json"), 1)
    return packing.pack(pieces)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("pii", mask_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: A trained model decides in the first stage, which SQL can't express; tests/llm has the brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again."""
    docs = shared.read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared.written(docs, f"stage-{name}")
    return docs
