import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns that an operator might use inside, or return.
CLASH = ["uid", "run", "sha", "best", "n", "keep_id", "kept", "group_size", "score", "predicted", "x", "spans", "piece", "start", "length", "salt", "rank", "bucket", "cid", "sig", "root", "digest", "cluster", "size", "copies", "class_id", "blk", "half", "tie", "_id", "_sha", "_len", "_nth", "toxic", "key"]


def words(seed, n, vocabulary=60):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, and many further columns."""
    long = words(1, 30_000, 500)
    rows = [
        (1, "One two three four five six. Call +1 (269) 555-3296 now", "en", "s", 50), (2, None, "en", None, None), (3, "", None, "s", 0), (4, long, "de", "s", len(long)),
        (4, long, "de", "s", len(long)), (None, "no id here", "fr", "s", 10), (None, None, None, None, None), (5, "One two  three four five six. Call +1 (269) 555-3296 now", "en", "s", 50),
        (6, "  \n ", "en", "s", 4), (7, "日本語 ñandú <|endoftext|> x@y.zz", "es", "s", 20), (8, "1234", "en", "s", 4), (9, "One two three", "en", "s", 13),
    ]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(7) for c in CLASH})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
