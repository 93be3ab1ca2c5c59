"""Queries against their SQL on rows where both once differed."""

import duckdb
import pytest

import __spark_entry__ as e

TEXTS = ["inächst der Stein", "Vi ê ouré la mé eur", "he said \"my dog ran off\" to all", "watch this very big red dog", "это очень длинный текст here now", "the cat sat on my mat here", " ".join(["the x of" + " zz" * 25] * 8 + ["and or or"] + ["zz"] * 29)]


def both(spark, folder, name, tables):
    """(rows of the query, rows of its SQL) over tables: name -> (rows, schema)."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet/*.parquet')")
    return sorted(map(tuple, e.queries()[name](spark, str(folder)).collect()), key=str), sorted(con.execute(e.oracle_sql()[name]).fetchall(), key=str)


@pytest.mark.parametrize("name", ["e04_confrontation_score", "e12_hook_is_usable"])
def test_words_end_at_no_letter_with_an_accent(spark, tmp_path, name):
    talk = [(k, 0, "user", t) for k, t in enumerate(TEXTS)]
    got, want = both(spark, tmp_path, name, {"conversations": (talk, "conv_id long, turn long, role string, text string")})
    assert got == want and len(got) == len(TEXTS)
    if name.startswith("e12"):
        assert [x[2] for x in got] == ["too short (3 words)", "", "", "generic phrase 'watch this'", "not English", "first person", "too long (256 words)"]
    else:
        assert got[0][2] == 0.0  # "in" is no word of "inächst"
        assert got[6][2] == 0.460938  # 8.85 hits in 256 words: 0.4609375


def test_layout_where_the_characters_fit_exactly(spark):
    from pyspark.sql import functions as F

    from spokenframe.functions import text as T

    rows = [(31 * n * k, 43 * k, n) for k in range(1, 30) for n in range(12, 43)]
    got = spark.createDataFrame(rows, "x long, w long, n int").withColumn("chars", T.chars_per_line(F.col("x"), F.col("w"))).collect()
    assert all(r.chars == r.n for r in got)
