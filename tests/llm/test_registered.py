"""The registered queries on tables of a few rows: columns, types, and values by brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from spokenframe.llm import queries, tokens

from .conftest import words
from .test_pii import base

KINDS = ("email", "ip", "card", "phone")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    texts = [None, "", "  \n ", "Write a.b@c.org, call +1 (269) 555-3296 from 10.0.0.255 (not 1.2.3.256) with 4111 1111 1111 1111 é é@x.y", "日本語 ñandú"]
    texts += [words(k, 40, 30) for k in range(40)] + [words(3, 40, 30)]
    rows = [(k, t, None if t is None else ("xx", "yy")[k % 2], "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, k % 2) for k in range(len(texts))], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    r = np.random.default_rng(0)
    vectors = [(k, [float(np.float32(x)) for x in r.normal(size=4)]) for k in range(60)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return folder, dict(enumerate(texts)), dict(vectors)


def rows_of(spark, name, folder):
    df = queries.QUERIES[name](spark, folder)
    return df, {x[0]: x for x in df.collect()}


def types(df):
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def crc(i):
    return zlib.crc32(str(i).encode())


def test_op1(spark, tables):
    df, got = rows_of(spark, "op1_pii", tables[0])
    assert list(types(df).items())[:7] == [("doc_id", "bigint"), *[(f"n_{k}", "bigint") for k in KINDS], ("base_sha256", "string"), ("spans", "string")]
    for i, t in tables[1].items():
        spans = sorted(base(t or ""), key=lambda s: (KINDS.index(s[0]), s[1]))
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest() and set(text.split(",")) - {""} <= set(got[i].spans.split(","))
        assert [got[i][f"n_{k}"] for k in KINDS] == [sum(s[0] == k for s in spans) for k in KINDS]


def test_op2(spark, tables):
    df, got = rows_of(spark, "op2_token_files", tables[0])
    assert list(types(df).items())[:4] == [(c, "bigint") for c in ("doc_id", "start", "n_tokens", "ids_crc32")]
    lib, at = Tokenizer.from_file(tokens.tokenizer_file("byte_bpe_50k.json")), 0
    for i in sorted(tables[1]):
        ids = [*lib.encode(tables[1][i] or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_op3(spark, tables):
    df, got = rows_of(spark, "op3_lm_score", tables[0])
    assert {c: types(df)[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")} == {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"}
    toks = {i: [*re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "</s>"] for i, t in tables[1].items()}
    c = Counter(w for i, t in toks.items() if crc(i) % 10 for w in t)
    n = sum(c.values())
    for i, t in toks.items():
        x = got[i]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (crc(i) % 10 == 0, len(t), sum(w in c for w in t), n) and x.score < 0
        assert x.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (len(c) + 1))) for w in t))


def test_op4_and_op10(spark, tables):
    df, got = rows_of(spark, "op4_language_id", tables[0])
    assert list(types(df).items())[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    assert all(x.held_out == (crc(i) % 4 == 2) and 0 <= x.score <= 1 and (x.lang_pred == "und") == (i < 3) for i, x in got.items()) and len(got) == len(tables[1])
    df, got = rows_of(spark, "op10_toxicity", tables[0])
    assert list(types(df).items())[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    assert all(x.held_out == (crc(i) % 5 == 0) and 0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for i, x in got.items()) and len(got) == len(tables[1])


def test_op5(spark, tables):
    df = queries.QUERIES["op5_exact_topk"](spark, tables[0])
    assert list(types(df).items())[:4] == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    v = {i: np.floor(256 * np.array(x)) for i, x in tables[2].items()}
    want = {(q, r, c, -s) for q in (0, 50) for r, (s, c) in enumerate(sorted((-int(v[q] @ v[c]), c) for c in v if c != q)[:5], 1)}
    assert {(x.query_id, x["rank"], x.vec_id, x.score) for x in df.collect()} == want


def test_op6(spark, tables):
    df = queries.QUERIES["op6_best_fit_packing"](spark, tables[0])
    assert {c: types(df)[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")} == {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    lib = Tokenizer.from_file(tokens.tokenizer_file("word_bpe_49k.json"))
    ids = {i: [*lib.encode(t or "", add_special_tokens=False).ids, 1] for i, t in tables[1].items()}
    got = df.collect()
    assert {(x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got} == {(i, 0, 0, len(t), zlib.crc32(np.array(t, "<u4").tobytes())) for i, t in ids.items()}
    assert len({x.sequence_id for x in got}) == -(-sum(map(len, ids.values())) // 4096)  # no packing needs fewer
    for k in {x.sequence_id for x in got}:
        own = sorted((x.offset, x.length) for x in got if x.sequence_id == k)
        assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own]])[:-1].tolist() and sum(n for _, n in own) <= 4096


def test_op7(spark, tables):
    df, got = rows_of(spark, "op7_exact_dedup", tables[0])
    assert list(types(df).items())[:5] == [("doc_id", "bigint"), ("keep_id", "bigint"), ("group_size", "bigint"), ("kept", "boolean"), ("text_sha256", "string")]
    bare = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t in tables[1].items()}
    for i, b in bare.items():
        group = [j for j, o in bare.items() if o == b]
        keep = min(group, key=lambda j: (-len(tables[1][j] or ""), j))
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (keep, len(group), keep == i, hashlib.sha256(b.encode()).hexdigest())


def test_op8_and_op9(spark, tables):
    _, got = rows_of(spark, "op8_sentencepiece", tables[0])
    assert len(got) == len(tables[1]) and all(x.same and x.merged_same and x.n_pieces <= x.n_merged for x in got.values())
    _, got = rows_of(spark, "op9_jaccard_join", tables[0])
    assert {i: (x.class_id, x.n_links) for i, x in got.items()} == {i: (8, 1) if i in (8, 45) else (0 if i < 3 else i, 0) for i in tables[1]}  # texts without words are one class without links


def test_op11_to_op13(spark, tables):
    from collections import Counter as Count

    from .test_curation import check_mix, plain_manifest, plain_variants

    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    rows = [(x.doc_id, x.text, x.lang, x.source, x.n_chars) for x in docs.collect()]
    df = queries.QUERIES["op11_source_mix"](spark, tables[0])
    assert types(df) == {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"}
    check_mix([(x[0], x[1], x[3]) for x in rows], df.join(docs.select("doc_id", "source"), "doc_id").collect())
    df = queries.QUERIES["op12_merkle_manifest"](spark, tables[0])
    assert list(types(df).items()) == [("doc_id", "bigint"), *[(c, "string") for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", "boolean")]
    assert Count(map(tuple, df.collect())) == plain_manifest(rows)
    df = queries.QUERIES["op13_spelling_variants"](spark, tables[0])
    assert list(types(df).items()) == [*[(c, "string") for c in ("word", "form", "root")], *[(c, "bigint") for c in ("n", "n_near", "form_n")]]
    assert {tuple(x) for x in df.collect()} == plain_variants([(x[0], x[1]) for x in rows])
