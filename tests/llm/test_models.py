import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spokenframe.llm import langid, ngram_lm, shared, toxicity

from .conftest import words


@pytest.mark.parametrize(("chunk", "cell"), [(ngram_lm.CHUNK, ngram_lm.CELL), (50, 100)])  # whole; in pieces, most words spread
def test_kneser_ney_like_brute_force(spark, monkeypatch, chunk, cell):
    monkeypatch.setattr(ngram_lm, "CHUNK", chunk)
    monkeypatch.setattr(ngram_lm, "CELL", cell)
    rows = [(k, words(k, 40, 30)) for k in range(60)] + [(100, None), (101, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = ngram_lm.train(docs, shared.id_crc(F.col("doc_id")) % 10 != 0, buckets=5)
    got = {x.doc_id: x for x in ngram_lm.score(docs, model).collect()}
    texts = {i: [*re.findall("[^ ]+", t or ""), "</s>"] for i, t in rows}
    train = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10 != 0]
    c1 = Counter(w for t in train for w in t)
    c3 = Counter(p for t in train for p in zip(["<s>", *t], t, t[1:]))
    c2 = Counter((b, c) for _, b, c in c3) + Counter(("<s>", t[0]) for t in train)
    before = Counter(b for _, b in c2)
    after = defaultdict(lambda: [0, 0, 0, 0])
    for (*a, _), c in [*c2.items(), *c3.items()]:
        after[tuple(a)][0] += c
        after[tuple(a)][min(c, 3)] += 1
    of = lambda c: [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
    d1, d2, d3 = (ngram_lm.discounts(of(c)) for c in (before, c2, c3))
    cut = lambda c, d: d[min(c, 3) - 1] if c else 0
    total, n = sum(before.values()), sum(c1.values())
    rest = sum(cut(c, d1) for c in before.values()) / total

    def p1(w):
        return max(before[w] - cut(before[w], d1), 0) / total + rest / (len(c1) + 1)

    def p2(a, b):
        if (a,) not in after:
            return p1(b)
        s = after[a,]
        return max(c2[a, b] - cut(c2[a, b], d2), 0) / s[0] + sum(x * y for x, y in zip(d2, s[1:])) / s[0] * p1(b)

    def p3(a, b, c):
        if (a, b) not in after:
            return p2(b, c)
        s = after[a, b]
        return (max(c3[a, b, c] - cut(c3[a, b, c], d3), 0) + sum(x * y for x, y in zip(d3, s[1:])) * p2(b, c)) / s[0]

    for i, t in texts.items():
        x = got[i]
        assert (x.n_tokens, x.n_known, x.train_tokens) == (len(t), sum(w in c1 for w in t), n)
        assert x.score == pytest.approx(math.log10(p2("<s>", t[0])) + sum(math.log10(p3(*x)) for x in zip(["<s>", *t], t, t[1:])))
        assert x.base_score == pytest.approx(sum(math.log10((c1[w] + 0.1) / (n + 0.1 * (len(c1) + 1))) for w in t))
    a, b, _ = max(c3, key=c3.get)
    assert sum(p3(a, b, w) for w in c1) + p3(a, b, "never") == pytest.approx(1)


def test_scores_of_odd_rows(odd_docs, no_docs):
    model = ngram_lm.train(odd_docs)
    assert ngram_lm.score(odd_docs, model).count() == odd_docs.count()
    none = ngram_lm.train(no_docs)
    got = ngram_lm.score(odd_docs, none).collect()
    assert all(x.n_known == 0 and math.isfinite(x.score) for x in got)
    assert ngram_lm.score(no_docs, model).count() == 0


def lang_rows(n):
    stems = {"xx": "ab ac ad", "yy": "mo no po", "zz": "ti vi zi"}
    return [(k, " ".join(stems[lang].split()[(k + j) % 3] for j in range(12)), lang) for k in range(n) for lang in [["xx", "yy", "zz"][k % 3]]]


def test_languages(spark, odd_docs, no_docs):
    docs = spark.createDataFrame(lang_rows(150), "doc_id bigint, text string, lang string")
    got = langid.identify(docs).join(docs, "doc_id").filter(shared.id_crc(F.col("doc_id")) % 4 == 2).collect()
    assert got and all(x.lang_pred == x.lang and 0 <= x.score <= 1 for x in got)
    odd = langid.identify(odd_docs).collect()
    assert len(odd) == odd_docs.count()
    assert all(x.lang_pred == "und" for x in odd if x.doc_id in (2, 3, 6, 8))
    assert langid.identify(no_docs).count() == 0


def test_sixty_five_languages(spark):
    """Every language is learned, those of large ids too."""
    r = random.Random(2)
    langs = {f"l{k:02d}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(4)] for k in range(65)}
    rows = [(f"{k:04d}-{j}", " ".join(r.choice(w) for _ in range(30)), lang) for k, (lang, w) in enumerate(langs.items()) for j in range(8)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id string, text string, lang string")).collect()
    want = {i: lang for i, _, lang in rows}
    assert np.mean([x.lang_pred == want[x.doc_id] for x in got]) > 0.98 and {x.lang_pred for x in got} == set(langs)


def test_decoding_like_a_plain_search():
    r = np.random.default_rng(3)
    x, y = r.random((60, 32)).astype(np.float32), [f"l{k % 5}" for k in range(60)]
    model = langid.fit_codes(x, y, steps=20)
    at, score = model.decode(x)
    for row, a, s in zip(x, at, score, strict=True):
        f = [float(row @ model.weight[:, b] + model.bias[b]) for b in range(model.code.shape[1])]
        cost = [sum(math.log1p(math.exp(-v * c)) for v, c in zip(f, code)) / len(f) * 4 for code in model.code]
        like = [math.exp(min(cost) - c) for c in cost]
        assert cost[a] == pytest.approx(min(cost), rel=1e-4) and s == pytest.approx(max(like) / sum(like), rel=1e-3)


def test_codewords_differ():
    for n in (1, 2, 3, 5, 7, 12, 40):
        code = langid.codewords(n)
        assert len(code) == n and len({tuple(c) for c in code}) == n


def test_toxicity(spark, odd_docs, no_docs):
    rows = [(k, words(k, 30, 200) + (" you idiot , you moron !" if k % 5 == 0 else ""), int(k % 5 == 0)) for k in range(600)]
    data = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    labels = data.select("doc_id", "toxic").union(spark.createDataFrame([(None, 1), (3, None)], "doc_id bigint, toxic int"))
    got = toxicity.toxicity(data.select("doc_id", "text"), labels).join(data.select("doc_id", "toxic"), "doc_id").filter(shared.id_crc(F.col("doc_id")) % 5 == 0).collect()
    assert got and np.mean([x.predicted == x.toxic for x in got]) > 0.97
    odd = toxicity.toxicity(odd_docs, labels).collect()
    assert len(odd) == odd_docs.count() and all(0 <= x.score <= 1 for x in odd)
    assert toxicity.toxicity(odd_docs, labels.limit(0)).filter("predicted = 1").count() == 0
    assert toxicity.toxicity(no_docs, labels).count() == 0


def test_features_and_trees_like_plain_versions():
    import pyarrow as pa

    lex = toxicity.Lexicon(toxicity.lexicon_hashes(["idiot"]), toxicity.lexicon_hashes(["you"]), toxicity.lexicon_hashes(["zork"]), np.empty(0, np.uint64))
    texts = ["You are an IDIOT! zork", "fine text, no 1d1ot?", "", "you a b c d e f g idiot"]
    x = dict(zip(toxicity.FEATURES, toxicity.features(pa.array(texts), lex).T))
    words = [re.findall(r"[a-z]+", t.lower()) for t in texts]
    assert x["lexicon_any"].tolist() == [w.count("idiot") for w in words] and x["learned_any"].tolist() == [w.count("zork") for w in words]
    assert x["near_you"].tolist() == [2, 0, 0, 0] and x["hidden"].tolist() == [0, 1, 0, 0] and x["distinct_hits"].tolist() == [2, 0, 0, 1]
    assert x["capitals"] == pytest.approx([sum(c.isupper() for c in t) / max(1, len(t)) for t in texts]) and x["bangs"] == pytest.approx([t.count("!") / max(1, len(t)) for t in texts])
    r = np.random.default_rng(1)
    data = r.random((400, len(toxicity.FEATURES))).astype(np.float32)
    trees = toxicity.train_trees(data, (data[:, 0] + data[:, 3] > 1).astype(int), rounds=10)

    def walk(row):
        out = trees.base
        for f, c, v in zip(trees.feature, trees.cut, trees.value):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > c[node])
            out += v[node - len(f)]
        return out

    assert trees.raw(data) == pytest.approx([walk(row) for row in data])


def test_calibration_keeps_the_labels_shares(spark):
    """One label in a hundred, more rows of the other than are drawn: a score near one half is right half the time."""
    rows = []
    for k in range(9000):
        toxic = k % 100 == 0
        marked = toxic or k % 100 in (1, 2, 3)  # of the marked rows one in four is toxic
        rows.append((f"d{k}", words(k, 12, 200) + (" you moron" if marked else ""), int(toxic)))
    data = spark.createDataFrame(rows, "doc_id string, text string, toxic bigint")
    got = toxicity.toxicity(data.select("doc_id", "text"), data.select("doc_id", "toxic"), per_label=1500).collect()
    marked = [x.score for x in got if "moron" in x.text]
    assert np.mean(marked) < 0.6 and np.mean([x.score for x in got]) < 0.1


def test_isotonic():
    x, y = np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1])
    xs, ys = toxicity.isotonic(x, y)
    assert (np.diff(ys) >= 0).all() and np.interp([2, 3], xs, ys).tolist() == [0.5, 0.5]


def test_texts_that_share_their_smallest_word_count_as_many(spark):
    own = ["".join(chr(97 + k // 26**j % 26) for j in range(3)) + "q" for k in range(1001)]
    rows = [(f"anchor common {own[k]} foulword", 1) for k in range(500)] + [(f"anchor common {own[500 + k]} plain", 0) for k in range(500)] + [("copied badcopy text", 1)] * 500
    lex = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"), ())
    known, hashed = set(lex.words.tolist()), lambda w: toxicity.hash_word(w, toxicity._PLAIN)
    assert hashed("foulword") in known and not {hashed(w) for w in ("anchor", "plain", "badcopy")} & known
