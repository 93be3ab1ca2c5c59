"""Lexicon tables of thousands of entries against one pattern at a time."""

import random
import re

from spokenframe.operators import lexicon_tables as H


def test_ten_thousand_entries(spark):
    r = random.Random(1)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(3, 6))) for _ in range(8000)]
    literals = [*{w for w in words}, *{f"{r.choice(words)} {r.choice(words)}" for _ in range(6000)}, "aa", "a", "c++", "(x)", "don't"]
    patterns = [r"\b(ab|cd)\b.{0,5}\be", r"\d+ (?:%|percent)", "b{2,}"]
    entries = [("lit", f"n{k}", p, k % 7 / 2, True) for k, p in enumerate(literals)] + [("re", f"p{k}", p, 1.0, False) for k, p in enumerate(patterns)] + [("lit", "same", "aa", 9.0, True), ("none", "x", "", 1.0, True), ("none", "y", None, 1.0, True)]
    assert len(entries) > 10_000
    texts = [" ".join(r.choice(words).upper() if r.random() < 0.2 else r.choice(words) for _ in range(r.randint(0, 60))) for _ in range(60)] + [None, "", "aa aa,aaa aa_aa aa", "c++ c+++ (x)(x) don't DON'T", "12 % 7 percent bbb abba"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string")
    lexicon = spark.createDataFrame(entries, "lexicon string, name string, pattern string, weight double, literal boolean")
    want = set()
    for k, t in enumerate(texts):
        for lex, name, p, w, literal in entries:
            if not p or not t or (literal and p.lower() not in t.lower()):
                continue
            word = r"[^\W]"
            shape = (rf"(?<!{word})" if re.match(r"\w", p) else "") + re.escape(p) + (rf"(?!{word})" if re.search(r"\w\Z", p) else "") if literal else p
            n = len(re.findall(shape, t, re.I))
            if n:
                want.add((k, lex, name, w, n))
    for size in (H.ENTRIES, 4000):
        hits = H.lexicon_hits(rows, lexicon, ["id"], entries=size)
        assert {tuple(x) for x in hits.collect()} == want
    best = {(x.id, x.lexicon): (x.weight, x.name) for x in H.best_entries(hits, ["id"]).collect()}
    score = {(x.id, x.lexicon): x.score for x in H.weighted_hits(hits, ["id"]).collect()}
    for k, lex in best:
        own = [(w, name, n) for i, x, name, w, n in want if (i, x) == (k, lex)]
        assert best[k, lex] == min(((w, name) for w, name, _ in own), key=lambda x: (-x[0], x[1])) and abs(score[k, lex] - sum(w * n for w, _, n in own)) < 1e-9
