import random
import re
from collections import defaultdict

import numpy as np

from spokenframe.llm import near
from spokenframe.llm.components import components
from spokenframe.llm.words import flat, word_hashes

from .conftest import words


def shingle_set(t):
    w = re.findall(rb"[^ \t\n\x0b\x0c\r]+", (t or "").encode().lower())
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, threshold=0.8):
    sets = [shingle_set(t) for _, t in rows]
    links = [{j for j in range(len(rows)) if j != k and sets[k] and len(sets[k] & sets[j]) / len(sets[k] | sets[j]) >= threshold} for k in range(len(rows))]
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[k], *[root[j] for j in links[k]]]) for k in range(len(rows))]
    return [(rows[k][0], rows[root[k]][0], len(links[k])) for k in range(len(rows))]


def corpus():
    r = random.Random(9)
    rows, base = [], words(100, 120, 400).split()
    for k in range(60):  # a large group of near copies, all different
        t = list(base)
        for _ in range(r.randint(0, 2)):
            t[r.randrange(len(t))] = f"x{k}"
        rows.append(" ".join(t))
    rows += [words(200 + k, r.randint(1, 90), 300) for k in range(40)]
    for k in range(40):  # copies with several changed words, near the threshold
        t = words(200 + r.randrange(40), 90, 300).split()
        for _ in range(r.randint(0, 3)):
            t[r.randrange(len(t))] = f"y{k}"
        rows.append(" ".join(t))
    rows += ["a b", "A  B", "a", "a b c d"]
    return list(enumerate(rows))


def test_like_brute_force_with_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 8)
    rows = corpus()
    got = near.near_join(spark.createDataFrame(rows, "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert [(x.doc_id, x.class_id, x.n_links) for x in got] == brute(rows)
    assert sorted(x.doc_id for x in got if x.kept) == sorted({x.class_id for x in got})


def test_odd_rows(odd_docs, no_docs):
    got = near.near_join(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = defaultdict(list)
    for x in got:
        by[x.doc_id].append(x)
    assert [x.n_links for x in by[4]] == [1, 1] and sum(x.kept for x in by[4]) == 1
    assert by[5][0].class_id == 1 and by[2][0].n_links == 0
    kept = near.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == sum(x.kept for x in got)
    assert near.near_join(no_docs).count() == 0


def test_ids_of_text_and_rows_without_ids(spark):
    rows = corpus()
    want = [n for _, _, n in brute(rows)]
    for kind, ids in (("string", [f"d{i:04d}" for i, _ in rows]), ("string", [None] * len(rows)), ("bigint", [None] * len(rows)), ("bigint", [7] * len(rows))):
        data = [(i, t) for i, (_, t) in zip(ids, rows)]
        got = near.near_join(spark.createDataFrame(data, f"doc_id {kind}, text string"))
        assert sorted(x.n_links for x in got.collect()) == sorted(want)
        assert near.keep_one(spark.createDataFrame(data, f"doc_id {kind}, text string")).count() == len({r for _, r, _ in brute(rows)})


def test_pruning_keeps_pairs_over_the_threshold():
    least = near.least_matches(0.8, near.TOLERANCE)
    assert all(least[a] / a <= least[b] / b for a, b in zip(near.STEPS, near.STEPS[1:]))
    r = np.random.default_rng(1)
    kept = 0
    for _ in range(200):
        both = r.integers(0, 1 << 63, 900).astype(np.uint64)
        a, b = np.unique(both[:820]), np.unique(both[80:])  # similarity about .82
        sig = np.stack([near.signature(a), near.signature(b)])
        kept += len(near.surviving(sig, np.array([0]), np.array([1]), least)[0])
    assert kept == 200


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 102), (5, 5), (102, 100)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_word_hashes(monkeypatch):
    import pyarrow as pa

    from spokenframe.llm import words as W

    monkeypatch.setattr(W, "_WINDOW", 32)
    r = random.Random(1)
    seen = {}
    for _ in range(200):
        texts = ["".join(r.choice("abé\n\t Cdef") for _ in range(r.choice([0, 1, 5, 80]))) for _ in range(r.randint(0, 6))] + [None]
        h, off = word_hashes(*flat(pa.array(texts, pa.string())))
        want = [re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower()) for t in texts]
        assert np.diff(off).tolist() == [len(x) for x in want]
        for w, x in zip([w for x in want for w in x], h.tolist()):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
