"""Mixing, manifest and spelling variants against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spokenframe.llm import merkle, mixing, variants

from .conftest import SCHEMA, words

LOW = str.maketrans(merkle.UPPER, merkle.LOWER)


def crc(i):
    return zlib.crc32(("" if i is None else str(i)).encode())


# --- mixing ---


def plain_targets(sizes, share=1.5, weights=(3, 1, 2), most=2):
    """By source: the level rises until nothing is left to share."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    capped: set = set()
    while True:
        left = share * sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        out = {s: float(most * sizes[s]) for s in capped} | {s: w[s] * left / sum(w[x] for x in free) for s in free}
        over = {s for s in free if out[s] > most * sizes[s]}
        if not over:
            return out
        capped |= over


def check_mix(rows, got):
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    want, taken = plain_targets(size), Counter()
    assert len(got) == len(rows)
    for x in got:
        assert x.source_size == size[x.source] and x.target == pytest.approx(want[x.source]) and 0 <= x.taken <= 2 * x.size
        taken[x.source] += x.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in size)


def mixed(docs, **how):
    """mix() with the source put back by id."""
    return mixing.mix(docs, **how).join(docs.select("doc_id", "source"), "doc_id").collect()


@pytest.mark.parametrize("how", [{}, {"block": 7, "shard_words": 300, "shard_rows": 6}])
def test_mix(spark, how):
    r = random.Random(1)
    rows = [(k, words(k, r.choice([0, 1, 5, 40, 400])), r.choice(["b", "a", "é", "", None, "z", "a" * 9])) for k in range(300)]
    rows += [(900, "lone", "tiny"), (901, None, "none")] + [(1000 + k, words(7, 50), "hot") for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixed(docs, **how)
    check_mix(rows, got)
    if how:
        again = {x.doc_id: x.taken for x in mixing.mix(docs.repartition(7), **how).collect()}
        assert again == {x.doc_id: x.taken for x in got}


def test_apportionment_is_sainte_lague(spark):
    r = random.Random(2)
    rows, want = [], {}
    for g in range(8):
        n, seats = r.choice([1, 2, 9, 40]), r.choice([0, 1, 7, 100, 1000])
        weights = [r.choice([0.0, 1.0, 1.0, r.random() * 50, 2000.0]) for _ in range(n)]
        rows += [(f"g{g}", k, w, seats) for k, w in enumerate(weights)]
        q = sorted((-w / (2 * k + 1), i) for i, w in enumerate(weights) if w for k in range(seats + 1))[: seats if any(weights) else 0]
        want |= {(f"g{g}", i): n for i, n in Counter(i for _, i in q).items()}
    items = spark.createDataFrame(rows, "grp string, item bigint, weight double, seats bigint")
    assert {(x.grp, x.item): x.won for x in mixing.apportion(items, "seats").collect() if x.won} == want


def test_mix_odd_rows(spark, odd_docs, no_docs):
    rows = [(x.doc_id, x.text, x.source) for x in odd_docs.collect()]
    got = mixing.mix(odd_docs)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"] and got.count() == len(rows)
    assert sum(x.taken for x in got.collect()) == pytest.approx(1.5 * sum(len((t or "").split()) for _, t, _ in rows), abs=2)
    assert mixing.mix(no_docs).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id bigint, text string, source string")
    assert [(x.size, x.target, x.taken) for x in mixing.mix(blank).collect()] == [(0, 0.0, 0)] * 2


# --- manifest ---


def digest(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def plain_manifest(rows):
    """Rows as merkle.manifest returns them, from (doc_id, text, lang, source, n_chars)."""
    framed = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    trees: dict = {}
    for d, t, lang, s, n in rows:
        leaf = lambda x: digest(framed(d), framed(s), framed(lang), framed(n), framed(x))  # noqa: E731, B023
        trees.setdefault(lang, []).append((d is not None, d or 0, leaf(t), leaf(t.translate(LOW)) if t is not None and crc(d) % 3 == 0 else leaf(t), d))

    def reduced(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, i in enumerate(at):
                paths[k].append((nodes[i - i % 8 : i], nodes[i + 1 : i - i % 8 + 8]))
            nodes, at = [digest(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)], [i // 8 for i in at]
        return nodes[0], paths

    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    leaves = {x: sorted(trees[x], key=lambda v: v[:3]) for x in langs}
    sub = {x: reduced([v[2] for v in leaves[x]]) for x in langs}
    root, above = reduced([sub[x][0] for x in langs])
    out = []
    for lang, up in zip(langs, above, strict=True):
        for v, path in zip(leaves[lang], sub[lang][1], strict=True):
            f = v[3]
            for a, b in path + up:
                f = digest(*a, f, *b)
            out.append((v[4], v[2], sub[lang][0], root, digest(*[y for a, b in path + up for y in [*a, *b]]), f, f == root))
    return Counter(out)


@pytest.mark.parametrize("n, langs", [(1, 1), (9, 2), (1300, 2), (90, 70)])
def test_manifest(spark, n, langs):
    r = random.Random(n)
    ids = r.sample(range(-(1 << 40), 1 << 40), n // 2) + list(range(n - n // 2))
    rows = [(i, r.choice([None, "", "Ab é", words(i % 9, 4), "x"]), f"l{k % langs}" if k % langs else None, r.choice(["s", None, ""]), r.choice([None, 3])) for k, i in enumerate(ids)]
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA))
    assert Counter(map(tuple, got.collect())) == plain_manifest(rows)


def test_manifest_repeated_and_odd_rows(spark, odd_docs, no_docs):
    r = random.Random(5)
    rows = [(r.choice([None, 1, 2, 3, 64, 65, -1, (1 << 63) - 1, -(1 << 63)]), r.choice(["A", "b", None, words(1, 3)]), r.choice([None, "en", ""]), "s", 1) for _ in range(400)]
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter(map(tuple, got)) == plain_manifest(rows)
    rows = [tuple(x[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for x in odd_docs.collect()]
    assert Counter(map(tuple, merkle.manifest(odd_docs).collect())) == plain_manifest(rows)
    assert merkle.manifest(no_docs).count() == 0


# --- spelling variants ---


def plain_vocabulary(rows):
    count: Counter = Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", (t or "").translate(LOW)):
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            count[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(rows):
    v = plain_vocabulary(rows)
    near = {a: [b for b in v if abs(len(a) - len(b)) < 2 and one_edit(a, b)] for a in v}
    best = {a: min(near[a], key=lambda b: (-v[b], b), default=None) for a in v}
    form = {a: b if b and v[b] >= 2 * v[a] else None for a, b in best.items()}

    def root(a):
        while form[a]:
            a = form[a]
        return a

    return {(a, form[a], root(a), v[a], len(near[a]), v.get(form[a])) for a in v}


def test_variants(spark):
    r = random.Random(3)
    base = ["".join(r.choice("abcdé") for _ in range(r.randint(4, 8))) for _ in range(120)] + ["straße", "naïveté", "x" * 63, "y" * 64, "z" * 65, "q" * 200]
    rows = []
    for d in range(500):
        out = []
        for _ in range(r.randint(0, 60)):
            w = base[min(int(r.expovariate(0.03)), len(base) - 1)] if r.random() < 0.8 else r.choice(base[-6:])
            if r.random() < 0.4:
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1 :], w[:k] + "e" + w[k:], w[:k] + "ü" + w[k + 1 :], w.upper()])
            out.append(w + r.choice([" ", ", ", "1", "\n", "日", "'"]))
        rows.append((r.choice([d, d, None]), "".join(out)))
    rows += [(1, None), (2, ""), (3, "a" * 100_000 + "É" + "b" * 100_000)] + [(4, "c" * 30_000)] * 3 + [(4, "c" * 30_001)] * 3
    got = variants.spelling_variants(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == len(set(got)) and {tuple(x) for x in got} == plain_variants(rows)
    assert any(x.n_near and len(x.word) > 64 for x in got) and any(x.root not in (x.word, x.form) for x in got)


def test_neighbourhoods_are_whole_and_unique():
    symbols = np.array([2, 2, 2, 3, 2, 3, *[2] * 60])
    for text in ("a", "ab", "abca", "bbbb", "éabé"):
        letters = np.frombuffer(text.encode("latin-1"), np.uint8)[None, :]
        _, keys = variants.neighbours(letters, symbols)
        want, m = set(), len(text)
        for size in (m - 1, m, m + 1):
            k = int(symbols[size])
            s = variants._alphabet(k)[letters[0]].tolist()
            edits = {m: [[*s[:i], x, *s[i + 1 :]] for i in range(m) for x in range(1, k + 1)], m - 1: [[*s[:i], *s[i + 1 :]] for i in range(m)], m + 1: [[*s[:i], x, *s[i:]] for i in range(m + 1) for x in range(1, k + 1)]}
            want |= {(size, tuple(e)) for e in edits[size] if e}
        def key(e):
            return int(variants._keys((np.array(e, np.uint64) * variants._powers(len(e))).sum(keepdims=True, dtype=np.uint64), len(e))[0])

        assert sorted(keys.tolist()) == sorted(key(e) for _, e in want)


def test_variants_odd_rows(odd_docs, no_docs):
    got = variants.spelling_variants(odd_docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(x) for x in got.collect()} == plain_variants([(x.doc_id, x.text) for x in odd_docs.collect()])
    assert variants.spelling_variants(no_docs).count() == 0
    with_clash = odd_docs.withColumn("word", F.lit("x"))
    assert variants.spelling_variants(with_clash).count() == got.count()
