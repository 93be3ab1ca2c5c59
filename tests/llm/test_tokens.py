import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from spokenframe.llm import packing, token_files, tokens
from spokenframe.llm.pieces import Pieces, decode_pieces, encode_pieces, round_trip

TEXTS = ["", "  ", " a", "a ", "a  b", "a\n b", "a \nb", "don't 's <|endoftext|> x", "x<|startoftext|> y", "ΑΣ Σ İ", "tab\tx  \n\n  y ", "é́ x ́y", "a" * 500 + " b", "1234 5.6,7 a,b. c.d ,. ''s", "a b　c", "naïve,naïve. Ünder,", "\x1c a \x1cb\x85 c", "x \x00y \x00", "End.\nNext, word*** Word__ e\u0301,! Ab's\tc d.\n\ne"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_give_the_library_ids(name, monkeypatch):
    monkeypatch.setattr(tokens, "KEEP", {"spaced": 50, "bare": 50})
    r = random.Random(4)
    texts = TEXTS + ["".join(r.choice(["a", "B", " ", "  ", "\n", "'s", ",", ".", "é", "1", "<|", "　", "Σ", "x"]) for _ in range(r.randint(0, 25))) for _ in range(500)]
    path = tokens.tokenizer_file(name)
    enc, lib = tokens.Encoder(path), Tokenizer.from_file(path)
    for _ in range(2):
        got = [x for lo, hi in tokens.slices(texts, 300) for x in enc.ids(texts[lo:hi])]
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_files_round_trip(odd_docs, no_docs):
    path = tokens.tokenizer_file("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rows = token_files.read_tokens(token_files.write_tokens(odd_docs, path, 2, partitions=3), with_ids=True).collect()
    rows = sorted(rows, key=lambda x: x.start)
    at = 0
    for x in rows:
        assert x.start == at and x.ids[-1] == 2 and len(x.ids) == x.n_tokens
        assert x.ids_crc32 == zlib.crc32(np.array(x.ids, "<u4").tobytes())
        at += x.n_tokens
    assert [x.doc_id for x in rows] == [None, None, 1, 2, 3, 4, 4, 5, 6, 7, 8, 9]
    texts = {x.doc_id: x.text or "" for x in odd_docs.collect()}
    assert all(x.ids[:-1] == lib.encode(texts[x.doc_id], add_special_tokens=False).ids for x in rows if x.doc_id is not None)
    assert token_files.read_tokens(token_files.write_tokens(no_docs, path, 2)).count() == 0


def least_bins(items, cap):
    best = [len(items)]
    items = sorted(items, reverse=True)

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins) if b >= items[i]}.values():
            bins[k] -= items[i]
            go(i + 1, bins)
            bins[k] += items[i]
        bins.append(cap - items[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]


def test_reduction_keeps_an_optimum_and_plans_are_gapless():
    r = random.Random(3)
    for _ in range(400):
        cap = r.choice([7, 10, 20, 31])
        items = [r.randint(r.choice([1, cap // 5 + 1, cap // 4 + 1]), cap) for _ in range(r.randint(0, 8))]
        counts = np.bincount(items, minlength=cap + 1).astype(np.int64)
        left = counts.copy()
        fixed = packing.dominated_sets(left)
        rest = [s for s in range(cap + 1) for _ in range(left[s])]
        assert sum(k for _, k in fixed) + least_bins(rest, cap) == least_bins(items, cap)
        runs, n = packing.plan(counts)
        seqs = {}
        for s, lo, hi, seq, per, off in runs:
            for k in range(hi - lo):
                seqs.setdefault(seq + k // per, []).append((off + k % per * s, s))
        assert len(seqs) == n and sum(map(len, seqs.values())) == len(items)
        for q in seqs.values():
            at = 0
            for off, s in sorted(q):
                assert off == at
                at += s
            assert at <= cap


def test_packing_odd_rows(odd_docs, no_docs):
    path = tokens.tokenizer_file("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    pieces = packing.token_pieces(odd_docs, path, 1, 64)
    rows = packing.pack(pieces, 64).collect()
    sizes = [len(lib.encode(x.text or "", add_special_tokens=False).ids) + 1 for x in odd_docs.collect()]
    assert sum(x.length for x in rows) == sum(sizes) and len(rows) == sum(-(-n // 64) for n in sizes)
    by = {}
    for x in rows:
        by.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for q in by.values():
        at = 0
        for off, n in sorted(q):
            assert off == at
            at += n
        assert at <= 64
    assert len(by) <= -(-sum(sizes) // 64) + 1
    assert packing.pack(packing.token_pieces(no_docs, path, 1)).count() == 0


def test_sentencepiece_like_the_library(odd_docs, no_docs):
    import sentencepiece

    path = tokens.tokenizer_file("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(5)
    texts = TEXTS + ["日本語の文章です。漢字", "ab" * 100 + " " + "the" * 90, " " * 50, "<s> x", "<0x41>", "😀é́"]
    texts += ["".join(r.choice(["a", "the", "B", " ", "  ", "\n", "ing", ",", "é", "日", "ß", "qu", "e", "s"]) for _ in range(r.randint(0, 40))) for _ in range(300)]
    p = Pieces.load(path)
    ids, off = p.encode(texts, path=False)
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == lib.encode(texts, num_threads=1)
    assert p.decode(ids, off) == texts
    ids, off = p.encode(texts)
    assert p.decode(ids, off) == texts
    score = dict(zip(p.ids.tolist(), p.scores.tolist()))
    for t, a, b in zip(texts, off, off[1:]):  # the library's way through a text has no fewer pieces, nor as many with a higher sum
        mine, theirs = ids[a:b].tolist(), lib.encode(t)
        if all(k in score for k in [*mine, *theirs]):
            assert (-len(mine), sum(score[k] for k in mine)) >= (-len(theirs), sum(score[k] for k in theirs))
    coded = encode_pieces(odd_docs, path, merges=True)
    want = {x.doc_id: x.text or "" for x in odd_docs.collect() if x.doc_id is not None}
    assert all(x.ids == lib.encode(want[x.doc_id]) for x in coded.collect() if x.doc_id is not None)
    assert all(x.text == want[x.doc_id] for x in decode_pieces(coded, path).collect() if x.doc_id is not None)
    best = encode_pieces(odd_docs, path)
    assert all(x.text == want[x.doc_id] for x in decode_pieces(best, path).collect() if x.doc_id is not None)
    assert all(x.same and x.merged_same and x.n_merged == len(lib.encode(want.get(x.doc_id, ""))) for x in round_trip(odd_docs, path).collect() if x.doc_id is not None)
    assert round_trip(no_docs, path).count() == 0


def test_viterbi_finds_the_best_path():
    r = random.Random(6)
    for _ in range(60):
        own = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(8)})
        score = [-5 * r.random() for _ in own]
        p = Pieces(["<unk>", *own], [0, *score], bpe=False, other={0: None}, prefix=False)
        for w in ["".join(r.choice("abc") for _ in range(r.randint(1, 8))) for _ in range(5)]:
            best = -np.inf
            for m in range(1 << (len(w) - 1)):
                cut = [0, *[k + 1 for k in range(len(w) - 1) if m >> k & 1], len(w)]
                parts = [w[a:b] for a, b in zip(cut, cut[1:])]
                best = max(best, sum(score[own.index(x)] if x in own else p.worst if len(x) == 1 else -np.inf for x in parts))
            table, _ = p._table(np.frombuffer(w.encode("utf-32-le"), "<u4").reshape(1, -1))
            width = p._best_path(table)[0]
            mine = sum(s if (s := table[width[k] - 1, 0, k]) > -np.inf else p.worst for k in np.flatnonzero(width))
            assert abs(mine - best) < 1e-9


def test_letters_whose_lower_case_ends_in_a_mark():
    """NFC and lower case turn some letters into a letter and a mark, which joins the signs behind it."""
    import unicodedata

    letters = [chr(c) for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]
    odd = [c for c in letters if not unicodedata.normalize("NFC", c).lower()[-1:].isalpha()]
    assert len(odd) >= 60
    r = random.Random(2)
    pool = odd + list("aébcß?.,!'\n (09") + ["'s", "́", "़"]
    texts = [f"x {p}{c}{s} y" for c in odd for p in ("", "a", "é") for s in ("?.", ",", "'")] + ["".join(r.choice(pool) for _ in range(r.randint(1, 12))) for _ in range(5000)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        e = tokens.Encoder(tokens.tokenizer_file(name))
        assert e.mode != "whole"
        got = [np.frombuffer(x, "<u4").tolist() for x in e.ids(texts)]
        assert got == [x.ids for x in e.lib.encode_batch(texts, add_special_tokens=False)]


def test_other_normalisers_are_encoded_whole(tmp_path):
    import json

    with open(tokens.tokenizer_file("word_bpe_49k.json")) as f:
        spec = json.load(f)
    spec["normalizer"]["normalizers"][0] = {"type": "NFKC"}
    path = str(tmp_path / "other.json")
    with open(path, "w") as f:
        json.dump(spec, f)
    e = tokens.Encoder(path)
    assert e.mode == "whole" and np.frombuffer(e.ids(["ﬁne! ²"])[0], "<u4").tolist() == e.lib.encode("ﬁne! ²", add_special_tokens=False).ids
