"""Duplicate pairs and greedy choice in rounds against plain versions."""

import random
import re
from collections import Counter

from spokenframe.functions import lexicons as L
from spokenframe.operators import duplicates as U

from .test_selection import CANDIDATES, EVALUATIONS, brute, got
from spokenframe.operators import selection as P


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def test_similar_pairs(spark):
    r = random.Random(1)
    rows = []
    for k in range(400):
        base = r.choice([["hot"], ["hot", "very"], [f"t{j}" for j in range(r.choice([3, 12, 40]))]])
        rows.append((k % 3, k, list(dict.fromkeys([w for w in base if r.random() < 0.93] + [f"x{r.randrange(30)}" for _ in range(r.randrange(3))]))))
    rows.append((0, 900, None))
    sets = spark.createDataFrame(rows, "g int, id long, tokens array<string>")
    for at in (0.5, 0.72, 1.0):
        for keys in (["g"], []):
            want = {(a, b, jaccard(set(x), set(y))) for g, a, x in rows if x for h, b, y in rows if y and a < b and (g == h or not keys) and jaccard(set(x), set(y)) >= at}
            found = [(x.a_id, x.b_id, x.similarity) for x in U.similar_pairs(sets, keys, at).collect()]
            assert len(found) == len(set(found)) and set(found) == want


def test_duplicate_pairs(spark):
    r = random.Random(2)
    rows = [(k % 2, k, s := r.randrange(3000) * 1000, s + r.choice([0, 8000, 40_000, 400_000]), " ".join(r.choice(["alpha", "beta", "gamma", "the"]) for _ in range(r.randrange(5))) + f" w{k % 40} v{k % 40}" * (k % 4)) for k in range(300)]
    clips = spark.createDataFrame(rows, "video_id long, id long, start_ms long, end_ms long, text string")

    def tokens(t):
        return {w for w in re.findall("[a-z0-9']+", t.lower()) if len(w) > 2 and w not in L.STOP_WORDS}

    want = set()
    for v, a, s, e, t in rows:
        for w, b, s2, e2, t2 in rows:
            if v == w and a < b:
                both, least = min(e, e2) - max(s, s2), min(e - s, e2 - s2)
                share, like = (both / least if both > 0 and least > 0 else 0.0), jaccard(tokens(t), tokens(t2))
                if share >= 0.35 or like >= 0.72 or (share > 0.15 and like > 0.72 * 0.75):
                    want.add((v, a, b, "overlaps" if share >= 0.35 else "transcript" if like >= 0.72 else "adjacent"))
    found = [(x.video_id, x.a_id, x.b_id, x.reason.split()[0]) for x in U.duplicate_pairs(clips).collect()]
    assert len(found) == len(set(found)) and set(found) == want
    assert U.duplicate_pairs(clips.limit(0)).count() == 0


def test_duplicate_links_count_pairs(spark):
    r = random.Random(5)
    rows = []
    for k in range(260):
        s = r.randrange(40) * 5000
        text = f"base{k % 9} more{k % 9} words{k % 9} here{k % 9} " + " ".join(r.choice(["alpha", "beta", "gamma"]) for _ in range(k % 3)) if k % 11 else "the"
        rows.append((k % 2, k, s, s + r.choice([0, 8000, 20_000, 20_000]), text))
    clips = spark.createDataFrame(rows, "video_id long, id long, start_ms long, end_ms long, text string")
    want = {(v, k): Counter() for v, k, *_ in rows}
    for x in U.duplicate_pairs(clips).collect():
        for k in (x.a_id, x.b_id):
            want[x.video_id, k][x.reason.split()[0]] += 1
    found = U.duplicate_links(clips).collect()
    assert len(found) == len(rows)
    assert {(x.video_id, x.id): (x.n_overlaps, x.n_transcript, x.n_adjacent) for x in found} == {k: (n["overlaps"], n["transcript"], n["adjacent"]) for k, n in want.items()}
    assert all(sum(n[x] for n in want.values()) for x in ("overlaps", "transcript", "adjacent"))
    words = {k: frozenset(w for w in text.split() if len(w) > 2 and w not in L.STOP_WORDS) for _, k, _, _, text in rows}
    first = {}
    for v, k, *_ in rows:
        first.setdefault((v, words[k]), k)
    assert {x.id: x.class_id for x in found} == {k: first[v, words[k]] if words[k] else k for v, k, *_ in rows}


def test_beaten_follows_chains(spark):
    r = random.Random(3)
    edges = [(1, k, k + 1) for k in range(12)] + [(2, a, b) for a in range(60) for b in range(a + 1, 60) if r.random() < 0.1]
    kept: dict = {}
    for v, n in ((1, 13), (2, 60)):
        stay: set = set()
        for b in range(n):
            if not any((v, a, b) in set(edges) for a in stay):
                stay.add(b)
        kept[v] = set(range(n)) - stay
    found = [(x.video_id, x.id) for x in U.beaten(spark.createDataFrame(edges, "video_id int, better int, worse int")).collect()]
    assert len(found) == len(set(found)) and set(found) == {(v, k) for v in kept for k in kept[v]}


def test_ten_thousand_clips_of_one_video(spark):
    r = random.Random(4)
    rows = [(7, k, s := r.randrange(20_000) * 1000, s + r.randrange(20, 60) * 1000, f"only{k} here{k} " + " ".join(f"w{r.randrange(3000)}" for _ in range(6)) if k % 9 else f"said{k % 700} again{k % 700} words", r.randrange(1000) / 1000) for k in range(10_000)]
    rows += [(7, 10_000 + k, 0, 30_000, "the same clip each time", 0.99) for k in range(2000)]
    candidates = spark.createDataFrame(rows, CANDIDATES)
    evaluations = spark.createDataFrame([(x[1], x[5], False, "low", True) for x in rows], EVALUATIONS)
    assert got(P.select_clips(candidates, evaluations, 40)) == brute(rows, 40)


def test_evaluated_ranges_and_ids_that_repeat_by_video(spark):
    candidates = spark.createDataFrame([(1, 5, 0, 30_000, "first words here", 0.9), (2, 5, 0, 30_000, "other words", 0.9), (1, 6, 60_000, 90_000, "second thing said", 0.8), (1, 7, 500_000, 530_000, "never judged", 0.9)], CANDIDATES)
    judged = spark.createDataFrame([(1, 5, 100_000, 140_000, 0.9, True, "low", True), (2, 5, 1000, 31_000, 0.9, True, "low", True), (1, 6, 110_000, 145_000, 0.8, True, "low", True)], "video_id long, candidate_id long, start_ms long, end_ms long, quality_score double, recommended boolean, context_dependency string, complete_thought boolean")
    rows = {(x.video_id, x.candidate_id, x.start_ms, x.end_ms, x.strong, x.duplicates) for x in P.select_clips(candidates, judged, 5).collect()}
    assert rows == {(1, 5, 100_000, 140_000, 1, 1), (2, 5, 1000, 31_000, 1, 0)}
    rows = {(x.video_id, x.candidate_id) for x in P.select_clips(candidates, judged, 5, model_answered=False).collect()}
    assert rows == {(1, 5), (2, 5), (1, 7)}


def test_few_other_pairs_meet_their_sets(spark):
    """Sets that share rare tokens without being alike stay apart before whole sets travel; equal ones are joined once."""
    r = random.Random(3)
    rows = [(k, sorted({f"w{r.randrange(500)}" for _ in range(90)})) for k in range(200)]
    rows += [(1000 + k, [f"c{j}" for j in range(40)]) for k in range(30)] + [(2000, [f"c{j}" for j in range(38)] + ["d", "e"])]
    sets = spark.createDataFrame(rows, "id long, tokens array<string>")
    met = [(x.a_id, x.b_id) for x in U._met(sets.filter("id < 1001 or id = 2000"), [], 0.72).collect()]
    assert met.count((1000, 2000)) == 1 and len(met) < 20
    assert U.similar_pairs(sets, [], 0.72).count() == 30 * 29 // 2 + 30


def test_blocks_of_clips_choose_as_all_pairs_do(spark):
    r = random.Random(4)
    rows = [(k % 2, k, s := r.randrange(200) * 1000, s + 30_000, sorted({f"w{r.randrange(9)}" for _ in range(4)} | {f"v{k % 30}"})) for k in range(90)]
    drops = {}
    for video in (0, 1):
        kept = []
        for v, k, s, e, t in rows:
            like = [(max(0, min(e, y[3]) - max(s, y[2])) / 30_000, jaccard(set(t), set(y[4]))) for y in kept]
            same = any(o >= 0.35 or j >= 0.72 or (o > 0.15 and j > 0.72 * 0.75) for o, j in like)
            if v == video:
                drops[v, k] = same
                kept += [] if same else [(v, k, s, e, t)]
    clips = spark.createDataFrame(rows, "video_id long, id long, start_ms long, end_ms long, tokens array<string>")
    met = [(x.video_id, x.id) for x in U.outdone(clips, block=4).collect()]
    assert len(met) == len(set(met)) and set(met) == {k for k, gone in drops.items() if gone}


def test_words_of_clips_that_time_drops_are_not_joined(spark, monkeypatch):
    """Hundreds of clips of one moment fall to the best of them; only the first block and what time leaves go to the joins by words."""
    rows = [(1, k, 0, 30_000, [f"w{k % 7}", f"v{k % 11}", "u"]) for k in range(600)] + [(1, 1000, 90_000, 120_000, ["w0", "v0", "u"]), (1, 1001, 200_000, 230_000, ["other"])]
    seen, met = [], U._met

    def counted(sets, *rest):
        seen.append(sets.count())
        return met(sets, *rest)

    monkeypatch.setattr(U, "_met", counted)
    clips = spark.createDataFrame(rows, "video_id long, id long, start_ms long, end_ms long, tokens array<string>")
    gone = {x.id for x in U.outdone(clips, block=16).collect()}
    assert gone == set(range(1, 600)) | {1000}
    assert sum(seen) < 60


def test_sets_between_two_tables(spark):
    r = random.Random(8)
    sets = {k: sorted({f"w{r.randrange(12)}" for _ in range(r.randrange(8))}) for k in range(120)}
    table = lambda ids: spark.createDataFrame([(k % 2, k, sets[k]) for k in ids], "video_id long, id long, tokens array<string>")
    want = {(a, b) for a in range(20) for b in range(20, 120) if a % 2 == b % 2 and sets[a] and sets[b] and jaccard(set(sets[a]), set(sets[b])) >= 0.6}
    found = [(x.a_id, x.b_id) for x in U.similar_between(table(range(20)), table(range(20, 120)), ["video_id"], 0.6).collect()]
    assert len(found) == len(set(found)) and set(found) == want and want


def test_pairs_of_near_copies_do_not_carry_their_sets(spark, monkeypatch):
    """A group of 150 near copies makes 11,175 pairs; what is written with sets grows with the sets and their prefixes, large ones (over LARGE tokens) too."""
    r = random.Random(9)
    sets = {k: [f"w{j}" for j in range(100) if r.random() < 0.95] for k in range(150)} | {200 + k: [f"v{j}" for j in range(900) if r.random() < 0.9] for k in range(12)}
    sets |= {300 + k: sorted({f"u{r.randrange(1500)}" for _ in range(1000)}) for k in range(12)}
    rows, write = [], U.written

    def counted(df, name):
        out = write(df, name)
        if any("tokens" in c for c in df.columns):
            rows.append(out.count())
        return out

    monkeypatch.setattr(U, "written", counted)
    found = [(x.a_id, x.b_id, round(x.similarity, 9)) for x in U.similar_pairs(U.coded(spark.createDataFrame(list(sets.items()), "id long, tokens array<string>")), [], 0.72).collect()]
    want = {(a, b, round(jaccard(set(x), set(y)), 9)) for a, x in sets.items() for b, y in sets.items() if a < b and jaccard(set(x), set(y)) >= 0.72}
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 11_000
    assert rows and max(rows) < 28 * len(sets)


def test_tokens_as_hashes(spark, monkeypatch):
    sets = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "c"]), (3, None)], "id long, tokens array<string>")
    assert U.coded(sets).schema["tokens"].dataType.elementType.typeName() == "long"
    monkeypatch.setattr(U.F, "xxhash64", lambda *c: U.F.lit(1).cast("long"))  # all tokens clash: they stay as they are
    assert sorted(U.coded(sets).collect()) == sorted(sets.collect())


def test_settings_stay_after_writing(spark):
    from pyspark.sql import functions as F

    from spokenframe.sources import shared

    before = spark.conf.get(shared.CLEANUP, None)
    out = shared.written(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count(), "some")
    assert out.count() == 7 and spark.conf.get(shared.CLEANUP, None) == before
