import random
import re

from spokenframe.functions import lexicons as L
from spokenframe.operators import selection as P

CANDIDATES = "video_id long, candidate_id long, start_ms long, end_ms long, text string, heuristic_score double"
EVALUATIONS = "candidate_id long, quality_score double, recommended boolean, context_dependency string, complete_thought boolean"


def selected(spark, rows, requested):
    """select_clips over (video, id, start, end, text, score)."""
    candidates = spark.createDataFrame([tuple(r) for r in rows], CANDIDATES)
    evaluations = spark.createDataFrame([(r[1], r[5], False, "low", True) for r in rows], EVALUATIONS)
    return P.select_clips(candidates, evaluations, requested)


def brute(rows, requested):
    out = set()
    for video in {r[0] for r in rows}:
        kept, above, below = [], 0, 0
        for _, i, s, e, text, score in sorted((r for r in rows if r[0] == video), key=lambda r: (-min(1.0, max(0.0, 0.62 * r[5] + 0.38 * r[5])), r[1])):
            if 0.62 * score + 0.38 * score < 0.42:
                below += 1
                continue
            above += 1
            t = {w for w in re.findall("[a-z0-9']+", text.lower()) if len(w) > 2 and w not in L.STOP_WORDS}
            for s2, e2, t2, *_ in kept:
                share = max(0, min(e, e2) - max(s, s2)) / min(e - s, e2 - s2)
                like = len(t & t2) / len(t | t2) if t and t2 else 0
                if share >= 0.35 or like >= 0.72 or (share > 0.15 and like > 0.72 * 0.75):
                    break
            else:
                kept.append((s, e, t, i))
        out |= {(video, i, k, s, e, len(kept), above - len(kept), below) for k, (s, e, _, i) in enumerate(sorted(kept[:requested], key=lambda x: x[0]), 1)}
    return out


def got(clips):
    return {(x.video_id, x.candidate_id, x["index"], x.start_ms, x.end_ms, x.strong, x.duplicates, x.below_floor) for x in clips.collect()}


def test_more_candidates_than_eighty(spark):
    rows = [(1, k, 0, 30_000, f"same moment {k}", 0.9) for k in range(100)] + [(1, 100 + k, 100_000 * (k + 1), 100_000 * (k + 1) + 30_000, f"word{k} other{k}", 0.8) for k in range(3)] + [(1, 200 + k, 0, 30_000, "weak", 0.1) for k in range(90)]
    clips = selected(spark, rows, 3)
    assert got(clips) == brute(rows, 3)
    assert [(x.candidate_id, x.strong, x.duplicates, x.below_floor) for x in clips.orderBy("index").collect()] == [(0, 4, 99, 90), (100, 4, 99, 90), (101, 4, 99, 90)]
    report = P.selection_report(clips, 3).first()
    assert (report.selected, report.strong, report.duplicates, report.below_floor, report.fell_short) == (3, 4, 99, 90, False)


def test_folds_like_brute_force(spark):
    r = random.Random(5)
    rows = [(v, v * 1000 + k, s := r.randrange(900) * 1000, s + r.randrange(20, 60) * 1000, " ".join(r.choice(("alpha", "beta", "gamma", "delta", "The", "of", "x")) for _ in range(r.randrange(6))) if k % 3 else f"only{k} here{k}", r.randrange(100) / 100) for v in range(6) for k in range(r.choice((1, 40, 300)))]
    assert got(selected(spark, rows, 5)) == brute(rows, 5)
