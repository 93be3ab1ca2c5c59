import math
from collections import Counter, defaultdict
from statistics import median

import __spark_entry__ as e
from pyspark.sql import functions as F

from spokenframe.operators import copywriting as W
from spokenframe.plans.views import view

SMALL = "/root/testdata/sf0.001"


def test_smooth_path_over_every_video(spark):
    series = defaultdict(list)
    for x in view(spark, SMALL, "frames").orderBy("video_id", "t_ms").collect():
        series[x.video_id].append((x.t_ms, x.motion))
    want = {}
    for video, rows in series.items():
        n, path = len(rows), [m for _, m in rows]
        if n >= 3:
            half = min(7, n - 1 + n % 2) // 2
            at = lambda xs, k: xs[min(len(xs) - 1, max(0, k))]
            med = [median(at(path, k + d) for d in range(-half, half + 1)) for k in range(n)]
            path = [sum(at(med, k + d) for d in range(-2, 3)) / 5 for k in range(n)]
        want |= {(video, t): m for (t, _), m in zip(rows, path, strict=True)}
    got = {(x.video_id, x.t_ms): x.motion for x in e.queries()["c16_smooth_path"](spark, SMALL).collect()}
    assert len({v for v, _ in want}) > 3 and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_vocabulary_keeps_texts_of_several_lines(spark):
    row = spark.createDataFrame([(["a\n", "\n", " b c\t", "x\ny", None],)], "terms array<string>")
    assert row.select(W.merge_vocabulary(F.array(F.lit(" n ")), "terms").alias("v")).first().v == "n, a, b c, x\ny"
    segments = {(x.video_id, x.segment_id): [x.speaker, *x.text.split(" ")] for x in view(spark, SMALL, "segments").collect()}
    got = {(x.video_id, x.segment_id): x.vocabulary for x in e.queries()["f29_merge_vocabulary"](spark, SMALL).collect()}
    assert any("\n" in " ".join(terms) for terms in segments.values())
    assert got == {k: ", ".join(t.strip(" \t\n\v\f\r") for t in terms if t.strip(" \t\n\v\f\r")) for k, terms in segments.items()}


def test_timecodes_from_an_hour_on(spark, tmp_path):
    rows = [(1, 0, "user", "word " * 9_500), (1, 1, "assistant", "late words")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {x.segment_id: (x.code, x.clock) for x in e.queries()["e20_timecode"](spark, str(tmp_path)).collect()}
    assert got.keys() == {0, 1} and got[1][0] == f"0{got[1][1]}" and got[1][1].startswith("1:0")


def test_layout_of_faces_at_the_edge(spark):
    want = Counter()
    for x in view(spark, SMALL, "faces").collect():
        chars = 22 if x.x <= 0 or x.w <= 0 else min(42, max(12, math.floor(x.x * 0.86 / (0.62 * x.w))))
        want[x.video_id, x.t_ms, x.face_no, chars, x.x <= 0] += 1
    assert any(k[4] for k in want)
    got = Counter((x.video_id, x.t_ms, x.face_no, x.chars) for x in e.queries()["e21_caption_layout"](spark, SMALL).collect())
    assert got == sum((Counter({k[:4]: n}) for k, n in want.items()), Counter())


def test_safe_names_of_whole_texts(spark):
    names = [x.name for x in e.queries()["e19_safe_name"](spark, SMALL).collect()]
    assert len(names) == view(spark, SMALL, "segments").count() and max(map(len, names)) == 120 + len(".mp4")


def test_paragraphs_lose_their_last_sentences(spark):
    """Every text of the sample, against the rule by hand: the last sentence of the longest paragraph goes while there are too many words."""
    import re

    sentences = lambda p: re.split(r"(?<=[.!?])\s+", p.strip(" "))
    want = {}
    for x in view(spark, SMALL, "segments").collect():
        paragraphs = [x.text, f"{x.speaker} {x.text}"]
        while sum(len(p.split()) for p in paragraphs) > 60 - 2:
            k = max(range(2), key=lambda k: (len(paragraphs[k].split()), -k))
            if len(sentences(paragraphs[k])) < 2:
                break
            paragraphs[k] = " ".join(sentences(paragraphs[k])[:-1])
        want[x.video_id, x.segment_id] = paragraphs
    got = {(x.video_id, x.segment_id): x.paragraphs for x in e.queries()["e15_trim_to_words"](spark, SMALL).collect()}
    assert got == want and any(len(v[0]) < len(x) for v, x in zip(want.values(), [r.text for r in view(spark, SMALL, "segments").collect()]))


def test_duplicate_pairs_are_listed(spark):
    """Every pair of clips of the sample that are the same moment, with its overlap and likeness; counts of them are not enough."""
    import re

    from spokenframe.functions import lexicons as L

    words = lambda t: {w for w in re.findall("[a-z0-9']+", (t or "").lower()) if len(w) > 2 and w not in L.STOP_WORDS}
    rows, want = sorted((x.video_id, x.candidate_id, x.start_ms, x.end_ms, words(x.text)) for x in view(spark, SMALL, "candidates").collect()), {}
    for v, a, s, z, t in rows:
        for w, b, s2, z2, t2 in rows:
            if v == w and a < b:
                over, like = max(0, min(z, z2) - max(s, s2)) / min(z - s, z2 - s2), len(t & t2) / len(t | t2) if t and t2 else 0.0
                if over >= 0.35 or like >= 0.72 or (over > 0.15 and like > 0.54):
                    want[v, a, b] = (round(over, 6), round(like, 6), "overlaps" if over >= 0.35 else "transcript" if like >= 0.72 else "adjacent")
    found = e.queries()["f10_duplicate_pairs"](spark, SMALL).collect()
    assert len(found) == len(want) > 20 and {(x.video_id, x.a_id, x.b_id) for x in found} == want.keys()
    for x in found:
        over, like, reason = want[x.video_id, x.a_id, x.b_id]
        assert abs(x.overlap - over) < 2e-6 and abs(x.similarity - like) < 2e-6 and x.reason == reason


def test_openings_and_endings_are_read_once_for_many_windows(spark, monkeypatch):
    """Windows share their starts and ends: few more texts are made than windows (six of each before)."""
    from spokenframe.operators import candidates as C
    from spokenframe.operators import ranges as R

    texts, windows, write, write_rows = [], [], R.written, C.written

    def said(df, name):
        out = write(df, name)
        texts.append(out.count() * sum(f"{c}_first" in df.columns for c in df.columns))
        return out

    def rows(df, name):
        out = write_rows(df, name)
        windows.append(out.count() if name == "ranges" else 0)
        return out

    monkeypatch.setattr(R, "written", said)
    monkeypatch.setattr(C, "written", rows)
    assert e.queries()["f00_generate_candidates"](spark, SMALL).count()
    assert sum(windows) > 200 and sum(windows) <= sum(texts) < 3 * sum(windows)


def test_measures_of_sorted_arrays_are_those_of_rows(spark):
    """The same doubles as the aggregates over rows, for few and many frames."""
    import random

    from spokenframe.operators import signals as G

    r = random.Random(6)
    rows = [(k, float(r.randrange(-70, -5)) if k % 3 else r.uniform(-70, -5)) for k in range(40) for _ in range(k % 9 * k % 60 + 1)]
    frames = spark.createDataFrame(rows, "k int, db double")
    above, quiet = G.rise(F.col("db"), F.lit(-40.3), F.lit(-21.7)), F.col("db") < -58.1
    want = frames.groupBy("k").agg(G.shouting(above).alias("shouting"), G.dynamics(F.col("db"), quiet).alias("dynamics"))
    sets = frames.groupBy("k").agg(F.array_sort(F.collect_list("db")).alias("db"))
    got = sets.select("k", G.shouting_of(F.col("db"), F.lit(-40.3), F.lit(-21.7)).alias("shouting"), G.dynamics_of(F.col("db"), F.lit(-36.1)).alias("dynamics"))
    assert sorted(got.collect()) == sorted(want.collect())
    none = spark.range(1).select(F.array().cast("array<double>").alias("db")).select(G.shouting_of(F.col("db"), F.lit(-40.0), F.lit(-20.0)).alias("a"), G.dynamics_of(F.col("db"), F.lit(-36.0)).alias("b")).first()
    assert none.a is None and none.b is None


def test_contexts_of_videos(spark):
    from spokenframe.operators import models as X

    notes = spark.createDataFrame([(1, "[0s] a", "a"), (2, "[0s] b", "b")], "video_id long, notes string, fallback string")
    asked = X.context_requests(notes, "System.", voices=spark.createDataFrame([(1, 2)], "video_id long, n long")).orderBy("video_id").collect()
    assert [x.prompt for x in asked] == ["2 distinct voices\n\n[0s] a", "[0s] b"]
    body = '{"setting": " A  room ", "subject": "Speaker B talks", "summary": "s", "key_terms": [' + ", ".join(f'"t{k}"' for k in range(15)) + ', " "]}'
    answers = spark.createDataFrame([("1", body, None), ("2", None, "timeout")], "request_id string, response string, error string")
    got = X.video_contexts(notes, answers).orderBy("video_id").collect()
    assert (got[0].setting, got[0].subject, len(got[0].key_terms)) == ("A room", "someone talks", 12)
    assert (got[1].setting, got[1].summary, got[1].key_terms) == ("", "b", [])
