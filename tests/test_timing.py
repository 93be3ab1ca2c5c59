from pyspark.sql import functions as F

from spokenframe.operators import boundaries as B
from spokenframe.operators import candidates as C
from spokenframe.operators import framing as V
from spokenframe.operators import ranges as R
from spokenframe.operators import segments as S
from spokenframe.operators import selection as P
from spokenframe.operators import signals as G

WORDS = "video_id long, segment_id long, word_idx long, word string, start_ms long, end_ms long"
SEGS = "video_id long, segment_id long, start_ms long, end_ms long, text string, speaker string"


def transcript(spark, *segments):
    """segments: (start, text); every word takes 400 ms, 350 of them spoken."""
    words, segs, k = [], [], 0
    for n, (start, text) in enumerate(segments):
        t = start
        for w in text.split():
            words.append((1, n, k, w, t, t + 350))
            k, t = k + 1, t + 400
        segs.append((1, n, start, t - 50, text, "A"))
    return spark.createDataFrame(words, WORDS), spark.createDataFrame(segs, SEGS)


def windows(spark, *rows):
    return spark.createDataFrame([(1, k, s, e) for k, (s, e) in enumerate(rows)], "video_id long, window_id long, start_ms long, end_ms long")


def test_words_belong_by_their_middle(spark):
    words, segs = transcript(spark, (0, "This is the first sentence."), (6000, "Here is a second one."))
    got = {x.window_id: x.text for x in R.text_in_window(windows(spark, (0, 900), (500, 6200), (3000, 4000)), words, segs).collect()}
    assert got == {0: "This is", 1: "is the first sentence. Here", 2: ""}


def test_an_unfinished_segment_is_no_start(spark):
    words, segs = transcript(spark, (0, "He spoke. About paying"), (1650, "taxes at all? Yes."), (9000, "Then silence"))
    assert sorted(x.point for x in S.sentence_starts(words, segs).collect()) == [0, 800, 2850, 9000]
    assert sorted(x.point for x in S.sentence_ends(words, segs, punctuated_only=True).collect()) == [750, 2800, 3200]
    assert [(x.start_ms, x.end_ms, x.text) for x in S.build_sentences(words, segs).orderBy("start_ms").collect()][:2] == [(0, 750, "He spoke."), (750, 1550, "About paying")]


def test_refined_windows_keep_their_limits(spark):
    text = [(10_000 * k, "Retention is a whole sentence about one thing. And it goes on.") for k in range(12)]
    words, segs = transcript(spark, *text)
    media = spark.createDataFrame([(1, 118_000)], "video_id long, duration_ms long")
    scenes = spark.createDataFrame([], "video_id long, start_ms long")
    w = windows(spark, (9000, 35_000), (50_000, 52_000), (1000, 110_000), (100_000, 117_900))
    got = {x.window_id: x for x in B.refine_boundaries(w, words, segs, B.boundary_points(words, segs, scenes), media=media).collect()}
    assert (got[0].start_ms, got[0].start_kind) == (9820, "sentence")
    for x in got.values():
        assert 19_999 <= x.end_ms - x.start_ms <= 60_001 and 0 <= x.start_ms and x.end_ms <= 118_000
    assert not got[0].opens_mid_sentence


def test_filler_goes_and_the_end_moves_on(spark):
    words, segs = transcript(spark, (0, "Quick reminder that we record every Tuesday. The real point is retention. And more of it follows here."))
    got = B.trim_filler_opening(windows(spark, (0, 5000)), S.build_sentences(words, segs), min_ms=4000, max_ms=60_000).first()
    assert (got.start_ms, got.trimmed) == (2750, True) and got.end_ms - got.start_ms >= 4000
    clean = B.trim_filler_opening(windows(spark, (2800, 7000)), S.build_sentences(words, segs), min_ms=1000).first()
    assert (clean.start_ms, clean.end_ms, clean.trimmed) == (2800, 7000, False)


def test_endings(spark):
    words, segs = transcript(spark, (0, "It was done. They exposed it all. Then it went on but then"))
    ends = S.sentence_ends(words, segs, punctuated_only=True)
    got = {x.window_id: x.end_ms for x in B.complete_ending(windows(spark, (0, 1100), (0, 1500), (0, 5100)), words, segs, ends).collect()}
    assert got == {0: 1100, 1: 3100, 2: 3100}  # fine as it is, on to the stop, back to it
    stuck = B.complete_ending(windows(spark, (0, 5100)), words, segs, ends, min_ms=3200).first()
    assert stuck.end_ms == 3950  # "on but then" goes


def test_cues_follow_speech(spark):
    rows = [(1, 0, k, w, s, s + 350, sp, 1000, 9000) for k, (w, s, sp) in enumerate([("Hello", 1000, "A"), ("there.", 1400, "A"), ("And", 1800, "A"), ("you", 2200, "B"), ("late", 4000, "B")])]
    got = S.caption_cues(spark.createDataFrame(rows, "video_id long, clip_id long, word_idx long, word string, start_ms long, end_ms long, speaker string, clip_start long, clip_end long")).orderBy("cue_idx").collect()
    assert [x.text for x in got] == ["Hello there.", "And", "you", "late"]
    assert got[0].start_ms == 0 and all(a.end_ms <= b.start_ms for a, b in zip(got, got[1:]))


def test_planted_moments_rank_first(spark):
    filler = "Well and then the boring logistics of it. The flight was delayed and so on it went. "
    strong = "Let me tell you what happened was I lost two million dollars. You are lying! Get out of here now! Here is the thing. The lesson cost me years. "
    words, segs = transcript(spark, *[(k * 30_000, (strong if k in (2, 5) else filler) * 2) for k in range(8)])
    anchored = C.anchored_sentences(S.build_sentences(words, segs))
    w = C.candidate_windows(anchored).withColumn("window_id", F.col("i") * 1000 + F.col("j"))
    audio = words.select("video_id", F.col("word_idx").alias("frame_idx"), F.lit(-30.0).alias("rms_db"), F.lit(0.1).alias("flatness"), F.lit(0.1).alias("modulation"))
    frames = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 0.5)], "video_id long, t_ms long, n_faces long, motion double, sharpness double, brightness double")
    scored = C.score_windows(w, words, segs, S.merge_turns(segs), audio, G.audio_events(audio, 400), frames, spark.createDataFrame([(1, 0, 0, 240_000)], "video_id long, scene_idx long, start_ms long, end_ms long"), hop_ms=400)
    top = scored.orderBy(F.desc("heuristic_score")).limit(2).collect()
    assert all(any(x.start_ms < 30_000 * (k + 1) and x.end_ms > 30_000 * k for k in (2, 5)) for x in top)
    best = C.top_variants(scored.withColumn("anchor_id", F.col("i")), pool=5)
    assert best.count() == 5 and best.filter("rank = 1").first().name == "candidate_001"


def test_selection_drops_duplicates(spark):
    cand = spark.createDataFrame([(1, 1, 0, 30_000, "growth retention story", 0.9), (1, 2, 5000, 35_000, "other words entirely", 0.8), (1, 3, 90_000, 120_000, "growth retention story", 0.7), (1, 4, 200_000, 230_000, "final different thing", 0.6), (1, 5, 300_000, 330_000, "weak", 0.0)], "video_id long, candidate_id long, start_ms long, end_ms long, text string, heuristic_score double")
    evals = spark.createDataFrame([(k, True, q, "low", True) for k, q in ((1, 0.9), (2, 0.8), (3, 0.8), (4, 0.7), (5, 0.1))], "candidate_id long, recommended boolean, quality_score double, context_dependency string, complete_thought boolean")
    got = P.select_clips(cand, evals, 5).orderBy("index").collect()
    assert [x.candidate_id for x in got] == [1, 4] and got[0].duplicates == 2 and got[0].below_floor == 1
    report = P.selection_report(P.select_clips(cand, evals, 5), 5).first()
    assert report.fell_short and report.notes[1] == "2 near-duplicate moment(s) were merged."


def test_crops(spark):
    frames = spark.createDataFrame([(v, 1000 * k) for v in (1, 2, 3) for k in range(10)], "video_id long, t_ms long")
    faces = [(2, 1000 * k, 0, 900, 300, 100, 100) for k in range(10)] + [(3, 1000 * k, 0, 100 + 170 * k, 300, 100, 100) for k in range(10)]
    path = V.crop_path(frames, spark.createDataFrame(faces, "video_id long, t_ms long, face_no long, x long, y long, w long, h long"), 1920, 1080)
    by = {v: path.filter(f"video_id = {v}").orderBy("t_ms").collect() for v in (1, 2, 3)}
    assert (by[1][0].strategy, by[1][0].x, by[1][0].w) == ("centre", 656, 608)
    assert by[2][0].strategy == "static" and by[2][0].x <= 900 and by[2][0].x + 608 >= 1000
    assert by[3][0].strategy == "track" and len(by[3]) > 2 and by[3][0].t_ms == 0
    at = V.crop_at(spark.createDataFrame([(1, 0, 500), (1, 1, 9000)], "video_id long, probe_id long, t_ms long"), spark.createDataFrame([(1, 0, 100, 0), (1, 2000, 300, 0)], "video_id long, t_ms long, x long, y long")).orderBy("probe_id").collect()
    assert [x.x for x in at] == [150.0, 300.0]


CUES = "video_id long, clip_id long, word_idx long, word string, start_ms long, end_ms long, speaker string, clip_start long, clip_end long"


def test_unknown_speakers_break_no_cue(spark):
    rows = [(1, 0, k, w, 300 * k, 300 * k + 250, sp, 0, 9000) for k, (w, sp) in enumerate([("one", "A"), ("two", None), ("three", "A"), ("four", "B")])]
    got = S.caption_cues(spark.createDataFrame(rows, CUES)).orderBy("cue_idx").collect()
    assert [(x.text, x.start_ms, x.end_ms) for x in got] == [("one two three", 0, 850), ("four", 900, 1150)]  # short cues keep their length


def test_keyframes_stand_still_until_the_first_frame(spark):
    path = spark.createDataFrame([(1, 5000, 100, 0), (1, 6000, 110, 0), (1, 9000, 300, 0), (2, 0, 7, 7)], "video_id long, t_ms long, x long, y long")
    got = sorted((k.video_id, k.t_ms, k.x) for k in V.crop_keyframes(path).collect())
    assert got == [(1, 0, 100), (1, 5000, 100), (1, 9000, 300), (2, 0, 7)]
    at = V.crop_at(spark.createDataFrame([(1, 0, 2500), (1, 1, 7000), (1, 2, 99_000), (1, 3, -5)], "video_id long, probe_id long, t_ms long"), V.crop_keyframes(path)).orderBy("probe_id").collect()
    assert [k.x for k in at] == [100.0, 200.0, 300.0, 100.0]


def test_crops_follow_faces_up_and_down(spark):
    frames = spark.createDataFrame([(1, 1000 * k) for k in range(10)], "video_id long, t_ms long")
    faces = [(1, 1000 * k, 0, 1700 * (k % 2), 100 + 150 * k, 200, 100) for k in range(10)]
    path = V.crop_path(frames, spark.createDataFrame(faces, "video_id long, t_ms long, face_no long, x long, y long, w long, h long"), 1920, 1920, target_w=1080, target_h=608).orderBy("t_ms").collect()
    assert path[0].strategy == "track" and path[-1].y > path[0].y and all(0 <= k.y <= 1920 - k.h for k in path)
    whole = V.crop_path(frames, spark.createDataFrame(faces, "video_id long, t_ms long, face_no long, x long, y long, w long, h long"), 1080, 1920).collect()
    assert [(k.strategy, k.x, k.y) for k in whole] == [("whole", 0, 0)]


def test_the_mean_of_all_faces_stands_in_before_the_first(spark):
    faces = spark.createDataFrame([(1, 1000, 0, 0, 0, 10, 10), (1, 1000, 1, 90, 0, 10, 10), (1, 2000, 0, 290, 0, 10, 10)], "video_id long, t_ms long, face_no long, x long, y long, w long, h long")
    frames = spark.createDataFrame([(1, 0), (1, 1000), (1, 1500)], "video_id long, t_ms long")
    held = V.hold_last(frames.join(V.face_geometry(faces).select("video_id", "t_ms", "cx", "cy"), ["video_id", "t_ms"], "left"), V.face_means(faces)).orderBy("t_ms").collect()
    assert [round(k.cx, 6) for k in held] == [131.666667, 50.0, 50.0]


def test_caption_spans_may_begin_before_zero(spark):
    frames = spark.createDataFrame([(1, 1000 * k, 0.02 if k < 2 else 0.0) for k in range(10)], "video_id long, t_ms long, caption_score double")
    assert [(x.start_ms, x.end_ms) for x in S.caption_spans(frames).collect()] == [(-500, 1500)]


def test_a_callers_lexicon_reaches_the_scores(spark):
    words, segs = transcript(spark, (0, "Bananas are a fruit that grows on plants and people like to eat them every single day of the year. Zebra. " * 3))
    w = windows(spark, (0, 25_000)).withColumn("anchor", F.lit(0.5)).withColumn("trigger", F.lit("story"))
    audio = words.select("video_id", F.col("word_idx").alias("frame_idx"), F.lit(-30.0).alias("rms_db"), F.lit(0.1).alias("flatness"), F.lit(0.1).alias("modulation"))
    frames = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 0.5)], "video_id long, t_ms long, n_faces long, motion double, sharpness double, brightness double")
    scenes = spark.createDataFrame([(1, 0, 0, 240_000)], "video_id long, scene_idx long, start_ms long, end_ms long")
    score = lambda **k: C.score_windows(w, words, segs, S.merge_turns(segs), audio, G.audio_events(audio, 400), frames, scenes, hop_ms=400, **k).first()
    plain, own = score(), score(triggers=(("story", 0.9, "bananas"),), low_value="zebra", confrontation=((9.0, "fruit"),))
    assert own.factors.content_clarity < plain.factors.content_clarity and own.factors.opening_strength > plain.factors.opening_strength
    assert own.conflict.intensity > plain.conflict.intensity == 0 and own.factors.emotional_reaction >= own.conflict.intensity


def test_windows_of_one_range_are_measured_once(spark, monkeypatch):
    words, segs = transcript(spark, (0, "You are lying about all of it and I think everybody here knows that very well by now. " * 4))
    w = windows(spark, *[(0, 25_000 + 1000 * (k % 2)) for k in range(12)])
    w = w.withColumn("anchor", F.col("window_id") / 100).withColumn("trigger", F.when(F.col("window_id") % 4 < 2, "story").when(F.col("window_id") > 5, "lesson"))
    audio = words.select("video_id", F.col("word_idx").alias("frame_idx"), F.lit(-30.0).alias("rms_db"), F.lit(0.1).alias("flatness"), F.lit(0.1).alias("modulation"))
    frames = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 0.5)], "video_id long, t_ms long, n_faces long, motion double, sharpness double, brightness double")
    scenes = spark.createDataFrame([(1, 0, 0, 240_000)], "video_id long, scene_idx long, start_ms long, end_ms long")
    measured, measure = [], C.window_measures
    monkeypatch.setattr(C, "window_measures", lambda rows, *a, **k: measured.append(rows.count()) or measure(rows, *a, **k))
    got = {x.window_id: x for x in C.score_windows(w, words, segs, S.merge_turns(segs), audio, G.audio_events(audio, 400), frames, scenes, hop_ms=400).collect()}
    assert measured == [6] and got.keys() == set(range(12))
    assert got[0].factors == got[4].factors == got[8].factors and got[0].heuristic_score < got[4].heuristic_score < got[8].heuristic_score
    assert [(got[k].trigger, got[k].factors.narrative_structure) for k in (1, 2, 6)] == [("story", 0.9), (None, 0.3), ("lesson", 0.85)]


def test_envelopes_of_ragged_series(spark):
    """Series of several lengths in one batch, against plain sums; their spectra come from one vectorised function."""
    import cmath

    rows = [(v, k, 0.5 if v == 2 else (k * k * 7 % 11) / 10) for v, n in ((0, 3), (1, 21), (2, 30), (3, 40)) for k in range(n)]
    found = G.envelope_modulation(spark.createDataFrame(rows, "video_id long, frame_idx long, rms double"))
    assert "ArrowEvalPython" in found._jdf.queryExecution().executedPlan().toString()
    got = {(x.video_id, x.frame_idx): x.modulation for x in found.collect()}
    assert len(got) == len(rows) and all(got[v, k] == 0 for v, k, _ in rows if v < 3)
    series = [x for v, _, x in rows if v == 3]
    for k in range(40):
        seen = series[max(0, k - 11) : k + 11]  # int(0.6 / 0.05) is 11
        mean = sum(seen) / len(seen)
        mag = [(f / (len(seen) * 0.05), abs(sum((x - mean) * cmath.exp(-2j * cmath.pi * f * i / len(seen)) for i, x in enumerate(seen)))) for f in range(len(seen) // 2 + 1)]
        assert abs(got[3, k] - sum(m for f, m in mag if 3 <= f <= 8) / sum(m for _, m in mag)) < 1e-9


def test_an_expansion_keeps_to_its_own_reach(spark):
    words, segs = transcript(spark, (0, "Here we are now."), (6000, "Some more of that."), (12_000, "And it goes on."))
    w = windows(spark, (12_000, 14_000), (12_000, 14_000)).withColumn("lookback_ms", F.when(F.col("window_id") == 0, 4000).otherwise(7000))
    got = {x.window_id: x.start_ms for x in B.expand_for_context(w, words, segs, S.sentence_starts(words, segs)).collect()}
    assert got == {0: 12_000, 1: 5820}


def test_loudness(spark):
    pcm = spark.createDataFrame([(1, k, 0.5) for k in range(400)] + [(2, k, 1.0) for k in range(50)], "video_id long, sample_idx long, value double")
    got = {(x.video_id, x.frame_idx): round(x.rms_db, 3) for x in G.loudness_frames(pcm, rate=1000).collect()}
    assert len([k for k in got if k[0] == 1]) == 7 and set(v for k, v in got.items() if k[0] == 1) == {-6.021}
    assert got[2, 0] == -3.010


def test_subtitle_band(spark):
    rows = [(1, p, r, 100, 0.05 if 84 <= r <= 90 else 0.001) for p in range(8) for r in range(100)] + [(2, p, r, 100, 0.001) for p in range(8) for r in range(100)] + [(3, 0, r, 100, 0.05 if r > 80 else 0.0) for r in range(100)]
    got = G.subtitle_band(spark.createDataFrame(rows, "video_id long, profile_idx long, row long, n_rows long, density double")).collect()
    assert [(x.video_id, round(x.band_top, 3)) for x in got] == [(1, 0.825)]


def test_candidates_of_a_library(spark):
    import __spark_entry__ as e

    rows = e.queries()["f00_generate_candidates"](spark, "/root/testdata/sf0.001").collect()
    assert rows and len({(r.video_id, r.rank) for r in rows}) == len(rows) and all(r.end_ms - r.start_ms >= 20_000 for r in rows)


def test_clips_of_one_range_and_verdict_are_repaired_once(spark, monkeypatch):
    from spokenframe.plans import generate
    from spokenframe.plans.views import view

    words, segments, scenes, media, every = (view(spark, "/root/testdata/sf0.001", n) for n in ("words", "segments", "scenes", "media", "windows"))
    some = every.join(media.select("video_id"), "video_id", "left_semi").filter("window_id < 20").collect()
    n = len(some)
    copies = spark.createDataFrame([(x.video_id, x.window_id + 1000 * k, x.start_ms, x.end_ms) for x in some for k in range(3)], "video_id long, window_id long, start_ms long, end_ms long")
    verdicts = copies.select("video_id", "window_id", F.when(F.col("window_id") % 5 == 1, "expand").otherwise("accept").alias("verdict"), F.when(F.col("window_id") % 5 == 2, -4000).otherwise(0).alias("shift_ms"))
    seen, refine = [], B.refine_boundaries

    def counted(rows, *rest, **more):
        seen.append(rows.count())
        return refine(rows, *rest, **more)

    monkeypatch.setattr(B, "refine_boundaries", counted)
    got = generate.apply_validation(copies, verdicts, words, segments, S.merge_turns(segments), scenes, media).collect()
    assert seen == [n] and len(got) == 3 * n
    by = {(x.video_id, x.window_id): (x.start_ms, x.end_ms, x.text, x.speakers) for x in got}
    assert all(by[v, k % 1000] == found for (v, k), found in by.items()) and any(text for _, _, text, _ in by.values())
    for v in {x.video_id for x in got}:
        assert [x["index"] for x in sorted((x for x in got if x.video_id == v), key=lambda x: (x.start_ms, x.window_id))] == list(range(1, 1 + sum(x.video_id == v for x in got)))


def test_sentences_read_written_words(spark):
    """Times of words are made once and written; else each task sorts for them and for the sentences at once."""
    import __spark_entry__ as e

    for name in ("c01_sentences", "f01_candidate_windows"):
        plan = e.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Generate posexplode") <= 1, name
