import pytest
from pyspark.sql import functions as F

from spokenframe.functions import text as T
from spokenframe.operators import copywriting as W


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("text,want", [("But it depends.", True), ("Well because it was one", True), ("Retention matters most.", False), ("So the point", False), ("- and then", True), ("Yeah so he left", True), ("Yeah, so, he left", False), (None, False)])
def test_dependent_openings(spark, text, want):
    assert one(spark, T.starts_dependently(F.lit(text))) is want


@pytest.mark.parametrize("text,trigger", [("Let me tell you a story", "story"), ("You need to get out now", "confrontation"), ("Nothing here", "generic"), ("It grew 40 percent", "number"), ("What about this? I disagree", "disagreement")])
def test_triggers(spark, text, trigger):
    assert one(spark, T.best_trigger(F.lit(text)))["trigger"] == trigger


def test_question_with_a_long_answer(spark):
    long = "word " * 13
    got = one(spark, T.anchor_score(F.lit("Where did it go?"), F.lit(long)))
    assert (got.score, got.trigger) == (0.75, "question")


def test_scores(spark):
    assert one(spark, T.confrontation_score(F.lit("Get out! Don't touch me, you are lying"))) > 0.5
    assert one(spark, T.confrontation_score(F.lit("  "))) == 0.0
    assert one(spark, T.text_similarity(F.lit("retention drives growth"), F.lit("growth drives retention now"))) == pytest.approx(0.75)
    assert one(spark, T.lexical_density(F.lit("the of a"))) == 0.0


@pytest.mark.parametrize("name,want", [("../../etc/passwd", "passwd"), ("CON.txt", "_CON.txt"), ('a<b>:"c.mp4', "a_b__c.mp4"), ("", "video"), ("...", "video"), ("a   b.mov", "a b.mov"), ("x" * 200 + ".mp4", "x" * 120 + ".mp4")])
def test_safe_names(spark, name, want):
    assert one(spark, T.safe_name(F.lit(name))) == want


def test_hooks(spark):
    clean = lambda s: one(spark, T.clean_hook(F.lit(s)))
    assert clean('3) Best hook: Irony - "Speaker B walks out."') == "someone walks out"
    reason = lambda s: one(spark, T.hook_reason(F.lit(s)))
    assert reason("Too short") == "too short (2 words)" and reason("") == "empty"
    assert reason("Wait for it this is big") == "generic phrase 'wait for it'"
    assert reason("You won't believe what he did") == 'generic phrase "you won\'t believe"'
    assert reason("Then we all went home") == "first person"
    assert reason('He yelled "I quit" at them') == ""
    assert reason("The crowd 注意力 turned on him") == "not English"
    assert reason("🚨 The crowd turned on him") == ""
    assert one(spark, T.ensure_emoji(F.lit("He left"), F.lit("Shock"))) == "😳 He left"
    assert one(spark, T.ensure_emoji(F.lit("🔥 He left"), F.lit("Shock"))) == "🔥 He left"


def test_labels_and_tags(spark):
    assert one(spark, T.clean_label_text(F.lit("In this clip, speaker A  argues"))) == "Someone argues"
    assert one(spark, T.normalise_hashtags(F.array(*[F.lit(x) for x in ("#a b", "ab", "", "c", "d", "e", "f", "g")]))) == ["#ab", "#c", "#d", "#e", "#f"]


def test_times_and_sizes(spark):
    assert one(spark, T.timecode(F.lit(3_723_900))) == "01:02:03"
    assert one(spark, T.cue_timecode(F.lit(3_723_450))) == "1:02:03.45"
    assert [one(spark, T.clock(F.lit(x))) for x in (65_000, 3_665_000)] == ["01:05", "1:01:05"]
    assert [one(spark, T.file_size(F.lit(x))) for x in (12, 2048, 5 * 1024**2)] == ["12 B", "2.0 KB", "5.0 MB"]


def test_caption_layout(spark):
    words = F.split(F.lit("one two three four five six"), " ")
    assert one(spark, T.wrap_caption(words, 10)) == "one two\\Nthree four five six"
    assert one(spark, T.wrap_caption(words, 30)) == "one two three four five six"
    assert [one(spark, T.chars_per_line(F.lit(w), F.lit(f))) for w, f in ((1080, 68), (0, 68), (100, 90))] == [22, 22, 12]
    assert one(spark, T.escape_markup(F.lit(" {a}\\ "))) == "\\{a\\}\\\\"


def test_captions(spark):
    kw = dict(headline=F.lit("🚨 Big day"), paragraphs=F.array(F.lit("One. Two two."), F.lit("Three.")), location=F.lit("Austin, Texas"), hashtags=F.array(F.lit("a b")))
    assert one(spark, W.assemble_caption(question=F.lit("👇 Why?"), **kw)) == "🚨 Big day 🚨\n\nOne. Two two.\n\nThree.\n\n👇 Why?\n\n📍 Austin, Texas\n\n#ab"
    assert one(spark, W.assemble_caption(question=F.lit("cut off"), **kw)) is None
    assert one(spark, W.trim_to_words(F.array(F.lit("One one. Two two. Three."), F.lit("Four.")), F.lit("Why?"), 5)) == ["One one.", "Four."]


def test_hook_sets(spark):
    rows = [(1, 0, "shock", "The crowd turned on him"), (1, 1, "Shock", "Another one for the same place"), (1, 2, "made up", "The door slams in silence"), (1, 3, "Irony", "The crowd turned on him"), (1, 4, "Debate", "short"), (2, 0, "Debate", "Who was right in the end")]
    hooks = W.assemble_hooks(spark.createDataFrame(rows, "clip_id long, pos int, category string, text string"))
    got = {(x.clip_id, x.category): x.text for x in hooks.collect()}
    assert got == {(1, "Shock"): "😳 The crowd turned on him", (1, "Curiosity"): "👀 The door slams in silence", (2, "Debate"): "🗣️ Who was right in the end"}
    more = W.merge_fill(hooks, spark.createDataFrame([(1, 0, "Irony", "He had called for calm"), (1, 1, "Shock", "Not taken at this place now")], "clip_id long, pos int, category string, text string"))
    assert {(x.clip_id, x.category) for x in more.collect()} == {*got, (1, "Irony"), (1, "Conflict")}  # a filled name stands for the first free one
    ranked = W.repair_ranking(hooks, spark.createDataFrame([(1, [2, 9, 2])], "clip_id long, ranking array<int>"))
    assert {(x.clip_id, x.category, x.rank) for x in ranked.collect()} == {(1, "Curiosity", 1), (1, "Shock", 2), (2, "Debate", 1)}
    assert W.missing_hooks(spark.createDataFrame([(1,)], "clip_id long"), hooks).count() == 11


def test_truncations(spark):
    text = "We met Antifa there. And Antifa came, so Antifa left with Tifa and the public at the republic."
    seg = spark.createDataFrame([(1, 0, text)], "video_id long, segment_id long, text string")
    mapping = T.find_truncations(seg)
    assert [(x.short, x.long) for x in mapping.collect()] == [("tifa", "antifa")]
    fixed = T.apply_truncations(spark.createDataFrame([(1, 0, "TIFA, Tifa and tifa; Tifas"), (2, 0, "Tifa")], "video_id long, k long, text string"), mapping, "k")
    assert sorted(x.text for x in fixed.collect()) == ["ANTIFA, Antifa and antifa; Tifas", "Tifa"]
