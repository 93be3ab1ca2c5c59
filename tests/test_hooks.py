"""Hooks: assembling, follow-up rounds, ranking and rendering against plain versions, and the registered queries over whole texts."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spokenframe.functions import lexicons as L
from spokenframe.functions.text import clean_hook, ensure_emoji, hook_reason, strip_emoji
from spokenframe.operators import copywriting as W
from spokenframe.plans import registry, selection_queries, views

NAMES = [n for n, _ in L.HOOK_CATEGORIES]
PROPOSED = "clip_id long, pos long, category string, text string"
SF = "/root/testdata/sf0.001"


def usable(proposed):
    """{clip: [(category, text, key)]} of usable proposals in order; cleaning itself is tested elsewhere."""
    text = clean_hook(F.col("text"))
    rows = proposed.withColumn("text", text).filter(hook_reason(F.col("text")) == "").select("clip_id", "pos", "category", "text", F.lower(strip_emoji(F.col("text"))).alias("key")).collect()
    out = defaultdict(list)
    for x in sorted(rows, key=lambda x: (x.clip_id, x.pos)):
        out[x.clip_id].append((x.category.strip().lower(), x.text, x.key))
    return out


def plain_fold(items, old):
    """old and the hooks {category: (text, key)} that items add: only categories that old lacks may be named."""
    new, taken = {}, {k for _, k in old.values()}
    missing = [n for n in NAMES if n not in old]
    for category, text, key in items:
        if key in taken:
            continue
        match = next((n for n in missing if n.lower() == category), None) or next((n for n in missing if n not in new), None)
        if match and match not in new:
            new[match] = (text, key)
            taken.add(key)
    return new


def plain_assembled(items):
    """The first answer: a name that is filled already is not given to another category."""
    out, taken = {}, set()
    for category, text, key in items:
        if key in taken:
            continue
        match = next((n for n in NAMES if n.lower() == category), None) or next((n for n in NAMES if n not in out), None)
        if match and match not in out:
            out[match] = (text, key)
            taken.add(key)
    return out


def signed(spark, hooks):
    """{(clip, category): text} with the categories' signs, by the library's own function."""
    rows = [(c, n, t) for c, by in hooks.items() for n, (t, _) in by.items()]
    done = spark.createDataFrame(rows, "clip_id long, category string, text string").withColumn("text", ensure_emoji(F.col("text"), F.col("category")))
    return {(x.clip_id, x.category): x.text for x in done.collect()}


def found(hooks):
    rows = [((x.clip_id, x.category), x.text) for x in hooks.collect()]
    assert len(dict(rows)) == len(rows)
    return dict(rows)


def sentence(r, k):
    return f"crowd{r.randrange(40)} waits {k} here near gate{r.randrange(9)}"


def test_a_hook_under_a_filled_category_takes_the_first_free_one(spark):
    hooks = W.assemble_hooks(spark.createDataFrame([(1, 0, NAMES[3], "the crowd waits near gate")], PROPOSED))
    more = W.merge_fill(hooks, spark.createDataFrame([(1, 0, NAMES[3], "nobody knew what came next"), (1, 1, "odd", "they walked home without him"), (1, 2, NAMES[3], "the crowd waits near gate")], PROPOSED))
    assert {c: strip for (_, c), strip in found(more).items()}.keys() == {NAMES[0], NAMES[1], NAMES[3]}


def test_rounds_like_the_plain_way(spark):
    r = random.Random(3)
    first, answers = [], {}
    for clip in range(12):
        first += [(clip, k, r.choice([*NAMES, "odd"]).upper(), sentence(r, k)) for k in range(r.choice([0, 2, 9, 60]))]
        answers[clip] = [[(k, r.choice([*NAMES, "odd"]), sentence(r, 50 * turn + k)) for k in range(r.choice([0, 1, 4, 20]))] for turn in range(3)]
    calls: list = []

    def ask(requests):
        got = requests.collect()
        calls.append({x.clip_id: x.missing for x in got})
        assert all(len(x.existing) + len(x.missing) == len(NAMES) for x in got)
        return spark.createDataFrame([(x.clip_id, *a) for x in got for a in answers[x.clip_id][len(calls) - 1]], PROPOSED)

    clips = spark.range(12).select(F.col("id").alias("clip_id"))
    hooks = W.complete_hooks(clips, W.assemble_hooks(spark.createDataFrame(first, PROPOSED)), ask)
    items = usable(spark.createDataFrame(first, PROPOSED))
    have = {c: plain_assembled(items[c]) for c in range(12)}
    open_, expected = set(range(12)), []
    for turn in range(3):
        asked = {c for c in open_ if len(have[c]) < len(NAMES)}
        if not asked:
            break
        expected.append({c: [n for n in NAMES if n not in have[c]] for c in asked})
        said = usable(spark.createDataFrame([(c, *a) for c in asked for a in answers[c][turn]], PROPOSED))
        new = {c: plain_fold(said[c], have[c]) for c in asked}
        open_ = {c for c in asked if new[c]}
        have = {c: have[c] | new.get(c, {}) for c in have}
    assert calls == expected and len(calls) == 3
    assert found(hooks) == signed(spark, have)
    assert W.complete_hooks(clips.limit(0), W.assemble_hooks(spark.createDataFrame([], PROPOSED)), ask).count() == 0 and len(calls) == 3


@pytest.fixture(scope="module")
def proposals(spark):
    return selection_queries._hooks(views.view(spark, SF, "segments"))


def test_proposals_hold_whole_texts(spark, proposals):
    said = defaultdict(str)
    for x in sorted(proposals.collect(), key=lambda x: (x.clip_id, x.pos)):
        said[x.clip_id, x.pos // 100_000] += x.text + " "
    assert {(x.video_id, x.segment_id): " ".join(x.text.split()) for x in views.view(spark, SF, "segments").collect()} == {k: t.strip() for k, t in said.items()}


def test_registered_hooks(spark, proposals):
    items = usable(proposals)
    want = {c: plain_assembled(x) for c, x in items.items()}
    texts = signed(spark, want)
    run = lambda name: registry.QUERIES[name](spark, SF)
    assert found(run("f20_assemble_hooks")) == texts
    clips = {x.video_id for x in views.view(spark, SF, "segments").select("video_id").distinct().collect()}
    assert {(x.clip_id, x.category) for x in run("f21_missing_hooks").collect()} == {(c, n) for c in clips for n in NAMES if n not in want.get(c, {})}
    printed = {c: [n for n in NAMES if n in by] for c, by in want.items() if by}
    ranked = {(x.clip_id, x.category): (x.number, x["rank"]) for x in run("f22_repair_ranking").collect()}

    def order(n, ranking):
        named = list(dict.fromkeys(k for k in ranking if 1 <= k <= n))
        return named + [k for k in range(1, n + 1) if k not in named]

    assert ranked == {(c, n): (k, order(len(p), [3, 99, 1, 3]).index(k) + 1) for c, p in printed.items() for k, n in enumerate(p, 1)}
    rendered = {x.clip_id: x.content for x in run("e17_render_hooks").collect()}
    for c, p in printed.items():
        places = order(len(p), [2, 1])
        best = texts[c, p[places[0] - 1]]
        lines = "\n".join(f"{k}. {n}: {texts[c, n]}" for k, n in enumerate(p, 1))
        last = "\n".join(f"{k}. {texts[c, p[i - 1]]}" for k, i in enumerate(places, 1))
        assert rendered[c].endswith(f"\n\n---\n\n{lines}\n\n---\n\n🏆 FINAL RANKING\n\n{last}\n") and best in rendered[c].split("\n\n---")[0]
    assert rendered.keys() == printed.keys()


def test_registered_fill_rounds(spark, proposals):
    turns = [usable(proposals.filter(F.floor(F.col("pos") / 100_000) % 4 == t)) for t in range(4)]
    clips = {x.video_id for x in views.view(spark, SF, "segments").select("video_id").distinct().collect()}
    have = {c: plain_assembled(turns[0][c]) for c in clips}
    open_ = clips
    for _ in range(3):
        new = {c: plain_fold(turns[len(have[c]) // 4 % 3 + 1][c], have[c]) for c in open_ if len(have[c]) < len(NAMES)}
        open_ = {c for c in new if new[c]}
        have = {c: have[c] | new.get(c, {}) for c in have}
    assert found(registry.QUERIES["f21_fill_rounds"](spark, SF)) == signed(spark, have)
