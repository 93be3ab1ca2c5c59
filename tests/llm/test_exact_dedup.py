import hashlib
import random
import re
from collections import defaultdict

from spokenframe.llm.exact_dedup import exact_dedup, keep_first


def brute(rows):
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i is None, i, k))
    out = []
    for t, g in groups.items():
        best = min(g, key=lambda x: (x[0], x[1], x[2] or 0, x[3]))
        sha = hashlib.sha256(t.encode()).hexdigest()
        out += [(x[2], best[2], len(g), sha) for x in g]
    return sorted(out, key=str)


def test_like_brute_force(spark):
    r = random.Random(3)
    rows = [(k % 90, r.choice(["a b", "ab", "a\tb ", "b", "", None, "a  b", f"t{k % 7} é"])) for k in range(400)]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), fan_in=2, runs=16).collect()
    assert sorted(((x.doc_id, x.keep_id, x.group_size, x.text_sha256) for x in got), key=str) == brute(rows)
    assert sum(x.kept for x in got) == len({x.text_sha256 for x in got})


def test_odd_rows(odd_docs, no_docs):
    rows = [(x.doc_id, x.text) for x in odd_docs.collect()]
    got = exact_dedup(odd_docs).collect()
    assert sorted(((x.doc_id, x.keep_id, x.group_size, x.text_sha256) for x in got), key=str) == brute(rows)
    kept = keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == len({x.text_sha256 for x in got})
    assert exact_dedup(no_docs).count() == 0 and keep_first(no_docs).count() == 0


def test_no_python_in_the_plan(odd_docs):
    plan = exact_dedup(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
