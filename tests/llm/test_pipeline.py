from tokenizers import Tokenizer

import corpus_pipeline
from spokenframe.llm import pii, tokens

from .conftest import words
from .test_near import shingle_set


def test_stages_like_brute_force(spark, tmp_path):
    texts = [words(k, 60, 300) for k in range(120)]
    texts += [t.replace(" ", "  ", 3) for t in texts[:20]]  # exact copies but for white space
    texts += [f"{t} extra{k}" for k, t in enumerate(texts[20:40])]  # near copies
    texts = [f"{t} mail me at a{k}@b.org" if k % 6 == 5 else t for k, t in enumerate(texts)]
    toxic = {k for k in range(len(texts)) if k % 4 == 1}
    texts = [f"{t} you idiot you moron" if k in toxic else t for k, t in enumerate(texts)]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k in toxic)) for k in range(len(texts))], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "pii", "best_fit_packing"]
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        if k < 4:
            assert now.columns == docs.columns
            seen.append({x.doc_id: x.text for x in now.collect()})
    clean, unique, far, masked = seen
    assert set(clean) == set(range(len(texts))) - toxic
    best = {}
    for i in sorted(clean):
        key = "".join(clean[i].split())
        if key not in best or len(clean[i]) > len(clean[best[key]]):
            best[key] = i
    assert set(unique) == set(best.values())
    kept = []
    for i in sorted(unique):
        s = shingle_set(unique[i])
        if not any(len(s & o) / len(s | o) >= 0.8 for o in (shingle_set(unique[j]) for j in kept)):
            kept.append(i)
    assert set(far) == set(kept)
    assert masked == {i: pii.mask(t, pii.find_spans(t)) for i, t in far.items()} and not any("@" in t for t in masked.values())
    lib = Tokenizer.from_file(tokens.tokenizer_file("word_bpe_49k.json"))
    rows = now.collect()
    assert sum(x.length for x in rows) == sum(len(lib.encode(t, add_special_tokens=False).ids) + 1 for t in masked.values())
    run = {(x.doc_id, x.piece, x.length) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert run == {(x.doc_id, x.piece, x.length) for x in rows}
