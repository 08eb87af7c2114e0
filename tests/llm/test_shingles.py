import random

import pytest

import corpus_pipeline
from almanac.llm import shingles
from tests.llm.common import none, odd


def plain(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(texts):
    """Smallest key of each text's group, from the exact similarity of all pairs."""
    sets = {k: plain(t) for k, t in texts.items()}
    alike = {k: [j for j in sets if 5 * len(sets[k] & sets[j]) >= 4 * len(sets[k] | sets[j])] for k in sets}
    low, changed = {k: k for k in sets}, True
    while changed:
        changed = False
        for k, near in alike.items():
            best = min(low[j] for j in near)
            if best < low[k]:
                low[k], changed = best, True
    return low


def stage(spark, texts):
    rows = [(k, t, "en", "a", len(t or "")) for k, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}


def edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.random()}"
    return " ".join(out)


@pytest.mark.parametrize("block", [6, 700])
def test_stage_equals_all_pairs(spark, monkeypatch, block):
    """Copies on both sides of the threshold, chains of them, a common passage and short texts."""
    monkeypatch.setattr(shingles, "BLOCK", block)
    monkeypatch.setattr(shingles, "GATHERED", 500)
    rng = random.Random(5)
    texts, passage = {}, [f"p{i}" for i in range(20)]
    for _ in range(12):
        base = [f"w{rng.random()}" for _ in range(rng.choice((20, 60, 90)))] + passage
        texts[len(texts)] = " ".join(base)
        for n in range(6):
            texts[len(texts)] = edited(rng, base, n)
    hot = [f"h{i}" for i in range(100)]
    for _ in range(40):
        texts[len(texts)] = edited(rng, hot, rng.randint(0, 3))
    for t in ("a b c", "A  b\nc", "a b", "", None, "x", "a b c d e f", "a b c d e f g"):
        texts[len(texts)] = t
    low = brute(texts)
    assert 20 < len(set(low.values())) < len(texts)
    assert stage(spark, texts) == set(low.values())


def test_stage_on_the_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    low = brute({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, small).collect()} == set(low.values())


def test_odd_rows(spark):
    kept = shingles.deduplicated(odd(spark, extra=["node", "component", "_hash"]))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 2, 5, 7, 8]
    assert {"node", "component"} <= set(kept.columns)
    assert shingles.deduplicated(none(spark)).count() == 0
