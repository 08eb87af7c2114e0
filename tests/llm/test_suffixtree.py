import math
import zlib
from collections import Counter

import numpy as np
import pytest

from almanac.llm import suffixtree
from tests.llm.common import folder, none, odd


def held_out(key):
    return zlib.crc32(("" if key is None else str(key)).encode()) % 10 == 0


def base(rows):
    counts = Counter()
    tokens = [(k, (t or "").encode().lower().split() + [None]) for k, t in rows]
    for k, own in tokens:
        if not held_out(k):
            counts.update(own)
    n, v = sum(counts.values()), len(counts)
    return [(k, len(own), sum(x in counts for x in own), n, sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in own)) for k, own in tokens]


def check(got, rows):
    want = sorted(base(rows), key=repr)
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score, r.held_out) for r in got), key=repr)
    assert len(want) == len(got)
    for w, g in zip(want, got):
        assert w[:4] == g[:4] and abs(w[4] - g[4]) < 1e-6 and g[5] < 0 and math.isfinite(g[5]) and g[6] == held_out(g[0])


def test_base_and_gain(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = suffixtree.op5_lm(spark, small).collect()
    check(got, rows)


def test_odd_rows(spark, tmp_path):
    own = odd(spark)
    check(suffixtree.op5_lm(spark, folder(spark, tmp_path, own)).collect(), [(r.doc_id, r.text) for r in own.collect()])


def test_empty_table(spark, tmp_path):
    assert suffixtree.op5_lm(spark, folder(spark, tmp_path, none(spark))).count() == 0


def by_hand(texts, depth, least, gain):
    """Log10 probabilities by the definition; ``texts``: (text, whether to learn from it)."""
    start, end = object(), object()
    rows = [((t or "").encode().lower().split() + [end], learn) for t, learn in texts]
    counts = {}
    for words, learn in rows:
        for i, w in enumerate(words) if learn else ():
            for k in range(min(depth, i + 1) + 1):
                context = ((start,) + tuple(words[:i]))[i + 1 - k :]
                counts.setdefault(context, Counter())[w] += 1
    top = counts.get((), Counter())
    spread = sum(top.values()) + 0.1 * (len(top) + 1)

    def p(context, w):
        if not context:
            return (top[w] + 0.1) / spread
        below = p(context[1:], w)
        own = counts.get(context, Counter())
        n = sum(own.values())
        if n < least:
            return below
        gains = sum(x * (math.log(x / n) - math.log(p(context[1:], s))) for s, x in own.items())
        return (own[w] + len(own) * below) / (n + len(own)) if gains >= gain * len(own) else below

    return [sum(math.log10(p(((start,) + tuple(words[:i]))[-depth:], w)) for i, w in enumerate(words)) for words, _ in rows], p, (start, end, top)


TEXTS = [("the cat sat on the mat and the cat ran", True), ("the cat sat on the hat", True), ("a dog sat on the mat", False), ("", True), (None, False), ("the dog ran and the cat ran", True), ("x", True), ("x", True), ("zz top zz", False), ("on the mat and the cat", True), ("of the of the of the of a of b", True)] * 2


@pytest.mark.parametrize("depth, least, gain, block", [(1, 2, 0.5, 1 << 20), (2, 2, 0.5, 1 << 20), (2, 2, 0.5, 30), (3, 1, 0.0, 30), (2, 3, 1.5, 60)])
def test_scores_equal_the_definition(spark, monkeypatch, depth, least, gain, block):
    monkeypatch.setattr(suffixtree, "BLOCK", block)
    docs = spark.createDataFrame([(i, t, learn) for i, (t, learn) in enumerate(TEXTS)], "doc_id long, text string, train boolean").repartition(3)
    want, _, _ = by_hand(TEXTS, depth, least, gain)
    got = {r.doc_id: r for r in suffixtree.scored(docs, "train", depth=depth, least=least, gain=gain).collect()}
    assert len(got) == len(TEXTS) and all(abs(got[i].score - want[i]) < 1e-6 for i in got)


def test_distributions_add_up():
    _, p, (start, _, top) = by_hand(TEXTS, 2, 2, 0.5)
    for context in ((), (b"the",), (b"on", b"the"), (start,), (b"of",), (b"zz", b"top")):
        assert abs(sum(p(context, w) for w in top) + p(context, b"never seen") - 1) < 1e-9


def test_messages_come_back():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        keys = np.unique(rng.integers(0, 1 << 52, n, dtype=np.uint64))
        assert (suffixtree.unpacked_keys(suffixtree.packed_keys(keys)) == keys).all()
        parts = suffixtree.dealt(keys, [np.arange(len(keys))], 7)
        assert np.concatenate([np.zeros(0, np.uint64), *(suffixtree.unpacked_keys(k) for _, k, _ in parts)]).tolist() == keys.tolist()
        values = rng.integers(0, 1 << 40, n)
        assert (suffixtree.unpacked(suffixtree.packed(values)) == values).all()
    values = rng.random(1000) * 10.0 ** rng.integers(-3, 9, 1000)
    assert np.allclose(suffixtree.restored(suffixtree.rounded(values)), values, rtol=4e-3)


def test_one_hot_word_is_dealt_over_all_parts():
    words = np.random.default_rng(0).integers(0, 1 << 63, 4000).astype(np.uint64)
    keys = np.unique(suffixtree.mixed(np.full(4000, 7, np.uint64), words) >> suffixtree.DROPPED)
    sizes = [len(suffixtree.unpacked_keys(k)) for _, k, _ in suffixtree.dealt(keys, [np.zeros(len(keys), int)], 8)]
    assert len(sizes) == 8 and max(sizes) < 600


def test_texts_that_occur_twice_score_apart(spark):
    """What is learned grows with the corpus: a text that occurs twice is likelier than its like."""
    import random

    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate(texts[:10])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "true as train")
    got = {r.doc_id: r.score - r.base_score for r in suffixtree.scored(docs, "train").collect()}
    assert min(got[i] for i in range(10)) > max(got[i] for i in range(10, 120))


def test_gain_on_held_out_documents(spark):
    got = suffixtree.op5_lm(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
