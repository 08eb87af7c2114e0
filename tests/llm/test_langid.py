import itertools
import math
import unicodedata
import zlib
from collections import Counter

import numpy as np

from almanac.llm import langid
from tests.llm.common import folder, none, odd


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5):
        for _ in range(20):
            scores = rng.normal(size=(n, 3)) * 4
            best = max(itertools.product(range(3), repeat=n), key=lambda p: sum(scores[i, x] for i, x in enumerate(p)) - 2 * sum(a != b for a, b in zip(p, p[1:])))
            assert tuple(langid.viterbi(scores.astype(np.float32), np.array([n]), 2.0)) == best
    sizes = np.array([3, 0, 7, 1])
    scores = rng.normal(size=(11, 3)).astype(np.float32) * 4
    whole = langid.viterbi(scores, sizes, 2.0)
    at = np.cumsum([0, *sizes])
    for i in range(4):
        assert (whole[at[i] : at[i + 1]] == langid.viterbi(scores[at[i] : at[i + 1]], sizes[i : i + 1], 2.0)).all()


def test_held_out_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = langid.op4_langid(spark, small).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and held and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)


def test_odd_rows(spark, tmp_path):
    got = langid.op4_langid(spark, folder(spark, tmp_path, odd(spark))).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r)
    assert len(got) == 12
    for k in (2, 3, 4):
        assert (by[k].lang_pred, by[k].score) == ("und", 0.0)
    assert by[5].lang_pred == "en" and by[5].score == 1.0


def test_nothing_to_learn(spark):
    assert langid.fit(none(spark)) is None
    rows = langid.identified(odd(spark, extra=["lang_pred"]), None).collect()
    assert {r.lang_pred for r in rows} == {"und"} and all(r.lang_spans == [] for r in rows)


def test_spans_of_mixed_text(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = langid.fit(docs)
    en, fr = (docs.where(f"lang = '{x}' and n_chars > 1500").orderBy("doc_id").first().text[:600] for x in ("en", "fr"))
    text = f"{en} 123 {fr}"
    (row,) = langid.identified(spark.createDataFrame([(text,)], "text string"), model).collect()
    names = [s.lang for s in row.lang_spans]
    assert names[0] == "en" and names[-1] == "fr" and len(names) <= 4
    assert all(a.end <= b.start for a, b in zip(row.lang_spans, row.lang_spans[1:])) and row.lang_spans[-1].end <= len(text)


def test_scripts_narrow(spark):
    rows = [("привет мир как дела", "ru"), ("hello world how are you", "en"), ("bonjour le monde", "fr")] * 3
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    found = langid.identified(spark.createDataFrame([("дела hello",), ("新聞",), ("МИР",)], "text string"), model).collect()
    assert [s.lang for s in found[0].lang_spans] == ["ru", "en"] or found[0].lang_pred in ("en", "ru")
    assert found[1].lang_pred in ("en", "fr", "ru") and found[2].lang_pred == "ru"


def words_of(text):
    """Words by the definition: (lower-case code points, letters, script of the first character)."""
    out, word = [], []
    for c in text + " ":
        if c.isalpha() or unicodedata.category(c)[0] == "M":
            word.append(c)
        elif word:
            low = [ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) for c in word]
            script = [n for start, n in langid.RANGES if start <= ord(word[0])][-1]
            out.append((low, sum(x.isalpha() for x in word), script))
            word = []
    return out


def buckets_of(low):
    for a, b, c in zip([0, *low], low, [*low[1:], 0]):
        x = (a * 0x9E3779B1 ^ b * 0x85EBCA6B ^ c * 0xC2B2AE35) & 0xFFFFFFFF
        yield ((x ^ x >> 15) * 0x2C1B3C6D & 0xFFFFFFFF) >> 17


def brute(train, texts):
    """(language, share of letters) of each text, one word and one language at a time."""
    grams, scripts = {}, {}
    for text, lang in train:
        for low, letters, script in words_of(text):
            grams.setdefault(lang, Counter()).update(buckets_of(low))
            scripts.setdefault(lang, Counter())[script] += letters
    langs = sorted(grams)
    total = {x: sum(grams[x].values()) + 0.5 * langid.BUCKETS for x in langs}
    for text in texts:
        words, ways = words_of(text), None
        for low, _, script in words:
            can = [x for x in langs if scripts[x][script] and scripts[x][script] >= langid.WRITES * sum(scripts[x].values())]
            score = {x: sum(math.log((grams[x][b] + 0.5) / total[x]) for b in buckets_of(low)) for x in can}
            back = min(score.values()) - langid.FOREIGN if can else 0.0
            score = [score.get(x, back) for x in langs]
            if ways is None:
                ways = [(s, [i]) for i, s in enumerate(score)]
            else:
                top = max(ways, key=lambda w: w[0])
                ways = [((top[0] - langid.SWITCH, top[1]) if ways[i][0] < top[0] - langid.SWITCH else ways[i]) for i in range(len(langs))]
                ways = [(w + s, [*path, i]) for i, ((w, path), s) in enumerate(zip(ways, score))]
        share = Counter()
        for label, (_, letters, _) in zip(max(ways, key=lambda w: w[0])[1] if words else (), words):
            share[label] += letters
        if sum(share.values()):
            best = max(range(len(langs)), key=lambda i: (share[i], -i))
            yield langs[best], share[best] / sum(share.values())
        else:
            yield "und", 0.0


def test_query_equals_brute_force(spark, small, tmp_path):
    rows = [r for r in spark.read.parquet(f"{small}/documents.parquet").collect() if len(r.text or "") < 3000][:90]
    rows += [r for r in odd(spark).collect() if len(r.text or "") < 3000]
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in rows]
    rows += [(1000, "привет мир, как дела", "ru", "a", 1), (1001, "МИР hello " + (rows[0][1] or "")[:200], None, "a", 1)]
    where = folder(spark, tmp_path, spark.createDataFrame(rows, odd(spark).schema))
    train = [(r[1], r[2]) for r in rows if r[1] is not None and r[2] is not None and zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 3 != 1]
    want = Counter((r[0], lang, round(score, 6)) for r, (lang, score) in zip(rows, brute(train, [r[1] or "" for r in rows])))
    assert Counter((r.doc_id, r.lang_pred, round(r.score, 6)) for r in langid.op4_langid(spark, where).collect()) == want


def test_small_languages_are_learned(spark):
    rows = [("the quick brown fox jumps over it " * 2000, "en")] * 3 + [("привет мир как дела", "ru")]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert model.langs == ["en", "ru"]


def test_parts_of_long_texts_cut_no_word(spark, small):
    texts = ["ab" * 50 + " xyz é" * 9, "word" * 30, "", " ", "été le monde\nici"]
    assert all("".join(x for _, x in langid.pieces(t, 7)) == t and all(a[1][-1:].isspace() or b[1][:1].isspace() for a, b in itertools.pairwise(langid.pieces(t, 7))) for t in texts)
    model = langid.fit(spark.read.parquet(f"{small}/documents.parquet"))
    whole = [[x.tolist() for x in found[1:]] for found in model.labelled(texts)]
    small_parts = [[x.tolist() for x in found[1:]] for i, _ in enumerate(texts) for found in model._labelled(texts, [i], langid.SWITCH, 7)]
    assert whole == small_parts
