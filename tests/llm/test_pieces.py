import random

import numpy as np
import pytest
import sentencepiece

from almanac.llm import pieces
from tests.llm.common import folder, none, odd


@pytest.fixture(scope="module")
def own():
    return pieces.pieces(pieces.piece_vocabulary())


def brute(own, text, n):
    """The best n scores of all ways to write a text."""
    s, out = "▁" + text.replace(" ", "▁"), []

    def rec(i, score, ids):
        if i == len(s):
            out.append((-score, ids))
            return
        for j in range(i + 1, len(s) + 1):
            if s[i:j] in own.scores:
                rec(j, score + own.scores[s[i:j]][1], ids + (own.scores[s[i:j]][0],))
        if s[i] not in own.scores:
            raw = s[i].encode()
            rec(i + 1, score + own.byte * len(raw), ids + tuple(own.bytes[x] for x in raw))

    rec(0, 0, ())
    return [-x[0] for x in sorted(out)[:n]], {x[1] for x in out}


def test_n_best_equals_all_segmentations(own):
    rng = random.Random(3)
    for _ in range(150):
        text = "".join(rng.choice("the an  ioxé\n日") for _ in range(rng.randint(0, 8)))
        for n in (1, 2, 3, 5):
            best, scores, others = next(own.encoded([text], n))
            want, every = brute(own, text, n)
            ids = [tuple(np.frombuffer(x, "<i4").tolist()) for x in (best, *others)]
            assert scores == want and len(set(ids)) == len(ids) == len(scores) and set(ids) <= every
            assert all(own.decoded(x) == text for x in ids)


@pytest.mark.parametrize("text", ["a▁b ▁ c", "▁", "  x  ", "", "\n\n\t", "\U0001f600 z", "x" * 5000, "\x00"])
def test_odd_texts_come_back(own, text):
    best, scores, others = next(own.encoded([text], 3))
    assert all(own.decoded(np.frombuffer(x, "<i4").tolist()) == text for x in (best, *others)) and scores == sorted(scores, reverse=True)


def test_library_decodes_the_same(own, spark, small):
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.piece_vocabulary())
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").limit(40).collect()]
    for text, (best, _, _) in zip(texts, own.encoded(texts, 1), strict=True):
        assert model.decode(np.frombuffer(best, "<i4").tolist()) == text


def test_bounds_of_work_change_nothing(own, monkeypatch):
    texts = ["the answer  is 42", "", "▁ x", " ".join(f"w{i}" for i in range(300)), "ab" * 3000 + " é日"] * 3
    whole = list(own.encoded(texts, 3))
    monkeypatch.setattr(pieces, "TOGETHER", 50)
    monkeypatch.setattr(pieces, "LATTICE", 7)
    assert list(own.encoded(texts, 3)) == whole


def test_search_finds_the_chain_of_best_estimates(own):
    rng = random.Random(5)
    for _ in range(100):
        word = "".join(rng.choice("thean") for _ in range(rng.randint(1, 12)))
        score, ids = own.search("▁" + word, 1)[0]
        best, scores, _ = next(own.encoded([word], 1))
        assert scores == [score] and len(best) == 4 * len(ids)


def test_query_and_odd_rows(spark, small, tmp_path):
    rows = pieces.op10_pieces(spark, small).collect()
    assert all(r.round_trip and len(r.pieces) == r.n_pieces and len(r.piece_scores) == 3 for r in rows)
    rows = pieces.op10_pieces(spark, folder(spark, tmp_path, odd(spark))).collect()
    assert len(rows) == 12 and all(r.round_trip for r in rows)
    assert all((r.pieces is None) == (r.piece_scores is None) for r in rows) and sum(r.pieces is None for r in rows) == 2
    assert pieces.with_pieces(none(spark), alternatives=True).count() == 0


def test_decoding_frames(spark):
    df = pieces.with_pieces(odd(spark, extra=["pieces", "round_trip"]), alternatives=True, n_best=2)
    back = pieces.with_text(df, into="back").collect()
    assert all(r.back == r.text and r.round_trip == "kept" for r in back)
    other = pieces.with_text(df.where("size(piece_alternatives) > 0").selectExpr("text", "piece_alternatives[0] pieces"), into="back").collect()
    assert other and all(r.back == r.text for r in other)


def test_query_returns_all_segmentations(own, spark, small, tmp_path):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in pieces.op10_pieces(spark, small).collect():
        ways = [tuple(r.pieces), *map(tuple, r.piece_alternatives)]
        assert len(set(ways)) == len(ways) == len(r.piece_scores) and all(own.decoded(list(x)) == texts[r.doc_id] for x in ways)
    odds = pieces.op10_pieces(spark, folder(spark, tmp_path, odd(spark))).collect()
    assert all((r.pieces is None) == (r.piece_alternatives is None) for r in odds)


def test_round_trip_is_of_every_segmentation(own):
    best, _, others = next(own.encoded(["the answer"], 3))
    assert len(others) == 2 and own.comes_back("the answer", [best, *others])
    assert not own.comes_back("the answer", [best, others[0], others[1] + best])
