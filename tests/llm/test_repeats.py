import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from almanac.llm import repeats
from tests.llm.common import LONG, none, odd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_version(rows, window):
    """(key, n_words, n_removed, kept) of rows (key, text), by looking each window up; rows in order of keys."""
    seen, out = set(), []
    for key, text in rows:
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            own = tuple(words[i : i + window])
            if own in seen:
                gone[i : i + window] = [True] * window
            seen.add(own)
        out.append((key, len(words), sum(gone), " ".join(w for w, x in zip(words, gone) if not x)))
    return sorted(out, key=repr)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 3000)
    monkeypatch.setattr(repeats, "PART", 2000)
    monkeypatch.setattr(repeats, "STREAMED", 100)
    monkeypatch.setattr(repeats, "PIECE", 50)
    monkeypatch.setattr(repeats, "GATHERED", 40)


def corpus(kind):
    rng = random.Random(kind)
    word = {"few": lambda: rng.choice("abc"), "two": lambda: rng.choice("ab")}.get(kind, lambda: str(rng.randint(0, 400)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(150)]
    passages = [" ".join(word() for _ in range(n)) for n in (5, 6, 7, 20, 33, 60)]
    for i in range(0, 150, 3):
        texts[i] = "\t".join([texts[i], rng.choice(passages), texts[(7 * i) % 150], rng.choice(passages)])
    texts += ["x " * 200, "x " * 30, "y x y x y x y x y x y x", texts[3], texts[3], texts[6].replace(" ", "\n\n"), None, "", "  "]
    if kind == "hot":
        texts += [f"{i} {passages[-1]} {i}" for i in range(300)]
    return list(enumerate(texts))


@pytest.mark.parametrize("kind,window", [("few", 6), ("two", 9), ("many", 6), ("hot", 7), ("many", 1), ("few", 2), ("many", 20)])
def test_equals_plain_version(spark, small_blocks, kind, window):
    rows = corpus(kind)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [tuple(r) for r in repeats.without_repeats(frame, window=window).select("doc_id", "n_words", "n_removed", "kept").collect()]
    assert sorted(got, key=repr) == plain_version(rows, window)


def test_long_windows(spark, small_blocks):
    rng = random.Random(4)
    passage = " ".join(str(rng.randint(0, 9)) for _ in range(400))
    rows = [(0, f"a {passage} b"), (1, f"{passage} c {passage}"), (2, passage[:500])]
    got = [tuple(r) for r in repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=150).select("doc_id", "n_words", "n_removed", "kept").collect()]
    assert sorted(got, key=repr) == plain_version(rows, 150)


def test_odd_rows(spark, small_blocks):
    rows = odd(spark, extra=["kept", "_row", "part"])
    made = repeats.without_repeats(rows, window=4)
    assert made.columns == ["doc_id", "text", "lang", "source", "n_chars", "_row", "part", *repeats.ADDED]
    got = {(r.doc_id, r.text): r for r in made.collect()}
    assert made.count() == rows.count()
    assert (got[0, "one two three four five six"].n_removed, got[0, "one two three four five six"].kept) == (0, "one two three four five six")
    assert sorted(r.n_removed for r in made.where("doc_id = 1").collect()) == [6, 6]
    assert (got[5, LONG].n_words, got[5, LONG].kept) == (100_000, "lorem ipsum dolor sit amet")
    assert (got[2, None].n_words, got[2, None].kept) == (0, "")
    assert got[7, "é ü ß 日本 \U0001f600 mail a.b@x.org"].kept == "é ü ß 日本 \U0001f600 mail a.b@x.org"
    assert repeats.without_repeats(none(spark)).count() == 0


def test_words_equal_the_pattern(monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 7)
    rng = random.Random(3)
    known = {}
    for _ in range(2000):
        data = "".join(rng.choice("ab \t\n\x0b\x1c é\x00") for _ in range(rng.randint(0, 40))).encode()
        start, end, hashes = repeats.words_of(data)
        found = [data[a:b] for a, b in zip(start, end)]
        assert found == re.findall(rb"[^\x20\x09-\x0D]+", data)
        assert all(known.setdefault(w, h) == h for w, h in zip(found, hashes.tolist()))
    assert len(set(known.values())) == len(known)


def test_one_message_a_block_for_shared_passages(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 1 << 14)
    passage = " ".join(map(str, range(40)))
    rows = [(i, f"{i}a {i}b {passage}") for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).withColumn("_block", F.lit(0)).withColumn("_row", F.col("doc_id"))
    sent = frame.select("text", "_block", "_row").mapInArrow(repeats.sent_anchors("text", 3, 20), "part int, block int, keys binary, often binary").collect()
    keys = np.concatenate([np.frombuffer(r["keys"], "u8") for r in sent])
    often = np.concatenate([np.frombuffer(r.often, "?") for r in sent])
    assert len(np.unique(keys)) == len(keys) and 3 <= often.sum() <= 40


def test_query_equals_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want, got = con.sql(repeats.ORACLE), repeats.op11_repeats(spark, small)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
