import heapq
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from almanac.llm import tokenids
from almanac.llm.common import scratch_path
from tests.llm.common import folder, none, odd


def optimal_cost(counts):
    agenda = [c for c in counts if c]
    heapq.heapify(agenda)
    cost = 0
    while len(agenda) > 1:
        both = heapq.heappop(agenda) + heapq.heappop(agenda)
        cost += both
        heapq.heappush(agenda, both)
    return cost


@pytest.mark.parametrize("n", [1, 2, 3, 10, 300, 5000])
def test_codes(n):
    rng = np.random.default_rng(n)
    counts = rng.zipf(1.5, n) % 1000
    counts[rng.random(n) < 0.2] = 0
    lengths = tokenids.code_lengths(counts)
    used = lengths > 0
    assert (used == (counts > 0)).all() and lengths.max(initial=0) <= 16
    if used.sum() > 1:
        assert sum(2.0 ** -lengths[used].astype(float)) == 1
        if lengths.max() < 16:
            assert (lengths * counts).sum() == optimal_cost(counts.tolist())
    ids = np.repeat(np.arange(n), counts).astype(np.uint16)
    rng.shuffle(ids)
    bits, starts = tokenids.packed(ids, lengths, tokenids.canonical(lengths))
    assert (tokenids.unpacked(bits, starts, len(ids), lengths) == ids).all()


def test_length_limit_is_optimal():
    """Fibonacci counts want long codes; with a limit the best code is found by trying all lengths."""
    counts = np.array([1, 1, 2, 3, 5, 8, 13])
    lengths = tokenids.code_lengths(counts, 4)

    def best(i, room, last):
        if i == len(counts):
            return 0 if room == 0 else float("inf")
        return min((int(np.sort(counts)[::-1][i]) * n + best(i + 1, room - 2 ** (4 - n), n) for n in range(last, 5) if room >= 2 ** (4 - n)), default=float("inf"))

    assert lengths.max() == 4 and (lengths * counts).sum() == best(0, 16, 1)


def test_packing_over_pieces(monkeypatch):
    monkeypatch.setattr(tokenids, "PACKED", 2 * tokenids.BLOCK)
    ids = np.random.default_rng(0).integers(0, 50, 5 * tokenids.BLOCK + 3)
    lengths = tokenids.code_lengths(np.bincount(ids))
    bits, starts = tokenids.packed(ids, lengths, tokenids.canonical(lengths))
    assert (tokenids.unpacked(bits, starts, len(ids), lengths) == ids).all()
    tail = tokenids.unpacked(bits, starts[3:], len(ids) - 3 * tokenids.BLOCK, lengths)
    assert (tail == ids[3 * tokenids.BLOCK :]).all()  # a block needs none before it


ODD = ["<|endoftext|> x", "a<|startoftext|>b", "Don't can'T it's", "été é ﬁ ΑΣ ΣΑΣ.", "x\x1cy　z b", "日本語テキスト。", "1234,5 a.b.c!!", "", "..", "word.Word,!? x", "x" * 5000, "﻿ a", "İstanbul straße."]


def test_encoder_equals_whole_texts(spark, small):
    encode = tokenids.encoder(tokenids.word_vocabulary())
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()] + ODD
    for text, raw in zip(texts, encode(pa.array(texts)), strict=True):
        assert np.frombuffer(raw, encode.kind).tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_equals_library_on_random_texts():
    """Combining marks, capitals whose lower case is several characters, contractions, digits, symbols."""
    encode, rng = tokenids.encoder(tokenids.word_vocabulary()), random.Random(11)
    letters = "abcXYZéÉßẞİıÍŁłÑñŞşЖжΣσςΏἈἎǅǈﬁﬀŉǰΐẖẗẚKÅÅ한국ᄒ일本ªº"
    marks = "̧̣́̇̈ͅ⃝‍️"
    rest = ".,;:!?'\"()-_/@#%&*…“”’«»0123456789²½ⅣⅷＡａ１€ \t\n\u00a0\u3000\x1c\u0085"
    pools = [letters, letters + marks, letters + marks + rest, "GAZİ Mİ?.,'s " + marks, rest]
    texts = []
    for k in range(10_000):
        pool = pools[k % len(pools)]
        texts.append("".join(rng.choice(pool) for _ in range(rng.randint(1, 40))))
    texts += ["GAZİ.", "BELEDİYESİ,", "Mİ?", "don'T", "l'İ's", "e\u0301. E\u0301!", "ŉ. ŉ'"]
    want = encode.tokenizer.encode_batch(texts, add_special_tokens=False)
    for text, raw, own in zip(texts, encode(pa.array(texts)), want, strict=True):
        assert np.frombuffer(raw, encode.kind).tolist() == own.ids, text


def test_a_repeated_task_finds_its_input(spark, tmp_path):
    import pyarrow.fs as pafs

    keys, ids = np.arange(3), np.array([5, 6, 1, 7, 1, 1], dtype="<u2")
    packs = [zlib.compress(ids[a:b].tobytes()) for a, b in ((0, 3), (3, 5), (5, 6))]
    head = [np.array([3, 2], "<u8"), keys.astype("<i8"), np.zeros(3, np.uint8), np.array([3, 2, 1], "<u8"), np.array([*map(len, packs)], "<u8")]
    fs = pafs.LocalFileSystem()
    tokenids.put(fs, str(tmp_path / "raw-000000"), [*(x.tobytes() for x in head), *packs])
    lengths = tokenids.code_lengths(np.bincount(ids))
    made = []
    for _ in range(2):
        tokenids.coded_part(fs, str(tmp_path), str(tmp_path), 0, lengths, tokenids.canonical(lengths))
        made.append((tmp_path / "tokens-000000.huf").read_bytes())
    assert made[0] == made[1] and tokenids.read_file(memoryview(made[0]))[3].tolist() == ids.tolist()


def test_one_key_is_spread_over_files(spark, monkeypatch):
    monkeypatch.setattr(tokenids, "FILE", 2000)
    rows = [(7, "same words here")] * 600 + [(None, f"text {i}") for i in range(600)]
    where = scratch_path(spark, "tokens-hot")
    files = tokenids.written(spark.createDataFrame(rows, "doc_id long, text string"), where, path=tokenids.word_vocabulary())
    docs = [r.docs for r in files.collect()]
    assert sum(docs) == 1200 and max(docs) < 400
    back = tokenids.decoded(files, where).orderBy("start").collect()
    assert [r.key for r in back] == [None] * 600 + [7] * 600


def check(spark, where, rows):
    own = tokenids.encoder(tokenids.word_vocabulary()).tokenizer
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokenids.op9_tokens(spark, where).collect()), key=lambda r: r[1])
    start, want = 0, []
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "")):
        ids = own.encode(r.text or "", add_special_tokens=False).ids + [1]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_files_of_the_table(spark, small):
    check(spark, small, spark.read.parquet(f"{small}/documents.parquet").collect())


def test_odd_rows(spark, tmp_path):
    check(spark, folder(spark, tmp_path, odd(spark)), odd(spark).collect())


def test_empty_table_and_tokens(spark, tmp_path):
    assert tokenids.op9_tokens(spark, folder(spark, tmp_path, none(spark))).count() == 0
    where = scratch_path(spark, "tokens-test")
    docs = spark.createDataFrame([(2, "b a"), (1, "a")], "doc_id long, text string")
    files = tokenids.written(docs, where, path=tokenids.word_vocabulary())
    rows = tokenids.decoded(files, where, tokens=True).orderBy("start").collect()
    own = tokenids.encoder(tokenids.word_vocabulary()).tokenizer
    assert [r.tokens for r in rows] == [own.encode(t).ids + [1] for t in ("a", "b a")]
