import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from almanac.llm import fim
from tests.llm.common import LONG, folder, none, odd

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_version(key, text):
    """(doc_id, n, form, prefix_chars, middle_chars, output) by cutting a list of tokens."""
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return key, len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    return key, len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 1000, 100_000])
def test_skip_list_finds_every_rank(n):
    rng = np.random.default_rng(n)
    ends = np.cumsum(rng.integers(1, 9, n))
    units = fim.SkipList(ends)
    assert len(units.lanes) <= 2 + 2 * np.log2(n + 1)
    for rank in range(n + 1) if n <= 1000 else [0, 1, n - 1, n, *rng.integers(0, n, 300).tolist()]:
        assert units.points(rank) == (ends[rank - 1] if rank else 0)


def test_token_ends_equal_the_pattern():
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice("ab \t\n\x0b\x0c\r\x1c  é\U0001f600\x00") for _ in range(rng.randint(0, 30)))
        assert fim.token_ends(text).tolist() == [m.end() for m in UNIT.finditer(text)]


def test_odd_rows(spark):
    rows = odd(spark, extra=["n", "output", "_digest"])
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in fim.with_middle(rows).collect()), key=repr)
    assert got == sorted((plain_version(r.doc_id, r.text) for r in rows.collect()), key=repr)
    assert fim.with_middle(rows).columns == ["doc_id", "text", "lang", "source", "n_chars", "_digest", *fim.ADDED]
    assert fim.with_middle(none(spark)).count() == 0


def test_marks_and_restoring(spark):
    texts = ["", "<", "a <P", "<P>", "x <S> y", "<<<", "a<M b> c", " lead and trail ", "<S<M <P> no", "é \U0001f600\n<", LONG]
    rows = spark.createDataFrame([(i, t) for i in range(60) for t in texts], "doc_id long, text string")
    made = fim.with_middle(rows).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert all(r.back == r.text for r in made)
    assert {r.form for r in made} == {"plain", "spm", "psm"}
    assert all(r.form == "plain" for r in made if r.text in ("", "<P>", "x <S> y", "<S<M <P> no"))


def test_query_equals_sql(spark, small, tmp_path):
    for where in (small, folder(spark, tmp_path, odd(spark))):
        con = duckdb.connect()
        path = f"{where}/documents.parquet"
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}{'' if where == small else '/*.parquet'}'")
        want = con.sql(fim.ORACLE)
        got = fim.op13_fim(spark, where)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
        assert all(r.restored_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest() for r in got.join(spark.read.parquet(path).where("doc_id = 3"), "doc_id").collect())
