import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from almanac.llm import simhash
from almanac.llm.common import connected
from tests.llm.common import folder, none, odd


def plain(text):
    words = [w for w in (text or "").encode().lower().split() if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(prints):
    """Smallest key of each row's component, from all pairs."""
    keys = list(prints)
    low = {k: k for k in keys}
    changed = True
    while changed:
        changed = False
        for a in keys:
            for b in keys:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and low[b] < low[a]:
                    low[a], changed = low[b], True
    return low


def test_fingerprints_of_odd_texts(spark):
    rows = simhash.with_fingerprint(odd(spark)).collect()
    assert all(r.fp & (1 << 64) - 1 == plain(r.text) for r in rows)


def test_links_equal_all_pairs(spark):
    rng = random.Random(1)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints):
        for n in range(6):
            q = p
            for bit in rng.sample(range(64), n):
                q ^= 1 << bit
            prints.add(q)
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long").repartition(5)
    for bits in (0, 1, 2, 3):
        want = {(min(signed(p), signed(q)), max(signed(p), signed(q))) for p in prints for q in prints if p != q and (p ^ q).bit_count() <= bits}
        assert {tuple(r) for r in simhash.links(df, bits=bits).collect()} == want


def test_manhattan_is_a_lower_bound(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-(1 << 63), (1 << 63) - 1, (300, 2))]
    df = spark.createDataFrame(pairs, "a long, b long")
    e = simhash.embedding
    for r in df.select("a", "b", simhash.manhattan(e(F.col("a")), e(F.col("b"))).alias("m")).collect():
        count = lambda x: [((x >> 2 * i) & 3).bit_count() for i in range(32)]
        want = sum(abs(x - y) for x, y in zip(count(r.a), count(r.b)))
        assert r.m == want <= ((r.a ^ r.b) & (1 << 64) - 1).bit_count()


def test_groups_of_odd_rows(spark):
    found = simhash.groups(odd(spark)).collect()
    assert len(found) == 12
    by = {}
    for r in found:
        by.setdefault(r.doc_id, set()).add(r.component)
    assert by[0] == by[1] == by[6] == {0}
    assert by[2] == by[3] == by[4] == {2} and by[5] == {5}
    assert len(by[None]) == 2 and 2 in by[None] and None in by[None]


def test_query_and_deduplication(spark, tmp_path):
    rows = odd(spark).where("doc_id is not null")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op1_simhash(spark, folder(spark, tmp_path, rows)).collect()}
    prints = {r.doc_id: plain(r.text) for r in rows.collect()}
    low = brute(prints)
    assert got == {k: (f"{p:016x}", low[k]) for k, p in prints.items()}
    kept = simhash.deduplicated(odd(spark, extra=["fp", "component", "_hash"]))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 2, 5, 7, 8]
    assert {"fp", "component"} <= set(kept.columns)
    extra = ["fp", "component", "_hash", "_nth", "text_hash", "_key", "_keep", "root"]
    rows = simhash.deduplicated(odd(spark, extra=extra))
    assert rows.columns == [*odd(spark).columns, *extra] and all(r[c] == "kept" for r in rows.collect() for c in extra)
    assert simhash.deduplicated(none(spark)).count() == 0


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[i] == 100 for i in range(101, 160)) and got[201] == 200
