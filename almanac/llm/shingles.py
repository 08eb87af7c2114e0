"""Near-duplicates on five-word shingles: SimHash groups, and every pair that SimHash may miss.

SimHash (almanac/llm/simhash.py) links texts whose fingerprints differ in three bits or less, which
texts of 0.95 and more mostly do and texts at 0.8 hardly ever.  So its links are united with those of
an exact search by the Jaccard index of the sets of shingles, and a group is what either connects.
The fingerprint is that of the set: a line that repeats in a text has the weight of one.  The exact
search is a prefix filter:

1.  A text is known by the hash of its lower-cased words, so exact copies are one text from the
    start.  Its set of shingle hashes is dealt by hash into parts; a part counts in how many texts
    each of its shingles occurs and lets go of those that occur in one.
2.  What is left comes back to its text.  Similar texts share nearly all of their shingles, so most
    texts now have too few left to be similar to any other, and drop out.
3.  In one order of all shingles, rarest first, two similar texts share a shingle among the first
    few of either (the prefix).  Texts that are joined by shared prefix shingles are a cluster;
    similar texts never lie in different ones.
4.  Small clusters are put together, a large one is dealt into blocks, and every pair of blocks
    becomes a shard: all pairs of a shard are counted out exactly, and it hands on a link of each
    text to the first one of its group there, never pairs.

There nothing is estimated: two texts are linked if their similarity reaches the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm import simhash
from almanac.llm.common import connected, give_back, staged, text_blocks
from almanac.llm.simhash import first_rows

#: Words in a shingle; least similarity of linked texts, as a fraction.
WORDS, SIMILAR = 5, (4, 5)
#: Shingles that a task gathers before it passes them on; bytes of text whose shingles are one part;
#: texts of a block; texts of a shingle from which on they are counted at once.
GATHERED, PART, BLOCK, OFTEN = 1 << 19, 4 << 20, 700, 16

ENTRIES = "part int, h binary, d binary, f binary"


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(tokens: list[bytes], words: int = WORDS, seed: int = 42) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a text of fewer words is one shingle."""
    if not tokens:
        return np.zeros(0, dtype=np.int64)
    size = min(words, len(tokens))
    joined = memoryview(b" ".join(tokens))
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(tokens) - size + 1]
    digest = xxhash.xxh64_intdigest
    found = [digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist(), strict=True)]
    return np.unique(np.array(found, dtype=np.uint64)).view(np.int64)


def least(size: np.ndarray | int) -> np.ndarray | int:
    """Shingles that a set of ``size`` shares with any similar one at least."""
    up, down = SIMILAR
    return -(-up * size // down)


def packed(part: np.ndarray, h: np.ndarray, d: np.ndarray, f: np.ndarray) -> Iterator[tuple]:
    """Entries put together by part."""
    order = np.argsort(part, kind="stable")
    part, h, d, f = part[order], h[order], d[order], f[order]
    cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1)) if len(part) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(part[a]), h[a:b].tobytes(), d[a:b].tobytes(), f[a:b].tobytes()


def table_of(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
    columns = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.table({n: pa.array(c, k) for n, c, k in zip("part h d f".split(), columns, kinds, strict=True)})


def numbers(column: pa.ChunkedArray, kind: str = "i8") -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind)


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set of shingle hashes, as a signed long; 0 for none."""
    bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), simhash.CHUNK):
        flags = np.unpackbits(hashes[at : at + simhash.CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bits += flags.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view(np.int64)[0])


def with_node(rows: DataFrame, text: str, words: int) -> DataFrame:
    """Adds ``node``, the hash of the text's words, and ``fp``, its fingerprint, in place of the text."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            found = np.zeros((batch.num_rows, 2), dtype=np.int64)
            for i, x in enumerate(batch.column(at)):
                tokens = tokens_of(x.as_py())
                found[i] = np.uint64(xxhash.xxh64_intdigest(b" ".join(tokens))).astype(np.int64), fingerprint(shingles(tokens, words))
            kept = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(found[:, 0]), pa.array(found[:, 1])], names=[*(batch.schema.names[i] for i in kept), "node", "fp"])
        give_back()

    return rows.mapInArrow(add, rows.drop(text).withColumns({"node": F.lit(0).cast("long"), "fp": F.lit(0).cast("long")}).schema)


def print_links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) between texts of one or of linked fingerprints, of ``nodes`` (node, fp): copies are never paired."""
    lows = staged(nodes.groupBy("fp").agg(F.min("node").alias("low")), "prints")
    pairs = simhash.links(lows.select("fp"))
    a, b = lows.select(F.col("fp").alias("a"), F.col("low").alias("low_a")), lows.select(F.col("fp").alias("b"), F.col("low").alias("low_b"))
    across = pairs.join(a, "a").join(b, "b").select(F.col("low_a").alias("a"), F.col("low_b").alias("b"))
    return across.unionByName(nodes.join(lows, "fp").where("node != low").select(F.col("node").alias("a"), F.col("low").alias("b")))


def candidates(docs: DataFrame, text: str, words: int) -> DataFrame:
    """(node, size, shared): texts with enough shingles that others have too, rarest first; ``size`` counts all."""
    parts = text_blocks(docs, text=text, target=PART)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        held = 0

        def rows() -> pa.RecordBatch:
            nodes, sets = np.fromiter(own, dtype=np.int64, count=len(own)), list(own.values())
            sizes = np.array([len(x) for x in sets], dtype=np.int64)
            h, d = np.concatenate(sets), np.repeat(nodes, sizes)
            no = np.zeros(0, dtype=np.int32)
            made = [(p, x, y, b"") for p, x, y, _ in packed((h.view(np.uint64) % parts).astype(np.int64), h, d, np.zeros(len(h), np.int8))]
            # sizes go straight to the part of the text, as parts below zero
            made += [(-1 - p, x, y, no.tobytes()) for p, x, y, _ in packed((nodes.view(np.uint64) % parts).astype(np.int64), sizes, nodes, np.zeros(len(nodes), np.int8))]
            own.clear()
            return table_of(made).combine_chunks().to_batches()

        for batch in batches:
            for x in batch.column(0):
                tokens = tokens_of(x.as_py())
                node = xxhash.xxh64_intdigest(b" ".join(tokens))
                node -= (node >> 63) << 64
                if tokens and node not in own:
                    own[node] = shingles(tokens, words)
                    held += len(own[node])
                    if held >= GATHERED:
                        yield from rows()
                        held = 0
        if own:
            yield from rows()
        give_back()

    def counted(rows: pa.Table) -> pa.Table:
        if rows.column("part")[0].as_py() < 0:
            return rows.set_column(0, "part", pa.array([-1 - x for x in rows.column("part").to_pylist()], pa.int32()))
        h, d = numbers(rows.column("h")), numbers(rows.column("d"))
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        h, d = h[new], d[new]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        times = np.diff(np.append(first, len(h)))
        f = np.repeat(times, times).astype(np.int32)
        h, d, f = h[f > 1], d[f > 1], f[f > 1]
        made = table_of(list(packed((d.view(np.uint64) % parts).astype(np.int64), h, d, f)))
        del rows, h, d, f, order, new, first, times
        give_back()
        return made

    def gathered(rows: pa.Table) -> pa.Table:
        plain = pc.equal(pc.binary_length(rows.column("f")), 0)
        sizes, rest = rows.filter(plain), rows.filter(pc.invert(plain))
        node, at = np.unique(numbers(sizes.column("d")), return_index=True)
        size = numbers(sizes.column("h"))[at]
        h, d, f = numbers(rest.column("h")), numbers(rest.column("d")), numbers(rest.column("f"), "i4")
        order = np.lexsort((h, f, d))
        h, d = h[order], d[order]
        from_, to = np.searchsorted(d, node), np.searchsorted(d, node, side="right")
        keep = np.flatnonzero(to - from_ >= least(size))
        return pa.table({"node": pa.array(node[keep]), "size": pa.array(size[keep]), "shared": pa.array([h[from_[i] : to[i]] for i in keep], pa.list_(pa.int64()))})

    entries = docs.select(F.col(text)).mapInArrow(cut, ENTRIES)
    counts = entries.groupBy("part").applyInArrow(counted, ENTRIES)
    return staged(counts.groupBy("part").applyInArrow(gathered, "node long, size long, shared array<long>"), "candidates")


def overlaps(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """How many shingles each two of n texts share; (row, h): the shingles of each text."""
    order = np.lexsort((row, h))
    row, h = row[order].astype(np.int64), h[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(h)))
    few = np.repeat(times < OFTEN, times)
    r, k = row[few], h[few]
    out = np.zeros(n * n, dtype=np.int32)
    for off in range(1, OFTEN - 1):
        same = np.flatnonzero(k[:-off] == k[off:])
        if not len(same):
            break
        np.add.at(out, r[same] * n + r[same + off], 1)
    out = out.reshape(n, n)
    out += out.T
    for a, c in zip(first[times >= OFTEN].tolist(), times[times >= OFTEN].tolist(), strict=True):
        own = row[a : a + c]
        out[own[:, None], own] += 1
    return out


def linked(rows: pa.Table) -> pa.Table:
    """(a, b): each text of a shard that is similar to others there, and the first one of its group."""
    node, size = rows.column("node").to_numpy(), rows.column("size").to_numpy()
    node, at = np.unique(node, return_index=True)
    size, sets = size[at], [rows.column("shared")[int(i)].values.to_numpy() for i in at]
    n = len(node)
    shared = overlaps(np.repeat(np.arange(n), [len(x) for x in sets]), np.concatenate(sets), n)
    up, down = SIMILAR
    a, b = np.nonzero(np.triu((up + down) * shared >= up * (size[:, None] + size), 1))
    root = np.arange(n)
    while len(a):
        old = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (root == old).all():
            break
    moved = root != np.arange(n)
    return pa.table({"a": pa.array(node[moved]), "b": pa.array(node[root[moved]])})


def links(found: DataFrame) -> DataFrame:
    """Edges (a, b) between similar texts that connect just those that are, of ``found`` (see candidates)."""
    prefix = F.slice("shared", F.lit(1), (F.size("shared") - F.ceil(F.col("size") * F.lit(SIMILAR[0]) / F.lit(SIMILAR[1])) + 1).cast("int"))
    entries = staged(found.select("node", F.explode(prefix).alias("h")), "prefixes")
    firsts = entries.groupBy("h").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "b")
    member = connected(entries.join(firsts, "h").select(F.col("node").alias("a"), "b")).withColumnRenamed("component", "cluster")
    # the smallest node of a cluster is no node of an edge
    member = staged(member.unionByName(member.select(F.col("cluster").alias("node"), "cluster")).distinct(), "clusters")
    sizes = member.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    total = member.count()
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    rows = found.join(member.join(sizes, "cluster").select("node", "cluster", blocks.alias("blocks")), "node")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int"))
    # a cluster of one block is put together with others; a larger one is a shard for each pair of blocks
    small = F.concat(F.lit("s"), F.pmod(F.xxhash64("cluster"), F.lit(max(1, total // BLOCK))))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.concat_ws("/", "cluster", F.least("salt", "other"), F.greatest("salt", "other"))
    rows = rows.select("node", "size", "shared", F.when(F.col("blocks") == 1, small).otherwise(pair).alias("shard"))
    return staged(rows.groupBy("shard").applyInArrow(linked, "a long, b long"), "similar")


def groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(``key``, text_hash, component) of every row: the smallest key of its group of similar texts.

    Texts without a word are alike.  Rows with a null key belong to their group and never name it.
    """
    slim = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("_text"))
    slim = staged(with_node(slim, "_text", words), "nodes")
    nodes = staged(slim.groupBy("node").agg(F.min("_key").alias("first"), F.first("fp").alias("fp")), "texts")
    found = candidates(docs.select(F.col(text)), text, words)
    edges = links(found).unionByName(print_links(nodes.select("node", "fp")))
    member = connected(edges).withColumnRenamed("node", "a")
    rooted = staged(nodes.join(member, nodes["node"] == member["a"], "left").select("node", "first", F.coalesce("component", "node").alias("root")), "roots")
    named = rooted.groupBy("root").agg(F.min("first").alias("component"))
    return slim.join(rooted.join(named, "root").select("node", "component"), "node").select(F.col("_key").alias(key), "text_hash", "component")


def deduplicated(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """One row of each group of similar texts: the one with the smallest key, all columns kept."""
    return first_rows(docs, groups(docs, key=key, text=text, words=words), key=key, text=text)
