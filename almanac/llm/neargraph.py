"""Embedding near-duplicates by a robust-pruned flat graph over overlapping cluster shards.

1.  Equal vectors are collapsed.  The rest are split into clusters, level by level, from bounded
    samples; each vector goes to its nearest few centres, so clusters overlap.  No two centres are
    links of each other, so a group of mutual links is not cut up.  In a cluster that is too dense
    to split, all vectors within half the threshold's angle of its centre are links of each other:
    these, its core, are counted by one sum and never compared.  The others of such a cluster are
    dealt into blocks, and every block meets every other one and those of the core, so that no
    shard is larger than a fixed number of rows and no pair inside a cluster is left out.
2.  Each shard builds its part of the graph: every vector's nearest candidates and some far ones,
    pruned robustly.  The adjacency lists of a vector from all its shards are united.
3.  An edge of the united lists between links that leaves a cluster takes its far end there as a
    visitor.  Each shard then searches for all its vectors over the united lists, members and
    visitors: greedily from the medoid, then expanding from everything in range until nothing new
    is in range.  Pairs are verified in double precision and counted once, in the first cluster in
    which both stand and one is at home.
4.  Shards hand on counts and a link of each vector to the smallest one of its local component,
    never pairs; Spark adds up counts and joins the components.
5.  A bounded number of queries, half of them vectors that a probe apart from the graph found to
    have links, is held against all vectors; if the share of links found is too low, everything is
    done again with more overlap, and at last by comparing all pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import connected, staged

THRESHOLD = 0.95
#: Rows of a shard at most; rows that a cluster should have; children of a cluster at most, so many that
#: half a million vectors need one level: on each level a vector goes to several clusters of each of its own.
LIMIT, TARGET, FAN = 2400, 1000, 1024
#: Sampled rows that a cluster's centres are fitted on; rows that one task assigns at a time.
SAMPLE, DEALT = 8192, 20_000
LEVELS = 8
#: Nearest candidates and far ones of a vector, edges kept, how much farther than a kept edge counts as covered.
NEAR, FAR, EDGES, ALPHA = 32, 16, 14, 1.2
#: Best vectors that a search keeps in view; searches that go on side by side; neighbours looked at at a time.
BEAM, ABREAST, LOOKED = 24, 300, 1_000_000
#: Nearest centres of a vector at first and at most; queries of the audit; share of links to be found.
OVERLAP, OVERLAP_MOST, AUDIT, RECALL = 2, 6, 400, 0.98
#: Vectors that the audit's probe looks at, about; random planes that it deals them by; rows of a deal.
PROBED, PLANES, DEAL = 20_000, 12, 2000


def unit_rows(lists: pa.Array) -> list[bytes | None]:
    """Unit vectors in double precision as bytes; None for null, empty, zero, non-finite vectors and null components."""
    out = []
    for x in lists:
        x = x.as_py()
        if not x or any(v is None for v in x):
            out.append(None)
            continue
        v = np.array(x, dtype=np.float64)
        if not np.isfinite(v).all() or not v.any():
            out.append(None)
            continue
        v = v / np.abs(v).max()
        out.append((v / np.sqrt(v @ v) + 0.0).tobytes())
    return out


def units(rows: DataFrame, key: str, column: str) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(unit_rows(batch.column(1)), pa.binary())], names=["id", "unit"])

    return rows.select(F.col(key).cast("long").alias("id"), F.col(column)).mapInArrow(make, "id long, unit binary")


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype=np.float64).reshape(len(values), -1) if values else np.zeros((0, 1))


def centres(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means from rows that are far from those chosen before."""
    chosen = [0]
    near = x @ x[0]
    for _ in range(min(k, len(x)) - 1):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    c = x[chosen]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.where(size > 0, size, 1), c)
    return c


def apart(c: np.ndarray, x: np.ndarray, threshold: float) -> np.ndarray:
    """Those of the centres that are no links of a larger one, so that a group of mutual links has one centre."""
    size = np.bincount((x @ c.T).argmax(axis=1), minlength=len(c))
    close = c @ c.T >= threshold
    kept: list[int] = []
    for i in np.argsort(-size, kind="stable"):
        if not close[i, kept].any():
            kept.append(int(i))
    return c[kept]


def routed(vectors: DataFrame, overlap: int, threshold: float = THRESHOLD) -> DataFrame:
    """(id, unit, n, cluster, size): every vector in its clusters.  ``vectors``: id, unit, n."""
    done = None
    now = vectors.select("id", "unit", "n", F.octet_length("unit").cast("string").alias("cluster"))
    for level in range(LEVELS + 1):
        now = staged(now, "routes")
        sizes = now.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
        parents = F.substring_index("cluster", ".", level)  # a child that is nearly its parent is dense
        if level:
            sizes = sizes.withColumn("parent", parents).join(before.select(F.col("cluster").alias("parent"), F.col("size").alias("was")), "parent")
            split = (F.col("size") > LIMIT) & (F.col("size") < 0.7 * F.col("was"))
        else:
            split = F.col("size") > LIMIT
        sizes = staged(sizes.withColumn("split", split & F.lit(level < LEVELS)).select("cluster", "size", "split"), "sizes")
        whole = now.join(sizes.where("not split"), "cluster").select("id", "unit", "n", "cluster", "size")
        done = whole if done is None else done.unionByName(whole)
        before = sizes.where("split")
        if before.isEmpty():
            return done
        open_ = now.join(before, "cluster")
        share = F.lit(float(SAMPLE)) / F.col("size")
        sample = open_.where(F.pmod(F.xxhash64(F.lit(level), "id"), F.lit(1 << 20)) < share * (1 << 20))

        def fit(rows: pa.Table) -> pa.Table:
            x = matrix(rows.column("unit"))
            k = min(FAN, max(2, -(-overlap * rows.column("size")[0].as_py() // TARGET)))
            c = apart(centres(x, k), x, threshold)
            return pa.table({"cluster": pa.array([rows.column("cluster")[0].as_py()], pa.string()), "centres": pa.array([c.tobytes()], pa.binary())})

        fitted = staged(sample.groupBy("cluster").applyInArrow(fit, "cluster string, centres binary"), "centres")
        dealt = F.ceil(F.col("size") / F.lit(DEALT)).cast("int")
        rows = open_.withColumn("salt", F.pmod(F.xxhash64("id"), dealt).cast("int"))
        spread = before.join(fitted, "cluster").select("cluster", "centres", F.explode(F.sequence(F.lit(0), dealt - 1)).alias("salt"))

        def assign(rows: pa.Table, fitted: pa.Table) -> pa.Table:
            x = matrix(rows.column("unit"))
            c = np.frombuffer(fitted.column("centres")[0].as_py(), dtype=np.float64).reshape(-1, x.shape[1])
            near = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :overlap]
            at = np.repeat(np.arange(len(x)), near.shape[1])
            cluster = rows.column("cluster")[0].as_py() if len(x) else ""
            names = pa.array([f"{cluster}.{i}" for i in near.ravel()], pa.string())
            return rows.select(["id", "unit", "n"]).take(pa.array(at)).append_column("cluster", names)

        now = rows.select("id", "unit", "n", "cluster", "salt").groupBy("cluster", "salt").cogroup(spread.groupBy("cluster", "salt")).applyInArrow(assign, "id long, unit binary, n long, cluster string")
    return done


def cored(routes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Adds core: the first dense cluster in whose core a vector is, or null; all vectors of a core are links.

    Two vectors within half the threshold's angle of one direction are within the whole angle of
    each other, whatever the direction, so a sample is enough to choose it by.
    """
    half = np.cos(np.arccos(threshold) / 2 - 1e-6) if 0 < threshold < 1 else 2.0
    dense = routes.where(F.col("size") > LIMIT)
    sizes = staged(dense.select("cluster", "size").distinct(), "dense")
    if sizes.isEmpty():
        return routes.drop("size").withColumn("core", F.lit(None).cast("string"))
    share = F.lit(float(SAMPLE)) / F.col("size")
    sample = dense.where(F.pmod(F.xxhash64(F.lit("core"), "id"), F.lit(1 << 20)) < share * (1 << 20))

    def centre(rows: pa.Table) -> pa.Table:
        c = matrix(rows.column("unit")).mean(axis=0)
        c /= np.linalg.norm(c) or 1.0
        return pa.table({"cluster": pa.array([rows.column("cluster")[0].as_py()], pa.string()), "centre": pa.array([c.tobytes()], pa.binary())})

    fitted = staged(sample.groupBy("cluster").applyInArrow(centre, "cluster string, centre binary"), "cores")
    dealt = F.ceil(F.col("size") / F.lit(DEALT)).cast("int")
    rows = dense.withColumn("salt", F.pmod(F.xxhash64("id"), dealt).cast("int")).select("id", "unit", "cluster", "salt")
    spread = sizes.join(fitted, "cluster").select("cluster", "centre", F.explode(F.sequence(F.lit(0), dealt - 1)).alias("salt"))

    def inside(rows: pa.Table, fitted: pa.Table) -> pa.Table:
        near = np.zeros(0, dtype=np.int64)
        if rows.num_rows and fitted.num_rows:
            near = np.flatnonzero(matrix(rows.column("unit")) @ np.frombuffer(fitted.column("centre")[0].as_py(), dtype=np.float64) >= half)
        return rows.select(["id", "cluster"]).take(pa.array(near))

    own = rows.groupBy("cluster", "salt").cogroup(spread.groupBy("cluster", "salt")).applyInArrow(inside, "id long, cluster string")
    first = own.groupBy("id").agg(F.min("cluster").alias("core"))
    return routes.drop("size").join(staged(first, "core"), "id", "left")


def core_links(vectors: DataFrame, cores: DataFrame) -> DataFrame:
    """(id, links, root) of the vectors in cores, each linked with all others of its core; ``cores``: id, core."""
    own = cores.where("core is not null").select("id", "core").distinct().join(vectors.select("id", "n"), "id")
    sums = own.groupBy("core").agg(F.sum("n").alias("total"), F.min("id").alias("root"))
    return own.join(sums, "core").select("id", (F.col("total") - F.col("n")).alias("links"), "root")


def sharded(rows: DataFrame) -> DataFrame:
    """Adds shard and salt: a cluster within the limit is one shard; the rows of a larger one that are not
    its core are dealt into blocks, its core into others, and every pair of blocks but two of the core is a shard."""
    rows = rows.withColumn("inside", F.coalesce(F.col("core") == F.col("cluster"), F.lit(False)))
    sizes = rows.groupBy("cluster").agg(F.count_if("inside").alias("core_size"), F.count_if(~F.col("inside")).alias("rest_size"))
    blocks = lambda size: F.ceil(F.col(size) / F.lit(LIMIT * 0.4)).cast("int")
    large = F.col("core_size") + F.col("rest_size") > LIMIT
    sizes = sizes.select("cluster", F.when(large, blocks("rest_size")).otherwise(1).alias("rest"), F.when(large, blocks("core_size")).otherwise(0).alias("cores"))
    rows = rows.join(sizes, "cluster")
    parted = F.col("inside") & (F.col("cores") > 0)
    hash_ = F.xxhash64("id", F.lit("block"))
    salt = F.when(parted, F.col("rest") + F.pmod(hash_, F.col("cores"))).otherwise(F.pmod(hash_, F.greatest("rest", F.lit(1))))
    others = F.when(parted, F.col("rest")).otherwise(F.col("rest") + F.col("cores"))
    rows = rows.withColumn("salt", salt.cast("int")).where(others > 0).withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    pair = F.concat_ws("/", "cluster", F.least("salt", "other"), F.greatest("salt", "other"))
    return rows.withColumn("shard", pair).drop("other", "inside", "rest", "cores")


def pruned(x: np.ndarray, i: int, candidates: np.ndarray) -> list[int]:
    """Edges of row i: always the nearest candidate left, which covers those much nearer to it than to i."""
    order = candidates[np.argsort(-(x[candidates] @ x[i]), kind="stable")]
    apart = 1 - x[order] @ x[i]
    between = 1 - x[order] @ x[order].T
    left, out = np.ones(len(order), dtype=bool), []
    for k in range(len(order)):
        if left[k]:
            out.append(int(order[k]))
            if len(out) == EDGES:
                break
            left &= ALPHA * between[k] > apart
    return out


def built(rows: pa.Table, threshold: float = THRESHOLD) -> pa.Table:
    """Adjacency lists of one shard's graph, in both directions: all edges, and those between links."""
    ids, x = rows.column("id").to_numpy(), matrix(rows.column("unit")).astype(np.float32)
    n = len(ids)
    if n < 2:
        none = pa.array([[]] * n, pa.list_(pa.int64()))
        return pa.table({"id": pa.array(ids), "near": none, "close": none})
    rng = np.random.default_rng(n)
    edges: list[set[int]] = [set() for _ in range(n)]
    for at in range(0, n, 500):
        sims = x[at : at + 500] @ x.T
        sims[np.arange(len(sims)), np.arange(at, at + len(sims))] = -2
        near = np.argpartition(-sims, min(NEAR, n - 1) - 1, axis=1)[:, : min(NEAR, n - 1)]
        for k, row in enumerate(near):
            i = at + k
            far = rng.integers(0, n, FAR)
            candidates = np.unique(np.concatenate((row, far[far != i])))
            for j in pruned(x, i, candidates):
                edges[i].add(j)
                edges[j].add(i)
    lists = [np.array(sorted(e), dtype=np.int64) for e in edges]
    close = [e[x[e] @ x[i] >= threshold - 1e-4] for i, e in enumerate(lists)]
    return pa.table({"id": pa.array(ids), **{name: pa.array([ids[e] for e in own], pa.list_(pa.int64())) for name, own in (("near", lists), ("close", close))}})


def searched(x: np.ndarray, lists: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which rows each row's search meets in range: greedy from the medoid, then expanding from all in range.

    ``lists``: neighbours of each row, few or many; work goes by those looked at, not by the longest list.
    """
    n = len(x)
    slack = threshold - 1e-4  # single precision; verified later
    every = np.arange(n)
    degree = np.fromiter(map(len, lists), dtype=np.int64, count=n)
    start, flat = np.cumsum(degree) - degree, np.concatenate([*lists, np.zeros(1, dtype=np.int64)])
    seen, inside = np.eye(n, dtype=bool), np.zeros((n, n), dtype=bool)
    medoid = int((x @ x.mean(axis=0)).argmax())
    beam = np.full((n, BEAM), -1, dtype=np.int64)
    sims = np.full((n, BEAM), -9, dtype=np.float32)
    opened = np.ones((n, BEAM), dtype=bool)
    beam[:, 0], sims[:, 0], opened[:, 0] = medoid, x @ x[medoid], False
    seen[:, medoid] = True
    inside[:, medoid] = sims[:, 0] >= slack
    live = every
    while len(live):  # every step opens a row for each query and none twice
        shut = np.where(opened[live], -9, sims[live])
        pick = shut.argmax(axis=1)
        going = shut[np.arange(len(live)), pick] > -9
        live, pick = live[going], pick[going]
        opened[live, pick] = True
        node = beam[live, pick]
        order = np.argsort(degree[node], kind="stable")  # those with lists of about one length side by side
        for at in range(0, len(live), ABREAST):
            own, row = live[order[at : at + ABREAST]], node[order[at : at + ABREAST]]
            width = np.arange(degree[row].max())
            new = flat[np.minimum(start[row][:, None] + width, len(flat) - 1)]
            fresh = (width < degree[row][:, None]) & ~seen[own[:, None], new]
            q, r = np.nonzero(fresh)
            found = np.full(new.shape, -9, dtype=np.float32)
            found[q, r] = np.einsum("pd,pd->p", x[own[q]], x[new[q, r]])
            seen[own[q], new[q, r]] = True
            q, r = np.nonzero(found >= slack)
            inside[own[q], new[q, r]] = True
            all_ids, all_sims = np.concatenate((beam[own], new), axis=1), np.concatenate((sims[own], found), axis=1)
            all_open = np.concatenate((opened[own], ~fresh), axis=1)
            top = np.argpartition(-all_sims, BEAM - 1, axis=1)[:, :BEAM]
            beam[own], sims[own], opened[own] = (np.take_along_axis(a, top, axis=1) for a in (all_ids, all_sims, all_open))
    inside[every, every] = False
    q, v = np.nonzero(inside)
    while len(q):
        grown_q, grown_v = [], []
        ends = np.cumsum(degree[v])
        parts = np.flatnonzero(np.diff(ends // LOOKED, prepend=0)).tolist()
        for low, high in zip([0, *parts], [*parts, len(q)], strict=True):
            own, row = q[low:high], v[low:high]
            owner, many = np.repeat(own, degree[row]), degree[row].sum()
            first = np.repeat(start[row] - (np.cumsum(degree[row]) - degree[row]), degree[row])
            met = owner * n + flat[first + np.arange(many)]
            met = np.unique(met[~seen.ravel()[met]])
            a, b = met // n, met % n
            seen[a, b] = True
            hit = np.concatenate([np.einsum("pd,pd->p", x[a[k : k + 50_000]], x[b[k : k + 50_000]]) >= slack for k in range(0, max(1, len(a)), 50_000)])
            a, b = a[hit], b[hit]
            inside[a, b] = True
            grown_q.append(a)
            grown_v.append(b)
        q, v = np.concatenate(grown_q), np.concatenate(grown_v)
    inside |= inside.T
    inside[every, every] = False
    return inside


def compared(x: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows each row has in range, by comparing all with all."""
    inside = x @ x.T >= threshold - 1e-4  # single precision; verified later
    np.fill_diagonal(inside, False)
    return inside


def linked(rows: pa.Table, threshold: float, exact: bool = False) -> pa.Table:
    """Per row of a shard: links counted here, and the smallest row of its component here."""
    rows = rows.sort_by("id")
    ids, unit, n_of = rows.column("id").to_numpy(), matrix(rows.column("unit")), rows.column("n").to_numpy()
    n = len(ids)
    lists = []
    for near in [] if exact else rows.column("near").to_pylist():
        at = np.searchsorted(ids, near or [])
        lists.append(at[ids[np.minimum(at, n - 1)] == (near or [])])
    single = unit.astype(np.float32)
    a, b = np.nonzero(np.triu(compared(single, threshold) if exact else searched(single, lists, threshold)))
    true = np.concatenate([np.einsum("pd,pd->p", unit[a[k : k + 50_000]], unit[b[k : k + 50_000]]) for k in range(0, max(1, len(a)), 50_000)]) >= threshold
    a, b = a[true], b[true]
    root = np.arange(n)
    while len(a):  # smallest index of each component, by minima along links and jumps
        old = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (root == old).all():
            break
    cluster, shard = rows.column("cluster")[0].as_py(), rows.column("shard")[0].as_py().split("/")
    salt = rows.column("salt").to_numpy()
    here = salt[a] != salt[b] if shard[1] != shard[2] else np.ones(len(a), dtype=bool)
    core = rows.column("core").to_pylist()
    cores = {c: i for i, c in enumerate(sorted({c for c in core if c is not None}))}
    core = np.array([-1 if c is None else cores[c] for c in core])
    here &= (core[a] < 0) | (core[a] != core[b])  # counted with their core
    # the clusters in which each row stands, and in which of them it is at home
    clusters, homes = rows.column("clusters").to_pylist(), rows.column("homes").to_pylist()
    number = {c: i for i, c in enumerate(sorted({c for own in clusters for c in own}))}
    most = max(map(len, clusters))
    own, home = np.full((n, most), -1), np.zeros((n, most), dtype=bool)
    for i, (stands, at_home) in enumerate(zip(clusters, homes, strict=True)):
        own[i, : len(stands)] = [number[c] for c in stands]
        home[i, : len(stands)] = [c in at_home for c in stands]
    this = (home & (own == number[cluster])).any(axis=1)
    here &= this[a] | this[b]
    step = max(1, 4_000_000 // most**2)
    for k in range(0, len(a), step):
        p, q = a[k : k + step], b[k : k + step]
        both = (own[p][:, :, None] == own[q][:, None, :]) & (own[p][:, :, None] >= 0) & (own[p][:, :, None] < number[cluster]) & (home[p][:, :, None] | home[q][:, None, :])
        here[k : k + step] &= ~both.any(axis=(1, 2))
    links = np.bincount(a[here], weights=n_of[b[here]], minlength=n) + np.bincount(b[here], weights=n_of[a[here]], minlength=n)
    return pa.table({"id": pa.array(ids), "links": pa.array(links.astype(np.int64)), "root": pa.array(ids[root])})


def visitors(lists: DataFrame, homes: DataFrame) -> DataFrame:
    """(id, cluster): the clusters that a vector is not in, but at the end of an edge between links from there."""
    edges = lists.select("id", F.explode("close").alias("to"))
    left = edges.join(homes.select("id", F.col("homes").alias("from")), "id")
    both = left.join(homes.select(F.col("id").alias("to"), "homes"), "to")
    return both.select(F.col("to").alias("id"), F.explode(F.array_except("from", "homes")).alias("cluster")).distinct()


def graph_links(vectors: DataFrame, *, threshold: float = THRESHOLD, overlap: int = OVERLAP) -> DataFrame:
    """(id, links, root) rows of all shards and cores over distinct ``vectors`` (id, unit, n)."""
    members = staged(cored(routed(vectors, overlap, threshold), threshold), "members")

    def build(rows: pa.Table) -> pa.Table:
        return built(rows, threshold)

    def search(rows: pa.Table) -> pa.Table:
        return linked(rows, threshold)

    parts = sharded(members).groupBy("shard").applyInArrow(build, "id long, near array<long>, close array<long>")
    united = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    lists = staged(parts.groupBy("id").agg(united("near"), united("close")), "adjacency")
    homes = staged(members.groupBy("id").agg(F.sort_array(F.collect_set("cluster")).alias("homes"), F.first("unit").alias("unit"), F.first("n").alias("n"), F.first("core").alias("core")), "homes")
    guests = staged(visitors(lists, homes), "visitors")
    stands = guests.groupBy("id").agg(F.collect_set("cluster").alias("visits"))
    known = homes.join(stands, "id", "left").join(lists.select("id", "near"), "id", "left")
    known = staged(known.withColumn("clusters", F.concat("homes", F.coalesce("visits", F.array().cast("array<string>")))).drop("visits"), "united")
    rows = sharded(known.select("*", F.explode("clusters").alias("cluster")))
    found = rows.groupBy("shard").applyInArrow(search, "id long, links long, root long")
    return staged(found.unionByName(core_links(vectors, members)), "links")


def exact_links(vectors: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """The same rows as graph_links, by comparing all vectors of one length with all, in pairs of blocks."""
    whole = vectors.select("id", "unit", "n", F.octet_length("unit").cast("string").alias("cluster"), F.lit(None).cast("string").alias("core"))
    rows = sharded(whole).withColumns({"clusters": F.array("cluster"), "homes": F.array("cluster")})

    def search(rows: pa.Table) -> pa.Table:
        return linked(rows, threshold, exact=True)

    return staged(rows.groupBy("shard").applyInArrow(search, "id long, links long, root long"), "links")


def probed(vectors: DataFrame, total: int, threshold: float) -> DataFrame:
    """Ids of vectors with links, found apart from the graph: some of the buckets that random planes deal
    the vectors into are compared in themselves, of a large bucket one deal."""

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            made = []
            for x in batch.column(1).to_pylist():
                v = np.frombuffer(x, dtype=np.float64)
                if len(v) not in planes:
                    planes[len(v)] = np.random.default_rng(len(v)).normal(size=(PLANES, len(v)))
                made.append((len(v) << PLANES) + int((planes[len(v)] @ v > 0) @ (1 << np.arange(PLANES))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.int64())], names=["id", "unit", "bucket"])

    def compare(rows: pa.Table) -> pa.Table:
        x = matrix(rows.column("unit"))
        hit = (x @ x.T >= threshold).sum(axis=1) > 1
        return rows.select(["id"]).filter(pa.array(hit))

    rows = vectors.select("id", "unit").mapInArrow(bucket, "id long, unit binary, bucket long")
    rows = staged(rows.where(F.pmod(F.xxhash64(F.lit("probe"), "bucket"), F.lit(1 << 20)) < F.lit((1 << 20) * PROBED / max(1, total))), "probe")
    sizes = rows.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / F.lit(DEAL)).alias("deals"))
    one = rows.join(sizes, "bucket").where(F.pmod(F.xxhash64("id"), F.col("deals")) == 0).select("id", "unit", "bucket")
    return one.groupBy("bucket").applyInArrow(compare, "id long")


def audited(vectors: DataFrame, counts: DataFrame, *, threshold: float = THRESHOLD, queries: int = AUDIT) -> float | None:
    """Share of the links of some queries that ``counts`` (id, links) has: of all, or a query's on average if that is less.

    Half of the queries are any vectors, half are vectors that the probe found to have links.  They
    are compared with every vector.  None if not one of them has a link: then nothing was measured.
    """
    total = vectors.count()
    known = staged(probed(vectors, total, threshold), "probed")

    def some(rows: DataFrame, n: int) -> DataFrame:
        return rows.where(F.pmod(F.xxhash64(F.lit("audit"), "id"), F.lit(1 << 30)) < F.lit((1 << 30) * queries / 2 / max(1, n))).select("id")

    chosen = some(vectors, total).unionByName(some(known, known.count())).distinct()
    asked = vectors.join(chosen, "id", "left_semi").join(counts, "id", "left").toArrow()
    groups: dict[int, list[int]] = {}
    for i, x in enumerate(asked.column("unit").to_pylist()):
        groups.setdefault(len(x), []).append(i)
    blocks = vectors.sparkSession.sparkContext.broadcast([(asked.column("id").to_numpy()[at], matrix(asked.column("unit").take(pa.array(at)))) for at in groups.values()])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, int] = {}
        for batch in batches:
            own, ids, weight = batch.column(1).to_pylist(), batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for keys, q in blocks.value:
                at = np.array([i for i, x in enumerate(own) if len(x) == 8 * q.shape[1]], dtype=np.int64)
                for k in range(0, len(at), 2000):
                    part = at[k : k + 2000]
                    hit = q @ np.frombuffer(b"".join(own[i] for i in part), dtype=np.float64).reshape(-1, q.shape[1]).T >= threshold
                    hit &= keys[:, None] != ids[part][None, :]
                    for key, more in zip(keys.tolist(), (hit @ weight[part]).tolist(), strict=True):
                        n[key] = n.get(key, 0) + more
        yield pa.RecordBatch.from_pydict({"id": pa.array(list(n), pa.int64()), "n": pa.array(list(n.values()), pa.int64())})

    rows = vectors.select("id", "unit", "n").mapInArrow(compare, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).where("n > 0").collect()
    found = {k: x or 0 for k, x in zip(asked.column("id").to_pylist(), asked.column("links").to_pylist(), strict=True)}
    if not rows:
        return None
    return min(sum(found[r.id] for r in rows) / sum(r.n for r in rows), sum(found[r.id] / r.n for r in rows) / len(rows))


def near_duplicates(rows: DataFrame, *, key: str = "vec_id", column: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: ``key``, n_links, component_id, kept, recall (of the audit; null if no query had a link).

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null
    key, link with nothing and are their own component.  Vectors of different lengths never link.
    Repeated rows count as vectors of their own.
    """
    every = staged(units(rows, key, column), "units")
    valid = every.where("unit is not null and id is not null")
    distinct = staged(valid.groupBy("unit").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).select("id", "unit", "n"), "vectors")
    overlap = OVERLAP
    while True:
        parts = graph_links(distinct, threshold=threshold, overlap=overlap)
        counts = parts.groupBy("id").agg(F.sum("links").alias("links"))
        recall = audited(distinct, counts, threshold=threshold)
        if recall is None or recall >= RECALL:
            break
        if overlap >= OVERLAP_MOST:
            parts = exact_links(distinct, threshold=threshold)
            counts = parts.groupBy("id").agg(F.sum("links").alias("links"))
            recall = audited(distinct, counts, threshold=threshold)
            break
        overlap += 2
    member = connected(parts.select(F.col("id").alias("a"), F.col("root").alias("b")))
    known = distinct.join(counts, "id", "left").join(member, F.col("id") == F.col("node"), "left")
    known = known.select("unit", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = every.join(known, "unit", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    # a row with a null key may hold a vector that others have: it links with nothing all the same
    own = F.col("id").isNull()
    return out.select(F.col("id").alias(key), F.when(own, 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"), F.when(~own, F.col("component_id")).alias("component_id"), F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"), F.lit(recall).cast("double").alias("recall"))


def op6_embeddings(spark, sf_dir: str) -> DataFrame:
    """Every vector with the number of its links and the smallest vector that links reach.

    Null, empty, zero and non-finite vectors and those with a null component link with nothing;
    equal ones and rows that repeat are links of each other; an empty table gives no rows.
    """
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
