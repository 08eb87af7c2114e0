"""Hard-negative mining by Fagin's threshold algorithm over shards of vectors.

Vectors are whole numbers (floor of SCALE times each component), so scores are exact.  They are
dealt into shards; a shard keeps, for every dimension, its rows sorted by that component.  For an
anchor the lists are read in step, each from its high end where the anchor's component is positive
and from its low end where it is negative.  A row that any list shows is scored at once, from all
its components.  What the lists show last bounds the score of all rows not seen (the threshold);
reading stops once the threshold is strictly below the last score that each window keeps, so ties
are always seen, or below what the window admits.

That is done twice: first for an anchor's positives, then, with a window of scores for each
positive, for its negatives.  A shard hands on its best few rows a window, and the best of all
shards are ranked.  Anchors are a stated set; they meet the shards in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.llm.common import staged

#: Components are multiplied by this and rounded down.
SCALE = 256
#: Positives of an anchor, negatives of a positive, and percents of the positive's score between which a negative lies.
POSITIVES, NEGATIVES, LEAST, MOST = 5, 10, 30, 90
#: Components of a shard's rows, anchors of a block, rows that a list shows at first.
SHARD, BLOCK, FIRST = 1 << 19, 1024, 32
#: Bounds of a score: whole 64-bit numbers.
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def one(column: pa.ChunkedArray) -> pa.Array:
    """A column's lists in one array."""
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def whole(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of whole numbers, zeros behind vectors shorter than ``width``; beyond 64 bits components stay at the bounds."""
    lists = one(column)
    sizes = np.diff(lists.offsets.to_numpy())
    values = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    values = np.where(values >= 2.0**63, HIGHEST, np.clip(values, -(2.0**63), 2.0**63 - 1024).astype(np.int64))
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def components(rows: pa.Table, name: str) -> int:
    return int(np.diff(one(rows.column(name)).offsets.to_numpy()).max(initial=0))


class Shard:
    """Rows under sorted lists, one a dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable")
        self.read = 0  # rows scored so far, for tests and figures

    def best(self, anchor: np.ndarray, eligible: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) of each window's first k eligible rows with low <= score <= high; high scores first, then small ids."""
        n, dims = self.vectors.shape
        kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
        if not n or not windows:
            return kept
        down = anchor >= 0
        # one column a dimension, the end to read from first
        lists = np.where(down, self.order[::-1], self.order) if dims else np.zeros((n, 0), np.int64)
        seen = np.zeros(n, dtype=bool)
        at, step = 0, FIRST if dims else n
        while True:
            to = min(n, at + step)
            fresh = np.zeros(n, dtype=bool)
            fresh[lists[at:to].ravel() if dims else slice(None)] = True
            fresh &= ~seen
            seen |= fresh
            rows = np.flatnonzero(fresh)
            self.read += len(rows)
            rows = rows[eligible[rows]]
            scores = self.vectors[rows] @ anchor
            for w, (low, high) in enumerate(windows):
                inside = (scores >= low) & (scores <= high)
                if inside.any():
                    ids, values = np.concatenate((kept[w][0], self.ids[rows[inside]])), np.concatenate((kept[w][1], scores[inside]))
                    first = np.lexsort((ids, ~values))[:k]
                    kept[w] = ids[first], values[first]
            if to == n:
                return kept
            # in Python's whole numbers, which do not wrap
            threshold = sum(int(a) * int(self.vectors[lists[to - 1, j], j]) for j, a in enumerate(anchor))
            if all(threshold < low or (len(ids) == k and threshold < values[-1]) for (ids, values), (low, _) in zip(kept, windows, strict=True)):
                return kept
            at, step = to, 2 * step


def vectors_of(rows: DataFrame, key: str, vector: str, label: Column) -> DataFrame:
    """(id, vector, label) of the rows that take part, one a key: the one with the smallest label, then vector."""
    x, own = F.col(vector), F.col(key).cast("long")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) != F.lit(float("inf"))))
    whole_rows = rows.where(own.isNotNull() & x.isNotNull() & sound).select(own.alias("id"), x.alias("vector"), label.cast("long").alias("label")).where("label is not null")
    return whole_rows.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row")).select("id", "row.vector", "row.label")


PAIRS = "anchor_id long, positive_id long, positive_score long, id long, score long"


def table_of(found: list[list[np.ndarray]]) -> pa.Table:
    columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 5
    return pa.table({name.split()[0]: pa.array(c.astype(np.int64)) for name, c in zip(PAIRS.split(", "), columns, strict=True)})


def met(shards: pa.Table, anchors: pa.Table, k: int, low: int, high: int) -> pa.Table:
    """What a shard has for a block of anchors: positives where an anchor names none yet, else negatives."""
    found: list[list[np.ndarray]] = []
    if "vector" not in shards.column_names or "anchor" not in anchors.column_names:  # one side has no rows here
        return table_of(found)
    width = max(components(shards, "vector"), components(anchors, "anchor"))
    shard = Shard(shards.column("id").to_numpy(), shards.column("label").to_numpy(), whole(shards.column("vector"), width))
    own, labels, vectors = anchors.column("own").to_numpy(), anchors.column("kind").to_numpy(), whole(anchors.column("anchor"), width)
    for i, positives in enumerate(anchors.column("positives")):
        same = shard.labels == labels[i]
        if not positives.is_valid:
            for ids, scores in shard.best(vectors[i], same & (shard.ids != own[i]), [(LOWEST, HIGHEST)], k):
                found.append([np.full(len(ids), own[i]), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), ids, scores])
            continue
        listed = [(p["id"], p["score"]) for p in positives.as_py()]
        # low * p <= 100 * score <= high * p in whole numbers
        windows = [(-(-low * p // 100), high * p // 100) for _, p in listed]
        open_ = [w for w, (a, b) in enumerate(windows) if a <= b]
        for w, (ids, scores) in zip(open_, shard.best(vectors[i], ~same, [windows[w] for w in open_], k), strict=True):
            found.append([np.full(len(ids), own[i]), np.full(len(ids), listed[w][0]), np.full(len(ids), listed[w][1]), ids, scores])
    return table_of(found)


def mined(rows: DataFrame, anchors: Column, *, key: str = "vec_id", vector: str = "embedding", label: str | Column = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LEAST, high: int = MOST) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the anchors' hard negatives.

    ``anchors`` tells by ``id`` which rows are anchors.  Rows with a null key, label or vector, or
    with a null or non-finite component, take no part; of rows with one key the smallest label and
    vector stays.  Shorter vectors count as followed by zeros.  A positive of a score below zero has
    no negatives, one of zero those of score zero.  An empty table gives no rows.
    """
    label = F.col(label) if isinstance(label, str) else label
    points = staged(vectors_of(rows, key, vector, label), "vectors")
    queries = points.where(anchors)
    n, width, asked = points.agg(F.count(F.lit(1)), F.max(F.size("vector")), F.count_if(anchors)).first()
    shards, blocks = max(1, -(-(n * max(1, width or 1)) // SHARD)), max(1, -(-asked // BLOCK))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    dealt = points.select("id", "vector", "label", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard")).withColumn("block", every(blocks))

    def asked_of(anchor_rows: DataFrame, k: int) -> DataFrame:
        # under names of their own: Spark takes equal columns of one table on both sides for the same
        asking = anchor_rows.select(F.col("id").alias("own"), F.col("vector").alias("anchor"), F.col("label").alias("kind"), "positives", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")).withColumn("shard", every(shards))
        return dealt.groupBy("shard", "block").cogroup(asking.groupBy("shard", "block")).applyInArrow(lambda left, right: met(left, right, k, low, high), PAIRS)

    def first(found: DataFrame, k: int, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    kind = "array<struct<id:long,score:long>>"
    best = first(asked_of(queries.withColumn("positives", F.lit(None).cast(kind)), positives), positives, "anchor_id")
    listed = best.groupBy("anchor_id").agg(F.collect_list(F.struct("id", "score")).cast(kind).alias("positives"))
    known = staged(queries.join(listed, F.col("id") == F.col("anchor_id")).select("id", "vector", "label", "positives"), "positives")
    found = first(asked_of(known, negatives), negatives, "anchor_id", "positive_id")
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_negatives(spark, sf_dir: str) -> DataFrame:
    """The hard negatives of every vector whose vec_id is divisible by 100 (see mined).

    Labels move on by one, modulo 10, where vec_id is divisible by 7.
    """
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 100 == 0, label=label)


ORACLE = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
      FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) <= 10
"""
