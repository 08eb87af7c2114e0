"""Mixing sources to target weights by systematic sampling, in DataFrame operations alone.

The sources share the size of all documents by weight; a source gives at most ``most`` times its
own size, and what it cannot take is shared out again by weight among the others.  Every document
of a source then has the same expected number of copies, the source's rate.  The expected copies
are summed up along the source's documents, one offset is added, and a document is taken once for
each whole number that its part of the sum crosses.  The documents stand in order of size, so
that any stretch of the order holds its fair share of words and the sum of taken words follows the
target closely.

No source is gathered in one task.  Its order is cut into strata (leading digits of the size, then
256 hash classes of key and text); documents are counted inside their stratum, and the strata of a
source, at most a few hundred thousand however large the source is, are added up in between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.llm.common import hidden, indexed, shown, staged

#: Weights of the sources in order of their names, repeating; times its size a source gives at most.
WEIGHTS, MOST = (1, 2, 3), 3
#: Binary places of rates and offsets: sums are whole numbers, so no rounding adds or drops a copy.
PLACES = 24
SEED = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A source's name as a key that is never null: nulls come last, after every name."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(_source, source_size, target, rate) of each source in ``sized`` (_source, size).

    One row a source.  A round of sharing needs three sums over this table, and only those reach
    the driver; there are as many rounds as it takes until no source is above its limit.
    """
    sums = sized.groupBy("_source").agg(F.sum("size").alias("source_size"))
    placed = indexed(sums, ["_source"], "sources")
    cycle = F.array(*(F.lit(w) for w in weights))
    weighed = placed.withColumn("weight", F.element_at(cycle, (F.col("_before") % len(weights) + 1).cast("int"))).withColumn("limit", most * F.col("source_size"))
    weighed = staged(weighed, "weights")
    share, stopped = None, F.lit(False)
    while True:
        total, held, free = weighed.agg(F.sum("source_size"), F.sum(F.when(stopped, F.col("limit")).otherwise(0)), F.sum(F.when(stopped, 0).otherwise(F.col("weight")))).first()
        share_now = (total - held) / free if free else 0.0
        if share_now == share or not free:
            break
        share = share_now
        stopped = F.col("weight") * F.lit(share) > F.col("limit")
    share = F.lit(float(share or 0.0))
    target = F.when(F.col("weight") * share > F.col("limit"), F.col("limit").cast("double")).otherwise(F.col("weight") * share)
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * (1 << PLACES))).otherwise(0).cast("long")
    return weighed.withColumn("target", target).select("_source", "source_size", "target", rate.alias("rate"))


#: What a mix adds to the columns of its input.
ADDED = ("size", "source_size", "target", "copies")


def taken(docs: DataFrame, key: str, text: str, source: str, weights: tuple[int, ...], most: int, seed: str) -> tuple[DataFrame, dict[str, str]]:
    """Every row with size, source_size, target and copies, its own columns hidden (see common.hidden)."""
    rows, names = hidden(docs)
    key, text, source = (F.col(names[c]) for c in (key, text, source))
    digits = F.length(F.col("size").cast("string"))
    stratum = F.concat(F.lpad(digits.cast("string"), 2, "0"), F.substring(F.col("size").cast("string"), 1, 2))
    name = F.md5(F.concat_ws("/", F.coalesce(key.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))
    rows = rows.withColumn("size", word_count(text)).withColumn("_source", source_key(source))
    rows = rows.withColumn("_digits", stratum).withColumn("_name", name).withColumn("_class", F.substring("_name", 1, 2))
    parts = ["_source", "_digits", "_class"]
    counted = staged(rows.groupBy(*parts).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")), "strata")
    shares = targets(counted.select("_source", "size"), weights, most)
    before = Window.partitionBy("_source").orderBy("_digits", "_class").rowsBetween(Window.unboundedPreceding, -1)
    strata = counted.select(*parts, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start")).join(shares, "_source")
    inside = Window.partitionBy(*parts).orderBy("size", "_name")
    placed = rows.withColumn("_nth", F.row_number().over(inside).cast("long")).join(strata, parts)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), "_source")), 1, PLACES // 4), 16, 10).cast("long")
    upto = lambda n: F.shiftright(n * F.col("rate") + offset, PLACES)
    nth = F.col("_start") + F.col("_nth")
    return placed.withColumn("copies", upto(nth) - upto(nth - 1)), names


def mixed(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """Adds size, source_size, target and copies (how often the mix takes the row) to ``docs``.

    Null texts and texts without words have size 0; they are counted in their stratum like others.
    Rows with equal keys are told apart by their text's hash, and equal rows are interchangeable,
    so a rerun takes the same rows.  A null source is a source of its own, the last one.  An empty
    table gives an empty mix.  Columns of the four added names are replaced, all others kept.
    """
    rows, names = taken(docs, key, text, source, weights, most, seed)
    return rows.select(*shown(names, ADDED), *ADDED)


def repeated(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with all its columns as they are."""
    rows, names = taken(docs, key, text, source, weights, most, seed)
    copies = F.explode(F.expr("filter(sequence(0L, copies), x -> x > 0)"))
    return rows.where("copies > 0").withColumn("_copy", copies).select(*shown(names))


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """Every document with its size, its source's size and target, and the words that the mix takes of it.

    Null texts have size 0 and a null source is the last one (see mixed).  Rows that repeat keep a
    row each; an empty table gives no rows.
    """
    rows = mixed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || '/' || md5(coalesce(text, ''))) AS name
  FROM documents),
s AS (SELECT src, sum(size)::BIGINT AS source_size,
             [1, 2, 3][(row_number() OVER (ORDER BY src) - 1) % 3 + 1] AS w FROM d GROUP BY src),
r AS (SELECT *, 3 * source_size AS cap, sum(source_size) OVER ()::BIGINT AS total,
             coalesce(sum(3 * source_size) OVER o, 0)::BIGINT AS held,
             (sum(w) OVER () - coalesce(sum(w) OVER o, 0))::BIGINT AS free
      FROM s WINDOW o AS (ORDER BY source_size / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max((total - held) / free) FILTER (WHERE (total - held) / free * w <= cap) AS share FROM r),
t AS (SELECT src, source_size, least(w * share, cap::DOUBLE) AS target FROM r, l),
k AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size * 16777216)::BIGINT ELSE 0 END AS rate,
             ('0x' || substr(md5('mix' || src), 1, 6))::BIGINT AS u FROM t),
n AS (SELECT d.*, k.source_size, k.target, k.rate, k.u,
             row_number() OVER (PARTITION BY d.src ORDER BY lpad(length(size::VARCHAR)::VARCHAR, 2, '0') || substr(size::VARCHAR, 1, 2), substr(name, 1, 2), size, name) AS i
      FROM d JOIN k USING (src))
SELECT doc_id, size, source_size, target, (((i * rate + u) >> 24) - (((i - 1) * rate + u) >> 24)) * size AS taken FROM n
"""
