"""SimHash near-duplicates by a segment-popcount embedding and a grid range-join.

A fingerprint's 64 bits are cut into 32 segments of two bits.  The counts of set bits per segment
(0, 1 or 2) are a point on a grid; flipping one bit moves the point by one step, so the Manhattan
distance of two points never exceeds the Hamming distance of their fingerprints.  Two points that
lie at most three steps apart lie at most one step apart in one half of the axes (the other half
then takes the rest).  So each fingerprint is entered in its own cell of either half, and looks
into its own cell and the cells one step up; whichever of two points is lower meets the other.
Whatever meets is held against the Manhattan distance over all axes and then verified exactly on
the bits.

Bits of a fingerprint are set where over half of the document's shingle hashes have them set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from almanac.llm.common import connected, hidden, shown, staged

#: Words in a shingle, and bits in which linked fingerprints may differ.
WORDS, BITS = 3, 3
#: Hashes that are held at once while a document's bits are counted.
CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = WORDS, seed: int = 42) -> int:
    """SimHash of the text's word shingles; 0 if it has no word.  Repeats of a shingle count."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = memoryview(b" ".join(tokens))
    size = min(words, len(tokens))
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(tokens) - size + 1
    bits = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        pairs = zip(starts[at : min(n, at + CHUNK)].tolist(), ends[at + size - 1 : min(n, at + CHUNK) + size - 1].tolist())
        hashes = np.array([digest(joined[a:b], seed) for a, b in pairs], dtype=np.uint64)
        flags = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bits += flags.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > n, bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, *, text: str = "text", words: int = WORDS) -> DataFrame:
    """Adds ``fp``, the fingerprint as a signed long, to all columns of ``docs``; a column of that name is replaced."""
    docs = docs.select(*(c for c in docs.columns if c != "fp"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            found = np.array([fingerprint(column[i].as_py(), words) for i in range(len(column))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view(np.int64))], names=[*batch.schema.names, "fp"])

    return docs.mapInArrow(add, StructType([*docs.schema.fields, StructField("fp", LongType())]))


def embedding(fp: Column) -> Column:
    """The 32 segment counts, two bits each, packed in a long."""
    low = F.lit(0x5555555555555555)
    left, right = F.shiftrightunsigned(fp, 1).bitwiseAND(low), fp.bitwiseAND(low)
    return F.shiftleft(left.bitwiseAND(right), 1).bitwiseOR(left.bitwiseXOR(right))


def manhattan(a: Column, b: Column) -> Column:
    """Manhattan distance of two packed embeddings: per segment |x - y|, summed over segments."""
    low = F.lit(0x5555555555555555)
    ones, other = a.bitwiseAND(low), b.bitwiseAND(low)  # segments with count 1
    twos, two = F.shiftrightunsigned(a, 1).bitwiseAND(low), F.shiftrightunsigned(b, 1).bitwiseAND(low)
    # one step where just one count is 1, two where 0 meets 2
    odd = ones.bitwiseXOR(other)
    return F.bit_count(odd) + 2 * F.bit_count(twos.bitwiseXOR(two).bitwiseAND(F.bitwise_not(odd)))


def links(prints: DataFrame, *, bits: int = BITS) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints in ``prints`` (fp long, no repeats) that differ in few bits.

    Only different fingerprints are paired, so copies never multiply; one fingerprint has at most
    43,744 others within three bits, whatever the number of documents.  The verification sits in
    the join itself.  ``bits`` is 3 at most, as the halves are probed one step away.
    """
    if not 0 <= bits <= BITS:
        raise ValueError("bits must be from 0 to 3")
    grid = prints.select("fp", embedding(F.col("fp")).alias("e"))
    halves = F.explode(F.array(*(F.struct(F.lit(h).alias("half"), F.shiftrightunsigned("e", 32 * h).bitwiseAND(F.lit(0xFFFFFFFF)).alias("cell")) for h in (0, 1))))
    own = grid.select("fp", "e", halves.alias("at")).select("fp", "e", "at.half", "at.cell")
    steps = F.array(
        F.struct(F.col("cell"), F.lit(False).alias("up")),
        *(F.when(F.shiftright("cell", 2 * i).bitwiseAND(F.lit(3)) < 2, F.struct((F.col("cell") + F.lit(1 << 2 * i)).alias("cell"), F.lit(True).alias("up"))) for i in range(16)),
    )
    probe = own.select(F.col("fp").alias("fp2"), F.col("e").alias("e2"), "half", F.explode(F.array_compact(steps)).alias("to")).select("fp2", "e2", "half", "to.cell", "to.up")
    met = own.alias("o").join(
        probe.alias("p"),
        (F.col("o.half") == F.col("p.half"))
        & (F.col("o.cell") == F.col("p.cell"))
        & (F.col("p.up") | (F.col("o.fp") < F.col("p.fp2")))
        & (manhattan(F.col("o.e"), F.col("p.e2")) <= bits)
        & (F.bit_count(F.col("o.fp").bitwiseXOR(F.col("p.fp2"))) <= bits),
    )
    return met.select(F.least("fp", "fp2").alias("a"), F.greatest("fp", "fp2").alias("b")).distinct()


def groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = WORDS, bits: int = BITS) -> DataFrame:
    """(``key``, text_hash, fp, component) of every row: its near-duplicate group by smallest key.

    Null and empty texts have fingerprint 0 and are linked like any other; rows with a null key
    belong to their group and never name it (a group of such rows alone has a null component).
    Repeated rows stay repeated.
    """
    slim = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("_text"))
    slim = staged(with_fingerprint(slim, text="_text", words=words).drop("_text"), "prints")
    prints = staged(slim.groupBy("fp").agg(F.min("_key").alias("first")), "distinct-prints")
    member = connected(links(prints, bits=bits))
    rooted = prints.join(member, prints["fp"] == member["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component"))
    return slim.join(rooted.join(named, "root").select("fp", "component"), "fp").select(F.col("_key").alias(key), "text_hash", "fp", "component")


def deduplicated(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = WORDS, bits: int = BITS) -> DataFrame:
    """One row of each near-duplicate group: the one with the smallest key, all columns kept.

    Of several rows with that key the one with the smallest text hash stays.  In a group where
    every key is null one row per text stays.
    """
    return first_rows(docs, groups(docs, key=key, text=text, words=words, bits=bits), key=key, text=text)


def first_rows(docs: DataFrame, found: DataFrame, *, key: str, text: str) -> DataFrame:
    """The rows of ``docs`` that name their group in ``found`` (``key``, text_hash, component), one a group."""
    keep = found.where(F.col(key).eqNullSafe(F.col("component"))).select(F.col(key).alias("_key"), F.col("text_hash").alias("_keep")).distinct()
    rows, names = hidden(docs)
    own = F.col(names[key])
    rows = rows.withColumn("_hash", F.xxhash64(names[text]))
    rows = rows.join(keep, own.eqNullSafe(F.col("_key")) & (F.col("_hash") == F.col("_keep")), "left_semi")
    first = Window.partitionBy(own, F.when(own.isNull(), F.col("_hash"))).orderBy("_hash")
    return rows.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").select(*shown(names))


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint (16 hex digits) and its group's smallest doc_id.

    Null and empty texts have fingerprint 0 and link like any other.  Rows that repeat keep a row
    each; a row with a null doc_id never names its group; an empty table gives no rows.
    """
    found = groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    hex16 = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", hex16.alias("fingerprint"), F.col("component").alias("component_id"))
