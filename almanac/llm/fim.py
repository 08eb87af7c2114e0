"""Fill-in-middle transformation: texts cut at two token ranks through an indexable skip list.

A text's tokens stand in an indexable skip list: every token is a node of the lowest lane, each
fourth one on average is also one of the next lane, and so on.  A link carries two widths, the
units and the code points that it skips.  A cut at a rank starts in the topmost lane, goes along a
lane as long as the units passed stay within the rank, and drops a lane otherwise; the code points
passed are then the place of the cut.  A node's height is a hash of its number, so lanes are the
same in any run.

Where the text is cut, and whether and in which form it is written, follows from a hash of its key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from almanac.llm.common import hidden, shown

#: Marks of the prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are transformed, and of 100 transformed ones so many have their suffix first.
RATE, SUFFIX_FIRST = 50, 80
SEED = "42"
#: Bits of a node's hash that a further lane needs to be zero: one node in four goes up.
RISE = 2

#: What the transformation adds to the columns of its input.
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


def token_ends(text: str) -> np.ndarray:
    """Where each token ends, in code points: white space with the word behind it, or white space at the text's end."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    blank = (points == 32) | ((points >= 9) & (points <= 13))
    last = ~blank
    last[:-1] &= blank[1:]
    if len(points):
        last[-1] = True
    return np.flatnonzero(last) + 1


def heights(n: int) -> np.ndarray:
    """The highest lane of each of n nodes: trailing zeros of a hash of its number, RISE for a lane."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    lowest = x & (~x + np.uint64(1))
    return np.log2(np.maximum(lowest, np.uint64(1)).astype(np.float64)).astype(np.int64) // RISE


class SkipList:
    """Units of given widths in a row, found by rank: ``widths(rank)`` units are so many code points."""

    def __init__(self, ends: np.ndarray):
        """``ends``: where each unit ends, in code points."""
        rank, high = np.arange(1, len(ends) + 1), heights(len(ends))
        self.lanes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # lowest first
        up = np.arange(len(ends))
        lane = 0
        while len(up):
            units, points = np.diff(rank[up], prepend=0), np.diff(ends[up], prepend=0)
            # where the lane below goes on behind each node of this one (behind the head: at 0)
            below = np.concatenate(([0], np.searchsorted(under, up) + 1)) if lane else np.zeros(0, np.int64)
            self.lanes.append((units, points, below))
            under, up, lane = up, up[high[up] > lane], lane + 1

    def points(self, rank: int) -> int:
        """Code points of the first ``rank`` units."""
        units_passed = points_passed = at = 0  # ``at``: number of links of the lane passed
        for units, points, below in reversed(self.lanes):
            while at < len(units) and units_passed + units[at] <= rank:
                units_passed += int(units[at])
                points_passed += int(points[at])
                at += 1
            if len(below):
                at = int(below[at])
        return points_passed


def transformed(text: str | None, digest: str) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of a text under a hash in hex digits."""
    text = text or ""
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    ends = token_ends(text)
    n = len(ends)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= RATE:
        return n, "plain", None, None, text
    units = SkipList(ends)
    a, b = (units.points(rank) for rank in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < SUFFIX_FIRST:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def with_middle(docs: DataFrame, *, key: str = "doc_id", text: str = "text", seed: str = SEED) -> DataFrame:
    """Adds n (tokens), form, prefix_chars, middle_chars and output to ``docs``; columns of those names are replaced.

    A null text counts as empty, and empty texts stay plain, as do texts that hold a mark.  A null
    key is hashed as the empty text.  Rows that repeat are transformed alike.
    """
    rows, names = hidden(docs)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(names[key]).cast("string"), F.lit(""))).cast("binary"), 256)
    rows = rows.select(*(own for c, own in names.items() if c not in ADDED or c in (key, text)), digest.alias("_digest"))
    kinds = {"n": LongType(), "form": StringType(), "prefix_chars": LongType(), "middle_chars": LongType(), "output": StringType()}
    arrow = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, digests = batch.column(batch.schema.get_field_index(names[text])), batch.column(batch.schema.get_field_index("_digest"))
            made = list(zip(*(transformed(t.as_py(), d.as_py()) for t, d in zip(texts, digests, strict=True)), strict=True)) or [()] * len(ADDED)
            new = [pa.array(values, arrow[c]) for c, values in zip(ADDED, made, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *(f"_{c}" for c in ADDED)])

    out = rows.mapInArrow(cut, StructType([*rows.schema.fields, *(StructField(f"_{c}", kinds[c]) for c in ADDED)]))
    return out.select(*shown({c: own for c, own in names.items() if c not in ADDED}), *(F.col(f"_{c}").alias(c) for c in ADDED))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from.  No text that is transformed holds a mark, so the first of each counts."""
    first, second = F.when(form == "spm", SUFFIX).otherwise(PREFIX), F.when(form == "spm", PREFIX).otherwise(SUFFIX)
    size = F.lit(len(PREFIX))
    at, middle = F.locate(PREFIX, output), F.locate(MIDDLE, output)
    suffix_at = F.locate(SUFFIX, output)
    two = F.when(form == "spm", at).otherwise(suffix_at)
    left = F.substring(output, size + 1, two - size - 1)
    right = F.substring(output, two + size, middle - two - size)
    rest = F.substring(output, middle + size, F.length(output))
    whole = F.when(form == "spm", F.concat(right, rest, left)).otherwise(F.concat(left, rest, right))
    return F.when(form == "plain", output).when(output.startswith(first) & output.contains(second), whole)


def op13_fim(spark, sf_dir: str) -> DataFrame:
    """Every document's cuts, form, and digests of what is written and of what is rebuilt from that.

    A null or empty text is plain with no tokens; rows that repeat keep a row each; an empty table
    gives no rows.
    """
    made = with_middle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM documents),
k AS (SELECT *, len(units)::BIGINT AS n, [('0x' || substr(h, 8 * i + 1, 8))::BIGINT FOR i IN range(4)] AS r FROM d),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 50 THEN 'plain'
                     WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
             least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b FROM k),
p AS (SELECT *, array_to_string(units[1:a], '') AS x, array_to_string(units[a + 1:b], '') AS y, array_to_string(units[b + 1:], '') AS z FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
