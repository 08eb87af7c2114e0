"""Substring search over an index of three-letter postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.operators.readmodel import haystack
from almanac.operators.staging import staged

#: Letters of a gram; grams of a search that are intersected, rarest first; keys that are named in a filter.
GRAM, USED, NAMED = 3, 4, 2000


def grams(text: Column) -> Column:
    """The distinct runs of three letters of a text, in one pass over it."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), 1))


class Index:
    """Three staged tables: texts by key, postings by gram, and how many of each there are.

    Each part of the texts, a range of keys, has its postings beside it, sorted by the hash of the gram:
    they move nowhere, the postings of one gram are a few row groups of each part, and those of a gram
    that every text holds are in all files, never one task's.  Grams whose hashes meet only add candidates.
    """

    def __init__(self, texts: DataFrame, postings: DataFrame, sizes: DataFrame):
        self.texts, self.postings, self.sizes = texts, postings, sizes

    @classmethod
    def of(cls, rows: DataFrame, key: str, columns: list[str]) -> Index:
        """The index of rows with a key by the text of ``columns``; rows without one cannot be found."""
        texts = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), haystack(columns).alias("text"))
        texts = staged(texts.repartitionByRange("key").sortWithinPartitions("key"), "texts")
        entries = texts.select(F.explode(grams(F.col("text"))).alias("gram"), "key").withColumn("gram", F.xxhash64("gram"))
        postings = staged(entries.sortWithinPartitions("gram"), "postings")
        return cls(texts, postings, staged(postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "sizes"))

    def candidates(self, term: str) -> DataFrame:
        """Keys of the texts that have the rarest grams of a term: each joins what the rarer ones have left."""
        texts = sorted({term[i : i + GRAM] for i in range(len(term) - GRAM + 1)})
        own = list(self.sizes.sparkSession.range(1).select(F.array(*(F.xxhash64(F.lit(x)) for x in texts))).first()[0])
        known = dict(map(tuple, self.sizes.where(F.col("gram").isin(own)).collect()))  # a row a gram of the term
        found = None
        for gram in sorted(own, key=lambda x: known.get(x, 0))[:USED]:
            keys = self.postings.where(F.col("gram") == gram).select("key")
            found = keys if found is None else found.join(keys, "key", "left_semi")
        return found

    def search(self, term: str) -> DataFrame:
        """Rows (key, text) whose text holds the term, in any case; each candidate is verified.

        Few candidates are named in the filter, so only their row groups are read; many are joined.
        Terms shorter than a gram are looked for in all texts.
        """
        term = term.lower()
        holds = self.texts.where(F.contains("text", F.lit(term)))
        if len(term) < GRAM:
            return holds
        found = staged(self.candidates(term), "candidates")
        few = [row[0] for row in found.limit(NAMED + 1).collect()]
        return holds.where(F.col("key").isin(few)) if len(few) <= NAMED else holds.join(found, "key", "left_semi")
