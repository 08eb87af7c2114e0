"""A corpus pipeline over documents: each stage works on all that the one before it kept.

Every stage returns the columns of ``documents``, except the last, which adds the pieces.  Rows
with null texts leave in the first stage, as text without a language.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm import langid, mixing, pieces, pii, shingles
from almanac.llm.common import staged


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay, and a null lang becomes the language found.

    A null text and one without letters go.  The languages are learned from the rows that name
    theirs; where none does there is nothing to tell them by, and every text with a letter stays.
    """
    model = langid.fit(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.identified(docs, model, spans=False).where("lang_pred != 'und'")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts stays, the one with the smallest doc_id.

    Texts are linked by SimHash over five-word shingles, and from a Jaccard index of 0.8 of their
    sets of shingles on, which SimHash alone would miss.
    """
    return shingles.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the text is replaced by the name of its kind, and n_chars follows the text."""
    clean = pii.with_pii(docs, redacted="text").drop("pii")
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of its source takes it."""
    return mixing.repeated(docs)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The text's three best segmentations, their scores, and whether decoding each gives the text back."""
    return pieces.with_pieces(docs, alternatives=True, verify=True).withColumn("n_pieces", F.size("pieces").cast("long"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix", mix),
    ("piece_ids", piece_ids),
]

#: No SQL: language models and fingerprints are beyond it.  The tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs
