"""Frames that the tests of all operators share."""

from pyspark.sql.types import LongType, StringType, StructField, StructType

LONG = "lorem ipsum dolor sit amet " * 20_000
#: Nulls in every column, empty and very long texts, ties, repeated rows and repeated keys.
ODD = [
    (0, "one two three four five six", "en", "a", 27),
    (1, "one two three four five six", "en", "a", 27),
    (1, "one two three four five six", "en", "a", 27),
    (2, None, "en", "a", None),
    (3, "", None, "b", 0),
    (4, "   \n\t ", "fr", None, 6),
    (5, LONG, "en", "b", len(LONG)),
    (None, "zwei drei vier", None, None, 14),
    (None, None, None, None, None),
    (6, "ONE  two\nthree four five six", "en", "a", 27),
    (7, "é ü ß 日本 \U0001f600 mail a.b@x.org", "de", "c", 28),
    (8, "<p>&amp; \x00 ▁ ,,, 12", "es", "c", 20),
]
SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType())])


def odd(spark, extra=()):
    """The odd rows, with extra columns of clashing names if asked for."""
    df = spark.createDataFrame(ODD, SCHEMA).repartition(3)
    for name in extra:
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit("kept"))
    return df


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def folder(spark, tmp_path, rows):
    """A tables folder with these documents."""
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)
