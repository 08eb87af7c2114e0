import corpus_pipeline
from pyspark.sql import functions as F

from almanac.llm import langid, mixing, pii, shingles
from tests.llm.common import folder, odd


def test_stages_keep_columns_and_take_effect(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "personal_data", "mix", "piece_ids"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns and out.schema == docs.schema or name == "mix"
        before, docs = docs, out.persist()
        if name == "language_id":
            assert docs.count() == before.count()
        if name == "near_duplicates":
            low = shingles.groups(before).where("doc_id = component").select("doc_id")
            assert {r[0] for r in low.collect()} == {r.doc_id for r in docs.collect()}
        if name == "personal_data":
            assert not [s for r in docs.collect() for s in pii.find(r.text) if s[0] in pii.PRIVATE]
            assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
        if name == "mix":
            copies = {r.doc_id: r.copies for r in mixing.mixed(before).collect() if r.copies}
            assert copies == {r.doc_id: r["count"] for r in docs.groupBy("doc_id").count().collect()}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert last.where("not round_trip").count() == 0 and last.count() == docs.count()


def test_whole_run_of_odd_rows(spark, tmp_path):
    where = folder(spark, tmp_path, odd(spark))
    kept = {r.doc_id for r in langid.identified(odd(spark), langid.fit(odd(spark))).where("lang_pred != 'und'").collect()}
    assert kept == {0, 1, 5, 6, 7, 8, None}
    out = corpus_pipeline.run(spark, where).collect()
    assert {r.doc_id for r in out} <= {0, 5, 7, 8, None} and all(r.round_trip for r in out)


def test_nothing_in_nothing_out(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, odd(spark).limit(0))).count() == 0


def test_languages_found_fill_null_ones(spark):
    rows = [(i, "the quick brown fox jumps over it", "en", "a", 1) for i in range(3)] + [(3, "привет мир как дела", "ru", "a", 1), (4, "как дела мир", None, "a", 1), (5, "12 34", None, "a", 1)]
    docs = spark.createDataFrame(rows, odd(spark).schema)
    found = {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert found == {0: "en", 1: "en", 2: "en", 3: "ru", 4: "ru"}


def test_nothing_to_learn_drops_no_clean_text(spark):
    docs = odd(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()} == {0, 1, 5, 6, 7, 8, None}
