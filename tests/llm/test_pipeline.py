import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from pactframe.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return queries.table(spark, DATA, "documents")


def test_stages_keep_columns_and_decide(spark, docs):
    extra = docs.withColumns({"score": F.lit(1), "value": F.lit("x"), "findings": F.lit("y"), "fp": F.lit(0), "size": F.lit(3)})
    for frame in (docs, extra):
        kept = frame
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, DATA)
            assert kept.columns == frame.columns, name
            assert kept.count() > 0


def test_exact_copies_leave_one(spark, docs):
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, DATA)
    assert kept.groupBy("text").count().where("count > 1").count() == 0
    assert kept.select("text").distinct().count() <= docs.select("text").distinct().count()


def test_empty_and_null_rows(spark, docs):
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "a", 0), (3, "a b c", "en", None, 5), (3, "a b c", "en", None, 5)], docs.schema)
    for frame in (docs.limit(0), odd):
        kept = frame
        for _, stage in corpus_pipeline.STAGES:
            kept = stage(spark, kept, DATA)
            kept.count()
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, odd, DATA).collect()) == [1, 3]
    nameless = spark.createDataFrame([(None, "x y z", None, None, 1), (None, "x y z", None, None, 1), (7, "x y z", None, None, 1)], docs.schema)
    assert corpus_pipeline.drop_near_duplicates(spark, nameless, DATA).count() == 3
    assert corpus_pipeline.mix_sources(spark, nameless, DATA).count() >= 3


def test_repeated_ids_are_told_apart(spark, docs):
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    rows = spark.createDataFrame([(1, a, "en", "s", 1), (1, b, "en", "s", 1), (2, b + " end", "en", "s", 1), (3, a, "en", "s", 1), (4, "p q r s t", "en", "s", 1), (4, a + " end", "en", "s", 1)], docs.schema)
    kept = corpus_pipeline.drop_near_duplicates(spark, rows, DATA).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(1, a), (1, b), (4, "p q r s t")]


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0 and corpus_pipeline.ORACLE_SQL is None
