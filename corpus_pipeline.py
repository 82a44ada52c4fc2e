"""A corpus pipeline over `documents`: toxicity, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns the columns of `docs`; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactframe.llm import mixing, packing, queries, secrets, similar, toxicity
from pactframe.llm.common import delete_table, scratch, set_aside, stored, written


KNOWN = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score 0.7 or more, the threshold of the toxicity query.

    Null and empty texts stay; rows with equal ids are judged one by one.
    """
    docs, restored = set_aside(docs, KNOWN)
    model = toxicity.fit(queries.table(spark, sf_dir, "documents"), queries.table(spark, sf_dir, "labels"))
    return restored(toxicity.score(docs, model, keep=tuple(docs.columns)).where("score < 0.7"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the row of the smallest id, then of the smallest hash.

    Documents whose sets of five-word shingles have an exact Jaccard similarity
    of 0.8 or more are linked, and groups are what links connect; the trie
    self-join of fingerprints offers pairs, but doesn't decide.
    Rows decide, not ids: unlike texts of one id both stay, and of rows equal
    in id and text one does.  Documents without an id stay, as they can't be
    told apart.
    """
    docs, restored = set_aside(docs, KNOWN)
    named = docs.where("doc_id is not null")
    row = F.xxhash64(*[F.struct(c) for c in docs.columns if c in KNOWN], *[F.isnull(c) for c in docs.columns if c in KNOWN])
    groups = similar.similar_rows(named, words=5, similarity=0.8, row=row)
    first = groups.where("doc_id = component_id and row_id = component_row").select(F.col("doc_id").alias("_kept"), F.col("row_id").alias("_kept_row"))
    classes = written(first, "pipeline-kept")
    named = named.withColumn("_row", row)
    kept = named.join(classes, (F.col("doc_id") == F.col("_kept")) & (F.col("_row") == F.col("_kept_row")), "left_semi")
    if not classes.groupBy("_kept", "_kept_row").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "_row"])
    kept = kept.drop("_row")
    return restored(kept.union(docs.where("doc_id is null")))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret.

    Null and empty texts have none and stay; equal rows are marked alike; very
    long texts are scanned whole.
    """
    docs, restored = set_aside(docs, KNOWN)
    names = docs.columns
    model = secrets.fit(queries.table(spark, sf_dir, "documents"))
    found = secrets.scan(docs, model, keep=tuple(names), redact="[SECRET]")
    changed = F.size("findings") > 0
    new = {"text": F.when(changed, F.col("clean")).otherwise(F.col("text"))}
    if "n_chars" in names:
        new["n_chars"] = F.when(changed, F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return restored(found.withColumns(new))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources meet their water-filled targets.

    Of null, empty and wordless texts nothing is taken, so they go; null
    sources are one source; repeated rows are told apart.
    """
    docs, restored = set_aside(docs, KNOWN)
    return restored(mixing.repeat_documents(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens.

    A null or empty text is the end id alone; repeated rows are separate
    documents; a very long text fills windows of its own.  Columns of `docs`
    other than id and text are not part of a piece.
    """
    return packing.pack(docs, queries.tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("secrets", redact_secrets), ("mixing", mix_sources), ("packing", pack_sequences)]
#: Trained models and whole-text tokenizers aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  What a stage wrote for itself, and its input, are deleted once its output is written."""
    docs, before = queries.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark):
            docs, path = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            delete_table(spark, before)
        before = path
    return docs
