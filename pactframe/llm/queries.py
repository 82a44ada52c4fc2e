"""The corpus operators bound to the given tables, and what SQL says of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactframe.llm import audit, conversations, graph, language, mixing, packing, pii, secrets, sharding, simhash, topk, toxicity, transport
from pactframe.llm.common import fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.fit(docs))
    spans = F.transform("findings", lambda f: F.concat(f["start"].cast("string"), F.lit(":"), f["end"].cast("string")))
    return found.select("doc_id", "n_candidates", F.size("findings").alias("n_secrets"), F.array_join(spans, ",").alias("spans"),
                        F.coalesce(F.array_max(F.transform("findings", lambda f: f["score"])), F.lit(0.0)).alias("score"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = transport.store_texts(table(spark, sf_dir, "documents"))
    s = F.col("streams")[0]
    points = F.size(F.filter(s["random_access"], lambda p: p))
    feature = F.concat_ws(";", F.concat_ws(":", s["program"], s["map_pid"], s["pid"], s["stream_type"]), F.concat(F.lit("packets="), "packets"), F.concat(F.lit("units="), s["units"]),
                          F.concat(F.lit("pts="), F.element_at(s["pts"], 1), F.lit("-"), F.element_at(s["pts"], -1)), F.concat(F.lit("points="), points), F.concat(F.lit("gaps="), s["continuity_errors"] + F.col("sync_errors")))
    return transport.parse_media(stored).select(
        "doc_id", "n_bytes", s["payload_bytes"].alias("payload_bytes"), s["payload_sha256"].alias("payload_sha256"), s["tail_crc32"].alias("tail_crc32"),
        "media_bytes", "media_sha256", feature.alias("feature"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    plain = F.filter("found", lambda f: ~f["disguised"])
    line = lambda spans: F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
    counts = [F.size(F.expr(f"filter(found, f -> not f.disguised and f.kind = '{kind}')")).cast("bigint").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(line(plain), 256).alias("base_sha256"), line(F.col("found")).alias("spans"),
                        F.size(F.filter("found", lambda f: f["disguised"])).cast("bigint").alias("n_disguised"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.search(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs)).select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.balanced_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op11_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = graph.sound(table(spark, sf_dir, "embeddings"))
    return graph.nearest(graph.stored_index(vectors), vectors.where(F.col("vec_id") % 50 == 0), 5)


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(audit.combinations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired(conversations.damaged(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_secrets, op2_toxicity, op3_transport, op4_mixing, op5_packing, op6_pii, op7_topk, op8_simhash, op9_language, op10_sharding, op11_graph, op12_audit, op13_repair)}
ORACLE_SQL = {"op4_mixing": mixing.MIX_SQL, "op7_topk": topk.TOPK_SQL, "op12_audit": audit.AUDIT_SQL, "op13_repair": conversations.REPAIR_SQL}
