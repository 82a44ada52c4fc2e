"""Strict JSON Lines: framing, encoding and size of records, in source order."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactframe.operators.budgets import MAX_LINE_BYTES
from pactframe.operators.shared import checkpointed


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per physical record: value (a kept carriage return and all), file, block, and m, which grows inside a block.

    Lines end at LF only; the default would also split at a lone CR.
    """
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("file_size"), F.monotonically_increasing_id().alias("m"))


def indexed(lines: DataFrame) -> DataFrame:
    """Adds item_index, the zero-based place by file, then by place in the file, and headed, whether the record begins with a file's byte order mark.

    Two passes: the first counts records by file block, which gives offsets
    of 32 bytes a block; the second reads with the same splits and looks its
    blocks' offsets up, so that no text is moved.  The text source drops a
    byte order mark at the head of a file.  Of a plain file it shows in the
    bytes that the file has beyond its records; of a compressed one the first
    three bytes are read, decompressed.
    """
    from pyspark.sql.window import Window

    spark = lines.sparkSession
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("_n"), F.min("m").alias("_low"), F.sum(F.octet_length("value") + 1).alias("_bytes"), F.first("file_size").alias("_size"))
    blocks = checkpointed(blocks)
    packed = [r["file"] for r in blocks.select("file").distinct().where(F.col("file").rlike(_packed(spark))).collect()] if _packed(spark) else []  # as many names as the scan lists
    told = spark.createDataFrame([(f, h == BOM) for f, h in zip(packed, heads(spark, packed), strict=True)], "_named string, _told boolean")
    blocks = blocks.join(F.broadcast(told), F.col("file") == F.col("_named"), "left")
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    beyond = F.col("_size") - F.sum("_bytes").over(Window.partitionBy("file")) >= 2
    offsets = blocks.select(F.xxhash64("file").alias("_file"), F.col("block").alias("_block"), "_low", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), (F.coalesce("_told", beyond) & (F.col("block") == 0)).alias("_marked"))
    if not offsets.groupBy("_file", "_block").count().where("count > 1").isEmpty():
        raise RuntimeError("two file names with one hash: rename one")
    met = (F.xxhash64("file") == F.col("_file")) & (F.col("block") == F.col("_block"))
    return (lines.join(F.broadcast(offsets), met).withColumn("item_index", F.col("m") - F.col("_low") + F.col("_base"))
            .withColumn("headed", F.col("_marked") & (F.col("m") == F.col("_low"))).drop("_low", "_base", "_marked", "_file", "_block"))


#: UTF-8's byte order mark.
BOM = b"\xef\xbb\xbf"


def _packed(spark: SparkSession) -> str:
    """A pattern for names of files that the cluster's codecs decompress."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory.getCodecClasses(conf)
    ends = {jvm.org.apache.hadoop.util.ReflectionUtils.newInstance(c, conf).getDefaultExtension() for c in codecs}
    return "(" + "|".join(re.escape(e) for e in sorted(ends)) + r")\z" if ends else ""


def heads(spark: SparkSession, files: list[str], size: int = len(BOM)) -> list[bytes]:
    """The first bytes of compressed files, decompressed; 32 files at a time."""
    from concurrent.futures import ThreadPoolExecutor

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    factory = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def head(file: str) -> bytes:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
        stream = factory.getCodec(path).createInputStream(path.getFileSystem(conf).open(path))
        try:
            found = [stream.read() for _ in range(size)]
        finally:
            stream.close()
        return bytes(b for b in found if b >= 0)

    with ThreadPoolExecutor(32) as pool:
        return list(pool.map(head, files))


def unterminated(value: Column) -> Column:
    """The record without its terminator, LF or CRLF."""
    return F.regexp_replace(value, r"(\r\n|\n|\r)\z", "")


def frame(value: Column) -> Column:
    """The framing code of a record, null for a sound one; white space alone is no blank record.

    invalid_encoding, blank, bom, or invalid_json where a line end remains inside.
    """
    body = unterminated(value)
    return (F.when(~F.is_valid_utf8(value), "invalid_encoding").when(body == "", "blank").when(body.startswith("﻿"), "bom").when(body.contains("\n"), "invalid_json"))


def line_bytes(value: Column, terminated: bool = False) -> Column:
    """UTF-8 bytes of a record with its terminator; `terminated` says that the value still has it."""
    return F.octet_length(value) + (0 if terminated else 1)


def line_size(value: Column, limit: int = MAX_LINE_BYTES, terminated: bool = False) -> Column:
    """jsonl_line_size where a record is over the limit, else null."""
    return F.when(line_bytes(value, terminated) > limit, "jsonl_line_size")


def input_size(value: Column, limit: int) -> Column:
    """input_size where a whole document has more bytes than the limit, else null; tested before decoding."""
    return F.when(F.octet_length(value) > limit, "input_size")


def read_jsonl(spark: SparkSession, path: str, contract, max_errors: int = 100) -> DataFrame:
    """Records of JSON Lines files against a contract: item_index, line, framing, value, errors.

    `framing` is the code of a record that is no strict JSON; such rows have
    no errors of their own.  The raw text is not kept.
    """
    from pactframe.operators.validate import from_json

    lines = indexed(read_lines(spark, path)).withColumn("_framing", F.when(F.col("headed"), "bom").otherwise(frame(F.col("value")))).withColumn("_text", F.when(F.col("_framing").isNull(), unterminated(F.col("value"))))
    done = from_json(lines.select("item_index", "_framing", "_text"), "_text", contract, max_errors)
    return classified(done)


def classified(done: DataFrame) -> DataFrame:
    """Moves decoding failures from errors to `framing`."""
    first = F.get(F.col("errors"), F.lit(0))
    framing = F.coalesce("_framing", F.when(first["code"] == "json_duplicate", "duplicate_key").when(first["code"] == "json_invalid", first["context"]["reason"]))
    return done.select("item_index", (F.col("item_index") + 1).alias("line"), framing.alias("framing"), F.when(framing.isNull(), F.col("value")).alias("value"),
                       F.when(framing.isNull(), F.col("errors")).otherwise(F.array().cast(done.schema["errors"].dataType)).alias("errors"), "truncated")
