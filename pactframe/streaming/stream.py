"""Contracts on streams: continuation, budgets and patches, a micro-batch at a time."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pactframe.contract.model import Contract
from pactframe.operators.budgets import BudgetError, within_limits
from pactframe.operators.patches import apply_patch, fold_patches
from pactframe.operators.shared import deleted, listed
from pactframe.operators.validate import from_json, split


def validated_stream(lines: DataFrame, column: str, contract, keep: list[str]) -> DataFrame:
    """The same columns as for a table, on a stream; stateless, for append mode."""
    return from_json(lines, column, contract, keep=keep)


COUNTERS = ("items", "invalid_items", "total_bytes")


def continued(stream: DataFrame, keys: list[str], good_path: str, bad_path: str, checkpoint: str, max_items: int | None = None, max_invalid: int | None = None, state_path: str | None = None,
              max_total_bytes: int | None = None, size: str | None = None, order: str | list[str] | None = None) -> StreamingQuery:
    """Writes good rows and quarantine of each batch; a budget that is exceeded fails the query.

    Running totals (items, invalid items and, if `size` names a column of
    byte counts, bytes) are one row a batch in `state_path`: a batch adds its
    own to the row of the batch before it, and one that runs again replaces
    its own row.  Of the batch that goes over a budget, the rows before the
    one that does are written, in the order of the columns `order`, and then
    the query fails; without an order none of that batch can be told to come
    before, so nothing is written.
    """
    limits = dict(zip(COUNTERS, (max_items, max_invalid, max_total_bytes), strict=True))

    def deliver(batch: DataFrame, number: int) -> None:
        good, bad = split(batch, keys)
        good.write.mode("overwrite").parquet(f"{good_path}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{bad_path}/batch={number}")

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            if state_path is not None:
                before = spark.read.parquet(f"{state_path}/batch={number - 1}").select(*COUNTERS).first().asDict() if number else dict.fromkeys(COUNTERS, 0)
                counted = {"items": F.lit(1), "invalid_items": (F.size("errors") > 0).cast("int"), "total_bytes": F.col(size) if size else F.lit(0)}
                own = batch.agg(*[(F.coalesce(F.sum(v), F.lit(0)) + before[c]).cast("bigint").alias(c) for c, v in counted.items()])
                own.write.mode("overwrite").parquet(f"{state_path}/batch={number}")
                seen = spark.read.parquet(f"{state_path}/batch={number}").first()
                over = [c for c, limit in limits.items() if limit is not None and seen[c] > limit]
                if over:
                    if order is None:
                        raise BudgetError(over[0], limits[over[0]], seen[over[0]])
                    within, at = within_limits(batch, order, {c: counted[c] for c in over}, {c: limits[c] - before[c] for c in over})
                    deliver(within, number)
                    code = next(c for c in over if at[c] + before[c] > limits[c])
                    raise BudgetError(code, limits[code], at[code] + before[code])
            deliver(batch, number)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def patch_stream(patches: DataFrame, base_path: str, out_path: str, key: str, order: str, contract: Contract, patch_contract: Contract, checkpoint: str, parts: int = 64) -> StreamingQuery:
    """Folds each batch's patches by key and applies them to the base table, which is kept in `parts` by a hash of the key.

    A batch rewrites the parts that its patches touch, under its own number;
    `patched` reads the newest of each part.  A batch that runs again
    replaces what it wrote.  When a batch begins, those before it are done, so
    that of each part only the newest version before it is kept: the table
    takes at most twice its size and what a batch touches, after any number
    of batches.
    """
    part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part")

    def write(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        if number == 0:
            base = spark.read.parquet(base_path)
            base.select("*", part).write.mode("overwrite").partitionBy("part").parquet(f"{out_path}/batch=-1")
        remove_dead(spark, out_path, number)
        folded = fold_patches(batch, patch_contract, key, order).persist()
        try:
            touched = [r["part"] for r in folded.select(part).distinct().collect()]  # at most `parts` numbers
            if not touched:
                return
            base = patched(spark, out_path, number).where(F.col("part").isin(touched)).drop("part")
            done = apply_patch(base, folded, key, contract, patch_contract)
            kept = done.join(base, key).select(key, *[F.when(F.size("errors") == 0, F.col("value")[f.name]).otherwise(F.col(f.name)).alias(f.name) for f in contract.fields if f.name != key], part)
            kept.write.mode("overwrite").partitionBy("part").parquet(f"{out_path}/batch={number}")
        finally:
            folded.unpersist()

    return patches.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versions(spark: SparkSession, out_path: str) -> list[tuple[int, int, str]]:
    """(part, batch, folder) of every version of a part: names of folders, no data."""
    found = [(f, re.search(r"/batch=(-?\d+)/part=(\d+)$", f)) for f in listed(spark, f"{out_path}/batch=*/part=*")]
    return [(int(m[2]), int(m[1]), f) for f, m in found if m]


def newest(found: list[tuple[int, int, str]], before: int | None = None) -> dict[int, int]:
    """The newest batch of each part, or that before one."""
    out: dict[int, int] = {}
    for part, batch, _ in found:
        if before is None or batch < before:
            out[part] = max(batch, out.get(part, batch))
    return out


def remove_dead(spark: SparkSession, out_path: str, number: int) -> None:
    """Deletes the versions of parts that neither batch `number`, should it run again, nor a reader after it reads."""
    found = versions(spark, out_path)
    kept = newest(found, number)
    for part, batch, folder in found:
        if batch < number and batch != kept[part]:
            deleted(spark, folder)


def patched(spark: SparkSession, out_path: str, before: int | None = None) -> DataFrame:
    """The table as the batches left it, or as it was before one: of each part, what the newest batch wrote."""
    found = versions(spark, out_path)
    chosen = newest(found, before)
    folders = [f for part, batch, f in found if chosen.get(part) == batch]  # at most one a part
    if not folders:
        return spark.read.parquet(out_path).where("false").drop("batch")
    return spark.read.option("basePath", out_path).parquet(*folders).drop("batch")
