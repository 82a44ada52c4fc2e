"""Sharding linked documents by balanced label propagation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactframe.llm.common import checkpointed, ordered_prefix, written

#: Hash buckets in which the rows of a shard are ranked.
BUCKETS = 1024


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 8


def _draw(*cols: Column | str) -> Column:
    """A hash of the columns in [0, 1)."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / float(1 << 30)


def propagate(linked: DataFrame, shards: int, quota: list[int], rounds: int = 4, slack: float = 0.5) -> DataFrame:
    """Moves linked documents towards their neighbours' shards: `linked` (row, group, shard) with new shards.

    Documents of a group are neighbours.  In each round a group wants the
    shards, of those with room, in which most of its documents are (ties: by a
    hash of the group, so that groups spread): one, or, where its documents
    don't fit, as many as these need.  Its other documents move there.  A
    shard takes no more than it has room for, its quota and a share `slack` of
    it for groups that fit a shard (full shards could move nothing; what is over
    a quota in the end leaves by whole groups): where more want in, groups are
    drawn by hash, and documents of groups that want several shards.  Only
    shard totals, one row a shard, reach the driver.
    """
    for k in range(rounds):
        held = {r["shard"]: r["count"] for r in linked.groupBy("shard").count().collect()}
        room = [max(0, math.ceil(quota[s] * (1 + slack)) - held.get(s, 0)) for s in range(shards)]
        if not held or not any(room):
            break
        rooms, exact = (F.array(*[F.lit(r).cast("bigint") for r in each]) for each in (room, [max(0, quota[s] - held.get(s, 0)) for s in range(shards)]))
        free = lambda s: F.when(F.col("size") > min(quota), F.get(exact, s)).otherwise(F.get(rooms, s))
        there = linked.groupBy("group", "shard").agg(F.count("*").alias("n"))
        ranked = there.groupBy("group").agg(F.sum("n").alias("size"), F.sort_array(F.collect_list(F.struct("n", F.xxhash64("group", "shard").alias("tie"), "shard")), asc=False).alias("by"))
        start = F.struct(F.lit(0).cast("bigint").alias("space"), F.lit(0).cast("bigint").alias("there"), F.array().cast("array<int>").alias("to"))
        fill = F.aggregate(F.filter("by", lambda x: free(x["shard"]) > 0), start, lambda acc, x: F.when(acc["space"] >= F.col("size"), acc).otherwise(
            F.struct((acc["space"] + x["n"] + free(x["shard"])).alias("space"), (acc["there"] + x["n"]).alias("there"), F.array_append(acc["to"], x["shard"]).alias("to"))))
        wish = ranked.withColumn("f", fill).select("group", F.col("f.to").alias("to"), (F.col("size") - F.col("f.there")).alias("movers"), (F.col("f.space") - F.col("f.there")).alias("space"))
        wish = checkpointed(wish.where((F.size("to") > 0) & (F.col("movers") > 0)))
        each = F.least("movers", "space") / F.size("to")
        wanted = {r["s"]: r["w"] for r in wish.select(F.explode("to").alias("s"), each.alias("w")).groupBy("s").agg(F.sum("w").alias("w")).collect()}
        if not wanted:
            break
        rate = F.array(*[F.lit(min(1.0, room[s] / wanted[s]) if s in wanted else 0.0) for s in range(shards)])
        go = wish.select(F.col("group").alias("_group"), "to", F.least(F.lit(1.0), F.col("space") / F.col("movers")).alias("share"))
        aim = F.get("to", F.pmod(F.xxhash64("row", F.lit(k), F.lit("aim")), F.size("to")).cast("int"))
        drawn = F.when(F.size("to") == 1, _draw("group", F.lit(k), F.lit("group"))).otherwise(_draw("row", F.lit(k), F.lit("rate")))
        met = linked.join(go, F.col("group") == F.col("_group"), "left").withColumn("_aim", aim)
        moved = F.col("to").isNotNull() & ~F.array_contains("to", F.col("shard")) & (drawn < F.get(rate, F.col("_aim"))) & (_draw("row", F.lit(k), F.lit("row")) < F.col("share"))
        linked = checkpointed(met.select("row", "group", F.when(moved, F.col("_aim")).otherwise(F.col("shard")).alias("shard")))
    return linked


def balanced_shards(docs: DataFrame, shards: int = 24, rounds: int = 4) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document; shards' counts are at most one apart.

    Documents with equal texts are linked (null texts with each other).
    Documents start in shards by a hash; `propagate` brings the linked ones
    together under the shards' quotas; unlinked ones then fill what is left,
    and where a shard is over its quota its last documents go to the free
    slots.  Slots are gapless from 0.  Ranks are by hash buckets, so no task
    gets a whole shard or group.  Rows with equal ids are separate documents;
    texts of any length count whole; other columns are not read; an empty
    table gives no row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = written(docs.select("doc_id", text_size(F.col("text")).alias("size"), F.crc32(text).alias("text_crc32"),
                               F.xxhash64(F.col("text").isNull(), text).alias("group"), F.monotonically_increasing_id().alias("row"))
                   .withColumn("shard", F.pmod(F.xxhash64("row", F.lit("start")), F.lit(shards)).cast("int")), "shard-base")
    total = base.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    groups = base.groupBy("group").count().where("count > 1").select(F.col("group").alias("_group"))
    marked = written(base.join(groups, F.col("group") == F.col("_group"), "left").withColumn("linked", F.col("_group").isNotNull()).drop("_group"), "shard-linked")
    placed = propagate(marked.where("linked").select("row", "group", "shard"), shards, quota, rounds)
    state = marked.join(placed.select(F.col("row").alias("_row"), F.col("shard").alias("_shard")), F.col("row") == F.col("_row"), "left")
    state = state.select("doc_id", "size", "text_crc32", "group", "row", "linked", F.coalesce("_shard", "shard").alias("shard"))
    one = F.lit(1).cast("bigint")
    bucket = F.when(F.col("linked"), 0).otherwise(BUCKETS) + F.pmod(F.xxhash64("group"), F.lit(BUCKETS))
    bucket = bucket * 64 + F.pmod(F.xxhash64("row"), F.lit(64))
    ranked = written(ordered_prefix(state, ["shard"], [F.col("group"), F.col("row")], bucket, one, "rank"), "shard-ranked")
    held = {r["shard"]: r["count"] for r in ranked.groupBy("shard").count().collect()}
    quotas = F.array(*[F.lit(q).cast("bigint") for q in quota])
    keeps = F.col("rank") < F.get(quotas, F.col("shard"))
    kept = ranked.where(keeps).select("doc_id", "size", "text_crc32", "shard", F.col("rank").alias("slot"))
    spill = ordered_prefix(ranked.where(~keeps).withColumn("all", F.lit(0)), ["all"], [F.col("group"), F.col("row")],
                           F.pmod(F.xxhash64("group"), F.lit(BUCKETS)) * 64 + F.pmod(F.xxhash64("row"), F.lit(64)), one, "at")
    ends, at = [], 0
    for s in range(shards):
        at += max(0, quota[s] - held.get(s, 0))
        ends.append(at)
    free = F.array(*[F.lit(e).cast("bigint") for e in ends])
    target = F.size(F.filter(free, lambda e: e <= F.col("at")))
    first = F.array(*[F.lit(ends[s] - max(0, quota[s] - held.get(s, 0)) - min(quota[s], held.get(s, 0))).cast("bigint") for s in range(shards)])
    moved = spill.withColumn("to", target).select("doc_id", "size", "text_crc32", F.col("to").alias("shard"), (F.col("at") - F.get(first, F.col("to"))).alias("slot"))
    return kept.union(moved)
