"""Order and budgets over partitioned records."""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pactframe.contract import compiler as C
from pactframe.operators.shared import checkpointed

MAX_ITEMS, MAX_INVALID, MAX_DEPTH, MAX_NODES, MAX_ERRORS = 1_000_000, 100, 64, 100_000, 100
MAX_LINE_BYTES = 8 * 1024 * 1024


class BudgetError(RuntimeError):
    """A budget that a job went over: its code, limit and what was observed."""

    def __init__(self, code: str, limit: int, observed: int):
        super().__init__(f"{code}: limit {limit}, observed {observed}")
        self.code, self.limit, self.observed = code, limit, observed


@dataclass(frozen=True)
class Verdict:
    """What a budget allows: rows before `cut` (all, if None), and the error that ends the stream there."""

    code: str
    limit: int
    observed: int
    cut: int | None

    @property
    def exceeded(self) -> bool:
        return self.cut is not None

    def deliver(self, df: DataFrame, index: str = "item_index", raise_error: bool = True) -> DataFrame:
        """The rows before the cut; over the limit this raises unless told not to."""
        if self.exceeded and raise_error:
            raise BudgetError(self.code, self.limit, self.observed)
        return df.where(F.col(index) < self.cut) if self.exceeded else df


def in_order(df: DataFrame, order: str | list[str], parts: int | None = None) -> DataFrame:
    """`df` sorted by `order` over all its partitions, kept in the shared folder.

    One exchange, by ranges of a sample, and a sort.  Ties go by a hash of the
    row, so that a key of very many rows is spread over partitions too, and
    reruns agree but for rows equal in all columns.
    """
    keys = [order] if isinstance(order, str) else order
    kinds = [(F.col(f"`{f.name}`"), f.dataType.simpleString()) for f in df.schema]
    tie = F.xxhash64(*[F.to_json(c) if "map<" in kind else c for c, kind in kinds if "variant" not in kind])  # maps have no hash
    own = df.withColumn("_pf_tie", tie)
    ranged = own.repartitionByRange(*([parts] if parts else []), *keys, "_pf_tie").sortWithinPartitions(*keys, "_pf_tie")
    return checkpointed(ranged.drop("_pf_tie"))


def running_sums(df: DataFrame, order: str | list[str], values: dict[str, Column], parts: int | None = None) -> DataFrame:
    """Adds, for each name in `values`, the sum of its value (a null counts as 0) over all rows up to this one in the order of `order`.

    Two passes over sorted partitions: their sums, one row each, give what
    lies before a partition, and within one the sums of Arrow batches run on.
    No row looks for its place, so the time doesn't grow with the number of
    partitions.
    """
    own = [f"_pf_n{k}" for k in range(len(values))]
    kept = in_order(df.withColumns({n: F.coalesce(v.cast("bigint"), F.lit(0).cast("bigint")) for n, v in zip(own, values.values(), strict=True)}), order, parts).withColumn("_part", F.spark_partition_id())
    sums = kept.groupBy("_part").agg(*[F.sum(n).alias(n) for n in own])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(F.col("_part"), *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_base{n}") for n in own])
    based = kept.join(F.broadcast(bases), "_part")  # one row a partition
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.LongType()) for n in values]])
    at = len(df.columns)

    def over(batches):
        seen = np.zeros(len(own), np.int64)
        for batch in batches:
            if batch.num_rows:
                sums = np.cumsum(np.stack([batch.column(at + k).to_numpy() for k in range(len(own))]), 1) + seen[:, None]
                seen = sums[:, -1].copy()
                yield pa.RecordBatch.from_arrays([*batch.columns[:at], *[pa.array(sums[k] + batch.column(at + len(own) + k)[0].as_py()) for k in range(len(own))]], names=schema.names)

    return based.select(*[f"`{c}`" for c in df.columns], *own, *[f"_base{n}" for n in own]).mapInArrow(over, schema)


def running(df: DataFrame, order: str | list[str], value: Column, name: str, parts: int | None = None) -> DataFrame:
    """`running_sums` of one value."""
    return running_sums(df, order, {name: value}, parts)


def _before(keys: list[str]) -> Column:
    """Whether a row's keys come before those of the cut, nulls first."""
    out = F.lit(False)
    for i, k in reversed(list(enumerate(keys))):
        own, cut = F.col(f"`{k}`"), F.col(f"_cut{i}")
        out = F.when(cut.isNull(), F.lit(False)).otherwise(F.coalesce(own < cut, F.lit(True))) | own.eqNullSafe(cut) & out
    return out


def within_limits(df: DataFrame, order: str | list[str], values: dict[str, Column], room: dict[str, int]) -> tuple[DataFrame, dict[str, int]]:
    """The rows before the first, in the order of `order`, with which a running sum is over its room, and the sums at that row; one must go over, and no value may be negative.

    Only keys and values of all rows are dealt by ranges, and only those of the
    range in which the sum goes over are sorted.  Whole rows are sorted where
    their keys are those of the first row beyond, as ties are told apart by
    all that is in them.
    """
    keys, names = [order] if isinstance(order, str) else order, list(values)
    own = {n: F.coalesce(v.cast("bigint"), F.lit(0).cast("bigint")) for n, v in values.items()}
    sums = lambda rows, given: rows.agg(*[F.coalesce(F.sum(given[n]), F.lit(0)).alias(n) for n in names]).first().asDict()
    narrow = df.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], *[v.alias(f"_v_{n}") for n, v in own.items()])
    ranged = checkpointed(narrow.repartitionByRange(*[f"_k{i}" for i in range(len(keys))])).withColumn("_part", F.spark_partition_id())
    parts = ranged.groupBy("_part").agg(*[F.sum(f"_v_{n}").alias(n) for n in names]).orderBy("_part").collect()  # one row a partition
    base = dict.fromkeys(names, 0)
    for part in parts:
        if any(base[n] + part[n] > room[n] for n in names):
            break
        base = {n: base[n] + part[n] for n in names}
    placed = running_sums(ranged.where(F.col("_part") == part["_part"]).drop("_part"), [f"_k{i}" for i in range(len(keys))], {n: F.col(f"_v_{n}") for n in names})
    passed = lambda b: functools.reduce(lambda x, y: x | y, [F.col(n) + b[n] > room[n] for n in names])
    cut = checkpointed(placed.where(passed(base)).orderBy(*names).limit(1).select(*[F.col(f"_k{i}").alias(f"_cut{i}") for i in range(len(keys))]))
    near = df.crossJoin(F.broadcast(cut))  # one row
    earlier = near.where(_before(keys)).select(*[f"`{c}`" for c in df.columns])
    base = sums(earlier, own)
    tie = functools.reduce(lambda x, y: x & y, [F.col(f"`{k}`").eqNullSafe(F.col(f"_cut{i}")) for i, k in enumerate(keys)])
    ties = running_sums(near.where(tie).select(*[f"`{c}`" for c in df.columns]), keys, {f"_pf_{n}": v for n, v in own.items()})
    tied = lambda n: F.col(f"_pf_{n}") + base[n]
    over = functools.reduce(lambda x, y: x | y, [tied(n) > room[n] for n in names])
    seen = ties.where(over).select(*[tied(n).alias(n) for n in names]).orderBy(*names).first().asDict()
    return earlier.unionByName(ties.where(~over).drop(*[f"_pf_{n}" for n in names])), seen


def item_index(df: DataFrame, order: str | list[str], parts: int | None = None) -> DataFrame:
    """Adds item_index, the zero-based place in the order of `order`: the place in a sorted partition and the rows of those before."""
    kept = in_order(df, order, parts).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = kept.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return kept.join(F.broadcast(bases), "_part").withColumn("item_index", F.col("_at") + F.col("_base")).drop("_part", "_at", "_base")  # one row a partition


def max_items(df: DataFrame, limit: int = MAX_ITEMS, index: str = "item_index") -> Verdict:
    """Every record counts; the first past the limit ends the stream."""
    over = not df.where(F.col(index) >= limit).isEmpty()
    return Verdict("items", limit, limit + 1 if over else limit, limit if over else None)


def _nth_bad(df: DataFrame, bad: Column, n: int, index: str) -> int | None:
    """The index of the n-th bad record, from 1; a top-n, not a sort."""
    top = df.where(bad).select(index).orderBy(index).limit(n)
    rows = top.agg(F.count("*").alias("n"), F.max(index).alias("last")).first()
    return rows["last"] if rows["n"] == n else None


def max_invalid(df: DataFrame, bad: Column, limit: int = MAX_INVALID, index: str = "item_index") -> Verdict:
    """Framing and validation failures share one counter; the first bad record over the limit ends the stream."""
    cut = _nth_bad(df, bad, limit + 1, index)
    return Verdict("invalid_items", limit, limit + 1 if cut is not None else limit, cut)


def fail_fast(df: DataFrame, bad: Column, index: str = "item_index") -> Verdict:
    """Delivers what comes before the first bad record."""
    return Verdict("fail_fast", 0, 1, _nth_bad(df, bad, 1, index))


def total_bytes(df: DataFrame, size: Column, limit: int, order: str) -> DataFrame:
    """Adds total_bytes, the running sum over all records, and within, whether it keeps to the limit."""
    return running(df, order, size, "total_bytes").withColumn("within", F.col("total_bytes") <= limit)


def nodes(contract, df: DataFrame) -> Column:
    """Values that a contract visits in a row of typed columns: the record, each field, and all that is inside."""
    total = F.lit(1).cast("bigint")
    for f in contract.fields:
        for n in f.names:
            if n in df.columns:
                total = total + C.row_nodes(f.type, F.col(f"`{n}`"), df.schema[n].dataType)
    return total


def max_nodes(df: DataFrame, contract, limit: int = MAX_NODES) -> DataFrame:
    """Adds nodes; a row over the limit ends the job when the action runs."""
    counted = nodes(contract, df)
    return df.withColumn("nodes", F.when(counted > limit, F.raise_error(F.concat(F.lit(f"nodes limit {limit} observed "), counted.cast("string"))).cast("bigint")).otherwise(counted))
