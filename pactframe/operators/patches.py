"""Patches by key: several per key fold to one, which is then applied to the base table."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pactframe.contract import compiler as C
from pactframe.contract.errors import Place, no_errors
from pactframe.contract.model import Contract
from pactframe.operators.shared import checkpointed


def fold_patches(patches: DataFrame, contract: Contract, key: str, order: str) -> DataFrame:
    """One patch a key: each field's last present value in the order; `patches` has key, order, value and present.

    A present null stays a change, so values travel in a struct.  Equals
    applying the patches one by one, with checks at the end.  Partial
    aggregation on each task makes a key with many patches cheap.
    """
    last = [F.max_by(F.struct(F.col("value")[f.name].alias("v")), F.when(F.array_contains("present", f.name), F.col(order))).alias(f"_{f.name}") for f in contract.fields]
    folded = patches.groupBy(key).agg(*last)
    value = F.struct(*[F.col(f"_{f.name}")["v"].alias(f.name) for f in contract.fields])
    present = F.filter(F.array(*[F.when(F.col(f"_{f.name}").isNotNull(), F.lit(f.name)) for f in contract.fields]), lambda n: n.isNotNull())
    return folded.select(key, value.alias("value"), present.alias("present"))


def apply_patch(base: DataFrame, patches: DataFrame, key: str, contract: Contract, patch_contract: Contract) -> DataFrame:
    """Rows of `base` with the present fields of their patch; whole-record checks run again.

    `base` has the contract's fields as columns, `patches` one row a key (see
    `fold_patches`).  Absent fields stay; a present null is a change.  Adds
    value, errors and changed.  Patches for output, or for another contract,
    are refused.
    """
    if patch_contract.mode == "output" or (patch_contract.origin or patch_contract.name) != (contract.origin or contract.name) or not patch_contract.partial:
        raise ValueError("a patch needs a partial contract of the same record, not for output")
    names = {f.name for f in patch_contract.fields}
    side = patches.select(F.col(key).alias("_key"), F.col("value").alias("_patch"), F.col("present").alias("_present"))
    joined = base.join(side, F.col(key) == F.col("_key"), "left")
    merged = [(F.when(F.array_contains("_present", f.name), F.col("_patch")[f.name]).otherwise(F.col(f.name)) if f.name in names else F.col(f.name)).alias(f.name) for f in contract.fields]
    staged = joined.select(key, *[m for m, f in zip(merged, contract.fields, strict=True) if f.name != key], F.coalesce(F.size("_present"), F.lit(0)).alias("_changed"))
    return recheck(staged, contract, [key]).withColumn("changed", F.col("_changed") > 0).drop("_changed")


def recheck(df: DataFrame, contract: Contract, keys: list[str], changed: frozenset[str] = frozenset()) -> DataFrame:
    """Adds value and errors of a table whose columns are the contract's fields by canonical name.

    Values are native, so representations don't run; transforms run on the
    `changed` fields alone.
    """
    plain = replace(contract, fields=tuple(replace(f, transforms=f.transforms if f.name in changed else (), load=None, alias=None, legacy=()) for f in contract.fields))
    own = type(df.schema)([f for f in df.schema if f.name in {x.name for x in contract.fields}])
    ctx = C.Ctx(stages=C.Stages())
    c = C.rows_record(plain, own, lambda n: F.col(f"`{n}`"), Place(), ctx)
    rest = [n for n in df.columns if n not in keys and n.startswith("_")]
    ok, _ = ctx.stage(c.ok, c.level)
    ok = ok & (F.spark_partition_id() >= 0)  # see validate._staged
    return ctx.stages.applied(df).select(*keys, *rest, F.when(ok, c.value).alias("value"), F.when(ok, no_errors()).otherwise(c.errors).alias("errors"))


def replace_fields(df: DataFrame, contract: Contract, keys: list[str], **changes) -> DataFrame:
    """Rows with some fields replaced by columns: transforms of these, then types, bounds and checks of the result."""
    unknown = set(changes) - {f.name for f in contract.fields}
    if unknown:
        raise ValueError(f"unknown fields {sorted(unknown)}")
    return recheck(df.withColumns(changes), contract, keys, frozenset(changes))


def apply_in_order(base: DataFrame, patches: DataFrame, key: str, order: str, contract: Contract, patch_contract: Contract, chunk: int = 10_000) -> DataFrame:
    """Rows of `base` after their patches one by one: a patch after which the record wouldn't hold is refused, and later ones go on without it.

    `patches` has key, order, value and present.  Adds applied (how many
    were), and refused (the orders of the others, first to last).  A key's
    patches are folded inside its row, at most `chunk` at once; keys with more
    go through further rounds, so that no row ever holds more.  Ties of order
    go by the patch's text; patches of unknown or null keys do nothing.
    """
    if patch_contract.mode == "output" or (patch_contract.origin or patch_contract.name) != (contract.origin or contract.name) or not patch_contract.partial:
        raise ValueError("a patch needs a partial contract of the same record, not for output")
    names = {f.name for f in patch_contract.fields}
    plain = replace(contract, fields=tuple(replace(f, transforms=(), load=None, alias=None, legacy=()) for f in contract.fields))
    own = type(base.schema)([base.schema[f.name] for f in contract.fields])
    seen = patches.schema[order].dataType

    def step(acc, p):
        merged = F.struct(*[(F.when(F.array_contains(p["present"], f.name), p["value"][f.name]).otherwise(acc["v"][f.name]) if f.name in names else acc["v"][f.name]).cast(own[f.name].dataType).alias(f.name) for f in contract.fields])

        def judged(new):
            ok = F.coalesce(C.rows_record(plain, own, lambda n: new[n], Place()).ok, F.lit(False))
            return C._let(F.struct(ok.alias("ok"), new.alias("v")), lambda t: F.struct(
                F.when(t["ok"], t["v"]).otherwise(acc["v"]).alias("v"), (acc["applied"] + t["ok"].cast("long")).alias("applied"),
                F.when(t["ok"], acc["refused"]).otherwise(F.concat(acc["refused"], F.array(p["at"]))).alias("refused")))

        return C._let(merged, judged)

    rank = Window.partitionBy("_key").orderBy("_at", "_tie")
    side = patches.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(order).alias("_at"), F.to_json("value").alias("_tie"), F.struct(F.col(order).alias("at"), "value", "present").alias("_patch"))
    side = checkpointed(side.withColumn("_n", F.row_number().over(rank)).drop("_at", "_tie").withColumn("_chunk", F.floor((F.col("_n") - 1) / chunk)))
    rounds = side.agg(F.coalesce(F.max("_chunk"), F.lit(-1))).first()[0] + 1
    done = base.select("*", F.struct(F.struct(*[F.col(f.name) for f in contract.fields]).alias("v"), F.lit(0).cast("long").alias("applied"), F.array().cast(T.ArrayType(seen)).alias("refused")).alias("_state"))
    for k in range(rounds):
        lists = side.where(F.col("_chunk") == k).groupBy("_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_patch")), lambda a, b: a["_n"] - b["_n"]), lambda x: x["_patch"]).alias("_patches"))
        met = done.join(lists, F.col(key) == F.col("_key"), "left")
        done = met.withColumn("_state", F.when(F.col("_patches").isNull(), F.col("_state")).otherwise(F.aggregate("_patches", F.col("_state"), step))).drop("_key", "_patches")
        if k + 1 < rounds:
            done = checkpointed(done)
    return done.select(*[F.col(f"_state.v.{f.name}").alias(f.name) for f in contract.fields], F.col("_state.applied").alias("applied"), F.col("_state.refused").alias("refused"))
