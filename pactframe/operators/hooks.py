"""The typed boundary of a function over columns."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pactframe.contract import compiler as C
from pactframe.contract.errors import Place, no_errors
from pactframe.contract.model import Hook


def python_hook(fn: Callable, gives: T.DataType | None = None) -> Hook:
    """A transform, or without `gives` a check, from a Python function of one value.

    Values go in Arrow batches, and only those that are still wanted are
    looked at: earlier hooks and types have passed.  `ValueError` is a failure
    of that row; any other exception ends the job.  None is passed and
    returned like any value.  A check returns None.
    """
    kind = T.BooleanType() if gives is None else gives
    value_type = to_arrow_type(kind)

    @F.arrow_udf(T.StructType([T.StructField("value", kind), T.StructField("failed", T.BooleanType())]))
    def called(values: pa.Array, wanted: pa.Array) -> pa.Array:
        out, failed = [], []
        for v, w in zip(values.to_pylist(), wanted.to_pylist(), strict=True):
            result, bad = None, False
            if w:
                try:
                    result = fn(v)
                except ValueError:
                    bad = True
                if gives is None and result is not None:
                    raise TypeError("a check must return None")
            out.append(result)
            failed.append(bad)
        return pa.StructArray.from_arrays([pa.array(out, value_type), pa.array(failed, pa.bool_())], names=["value", "failed"])

    return Hook(lambda value, wanted: called(value, wanted))


def validated_udf(df: DataFrame, fn, params: list[tuple], returns, arguments: list[str], rest: tuple[str, object] | None = None) -> DataFrame:
    """Adds value and errors of `fn` (a column function or UDF) over checked arguments.

    `params` are (name, type) or (name, type, default); `arguments` are
    columns, and where there are fewer than parameters, defaults stand for the
    others.  Arguments beyond the parameters are those of `rest`, (name, type),
    and are located at that name and their place.  Each argument is checked
    strictly at its parameter's name, the result at `return`; the function
    sees nulls in place of all arguments where one failed, and its result
    counts only where all passed.
    """
    ctx = C.Ctx(stages=C.Stages())
    if len(arguments) > len(params) and rest is None or len(arguments) < sum(len(p) == 2 for p in params):
        raise ValueError(f"{len(arguments)} arguments for {len(params)} parameters")
    checked = [C.rows(p[1], F.col(f"`{a}`"), df.schema[a].dataType, Place().field(p[0]), ctx) for p, a in zip(params, arguments, strict=False)]
    checked += [C.rows(rest[1], F.col(f"`{a}`"), df.schema[a].dataType, Place().field(rest[0]).index(F.lit(k)), ctx) for k, a in enumerate(arguments[len(params):])]
    staged = [ctx.stage(c.ok, c.level) for c in checked]
    good, level = ctx.stage(C._all([ok for ok, _ in staged]), max([0, *[n for _, n in staged]]))
    given = [F.when(good, F.col(f"`{a}`")) for a in arguments] + [F.lit(p[2]) for p in params[len(arguments):]]
    done = ctx.stages.applied(df).withColumn("_result", fn(*given))
    result = C.rows(returns, F.col("_result"), done.schema["_result"].dataType, Place().field("return"))
    failed = F.flatten(F.array(*[F.when(~ok, c.errors).otherwise(no_errors()) for (ok, _), c in zip(staged, checked, strict=True)])) if checked else no_errors()
    errors = F.when(~good, failed).when(result.ok, no_errors()).otherwise(result.errors)
    return done.select(*df.columns, F.when(good & result.ok, F.col("_result")).alias("value"), errors.alias("errors"))


def dump_checked(kind, value: Column, fn, dtype) -> C.Compiled:
    """A field serialised by `fn`, its result checked against the declared output; errors are empty where it is sound."""
    c = C.rows(kind, fn(value), dtype, Place().field("output"))
    return C.Compiled(c.value, c.ok, F.when(c.ok, no_errors()).otherwise(c.errors), c.truncated, c.level)
