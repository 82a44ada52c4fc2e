"""Tagged records to one table per branch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactframe.contract import compiler as C
from pactframe.contract.model import Contract, Literal, Tagged
from pactframe.operators.validate import from_json


def route(result: DataFrame, kind: Tagged, keys: list[str]) -> dict[str, DataFrame]:
    """A typed DataFrame per branch of validated tagged records; each reads `result` for itself, so give a written or persisted one."""
    good = result.where(F.col("value").isNotNull()).select(*keys, "value")
    return {c.name: good.where(F.col("value")[kind.tag] == F.lit(t)).select(*keys, F.col("value")[c.name].alias("value")) for t, c in kind.branches}


def write_routed(result: DataFrame, kind: Tagged, keys: list[str], path: str, salts: int = 16) -> None:
    """Good rows, written in folders by tag; a frequent tag is dealt to several tasks."""
    good = result.where(F.size("errors") == 0).select(*keys, F.col("value")[kind.tag].alias(kind.tag), "value")
    salted = good.repartition(F.col(kind.tag), F.pmod(F.xxhash64(*keys), F.lit(salts)))
    salted.write.partitionBy(kind.tag).parquet(path)


def dispatch(df: DataFrame, column: str, kind: Tagged, keys: list[str], path: str, max_errors: int = 100) -> tuple[dict[str, DataFrame], DataFrame]:
    """({branch: keys, value, errors, truncated of its rows}, keys and errors of the rows that no branch takes) of JSON texts.

    One pass reads the tag of each text and writes the rows to a folder a
    branch, below `path` in a folder that driver and executors share; then
    each branch's contract is compiled for its own rows alone.  So a row costs
    what its branch costs, however many there are, where `from_json` has all
    branches in each row's plan.  Spark sorts rows by
    branch before it writes, so a task has one file open.  Texts that aren't strict JSON,
    or have no known tag, are found by the tags alone and checked as a whole.
    """
    spark = df.sparkSession
    values = [t for t, _ in kind.branches]
    base = Literal(tuple(values)).base()
    tag = C.json_scalar(base, C.member(F.try_parse_json(F.col(column)), kind.tag))
    number = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, t in enumerate(values) for x in (t, k)]), tag), F.lit(-1))
    df.select(*keys, column, number.alias("_branch")).write.partitionBy("_branch").parquet(path)
    written = spark.read.schema(df.select(*keys, column).schema.add("_branch", T.IntegerType())).parquet(path)
    out = {}
    for k, (_, contract) in enumerate(kind.branches):
        own = written.where(F.col("_branch") == k).drop("_branch")
        out[contract.name] = from_json(own, column, contract, max_errors, keep=keys, ignored=(kind.tag,)).drop("present")
    rest = from_json(written.where("_branch = -1").drop("_branch"), column, Tagged(kind.tag, tuple((t, Contract(c.name, ())) for t, c in kind.branches)), max_errors, keep=keys)
    return out, rest.select(*keys, "errors")
