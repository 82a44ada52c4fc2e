"""Helpers of the registered queries: reading tables, flat results, and SQL for errors by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pactframe.contract.model import Contract
from pactframe.operators.shared import shared_folder  # noqa: F401
from pactframe.operators.validate import flat_errors, from_rows, validate_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """A table's rows in tasks of about `rows`, for work that is a row's: files are cut by bytes and row groups, which may hold millions of short rows."""
    parts = -(-df.count() // rows)  # from the files' footers
    return df.repartition(parts) if parts > 1 else df


def row_errors(df: DataFrame, contract: Contract, keys: list[str], max_errors: int = 100) -> DataFrame:
    """keys, position, path and code of every error of a typed table."""
    return flat_errors(from_rows(df, contract, max_errors, keep=keys), keys).select(*keys, "position", "path", "code")


def strict_errors(df: DataFrame, contract: Contract, keys: list[str]) -> DataFrame:
    return flat_errors(validate_table(df, contract, keep=keys), keys).select(*keys, "position", "path", "code")


def errors_sql(source: str, keys: list[str], rules: list[tuple[str, str]], first: bool = False, limit: int | None = None, row: bool = False) -> str:
    """SQL of keys, position, path, code (and rid, a number of the row): each rule is a path and an expression for its code, in order."""
    names = ", ".join(keys) + (", rid" if row else "")
    parts = " union all ".join(f"select {', '.join(keys)}, rid, {i} as i, '{path}' as path, {code} as code from src" for i, (path, code) in enumerate(rules))
    most = 1 if first else limit
    cut = f" where position < {most}" if most else ""
    return (f"with src as materialized (select *, row_number() over () as rid from {source}), e as ({parts}) select * from (select {names}, cast(row_number() over (partition by rid order by i) - 1 as int) as position, "
            f"path, code from e where code is not null){cut}")
