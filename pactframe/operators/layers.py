"""Values from several layers: the strongest wins, leaf by leaf, with its source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weakest first.
RANKS = {"default": 0, "toml": 1, "secret": 2, "environment": 3, "override": 4}


def normalized_path(name: Column, prefix: str = "") -> Column:
    """The leaf that a name such as PREFIX_A__B means: lower case, parts joined by dots; null without the prefix."""
    low = F.lower(name)
    rest = F.substring(low, F.lit(len(prefix) + 1), F.length(low))
    return F.when(low.startswith(prefix.lower()), F.array_join(F.split(rest, "__"), "."))


def resolve_layers(rows: DataFrame, entity: str = "entity") -> DataFrame:
    """entity, path, value, source: the strongest layer's value of each leaf.

    `rows` are (entity, rank, layer, path, value).  A value at a prefix of a
    path replaces what weaker layers have below it, and a value below replaces
    a weaker one at the prefix.  Prefixes are exploded and joined by equality.
    A null path (an empty object) erases nothing.
    """
    rows = rows.where(F.col("path").isNotNull())
    best = rows.groupBy(entity, "path").agg(F.max_by(F.struct("value", "layer"), "rank").alias("w"), F.max("rank").alias("rank"))
    parts = F.split("path", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "."))
    above = F.when(F.size(parts) > 1, above).otherwise(F.array().cast("array<string>"))
    links = best.select(entity, "path", "rank", F.explode(above).alias("prefix"))
    tops = best.select(F.col(entity).alias("_e"), F.col("path").alias("_p"), F.col("rank").alias("_r"))
    met = links.join(tops, (F.col(entity) == F.col("_e")) & (F.col("prefix") == F.col("_p")))
    hidden = (met.where(F.col("_r") > F.col("rank")).select(entity, "path")
              .union(met.where(F.col("_r") <= F.col("rank")).select(entity, F.col("prefix").alias("path"))).distinct())
    return best.join(hidden, [entity, "path"], "left_anti").select(entity, "path", F.col("w.value").alias("value"), F.col("w.layer").alias("source"))


def provenance(resolved: DataFrame, leaves: DataFrame, entity: str = "entity") -> DataFrame:
    """The source of each declared leaf of each entity; `default` where no layer has it."""
    return leaves.join(resolved.select(entity, "path", "source", "value"), [entity, "path"], "left").select(
        entity, "path", "value", F.coalesce("source", F.lit("default")).alias("source"))


def name_conflicts(named: DataFrame, names: DataFrame, entity: str = "entity") -> DataFrame:
    """Leaves that two names of one layer hit: entity, layer, leaf, names.

    `named` is (entity, layer, name), `names` the declared (name, leaf), a
    table of the declaration's size.
    """
    hit = named.withColumn("name", F.lower("name")).join(F.broadcast(names), "name")
    return (hit.groupBy(entity, "layer", "leaf").agg(F.sort_array(F.collect_set("name")).alias("names"))
            .where(F.size("names") > 1).withColumn("code", F.lit("alias_conflict")))
