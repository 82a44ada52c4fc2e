"""Mixing sources to target weights by capped water-filling (native expressions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pactframe.llm.common import ordered_prefix, written

WORD = r"[^\x20\x09-\x0D]+"
#: Hash buckets of a source; each is ordered by a task of its own.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2),
                   epochs: int = 2) -> DataFrame:
    """Water-filled targets: one row per source, from `sizes` (source, source_size).

    Sources by code point, null last, take `weights` in turn and share
    `share[0] / share[1]` of all sizes.  A source is clamped at `epochs` times
    its size and what it can't take goes to the others by weight, until no
    source is above its cap.  Sorted by cap over weight, the clamped sources
    are a prefix, so the repeated redistribution ends at one level: the first
    source whose cap is above the level that the rest would share.  Sums are
    of whole numbers; each target is one division.  An empty table gives no
    row; a source of size 0 gets target 0.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turns = F.array(*[F.lit(w).cast("bigint") for w in weights])
    named = sizes.withColumn("weight", F.element_at(turns, (F.row_number().over(by_name) - 1) % len(weights) + 1))
    caps = named.withColumn("cap", F.col("source_size") * epochs)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    filled = (
        caps.withColumn("total", F.sum("source_size").over(everything) * share[0])
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weights_left", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_left", F.col("total") - F.col("caps_before") * share[1])
        .withColumn("_clamped", F.col("cap") * F.col("weights_left") * share[1] <= F.col("_left") * F.col("weight"))
    )
    level = F.min(F.when(~F.col("_clamped"), F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("_left"), F.col("weights_left")))).over(everything)
    rest = F.col("_level._left") * F.col("weight") / (F.col("_level.weights_left") * share[1])
    return filled.withColumn("_level", level).select(
        "source", "source_size", "weight",
        F.when(F.col("_clamped") | F.col("_level").isNull(), F.col("cap").cast("double")).otherwise(rest).alias("target"))


def _taken(rows: DataFrame, sizes: DataFrame, seed: str, weights: tuple[int, ...], share: tuple[int, int], epochs: int, tie: Column | None = None) -> DataFrame:
    """`rows` (doc_id, source, size and more) with source_size, target and taken."""
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(per_source, weights, share, epochs).select(F.col("source").alias("_source"), "source_size", "target")
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    within = [F.col("_order"), F.col("doc_id"), F.col("size")] + ([] if tie is None else [tie])
    ranked = ordered_prefix(rows.withColumn("_order", order), ["source"], within, F.substring("_order", 1, BUCKET_DIGITS), F.col("size"), "before")
    whole = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("bigint")
    extra = F.floor(F.col("target") + 0.5).cast("bigint") - F.col("whole") * F.col("source_size")
    part = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), extra - F.col("before")))
    return (ranked.join(targets, F.col("source").eqNullSafe(F.col("_source")))
            .withColumn("whole", whole)
            .select(*rows.columns, "source_size", "target", (F.col("whole") * F.col("size") + part).alias("taken")))


def mix(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2),
        epochs: int = 2) -> DataFrame:
    """How many words of each document a mix takes: doc_id, source, size, source_size, target, taken.

    Every document is taken as often as its whole source is; documents ordered
    by a seeded hash of their id then get one more whole repetition while
    these fit the target, and the one at the edge a fraction of it.  A source
    so meets its target to the word and no document exceeds `epochs` times its
    size.  Null texts and texts without a word have size 0 and are taken 0
    times; very long texts are only counted; null sources are one source, the
    last; rows with equal ids are separate rows; other columns are ignored,
    whatever their names; an empty table gives no row.  Reruns agree: nothing
    depends on partitions.  The targets' windows run over one row a source, in
    one task: sources are taken to be few.
    """
    sizes = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    return _taken(sizes, sizes, seed, weights, share, epochs)


def repeat_documents(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), epochs: int = 2) -> DataFrame:
    """The mix itself: documents repeated as `mix` says, with the columns of `docs`.

    A repetition that is a fraction is the prefix of the text up to its last
    word that is taken, white space and all; texts of which nothing is taken
    are left out, so null and empty ones.  Each row carries its own number, so
    that rows with equal ids, sources and sizes are told apart and none is
    lost.  Columns travel in a struct: their names can't clash.
    """
    sizes = docs.select("source", word_count(F.col("text")).alias("size"))
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    taken = _taken(rows, sizes, seed, weights, share, epochs, F.xxhash64("_row.text")).where("taken > 0")
    copies = F.transform(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int")),
                         lambda k: F.least(F.col("size"), F.col("taken") - (k - 1) * F.col("size")))
    out = taken.select("_row", "size", F.explode(copies).alias("_words"))
    lead = F.array_join(F.slice(F.regexp_extract_all(F.col("_row.text"), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), 1, F.col("_words").cast("int")), "")
    whole = F.col("_words") == F.col("size")
    out = out.withColumn("_text", F.when(whole, F.col("_row.text")).otherwise(lead))
    fixed = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        fixed["n_chars"] = F.when(whole, F.col("_row.n_chars")).otherwise(F.length("_text")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[fixed.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])


MIX_SQL = r"""
with sizes as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size from documents
), sources as (
  select source, cast(sum(size) as bigint) as source_size from sizes group by source
), named as (
  select source, source_size, [3, 1, 2][cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as int)] as weight,
    2 * source_size as cap from sources
), filled as (
  select *, cast(3 * sum(source_size) over () as bigint)
      - 2 * cast(coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as bigint) as rest,
    cast(sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as bigint) as weights_left
  from named
), split as (
  select *, cap * weights_left * 2 <= rest * weight as clamped from filled
), level as (
  select rest, weights_left from split where not clamped order by cap / weight, source nulls last limit 1
), targets as (
  select source, source_size,
    case when clamped then cast(cap as double)
      else cast((select rest from level) * weight as double) / cast((select weights_left from level) * 2 as double) end as target
  from split
), ranked as (
  select s.doc_id, s.size, t.source_size, t.target,
    case when t.source_size = 0 then 0 else cast(floor(t.target / t.source_size) as bigint) end as whole,
    cast(coalesce(sum(s.size) over (partition by s.source order by md5('mix:' || coalesce(cast(s.doc_id as varchar), '')), s.doc_id, s.size
      rows between unbounded preceding and 1 preceding), 0) as bigint) as before
  from sizes s join targets t on s.source is not distinct from t.source
)
select doc_id, size, source_size, target,
  cast(whole * size + greatest(0, least(size, cast(floor(target + 0.5) as bigint) - whole * source_size - before)) as bigint) as taken
from ranked
"""
