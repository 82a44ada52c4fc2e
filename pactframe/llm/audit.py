"""How filters of a corpus interact: what each of them removes in every order, alone and together with the others."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactframe.llm.common import written

FILTERS = "ABCDE"
#: Rows of one text above which its rows are dealt to several tasks; never more such texts than HOT_TEXTS.
HOT_ROWS, HOT_TEXTS = 1000, 10_000
_BIT = {f: 1 << k for k, f in enumerate(FILTERS)}
_GAP = r"[\x20\x09-\x0D]+"


def text_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails; a null text is empty.

    A: under 200 words; B: under half of the words distinct; C: over 2 % of
    the characters in A-Z; D: a character of `#$%&*|`.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, _GAP), lambda w: w != "")
    return (F.when(F.size(words) < 200, _BIT["A"]).otherwise(0)
            + F.when(100 * F.size(F.array_distinct(words)) < 50 * F.size(words), _BIT["B"]).otherwise(0)
            + F.when(100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))) > 2 * F.length(text), _BIT["C"]).otherwise(0)
            + F.when(text.rlike("[#$%&*|]"), _BIT["D"]).otherwise(0))


def repeated_rows(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows (doc_id, part, h) of `rows` whose text a smaller doc_id has too: an existential self-join.

    `docs` has doc_id, h and text, `rows` the same documents without texts.
    Texts are moved once, one row a distinct text and task: grouped by hash and
    exact text they give the least doc_id of each.  Where a hash stands for one
    text alone, the hash decides for all its rows; rows of the others (two
    texts of one 64-bit hash) are joined by their text as well.  Rows of a
    text that many have are dealt to several tasks by a salt, of which the
    other side gets a copy each.
    """
    firsts = docs.groupBy("h", "text").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("rows")).drop("text")
    firsts = written(firsts, "audit-firsts")
    shared = written(firsts.groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1").select(F.col("h").alias("_h")), "audit-shared")
    right, left = firsts.where("least < most"), rows
    if not shared.isEmpty():
        # Nearly never: unlike texts of one hash.  Their rows alone carry the text.
        of_shared = F.col("h") == F.col("_h")
        clash = docs.join(shared, of_shared, "left_semi")
        bodies = clash.groupBy(F.col("h").alias("_h"), F.col("text").alias("_text")).agg(F.min("doc_id").alias("least"))
        clashing = clash.join(bodies, of_shared & (F.col("text") == F.col("_text")) & (F.col("least") < F.col("doc_id")), "left_semi").select("doc_id", "part", "h")
        right, left = right.join(shared, of_shared, "left_anti"), left.join(shared, of_shared, "left_anti")
    # At most HOT_TEXTS hashes: each has over a HOT_TEXTS-th of all rows.
    most = max(HOT_ROWS, rows.count() // HOT_TEXTS)
    hot = right.where(F.col("rows") > most).select(F.col("h").alias("_hot"), F.ceil(F.col("rows") / most).cast("int").alias("_salts"))
    hot = written(hot, "audit-hot")
    salted = left.join(F.broadcast(hot), F.col("h") == F.col("_hot"), "left")
    salted = salted.withColumn("_salt", F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64("doc_id", F.lit(2)), F.col("_salts")).cast("int")).otherwise(0)).drop("_hot", "_salts")
    sides = right.join(F.broadcast(hot), F.col("h") == F.col("_hot"), "left")
    sides = sides.select(F.col("h").alias("_h"), "least", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)).alias("_of"))
    on = (F.col("h") == F.col("_h")) & (F.col("_salt") == F.col("_of")) & (F.col("least") < F.col("doc_id"))
    found = salted.join(sides, on, "left_semi").select("doc_id", "part", "h")
    return found if shared.isEmpty() else found.union(clashing)


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic, n: documents by the set of filters that they fail, as bits, and by their labels.

    Failing E means that a smaller doc_id anywhere in the table has the same
    text; equal rows of one doc_id, and rows without one, don't make each
    other fail.  A part is a value of `source`; null is the empty one.  A
    document is good (toxic) if any row of `labels` with its doc_id says so;
    ids without a label, and null ids, are neither.  Other columns are not
    read; an empty table gives no row.
    """
    text = F.coalesce("text", F.lit(""))
    known = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.xxhash64(text).alias("h"), text.alias("text"))
    rows = written(known.select("doc_id", "part", "h", text_failures(F.col("text")).alias("mask")), "audit-rows")
    failed = repeated_rows(rows.select("doc_id", "part", "h"), known)
    # Ids of all documents with their other failures, and those of E; of repeated rows `n` counts.
    bits = rows.withColumn("n", F.lit(1)).union(failed.select("doc_id", "part", "h", F.lit(_BIT["E"]).alias("mask"), F.lit(0).alias("n")))
    whole = bits.groupBy("doc_id", "part", "h").agg(F.bit_or("mask").alias("mask"), F.sum("n").alias("n"))
    whole = whole.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    joined = whole.join(told, F.col("doc_id") == F.col("_id"), "left")
    return (joined.groupBy("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
            .agg(F.sum("n").alias("n")))


def interactions(counted: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of each, of what `combinations` gives.

    What a filter removes depends on the set before it, not on that set's
    order, so counts are made for the 80 pairs of a filter and a set, and
    pairs are then spread over the 120 orders.
    """
    pairs = [(f, s) for f in FILTERS for s in range(32) if not s & _BIT[f]]
    spread = F.explode(F.array(*[F.struct(F.lit(_BIT[f]).alias("bit"), F.lit(s).alias("before"), F.lit(factorial(bin(s).count("1")) * factorial(4 - bin(s).count("1"))).alias("orders")) for f, s in pairs]))
    each = counted.withColumn("pair", spread).select("part", "mask", "good", "toxic", "n", "pair.*")
    mask, bit, before = F.col("mask"), F.col("bit"), F.col("before")
    fails, earlier = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(before) != 0
    count = lambda where: F.sum(F.when(where, F.col("n")).otherwise(0)).cast("long")
    sets = each.groupBy("part", "bit", "before", "orders").agg(
        count(~fails & ~earlier).alias("kept"), count(fails & ~earlier).alias("removed"), count(fails & earlier).alias("redundant"),
        count(mask == bit).alias("unique_fails"), count(fails & ~earlier & F.col("good")).alias("good_lost"), count(fails & ~earlier & F.col("toxic")).alias("toxic_lost"))
    sums = sets.groupBy("part", "bit").agg(F.sum(F.col("removed") * F.col("orders")).cast("long").alias("shapley"))
    sets = sets.join(sums.select(F.col("part").alias("_part"), F.col("bit").alias("_bit"), "shapley"), (F.col("part") == F.col("_part")) & (F.col("bit") == F.col("_bit")))
    orders: dict[tuple[int, int], list[tuple[str, int]]] = {}
    for order in map("".join, permutations(FILTERS)):
        done = 0
        for step, f in enumerate(order, 1):
            orders.setdefault((_BIT[f], done), []).append((order, step))
            done |= _BIT[f]
    spark = counted.sparkSession
    steps = spark.createDataFrame([(b, s, o, k) for (b, s), found in orders.items() for o, k in found], "_b int, _s int, filter_order string, step int")  # 600 rows
    return sets.join(F.broadcast(steps), (F.col("bit") == F.col("_b")) & (F.col("before") == F.col("_s"))).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


AUDIT_SQL = r"""
with words as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), failures as (
  select doc_id, part, (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int
    + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text))::int + 8 * regexp_matches(text, '[#$%&*|]')::int
    + 16 * coalesce(doc_id > min(doc_id) over (partition by text), false)::int as mask
  from words
), told as (
  select doc_id, coalesce(bool_or(quality = 1), false) as good, coalesce(bool_or(toxic = 1), false) as toxic from labels where doc_id is not null group by doc_id
), known as (
  select part, mask, coalesce(good, false) as good, coalesce(toxic, false) as toxic from failures left join told using (doc_id)
), letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as f, unnest([1, 2, 4, 8, 16]) as bit
), orders as (
  select a.f || b.f || c.f || d.f || e.f as filter_order from letters a, letters b, letters c, letters d, letters e
  where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps as (
  select filter_order, step, l.bit, (select coalesce(sum(x.bit), 0)::int from letters x where strpos(filter_order, x.f) < step) as before
  from orders, (select unnest([1, 2, 3, 4, 5]) as step) s, letters l where l.f = filter_order[step]
), sets as (select distinct bit, before from steps
), counts as (
  select part, bit, before, count(*) filter (mask & (bit | before) = 0) as kept, count(*) filter (mask & bit <> 0 and mask & before = 0) as removed,
    count(*) filter (mask & bit <> 0 and mask & before <> 0) as redundant, count(*) filter (mask = bit) as unique_fails,
    count(*) filter (mask & bit <> 0 and mask & before = 0 and good) as good_lost, count(*) filter (mask & bit <> 0 and mask & before = 0 and toxic) as toxic_lost
  from known, sets group by part, bit, before
), wide as (select part, filter_order, step, bit, counts.* exclude (part, bit, before) from counts join steps using (bit, before))
select part, filter_order, cast(step as int) as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, cast(sum(removed) over (partition by part, bit) as bigint) as shapley from wide
"""
