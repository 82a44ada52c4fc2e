"""Groups of documents with similar word shingles: an exact Jaccard self-join of sets, helped by SimHash tries."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pactframe.llm.common import as_map, registered, scratch, stored, written
from pactframe.llm.simhash import components, shingle_hashes, simhash, trie_links

#: Longs of 64 parities by which a set of shingles is told from others before the sets themselves are compared.
PARITIES = 8
SKETCH = [f"p{k}" for k in range(PARITIES)]
#: In place of a number of shared shingles that isn't known.
ANY = 2**30
#: Keys of a set before one of its keys by which a pair is known to have met already.
BEFORE = 4
#: Texts whose sets a task holds at once.
SLICE = 64
#: Hash buckets by which texts are picked out, and how many of them are listed at most.
BUCKETS, MARKED = 1 << 20, 1 << 15
#: Bounds of what the order of shingles is learnt from; it decides the costs, not the links.
ORDER_DOCS, ORDER_SHINGLES = 10_000, 65_536


def frequent_shingles(docs: DataFrame, words: int, seed: int = 42, text: str = "text") -> np.ndarray:
    """Hashes of shingles that at least three of about ORDER_DOCS documents hold, rarest first; at most ORDER_SHINGLES."""
    total = docs.count()
    draw = F.pmod(F.xxhash64(F.col(text), F.lit("order")), F.lit(1_000_000)) / 1e6

    def over(batch):
        found = [np.unique(shingle_hashes(t, words, seed)) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found or [np.zeros(0, np.uint64)]).view(np.int64))], names=["h"])

    sample = docs.where(F.col(text).isNotNull() & (draw < min(1.0, ORDER_DOCS / max(1, total)))).select(text)
    counts = as_map(sample, over, "h long").groupBy("h").count().where("count >= 3")
    top = counts.orderBy(F.desc("count"), "h").limit(ORDER_SHINGLES).collect()
    return np.array([r["h"] for r in reversed(top)], np.int64).view(np.uint64)


def parities(hashes: np.ndarray, count: int) -> np.ndarray:
    """Longs of `count` bits, a power of two from 64 on: each says whether an odd number of hashes ends in its place."""
    odd = (np.bincount((hashes & np.uint64(count - 1)).astype(np.int64), minlength=count) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8")


def shingle_sets(docs: DataFrame, words: int, similarity: float, keep: tuple[str, ...], seed: int = 42, text: str = "text") -> DataFrame:
    """`keep` and, of each whole text's set of shingles: node (its hash), n (its size), fp (SimHash), sketch, wide and prefix.

    `prefix` holds the set's n - ceil(similarity * n) + 1 first shingles, frequent ones last: two sets
    of at least that similarity share one of them.  `wide` holds, of sets of more shingles than the
    sketch has parities, at least as many parities as shingles.  Null and wordless texts have the empty set.
    """
    frequent = frequent_shingles(docs, words, seed, text)
    by_hash = np.argsort(frequent)
    shared = docs.sparkSession.sparkContext.broadcast((frequent[by_hash], by_hash + 1))
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("fp", T.LongType()),
                           *[T.StructField(p, T.LongType()) for p in SKETCH], T.StructField("wide", T.ArrayType(T.LongType())), T.StructField("prefix", T.ArrayType(T.LongType()))])

    def over(batch):
        for at in range(0, batch.num_rows, 16 * SLICE):
            yield from part(batch.slice(at, 16 * SLICE))

    def part(batch):
        known, places = shared.value
        rows, wide, prefixes = [], [], []
        for t in batch.column(len(keep)).to_pylist():
            hashes = np.unique(shingle_hashes(t or "", words, seed))
            n = len(hashes)
            rank = np.zeros(n, np.int64)
            if len(known) and n:
                at = np.searchsorted(known, hashes).clip(max=len(known) - 1)
                rank = np.where(known[at] == hashes, places[at], 0)
            first = n - math.ceil(similarity * n - 1e-9) + 1 if n else 0
            prefixes.append(hashes[np.argsort(rank, kind="stable")[:first]].view(np.int64))
            wide.append(parities(hashes, 1 << (n - 1).bit_length()) if n > 64 * PARITIES else np.zeros(0, np.int64))
            node = xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), seed)
            rows.append(np.array([node, n, simhash(hashes), *parities(hashes, 64 * PARITIES).view(np.uint64)], np.uint64))
        table = np.stack(rows).view(np.int64) if rows else np.zeros((0, 3 + PARITIES), np.int64)
        lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in part])]).astype(np.int32)), pa.array(np.concatenate(part or [np.zeros(0, np.int64)])))
                 for part in (wide, prefixes)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], *[pa.array(np.ascontiguousarray(table[:, k])) for k in range(table.shape[1])], *lists], names=schema.names)

    return as_map(docs.select(*keep, text), over, schema)


def _may_be(similarity: float, a: str, b: str) -> Column:
    """False only where the sizes or the parities of sets `a` and `b` show a smaller similarity."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = sum((F.bit_count(F.col(f"{a}.{p}").bitwiseXOR(F.col(f"{b}.{p}"))) for p in SKETCH), F.lit(0))
    return (F.least(n, m) >= F.greatest(n, m) * similarity - 1e-6) & (apart <= _apart(n, m, similarity))


def _apart(n: Column, m: Column, similarity: float) -> Column:
    """How many shingles only one of two sets of that similarity has, at most."""
    return (n + m) * ((1 - similarity) / (1 + similarity)) + 1e-6


def _may_be_wide(similarity: float, a: str, b: str) -> Column:
    """False only where the parities in `wide` of sets `a` and `b` show a smaller similarity; the longer of two lists is folded to the other's length."""
    x, y = F.col(f"{a}.wide"), F.col(f"{b}.wide")

    def half(v: Column) -> Column:
        size = (F.size(v) / 2).cast("int")
        return F.zip_with(F.slice(v, F.lit(1), size), F.slice(v, size + 1, size), lambda p, q: p.bitwiseXOR(q))

    ones = lambda v, w: F.aggregate(F.zip_with(v, w, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, c: s + c)
    apart = (F.when(F.size(x) == F.size(y), ones(x, y)).when(F.size(x) == 2 * F.size(y), ones(half(x), y))
             .when(2 * F.size(x) == F.size(y), ones(x, half(y))).otherwise(0))
    return apart <= _apart(F.col(f"{a}.n"), F.col(f"{b}.n"), similarity)


def exact_links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, on: list[str], words: int, similarity: float, seed: int = 42, text: str = "text",
                known: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Those pairs (a > b) of nodes whose sets of shingles have a Jaccard similarity of at least `similarity`, the pairs compared and their sets.

    `common` bounds how many shingles of their prefixes the two share.  Beyond the prefixes two sets can share
    no more than the rest of one of them, so sizes, parities and `common` rule out most pairs.  `classes` names by its
    columns `on` a row of `docs` for each node; only texts of the pairs left are read again, but for sets in `known`.
    """
    narrow = classes.select("node", "n", F.size("prefix").alias("first"), *SKETCH, "wide")
    left, right = narrow.alias("x"), narrow.alias("y")
    pairs = pairs.alias("q").join(left, F.col("q.a") == F.col("x.node")).join(right, F.col("q.b") == F.col("y.node"))
    n, m = F.col("x.n"), F.col("y.n")
    shared = F.col("q.common") + F.greatest(n - F.col("x.first"), m - F.col("y.first")) >= (n + m) * (similarity / (1 + similarity)) - 1e-6
    pairs = written(pairs.where(_may_be(similarity, "x", "y") & shared).where(_may_be_wide(similarity, "x", "y")).select("a", "b", n.alias("na"), m.alias("nb")), "similar-pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    if known is not None:
        wanted = wanted.join(known.select("node"), "node", "left_anti")
    wanted = written(wanted.join(classes.select("node", *on), "node"), "similar-wanted")
    match = [F.col(k).eqNullSafe(F.col(f"_w_{k}")) for k in on]
    bucket = F.pmod(F.xxhash64(*on), F.lit(BUCKETS))
    if wanted.count() <= MARKED:  # few texts: the others are left out before anything is shuffled
        marked = [r[0] for r in wanted.select(bucket.alias("b")).distinct().collect()]
        docs = docs.where(bucket.isin(marked))
    texts = docs.join(wanted.select("node", *[F.col(k).alias(f"_w_{k}") for k in on]), match).dropDuplicates(["node"]).select("node", text)

    def over(batch):
        for at in range(0, batch.num_rows, SLICE):  # sets take more room than texts
            part = batch.slice(at, SLICE)
            sets = [np.unique(shingle_hashes(t.as_py() or "", words, seed)).view(np.int64) for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    sets = written(as_map(texts, over, "node long, shingles array<long>"), "similar-sets")
    sets = sets if known is None else known.union(sets)
    both = (pairs.join(sets.toDF("a", "_sa"), "a").join(sets.toDF("b", "_sb"), "b")
            .withColumn("common", F.size(F.array_intersect("_sa", "_sb"))))
    links = both.where(F.col("common") >= (F.col("na") + F.col("nb") - F.col("common")) * similarity - 1e-6).select("a", "b")
    return written(links, "similar-links"), pairs.select("a", "b"), sets


def _pair(a: str, b: str) -> list[Column]:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


#: Rounds in which the sets of a shingle meet one of them, at most, before those still apart meet in pairs.
ROUNDS = 4
#: The share of the open rows that a round must have closed for another one.
WORTH = 0.05


def shared_keys(keyed: DataFrame) -> DataFrame:
    """Those rows of `keyed` (key, node, first) whose key another row has: one pass over sorted rows, which holds one of them."""

    def over(batches):
        held = None
        for batch in batches:
            table = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)
            if held is not None:
                table = np.concatenate([held[0], table])
            if not len(table):
                continue
            same = table[1:, 0] == table[:-1, 0]
            shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            if held is not None:
                shared[0] |= held[1]
            out = table[:-1][shared[:-1]]
            held = (table[-1:], bool(shared[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(out[:, k])) for k in range(3)], names=["key", "node", "first"])
        if held is not None and held[1]:
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(held[0][:, k])) for k in range(3)], names=["key", "node", "first"])

    return keyed.select("key", "node", F.col("first").cast("long")).repartition("key").sortWithinPartitions("key").mapInArrow(over, "key long, node long, first long")


def jaccard_links(classes: DataFrame, docs: DataFrame, on: list[str], words: int, similarity: float, block: int = 1024, rounds: int = ROUNDS) -> DataFrame:
    """Links (a > b) with the same components as all pairs of nodes of at least `similarity`; each link is such a pair.

    Sets that share a shingle of their prefixes meet.  At first each meets only one set of its shingle that
    isn't connected with it yet, the one whose own prefix is shared most, in a component drawn by a hash, and the least of
    its fingerprints' class in the trie join.  In large groups of near copies that joins most sets in a few
    rounds of as many comparisons as there are sets.  Then all sets that share a shingle and are still apart are compared in
    pairs, so that no link is lost: those outside a shingle's largest component with all others.
    The others are dealt into blocks of about `block` and the first into blocks of 64 times that; each pair of blocks is
    a key of the join, so no key has more, however many sets share a shingle.
    """
    rows = written(shared_keys(classes.select("node", F.size("prefix").alias("first"), F.explode("prefix").alias("key"))), "similar-keys")
    weights = rows.groupBy("node").agg((F.count("*") / F.first("first")).alias("w"))
    rows = rows.join(weights, "node").select("key", "node", F.col("node").alias("root"), "w")
    near = components(trie_links(classes.select("fp")))
    tried = classes.select("node", "fp").join(near.toDF("_fp", "_root"), F.col("fp") == F.col("_fp")).select("node", "_root")
    tried = tried.join(tried.groupBy("_root").agg(F.min("node").alias("center")), "_root").where("node <> center").select(*_pair("node", "center"), F.lit(ANY).alias("common"))
    links = compared = sets = roots = None
    before = None
    for k in range(rounds + 1):
        if roots is not None:
            rows = written(_open(rows, roots), "similar-open")
            now = rows.count()
            if k == rounds or not now or before is not None and now > before * (1 - WORTH):
                break
            before = now
        drawn = F.struct(F.xxhash64("root", F.lit(k)) if roots is not None else F.lit(0), "w", "node")
        centers = rows.groupBy("key").agg(F.max_by(F.struct("node", "root"), drawn).alias("c"))
        stars = rows.join(centers, "key").where(F.col("root") != F.col("c.root")).select(*_pair("node", "c.node")).groupBy("a", "b").agg(F.count("*").alias("common"))
        if compared is None:
            stars = stars.union(tried).groupBy("a", "b").agg(F.sum("common").alias("common"))
        else:
            stars = stars.join(compared, ["a", "b"], "left_anti")
        found, met, sets = exact_links(stars, classes, docs, on, words, similarity, known=sets)
        links = found if links is None else links.union(found)
        compared = met if compared is None else compared.union(met)
        roots = written(components(links).toDF("_node", "_root"), "similar-roots")
    pairs = meetings(rows.drop("w"), classes, similarity, block)
    pairs = pairs.distinct().join(compared, ["a", "b"], "left_anti").withColumn("common", F.lit(ANY))
    last, _, _ = exact_links(pairs, classes, docs, on, words, similarity, known=sets)
    return roots.toDF("a", "b").union(last)


def meetings(rows: DataFrame, classes: DataFrame, similarity: float, block: int) -> DataFrame:
    """a, b (a > b) of all sets apart that share a key of `rows` (key, node, root) and may be similar, a few rows a pair.

    Each row knows the BEFORE keys of its set before its own: a pair that shares one of them has met there, so
    near copies, which share most of their keys, don't meet once a key.
    """
    rows = rows.join(classes.select("node", "n", *SKETCH), "node")
    by_root = rows.groupBy("key", "root").count().groupBy("key").agg(F.sum("count").alias("m"), F.max_by("root", F.struct("count", "root")).alias("most"), F.max("count").alias("c"))
    by_root = by_root.select("key", "most", F.ceil(F.col("m") / block).cast("long").alias("js"), F.ceil((F.col("m") - F.col("c")) / (64 * block)).cast("long").alias("is"))
    earlier = Window.partitionBy("node").orderBy("key").rowsBetween(-BEFORE, -1)
    rows = written(rows.withColumn("before", F.collect_list("key").over(earlier)).join(by_root, "key"), "similar-rest")
    x = rows.where("root <> most").withColumn("i", F.pmod(F.xxhash64("node"), F.col("is"))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("js") - 1))).alias("x")
    y = rows.withColumn("j", F.pmod(F.xxhash64("node", F.lit(1)), F.col("js"))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("is") - 1))).alias("y")
    met = (F.col("x.key") == F.col("y.key")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    met = met & (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("y.most")) | (F.col("x.node") < F.col("y.node")))
    met = met & ~F.arrays_overlap("x.before", "y.before")  # the first key that two sets share is never left out
    return x.join(y, met & _may_be(similarity, "x", "y")).select(*_pair("x.node", "y.node"))


def _open(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """key, node, root, w of the shingles whose sets aren't all connected."""
    rows = rows.drop("root").join(roots, F.col("node") == F.col("_node"), "left").select("key", "node", F.coalesce("_root", "node").alias("root"), "w")
    apart = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    return rows.join(apart, "key", "left_semi")


def similar_rows(docs: DataFrame, words: int = 5, similarity: float = 0.8, row: Column | None = None) -> DataFrame:
    """doc_id, row_id, component_id and component_row of every document: its group's row of the smallest (doc_id, row_id).

    `row` tells rows of one id apart, a hash of the text if not given.  Two
    texts are linked if their sets of `words`-word shingles have a Jaccard
    similarity of at least `similarity`, each such pair and no other.  Equal
    sets are one node.  Null, empty and wordless texts are equal to each other.
    A null id is never the smallest; an empty table gives no row; other columns
    are ignored, whatever their names; very long texts count whole.  What is
    written on the way is deleted once the result is.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", (F.xxhash64("text") if row is None else row).alias("row_id"))
    with scratch(spark):
        signed = written(shingle_sets(docs, words, similarity, ("doc_id", "row_id")), "shingles")
        one = [c for c in signed.columns if c not in ("doc_id", "row_id", "node")]
        own = F.struct("doc_id", "row_id")
        classes = signed.groupBy("node").agg(F.min(F.when(F.col("doc_id").isNotNull(), own)).alias("least"), F.min(own).alias("row"), *[F.first(c).alias(c) for c in one])
        classes = written(classes.select("node", "least", "row.*", *one), "similar-classes")
        found = components(jaccard_links(classes, docs, ["doc_id", "row_id"], words, similarity))
        rooted = classes.select("node", "least").join(found.toDF("_node", "_root"), F.col("node") == F.col("_node"), "left").select("node", "least", F.coalesce("_root", "node").alias("root"))
        smallest = rooted.groupBy("root").agg(F.min("least").alias("first"))
        named = rooted.join(smallest, "root").select(F.col("node").alias("_node"), "first")
        groups = signed.select("doc_id", "row_id", "node").join(named, F.col("node") == F.col("_node")).select(
            "doc_id", "row_id", F.col("first.doc_id").alias("component_id"), F.col("first.row_id").alias("component_row"))
        out, path = stored(groups, "similar-groups")
    registered(path)
    return out


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id and component_id, the smallest doc_id of each group of `similar_rows`."""
    return similar_rows(docs, words, similarity).select("doc_id", "component_id")
