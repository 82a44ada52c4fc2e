"""SimHash fingerprints and their near-duplicate classes by a self-join of binary tries."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactframe.llm.common import as_map, checkpointed, release, written

BITS = 64
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_UPPER = bytes(range(65, 91))
_LOWERED = bytes.maketrans(_UPPER, _UPPER.lower())


def shingle_hashes(text: str, words: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle of `words` words (fewer words: the whole sequence; none: nothing)."""
    found = _WORD.findall(text.encode("utf-8", "surrogatepass").translate(_LOWERED))
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(found) - words + 1)
    hashed = xxhash.xxh64_intdigest
    return np.array([hashed(joined[a:b], seed) for a, b in zip(begins[:n].tolist(), ends[-n:].tolist(), strict=True)], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; 0 for none."""
    if not len(hashes):
        return 0
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """`keep` and fp (the fingerprint as a signed long) of every whole text; null, empty and wordless texts have 0."""
    schema = T.StructType(docs.select(*keep).schema.fields + [T.StructField("fp", T.LongType())])

    def over(batch):
        fps = np.array([simhash(shingle_hashes(t or "", words, seed)) for t in batch.column(len(keep)).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(fps.view(np.int64))], names=schema.names)

    return as_map(docs.select(*keep, text), over, schema)


def _split(values: np.ndarray, begin: np.ndarray, end: np.ndarray, bit: int) -> np.ndarray:
    """Where the values of each range, sorted and equal in all higher bits, have the bit set first."""
    mask = np.uint64(1 << bit)
    low, high = begin.copy(), end.copy()
    while (open_ := low < high).any():
        middle = (low + high) // 2
        one = values[np.minimum(middle, len(values) - 1)] & mask > 0
        high = np.where(open_ & one, middle, high)
        low = np.where(open_ & ~one, middle + 1, low)
    return low


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least position in each position's component, for links i - j."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def trie_components(values: np.ndarray, nodes: tuple[np.ndarray, ...], bit: int, budget: int) -> np.ndarray:
    """Labels that connect values which differ in at most `budget` bits.

    `nodes` are pairs of trie nodes, as ranges (begin a, end a, begin b, end b)
    of `values`, sorted within a range; `bit` is the highest in which the
    values of a node can differ.  Walks the pairs together, a level at a time:
    a node's children are its range split at the next bit.  A pair carries the
    number of bits in which it differs so far and is dropped when that exceeds
    the budget; small pairs are compared leaf by leaf.
    """
    a0, a1, b0, b1 = nodes
    apart = (values[a0] ^ values[b0]) >> np.uint64(bit + 1) if bit < BITS - 1 else np.zeros(len(a0), np.uint64)
    spent = np.bitwise_count(apart).astype(np.int64)
    i_held, j_held, held = [], [], 0

    def fold() -> None:
        nonlocal i_held, j_held, held
        label = forest(len(values), np.concatenate(i_held), np.concatenate(j_held))
        linked = np.flatnonzero(label != np.arange(len(values)))
        i_held, j_held, held = [linked], [label[linked]], 0

    while len(a0):
        small = ((a1 - a0) * (b1 - b0) <= LEAVES) | (bit < 0)
        chosen = np.flatnonzero(small)
        for at in range(0, len(chosen), LEAF_PAIRS // LEAVES):
            own = chosen[at:at + LEAF_PAIRS // LEAVES]
            n, m = (a1 - a0)[own], (b1 - b0)[own]
            inside = np.arange((n * m).sum()) - np.repeat(np.cumsum(n * m) - n * m, n * m)
            wide = np.repeat(m, n * m)
            i, j = np.repeat(a0[own], n * m) + inside // wide, np.repeat(b0[own], n * m) + inside % wide
            near = (i < j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
            i_held.append(i[near])
            j_held.append(j[near])
            held += int(near.sum())
            if held > LEAF_PAIRS:
                fold()
        a0, a1, b0, b1, spent = a0[~small], a1[~small], b0[~small], b1[~small], spent[~small]
        if not len(a0):
            break
        am, bm = _split(values, a0, a1, bit), _split(values, b0, b1, bit)
        children = [(a0, am, b0, bm, spent), (am, a1, bm, b1, spent), (a0, am, bm, b1, spent + 1), (am, a1, b0, bm, spent + 1)]
        a0, a1, b0, b1, spent = (np.concatenate(x) for x in zip(*children, strict=True))
        alive = (a1 > a0) & (b1 > b0) & (spent <= budget) & (a0 <= b0)
        a0, a1, b0, b1, spent = a0[alive], a1[alive], b0[alive], b1[alive], spent[alive]
        bit -= 1
    return forest(len(values), np.concatenate(i_held), np.concatenate(j_held)) if i_held else np.arange(len(values))


#: Pairs of leaves below which two nodes are compared directly, and those that are held at once.
LEAVES, LEAF_PAIRS = 128, 1 << 18
#: Values that a task holds, beside the two nodes it is at.
HELD = 1 << 13
#: Bits by which a large node is split in a round.
LEVELS = 3


def trie_links(fps: DataFrame, budget: int = 3, node: int = 2048) -> DataFrame:
    """Links (a, b) between distinct values of `fps.fp` that differ in at most `budget` bits.

    They suffice for connectivity but aren't all pairs: each task gives a
    spanning forest of what it compares.  Two values within the budget agree
    in one of budget + 1 equal parts of their bits.  For each part, the values
    rotated to begin with it form tries, and the walk starts at the nodes
    below that part, each with itself.  Pairs with a node of over `node`
    values are first walked by joins, which replace them by the pairs of their
    nodes three levels down that are within the budget, until both are small.
    So no task holds more than two such nodes, however many values agree.
    """
    step = BITS // (budget + 1)
    turned = (fps.select("fp").where("fp is not null").distinct()
              .withColumn("turn", F.explode(F.array(*[F.lit(r) for r in range(budget + 1)])))
              .withColumn("v", F.expr(f"shiftleft(fp, turn * {step}) | shiftrightunsigned(fp, {BITS} - turn * {step})")))
    turned = turned.withColumn("p", _prefix(F.col("v"), step))
    hot = written(turned.groupBy("turn", "p").count().where(F.col("count") > node).select("turn", "p"), "trie-hot")
    if hot.isEmpty():
        return _walked(turned.withColumns({"q": F.col("p"), "side": F.lit(0)}), BITS - step - 1, budget, step).distinct()
    turned = written(turned, "trie-turned")
    cool = turned.join(hot, ["turn", "p"], "left_anti")
    links = _walked(cool.withColumns({"q": F.col("p"), "side": F.lit(0)}), BITS - step - 1, budget, step)
    pairs = hot.select("turn", "p", F.col("p").alias("q"), F.lit(0).alias("spent"))
    depth = step
    while not pairs.isEmpty():
        deeper = min(LEVELS, BITS - depth)
        parts = pairs.select("turn", F.explode(F.array("p", "q")).alias("p")).distinct()
        below = turned.withColumn("p", _prefix(F.col("v"), depth)).join(parts, ["turn", "p"], "left_semi")
        below = below.withColumn("p", _prefix(F.col("v"), depth + deeper))
        counts = written(below.groupBy("turn", "p").count(), "trie-counts")
        for side in "pq":
            kids = [F.shiftleft(side, deeper).bitwiseOR(F.lit(k)) for k in range(2**deeper)]
            pairs = pairs.withColumn(side, F.explode(F.array(*kids)))
            pairs = pairs.where("p <= q") if side == "q" else pairs
        apart = F.bit_count(F.col("p").bitwiseXOR(F.col("q")).bitwiseAND(F.lit(2**deeper - 1)))
        pairs = pairs.withColumn("spent", F.col("spent") + apart).where(F.col("spent") <= budget)
        for side in "pq":
            pairs = pairs.join(counts.select("turn", F.col("p").alias(side), F.col("count").alias(f"n{side}")), ["turn", side])
        pairs = written(pairs.where("p <> q or np > 1"), "trie-pairs")
        depth += deeper
        fits = (F.greatest("np", "nq") <= node) | F.lit(depth == BITS)
        tasks = pairs.where(fits).select("turn", "p", "q")
        sides = F.when(F.col("p") == F.col("q"), F.array(F.struct(F.lit(0).alias("side"), F.col("p").alias("own")))).otherwise(
            F.array(F.struct(F.lit(0).alias("side"), F.col("p").alias("own")), F.struct(F.lit(1).alias("side"), F.col("q").alias("own"))))
        tasks = tasks.select("turn", "p", "q", F.inline(sides))
        rows = below.withColumnRenamed("p", "own").join(tasks, ["turn", "own"]).select("fp", "turn", "v", "p", "q", "side")
        links = links.union(_walked(rows, BITS - depth - 1, budget, step))
        pairs = pairs.where(~fits).select("turn", "p", "q", "spent")
    return links.distinct()


def _prefix(value: Column, depth: int) -> Column:
    return F.shiftrightunsigned(value, BITS - depth) if depth < BITS else value


def _walked(rows: DataFrame, bit: int, budget: int, step: int) -> DataFrame:
    """Links within the pairs of nodes (turn, p, q), whose values have side 0 or, in another node q, 1."""

    def over(batches):
        held: list[np.ndarray] = []

        def walk(block: np.ndarray):
            """`block`: columns fp, turn, p, q, side, of whole groups."""
            fp = block[:, 0].astype(np.uint64)
            turn = (block[:, 1] * step).astype(np.uint64)
            v = (fp << turn) | np.where(turn > 0, fp >> (np.uint64(BITS) - turn) % np.uint64(BITS), np.uint64(0))
            order = np.lexsort((v, block[:, 4], block[:, 3], block[:, 2], block[:, 1]))
            block, fp, v = block[order], block[order, 0], v[order]
            edge = np.flatnonzero(np.concatenate([[True], (np.diff(block[:, 1:5], axis=0) != 0).any(1)]))
            ends = np.append(edge[1:], len(v))
            side = block[edge, 4]
            alone = block[edge, 2] == block[edge, 3]
            left = np.flatnonzero((side == 0) & alone)
            first = np.flatnonzero((side == 0) & ~alone)
            first = first[first + 1 < len(edge)]
            first = first[side[first + 1] == 1]
            a, b = np.concatenate([left, first]), np.concatenate([left, first + 1])
            many = (ends[a] - edge[a]) * (ends[b] - edge[b]) > np.where(a == b, 1, 0)
            a, b = a[many], b[many]
            if not len(a):
                return
            label = trie_components(v, (edge[a], ends[a], edge[b], ends[b]), bit, budget)
            linked = np.flatnonzero(label != np.arange(len(v)))
            pair = np.stack([fp[linked], fp[label[linked]]])
            pair = np.unique(np.sort(pair, axis=0), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pair[1]), pa.array(pair[0])], names=["a", "b"])

        for batch in batches:
            rows_ = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)], 1)
            held.append(rows_)
            if sum(map(len, held)) >= HELD:
                block = np.concatenate(held)
                change = np.flatnonzero((np.diff(block[:, 1:4], axis=0) != 0).any(1))
                if len(change):
                    cut = change[-1] + 1
                    held = [block[cut:]]
                    yield from walk(block[:cut])
                else:
                    held = [block]
        if held and sum(map(len, held)):
            yield from walk(np.concatenate(held))
        release()

    ordered = (rows.select("fp", F.col("turn").cast("long"), "p", "q", F.col("side").cast("long"))
               .repartition("turn", "p", "q").sortWithinPartitions("turn", "p", "q"))
    return ordered.mapInArrow(over, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node and root, the least node that is reachable, for every node of `links` (a > b) but the roots.

    Large stars and small stars in turn; each round's links go to the shared
    folder.  A node's least neighbour is a partial aggregate, so no task needs
    all links of a node together.
    """
    def state(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(row)

    edges = checkpointed(links.select("a", "b"))
    seen = state(edges)
    while seen[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        large = checkpointed(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = checkpointed(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        now = state(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 3, budget: int = 3, seed: int = 42, node: int = 2048) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links, itself included) of every document.

    Fingerprints of equal value are one node, so copies are never expanded
    into pairs.  Rows with equal ids are separate documents; a null id is
    never the smallest, and a component of null ids has a null component_id.
    Null and wordless texts have fingerprint 0, texts of any length count
    whole, and other columns are not read.  An empty table gives no row.
    """
    fps = written(fingerprints(docs, words, seed), "simhash")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(trie_links(fps, budget, node))
    rooted = classes.join(found, classes.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select(F.col("fp").alias("_fp"), "component_id")
    return fps.join(named, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")
