"""Exact top-k search over a bit-sliced index of quantised vectors."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactframe.llm.common import release, searched, vectors_by_length, written

#: Vectors of an index block and bytes of their values, at most; queries that are answered at once, and words of their bitmaps.
BLOCK, BLOCK_BYTES, QUERIES, TOGETHER = 65_536, 32 << 20, 128, 1 << 13


def quantised(vectors: DataFrame, scale: int = 64, column: str = "embedding") -> DataFrame:
    """vec_id and q: floor(scale * x) of each component, in doubles.

    Vectors that are null, empty, or hold a null or non-finite component are
    left out.
    """
    sound = F.size(column) > 0
    sound = sound & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    q = F.transform(column, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    return vectors.where(F.coalesce(sound, F.lit(False))).select("vec_id", q.alias("q"))


def _slices(values: np.ndarray) -> np.ndarray:
    """Bit slices of non-negative whole numbers, rows x dims: dims x bits x words of 64 rows."""
    rows, dims = values.shape
    bits = max(1, int(values.max()).bit_length())
    pad = -(-rows // 64) * 64 - rows
    v = np.ascontiguousarray(np.pad(values, ((0, pad), (0, 0))).T)
    return np.stack([np.packbits((v >> b & 1).astype(np.uint8), axis=1, bitorder="little").view(np.uint64) for b in range(bits)], 1)


def index(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks of the index over `quantised` vectors: block, dims, bits, low, ids, slices, values.

    Each attribute is stored as slices of what it is above the block's lowest
    component `low`; `values` keeps the rows for exact scores.  Blocks hold at
    most `block` vectors of one length and BLOCK_BYTES of them, in the order
    of their ids, and are made where the vectors lie, without a shuffle.
    """
    kind = vectors.schema["vec_id"].dataType
    schema = T.StructType([*(T.StructField(c, T.LongType()) for c in ("block", "dims", "bits", "low")), T.StructField("ids", T.ArrayType(kind)),
                           T.StructField("slices", T.BinaryType()), T.StructField("values", T.BinaryType())])

    def over(batches):
        part, made = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {}

        def flush(dims):
            nonlocal made
            own = held.pop(dims)
            ids = [i for x, _ in own for i in x]
            order = sorted(range(len(ids)), key=ids.__getitem__)
            q = np.concatenate([m for _, m in own])[order]
            low = int(q.min())
            sliced = _slices(q - low)
            made += 1
            row = [(part << 32) + made, dims, sliced.shape[1], low, [ids[k] for k in order], sliced.tobytes(), q.astype("<i8").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [*[pa.int64()] * 4, pa.list_(id_type), pa.binary(), pa.binary()], strict=True)], names=schema.names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for ids, matrix in vectors_by_length(batch):
                dims = matrix.shape[1]
                most = max(1, min(block, BLOCK_BYTES // (8 * dims)))
                while len(ids):
                    room = most - sum(len(x) for x, _ in held.get(dims, ()))
                    held.setdefault(dims, []).append((ids[:room], matrix[:room].copy()))
                    if len(ids) >= room:
                        yield flush(dims)
                    ids, matrix = ids[room:], matrix[room:]
            while sum(m.nbytes for x in held.values() for _, m in x) > 2 * BLOCK_BYTES:  # many lengths
                yield flush(max(held, key=lambda d: sum(m.nbytes for _, m in held[d])))
        for dims in list(held):
            yield flush(dims)
        release()

    return vectors.where("vec_id is not null").select("vec_id", "q").mapInArrow(over, schema)


def _sums(slices: np.ndarray, queries: np.ndarray) -> list[np.ndarray]:
    """Binary digits, lowest first, of each row's sum for each query: bitmaps, queries x words.

    Each binary digit of a query's component adds the attribute's slices,
    shifted, or, for a negative component, their complement: that differs
    from the score by the same amount in all rows.  Slices of one weight are
    added three to two, for all queries at once, and what carries goes to
    the next weight.
    """
    dims, bits, words = slices.shape
    size, negative = np.abs(queries), np.where(queries < 0, ~np.uint64(0), np.uint64(0))
    width = int(size.max()).bit_length()
    chosen = [np.where(size >> shift & 1 > 0, ~np.uint64(0), np.uint64(0)) for shift in range(width)]
    used = [np.flatnonzero(c.any(0)).tolist() for c in chosen]
    digits, carried = [], []
    weight = 0
    while weight < bits + width - 1 or carried:
        own, carried = iter(carried), []
        new = ((slices[d, weight - shift] ^ negative[:, d, None]) & chosen[shift][:, d, None] for shift in range(max(0, weight - bits + 1), min(width, weight + 1)) for d in used[shift])
        operands = chain(own, new)
        held = next(operands, None)
        if held is None:
            held = np.zeros((len(queries), words), np.uint64)
        for a in operands:
            b = next(operands, None)
            if b is None:
                carried.append(held & a)
                held = held ^ a
            else:
                x = a ^ b
                carried.append((a & b) | (x & held))
                held = x ^ held
        digits.append(held)
        weight += 1
    return digits


def _select(digits: list[np.ndarray], k: int, rows: int) -> np.ndarray:
    """Rows with the k greatest sums and all that tie with the last of them."""
    words = len(digits[0])
    alive = np.full(words, ~np.uint64(0))
    if rows % 64:
        alive[-1] = np.uint64((1 << rows % 64) - 1)
    taken = np.zeros(words, np.uint64)
    need = k
    for d in reversed(digits):
        high = alive & d
        count = int(np.bitwise_count(high).sum())
        if count > need:
            alive = high
        else:
            taken |= high
            need -= count
            alive &= ~d
            if not need:
                alive[:] = 0
                break
    return np.flatnonzero(np.unpackbits((taken | alive).view(np.uint8), bitorder="little"))


def block_top(slices: np.ndarray, values: np.ndarray, queries: np.ndarray, own: list[list[int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query (places, scores) of the k best rows of a block, without the places `own`; ties to smaller places."""
    out = []
    digits = _sums(slices, queries)
    for j, query in enumerate(queries):
        found = _select([d[j] for d in digits], k + len(own[j]), len(values))
        if own[j]:
            found = found[~np.isin(found, own[j])]
        scores = values[found] @ query
        order = np.lexsort((found, -scores))[:k]
        out.append((found[order], scores[order]))
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score of the k greatest inner products, exact; all, if there are fewer.

    `vectors` and `queries` are as `quantised` gives them.  Ties go to the
    smaller vec_id; a query is not compared with rows of its own id, nor with
    vectors of another length.  Ids may be of any type that has an order.
    Rows without an id take no part; repeated rows each count; other columns
    are gone; an empty table gives no row.  Queries are broadcast in rounds
    of bounded size to the blocks of the index, which is written once; only
    the best k of a query and block are shuffled.
    """
    kind = vectors.schema["vec_id"].dataType
    schema = T.StructType([T.StructField("query", T.LongType()), T.StructField("query_id", kind), T.StructField("vec_id", kind), T.StructField("score", T.LongType())])

    def over(asked, block):
        row = {c: block.column(c)[0] for c in block.schema.names}
        dims, bits, ids = row["dims"].as_py(), row["bits"].as_py(), row["ids"].as_py()
        if dims not in asked:
            return
        slices = np.frombuffer(row["slices"].as_buffer(), np.uint64).reshape(dims, bits, -1)
        values = np.frombuffer(row["values"].as_buffer(), "<i8").reshape(-1, dims)
        numbers, asking, matrix = asked[dims]
        wanted = set(asking)
        places: dict = {}
        for place, i in enumerate(ids):
            if i in wanted:
                places.setdefault(i, []).append(place)
        id_type = block.schema.field("ids").type.value_type
        step = max(1, min(QUERIES, TOGETHER // slices.shape[2]))
        for at in range(0, len(asking), step):
            best = block_top(slices, values, matrix[at:at + step], [places.get(i, []) for i in asking[at:at + step]], k)
            n = [len(p) for p, _ in best]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(numbers[at:at + step], n)), pa.array([asking[at + j] for j, m in enumerate(n) for _ in range(m)], id_type),
                pa.array([ids[p] for own, _ in best for p in own], id_type), pa.array(np.concatenate([s for _, s in best]))], names=schema.names)

    return searched(queries.where("vec_id is not null"), written(index(vectors), "topk-index"), over, schema, k)


TOPK_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as q from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.vec_id as query_id, b.vec_id, cast(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) as bigint) as score
  from v a join v b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q)
)
select query_id, cast(rank as integer) as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored
) where rank <= 20
"""
