"""Approximate nearest neighbours by cosine: a robust-pruned directed graph a shard, searched with a beam."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactframe.llm.common import release, searched, vectors_by_length, written

#: Vectors and bytes of vectors in a shard, at most.
SHARD_ROWS, SHARD_BYTES = 16_384, 16 << 20
#: Edges of a node; nodes that a search holds while the graph is built, and while it is asked.
DEGREE, BUILD_BEAM, BEAM = 32, 64, 128
#: A neighbour goes if another is ALPHA times nearer to it than the node is.
ALPHA = 1.2
#: Nodes that join the graph, and queries that are answered, at once; nodes that a step of a search opens.
BATCH, OPENED = 256, 4


def sound(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and q, in doubles, of the vectors that take part.

    Rows without an id, and vectors that are null, empty, zero or hold a null
    or non-finite component, are left out.
    """
    q = F.transform(column, lambda x: x.cast("double"))
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = F.col("vec_id").isNotNull() & (F.size(column) > 0) & finite & F.exists(column, lambda x: x != 0)
    return vectors.where(F.coalesce(ok, F.lit(False))).select("vec_id", q.alias("q"))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1, without overflow on the way."""
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt(np.einsum("nd,nd->n", rows, rows))[:, None]


def cosines(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosines of rows and a query, in doubles; a row's doesn't depend on the rows beside it."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        size = np.sqrt((rows * rows).sum(1)) * np.sqrt((query * query).sum())
        out = (rows * query).sum(1) / size
    odd = ~((size > 1e-140) & (size < 1e140))  # squares may have left the range of doubles
    if odd.any():
        out[odd] = (unit(rows[odd]) * unit(query[None])).sum(1)
    return out


def prune(points: np.ndarray, found: np.ndarray, own: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Edges of the nodes `own` among the nodes `found` (rows of candidates, -1 for none), nearest first.

    The nearest candidate stays, and those go which are alpha times nearer to
    it than to the node; so on with the next that is left.  Distances are
    those of unit vectors.
    """
    found = np.where(found == own[:, None], -1, found)
    found = np.sort(found, 1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    v = points[found]
    far = 2 - 2 * np.einsum("ncd,nd->nc", v, points[own])
    far[found < 0] = np.inf
    order = np.argsort(far, 1, kind="stable")
    found, far = np.take_along_axis(found, order, 1), np.take_along_axis(far, order, 1)
    v = points[found]
    apart = (2 - 2 * v @ v.transpose(0, 2, 1)) * alpha**2
    alive, rows = found >= 0, np.arange(len(own))
    out = np.full((len(own), degree), -1, np.int32)
    for k in range(degree):
        pick = alive.argmax(1)
        has = alive[rows, pick]
        if not has.any():
            break
        out[has, k] = found[has, pick[has]]
        alive &= ~((apart[rows, pick] <= far) & has[:, None])
        alive[rows, pick] = False
    return out


def beam_search(points: np.ndarray, edges: np.ndarray, entries: np.ndarray, queries: np.ndarray, width: int) -> np.ndarray:
    """For each query the up to `width` nearest nodes that a greedy search comes by, nearest first; -1 for none.

    All queries go on together: a step opens the nearest unopened nodes of
    each beam and puts their neighbours into it.
    """
    n = len(queries)
    seen = np.zeros((n, len(points) + 1), bool)  # the last column is for no node
    seen[:, -1] = True
    seen[:, entries] = True
    near = 2 - 2 * queries @ points[entries].T
    ids = np.broadcast_to(entries, near.shape)
    if len(entries) < width:
        gap = width - len(entries)
        ids, near = np.pad(ids, ((0, 0), (0, gap)), constant_values=-1), np.pad(near, ((0, 0), (0, gap)), constant_values=np.inf)
    order = np.argsort(near, 1)[:, :width]
    ids, near = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
    opened = ids < 0
    active = np.arange(n)
    while len(active):
        waits = np.where(opened[active], width, np.arange(width))
        pick = np.argpartition(waits, OPENED - 1, 1)[:, :OPENED] if width > OPENED else np.argsort(waits, 1)
        real = np.take_along_axis(waits, pick, 1) < width
        some = real.any(1)
        active, pick, real = active[some], pick[some], real[some]
        if not len(active):
            break
        nodes = np.where(real, ids[active[:, None], pick], -1)
        opened[active[:, None], pick] = True
        new = np.where((nodes >= 0)[:, :, None], edges[nodes], -1).reshape(len(active), -1)
        new = np.sort(new, 1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        new[seen[active[:, None], new]] = -1
        seen[active[:, None], new] = True
        far = 2 - 2 * np.einsum("ncd,nd->nc", points[new], queries[active])
        far[new < 0] = np.inf
        ids_all = np.concatenate([ids[active], new], 1)
        far_all = np.concatenate([near[active], far], 1)
        opened_all = np.concatenate([opened[active], new < 0], 1)
        order = np.argsort(far_all, 1, kind="stable")[:, :width]
        ids[active], near[active], opened[active] = (np.take_along_axis(x, order, 1) for x in (ids_all, far_all, opened_all))
    return ids


def build(points: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(edges, entries) of a graph over distinct unit vectors.

    Nodes join in a seeded order, in batches no larger than what is there: a
    search proposes neighbours, pruning keeps some, and their edges back are
    pruned where a node has too many.
    """
    n = len(points)
    order = np.random.default_rng(seed).permutation(n)
    edges = np.full((n, DEGREE), -1, np.int32)
    entries = order[:min(n, 16)]
    done = min(n, DEGREE)
    first = order[:done]
    edges[first] = prune(points, np.broadcast_to(first, (done, done)), first)
    while done < n:
        own = order[done:done + min(done, BATCH)]
        found = beam_search(points, edges, entries, points[own], BUILD_BEAM)
        edges[own] = prune(points, found, own)
        done += len(own)
        _link_back(points, edges, own)
    return edges, entries


def _link_back(points: np.ndarray, edges: np.ndarray, own: np.ndarray) -> None:
    heads, tails = edges[own].ravel(), np.repeat(own, edges.shape[1])
    heads, tails = heads[heads >= 0], tails[heads >= 0]
    by_head = np.argsort(heads, kind="stable")
    heads, tails = heads[by_head], tails[by_head]
    while len(heads):
        nodes, at, count = np.unique(heads, return_index=True, return_counts=True)
        place = np.arange(len(heads)) - np.repeat(at, count)
        now = place < DEGREE
        extra = np.full((len(nodes), DEGREE), -1, np.int32)
        extra[np.repeat(np.arange(len(nodes)), count)[now], place[now]] = tails[now]
        full = (edges[nodes] >= 0).sum(1) + (extra >= 0).sum(1) > DEGREE
        for chosen in (np.flatnonzero(~full), *np.array_split(np.flatnonzero(full), max(1, -(-int(full.sum()) // BATCH)))):
            both = np.concatenate([edges[nodes[chosen]], extra[chosen]], 1)
            if len(chosen) and full[chosen[0]]:
                edges[nodes[chosen]] = prune(points, both, nodes[chosen])
            elif len(chosen):
                edges[nodes[chosen]] = -np.sort(-both, 1)[:, :DEGREE]
        heads, tails = heads[~now], tails[~now]


def index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Shards of the index over `sound` vectors, one row each: shard, dims, ids, rows, nodes, edges, entries.

    Rows are dealt evenly, so that a shard is a sample of the table and a hot
    id or vector is spread; a shard has vectors of one length, at most
    `shard_rows` of them and SHARD_BYTES.  Equal vectors of a shard are one
    node: `nodes` has each row's, `rows` the distinct vectors, `ids` the ids in
    order.  Nothing is sampled: every vector is in a shard.
    """
    kind = vectors.schema["vec_id"].dataType
    parts = max(1, -(-vectors.count() // shard_rows))
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("dims", T.LongType()), T.StructField("ids", T.ArrayType(kind)),
                           *(T.StructField(c, T.BinaryType()) for c in ("rows", "nodes", "edges", "entries"))])

    def over(batches):
        part, made = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {}

        def flush(dims: int):
            nonlocal made
            own = held.pop(dims)
            ids = [i for x, _ in own for i in x]
            order = sorted(range(len(ids)), key=ids.__getitem__)
            rows, nodes = np.unique(np.concatenate([m for _, m in own])[order], axis=0, return_inverse=True)
            edges, entries = build(unit(rows).astype(np.float32))
            made += 1
            row = [(part << 32) + made, dims, [ids[k] for k in order], rows.tobytes(), nodes.astype("<i4").tobytes(), edges.tobytes(), entries.astype("<i4").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.int64(), pa.int64(), pa.list_(id_type), *[pa.binary()] * 4], strict=True)], names=schema.names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for ids, matrix in vectors_by_length(batch):
                dims = matrix.shape[1]
                most = max(1, min(shard_rows, SHARD_BYTES // (8 * dims)))
                while len(ids):
                    room = most - sum(len(x) for x, _ in held.get(dims, ()))
                    held.setdefault(dims, []).append((ids[:room], matrix[:room].copy()))
                    if len(ids) >= room:
                        yield flush(dims)
                    ids, matrix = ids[room:], matrix[room:]
            while sum(m.nbytes for x in held.values() for _, m in x) > 2 * SHARD_BYTES:  # many lengths
                yield flush(max(held, key=lambda d: sum(m.nbytes for _, m in held[d])))
        for dims in list(held):
            yield flush(dims)
        release()

    return vectors.repartition(parts).mapInArrow(over, schema)


def shard_search(asked: dict, shard: pa.RecordBatch, k: int, beam: int = BEAM):
    """Batches of query, query_id, vec_id, score: of each query the k nearest rows that the beam finds, ties to smaller ids."""
    row = {c: shard.column(c)[0] for c in shard.schema.names}
    dims = row["dims"].as_py()
    if dims not in asked:
        return
    numbers, asking, matrix = asked[dims]
    ids = row["ids"].as_py()
    held = {c: np.frombuffer(row[c].as_buffer(), t) for c, t in (("rows", np.float64), ("nodes", "<i4"), ("edges", np.int32), ("entries", "<i4"))}
    rows, edges = held["rows"].reshape(-1, dims), held["edges"].reshape(-1, DEGREE)
    points = unit(rows).astype(np.float32)
    members = np.argsort(held["nodes"], kind="stable")  # by node, then by id
    begins = np.searchsorted(held["nodes"][members], np.arange(len(rows) + 1))
    places: dict = {}
    for place, i in enumerate(ids):
        places.setdefault(i, []).append(place)
    out: list[list] = [[], [], [], []]
    for at in range(0, len(asking), BATCH):
        block = matrix[at:at + BATCH]
        found = beam_search(points, edges, held["entries"], unit(block).astype(np.float32), max(beam, k))
        for j, nodes in enumerate(found):
            nodes = nodes[nodes >= 0]
            own = places.get(asking[at + j], [])
            scores = cosines(rows[nodes], block[j])
            # Of a node no more than its k first rows besides the query's own can count.
            places_of = [members[b:min(e, b + k + len(own))] for b, e in zip(begins[nodes], begins[nodes + 1], strict=True)]
            score = np.repeat(scores, [len(p) for p in places_of])
            place = np.concatenate(places_of)
            if own:
                other = ~np.isin(place, own)
                score, place = score[other], place[other]
            best = np.lexsort((place, -score))[:k]
            out[0] += [numbers[at + j]] * len(best)
            out[1] += [asking[at + j]] * len(best)
            out[2] += [ids[p] for p in place[best]]
            out[3].append(score[best])
    id_type = shard.schema.field("ids").type.value_type
    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], id_type), pa.array(out[2], id_type), pa.array(np.concatenate(out[3]))], names=["query", "query_id", "vec_id", "score"])


def nearest(shards: DataFrame, queries: DataFrame, k: int = 5, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score (cosine, in doubles) of the k nearest rows found for each of `queries`.

    `shards` is a stored `index`, `queries` as `sound` gives them.  Every query
    is put to every shard by a beam search; of what the beams find, the exact
    cosines of the vectors as given decide, ties to the smaller vec_id.  A
    query is not compared with rows of its own id, nor with vectors of another
    length.  Rows with equal vectors each count, as do repeated queries; a
    vector whose graph no beam reaches is missed (tests hold recall at 0.9 or
    more against all cosines).  An empty table gives no row.
    """
    kind = queries.schema["vec_id"].dataType
    schema = T.StructType([T.StructField("query", T.LongType()), T.StructField("query_id", kind), T.StructField("vec_id", kind), T.StructField("score", T.DoubleType())])
    return searched(queries, shards, lambda asked, shard: shard_search(asked, shard, k, beam), schema, k)


def stored_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The index written once to the shared folder, which searches then read."""
    return written(index(written(vectors, "graph-vectors"), shard_rows), "graph-index")
