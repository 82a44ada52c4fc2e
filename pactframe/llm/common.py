"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

_LOCAL_SHARED: dict[str, str] = {}
#: Open scratch scopes, innermost last; each lists the tables that `written` made in it.
_SCRATCH: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: what `spark.checkpoint.dir` names.

    Where that is unset, a temporary folder takes its place on one machine
    (a local master, as in tests); on a cluster this is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "dir" not in _LOCAL_SHARED:
        _LOCAL_SHARED["dir"] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL_SHARED["dir"]


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """`df` written once as Parquet in the shared folder and read again, and the table's path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` by way of a table of the shared folder.

    Cuts the lineage and survives lost executors.  Within `scratch` the table
    is deleted at the end of the scope; elsewhere it stays for the reader of
    the result, and whoever runs the cluster clears the folder.
    """
    out, path = stored(df, name)
    registered(path)
    return out


def registered(path: str) -> None:
    """Makes a table part of the open scratch scope, if there is one."""
    if _SCRATCH:
        _SCRATCH[-1].append(path)


def delete_table(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession):
    """A scope whose written tables are deleted at its end: what it returns must not read them any more."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            delete_table(spark, path)


def checkpointed(df: DataFrame) -> DataFrame:
    """An eager reliable checkpoint in the shared folder; for loop states."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def set_aside(df: DataFrame, known: tuple[str, ...]):
    """(`df` with its other columns under names that clash with nothing, a function that restores the names)."""
    names = df.columns
    inner = [n if n in known else f"_aside_{k}" for k, n in enumerate(names)]
    return df.toDF(*inner), lambda out: out.select(*inner).toDF(*names)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; null ids are in no fold (null)."""
    return F.crc32(doc_id.cast("string")) % F.lit(folds)


def release() -> None:
    """Gives a Python worker's free memory back to the system: workers live on, and what one task freed would stay with them."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: Rows and bytes that a function on batches gets at once.
SLICE_ROWS, SLICE_BYTES = 1000, 8 << 20


def slices(batch):
    """Consecutive parts of a pyarrow RecordBatch of at most SLICE_ROWS rows and, for rows of even size, SLICE_BYTES."""
    step = max(1, min(SLICE_ROWS, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes)))
    for at in range(0, max(1, batch.num_rows), step):
        yield batch.slice(at, step)


_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lets Spark hand SLICE_ROWS rows at once to Python workers, unless the session says how many.

    Its own 10,000 rows of long texts are buffers of over 100 MB a task outside
    the heap, which executors don't give back.
    """
    if spark.conf.get(_BATCH_ROWS, None) is None:
        spark.conf.set(_BATCH_ROWS, str(SLICE_ROWS))


def as_map(df: DataFrame, fn, schema: T.StructType | str) -> DataFrame:
    """`mapInArrow` with a function from a pyarrow RecordBatch to one or more; Python objects of a few rows live at once."""

    def over(batches):
        for batch in batches:
            for part in slices(batch):
                yield from fn(part)
        release()

    small_batches(df.sparkSession)
    return df.mapInArrow(over, schema)


def ordered_prefix(df: DataFrame, keys: list[str], order: list[Column], bucket: Column,
                   value: Column, name: str) -> DataFrame:
    """Adds `name`: the sum of `value` over the rows that precede a row of its `keys`.

    Rows are ordered by `bucket`, then by `order`.  Sums of whole buckets come
    from a small aggregate, so no task gets all rows of a hot key: each window
    covers one (key, bucket).
    """
    df = df.withColumn("_bucket", bucket).withColumn("_value", value)
    joined = [F.col(k) for k in keys]
    sums = df.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*joined).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bucket").alias("_b"),
                       F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = (Window.partitionBy(*joined, F.col("_bucket")).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    on = F.col("_bucket") == F.col("_b")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return (df.join(sums, on, "left")
            .withColumn(name, F.coalesce(F.sum("_value").over(inside), F.lit(0)) + F.col("_base"))
            .drop("_bucket", "_value", "_b", "_base", *[f"_k_{k}" for k in keys]))


def bounded_sample(df: DataFrame, key: Column, most: int) -> DataFrame:
    """At most `most` rows, picked by a hash of `key`; the same rows on every run."""
    return df.orderBy(F.xxhash64(key, F.lit("sample")), key).limit(most)


#: Bytes of query vectors that are broadcast at once.
ROUND_BYTES = 32 << 20


def searched(queries: DataFrame, blocks: DataFrame, search, schema: T.StructType, k: int, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best (ties to smaller vec_id) that `search` finds in all `blocks` for each row (vec_id, q) of `queries`.

    Blocks stay where they are and are not shuffled: queries go to them in
    rounds, each a broadcast of at most `round_bytes` of vectors, however
    many queries there are.  `search(asked, batch)` gets a round's queries
    by length, as (numbers, ids, matrix), and yields batches of query, query_id,
    vec_id, score, with at most k rows a query and block; these alone are
    shuffled.  `query` numbers the rows of `queries`, of which several may
    have one id.
    """
    spark = queries.sparkSession
    queries = written(queries.select("vec_id", "q", F.size("q").cast("long").alias("_dims")), "asked")
    rounds = -(-8 * (queries.agg(F.sum("_dims")).first()[0] or 0) // round_bytes)
    if rounds > 1:
        queries = written(queries.repartition(rounds).withColumn("_round", F.spark_partition_id()), "asked-rounds")
    found = []
    for k_round in range(rounds):
        own = queries if rounds == 1 else queries.where(F.col("_round") == k_round)
        rows = own.select("vec_id", "q").toArrow()  # at most round_bytes, and what rounding leaves
        asked = spark.sparkContext.broadcast(_by_length(rows, k_round))

        def over(batches, asked=asked):
            for batch in batches:
                for j in range(batch.num_rows):
                    yield from search(asked.value, batch.slice(j, 1))
            release()

        part = blocks.mapInArrow(over, schema)
        if rounds > 1:
            part = written(part, "found")
            asked.unpersist()
        found.append(part)
    if not found:
        return blocks.mapInArrow(lambda batches: iter(()), schema).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    partial = found[0]
    for part in found[1:]:
        partial = partial.union(part)
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _by_length(rows, k_round: int) -> dict:
    """{length: (numbers, ids, matrix)} of an Arrow table of ids and vectors."""
    import numpy as np

    out: dict[int, list] = {}
    at = k_round << 40
    for batch in rows.to_batches():
        for ids, matrix in vectors_by_length(batch):
            out.setdefault(matrix.shape[1], []).append((at + np.arange(len(ids)), ids, matrix))
            at += len(ids)
    return {d: (np.concatenate([n for n, _, _ in x]), [i for _, ids, _ in x for i in ids], np.concatenate([m for _, _, m in x])) for d, x in out.items()}


def vectors_by_length(batch):
    """(ids, matrix) for each length of the vectors (second column; none null) in a pyarrow RecordBatch."""
    import numpy as np
    import pyarrow as pa

    lists = batch.column(1)
    offsets = lists.offsets.to_numpy()
    sizes, flat = np.diff(offsets), lists.values.to_numpy(zero_copy_only=False)
    for dims in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == dims)
        yield batch.column(0).take(pa.array(own)).to_pylist(), flat[offsets[own][:, None] + np.arange(dims)]
