"""Shared pieces: scratch tables, hot-key joins, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import fresh_folder, shared_folder

def fresh_path(spark: SparkSession, name: str) -> str:
    return fresh_folder(spark, f"llm/{name}")


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back: the lineage ends there."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Remove every scratch table. Results not yet written must not be used afterwards."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_folder(spark) + "/llm")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5 = 0; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def null_key(c: Column) -> Column:
    """A string that is equal for equal values and for nulls, and never null."""
    return F.when(c.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), c.cast("string")))


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """Join `left` with `right` (one row a key; column `n` counts the key's rows in `left`).

    Keys with more than total/1000 rows of `left` are fewer than 1000 whatever the data, so their
    rows of `right` are broadcast and their rows of `left` stay where they are. The other keys
    are joined by a shuffle in which no key holds more than a thousandth of the rows.
    Both inputs are read twice: pass staged or cheap ones.
    """
    most = max(total // 1000, 100)
    hot = right.filter(F.col(n) > most)
    cold = right.filter(F.col(n) <= most)
    far = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how)
    return left.join(F.broadcast(hot), keys, "inner").unionByName(far)


def give_back() -> None:
    """What a task's Python has freed goes back to the system: a worker outlives its task, and an executor keeps several."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: About the most bytes of rows that `map_columns` hands on at once.
PART_BYTES = 2 << 20


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about PART_BYTES, a row at least: what is made of a slice, here and in the JVM, stays as small."""
    n = max(1, batch.num_rows * PART_BYTES // max(batch.nbytes, 1))
    for k in range(0, batch.num_rows, n):
        yield batch.slice(k, n)


def map_columns(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, done: Callable[[], None] | None = None) -> DataFrame:
    """Parts of Arrow batches through `fn`, one in memory at a time. `done` drops what a task leaves in its worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for b in batches:
                yield from map(fn, parts(b))
        finally:
            if done is not None:
                done()
            give_back()

    return df.mapInArrow(run, schema)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (x, root) that connect what the edges (a, b) do, one for each vertex but the smallest of its component."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        i, j = root[i], root[j]
        open_ = i != j
        if not open_.any():
            break
        i, j = i[open_], j[open_]
        np.minimum.at(root, np.maximum(i, j), np.minimum(i, j))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    far = root != np.arange(len(ids))
    return ids[far], ids[root[far]]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning stars of a partition's edges."""
    a = b = np.zeros(0, np.int64)
    wait, size = [], 0

    def reduced() -> tuple[np.ndarray, np.ndarray]:
        return stars(np.concatenate([a, *[x for x, _ in wait]]), np.concatenate([b, *[y for _, y in wait]]))

    for batch in batches:
        wait.append((np.asarray(batch.column(0)), np.asarray(batch.column(1))))
        size += batch.num_rows
        if size > len(a) + 500_000:
            a, b = reduced()
            wait, size = [], 0
    a, b = reduced()
    for i in range(0, len(a), 50_000):
        yield pa.record_batch({"a": pa.array(a[i : i + 50_000]), "b": pa.array(b[i : i + 50_000])})


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): every vertex of `edges` (a, b: bigint) with the smallest vertex it reaches.

    Each partition first reduces its edges to spanning stars. Then labels travel along the edges
    both ways and are shortened by pointer jumping until none changes, so the rounds grow with the
    logarithm of the longest path. Rounds are staged in the shared folder. A hub's edges are only
    pre-aggregated or joined with one label row, which Spark splits when skewed.
    No edges: no rows. Loops and repeated edges do not matter; nulls are not allowed.
    """
    stars = staged(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(_forest, "a long, b long"), "stars")
    both = staged(stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both")
    label = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l"))
    label = staged(label.select(F.col("a").alias("id"), "l"), "label")
    while True:
        near = both.join(label.select(F.col("id").alias("b"), F.col("l").alias("m")), "b").groupBy("a").agg(F.min("m").alias("m"))
        new = label.join(near.withColumnRenamed("a", "id"), "id").select("id", "l", F.least("l", "m").alias("m"))
        new = staged(new, "hook")
        jump = new.select(F.col("id").alias("m"), F.col("m").alias("to"))
        new = new.join(jump, "m").select("id", F.col("l").alias("old"), F.col("to").alias("l"))
        new = staged(new, "label")
        if new.filter("l <> old").isEmpty():
            return new.select("id", F.col("l").alias("component"))
        label = new.select("id", "l")


def content_key(df: DataFrame, columns: tuple[str, ...] = ("doc_id", "text", "lang", "source")) -> Column:
    """A 64-bit hash of a row's content in which a null differs from an empty value."""
    return F.xxhash64(*[x for c in columns for x in (df[c].isNull(), df[c])])


BROADCAST_ROWS = 500_000


def drop_rows(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """`docs` without the rows that have a (doc_id, key) in `bad`; key is content_key(docs).

    `bad` is broadcast (16 bytes a row) when it has at most BROADCAST_ROWS rows, else joined by a shuffle.
    """
    bad = bad.select(F.coalesce("doc_id", F.lit(0)).alias("_bad_id"), F.col("key").alias("_bad_key")).distinct()
    if bad.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        bad = F.broadcast(bad)
    same = (F.coalesce(docs["doc_id"], F.lit(0)) == bad["_bad_id"]) & (content_key(docs) == bad["_bad_key"])
    return docs.join(bad, same, "left_anti")
