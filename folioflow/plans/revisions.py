"""The relational forms of what happens inside a cross-reference index and a page tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import fresh_folder


def latest_revision(log: DataFrame, keys: list[str], order: str, deleted: str) -> DataFrame:
    """The newest row of each key, unless it is a deletion. `order` grows with time.

    max_by with partial sums, not a window: a key with very many revisions is reduced before the shuffle.
    """
    rest = [c for c in log.columns if c not in keys]
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row"))
    return newest.select(*keys, "_row.*").filter(~F.col(deleted))


def next_boundary(offsets: DataFrame, key: str, offset: str, end: str | None = None) -> DataFrame:
    """Each distinct offset of a key with the next one (`end`, if given, after the last)."""
    w = Window.partitionBy(key).orderBy(offset)
    after = F.lead(offset).over(w)
    last = [F.max(end).alias("_end")] if end else []
    rows = offsets.groupBy(key, offset).agg(*last) if last else offsets.select(key, offset).distinct()
    return rows.select(key, offset, (F.coalesce(after, F.col("_end")) if end else after).alias("next_offset"))


def page_order(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """tree, id, page_number of the pages of each tree in order. nodes: (tree, id, parent, position, is_page); roots: (tree, id).

    A level of all trees at a time, written to the shared folder, so that neither the number of rows nor a tree's depth
    has a limit but the storage. The path to a page, its positions from the root down, is the sort key.
    """
    spark, found = nodes.sparkSession, []
    below = nodes.select("tree", F.col("id").alias("next"), F.col("parent").alias("id"), "position", "is_page")
    level = roots.select("tree", "id", F.array().cast("array<bigint>").alias("path"), F.lit(False).alias("is_page"))
    while True:
        level = level.filter(~F.col("is_page")).join(below.withColumnRenamed("is_page", "leaf"), ["tree", "id"])
        level = level.select("tree", F.col("next").alias("id"), F.array_append("path", F.col("position").cast("bigint")).alias("path"), F.col("leaf").alias("is_page"))
        path = fresh_folder(spark, "page-level")
        level.write.parquet(path)
        level = spark.read.schema(level.schema).parquet(path)
        if level.isEmpty():
            break
        found.append(level.filter("is_page"))
    rows = found[0] if found else level
    for x in found[1:]:
        rows = rows.unionByName(x)
    number = F.row_number().over(Window.partitionBy("tree").orderBy("path"))
    return rows.select("tree", "id", number.cast("int").alias("page_number"))
