"""Line dedup: a suffix array over line-ID sequences, built by distributed prefix doubling.

The sequence of a document is its lines that hold a word. The rank of a suffix after round k is its
place in the order of all suffixes by their first 2^k lines; round k + 1 sorts the pairs of the
ranks at a position and 2^k lines further. A suffix whose rank is its own alone has its place and
repeats nothing longer, so it drops out; rounds go on until none is left.

An interval of the suffix array whose suffixes have their first L lines in common is known by its
ranks: for 2^k <= L < 2^(k+1) by those of round k at its start and L - 2^k lines further. First
every suffix is put into the interval at the L with which it comes to `least` words. From there the
rounds are walked downwards: an interval of L lines falls into those of L + 2^k. What has company in
a narrower interval goes on there; the first of that one, in order of documents and lines, also stays
in the wider one, where it may be a copy of something earlier. So every suffix ends in its deepest interval
of which it is not the first: that interval's depth is the length of the longest run that
begins there and came before. The run that came first stays, these are deleted.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import content_key, join_hot, staged

MIN_WORDS = 50
#: Largest table of spans that is broadcast.
BROADCAST_MB = 48
NO_ID = -(2**63)


def stretches(words: list[int], least: int) -> list[int]:
    """For each line the number of lines with which the run from it comes to `least` words; 0 if none does."""
    found, end, total = [], 0, 0
    for i, n in enumerate(words):
        while end < len(words) and total < least:
            total += words[end]
            end += 1
        found.append(end - i if total >= least else 0)
        total -= n
    return found


def _worded(text: str) -> list[bytes]:
    return [x for x in text.encode().split(b"\n") if x and not x.isspace()]


def _explode(least: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, k, line, ids, spans = [], [], [], [], []
            for doc, key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                lines = _worded(text.as_py() or "")
                d += [doc] * len(lines)
                k += [key] * len(lines)
                line += range(len(lines))
                ids += [md5(x, usedforsecurity=False).digest() for x in lines]
                spans += stretches([len(x.split()) for x in lines], least)
                if len(d) > 100_000:
                    yield _batch(d, k, line, ids, spans)
                    d, k, line, ids, spans = [], [], [], [], []
            if d:
                yield _batch(d, k, line, ids, spans)

    return run


def _batch(d: list, k: list, line: list, ids: list, spans: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(d, pa.int64()), pa.array(k, pa.int64()), pa.array(line, pa.int32()), pa.array(ids, pa.binary()), pa.array(spans, pa.int32())], ["d", "k", "line", "id", "reach"])


def _ranked(keys: DataFrame, by: list[str]) -> DataFrame:
    """`by`, n, rank: the keys that occur twice or more, numbered in their order."""
    found = keys.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1")
    return staged(found.orderBy(*by).withColumn("rank", F.monotonically_increasing_id()), "line-ranks")


PLACE = ["d", "k", "line"]


def suffix_ranks(level: DataFrame) -> list[DataFrame]:
    """d, k, line, rank of the suffixes that share their first 2^i lines with another, for each round i that has any; level: those of round 0."""
    found, step = [], 1
    while not level.isEmpty():
        found.append(level)
        ahead = level.select("d", "k", F.col("line").alias("to"), F.col("rank").alias("r2"))
        pairs = level.withColumnRenamed("rank", "r1").withColumn("to", F.col("line") + step).join(ahead, ["d", "k", "to"])
        pairs = staged(pairs.select(*PLACE, "r1", "r2"), "line-pairs")
        # A pair of many rows is a skewed key of a join, which Spark splits.
        level = staged(pairs.join(_ranked(pairs, ["r1", "r2"]), ["r1", "r2"]).select(*PLACE, "rank"), "line-level")
        step *= 2
    return found


def _intervals(rows: DataFrame, by: list[str]) -> DataFrame:
    """`by`, top: the first row of those that share their `by` with another."""
    return rows.groupBy(*by).agg(F.count("*").alias("m"), F.min(F.struct(*PLACE)).alias("top")).filter("m > 1").drop("m")


def _narrowed(rows: DataFrame, level: DataFrame, step: int) -> DataFrame:
    """`rows` (d, k, line, n, g, first: the interval g of n lines and its first suffix) after the intervals of n + step lines have been told apart."""
    ahead = level.select("d", "k", F.col("line").alias("to"), F.col("rank").alias("r"))
    rows = rows.withColumn("to", F.col("line") + F.col("n")).join(ahead, ["d", "k", "to"], "left").drop("to")
    rows = staged(rows, "line-ahead")
    rows = rows.join(_intervals(rows.filter("r is not null"), ["g", "r"]), ["g", "r"], "left")
    stays = F.struct("n", "g", "first")
    moves = F.struct((F.col("n") + step).alias("n"), F.xxhash64("g", "r").alias("g"), F.col("top").alias("first"))
    where = F.when(F.col("top").isNull(), F.array(stays)).when(F.struct(*PLACE) == F.col("top"), F.array(stays, moves)).otherwise(F.array(moves))
    return staged(rows.select(*PLACE, F.explode(where).alias("at")).select(*PLACE, "at.*"), "line-rows")


def later_copies(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """d, k (a document's id and content key), line, n: the longest run of lines from each that came before, if it has `least` words."""
    src = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), content_key(docs).alias("k"), "text")
    lines = staged(src.mapInArrow(_explode(least), "d long, k long, line int, id binary, reach int"), "lines")
    base = join_hot(lines, _ranked(lines, ["id"]), ["id"], "n", lines.count())
    base = staged(base.select(*PLACE, "rank", "reach").dropDuplicates(PLACE), "line-level")
    levels = suffix_ranks(base.select(*PLACE, "rank"))
    wanted = base.filter("reach > 0").select(*PLACE, F.col("reach").alias("n"))
    starts = []
    for i, level in enumerate(levels):
        tests = wanted.filter((F.col("n") >= 2**i) & (F.col("n") < 2 ** (i + 1))).join(level.withColumnRenamed("rank", "r1"), PLACE)
        ahead = level.select("d", "k", F.col("line").alias("to"), F.col("rank").alias("r2"))
        starts.append(tests.withColumn("to", F.col("line") + F.col("n") - 2**i).join(ahead, ["d", "k", "to"]).select(*PLACE, "n", "r1", "r2"))
    if not starts:
        return wanted.filter("false")
    tests = starts[0]
    for x in starts[1:]:
        tests = tests.unionByName(x)
    here = F.struct(*PLACE)
    tests = staged(tests, "line-tests")
    by = ["n", "r1", "r2"]
    rows = tests.join(_intervals(tests, by), by).select(*PLACE, "n", F.xxhash64(*by).alias("g"), F.col("top").alias("first"))
    rows = staged(rows, "line-rows")
    # A copy that overlaps the stretch it copies is none.
    apart = (F.col("first.d") != F.col("d")) | (F.col("first.k") != F.col("k")) | (F.col("line") - F.col("first.line") >= F.col("n"))
    copies = rows.filter((here > F.col("first")) & apart).select(*PLACE)
    for i in range(len(levels) - 1, -1, -1):
        rows = _narrowed(rows, levels[i], 2**i)
    longest = rows.filter(here > F.col("first")).groupBy(*PLACE).agg(F.max("n").alias("n"))
    return copies.join(longest, PLACE)


def without(text: str, spans: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without the worded lines in `spans` (line, n), and their number. A wordless line goes with the worded line before it."""
    gone = {i for line, n in spans for i in range(line, line + n)}
    kept, at, drop = [], -1, False
    for x in text.split("\n"):
        if x.encode().strip():
            at += 1
            drop = at in gone
        if not drop:
            kept.append(x)
    return "\n".join(kept), len(gone)


def dedup_lines(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """The rows and columns of `docs` with repeated lines taken out of text, and n_lines_removed, n_lines_left (lines with a word).

    Of runs of whole lines with `least` words or more that occur twice or more, in one document or
    several, the copy first in order of doc_id stays. In one document a copy begins after the first
    `least` words of what it repeats, so of lines that are all alike as many stay as hold `least` words.
    Null and empty texts stay as they are. Rows that repeat another with its doc_id, text, lang and
    source are one document and end up alike. A text that is all copies becomes empty. An existing
    column of either added name is replaced. The spans to delete are broadcast up to BROADCAST_MB, else
    joined by a shuffle.
    """
    # A run that ends where the run from the line before does is part of it.
    before = F.lag(F.struct("line", "n")).over(Window.partitionBy("d", "k").orderBy("line"))
    own = later_copies(docs, least).withColumn("before", before)
    own = own.filter("before is null or before.line + 1 < line or before.line + before.n < line + n")
    marks = staged(own.groupBy("d", "k").agg(F.collect_list(F.struct("line", "n")).alias("_spans")), "line-marks")
    size = marks.agg(F.count("*"), F.sum(F.size("_spans"))).first()
    if 100 * size[0] + 24 * (size[1] or 0) <= BROADCAST_MB << 20:
        marks = F.broadcast(marks)
    names = [c for c in docs.columns if c not in ("n_lines_removed", "n_lines_left")]
    own = "_spans"
    while own in names:
        own += "_"
    same = (F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == marks["d"]) & (content_key(docs) == marks["k"])
    joined = docs.join(marks, same, "left").select(*[docs[c] for c in names], marks["_spans"].alias(own))
    counted = F.size(F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))).cast("long")
    clean = joined.filter(F.col(own).isNull()).drop(own).withColumns({"n_lines_removed": F.lit(0).cast("long"), "n_lines_left": counted})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [without(t, [(s["line"], s["n"]) for s in spans]) for t, spans in zip(b.column("text").to_pylist(), b.column(own).to_pylist(), strict=True)]
            cols = {c: b.column(c) for c in names} | {"text": pa.array([x for x, _ in found], pa.string())}
            yield pa.record_batch(cols | {"n_lines_removed": pa.array([n for _, n in found], pa.int64())})

    changed = joined.filter(F.col(own).isNotNull())
    schema = changed.drop(own).withColumn("n_lines_removed", F.lit(0).cast("long")).schema
    changed = changed.mapInArrow(cut, schema).withColumn("n_lines_left", counted)
    return clean.unionByName(changed)
