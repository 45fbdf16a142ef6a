"""Mixing sources to target weights by fitting subset sums.

A source takes each of its documents floor(target / size) times, then fits the remaining budget:
documents are counted by exact length, every length gives its proportional share, and bounded
knapsack dynamic programming over the documents left closes what remains, less than two documents
of the longest length. How many documents a length gives is settled from counts alone; which ones,
by the order of a seeded hash.
"""

from __future__ import annotations

from math import gcd

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import join_hot, null_key, staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Bits of the largest table of sums, about.
WORK = 1 << 32
PLAN_BROADCAST_ROWS = 300_000
#: Targets are shared out on the driver, a few dozen bytes a source.
MOST_SOURCES = 300_000


def shares(sizes: list[int], weights: list[float], budget: float) -> list[float]:
    """Targets by weight; one that would pass MOST times its size stops there and the others share its excess."""
    target, free = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    left = budget
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > MOST * sizes[i]]
        if not over:
            for i in free:
                target[i] = left * weights[i] / total
            break
        for i in over:
            target[i] = float(MOST * sizes[i])
        left -= sum(target[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return target


def fit(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length to take so that their words come as near `budget` from below as any choice does.

    Shares are dealt from the longest length down, rounded, so that what each leaves or takes over goes to the next. Where the
    documents beyond the shares cannot make what is left at last, shares of the shortest lengths are given back,
    twice as many words each time, until they can or until the choice is among all documents. It also ends where the
    table of sums would pass WORK bits; the gap is then what the window before could not close.
    """
    total = sum(a * b for a, b in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    order = sorted((i for i in range(len(lengths)) if lengths[i]), key=lambda i: lengths[i])
    unit = gcd(*[lengths[i] for i in order])
    budget = budget // unit * unit
    share, carry = [0] * len(lengths), 0
    for i in reversed(order):
        words, one = budget * lengths[i] * counts[i] + carry, total * lengths[i]  # in units of 1 / total
        share[i] = max(0, min(counts[i], (2 * words + one) // (2 * one)))
        carry = words - share[i] * one
    back, best = 0, None
    while True:
        take, given = list(share), 0
        for i in order:
            n = min(take[i], -(-max(0, back - given) // lengths[i]))
            take[i] -= n
            given += n * lengths[i]
        left = budget - sum(lengths[i] * take[i] for i in order)
        if left < 0:
            back = 2 * back or 64
            continue
        if best and left // unit * len(order) * 8 > WORK:
            return best[1]
        more, gap = _closed([lengths[i] // unit for i in order], [counts[i] - take[i] for i in order], left // unit)
        for i, n in zip(order, more, strict=True):
            take[i] += n
        if best is None or gap < best[0]:
            best = gap, take
        if not gap or given < back:
            return best[1]
        back = 2 * back or 64


def _closed(lengths: list[int], counts: list[int], left: int) -> tuple[list[int], int]:
    """Bounded knapsack: how many of each length make the largest sum up to `left`, and what it lacks."""
    # Bit s of `reach` says whether s words can be made; its state before each item leads the way back.
    reach, steps, mask = 1, [], (1 << (left + 1)) - 1
    for i, length in enumerate(lengths):
        free, size = counts[i], 1
        while free and length <= left and not reach >> left & 1:
            size = min(size, free)
            steps.append((i, size, reach))
            reach = (reach | reach << length * size) & mask
            free -= size
            size *= 2
    top = at = reach.bit_length() - 1
    take = [0] * len(lengths)
    for i, size, before in reversed(steps):
        if not before >> at & 1:
            at -= lengths[i] * size
            take[i] += size
    return take, left - top


def _size() -> Column:
    return F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")


def _dart(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))


def plan(docs: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(sizes, plan): doc_id, so, size, dart for every row; so, size, source_size, target, base, limit, quota for each source and length.

    A row is taken `base` times and once more if its dart is below `limit` (null: never), or if it
    is among `quota` of the rows at `limit` (null: all), which are repeats of one row.
    One row a source is gathered on the driver (at most MOST_SOURCES, else an error), and one source's
    counts by length in a task: counts whose number does not follow the documents'.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", null_key(F.col("source")).alias("so"))
    sizes = staged(rows.select("doc_id", "so", _size().alias("size"), _dart(seed).alias("dart")), "mix-sizes")
    counts = staged(sizes.groupBy("so", "size").agg(F.count("*").alias("n")), "mix-counts")
    sources = counts.groupBy("so").agg(F.sum(F.col("size") * F.col("n")).alias("s")).limit(MOST_SOURCES + 1).collect()
    if len(sources) > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} sources: weights by source are meant for fewer")
    # Code point order is that of UTF-8 bytes and of Python strings; null ("") goes last.
    sources = sorted(((r.so, int(r.s)) for r in sources), key=lambda x: (x[0] == "", x[0]))
    target = shares([s for _, s in sources], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sources))], SHARE * sum(s for _, s in sources))
    targets = spark.createDataFrame(
        [(so, s, t, (base := min(MOST, int(t // s))) if s else 0, round(t) - base * s if s else 0) for (so, s), t in zip(sources, target, strict=True)],
        "so string, source_size long, target double, base long, budget long",
    )

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("size")
        budget = int(part.budget.iloc[0])
        part["take"] = fit(part["size"].tolist(), part.n.tolist(), budget) if budget > 0 else 0
        return part.drop(columns="budget")

    schema = "so string, size long, n long, source_size long, target double, base long, take long"
    known = counts.join(F.broadcast(targets), "so").groupBy("so").applyInPandas(solve, schema)
    known = staged(known, "mix-plan")
    return sizes, staged(known.join(_limits(sizes, known), ["so", "size"], "left"), "mix-limits")


def _nth(rows: DataFrame, wanted: DataFrame, by: str, shift: int) -> DataFrame:
    """so, size, limit: the k-th smallest `by` among the rows of each so and size of `wanted` (so, size, n rows, k).

    Those with over 1/1000 of all rows are first cut into buckets by the leading bits of `by`, so
    that only the bucket that holds the limit is sorted.
    """
    most = max(rows.count() // 1000, 1000)
    hot = F.broadcast(wanted.filter(F.col("n") > most).select("so", "size", "k"))
    bucket = F.shiftright(by, shift)
    cut = rows.join(hot, ["so", "size"]).groupBy("so", "size", "k", bucket.alias("bucket")).count()
    upto = F.sum("count").over(Window.partitionBy("so", "size").orderBy("bucket"))
    edge = cut.withColumn("upto", upto).filter("upto >= k and upto - count < k")
    edge = F.broadcast(edge.select("so", "size", "bucket", (F.col("k") - F.col("upto") + F.col("count")).alias("k")))
    cold = wanted.filter(F.col("n") <= most).select("so", "size", "k")
    if cold.limit(PLAN_BROADCAST_ROWS + 1).count() <= PLAN_BROADCAST_ROWS:
        cold = F.broadcast(cold)
    found = rows.withColumn("bucket", bucket).join(edge, ["so", "size", "bucket"]).select("so", "size", by, "k")
    found = found.unionByName(rows.join(cold, ["so", "size"]).select("so", "size", by, "k"))
    nth = F.row_number().over(Window.partitionBy("so", "size").orderBy(by))
    return found.withColumn("nth", nth).filter("nth = k").select("so", "size", F.col(by).alias("limit"))


def _limits(sizes: DataFrame, known: DataFrame) -> DataFrame:
    """so, size, limit, quota: the take-th smallest dart of each source and length, and how many of the rows that have it are taken (null: all)."""
    part = known.filter("take > 0 and take < n").select("so", "size", "n", F.col("take").alias("k"))
    whole = known.filter("take > 0 and take = n").select("so", "size", F.lit(2**63 - 1).cast("long").alias("limit"), F.lit(None).cast("long").alias("quota"))
    edge = staged(_nth(sizes, part, "dart", 54), "mix-edges")
    near = F.broadcast(edge) if edge.limit(PLAN_BROADCAST_ROWS + 1).count() <= PLAN_BROADCAST_ROWS else edge
    same = sizes.join(near, ["so", "size"]).filter("dart <= limit").groupBy("so", "size", "limit").agg(F.count_if(F.col("dart") < F.col("limit")).alias("less"), F.count("*").alias("upto"))
    same = same.join(part.select("so", "size", "k"), ["so", "size"])
    return whole.unionByName(same.select("so", "size", "limit", F.when(F.col("upto") > F.col("k"), F.col("k") - F.col("less")).alias("quota")))


def _times(rows: DataFrame, known: DataFrame) -> DataFrame:
    """`rows` (so, size, dart, ...) with source_size, target and times."""
    known = known.select("so", "size", "n", "source_size", "target", "base", "limit", "quota")
    if known.count() <= PLAN_BROADCAST_ROWS:
        joined = rows.join(F.broadcast(known), ["so", "size"])
    else:
        joined = join_hot(rows, known, ["so", "size"], "n", known.agg(F.sum("n")).first()[0])
    more = F.coalesce(F.col("dart") <= F.col("limit"), F.lit(False))
    if known.filter("quota is not null").isEmpty():
        return joined.withColumn("times", F.col("base") + more.cast("long"))
    # Repeats of one row at the limit: as many as the quota says, in the order in which they are stored here.
    tied = F.coalesce(F.col("quota").isNotNull() & (F.col("dart") == F.col("limit")), F.lit(False))
    ties = staged(joined.filter(tied).withColumn("at", F.monotonically_increasing_id()), "mix-ties")
    wanted = ties.groupBy("so", "size").agg(F.count("*").alias("n"), F.max("quota").alias("k"))
    last = _nth(ties.select("so", "size", "at"), staged(wanted, "mix-tied"), "at", 33).withColumnRenamed("limit", "last")
    ties = ties.join(F.broadcast(staged(last, "mix-last")), ["so", "size"]).withColumn("times", F.col("base") + (F.col("at") <= F.col("last")).cast("long"))
    return joined.filter(~tied).withColumn("times", F.col("base") + more.cast("long")).unionByName(ties.drop("at", "last"))


def allot(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) for every row.

    Null and empty texts have size 0 and take 0. A null source is a source of its own, the last.
    Of rows that repeat a doc_id and text as many are taken as are needed. Extra columns are ignored,
    whatever their names. An empty table gives no rows.
    """
    sizes, known = plan(docs, seed)
    return _times(sizes, known).select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it, with all their columns, whatever these are called.

    Null and empty texts are never taken. A null source is a source of its own. Repeated rows are rows
    of their own. An empty table stays empty.
    """
    _, known = plan(docs, seed)
    rows = docs.select(F.struct(*docs.columns).alias("_row"))
    rows = rows.select("_row", null_key(F.col("_row.source")).alias("so"), F.col("_row.doc_id").cast("long").alias("doc_id"), F.col("_row.text").alias("text"))
    rows = rows.select("_row", "so", _size().alias("size"), _dart(seed).alias("dart"))
    taken = _times(rows, known).filter("times > 0")
    return taken.withColumn("_k", F.explode(F.expr("sequence(1, times)"))).select("_row.*")
