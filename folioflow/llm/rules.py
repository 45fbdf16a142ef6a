"""Quality rules: fixed limits, then robust multivariate outliers.

Documents that pass the limits are described by five transformed statistics. For each language and
source a minimum-covariance-determinant estimate is sought as FAST-MCD does (Rousseeuw and Van
Driessen, 1999): many small random subsets of a bounded sample are concentrated, the best go on as
starts, and each start is concentrated over all rows of the group until its determinant falls no
further; the smallest determinant wins. A concentration step is one aggregation: distances under the
current estimate, moments of each bin of distance, and the sum of the bins that hold the nearest
H_SHARE of the rows. Partial sums make a group that holds a third of the rows cost no single task more.
Estimates are shrunk, by the weight of PRIOR rows, towards the medians and quartile ranges of all rows,
so that a group of any size has one. Rows beyond a Mahalanobis cut are rejected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, content_key, drop_rows, join_hot, map_columns, null_key, staged

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
H_SHARE = 0.75
#: Rows of a group, about, among which starts are sought; random subsets tried; starts that go on to all rows.
SAMPLE = 500
SUBSETS = 40
STARTS = 2
#: A step must lower the logarithm of the determinant by this much to be worth another.
GAIN = 1e-2
#: Rows whose weight the prior has in a group's mean and covariance.
PRIOR = 30
#: Squared distance beyond which a row is an outlier: the chi-squared(5) quantile at about 1 - 1e-12.
CUT = 65.0
#: Least standard deviation of each transformed statistic: a share that is nearly always zero must not make one symbol an outlier.
FLOOR = (0.5, 0.25, 0.25, 0.35, 0.35)
D = len(FLOOR)
BIN = 64.0  # bins per unit of the logarithm of a squared distance
CHI2_MEDIAN = 4.351  # of D degrees of freedom

STAT_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def text_stats(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The six counts of one text; bytes are enough as the separators are ASCII."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return 0, 0, 0, 0, 0, 0
    joined = b"".join(words)
    # Code points: bytes that are no UTF-8 continuation.
    word_chars = len(joined) if joined.isascii() else len(joined.decode())
    symbols = len(joined) - len(joined.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeat = 0
    if n >= 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            seen: set = set()
            twice = {w for w in windows if w in seen or seen.add(w)}
            end = 0
            for i, w in enumerate(windows):
                if w in twice:
                    repeat += i + 3 - max(i, end)
                    end = i + 3
    return n, word_chars, symbols, len(lines) - len(set(lines)), repeat, len(lines)


def _work(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = np.array([text_stats(t.as_py()) for t in batch.column("text")], np.int64).reshape(-1, 6)
    names = [x.split()[0] for x in STAT_SCHEMA.split(", ")]
    kept = {n: batch.column(n) for n in ("doc_id", "lang", "source", "key")}
    return pa.record_batch(kept | {n: rows[:, i] for i, n in enumerate(names)})


def transformed() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log1p("n_words"),
        F.col("word_chars") / n,
        F.log1p(20 * F.col("n_symbols") / n),
        F.log1p(10 * F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        F.log1p(10 * F.col("n_repeat_words") / n),
    ]


def _distance() -> Column:
    """Squared Mahalanobis distance: columns x1.. of the row, mean and w (rows of the inverse Cholesky factor) of its group."""
    total = F.lit(0.0)
    for i in range(D):
        z = F.lit(0.0)
        for j in range(i + 1):
            z = z + F.col("w")[i * (i + 1) // 2 + j] * (F.col(f"x{j + 1}") - F.col("mean")[j])
        total = total + z * z
    return total


Prior = tuple[list[float], list[float]]
MODEL = "g string, n long, s int, mean array<double>, w array<double>, log_det double, moved boolean"


def _factor(mean: np.ndarray, cov: np.ndarray, k: float, prior: Prior) -> tuple[list[float], list[float], float]:
    """Mean, inverse Cholesky factor by rows and log-determinant of an estimate from k rows."""
    share = k / (k + PRIOR)
    mean = share * mean + (1 - share) * np.array(prior[0])
    cov = share * cov + (1 - share) * np.diag(prior[1])
    cov = cov + np.diag(np.maximum(0, np.square(FLOOR) - np.diag(cov)))
    low = np.linalg.cholesky(cov)
    w = np.linalg.inv(low)
    return [round(float(x), 9) for x in mean], [round(float(w[i, j]), 9) for i in range(D) for j in range(i + 1)], float(2 * np.log(np.diag(low)).sum())


def _apart(x: np.ndarray, mean: list[float], w: list[float]) -> np.ndarray:
    """Squared distances of rows."""
    full = np.zeros((D, D))
    full[np.tril_indices(D)] = w
    return np.square((x - np.array(mean)) @ full.T).sum(1)


def _concentrated(x: np.ndarray, model: tuple, k: float, prior: Prior, steps: int) -> tuple:
    """The estimate after so many concentration steps over x, or when they no longer help."""
    h = max(1, int(np.ceil(H_SHARE * len(x))))
    for _ in range(steps):
        near = x[np.argpartition(_apart(x, *model[:2]), h - 1)[:h]]
        new = _factor(near.mean(0), np.cov(near.T, bias=True), k, prior)
        if new[2] > model[2] - GAIN:
            break
        model = new
    return model


def starts(x: np.ndarray, n: int, prior: Prior) -> list[tuple]:
    """The STARTS best estimates, of different determinants, that random subsets of the sample x of a group of n rows lead to."""
    r, k = np.random.default_rng(5), H_SHARE * n
    x = x[np.lexsort(x.T)]
    found = [_factor(np.median(x, 0), np.diag(((np.quantile(x, 0.75, 0) - np.quantile(x, 0.25, 0)) / 1.349) ** 2), k, prior)]
    for _ in range(SUBSETS):
        own = x[r.permutation(len(x))[: D + 1]]
        found.append(_concentrated(x, (*_factor(own.mean(0), np.cov(own.T, bias=True), k, prior)[:2], np.inf), k, prior, 2))
    found = sorted((_concentrated(x, m, k, prior, 100) for m in sorted(found, key=lambda m: m[2])[: 4 * STARTS]), key=lambda m: m[2])
    best = [m for i, m in enumerate(found) if not i or m[2] > found[i - 1][2] + GAIN]
    return best[:STARTS]


def _by_bin(rows: DataFrame, model: DataFrame, models: int, total: int) -> DataFrame:
    """g, s, n, bin, count, upto, m1..: moments of each bin of distance under each model, and the rows up to its end."""
    x = [F.col(f"x{i + 1}") for i in range(D)]
    moments = [*x, *[x[i] * x[j] for i in range(D) for j in range(i + 1)]]
    far = _with_model(rows, model, models, total).withColumn("bin", F.floor(F.log(_distance() + 1e-6) * BIN))
    bins = far.groupBy("g", "s", "bin").agg(F.max("n").alias("n"), F.count("*").alias("count"), *[F.sum(m).alias(f"m{i}") for i, m in enumerate(moments)])
    return bins.withColumn("upto", F.sum("count").over(Window.partitionBy("g", "s").orderBy("bin")))


def _with_model(rows: DataFrame, model: DataFrame, models: int, total: int) -> DataFrame:
    """`rows` with the models of their g: broadcast (some 250 bytes each) up to a tenth of BROADCAST_ROWS, else only those of hot groups."""
    model = model.select("g", "n", "s", "mean", "w")
    if models <= BROADCAST_ROWS // 10:
        return rows.join(F.broadcast(model), "g")
    return join_hot(rows, model, ["g"], "n", total)


def estimates(fit: DataFrame) -> DataFrame:
    """g, n, s, mean, w, log_det, stretch: the estimate of each group of `fit` (g, x1.., pick: a hash).

    w are the rows of the inverse Cholesky factor. The inner rows' covariance is too small: distances
    are to be divided by `stretch`, which brings the median of all rows' to the chi-squared one.
    """
    at = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    everything = fit.agg(F.count("*").alias("n"), *[F.percentile_approx(f"x{i + 1}", at, F.lit(10000)).alias(f"q{i}") for i in range(D)]).first()
    total = everything["n"]
    q = [everything[f"q{i}"] or [0.0] * 3 for i in range(D)]
    prior: Prior = ([b for _, b, _ in q], [max(f, (c - a) / 1.349) ** 2 for f, (a, _, c) in zip(FLOOR, q, strict=True)])
    groups = staged(fit.groupBy("g").agg(F.count("*").alias("n")), "rule-groups")
    few = groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rated = fit.join(F.broadcast(groups), "g") if few else join_hot(fit, groups, ["g"], "n", total)
    picked = rated.filter(F.pmod("pick", F.lit(1 << 30)) * F.col("n") < F.lit(SAMPLE << 30))
    picked = picked.groupBy("g", *[f"x{i + 1}" for i in range(D)]).agg(F.max("n").alias("n"))

    def begin(part: pd.DataFrame) -> pd.DataFrame:
        g, n = part.g.iloc[0], int(part.n.iloc[0])
        found = starts(part[[f"x{i + 1}" for i in range(D)]].to_numpy(), n, prior)
        # The first step puts the whole group's determinant in the place of the sample's.
        return pd.DataFrame([(g, n, s, *m[:2], 1e9, True) for s, m in enumerate(found)], columns=[c.split()[0] for c in MODEL.split(", ")])

    def step(parts):  # noqa: ANN001, ANN202
        for part in parts:
            out = []
            for row in part.itertuples(index=False):
                m = np.array(row.m) / row.k
                cov = np.zeros((D, D))
                cov[np.tril_indices(D)] = m[D:]
                cov = cov + np.tril(cov, -1).T - np.outer(m[:D], m[:D])
                new = _factor(m[:D], cov, row.k, prior)
                moved = new[2] < row.log_det - GAIN
                out.append((row.g, row.n, row.s, *(new if moved else (row.mean, row.w, row.log_det)), moved))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in MODEL.split(", ")])

    tasks = 2 * fit.sparkSession.sparkContext.defaultParallelism
    model = staged(picked.repartition(tasks, "g").groupBy("g").applyInPandas(begin, MODEL), "rule-model")
    models = model.count()
    while True:
        bins = _by_bin(fit, model.filter("moved"), models, total).filter(F.col("upto") - F.col("count") < F.col("n") * H_SHARE)
        sums = F.array(*[F.sum(f"m{i}") for i in range(D + D * (D + 1) // 2)])
        inner = bins.groupBy("g", "s").agg(F.sum("count").alias("k"), sums.alias("m"))
        known = model.filter("moved").join(inner, ["g", "s"])
        new = known.select("g", "n", "s", "mean", "w", "log_det", "k", "m").mapInPandas(step, MODEL)
        model = staged(new.unionByName(model.filter("not moved")), "rule-model")
        if model.filter("moved").isEmpty():
            break
    best = model.groupBy("g").agg(F.min(F.struct("log_det", "s", "n", "mean", "w")).alias("best")).select("g", "best.*")
    best = staged(best, "rule-model")
    middle = _by_bin(fit, best, models, total).filter(F.col("upto") >= F.col("n") * 0.5).groupBy("g").agg(F.min("bin").alias("bin"))
    stretch = F.greatest(F.exp((F.col("bin") + 0.5) / BIN) / CHI2_MEDIAN, F.lit(1.0))
    return staged(best.join(middle, "g").withColumn("stretch", stretch).drop("bin"), "rule-model")


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, d2 (null where the limits failed), kept, and key (its content's hash).

    Null and empty texts have no words and fail. Null languages and sources are values like others.
    Repeated rows are judged alike; they count towards their group each. Groups of any size have an
    estimate. Extra columns are ignored, whatever their names; an empty table gives no rows.
    """
    src = docs.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string"), F.col("source").cast("string"), content_key(docs).alias("key"))
    stats = map_columns(src, _work, f"doc_id long, lang string, source string, key long, {STAT_SCHEMA}")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    la, so = null_key(F.col("lang")), null_key(F.col("source"))
    stats = stats.withColumns({"base_failed": failed, "g": F.concat(F.length(la).cast("string"), F.lit(":"), la, so)})
    stats = staged(stats.drop("lang", "source").select("*", *[x.alias(f"x{i + 1}") for i, x in enumerate(transformed())]), "rule-stats")
    good = stats.filter("not base_failed")
    model = estimates(good.select("g", F.xxhash64("doc_id", "key").alias("pick"), *[f"x{i + 1}" for i in range(D)]))
    stretch = model.select("g", "n", "s", "mean", F.transform("w", lambda w: w / F.sqrt("stretch")).alias("w"))
    scored = _with_model(good, stretch, model.count(), good.count()).withColumn("d2", _distance())
    counts = [x.split()[0] for x in STAT_SCHEMA.split(", ")][:5]
    fine = scored.select("doc_id", *counts, "base_failed", "d2", (F.col("d2") <= CUT).alias("kept"), "key")
    return fine.unionByName(stats.filter("base_failed").select("doc_id", *counts, "base_failed", F.lit(None).cast("double").alias("d2"), F.lit(False).alias("kept"), "key"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that `judge` keeps, with all their columns, whatever these are called.

    Null and empty texts go. Rows that are alike stay or go together. An empty table stays empty.
    """
    verdict = staged(judge(docs).select("doc_id", "key", "kept"), "rule-verdict")
    return drop_rows(docs, verdict.filter("not kept"))
