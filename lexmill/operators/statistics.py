"""Statistics over labels, scores and ranks: agreement, retrieval and ranking measures, exact and resampled tests."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lexmill.runtime import cut


def global_rank(df: DataFrame, value: str, parts: int = 64) -> DataFrame:
    """Adds ``rank_avg``: ascending rank with ties averaged, over the whole table.

    Counts per distinct value, then running sums within value ranges and over ranges, so no task sorts all rows.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_gr_v")).agg(F.count(F.lit(1)).alias("_gr_n"))
    ranged = cut(counts.repartitionByRange(parts, "_gr_v").withColumn("_gr_p", F.spark_partition_id()))  # ids must stay
    local = ranged.withColumn("_gr_c", F.sum("_gr_n").over(Window.partitionBy("_gr_p").orderBy("_gr_v")))
    totals = local.groupBy("_gr_p").agg(F.sum("_gr_n").alias("_gr_t"))
    before = totals.select("_gr_p", (F.sum("_gr_t").over(Window.partitionBy(F.lit(1)).orderBy("_gr_p")) - F.col("_gr_t")).alias("_gr_b"))  # at most ``parts`` rows
    ranks = local.join(F.broadcast(before), "_gr_p").select("_gr_v", (F.col("_gr_b") + F.col("_gr_c") - (F.col("_gr_n") - 1) / 2).alias("rank_avg"))
    return df.join(ranks, F.col(value) == F.col("_gr_v")).drop("_gr_v")


def average_rank(value: str, *partition: str) -> Column:
    """Ascending rank with ties averaged, within a partition that one task can hold."""
    return F.rank().over(Window.partitionBy(*partition).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*partition, value)) - 1) / 2


def cohen_kappa(pairs: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """(by..., n, agreement, kappa) from pairs of labels; kappa is null where chance agreement is complete."""
    cells = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    rows = cells.select(*by, F.col("_a").alias("_l"), F.col("_n").alias("_x"), F.lit(0).alias("_y"), F.when(F.col("_a") == F.col("_b"), F.col("_n")).otherwise(0).alias("_d"))
    cols = cells.select(*by, F.col("_b").alias("_l"), F.lit(0).alias("_x"), F.col("_n").alias("_y"), F.lit(0).alias("_d"))
    each = rows.union(cols).groupBy(*by, "_l").agg(F.sum("_x").alias("_x"), F.sum("_y").alias("_y"), F.sum("_d").alias("_d"))
    out = each.groupBy(*by).agg(F.sum("_x").alias("n"), F.sum("_d").alias("_d"), F.sum(F.col("_x").cast("double") * F.col("_y")).alias("_e"))
    po, pe = F.col("_d") / F.col("n"), F.col("_e") / (F.col("n").cast("double") * F.col("n"))
    return out.select(*by, "n", po.alias("agreement"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def threshold_sweep(df: DataFrame, score: str, gold: str, grid: list[float]) -> DataFrame:
    """(threshold, tp, fp, fn, precision, recall, f1) of every threshold in one pass.

    A row's score passes all thresholds up to it; counts per passed number are summed from the top, so the
    grid is never multiplied with the rows.
    """
    steps = F.array(*(F.lit(float(t)) for t in grid))
    passed = F.size(F.filter(steps, lambda t: F.col(score) >= t))
    counts = df.where(F.col(score).isNotNull()).groupBy(passed.alias("_k")).agg(F.count(F.when(F.col(gold), 1)).alias("_p"), F.count(F.when(~F.col(gold), 1)).alias("_n"))
    points = df.sparkSession.createDataFrame([(k + 1, float(t)) for k, t in enumerate(sorted(grid))], "_t int, threshold double")
    met = points.join(F.broadcast(counts), F.col("_k") >= F.col("_t"), "left").groupBy("_t", "threshold").agg(F.coalesce(F.sum("_p"), F.lit(0)).alias("tp"), F.coalesce(F.sum("_n"), F.lit(0)).alias("fp"))
    total = df.where(F.col(score).isNotNull()).agg(F.count(F.when(F.col(gold), 1)).alias("_all"))
    out = met.crossJoin(F.broadcast(total)).withColumn("fn", F.col("_all") - F.col("tp"))  # one row
    p, r = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("_all"), F.lit(0))
    f1 = 2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0))
    zero = F.lit(0.0)
    return out.select("threshold", "tp", "fp", "fn", F.coalesce(p, zero).alias("precision"), F.coalesce(r, zero).alias("recall"), F.coalesce(f1, zero).alias("f1"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The row of the highest f1; the first threshold wins ties."""
    return sweep.orderBy(F.desc("f1"), "threshold").limit(1)


def average_precision(df: DataFrame, score: str, gold: str, key: str, *by: str) -> DataFrame:
    """(by..., average_precision): mean precision at the hits, in descending order of score, ties by key."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(key)).rowsBetween(Window.unboundedPreceding, 0)
    hit = F.when(F.col(gold), 1).otherwise(0)
    ranked = df.withColumn("_h", hit).withColumn("_at", F.sum(hit).over(w) / F.count(F.lit(1)).over(w))
    return ranked.groupBy(*by).agg((F.sum(F.col("_h") * F.col("_at")) / F.nullif(F.sum("_h"), F.lit(0))).alias("average_precision"))


def bh_qvalues(df: DataFrame, p: str, parts: int = 64) -> DataFrame:
    """Adds ``q``: Benjamini-Hochberg, the smallest p * m / rank at or above each p, at most 1. Null p give no row.

    Works on distinct p values: ranks and running minima are found per value range and carried between ranges.
    """
    counts = df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    local = cut(counts.repartitionByRange(parts, "_v").withColumn("_p", F.spark_partition_id()))  # ids must stay
    one = Window.partitionBy(F.lit(1))  # over at most ``parts`` rows
    local = local.withColumn("_c", F.sum("_n").over(Window.partitionBy("_p").orderBy("_v")))
    sums = local.groupBy("_p").agg(F.sum("_n").alias("_t"))
    sums = sums.select("_p", (F.sum("_t").over(one.orderBy("_p")) - F.col("_t")).alias("_b"), F.sum("_t").over(one).alias("_m"))
    raw = local.join(F.broadcast(sums), "_p").withColumn("_raw", F.col("_v") * F.col("_m") / (F.col("_b") + F.col("_c")))
    raw = raw.withColumn("_low", F.min("_raw").over(Window.partitionBy("_p").orderBy(F.desc("_v"))))
    ends = raw.groupBy("_p").agg(F.min("_raw").alias("_e"))
    ends = ends.select("_p", F.min("_e").over(one.orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, -1)).alias("_above"))
    q = raw.join(F.broadcast(ends), "_p").select("_v", F.least(F.lit(1.0), "_low", F.coalesce("_above", F.lit(1.0))).alias("q"))
    return df.join(q, F.col(p) == F.col("_v")).drop("_v")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, rho) over rows with both values; ties get average ranks."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("_a"), F.col(b).alias("_b"))
    ranked = global_rank(global_rank(rows, "_a").withColumnRenamed("rank_avg", "_ra"), "_b").withColumnRenamed("rank_avg", "_rb")
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.corr("_ra", "_rb").alias("rho"))


def mann_whitney(df: DataFrame, value: str, first: str) -> DataFrame:
    """(n1, n2, u1, mean1, mean2, z, p_less): rank-sum test of rows where ``first`` against the rest.

    z and p (one-sided, first smaller) by the normal approximation with corrections for ties and continuity.
    """
    rows = df.where(F.col(value).isNotNull() & F.col(first).isNotNull()).select(F.col(value).alias("_v"), F.col(first).alias("_f"))
    ranked = global_rank(rows, "_v")
    ties = rows.groupBy("_v").agg(F.count(F.lit(1)).cast("double").alias("_t")).agg(F.sum(F.col("_t") * F.col("_t") * F.col("_t") - F.col("_t")).alias("_ties"))
    s = ranked.agg(
        F.count(F.when(F.col("_f"), 1)).alias("n1"), F.count(F.when(~F.col("_f"), 1)).alias("n2"), F.sum(F.when(F.col("_f"), F.col("rank_avg"))).alias("_r"), F.avg(F.when(F.col("_f"), F.col("_v"))).alias("mean1"), F.avg(F.when(~F.col("_f"), F.col("_v"))).alias("mean2")
    ).crossJoin(F.broadcast(ties))  # single rows
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("_r") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("_ties") / (n * (n - 1))))
    z = (u - n1 * n2 / 2 + 0.5) / F.nullif(sd, F.lit(0.0))
    normal = F.udf(lambda x: None if x is None else 0.5 * math.erfc(-x / math.sqrt(2)), "double")  # one row
    return s.select("n1", "n2", u.alias("u1"), "mean1", "mean2", z.alias("z")).withColumn("p_less", normal("z"))


def fisher_exact(a: int, b: int, c: int, d: int) -> tuple[float, float]:
    """(odds ratio, p): one-sided "greater" test of a 2x2 table by the hypergeometric tail."""
    n, k, m = a + b + c + d, a + b, a + c
    odds = math.inf if b * c == 0 and a * d else (a * d) / (b * c) if b * c else math.nan
    p = sum(math.comb(m, x) * math.comb(n - m, k - x) for x in range(a, min(k, m) + 1)) / math.comb(n, k)
    return odds, p


def mcnemar_exact(b: int, c: int) -> float:
    """Two-sided exact p of b against c discordant pairs."""
    n = b + c
    return 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, x) for x in range(min(b, c) + 1)) / 2**n)


def t_two_sided(r: float, n: int) -> float:
    """p of a correlation by Student's t with n - 2 degrees of freedom (regularised incomplete beta by continued fraction)."""
    if n < 3 or abs(r) >= 1:
        return math.nan if n < 3 else 0.0
    df = n - 2
    t = r * math.sqrt(df / (1 - r * r))
    x, a, b = df / (df + t * t), df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))

    def fraction(x: float, a: float, b: float) -> float:
        tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + num * d
                c = 1 + num / c
                d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


def bootstrap_mean(df: DataFrame, unit: str, value: str, replicates: int = 2000, seed: int = 42) -> DataFrame:
    """(n_units, mean, low, high): mean and percentile interval when whole units are resampled.

    A unit's rows stay together. Units get Poisson(1) weights drawn from (seed, replicate, unit), so every
    partition adds its part of each replicate and one row a replicate is shuffled: no unit table is collected.
    """
    units = df.where(F.col(value).isNotNull() & F.col(unit).isNotNull()).groupBy(unit).agg(F.sum(value).alias("_s"), F.count(F.lit(1)).cast("double").alias("_n"), F.xxhash64(F.first(unit)).alias("_h"))

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((replicates, 2))
        for pdf in batches:
            x = pdf[["_s", "_n"]].to_numpy(dtype=float)
            for at, h in enumerate(pdf["_h"]):
                w = np.random.Generator(np.random.Philox(key=[seed, h & 0x7FFFFFFFFFFFFFFF])).poisson(1.0, replicates)
                total += w[:, None] * x[at]
        yield pd.DataFrame({"_r": np.arange(replicates), "_s": total[:, 0], "_n": total[:, 1]})

    draws = units.select("_s", "_n", "_h").mapInPandas(weigh, "_r int, _s double, _n double").groupBy("_r").agg((F.sum("_s") / F.nullif(F.sum("_n"), F.lit(0.0))).alias("_m"))
    interval = draws.agg(F.percentile("_m", F.lit(0.025)).alias("low"), F.percentile("_m", F.lit(0.975)).alias("high"))
    return units.agg(F.count(F.lit(1)).alias("n_units"), (F.sum("_s") / F.sum("_n")).alias("mean")).crossJoin(F.broadcast(interval))  # one row each


def permutation_leak(edges: DataFrame, labels: DataFrame, node: str, label: str, replicates: int = 1000, seed: int = 42, most_edges: int = 5_000_000) -> DataFrame:
    """(a, b, edges, null_mean, p): edges between labels a < b of a fixed graph against shuffled labels.

    p = (1 + shuffles with at least as many) / (1 + replicates). Each task shuffles on its own; the graph is sent
    to all tasks and so may have at most ``most_edges`` edges (checked).
    """
    numbered = edges.select(F.col("src"), F.col("dst"))
    if numbered.count() > most_edges:
        raise ValueError(f"more than {most_edges} edges; sample the graph first")
    nodes = labels.select(F.col(node).alias("_n"), F.col(label).cast("string").alias("_l")).toPandas().sort_values("_n", ignore_index=True)  # nodes of a graph of bounded size
    at = pd.Series(np.arange(len(nodes)), index=nodes["_n"])
    e = numbered.toPandas()
    src, dst = at[e["src"]].to_numpy(), at[e["dst"]].to_numpy()
    names = sorted(nodes["_l"].unique())
    code = nodes["_l"].map({n: k for k, n in enumerate(names)}).to_numpy()
    k = len(names)

    def count(c: np.ndarray) -> np.ndarray:
        x, y = c[src], c[dst]
        return np.bincount(np.minimum(x, y) * k + np.maximum(x, y), minlength=k * k)

    seen = count(code)

    def shuffle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        above, total = np.zeros(k * k, dtype=np.int64), np.zeros(k * k)
        for pdf in batches:
            for r in pdf["id"]:
                n = count(np.random.default_rng([seed, int(r)]).permutation(code))
                above += n >= seen
                total += n
        yield pd.DataFrame({"_at": np.arange(k * k), "_above": above, "_total": total})

    spark = edges.sparkSession
    runs = spark.range(0, replicates, 1, 32).mapInPandas(shuffle, "_at int, _above bigint, _total double").groupBy("_at").agg(F.sum("_above").alias("_above"), F.sum("_total").alias("_total"))
    pairs = spark.createDataFrame([(i * k + j, names[i], names[j], int(seen[i * k + j])) for i in range(k) for j in range(i + 1, k)], "_at int, a string, b string, edges bigint")
    return pairs.join(F.broadcast(runs), "_at").select("a", "b", "edges", (F.col("_total") / replicates).alias("null_mean"), ((1 + F.col("_above")) / (1 + replicates)).alias("p"))


def target_ranks(scores: DataFrame, query: str, item: str, score: str, target: str, *by: str) -> DataFrame:
    """(by..., query, rank_position, rank_strict, n): the target's place by position (ties by item) and as 1 + number strictly above."""
    w = Window.partitionBy(*by, query).orderBy(F.desc(score), F.asc(item))
    ranked = scores.withColumn("rank_position", F.row_number().over(w)).withColumn("rank_strict", F.rank().over(Window.partitionBy(*by, query).orderBy(F.desc(score)))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*by, query)))
    return ranked.where(F.col(item) == F.col(target)).select(*by, query, "rank_position", "rank_strict", "n")


def rank_metrics(ranks: DataFrame, rank: str, *by: str) -> DataFrame:
    """(by..., n_queries, acc_at_1, acc_at_5, mrr, chance_at_1)."""
    r = F.col(rank)
    return ranks.groupBy(*by).agg(F.count(F.lit(1)).alias("n_queries"), F.avg((r <= 1).cast("int")).alias("acc_at_1"), F.avg((r <= 5).cast("int")).alias("acc_at_5"), F.avg(1 / r).alias("mrr"), F.avg(1 / F.col("n")).alias("chance_at_1"))


def distribution(df: DataFrame, value: str, *by: str) -> DataFrame:
    """(by..., value, n, share): shares of a group's values, 4 digits."""
    n = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*by)), 4))


def multiclass(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1) one against the rest."""
    cells = df.where(F.col(gold).isNotNull() & F.col(predicted).isNotNull()).groupBy(gold, predicted).agg(F.count(F.lit(1)).alias("_n"))
    hit = F.col(gold) == F.col(predicted)
    a = cells.select(F.col(gold).alias("label"), F.when(hit, F.col("_n")).otherwise(0).alias("tp"), F.lit(0).alias("fp"), F.when(~hit, F.col("_n")).otherwise(0).alias("fn"))
    b = cells.where(~hit).select(F.col(predicted).alias("label"), F.lit(0).alias("tp"), F.col("_n").alias("fp"), F.lit(0).alias("fn"))
    s = a.union(b).groupBy("label").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    div = lambda x, y: F.coalesce(x / F.nullif(y, F.lit(0)), F.lit(0.0))
    return s.select("label", "tp", "fp", "fn", div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), div(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))
