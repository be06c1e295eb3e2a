"""The N best items of every group under one fixed order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def top_n(df: DataFrame, group: str, item: str, score: str, n: int, bins: int = 1024, salts: int = 8) -> DataFrame:
    """(group, item, score, rank): per group the ``n`` distinct items of the highest score; ties go to the smaller item.

    An item's score is the highest over its rows in the group. Rows with a null group, item or score, or
    with NaN, are left out; infinite scores count as such. Groups of fewer items give all.

    Method: a histogram of item scores per group tells the bin in which the n-th item lies; items of lower
    bins are dropped (at least n of each larger group survive), the rest are ranked exactly. The histogram
    is aggregated before it is shuffled and holds at most ``bins`` rows a group. Items meet the surviving
    bins by (group, bin, salt), so a group that holds a third of all rows is spread over its bins, and a bin
    of ties over ``salts`` tasks; the ranking keeps only n rows of a group from each task before the shuffle.
    """
    g, i, s = F.col(group).alias("_g"), F.col(item).alias("_i"), F.col(score).cast("double").alias("_s")
    rows = df.select(g, i, s).where("_g IS NOT NULL AND _i IS NOT NULL AND _s IS NOT NULL AND NOT isnan(_s)")
    best = rows.groupBy("_g", "_i").agg(F.max("_s").alias("_s"))
    finite = F.when(F.abs("_s") < F.lit(float("inf")), F.col("_s"))
    span = rows.agg(F.min(finite).alias("_lo"), F.max(finite).alias("_hi"))  # one row
    place = F.floor((F.col("_s") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * bins)
    bin_ = (
        F.when(F.col("_s") == float("inf"), F.lit(bins + 1)).when(F.col("_s") == float("-inf"), F.lit(-1)).otherwise(F.coalesce(place, F.lit(0))).cast("int")
    )
    binned = best.crossJoin(F.broadcast(span)).select("_g", "_i", "_s", bin_.alias("_bin"))
    counts = binned.groupBy("_g", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    above = F.sum("_n").over(Window.partitionBy("_g").orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1))
    alive = (
        counts.withColumn("_above", F.coalesce(above, F.lit(0)))
        .where(F.col("_above") < n)
        .select("_g", "_bin", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    )
    salt = F.pmod(F.xxhash64("_i"), F.lit(salts)).cast("int")
    kept = binned.withColumn("_salt", salt).join(alive, ["_g", "_bin", "_salt"], "left_semi")
    rank = F.row_number().over(Window.partitionBy("_g").orderBy(F.desc("_s"), F.asc("_i")))
    return (
        kept.withColumn("rank", rank)
        .where(F.col("rank") <= n)
        .select(F.col("_g").alias(group), F.col("_i").alias(item), F.col("_s").alias(score), "rank")
    )
