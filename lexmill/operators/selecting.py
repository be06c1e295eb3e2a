"""Selection: funnels, caps, deterministic samples, disjoint sets, splits. All choices have a total order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexmill.functions.text import squeeze


def hash01(seed: str | int, *key: Column | str) -> Column:
    """A number in [0, 1) that depends on the seed and the key only; the same in any engine with MD5."""
    parts = [F.lit(str(seed)), *(F.coalesce(k if isinstance(k, Column) else F.col(k), F.lit("")).cast("string") for k in key)]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("bigint") / float(1 << 32)


def first_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key under ``order``, which must be total."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rank).where("_rn = 1").drop("_rn")


def top_per(df: DataFrame, keys: list[str], n: int | None, *order: Column) -> DataFrame:
    """The first ``n`` rows of each key; without n, all rows as they are."""
    if n is None:
        return df
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rank).where(F.col("_rn") <= n).drop("_rn")


def label_pattern(names: list[str]) -> str:
    """One pattern for technical names: each part between slashes, escaped, the longest first, as whole words."""
    parts = sorted({p.strip() for n in names for p in n.split("/") if p.strip()}, key=lambda p: (-len(p), p))
    special = set(r"\.^$|?*+()[]{}")
    return r"(?i)\b(?:" + "|".join("".join("\\" + c if c in special else c for c in p) for p in parts) + r")\b"


def select_candidates(df: DataFrame, group: list[str], key: str, text: str, score: str, seq: str, n: int, pattern: str | None = None) -> DataFrame:
    """Candidates of each group: best row per key, best per normalised text, label mentions removed, top n by score.

    Ties keep the earlier ``seq``. Blank and null texts are dropped at the second step. Adds ``rank``.
    """
    order = (F.desc_nulls_last(score), F.asc(seq))
    best = first_per(df, [*group, key], *order).withColumn("_norm", squeeze(text)).where("_norm <> ''")
    best = first_per(best, [*group, "_norm"], *order)
    if pattern:
        best = best.where(~F.coalesce(F.col(text).rlike(pattern), F.lit(False)))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return best.withColumn("rank", rank).where(F.col("rank") <= n).drop("_norm")


def candidate_funnel(df: DataFrame, group: list[str], key: str, text: str, score: str, seq: str, n: int, pattern: str | None = None) -> DataFrame:
    """Counts of each group after every step of ``select_candidates``: one pass of flags instead of five scans."""
    order = (F.desc_nulls_last(score), F.asc(seq))
    rows = df.withColumn("_norm", squeeze(text)).withColumn("_k", F.row_number().over(Window.partitionBy(*group, key).orderBy(*order)))
    rows = rows.withColumn("_t", F.row_number().over(Window.partitionBy(*group, F.when(F.col("_k") == 1, F.col("_norm"))).orderBy(*order)))
    by_key = F.col("_k") == 1
    by_text = by_key & (F.col("_norm") != "") & (F.col("_t") == 1)
    clean = by_text & (~F.coalesce(F.col(text).rlike(pattern), F.lit(False)) if pattern else F.lit(True))
    kept = F.count(F.when(clean, 1))
    return rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_raw"), F.count(F.when(by_key, 1)).alias("n_keys"), F.count(F.when(by_text, 1)).alias("n_texts"), kept.alias("n_clean"), F.least(kept, F.lit(n).cast("bigint")).alias("n_selected")
    )


def drawn_then_ranked(df: DataFrame, group: list[str], key: str, score: str, n_random: int, n_ranked: int, seed: str) -> DataFrame:
    """Two disjoint sets a group: a random draw first, then the top by score of the rest. Adds ``set_name`` and ``index``."""
    draw = F.row_number().over(Window.partitionBy(*group).orderBy(hash01(seed, *group, key), key))
    rows = df.withColumn("_draw", draw)
    chosen = F.col("_draw") <= n_random
    place = F.row_number().over(Window.partitionBy(*group, chosen).orderBy(F.desc_nulls_last(score), key))
    rows = rows.withColumn("_place", place).where(chosen | (F.col("_place") <= n_ranked))
    return rows.withColumn("set_name", F.when(chosen, "random").otherwise("ranked")).withColumn("index", F.when(chosen, F.col("_draw")).otherwise(F.col("_place"))).drop("_draw", "_place")


def extraction_set(df: DataFrame, group: list[str], key: str, prob: str, retained: str, floor: int, cap: int, seed: str) -> DataFrame:
    """Retained rows of a group, sampled down to ``cap``; groups below ``floor`` are filled up from the rest by prob.

    Adds ``extraction_source`` (retained or backfill). A missing probability counts as 0.
    """
    p = F.coalesce(F.col(prob), F.lit(0.0))
    n = F.count(F.when(F.col(retained), 1)).over(Window.partitionBy(*group))
    sampled = F.row_number().over(Window.partitionBy(*group, retained).orderBy(F.when(F.col(retained), hash01(seed, *group, key)).otherwise(-p), key))
    rows = df.withColumn("_n", n).withColumn("_rn", sampled)
    keep = F.when(F.col(retained), F.col("_rn") <= cap).otherwise((F.col("_n") < floor) & (F.col("_rn") <= floor - F.col("_n")))
    return rows.where(keep).withColumn("extraction_source", F.when(F.col(retained), "retained").otherwise("backfill")).drop("_n", "_rn")


def quota_plan(df: DataFrame, group: str, stratum: str, cap: int) -> DataFrame:
    """(group, stratum, n, quota, p): the share to keep of each stratum (null is one) so that a group has about cap rows."""
    n = df.groupBy(group, stratum).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group)
    quota = F.ceil(F.lit(float(cap)) / F.count(F.lit(1)).over(w))
    all_ = F.sum("n").over(w) <= cap
    return n.withColumn("quota", quota).withColumn("p", F.when(all_, 1.0).otherwise(F.least(F.lit(1.0), F.col("quota") / F.col("n"))))


def stratified_sample(df: DataFrame, group: str, stratum: str, key: str, cap: int, seed: str) -> DataFrame:
    """Rows kept with their stratum's probability, decided by a hash of seed, group and key; strata are counted first.

    The plan has one row per group and stratum; it is joined by key, broadcast by size when it is small.
    """
    plan = quota_plan(df, group, stratum, cap).select(F.col(group).alias("_g"), F.col(stratum).alias("_s"), "p")
    met = df.join(plan, (F.col(group).eqNullSafe(F.col("_g"))) & (F.col(stratum).eqNullSafe(F.col("_s"))))
    return met.where(hash01(seed, group, key) < F.col("p")).drop("_g", "_s", "p")


def split_by_key(df: DataFrame, key: str, seed: str, train: float = 0.8, dev: float = 0.1) -> DataFrame:
    """Adds ``split``; rows of one key share it. Keys are ranked by a hash and cut at whole numbers.

    Ranks come from per-bucket counts and ranks within 256 hash buckets, so that no task holds all keys.
    """
    keys = df.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_h", hash01(seed, key)).withColumn("_b", F.floor(F.col("_h") * 256))
    counts = keys.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(F.lit(1)).orderBy("_b")
    starts = counts.select("_b", (F.sum("_n").over(w) - F.col("_n")).alias("_start"), F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("_all"))  # at most 256 rows
    rank = F.col("_start") + F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    ranked = keys.join(F.broadcast(starts), "_b").withColumn("_r", rank)
    name = F.when(F.col("_r") <= F.floor(F.col("_all") * train), "train").when(F.col("_r") <= F.floor(F.col("_all") * train) + F.floor(F.col("_all") * dev), "dev").otherwise("test")
    return df.join(ranked.select(key, name.alias("split")), key)


def without_leaks(df: DataFrame, text: str, held_out: DataFrame, held_text: str) -> DataFrame:
    """Rows whose normalised text occurs in no held-out row."""
    out = held_out.select(squeeze(held_text).alias("_norm")).where("_norm <> ''").distinct()
    return df.withColumn("_norm", squeeze(text)).join(out, "_norm", "left_anti").drop("_norm")


def merge_new_over_old(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, and old rows whose keys have no new one."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def expect_none(df: DataFrame, what: str, limit: int = 5) -> None:
    """Fails with a few examples if df has rows: completeness and integrity checks before anything is written."""
    found = df.take(limit)
    if found:
        raise ValueError(f"{what}: {', '.join(str(r.asDict()) for r in found)}")


def singletons_dropped(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """Rows of outer groups that hold at least two inner ones."""
    many = df.select(outer, inner).distinct().groupBy(outer).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2").select(outer)
    return df.join(many, outer, "left_semi")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
