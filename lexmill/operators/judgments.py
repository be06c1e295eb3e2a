"""Frozen pools, judgments of several raters, derived views, soft labels and checks before they are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexmill.functions.text import blank_to_null, strip
from lexmill.operators.selecting import first_per, hash01

FOLK, INCIDENTAL, OFF = LABELS = ("folk_description", "incidental_mention", "off_topic")


def rater_id(c: str) -> Column:
    return F.replace(strip(c), F.lit(":"), F.lit("-"))


def rater_type(c: str) -> Column:
    return F.when(F.startswith(rater_id(c), F.lit("human")), "human").when(F.startswith(rater_id(c), F.lit("llm")), "llm").otherwise("other")


def label_of(c: str) -> Column:
    return F.translate(F.lower(strip(c)), " -", "__")


def hits(df: DataFrame) -> DataFrame:
    """Judgement rows with clean ids: seq, uid, passage_id, text, source, seed_id, score (NaN is null), label, code, rater, judged_at."""
    return df.select(
        F.col("row_id").alias("seq"), "set_name", "uid", "passage_id", "text", F.lower(blank_to_null("source")).alias("source"), blank_to_null("seed_id").alias("seed_id"), F.when(~F.isnan("hybrid_score"), F.col("hybrid_score")).alias("score"),
        label_of("label").alias("label"), F.col("best_ability_code").alias("code"), rater_id("annotator").alias("rater"), rater_type("annotator").alias("rater_type"), "pool_version", "judged_at", "loaded_at",
    )


def latest_votes(rows: DataFrame) -> DataFrame:
    """One valid vote per (uid, passage, rater): the latest; later rows of the same time lose to the greater label and code."""
    last = first_per(rows, ["uid", "passage_id", "rater"], F.desc("judged_at"), F.desc("label"), F.desc_nulls_last("code"))
    return last.where(F.col("label").isin(*LABELS))


def lean_rows(pool: DataFrame, judgments: DataFrame) -> DataFrame:
    """Judgments of pool items only, the first rater by name per item: the derived view. Orphans are left out."""
    met = judgments.join(pool.select("uid", "passage_id"), ["uid", "passage_id"], "left_semi")
    return first_per(met, ["uid", "passage_id"], F.asc("rater"), F.asc("seq"))


def orphans(pool: DataFrame, judgments: DataFrame) -> DataFrame:
    return judgments.join(pool.select("uid", "passage_id"), ["uid", "passage_id"], "left_anti")


def unjudged(pool: DataFrame, judgments: DataFrame, rater: str | None = None) -> DataFrame:
    """Pool items without a judgment by anyone, or by one rater."""
    done = judgments if rater is None else judgments.where(F.col("rater") == rater)
    return pool.join(done.select("uid", "passage_id").distinct(), ["uid", "passage_id"], "left_anti")


def judged_by_all(votes: DataFrame, raters: list[str]) -> DataFrame:
    """Items that every one of ``raters`` has voted on."""
    some = votes.where(F.col("rater").isin(*raters))
    return some.groupBy("uid", "passage_id").agg(F.count_distinct("rater").alias("n_raters")).where(F.col("n_raters") == len(raters)).select("uid", "passage_id")


def rater_pairs(votes: DataFrame, a: str, b: str) -> DataFrame:
    """(uid, passage_id, label_a, label_b) of the items both have voted on; one aggregation instead of a self-join."""
    of = lambda r: F.max(F.when(F.col("rater") == r, F.col("label")))
    both = votes.where(F.col("rater").isin(a, b)).groupBy("uid", "passage_id").agg(of(a).alias("label_a"), of(b).alias("label_b"))
    return both.where("label_a IS NOT NULL AND label_b IS NOT NULL")


def coverage(votes: DataFrame) -> DataFrame:
    """(uid, rater, n, prev, inc, off, nb, folk_any); a missing code counts as the pool's own ability here."""
    own = F.col("code").isNull() | (F.col("code") == F.col("uid"))
    folk = F.col("label") == FOLK
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return votes.groupBy("uid", "rater").agg(
        F.count(F.lit(1)).alias("n"), share(folk & own).alias("prev"), share(F.col("label") == INCIDENTAL).alias("inc"), share(F.col("label") == OFF).alias("off"), share(folk & ~own).alias("nb"), share(folk).alias("folk_any")
    )


def tier_of(c: Column) -> Column:
    return F.when(c >= 0.10, "high").when(c > 0, "sparse").otherwise("none")


def coverage_mean(votes: DataFrame) -> DataFrame:
    """(uid, n_raters, prev, inc, off, nb, tier): means over raters, as each rater counts once."""
    means = coverage(votes).groupBy("uid").agg(F.count(F.lit(1)).alias("n_raters"), *(F.avg(c).alias(c) for c in ("prev", "inc", "off", "nb")))
    return means.withColumn("tier", tier_of(F.col("prev")))


def coverage_rollup(votes: DataFrame) -> DataFrame:
    """(level, name, n_abilities, prev): means by stratum, by tier, and over all, in one pass."""
    m = coverage_mean(votes).withColumn("broad", F.split_part("uid", F.lit("-"), F.lit(1)))
    m.createOrReplaceTempView("_lexmill_coverage")
    return m.sparkSession.sql(
        """SELECT CASE WHEN grouping(broad) = 0 THEN 'stratum' WHEN grouping(tier) = 0 THEN 'tier' ELSE 'all' END AS level,
        coalesce(broad, tier, 'all') AS name, count(*) AS n_abilities, avg(prev) AS prev FROM _lexmill_coverage GROUP BY GROUPING SETS ((broad), (tier), ())"""
    )


def soft_labels(votes: DataFrame, anchor: str = "uid") -> DataFrame:
    """(uid, passage_id, n_raters, p_folk, p_inc, p_off, label): mean votes relative to the pool's ability.

    A folk description of another ability is off topic for this one. Ties of the largest: folk, incidental, off.
    """
    own = (F.col("label") == FOLK) & (F.col("code") == F.col(anchor))
    inc = F.col("label") == INCIDENTAL
    share = lambda c: F.avg(F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0))
    s = votes.groupBy("uid", "passage_id").agg(F.count(F.lit(1)).alias("n_raters"), share(own).alias("p_folk"), share(inc).alias("p_inc"), share(~F.coalesce(own | inc, F.lit(False))).alias("p_off"))
    top = F.greatest("p_folk", "p_inc", "p_off") - 1e-12
    return s.withColumn("label", F.when(F.col("p_folk") >= top, FOLK).when(F.col("p_inc") >= top, INCIDENTAL).otherwise(OFF))


def class_weights(df: DataFrame, label: str, classes: tuple[str, ...] = LABELS) -> DataFrame:
    """(label, n, weight): total / (classes * n), 1 for an empty class."""
    n = [F.count(F.when(F.col(label) == c, 1)).alias(f"_{k}") for k, c in enumerate(classes)]
    row = df.agg(*n)
    total = sum(F.col(f"_{k}") for k in range(len(classes)))
    each = F.array(*(F.struct(F.lit(c).alias("label"), F.col(f"_{k}").alias("n"), F.coalesce(total / F.nullif(len(classes) * F.col(f"_{k}"), F.lit(0)), F.lit(1.0)).alias("weight")) for k, c in enumerate(classes)))
    return row.select(F.inline(each))


def off_topic_capped(soft: DataFrame, ratio: float, seed: str) -> DataFrame:
    """All rows but the unanimously off-topic ones, and of those at most round(ratio * number of incidental ones).

    Kept are those of the smallest hash; the cut is found from counts per hash bucket, no task ranks all rows.
    """
    rows = soft.withColumn("_h", hash01(seed, "uid", "passage_id")).withColumn("_u", F.col("p_off") >= 1 - 1e-12)
    quota = rows.agg(F.round(F.count(F.when(F.col("label") == INCIDENTAL, 1)) * ratio).alias("_quota"))
    bucket = F.floor(F.col("_h") * 1024)
    counts = rows.where("_u").groupBy(bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(F.lit(1)).orderBy("_b")
    before = counts.withColumn("_before", F.sum("_n").over(w) - F.col("_n")).crossJoin(F.broadcast(quota))  # at most 1024 rows
    met = rows.withColumn("_b", F.when(F.col("_u"), bucket)).join(F.broadcast(before), "_b", "left")
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_b", "_u").orderBy("_h", "uid", "passage_id"))
    # Rows of buckets wholly within the quota need no rank; it is taken anyway, per bucket.
    kept = met.where("_u").withColumn("_r", rank).where("_r <= _quota")
    return met.where("NOT _u").drop("_b", "_n", "_before", "_quota").unionByName(kept.drop("_b", "_n", "_before", "_quota", "_r")).drop("_h", "_u")


def reanchored(soft: DataFrame, abilities: DataFrame, seed: str) -> DataFrame:
    """(uid, passage_id, anchor): each folk passage with another ability as anchor, of its own stratum if there is one.

    Abilities are a small dimension (one row each); the choice is by hash, the same on every run.
    """
    a = abilities.select(F.col("uid").alias("anchor"), F.col("broad_stratum").alias("_ab"))
    near = a.groupBy(F.col("_ab").alias("_b")).agg(F.sort_array(F.collect_list("anchor")).alias("_near"))
    far = a.agg(F.sort_array(F.collect_list("anchor")).alias("_far"))
    rows = soft.where(F.col("label") == FOLK).select("uid", "passage_id", F.split_part("uid", F.lit("-"), F.lit(1)).alias("_b"))
    met = rows.join(F.broadcast(near), "_b", "left").crossJoin(F.broadcast(far))
    others = F.filter("_near", lambda x: x != F.col("uid"))
    pool = F.when(F.size(F.coalesce(others, F.array())) > 0, others).otherwise(F.filter("_far", lambda x: x != F.col("uid")))
    at = F.floor(hash01(seed, "uid", "passage_id") * F.size("_pool")).cast("int")
    return met.withColumn("_pool", pool).where(F.size("_pool") > 0).select("uid", "passage_id", F.get("_pool", at).alias("anchor"))


def label_file_errors(pool: DataFrame, labels: DataFrame, abilities: DataFrame, gaps_only: bool = False) -> DataFrame:
    """(uid, passage_id, error): missing, extra, bad label, folk without ability, unknown ability. Empty if it may be applied."""
    key = ["uid", "passage_id"]
    known = abilities.select(F.col("uid").alias("code")).distinct()
    bad = lambda df, e: df.select(*key, F.lit(e).alias("error"))
    out = bad(labels.join(pool, key, "left_anti"), "extra").unionByName(bad(labels.where(~F.coalesce(F.col("label").isin(*LABELS), F.lit(False))), "bad label"))
    folk = labels.where(F.col("label") == FOLK)
    out = out.unionByName(bad(folk.where("code IS NULL"), "folk without ability")).unionByName(bad(folk.where("code IS NOT NULL").join(known, "code", "left_anti"), "unknown ability"))
    return out if gaps_only else out.unionByName(bad(pool.join(labels, key, "left_anti"), "missing"))
