"""Extractions from passages: cleaning loosely typed answers, rendering batches, progress, reports on clusters and pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexmill.functions.text import strip
from lexmill.operators.selecting import expect_none, first_per
from lexmill.operators.vectors import mean_vector, unit

# What the enumerated fields may hold, the first being the default.
CONSTRUAL = ("other", "store", "operation")
TONE = ("neutral", "positive", "negative")


def one_of(c: Column, allowed: tuple[str, ...]) -> Column:
    v = F.lower(strip(c))
    return F.when(v.isin(*allowed), v).otherwise(allowed[0])


def coerced(df: DataFrame, raw: str) -> DataFrame:
    """Adds spans, construal, tone, schema_name, on_target, error from a JSON text.

    Spans may be strings or {text, pos}; blank ones are dropped. Unknown enum values take the default, blank
    names are null. What is no JSON object has error ``unreadable`` and no spans.
    """
    j = F.try_parse_json(raw)
    df = df.withColumn("_j", j)
    items = F.from_json(F.get_json_object(raw, "$.spans"), "array<string>")
    text = F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda s: F.struct(strip(F.coalesce(F.get_json_object(s, "$.text"), s)).alias("text"), F.get_json_object(s, "$.pos").alias("pos")))
    object_ = F.coalesce(F.col("_j").isNotNull() & F.startswith(F.ltrim(raw), F.lit("{")), F.lit(False))
    return df.select(
        *(c for c in df.columns if c != "_j"),
        F.when(object_, F.filter(text, lambda s: s["text"] != "")).otherwise(F.array().cast("array<struct<text:string,pos:string>>")).alias("spans"),
        one_of(F.get_json_object(raw, "$.construal"), CONSTRUAL).alias("construal"),
        one_of(F.get_json_object(raw, "$.evaluative.tone"), TONE).alias("tone"),
        F.nullif(strip(F.get_json_object(raw, "$.conceptual_schema")), F.lit("")).alias("schema_name"),
        F.coalesce(F.lower(F.get_json_object(raw, "$.on_target")) == "true", F.lit(False)).alias("on_target"),
        F.when(~object_, "unreadable").alias("error"),
    )


def batches(df: DataFrame, group: str, order: list[str], size: int) -> DataFrame:
    """Adds ``batch``: rows of a group in order, ``size`` to a batch."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("batch", F.floor((rank - 1) / size))


def rendered(df: DataFrame, group: str, index: str, text: str, limit: int) -> DataFrame:
    """(group, prompt): the first ``limit`` rows of a group as lines of index, tab and text on one line."""
    line = F.concat_ws("\t", F.col(index).cast("string"), F.regexp_replace(text, r"\s+", " "))
    some = df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(index))).where(F.col("_r") <= limit)
    lines = F.transform(F.sort_array(F.collect_list(F.struct("_r", line.alias("_l")))), lambda s: s["_l"])
    return some.groupBy(group).agg(F.array_join(lines, "\n").alias("prompt"))


def progress(expected: DataFrame, done: DataFrame, group: str, key: str) -> DataFrame:
    """(group, n_expected, n_done, n_stale, status): done, partial, missing, or stale where results are of no expected key."""
    e, d = expected.select(group, key).distinct().withColumn("_e", F.lit(1)), done.select(group, key).distinct().withColumn("_d", F.lit(1))
    m = e.join(d, [group, key], "full").groupBy(group).agg(F.count("_e").alias("n_expected"), F.count(F.when(F.col("_e").isNotNull(), F.col("_d"))).alias("n_done"), F.count(F.when(F.col("_e").isNull(), 1)).alias("n_stale"))
    status = F.when(F.col("n_stale") > 0, "stale").when(F.col("n_done") == F.col("n_expected"), "done").when(F.col("n_done") == 0, "missing").otherwise("partial")
    return m.withColumn("status", status)


def merged_manifests(manifests: DataFrame, source: str, *order: Column) -> DataFrame:
    """Records with status ok, the first per source under ``order``."""
    return first_per(manifests.where("scan_status = 'ok'"), [source], *order)


def complete_sources(*counts: DataFrame) -> DataFrame:
    """(source, n): sources that all tables of (source, n) have, with the same n."""
    both = counts[0].select("source", "n")
    for c in counts[1:]:
        both = both.join(c.select("source", "n"), ["source", "n"], "left_semi")
    return both


def source_subset(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows of the named sources; fails on a name no row has."""
    wanted = df.sparkSession.createDataFrame([(n,) for n in names], "source string")
    expect_none(wanted.join(df.select("source").distinct(), "source", "left_anti"), "unknown sources")
    return df.where(F.col("source").isin(*names))


def cluster_rollup(members: DataFrame, group: str, cluster: str, surface: str, key: str) -> DataFrame:
    """(group, cluster, n, share, label): size and share of each cluster and its most frequent surface form (ties: the smaller)."""
    forms = members.groupBy(group, cluster, surface).agg(F.count(F.lit(1)).alias("_f"))
    best = forms.groupBy(group, cluster).agg(F.sum("_f").alias("n"), F.min(F.struct(-F.col("_f"), surface)).alias("_b"))
    return best.select(group, cluster, "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(group)), 6).alias("share"), F.col(f"_b.{surface}").alias("label"))


def prevalence(retained: Column, pool: Column, on_target: Column) -> Column:
    """Estimated share of a corpus: retained part times on-target rate, 4 digits, null without a pool."""
    return F.round(retained / F.nullif(pool, F.lit(0)) * on_target, 4)


def pair_cells(pairs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(cell, n) of pairs (edges, null_mean, q): collapse, separate or between."""
    cell = F.when(F.col("q") < alpha, "collapse").when(F.col("edges") <= F.col("null_mean"), "separate").otherwise("between")
    return pairs.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))


def support_split(scores: DataFrame, support: DataFrame, key: str, cap: int) -> DataFrame:
    """(supported, n, mean): mean score of keys with at least ``cap`` rows of support, of those with fewer, and of those with none."""
    n = support.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    level = F.when(F.col("_n") >= cap, "full").when(F.col("_n").isNotNull(), "thin").otherwise("none")
    return scores.join(n, key, "left").groupBy(level.alias("supported")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"))


def centred(df: DataFrame, vector: str, by: str) -> DataFrame:
    """Vectors less the mean of their ``by`` group, scaled to length 1. One mean a group meets its rows in a join."""
    m = mean_vector(df, vector, by).select(by, F.col("vector").alias("_m"))
    return df.join(m, by).withColumn(vector, F.zip_with(vector, "_m", lambda x, y: x - y)).drop("_m").withColumn(vector, unit(vector))


def checked_instrument(registry: DataFrame, name: str, version: str, text: str) -> str:
    """The hash of an instrument's text; fails if the registry (name, version, sha256) knows another for the version."""
    import hashlib

    digest = hashlib.sha256(text.encode()).hexdigest()
    expect_none(registry.where((F.col("name") == name) & (F.col("version") == version) & (F.col("sha256") != digest)), "changed text under the same version")
    return digest
