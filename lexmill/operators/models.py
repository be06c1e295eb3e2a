"""Pair classifier over (anchor, target) texts, ensembles, and fingerprints of groups."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from lexmill.functions.text import content_tokens
from lexmill.operators.selecting import hash01


def anchors(seeds: DataFrame, per: int, draws: int, base: str) -> DataFrame:
    """(uid, draw, anchor): the ability's name and ``per`` of its seeds, chosen anew for each draw by hash."""
    many = seeds.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    w = Window.partitionBy("ability_code", "draw").orderBy(hash01(base, "draw", "seed_id"), "seed_id")
    some = many.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per)
    return some.groupBy(F.col("ability_code").alias("uid"), "draw").agg(F.concat_ws(" [SEP] ", F.min("ability_name"), F.array_sort(F.collect_list("text"))).alias("anchor"))


def pair_features(df: DataFrame, anchor: str, target: str) -> DataFrame:
    """Adds ``tokens``: target words, and words that anchor and target share."""
    shared = F.transform(F.array_intersect(content_tokens(anchor), content_tokens(target)), lambda w: F.concat(F.lit("&"), w))
    return df.withColumn("tokens", F.concat(content_tokens(target), shared, F.array(F.concat(F.lit("#"), F.size(shared).cast("string")))))


def fit_classifier(rows: DataFrame, label: str, weight: str, features: int = 1 << 14) -> PipelineModel:
    """Weighted multinomial logistic regression on hashed pair features (column tokens)."""
    steps = [HashingTF(inputCol="tokens", outputCol="features", numFeatures=features), LogisticRegression(labelCol=label, weightCol=weight, maxIter=20, regParam=0.01)]
    return Pipeline(stages=steps).fit(rows)


def soft_rows(soft: DataFrame, names: list[str]) -> DataFrame:
    """Each soft-labelled row once per class that has mass, weighted by it: how a hard learner takes soft targets."""
    each = F.array(*(F.struct(F.lit(float(k)).alias("y"), F.col(n).alias("mass")) for k, n in enumerate(names)))
    return soft.select("*", F.inline(F.filter(each, lambda s: s["mass"] > 0)))


def score_pairs(models: list[PipelineModel], rows: DataFrame, keys: list[str], of: int = 0) -> DataFrame:
    """(keys..., prob, n_scores): probability of class ``of``, averaged over models and over repeated anchors of a key."""
    scored = [m.transform(rows).select(*keys, vector_to_array("probability")[of].alias("_p")) for m in models]
    both = scored[0]
    for s in scored[1:]:
        both = both.unionByName(s)
    return both.groupBy(*keys).agg(F.avg("_p").alias("prob"), F.count(F.lit(1)).alias("n_scores"))


def fingerprint(clusters: DataFrame, lexical: DataFrame, shares: DataFrame) -> DataFrame:
    """(uid, json): one document a group of its lexical profile, its clusters and its distribution of labels.

    clusters: (uid, cluster, n); lexical: (uid, term, n, lift, rank); shares: (uid, label, share).
    Lists are short by construction: ranks are cut before they are gathered.
    """
    place = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("n"), "cluster"))
    c = clusters.withColumn("_r", place).where("_r <= 12").groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("_r", "cluster", "n"))).alias("clusters"))
    x = lexical.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("rank", "term", "lift"))).alias("lexical"))
    d = shares.groupBy("uid").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "share")))).alias("labels"))
    return x.join(c, "uid", "full").join(d, "uid", "full").select("uid", F.to_json(F.struct("lexical", "clusters", "labels")).alias("json"))
