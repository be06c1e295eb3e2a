"""Vector operators of retrieval and structure tests: top-k, hybrid scores, debiasing, neighbour graphs, clusters."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lexmill.runtime import cut


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: str) -> Column:
    """Scaled to length 1; an all-zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: x / F.when(n > 0, n).otherwise(1.0))


def mean_vector(df: DataFrame, vector: str, *by: str) -> DataFrame:
    """(by..., n, vector): mean per dimension. Vectors go out as rows of (dimension, value), combined before the shuffle."""
    parts = df.where(F.col(vector).isNotNull()).select(*by, F.posexplode(vector).alias("_d", "_x")).groupBy(*by, "_d").agg(F.avg("_x").alias("_m"), F.count(F.lit(1)).alias("n"))
    return parts.groupBy(*by).agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("_d", "_m"))), lambda s: s["_m"]).alias("vector"))


def block_top_k(queries: DataFrame, rows: DataFrame, k: int, apart: bool = False, by: str | None = None, block: int = 8192) -> DataFrame:
    """(query, id, score): per query (and value of ``by`` of the rows) the k rows of the highest inner product.

    Both sides have columns id and v; with ``apart`` also p, and pairs of the same p (or id) are left out. Both sides
    are cut into blocks whose sizes are counted first; each pair of blocks is a matrix product in one task, whose
    best k are merged by rank. Ties go to the smaller id. Fewer than k come out where there are no more.
    """
    # New names for the columns: both sides may come from one table.
    fresh = lambda df, cols: df.select(*(F.col(c).alias(c) for c in cols))
    q = fresh(queries, ["id", "v", *(["p"] if apart else [])])
    r = fresh(rows, ["id", "v", *(["p"] if apart else []), *([by] if by else [])])
    q, r = cut(q), cut(r)
    nq, nr = (max(1, math.ceil(x.count() / block)) for x in (q, r))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    qs = q.withColumn("_qb", F.pmod(F.hash("id"), F.lit(nq))).withColumn("_rb", spread(nr))
    rs = r.withColumn("_rb", F.pmod(F.hash("id"), F.lit(nr))).withColumn("_qb", spread(nq))
    kind, rkind = dict(q.dtypes)["id"], dict(r.dtypes)["id"]
    extra = f", {by} {dict(r.dtypes)[by]}" if by else ""

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            b = b.sort_values("id", ignore_index=True)
            y = np.array(b["v"].tolist(), dtype=np.float64)
            groups = [(None, np.arange(len(b)))] if by is None else [(g, ix.to_numpy()) for g, ix in pd.Series(np.arange(len(b))).groupby(b[by].to_numpy())]
            for lo in range(0, len(a), 256):
                part = a.iloc[lo : lo + 256]
                s = np.array(part["v"].tolist(), dtype=np.float64) @ y.T
                if apart:
                    s[(part["p"].to_numpy()[:, None] == b["p"].to_numpy()) | (part["id"].to_numpy()[:, None] == b["id"].to_numpy())] = -np.inf
                for g, ix in groups:
                    sub = s[:, ix]
                    order = np.argsort(-np.round(sub, 9), axis=1, kind="stable")[:, :k]
                    val = np.take_along_axis(sub, order, axis=1)
                    ok = np.isfinite(val)
                    at = np.nonzero(ok)
                    f = pd.DataFrame({"query": part["id"].to_numpy()[at[0]], "id": b["id"].to_numpy()[ix[order[ok]]], "score": val[ok]})
                    out.append(f.assign(**{by: g}) if by else f)
        cols = ["query", "id", "score", *([by] if by else [])]
        return pd.concat(out)[cols] if out else pd.DataFrame({c: [] for c in cols})

    found = qs.groupBy("_qb", "_rb").cogroup(rs.groupBy("_qb", "_rb")).applyInPandas(meet, f"query {kind}, id {rkind}, score double{extra}")
    w = Window.partitionBy("query", *([by] if by else [])).orderBy(F.desc(F.round("score", 9)), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def sparse_dot(a: str, b: str) -> Column:
    """Sum of products over the keys two maps share."""
    return F.aggregate(F.map_keys(a), F.lit(0.0), lambda s, k: s + F.col(a)[k] * F.coalesce(F.col(b)[k], F.lit(0.0)))


def hybrid(dense: Column, sparse: Column, alpha: float) -> Column:
    return F.round((1 - alpha) * dense + alpha * sparse, 6)


def hashed_encoder(width: int = 64):
    """A stand-in for a neural encoder: signed hashing of words into ``width`` numbers, length 1. For mapInPandas-free use."""

    @F.pandas_udf("array<float>")
    def encode(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            v = np.zeros(width)
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode("utf-8", "replace"))
                v[h % width] += 1 if h >> 31 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype(np.float32).tolist())
        return pd.Series(out)

    return encode


def debias(queries: DataFrame, vector: str, axes: int = 2, most: int = 100_000) -> DataFrame:
    """Query vectors less the mean and the first principal axes of all queries, scaled to length 1.

    The covariance (width x width) is summed per partition and added up; queries themselves stay distributed.
    """

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, c = 0, None, None
        for pdf in batches:
            if len(pdf):
                x = np.array(pdf[vector].tolist(), dtype=np.float64)
                n += len(x)
                s = x.sum(axis=0) if s is None else s + x.sum(axis=0)
                c = x.T @ x if c is None else c + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "c": [c.ravel().tolist()]})

    parts = queries.where(F.col(vector).isNotNull()).select(vector).mapInPandas(moments, "n bigint, s array<double>, c array<double>").collect()  # one row a partition, width squared numbers
    if not parts:
        return queries
    n, s, c = sum(p["n"] for p in parts), np.sum([p["s"] for p in parts], axis=0), np.sum([p["c"] for p in parts], axis=0)
    m = s / n
    _, vectors = np.linalg.eigh(c.reshape(len(m), -1) / n - np.outer(m, m))
    top = vectors[:, ::-1][:, :axes]

    @F.pandas_udf("array<double>")
    def turn(col: pd.Series) -> pd.Series:
        x = np.array([m if v is None else v for v in col], dtype=np.float64) - m  # what is null stays null below
        x -= (x @ top) @ top.T
        length = np.linalg.norm(x, axis=1, keepdims=True)
        return pd.Series((x / np.where(length > 0, length, 1)).tolist())

    return queries.withColumn(vector, F.when(F.col(vector).isNotNull(), turn(vector)))


def leader_clusters(df: DataFrame, group: str, key: str, vector: str, priority: str, threshold: float = 0.8) -> DataFrame:
    """(group, key, leader): greedy clusters; in order of priority, a row joins the first leader it is as near as ``threshold`` to.

    Sequential by definition, so one task holds one group; meant for groups of at most some 100,000 rows.
    """
    schema = f"{group} {dict(df.dtypes)[group]}, {key} {dict(df.dtypes)[key]}, leader {dict(df.dtypes)[key]}"

    def lead(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([priority, key], ascending=[False, True], ignore_index=True)
        x = np.array(pdf[vector].tolist(), dtype=np.float64)
        length = np.linalg.norm(x, axis=1, keepdims=True)
        x /= np.where(length > 0, length, 1)
        at, free = np.full(len(x), -1), np.ones(len(x), dtype=bool)
        for k in range(len(x)):
            if free[k]:
                near = free & (x @ x[k] >= threshold)
                near[k] = True
                at[near], free = k, free & ~near
        ids = pdf[key].to_numpy()
        return pd.DataFrame({group: pdf[group], key: ids, "leader": ids[at]})

    return df.where(F.col(vector).isNotNull()).select(group, key, vector, priority).groupBy(group).applyInPandas(lead, schema)


def neighbour_purity(neighbours: DataFrame, labels: DataFrame, node: str, label: str) -> DataFrame:
    """(n, purity, chance): share of neighbours of the same label, and what chance alone would give."""
    a = labels.select(F.col(node).alias("query"), F.col(label).alias("_a"))
    b = labels.select(F.col(node).alias("id"), F.col(label).alias("_b"))
    seen = neighbours.join(a, "query").join(b, "id").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("_a") == F.col("_b")).cast("int")).alias("purity"))
    sizes = labels.groupBy(label).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    chance = sizes.agg((F.sum(F.col("_n") * (F.col("_n") - 1)) / (F.sum("_n") * (F.sum("_n") - 1))).alias("chance"))
    return seen.crossJoin(F.broadcast(chance))  # single rows


def cross_edges(neighbours: DataFrame, labels: DataFrame, node: str, label: str) -> DataFrame:
    """(a, b, edges): neighbour edges between labels a < b, both directions together."""
    x = labels.select(F.col(node).alias("query"), F.col(label).alias("_a"))
    y = labels.select(F.col(node).alias("id"), F.col(label).alias("_b"))
    met = neighbours.join(x, "query").join(y, "id").where(F.col("_a") != F.col("_b"))
    return met.groupBy(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).agg(F.count(F.lit(1)).alias("edges"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, ari) of two labellings, from their contingency table."""
    two = lambda n: n * (n - 1) / 2
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    rows = cells.groupBy(a).agg(F.sum("_n").alias("_r")).agg(F.sum(two(F.col("_r"))).alias("_sa"))
    cols = cells.groupBy(b).agg(F.sum("_n").alias("_r")).agg(F.sum(two(F.col("_r"))).alias("_sb"))
    s = cells.agg(F.sum("_n").alias("n"), F.sum(two(F.col("_n"))).alias("_s")).crossJoin(F.broadcast(rows)).crossJoin(F.broadcast(cols))  # single rows
    e = F.col("_sa") * F.col("_sb") / two(F.col("n"))
    top = (F.col("_sa") + F.col("_sb")) / 2
    return s.select(F.col("n").cast("bigint").alias("n"), F.when(top != e, (F.col("_s") - e) / (top - e)).otherwise(1.0).alias("ari"))


def kmeans_labels(df: DataFrame, key: str, vector: str, k: int, seeds: int = 3) -> DataFrame:
    """(key, cluster): k-means (parallel initialisation) of the lowest cost over ``seeds`` starts."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = cut(df.where(F.col(vector).isNotNull()).select(key, array_to_vector(F.col(vector)).alias("features")))
    models = [KMeans(k=k, seed=s, maxIter=30).fit(data) for s in range(seeds)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(data).select(key, F.col("prediction").alias("cluster"))


def ellipse(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """(by..., n, cx, cy, major, minor, angle): centre and axes of the covariance of points; groups below 3 give none."""
    s = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.var_samp(x).alias("_a"), F.var_samp(y).alias("_d"), F.covar_samp(x, y).alias("_b")).where("n >= 3")
    mid, off = (F.col("_a") + F.col("_d")) / 2, F.sqrt(((F.col("_a") - F.col("_d")) / 2) ** 2 + F.col("_b") ** 2)
    return s.select(*by, "n", "cx", "cy", F.sqrt(mid + off).alias("major"), F.sqrt(F.greatest(mid - off, F.lit(0.0))).alias("minor"), (0.5 * F.atan2(2 * F.col("_b"), F.col("_a") - F.col("_d"))).alias("angle"))


def prototypes(df: DataFrame, group: str, vector: str, weight: str) -> DataFrame:
    """(group, vector): weighted mean, uniform where weights sum to nothing, length 1."""
    total = F.sum(weight).over(Window.partitionBy(group))
    w = df.where(F.col(vector).isNotNull()).withColumn("_w", F.when(total > 0, F.col(weight)).otherwise(1.0))
    parts = w.select(group, "_w", F.posexplode(vector).alias("_d", "_x")).groupBy(group, "_d").agg((F.sum(F.col("_w") * F.col("_x")) / F.sum("_w")).alias("_m"))
    mean = parts.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("_d", "_m"))), lambda s: s["_m"]).alias("vector"))
    return mean.withColumn("vector", unit("vector"))


def blended(df: DataFrame, group: str, vector: str, protos: DataFrame, alpha: float) -> DataFrame:
    """Vectors moved towards their group's prototype, length 1; groups without one unchanged."""
    p = protos.select(group, F.col("vector").alias("_p"))
    mixed = F.zip_with(vector, "_p", lambda v, q: alpha * q + (1 - alpha) * v)
    return df.join(p, group, "left").withColumn("_m", mixed).withColumn(vector, F.when(F.col("_p").isNotNull(), unit("_m")).otherwise(F.col(vector).cast("array<double>"))).drop("_p", "_m")
