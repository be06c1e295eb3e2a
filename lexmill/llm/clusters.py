"""Grouping vectors into clusters of mutually similar members by power-iteration spectral clustering."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lexmill.llm.vectors import directions, quantise, unit_rows
from lexmill.runtime import cut

TILE = 1024
AXES = 3


def _blocks(rows: DataFrame, sizes: DataFrame, group: str, block: int) -> DataFrame:
    """rows, each once for every pair of blocks (i <= j) of its group that it takes part in; _own is its block."""
    n = F.ceil(F.col("_n") / block).cast("int")
    return (
        rows.join(sizes.select(group, n.alias("_blocks")), group)
        .withColumn("_own", F.pmod(F.xxhash64("_id"), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumn("_i", F.least("_own", "_other"))
        .withColumn("_j", F.greatest("_own", "_other"))
        .drop("_other", "_blocks")
    )


def _walk(pdf: pd.DataFrame, product: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], use: Callable) -> None:
    """Calls use(a, b, about, high) for tiles of a block pair, so that all b of an a come in one call."""
    own, i, j = pdf["_own"].to_numpy(), pdf["_i"].iat[0], pdf["_j"].iat[0]
    left, right = (own == i).nonzero()[0], (own == j).nonzero()[0]
    for x, y in ((left, right), (right, left))[: 1 + (i != j)]:
        for lo in range(0, len(x), TILE // 4):
            a = x[lo : lo + TILE // 4]
            use(a, y, *product(a, y))


def _strong(cosine: float, top: int, kind: str) -> tuple[Callable, str]:
    """Per row of a block pair: how many may reach ``cosine``, its ``top`` strongest such and the one of the smallest id."""

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_id", ignore_index=True)
        q = np.frombuffer(b"".join(pdf["q"]), dtype=np.int8).reshape(len(pdf), -1).astype(np.float32) * pdf["s"].to_numpy()[:, None]
        e, ids = pdf["e"].to_numpy(), pdf["_id"].to_numpy()
        out = []

        def product(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            about = q[a] @ q[b].T
            return about, about + 1.01 * (e[a][:, None] + e[b]) + 1e-4

        def use(a: np.ndarray, b: np.ndarray, about: np.ndarray, high: np.ndarray) -> None:
            near = high >= cosine
            near[a[:, None] == b] = False
            degree = near.sum(axis=1)
            some = degree.nonzero()[0]
            if not len(some):
                return
            near, about, a = near[some], np.where(near[some], about[some], -1).astype(np.float32), a[some]
            m = min(top, about.shape[1])
            best = np.argpartition(-about, m - 1, axis=1)[:, :m]
            rows = np.arange(len(a))
            for k in range(m):
                w = about[rows, best[:, k]]
                ok = w > -1
                out.append((ids[a][ok], ids[b[best[:, k]]][ok], w[ok], (degree[some] * (k == 0))[ok]))
            least = near.argmax(axis=1)  # b lies in order of id
            out.append((ids[a], ids[b[least]], about[rows, least], degree[some] * 0))
            # argpartition leaves no order: the degree rides on the first row kept, so give it a row of its own where that was cut
            lost = about[rows, best[:, 0]] <= -1
            if lost.any():
                out.append((ids[a][lost], ids[b[least]][lost], about[rows, least][lost], degree[some][lost]))

        _walk(pdf, product, use)
        if not out:
            return pd.DataFrame({"_id": ids[:0], "_to": ids[:0], "_w": e[:0], "_degree": np.zeros(0, dtype=np.int64)})
        a, b, w, d = (np.concatenate(c) for c in zip(*out))
        return pd.DataFrame({"_id": a, "_to": b, "_w": w, "_degree": d.astype(np.int64)})

    return meet, f"_id {kind}, _to {kind}, _w float, _degree bigint"


def _degrees(rows: DataFrame, group: str, cosine: float, block: int, kind: str) -> DataFrame:
    """(group, _id, _in, _sum): exactly how many others of its group reach ``cosine`` with a row, and the sum of all its cosines."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        x, out = unit_rows(pdf["_v"]), []

        def product(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, None]:
            return x[a] @ x[b].T, None

        def use(a: np.ndarray, b: np.ndarray, c: np.ndarray, _: None) -> None:
            same = a[:, None] == b
            out.append(pd.DataFrame({"_at": a, "_in": ((c >= cosine) & ~same).sum(axis=1), "_sum": np.where(same, 0.0, c).sum(axis=1)}))

        _walk(pdf, product, use)
        found = pd.concat(out)
        return pd.DataFrame({group: pdf[group].iat[0], "_id": pdf["_id"].to_numpy()[found["_at"]], "_in": found["_in"].astype(np.int64).to_numpy(), "_sum": found["_sum"].to_numpy()})

    gkind = dict(rows.dtypes)[group]
    parts = _blocks(rows.select(group, "_id", "_v"), sizes, group, block).groupBy(group, "_i", "_j").applyInPandas(meet, f"{group} {gkind}, _id {kind}, _in bigint, _sum double")
    return parts.groupBy(group, "_id").agg(F.sum("_in").alias("_in"), F.sum("_sum").alias("_sum"))


def _cliques(near: list[set[int]], least: int) -> list[list[int]]:
    """All maximal cliques of at least ``least`` vertices (pivoted search on the core that can hold them)."""
    alive = set(range(len(near)))
    while low := {v for v in alive if len(near[v] & alive) < least - 1}:
        alive -= low
    found: list[list[int]] = []
    stack = [([], set(alive), set())]
    while stack:
        r, p, x = stack.pop()
        if not p and not x:
            if len(r) >= least:
                found.append(sorted(r))
            continue
        if len(r) + len(p) < least:
            continue
        pivot = max(p | x, key=lambda v: len(near[v] & p))
        for v in list(p - near[pivot]):
            stack.append(([*r, v], p & near[v], x & near[v]))
            p = p - {v}
            x = x | {v}
    return found


def similarity_clusters(
    df: DataFrame, key: str, group: str, vector: str, cosine: float = 0.6, min_size: int = 5, top: int = 3, iterations: int = 3, block: int = 8192, salt: int = 11
) -> DataFrame:
    """(group, cluster_id, member, size, affinity, rank): clusters of mutually similar members of one group.

    A cluster is a maximal set of at least ``min_size`` distinct keys of one group, every two of which have a
    cosine of at least ``cosine``; cluster_id is its smallest key. ``affinity`` is a member's mean cosine to the
    others, ``rank`` orders the members by it (1: the most typical; ties: the smaller key). Keys must be
    integers; rows repeated for a key count once; rows with a null key or group, or a vector without a
    direction, belong to no cluster. An empty table gives none.

    Method: int8 tiles of each group's blocks (a group above ``block`` rows is cut, every pair of its blocks
    is a task of its own) give, per row, the number that may reach ``cosine``, its ``top`` strongest
    affinities and that to the smallest such key: a sparse graph of at most top + 1 edges a row. Its
    row-normalised affinities are applied to several vectors by distributed power iteration; started from
    one random point per smallest neighbour. The embedding is clustered by a k-means step in which a row's
    candidates are the centres of its neighbours. An exact check follows: within each cluster all cosines are
    computed in float64 tiles; a cluster is confirmed if all reach ``cosine`` and one of its rows has no other
    partner in the group. The rows for which that does not settle every set they can be in are searched
    for maximal sets exhaustively; exact, but exponential at worst where similarity is not transitive at all.
    """
    kind = dict(df.dtypes)[key]
    rows = directions(df, key, vector, group).select(F.col(f"_{group}").alias("_g"), "_id", "_v")
    rows = cut(rows.where("_g IS NOT NULL"))
    width = rows.agg(F.max(F.size("_v"))).first()[0] or 1  # one number
    rows = rows.where(F.size("_v") == width)

    def pack(batches):
        for pdf in batches:
            if len(pdf):
                q, s, e = quantise(unit_rows(pdf["_v"]))
                yield pdf[["_g", "_id"]].assign(q=[r.tobytes() for r in q], s=s, e=e)

    gkind = dict(rows.dtypes)["_g"]
    packed = rows.mapInPandas(pack, f"_g {gkind}, _id {kind}, q binary, s float, e float")
    sizes = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    meet, schema = _strong(cosine, top, kind)
    raw = _blocks(packed, sizes, "_g", block).groupBy("_g", "_i", "_j").applyInPandas(meet, schema)
    by_id = Window.partitionBy("_id")
    near = (
        raw.withColumn("_rank", F.row_number().over(by_id.orderBy(F.desc("_w"), "_to")))
        .withColumn("_least", F.min("_to").over(by_id))
        .withColumn("_all", F.sum("_degree").over(by_id))
        .where((F.col("_rank") <= top) | (F.col("_to") == F.col("_least")))
        .select("_id", "_to", "_w", "_least", "_all")
    )
    near = cut(near.groupBy("_id", "_to").agg(F.max("_w").alias("_w"), F.first("_least").alias("_least"), F.first("_all").alias("_all")))
    vertices = near.groupBy("_id").agg(F.first("_all").alias("_all"), F.least(F.col("_id"), F.first("_least")).alias("_label"))
    weight = F.greatest(F.col("_w") - cosine, F.lit(0.0)) + 0.02
    edges = near.select("_id", "_to", weight.alias("_w")).union(near.select("_to", "_id", weight)).groupBy("_id", "_to").agg(F.max("_w").alias("_w"))

    def start(axis: int) -> Column:
        return F.pmod(F.xxhash64("_label", F.lit(salt + axis)), F.lit(1 << 20)) / float(1 << 20)

    x = vertices.select("_id", *(start(k).alias(f"_x{k}") for k in range(AXES)))
    edges, x = cut(edges), cut(x)
    for _ in range(iterations):
        sent = edges.join(x.withColumnRenamed("_id", "_to"), "_to")
        got = sent.groupBy("_id").agg(*((F.sum(F.col("_w") * F.col(f"_x{k}")) / F.sum("_w")).alias(f"_y{k}") for k in range(AXES)))
        x = cut(x.join(got, "_id").select("_id", *((0.5 * F.col(f"_x{k}") + 0.5 * F.col(f"_y{k}")).alias(f"_x{k}") for k in range(AXES))))
    placed = cut(vertices.join(x, "_id"))
    centres = placed.groupBy("_label").agg(*(F.avg(f"_x{k}").alias(f"_c{k}") for k in range(AXES)))
    # A row's candidates: the clusters of its neighbours and its own.
    offered = edges.join(placed.select(F.col("_id").alias("_to"), "_label"), "_to").select("_id", "_label").union(placed.select("_id", "_label")).distinct()
    apart = sum((F.col(f"_x{k}") - F.col(f"_c{k}")) ** 2 for k in range(AXES))
    chosen = offered.join(centres, "_label").join(placed.drop("_label"), "_id").groupBy("_id").agg(F.min(F.struct(apart.alias("_d"), "_label")).alias("_m"), F.first("_all").alias("_all"))
    labelled = chosen.select("_id", F.col("_m._label").alias("_label"), "_all")
    labelled = cut(rows.join(labelled, "_id"))

    # The exact check.
    large = labelled.groupBy("_g", "_label").agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") >= min_size)
    inside = labelled.join(large, ["_g", "_label"])
    checked = inside.select("_id", "_label", "_g", "_all", "_size").join(_degrees(inside.select("_label", "_id", "_v"), "_label", cosine, block, kind), ["_label", "_id"])
    passed = checked.groupBy("_label").agg(F.min(F.when(F.col("_in") == F.col("_size") - 1, 1).otherwise(0)).alias("_mutual"), F.max(F.when(F.col("_all") == F.col("_size") - 1, 1).otherwise(0)).alias("_closed"))
    checked = cut(checked.join(passed, "_label"))
    sure = checked.where("_mutual = 1 AND _closed = 1")
    clean = sure.select("_g", F.min("_id").over(Window.partitionBy("_label")).alias("_cluster"), "_id", "_size", (F.col("_sum") / (F.col("_size") - 1)).alias("_affinity"))
    # What may still be in another set: rows with enough partners, unless all partners are in a confirmed cluster of their own.
    inner = sure.where("_all = _size - 1").select("_id")
    home = sure.select("_id", F.col("_label").alias("_home"))
    open_ = labelled.where(F.col("_all") >= min_size - 1).join(inner, "_id", "left_anti").join(home, "_id", "left").select("_g", "_id", "_v", "_home")
    open_ = cut(open_)
    left = _degrees(open_, "_g", cosine, block, kind).where(F.col("_in") >= min_size - 1).select("_id")
    open_ = open_.join(left, "_id", "left_semi")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_id", ignore_index=True)
        x, ids, homes = unit_rows(pdf["_v"]), pdf["_id"].to_numpy(), pdf["_home"]
        near = []
        for lo in range(0, len(x), TILE):
            for r, row in enumerate(x[lo : lo + TILE] @ x.T >= cosine):
                near.append(set(row.nonzero()[0].tolist()) - {lo + r})
        out = []
        for c in _cliques(near, min_size):
            if homes[c].notna().all() and homes[c].nunique() == 1:
                continue  # a part of a confirmed cluster
            total = (x[c] @ x[c].T).sum(axis=1) - 1
            out += [(pdf["_g"].iat[0], ids[c[0]], ids[v], len(c), t / (len(c) - 1)) for v, t in zip(c, total)]
        return pd.DataFrame(out, columns=["_g", "_cluster", "_id", "_size", "_affinity"])

    more = open_.groupBy("_g").applyInPandas(search, f"_g {gkind}, _cluster {kind}, _id {kind}, _size bigint, _affinity double")
    rank = F.row_number().over(Window.partitionBy("_cluster", "_size").orderBy(F.desc("_affinity"), "_id"))
    return clean.unionByName(more).select(
        F.col("_g").alias(group), F.col("_cluster").alias("cluster_id"), F.col("_id").alias("member"), F.col("_size").alias("size"), F.col("_affinity").alias("affinity"), rank.alias("rank")
    )
