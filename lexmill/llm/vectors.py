"""Most similar vectors: block matrix joins on int8 tiles with error bounds, survivors recomputed in float.

All similarities are cosines. A vector is null, shorter than the longest, all zero or holds NaN or
infinity: then it has no direction and takes part in nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from lexmill.runtime import cut

TILE = 1024
BLOCKS, MOST = 32, 262_144  # of a join of all pairs: blocks, and rows of one where they are more


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows q, scales s and bounds e with ``|x - s*q| <= e`` (Euclidean, measured, not assumed)."""
    s = np.maximum(np.abs(x).max(axis=1, initial=0.0), 1e-30) / 127.0
    q = np.rint(x / s[:, None]).astype(np.int8)
    e = np.linalg.norm(x - q * s[:, None], axis=1) + 1e-6
    return q, s.astype(np.float32), e.astype(np.float32)


def unit_rows(vectors: pd.Series | list) -> np.ndarray:
    """float64 matrix with rows of length 1."""
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def directions(df: DataFrame, key: str, vector: str, *more: str) -> DataFrame:
    """(_id, _v, more...): one row of each key whose vector has a direction; repeated rows of a key count once.

    Where rows of a key differ, the smallest row counts. Partitioned by _id.
    """
    ok = F.col("_v").isNotNull() & (F.size("_v") > 0) & F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("_v", lambda x: x != 0)
    rows = df.select(F.col(key).alias("_id"), F.col(vector).cast("array<double>").cast("array<float>").alias("_v"), *(F.col(c).alias(f"_{c}") for c in more))
    one = rows.where(F.col("_id").isNotNull() & ok).groupBy("_id").agg(F.min(F.struct(*(f"_{c}" for c in more), "_v")).alias("_r"))
    return one.select("_id", "_r.*")


def _rotation(width: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def _plan(n: int, cosine: float, target: float, bucket: int) -> tuple[int, int]:
    """Bits a table and tables, so that a pair at ``cosine`` meets in one with probability ``target``; at 1 one table of one bucket."""
    if target >= 1:
        return 0, 1
    p = 1 - math.acos(cosine) / math.pi
    bits = max(0, min(24, round(math.log2(max(1, n) / bucket))))
    tables = 1 if bits == 0 else math.ceil(math.log(1 - target) / math.log(1 - p**bits))
    return bits, tables


def _block_bounds(q: np.ndarray, s: np.ndarray, e: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose product, left with right, bounds the cosine of two vectors by the first ``part`` axes of their tiles.

    The three last axes add the lengths left over and the quantisation errors, so one product gives the bound.
    """
    left = np.ones((len(q), part + 3), dtype=np.float32)
    left[:, :part] = q[:, :part] * s[:, None]
    known = np.linalg.norm(left[:, :part], axis=1) - e  # e bounds the error of every part of a row
    left[:, part] = np.sqrt(np.maximum(0.0, 1.0 - np.maximum(0.0, known) ** 2)) + 1e-4
    right = left.copy()
    left[:, part + 1], right[:, part + 2] = 1.01 * e + 1e-3, 1.01 * e
    return left, right


def _meet_blocks(one: tuple, two: tuple | None, cosine: float, tile: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (in one, in two) of all pairs whose bound reaches ``cosine``, in parts; ``two`` None: pairs within one, each once.

    Blocks are (q, s, e, rest). Half of the axes give a first bound of every pair, all axes that of what it leaves.
    """
    other = one if two is None else two
    part = (one[0].shape[1] + 1) // 2
    left, right = _block_bounds(*one[:3], part)[0], _block_bounds(*other[:3], part)[1]
    (q, s, e, rest), (q2, s2, e2, rest2) = one, other

    def fine(hits: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        x, y = map(np.concatenate, zip(*hits))
        for at in range(0, len(x), 65536):
            u, v = x[at : at + 65536], y[at : at + 65536]
            product = np.einsum("ij,ij->i", q[u].astype(np.float32), q2[v].astype(np.float32))  # of int8: exact in float32
            keep = product * s[u] * s2[v] + rest[u] * rest2[v] + 1.01 * (e[u] + e2[v]) + 1e-3 >= cosine
            yield u[keep], v[keep]

    hits, held = [], 0
    space = np.empty(tile * tile, dtype=np.float32)
    for lo in range(0, len(left), tile):
        a = left[lo : lo + tile]
        for ro in range(lo if two is None else 0, len(right), tile):
            b = right[ro : ro + tile]
            bound = np.matmul(a, b.T, out=space[: len(a) * len(b)].reshape(len(a), len(b)))
            hit = np.flatnonzero(bound >= cosine)
            if len(hit):
                x, y = hit // len(b) + lo, hit % len(b) + ro
                new = x < y if two is None else slice(None)
                hits.append((x[new], y[new]))
                held += len(hits[-1][0])
            if held > 65536:
                yield from fine(hits)
                hits, held = [], 0
    if hits:
        yield from fine(hits)


def _all_blocks(placed: DataFrame, n: int, kind: str, cosine: float, block: int) -> DataFrame:
    """(a, b): every pair of ``placed`` that the bounds leave, from every pair of blocks.

    A block is one row of packed tiles, written once; a task of the cartesian product reads two of them where they lie.
    So nothing is copied for the other blocks, however many they are. Their number is held to BLOCKS (b blocks
    are b * b tasks) as long as a block has at most MOST rows.
    """
    block = max(block, min(MOST, math.ceil(n / BLOCKS)))
    tile = TILE

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [pdf for pdf in batches if len(pdf)]
        if parts:
            pdf = pd.concat(parts)
            numbers = {c: [pdf[c].to_numpy().astype(t).tobytes()] for c, t in (("id", np.int64), ("s", np.float32), ("e", np.float32), ("rest", np.float32))}
            yield pd.DataFrame({"i": [TaskContext.get().partitionId()], "q": [b"".join(pdf["q"])], **numbers})

    parts = placed.repartition(max(1, math.ceil(n / block)), "id")
    blocks = cut(parts.mapInPandas(pack, "i int, q binary, id binary, s binary, e binary, rest binary"))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def side(r, k: str) -> tuple[np.ndarray, tuple]:
            ids = np.frombuffer(r[f"id{k}"], dtype=np.int64)
            s, e, rest = (np.frombuffer(r[f"{c}{k}"], dtype=np.float32) for c in ("s", "e", "rest"))
            return ids, (np.frombuffer(r[f"q{k}"], dtype=np.int8).reshape(len(ids), -1), s, e, rest)

        for pdf in batches:
            for _, r in pdf.iterrows():
                ids_l, one = side(r, "1")
                ids_r, two = (ids_l, None) if r["i1"] == r["i2"] else side(r, "2")
                for x, y in _meet_blocks(one, two, cosine, tile):
                    a, b = ids_l[x], ids_r[y]
                    yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    one, two = (blocks.select(*(F.col(c).alias(f"{c}{k}") for c in blocks.columns)) for k in (1, 2))
    return one.hint("shuffle_replicate_nl").join(two, F.col("i1") <= F.col("i2")).mapInPandas(meet, f"a {kind}, b {kind}")


def similar_pairs(
    df: DataFrame, key: str, vector: str, apart: str | None, cosine: float = 0.95, target: float = 1.0, bucket: int = 4096, block: int = 8192, sketch: int = 64, seed: int = 7
) -> DataFrame:
    """(a, b, cosine): pairs of keys, a < b, of different ``apart``, whose vectors' cosine is at least ``cosine``.

    A null ``apart`` differs from every other value. Keys must be integers. Copies of one vector are all
    compared, as each is a key of its own.

    Method: block matrix join. Rows are cut into blocks of about ``block`` or more and every pair of blocks is joined, a
    task each, so the result is whole at any size; the work grows as the square of the rows, the disk in proportion
    to them (``_all_blocks``). With a ``target``
    below 1 only, signs of random projections place each vector in one bucket of several tables, as many that a pair at
    exactly ``cosine`` shares a bucket with probability ``target``, and blocks are joined within buckets, whose rows
    are copied for every pair of blocks.
    Within a block pair, int8 tiles over the first ``sketch`` axes give each product with a bound: quantisation
    error of both sides plus the product of the lengths left over; half of these axes decide first. Only pairs whose
    bound reaches ``cosine`` survive; they are recomputed from the whole vectors in float64.
    """
    rows = directions(df, key, vector, *([apart] if apart else []))
    if apart is None:
        rows = rows.withColumn("_apart", F.lit(None).cast("string"))
        apart_col = "_apart"
    else:
        apart_col = f"_{apart}"
    rows = cut(rows)
    n = rows.count()
    width = rows.agg(F.max(F.size("_v"))).first()[0] or 1  # one number
    sketch = min(sketch, width)
    bits, tables = _plan(n, cosine, target, bucket)
    turn = _rotation(width, seed)[:, :sketch].astype(np.float32)
    planes = np.random.default_rng(seed + 1).standard_normal((width, max(1, bits * tables))).astype(np.float32)
    weights = (1 << np.arange(max(1, bits), dtype=np.int64))[: max(1, bits)]

    def codes_of(x: np.ndarray) -> np.ndarray:
        codes = ((x @ planes) > 0).reshape(len(x), tables, bits).astype(np.int64) @ weights if bits else np.zeros((len(x), 1), dtype=np.int64)
        return codes * codes.shape[1] + np.arange(codes.shape[1])

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[[len(v) == width for v in pdf["_v"]]]
            if len(pdf):
                yield pd.DataFrame({"place": codes_of(unit_rows(pdf["_v"]).astype(np.float32)).ravel()})

    def sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[[len(v) == width for v in pdf["_v"]]]
            if not len(pdf):
                continue
            x = unit_rows(pdf["_v"]).astype(np.float32)
            y = x @ turn
            q, s, e = quantise(y)
            rest = np.sqrt(np.maximum(0.0, 1.0 - (y * y).sum(axis=1))) + 1e-4
            packed = [r.tobytes() for r in q]
            codes = codes_of(x)
            base = pd.DataFrame({"id": pdf["_id"].to_numpy(), "q": packed, "s": s, "e": e, "rest": rest.astype(np.float32)})
            for t in range(codes.shape[1]):
                yield base.assign(place=codes[:, t])

    kind = dict(df.dtypes)[key]
    placed = rows.select("_id", "_v").mapInPandas(sketches, f"id {kind}, q binary, s float, e float, rest float, place bigint")

    def in_buckets() -> DataFrame:
        # Buckets above a block are cut: their rows go to every pair of blocks they take part in.
        sizes = rows.select("_v").mapInPandas(places, "place bigint").groupBy("place").agg(F.count(F.lit(1)).alias("_n"))
        large = sizes.where(F.col("_n") > block).select("place", F.ceil(F.col("_n") / block).cast("int").alias("_blocks"))
        # Of n * tables rows at most n * tables / block buckets are large.
        blocks = F.coalesce(F.col("_blocks"), F.lit(1))
        tiles = (
            placed.join(F.broadcast(large) if n * tables / block <= 1_000_000 else large, "place", "left")
            .withColumn("_own", F.pmod(F.xxhash64("id"), blocks).cast("int"))
            .withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            .select("id", "q", "s", "e", "rest", "place", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "_own")
        )

        def meet(pdf: pd.DataFrame) -> pd.DataFrame:
            q = np.frombuffer(b"".join(pdf["q"]), dtype=np.int8).reshape(len(pdf), -1).astype(np.float32)  # products of int8 stay exact in float32
            ids, s, e, rest, own = (pdf[c].to_numpy() for c in ("id", "s", "e", "rest", "_own"))
            i, j = pdf["i"].iat[0], pdf["j"].iat[0]
            left, right = (own == i).nonzero()[0], (own == j).nonzero()[0]
            out_a, out_b = [], []
            qs = q * s[:, None]
            for lo in range(0, len(left), TILE):
                a = left[lo : lo + TILE]
                for ro in range(lo if i == j else 0, len(right), TILE):
                    b = right[ro : ro + TILE]
                    bound = qs[a] @ qs[b].T
                    bound += rest[a][:, None] * rest[b]
                    bound += 1.01 * (e[a][:, None] + e[b]) + 1e-3
                    x, y = (bound >= cosine).nonzero()
                    out_a.append(ids[a[x]])
                    out_b.append(ids[b[y]])
            a, b = (np.concatenate(o) if o else ids[:0] for o in (out_a, out_b))
            keep = a != b
            a, b = a[keep], b[keep]
            found = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})
            return found.drop_duplicates()

        return tiles.groupBy("place", "i", "j").applyInPandas(meet, f"a {kind}, b {kind}").distinct()

    pairs = _all_blocks(placed.drop("place"), n, kind, cosine, block) if bits == 0 else in_buckets()
    left = rows.select(F.col("_id").alias("a"), F.col("_v").alias("_va"), F.col(apart_col).alias("_pa"))
    right = rows.select(F.col("_id").alias("b"), F.col("_v").alias("_vb"), F.col(apart_col).alias("_pb"))
    both = pairs.join(left, "a").join(right, "b").where(F.col("_pa").isNull() | F.col("_pb").isNull() | (F.col("_pa") != F.col("_pb")))

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                c = np.einsum("ij,ij->i", unit_rows(pdf["_va"]), unit_rows(pdf["_vb"]))
                out = pdf[["a", "b"]].assign(cosine=np.minimum(c, 1.0))
                yield out[c >= cosine]

    return both.select("a", "b", "_va", "_vb").mapInPandas(exact, f"a {kind}, b {kind}, cosine double")


def nearest(df: DataFrame, queries: DataFrame, key: str, vector: str, apart: str | None, k: int = 10, block: int = 16384) -> DataFrame:
    """(query, neighbour, cosine, rank): of each query's vector the ``k`` most similar of df, not of the same ``apart``.

    Queries are rows of the same columns; a query is never its own neighbour; a null ``apart`` differs from
    every other value. Ties go to the smaller key. Fewer than k are given only where there are no more.

    Method: both sides are cut into blocks of about ``block`` rows, each pair of blocks is one task. Tiles of
    int8 products give every cosine with a quantisation bound; what can still reach a query's k-th best lower
    bound is recomputed in float64 and kept in a heap of k; heaps are merged by rank. Exact.
    """
    more = [apart] if apart else []
    rows, asked = directions(df, key, vector, *more), directions(queries, key, vector, *more)
    pid = F.col(f"_{apart}").cast("string") if apart else F.lit(None).cast("string")
    rows, asked = (cut(x.select(F.col("_id").alias("id"), pid.alias("p"), F.col("_v").alias("v"))) for x in (rows, asked))
    nr, nq = (max(1, math.ceil(x.count() / block)) for x in (rows, asked))
    width = rows.agg(F.max(F.size("v"))).first()[0] or 1  # one number
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    side_r = rows.select("id", "p", "v", F.pmod(F.xxhash64("id"), F.lit(nr)).alias("rb"), every(nq).alias("qb"))
    side_q = asked.select("id", "p", "v", every(nr).alias("rb"), F.pmod(F.xxhash64("id"), F.lit(nq)).alias("qb"))
    kind = dict(df.dtypes)[key]

    def best(key_: tuple, q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query": q["id"][:0], "neighbour": q["id"][:0], "cosine": np.zeros(0)})
        if not len(q) or not len(r):
            return empty
        q, r = (x[[len(v) == width for v in x["v"]]].sort_values("id") for x in (q, r))
        if not len(q) or not len(r):
            return empty
        xq, xr = unit_rows(q["v"]), unit_rows(r["v"])
        qq, sq, eq = quantise(xq)
        qr, sr, er = quantise(xr)
        tr = qr.astype(np.float32) * sr[:, None]
        groups = pd.factorize(pd.concat([q["p"], r["p"]]))[0]
        gq, gr = groups[: len(q)], groups[len(q) :]
        iq, ir = q["id"].to_numpy(), r["id"].to_numpy()
        out = []
        for lo in range(0, len(q), 256):
            a = slice(lo, lo + 256)
            about = (qq[a].astype(np.float32) * sq[a][:, None]) @ tr.T
            about[(gq[a][:, None] == gr) & (gr >= 0)] = -np.inf
            about[iq[a][:, None] == ir] = -np.inf
            slack = (eq[a] * 1.01 + 1e-4)[:, None] + er * 1.01
            low = about - slack
            m = min(k, len(r))
            kth = -np.partition(-low, m - 1, axis=1)[:, m - 1]
            x, y = ((about + slack >= kth[:, None]) & np.isfinite(about)).nonzero()
            c = np.einsum("ij,ij->i", xq[a][x], xr[y])
            hit = pd.DataFrame({"query": iq[a][x], "neighbour": ir[y], "cosine": np.minimum(c, 1.0)})
            hit = hit.sort_values(["query", "cosine", "neighbour"], ascending=[True, False, True])
            out.append(hit.groupby("query", sort=False).head(k))
        return pd.concat(out)

    heaps = side_q.groupBy("rb", "qb").cogroup(side_r.groupBy("rb", "qb")).applyInPandas(best, f"query {kind}, neighbour {kind}, cosine double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "neighbour"))
    return heaps.withColumn("rank", rank).where(F.col("rank") <= k)
