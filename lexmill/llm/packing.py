"""Filling containers of a fixed token capacity with documents."""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lexmill.runtime import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def token_counts(df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, tokens): the number of tokens of each row's whole text; 0 for null. One row a row."""
    kind = dict(df.dtypes)[key]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        t.encode_special_tokens = True
        for pdf in batches:
            sizes: list[int] = []
            texts = pdf["_t"].fillna("").tolist()
            for lo in range(0, len(texts), 256):
                sizes += [len(e.ids) for e in t.encode_batch_fast(texts[lo : lo + 256], add_special_tokens=False)]
            yield pd.DataFrame({"_k": pdf["_k"], "tokens": np.array(sizes, dtype=np.int64)})

    return df.select(F.col(key).alias("_k"), F.col(text).alias("_t")).mapInPandas(count, f"_k {kind}, tokens bigint").withColumnRenamed("_k", key)


def fill(sizes: np.ndarray, capacity: int, linear: float, quadratic: float) -> np.ndarray:
    """The container of each piece; ``sizes`` descending, none above ``capacity``.

    Each piece goes to the container of the lowest cost so far among those with room for it (ties: the first);
    there are as many containers as the total needs at least, and a new one only where none has room.
    """
    count = max(1, math.ceil(sizes.sum() / capacity))
    cost, room = np.zeros(count), np.full(count, capacity, dtype=np.int64)
    out = np.zeros(len(sizes), dtype=np.int64)
    for k, n in enumerate(sizes):
        at = int(np.argmin(np.where(room >= n, cost, np.inf)))
        if room[at] < n:
            at = len(room)
            cost, room = np.append(cost, 0.0), np.append(room, capacity)
        cost[at] += linear * n + quadratic * n * n
        room[at] -= n
        out[k] = at
    return out


def pack(sized: DataFrame, key: str, size: str = "tokens", capacity: int = 2048, linear: float = 1.0, quadratic: float = 1.0 / 4096, shard: int = 20_000) -> DataFrame:
    """(key, piece, tokens, container_id): every row of a size above 0 in a container of ``capacity``.

    Rows above the capacity are cut into pieces of exactly the capacity and a rest; all others stay whole
    (piece 0). Rows of size 0, negative or null come out with a null container. Repeated rows and null keys
    are packed as rows of their own. An empty table gives none.

    Method: cost-balanced packing. A piece of n tokens costs ``linear * n + quadratic * n * n``, the price of a pass
    through a network with attention; in descending order pieces go to the container of the lowest cost with
    room. Rows are spread at random over shards of about ``shard`` rows, each packed by one task, so that space
    is lost in at most about one container a shard and the work grows in proportion to the data.
    """
    rows = cut(sized.select(F.col(key).alias("_k"), F.col(size).cast("long").alias("_n")).withColumn("_row", F.monotonically_increasing_id()))
    shards = max(1, math.ceil(rows.count() / shard))
    kind = dict(rows.dtypes)["_k"]
    whole = rows.where("_n > 0").select("_k", "_n", "_row", F.pmod(F.xxhash64("_row"), F.lit(shards)).alias("_shard"))
    last = F.ceil(F.col("_n") / capacity) - 1
    pieces = whole.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long")))).withColumn("_size", F.when(F.col("_piece") < last, F.lit(capacity)).otherwise(F.col("_n") - last * capacity).cast("long"))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_size", "_row", "_piece"], ascending=[False, True, True], ignore_index=True)
        at = fill(pdf["_size"].to_numpy(), capacity, linear, quadratic)
        return pd.DataFrame({"_k": pdf["_k"], "piece": pdf["_piece"].astype(np.int32), "tokens": pdf["_size"], "container_id": pdf["_shard"] * 2**32 + at})

    packed = pieces.groupBy("_shard").applyInPandas(place, f"_k {kind}, piece int, tokens bigint, container_id bigint")
    empty = rows.where("_n IS NULL OR _n <= 0").select("_k", F.lit(0).alias("piece"), F.coalesce("_n", F.lit(0)).alias("tokens"), F.lit(None).cast("bigint").alias("container_id"))
    return packed.unionByName(empty).withColumnRenamed("_k", key)
