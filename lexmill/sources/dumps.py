"""Compressed dumps of newline-delimited JSON, their manifest, and other files."""

from __future__ import annotations

import io
import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lexmill.functions.text import is_kept, segments, year_of

COMMENT = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "body", "created_utc")])
MAGIC = b"\x28\xb5\x2f\xfd"
ROWS = 5000


def _lines(path: str) -> Iterator[bytes]:
    import zstandard

    with open(path.removeprefix("file:"), "rb") as f:
        yield from io.BufferedReader(zstandard.ZstdDecompressor(max_window_size=2**31).stream_reader(f, read_across_frames=True), 1 << 16)


def read_dumps(spark: SparkSession, paths: list[str], columns: tuple[str, ...] = ("id", "body", "created_utc")) -> DataFrame:
    """(path, columns..., error): records of zstd dumps with windows of up to 2^31 bytes, which the JVM's codec refuses.

    One task streams one file; nothing holds a whole file. Blank lines are skipped; a line that is no JSON object, and
    a file that is corrupt or missing, give a row with an error. Paths must be readable on all workers.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=["path", *columns, "error"], dtype=object)

        for pdf in batches:
            for path in pdf["path"]:
                rows: list[tuple] = []
                try:
                    for line in _lines(path):
                        if not line.strip():
                            continue
                        try:
                            x = json.loads(line)
                            if not isinstance(x, dict):
                                raise ValueError
                            got = [x.get(c) for c in columns]
                            rows.append((path, *(None if v is None else v if isinstance(v, str) else json.dumps(v) for v in got), None))
                        except ValueError:
                            rows.append((path, *[None] * len(columns), "bad line"))
                        if len(rows) >= ROWS:
                            yield frame(rows)
                            rows = []
                except Exception as e:  # noqa: BLE001
                    rows.append((path, *[None] * len(columns), f"corrupt: {type(e).__name__}"))
                yield frame(rows)

    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("path", *columns, "error")])
    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return files.mapInPandas(read, schema)


def preflight(comments: DataFrame, source: str, body: str, epoch: str, order: str, sample: int = 5000) -> DataFrame:
    """(source, n_total, n_deleted, n_kept, n_unknown_year, est_passages) of each source.

    The passages of the first ``sample`` kept comments of a source (by ``order``) give the ratio for the estimate.
    """
    from pyspark.sql import Window

    kept = is_kept(body)
    counts = comments.groupBy(source).agg(F.count(F.lit(1)).alias("n_total"), F.count(F.when(~kept, 1)).alias("n_deleted"), F.count(F.when(kept, 1)).alias("n_kept"), F.count(F.when(kept & year_of(epoch).isNull(), 1)).alias("n_unknown_year"))
    first = comments.where(kept).withColumn("_r", F.row_number().over(Window.partitionBy(source).orderBy(order))).where(F.col("_r") <= sample)
    ratio = first.groupBy(F.col(source).alias("_s")).agg(F.avg(F.size(segments(body))).alias("_ratio"))
    return counts.join(ratio, F.col(source).eqNullSafe(F.col("_s")), "left").drop("_s").withColumn("est_passages", F.coalesce(F.floor(F.round(F.col("n_kept") * F.col("_ratio"), 6)), F.lit(0))).drop("_ratio")


def stale_files(spark: SparkSession, folder: str, manifest: DataFrame | None) -> DataFrame:
    """(path, size, modified) of the files whose size or time differ from the stored manifest."""
    now = spark.read.format("binaryFile").load(folder).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return now if manifest is None else now.join(manifest.select("path", "size", "modified"), ["path", "size", "modified"], "left_anti")


def magic_ok(spark: SparkSession, folder: str) -> DataFrame:
    """(path, ok): whether each file starts as a zstd file must."""
    head = spark.read.format("binaryFile").load(folder)
    return head.select("path", (F.substring("content", 1, 4) == F.lit(bytearray(MAGIC))).alias("ok"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_once(df: DataFrame, path: str, *by: str) -> DataFrame:
    """Writes on the first call, reads what was written on later ones: a frozen table."""
    spark = df.sparkSession
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(os.path.join(path, "_SUCCESS"))):
        (df.write.partitionBy(*by) if by else df.write).mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def decode_torrent(data: bytes) -> object:
    """The value of a bencoded file, read iteratively."""
    at, stack = 0, [[]]
    kinds: list[str] = ["root"]
    while at < len(data):
        c = data[at : at + 1]
        if c == b"i":
            end = data.index(b"e", at)
            stack[-1].append(int(data[at + 1 : end]))
            at = end + 1
        elif c in (b"l", b"d"):
            stack.append([])
            kinds.append(c.decode())
            at += 1
        elif c == b"e":
            done, kind = stack.pop(), kinds.pop()
            stack[-1].append(done if kind == "l" else dict(zip(done[::2], done[1::2])))
            at += 1
        else:
            colon = data.index(b":", at)
            n = int(data[at:colon])
            stack[-1].append(data[colon + 1 : colon + 1 + n])
            at = colon + 1 + n
    return stack[0][0] if stack[0] else None


def torrent_files(data: bytes) -> list[tuple[int, str, int]]:
    """(number from 1, path, bytes) of each file of a torrent."""
    info = decode_torrent(data)[b"info"]
    files = info.get(b"files") or [{b"path": [info[b"name"]], b"length": info[b"length"]}]
    return [(k, "/".join(p.decode() for p in f[b"path"]), f[b"length"]) for k, f in enumerate(files, 1)]


def matching_files(listed: DataFrame, names: DataFrame, suffix: str) -> tuple[DataFrame, DataFrame]:
    """(found, missing) of wanted names (column name) among listed paths, by file name with ``suffix``."""
    base = listed.withColumn("_n", F.regexp_extract("path", r"([^/]+)$", 1))
    wanted = names.select("name", F.concat("name", F.lit(suffix)).alias("_n"))
    return base.join(wanted, "_n").drop("_n"), wanted.join(base, "_n", "left_anti").select("name")
