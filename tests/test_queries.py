"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tools.oracle import compare

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(D).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.skipif(not Path(D).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, con, name):
    assert compare(spark, name, D, con).startswith("same")


def test_entry_and_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not Path(D).exists(), reason="no test tables here")
def test_searches_take_every_vector(spark):
    known, n = entry.queries(), spark.read.parquet(f"{D}/embeddings.parquet").count()
    for name in ("dense_topk_hybrid", "mean_topk_cosine", "target_ranks", "zscore_scores"):
        assert known[f"{name}_all"](spark, D).select("query").distinct().count() == n
    assert known["rank_metrics_all"](spark, D).first().n_queries == n
    for name in ("mrr_by_pool", "error_breakdown"):
        got = known[f"{name}_all"](spark, D)
        assert sum(r[got.columns[-1] if name == "error_breakdown" else "n_queries"] for r in got.collect()) == n
    assert not any("vec_id < " in s for k, s in entry.oracle_sql().items() if k.endswith("_all"))


@pytest.mark.skipif(not Path(D).exists(), reason="no test tables here")
def test_replicates_of_the_reference(spark, monkeypatch):
    p = [r.p * 10_001 for r in entry.queries()["permutation_null"](spark, D).collect()]
    assert p and all(abs(x - round(x)) < 1e-6 for x in p)
    from lexmill.plans import labels

    monkeypatch.setattr(labels.T, "bootstrap_mean", lambda *a: a[3])
    assert entry.queries()["bootstrap_ci"](spark, D) == 2000


def test_kmeans_takes_as_many_clusters_as_labels(spark, monkeypatch):
    from lexmill.plans import structure

    asked, real = [], structure.V.kmeans_labels
    monkeypatch.setattr(structure, "table", lambda s, d, n: s.createDataFrame([(k, [float(k % 4 == j) for j in range(4)], k % 4) for k in range(24)], "vec_id long, embedding array<float>, label int"))
    monkeypatch.setattr(structure.V, "kmeans_labels", lambda *a: asked.append(a[3:]) or real(*a))
    assert entry.queries()["kmeans_ari"](spark, "").first().ari == 1.0
    assert asked == [(4, 10)]
