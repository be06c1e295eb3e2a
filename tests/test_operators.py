import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import judgments as J, lexical as L, selecting as S, statistics as T, vectors as V
from lexmill.sources import dumps, inventory


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


HITS = "seq long, uid string, passage_id string, text string, score double"


def test_candidates_ties_blanks_and_labels(spark):
    df = spark.createDataFrame(
        [
            (1, "u", "p1", "Good text", 0.5), (2, "u", "p1", "Good text", 0.9), (3, "u", "p2", "good  TEXT", 0.9), (4, "u", "p3", " ", 1.0), (5, "u", "p4", None, 1.0),
            (6, "u", "p5", "about rule spotting here", 0.8), (7, "u", "p6", "unruly", 0.1), (8, "u", "p7", "no score", None),
        ], HITS,
    )
    rx = S.label_pattern(["Rule spotting", "rule"])
    got = S.select_candidates(df, ["uid"], "passage_id", "text", "score", "seq", 10, rx)
    assert rows(got, "rank", "passage_id") == [(1, "p1"), (2, "p6"), (3, "p7")]
    f = S.candidate_funnel(df, ["uid"], "passage_id", "text", "score", "seq", 2, rx).first()
    assert (f.n_raw, f.n_keys, f.n_texts, f.n_clean, f.n_selected) == (8, 7, 4, 3, 2)
    assert S.select_candidates(df.limit(0), ["uid"], "passage_id", "text", "score", "seq", 10, rx).count() == 0


def test_label_pattern_escapes_and_prefers_longer():
    assert S.label_pattern(["a.b/ab c"]) == r"(?i)\b(?:ab c|a\.b)\b"


def test_sets_are_disjoint(spark):
    df = spark.range(50).select(F.lit("u").alias("uid"), F.col("id").cast("string").alias("k"), (F.col("id") / 50).alias("s"))
    got = S.drawn_then_ranked(df, ["uid"], "k", "s", 10, 15, "z")
    assert got.count() == 25 and got.select("k").distinct().count() == 25
    assert got.groupBy("set_name").agg(F.max("index")).count() == 2
    left = {r.k for r in df.collect()} - {r.k for r in got.where("set_name = 'random'").collect()}
    assert {r.k for r in got.where("set_name = 'ranked'").collect()} == set(sorted(left, key=lambda k: -int(k))[:15])


@pytest.mark.parametrize("kept,want", [(0, 5), (3, 5), (7, 7), (12, 10)])
def test_extraction_floor_and_cap(spark, kept, want):
    df = spark.range(20).select(F.lit("u").alias("uid"), F.col("id").alias("k"), (F.col("id") / 20).alias("p"), (F.col("id") < kept).alias("r"))
    got = S.extraction_set(df, ["uid"], "k", "p", "r", 5, 10, "z")
    assert got.count() == want
    assert got.where("extraction_source = 'backfill'").count() == max(0, want - kept) * (kept < 5)


def test_quota_plan_keeps_small_groups_whole(spark):
    df = spark.createDataFrame([("a", 2001)] * 3 + [("b", 2001)] * 30 + [("b", None)] * 2, "g string, y int")
    plan = {(r.g, r.y): r.p for r in S.quota_plan(df, "g", "y", 10).collect()}
    assert plan == {("a", 2001): 1.0, ("b", 2001): pytest.approx(5 / 30), ("b", None): 1.0}


def test_split_is_exact_and_by_key(spark):
    df = spark.range(205).select((F.col("id") % 100).alias("k"))
    got = S.split_by_key(df, "k", "z")
    assert got.count() == 205
    per = {r[0]: r[1] for r in got.distinct().groupBy("split").count().collect()}
    assert per == {"train": 80, "dev": 10, "test": 10}


def test_merge_and_leaks(spark):
    old, new = spark.createDataFrame([(1, "o"), (2, "o")], "k int, v string"), spark.createDataFrame([(2, "n"), (3, "n")], "k int, v string")
    assert rows(S.merge_new_over_old(old, new, ["k"]), "k", "v") == [(1, "o"), (2, "n"), (3, "n")]
    held = spark.createDataFrame([("  A  b",), (None,)], "h string")
    assert rows(S.without_leaks(spark.createDataFrame([("a B",), ("c",)], "t string"), "t", held, "h"), "t") == [("c",)]
    with pytest.raises(ValueError, match="odd"):
        S.expect_none(old, "odd")


VOTES = "uid string, passage_id string, rater string, label string, code string"


def test_coverage_and_soft_labels_treat_missing_code_differently(spark):
    v = spark.createDataFrame([("G-A", "p", "r1", "folk_description", None), ("G-A", "p", "r2", "folk_description", "G-B"), ("G-A", "p", "r3", "off_topic", None)], VOTES)
    c = {r.rater: r for r in J.coverage(v).collect()}
    assert (c["r1"].prev, c["r1"].nb, c["r2"].prev, c["r2"].nb) == (1.0, 0.0, 0.0, 1.0)
    s = J.soft_labels(v).first()
    assert (s.p_folk, s.p_inc, s.p_off, s.label) == (0.0, 0.0, 1.0, "off_topic")


def test_label_file_errors(spark):
    pool = spark.createDataFrame([("G-A", "p1"), ("G-A", "p2")], "uid string, passage_id string")
    labels = spark.createDataFrame([("G-A", "p1", "odd", None), ("G-A", "p3", "folk_description", None), ("G-A", "p3", "folk_description", "G-Z")], "uid string, passage_id string, label string, code string")
    got = rows(J.label_file_errors(pool, labels, spark.createDataFrame([("G-A",)], "uid string")), "passage_id", "error")
    assert got == [("p1", "bad label"), ("p2", "missing"), ("p3", "extra"), ("p3", "extra"), ("p3", "folk without ability"), ("p3", "unknown ability")]


def test_kappa_by_hand(spark):
    df = spark.createDataFrame([("a", "a")] * 20 + [("a", "b")] * 5 + [("b", "a")] * 10 + [("b", "b")] * 15 + [("a", None)], "x string, y string")
    r = T.cohen_kappa(df, "x", "y").first()
    assert (r.n, r.agreement, r.kappa) == (50, pytest.approx(0.7), pytest.approx(0.4))


def test_sweep_and_average_precision(spark):
    df = spark.createDataFrame([(1, 0.9, True), (2, 0.8, False), (3, 0.7, True), (4, 0.1, False)], "k int, s double, g boolean")
    got = {r.threshold: (r.tp, r.fp, r.fn) for r in T.threshold_sweep(df, "s", "g", [0.05, 0.7, 0.95]).collect()}
    assert got == {0.05: (2, 2, 0), 0.7: (2, 1, 0), 0.95: (0, 0, 2)}
    assert T.average_precision(df, "s", "g", "k").first()[0] == pytest.approx((1 + 2 / 3) / 2)


def test_bh_against_brute_force(spark):
    p = [0.01, 0.04, 0.03, 0.03, 1.0, 0.2, 0.001]
    got = {r.i: r.q for r in T.bh_qvalues(spark.createDataFrame(list(enumerate(p)), "i int, p double"), "p", 3).collect()}
    order = np.argsort(p)
    q, low = {}, 1.0
    for rank in range(len(p), 0, -1):
        low = min(low, p[order[rank - 1]] * len(p) / rank)
        q[int(order[rank - 1])] = low
    assert got == {k: pytest.approx(v) for k, v in q.items()}


def test_ranks_and_tests(spark):
    df = spark.createDataFrame([(1.0, 2.0, True), (2.0, 1.0, True), (2.0, 3.0, False), (4.0, 4.0, False), (None, 1.0, True)], "a double, b double, f boolean")
    assert rows(T.global_rank(df, "a", 2), "rank_avg") == [(1.0,), (2.5,), (2.5,), (4.0,)]
    assert T.spearman(df, "a", "b").first().rho == pytest.approx(np.corrcoef([1, 2.5, 2.5, 4], [2, 1, 3, 4])[0, 1])
    m = T.mann_whitney(df, "a", "f").first()
    assert (m.n1, m.n2, m.u1) == (2, 2, 0.5) and 0 < m.p_less < 0.5
    assert T.fisher_exact(3, 1, 1, 3)[1] == pytest.approx(17 / 70)
    assert T.mcnemar_exact(1, 5) == pytest.approx(14 / 64)
    assert T.t_two_sided(0.5, 12) == pytest.approx(0.0978, abs=2e-4)
    assert math.isnan(T.t_two_sided(0.5, 2))


def test_bootstrap_covers_the_mean(spark):
    df = spark.range(200).select((F.col("id") % 50).alias("u"), (F.col("id") % 2).cast("double").alias("v"))
    r = T.bootstrap_mean(df, "u", "v", 300).first()
    assert r.n_units == 50 and r.low < r["mean"] < r.high and r.high - r.low < 0.5


def test_top_k_leaves_out_own_passage_and_breaks_ties(spark):
    x = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], 3), (5, [0.0, 1.0], 4)], "id long, v array<double>, p int")
    got = V.block_top_k(x, x, 2, apart=True, block=2)
    assert rows(got.where("query = 1"), "rank", "id") == [(1, 3), (2, 4)]


def test_leaders_need_not_be_transitive(spark):
    a = [(1, "g", 9, [1.0, 0.0]), (2, "g", 5, [0.8, 0.6]), (3, "g", 5, [0.28, 0.96]), (4, "g", 1, None)]
    got = rows(V.leader_clusters(spark.createDataFrame(a, "k long, g string, n int, v array<double>"), "g", "k", "v", "n", 0.75), "k", "leader")
    assert got == [(1, 1), (2, 1), (3, 3)]


def test_debias_removes_mean_and_axes(spark):
    rng = np.random.default_rng(0)
    data = [(i, [float(y) for y in (rng.normal(0, [5, 1, 1, 1]) + [3, 0, 0, 0])]) for i in range(40)] + [(99, None)]
    got = V.debias(spark.createDataFrame(data, "id int, v array<double>"), "v", 1).collect()
    x = np.array([r.v for r in got if r.v])
    assert np.allclose(np.linalg.norm(x, axis=1), 1) and abs(x[:, 0]).max() < 0.4 and got[-1].v is None


def test_rand_and_ellipse(spark):
    df = spark.createDataFrame([(0, 5), (0, 5), (1, 7), (1, 7)], "a int, b int")
    assert V.adjusted_rand(df, "a", "b").first().ari == pytest.approx(1.0)
    pts = spark.createDataFrame([(0.0, 0.0), (2.0, 2.0), (1.0, 1.0)], "x double, y double")
    e = V.ellipse(pts, "x", "y").first()
    assert e.minor == pytest.approx(0.0, abs=1e-9) and e.angle == pytest.approx(math.pi / 4)
    assert V.ellipse(pts.limit(2), "x", "y").count() == 0


def test_permutation_finds_leak(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 4)], "src int, dst int")
    labels = spark.createDataFrame([(k, "a" if k % 2 else "b") for k in range(1, 9)], "n int, l string")
    r = T.permutation_leak(edges, labels, "n", "l", 200).first()
    assert r.edges == 3 and 0 < r.p < 1 and 0 < r.null_mean < 3
    with pytest.raises(ValueError):
        T.permutation_leak(edges, labels, "n", "l", 10, most_edges=2)


def test_lift_and_proper_nouns(spark):
    counts = spark.createDataFrame([("u", "only", 6), ("u", "both", 6), ("w", "both", 60), ("u", "rare", 2)], "uid string, term string, n long")
    got = L.lift(counts, "uid", 5, 10).where("uid = 'u'").orderBy("rank").collect()
    assert [r.term for r in got] == ["only", "both"]
    cased = spark.createDataFrame([("paris", 4, 4), ("city", 9, 1), ("rome", 3, 3)], "term string, n long, n_capital long")
    assert rows(L.proper_nouns(cased), "term") == [("paris",)]


def test_discriminators(spark):
    a = spark.createDataFrame([("A-X", "X", "A", "vs Y/Q (same)"), ("A-Y", "Y", "A", None), ("B-Q", "Q", "B", "vs X (Ga); vs Q"), ("B-Y", "Y", "B", "")], "uid string, code string, broad_stratum string, discriminator string")
    assert rows(inventory.discriminator_pairs(a), "a", "b") == [("A-X", "A-Y"), ("A-X", "B-Q")]


def test_inventory_fails_closed(spark):
    a = spark.createDataFrame([("A-X", "X", "n", "A", "b")], "uid string, code string, ability_name string, broad_stratum string, broad_name string")
    with pytest.raises(ValueError, match="without seeds"):
        inventory.checked_inventory(a, spark.createDataFrame([], "ability_code string"))
    with pytest.raises(ValueError, match="unknown"):
        inventory.checked_inventory(a, spark.createDataFrame([("A-X",), ("Z",)], "ability_code string"))


@pytest.mark.parametrize("log", [20, 28])
def test_dumps(spark, tmp_path, log):
    import zstandard

    data = b'{"id": "1", "body": "x", "created_utc": 5}\n\nnot json\n{"id": "2", "body": null, "other": 1}'
    params = zstandard.ZstdCompressionParameters.from_level(3, window_log=log)
    path = tmp_path / "a.zst"
    path.write_bytes(zstandard.ZstdCompressor(compression_params=params).compress(data))
    bad = tmp_path / "b.zst"
    bad.write_bytes(b"no dump")
    got = dumps.read_dumps(spark, [str(path), str(bad), str(tmp_path / "none.zst")])
    ok = rows(got.where(F.col("path") == str(path)).fillna("-"), "id", "body", "created_utc", "error")
    assert ok == [("-", "-", "-", "bad line"), ("1", "x", "5", "-"), ("2", "-", "-", "-")]
    assert got.where("error LIKE 'corrupt%'").count() == 2
    assert rows(dumps.magic_ok(spark, str(tmp_path)), "ok") == [(False,), (True,)]


def test_frozen_table_and_torrent(spark, tmp_path):
    path = str(tmp_path / "pool")
    dumps.write_once(spark.range(3), path)
    assert dumps.write_once(spark.range(9), path).count() == 3
    data = b"d4:infod5:filesld6:lengthi7e4:pathl1:a5:x.zsteed6:lengthi9e4:pathl5:y.txteeeee"
    assert dumps.torrent_files(data) == [(1, "a/x.zst", 7), (2, "y.txt", 9)]
    listed = spark.createDataFrame(dumps.torrent_files(data), "n int, path string, size long")
    found, missing = dumps.matching_files(listed, spark.createDataFrame([("x",), ("q",)], "name string"), ".zst")
    assert rows(found, "name") == [("x",)] and rows(missing, "name") == [("q",)]


def test_settings(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text("a: 1\nb: 2\n")
    assert inventory.Settings.load(p, ("a",), b=5)["b"] == 5
    with pytest.raises(KeyError, match="c"):
        inventory.Settings.load(p, ("c",))
