"""Queries on vectors, ranks and structure tests, and the stand-in classifier."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lexmill.functions.text import content_tokens
from lexmill.operators import judgments as J, lexical as L, models as M, statistics as T, vectors as V
from lexmill.plans.corpus import hits, votes
from lexmill.runtime import cut, table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def searches(sql: str, most: int):
    """Registers a query under its name on the query vectors below ``most``, as its SQL has them, and as NAME_all on all of them."""

    def add(f):
        n = f.__name__
        QUERIES[n], SQL[n] = lambda spark, d: f(spark, d, f"id < {most}"), sql
        QUERIES[f"{n}_all"], SQL[f"{n}_all"] = f, re.sub(rf" WHERE a\.vec_id < {most}(?: AND|(?=\)))", lambda m: " WHERE" if "AND" in m.group(0) else "", sql)
        return f

    return add


_DOT = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_KNN = f"""WITH s AS (SELECT a.vec_id AS query, b.vec_id AS id, {_DOT} AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.vec_id // 3 <> b.vec_id // 3),
knn AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank FROM s QUALIFY rank <= 10)"""


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.expr("vec_id div 3").alias("p"), "label")


def _knn(spark, d):
    x = _vectors(spark, d)
    return V.block_top_k(x, x, 10, apart=True)


@query(_KNN + " SELECT query, id, round(score, 6) AS score, rank FROM knn")
def knn_excl_group(spark, d):
    return _knn(spark, d).select("query", "id", F.round("score", 6).alias("score"), "rank")


@searches(f"""WITH s AS (SELECT a.vec_id AS query, b.vec_id AS id, b.label % 4 AS source, round({_DOT}, 9) AS score FROM embeddings a JOIN embeddings b ON true WHERE a.vec_id < 20),
r AS (SELECT *, row_number() OVER (PARTITION BY query, source ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10),
h AS (SELECT r.*, CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END AS sparse FROM r JOIN embeddings a ON a.vec_id = query JOIN embeddings b ON b.vec_id = id)
SELECT query, id, source, rank, round(0.7 * score + 0.3 * sparse, 6) AS hybrid FROM h WHERE score >= 0.1""", 20)
def dense_topk_hybrid(spark, d, only="true"):
    x = _vectors(spark, d).withColumn("source", F.col("label") % 4)
    top = V.block_top_k(x.where(only), x, 10, by="source").where(F.col("score") >= 0.1)
    of = lambda c, k: x.select(F.col("id").alias(k), F.create_map(F.col("label"), F.lit(1.0)).alias(c))
    met = top.join(of("_a", "query"), "query").join(of("_b", "id"), "id")
    return met.select("query", "id", "source", "rank", V.hybrid(F.round("score", 9), V.sparse_dot("_a", "_b"), 0.3).alias("hybrid"))


@query(_KNN + """ SELECT count(*) AS n, round(avg((a.label = b.label)::INT), 6) AS purity, (SELECT round(sum(n * (n - 1)) / (sum(n) * (sum(n) - 1)), 6) FROM (SELECT count(*)::DOUBLE AS n FROM embeddings GROUP BY label)) AS chance
FROM knn JOIN embeddings a ON a.vec_id = query JOIN embeddings b ON b.vec_id = id""")
def knn_purity(spark, d):
    p = V.neighbour_purity(_knn(spark, d), _vectors(spark, d), "id", "label")
    return p.select("n", F.round("purity", 6).alias("purity"), F.round("chance", 6).alias("chance"))


@query(_KNN + " SELECT least(a.label, b.label) AS a, greatest(a.label, b.label) AS b, count(*) AS edges FROM knn JOIN embeddings a ON a.vec_id = query JOIN embeddings b ON b.vec_id = id WHERE a.label <> b.label GROUP BY 1, 2")
def cross_edge_leak(spark, d):
    return V.cross_edges(_knn(spark, d), _vectors(spark, d), "id", "label")


_CENTRES = "WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), m AS (SELECT label, d, avg(x) AS x FROM x GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY d) AS v FROM m GROUP BY 1)"


@query(_CENTRES + " SELECT a.label AS a, b.label AS b, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM c a JOIN c b ON a.label < b.label")
def centroid_cosine(spark, d):
    c = V.mean_vector(_vectors(spark, d).withColumn("v", F.col("v").cast("array<double>")), "v", "label")  # one row a label
    a, b = c.select(F.col("label").alias("a"), F.col("vector").alias("_a")), c.select(F.col("label").alias("b"), F.col("vector").alias("_b"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(V.dot("_a", "_b") / (V.norm("_a") * V.norm("_b")), 6).alias("cosine"))


@searches(f"""WITH s AS (SELECT a.vec_id AS query, b.vec_id AS id, b.label, round({_DOT}, 9) AS score FROM embeddings a JOIN embeddings b ON true WHERE a.vec_id < 30),
r AS (SELECT *, row_number() OVER (PARTITION BY query, label ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 5) SELECT query, label, round(avg(score), 6) AS score FROM r GROUP BY 1, 2""", 30)
def mean_topk_cosine(spark, d, only="true"):
    x = _vectors(spark, d)
    return V.block_top_k(x.where(only), x, 5, by="label").groupBy("query", "label").agg(F.round(F.avg(F.round("score", 9)), 6).alias("score"))


_SCORES = f"""WITH s AS (SELECT a.vec_id AS query, a.label AS target, b.label, round({_DOT}, 9) AS score, b.vec_id AS id FROM embeddings a JOIN embeddings b ON true WHERE a.vec_id < 60 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query, label ORDER BY score DESC, id) AS k FROM s QUALIFY k <= 5), m AS (SELECT query, any_value(target) AS target, label, round(avg(score), 6) AS score FROM r GROUP BY query, label),
t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, label) AS pos, rank() OVER (PARTITION BY query ORDER BY score DESC) AS strict, count(*) OVER (PARTITION BY query) AS n FROM m)"""


def _scores(spark, d, only):
    x = _vectors(spark, d).withColumn("p", F.col("id"))
    top = V.block_top_k(x.where(only), x, 5, apart=True, by="label")
    s = top.groupBy("query", "label").agg(F.round(F.avg(F.round("score", 9)), 6).alias("score"))
    return s.join(x.select(F.col("id").alias("query"), F.col("label").alias("target")), "query")


@searches(_SCORES + " SELECT query, pos AS rank_position, strict AS rank_strict, n FROM t WHERE label = target", 60)
def target_ranks(spark, d, only="true"):
    return T.target_ranks(_scores(spark, d, only), "query", "label", "score", "target")


@searches(_SCORES + " SELECT count(*) AS n_queries, round(avg((strict <= 1)::INT), 6) AS acc_at_1, round(avg((strict <= 5)::INT), 6) AS acc_at_5, round(avg(1.0 / strict), 6) AS mrr, round(avg(1.0 / n), 6) AS chance_at_1 FROM t WHERE label = target", 60)
def rank_metrics(spark, d, only="true"):
    m = T.rank_metrics(T.target_ranks(_scores(spark, d, only), "query", "label", "score", "target"), "rank_strict")
    return m.select("n_queries", *(F.round(c, 6).alias(c) for c in ("acc_at_1", "acc_at_5", "mrr", "chance_at_1")))


@searches(_SCORES + " SELECT target % 4 AS stratum, count(*) AS n_queries, round(avg(1.0 / strict), 6) AS mrr FROM (SELECT query, target, label, rank() OVER (PARTITION BY query ORDER BY score DESC) AS strict FROM m WHERE label % 4 = target % 4) WHERE label = target GROUP BY 1", 60)
def mrr_by_pool(spark, d, only="true"):
    s = _scores(spark, d, only).where("label % 4 = target % 4")
    ranks = T.target_ranks(s.withColumn("stratum", F.col("target") % 4), "query", "label", "score", "target", "stratum")
    return T.rank_metrics(ranks, "rank_strict", "stratum").select("stratum", "n_queries", F.round("mrr", 6).alias("mrr"))


@searches(_SCORES + " SELECT CASE WHEN label = target THEN 'hit' WHEN label % 4 = target % 4 THEN 'same stratum' ELSE 'other' END AS outcome, count(*) AS n FROM t WHERE pos = 1 GROUP BY 1", 60)
def error_breakdown(spark, d, only="true"):
    from lexmill.operators.selecting import first_per

    top = first_per(_scores(spark, d, only), ["query"], F.desc("score"), F.asc("label"))
    kind = F.when(F.col("label") == F.col("target"), "hit").when(F.col("label") % 4 == F.col("target") % 4, "same stratum").otherwise("other")
    return top.groupBy(kind.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@searches(_SCORES + " SELECT query, label, round((score - avg(score) OVER (PARTITION BY label)) / (stddev_pop(score) OVER (PARTITION BY label) + 1e-9), 4) AS z FROM m", 60)
def zscore_scores(spark, d, only="true"):
    s = cut(_scores(spark, d, only))
    of = s.groupBy("label").agg(F.avg("score").alias("_m"), F.stddev_pop("score").alias("_s"))  # a window would put a label into one task
    return s.join(of, "label").select("query", "label", F.round((F.col("score") - F.col("_m")) / (F.col("_s") + 1e-9), 4).alias("z"))


@query("SELECT label, count(*) AS n, round(avg(embedding[1]::DOUBLE), 6) AS cx, round(avg(embedding[2]::DOUBLE), 6) AS cy, round(sqrt((var_samp(embedding[1]::DOUBLE) + var_samp(embedding[2]::DOUBLE)) / 2 + sqrt(((var_samp(embedding[1]::DOUBLE) - var_samp(embedding[2]::DOUBLE)) / 2) ** 2 + covar_samp(embedding[1]::DOUBLE, embedding[2]::DOUBLE) ** 2)), 6) AS major FROM embeddings GROUP BY 1 HAVING count(*) >= 3")
def covariance_ellipse(spark, d):
    pts = _vectors(spark, d).select("label", F.col("v")[0].cast("double").alias("x"), F.col("v")[1].cast("double").alias("y"))
    return V.ellipse(pts, "x", "y", "label").select("label", "n", *(F.round(c, 6).alias(c) for c in ("cx", "cy", "major")))


@query("""WITH p AS (SELECT p_partkey, (('0x' || substr(md5(p_partkey::VARCHAR), 1, 8))::BIGINT / 4294967296.0) AS p FROM part), r AS (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS k, count(*) OVER () AS m FROM p)
SELECT p_partkey, round(least(1.0, min(p * m / k) OVER (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 8) AS q FROM r""")
def bh_qvalues(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.conv(F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 8), 16, 10).cast("bigint") / float(1 << 32)).alias("p"))
    return T.bh_qvalues(p, "p").select("p_partkey", F.round("q", 8).alias("q"))


@query()
def leader_clusters(spark, d):
    return V.leader_clusters(table(spark, d, "members").groupBy("member_id").agg(F.first("member_uid").alias("member_uid"), F.first("member_matrix").alias("v"), F.max("member_count").alias("n")), "member_uid", "member_id", "v", "n", 0.7)


@query()
def debias_queries(spark, d):
    return V.debias(_vectors(spark, d).select("id", "v"), "v", 2).select("id", F.round(V.norm("v"), 6).alias("length"))


@query()
def kmeans_ari(spark, d):
    x = _vectors(spark, d)
    k = x.select("label").distinct().count()
    found = V.kmeans_labels(x, "id", "v", k, 10).join(x.select("id", "label"), "id")
    return V.adjusted_rand(found, "label", "cluster").select("n", F.round("ari", 6).alias("ari"))


@query()
def ability_prototypes(spark, d):
    m = table(spark, d, "members").groupBy("member_id").agg(F.first("member_uid").alias("uid"), F.first("member_matrix").alias("v"), F.max("member_count").alias("n"))
    protos = V.prototypes(m.where("v IS NOT NULL"), "uid", "v", "n")
    moved = V.blended(m.where("v IS NOT NULL").select("member_id", "uid", "v"), "uid", "v", protos, 0.5)
    return moved.groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(V.norm("v")), 6).alias("mean_length"))


@query()
def permutation_null(spark, d):
    x = _vectors(spark, d)
    edges = cut(_knn(spark, d).select(F.col("query").alias("src"), F.col("id").alias("dst")))
    return T.permutation_leak(edges, x, "id", "label", 10_000)


@query()
def encoded_seeds(spark, d):
    s = table(spark, d, "seeds").select("seed_id", F.col("text"))
    texts = s.select("text").distinct().withColumn("v", V.hashed_encoder()("text"))  # each text is encoded once
    return s.join(texts, "text").select("seed_id", F.size("v").alias("width"), F.round(V.norm("v"), 4).alias("length"))


@query()
def classifier_scores(spark, d):
    soft = J.soft_labels(votes(spark, d))
    texts = hits(spark, d).where("text IS NOT NULL").groupBy("uid", "passage_id").agg(F.min("text").alias("text"))
    rows = soft.join(texts, ["uid", "passage_id"]).join(M.anchors(table(spark, d, "seeds"), 2, 2, "a"), "uid")
    rows = cut(M.pair_features(rows, "anchor", "text").select("uid", "passage_id", "draw", "tokens", "p_folk", "p_inc", "p_off"))
    train = M.soft_rows(rows.where("draw = 0"), ["p_folk", "p_inc", "p_off"])
    model = M.fit_classifier(train, "y", "mass")
    return M.score_pairs([model], rows, ["uid", "passage_id"]).withColumn("retained", F.col("prob") >= 0.55).withColumn("prob", F.round("prob", 4))


@query()
def fingerprint_json(spark, d):
    texts = hits(spark, d).where("text IS NOT NULL").groupBy("uid", "passage_id").agg(F.min("text").alias("text"))
    m = table(spark, d, "members").groupBy("member_id").agg(F.first("member_uid").alias("uid"), F.first("member_matrix").alias("v"), F.max("member_count").alias("n"))
    groups = V.leader_clusters(m, "uid", "member_id", "v", "n", 0.7).groupBy("uid", F.col("leader").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
    return M.fingerprint(groups, L.lift(L.term_counts(texts, "uid", "text"), "uid"), T.distribution(votes(spark, d), "label", "uid"))
