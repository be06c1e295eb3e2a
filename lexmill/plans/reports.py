"""Queries on extraction batches, progress and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import extraction as E, vectors as V
from lexmill.plans.corpus import HITS, hits
from lexmill.runtime import table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT ability_code, seed_id, ((row_number() OVER (PARTITION BY ability_code ORDER BY seed_id) - 1) // 3)::BIGINT AS batch FROM seeds")
def annotation_batches(spark, d):
    return E.batches(table(spark, d, "seeds"), "ability_code", ["seed_id"], 3).select("ability_code", "seed_id", "batch")


@query(r"WITH r AS (SELECT *, row_number() OVER (PARTITION BY ability_code ORDER BY seed_id) AS r FROM seeds) SELECT ability_code, string_agg(seed_id || chr(9) || regexp_replace(text, '\s+', ' ', 'g'), chr(10) ORDER BY r) AS prompt FROM r WHERE r <= 5 GROUP BY 1")
def rendered_pool(spark, d):
    return E.rendered(table(spark, d, "seeds"), "ability_code", "seed_id", "text", 5)


@query(f"""WITH {HITS}, e AS (SELECT DISTINCT uid, passage_id, 1 AS e FROM hits WHERE set_name = 'ranked'), d AS (SELECT DISTINCT uid, passage_id, 1 AS d FROM hits WHERE rater = 'llm-tern-2'),
m AS (SELECT uid, count(e) AS n_expected, count(d) FILTER (e IS NOT NULL) AS n_done, count(*) FILTER (e IS NULL) AS n_stale FROM e FULL JOIN d USING (uid, passage_id) GROUP BY 1)
SELECT *, CASE WHEN n_stale > 0 THEN 'stale' WHEN n_done = n_expected THEN 'done' WHEN n_done = 0 THEN 'missing' ELSE 'partial' END AS status FROM m""")
def annotation_progress(spark, d):
    h = hits(spark, d)
    return E.progress(h.where("set_name = 'ranked'"), h.where("rater = 'llm-tern-2'"), "uid", "passage_id")


@query("SELECT source, size_bytes, n_total FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY scanned_at, size_bytes) AS k FROM source_manifest WHERE scan_status = 'ok') WHERE k = 1")
def manifest_merge(spark, d):
    return E.merged_manifests(table(spark, d, "source_manifest"), "source", F.asc("scanned_at"), F.asc("size_bytes")).select("source", "size_bytes", "n_total")


@query(f"""WITH {HITS}, a AS (SELECT source, count(DISTINCT passage_id) AS n FROM hits WHERE source IS NOT NULL GROUP BY 1), b AS (SELECT source, count(DISTINCT passage_id) AS n FROM hits WHERE source IS NOT NULL AND text IS NOT NULL GROUP BY 1)
SELECT source, n FROM a SEMI JOIN b USING (source, n)""")
def complete_sources(spark, d):
    h = hits(spark, d).where("source IS NOT NULL")
    n = lambda x: x.groupBy("source").agg(F.count_distinct("passage_id").alias("n"))
    return E.complete_sources(n(h), n(h.where("text IS NOT NULL")))


@query("""WITH f AS (SELECT member_uid, member_broad, member_span, count(*) AS f FROM members GROUP BY 1, 2, 3), b AS (SELECT member_uid, member_broad, sum(f)::BIGINT AS n, arg_min(member_span, (-f, member_span)) AS label FROM f GROUP BY 1, 2)
SELECT member_broad, member_uid, n, round(n / sum(n) OVER (PARTITION BY member_broad), 6) AS share, label FROM b""")
def cluster_rollup(spark, d):
    return E.cluster_rollup(table(spark, d, "members"), "member_broad", "member_uid", "member_span", "member_id")


@query(f"""WITH {HITS}, p AS (SELECT uid, passage_id, max(score) AS score, max((label = 'folk_description' AND code = uid)::INT) AS hit FROM hits GROUP BY 1, 2)
SELECT uid, round(count(*) FILTER (score >= 0.55) / nullif(count(*), 0) * avg(coalesce(hit, 0)), 4) AS prevalence FROM p GROUP BY 1""")
def prevalence_estimate(spark, d):
    on = ((F.col("label") == "folk_description") & (F.col("code") == F.col("uid"))).cast("int")
    p = hits(spark, d).groupBy("uid", "passage_id").agg(F.max("score").alias("score"), F.max(on).alias("hit"))
    return p.groupBy("uid").agg(E.prevalence(F.count(F.when(F.col("score") >= 0.55, 1)), F.count(F.lit(1)), F.avg(F.coalesce("hit", F.lit(0)))).alias("prevalence"))


@query("""WITH n AS (SELECT member_uid AS uid, count(*) AS n FROM members GROUP BY 1), s AS (SELECT uid, avg(CASE WHEN NOT isnan(hybrid_score) THEN hybrid_score END) AS score FROM lean_view GROUP BY 1)
SELECT CASE WHEN n >= 10 THEN 'full' WHEN n IS NOT NULL THEN 'thin' ELSE 'none' END AS supported, count(*) AS n, round(avg(score), 6) AS mean FROM s LEFT JOIN n USING (uid) GROUP BY 1""")
def support_split(spark, d):
    s = hits(spark, d).groupBy("uid").agg(F.avg("score").alias("score"))
    return E.support_split(s, table(spark, d, "members").select(F.col("member_uid").alias("uid")), "uid", 10).select("supported", "n", F.round("mean", 6).alias("mean"))


@query()
def centred_vectors(spark, d):
    x = table(spark, d, "embeddings").select("vec_id", (F.col("label") % 4).alias("stratum"), F.col("embedding").cast("array<double>").alias("v"))
    return E.centred(x, "v", "stratum").groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(V.norm("v")), 6).alias("mean_length"))


@query()
def coerced_extractions(spark, d):
    """Event properties as loosely typed answers: none holds spans, all are readable."""
    return E.coerced(table(spark, d, "events").select("event_id", "props"), "props").select("event_id", F.size("spans").alias("n_spans"), "construal", "tone", "error")
