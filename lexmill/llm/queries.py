"""The queries of this subpackage, by name, and the SQL they must equal where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.functions.text import blank_to_null
from lexmill.llm import abuse, clusters, leakage, packing, personal, raters, stuffing, terms, topn, vectors
from lexmill.runtime import table


def p1_terms(spark: SparkSession, d: str) -> DataFrame:
    scored = terms.term_divergence(table(spark, d, "lean_view"), "passage_id", "text")
    return scored.withColumn("score", F.round("score", 6))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.repeated_terms(table(spark, d, "lean_view"), "passage_id", "text", 2, 2, 15, 4).select("passage_id", "term")


def p2_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.abuse_scores(table(spark, d, "lean_view"), "passage_id", "text").withColumn("score", F.round("score", 4))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse.abuse_scores(table(spark, d, "lean_view"), "passage_id", "text").where(F.col("score") >= 0.7).select("passage_id")


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lean_view")
    return abuse.source_rates(abuse.abuse_scores(rows, "passage_id", "text"), rows, "passage_id", "source")


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    found = personal.entities(table(spark, d, "lean_view"), "passage_id", "text")
    return found.select("passage_id", "redacted", F.size("found").alias("n_found"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = personal.entities(table(spark, d, "lean_view"), "passage_id", "text")
    return found.select("passage_id", F.explode(F.array_distinct("found")).alias("kind"))


def _by_seed(spark: SparkSession, d: str, n: int) -> DataFrame:
    rows = table(spark, d, "lean_view").select(blank_to_null("seed_id").alias("seed_id"), "passage_id", "hybrid_score")
    return topn.top_n(rows, "seed_id", "passage_id", "hybrid_score", n)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _by_seed(spark, d, 5).select("seed_id", "passage_id")


def p3_top20(spark: SparkSession, d: str) -> DataFrame:
    return _by_seed(spark, d, 20)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = vectors.similar_pairs(table(spark, d, "members"), "member_id", "member_matrix", "member_passage_id", 0.95)
    return pairs.select(F.col("a").alias("member_a"), F.col("b").alias("member_b"))


def p5_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The 10 most similar members of every member whose id is divisible by 100, against all members."""
    rows = table(spark, d, "members")
    found = vectors.nearest(rows, rows.where("member_id % 100 = 0"), "member_id", "member_matrix", "member_passage_id", 10)
    return found.select(F.col("query").alias("member_id"), F.col("neighbour").alias("neighbour_id"), F.round("cosine", 4).alias("cosine"), "rank")


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters.similarity_clusters(table(spark, d, "members"), "member_id", "member_uid", "member_matrix", 0.6, 5)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(spark, d).select("cluster_id", F.col("member").alias("member_id"))


def p6_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Size, cohesion and the three most typical members of each cluster."""
    typical = {f"typical_{k}": F.max(F.when(F.col("rank") == k, F.col("member"))) for k in (1, 2, 3)}
    return _clusters(spark, d).groupBy("member_uid", "cluster_id", "size").agg(F.round(F.avg("affinity"), 4).alias("cohesion"), *(c.alias(k) for k, c in typical.items()))


_VOTE = (["uid", "passage_id"], "annotator", "label", "best_ability_code", "judged_at")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    items = raters.rule_consensus(table(spark, d, "lean_view"), *_VOTE).items
    return items.where("label IS NOT NULL").select("uid", "passage_id", "label", "best_ability_code")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    items = raters.spectral_consensus(table(spark, d, "lean_view"), *_VOTE).items
    return items.select("uid", "passage_id", "n_votes", F.round("agreement", 6).alias("agreement"), "spectral_label", F.round("spectral_share", 6).alias("spectral_share"))


def p7_raters(spark: SparkSession, d: str) -> DataFrame:
    return raters.rule_consensus(table(spark, d, "lean_view"), *_VOTE).raters.select("rater", "n_votes", "n_compared", "n_agreed", "reliable")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.token_counts(table(spark, d, "documents"), "doc_id", "text"), "doc_id", capacity=2048)


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).select("doc_id", "item_id")


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.stuffed_pages(table(spark, d, "documents"), "doc_id", "text", "lang")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_scores(spark, d).where("flagged").select("doc_id").distinct()


_TERMS = """
WITH docs AS (SELECT passage_id, min(text) AS text FROM lean_view WHERE passage_id IS NOT NULL AND text IS NOT NULL GROUP BY 1),
runs AS (SELECT passage_id, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS term FROM docs),
counts AS (SELECT passage_id, term, count(*) AS tf FROM runs GROUP BY 1, 2),
lens AS (SELECT passage_id, sum(tf)::BIGINT AS doc_len FROM counts GROUP BY 1),
stats AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM counts GROUP BY 1),
total AS (SELECT sum(tf)::DOUBLE AS n FROM counts)
"""
_BEST = """
WITH best AS (SELECT trim(seed_id, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS seed_id, passage_id, max(hybrid_score) AS hybrid_score FROM lean_view
  WHERE hybrid_score IS NOT NULL AND NOT isnan(hybrid_score) AND passage_id IS NOT NULL GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY hybrid_score DESC, passage_id) AS rank FROM best WHERE seed_id <> '')
"""
_VOTES = """
WITH rows AS (SELECT uid, passage_id, trim(replace(annotator, ':', '-')) AS rater, judged_at, row_id,
    replace(replace(lower(trim(label)), ' ', '_'), '-', '_') AS label, best_ability_code AS code FROM lean_view WHERE annotator IS NOT NULL),
latest AS (SELECT *, row_number() OVER (PARTITION BY uid, passage_id, rater ORDER BY judged_at DESC, label DESC, code DESC NULLS LAST) AS k FROM rows),
valid AS (SELECT uid, passage_id, rater, label, code FROM latest WHERE k = 1 AND label IN ('folk_description', 'incidental_mention', 'off_topic')),
votes AS (SELECT *, count(*) OVER (PARTITION BY uid, passage_id) AS size FROM valid QUALIFY size >= 3),
tally AS (SELECT uid, passage_id, count(*) FILTER (label = 'folk_description') AS f, count(*) FILTER (label = 'incidental_mention') AS i, count(*) FILTER (label = 'off_topic') AS o FROM votes GROUP BY 1, 2),
less AS (SELECT v.rater, v.label, t.f - (v.label = 'folk_description')::INT AS f, t.i - (v.label = 'incidental_mention')::INT AS i, t.o - (v.label = 'off_topic')::INT AS o FROM votes v JOIN tally t USING (uid, passage_id)),
others AS (SELECT rater, label, CASE WHEN f > i AND f > o THEN 'folk_description' WHEN i > f AND i > o THEN 'incidental_mention' WHEN o > f AND o > i THEN 'off_topic' END AS top FROM less),
raters AS (SELECT rater, count(*) AS n_votes, count(top) AS n_compared, count(*) FILTER (top = label) AS n_agreed, coalesce(count(*) FILTER (top = label) >= 0.6 * count(top) AND count(top) > 0, false) AS reliable FROM others GROUP BY 1)
"""

_VECTORS = """
WITH v AS (SELECT member_id, any_value(member_passage_id) AS pid, any_value(member_matrix)::DOUBLE[] AS m FROM members WHERE member_matrix IS NOT NULL GROUP BY 1),
ok AS (SELECT member_id, pid, m, sqrt(list_inner_product(m, m)) AS len FROM v WHERE list_inner_product(m, m) > 0)
"""

QUERIES = {
    "p5_found": p5_found,
    "p5_nearest": p5_nearest,
    "p1_terms": p1_terms,
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_scores": p2_scores,
    "p2_rates": p2_rates,
    "p4_found": p4_found,
    "p4_redacted": p4_redacted,
    "p3_found": p3_found,
    "p3_top20": p3_top20,
    "p6_found": p6_found,
    "p6_clusters": p6_clusters,
    "p7_found": p7_found,
    "p7_items": p7_items,
    "p7_raters": p7_raters,
    "p8_containers": p8_containers,
    "p9_found": p9_found,
    "p9_leaks": p9_leaks,
    "p10_found": p10_found,
    "p10_scores": p10_scores,
}

SQL = {
    "p5_found": _VECTORS
    + """SELECT a.member_id AS member_a, b.member_id AS member_b FROM ok a JOIN ok b ON a.member_id < b.member_id AND a.pid <> b.pid
WHERE list_inner_product(a.m, b.m) / (a.len * b.len) >= 0.95""",
    "p5_nearest": _VECTORS
    + """, c AS (SELECT a.member_id, b.member_id AS neighbour_id, least(1.0, list_inner_product(a.m, b.m) / (a.len * b.len)) AS cosine
  FROM ok a JOIN ok b ON a.member_id <> b.member_id AND a.pid <> b.pid WHERE a.member_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY member_id ORDER BY cosine DESC, neighbour_id) AS rank FROM c)
SELECT member_id, neighbour_id, round(cosine, 4) AS cosine, rank FROM r WHERE rank <= 10""",
    "p1_terms": _TERMS
    + """SELECT c.passage_id, c.term, c.tf, s.df, s.cf, l.doc_len,
  round(((c.tf + 200 * (s.cf / n)) / (l.doc_len + 200)) * ln(((c.tf + 200 * (s.cf / n)) / (l.doc_len + 200)) / (s.cf / n)), 6) AS score
FROM counts c JOIN stats s USING (term) JOIN lens l USING (passage_id) CROSS JOIN total WHERE s.df >= 2""",
    "p1_found": _TERMS + "SELECT passage_id, term FROM counts JOIN stats USING (term) WHERE tf >= 2 AND df BETWEEN 2 AND 15 AND length(term) >= 4",
    "p3_found": _BEST + "SELECT seed_id, passage_id FROM ranked WHERE rank <= 5",
    "p3_top20": _BEST + "SELECT seed_id, passage_id, hybrid_score, rank FROM ranked WHERE rank <= 20",
    "p7_found": _VOTES
    + """, kept AS (SELECT v.* FROM votes v JOIN raters r ON v.rater = r.rater AND r.reliable),
t AS (SELECT uid, passage_id, count(*) FILTER (label = 'folk_description') AS f, count(*) FILTER (label = 'incidental_mention') AS i, count(*) FILTER (label = 'off_topic') AS o FROM kept GROUP BY 1, 2),
won AS (SELECT uid, passage_id, CASE WHEN f > i AND f > o THEN 'folk_description' WHEN i > f AND i > o THEN 'incidental_mention' WHEN o > f AND o > i THEN 'off_topic' END AS label FROM t),
codes AS (SELECT uid, passage_id, code, count(*) AS n FROM kept WHERE label = 'folk_description' AND code IS NOT NULL GROUP BY 1, 2, 3),
top AS (SELECT uid, passage_id, CASE WHEN count(*) FILTER (n = m) = 1 THEN max(code) FILTER (n = m) END AS code FROM (SELECT *, max(n) OVER (PARTITION BY uid, passage_id) AS m FROM codes) GROUP BY 1, 2)
SELECT w.uid, w.passage_id, w.label, CASE WHEN w.label = 'folk_description' THEN coalesce(top.code, '') ELSE '' END AS best_ability_code
FROM won w LEFT JOIN top USING (uid, passage_id) WHERE w.label IS NOT NULL""",
    "p7_raters": _VOTES + "SELECT rater, n_votes, n_compared, n_agreed, reliable FROM raters",
}
