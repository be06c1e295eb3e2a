"""Queries on pools, judgments, agreement, coverage and classifier evaluation."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from lexmill.operators import judgments as J, selecting as S, statistics as T
from lexmill.plans.corpus import HITS, VOTES, hash_sql, hits, votes
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


_POOL = "pool AS (SELECT DISTINCT uid, passage_id FROM hits WHERE set_name = 'ranked')"
_OWN = "(code IS NULL OR code = uid)"
_COVER = VOTES + f""", c AS (SELECT uid, rater, count(*) AS n, avg((label = 'folk_description' AND {_OWN})::INT) AS prev, avg((label = 'incidental_mention')::INT) AS inc,
  avg((label = 'off_topic')::INT) AS off, avg((label = 'folk_description' AND NOT {_OWN})::INT) AS nb, avg((label = 'folk_description')::INT) AS folk_any FROM votes GROUP BY 1, 2),
m AS (SELECT uid, count(*) AS n_raters, avg(prev) AS prev, avg(inc) AS inc, avg(off) AS off, avg(nb) AS nb FROM c GROUP BY 1),
t AS (SELECT *, CASE WHEN prev >= 0.1 THEN 'high' WHEN prev > 0 THEN 'sparse' ELSE 'none' END AS tier FROM m)"""
_SOFT = VOTES + """, soft0 AS (SELECT uid, passage_id, count(*) AS n_raters, avg(coalesce(label = 'folk_description' AND code = uid, false)::INT) AS p_folk, avg((label = 'incidental_mention')::INT) AS p_inc,
  avg((NOT coalesce(label = 'folk_description' AND code = uid, false) AND label <> 'incidental_mention')::INT) AS p_off FROM votes GROUP BY 1, 2),
soft AS (SELECT *, CASE WHEN p_folk >= greatest(p_folk, p_inc, p_off) - 1e-12 THEN 'folk_description' WHEN p_inc >= greatest(p_folk, p_inc, p_off) - 1e-12 THEN 'incidental_mention' ELSE 'off_topic' END AS label FROM soft0)"""


def _pool(spark, d):
    return hits(spark, d).where("set_name = 'ranked'").select("uid", "passage_id").distinct()


def _rounded(df, *cols):
    return df.select(*(F.round(c, 6).alias(c) if c in cols else c for c in df.columns))


@query(f"WITH {HITS}, {_POOL}, j AS (SELECT h.* FROM hits h SEMI JOIN pool USING (uid, passage_id)) SELECT uid, passage_id, rater, label, seq FROM j QUALIFY row_number() OVER (PARTITION BY uid, passage_id ORDER BY rater, seq) = 1")
def first_rater_wins(spark, d):
    return J.lean_rows(_pool(spark, d), hits(spark, d)).select("uid", "passage_id", "rater", "label", "seq")


@query(f"WITH {HITS}, {_POOL} SELECT count(*) AS n_orphans, count(DISTINCT uid) AS n_pools FROM hits h ANTI JOIN pool USING (uid, passage_id)")
def orphan_judgments(spark, d):
    return J.orphans(_pool(spark, d), hits(spark, d)).agg(F.count(F.lit(1)).alias("n_orphans"), F.count_distinct("uid").alias("n_pools"))


@query(f"WITH {HITS}, {_POOL} SELECT uid, passage_id FROM pool ANTI JOIN (SELECT * FROM hits WHERE rater = 'human-r01') h USING (uid, passage_id)")
def gaps_only(spark, d):
    return J.unjudged(_pool(spark, d), hits(spark, d), "human-r01")


@query(VOTES + " SELECT uid, passage_id FROM votes WHERE rater IN ('llm-ostrich-a', 'llm-tern-2') GROUP BY 1, 2 HAVING count(DISTINCT rater) = 2")
def judged_by_all(spark, d):
    return J.judged_by_all(votes(spark, d), ["llm-ostrich-a", "llm-tern-2"])


@query(VOTES + """, o AS (SELECT uid, passage_id, label FROM votes WHERE rater = 'human-r01'), n AS (SELECT uid, passage_id, label FROM votes WHERE rater = 'human-r08')
SELECT *, 'new' AS origin FROM n UNION ALL SELECT o.*, 'old' FROM o ANTI JOIN n USING (uid, passage_id)""")
def rater_merge(spark, d):
    v = votes(spark, d)
    of = lambda r, o: v.where(F.col("rater") == r).select("uid", "passage_id", "label", F.lit(o).alias("origin"))
    return S.merge_new_over_old(of("human-r01", "old"), of("human-r08", "new"), ["uid", "passage_id"])


@query(VOTES + " SELECT uid, passage_id, rater, label, code FROM votes")
def latest_ratings(spark, d):
    return votes(spark, d).select("uid", "passage_id", "rater", "label", "code")


_PAIR = VOTES + """, p AS (SELECT a.uid, split_part(a.uid, '-', 1) AS broad, a.label AS x, b.label AS y FROM votes a JOIN votes b USING (uid, passage_id) WHERE a.rater = 'llm-ostrich-a' AND b.rater = 'llm-tern-2'),
"""


@query(_PAIR + """n AS (SELECT count(*) AS n, avg((x = y)::INT) AS po FROM p), e AS (SELECT sum(cx * cy) / (SELECT n * n FROM n) AS pe FROM (SELECT x, count(*)::DOUBLE AS cx FROM p GROUP BY 1) JOIN (SELECT y, count(*)::DOUBLE AS cy FROM p GROUP BY 1) ON x = y)
SELECT n, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa FROM n, e""")
def cohen_kappa(spark, d):
    return _rounded(T.cohen_kappa(J.rater_pairs(votes(spark, d), "llm-ostrich-a", "llm-tern-2"), "label_a", "label_b"), "agreement", "kappa")


@query(_PAIR + """n AS (SELECT broad, count(*) AS n, avg((x = y)::INT) AS po FROM p GROUP BY 1), ex AS (SELECT broad, x, count(*)::DOUBLE AS c FROM p GROUP BY 1, 2), ey AS (SELECT broad, y, count(*)::DOUBLE AS c FROM p GROUP BY 1, 2),
e AS (SELECT n.broad, coalesce(sum(ex.c * ey.c), 0) / any_value(n.n * n.n) AS pe FROM n LEFT JOIN ex USING (broad) LEFT JOIN ey ON ey.broad = ex.broad AND ey.y = ex.x GROUP BY 1)
SELECT broad, n, round(po, 6) AS agreement, CASE WHEN pe < 1 THEN round((po - pe) / (1 - pe), 6) END AS kappa FROM n JOIN e USING (broad)""")
def kappa_by_stratum(spark, d):
    pairs = J.rater_pairs(votes(spark, d), "llm-ostrich-a", "llm-tern-2").withColumn("broad", F.split_part("uid", F.lit("-"), F.lit(1)))
    return _rounded(T.cohen_kappa(pairs, "label_a", "label_b", "broad"), "agreement", "kappa")


@query(f"WITH {HITS} SELECT uid, count(*) AS n_records, count(DISTINCT passage_id) AS n_passages, count(DISTINCT (source, passage_id)) AS n_source_passages, count(DISTINCT seed_id) AS n_seeds, arg_min(source, (-n, source)) AS top_source FROM (SELECT *, count(*) OVER (PARTITION BY uid, source) AS n FROM hits) WHERE source IS NOT NULL GROUP BY 1")
def corpus_funnel(spark, d):
    n = F.count(F.lit(1)).over(Window.partitionBy("uid", "source"))
    h = hits(spark, d).where("source IS NOT NULL").withColumn("_n", n)
    return h.groupBy("uid").agg(F.count(F.lit(1)).alias("n_records"), F.count_distinct("passage_id").alias("n_passages"), F.count_distinct("source", "passage_id").alias("n_source_passages"), F.count_distinct("seed_id").alias("n_seeds"), F.min_by("source", F.struct(-F.col("_n"), "source")).alias("top_source"))


@query(f"""WITH {HITS}, p AS (SELECT uid, passage_id, max(score) AS score FROM hits GROUP BY 1, 2)
SELECT uid, count(*) AS n, count(*) FILTER (score >= 0.55) AS retained, round(count(*) FILTER (score >= 0.55) / count(*), 4) AS rate, round(avg(score), 4) AS mean_score, round(avg(score) FILTER (score >= 0.55), 4) AS mean_retained,
CASE WHEN count(*) FILTER (score >= 0.55) / count(*) >= 0.1 THEN 'high' WHEN count(*) FILTER (score >= 0.55) / count(*) >= 0.01 THEN 'sparse' ELSE 'none' END AS tier FROM p GROUP BY 1""")
def retention_report(spark, d):
    p = hits(spark, d).groupBy("uid", "passage_id").agg(F.max("score").alias("score"))
    kept = F.count(F.when(F.col("score") >= 0.55, 1))
    rate = kept / F.count(F.lit(1))
    return p.groupBy("uid").agg(
        F.count(F.lit(1)).alias("n"), kept.alias("retained"), F.round(rate, 4).alias("rate"), F.round(F.avg("score"), 4).alias("mean_score"), F.round(F.avg(F.when(F.col("score") >= 0.55, F.col("score"))), 4).alias("mean_retained"), F.when(rate >= 0.1, "high").when(rate >= 0.01, "sparse").otherwise("none").alias("tier")
    )


@query(_COVER + " SELECT uid, rater, n, round(prev, 6) AS prev, round(inc, 6) AS inc, round(off, 6) AS off, round(nb, 6) AS nb, round(folk_any, 6) AS folk_any FROM c")
def coverage_rates(spark, d):
    return _rounded(J.coverage(votes(spark, d)), "prev", "inc", "off", "nb", "folk_any")


@query(_COVER + " SELECT uid, n_raters, round(prev, 6) AS prev, round(inc, 6) AS inc, round(off, 6) AS off, round(nb, 6) AS nb, tier FROM t")
def coverage_means(spark, d):
    return _rounded(J.coverage_mean(votes(spark, d)), "prev", "inc", "off", "nb")


@query(_COVER + """, x AS (SELECT *, split_part(uid, '-', 1) AS broad FROM t) SELECT CASE WHEN grouping(broad) = 0 THEN 'stratum' WHEN grouping(tier) = 0 THEN 'tier' ELSE 'all' END AS level,
coalesce(broad, tier, 'all') AS name, count(*) AS n_abilities, round(avg(prev), 6) AS prev FROM x GROUP BY GROUPING SETS ((broad), (tier), ())""")
def coverage_rollup(spark, d):
    return _rounded(J.coverage_rollup(votes(spark, d)), "prev")


@query(VOTES + """ SELECT uid, set_name, count(*) AS n, count(*) FILTER (label = 'folk_description' AND code = uid) AS on_target, count(*) FILTER (label = 'folk_description' AND code <> uid) AS neighbour,
round(100.0 * count(*) FILTER (label = 'folk_description' AND code = uid) / count(*), 1) AS pct FROM votes GROUP BY 1, 2""")
def set_summary(spark, d):
    folk = F.col("label") == J.FOLK
    on = F.count(F.when(folk & (F.col("code") == F.col("uid")), 1))
    return votes(spark, d).groupBy("uid", "set_name").agg(F.count(F.lit(1)).alias("n"), on.alias("on_target"), F.count(F.when(folk & (F.col("code") != F.col("uid")), 1)).alias("neighbour"), F.round(100.0 * on / F.count(F.lit(1)), 1).alias("pct"))


@query(VOTES + " SELECT uid, label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY uid), 4) AS share FROM votes GROUP BY 1, 2")
def distribution_props(spark, d):
    return T.distribution(votes(spark, d), "label", "uid")


@query(_COVER + " SELECT tier, count(*) AS n, round(median(prev), 6) AS median_prev, round(median(inc), 6) AS median_inc FROM t GROUP BY 1")
def tier_medians(spark, d):
    return J.coverage_mean(votes(spark, d)).groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("prev", F.lit(0.5)), 6).alias("median_prev"), F.round(F.percentile("inc", F.lit(0.5)), 6).alias("median_inc"))


@query(_COVER + " SELECT uid, count(*) AS n_raters FROM c WHERE prev < 0.2 GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT rater) FROM c x WHERE x.uid = c.uid)")
def low_prevalence(spark, d):
    return J.coverage(votes(spark, d)).groupBy("uid").agg(F.count(F.lit(1)).alias("n_raters"), F.count(F.when(F.col("prev") < 0.2, 1)).alias("_low")).where("_low = n_raters").select("uid", "n_raters")


@query(f"WITH {HITS} SELECT uid, round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.9), 6) AS p90, round(quantile_cont(score, 0.99), 6) AS p99 FROM hits WHERE score IS NOT NULL GROUP BY 1")
def score_percentiles(spark, d):
    p = lambda q: F.round(F.percentile("score", F.lit(q)), 6)
    return hits(spark, d).where("score IS NOT NULL").groupBy("uid").agg(p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.99).alias("p99"))


@query(VOTES + " SELECT least(uid, code) AS a, greatest(uid, code) AS b, count(*) AS n FROM votes WHERE label = 'folk_description' AND code <> uid GROUP BY 1, 2")
def cross_attribution(spark, d):
    return votes(spark, d).where((F.col("label") == J.FOLK) & (F.col("code") != F.col("uid"))).groupBy(F.least("uid", "code").alias("a"), F.greatest("uid", "code").alias("b")).agg(F.count(F.lit(1)).alias("n"))


@query(_SOFT + " SELECT uid, passage_id, n_raters, round(p_folk, 6) AS p_folk, round(p_inc, 6) AS p_inc, round(p_off, 6) AS p_off, label FROM soft")
def soft_labels(spark, d):
    return _rounded(J.soft_labels(votes(spark, d)), "p_folk", "p_inc", "p_off")


@query(_SOFT + " SELECT label, count(*) AS n, round((SELECT count(*) FROM soft) / (3.0 * count(*)), 6) AS weight FROM soft GROUP BY 1")
def class_weights(spark, d):
    return _rounded(J.class_weights(J.soft_labels(votes(spark, d)), "label"), "weight")


@query(_SOFT + f""", u AS (SELECT *, row_number() OVER (ORDER BY {hash_sql('cap', 'uid', 'passage_id')}, uid, passage_id) AS r FROM soft WHERE p_off >= 1 - 1e-12)
SELECT uid, passage_id, label FROM soft WHERE p_off < 1 - 1e-12 UNION ALL SELECT uid, passage_id, label FROM u WHERE r <= (SELECT round(count(*) * 0.5) FROM soft WHERE label = 'incidental_mention')""")
def off_topic_cap(spark, d):
    return J.off_topic_capped(J.soft_labels(votes(spark, d)), 0.5, "cap").select("uid", "passage_id", "label")


@query()
def synthetic_negatives(spark, d):
    return J.reanchored(J.soft_labels(votes(spark, d)), table(spark, d, "abilities"), "neg")


@query(_SOFT + f""", k AS (SELECT passage_id, CASE WHEN {hash_sql('ds', 'passage_id')} < 0.8 THEN 'train' ELSE 'test' END AS split FROM (SELECT DISTINCT passage_id FROM soft))
SELECT coalesce(split, 'all') AS split, coalesce(label, 'all') AS label, count(*) AS n, round(sum(p_folk), 4) AS mass_folk, count(*) FILTER (greatest(p_folk, p_inc, p_off) < 1 - 1e-9) AS n_soft FROM soft JOIN k USING (passage_id) GROUP BY GROUPING SETS ((split, label), (split), ())""")
def dataset_summary(spark, d):
    s = J.soft_labels(votes(spark, d)).withColumn("split", F.when(S.hash01("ds", "passage_id") < 0.8, "train").otherwise("test"))
    s.createOrReplaceTempView("_lexmill_dataset")
    return spark.sql("""SELECT coalesce(split, 'all') AS split, coalesce(label, 'all') AS label, count(*) AS n, round(sum(p_folk), 4) AS mass_folk, count_if(greatest(p_folk, p_inc, p_off) < 1 - 1e-9) AS n_soft
        FROM _lexmill_dataset GROUP BY GROUPING SETS ((split, label), (split), ())""")


_GOLD = VOTES + """, g AS (SELECT uid, passage_id, max(score) AS score, count(*) FILTER (label = 'folk_description' AND code = uid) * 2 > count(*) AS gold FROM votes GROUP BY 1, 2)"""


def _gold(spark, d):
    on = (F.col("label") == J.FOLK) & (F.col("code") == F.col("uid"))
    return votes(spark, d).groupBy("uid", "passage_id").agg(F.max("score").alias("score"), (F.count(F.when(on, 1)) * 2 > F.count(F.lit(1))).alias("gold"))


_GRID = [round(0.05 * k, 2) for k in range(1, 20)]
_SWEEP = _GOLD + f""", t AS (SELECT unnest([{', '.join(map(str, _GRID))}])::DOUBLE AS threshold),
c AS (SELECT threshold, count(*) FILTER (score >= threshold AND gold) AS tp, count(*) FILTER (score >= threshold AND NOT gold) AS fp, count(*) FILTER (score < threshold AND gold) AS fn FROM t, g WHERE score IS NOT NULL GROUP BY 1),
s AS (SELECT threshold, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c)"""


@query(_SWEEP + " SELECT * FROM s")
def prf_sweep(spark, d):
    return _rounded(T.threshold_sweep(_gold(spark, d), "score", "gold", _GRID), "precision", "recall", "f1")


@query(_SWEEP + " SELECT threshold, f1 FROM s ORDER BY f1 DESC, threshold LIMIT 1")
def best_threshold(spark, d):
    return T.best_threshold(_rounded(T.threshold_sweep(_gold(spark, d), "score", "gold", _GRID), "f1")).select("threshold", "f1")


@query(_GOLD + """, r AS (SELECT uid, gold, sum(gold::INT) OVER w / count(*) OVER w AS p FROM g WHERE score IS NOT NULL WINDOW w AS (PARTITION BY uid ORDER BY score DESC, passage_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT uid, round(sum(p) FILTER (gold) / nullif(count(*) FILTER (gold), 0), 6) AS average_precision FROM r GROUP BY 1""")
def average_precision(spark, d):
    return _rounded(T.average_precision(_gold(spark, d).where("score IS NOT NULL"), "score", "gold", "passage_id", "uid"), "average_precision")


@query(_PAIR + """l AS (SELECT DISTINCT x AS label FROM p UNION SELECT DISTINCT y FROM p), c AS (SELECT label, (SELECT count(*) FROM p WHERE x = label AND y = label) AS tp, (SELECT count(*) FROM p WHERE x <> label AND y = label) AS fp, (SELECT count(*) FROM p WHERE x = label AND y <> label) AS fn FROM l)
SELECT label, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""")
def multiclass_metrics(spark, d):
    return _rounded(T.multiclass(J.rater_pairs(votes(spark, d), "llm-ostrich-a", "llm-tern-2"), "label_a", "label_b"), "precision", "recall", "f1")


@query(VOTES + " SELECT uid, passage_id, count(*) FILTER (label = 'folk_description') AS n_folk, count(*) AS n_raters, count(*) FILTER (label = 'folk_description') IN (0, count(*)) AS agreed FROM votes GROUP BY 1, 2")
def vote_counts(spark, d):
    folk = F.count(F.when(F.col("label") == J.FOLK, 1))
    return votes(spark, d).groupBy("uid", "passage_id").agg(folk.alias("n_folk"), F.count(F.lit(1)).alias("n_raters"), ((folk == 0) | (folk == F.count(F.lit(1)))).alias("agreed"))


@query(_GOLD + """, r AS (SELECT gold, score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM g WHERE score IS NOT NULL)
SELECT count(*) FILTER (gold) AS n1, count(*) FILTER (NOT gold) AS n2, round(sum(r) FILTER (gold) - count(*) FILTER (gold) * (count(*) FILTER (gold) + 1) / 2.0, 4) AS u1 FROM r""")
def mann_whitney_u(spark, d):
    return T.mann_whitney(_gold(spark, d), "score", "gold").select("n1", "n2", F.round("u1", 4).alias("u1"))


@query(_COVER + ", r AS (SELECT rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0 AS a, rank() OVER (ORDER BY prev) + (count(*) OVER (PARTITION BY prev) - 1) / 2.0 AS b FROM c) SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r")
def spearman(spark, d):
    return _rounded(T.spearman(J.coverage(votes(spark, d)), "n", "prev"), "rho")


@query()
def label_file_errors(spark, d):
    pool = _pool(spark, d)
    given = votes(spark, d).where("rater = 'human-r01'").select("uid", "passage_id", "label", "code")
    return J.label_file_errors(pool, given, table(spark, d, "abilities"))


@query()
def bootstrap_ci(spark, d):
    g = _gold(spark, d).withColumn("hit", F.col("gold").cast("double"))
    return T.bootstrap_mean(g, "passage_id", "hit", 2000)
