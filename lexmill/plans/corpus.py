"""Queries from raw comments to candidate passages and lexical profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.functions import text as X
from lexmill.operators import judgments as J, lexical as L, selecting as S
from lexmill.runtime import table
from lexmill.sources import dumps, inventory

QUERIES: dict = {}
SQL: dict = {}

WS = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
KEPT = f"(coalesce(regexp_replace(text, '^{WS}+|{WS}+$', '', 'g'), '') NOT IN ('[deleted]', '[removed]', ''))"
YEAR = "year(make_timestamp(try_cast(trunc(try_cast(created_utc AS DOUBLE)) AS BIGINT) * 1000000))"
SOURCE = "lower(nullif(trim(source), ''))"
SEGMENTS = f"list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda s: regexp_replace(s, '^{WS}+|{WS}+$', '', 'g')), lambda s: length(s) BETWEEN 40 AND 600)"
NORM = f"lower(trim(regexp_replace(text, '{WS}+', ' ', 'g')))"
HITS = """hits AS (SELECT row_id AS seq, set_name, uid, passage_id, text, lower(nullif(trim(source), '')) AS source, nullif(trim(seed_id), '') AS seed_id,
  CASE WHEN NOT isnan(hybrid_score) THEN hybrid_score END AS score, replace(replace(lower(trim(label)), ' ', '_'), '-', '_') AS label, best_ability_code AS code,
  trim(replace(annotator, ':', '-')) AS rater, pool_version, judged_at FROM lean_view)"""
VOTES = (
    "WITH "
    + HITS
    + """, votes AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid, passage_id, rater ORDER BY judged_at DESC, label DESC, code DESC NULLS LAST) AS k FROM hits)
  WHERE k = 1 AND label IN ('folk_description', 'incidental_mention', 'off_topic'))"""
)


def hash_sql(seed: str, *key: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(f"coalesce(({k})::VARCHAR, '')" for k in key)})), 1, 8))::BIGINT / 4294967296.0)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def hits(spark: SparkSession, d: str) -> DataFrame:
    return J.hits(table(spark, d, "lean_view"))


def votes(spark: SparkSession, d: str) -> DataFrame:
    return J.latest_votes(hits(spark, d))


def comments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").withColumn("source", F.lower(X.blank_to_null("source")))


@query(f"""WITH c AS (SELECT *, {SOURCE} AS src, {KEPT} AS kept FROM documents),
f AS (SELECT src, len({SEGMENTS}) AS n, row_number() OVER (PARTITION BY src ORDER BY doc_id) AS r FROM c WHERE kept),
ratio AS (SELECT src, avg(n) AS ratio FROM f WHERE r <= 5000 GROUP BY 1),
n AS (SELECT src, count(*) AS n_total, count(*) FILTER (NOT kept) AS n_deleted, count(*) FILTER (kept) AS n_kept, count(*) FILTER (kept AND {YEAR} IS NULL) AS n_unknown_year FROM c GROUP BY 1)
SELECT n.src AS source, n_total, n_deleted, n_kept, n_unknown_year, coalesce(floor(round(n_kept * ratio, 6)), 0)::BIGINT AS est_passages FROM n LEFT JOIN ratio ON n.src IS NOT DISTINCT FROM ratio.src""")
def preflight_manifest(spark, d):
    return dumps.preflight(comments(spark, d), "source", "text", "created_utc", "doc_id")


@query(f"SELECT {SOURCE} AS source, {YEAR}::INT AS year, count(*) AS n FROM documents WHERE {KEPT} GROUP BY 1, 2")
def year_histogram(spark, d):
    return comments(spark, d).where(X.is_kept("text")).groupBy("source", X.year_of("created_utc").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH s AS (SELECT doc_id, {SEGMENTS} AS l FROM documents WHERE {KEPT})
SELECT doc_id, unnest(l) AS segment, unnest(range(len(l)))::INT AS idx FROM s""")
def clean_and_segment(spark, d):
    return comments(spark, d).where(X.is_kept("text")).select("doc_id", F.posexplode(X.segments("text")).alias("idx", "segment"))


@query(f"SELECT min(doc_id) AS doc_id, count(*) AS n_copies, {NORM} AS norm FROM documents WHERE {KEPT} GROUP BY 3")
def normalize_dedup(spark, d):
    return comments(spark, d).where(X.is_kept("text")).groupBy(X.squeeze("text").alias("norm")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_copies"))


LABEL_WORDS = ["Rule spotting", "Step laying/Pattern bridging", "brilliant answer", "genius"]
LABEL_RX = S.label_pattern(LABEL_WORDS)
_CAND = f"""WITH {HITS}, a AS (SELECT *, row_number() OVER (PARTITION BY uid, passage_id ORDER BY score DESC NULLS LAST, seq) AS k FROM hits),
b AS (SELECT *, {NORM} AS norm FROM a WHERE k = 1), c AS (SELECT *, row_number() OVER (PARTITION BY uid, norm ORDER BY score DESC NULLS LAST, seq) AS t FROM b WHERE norm <> ''),
e AS (SELECT *, regexp_matches(text, '{LABEL_RX}') AS hit FROM c WHERE t = 1)"""


@query(_CAND + """, r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC NULLS LAST, seq) AS rank FROM e WHERE NOT hit)
SELECT uid, passage_id, seq, score, rank FROM r WHERE rank <= 100""")
def select_candidates(spark, d):
    return S.select_candidates(hits(spark, d), ["uid"], "passage_id", "text", "score", "seq", 100, LABEL_RX).select("uid", "passage_id", "seq", "score", "rank")


@query(_CAND + """, x AS (SELECT uid, count(*) AS n_raw FROM hits GROUP BY 1), y AS (SELECT uid, count(*) AS n_keys FROM b GROUP BY 1),
z AS (SELECT uid, count(*) AS n_texts, count(*) FILTER (NOT hit) AS n_clean FROM e GROUP BY 1)
SELECT uid, n_raw, n_keys, coalesce(n_texts, 0) AS n_texts, coalesce(n_clean, 0) AS n_clean, least(coalesce(n_clean, 0), 100) AS n_selected FROM x JOIN y USING (uid) LEFT JOIN z USING (uid)""")
def label_prefilter_funnel(spark, d):
    return S.candidate_funnel(hits(spark, d), ["uid"], "passage_id", "text", "score", "seq", 100, LABEL_RX)


@query(f"WITH {HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC NULLS LAST, seq) AS k FROM hits) SELECT uid, seq, score FROM r WHERE k <= 50")
def per_ability_cap(spark, d):
    return S.top_per(hits(spark, d), ["uid"], 50, F.desc_nulls_last("score"), F.asc("seq")).select("uid", "seq", "score")


@query(f"""WITH {HITS}, p AS (SELECT uid, passage_id, max(score) AS score FROM hits GROUP BY 1, 2),
a AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY {hash_sql('sets', 'uid', 'passage_id')}, passage_id) AS i FROM p),
b AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC NULLS LAST, passage_id) AS j FROM a WHERE i > 20)
SELECT uid, passage_id, 'random' AS set_name, i AS index FROM a WHERE i <= 20 UNION ALL SELECT uid, passage_id, 'ranked', j FROM b WHERE j <= 20""")
def random_then_ranked(spark, d):
    best = hits(spark, d).groupBy("uid", "passage_id").agg(F.max("score").alias("score"))
    return S.drawn_then_ranked(best, ["uid"], "passage_id", "score", 20, 20, "sets").select("uid", "passage_id", "set_name", "index")


@query(f"""WITH {HITS}, p AS (SELECT uid, passage_id, max(score) AS score FROM hits GROUP BY 1, 2), q AS (SELECT *, coalesce(score >= 0.75, false) AS kept FROM p),
n AS (SELECT *, count(*) FILTER (kept) OVER (PARTITION BY uid) AS n, row_number() OVER (PARTITION BY uid, kept ORDER BY CASE WHEN kept THEN {hash_sql('x', 'uid', 'passage_id')} ELSE -coalesce(score, 0) END, passage_id) AS r FROM q)
SELECT uid, passage_id, CASE WHEN kept THEN 'retained' ELSE 'backfill' END AS extraction_source FROM n WHERE CASE WHEN kept THEN r <= 40 ELSE n < 10 AND r <= 10 - n END""")
def extraction_set(spark, d):
    p = hits(spark, d).groupBy("uid", "passage_id").agg(F.max("score").alias("score")).withColumn("kept", F.coalesce(F.col("score") >= 0.75, F.lit(False)))
    return S.extraction_set(p, ["uid"], "passage_id", "score", "kept", 10, 40, "x").select("uid", "passage_id", "extraction_source")


_PLAN = f"""WITH c AS (SELECT doc_id, {SOURCE} AS src, {YEAR} AS y FROM documents), n AS (SELECT src, y, count(*) AS n FROM c GROUP BY 1, 2),
plan AS (SELECT *, ceil(30.0 / count(*) OVER (PARTITION BY src)) AS quota, sum(n) OVER (PARTITION BY src) <= 30 AS small FROM n)"""


@query(_PLAN + "SELECT src AS source, y::INT AS year, n, quota::BIGINT AS quota, CASE WHEN small THEN 1.0 ELSE least(1.0, quota / n) END::DOUBLE AS p FROM plan")
def sampling_quota_plan(spark, d):
    return S.quota_plan(comments(spark, d).withColumn("year", X.year_of("created_utc")), "source", "year", 30)


@query(_PLAN + f"SELECT c.doc_id FROM c JOIN plan ON c.src IS NOT DISTINCT FROM plan.src AND c.y IS NOT DISTINCT FROM plan.y WHERE {hash_sql('42', 'c.src', 'c.doc_id')} < CASE WHEN small THEN 1.0 ELSE least(1.0, quota / n) END")
def stratified_sample(spark, d):
    return S.stratified_sample(comments(spark, d).withColumn("year", X.year_of("created_utc")), "source", "year", "doc_id", 30, "42").select("doc_id")


@query(f"WITH r AS (SELECT member_uid, member_id, row_number() OVER (PARTITION BY member_uid ORDER BY {hash_sql('b', 'member_uid', 'member_id')}, member_id) AS k FROM (SELECT DISTINCT member_uid, member_id FROM members)) SELECT member_uid, member_id FROM r WHERE k <= 15")
def balanced_subsample(spark, d):
    m = table(spark, d, "members").select("member_uid", "member_id").distinct()
    return S.top_per(m, ["member_uid"], 15, S.hash01("b", "member_uid", "member_id"), F.asc("member_id"))


@query(f"WITH r AS (SELECT ability_code, seed_id, row_number() OVER (PARTITION BY ability_code ORDER BY {hash_sql('s', 'ability_code', 'seed_id')}, seed_id) AS k FROM seeds) SELECT ability_code, seed_id FROM r WHERE k <= 5")
def seed_sample(spark, d):
    return S.top_per(table(spark, d, "seeds"), ["ability_code"], 5, S.hash01("s", "ability_code", "seed_id"), F.asc("seed_id")).select("ability_code", "seed_id")


@query(f"""WITH k AS (SELECT DISTINCT passage_id, {hash_sql('split', 'passage_id')} AS h FROM lean_view WHERE passage_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (ORDER BY h, passage_id) AS r, count(*) OVER () AS n FROM k)
SELECT passage_id, CASE WHEN r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.8) + floor(n * 0.1) THEN 'dev' ELSE 'test' END AS split FROM r""")
def split_by_passage(spark, d):
    return S.split_by_key(table(spark, d, "lean_view").select("passage_id").distinct(), "passage_id", "split").select("passage_id", "split")


@query(f"WITH s AS (SELECT doc_id, unnest({SEGMENTS}) AS text FROM documents WHERE {KEPT}), e AS (SELECT unnest({SEGMENTS}) AS text FROM eval_items), h AS (SELECT DISTINCT {NORM} AS norm FROM e) SELECT doc_id, text AS segment FROM s WHERE {NORM} NOT IN (SELECT norm FROM h)")
def leakage_exclusion(spark, d):
    seg = comments(spark, d).where(X.is_kept("text")).select("doc_id", F.explode(X.segments("text")).alias("segment"))
    held = table(spark, d, "eval_items").select(F.explode(X.segments("text")).alias("held"))
    return S.without_leaks(seg, "segment", held, "held")


@query("WITH n AS (SELECT member_broad, member_uid FROM members GROUP BY 1, 2), k AS (SELECT member_broad FROM n GROUP BY 1 HAVING count(*) >= 2) SELECT member_id, member_uid FROM members WHERE member_broad IN (SELECT member_broad FROM k)")
def singleton_drop(spark, d):
    return S.singletons_dropped(table(spark, d, "members"), "member_broad", "member_uid").select("member_id", "member_uid")


@query(f"WITH p AS (SELECT DISTINCT ON (passage_id) passage_id, text FROM (SELECT passage_id, text FROM lean_view WHERE text IS NOT NULL ORDER BY passage_id, text)) SELECT m.member_uid AS uid, m.member_span || ' [SEP] ' || p.text AS joint, count(*) AS n, min(m.member_id) AS first_id, avg(m.member_conf::DOUBLE) AS conf FROM members m JOIN p ON m.member_passage_id = p.passage_id WHERE length(trim(m.member_span)) >= 8 GROUP BY 1, 2")
def joint_members(spark, d):
    texts = table(spark, d, "lean_view").where("text IS NOT NULL").groupBy(F.col("passage_id").alias("member_passage_id")).agg(F.min("text").alias("text"))
    m = table(spark, d, "members").where(F.length(F.trim("member_span")) >= 8).join(texts, "member_passage_id")
    return m.groupBy(F.col("member_uid").alias("uid"), F.concat_ws(" [SEP] ", "member_span", "text").alias("joint")).agg(F.count(F.lit(1)).alias("n"), F.min("member_id").alias("first_id"), F.avg(F.col("member_conf").cast("double")).alias("conf"))


_STOP = ", ".join(f"'{w}'" for w in sorted(set(X.STOPWORDS)))
_TOKENS = f"""WITH {HITS}, p AS (SELECT uid, passage_id, min(text) AS text FROM hits WHERE text IS NOT NULL GROUP BY 1, 2),
w AS (SELECT uid, regexp_replace(regexp_replace(regexp_replace(unnest(regexp_extract_all(lower(text), '[a-z][a-z''’-]+')), '[''’-]+$', ''), '(n[''’]t|[''’]re|[''’]ve|[''’]ll|[''’]s|[''’]d|[''’]m)$', ''), '[''’-]+$', '') AS term FROM p),
counts AS (SELECT uid, term, count(*) AS n FROM w WHERE length(term) >= 3 AND term NOT IN ({_STOP}) GROUP BY 1, 2)"""


def _counts(spark, d):
    texts = hits(spark, d).where("text IS NOT NULL").groupBy("uid", "passage_id").agg(F.min("text").alias("text"))
    return L.term_counts(texts, "uid", "text")


@query(_TOKENS + " SELECT uid, term, n FROM counts")
def content_token_counts(spark, d):
    return _counts(spark, d)


@query(_TOKENS + """, g AS (SELECT uid, sum(n) AS g FROM counts GROUP BY 1), t AS (SELECT sum(n) AS t FROM counts), a AS (SELECT *, sum(n) OVER (PARTITION BY term) AS a FROM counts),
l AS (SELECT a.uid, a.term, a.n, round(log2((a.n::DOUBLE / g.g) / greatest((a.a - a.n)::DOUBLE / (t.t - g.g), 1.0 / (t.t - g.g))), 6) AS lift FROM a JOIN g USING (uid) CROSS JOIN t WHERE a.n >= 5),
r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY lift DESC, n DESC, term) AS rank FROM l) SELECT uid, term, n, lift, rank FROM r WHERE rank <= 10""")
def lexical_lift(spark, d):
    return L.lift(_counts(spark, d), "uid")


@query(_TOKENS + ", t AS (SELECT count(DISTINCT uid) AS m FROM counts) SELECT term, count(DISTINCT uid) AS df, round(ln((1.0 + any_value(m)) / (1.0 + count(DISTINCT uid))) + 1, 6) AS idf FROM counts CROSS JOIN t GROUP BY term")
def ability_idf(spark, d):
    return L.group_idf(_counts(spark, d), "uid").withColumn("idf", F.round("idf", 6))


@query()
def casing_counts(spark, d):
    return L.casing(comments(spark, d).where(X.is_kept("text")), "text")


@query()
def proper_nouns(spark, d):
    return L.proper_nouns(L.casing(comments(spark, d).where(X.is_kept("text")), "text"))


@query("SELECT a.uid, a.code, a.ability_name, a.broad_stratum, a.broad_name, count(*) AS n_seeds FROM abilities a JOIN seeds s ON s.ability_code = a.uid GROUP BY ALL")
def inventory_join_check(spark, d):
    return inventory.checked_inventory(table(spark, d, "abilities"), table(spark, d, "seeds"))


@query(r"""WITH p AS (SELECT uid, broad_stratum, unnest(string_split(discriminator, ';')) AS p FROM abilities),
n AS (SELECT uid, broad_stratum, regexp_extract(p, 'vs\s+([A-Za-z0-9/]+)', 1) AS c, regexp_extract(p, 'vs\s+[A-Za-z0-9/]+\s+\((G[a-z]+)\)', 1) AS s FROM p),
k AS (SELECT uid, CASE WHEN s <> '' THEN s ELSE broad_stratum END AS s, unnest(string_split(c, '/')) AS code FROM n WHERE c <> ''),
o AS (SELECT code, min(uid) AS u FROM abilities GROUP BY 1 HAVING count(*) = 1),
m AS (SELECT k.uid, coalesce(a.uid, o.u) AS other FROM k LEFT JOIN abilities a ON a.code = k.code AND a.broad_stratum = k.s LEFT JOIN o ON o.code = k.code)
SELECT DISTINCT least(uid, other) AS a, greatest(uid, other) AS b FROM m WHERE other IS NOT NULL AND other <> uid""")
def discriminator_pairs(spark, d):
    return inventory.discriminator_pairs(table(spark, d, "abilities"))


@query()
def name_aliases(spark, d):
    return inventory.aliases(table(spark, d, "abilities"))


@query("SELECT source, n_total - n_deleted AS n_kept, round(n_deleted / n_total, 4) AS deleted_share, size_bytes FROM source_manifest WHERE scan_status = 'ok' AND n_total > 0")
def manifest_ok(spark, d):
    m = table(spark, d, "source_manifest").where("scan_status = 'ok' AND n_total > 0")
    return m.select("source", (F.col("n_total") - F.col("n_deleted")).alias("n_kept"), F.round(F.col("n_deleted") / F.col("n_total"), 4).alias("deleted_share"), "size_bytes")
