"""Small fixtures with nulls, ties, repeats, empty tables and clashing names; brute force where SQL cannot tell."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import abuse, clusters, leakage, packing, personal, raters, stuffing, terms, topn, vectors


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


# 1


TEXTS = [("a", "apple apple Pear"), ("a", None), ("b", "pear fig"), ("c", ""), ("d", None), (None, "apple"), ("b", "pear fig"), ("e", "12 34")]


def test_terms_by_hand(spark):
    df = spark.createDataFrame([(*t, 1, "x") for t in TEXTS], "id string, t string, df int, term string")
    got = {(r.id, r.term): r for r in terms.term_divergence(df, "id", "t", mu=10, min_df=1).collect()}
    assert set(got) == {("a", "apple"), ("a", "pear"), ("b", "pear"), ("b", "fig")}
    r = got["a", "apple"]
    assert (r.tf, r.df, r.cf, r.doc_len) == (2, 1, 2, 3)
    pd = (2 + 10 * 0.4) / 13
    assert r.score == pytest.approx(pd * math.log(pd / 0.4))
    assert {k[1] for k in (((x.id, x.term)) for x in terms.term_divergence(df, "id", "t", min_df=2).collect())} == {"pear"}
    assert terms.term_divergence(df.limit(0), "id", "t").count() == 0


def test_hot_terms_lose_nothing(spark):
    df = spark.range(1500).select(F.col("id"), F.concat(F.lit("common word"), (F.col("id") % 700).cast("string"), F.lit(" "), F.translate((F.col("id") % 700).cast("string"), "0123456789", "abcdefghij")).alias("t"))
    got = terms.term_divergence(df, "id", "t", min_df=1)
    assert got.count() == 4500 and got.where("term = 'common'").first().df == 1500


def test_found_terms_run_no_stage_without_effect(spark, monkeypatch):
    """F2: the score, its totals and the hot terms' branch change no row of p1_found, so none of them runs."""
    from lexmill.llm import queries

    data = [(f"p{k}", f"Ledger common common word{'abcd'[k % 4]} WORD{'abcd'[k % 4]}" + " ledger" * (k < 3) + " tiny tiny" * (k == 5) + " owl owl" * (k > 37)) for k in range(40)]
    data += [("p0", None), (None, "solo solo"), ("q1", "solo solo"), ("q2", "über über Über"), ("q3", "über"), ("q4", "")]
    df = spark.createDataFrame(data, "passage_id string, text string")
    monkeypatch.setattr(queries, "table", lambda *a: df)
    got = queries.p1_found(spark, "")
    assert rows(got, "passage_id", "term") == sorted([(f"p{k}", f"word{'abcd'[k % 4]}") for k in range(40)] + [("q2", "über")])
    scored = terms.term_divergence(df, "passage_id", "text").where("tf >= 2 AND df BETWEEN 2 AND 15 AND length(term) >= 4")
    assert rows(got, "passage_id", "term") == rows(scored, "passage_id", "term")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "Join Cross" not in plan and plan.count("Join") == 1


# 2


def test_abuse_needs_company(spark):
    data = [
        ("1", "You are a worthless idiot and everyone here knows it"), ("2", "You are a w0rthl355 1d10t and everyone here knows it!"), ("3", "Log off forever, filthy b a s t a r d."), ("4", "All of these refugees are vermin and should be driven out of town"),
        ("5", "Vermin control came to fumigate the shed, so the lecture was cancelled."), ("6", "I feel like a moron whenever I forget paper cups, but everyone was kind about it."), ("7", "With the naked eye you can see the harbour lights."), ("8", "My aunt is really clever and also owns a ladder."),
        ("9", ""), ("10", None), (None, "You idiot"), ("11", "fine words. " * 20000 + "Shut your mouth you pathetic cretin, nobody asked you!"), ("1", "You are a worthless idiot and everyone here knows it"),
    ]
    got = dict(rows(abuse.abuse_scores(spark.createDataFrame([(*r, 0.5) for r in data], "k string, t string, score double"), "k", "t"), "k", "score"))
    assert {k for k, s in got.items() if s >= 0.7} == {"1", "2", "3", "4", "11"}
    assert set(got) == {str(k) for k in range(1, 12)} - {"10"}


# Written after the grammar and kept out of it: what people say in other words.
ABUSIVE = """I want to rape her|she is a stupid cow and should be fired|you're such a p4thetic l0ser|go jump in front of a train you worthless piece of shit|women belong in the kitchen, they are too dumb to drive|all muslims are terrorists, deport the lot
nobody wants you here, just die already|He fucked me so hard last night|she sucked his dick in the car|These Belkan people are cockroaches and ought to be exterminated|you f*cking b!tch|send your nudes baby|I'll slit your throat|gays deserve to be beaten|you're ugly and your whole family is ugly
hope your house burns down with you in it|kill all foreigners|shut up you fat pig|what a moron you are|I'm going to break every bone in your body|Refugees are a plague on this city|dumb bitch, go back to school|I will strangle you in your sleep|he came on her face|You are the most disgusting coward alive""".replace("\n", "|").split("|")
HARMLESS = """I hate mondays|My feet are killing me after the marathon|That goal was sick, he absolutely killed it|She shot a documentary about refugees in Berlin|Our cat is a lazy fat animal and we love her|I feel so stupid, I locked myself out again|The essay discusses why slurs like that hurt people|you should come to dinner on Friday
This fucking laptop crashed again|Migrants are welcome in our choir|We need to kill the background process|The doctor examined her breast for lumps|Dogs are animals too|He came home late and went straight to bed|The rats in our cellar are gone|you are a star|he beat me at chess again|I could murder a curry right now|they called me a loser at school and it still hurts
What an ugly building that is|The children were beaten in the last minute|Women run this bakery|Is your brother ill?|I burned my tongue, stupid hot soup|The play is about a man who insults everybody""".replace("\n", "|").split("|")


def test_abuse_in_other_words():
    w, v, b = abuse.model()
    flagged = lambda texts: np.mean([abuse.raw_scores(abuse.features(abuse.sentences(t)), w, v, b).max() > math.log(0.7 / 0.3) for t in texts])
    assert flagged(ABUSIVE) >= 0.85 and flagged(HARMLESS) <= 0.1


def test_abuse_in_fresh_draws():
    rng = np.random.default_rng(99)
    w, v, b = abuse.model()
    hit = lambda grammar, n: abuse.raw_scores(abuse.features(abuse._draw(rng, grammar, n)), w, v, b) > math.log(0.7 / 0.3)
    assert np.mean(np.concatenate([hit(g, 400) for g in (abuse.ABUSE, abuse.HATE, abuse.EXPLICIT)])) > 0.93
    assert np.mean(np.concatenate([hit(g, 400) for g in (abuse.HARMLESS, abuse.PLAIN)])) < 0.04


def test_rates_per_source(spark):
    df = spark.createDataFrame([("1", "A ", "x"), ("1", "a", "x"), ("2", " a", "x"), ("3", None, "x")], "k string, s string, source string")
    scores = spark.createDataFrame([("1", 0.9), ("2", 0.1), ("3", 0.9)], "k string, score double")
    got = {r.source: (r.records, r.flagged, r.rate) for r in abuse.source_rates(scores, df, "k", "s").collect()}
    assert got == {"a": (2, 1, 0.5), None: (1, 1, 1.0)}


# 3


def test_top_n_against_brute_force(spark):
    rng = np.random.default_rng(1)
    data = [(f"g{int(g)}", f"i{int(i):03d}", float(s)) for g, i, s in zip(rng.integers(0, 5, 3000) ** 2 // 9, rng.integers(0, 400, 3000), np.round(rng.random(3000), 2))]
    data += [("g0", "x", float("nan")), ("g0", "y", None), (None, "z", 1.0), ("g0", None, 1.0), ("inf", "a", float("inf")), ("inf", "b", float("-inf")), ("inf", "c", 3.0), ("tie", "b", 1.0), ("tie", "a", 1.0), ("tie", "é", 1.0), ("tie", "z", 1.0)]
    best: dict = {}
    for g, i, s in data:
        if g and i and s is not None and s == s:
            best.setdefault(g, {})[i] = max(s, best.get(g, {}).get(i, -math.inf))
    want = sorted((g, i, k) for g, m in best.items() for k, (i, _) in enumerate(sorted(m.items(), key=lambda x: (-x[1], x[0].encode()))[:3], 1))
    df = spark.createDataFrame([(*r, 1, 2) for r in data], "g string, i string, s double, rank int, _bin int")
    assert rows(topn.top_n(df, "g", "i", "s", 3), "g", "i", "rank") == want
    assert topn.top_n(df.limit(0), "g", "i", "s", 3).count() == 0


# 4


def test_entities_are_replaced(spark):
    text = "Write to jo.varn@example.org for the sheets. Call 202-555-0143 after six, my social security number is 978-75-5662 by the way. I live at 77 Ellbrook Lane and the door is open. Thanks again to Kora Venholm for the chairs."
    clean = "Order No. 4320-2250-11 came via Blue Heron Cafe, page 567 of the guide, and @mira_56 posted at 10:30-11:45 on Tuesday."
    df = spark.createDataFrame([("1", text), ("2", clean), ("3", ""), ("4", None), (None, text), ("1", text), ("5", "word " * 50000)], "k string, found string")
    got = {r.k: r for r in personal.entities(df.withColumnRenamed("found", "t").withColumn("found", F.lit(1)), "k", "t").collect()}
    assert sorted(got["1"].found) == sorted(personal.KINDS)
    assert got["1"].redacted == "Write to [EMAIL] for the sheets. Call [PHONE] after six, my social security number is [NATIONAL_ID] by the way. I live at [STREET_ADDRESS] and the door is open. Thanks again to [PERSON_NAME] for the chairs."
    assert (got["2"].redacted, got["2"].found) == (clean, [])
    assert set(got) == {"1", "2", "3", "5"}


def test_entities_that_a_narrow_filter_would_miss(spark):
    data = [
        ("1", "I learned it from Maren van der Kest at school.", "I learned it from [PERSON_NAME] at school.", ["person_name"]),
        ("2", "Thanks\xa0 again to  Kora \t Venholm  for the  chairs.", "Thanks\xa0 again to  [PERSON_NAME]  for the  chairs.", ["person_name"]),
        ("3", "Write to varn(at)mail.org for the sheets.", "Write to [EMAIL] for the sheets.", ["email"]),
        ("4", "Send the answers to varn at\nmail\ndot org.", "Send the answers to [EMAIL].", ["email"]),
        ("5", "I live at 77  Ellbrook\n Lane and the door is open.", "I live at [STREET_ADDRESS] and the door is open.", ["street_address"]),
        ("6", "SEND THE ANSWERS TO VARN AT MAIL DOT ORG.", "SEND THE ANSWERS TO [EMAIL].", ["email"]),
        ("7", "We did it without a map at all. My aunt was lost.", "We did it without a map at all. My aunt was lost.", []),
    ]
    got = {r.k: (r.redacted, r.found) for r in personal.entities(spark.createDataFrame([r[:2] for r in data], "k string, t string"), "k", "t").collect()}
    assert got == {k: (clean, kinds) for k, _, clean, kinds in data}


def test_entities_on_held_out_sentences():
    rng, w = np.random.default_rng(77), personal.weights()
    hit = said = real = 0
    for _ in range(400):
        text, gold = personal._made(rng)
        found = set(personal.find(text, w))
        hit, said, real = hit + len(found & set(gold)), said + len(found), real + len(gold)
    assert hit / said > 0.9 and hit / real > 0.9


def test_field_sums_over_all_paths():
    before, scores = [0, 0, 1, 2], [0.3, -0.2, 0.9, 0.5]
    total, weight = np.zeros(4), 0.0
    for n in range(5):
        for c in itertools.combinations(range(4), n):
            if all(a < before[b] for a, b in itertools.pairwise(c)):
                x = math.exp(sum(scores[k] for k in c))
                weight += x
                total[list(c)] += x
    assert personal.expected(scores, before) == pytest.approx(list(total / weight))


# 5 and 6


def members(seed=0):
    rng = np.random.default_rng(seed)
    out, n = [], 0
    for c in range(12):
        centre = rng.normal(size=24)
        for _ in range(9 if c < 8 else 1):
            v = centre + rng.normal(size=24) * 0.35
            out.append((n, f"u{c % 3}", f"p{n // 2}", (v * rng.uniform(0.5, 3)).astype(float).tolist()))
            if n % 5 == 0:
                n += 1
                out.append((n, f"u{c % 3}", f"p{n // 2 + 1000}", (v + rng.normal(size=24) * 0.01).astype(float).tolist()))
            n += 1
    return out


BAD = [(900, "u0", "p", None), (901, "u0", "p", [0.0] * 24), (902, "u0", "p", [float("nan")] * 24), (903, "u0", "p", [1.0]), (None, "u0", "p", [1.0] * 24)]
SCHEMA = "id long, u string, pid string, v array<double>"


def cosines(data):
    x = np.array([r[3] for r in data])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x @ x.T


@pytest.mark.parametrize("bucket,block", [(4096, 8192), (16, 12)])
def test_similar_pairs_against_brute_force(spark, bucket, block):
    data = members()
    c = cosines(data)
    want = {(data[i][0], data[j][0]) for i in range(len(data)) for j in range(i + 1, len(data)) if c[i, j] >= 0.95 and data[i][2] != data[j][2]}
    df = spark.createDataFrame([(*r, 1.0) for r in data + data[:9] + BAD], SCHEMA + ", cosine double")
    got = {(r.a, r.b) for r in vectors.similar_pairs(df, "id", "v", "pid", 0.95, bucket=bucket, block=block).collect()}
    assert want and got == want
    assert vectors.similar_pairs(df.limit(0), "id", "v", "pid").count() == 0


def test_similar_pairs_compares_all_blocks(spark, monkeypatch):
    """Above the size where vectors used to be placed in buckets nothing else than blocks decides who meets."""
    data = members()
    monkeypatch.setattr(vectors, "TILE", 16)
    c = cosines(data)
    want = {(data[i][0], data[j][0]) for i in range(len(data)) for j in range(i + 1, len(data)) if c[i, j] >= 0.3 and data[i][2] != data[j][2]}
    df = spark.createDataFrame(data, SCHEMA)
    got = {(r.a, r.b) for r in vectors.similar_pairs(df, "id", "v", "pid", 0.3, bucket=1, block=20).collect()}
    assert want and got == want
    assert vectors._plan(800_000, 0.95, 1.0, 4096) == (0, 1)


def test_similar_pairs_copies_no_row_for_other_blocks(spark):
    """the rows written between stages follow the rows, not the rows times the blocks."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 16))
    x = np.concatenate([x, x[:50] + rng.normal(size=(50, 16)) * 0.05, x[:1].repeat(30, 0)])
    data = [(k, "u", f"p{k}" if k % 9 else None, v.tolist()) for k, v in enumerate(x)]
    c = cosines(data)
    want = {(i, j) for i, j in itertools.combinations(range(len(x)), 2) if c[i, j] >= 0.95 and (data[i][2] != data[j][2] or data[i][2] is None)}
    df = spark.createDataFrame(data, "id int, u string, pid string, v array<double>")
    sc = spark.sparkContext
    store = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    before = {store().apply(k).stageId() for k in range(store().size())}
    got = vectors.similar_pairs(df, "id", "v", "pid", 0.95, block=15).collect()
    assert want and {(r.a, r.b) for r in got} == want and len(got) == len(want)
    after = store()
    written = sum(s.shuffleWriteRecords() for s in map(after.apply, range(after.size())) if s.stageId() not in before)
    assert 0 < written < 8 * len(x) + 4 * len(want)  # 32 blocks


def test_block_bounds_hold():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 24))
    x[:150] = x[150:] + rng.normal(size=(150, 24)) * 0.4
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = (x @ vectors._rotation(24, 7))[:, :16]
    q, s, e = vectors.quantise(y)
    rest = (np.sqrt(np.maximum(0, 1 - (y * y).sum(axis=1))) + 1e-4).astype(np.float32)
    left, right = vectors._block_bounds(q, s, e, 8)
    assert (left @ right.T >= x @ x.T).all()
    c = x @ x.T
    found = [p for u, v in vectors._meet_blocks((q, s, e, rest), None, 0.8, 64) for p in zip(u.tolist(), v.tolist())]
    assert len(found) == len(set(found)) and {(i, j) for i, j in itertools.combinations(range(300), 2) if c[i, j] >= 0.8} <= set(found)


def test_recall_of_hashing():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 128))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y = 0.95 * x + math.sqrt(1 - 0.95**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    bits, tables = vectors._plan(2_000_000, 0.95, 0.999, 4096)
    planes = np.random.default_rng(8).standard_normal((128, bits * tables))
    same = (((x @ planes) > 0) == ((y @ planes) > 0)).reshape(len(x), tables, bits).all(axis=2).any(axis=1)
    assert same.mean() >= 0.995  # of pairs at the threshold itself, where it is hardest


@pytest.mark.parametrize("block", [16384, 20])
def test_nearest_is_exact(spark, block):
    data = members(3)
    c = cosines(data)
    df = spark.createDataFrame(data + data[:4] + BAD, SCHEMA)
    got = rows(vectors.nearest(df, df.where("id % 10 = 0"), "id", "v", "pid", 4, block), "query", "rank", "neighbour")
    want = []
    for i, r in enumerate(data):
        if r[0] % 10 == 0:
            order = sorted((-c[i, j], s[0]) for j, s in enumerate(data) if j != i and s[2] != r[2])[:4]
            want += [(r[0], k, n) for k, (_, n) in enumerate(order, 1)]
    assert got == sorted(want)


@pytest.mark.parametrize("block", [8192, 10])
def test_clusters_against_all_cliques(spark, block):
    data = members(5)
    want = set()
    for u in {r[1] for r in data}:
        g = [r for r in data if r[1] == u]
        near = [set(np.nonzero(x)[0].tolist()) - {k} for k, x in enumerate(cosines(g) >= 0.6)]
        for q in clusters._cliques(near, 5):
            want |= {(g[q[0]][0], g[k][0]) for k in q}
    df = spark.createDataFrame([(*r, "x") for r in data + data[:7] + BAD], SCHEMA + ", cluster_id string")
    got = clusters.similarity_clusters(df, "id", "u", "v", 0.6, 5, block=block)
    assert want and {(r.cluster_id, r.member) for r in got.collect()} == want
    assert clusters.similarity_clusters(df.limit(0), "id", "u", "v").count() == 0


def test_clusters_that_overlap(spark):
    """A ring of directions: similarity is not transitive, maximal sets overlap."""
    data = [(k, "u", "p", [math.cos(a), math.sin(a)]) for k, a in enumerate(np.linspace(0, 2 * math.pi, 24, endpoint=False))]
    near = [set(np.nonzero(x)[0].tolist()) - {k} for k, x in enumerate(cosines(data) >= 0.6)]
    want = {(q[0], k) for q in clusters._cliques(near, 5) for k in q}
    got = {(r.cluster_id, r.member) for r in clusters.similarity_clusters(spark.createDataFrame(data, SCHEMA), "id", "u", "v").collect()}
    assert got == want


def test_bounds_hold():
    x = np.random.default_rng(4).normal(size=(200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, s, e = vectors.quantise(x)
    y = q.astype(float) * s[:, None]
    assert (np.abs(x @ x.T - y @ y.T) <= 1.01 * (e[:, None] + e) + 1e-6).all()


# 7


def judged(spark, data):
    cols = "uid string, p string, a string, l string, c string, at timestamp, reliable int"
    from datetime import datetime

    return spark.createDataFrame([(u, p, a, l, c, t if t is None else datetime(2020, 1, t), 1) for u, p, a, l, c, t in data], cols)


def consensus(spark, data, **k):
    return raters.spectral_consensus(judged(spark, data), ["uid", "p"], "a", "l", "c", "at", **k)


def test_consensus_and_reliability(spark):
    data = []
    for k in range(12):
        true = raters.LABELS[k % 2]
        for a in ("h-1", "h:2", " h-3 "):
            data.append(("u", f"p{k}", a, true.replace("_", " ").upper(), "u" if k % 2 == 0 else None, 2))
        data.append(("u", f"p{k}", "bad", raters.LABELS[2 - (k % 3) * (k % 2)], None, 2))
    data += [("u", "p0", "h-2", "off_topic", None, 1), ("u", "p0", "h-2", "FOLK-description", "u", 2), ("u", "p1", "late", "folk_description", "u", 1), ("u", "p1", "late", "error", None, 2), ("u", "q", "h-1", None, None, 1), ("u", "q", None, "off_topic", None, 1), (None, "q", "h-1", "off_topic", None, 1), ("u", "few", "h-1", "off_topic", None, None)]
    c = consensus(spark, data)
    items = {r.p: r for r in c.items.collect()}
    assert set(items) == {f"p{k}" for k in range(12)}
    assert all(items[f"p{k}"].label == raters.LABELS[k % 2] == items[f"p{k}"].spectral_label for k in range(12))
    assert (items["p0"].best_ability_code, items["p1"].best_ability_code) == ("u", "")
    r = {x.rater: x for x in c.raters.collect()}
    assert set(r) == {"h-1", "h-2", "h-3", "bad"}
    assert r["h-1"].reliable and not r["bad"].reliable and r["h-1"].reliability > r["bad"].reliability
    assert items["p0"].agreement == pytest.approx(0.5)


def test_consensus_shuffled_equals_broadcast_and_empty(spark):
    data = [("u", f"p{k}", f"r{j}", raters.LABELS[(k * j) % 3], "u", 1) for k in range(9) for j in range(5)]
    pick = ("uid", "p", "label", "spectral_label", "best_ability_code", "n_votes")
    assert sorted(map(str, consensus(spark, data).items.select(*pick).collect())) == sorted(map(str, consensus(spark, data, most_broadcast=0).items.select(*pick).collect()))
    none = consensus(spark, [])
    assert none.items.count() == 0 and none.raters.count() == 0


def test_found_consensus_runs_no_stage_without_effect(spark, monkeypatch):
    """p7_found is defined by the rule alone; no eigenvector is made for it, nor can one stop it."""
    from lexmill.llm import queries

    data = [("u", f"p{k}", f"r{j}", raters.LABELS[(k * j) % 3], "u" if j % 2 else None, 1) for k in range(9) for j in range(5)]
    data += [("v", "x", f"s{j}", raters.LABELS[j], "c", 1) for j in range(3)]  # raters whose items have no label given most often by the others
    data += [("v", "y", f"r{j}", raters.LABELS[0], "cC"[j == 4], 1) for j in range(5)]
    df = judged(spark, data).withColumnsRenamed({"p": "passage_id", "a": "annotator", "l": "label", "c": "best_ability_code", "at": "judged_at"})
    monkeypatch.setattr(queries, "table", lambda *a: df)
    compared, agreed, votes = {}, {}, {}
    for u, p, a, l, c, _ in data:
        votes.setdefault((u, p), {})[a] = (l, c)
    for given in votes.values():
        for a, (l, _) in given.items():
            rest = [m for b, (m, _) in given.items() if b != a]
            best = [m for m in raters.LABELS if rest.count(m) == max(map(rest.count, raters.LABELS))]
            compared[a] = compared.get(a, 0) + (len(best) == 1)
            agreed[a] = agreed.get(a, 0) + (best == [l])
    good = {a for a in compared if compared[a] and agreed[a] >= 0.6 * compared[a]}
    want = []
    for (u, p), given in votes.items():
        ls = [l for a, (l, _) in given.items() if a in good]
        best = [m for m in raters.LABELS if ls and ls.count(m) == max(map(ls.count, raters.LABELS))]
        if len(best) == 1:
            cs = [c for a, (l, c) in given.items() if a in good and l == best[0] == raters.LABELS[0] and c]
            tops = [c for c in set(cs) if cs.count(c) == max(map(cs.count, cs))]
            want.append((u, p, best[0], tops[0] if len(tops) == 1 else ""))
    assert want and rows(queries.p7_found(spark, ""), "uid", "passage_id", "label", "best_ability_code") == sorted(want)
    assert rows(queries.p7_raters(spark, ""), "rater", "n_compared", "n_agreed", "reliable") == sorted((a, compared[a], agreed[a], a in good) for a in compared)
    monkeypatch.setattr(raters, "spectral_consensus", None)
    assert queries.p7_found(spark, "").count() == len(want)


# 8


def test_packing_is_whole_and_tight(spark):
    rng = np.random.default_rng(6)
    data = [(k, int(n)) for k, n in enumerate(rng.lognormal(4, 1, 3000))] + [(9000, 2500), (9001, 0), (9002, None), (None, 40), (9003, 512), (9003, 512)]
    df = spark.createDataFrame([(*r, 1) for r in data], "id long, tokens long, container_id int")
    got = packing.pack(df, "id", capacity=512, shard=700).toPandas()
    full = got[got["container_id"].notna()]
    per = full.groupby("container_id")["tokens"].sum()
    assert per.max() <= 512 and per.mean() / 512 > 0.97
    assert full["tokens"].sum() == sum(n or 0 for _, n in data)
    assert got.loc[got["id"] == 9000, "tokens"].sum() == 2500 and set(got.loc[got["id"].isin([9001, 9002]), "container_id"].isna()) == {True}
    small = full[full["id"].isin([k for k, n in data if k is not None and n and n <= 512 and k != 9003])]
    assert small["id"].is_unique
    assert packing.pack(df.limit(0), "id").count() == 0


def test_token_counts(spark):
    from tokenizers import Tokenizer

    texts = [None, "", "hello world", "<|endoftext|>", "schön " * 3000]
    got = dict(rows(packing.token_counts(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t"), "id", "tokens"))
    t = Tokenizer.from_file(packing.TOKENIZER)
    t.encode_special_tokens = True
    assert got == {k: len(t.encode(x or "", add_special_tokens=False).ids) for k, x in enumerate(texts)}


# 9


def test_leaks(spark):
    item = "The quick brown fox jumped over seven lazy dogs while the old farmer counted his striped wooden spoons beside the narrow river bank before sunset came"
    w = item.split()
    near = w[:]
    near[3], near[9] = "dog", "hound"
    del near[15]
    near.insert(20, "really")
    near[5] = near[5][:2] + near[5][3:]
    docs = [
        (1, "Before. " + item.upper() + "! After"), (2, "> " + "\n> ".join(" ".join(w[k : k + 5]) for k in range(0, len(w), 5))), (3, "x y z " + " ".join(near)), (4, " ".join(w[: len(w) // 2 + 1]) + " and so on"),
        (5, " ".join(w[:6]) + " only few words quoted"), (6, " ".join(sorted(w))), (7, None), (8, ""), (None, item), (9, "word " * 30000 + item), (1, "Before. " + item.upper() + "! After"),
    ]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc long, t string, words int")
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "fox"), (None, item)], "item int, t string")
    for limit in (500_000, 0):
        got = {r.doc: r for r in leakage.leaked_items(df, "doc", "t", items, "item", "t", most_broadcast=limit).collect()}
        assert set(got) == {1, 2, 3, 4, 9} and got[1].exact and not got[3].exact
    assert leakage.leaked_items(df.limit(0), "doc", "t", items, "item", "t").count() == 0
    assert leakage.leaked_items(df, "doc", "t", items.limit(0), "item", "t").count() == 0


def test_leak_with_a_word_changed_in_every_bucket(spark):
    """The pairs that the changes remove stand in no document and must not be chosen as anchors."""
    w = "amber basil cedar delta ember flint grove heron indigo jasper kelp linden maple nectar olive pepper quartz raven sable tulip umber violet willow yarrow".split()
    changed = [f"zz{k}" if k % 4 == 2 else x for k, x in enumerate(w)]
    df = spark.createDataFrame([(1, "Here it is, " + " ".join(changed) + " and no more")], "doc long, t string")
    items = spark.createDataFrame([(1, " ".join(w))], "item int, t string")
    got = leakage.leaked_items(df, "doc", "t", items, "item", "t").collect()
    assert [(r.doc, r.item, r.matched, r.exact) for r in got] == [(1, 1, 18, False)]


@pytest.mark.parametrize("a,b,same", [("lantern", "lantren", True), ("lantern", "lanten", True), ("lantern", "lanterns", True), ("lantern", "lintern", True), ("lantern", "eastern", False), ("cat", "car", False)])
def test_misspelt(a, b, same):
    assert leakage._alike(a, b) == same


# 10


def test_language_of_a_whole_page():
    assert stuffing.language(None, ["the", "and"] * 1000 + ["der", "und"] * 3000) == "de"
    assert stuffing.language("fr", ["the"] * 9) == "fr"


def test_stuffed_pages(spark):
    prose = "My aunt can follow a quiet speaker through a noisy room, and nobody knows how she does it. We asked her about it once, but she only laughed and went back to her tea. "
    tags = "#buy #cheap #sale #yogamat #sale #best #buy #discount #online #trusted #cheap #yogamat #top #review #sale #best #buy"
    links = "[yoga mat](https://a.test/p/1) [fake tan](https://b.test/p/2) https://c.test/x <a href=\"https://d.test\">gold coins</a> www.e.test/y [tea](https://f.test)"
    stuffed = "Get yoga mat yoga mat yoga mat now, cheap yoga mat! Why yoga mat? Because yoga mat beats yoga mat and yoga mat is cheap. "
    docs = [(1, prose * 4), (2, tags * 3), (3, links * 4), (4, stuffed * 5), (5, prose * 6 + tags), (6, "".join(f"- {prose}\n" for _ in range(4))), (7, None), (8, "  "), (9, prose), (9, prose), (10, prose * 3000 + tags * 20)]
    df = spark.createDataFrame([(k, t, "en" if k % 2 else None, 1) for k, t in docs], "id int, t string, lang string, words int")
    got = stuffing.stuffed_pages(df, "id", "t", "lang")
    assert {r.id for r in got.where("flagged").collect()} == {2, 3, 4} and got.count() == len(docs)
    assert stuffing.stuffed_pages(df.limit(0), "id", "t", "lang").count() == 0


def test_markers_and_short_answers_are_no_lists(spark):
    texts = ["[deleted]", "[removed]", " [deleted] ", "Yes.", "lol", "Great answer!", "Danke schön!", "no no no!", "https://a.test/x", "#first", "12", "a" * 100_000]
    got = stuffing.stuffed_pages(spark.createDataFrame(list(enumerate(texts)), "id int, t string").withColumn("lang", F.lit(None).cast("string")), "id", "t", "lang")
    assert got.count() == len(texts) and got.where("flagged").count() == 0


def test_ratio_of_kinds_decides():
    """Pages of ever new links or tags are redundant though no word repeats; prose is not, in any language."""
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("bcdfghklmnprst"), 4)) + "a"
    links = " ".join(f"- https://{word()}.test/{word()}" for _ in range(60))
    prose = "my aunt can follow a quiet speaker through the noisy room and nobody at home knows how she does it when the radio is on so we asked her about it once but she only laughed and went back to her cup of tea as if that was all there is to say on it".split()
    ratio = lambda t: max(r for _, r in stuffing.block_ratios(stuffing.classes_of(t)))
    assert ratio(links.split()) > 3 * ratio(prose)
    usual = stuffing.usual_ratios({("en", 10, 120): 50, ("en", 10, 130): 50, ("de", 10, 140): 3, ("en", 8, 100): 1})
    assert usual["en", 10][0] == pytest.approx(1.2) and ("de", 8) in usual
    usual = stuffing.usual_ratios({("en", 10, 115): 500, ("en", 10, 130): 500, ("de", 10, 140): 90})
    assert usual["de", 10][0] > usual["en", 10][0]
