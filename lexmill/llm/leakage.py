"""Evaluation passages that reappear, fully or partly, in a corpus: positional inverted index and proximity match."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from lexmill.runtime import cut

_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>|\[/?[a-zA-Z]+(?:=[^\]]*)?\]")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-case words without markup, entities, punctuation or quoting."""
    return _WORD.findall(_TAG.sub(" ", html.unescape(text or "")).replace("'", "").replace("’", "").lower())


def _alike(a: str, b: str) -> bool:
    """The same word, or one misspelt: one letter changed, lost, added, or two neighbours swapped."""
    if a == b:
        return True
    if min(len(a), len(b)) < 4 or abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    x, y = a[k:], b[k:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (x[1::-1] == y[:2] and x[2:] == y[2:])


def repeated(item: list[str], doc: list[str], gap: int = 3, odd: float = 0.3) -> int:
    """The most words of ``item`` that ``doc`` repeats in order and in one stretch.

    A stretch is a path of equal or misspelt words, in order on both sides, with at most ``gap`` words left out
    between two of them on either side, and whose words left out are at most ``odd`` of the item's words spanned.
    """
    places: dict[str, list[int]] = {}
    for k, w in enumerate(doc):
        places.setdefault(w, []).append(k)
    # Paths over matching places; best[(i, j)] = (words matched, item start).
    best: dict[int, dict[int, tuple[int, int]]] = {}
    most = 0
    for i, w in enumerate(item):
        row = {}
        here = list(places.get(w, ()))
        near = set()
        for back in range(1, gap + 2):
            for j in best.get(i - back, {}):
                near.update(range(j + 1, j + gap + 2))
        here += [j for j in near if j < len(doc) and doc[j] != w and _alike(doc[j], w)]
        for j in here:
            top = (1, i)
            for back in range(1, gap + 2):
                before = best.get(i - back)
                if before:
                    for step in range(1, gap + 2):
                        p = before.get(j - step)
                        if p and p[0] + 1 > top[0]:
                            top = (p[0] + 1, p[1])
            row[j] = top
            span = i - top[1] + 1
            if top[0] > most and top[0] >= (1 - odd) * span:
                most = top[0]
        best[i] = row
        best.pop(i - gap - 2, None)
    return most


def leaked_items(
    docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, share: float = 0.5, every: int = 4, band: int = 24, least: int = 2, most_broadcast: int = 500_000
) -> DataFrame:
    """(key, item, words, matched, exact): documents that repeat at least ``share`` of an item's words in one stretch.

    ``words`` are the item's, ``matched`` those repeated in order, ``exact`` whether all are, unchanged and
    unbroken. Case, punctuation, spacing, markup and quoting do not count; a word may be changed, dropped,
    added or misspelt now and then. Null or blank documents and items of fewer than four words match
    nothing; rows of one key are versions of one document or item, of which any may match; an empty table on
    either side gives no rows.

    Method: positional inverted index. Its terms are the pairs of neighbouring words of the items, its postings
    (term, document, position) cover the whole corpus. Of every ``every`` neighbouring terms of an item the one in
    the fewest documents, of those in any, is an anchor. Postings of anchors are moved by the anchor's offset in the item, and
    those of one item are intersected: ``least`` different anchors within ``band`` positions make a candidate
    (a stretch of half an item holds several times as many). Candidates are matched around these positions, by
    pairs of neighbours first, then word by word with words changed, dropped, added or misspelt. What is
    known of the items is sent to the workers if they have at most ``most_broadcast`` terms with repeats (counted
    first), else met in a shuffle.
    """
    kind, ikind = dict(docs.dtypes)[key], dict(items.dtypes)[item_key]
    corpus = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).where("_k IS NOT NULL AND _t IS NOT NULL")

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [words_of(t) for t in pdf["_t"]]
            yield pd.DataFrame({"_item": pdf["_item"], "_words": found, "_pairs": [[f"{a} {b}" for a, b in zip(w, w[1:])] for w in found]})

    given = items.select(F.col(item_key).alias("_item"), F.col(item_text).alias("_t")).where("_item IS NOT NULL AND _t IS NOT NULL").distinct()
    wanted = cut(given.mapInPandas(tokens, f"_item {ikind}, _words array<string>, _pairs array<string>").where(F.size("_words") >= 4))
    places = wanted.select("_item", F.size("_words").alias("_n"), F.posexplode("_pairs").alias("_at", "_term"))
    terms = places.select("_term").distinct()
    few = places.count() <= most_broadcast  # bounds the terms, the anchors and all words of the items
    known = frozenset(r[0] for r in terms.collect()) if few else None  # at most most_broadcast terms of the items

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            k_, term, pos = [], [], []
            for k, t in zip(pdf["_k"], pdf["_t"]):
                w = words_of(t)
                for at, p in enumerate(map(" ".join, zip(w, w[1:]))):
                    if known is None or p in known:
                        k_.append(k)
                        term.append(p)
                        pos.append(at)
            yield pd.DataFrame({"_k": pd.Series(k_, dtype=pdf["_k"].dtype), "_term": pd.Series(term, dtype=object), "_pos": pd.Series(pos, dtype="int32")})

    postings = corpus.mapInPandas(index, f"_k {kind}, _term string, _pos int")
    postings = cut(postings if few else postings.join(terms, "_term", "left_semi"))
    df = postings.groupBy("_term").agg(F.count(F.lit(1)).alias("_df"))
    rare = F.row_number().over(Window.partitionBy("_item", "_n", F.floor(F.col("_at") / every)).orderBy(F.asc_nulls_last("_df"), "_at"))
    anchors = cut(places.join(df, "_term", "left").withColumn("_rank", rare).where("_rank = 1").select("_item", "_n", "_at", "_term"))
    met = postings.join(F.broadcast(anchors) if few else anchors, "_term").select("_k", "_item", "_n", "_at", (F.col("_pos") - F.col("_at")).alias("_d"))
    # Bands overlap by half, so that anchors near each other share one.
    bands = met.withColumn("_band", F.explode(F.array(2 * F.floor(F.col("_d") / band), 2 * F.floor((F.col("_d") + band // 2) / band) + 1)))
    need = F.least(F.lit(least), F.floor(F.col("_n") / (2 * every)) + 1)
    hits = bands.groupBy("_k", "_item", "_n", "_band").agg(F.count_distinct("_at").alias("_anchors"), F.min("_d").alias("_lo"), F.max("_d").alias("_hi")).where(F.col("_anchors") >= need)
    spans = hits.groupBy("_k", "_item").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    spans = cut(spans)
    found = corpus.join(spans, "_k").join(F.broadcast(wanted.select("_item", "_words")) if few else wanted.select("_item", "_words"), "_item")

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, item, words, t, lo, hi in zip(pdf["_k"], pdf["_item"], pdf["_words"], pdf["_t"], pdf["_lo"], pdf["_hi"]):
                words, doc = list(words), words_of(t)
                part = doc[max(0, lo - band) : hi + len(words) + band]
                # At most ``odd`` of a stretch's words are left out, so many pairs of neighbours stay whole.
                pairs = set(zip(part, part[1:]))
                if sum(p in pairs for p in zip(words, words[1:])) < 0.1 * len(words) - 1:
                    continue
                n = repeated(words, part)
                if n >= share * len(words):
                    exact = n == len(words) and f" {' '.join(words)} " in f" {' '.join(part)} "
                    out.append((k, item, len(words), n, exact))
            yield pd.DataFrame(out, columns=["_k", "_item", "words", "matched", "exact"])

    best = found.mapInPandas(match, f"_k {kind}, _item {ikind}, words int, matched int, exact boolean")
    best = best.groupBy("_k", "_item").agg(F.max(F.struct("matched", "words", "exact")).alias("_m"))
    return best.select(F.col("_k").alias(key), F.col("_item").alias(item_key), F.col("_m.words").alias("words"), F.col("_m.matched").alias("matched"), F.col("_m.exact").alias("exact"))
