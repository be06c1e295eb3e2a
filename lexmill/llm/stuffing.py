"""Pages of stuffed keywords, link lists and tag or product lists in place of sentences."""

from __future__ import annotations

import html
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

# Frequent function words of four languages; they hold sentences together and are rare in lists.
FUNCTION_WORDS = {
    "en": "the a an of to in and is was it that for on with as at by be this i you he she we they my our his her not but or if so than then there when which who what from up just can could will would have has had do did does are were been him them its into about how after before while during one two three others other some any all each more most only never nobody i've can't just through beside behind past over between under across without along around inside until against beneath opposite above below among".split(),
    "de": "der die das und ist ein eine einen nicht mit auf den dem zu von im in für es ich wir sie er man so auch nach nur wie aber sich kann bei uns unser mein meine ohne nie jede des hat war".split(),
    "fr": "le la les un une des et est pas avec dans pour que qui du au ce se il elle on nous je sans plus mais peut notre mon ma à d'un en après même jamais de".split(),
    "es": "el la los las un una y es no con en para que de del al se lo su por como más pero sin mi puede nuestra nuestro tras nunca cualquier desde".split(),
}
LANGUAGES = tuple(FUNCTION_WORDS)
_ALL = frozenset(w for words in FUNCTION_WORDS.values() for w in words)
_LINK = re.compile(r"https?:|www\.|href=|\[/?url|\]\(|\w\.(?:com|net|org|info|biz|shop|io|co|uk|de|fr|es|test|example|invalid)\b(?!\.\w)|^<a$|</a>", re.I)
_MARKUP = re.compile(rf"^[#@]\w|{_LINK.pattern}|^sku[-\d]|^[$€£]?\d+[.,]\d\d$|^[-–]\d+%", re.I)
_EDGE = re.compile(r"^[^\w#]+|[^\w]+$")
_END = re.compile(r"[.!?…]+[\"'»”)\]]*(?=\s|$)")
# Log-odds of a token for a list against a sentence, the cost of passing from one to the other, and that of starting in a list.
FUNCTION, REPEATED, MARKUP, CONTENT, LOOSE, SWITCH, START = -1.5, 2.2, 2.5, 0.1, 1.0, 4.5, 7.0
# REPEATED: said again within GAP words. LOOSE: in a run of RUN or more words without any function word.
GAP, RUN = 5, 7
BLOCK = 60
# One byte for each kind of token: function words keep (nearly) one of their own.
_BYTE = {w: bytes([128 + k % 120]) for k, w in enumerate(sorted(_ALL))}
BINS = 100  # of a block's ratio, per unit
# What is known before any block is seen, so that a handful of texts has usual ratios too: blocks of prose.
PRIOR = {105: 10, 115: 10, 120: 10, 130: 10}


_FUNCTION_BYTES = bytes(range(128, 256))


@lru_cache(maxsize=200_000)
def token_class(token: str) -> tuple[bytes, bytes, bool]:
    """What a lower-case token is, in one byte: a link, a tag, a number, a function word or any other word.

    The same with a stop behind it where the token ends a sentence, and whether there is a letter or digit in it.
    """
    if _LINK.search(token):
        kind = b"L"
    elif token[0] in "#@":
        kind = b"T"
    elif any(c.isdigit() for c in token):
        kind = b"N"
    else:
        bare = _EDGE.sub("", token)
        kind = _BYTE.get(bare, b"C") if bare else b""
    return kind, kind + b"." if _END.search(token) else kind, any(c.isalnum() for c in token)


def classes_of(tokens: list[str]) -> list[tuple[bytes, bytes, bool]]:
    """The class of each token; very long ones are links, whatever they hold."""
    return [token_class(t) if len(t) < 200 else (b"L", b"L", True) for t in tokens]


def block_ratios(classes: list[tuple[bytes, bytes, bool]]) -> list[tuple[int, float]]:
    """(length class, compression ratio) of each block of about ``BLOCK`` tokens, each written as its class.

    Sentences alternate between many function words and other words and hardly compress; repeated keywords, links
    and tags of whatever wording become runs and do.
    """
    count, out = max(1, round(len(classes) / BLOCK)), []
    for k in range(count):
        block = b"".join([c[0] for c in classes[k * len(classes) // count : (k + 1) * len(classes) // count]])
        if block:
            # 8 of zlib's bytes are header and checksum.
            out.append((int(2 * math.log2(max(16, len(block)))), len(block) / max(1, len(zlib.compress(block)) - 8)))
    return out


def sentence_ends(classes: list[tuple[bytes, bytes, bool]]) -> int:
    """The number of sentences: parts that end in a stop and of whose tokens at least a sixth are function words."""
    return sum(6 * (len(p) - len(p.translate(None, _FUNCTION_BYTES))) >= len(p) > 0 for p in b"".join([c[1] for c in classes]).split(b".")[:-1])


def language(given: str | None, words: list[str]) -> str:
    """The language by its tag, or by the function words where the tag is missing or none of the four."""
    tag = (given or "").strip().lower()[:2]
    if tag in FUNCTION_WORDS:
        return tag
    counts = [sum(w in FUNCTION_WORDS[k] for w in words) for k in LANGUAGES]
    return LANGUAGES[int(np.argmax(counts))] if words and max(counts) else "en"


@lru_cache(maxsize=200_000)
def _evidence(token: str) -> tuple[str, float | None]:
    """(word, log-odds) of a lower-case token; None where its repetition decides."""
    word = _EDGE.sub("", token)
    if _MARKUP.search(token):
        return word, MARKUP
    return word, FUNCTION if word in _ALL else None if word else 0.0


def listed(tokens: list[str]) -> list[bool]:
    """For each lower-case token, whether it stands in a list: the best path of two states through the tokens' log-odds.

    A path starts in a sentence or pays for a list, so that a few words without evidence, such as a marker, are none.
    """
    odds: list[float] = []
    last: dict[str, int] = {}
    start = 0  # of the run without any function word

    def close(end: int) -> None:
        if sum(x != 0.0 for x in odds[start:end]) >= RUN:
            odds[start:end] = [LOOSE if x == CONTENT else x for x in odds[start:end]]

    for k, t in enumerate(tokens):
        word, x = _evidence(t) if len(t) < 200 else ("", MARKUP)
        if x is None:
            at, x = last.get(word), CONTENT
            if at is not None and k - at <= GAP:
                odds[at] = x = REPEATED
            last[word] = k
        elif x == FUNCTION:
            close(k)
            start = k + 1
        odds.append(x)
    close(len(odds))
    prose, lists, back = 0.0, -START, []
    for x in odds:
        from_lists, from_prose = lists - SWITCH > prose, prose - SWITCH > lists
        prose, lists = (lists - SWITCH if from_lists else prose), (prose - SWITCH if from_prose else lists) + x
        back.append((from_lists, from_prose))
    out, state = [], lists > prose
    for step in reversed(back):
        out.append(state)
        if step[state]:
            state = not state
    return out[::-1]


def usual_ratios(counts: dict[tuple[str, int, int], int]) -> dict[tuple[str, int], tuple[float, float]]:
    """(middle, deviation) of the ratios for each language and length class, from the number of blocks of each bin.

    The length decides the middle and the deviation (half the distance of the quartiles), over all languages, as
    rare languages have few blocks of each length; a language moves the middle by the median of its own distances.
    A few blocks of prose are added to each length, and as many without distance to each language.
    """

    def quantiles(at: list[tuple[float, int]], *q: float) -> list[float]:
        at = sorted(at)
        up = np.cumsum([n for _, n in at])
        return [at[int(np.searchsorted(up, x * up[-1]))][0] for x in q]

    by_size: dict[int, Counter] = {}
    for (_, size, ratio), n in counts.items():
        by_size.setdefault(size, Counter({r / BINS: k for r, k in PRIOR.items()}))[ratio / BINS] += n
    sized = {}
    for size, c in by_size.items():
        low, middle, high = quantiles(list(c.items()), 0.25, 0.5, 0.75)
        sized[size] = middle, max((high - low) / 2, 0.05 * middle)
    by_lang: dict[str, list[tuple[float, int]]] = {}
    for (lang, size, ratio), n in counts.items():
        by_lang.setdefault(lang, [(0.0, sum(PRIOR.values()) // 2)]).append(((ratio / BINS - sized[size][0]) / sized[size][1], n))
    shift = {lang: quantiles(d, 0.5)[0] for lang, d in by_lang.items()}
    return {(lang, size): (m + shift[lang] * d, d) for lang in shift for size, (m, d) in sized.items()}


def stuffed_pages(df: DataFrame, key: str, text: str, lang: str, share: float = 0.5, redundant: float = 3.5, punctuated: float = 0.08) -> DataFrame:
    """(key, words, list_share, redundancy, punctuation, flagged) of every row; flagged are the stuffed pages.

    Null and blank texts have 0 words and are never flagged, nor are markers, single words and short answers. Rows
    are taken as they are: repeated rows give repeated results, null keys keep theirs. An empty table gives no
    rows. ``list_share`` is null where the first two measures already tell that a page is no list.

    Method: a text is cut into blocks of about 60 tokens, each written as its class (function words as themselves).
    A block's compression ratio is compared with the median of all blocks of the same length class and language, in
    units of the deviation; ``redundancy`` is the greatest of a text's blocks, ``punctuation`` its number of
    sentences that end in a stop, per word. Extreme redundancy (``redundant`` deviations, the usual bound of
    outliers) makes a page a candidate, few sentence ends (below ``punctuated``) confirm it. An exact check
    follows: tokens are divided into lists and sentences by the best path through two states (links, tags
    and words repeated within five words speak for a list, function words for a sentence), and a candidate is
    flagged if more than ``share`` of its words stand in lists. The text is read twice, once for the ratios (a
    histogram of fixed size, summed before it is shuffled) and once to judge; nothing else is kept.
    """
    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"), F.col(lang).alias("_g"))

    def parts(text: str | None, tag: str | None) -> tuple[list[str], list[tuple[bytes, bytes, bool]], str]:
        tokens = html.unescape(text or "").lower().split()
        return tokens, classes_of(tokens), language(tag, tokens)

    def ratios(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        for pdf in batches:
            for t, g in zip(pdf["_t"], pdf["_g"]):
                _, classes, tag = parts(t, g)
                found.update((tag, size, round(r * BINS)) for size, r in block_ratios(classes))
        yield pd.DataFrame([(*k, n) for k, n in found.items()], columns=["lang", "size", "ratio", "n"])

    counted = rows.select("_t", "_g").mapInPandas(ratios, "lang string, size int, ratio int, n bigint").groupBy("lang", "size", "ratio").agg(F.sum("n").alias("n"))
    # At most 4 languages by 6 length classes by the ratios that 90 bytes can have.
    usual = usual_ratios({(r.lang, r.size, r.ratio): r.n for r in counted.collect()})

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, t, g in zip(pdf["_k"], pdf["_t"], pdf["_g"]):
                tokens, classes, tag = parts(t, g)
                words = sum(c[2] for c in classes)
                far = max(((r - usual[tag, size][0]) / usual[tag, size][1] for size, r in block_ratios(classes)), default=0.0)
                ends = sentence_ends(classes) / max(1, words)
                part = None
                if far >= redundant and ends < punctuated and words:
                    part = sum(x and c[2] for c, x in zip(classes, listed(tokens))) / words
                out.append((k, words, part, far, ends, part is not None and part > share))
            yield pd.DataFrame({c: pd.Series(v, dtype=d) for (c, d), v in zip((("_k", pdf["_k"].dtype), ("words", "int64"), ("list_share", "float64"), ("redundancy", "float64"), ("punctuation", "float64"), ("flagged", "bool")), zip(*out) if out else [[]] * 6)})

    out = rows.mapInPandas(judge, f"_k {kind}, words bigint, list_share double, redundancy double, punctuation double, flagged boolean")
    return out.withColumnRenamed("_k", key)
