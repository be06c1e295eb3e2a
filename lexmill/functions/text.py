"""Column expressions on text. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters Unicode counts as white space.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends (SQL trim removes only U+0020)."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(SPACES))


def blank_to_null(c: Column | str) -> Column:
    s = strip(c)
    return F.when(s != "", s)


def squeeze(c: Column | str) -> Column:
    """Stripped, lower case, runs of white space as one space."""
    return F.lower(strip(F.regexp_replace(c, rf"[{SPACES}]+", " ")))


def letter_runs(c: Column | str) -> Column:
    """Array of the maximal runs of letters, lower-cased."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+"), 0)


# What a deleted comment's body is.
DELETED = ("[deleted]", "[removed]", "")
# Endings that contractions add, the longest first.
CONTRACTIONS = ("n't", "'re", "'ve", "'ll", "'s", "'d", "'m")
# Words that carry no content.
STOPWORDS = tuple(
    "the and that have for not with you this but his they her she from will would there their what about which when make can like time just him know take people into year your some could them see other than then now look only come its over think also back after use two how our work first well way even new want because any these give day most are was were been has had did does doing being who whom those where why all both each few more nor too very should ought again once here off under until while during before above below between through against own same such don doesn didn isn aren wasn weren hasn haven hadn won wouldn couldn shouldn let".split()
)


def is_kept(body: Column | str) -> Column:
    """Whether a comment is neither deleted, removed, blank nor missing."""
    return ~F.coalesce(strip(body), F.lit("")).isin(*DELETED)


def year_of(epoch: Column | str) -> Column:
    """UTC year of an epoch in seconds, written as whole or decimal number; null where it is neither."""
    c = F.col(epoch) if isinstance(epoch, str) else epoch
    return F.year(F.timestamp_seconds(c.try_cast("double").try_cast("bigint")))


def segments(text: Column | str, low: int = 40, high: int = 600) -> Column:
    """Array of the sentences of ``low`` to ``high`` characters; an approximation of a trained splitter by end marks."""
    parts = F.transform(F.regexp_extract_all(text, F.lit(r"[^.!?]+[.!?]*"), 0), strip)
    return F.filter(parts, lambda s: F.length(s).between(low, high))


def content_tokens(text: Column | str) -> Column:
    """Array of content words: lower-case words, contractions undone, at least 3 letters, no stop words."""
    c = F.lower(F.col(text) if isinstance(text, str) else text)
    ends = "|".join(e.replace("'", "['’]") for e in CONTRACTIONS)
    words = F.regexp_extract_all(c, F.lit(r"[a-z][a-z'’-]+"), 0)
    bare = F.transform(words, lambda w: F.regexp_replace(F.regexp_replace(F.regexp_replace(w, r"['’-]+$", ""), f"({ends})$", ""), r"['’-]+$", ""))
    return F.filter(bare, lambda w: (F.length(w) >= 3) & ~w.isin(*STOPWORDS))


def mid_sentence_words(text: Column | str) -> Column:
    """Array of words not at the start of a sentence and not all upper case: what shows how a word is usually cased."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"(?<=[A-Za-z0-9,;:] )[A-Za-z][A-Za-z'-]+"), 0), lambda w: w != F.upper(w))


def technical_parts(name: Column | str) -> Column:
    """A technical name without its bracket, lower-cased, and each of its parts between slashes."""
    c = F.col(name) if isinstance(name, str) else name
    bare = F.lower(strip(F.regexp_replace(c, r"\s*\([^)]*\)\s*$", "")))
    return F.array_distinct(F.concat(F.array(bare), F.transform(F.split(bare, "/"), strip)))
