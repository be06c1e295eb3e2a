"""Personal information in free text, found and replaced: a semi-Markov conditional random field.

The field is trained here, on the fly, from ``SENTENCES`` made-up sentences of the patterns below, the same
ones on every run. No row of any table is used for training, and no list of names: what speaks for a name
is its form and its company.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lexmill.llm.terms import one_text

KINDS = ("email", "phone", "national_id", "street_address", "person_name")
SENTENCES, EPOCHS, BITS = 3000, 4, 16

_UP = r"[^\W\d_a-zß-öø-ÿ]"  # a letter that is no lower-case Latin one
_WORD = rf"{_UP}[\w]*(?:['’]{_UP}?\w+)?(?:-{_UP}\w+)*"
# What could be an entity at all; the field decides whether and as what.
_EMAIL = re.compile(r"(?:mailto:)?[\w][\w.+%-]*(?: ?@ ?| ?[\[({] ?at ?[\])}] ?| at )[\w-]+(?:(?: ?\. ?(?=\w)| ?[\[({] ?dot ?[\])}] ?| dot )[\w-]+)+", re.I)
_DIGITS = re.compile(r"(?:\+ ?|\()?\d[\d().\- ]{4,22}\d(?:\s*(?:ext\.?|x)\s*\d{1,5})?(?:[-\s]?[A-Z]\b)?")
_CODE = re.compile(r"\b[A-Z]{1,2}[- ]?\d(?:[ -]?\d){4,9}(?:[ -]?[A-Z])?\b|\b\d{2}-\d{4}-\d{2}[A-Z]\b")
_STREET = re.compile(rf"\b\d{{1,5}}[a-zA-Z]?,? (?:{_WORD} ){{1,3}}{_WORD}\.?(?:, (?:Apt|Unit|Flat|Suite|No)\.? ?\w+)?")
_TITLE = r"(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Professor|Sir|Rev|Herr|Frau)\b\.?"
_NAME = re.compile(rf"\b(?:(?:{_TITLE}|{_UP}\.|{_WORD}) ){{0,4}}(?:(?:van|von|de|der|den|di|da|del|la|bin|al) ){{0,2}}{_WORD}")
_AROUND = re.compile(r"[^\W_]+|[^\w\s]")
_TITLES = frozenset("mr mrs ms miss mx dr prof professor sir rev herr frau".split())


def _shape(t: str) -> str:
    return re.sub(r"(.)\1+", r"\1", re.sub(r"\d", "9", re.sub(r"[^\W\d_]", lambda m: "A" if m.group(0).isupper() else "a", t)))


def _hash(f: str) -> int:
    return zlib.crc32(f.encode("utf-8", "replace")) & ((1 << BITS) - 1)


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every segment that could be an entity; they may overlap."""
    out: set[tuple[int, int, str]] = set()
    if "@" in text or "at" in text.lower():
        for m in _EMAIL.finditer(text):
            start = m.start() + (7 if m.group(0)[:7].lower() == "mailto:" else 0)
            out.add((start, m.end(), "email"))
            # What looks like one more part of the domain may be the next sentence.
            out |= {(start, m.start() + d.start(), "email") for d in re.finditer(r" ?\. ", m.group(0)) if "." in m.group(0)[: d.start()] or "dot" in m.group(0)[: d.start()].lower()}
    if any(c.isdigit() for c in text):
        for m in _DIGITS.finditer(text):
            s = m.start() if text[m.start()] != "(" or ")" in m.group(0) else m.start() + 1
            e = m.end() if ")" not in m.group(0) or "(" in text[s : m.end()] else s + text[s : m.end()].index(")")
            out |= {(s, e, "phone"), (s, e, "national_id")}
        for m in _CODE.finditer(text):
            out.add((m.start(), m.end(), "national_id"))
        for m in _STREET.finditer(text):
            cut = [m.end(), m.end() - (text[m.end() - 1] == ".")]
            for w in re.finditer(r" [^\W\d]", m.group(0)):
                cut.append(m.start() + w.start())
            out |= {(m.start(), e, "street_address") for e in cut if " " in text[m.start() : e].strip(" ,") and re.search(r"[^\W\d_]{2}", text[m.start() : e])}
    for m in _NAME.finditer(text):
        if " " in m.group(0):
            words = [(m.start() + w.start(), m.start() + w.end()) for w in re.finditer(r"\S+", m.group(0))]
            for a in range(len(words)):
                for b in range(a + 1, len(words)):
                    if text[words[a][0]].isupper():
                        out.add((words[a][0], words[b][1], "person_name"))
    return sorted(out)


def span_features(text: str, start: int, end: int, kind: str) -> list[int]:
    """Hashed features of a whole segment as a ``kind``: its form, its words, what stands around it."""
    span = text[start:end]
    before, after = _AROUND.findall(text[max(0, start - 40) : start])[-3:], _AROUND.findall(text[end : end + 30])[:2]
    before = ["<s>"] * (3 - len(before)) + [w.lower() for w in before]
    after = [w.lower() for w in after] + ["</s>"] * (2 - len(after))
    words = span.split()
    digits = sum(c.isdigit() for c in span)
    opens = before[2] in ("<s>", ".", "!", "?", ":")
    f = [
        "bias", f"n{len(words)}", f"d{digits}", f"full {re.sub(r'[0-9]', '9', span) if digits else _shape(span)}", f"b1 {before[2]}", f"b2 {before[1]} {before[2]}", f"b3 {before[1]}", f"a1 {after[0]}", f"a2 {after[0]} {after[1]}", f"opens {opens}",
        f"first {words[0].lower().strip('.,')}" if kind != "phone" else f"start {span[0]}", f"last {words[-1].lower().strip('.,')}" if kind in ("person_name", "street_address") else f"end {span[-1].isalpha()}",
        f"cut {bool(after[0][:1].isalnum() and end < len(text) and text[end : end + 1] == ' ' and text[end + 1 : end + 2].isupper())}", f"glued {text[end : end + 1].isalnum()}",
    ]
    if kind in ("phone", "national_id"):
        f.append("gaps " + re.sub(r"\d+", lambda m: str(len(m.group(0))), span))
    if kind == "person_name":
        titled = words[0].lower().strip(".") in _TITLES
        f += [f"titled {titled}", f"titled {titled} n{len(words)}", f"initial {any(len(w.strip('.')) == 1 for w in words)}", f"upper {span.isupper()}", f"dots {any(w.endswith('.') and len(w) > 2 and w.lower().strip('.') not in _TITLES for w in words[:-1])}"]
        f += [f"w {w.lower().strip('.,')}" for w in words] + [f"opens {opens} first {words[0].lower()}"]
    if kind == "street_address":
        f += [f"w {w.lower().strip('.,')}" for w in words[1:]]
    return [_hash(f"{kind} {x}") for x in f]


def lattice(text: str) -> tuple[list[tuple[int, int, str]], list[list[int]], list[int]]:
    """Candidates in order of their ends, their features, and for each how many candidates end at or before its start."""
    c = sorted(candidates(text), key=lambda x: (x[1], x[0], x[2]))
    ends = [x[1] for x in c]
    before = [int(np.searchsorted(ends, x[0], side="right")) for x in c]
    return c, [span_features(text, *x) for x in c], before


def best_path(scores: list[float], before: list[int]) -> list[int]:
    """The set of segments that do not overlap of the highest sum; text outside scores 0."""
    top, take = [0.0], []
    for s, b in zip(scores, before):
        take.append(top[b] + s > top[-1])
        top.append(max(top[-1], top[b] + s))
    out, k = [], len(scores)
    while k:
        if take[k - 1]:
            out.append(k - 1)
            k = before[k - 1]
        else:
            k -= 1
    return out[::-1]


def expected(scores: list[float], before: list[int]) -> list[float]:
    """The probability of each segment under the field: sums over all sets of segments that do not overlap."""
    n = len(scores)
    a = [0.0] * (n + 1)  # log-sum over the first k candidates
    for k in range(n):
        a[k + 1] = float(np.logaddexp(a[k], a[before[k]] + scores[k]))
    g = [0.0] * (n + 1)
    g[n] = 1.0
    p = [0.0] * n
    for k in range(n - 1, -1, -1):
        p[k] = g[k + 1] * math.exp(a[before[k]] + scores[k] - a[k + 1])
        g[before[k]] += p[k]
        g[k] += g[k + 1] - p[k]
    return p


# The words of the training patterns.
_STREETS = "Street Road Avenue Lane Court Close Terrace Drive Way Place Square St Rd Ave Ln Dr St. Rd. Ave. Ln. Dr. Blvd Crescent Hill Row Gardens".split()
_TOWNS = "Ashby Wexford Norbury Pelham Drayton Easton Westmere Saltham".split()
_PLACES = "Lake|Cafe|Club|Radio|Platform|Lantern|Cup|Night|Festival|Library|Museum|Station|Park|Abacus|Hotel|Bridge|School|Theatre|Market|Harbour|Bakery|Tavern|Gallery|Institute|League|Prize|Show|Garden|Hall|Festival|Puzzle".split("|")
_ADJ = "Blue Golden Copper Winter North Monday Silver Grand Royal Summer Old New Green South Red Lucky Harbour Chess Quiz Heron Spring Friday".split()
_HEADS = "write to {e} for the sheets|send the answers to <{e}>|send the answers to {e}|my address is {e}, no spam please|contact: {e}|questions go to {e}|cc {e} when you post it|whoever owns {e} should reply|his inbox {e} is always full|the form bounced from {e} twice|{e} works best for me|({e} if you want the full list)|mail {e}|reach me at {e}"
_CALLS = "call {p} after six|my number is {p} if you want to join|ring {p} and ask for the desk|text me on {p} about the next round|tel: {p}|nobody picks up at {p}|leave a message, {p}|the poster with {p} on it is still up|wrong digits, it should be {p}|WhatsApp {p}|{p} is the landline|({p} - evenings only)|fax {p}|phone {p}"
_IDS = "my social security number is {i} by the way|the form even shows the SSN {i}|{i} was typed on the back of the sheet|insurance no. {i} is on file|my citizen ID is {i} and it was on the sheet|they asked for my ID card ({i}) at the door|the badge lists passport no. {i} in bold|passport {i} went missing that day|her NI number {i} leaked|ID: {i}"
_LIVES = "I live at {a} and the door is open|come round to {a} on Friday|come round to {a}, {t} on Friday|the parcel sat outside {a} for days|we moved from {a} last spring|post it to {a}|post it to {a}, {t}|deliver to: {a}|the lessons are held at {a}|we practise at {a}, {t}|{a} is where it all began|the old workshop ({a}) is gone"
_MEETS = "signed, {n}|thanks again to {n} for the chairs|ask {n} who taught me|it was {n} who showed us|the credit goes to {n}|the winner was {n} by a mile|{n} said so at the meeting|that was before {n} left the club|I learned it from {n} at school|nobody does it like {n}|my neighbour {n} came too|{n} just can't fold a paper plan|{n} is the one who can see it|I've noticed that {n} will turn it|you should see {n} juggle two lists|at the club, {n} could follow a quiet speaker|years ago, {n} could read it|in our house, {n} can write it|last winter, {n} could scale a recipe|{n} can do it in bad light|{n} could swap it|as a rule, {n} could name it|funny enough, {n} could hear it|to be fair, {n} could keep it"
_DECOYS = "order No. {4}-{4}-{2} for spice jars came via {l}|and row {2}-{2}-{4} of the chart mentions {l}|the ticket {3} {3} {3} won at {l}|page {3} of the guide says 555 points beat {l}|the rematch at {l} ended {3}-{3}-{3} on 20{2}-04-11|it costs $5.55 or 0.{3} a page at {l}|call it 4 to 7 points, {3}-{2} at the very most, at {l}|@{u}_{2} posted about {l} at 10:30-11:45|chapter {2} Road signs is our favourite since {l}|we met on the corner of {w} Street near {l}|and my phone died at {l} and my passport photo is awful|XZ-{2} fits the {l} clock|On {w}: you should see it|Re: {w} - the dog came|a round of {w}. Women in the trial came|some {w} exercise because {w} is the only thing that sticks|part {4}{4} broke|{w}'s rules never change|on Tuesday. The bus was late|nobody asked the {w} lot|those {w} immigrants came|{w} women won|Every single time the bus came|A trick known as {w}. Our landlady came|I remember {l} mostly for the sandwiches|We were told so by the Tuesday Club|Update from {w} week|version {1}.{1}.{1} of the chart came out on {2}.{2}.|people swear by the {w} drill. Women in the trial came|tag #{w} and be done|{w}, day nine. My aunt came|HE MAKES ME SICK|Only A Fool Would Do That|model {2} {2} {2} is sold out|score 555-{4} in the game|it was {4} points in {2} games|the 12 {l} stamps came|Keep {w} women out|Keep the {w} lot out|Send {w} people back|this place was clean before {w} people crawled in|Never trust {w} men|YOU FILTHY IMBECILE|YOU WILL NEVER BE ANYTHING|AND THEY ARE RIGHT|NOBODY COULD LOVE THAT|KEEP TALKING M|LOG OFF FOREVER, STUPID FOOL|WHAT A PATHETIC LITTLE MAN YOU TURNED OUT TO BE|GO BACK UNDER YOUR ROCK|EVERYONE LAUGHS AT YOU|I HOPE YOU CHOKE ON IT|Those {w} people won|The {w} method is old|Our {w} drill began|we stayed at home. {w} came later|she was good at chess. Nobody knew|take a look at it. I laughed|no use at first. We left at noon. {w} slept"
_FILL = "the rain ruined the stock count|my aunt forgot tent poles again|nobody had watered the plants|they moved the lecture to Thursday because of a squeaky hinge|the heating failed around six|Honestly, my dentist came|We queued for the ferry|A crate of paper cups arrived|it cost next to nothing"


def _made(rng: np.random.Generator) -> tuple[str, list[tuple[int, int, str]]]:
    """A sentence and its entities."""
    pick = lambda x: x[rng.integers(len(x))]
    num = lambda k: "".join(str(rng.integers(10)) for _ in range(k))

    def word(cap: bool = True) -> str:
        w = "".join(pick(["ka", "lor", "ven", "mi", "dra", "tho", "sel", "wyn", "bar", "ul", "fen", "ro", "zan", "el", "mar", "is", "chi", "ya", "gre", "holm", "nó", "zë", "ran", "quil", "mo", "den"]) for _ in range(rng.integers(2, 4)))
        return w.capitalize() if cap else w

    def name() -> str:
        last = pick([word(), word(), word(), f"{word()}-{word()}", f"O'{word()}", f"Al-{word()}", f"De {word()}", f"van {word()}", f"van der {word()}", f"de la {word()}"])
        first = pick([word(), word(), word(), word()[:1] + ".", f"{word()} {word()[:1]}.", f"{word()}-{word()[:3]}"])
        return f"{pick(['Mr', 'Mrs', 'Ms', 'Dr', 'Mr.', 'Mrs.', 'Dr.', 'Prof.', 'Prof', 'Miss'])} {last}" if rng.random() < 0.3 else f"{first} {last}"

    def email() -> str:
        user = pick([f"{word(False)}{num(2)}", f"{word(False)}.{word(False)}", f"{word(False)}_{word(False)}{num(2)}", f"{word(False)}+study{num(1)}", f"{word(False)[:1]}{word(False)}", f"{word()}.{word()}"])
        host, end = pick(["example", "mail", "post", word(False)]), pick(["com", "org", "net", "test", "example", "invalid", "de", "co"])
        return pick([f"{user}@{host}.{end}"] * 5 + [f"{user} at {host} dot {end}", f"{user} [at] {host} [dot] {end}", f"{user} (at) {host} (dot) {end}", f"{user} @ {host} . {end}", f"{user}(at){host}.{end}"])

    def phone() -> str:
        a, b, c = num(3), "555", "0" + num(3)
        return pick([f"{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}.{b}.{c}", f"+1 {a} {b} {c}", f"+1-{a}-{b}-{c}", f"1{a}{b}{c}", f"{a} - {b} - {c}", f"{a} {b} {c}", f"07700 900 {a}", f"+44 7700 900{a}", f"07700 900{a}", f"+49 30 {num(7)}", f"+1-{a}-{b}-{c} ext. {num(2)}", f"(0{num(3)}) {num(3)} {num(4)}", f"0{num(4)} {num(6)}", f"+1 ({a}) {b}-{c}"])

    def ident() -> str:
        return pick([f"{num(3)}-{num(2)}-{num(4)}", f"{num(3)} {num(2)} {num(4)}", f"QQ{num(6)}{pick('ABCD')}", f"QQ {num(2)} {num(2)} {num(2)} {pick('ABCD')}", f"AB {num(2)} {num(2)} {num(2)} {pick('ABCD')}", f"{num(2)}-{num(4)}-{num(2)}{pick('KLMN')}", f"XZ{num(7)}", f"XZ {num(3)} {num(4)}", f"C{num(8)}"])

    def place() -> str:
        return " ".join([pick(_ADJ) for _ in range(rng.integers(0, 2))] + [pick(_ADJ + [word()]), pick(_PLACES)]) if rng.random() < 0.8 else f"Lake {word()}"

    def street() -> str:
        s = f"{rng.integers(1, 9999)}{pick(['', '', '', 'b', 'a'])} {word()} {pick(_STREETS)}"
        return s + pick(["", "", "", f", Apt {num(2)}", f", Unit {num(2)}", f", Flat {num(2)}"])

    text, gold = "", []
    for k in range(rng.integers(1, 4)):
        kind = pick(["email", "phone", "national_id", "street_address", "person_name", "person_name", "decoy", "decoy", "decoy", "fill"])
        if kind in ("decoy", "fill"):
            s = pick((_DECOYS if kind == "decoy" else _FILL).split("|"))
            for d in "1234":
                while f"{{{d}}}" in s:
                    s = s.replace(f"{{{d}}}", num(int(d)), 1)
            while "{w}" in s:
                s = s.replace("{w}", word() if rng.random() < 0.8 else word().upper(), 1)
            s = s.replace("{u}", word(False)).replace("{l}", place())
            value = ""
        else:
            s = pick({"email": _HEADS, "phone": _CALLS, "national_id": _IDS, "street_address": _LIVES, "person_name": _MEETS}[kind].split("|")).replace("{t}", pick(_TOWNS))
            value = {"email": email, "phone": phone, "national_id": ident, "street_address": street, "person_name": name}[kind]()
        if rng.random() < 0.5:
            s = s[:1].upper() + s[1:] if not s.startswith("{") else s
        at = next((s.index(x) for x in ("{e}", "{p}", "{i}", "{a}", "{n}") if x in s), None)
        if at is not None:
            gold.append((len(text) + at, len(text) + at + len(value), kind))
            s = s[:at] + value + s[at + 3 :]
        text += s + pick([". ", ", ", "; ", " - ", "! ", " "] if rng.random() < 0.5 else [". ", ". ", ", "])
    return text.rstrip(), gold


@lru_cache(maxsize=1)
def weights(seed: int = 3) -> np.ndarray:
    """The field's weights: stochastic gradient ascent on the likelihood of the made-up sentences (averaged)."""
    rng = np.random.default_rng(seed)
    made = []
    for _ in range(SENTENCES):
        text, gold = _made(rng)
        c, f, before = lattice(text)
        if c:
            wanted = {(s, e, k) for s, e, k in gold}
            made.append((f, before, [float(x in wanted) for x in c]))
    w, g, total = np.zeros(1 << BITS), np.ones(1 << BITS), np.zeros(1 << BITS)
    for epoch in range(EPOCHS):
        for k in rng.permutation(len(made)):
            f, before, y = made[k]
            p = expected([float(w[x].sum()) for x in f], before)
            for x, want, have in zip(f, y, p):
                d = want - have
                if abs(d) > 1e-3:
                    at = np.unique(x)
                    g[at] += d * d
                    w[at] += 0.5 * d / np.sqrt(g[at]) - 1e-4 * w[at]
        if epoch:
            total += w
    return (total / max(1, EPOCHS - 1)).astype(np.float32)


def find(text: str, w: np.ndarray) -> list[tuple[int, int, str]]:
    """The entities of a text, in order."""
    c, f, before = lattice(text)
    if not c:
        return []
    return [c[k] for k in best_path([float(w[x].sum()) for x in f], before)]


def flat(text: str) -> tuple[str, list[int]]:
    """The text with every run of white space as one space, and the place in ``text`` of each of its characters."""
    kept = [k for k, c in enumerate(text) if not (c.isspace() and k and text[k - 1].isspace())]
    return "".join(" " if text[k].isspace() else text[k] for k in kept), kept


def entities(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, redacted, found): each key's text, the text with typed placeholders, and the entities' kinds.

    Rows of one key are versions of one record; the smallest non-null text stands for it. Null keys and keys
    without text give no row; a text without entities comes out as it is, with an empty array. Placeholders are
    ``[EMAIL]``, ``[PHONE]``, ``[NATIONAL_ID]``, ``[STREET_ADDRESS]`` and ``[PERSON_NAME]``; all else stays.

    Method: a semi-Markov conditional random field. Whole segments, proposed by their form, are scored as a kind
    by features of the segment and of what surrounds it; a dynamic programme over the segments, each of
    bounded length, chooses boundaries and kinds together. Every text is looked at; segments are sought with each
    run of white space as one space, and replaced where they stand in the text itself.
    """
    w = weights()
    docs = one_text(df, key, text)
    kind = dict(docs.dtypes)["_key"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found, clean = [], []
            for t in pdf["_text"]:
                plain, kept = flat(t)
                e = find(plain, w)
                found.append([k for _, _, k in e])
                for s, end, k in reversed(e):
                    t = f"{t[: kept[s]]}[{k.upper()}]{t[kept[end - 1] + 1 :]}"
                clean.append(t)
            yield pd.DataFrame({"_key": pdf["_key"], "_text": pdf["_text"], "redacted": clean, "found": found})

    out = docs.mapInPandas(run, f"_key {kind}, _text string, redacted string, found array<string>")
    return out.select(F.col("_key").alias(key), F.col("_text").alias(text), "redacted", "found")
