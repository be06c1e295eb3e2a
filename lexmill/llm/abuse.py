"""Abusive, hateful or sexually explicit text: a factorization machine over hashed terms.

The model is trained here, on the fly, from ``SAMPLES`` sentences of each kind, drawn from the grammar below, the
same ones on every run. The grammar is written from general knowledge of such language; no row of any table and
no sentence of one is in it.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lexmill.llm.terms import one_text

BITS, RANK, EPOCHS, SAMPLES, LENGTH, PART = 18, 8, 6, 9000, 128, 14

# What letters are written as to disguise a word.
LOOKALIKES = str.maketrans("аеорсухіјѕԁһӏνοαε", "aeopcyxijsdhlvoae")
DIGITS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"})

# Words by what they mean in such language. A word may be in several classes.
CLASSES = {
    "GROUP": "immigrants refugees foreigners cripples gays women muslims jews blacks gypsies migrants seekers lesbians transsexuals catholics arabs asians africans mexicans christians hindus homosexuals feminists females girls men whites turks poles roma indians chinese pakistanis atheists protestants natives aliens outsiders newcomers disabled elderly trans queers minorities".split(),
    "DEHUMAN": "vermin rats parasites animals scum subhuman filth disease cockroaches plague pests beasts savages apes monkeys pigs dogs thieves criminals rapists liars leeches maggots trash garbage cancer infection swine locusts dirt terrorists degenerates human humans subhumans inferior unclean barbarians thugs worms lice brutes".split(),
    "SEXACT": "fuck fucked fucks fucking sex blowjob handjob cum cumming sucked sucks sucking licked licking fingered threesome moaned moaning moans orgasm orgasms masturbate masturbated jerked wanked spanked deepthroat anal bang banged shagged shag rode riding humped orgy gangbang swallowed thrust pounded ejaculated".split(),
    "SEXPART": "cock dick pussy tits ass boobs clit cunt nipples penis vagina balls anus testicles butthole breasts crotch groin cocks dicks thighs".split(),
    "LEWD": "horny naked nude nudes xxx stockings panties porn porno topless kinky erotic lingerie dildo vibrator milf milfs slutty hardcore webcam camgirls explicit adults lust aroused erection".split(),
    "INSULT": "idiot moron imbecile cretin bastard bitch asshole dipshit dumbass jackass scumbag loser prick wanker twat slut whore cunt fuckwit shithead arsehole pig dimwit halfwit scum trash creep freak coward fool clown retard simpleton scum douchebag bellend tosser nitwit numbskull dunce airhead bimbo skank hag pervert weirdo psycho liar parasite leech worm maggot vermin rat snake cockroach filth garbage failure disgrace knob git plonker bonehead blockhead dullard lowlife deadbeat crybaby snowflake hypocrite mutt swine cow".split(),
    "SLUR": "worthless useless pathetic stupid disgusting filthy braindead fucking dumb ugly rotten brainless miserable sick subhuman lazy lying fat goddamn shitty vile repulsive hideous spineless gutless ignorant idiotic moronic retarded thick dense clueless mindless nasty smelly stinking wretched revolting pitiful inbred whiny sad damn bloody lousy hopeless bald toothless illiterate".split(),
    "YOU": "you your yours yourself yourselves u ur ya youre you're you've you'll youd you'd y'all".split(),
    "ME": "i me my myself mine i'm im i've i'd we us our ourselves we're".split(),
    "WILL": "i'll ill we'll gonna shall".split(),
    "BODY": "bone bones body face teeth fingers neck head bones skull legs ribs throat nose jaw arms knees eyes guts spine kneecaps faces heads noses jaws throats skulls brain brains".split(),
    "HARM": "die rot choke suffer drown disappear perish bleed burn starve jump crash vanish dead died dies rots killed".split(),
    "OUT": "deport ban expel remove exterminate sterilise exclude banish evict gas lynch purge ship deported banned expelled removed exterminated sterilised excluded banished evicted gassed lynched purged shipped caged fenced".split(),
    "STEAL": "steal lie cheat rob smell stink breed ruin infest invade leech multiply poison pollute steals lies cheats robs smells stinks breeds ruins infests invades poisons stole lied invaded infested ruined crawl crawled swarm swarmed".split(),
    "QUOTE": "called calling calls call word words slur insult insults article report reported policy rule rules course talk study speech hateful victims survivors harassment bullying bullied awareness moderators moderator filter offensive rude abuse abusive threats threatened banned apologised apologise suspended fined campaign poster helpline hotline support workshop lesson law book novel film documentary".split(),
    "SWEAR": "screw screwed damn shit crap bloody hell bugger fuck bitch ass bastard arse wtf".split(),
    "BEAST": "control fumigate fumigated infestation exterminator biologist rooster hen hens farm barn cellar attic kitten kittens puppies puppy donkey mule bird birds nest nests traps trap poison biology lizard toad zoo stable cheese fleas crops grain corn kennel vet breeder chicken dog dogs cat cats".split(),
    "CAME": ["came"],
    "MASKED": ["<masked>"],
}
# Verbs of violence; their forms follow by rule.
_HURT = "kill beat shoot hang burn stab punch smash break slap strangle cut hit kick whip drag crush slaughter murder knock hurt choke rape skin torture bury behead drown cripple thrash bash gut slit snap smack thump knife".split()


def forms(verb: str) -> list[str]:
    """The forms of an English verb, by rule and for a few irregular ones."""
    odd = {"beat": ["beaten"], "shoot": ["shot"], "hang": ["hanged", "hung"], "break": ["broke", "broken"], "strangle": []}.get(verb, [])
    stem = verb[:-1] if verb.endswith("e") else verb + verb[-1] if re.fullmatch(r"[^aeiou]*[aeiou][bdgmnpt]", verb) else verb
    return [verb, verb + ("es" if verb.endswith(("s", "sh", "ch")) else "s"), stem + "ing", stem + "ed", *odd]


def _lexicon() -> dict[str, tuple[str, ...]]:
    out: dict[str, list[str]] = {}
    for name, words in {**CLASSES, "HURT": [f for v in _HURT for f in forms(v)]}.items():
        for w in words:
            out.setdefault(w, []).append(name)
            if name in ("INSULT", "SEXPART") and not w.endswith("s"):
                out.setdefault(w + ("es" if w.endswith(("ch", "sh")) else "s"), []).append(name)
    return {w: tuple(dict.fromkeys(c)) for w, c in out.items()}


LEXICON = _lexicon()
# Classes without which a sentence has no terms at all; the others only tell what these mean.
STRONG = frozenset(CLASSES) - {"ME", "WILL", "BODY", "QUOTE", "BEAST"} | {"HURT"}
# Words that make a group of the name before them.
_BEFORE_GROUPS = frozenset("<s> the those these all no every hate of".split())
_OF_NAMES = frozenset("people folk folks lot men women immigrants refugees migrants girls kind tribe crowd".split())
# Words kept as themselves in the outline of a sentence.
OUTLINE = frozenset(
    "a an the this that these those all every any some no not never nobody nothing only just such what who is are was were be been am should must would could can will to of in for with without at on by like than and or but so if when he she they him her them his their it its out up off back go get keep hope deserve deserves hate despise better everyone somebody someone anyone feel felt said says about against than before until people folk folks lot kind sort more less barely hardly human smarter sense want wanted welcome if wrong claim claims iq hospital town".split()
)


_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_*·]){2,}[^\W\d_](?![^\W_])")
_TOKEN = re.compile(r"[^\W_]+(?:[*#@$!'’][^\W_]*)*|[^\W_]*\*+[^\W_]+")
_LONG = re.compile(r"(.)\1{2,}")
_SPLIT = re.compile(r"[.!?…]+[\"')»”]*(?:\s+|$)|\blol\b|\n{2,}")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")


def plain_tokens(sentence: str) -> list[str]:
    """Lower-case terms with disguises undone: look-alike letters, digits for letters, gaps, stars, long vowels.

    A capitalised word after the first that is in no class comes out as ``<cap>``, with an s at its end as
    ``<caps>``: a name, whatever it is, of one or of many.
    """
    out = []
    found = _TOKEN.findall(sentence)
    for k, raw in enumerate(found):
        t = raw.lower().translate(LOOKALIKES).replace("’", "'").strip("'!@$#")
        if "*" in t.strip("*"):
            t = "<masked>"
        elif any(c.isdigit() or c in "@$!" for c in t) and sum(c.isalpha() for c in t) >= 2 and not t[-1:].isdigit():
            t = t.translate(DIGITS)
        elif any(c.isdigit() for c in t) and t.translate(DIGITS) in LEXICON:
            t = t.translate(DIGITS)
        if t not in LEXICON:
            t = _LONG.sub(r"\1", t)
        if t:
            name = (k or found[1:2] and found[1].lower() in _OF_NAMES) and raw[:1].isupper() and raw[1:2].islower() and t not in LEXICON
            out.append(("<caps>" if t.endswith("s") and len(t) > 4 else "<cap>") if name else t)
    return out


def sentences(text: str) -> list[list[str]]:
    text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    text = _SPACED.sub(lambda m: re.sub(r"[ .\-_*·]", "", m.group(0)), text)
    found = [plain_tokens(s) for s in _SPLIT.split(text)]
    parts = [f[lo : lo + 40] for f in found for lo in range(0, len(f), 32)]
    # Sentences often run on without a stop; so long ones are also scored in parts.
    parts += [f[lo : lo + PART] for f in found if len(f) > PART + 4 for lo in range(0, len(f) - PART // 2, PART // 2)]
    return parts or [[]]


@lru_cache(maxsize=400_000)
def _hash(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "replace")) % ((1 << BITS) - 1) + 1


def terms_of(tokens: list[str]) -> list[int]:
    """Hashed terms of a sentence: its words, their classes, and runs of two and three of its outline.

    The outline has a word's class for the word, little words as themselves and ``_`` for all others; a name with a
    word for people behind it, or of many, counts as a group. A sentence without any telling word has no terms.
    """
    out, outline, strong = set(), ["<s>"], False
    for k, t in enumerate(tokens):
        classes = LEXICON.get(t, ())
        after, before = (tokens[k + 1] if k + 1 < len(tokens) else "</s>"), (tokens[k - 1] if k else "<s>")
        if t == "<caps>" and before in _BEFORE_GROUPS and (after in OUTLINE or after in LEXICON or after == "</s>") or t == "<cap>" and tokens[k + 1 : k + 2] and tokens[k + 1] in _OF_NAMES:
            classes = ("GROUP",)
        elif k and tokens[k - 1] == "<cap>" and t in _OF_NAMES:
            continue  # one group with the name
        if classes:
            if classes[0] != "DEHUMAN":  # these are harmless words by themselves; only their company tells
                out.add(_hash("w " + t))
            out.update(_hash("c " + c) for c in classes)
            outline.append(classes[0])
            strong = strong or not STRONG.isdisjoint(classes)
        else:
            outline.append(t if t in OUTLINE or t[0] == "<" else "_")
    if not strong:
        return []
    outline.append("</s>")
    for a, b, c in zip(outline, outline[1:], [*outline[2:], "<s>"]):
        if a in STRONG or b in STRONG:
            out.add(_hash(f"2 {a} {b}"))
        if a in STRONG or b in STRONG or c in STRONG:
            out.add(_hash(f"3 {a} {b} {c}"))
    for a, b in zip(tokens, tokens[1:]):
        if (a in LEXICON or b in LEXICON) and "DEHUMAN" not in (*LEXICON.get(a, ()), *LEXICON.get(b, ())):
            out.add(_hash(f"b {a} {b}"))
    return sorted(out)


def features(rows: list[list[str]]) -> np.ndarray:
    """The hashed terms of each sentence, padded with 0 (a bucket no term uses)."""
    found = [terms_of(r)[:LENGTH] for r in rows]
    x = np.zeros((len(rows), max(1, max(map(len, found), default=1))), dtype=np.int64)
    for k, f in enumerate(found):
        x[k, : len(f)] = f
    return x


def raw_scores(x: np.ndarray, w: np.ndarray, v: np.ndarray, b: float) -> np.ndarray:
    e = v[x]
    s = e.sum(axis=1)
    return b + w[x].sum(axis=1) + 0.5 * ((s * s).sum(axis=1) - (e * e).sum(axis=(1, 2)))


# The words that fill the grammar's slots.
SLOTS = {
    "i": "idiot moron imbecile cretin bastard bitch asshole dipshit dumbass jackass scumbag loser prick wanker twat slut whore cunt fuckwit shithead arsehole pig dimwit halfwit scum trash creep freak coward fool clown retard maggot parasite worm rat <masked>".split(),
    "s": "worthless useless pathetic stupid disgusting filthy braindead fucking dumb ugly rotten brainless miserable sick lazy lying fat goddamn shitty vile repulsive spineless ignorant idiotic thick clueless <masked>".split(),
    "g": "immigrants|refugees|foreigners|cripples|gays|women|muslims|jews|blacks|gypsies|migrants|asylum seekers|lesbians|transsexuals|catholics|arabs|asians|africans|mexicans|homosexuals|those foreigners|these migrants|the <cap> people|those <cap> people|<cap> women|<cap> men|the <cap> folk|<cap> immigrants|the <cap> lot|the <caps>|those <caps>|<caps>|the <caps>|all <caps>|you people|their kind|disabled people|old people|girls".split("|"),
    "deh": "vermin|rats|parasites|animals|scum|filth|a disease|cockroaches|a plague|pests|savages|apes|pigs|dogs|thieves|criminals|liars|leeches|maggots|trash|garbage|a cancer|subhuman|dirty animals|inferior|barbarians".split("|"),
    "hurt": [v for v in _HURT],
    "hurted": [forms(v)[-1] if v in ("beat", "shoot", "break", "hang") else forms(v)[3] for v in _HURT if v not in ("cut", "hit")],
    "body": CLASSES["BODY"],
    "harm": "die|rot|choke|drown|disappear|burn|starve|jump off a bridge|jump off a roof|die of cancer|bleed out|rot in hell|burn in hell|drop dead|get hit by a truck|choke to death|suffer".split("|"),
    "out": CLASSES["OUT"][:11],
    "outed": CLASSES["OUT"][11:],
    "part": CLASSES["SEXPART"][:10],
    "thing": "printer|kettle|spreadsheet|parcel|umbrella|newspaper|bicycle|laptop|garden shed|sofa|microwave|football boots|calendar|passport office|dishwasher|keyboard|radiator|curtain rail|suitcase|battery|recipe|train timetable|blender|tent pole|mattress|stapler|elevator|parking meter|violin|chess club|quiz night|bakery|museum|committee meeting|homework|wallet|soup|carpet|essay|exam|invoice|server|wifi|website".split("|"),
    "who": "my cousin|a neighbour|the plumber|our teacher|his sister|the manager|grandma|a student|the driver|my friend|the nurse|an old man|dad|the girl upstairs|our captain|somebody|he|she|they|we|i|the baker|the singer|my daughter|that actor|uncle joe|<cap>|the <cap> club".split("|"),
    "when": "yesterday|last week|at noon|this morning|in april|after lunch|on monday|again|every day|for hours|before bed|in the end|years ago|without a word|with a smile|||".split("|"),
    "love": "my wife|my husband|my girlfriend|my boyfriend|my ex|her boss|his neighbour|a stranger|that guy|some woman|a married man|two men|the couple|her|him|me|us".split("|"),
    "did": "fixed carried bought sold painted washed borrowed noticed remembered forgot counted opened cleaned described finished".split(),
}
# The grammar: (a|b|) is a choice, {x} a slot.
ABUSE = [
    "(you are|you're|youre|u r) (nothing but |such |just |really |)(a|an|one) (complete |total |absolute |real |little |) ({s} |){i}", "(you|ya|u) ({s} |little |{s} little |){i}", "(you're|u r) {s}( and {s}| and {i}|)", "you {s}( and {s}|)", "{i}", "(you|your) {i} (brain|face|family|opinion)",
    "(get lost|shut up|piss off|fuck off|get a life|grow up|go away|shut it|stfu|screw you|go home|delete your account|stop talking|be quiet) (you |)({s} |){i}", "(hey|listen|oi|well done|nice try|wake up) ({s} |){i} (nobody cares|no one cares|nobody reads this|)", "what a (complete |total |) {s} ({s} |little |){i} (you are|he is|she is|this is|)", "(typical|only a|just another|another) {s} {i} (says|writes|thinks|believes|needs) (that|this|so|)( about the {thing}|)",
    "(he|she|this guy|that woman|{who}) is (a|such a|nothing but a) {s} {i}( and everybody can see it|)", "(fuck|screw|damn) you( {i}| you {s} {i}| and your {thing}|)", "(listen|look|read) (here |) you {s} ({s} |){i}", "(you made|your face makes|looking at you makes) me (sick|vomit|puke)( {s} {i}|)", "you (disgust me|stink|reek|are an embarrassment|are a failure|are a disgrace|ruin everything)( {i}|)",
    "(i will|i'll|i am going to|i'm gonna|we will|we'll|someone will|somebody should|somebody ought to|one day i will) {hurt} (you|your {body}|you up|you to death|your {body} in|the shit out of you|your kids|your whole family)( you {s} {i}| {when}|)", "(watch out|better hide|sleep with one eye open|keep looking over your shoulder|lock your doors) (i know|we know|because i know) (your address|where you (sleep|live|park)|where your kids play|which bus you take)( {i}|)",
    "i (will|am going to|can) (find|hunt|track|get) you( down|) and {hurt} (you|your {body})", "(keep|go on|one more word) (writing|posting|lying|and)( {i}|) (and |)i (will|'ll) {hurt} (you|your {body})", "you (deserve|ought|should|need|deserved) to (be {hurted}|{harm}|be {hurted} (in public|with a belt|until you cry)|suffer|get {hurted})", "(a person|someone|women|men) like you (deserve|deserves|ought|needs) to (be {hurted}|{harm})", "(i hope|hope|i pray|i wish) (you|your mother|your kids|he) (will |)({harm}|get {hurted}|are {hurted})( slowly| in pain| alone|)( you {s} {i}|)",
    "(i hope|hope|i pray|may) your (house|car|family|kids|mother) (burns|dies|burns down|crashes|rots|gets hit)( with you in it| soon|)", "(go|please|just|do us all a favour and) (and |go |) {harm}( {i}| you {i}|)", "(kys|kill yourself|hang yourself|end yourself|shoot yourself|drown yourself|go kill yourself|go hang yourself)( {i}|)", "(the planet|humanity|this club|the town) (is|would be) (better|nicer|happier) (off |)(if you (died|vanished|were dead)|once you are dead|without you alive)", "(no one|nobody|not one person) (loves|wants|needs|likes|cares about|would mourn|could love|will ever love|can stand|respects) (you|a {s} {i} like you)( and (never will|your parents know it)| if you (died|vanished|were dead)|)",
    "you (are never going to|won't ever|never will) (achieve|become|manage|deserve|have) (anything|something|a real job|a friend|love)( {i}|)", "you are (a waste of (space|oxygen|skin|everyones time)|worth nothing|a joke|a burden|human garbage|a pile of (shit|garbage|trash))", "(you|such a) {s} (waste of (space|oxygen|air|skin)|excuse of a (man|woman|human)|excuse for a (man|woman|parent)|pile of (shit|trash|rubbish|garbage))", "your (mother|father|parents|kids) (must be ashamed of|regret having|wish they had aborted|ought to have (drowned|aborted|abandoned)|hate) you( you {s} {i}|)",
    "(everybody|the whole town|they all|we all|your friends all) (laughs|laugh|mocks|jokes|sneers) (at|about) (you|your {s} face)( {i}| and you deserve it|)", "(your mother|someone|the midwife|your father) (must have dropped|surely dropped) you (on your head|as a baby)( {i}|)", "(are you|were you born) (this|that|too|really that) {s}( {i}| or what| to breathe| to read| to understand)", "(a|the|my|even a) (potato|goldfish|rock|doorknob|{thing}) (is smarter than you|has a higher iq than you|has more brain cells than you|would beat you at thinking|has more wit than you)",
    "(eat shit|eat dirt|rot in hell|burn in hell|suck it|choke on it|drop dead)( {i}| and die|)", "(keep crying|cry harder|cry some more|boo hoo)( you|) {s} (baby|crybaby|{i})", "i (would|want to|could) (spit on|spit at|piss on|puke on|slap|punch|{hurt}) (you|your {body}|your grave)( {i}|)", "(go back to|crawl into|return to|stay in) your (cave|hole|swamp|sewer|gutter|rock)( you|)( {s}|) {i}", "(somebody|someone|your dad) (should|ought to|needs to|must) (teach|show|beat) you (some respect|manners|respect|a lesson)( with a (stick|whip|belt)|)",
    "(once|the day|as soon as) i (meet|catch|find) you (i will|i'll) {hurt} you( until you need a doctor| into hospital| into the ground|)", "(i'll|we'll|they should|somebody should) (put|send|get) you (in|into|to) (a hospital|the clinic|intensive care|a wheelchair|a coffin|the morgue|the ground)",
]
HATE = [
    "(all |most |{who} knows that |)({g}) are (all |just |nothing but |)({deh})", "{g} are {deh}( and always will be| and (must|should) {harm}|)", "{g} are {deh} (and (must|need to|ought to)|who should|that should) be ({hurted}|{outed}|kicked out|chased away|wiped out|driven off)", "(we|the army|they) (must|has to|will|had better) ({out}|{hurt}|round up|drive out|hunt down|wipe out) (all |)({g})( and {out} them( all|)| once and for good|)",
    "{g} (are|is) (all |nothing but |just |)({deh}|a bunch of {deh})", "{g} (should|must|need to|ought to|have to) be ({hurted}|{outed}|kicked out|thrown out|driven away|wiped out|locked up|rounded up|burned|forbidden to (vote|marry|work))", "({out}|{hurt}|get rid of|wipe out|kick out|throw out|lock up|drive out|round up|burn out) (all |every one of the |)({g})( {when}| and be done with it| like (rats|pigs)|)", "(i|we) (hate|despise|loathe|detest|spit on) (all |){g}", "(all |most |){g} (steal|lie|rape|cheat|stink|smell|breed|murder|rob|spread disease|bring crime|ruin everything|breed like (rabbits|rats))",
    "{g} (have no place|do not belong|don't belong|are not welcome|should go back|should go home|should leave)( in (our|this) (country|town|school|club|street)|)", "{g} (are|is|seem) (barely|hardly|not even|less than|not really|not fully) human", "{g} (steal|lie|stink|smell|cheat|rob|take) (and|or) (steal|lie|stink|smell|cheat|destroy) (everything|all|whatever they (see|can)|)( for (everyone|normal people)|)", "{g} (ruin|spoil|infest|poison|destroy) (everything|our {thing}|my {thing}|this town)( for (everyone|normal people)|)", "{g} with their (stupid|ugly|filthy|fat|dirty) (faces|heads|noses|kids|food)", "(the sooner|better if|i wish) {g} (all |)(die|died|are dead|vanish|disappear|drown|drowned)( young|)", "(never|don't|do not) (hire|trust|help|marry|believe|rent to) (any |){g}( they (all |)(steal|lie|stink|cheat|are {deh})|)", "(all |){g} (are|is) (stupid|lazy|dirty|filthy|disgusting|ugly|born (thieves|liars|criminals)|less than human|not (real |)(people|human)|hardly human|the enemy|too {s} to (work|vote|think)|{s})", "(our country|the nation|the town|this school|europe|everything) (is|was) (better|cleaner|purer|safer|ruined|overrun|poisoned|clean) (without|before|because of|by|until) {g}( (came|arrived|showed up)|)",
    "{g} (deserve|deserved) (no rights|to die|to be {hurted}|every (kick|punch|bullet)|nothing but pain|what they get)", "(keep|stop) {g} (out|out of (our|this) (country|school|street)|away from (us|our kids|decent folk))( for (pure|clean) (blood|streets)|)", "(send|ship|put|throw) {g} (back|back home|back on the boat|on a train|into (camps|the sea)|away)( (for good|by force)|)", "(a good|the best|the only good) (one of |) {g} (is|are) (a dead one|dead ones|dead)", "(you can |i can |)(smell|spot) {g} (from afar|by their (stink|ugly faces|filth))", "{g} (have|got) (dirty|small|rotten|diseased|evil) (brains|blood|genes|minds|souls)( like (apes|rats)|)",
    "i (would|will) never (let|allow) {g} (in|into my (house|shop)|touch my kids|near (us|me|decent people))( (dirty|filthy) {deh}|)", "no {g}( (here|allowed|in my house|in our club)|) (they are|because they are) {deh}", "{g} (make me sick|disgust me|poison us|infest our streets|crawl in everywhere)", "(life|this place|our world) (will|would) (be|get) (better|nice|safe) (without|once we are rid of) {g}",
]
EXPLICIT = [
    "(he|she|{love}|they) (sucked|licked|rode|stroked|fingered|swallowed|grabbed|fucked) (my|his|her) {part}( {when}| until (i|she|he) came| all night|)", "(i|we|he|she|{love}) (fucked|banged|screwed|shagged|had sex with|came inside|came on|jerked off to|spanked) (her|him|me|{love}|each other)( all night| in the shower| from behind| on the couch| hard|)", "(i wanna|he wants to|wants to|let me|i need to|you want me to) (fuck|suck|lick|ride|taste|shag|bang) (you|me|your {part}|my {part}|her|him)( hard| tonight| so badly| all night|)", "(so |i am so |feeling |getting )(horny|aroused|wet and horny)( {when}| right now| for you| text me|)",
    "(send|post|show|want) (me |us |more |)(your |some |)(nudes|naked pics|dirty pics|dick pics|nude selfies|pussy|tits)", "(hot|horny|naked|sexy|kinky) (girls|milfs|singles|women|couples|wives) (near you|online|on cam|around the corner|waiting)( want to fuck| for sex| ready to strip|)", "(watch|download|free|enjoy|she filmed|he uploaded|put online) (the |our |)(porn|xxx|hardcore|sex|naked) (videos|clips|movies|cams|tape|clip)", "(her|his|my) (pussy|cock|dick|tits|nipples|clit|ass) (was|got|is|felt) (wet|hard|dripping|so tight|in my mouth|naked|sore from fucking|full of cum)", "(gave|gives|giving|got|wants|begged for) (me |him |her |)(a |)(blowjob|handjob|orgasm|threesome|rimjob|lap dance|anal)",
    "(she|he|{love}) (begged|asked|begs) (me |us |him |)(to |)(fuck|cum|come on her tits|spank|be fucked)( her| him| again|)", "{love} (stood|lay|waited|danced) (naked|topless|nude)( and (moaning|horny|wet)| on (the bed|my bed|the sofa)| in (stockings|lingerie|panties))", "(came|cum|cumming) (all over|on|inside) (her|his|my) (face|tits|ass|mouth|chest|belly|stockings)", "(ripped|tore|took) (her|my|his) (panties|bra|pants|stockings) off and (fucked|licked|fingered|sucked) (me|her|him)", "(recorded|watched|caught) (us|them|her|him|{love}) (having sex|fucking|naked|masturbating|sucking cock)( {when}|)",
    "(he|she|i|{love}|we both) came (twice|inside|hard|so hard|loudly|first in bed|in (her|my|his) mouth|on (the sheets|the pillow|her belly|his chest)|three times)( and (moaned|screamed|slept)| {when}|)", "(up|in) (her|his|my|the) (ass|pussy|butthole)( all the way| hard|)", "(looking|searching) for (a |)(woman|man|couple|girl|someone) (to fuck|for sex|who likes anal|for a threesome)( tonight| no strings|)", "(undress|strip|stripping) (naked|nude) and (fuck|have sex|screw|shag)( with (you|me)|)", "(adults only|eighteen plus|explicit) (pics|content|videos)( inside| free|)( naked (girls|women)|)", "(moaned|screamed) while (i|he|she|they) (fucked|licked|sucked|rode) (her|him|me)",
]
HARMLESS = [
    "(i am|i'm|i was|i felt like|i was feeling like|me feeling like) (such |)(a|an) ({s} |complete |total |little |){i} (today|again|because i forgot the {thing}|when i forget the {thing}|for (losing|breaking) the {thing}|)( but they were nice|)", "(silly|stupid|dumb|clumsy) (me|old me) (i |)(forgot|lost|dropped) the {thing}", "(my|my own|one more) (stupid|dumb|silly|idiotic) (mistake|fault|idea|typo)( i (forgot|lost) the {thing}|)", "(the|a) (stupid|dumb|silly) (mistake|idea) was mine", "(a|some|what) (stupid|dumb|silly|idiotic) (error|blunder|slip|thing) of mine( i (forgot|lost) the {thing}|)", "(keep|kept|lost|found|feel) the (beat|rhythm|drum beat) (in time|of the {thing}|{when})", "i (could|should) kick myself for (losing|selling) the {thing}",
    "(this|that|the|my|our|these) (stupid|damn|bloody|fucking|useless|goddamn|ugly|filthy|shitty|rotten|dumb|lousy|disgusting|pathetic) {thing} (broke|is stuck|crashed again|won't start|leaks|smells|never works|was late|is useless|)", "(damn|shit|crap|bloody hell|fuck|bugger|what the hell|hell) (i |)(forgot|lost|dropped|missed) (the|my) {thing}( again|)", "(the|this|that|our) {thing} is (a bitch|a pain in the ass|a bastard|crap|shit|rubbish|useless|ugly|stupid|filthy|disgusting|trash|a fat lie)( to (fix|open|clean|use|photograph)|)", "(damn|bloody|fucking|shitty|crappy) (weather|traffic|day|week|{thing})( again|)",
    "(it |that |this |)(kills|killed|is killing) (time|the engine|the process|the lights|my (back|knees|feet|appetite)|the mood)", "(i|we|she) (kill|killed|stop|restart) (a|every|that) (process|script|server|job) (if|because|once) (it|the {thing}) (hangs|freezes|crashes)", "(that|the|this) {thing} (is|was) (a killer|killer|to die for|dead easy|sick|wicked|dead boring)", "(a|what a|her) drop dead gorgeous (dress|sunset|{thing})", "(i|we|she) (nearly|almost) died (laughing|of (shame|boredom))", "(we|they|our team|the girls|the home side) (destroyed|smashed|crushed|beat|slaughtered|thrashed|murdered|killed) (the other side|the rivals|them|the champions|the opposition|their team)( in the final| bloody good|)",
    "(he|she|{who}) shot (a short film|portraits|two goals|some pictures|photos of the {thing}|rolls of film)", "(beat|whip|crush|slap|pound) (the eggs|the cream|the drum|garlic|the dough|the record)", "(i|we|they|she) (beat|broke|smashed|smash) (my|the|our|his) (record|best time|personal best|own record)", "(choked|choking|choke) on (a crumb|the tea|popcorn|a fish bone|water)", "(hang|burn|shoot|cut|kick|hit|break) (the picture|the candle|me an email|the cake|the ball|the brakes|the ice)", "(my|his|her|the) (back|feet|head|fingers|teeth|legs|knees|neck) (hurt|hurts|ached|froze|got cold|are sore|is stiff|broke in a fall)( after the {thing}| {when}|)",
    "the (cock|rooster|ass|donkey|bitch|pig|rat|snake|cow|goose|great tits|blue tits|beaver|mule) (crowed|brayed|had puppies|slept|ate the corn|nested|sat on the fence|grazed|fed her pups|pulled the cart)", "(rats|mice|vermin|parasites|pests|cockroaches|fleas|pigs|maggots|worms) (in the (cellar|attic|barn|compost)|got into the grain|are hard to get rid of|ate the {thing}|were studied in biology|live in the drains|carry germs)", "(pest|vermin|rat|parasite) (control|traps|poison|biology|research|exhibit)( (came|arrived|was late)| for the {thing}|)", "(we|they|the city) (got rid of|trapped|poisoned|fumigated|exterminated) the (rats|mice|vermin|cockroaches|moths)",
    "(sex|gender) (differences|ratios|education|hormones|chromosomes)( in (birds|sport|mice)|)", "(visible to |hidden from |)the (naked|nude) (eye|truth|mole rat|portrait|statue|figure)( hung in the museum|)", "breast (cancer|milk|stroke|feeding)( {when}|)", "(hard|wet|hot|dirty|sweet|cold|fat) (drive|work|chair|paint|socks|soup|chocolate|towel|cheese|dishes|cat)", "(he|she|{who}|they) came (home|back|early|first|to dinner|over|late|in last|to the {thing})", "(he|she|{who}) (licked|sucked) (the spoon|a lollipop|on a mint|the stamp|an orange|ice cream)", "(he|she|{who}) rode (a bike|the bus|a horse|the train|my bike)( {when}|)", "(a|the|one|this|another) (loose|missing|tiny|rusty|last|) (screw|bang|shag carpet|cock|ass|strip)( (is|was) (missing|loud|new)| of (paper|the {thing})| in the {thing}|)", "(he|she|{who}|we) (screwed|unscrewed|banged|grabbed|sucked up) (the lid|the {thing}|a nail|dust)( on| shut|)", "{who} (could|can|will|just|) (hit|cut|kick|crush|drop|dropped|broke|break|beat|smash|slap|punch|shoot|hang|drag|whip|knock|burn|choke|bash) (the|a|an|every|any) (wrong |red |)(button|ball|note|brakes|{thing}|paper|nail|target|picture|door|wood|rug)( {when}|)", "{who} came (home|back|for the {thing}|out|down|with a {thing}|by bus|in a hurry|from (work|school|abroad)) {when}", "(the|a) (dog|cat|child|boy|ball|{thing}) (died|drowned|vanished|disappeared|jumped|crashed|starved|burned|fell)( {when}|)", "(ban|remove|exclude|ship|deport|fence|cage) (the|a|every|this) ({thing}|file|order|user account|bird)( {when}|)", "(my girlfriend|my wife|my husband|my boss|his ex|the couple|a grown woman|her neighbour) (bought|cooked|painted|lost|repaired|likes|wrote about) (a|the) {thing}",
    "(he|she|the coach|a pupil|a player|someone) (was|got) (suspended|fined|banned|sacked) for (calling|shouting|writing) (a player |someone |a colleague |)(a |)({s} |){i}", "the (word|insult|slur|term) {i} (is (rude|offensive|banned|forbidden|old)|was (deleted|banned)|comes from latin|is on the filter list|hurts people)", "(calling|to call) (people|anyone|someone|a colleague|players) (a |an |){i} (hurts|is wrong|is rude|ends the talk|is not allowed|was never funny|stops the discussion)", "(a|the|our|this|an) (article|course|talk|report|study|policy|poster|law|book|film|workshop|lesson) (on|about|against|explains) (hate speech|racist abuse|bullying|harassment|threats|slurs|sexual harassment|online hate|hate mail|why people hate {g})( (began|opened|was useful)|)",
    "(victims|survivors|targets) of (abuse|rape|hate|hate crimes|bullying|assault|threats) (need help|get support|can call a helpline|spoke|meet {when})", "(please |)(do not|never|don't) call (people|anyone|each other|classmates) (a |){i}(s|)", "being (told|called) (i was |you are |a |){s}( {i}|) (hurts|stays with you|was the topic|left scars)", "(they|some boys|people) (called|call) (me|us|him|her) (a |){s} ({i} |)(at school|as a child|once) and (it hurt|we reported it|i cried|a teacher helped)", "it is (wrong|a lie|false|racist|hateful|not true) (to say|that|to claim) {g} are {deh}", "(he|she|the speaker|{who}) (condemned|criticised|rejected|reported) (the |)(claim|post|speech|remark) (that|saying) {g} are {deh}",
    "{g} (celebrate|told their stories|opened a shop|cooked|live here|work there|played chess|joined the choir|won the cup|sing|study|voted|came to tea|run the {thing}|ran the {thing}|answered faster|meet {when}|queued for the {thing}|waited)", "(many|some|two|several|most) {g} (in the study|from the choir|on our street|in the survey|at work) (said|agreed|answered|cooked|slept|won)", "(welcome|support|help|thank|invite|protect) {g}", "{g} should be (invited|welcomed|paid fairly|heard|protected|proud)", "(keep|send) {g} (safe|informed|a postcard|some food|warm)", "(rights|stories|food|music|songs|prayers|shoes) (of|for|by) {g}( {when}|)", "(i|we) (love|like|teach|met|trust|helped|cook with) {g}", "(many|the) {g} are (kind|friendly|our neighbours|great cooks|doctors|good at chess|welcome here)", "{g} are (always |most |all |)(welcome|invited|loved|safe|needed|respected|missed) (here|in our {thing}|at the {thing}|among us|{when})", "{g} (over|under|from|with|near|in) (forty|the {thing}|our town|the north) (were|are|was|came|met) (invited|asked|happy|tired|there|{when})", "the <caps> (sheet|method|week|{thing}) (since|and|because|until|is|was) (it|the {thing}|<cap>)", "{g} and {g} (shared|met|sang|played) {when}",
    "(a|the) (poor|lazy|fat|ugly|stupid|dumb|sad|rotten|sick|mad) (cat|sweater|joke|apple|tooth|film|puppet|question|dog|plant) (made us laugh|slept|was funny|fell off|)", "(crash test|ventriloquist|baby|tailor|bridge) dummy", "(he|she|{who}) (is|was) (sick|thick with flu|ill|sad|mad with joy|miserable) {when}", "(a|the) (blood|dna) (test|sample) (was|came back) clean", "(bloody|damn) (good|brilliant|great|fine) (fun|match|{thing}|soup)", "(the|a) (bastard|bloody) (sword|file|fool in the play|mary)", "(dead|lost|broken) (battery|end|letters|plants|wood)",
]
PLAIN = [
    "{who} {did} the {thing} {when}", "the {thing} was (cold|late|green|heavy|empty|on sale) {when}", "{who} (is|was) (clever|brilliant|smart|a genius|really good at chess|quick|kind|tall)( and owns a {thing}|)", "{who} (can|could|will) (read|count|draw|repeat|remember|spell|juggle|sort|hear|guess) (the|every|any) {thing} {when}", "{who} (cannot|could not|couldn't) (find|follow|count|remember|read|solve) the {thing} {when}", "(we|they|i) (went|walked|drove|came) (home|back|to the {thing}) {when}", "(running|fixing|finding) a {thing} (needs|costs) (time|brains|money|nothing)", "{who} (laughed|smiled|shrugged|slept|sang|waited) {when}",
    "(you|u) (can|could|might|may|must|will|should) (find|ask|try|bring|read|visit|take|look at|watch|borrow|hear|meet|call) (the {thing}|{who}|us|it) {when}", "you should (hear|watch|listen to|taste|meet|be there when) ({who}|the {thing}|it) {did} (the|a) {thing} {when}", "you should (hear|watch) {who} (count|read|draw|hit|cut|beat|cook|sing|spell) the {thing} {when}", "you are (a star|an angel|a genius|a friend|a good cook|so kind|right|welcome|late|invited|lucky|a great {thing}|the best)( {when}|)", "(if|when|unless) you (like|need|can|wish|have time)( to (come|know|help|play|read the {thing})| the {thing}|)", "{who} {did} the {thing} (if|before|after|because|until) (you|they|we) (came|asked|called|want)( {when}|)", "until the (lamps|heating|alarm|radio|band|{thing}) came (on|back|home)", "(thank you|thanks) for the {thing}", "are you (coming|free|sure|ready|hungry)( {when}|)", "(i will|i'll|we will|i can|we can) (show|send|call|meet|help|teach|drive|email|pay|thank) you {when}", "(i hope|hope) you (enjoy|like|feel better|sleep well|had fun|find) (the {thing}|it|)", "your (mother|brother|house|street|idea|plan|{thing}|sister|car) (is|looks|was|sounded) (lovely|nearby|great|clean|ready|funny)", "(watch|mind) your (step|head|fingers) (on the stairs|there|)", "(nobody|no one) (knows|told|asked|saw|came|watered|explains|noticed|remembered) (why|the {thing}|it|me)", "(everyone|everybody) (laughed|clapped|smiled|knows|cheered) (at the joke|when {who} sang|because of the {thing}|{who}|)",
    "you deserve (a break|better|the prize|a holiday|some rest)", "(people|friends|neighbours) like you make (this club|us|the day) (great|happy|better)", "i know (your sister|where you work|the shop|which {thing} you mean|where {who} lives)", "the (world|town|club) would be (better|nicer) with (more trees|a {thing})", "i (told|asked|saw|met|heard|know|remember) (you|your name|your talk) {when}", "(if|when) you (see|meet|find) {who} (say hello|tell me|bring the {thing})", "(once|the day) i meet you (i will|i'll) bring (the {thing}|cake)", "(cry|laugh|sing|talk) (about it|with me|a bit)", "(go|come) (back|home|away) (to the {thing}|soon|for lunch)", "(get|find|keep) (a|the) {thing}", "what (a|a great|a lovely|a long|a strange|an odd) (day|idea|{thing}|trick|meal)", "(the|a|an) {thing} and (the|a) {thing}", "(i|we) (hate|love|like|miss|need|prefer|despise) (the {thing}|mondays|onions|rain|traffic|decaf)( more than the {thing}|)", "(use|trust|rest) your (brain|head|eyes)( and the {thing}|)", "(the|my|a|his) (brain|head|face|skull|throat) (scan|is tired|works|needs sleep|was sore|x ray)", "brains (and|or|not|need|to) (muscle|luck|the {thing}|sleep)( people say|)", "(people|folks) (say|think|know|here|from work) (it|that|the {thing}|so)( and|)( {when}|)", "(the|our) (train|bus|music|coffee|sun) (came|went) (on|off|out|late|cold)", "the <caps> (won|lost|played|sang|live here|opened|came|sell bread)( the cup| {when}|)", "(a letter|an email|greetings|a song) (from|by|for) (the <caps>|<caps>|<cap>|the <cap> club)", "<cap> (people|women|men|folk) (cook|sing|live|work|came|won|ran|built) (the {thing}|here|well|{when})", "(early|late|out|up|back) (in spring|on the road|at the {thing}) {who} {did} the {thing}", "(i|we|{who}) will (bring|open|carry|sort) the {thing}( {when}|)", "(that|the) (town|street|kitchen|office) was (clean|nice|quiet|better) (until|before) (lunch|noon|{who} left)", "(all|some|both|many) (of these|of the|of those) {thing}s (smell|broke|are old|cost more|leak)", "(older|taller|faster|earlier|kinder) than (you|me|{who})", "{who} (lives|moved|works) (near|beside|behind) the {thing}", "(looking|searching) for a (piano teacher|flat|{thing}|lost cat|running partner)( {when}|)", "(my|his|her) (name|number|address|phone) is on the {thing}", "(that is|it is|this is|there is) (the|a) {thing} {when}", "{who} (asked|told|helped|thanked|met|saw|called|visited) (him|her|us|me|them|{who}) {when}", "(would|will|could) you (please |)(pass|open|close|bring|send) (me |)the {thing}", "i (am|was|will be) (tired|happy|late|bored|hungry|bad with numbers|at the {thing})", "{who} (came|went|walked) (over|down|up|past) the {thing}",
]


def _draw(rng: np.random.Generator, grammar: list[str], n: int) -> list[list[str]]:
    """n sentences of a grammar as terms."""

    def one(pattern: str) -> str:
        while "{" in pattern or "(" in pattern:
            pattern = re.sub(r"\(([^()]*)\)", lambda m: (c := m.group(1).split("|"))[rng.integers(len(c))], pattern)
            pattern = re.sub(r"\{(\w+)\}", lambda m: (c := SLOTS[m.group(1)])[rng.integers(len(c))], pattern)
        return pattern

    out = []
    for k in range(n):
        tokens = []
        for word in one(grammar[k % len(grammar)]).split():
            tokens += [word] if word.startswith("<") else plain_tokens(word)
        out.append(tokens)
    return out


@lru_cache(maxsize=1)
def model(seed: int = 5) -> tuple[np.ndarray, np.ndarray, float]:
    """(linear weights, factors, bias) of a factorization machine, trained by Adagrad on the logistic loss.

    A sentence is often part of a longer one, so half of them get a plain one before or behind.
    """
    rng = np.random.default_rng(seed)
    bad = _draw(rng, ABUSE, SAMPLES) + _draw(rng, HATE, SAMPLES) + _draw(rng, EXPLICIT, SAMPLES // 2)
    good = _draw(rng, HARMLESS, SAMPLES) + _draw(rng, PLAIN, SAMPLES * 3 // 2)
    more = _draw(rng, PLAIN, len(bad) + len(good))
    kind = rng.integers(0, 4, len(more))
    x = features([b if k > 1 else b + m if k else m + b for b, m, k in zip(bad + good, more, kind)])
    y = np.r_[np.ones(len(bad)), np.zeros(len(good))].astype(np.float32)
    seen, x = np.unique(x, return_inverse=True)  # trained among the terms that occur only
    x, n = x.reshape(len(y), -1), len(seen)
    size = (x > 0).sum(axis=1)
    w, v, b = np.zeros(n, np.float32), rng.normal(0, 0.05, (n, RANK)).astype(np.float32), -1.0
    gw, gv = np.ones(n, np.float32), np.ones((n, RANK), np.float32)
    v[0] = 0.0  # the padding
    for _ in range(EPOCHS):
        order = np.argsort(size + rng.integers(0, 6, len(y)), kind="stable")  # alike in length
        for lo in rng.permutation(np.arange(0, len(y), 256)):
            at = order[lo : lo + 256]
            xb = x[at, : size[at].max()]
            e = v[xb]
            s = e.sum(axis=1)
            z = b + w[xb].sum(axis=1) + 0.5 * ((s * s).sum(axis=1) - (e * e).sum(axis=(1, 2)))
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[at]
            used = xb > 0
            terms, at_term = np.unique(xb[used], return_inverse=True)
            dv = (g[:, None, None] * (s[:, None, :] - e))[used] + 1e-3 * e[used]
            dw = np.bincount(at_term, np.repeat(g, used.sum(axis=1))) + 1e-3 * w[terms]
            dv = np.stack([np.bincount(at_term, c) for c in dv.T], axis=1)
            gw[terms] += dw * dw
            gv[terms] += dv * dv
            w[terms] -= 0.3 * dw / np.sqrt(gw[terms])
            v[terms] -= 0.1 * dv / np.sqrt(gv[terms])
            b -= 0.01 * g.sum() / 16
    every_w, every_v = np.zeros(1 << BITS, np.float32), np.zeros((1 << BITS, RANK), np.float32)
    every_w[seen[1:]], every_v[seen[1:]] = w[1:], v[1:]  # what was never seen says nothing
    return every_w, every_v, float(b)


def abuse_scores(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, score): for each key with a text, the probability that it is abusive, hateful or sexually explicit.

    Rows of one key are versions of one record; the smallest non-null text stands for it. Null keys and keys
    without text give no row, blank texts score as the empty sentence (near 0). Texts are scored whole:
    the score is the highest of their sentences, long sentences in overlapping parts.

    Method: a factorization machine over hashed terms: words that may tell, what class of word they are, and runs of
    the sentence's outline. Its factors learn which terms are abusive together, such as an insult with an address
    or a slur with a group, where each alone is harmless. English only: other languages score as unknown words.
    """
    w, v, b = model()
    docs = one_text(df, key, text)
    kind = dict(docs.dtypes)["_key"]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 1024):
                part = pdf.iloc[lo : lo + 1024]
                rows = [sentences(t) for t in part["_text"]]
                of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
                z = np.concatenate([raw_scores(x, w, v, b) for x in np.array_split(features([s for r in rows for s in r]), max(1, len(of) // 2048))])
                best = np.full(len(rows), -np.inf)
                np.maximum.at(best, of, z)
                yield pd.DataFrame({"_key": part["_key"], "score": 1 / (1 + np.exp(-np.clip(best, -30, 30)))})

    return docs.mapInPandas(score, f"_key {kind}, score double").withColumnRenamed("_key", key)


def source_rates(scores: DataFrame, df: DataFrame, key: str, source: str, threshold: float = 0.7) -> DataFrame:
    """(source, records, flagged, rate): per source, trimmed and lower-cased, of the records with a score.

    A record counts once, under the smallest of its rows' sources; records without any under null.
    """
    from lexmill.functions.text import blank_to_null

    of = df.select(F.col(key).alias("_k"), F.lower(blank_to_null(source)).alias("_s")).where("_k IS NOT NULL").groupBy("_k").agg(F.min("_s").alias("source"))
    return (
        scores.join(of, scores[key] == of["_k"])
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("records"), F.count(F.when(F.col("score") >= threshold, 1)).alias("flagged"))
        .withColumn("rate", F.round(F.col("flagged") / F.col("records"), 6))
    )
