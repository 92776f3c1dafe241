"""P1: personal information inside free text, by information-theoretic sanitisation.

Co-occurrence over the whole corpus says how strongly a term discloses a protected entity; what exceeds a threshold is generalised to a
placeholder of its kind, whatever stays below is left in the text.

* *Names* have no shape of their own.  A few words introduce a person in any text of their language: titles and "my name is".  From these
  seeds the corpus learns the rest.  Words that often stand in a seeded place disclose a name; the *contexts* (one or two words before or after) in which
  mostly such words stand, and capitalised pairs of them, become introductions too ("our landlord ...", "... fell there"), and count as evidence in turn.  The
  disclosure of a word is ``log2(P(introduced | word) / P(introduced))``, and as the second factor is the same for all words, thresholds are set on the first.
  A candidate is a name when its words exceed them, wherever it stands.
* *Addresses* are a number beside a street.  Where neither capitals nor a street word settle that, the word next to the number decides by how often it
  stands beside a kind of street, or a number, out of all its uses: "12 kelmoor lane" but not "12 people place".
* *E-mail addresses, phone and identity numbers* have a shape, and disclose a person as far as few people share them: ``log2(texts / texts with
  it)`` bits.  A number that every sixteenth text gives belongs to an office, and stays.

Wrongly decoded text is read as it was meant, and its spans are given where they stand.  All counts cover all texts: nothing is decided within a batch,
and overlapping candidates all meet the counts.  Counts stay in Spark; what is collected are the learned contexts and the surest words, each of which must introduce ``CUE_SHARE`` of all
names, or be in that share of them, so there are ``4 / CUE_SHARE`` and ``1 / CUE_SHARE`` of them at most.  Decisions are made once per pair of words and joined back, so a common first name is not
worked out per occurrence.

Defined cases: null and empty fields have no spans; what is masked already is no case; a repeated key reports once; further
columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_columns, shared_checkpoint
from .encoding import repair_aligned

FIELDS = ("response_text", "raw_text_original")
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

#: Least share of a word's occurrences that are introduced: both words of a candidate that is introduced itself; the surer and the other
#: word of a candidate anywhere else.
IN_SLOT, SURE, OTHER = 0.1, 0.3, 0.05
#: A word that occurs so often in the corpus and is never introduced is everyday speech; a rarer one may be a name not introduced yet.
EVERYDAY = 50
#: A context is an introduction when this share of the capitalised candidates in it are seeded names, and when it has this share of all of these (and this number).
CUE, CUE_SHARE, CUE_LEAST = 0.5, 1 / 4000, 2
#: Least share of a word's uses that stand beside a kind of street, or before a number, for it to name a street where capitals do not tell.
STREET = 0.02
#: Bits: a shape in more than one of ``2 ** PUBLIC`` texts is public.  ``SMOOTHED`` texts are added, so that in a small corpus nothing is.
PUBLIC, SMOOTHED = 4, 64

# Titles, and how people give their name, in the languages of the surveys.
TITLES = "mr mrs ms miss mx dr prof sr sra srta señor señora don doña herr frau mme mlle monsieur madame m senhor senhora dona seu".split()
INTRODUCTIONS = ["my name is", "me llamo", "mi nombre es", "ich heiße", "mein name ist", "je m'appelle", "je m’appelle", "mon nom est", "meu nome é", "eu me chamo", "me chamo", "chamo-me"]
# Small words inside names, and before the name of a street.
PARTICLES = "de del della der den van von la las los le di da dos das do du ter zu al el bin ibn y e".split()
# English words of grammar, with which no street's name begins.
FUNCTION_WORDS = "a an the my our your his her its their this that these those in on at near by from to of and or but if when after before between until since while for with without about around every each some any all no not is are was were we i you he she it they there here".split()
# Kinds of street and place, which turn the words before them into no person.
STREETS = "street st avenue ave road rd lane ln drive dr court ct place pl terrace ter way boulevard blvd square sq circle cir parkway pkwy".split()
PLACES = "school hall library park station bridge market plaza hospital church center centre university college".split()
PLACE_PREFIXES = "parque plaza biblioteca mercado puente estación calle avenida parc place marché gare pont bibliothèque rue brücke markt bahnhof platz bücherei praça ponte estação".split()


def _any(words: list[str]) -> str:
    return "|".join(re.escape(w).replace(r"\ ", r"\s+") for w in sorted(words, key=len, reverse=True))


_L = r"[^\W\d_]"
_TOKEN = rf"{_L}(?:[\w'’-]*{_L})?"
_DOT = r"(?:\.|\s?[\[(]\s?dot\s?[\])]\s?|\sdot\s)"
_AT = r"(?:\s?[@＠]\s?|\s?\(\s?@\s?\)\s?|\s?[\[(]\s?at\s?[\])]\s?)"
_LABEL = r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"
EMAIL = re.compile(
    rf"(?<![\w.+-])\w[\w.%+-]*(?:{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[a-z]{{2,}}|\sat\s{_LABEL}(?:\s?[\[(]\s?dot\s?[\])]\s?{_LABEL}|\sdot\s{_LABEL})+)(?![\w-])",
    re.I,
)
ID_NUMBER = re.compile(
    r"(?<![\w.-])(?:\d{3}([-. ])\d{2}\1\d{4}|[A-Z]\d{7}|RC[- ]?\d{4}-\d{4}-\d{2}|\d{8}(?:-|\s)?[A-Z])(?![\w-]|\.\d)", re.I
)
PHONE = re.compile(
    r"(?<![\w$€£/.-])(?:"
    r"\+\d{1,3}(?:[ .-]?\(?\d{1,5}\)?){2,6}"
    r"|(?:\+?1[ .-]?)?\(\d{3}\)\s?\d{3}[ .-]?\d{4}"
    r"|(?:1[ .-])?\d{3}([ .-])\d{3}\1\d{4}"
    r"|1?\d{10}"
    r"|\d(?: \d){9,10}"
    r"|\(?0\d{2,4}\)?\s?[ /.-]\d{3,5}[ .-]?\d{3,4}"
    r"|0\d(?:[ .-]?\d{2}){4}"
    r")(?![\w]|-\d|[.,]\d)"
)
_NO_FUNCTION = rf"(?!(?:{_any(FUNCTION_WORDS)})\b)"
_CAP = r"[A-ZÀ-ÖØ-Þ](?:\w|['’-](?=\w))*"
_OF = r"(?:(?:de\s(?:la|las|los|l['’])|de|del|du|des|do|da|dos|das|la|le|les|der|den)\s|(?:de\s)?[ld]['’])"
_UNIT = r"(?:,?\s(?:apt|unit|apartment|suite)\.?\s?\d+\w?|,?\s#\s?\d+)?"
#: Each with the word that discloses a street where the shape alone does not (``name``), if it has one.
ADDRESSES = [
    # number, capitalised name of several words, kind of street
    re.compile(rf"(?<![\w$€£.,/-])\d{{1,5}}[a-z]?\s(?:[NSEW]\.?\s)?(?i:{_NO_FUNCTION}){_CAP}(?:\s{_CAP}){{1,3}}?\s(?:{_any([k.title() for k in STREETS])})\b\.?{_UNIT}"),
    # number, name, kind of street
    re.compile(rf"(?<![\w$€£.,/-])\d{{1,5}}[a-z]?\s(?:[NSEW]\.?\s)?{_NO_FUNCTION}(?P<name>{_TOKEN})\s(?P<kind>{_any(STREETS)})\b\.?{_UNIT}", re.I),
    # number, kind of street, name
    re.compile(
        rf"(?<![\w.,])\d{{1,4}}(?:\s(?:bis|ter))?,?\s(?:rue|avenue|boulevard|allée|impasse|chemin|quai|place|cours)\s{_OF}*{_TOKEN}(?:\s(?-i:{_CAP})){{0,2}}(?!\w)",
        re.I,
    ),
    # kind of street, name, number
    re.compile(
        rf"(?<!\w)(?:calle|c/|avenida|avda\.?|av\.|paseo|camino|carretera|ronda|rua|r\.|travessa|alameda)\s?{_OF}*{_TOKEN}(?:\s{_OF}?(?-i:{_CAP})){{0,3}},?\s(?:nº\s?|n\.º\s?|n°\s?|núm\.?\s?|no\.\s?)?\d{{1,4}}[a-z]?(?:,\s\d+º(?:\s[A-Z]\b)?)?(?!\d|\s(?:años|anos|semanas|días|dias|personas|meses))",
        re.I,
    ),
    # name and kind of street in one word, number
    re.compile(
        r"(?<![\w-])(?P<joined>[^\W\d_][\w-]*?(?:straße|strasse|str\.|weg|gasse|allee|platz|damm|ufer))\s\d{1,4}(?:\s?[a-z])?\b(?!\s(?:jahre|wochen|tage|monate|minuten|leute))",
        re.I,
    ),
]
#: What an address of the last two kinds needs in small letters.
_NAMED_STREET = re.compile(r"calle|c/|avenida|avda|av\.|paseo|camino|carretera|ronda|rua|r\.|travessa|alameda")
_JOINED_STREET = re.compile(r"(?:straße|strasse|str\.|weg|gasse|allee|platz|damm|ufer)\s\d")
_DIGITS = re.compile(r"\d+")
_TITLE = rf"(?:{_any(TITLES)})\b\.?"
_NO_PLACE = rf"(?!\s+(?:{_any(STREETS + PLACES)})\b)"
_BETWEEN = rf"(?:\s+(?:{_L}\.\s?|(?:(?:{_any(PARTICLES)})\s+){{1,3}})|\s+)"
#: title + surname (a); initial + surname (b); last, first (c); first [initial or particles] last (d)
_NAME = rf"(?:{_TITLE}\s+(?P<a>{_TOKEN})|{_L}\.\s?(?P<b>{_TOKEN})|(?P<c2>{_TOKEN}),\s(?P<c1>{_TOKEN})|(?P<d1>{_TOKEN}){_BETWEEN}(?P<d2>{_TOKEN}))"
_CUE = re.compile(rf"(?<!\w)(?:{_any(INTRODUCTIONS)})\s+")
_NAME_THERE = re.compile(_NAME + _NO_PLACE, re.I)
_NAME_ENDING = re.compile(
    rf"(?<![\w’'])(?:{_TITLE}\s+(?P<a>{_TOKEN})|(?P<c2>{_TOKEN}),\s(?P<c1>{_TOKEN})|(?P<d1>{_TOKEN}){_BETWEEN}(?P<d2>{_TOKEN})|(?<!\w\s){_L}\.\s?(?P<b>{_TOKEN}))$", re.I
)
_TITLED = re.compile(rf"(?<![\w’'])(?:{_TITLE})\s+(?P<a>{_TOKEN})" + _NO_PLACE, re.I)
_INITIAL = re.compile(rf"(?<![\w’'.])[A-ZÀ-ÖØ-Þ]\.\s?(?P<b>{_CAP})" + _NO_PLACE)
_CAPITAL = re.compile(rf"(?<![\w’'])(?=({_CAP})(?:({_BETWEEN})|(,\s))({_CAP})(?![\w’'-]))")
_WORDS = re.compile(rf"{_L}+")
_TOKENS = re.compile(r"[^\W_]+|[^\w\s]")
_CASED = re.compile(r"[A-ZÀ-ÖØ-Þ]\w*[a-zà-öø-ÿ]")
#: The same for the JVM: a text without it tells nothing by its capitals.
CASED = r"\p{Lu}[\p{L}\p{M}]*\p{Ll}"
#: The longest word of each introduction, and the titles: a text without any is not searched for them.
_CUE_WORDS = sorted({max(re.split(r"[\s'’]", c), key=len) for c in INTRODUCTIONS})
_TITLE_WORDS = frozenset(TITLES)
_EVERYDAY_TITLES = frozenset("dr miss m don dona seu ms".split())
_STREET_KINDS, _MARKS, _DIGIT = frozenset(STREETS), ".,;:!?)…–-", frozenset("0123456789")
_NO_NAME = frozenset(STREETS + PLACES + PLACE_PREFIXES)
#: Words a name can take, which is how far back from what follows it one is looked for.
_NAME_WORDS = 8


def shaped(text: str) -> tuple[list[tuple[str, int, int, str | None]], str]:
    """Spans recognised by their shape (kind, begin, end, and the word that has to disclose a street, if one has to), and the text with
    them blanked out."""
    spans: list[tuple[str, int, int, str | None]] = []

    def take(kind: str, pattern: re.Pattern, text: str) -> str:
        for m in pattern.finditer(text):
            word = None
            if kind == "phone" and not 9 <= sum(map(str.isdigit, m.group())) <= 14:
                continue
            if kind == "address" and "name" in pattern.groupindex:
                if not m["name"][0].isupper() and m["kind"][0].isupper():
                    continue  # a small word before a capitalised kind of street is no name
                if not m["kind"][0].isupper():
                    word = key_of(m["name"])
            elif kind == "address" and "joined" in pattern.groupindex:
                word = key_of(m["joined"])
            spans.append((kind, m.start(), m.end(), word))
            text = text[: m.start()] + "\x00" * (m.end() - m.start()) + text[m.end() :]
        return text

    low = text.lower()
    if "@" in text or "＠" in text or "dot" in low:
        text = take("email", EMAIL, text)
    digits = _DIGITS.findall(text)
    if digits:
        if sum(map(len, digits)) >= 7:
            text = take("phone", PHONE, take("id_number", ID_NUMBER, text))
        for pattern in ADDRESSES[:3]:
            text = take("address", pattern, text)
        if _NAMED_STREET.search(low):
            text = take("address", ADDRESSES[3], text)
        if _JOINED_STREET.search(low):
            text = take("address", ADDRESSES[4], text)
    return spans, text


def key_of(token: str) -> str:
    """What a word is counted under: its longest run of letters, in small letters ("O'Neil" under "neil")."""
    return max(_WORDS.findall(token.lower()), key=len)


def beside_streets(low: str) -> Iterator[str]:
    """Words before a kind of street or a number: the evidence that they name streets."""
    words = low.split()
    for at, word in enumerate(words):
        if word[0] in _DIGIT or word in _STREET_KINDS or (word[-1] in _MARKS and word.rstrip(_MARKS) in _STREET_KINDS):
            before = words[at - 1] if at else ""
            if before and before[-1].isalpha():
                yield key_of(before)


class Contexts:
    """What stands around a place of a text: one and two words (or marks) before and after, as numbers."""

    def __init__(self, low: str):
        self.words = _TOKENS.findall(low)
        self.starts = [m.start() for m in _TOKENS.finditer(low)]

    def _word(self, at: int) -> str:
        return self.words[at] if 0 <= at < len(self.words) else "^"

    def before(self, at: int) -> list[int]:
        """Of the place before token ``at``."""
        one = self._word(at - 1)
        return [_number("l", one), _number("l", f"{self._word(at - 2)} {one}")]

    def after(self, at: int) -> list[int]:
        """Of the place that ends before token ``at``."""
        one = self._word(at)
        return [_number("r", one), _number("r", f"{one} {self._word(at + 1)}")]

    def around(self, begin: int, end: int) -> list[int]:
        return self.before(bisect_left(self.starts, begin)) + self.after(bisect_left(self.starts, end))


def _number(side: str, words: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{side} {words}") - (1 << 63)


Candidate = tuple[int, int, str, str | None, bool]


def _candidate(m: re.Match, slot: bool, shift: int = 0) -> Candidate:
    g = m.groupdict()
    word, other = g.get("a") or g.get("b") or g.get("c1") or g.get("d1"), g.get("c2") or g.get("d2")
    return m.start() + shift, m.end() + shift, key_of(word), key_of(other) if other else None, slot


def _small(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else text  # a letter whose small form is longer: positions must not shift


def candidates(text: str) -> list[Candidate]:
    """Name candidates: begin, end, word, other word, introduced by a seed.  Overlapping ones all come out, the counts decide between them."""
    return _read_candidates(text)[0]


def _read_candidates(text: str, words: list[str] | None = None) -> tuple[list[Candidate], list[tuple[int, int]]]:
    """Candidates, and the capitalised pairs that are none, as a word of theirs says what kind of place they are; ``words`` are those of the
    text in small letters, where they are known."""
    found: dict[tuple[int, int], Candidate] = {}
    places: list[tuple[int, int]] = []

    def add(c: Candidate) -> None:
        found.setdefault(c[:2], c)

    low = _small(text)
    if any(w in low for w in _CUE_WORDS):
        for cue in _CUE.finditer(low):
            if m := _NAME_THERE.match(text, cue.end()):
                add(_candidate(m, True))
    capitals = text.isupper()
    for m in _TITLED.finditer(text) if not _TITLE_WORDS.isdisjoint(words if words is not None else _WORDS.findall(low)) else ():
        # in capitals only titles that are no everyday word tell anything
        if m["a"][0].isupper() and not (capitals and m.group().split()[0].strip(".").lower() in _EVERYDAY_TITLES):
            add(_candidate(m, True))
    for m in _INITIAL.finditer(text):
        add(_candidate(m, False))
    for m in _CAPITAL.finditer(text):
        first, second = key_of(m[1]), key_of(m[4])
        if first in _NO_NAME or second in _NO_NAME:
            places.append((m.start(), m.end(4)))
        elif min(len(m[1]), len(m[4])) > 1:
            add((m.start(), m.end(4), *((second, first) if m[3] else (first, second)), False))
    return list(found.values()), places


def cued_candidates(text: str, cues: frozenset[int], sure: frozenset[str]) -> list[Candidate]:
    """Candidates of any case: those that stand in a learned context, which introduces them, and those with a sure word, which does not."""
    found: dict[tuple[int, int], Candidate] = {}
    around = Contexts(_small(text))
    starts = around.starts

    def add(m: re.Match | None, slot: bool, shift: int = 0) -> None:
        if m:
            c = _candidate(m, slot, shift)
            found.setdefault(c[:2], c)

    words = around.words
    for at, (begin, word) in enumerate(zip(starts, words)):
        end = begin + len(word)
        if word[0].isalpha():
            if not cues.isdisjoint(around.before(at)):
                add(_NAME_THERE.match(text, begin), True)
            if not cues.isdisjoint(around.after(at + 1)):
                since = starts[max(0, at + 1 - _NAME_WORDS)]
                add(_NAME_ENDING.search(text[since:end]), True, since)
    for at, word in enumerate(words):
        if word in sure:
            for since in range(max(0, at - 3), at + 1):
                if (m := _NAME_THERE.match(text, starts[since])) and m.end() >= starts[at] + len(word) and word in _candidate(m, False)[2:4]:
                    add(m, False)
    return list(found.values())


_NAMES = ("row_kind", "key", "places", "text_hash", "pii_kind", "begin", "end", "word", "other", "seeded", "cased", "contexts", "words", "n", "slots", "streets")
_SCHEMA = "row_kind string, key {kind}, places array<struct<field_name:string,shift:int>>, text_hash bigint, pii_kind string, begin int, `end` int, word string, other string, seeded boolean, cased boolean, contexts array<bigint>, words array<string>, n array<bigint>, slots array<bigint>, streets array<bigint>"


def _is_evidence(rest: str, begin: int, end: int, other: str | None) -> bool:
    """Only a capitalised candidate counts as evidence: caseless text says nothing about names."""
    return not rest.isupper() and rest[begin:end].split()[-1][0].isupper() and (other is None or rest[begin].isupper())


def _columns(rows: list[tuple]) -> dict[str, list]:
    return dict(zip(_NAMES, map(list, zip(*rows)))) if rows else {n: [] for n in _NAMES}


def _each(batch: dict[str, list], key: str, fields: tuple[str, ...], read) -> list[tuple]:
    """What ``read`` makes of every different text of a row, with the fields that hold it and how far in each it begins."""
    rows: list[tuple] = []
    for i, k in enumerate(batch[key]):
        places: dict[str, list[dict]] = {}
        for f in fields:
            if text := batch[f][i]:
                places.setdefault(text.strip(), []).append({"field_name": f, "shift": len(text) - len(text.lstrip())})
        for core, where in places.items():
            plain, origin = repair_aligned(core)
            made = read(plain)
            if made:
                h = xxhash.xxh3_64_intdigest(core) - (1 << 63)
                # found in the restored text, reported where they stand
                rows += [("span", k, where, h, kind, *((origin[b], origin[e]) if origin else (b, e)), *more, None, None, None, None) for kind, b, e, *more in made]
    return rows


def scan(df: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """One pass over all texts: spans by shape, name candidates with their contexts, and per batch the counts of words and contexts.

    A field equal to the one before it (up to outer blanks) is worked out once; its counts enter once.
    """

    def run(batch: dict[str, list]) -> dict[str, list]:
        total: Counter[str] = Counter()
        slots: Counter[str] = Counter()
        streets: Counter[str] = Counter()
        seen: Counter[int] = Counter()
        met: list[int] = []
        said: list[str] = []

        def read(plain: str) -> list[tuple]:
            shapes, rest = shaped(plain)
            low = rest.lower()
            words = _WORDS.findall(low)
            said.extend(words)
            streets.update(beside_streets(plain.lower()))
            # words of what was blanked out count as well, where they have to disclose a street
            said.extend(w for *_, w in shapes if w)
            made = [(kind, b, e, w, plain[b:e] if kind in ("email", "phone", "id_number") else None, None, None, None) for kind, b, e, w in shapes]
            found, places = _read_candidates(rest, words)
            around = Contexts(low) if (found or places) and len(low) == len(rest) else None
            if around:  # such a pair speaks against a context
                for begin, end in places:
                    met.extend(around.around(begin, end))
            taken: list[tuple[int, int]] = []
            for begin, end, word, other, seeded in found:
                cased = _is_evidence(rest, begin, end, other)
                contexts = around.around(begin, end) if around and cased else []
                met.extend(contexts)
                made.append(("name", begin, end, word, other, seeded, cased, contexts))
                # a place counts once as evidence, by its first reading
                if seeded and cased and not any(begin < e and b < end for b, e in taken):
                    taken.append((begin, end))
                    slots[word] += 1
                    if other:
                        slots[other] += 1
            return made

        rows = _each(batch, key, fields, read)
        total.update(said)
        seen.update(met)
        # one row for all counts of the batch, unpacked where they are summed
        none, words = (None,) * 10, list(total)
        rows.append(("count", *none, None, words, list(total.values()), [slots[w] for w in words], [streets[w] for w in words]))
        rows.append(("context", *none, list(seen), None, list(seen.values()), None, None))
        return _columns(rows)

    return map_columns(df.select(key, *fields), run, _SCHEMA.format(kind=dict(df.dtypes)[key]))


def scan_cued(df: DataFrame, key: str, fields: tuple[str, ...], cues: list[int], sure: list[str]) -> DataFrame:
    """Candidates in the learned contexts, or with one of the sure words, of texts whose capitals tell nothing; other texts stay in the JVM."""
    known, certain = frozenset(cues), frozenset(sure)

    def run(batch: dict[str, list]) -> dict[str, list]:
        def read(plain: str) -> list[tuple]:
            if _CASED.search(plain):
                return []
            rest = shaped(plain)[1]
            return [("name", b, e, w, o, s, False, []) for b, e, w, o, s in cued_candidates(rest, known, certain)]

        return _columns(_each(batch, key, fields, read))

    caseless = None
    for f in fields:
        one = F.col(f).isNotNull() & ~F.col(f).rlike(CASED)
        caseless = one if caseless is None else caseless | one
    return map_columns(df.where(caseless).select(key, *fields), run, _SCHEMA.format(kind=dict(df.dtypes)[key]))


def _share(word: str) -> Column:
    return F.col(f"{word}_slots") / F.col(f"{word}_n")


def learned_contexts(candidates: DataFrame, counts: DataFrame, totals: DataFrame) -> list[int]:
    """Contexts in which mostly seeded names stand: at most ``4 / CUE_SHARE``, as each has that share of the names and a name has four."""
    telling = counts.where(F.col("slots") >= IN_SLOT * F.col("n")).where("slots > 0").select("word")
    cased = candidates.where("cased AND size(contexts) > 0").select("key", "text_hash", "begin", "end", "word", "other", "contexts")
    # either word tells; a candidate of both fields, or delivered twice, counts as often as it is read
    named = cased.join(telling, "word", "left_semi").unionByName(cased.join(telling.withColumnRenamed("word", "other"), "other", "left_semi").select(cased.columns))
    named = shared_checkpoint(named.groupBy("key", "text_hash", "begin", "end").agg(F.first("contexts").alias("contexts")))
    n_names = named.count()
    each = named.select(F.explode("contexts").alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("names"))
    each = each.where(F.col("names") >= max(CUE_LEAST, CUE_SHARE * n_names))
    return [r[0] for r in each.join(totals, "c").where(F.col("names") >= CUE * F.col("n")).select("c").collect()]


def sure_words(counts: DataFrame) -> list[str]:
    """Words that are mostly introduced and make up ``CUE_SHARE`` of all introductions, so at most ``1 / CUE_SHARE`` of them."""
    least = max(CUE_LEAST, CUE_SHARE * (counts.agg(F.sum("slots")).first()[0] or 0))
    return [r[0] for r in counts.where((F.col("slots") >= least) & (F.col("slots") >= SURE * F.col("n"))).select("word").collect()]


def _apart(found: DataFrame) -> DataFrame:
    """Of names that overlap in a text the one with the best disclosure stays; parts of one longer name, all of whose words are introduced often enough, are united."""
    place = ["key", "text_hash"]
    best = F.array_sort(F.collect_set(F.struct((-F.col("disclosure")).alias("rank"), "begin", "end")))
    none = F.array().cast("array<struct<rank:double,begin:int,end:int>>")
    overlap = lambda x, y: (x["begin"] < y["end"]) & (y["begin"] < x["end"])
    wider = lambda x, y: F.struct(x["rank"].alias("rank"), F.least(x["begin"], y["begin"]).alias("begin"), F.greatest(x["end"], y["end"]).alias("end"))
    sure = lambda x: x["rank"] <= -IN_SLOT
    step = lambda acc, x: F.when(
        F.exists(acc, lambda y: overlap(x, y)), F.transform(acc, lambda y: F.when(overlap(x, y) & sure(x) & sure(y), wider(y, x)).otherwise(y))
    ).otherwise(F.concat(acc, F.array(x)))
    kept = F.aggregate("ranked", none, step)
    each = found.groupBy(*place).agg(best.alias("ranked"), F.first("places").alias("places")).select("key", "places", F.explode(kept).alias("s"))
    return each.select("key", "places", F.lit("name").alias("pii_kind"), "s.begin", "s.end")


def _names(found: DataFrame, counts: DataFrame) -> DataFrame:
    """Candidates (with ``in_slot``) whose words disclose a person enough; decided once per pair of words."""
    pair = ["word", "second", "in_slot"]
    placed = found.withColumn("second", F.coalesce("other", F.lit("")))
    kinds = placed.select(*pair).distinct().withColumn("other", F.nullif("second", F.lit("")))
    telling = counts.where("slots > 0")
    side = lambda s: telling.select(F.col("word").alias(s), F.col("n").alias(f"{s}_n"), F.col("slots").alias(f"{s}_slots"))
    two = shared_checkpoint(kinds.join(side("word"), "word", "left").join(side("other"), "other", "left"))
    surer, lesser = F.greatest(_share("word"), F.coalesce(_share("other"), F.lit(0.0))), F.least(_share("word"), _share("other"))
    single = F.col("other").isNull()
    known = F.col("word_n").isNotNull()
    # outside a slot, a word without any slot stands beside a sure one only while it is too rare in the corpus to be everyday speech
    slotless = F.when(~F.col("in_slot") & ~known, F.col("word")).when(~F.col("in_slot") & F.col("other_n").isNull(), F.col("other"))
    disclosure = F.when(single, _share("word")).when(known & F.col("other_n").isNotNull(), lesser).otherwise(0.0)
    exceeds = F.when(single, _share("word") >= F.when(F.col("in_slot"), IN_SLOT).otherwise(SURE)).otherwise(
        F.when(F.col("in_slot"), lesser >= IN_SLOT).otherwise((surer >= SURE) & (lesser >= OTHER))
    )
    everyday = counts.where(f"slots = 0 AND n >= {EVERYDAY}").select(F.col("word").alias("unknown"))
    kept = two.where(exceeds).withColumns({"disclosure": disclosure, "unknown": slotless}).join(everyday, "unknown", "left_anti").select(*pair, "disclosure")
    # a sure first name with a word nobody else uses is a name as well, and so is such a word after a title or an initial inside a slot
    lone = single & F.col("in_slot") & ~known
    beside = ~single & (F.col("word_slots") >= 3) & F.col("other_n").isNull() & (_share("word") >= SURE)
    rare = counts.where("slots = 0 AND n <= 2").select(F.col("word").alias("unknown"))
    alone = two.where(lone | beside).withColumn("unknown", F.coalesce("other", "word")).join(rare, "unknown", "left_semi").select(*pair, F.lit(0.0).alias("disclosure"))
    decided = shared_checkpoint(kept.unionByName(alone).groupBy(*pair).agg(F.max("disclosure").alias("disclosure")))
    return placed.join(decided, pair).select("key", "places", "text_hash", "begin", "end", "disclosure")


def spans(df: DataFrame, key: str = "response_key", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """All spans of personal information: ``key, field_name, pii_kind, begin, end`` (end exclusive)."""
    made = shared_checkpoint(scan(df, key, fields))
    place = ["key", "places", "text_hash", "begin", "end"]
    counted = made.where("row_kind = 'count'").select(F.inline(F.arrays_zip(F.col("words").alias("word"), "n", "slots", "streets")))
    first = counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("slots").alias("slots"), F.sum("streets").alias("streets"))
    first = shared_checkpoint(first)
    found = made.where("row_kind = 'span'")
    names = found.where("pii_kind = 'name'").select(*place, "word", "other", "seeded", "cased", "contexts")
    totals = made.where("row_kind = 'context'").select(F.inline(F.arrays_zip(F.col("contexts").alias("c"), "n"))).groupBy("c").agg(F.sum("n").alias("n"))
    cues = learned_contexts(names, first, totals)
    # which candidates are introduced, by a seed or a learned context
    listed = F.array(*map(F.lit, cues)).cast("array<bigint>") if cues else F.array().cast("array<bigint>")
    introduced = names.withColumn("in_slot", F.col("seeded") | F.arrays_overlap("contexts", listed)).drop("contexts", "seeded")
    again = introduced.where("in_slot AND cased").groupBy("key", "text_hash", "begin", "end", "word", "other").agg(F.lit(1).alias("one"))
    evidence = again.select(F.explode(F.array_compact(F.array("word", "other"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("more"))
    counts = first.join(evidence, "word", "left").select("word", "n", F.greatest("slots", F.coalesce("more", F.lit(0))).alias("slots"), "streets")
    counts = shared_checkpoint(counts)
    sure = sure_words(counts)
    cued = scan_cued(df, key, fields, cues, sure).select(*place, "word", "other", F.col("seeded").alias("in_slot"))
    everywhere = shared_checkpoint(introduced.drop("cased").unionByName(cued))
    # shapes that too many texts share are public; streets need a word that discloses them
    shapes = found.where("pii_kind <> 'name'").withColumnRenamed("other", "shape")
    texts = df.select(F.approx_count_distinct(key)).first()[0]
    public = shapes.where("shape IS NOT NULL").groupBy("shape").agg(F.count_distinct("key").alias("k")).where(F.col("k") * 2**PUBLIC > F.lit(texts + SMOOTHED)).select("shape")
    private = shapes.join(public, "shape", "left_anti")
    streets = counts.where(F.col("streets") >= STREET * F.col("n")).select("word")
    private = private.where("word IS NULL").unionByName(private.join(streets, "word", "left_semi").select(private.columns))
    column = ["key", "places", "pii_kind", "begin", "end"]
    each = private.select(column).unionByName(_apart(_names(everywhere, counts)).select(column)).withColumn("p", F.explode("places"))
    return each.select(F.col("key").alias(key), "p.field_name", "pii_kind", (F.col("begin") + F.col("p.shift")).alias("begin"), (F.col("end") + F.col("p.shift")).alias("end"))


def found_kinds(df: DataFrame, key: str = "response_key", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Each kind that occurs at least once in a field of a key."""
    return spans(df, key, fields).select(key, "field_name", "pii_kind").distinct()


def redact(df: DataFrame, key: str = "response_key", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``key`` and the fields with every span replaced by the placeholder of its kind, everything else unchanged.

    Deliveries of one key that differ in their texts are refused by the caller's key; the greatest value of each is kept.
    """
    once = df.groupBy(key).agg(*[F.max(f).alias(f) for f in fields])
    marks = spans(once, key, fields).groupBy(key).agg(
        F.sort_array(F.collect_set(F.struct("field_name", "begin", "end", "pii_kind"))).alias("marks")
    )
    kind = dict(df.dtypes)[key]

    def run(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {key: batch[key]} | {f: [] for f in fields}
        for i, marks in enumerate(batch["marks"]):
            for f in fields:
                text = batch[f][i]
                if text is not None and marks:
                    parts, at = [], 0
                    for m in marks:
                        if m["field_name"] == f and m["begin"] >= at:
                            parts += [text[at : m["begin"]], PLACEHOLDERS[m["pii_kind"]]]
                            at = m["end"]
                    text = "".join(parts) + text[at:]
                out[f].append(text)
        return out

    schema = ", ".join([f"`{key}` {kind}"] + [f"`{f}` string" for f in fields])
    return map_columns(once.join(marks, key, "left"), run, schema)
