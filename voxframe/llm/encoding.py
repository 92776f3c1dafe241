"""P5: text that was decoded with the wrong character encoding.

Garbled sequences are worked out in advance for all pairs of a written and a wrongly read encoding, and a multi-pattern automaton finds them
in one pass.  Only matched spans are replaced, so correct text beside them stays as it is.  A replacement character marks a field whose text is
lost.

* *UTF-8 read as a single-byte encoding*: every character of the alphabets in ``SCRIPTS`` as a sequence of two or three; for longer ones the
  automaton holds what their first two bytes become, and the rest is read byte by byte.  Latin letters, signs and emoji count wherever they stand; letters of
  other scripts need a second one of their script in the text, as one alone may be meant.
* *A single-byte encoding read as another one*: every letter becomes one other character, which may be meant, so it takes a word to tell.
  In Latin text a letter with a mark has become something no small letter is, in the middle of a small word (``LATIN_WRITTEN``).  In
  other scripts (``SCRIPT_WRITTEN``) a whole word has become letters that do not go together; it is restored where the other reading is the likelier one by
  the frequency of its letters and the order of capitals.  The pair of encodings that explains most of a text is taken, and one that explains too little is not.

A sequence that starts with a capital which is a letter of its own right (as in Portuguese or French capitals) and goes
on with closing punctuation is a case only inside a word, or after a small letter.

Not found: a letter read as another small letter of the same script, which only a dictionary could tell (cp1252 as cp1250: "ñ" as "ń"), and one ambiguous word of a
text that is correct otherwise.

Defined cases: null and empty fields are no cases; a repeated key reports once; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns

#: Single-byte encodings in which text is misread; bytes an encoding lacks come out as control characters.
WRONG_ENCODINGS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "iso8859-15", "cp1254", "cp1253", "cp852", "iso8859-2", "cp866", "koi8-r")
#: Encodings in which Latin text, and text of other scripts, was written before it was misread.
LATIN_WRITTEN = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp852")
SCRIPT_WRITTEN = {"Cyrillic": ("cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic"), "Greek": ("cp1253", "iso8859-7"), "Hebrew": ("cp1255",), "Arabic": ("cp1256",)}
LOST = "\ufffd"
_CLOSING = set("”’…»–—\xa0")
#: First and last code point of scripts beyond the Latin letters, signs and emoji of ``_likely``.
SCRIPTS = {
    "Latin": ((0x180, 0x24F), (0x1E00, 0x1EFF)), "Mark": ((0x300, 0x36F),), "Greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)), "Cyrillic": ((0x400, 0x52F),), "Armenian": ((0x531, 0x58F),), "Hebrew": ((0x591, 0x5F4),),
    "Arabic": ((0x60C, 0x6FF),), "Indic": ((0x900, 0xDFF),), "Thai": ((0xE01, 0xE5B),), "Georgian": ((0x10A0, 0x10FF),), "Kana": ((0x3001, 0x30FF), (0xFF61, 0xFF9F)), "Han": ((0x3400, 0x9FFF),), "Hangul": ((0xAC00, 0xD7A3),),
}
# Letters of a script from the most to the least frequent in running text.
LETTERS = {
    "Cyrillic": "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъёіїєґ", "Greek": "αοιετνσηρπκμλυςόάίέγδωθήχβφύξώζψϊϋΐΰ", "Hebrew": "יוהלארתמבשנדעקםפחטסכגצןזךףץ", "Arabic": "اليمنوترهبدعسقكفحجةأشصزخطغضىذثظءئإآؤ",
}
#: How much likelier, in mean log frequency of a letter, the other reading of a word has to be, and how likely itself; different letters of a word, and letters of a text, that it takes.
LIKELIER, LEAST_LIKELY, WORD_LETTERS, TEXT_LETTERS = 0.7, -3.0, 3, 5
#: Mean log frequency of its letters from which a text reads well as it is.
LIKELY_TEXT = -2.3


def misread(data: bytes, encoding: str) -> str:
    out = []
    for b in data:
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


def _likely() -> list[str]:
    """Latin letters with marks, signs, punctuation, special blanks and emoji."""
    ranges = ((0xA0, 0x180), (0x2000, 0x2070), (0x20A0, 0x20C0), (0x2100, 0x2130), (0x2190, 0x2200), (0x2600, 0x27C0), (0xFE0F, 0xFE10), (0xFEFF, 0xFF00), (0xFF01, 0xFF5F), (0xFFFD, 0xFFFE), (0x1F300, 0x1F6FF), (0x1F900, 0x1FA00))
    return [chr(c) for a, b in ranges for c in range(a, b)]


_LIKELY = frozenset(_likely())


@lru_cache(maxsize=1)
def sequences() -> dict[str, str]:
    """Garbled sequence to the character it was; the earlier encoding wins a tie.

    A no-break space or soft hyphen inside a sequence may have become a plain blank since.
    """
    known: dict[str, str] = {}
    for encoding in WRONG_ENCODINGS:
        for c in _likely():
            garbled = misread(c.encode("utf-8"), encoding)
            if not garbled.isascii():
                known.setdefault(garbled, c)
    for c in _likely()[: 0xE0]:  # letters and signs misread twice
        for encoding in WRONG_ENCODINGS[:4]:
            twice = misread(misread(c.encode("utf-8"), encoding).encode("utf-8"), encoding)
            known.setdefault(twice, c)
    for code in range(0x80, 0xA0):  # a control character is never meant; it is one byte of a character misread twice
        known.setdefault("Â" + chr(code), chr(code))
    known.setdefault("â€", "”")  # the third byte has no character and was dropped
    for first in ("Â", "Ã", "В", "Г"):
        known.setdefault(first + " ", " " if first in "ÂВ" else "à ")
    return known


def script_of(c: str) -> str | None:
    code = ord(c)
    return next((name for name, ranges in SCRIPTS.items() if any(a <= code <= b for a, b in ranges)), None)


@lru_cache(maxsize=1)
def script_sequences() -> dict[str, list[str]]:
    """Garbled beginnings (two bytes) of the letters of ``SCRIPTS``, with the encodings that show them so."""
    begun: dict[str, list[str]] = {}
    for encoding in WRONG_ENCODINGS:
        shown = _shown(encoding)
        leads = {chr(code).encode("utf-8")[:2] for ranges in SCRIPTS.values() for a, b in ranges for code in (range(a, b + 1) if b <= 0x7FF else range(a, b + 1, 16))}
        for lead in sorted(leads):
            begun.setdefault(shown[lead[0]] + shown[lead[1]], []).append(encoding)
    return begun


@lru_cache(maxsize=None)
def _shown(encoding: str) -> list[str]:
    """What each byte is read as."""
    return [misread(bytes([b]), encoding) for b in range(256)]


@lru_cache(maxsize=None)
def _byte_of(encoding: str) -> dict[str, int]:
    return {c: b for b, c in enumerate(_shown(encoding))}


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """All sequences: length, what they were, and for beginnings of letters of ``SCRIPTS`` the encodings."""
    built = ahocorasick.Automaton()
    plain = sequences()
    for garbled, encodings in script_sequences().items():
        built.add_word(garbled, (2, plain.get(garbled), tuple(encodings)))
    for garbled, c in plain.items():
        if garbled not in built:
            built.add_word(garbled, (len(garbled), c, ()))
    built.make_automaton()
    return built


_RUN = regex.compile(r"[^\x00-\x7f]+")


def _run_readings(text: str, begin: int, end: int, encodings: set[str]) -> Iterator[tuple[str, str]]:
    """What a whole run of odd characters was, per encoding in which it was misread, if it holds a letter of ``SCRIPTS``."""
    run = text[begin:end]
    if any(all(script_of(c) == s for c in run) and _ordered(run) for s in LETTERS):
        return  # a word of that script
    for encoding in WRONG_ENCODINGS:
        if encoding in encodings:
            of = _byte_of(encoding)
            data = bytes(of.get(c, 0) for c in run)
            try:
                was = data.decode("utf-8")
            except UnicodeDecodeError:
                continue
            if all(c.isprintable() and (script_of(c) or c in _LIKELY) for c in was) and any(map(script_of, was)):
                yield encoding, was


def _script_runs(text: str, begun: list[tuple[int, tuple[str, ...]]]) -> list[tuple[int, int, str]]:
    """Runs that one encoding, the one that explains most letters of the text, makes words of."""
    explained: dict[str, list[tuple[int, int, str]]] = {}
    at = 0
    for m in _RUN.finditer(text):
        encodings: set[str] = set()
        while at < len(begun) and begun[at][0] < m.end():
            if begun[at][0] >= m.start():
                encodings.update(begun[at][1])
            at += 1
        if encodings:
            for encoding, was in _run_readings(text, m.start(), m.end(), encodings):
                explained.setdefault(encoding, []).append((m.start(), m.end(), was))
    best: tuple[float, list[tuple[int, int, str]]] = (0.0, [])
    for runs in explained.values():
        # a letter inside a word of other letters stands for itself; letters of other scripts take two side by side
        words = {script_of(c) for _, _, was in runs if sum(script_of(c) is not None for c in was) > 1 for c in was}
        inside = lambda b, e: (b and "a" <= text[b - 1].lower() <= "z") or (e - b > 2 and "a" <= text[e : e + 1].lower() <= "z")
        kept = [(b, e, was) for b, e, was in runs if any((script_of(c) in ("Latin", "Mark") and inside(b, e)) or (len(was) > 1 and script_of(c)) or script_of(c) in words - {"Latin", "Mark"} for c in was)]
        letters = sum(len(was) for _, _, was in kept)
        likely = sum(_frequencies(s).get(c, -5.0) for _, _, was in kept for c in was.lower() if (s := script_of(c)) in LETTERS)
        if kept and letters * 10 + likely > best[0]:
            best = (letters * 10 + likely, kept)
    return best[1]


def _is_letter_pair(text: str, begin: int, end: int) -> bool:
    """Whether the sequence may as well be correct text."""
    first, second = text[begin], text[begin + 1]
    before = text[begin - 1] if begin else " "
    after = text[end] if end < len(text) else " "
    if second == " ":
        # a word may end in such a capital, so what comes before has to rule that out
        if first in "ВГ":
            return not ("a" <= before.lower() <= "z")
        return before.isupper() or (first == "Ã" and not before.isalpha() and not after.islower())
    if first in "ÂÃÄÅĂÐÎÏ" and second in _CLOSING:
        return before.isupper() and not after.isalpha()
    if first in "вВГРС" and second.isalpha() and (before in _CYRILLIC or after in _CYRILLIC):
        return True  # Cyrillic text
    if first in "ΓΒΟΞ" and (before in _GREEK or after in _GREEK):
        return True
    return False


_CYRILLIC = {chr(c) for c in range(0x430, 0x450)}
_GREEK = {chr(c) for c in range(0x391, 0x3CF)}


def spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost-longest garbled spans with the characters they were."""
    hits, begun = [], []
    for end, (n, c, encodings) in automaton().iter(text):
        end += 1
        if c is not None:
            hits.append((end - n, end, c))
        if encodings:
            begun.append((end - n, encodings))
    if text[-1:] in ("Â", "В") and len(text) > 1 and not (text[-2].isspace() or text[-2].isupper()):
        hits.append((len(text) - 1, len(text), ""))  # of a no-break space at the end only the first byte is left
    kept = _leftmost([h for h in hits if not (h[2] and _is_letter_pair(text, h[0], h[1]))])
    runs = _script_runs(text, begun) if begun else []
    if runs:  # what letters, signs and emoji explain wholly needs no other script
        covered = {i for b, e, _ in kept for i in range(b, e)}
        kept = _leftmost(kept + [r for r in runs if not covered.issuperset(range(r[0], r[1]))])
    return kept or single_byte_spans(text)


def _leftmost(hits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Of overlapping spans the leftmost, and of these the longest."""
    kept: list[tuple[int, int, str]] = []
    for hit in sorted(hits, key=lambda h: (h[0], -h[1])):
        if not (kept and hit[0] < kept[-1][1]):
            kept.append(hit)
    return kept


# ---- one single-byte encoding read as another -----------------------------------------------------------------------------------

_WORD = regex.compile(r"(?:[^\s\x00-\x7f]|[A-Za-z])+")
_THREE = regex.compile(r"[^\x00-\x7f\s]{3}")
#: Marks that stand in correct words, or beside them, in many languages.
_MEANT = frozenset("’‘'´`“”«»„–—-…·•°ªº¹²³™®©€£¢¥§¿¡ \xa0\xad\ufb01\ufb02")


@lru_cache(maxsize=1)
def latin_readings() -> dict[str, dict[tuple[str, str], str]]:
    """What a character inside a small Latin word may have been: per pair of encodings a small letter with a mark."""
    out: dict[str, dict[tuple[str, str], str]] = {}
    for written in LATIN_WRITTEN:
        for b in range(0x80, 0x100):
            c = _shown(written)[b]
            if not (c.isalpha() and c.islower() and ord(c) < 0x180) or c in "ªºµſ":
                continue
            for wrong in WRONG_ENCODINGS:
                g = _shown(wrong)[b]
                if g != c:
                    out.setdefault(g, {}).setdefault((written, wrong), c)
    return out


# Small Latin letters with marks, the most frequent of the surveys' languages first.
_MARKED = "éáíóãçüöäñúèàêôßâõïîûùëœåøæýščžřěůąęłńśźżőűăâîșțğşı"
_LOOK_ALIKE = frozenset("аеорсухіјѕһԁԛԝүӏοναικ")


@lru_cache(maxsize=1)
def _odd_inside() -> regex.Pattern:
    """What stands between two small letters of no correct Latin word."""
    odd = [g for g in latin_readings() if not g.isascii() and g not in _MEANT and g not in _LOOK_ALIKE and not (g.islower() and ord(g) < 0x180)]
    return regex.compile("(?<=[a-z])[" + "".join(map(regex.escape, odd)) + "](?=[a-z])")


def _latin_spans(text: str) -> list[tuple[int, int, str]]:
    if not _odd_inside().search(text):
        return []
    readings = latin_readings()
    evidence: list[tuple[int, int, int, str]] = []
    # scripts the text is written in itself: their letters inside a Latin word are look-alikes, not misread ones
    own_scripts = {script_of(m.group()[0]) for m in _WORD.finditer(text) if len({script_of(c) for c in m.group()}) == 1 and len(m.group()) >= WORD_LETTERS}
    for m in _WORD.finditer(text):
        word = m.group()
        for i, g in enumerate(word):
            # in the middle of a word of small letters, and no small Latin letter itself
            if g.isascii() or g not in readings or not 0 < i < len(word) - 1 or not ("a" <= word[i - 1] <= "z" and "a" <= word[i + 1] <= "z"):
                continue
            if g in _MEANT or g in _LOOK_ALIKE or script_of(g) in own_scripts - {None} or (g.islower() and ord(g) < 0x180) or not (word[0].isascii() and word[:1].isalpha()):
                continue
            evidence.append((m.start(), m.end(), m.start() + i, g))
    if not evidence:
        return []
    votes: Counter[tuple[str, str]] = Counter()
    rank: Counter[tuple[str, str]] = Counter()
    for *_, g in evidence:
        for pair, c in readings[g].items():
            votes[pair] += 1
            rank[pair] += _MARKED.find(c) if c in _MARKED else 60
    best = max(votes, key=lambda p: (votes[p], -rank[p]))
    # one letter alone has to be a frequent one, and the reading has to explain all there is
    if votes[best] < len(evidence) or (len(evidence) < 2 and rank[best] > 12):
        return []
    own = {m[0] for m in evidence}
    out: dict[int, str] = {}
    others: dict[int, str] = {}
    for m in _WORD.finditer(text):
        odd = [at for at in range(*m.span()) if not text[at].isascii()]
        was = {at: c for at in odd if (c := readings.get(text[at], {}).get(best))}
        if len(was) == len(odd) < len(m.group()):
            (out if m.start() in own else others).update(was)
    # one letter explains its own word; with a second or third the same reading holds for every word it makes one of small letters
    if len(evidence) > 1 or len(out) + len(others) > 2:
        out |= others
    return [(at, at + 1, c) for at, c in sorted(out.items())]


@lru_cache(maxsize=1)
def script_readings() -> dict[str, tuple[str, dict[str, dict[str, str]]]]:
    """Per written encoding its script, and per encoding it was misread in what every character was."""
    out = {}
    for script, encodings in SCRIPT_WRITTEN.items():
        for written in encodings:
            maps: dict[str, dict[str, str]] = {}
            for wrong in WRONG_ENCODINGS:
                if wrong != written:
                    maps[wrong] = {_shown(wrong)[b]: _shown(written)[b] for b in range(0x80, 0x100) if script_of(_shown(written)[b]) == script and _shown(written)[b].isalpha()}
            out[written] = (script, maps)
    return out


@lru_cache(maxsize=None)
def _frequencies(script: str) -> dict[str, float]:
    letters = LETTERS[script]
    return {c: math.log(1 / (i + 2)) for i, c in enumerate(letters)}


def _likelihood(word: str, script: str) -> float:
    """Mean log frequency of the letters; a word whose capitals are out of order is unlikely."""
    known = _frequencies(script)
    low = word.lower()
    return sum(known.get(c, -5.0) for c in low) / len(word) - (0.0 if _ordered(word) else 2.0)


def _ordered(word: str) -> bool:
    """Whether capitals stand where they may: nowhere, everywhere, or first."""
    low = word.lower()
    return word == low or word == word.upper() or word[1:] == low[1:]


def _script_spans(text: str) -> list[tuple[int, int, str]]:
    if not _THREE.search(text):
        return []
    every = [(m.start(), m.group()) for m in _WORD.finditer(text)]
    words = [(at, w) for at, w in every if len(w) >= WORD_LETTERS and not any("A" <= c <= "z" for c in w)]
    if not words:
        return []
    now = {w: max(_likelihood(w, s) if all(script_of(c) == s for c in w) else -6.0 for s in LETTERS) for _, w in words}
    if sum(now[w] * len(w) for _, w in words) >= LIKELY_TEXT * sum(len(w) for _, w in words):
        return []  # reads well as it is
    best: tuple[float, dict[str, str], list[tuple[int, str]]] = (0.0, {}, [])
    for written, (script, maps) in script_readings().items():
        for table in maps.values():
            taken, gain = [], 0.0
            for at, word in words:
                other = "".join(table.get(c, " ") for c in word)
                likely = -6.0 if " " in other or len(set(word)) < WORD_LETTERS else _likelihood(other, script)
                # a word the reading makes nothing of speaks against it
                gain += (likely - now[word]) * len(word)
                if likely >= max(LEAST_LIKELY, now[word] + LIKELIER):
                    taken.append((at, other))
            if sum(len(w) for _, w in taken) >= TEXT_LETTERS and gain > best[0]:
                best = (gain, table, taken)
    _, table, taken = best
    if len(taken) > 1:  # settled by longer words, the reading holds for the short ones as well
        taken += [(at, "".join(table[c] for c in w)) for at, w in every if len(w) < WORD_LETTERS and all(c in table for c in w)]
    return [(at + i, at + i + 1, c) for at, word in sorted(taken) for i, c in enumerate(word)]


def single_byte_spans(text: str) -> list[tuple[int, int, str]]:
    """Characters of words that were read in another single-byte encoding, with what they were."""
    return _latin_spans(text) or _script_spans(text)


def repair_aligned(text: str, passes: int = 3) -> tuple[str, list[int] | None]:
    """The text with its garbled spans restored, and for each of its positions (and its end) the position in ``text``.

    Null positions mean that nothing was garbled.
    """
    if text.isascii():
        return text, None
    origin: list[int] | None = None
    for _ in range(passes):
        found = spans(text)
        if not found:
            break
        origin = origin if origin is not None else list(range(len(text) + 1))
        parts, places, at = [], [], 0
        for begin, end, c in found:
            parts += [text[at:begin], c]
            places += origin[at:begin] + [origin[begin]] * len(c)
            at = end
        text, origin = "".join(parts) + text[at:], places + origin[at:]
    return text, origin


def repair(text: str | None, passes: int = 3) -> tuple[bool, str | None]:
    """Whether the text is garbled, and the text with its garbled spans restored where they can be."""
    if text is None or text.isascii():
        return False, text
    better, origin = repair_aligned(text, passes)
    return origin is not None or LOST in text, better


def repaired(df: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """One row per garbled field of a key: ``key``, ``field_name``, ``garbled_text``, ``restored_text``, ``is_lost``.

    Plain ASCII fields are dropped before the rows leave the JVM, and a field equal to the one before it is worked
    out once.
    """
    kind = dict(df.dtypes)[key]
    odd = None
    for f in fields:
        one = F.col(f).rlike(r"[^\x00-\x7F]")
        odd = one if odd is None else odd | one

    def run(columns: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in (key, "field_name", "garbled_text", "restored_text", "is_lost")}
        for i, k in enumerate(columns[key]):
            done: dict[str, tuple[bool, str | None]] = {}
            for f in fields:
                text = columns[f][i]
                if text is None:
                    continue
                if text not in done:
                    done[text] = repair(text)
                garbled, better = done[text]
                if garbled:
                    for n, v in zip(out, (k, f, text, better, LOST in better)):
                        out[n].append(v)
        return out

    schema = f"`{key}` {kind}, field_name string, garbled_text string, restored_text string, is_lost boolean"
    return map_columns(df.where(odd).select(key, *fields), run, schema)


def garbled_fields(df: DataFrame, key: str = "response_key", fields: tuple[str, ...] = ("response_text", "raw_text_original")) -> DataFrame:
    """The fields of each key that hold garbled characters, restorable or not."""
    return repaired(df, key, fields).select(key, "field_name").distinct()
