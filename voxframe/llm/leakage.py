"""P8: evaluation texts inside a training corpus.

A generalised suffix automaton over the words of all evaluation items is built once and broadcast; every partition streams its documents'
words through it, keeping the longest suffix that is a passage of an item.  Two limits make a passage a leak:

* *length*: it has ``min_words`` words or more;
* *coverage* (only where ``coverage`` is given): it is at least that share of one item's words, and ``LEAST_COVERING`` words or more.  So an item too
  short for the first limit is found once it stands there nearly whole.

The automaton is kept in arrays: at most two states per item word, a state with one successor takes 16 bytes, and which items hold a state's
passage is a range of one array (the tour of the suffix links), not a set per state.  A pass over the corpus holds up to ``MAX_BLOCK_WORDS``
words of items, a broadcast of at most some 100 MB; a larger evaluation set takes several passes, and what they find is united per document
before anything is removed, so the result does not depend on how many passes there were.

Defined cases: null, empty or blank texts and items leak nothing; items below ``min_words`` words cannot be found by length; repeated item ids report
once; a document delivered twice is one row for each different text; where lower-casing changes a text's length, positions are those of the text as it is;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, map_columns

MAX_BLOCK_WORDS = 1_000_000
#: Words a passage needs to count by its coverage of an item.
LEAST_COVERING = 5
#: Share of an item's words that counts as the item.
COVERAGE = 0.8


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of words, with the owners of every state."""

    def __init__(self, items: list[tuple[int, list[str]]], coverage: float | None = None):
        self.ids: dict[str, int] = {}
        self.items, self.coverage = [i for i, _ in items], coverage
        self.sizes = array("i", [len(w) for _, w in items])
        self.link, self.length = array("i", [-1]), array("i", [0])
        self.token, self.after = array("i", [-1]), array("i", [-1])  # the first successor of a state
        self.more: dict[int, dict[int, int]] = {}  # its others
        ends: list[tuple[int, int]] = []
        for number, (_, words) in enumerate(items):
            last = 0
            for w in words:
                last = self._extend(last, self.ids.setdefault(w, len(self.ids)))
                ends.append((last, number))
        self._tour(ends)

    def successor(self, state: int, token: int) -> int:
        if self.token[state] == token:
            return self.after[state]
        others = self.more.get(state)
        return -1 if others is None else others.get(token, -1)

    def _lead(self, state: int, token: int, to: int) -> None:
        if self.token[state] in (-1, token):
            self.token[state], self.after[state] = token, to
        else:
            self.more.setdefault(state, {})[token] = to

    def _state(self, length: int, link: int, like: int = -1) -> int:
        new = len(self.link)
        self.link.append(link)
        self.length.append(length)
        self.token.append(self.token[like] if like >= 0 else -1)
        self.after.append(self.after[like] if like >= 0 else -1)
        if like in self.more:
            self.more[new] = dict(self.more[like])
        return new

    def _split(self, state: int, above: int, token: int) -> int:
        """A copy of ``above`` that is exactly one word longer than ``state``."""
        copy = self._state(self.length[state] + 1, self.link[above], above)
        self.link[above] = copy
        while state >= 0 and self.successor(state, token) == above:
            self._lead(state, token, copy)
            state = self.link[state]
        return copy

    def _extend(self, last: int, token: int) -> int:
        there = self.successor(last, token)
        if there >= 0:  # another item has this passage
            return there if self.length[there] == self.length[last] + 1 else self._split(last, there, token)
        new = self._state(self.length[last] + 1, 0)
        at = last
        while at >= 0 and self.successor(at, token) < 0:
            self._lead(at, token, new)
            at = self.link[at]
        if at >= 0:
            above = self.successor(at, token)
            self.link[new] = above if self.length[above] == self.length[at] + 1 else self._split(at, above, token)
        return new

    def _tour(self, ends: list[tuple[int, int]]) -> None:
        """Items in the order of the suffix-link tree: those of a state's passage are ``tour[first:first + count]``."""
        n = len(self.link)
        own: dict[int, list[int]] = {}
        for state, number in ends:
            own.setdefault(state, []).append(number)
        count, shortest = array("i", [0]) * n, array("i", [1 << 30]) * n
        for s, numbers in own.items():
            own[s] = numbers = list(dict.fromkeys(numbers))
            count[s], shortest[s] = len(numbers), min(self.sizes[i] for i in numbers)
        by_length = sorted(range(1, n), key=self.length.__getitem__)
        for s in reversed(by_length):  # a suffix occurs wherever the longer one does
            up = self.link[s]
            count[up] += count[s]
            shortest[up] = min(shortest[up], shortest[s])
        first, free = array("i", [0]) * n, array("i", [0]) * n
        self.tour = array("i", [0]) * count[0]
        # a passage below ``covers`` words of a state is covered by a shorter suffix, if at all
        covered = bytearray(n)
        for s in [0, *by_length]:
            if s:
                up = self.link[s]
                first[s] = free[up]
                free[up] += count[s]
                covered[s] = covered[up] or self._covers(self.length[up], shortest[up])
            free[s] = first[s]
            for number in own.get(s, ()):
                self.tour[free[s]] = number
                free[s] += 1
        self.first, self.count, self.shortest, self.covered = first, count, shortest, bytes(covered)

    def _covers(self, words: int, size: int) -> bool:
        return self.coverage is not None and words >= LEAST_COVERING and words >= self.coverage * size

    def owners(self, state: int) -> set[int]:
        begin = self.first[state]
        return set(self.tour[begin : begin + self.count[state]])

    def matches(self, words: list[str], least: int) -> tuple[set[int], list[tuple[int, int]]]:
        """Items with a passage beyond the limits, and the ranges of words (end exclusive) these passages take, united."""
        tokens = list(map(self.ids.get, words))
        token_of, after, more, link, length = self.token, self.after, self.more, self.link, self.length
        state = matched = 0
        found: set[int] = set()
        asked: set[tuple[int, int]] = set()
        spans: list[tuple[int, int]] = []
        for at, token in enumerate(tokens):
            if token is None:
                state = matched = 0
                continue
            while True:
                if token_of[state] == token:
                    there = after[state]
                else:
                    others = more.get(state)
                    there = -1 if others is None else others.get(token, -1)
                if there >= 0 or not state:
                    break
                state = link[state]
                matched = length[state]
            if there < 0:
                matched = 0
                continue
            state, matched = there, matched + 1
            taken = 0
            if matched >= least:
                taken = matched
                up = state
                while length[link[up]] >= least:
                    up = link[up]
                if (up, 0) not in asked:
                    asked.add((up, 0))
                    found |= self.owners(up)
            if self.coverage is not None and (self.covered[state] or self._covers(matched, self.shortest[state])):
                up, words_here = state, matched
                while up > 0:
                    if self._covers(words_here, self.shortest[up]):
                        taken = max(taken, words_here)
                        if (up, words_here) not in asked:
                            asked.add((up, words_here))
                            found.update(i for i in self.owners(up) if self._covers(words_here, self.sizes[i]))
                    if not self.covered[up]:
                        break
                    up = link[up]
                    words_here = length[up]
            if taken:
                since = at + 1 - taken
                while spans and spans[-1][1] >= since:
                    since = min(since, spans.pop()[0])
                spans.append((since, at + 1))
        return {self.items[i] for i in found}, spans


def _blocks(items: DataFrame, key: str, text: str, most: int) -> Iterator[list[tuple[int, list[str]]]]:
    word = regex.compile(WORD_PATTERN)
    block, size = [], 0
    for row in items.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(key, text).toLocalIterator():
        words = word.findall(row[1].lower())
        if block and size + len(words) > most:
            yield block
            block, size = [], 0
        block.append((row[0], words))
        size += len(words)
    if block:
        yield block


def places(text: str, low: str, word: regex.Pattern, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character positions, in the text as it is, of ranges of words of the lower-cased text."""
    at = [(m.start(), m.end()) for m in word.finditer(low)]
    got = [(at[a][0], at[b - 1][1]) for a, b in spans]
    if len(low) == len(text):
        return got
    origin = [i for i, c in enumerate(text) for _ in c.lower()]
    return [(origin[a], origin[b - 1] + 1) for a, b in got]


def passages(
    documents: DataFrame,
    items: DataFrame,
    min_words: int = 12,
    coverage: float | None = None,
    doc_key: str = "doc_id",
    doc_text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    max_block_words: int = MAX_BLOCK_WORDS,
    with_text: bool = True,
) -> DataFrame:
    """One row per document with leaks: ``doc_key``, ``items``, and with ``with_text`` the ``text`` and the ``spans`` (begin, end) in it."""
    kind = dict(documents.dtypes)[doc_key]
    schema = f"`{doc_key}` {kind}, items array<bigint>" + (", text string, spans array<struct<begin:int,end:int>>" if with_text else "")
    source = documents.where(F.col(doc_text).isNotNull()).select(F.col(doc_key).alias("k"), F.col(doc_text).alias("t"))
    parts = []
    for block in _blocks(items, item_key, item_text, max_block_words):
        shared = documents.sparkSession.sparkContext.broadcast(SuffixAutomaton(block, coverage))

        def run(columns: dict[str, list], shared=shared) -> dict[str, list]:
            automaton, word = shared.value, regex.compile(WORD_PATTERN)
            got: dict[str, list] = {doc_key: [], "items": [], "text": [], "spans": []}
            for key, text in zip(columns["k"], columns["t"]):
                low = text.lower()
                found, spans = automaton.matches(word.findall(low), min_words)
                if found:
                    got[doc_key].append(key)
                    got["items"].append(sorted(found))
                    if with_text:
                        got["text"].append(text)
                        got["spans"].append([{"begin": a, "end": b} for a, b in places(text, low, word, spans)])
            return got

        parts.append(map_columns(source, run, schema))
    if not parts:
        return documents.sparkSession.createDataFrame([], schema)
    if len(parts) == 1:
        return parts[0]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    each = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")  # the items of one document
    if not with_text:
        return out.groupBy(doc_key).agg(each)
    united = out.groupBy(doc_key, F.xxhash64("text").alias("_h")).agg(each, F.first("text").alias("text"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    return united.drop("_h")


def scan(documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", coverage: float | None = COVERAGE, **options) -> DataFrame:
    """One row per document with leaks: ``doc_key``, ``items``, ``leaked_chars``, ``clean_text`` (the text without the passages beyond either limit)."""
    kind = dict(documents.dtypes)[doc_key]

    def cut(columns: dict[str, list]) -> dict[str, list]:
        leaked, clean = [], []
        for text, spans in zip(columns["text"], columns["spans"]):
            kept, at, gone = [], 0, 0
            for s in spans:
                begin = max(at, s["begin"])
                if s["end"] > begin:
                    kept.append(text[at:begin])
                    gone += s["end"] - begin
                    at = s["end"]
            leaked.append(gone)
            clean.append("".join(kept) + text[at:])
        return {doc_key: columns[doc_key], "items": columns["items"], "leaked_chars": leaked, "clean_text": clean}

    found = passages(documents, items, coverage=coverage, doc_key=doc_key, **options)
    return map_columns(found, cut, f"`{doc_key}` {kind}, items array<bigint>, leaked_chars bigint, clean_text string")


def leaked_items(documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", **options) -> DataFrame:
    """Pairs of a document and an item of which it holds ``min_words`` consecutive words (or, with ``coverage``, that share of the item)."""
    found = passages(documents, items, doc_key=doc_key, item_key=item_key, with_text=False, **options)
    return found.select(doc_key, F.explode("items").alias(item_key)).distinct()
