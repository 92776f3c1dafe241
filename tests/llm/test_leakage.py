import random

from hypothesis import given, settings
from hypothesis import strategies as st

from voxframe.llm.leakage import LEAST_COVERING, SuffixAutomaton, leaked_items, scan

WORDS = st.lists(st.sampled_from("abc"), max_size=30)


def brute(items, doc, least):
    grams = {tuple(doc[i : i + least]) for i in range(len(doc) - least + 1)}
    return {k for k, w in items if any(tuple(w[i : i + least]) in grams for i in range(len(w) - least + 1))}


@settings(max_examples=300, deadline=None)
@given(st.lists(WORDS, max_size=5), WORDS, st.integers(1, 6))
def test_against_brute_force(texts, doc, least):
    items = list(enumerate(texts))
    automaton = SuffixAutomaton(items)
    found, spans = automaton.matches(doc, least)
    assert found == brute(items, doc, least)
    assert all(e - b >= least for b, e in spans)
    inside = {j for i in range(len(doc) - least + 1) for j in range(i, i + least) if any(doc[i : i + least] == w[k : k + least] for _, w in items for k in range(len(w)))}
    assert {j for b, e in spans for j in range(b, e)} == inside


@settings(max_examples=300, deadline=None)
@given(st.lists(WORDS, max_size=4), WORDS, st.integers(8, 12))
def test_coverage_against_brute_force(texts, doc, least):
    """An item is found when that share of its words stands in the document in a row, however short it is."""
    items = list(enumerate(texts))
    covered, inside = set(), set()
    for i, w in items:
        for a in range(len(w)):
            for b in range(a + LEAST_COVERING, len(w) + 1):
                if b - a >= 0.8 * len(w) or b - a >= least:
                    for at in range(len(doc) - (b - a) + 1):
                        if doc[at : at + b - a] == w[a:b]:
                            covered.add(i)
                            inside |= set(range(at, at + b - a))
    found, spans = SuffixAutomaton(items, 0.8).matches(doc, least)
    assert found == covered
    assert {j for b, e in spans for j in range(b, e)} == inside


def test_blocks_give_the_same(spark):
    r = random.Random(1)
    vocabulary = [f"w{i}" for i in range(50)]
    texts = [[r.choice(vocabulary) for _ in range(40)] for _ in range(8)]
    docs = []
    for i in range(30):
        t = [r.choice(vocabulary) for _ in range(20)]
        if i % 3 == 0:
            source = r.choice(texts)
            t += source[5 : 5 + r.randint(10, 14)]
        docs.append((i, " ".join(t).upper()))
    items = [(100 + i, ", ".join(t)) for i, t in enumerate(texts)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(items, "item_id long, text string")
    expected = {(i, k) for i, t in docs for k in brute([(k, w.split(", ")) for k, w in items], t.lower().split(), 12)}
    assert expected
    assert {tuple(x) for x in leaked_items(d, q).collect()} == expected
    assert {tuple(x) for x in leaked_items(d, q, max_block_words=90).collect()} == expected
    rows = [tuple(map(str, x)) for x in scan(d, q, coverage=None).collect()]
    assert len(rows) == len({i for i, _ in expected})
    for blocks in (90, 1):  # one row per document, cut once, whatever the number of passes
        assert sorted(tuple(map(str, x)) for x in scan(d, q, coverage=None, max_block_words=blocks).collect()) == sorted(rows)
        assert sorted(tuple(map(str, x)) for x in scan(d, q, max_block_words=blocks).collect()) == sorted(tuple(map(str, x)) for x in scan(d, q).collect())
    assert all(not brute([(k, w.split(", ")) for k, w in items], t.lower().split(), 12) for *_, t in rows)


def test_positions_hold_for_the_text_as_it_is(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    docs = [(1, f"Keep THIS İstanbul Text. {item.upper()} And İzmir."), (2, "İ a short answer of mine İ")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame([(7, item), (8, "A short answer, of mine!")], "item_id long, text string")
    got = {x.doc_id: x for x in scan(d, q).collect()}
    assert got[1].clean_text == "Keep THIS İstanbul Text.  And İzmir." and got[1].items == [7] and got[1].leaked_chars == len(item)
    assert got[2].clean_text == "İ  İ" and got[2].items == [8]
    assert {x.doc_id for x in scan(d, q, coverage=None).collect()} == {1}
