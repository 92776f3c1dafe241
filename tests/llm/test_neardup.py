import random

import regex

from voxframe.llm import neardup

WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def corpus(seed=3):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(600)]
    rows = []
    for q in (1, 2):
        for _ in range(60):
            base = r.sample(words, r.randint(15, 60))
            for _ in range(r.randint(1, 4)):
                text = list(base)
                for _ in range(r.randint(0, 9)):
                    k = r.randrange(len(text))
                    r.choice([lambda: text.__setitem__(k, r.choice(words)), lambda: text.pop(k), lambda: text.insert(k, r.choice(words))])()
                rows.append((f"1:{q}:{len(rows)}", q, r.choice([" ", ", "]).join(text)))
        rows += [(f"1:{q}:{len(rows) + i}", q, "Copy " + " ".join(words[:25])) for i in range(40)]
    return rows


def brute(rows, p=7, q=10, least=20):
    sets = [(k, s, set(WORD.findall(t.lower())), regex.sub(r"[^\p{L}\p{M}\p{N}]", "", t.lower())) for k, s, t in rows]
    return {
        (min(a, b), max(a, b))
        for i, (a, s, x, f) in enumerate(sets)
        for b, t, y, g in sets[i + 1 :]
        if s == t and f != g and len(x) >= least and len(y) >= least and q * len(x & y) >= p * len(x | y)
    }


def test_against_brute_force(spark):
    rows = corpus()
    expected = brute(rows)
    got = {tuple(r) for r in neardup.near_pairs(spark.createDataFrame(rows, "response_key string, question_id long, response_text string")).collect()}
    assert not got - expected
    assert len(got) >= 0.97 * len(expected) > 20


def test_groups_follow_links(spark):
    rows = corpus(4)
    df = spark.createDataFrame(rows, "response_key string, question_id long, response_text string")
    pairs = {tuple(r) for r in neardup.near_pairs(df).collect()}
    groups = {r.response_key: (r.group_key, r.links) for r in neardup.near_groups(df).collect()}
    parent = {k: k for k in groups}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    copies = [k for k, q, t in rows if t.startswith("Copy")]
    for k, (g, links) in groups.items():
        if k not in copies:
            assert g == root(k)
            assert links == sum(k in p for p in pairs)


def test_hot_buckets_in_blocks_give_the_same(spark):
    df = spark.createDataFrame(corpus(6), "response_key string, question_id long, response_text string")
    whole = {tuple(r) for r in neardup.near_pairs(df).collect()}
    assert whole and {tuple(r) for r in neardup.near_pairs(df, block_rows=2).collect()} == whole


def test_components_of_a_long_chain(spark):
    r = random.Random(8)
    names = list(range(400))
    r.shuffle(names)
    edges = [(names[i], names[i + 1]) for i in range(299)] + [(names[i], names[299]) for i in range(300, 350)] + [(names[i], names[i + 1]) for i in range(350, 399, 2)]
    got = {x.c: x.root for x in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    chain = min(names[:350])
    expected = {n: chain for n in names[:350] if n != chain} | {max(names[i], names[i + 1]): min(names[i], names[i + 1]) for i in range(350, 399, 2)}
    assert got == expected
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_recall_formula():
    curve = lambda s: (1 - (1 - s**neardup.BAND_WIDTH) ** neardup.BANDS) ** 2
    assert curve(0.7) > 0.96 and curve(0.8) > 0.995 and curve(0.85) > 0.998


def test_one_hot_scope_of_copies(spark):
    rows = [(f"1:1:{i}", 1, "Hot " + " ".join(f"w{k}" for k in range(25)) + ("!" if i % 2 else "")) for i in range(2000)]
    assert neardup.near_pairs(spark.createDataFrame(rows, "response_key string, question_id long, response_text string")).count() == 0
