import duckdb
import pyarrow as pa
import pytest

from voxframe.llm import visual

ALIKE = [
    ("Ａbc １２", "Abc 12"), ("café", "café"), ("a​b­c", "abc"), ("a b c\td", "a b c d"), ("ﬁne ﬄow", "fine fflow"), ("Мosсow", "Mosсow"), ("рaypal", "paypal"), ("a‑b", "a-b"), ("x\r\ny", "x\ny"),
    ("ZΚ", "ZK"), ("е́", "é"), ("ё", "ë"), ("a  \nb", "a\nb"), ("﻿a", "a"), ("а́", "á"),
]
UNLIKE = [("a", "A"), ("cafe", "café"), ("a\nb", "a b"), ("x²", "x2"), ("½", "1/2"), ("a b", "ab"), ("a.", "a!"), ("a–b", "a-b"), ("👩‍👧", "👩👧"), ("λαϊκή", "λαικη"), ("ж", "x")]


@pytest.fixture(scope="module")
def form():
    con = duckdb.connect()
    sql = f"SELECT {visual.form_sql('t')} FROM (SELECT ? AS t)"
    return lambda t: con.execute(sql, [t]).fetchall()[0][0]


@pytest.mark.parametrize("a,b", ALIKE)
def test_alike(form, a, b):
    assert form(a) == form(b)


@pytest.mark.parametrize("a,b", UNLIKE)
def test_unlike(form, a, b):
    assert form(a) != form(b)


def test_the_form_is_final(form):
    for pair in ALIKE + UNLIKE:
        for t in pair:
            assert form(form(t)) == form(t)


def test_pairs(spark):
    texts = ["abc", "abс", "ab​c", "abc", "ABC", None, "", "​", "  "]
    got = {tuple(r) for r in visual.look_alike_pairs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {(0, 1), (0, 2), (1, 2), (1, 3), (2, 3)}
    assert {tuple(r) for r in visual.look_alike_pairs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block_rows=1).collect()} == got


def test_classes(spark):
    texts = ["abc", "abс", "ab​c", "abc", "ABC", None, "", "abc"]
    df = spark.createDataFrame([*enumerate(texts), (None, "abс")], "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.members, r.links) for r in visual.look_alike_classes(df).collect()}
    pairs = [tuple(r) for r in visual.look_alike_pairs(df).collect()]
    assert got == {i: (0, 5, sum(i in p for p in pairs)) for i in (0, 1, 2, 3, 7)}


def test_slices_hold_every_row():
    texts = [None, "", "x" * 30, "y" * 5, "z" * 70, "a", "b" * 9]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["k", "t"])
    for most in (1, 10, 40, 1000):
        parts = list(visual._slices(batch, 1, most))
        assert [t for p in parts for t in p.column(1).to_pylist()] == texts
        assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= most for p in parts)
