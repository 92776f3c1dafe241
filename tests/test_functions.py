import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from voxframe.functions import dates, encoding, hashing, text


def column(spark, values, expression, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(expression(F.col("v"))).collect()]


def test_dates(spark):
    good = ["2023-09-19", "9/19/2023", "9/19/23", "2023/09/19", "19-Sep-2023", "2023-09-19 00:00:00"]
    assert column(spark, good, dates.parse_date) == [dt.date(2023, 9, 19)] * len(good)
    assert column(spark, ["12/1/2026", "1/2/70"], dates.parse_date) == [dt.date(2026, 12, 1), dt.date(1970, 1, 2)]
    assert column(spark, ["", "not a date", "13/45/2023", "999", "Q3 2023", None], dates.parse_date) == [None] * 6


def test_buckets_and_periods(spark):
    days = [dt.date(2023, 9, 19), dt.date(2024, 1, 5), None]
    assert column(spark, days, lambda c: dates.bucket_label(c, "quarter"), "date") == ["2023 Q3", "2024 Q1", None]
    assert column(spark, days, lambda c: dates.bucket_label(c, "month"), "date") == ["2023-09", "2024-01", None]
    named = dates.periods([{"label": "Summer", "start": "2023-06-01", "end": "2023-09-30"}])
    assert column(spark, days, lambda c: dates.period_label(c, named), "date") == ["Summer", "(unlabeled)", None]
    with pytest.raises(ValueError):
        dates.bucket_label(F.lit(1), "week")


@pytest.mark.parametrize("config", [[], [{"label": "", "start": "2023-01-01", "end": "2023-01-02"}], [{"label": "(unlabeled)", "start": "2023-01-01", "end": "2023-01-02"}], [{"label": "a", "start": "2023-02-01", "end": "2023-01-02"}], [{"label": "a", "start": "x", "end": "2023-01-02"}], [{"label": "a", "start": "2023-01-01", "end": "2023-01-31"}, {"label": "b", "start": "2023-01-31", "end": "2023-02-01"}]])
def test_bad_periods(config):
    with pytest.raises(ValueError):
        dates.periods(config)


def test_window():
    dates.check_window("2023-01-01", None)
    with pytest.raises(ValueError):
        dates.check_window("2023-02-01", "2023-01-01")


def test_nonanswers(spark):
    assert column(spark, ["n/a", " N/A. ", "...", "", "  ", "don't know!", "not sure"], text.is_nonanswer) == [True] * 7
    assert column(spark, ["none", "nothing", "more parks", None], text.is_nonanswer) == [False, False, False, None]


def test_spans(spark):
    assert column(spark, ["The Streets.", "  Downtown   Area ", "a park", '"St. James Park"', "the", None], text.normalized_span) == ["streets", "downtown area", "park", "st. james park", "the", None]


def test_truncation(spark):
    assert column(spark, ["abcdef", "abc", None], lambda c: text.truncated(c, 4)) == ["abcd…", "abc", None]


def test_tokens_and_names(spark):
    assert column(spark, ["The Issues of Parks and bus stops"], lambda c: F.array_join(text.tokens(c), ",")) == ["park,bus,stop"]
    assert column(spark, [" Bus-Stops, (new) "], text.normalized_name) == ["busstops new"]


def test_verbatim_spans(spark):
    got = spark.createDataFrame([(["Downtown", "downtown", "the moon", " Park "], "A PARK in downtown")], "s array<string>, t string").select(text.verbatim(F.col("s"), F.col("t"))).first()[0]
    assert got == ["Downtown", "Park"]


def test_concepts(spark):
    pattern = text.concept_pattern(["bus", "light rail"])
    assert column(spark, ["Buses late", "LIGHT  RAIL", "light rails", "busy", "CAFÉ"], lambda c: c.rlike(pattern)) == [True, True, True, False, False]
    assert column(spark, ["CAFÉS"], lambda c: c.rlike(text.concept_pattern(["café"]))) == [True]


def test_json_in_prose(spark):
    got = column(spark, ['sure:\n```json\n{"a": 1}\n```', "none here", None], lambda c: text.json_in_prose(c, "a int")["a"])
    assert got == [1, None, None]


def test_citations(spark):
    assert column(spark, ["x [1, 3, 4] y [3] z [12]"], lambda c: F.array_join(text.citations(c), ",")) == ["1,3,4,12"]


def test_normalized_question():
    assert text.normalized_question("  What’s  the Straße?") == "whats the strasse"


def test_row_hash(spark):
    expected = hashlib.sha256(b"ab\0\0").hexdigest()
    df = spark.createDataFrame([("ab", ""), ("a", "b"), ("ab", None)], "x string, y string")
    got = [r[0] for r in df.select(hashing.row_hash([F.col("x"), F.col("y")])).collect()]
    assert got[0] == got[2] == expected and got[1] != expected


def test_fingerprints(spark):
    df = spark.createDataFrame([(i, f"v{i % 7}") for i in range(100)], "i int, v string")
    expected = hashlib.sha256("".join(f"v{i % 7}\0" for i in range(100)).encode()).hexdigest()
    assert hashing.ordered_fingerprint(df.withColumn("g", F.lit(1)), ["g"], "i", F.col("v")).first().fingerprint == expected
    one = hashing.block_fingerprint(df.withColumn("g", F.lit(1)), ["g"], "i", F.col("v"), 9).first().fingerprint
    other = hashing.block_fingerprint(df.withColumn("g", F.lit(1)).replace("v3", "x", "v"), ["g"], "i", F.col("v"), 9).first().fingerprint
    assert one != other
    keyed = df.select(F.col("i").cast("string").alias("k"), "v")
    assert hashing.corpus_fingerprint(keyed, "k", "v").first() == hashing.corpus_fingerprint(keyed.repartition(7), "k", "v").first()
    assert hashing.corpus_fingerprint(keyed, "k", "v").first() != hashing.corpus_fingerprint(keyed.limit(99), "k", "v").first()


def test_pair_key(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "a")], "x string, y string")
    assert df.select(hashing.pair_key(F.col("x"), F.col("y")).alias("k")).distinct().count() == 1
    assert hashing.canonical_key({"b": 1, "a": 2}) == hashing.canonical_key({"a": 2, "b": 1})


@pytest.mark.parametrize("garbled,fixed", [("mÃ¡s aÃ±os", "más años"), ("Ã\x81rboles", "Árboles"), ("más", "más"), ("plain", "plain"), ("", ""), (None, None)])
def test_encoding_repair(garbled, fixed):
    assert encoding.repair(garbled) == (fixed, garbled != fixed)


def test_encoding_repair_column(spark):
    got = encoding.with_repair(spark.createDataFrame([("mÃ¡s",), ("ok",), (None,)], "v string"), "v").collect()
    assert [tuple(r) for r in got] == [("más", True), ("ok", False), (None, False)]
