import duckdb
from pyspark.sql import functions as F

from voxframe.llm import dedup, queries, sql


def test_hot_text_is_one_group(spark):
    hot = spark.range(3000).select(F.concat(F.lit("1:1:"), "id").alias("response_key"), F.lit(1).alias("question_id"), F.when(F.col("id") % 2 == 0, "Same, text!").otherwise("same TEXT").alias("response_text"))
    rows = dedup.duplicate_responses(hot).collect()
    assert [(r.first_key, r.copies) for r in rows] == [("1:1:0", 3000)]


def test_whole_table_against_sql(spark, tiny):
    con = duckdb.connect()
    for t in ("responses", "raw_rows"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    got = sorted(map(tuple, queries.p3_found(spark, tiny).select("record_kind", "first_key", "copies").collect()))
    assert got == sorted(con.execute(sql.P3).fetchall()) and got
