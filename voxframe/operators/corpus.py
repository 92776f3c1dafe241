"""The canonical frames: deliveries reduced to one, answers split by use, memberships, attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_nonanswer, stripped

LABEL_BLOCK = ("label_ids", "uncategorized", "fit", "locations", "time_context", "actionability", "event_occurred")


def latest(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row per key, that of the greatest ``order``; map-side combining keeps repeated keys out of the shuffle."""
    kept = F.struct(*[c for c in df.columns if c not in key])
    return df.groupBy(*key).agg(F.max_by(kept, F.coalesce(F.col(order), F.lit("1900-01-01").cast("timestamp"))).alias("_r")).select(*key, "_r.*")


def response_key(dataset: Column, question: Column, row: Column) -> Column:
    """PR-03."""
    return F.concat_ws(":", dataset, question, row)


def respondent_key(key: Column) -> Column:
    """PR-03: dataset and row of a response key; null unless the key has three parts."""
    parts = F.split(key, ":")
    return F.when(F.size(parts) == 3, F.concat_ws(":", parts[0], parts[2]))


def resolve(df: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """SC-04: the columns of a corpus whatever its export calls them; the first candidate that exists is taken."""
    out = []
    for name, candidates in wanted.items():
        there = [c for c in candidates if c in df.columns]
        if not there:
            raise ValueError(f"no column for {name}: expected one of {', '.join(candidates)}")
        out.append(F.coalesce(*[F.col(c) for c in there]).alias(name))
    return df.select(*out)


def split_answers(corpus: DataFrame, text: str = "response_text", stored: str | None = "is_nonanswer") -> DataFrame:
    """SC-04: ``answer_kind`` blank, nonanswer or usable; a stored flag goes before the rule."""
    rule = is_nonanswer(F.col(text))
    flag = F.coalesce(F.col(stored), rule) if stored and stored in corpus.columns else rule
    blank = F.col(text).isNull() | (stripped(F.col(text)) == "")
    return corpus.withColumn("answer_kind", F.when(blank, "blank").when(flag, "nonanswer").otherwise("usable"))


def questions(corpus: DataFrame) -> DataFrame:
    """SC-06: question id, its wording on the lowest row, number of rows."""
    return corpus.groupBy("question_id").agg(
        F.min_by("question_label", F.when(F.col("question_label").isNotNull(), F.struct("source_row_index", "question_label"))).alias("question_label"), F.count(F.lit(1)).alias("n_rows")
    )


def with_labels(base: DataFrame, labels: DataFrame, block: tuple[str, ...] = LABEL_BLOCK) -> DataFrame:
    """JN-01: every response with the label block of its latest record (greatest ``run_id``), null where it has none."""
    there = [c for c in block if c in labels.columns]
    newest = labels.groupBy("response_key").agg(F.max_by(F.struct(*there), "run_id").alias("_r")).select("response_key", "_r.*")
    return base.drop(*block).join(newest, "response_key", "left")


def coded(corpus: DataFrame) -> DataFrame:
    """Rows a label run covered: missing data stays missing."""
    return corpus.where("uncategorized IS NOT NULL")


def members(corpus: DataFrame) -> DataFrame:
    """AG-02: one row per response and label."""
    return corpus.select("dataset_id", "question_id", "response_key", F.explode("label_ids").alias("label_id")).distinct()


def parent_of(label_id: Column, width: int = 5) -> Column:
    """A parent per ``width`` consecutive labels of a question, for tables that come without a taxonomy."""
    number = F.split(label_id, "_")[1].cast("int")
    return F.concat(F.split(label_id, "_")[0], F.lit("_P"), F.lpad(F.floor((number - 1) / width).cast("string"), 2, "0"))


def taxonomy(corpus: DataFrame, extra: int = 1) -> DataFrame:
    """Labels of every question up to ``extra`` beyond the highest used number, so that some have no members."""
    top = members(corpus).select("question_id", F.split("label_id", "_")[1].cast("int").alias("n")).groupBy("question_id").agg(F.max("n").alias("n"))
    ids = top.select("question_id", F.explode(F.sequence(F.lit(1), F.col("n") + extra)).alias("n"))
    label = F.concat(F.col("question_id").cast("string"), F.lit("_"), F.lpad(F.col("n").cast("string"), 3, "0"))
    return ids.select("question_id", label.alias("label_id"), parent_of(label).alias("parent_id"))
