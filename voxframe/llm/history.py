"""P6: new batches against all history, by a stored pivot-distance table.

Rows are points: the set of their different words, under the number of words that differ (the size of the symmetric difference), a
metric.  The pivots are fixed: ``CLASSES`` disjoint classes of all words there are, chosen by a hash.  How near a row is to a pivot is the
number of its words in that class, so the table stores per row, sparsely, the classes it has words in (``near``, one entry for each word),
and packed its distances to ``COARSE`` pivots that unite them.  All of it depends on nothing but the row: a new file appends rows to
the table, and history is never worked through again; its texts are not even read.

Two rows are near from a Jaccard similarity of ``p/q`` on, which bounds their distance by ``(q-p)/(q+p)`` of the summed sizes.

* *Which ranges meet.*  A row of n words can only be near a row that is equally near to one of its pivots within the first ``n - ceil(p n / q) +
  1`` of them, in whatever fixed order: were all of these different, the triangle inequality would put the two too far apart.  So the
  join is an equi-join on (scope, pivot, range of the distance to it) over these few (``reach``).  The order puts pivots that few rows are near
  to first; it is counted over all rows of the first batch, stored with the table, and never changes (it decides speed alone).
* *Pruning.*  In the join condition, pairs are dropped whose sizes differ too much or whose distances to the coarse pivots do; as classes
  are disjoint, the differences add up over them.
* *Verification.*  The true distance is worked out on the words of what is left.

A range with many rows is cut into blocks of ``BLOCK_ROWS`` rows (``common.spread``).  The table lies in ``PARTS`` folders by a hash of the scope; a new file reads
those of its scopes only.

Defined cases: a row delivered twice counts once, and if its deliveries differ, each is compared; null hashes match nothing; rows of fewer than ``min_words`` words (repeated ones
counted) have no near rows; an upload without row_offset takes no part; cells that are no JSON object have no words; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch, ship_package
from .common import WORD_PATTERN, shared_checkpoint, spread

CLASSES = 1 << 16
COARSE = 16
MIN_WORDS = 12
THRESHOLD = (3, 4)
BLOCK_ROWS = 4_000
PARTS = 16
TEXT_FIELDS = ("answer_a", "answer_b")


def points(rows: DataFrame, keys: list[str], cells: str = "cells", fields: tuple[str, ...] = TEXT_FIELDS, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row with enough words: keys and the hashes of its different words; expressions only, nothing leaves the JVM."""
    parsed = F.from_json(F.col(cells), ", ".join(f"`{f}` string" for f in fields))
    text = F.concat_ws(" ", *[parsed[f] for f in fields])
    words = rows.select(*keys, F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0)).alias("_words")).where(F.size("_words") >= min_words)
    return words.select(*keys, F.array_sort(F.array_distinct(F.transform("_words", lambda w: F.xxhash64(w)))).alias("hashes"))


def pivot_order(made: DataFrame) -> DataFrame:
    """How many rows are near each pivot: at most ``CLASSES`` rows, whatever the size of the batch."""
    each = made.select(F.explode("hashes").alias("h")).select(F.col("h").bitwiseAND(F.lit(CLASSES - 1)).cast("int").alias("pivot"))
    return each.groupBy("pivot").agg(F.count(F.lit(1)).alias("rows"))


def with_distances(made: DataFrame, order: np.ndarray, threshold: tuple[int, int]) -> DataFrame:
    """The table: ``words`` (their number), ``near``-est pivots in the fixed order as far as the triangle inequality asks (``reach``), packed coarse distances, the point's name.

    A range is a pivot and a rank: the second word of one class is the range "nearer by two", so equal ranges are equal distances.
    """
    p, q = threshold
    shared = made.sparkSession.sparkContext.broadcast(order)
    names = made.columns
    more = T._parse_datatype_string("words int, reach array<bigint>, p0 bigint, p1 bigint")
    out = T.StructType([*made.schema.fields, *more.fields])
    ship_package(made.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            lists = batch.column(names.index("hashes"))
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            edges = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
            n = np.diff(edges)
            row = np.repeat(np.arange(len(n)), n)
            pivot = flat & (CLASSES - 1)
            # rank of a word within its class and row
            by = np.lexsort((pivot, row))
            same = np.r_[False, (pivot[by][1:] == pivot[by][:-1]) & (row[by][1:] == row[by][:-1])]
            start = np.maximum.accumulate(np.where(~same, np.arange(len(by)), 0))
            rank = np.empty(len(by), np.int64)
            rank[by] = np.arange(len(by)) - start
            # the first pivots of every row
            first = np.lexsort((rank, pivot, order[pivot], row))
            place = np.arange(len(first)) - edges[:-1][row[first]]
            keep = place < (n - (p * n + q - 1) // q + 1)[row[first]]
            chosen = first[keep]
            reach = pa.ListArray.from_arrays(np.r_[0, np.cumsum(np.bincount(row[chosen], minlength=len(n)))].astype(np.int32), pa.array(rank[chosen] * CLASSES + pivot[chosen]))
            coarse = np.minimum(np.bincount(row * COARSE + (pivot % COARSE), minlength=len(n) * COARSE), 255).reshape(len(n), COARSE).astype(np.uint8)
            packed = np.ascontiguousarray(coarse).view(np.int64)
            columns = [*batch.columns, pa.array(n.astype(np.int32)), reach, pa.array(packed[:, 0]), pa.array(packed[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "words", "reach", "p0", "p1"])

    placed = made.mapInArrow(run, out)
    return placed.withColumn("point", F.xxhash64("hashes"))


def _byte(packed: str, i: int) -> Column:
    return F.shiftrightunsigned(F.col(packed), 8 * i).bitwiseAND(F.lit(255).cast("long"))


def near_rows(table: DataFrame, new: DataFrame, scope: str, key: str, order: str, threshold: tuple[int, int] = THRESHOLD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows (``scope, key, order``) of ``new`` with a near row of lower ``order`` in their scope, in ``table``, which holds the new rows too.

    Rows of one and the same word set are a single point, so copies are not searched one by one.  The join carries 44 bytes a range; the words
    themselves are fetched only for pairs that the pivots could not rule out.
    """
    p, q = threshold
    shape = ["words", "p0", "p1"]
    held = table.groupBy(scope, "point", *shape).agg(F.first("reach").alias("reach"), F.min(order).alias("since"))
    begun = held.groupBy(scope).agg(F.min("since").alias("begun"))  # a row is asked for when its scope has an earlier file at all
    asked = new.join(begun, scope).where(F.col(order) > F.col("begun")).groupBy(scope, "point", *shape).agg(F.first("reach").alias("reach"), F.max(order).alias("until"))
    ranges = lambda df, last: df.select(scope, F.explode("reach").alias("range"), "point", *shape, last)
    b, a = spread(ranges(held, "since"), ranges(asked, "until"), [scope, "range"], "point", block_rows)
    a, b = a.alias("a"), b.alias("b")
    sizes = F.col("a.words") + F.col("b.words")
    apart = None
    for packed in ("p0", "p1"):
        for i in range(8):
            one = F.abs(_byte(f"a.{packed}", i) - _byte(f"b.{packed}", i))
            apart = one if apart is None else apart + one
    left = (
        a.join(b, [F.col(f"a.{n}") == F.col(f"b.{n}") for n in (scope, "range", "block")])
        .where(F.col("b.since") < F.col("a.until"))
        .where((p + q) * F.abs(F.col("a.words") - F.col("b.words")) <= (q - p) * sizes)
        .where((p + q) * apart <= (q - p) * sizes)
        .select(F.col(f"a.{scope}").alias(scope), F.col("a.point").alias("point"), F.col("b.point").alias("other"), F.col("b.since").alias("since"))
        .distinct()
    )
    left = shared_checkpoint(left)
    met = left.select(scope, "point").unionByName(left.select(scope, F.col("other").alias("point"))).distinct()
    words = table.join(met, [scope, "point"], "left_semi").groupBy(scope, "point").agg(F.first("hashes").alias("hashes"))
    both = left.join(words, [scope, "point"]).join(words.select(scope, F.col("point").alias("other"), F.col("hashes").alias("others")), [scope, "other"])
    shared = F.size(F.array_intersect("hashes", "others"))
    total = F.size("hashes") + F.size("others")
    matched = both.where(q * shared >= p * (total - shared)).groupBy(scope, "point").agg(F.min("since").alias("since"))
    return new.select(scope, key, order, "point").join(matched, [scope, "point"]).where(F.col("since") < F.col(order)).select(scope, key, order).distinct()


class History:
    """All accepted rows, as two stored tables that are only appended to: hashes (``exact``) and pivot distances (``near``).

    ``place`` is a folder on the shared file system; one that does not exist yet begins a history.
    """

    def __init__(self, spark: SparkSession, place: str, scope: str, key: str, order: str, threshold: tuple[int, int] = THRESHOLD, block_rows: int = BLOCK_ROWS):
        self.spark, self.place = spark, place.rstrip("/")
        self.scope, self.key, self.order = scope, key, order
        self.threshold, self.block_rows = threshold, block_rows

    def _stored(self, name: str, schema: T.StructType) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.place}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(self.scope), F.lit(PARTS).cast("long")).cast("int")

    def _write(self, rows: DataFrame, name: str) -> None:
        """Appended under the parts of their scopes; small parts share a task, a part with a third of all rows is split over several."""
        placed = rows.withColumn("part", self._part()).hint("rebalance", "part")
        placed.sortWithinPartitions("part").write.mode("append").option("compression", "zstd").partitionBy("part").parquet(f"{self.place}/{name}")

    def _parts_of(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self._part().alias("part")).distinct().collect())  # at most PARTS numbers

    def _added(self, name: str, new: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``new``, and it together with the stored rows of its scopes, once what was missing of it is stored.

        Both are read from the files there are at this point, so a later batch does not change them.
        """
        schema = T.StructType([*new.schema.fields, T.StructField("part", T.IntegerType())])
        keys = [self.scope, self.key, self.order]
        stored = self._stored(name, schema)
        if stored is None:
            self._write(new, name)
            everything = self._stored(name, schema)
            return (new.limit(0),) * 2 if everything is None else (everything.drop("part"),) * 2
        new = shared_checkpoint(new)
        held = stored.where(F.col("part").isin(*self._parts_of(new))).drop("part")
        missing = shared_checkpoint(new.join(held.select(*keys), keys, "left_anti").select(new.columns))
        self._write(missing, name)
        return new, held.select(new.columns).unionByName(missing)

    def _pivot_order(self, made: DataFrame) -> tuple[DataFrame, np.ndarray]:
        """The fixed order of the pivots, counted over ``made`` where there is none yet."""
        schema = T.StructType([T.StructField("pivot", T.IntegerType()), T.StructField("rows", T.LongType())])
        stored = self._stored("order", schema)
        if stored is None:
            made = shared_checkpoint(made)
            pivot_order(made).coalesce(1).write.mode("overwrite").parquet(f"{self.place}/order")
            stored = self._stored("order", schema)
        order = np.zeros(CLASSES, np.int64)
        for pivot, rows in stored.collect():  # at most CLASSES rows
            order[pivot] = rows
        return made, order

    def exact(self, hashes: DataFrame) -> DataFrame:
        """New rows (``scope, key, order, h``) are stored; those whose hash a row of lower order in their scope has."""
        new, everything = self._added("exact", hashes.where(F.col("h").isNotNull()).select(self.scope, self.key, self.order, "h").distinct())
        first = everything.groupBy(self.scope, "h").agg(F.min(self.order).alias("since"))
        return new.join(first, [self.scope, "h"]).where(F.col(self.order) > F.col("since")).select(self.scope, self.key).distinct()

    def near(self, rows: DataFrame, **options) -> DataFrame:
        """New rows (``scope, key, order`` and cells) are stored as distances; those that are near a row of lower order in their scope.

        Distances are worked out for the new rows only.  A row that is stored already is not stored again, but answered again.
        """
        made, order = self._pivot_order(points(rows, [self.scope, self.key, self.order], **options))
        new, everything = self._added("near", with_distances(made, order, self.threshold))
        return near_rows(everything, new, self.scope, self.key, self.order, self.threshold, self.block_rows)

    def append(self, rows: DataFrame, hashes: DataFrame, **options) -> DataFrame:
        """``scope, key, match_kind`` of the rows of one or more new files that history, or an earlier one of these files, had already."""
        exact = self.exact(hashes).withColumn("match_kind", F.lit("exact"))
        near = self.near(rows, **options).select(self.scope, self.key, F.lit("near").alias("match_kind"))
        # exact comes before near, and a row is given once
        return exact.unionByName(near).groupBy(self.scope, self.key).agg(F.min("match_kind").alias("match_kind"))


def new_files(raw_rows: DataFrame, row_hashes: DataFrame, uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two inputs of ``History.append``: rows with the offset of their file, and their hashes (case of hex aside)."""
    files = uploads.where(F.col("row_offset").isNotNull()).select("dataset_id", "upload_id", "row_offset").distinct()
    rows = raw_rows.join(files, ["dataset_id", "upload_id"]).select("dataset_id", "row_index", "row_offset", "cells")
    hashes = row_hashes.where(F.col("row_hash").isNotNull()).select("dataset_id", "row_index", F.unhex(F.lower("row_hash")).alias("h"))
    return rows, rows.select("dataset_id", "row_index", "row_offset").join(hashes, ["dataset_id", "row_index"])


def matched_rows(raw_rows: DataFrame, row_hashes: DataFrame, uploads: DataFrame, place: str | None = None, **options) -> DataFrame:
    """Rows of raw_rows that an upload of lower row_offset had already: ``dataset_id, row_index, match_kind``.

    ``place`` is the stored history these files are new to; without one a history begins in the shared folder, and all files are one
    batch that is appended to it.
    """
    spark = raw_rows.sparkSession
    history = History(spark, place or scratch(spark, "history"), "dataset_id", "row_index", "row_offset")
    return history.append(*new_files(raw_rows, row_hashes, uploads), **options)


def file_report(raw_rows: DataFrame, row_hashes: DataFrame, uploads: DataFrame, **options) -> DataFrame:
    """Per file: its rows, and how many an earlier file had, equal or slightly changed."""
    rows = raw_rows.select("dataset_id", "upload_id", "row_index").distinct()
    found = matched_rows(raw_rows, row_hashes, uploads, **options)
    return (
        rows.join(found, ["dataset_id", "row_index"], "left")
        .groupBy("dataset_id", "upload_id")
        .agg(
            F.count(F.lit(1)).alias("file_rows"),
            F.count_if(F.col("match_kind") == "exact").alias("exact_rows"),
            F.count_if(F.col("match_kind") == "near").alias("near_rows"),
        )
    )
