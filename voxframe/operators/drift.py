"""P2: schemas that drift between the files of one survey.

Every column of every file gets a profile: the kind of its values, their number, and a value sketch, which keeps the
values of the ``SKETCH`` respondents with the lowest hashes.  As the same respondents are kept everywhere, two sketches estimate
how many respondents say the same in two columns.  Columns only in the earlier file and columns only in the later one form a bipartite
graph; the sketches strike out edges that cannot hold, all others are checked exactly over all common respondents, and a maximum-weight matching (share of equal
values first, similarity of names second) gives the renames.  Matched columns are then unified into one table.

Files of one survey are few and their columns bounded, so only column-level metadata is grouped per survey; rows are joined on
(survey, file, respondent) and stay distributed.

Defined cases: rows delivered twice count once; of a respondent's several rows in a file the last value counts; cells that are
no JSON object have no columns; blank, ``n/a`` and ``-`` are no values; uploads without row_offset take no part; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import difflib
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_table, ship_package

RESPONDENT = "respondent_id"
SKETCH = 256
#: Share of respondents that must say the same in a renamed column, and the chance of meeting a sketch by which such a column is ruled out.
SAME, RULED_OUT = 0.9, 1e-9

_NUMBER = r"^[+-]?\d+([.,]\d+)?$"
_WHOLE = r"^[+-]?\d+$"
_YES, _NO = ("yes", "y", "true"), ("no", "n", "false")
#: Notations of a full day: what a value looks like, and how it is read.
_DAYS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}([ T].*)?$", r"^(\d{4}-\d{1,2}-\d{1,2}).*$", "yyyy-M-d"),
    (r"^\d{4}/\d{1,2}/\d{1,2}([ T].*)?$", r"^(\d{4}/\d{1,2}/\d{1,2}).*$", "yyyy/M/d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}( .*)?$", r"^(\d{1,2}/\d{1,2}/\d{4}).*$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}( .*)?$", r"^(\d{1,2}/\d{1,2}/\d{4}).*$", "d/M/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", r"^(.*)$", "M/d/yy"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}( .*)?$", r"^(\d{1,2}\.\d{1,2}\.\d{4}).*$", "d.M.yyyy"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", r"^(.*)$", "d-MMM-yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", r"^(.*)$", "d MMM yyyy"),
    (r"^\d{1,2} [A-Za-z]{4,9} \d{4}$", r"^(.*)$", "d MMMM yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", r"^(.*)$", "MMM d, yyyy"),
    (r"^[A-Za-z]{4,9} \d{1,2}, \d{4}$", r"^(.*)$", "MMMM d, yyyy"),
)


#: Characters of the shortest notation of a day, ``1/1/20``.
_DAY_LENGTH = 6
_DAY_LIKE = r"^\d{1,4}[-/.][\dA-Za-z]{1,9}[-/.]\d{1,4}|^\d{1,2} [A-Za-z]{3,9} \d{4}$|^[A-Za-z]{3,9} \d{1,2}, \d{4}$"


def _value(v: Column) -> Column:
    """Trimmed, blanks joined; null where a cell says nothing."""
    # most cells have nothing to join; finding that out costs less than replacing
    plain = F.trim(F.when(v.rlike(r"[\s\u00a0]{2}|[^\S ]|\u00a0"), F.regexp_replace(v, r"[\s\u00a0]+", " ")).otherwise(v))
    return F.when(~F.lower(plain).isin("", "n/a", "-"), plain)


def _days(v: Column) -> list[Column]:
    return [F.when(v.rlike(shape), F.try_to_timestamp(F.regexp_extract(v, part, 1), F.lit(fmt)).cast("date")) for shape, part, fmt in _DAYS]


def _meanings(v: Column, days: Column) -> Column:
    """All a value can be read as: text, number, yes/no, day (also as days from 1899-12-30)."""
    low = F.lower(v)
    number = F.when(_begins_a_number(v) & v.rlike(_NUMBER), F.translate(v, ",", ".").cast("double"))
    serial = F.when(_begins_a_number(v) & (F.length(v) >= 5) & v.rlike(r"^\d{5}([.,]0+)?$"), F.date_add(F.lit("1899-12-30").cast("date"), F.substring(v, 1, 5).try_cast("int")))
    answers = F.when(low.isin(*_YES, "1"), "yes").when(low.isin(*_NO, "0"), "no")
    plain = F.array_compact(F.array(F.concat(F.lit("t:"), low), F.concat(F.lit("n:"), number.cast("string")), F.concat(F.lit("b:"), answers), F.concat(F.lit("d:"), serial.cast("string"))))
    as_days = F.transform(F.coalesce(days, F.array().cast("array<date>")), lambda d: F.concat(F.lit("d:"), d.cast("string")))
    return F.when(v.isNotNull(), F.concat(plain, as_days))


def _begins_a_number(v: Column) -> Column:
    """A digit or a sign comes first: what spares texts the patterns of numbers."""
    return F.ascii(v).between(ord("0"), ord("9")) | F.ascii(v).isin(ord("+"), ord("-"))


def _kind(v: Column, days: Column) -> Column:
    return (
        F.when(v.isNull(), None)
        .when(_begins_a_number(v) & v.rlike(_WHOLE), "whole")
        .when(_begins_a_number(v) & v.rlike(_NUMBER), "decimal")
        .when(F.lower(v).isin(*_YES, *_NO), "yes/no")
        .when(F.size(days) > 0, "date")
        .otherwise("text")
    )


def _file_pairs(uploads: DataFrame, cells: DataFrame) -> DataFrame:
    """Each file with the one of the next lower row_offset of its survey."""
    files = uploads.where(F.col("row_offset").isNotNull()).select("dataset_id", "upload_id", "row_offset").distinct()
    files = files.join(cells.select("dataset_id", "upload_id").distinct(), ["dataset_id", "upload_id"], "left_semi")
    order = Window.partitionBy("dataset_id").orderBy("row_offset", "upload_id")
    return files.withColumn("earlier_id", F.lag("upload_id").over(order))


def long_cells(wave_rows: DataFrame) -> DataFrame:
    """One row per cell: dataset_id, upload_id, row_index, respondent, name, value (null where it says nothing), kind, meanings."""
    rows = wave_rows.select("dataset_id", "upload_id", "row_index", F.from_json("cells", "map<string,string>").alias("m")).where("m IS NOT NULL")
    long = rows.select("dataset_id", "upload_id", "row_index", F.col("m")[RESPONDENT].alias("respondent"), F.explode("m").alias("name", "value"))
    said = long.withColumn("value", _value(F.col("value")))
    v = F.col("value")
    # days are read only where a value looks like one, and read once
    read = said.withColumn("days", F.when((F.length(v) >= _DAY_LENGTH) & v.rlike(_DAY_LIKE), F.array_distinct(F.array_compact(F.array(*_days(v))))))
    return read.withColumn("kind", _kind(v, F.col("days"))).withColumn("meanings", _meanings(v, F.col("days")))


def profiles(cells: DataFrame, last: DataFrame) -> DataFrame:
    """Per file and column: kind (null without values), number of values, and the value sketch."""
    column = ["dataset_id", "upload_id", "name"]
    sketch = F.array_sort(F.collect_list(F.struct("h", "meanings")))
    ranked = last.withColumn("rank", F.row_number().over(Window.partitionBy(*column).orderBy("h")))
    sketches = ranked.where(F.col("rank") <= SKETCH).groupBy(*column).agg(sketch.alias("sketch"))
    kinds = cells.groupBy("dataset_id", "upload_id", "name").agg(
        F.count("value").alias("n"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("whole", "decimal", "yes/no", "date")]
    )
    full = lambda *ks: F.col("n") == sum((F.col(f"`{k}`") for k in ks[1:]), F.col(f"`{ks[0]}`"))
    kind = (
        F.when(F.col("n") == 0, None).when(full("whole"), "whole").when(full("whole", "decimal"), "decimal")
        .when(full("yes/no"), "yes/no").when(full("date"), "date").otherwise("text")
    )
    return kinds.select("dataset_id", "upload_id", "name", "n", kind.alias("kind")).join(sketches, ["dataset_id", "upload_id", "name"], "left")


def _last_values(cells: DataFrame) -> DataFrame:
    """The last value of each respondent in each column of a file, with all its meanings."""
    said = cells.where("value IS NOT NULL AND respondent IS NOT NULL").where(F.col("name") != RESPONDENT)
    last = said.groupBy("dataset_id", "upload_id", "name", "respondent").agg(F.max_by("meanings", F.struct("row_index", "value")).alias("meanings"))
    return last.withColumn("h", F.xxhash64("respondent"))


def name_similarity(a: str, b: str) -> float:
    """0 to 1, blind to case and separators."""
    plain = lambda s: "".join(c for c in s.lower() if c.isalnum())
    return difflib.SequenceMatcher(None, plain(a), plain(b)).ratio()


def best_matching(weights: dict[tuple[str, str], float]) -> set[tuple[str, str]]:
    """Maximum-weight matching of a bipartite graph by shortest augmenting paths (positive weights)."""
    left, right = sorted({a for a, _ in weights}), sorted({b for _, b in weights})
    if not left:
        return set()
    n = max(len(left), len(right))
    cost = [[-weights.get((left[i], right[j]), 0.0) if i < len(left) and j < len(right) else 0.0 for j in range(n)] for i in range(n)]
    u, v, match = [0.0] * (n + 1), [0.0] * (n + 1), [n] * (n + 1)
    for i in range(n):
        match[n] = i
        least, back, seen, j = [float("inf")] * n, [n] * n, [False] * (n + 1), n
        while True:
            seen[j] = True
            row, delta, at = match[j], float("inf"), -1
            for k in range(n):
                if not seen[k]:
                    slack = cost[row][k] - u[row] - v[k]
                    if slack < least[k]:
                        least[k], back[k] = slack, j
                    if least[k] < delta:
                        delta, at = least[k], k
            for k in range(n + 1):
                if seen[k]:
                    u[match[k]] += delta
                    v[k] -= delta
                elif k < n:
                    least[k] -= delta
            j = at
            if match[j] == n:
                break
        while j != n:
            match[j], j = match[back[j]], back[j]
    return {(left[match[j]], right[j]) for j in range(len(right)) if match[j] < len(left) and (left[match[j]], right[j]) in weights}


def _match_file(edges: pd.DataFrame) -> pd.DataFrame:
    weights = {(a, b): s + name_similarity(a, b) / 1000 for a, b, s in zip(edges["stored_name"], edges["file_name"], edges["share"])}
    kept = best_matching(weights)
    return pd.DataFrame(
        [(edges["dataset_id"].iloc[0], edges["upload_id"].iloc[0], a, b) for a, b in sorted(kept)], columns=["dataset_id", "upload_id", "stored_name", "file_name"]
    )


def possible(same: int, common: int) -> bool:
    """Whether ``same`` of ``common`` sampled respondents leave room for a share of ``SAME`` among all: a binomial tail, so that few rule out nothing."""
    return sum(math.comb(common, k) * SAME**k * (1 - SAME) ** (common - k) for k in range(same + 1)) >= RULED_OUT


def _estimates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        keep = []
        for x, y in zip(b["sketch_a"], b["sketch_b"]):
            said = {s["h"]: set(s["meanings"]) for s in (x if x is not None else ())}
            common = [(said[s["h"]], s["meanings"]) for s in (y if y is not None else ()) if s["h"] in said]
            keep.append(possible(sum(not p.isdisjoint(q) for p, q in common), len(common)))
        yield b.loc[keep, ["dataset_id", "upload_id", "earlier_id", "stored_name", "file_name"]]


class Drift:
    """Changes between successive files, and the table that unifies them."""

    def __init__(self, wave_rows: DataFrame, uploads: DataFrame, fingerprints: DataFrame | None = None):
        ship_package(wave_rows.sparkSession)
        delivered = wave_rows.select("dataset_id", "upload_id", "row_index", "cells").distinct()
        self.rows = delivered.select("dataset_id", "upload_id", "row_index", F.from_json("cells", "map<string,string>")[RESPONDENT].alias("respondent")).distinct()
        self.cells = shared_table(long_cells(delivered))
        self.files = shared_table(_file_pairs(uploads, wave_rows))
        self.last = shared_table(_last_values(self.cells))
        columns = profiles(self.cells, self.last)
        if fingerprints is not None:  # a file may leave out the cells of a blank column altogether
            listed = fingerprints.select("dataset_id", "upload_id", F.col("column_name").alias("name")).distinct()
            columns = columns.join(listed, ["dataset_id", "upload_id", "name"], "full")
        self.columns = shared_table(columns.where(F.col("name") != RESPONDENT))
        self._renames: DataFrame | None = None
        self._compared: DataFrame | None = None

    def compared(self) -> DataFrame:
        """Columns of each file beside those of the file before, by exact name."""
        if self._compared is not None:
            return self._compared
        pairs = self.files.where("earlier_id IS NOT NULL")
        later = self.columns.join(pairs.select("dataset_id", "upload_id", "earlier_id"), ["dataset_id", "upload_id"]).select(
            "dataset_id", "upload_id", "earlier_id", "name", F.struct("kind", "sketch").alias("later")
        )
        earlier = self.columns.withColumnRenamed("upload_id", "earlier_id").join(
            pairs.select("dataset_id", "upload_id", "earlier_id"), ["dataset_id", "earlier_id"]
        ).select("dataset_id", "upload_id", "earlier_id", "name", F.struct("kind", "sketch").alias("earlier"))
        self._compared = shared_table(earlier.join(later, ["dataset_id", "upload_id", "earlier_id", "name"], "full"))
        return self._compared

    def renames(self) -> DataFrame:
        """``dataset_id, upload_id, stored_name, file_name`` of every renamed column."""
        if self._renames is not None:
            return self._renames
        both = self.compared()
        file = ["dataset_id", "upload_id", "earlier_id"]
        gone = both.where("later IS NULL").select(*file, F.col("name").alias("stored_name"), F.col("earlier.sketch").alias("sketch_a"))
        new = both.where("earlier IS NULL").select(*file, F.col("name").alias("file_name"), F.col("later.sketch").alias("sketch_b"))
        edges = gone.join(new, file).where("sketch_a IS NOT NULL AND sketch_b IS NOT NULL")
        edges = shared_table(edges.mapInPandas(_estimates, "dataset_id bigint, upload_id bigint, earlier_id bigint, stored_name string, file_name string"))
        # only values of columns that may have been renamed are compared; the edges are few, and Spark sends them to the values where their size allows
        a = self.last.select("dataset_id", F.col("upload_id").alias("earlier_id"), F.col("name").alias("stored_name"), "respondent", F.col("meanings").alias("was"))
        b = self.last.select("dataset_id", "upload_id", F.col("name").alias("file_name"), "respondent", F.col("meanings").alias("now"))
        b = b.join(edges.select("dataset_id", "upload_id", "file_name").distinct(), ["dataset_id", "upload_id", "file_name"], "left_semi")
        checked = (
            edges.join(a, ["dataset_id", "earlier_id", "stored_name"])
            .join(b, ["dataset_id", "upload_id", "file_name", "respondent"])
            .groupBy("dataset_id", "upload_id", "stored_name", "file_name")
            .agg(F.count_if(F.arrays_overlap("was", "now")).alias("same"), F.count(F.lit(1)).alias("common"))
            .where(F.col("same") >= SAME * F.col("common"))
            .select("dataset_id", "upload_id", "stored_name", "file_name", (F.col("same") / F.col("common")).alias("share"))
        )
        matched = checked.groupBy("dataset_id", "upload_id").applyInPandas(_match_file, "dataset_id bigint, upload_id bigint, stored_name string, file_name string")
        self._renames = shared_table(matched)
        return self._renames

    def changes(self) -> DataFrame:
        """Every change of a file against the file before: ``dataset_id, upload_id, change_kind, stored_name, file_name``."""
        file = ["dataset_id", "upload_id"]
        renamed = self.renames()
        both = self.compared()
        kinds = both.select(*file, "name", F.col("earlier.kind").alias("was"), F.col("later.kind").alias("now"), F.col("earlier").isNotNull().alias("old"), F.col("later").isNotNull().alias("new"))
        gone = kinds.where("old AND NOT new").withColumnRenamed("name", "stored_name")
        came = kinds.where("new AND NOT old").withColumnRenamed("name", "file_name")
        removed = gone.join(renamed, [*file, "stored_name"], "left_anti")
        added = came.join(renamed, [*file, "file_name"], "left_anti")
        moved = renamed.join(gone.select(*file, "stored_name", "was"), [*file, "stored_name"]).join(came.select(*file, "file_name", "now"), [*file, "file_name"])
        stayed = kinds.where("old AND new").select(*file, F.col("name").alias("stored_name"), F.col("name").alias("file_name"), "was", "now")
        retyped = moved.select(*stayed.columns).unionByName(stayed).where("was <> now")
        row = lambda df, kind, a, b: df.select(*file, F.lit(kind).alias("change_kind"), a.alias("stored_name"), b.alias("file_name"))
        s, f, none = F.col("stored_name"), F.col("file_name"), F.lit("")
        return (
            row(renamed, "renamed", s, f)
            .unionByName(row(removed, "removed", s, none))
            .unionByName(row(added, "added", none, f))
            .unionByName(row(retyped, "retyped", s, f))
        )

    def unified_names(self) -> DataFrame:
        """The name under which each column of each file goes in the unified table: the first name of its chain of renames.

        A column that comes back under a name another chain has taken keeps its own name with its file's number.
        """
        columns = self.columns.join(self.files, ["dataset_id", "upload_id"]).select("dataset_id", "upload_id", "row_offset", "name", "kind")
        renamed = self.renames().select("dataset_id", "upload_id", F.col("file_name").alias("name"), "stored_name")
        listed = columns.join(renamed, ["dataset_id", "upload_id", "name"], "left")

        def chain(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["row_offset", "upload_id", "name"])
            before: dict[str, str] = {}
            origin: list[str] = []
            for _, one in pdf.groupby(["row_offset", "upload_id"], sort=True):
                now: dict[str, str] = {}
                for r in one.itertuples():
                    source = r.stored_name if isinstance(r.stored_name, str) else r.name
                    now[r.name] = before.get(source, r.name)
                taken: set[str] = set()
                for name in one["name"]:
                    if now[name] in taken:
                        now[name] = f"{name} ({one['upload_id'].iloc[0]})"
                    taken.add(now[name])
                    origin.append(now[name])
                before = before | now
            kinds = pdf.assign(unified_name=origin).groupby("unified_name")["kind"].agg(lambda k: set(k.dropna()))
            pdf = pdf.assign(unified_name=origin)
            pdf["as_day"] = [bool(kinds[u] - {"text"} <= {"date", "whole"} and "date" in kinds[u]) for u in pdf["unified_name"]]
            return pdf[["dataset_id", "upload_id", "name", "unified_name", "as_day"]]

        return listed.groupBy("dataset_id").applyInPandas(chain, "dataset_id bigint, upload_id bigint, name string, unified_name string, as_day boolean")

    def unified(self) -> DataFrame:
        """One table of all rows: ``dataset_id, upload_id, row_index, respondent_id, cells``, cells as JSON under unified names.

        Numbers have a decimal point, days are ISO days (also where a file gave day numbers), yes/no is spelled out, and cells that say
        nothing are left out.
        """
        named = self.cells.where(F.col("value").isNotNull() & (F.col("name") != RESPONDENT)).join(self.unified_names(), ["dataset_id", "upload_id", "name"])
        v = F.col("value")
        serial = F.when(F.col("as_day") & v.rlike(r"^\d{5}$"), F.date_add(F.lit("1899-12-30").cast("date"), v.try_cast("int")))
        plain = F.coalesce(
            F.coalesce(F.get(F.col("days"), F.lit(0)), serial).cast("string"),
            F.when(v.rlike(_NUMBER), F.regexp_replace(v, ",", ".")),
            F.when(F.lower(v).isin(*_YES), "yes").when(F.lower(v).isin(*_NO), "no"),
            v,
        )
        filled = named.groupBy("dataset_id", "upload_id", "row_index", "respondent").agg(
            F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("unified_name"), plain.alias("value")))))).alias("cells")
        )
        return self.rows.join(filled.drop("respondent"), ["dataset_id", "upload_id", "row_index"], "left").select(
            "dataset_id", "upload_id", "row_index", F.col("respondent").alias("respondent_id"), F.coalesce("cells", F.lit("{}")).alias("cells")
        )
