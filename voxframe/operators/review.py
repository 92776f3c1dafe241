"""Review of a taxonomy: suggested changes, and changes a person approved (TX-07, TX-08)."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalized_name
from .graph import components
from .taxonomy import label_overlaps, remap


@dataclass
class Label:
    name: str
    parent_id: str | None = None
    description: str = ""
    merged: list[str] = field(default_factory=list)


class Review:
    """A taxonomy (as many labels as a person can read) under a list of edits, applied in order.

    An edit that cannot be applied raises and names itself: a change that silently does nothing is worse than one that fails.  ``gone`` says
    where every merged label went, null for a deleted one; what refers to a label that is gone means the one it went to.  Each label has
    one parent and a parent has none, so labels and parents cannot form a circle; a merge into what was merged into it is refused.
    """

    def __init__(self, labels: dict[str, Label], parents: dict[str, str]):
        self.labels = {i: Label(x.name, x.parent_id, x.description, list(x.merged)) for i, x in labels.items()}
        self.parents = dict(parents)
        self.gone: dict[str, str | None] = {}
        self.log: list[str] = []
        self.added: list[str] = []

    @classmethod
    def of(cls, taxonomy: DataFrame, parents: DataFrame) -> Review:
        """``taxonomy``: label_id, parent_id, name, description; ``parents``: parent_id, name."""
        rows = taxonomy.select("label_id", "parent_id", "name", "description").collect()
        return cls({r.label_id: Label(r.name, r.parent_id, r.description or "") for r in rows}, {r.parent_id: r.name for r in parents.select("parent_id", "name").collect()})

    def now(self, label_id: str) -> str | None:
        """The label an id stands for by now; null for a deleted one."""
        at: str | None = label_id
        while at is not None and at in self.gone:
            at = self.gone[at]
        return at

    def _label(self, edit: dict, name: str = "label_id") -> str:
        at = self.now(str(edit.get(name)))
        if at is None or at not in self.labels:
            raise ValueError(f"{edit}: no label {edit.get(name)!r}")
        return at

    def _parent(self, edit: dict) -> str | None:
        at = edit.get("parent_id")
        if at is not None and at not in self.parents:
            raise ValueError(f"{edit}: no parent {at!r}")
        return at

    def apply(self, edits: Iterable[dict]) -> Review:
        ops = {"merge": self._merge, "delete": self._delete, "rename": self._rename, "add_parent": self._add_parent, "reparent": self._reparent, "add_label": self._add_label}
        for edit in edits:
            if edit.get("op") not in ops:
                raise ValueError(f"{edit}: no such operation")
            self.log.append(f"{edit['op']}: {ops[edit['op']](edit)}")
        return self

    def _merge(self, edit: dict) -> str:
        source, target = self._label(edit, "from"), self._label(edit, "into")
        if source == target:
            raise ValueError(f"{edit}: both are {source} by now, merges must not go in a circle")
        lost = self.labels.pop(source)
        self.labels[target].merged += [source, *lost.merged]
        self.gone[source] = target
        return f"{source} ({lost.name}) into {target} ({self.labels[target].name})"

    def _delete(self, edit: dict) -> str:
        at = self._label(edit)
        self.gone[at] = None
        return f"{at} ({self.labels.pop(at).name})"

    def _rename(self, edit: dict) -> str:
        name, parent = str(edit["name"]), str(edit.get("parent_id") or edit.get("label_id"))
        if parent in self.parents:
            before, self.parents[parent] = self.parents[parent], name
            return f"{parent} {before} to {name}"
        label = self.labels[self._label(edit)]
        before, label.name = label.name, name
        label.description = str(edit.get("description") or label.description)
        return f"{before} to {name}"

    def _add_parent(self, edit: dict) -> str:
        at = str(edit["parent_id"])
        if at in self.parents or at in self.labels or at in self.gone:
            raise ValueError(f"{edit}: {at!r} exists already")
        self.parents[at] = str(edit["name"])
        return f"{at} ({edit['name']})"

    def _reparent(self, edit: dict) -> str:
        at, parent = self._label(edit), self._parent(edit)
        self.labels[at].parent_id = parent
        return f"{at} under {parent}"

    def _add_label(self, edit: dict) -> str:
        at = str(edit["label_id"])
        if at in self.labels or at in self.gone or at in self.parents:
            raise ValueError(f"{edit}: {at!r} exists already")
        self.labels[at] = Label(str(edit["name"]), self._parent(edit), str(edit.get("description", "")))
        self.added.append(at)
        return f"{at} ({edit['name']})"

    def id_map(self) -> dict[str, str | None]:
        """Every id that is gone with the label it stands for now."""
        return {i: self.now(i) for i in self.gone}

    def taxonomy(self, spark) -> DataFrame:
        rows = [(i, x.parent_id, self.parents.get(x.parent_id), x.name, x.description) for i, x in sorted(self.labels.items())]
        return spark.createDataFrame(rows, "label_id string, parent_id string, parent_name string, name string, description string")

    def assignments(self, records: DataFrame) -> DataFrame:
        """Records under the edits: ids follow the map, each once and in order, unknown ones go; a record left without any is uncategorised."""
        ids = F.coalesce(remap(F.col("label_ids"), self.id_map()), F.array().cast("array<string>"))
        kept = F.filter(ids, lambda i: i.isin(*self.labels)) if self.labels else F.array().cast("array<string>")
        return records.withColumn("label_ids", kept).withColumn("uncategorized", F.when(F.size("label_ids") == 0, F.lit(True)).otherwise(F.col("uncategorized")))


def suggested_edits(taxonomy: DataFrame, members: DataFrame, percent: int = 60, least: int = 4) -> DataFrame:
    """TX-08: ``op, label_id, into``: merges of labels of one name, or of one parent whose members overlap by ``percent`` hundredths, and deletions of
    labels without members.

    Labels that are tied, directly or not, are one group, of which the largest stays (ties by id); so the list can be applied as it is, in any order.
    ``taxonomy``: question_id, label_id, parent_id, name.
    """
    n = members.groupBy("label_id").agg(F.count_distinct("response_key").alias("n"))
    sized = taxonomy.join(n, "label_id", "left").select("question_id", "label_id", "parent_id", "name", F.coalesce("n", F.lit(0)).alias("n"))
    named = sized.where("name IS NOT NULL").withColumn("norm", normalized_name(F.col("name")))
    first = named.groupBy("question_id", "norm").agg(F.min("label_id").alias("a"))
    same_name = named.join(first, ["question_id", "norm"]).select("a", F.col("label_id").alias("b"))
    parent = lambda s: taxonomy.select(F.col("label_id").alias(f"label_{s}"), F.col("parent_id").alias(f"parent_{s}"))
    strong = label_overlaps(members, least).where(100 * F.col("shared") >= percent * F.least("n_a", "n_b"))
    alike = strong.join(parent("a"), "label_a").join(parent("b"), "label_b").where(F.col("parent_a").eqNullSafe(F.col("parent_b")))
    tied = components(same_name.union(alike.select("label_a", "label_b")))
    groups = sized.join(tied, sized.label_id == tied.c, "left").select("label_id", "n", F.coalesce("root", "label_id").alias("root"))
    keep = groups.groupBy("root").agg(F.max_by("label_id", F.struct("n", _descending("label_id"))).alias("into"))
    merged = groups.join(keep, "root").where("label_id <> into").select(F.lit("merge").alias("op"), "label_id", "into")
    empty = groups.groupBy("root").agg(F.sum("n").alias("all"), F.min("label_id").alias("any"))
    dead = groups.join(keep, "root").join(empty, "root").where("label_id = into AND `all` = 0").select(F.lit("delete").alias("op"), "label_id", F.lit(None).cast("string").alias("into"))
    return merged.unionByName(dead)


def _descending(c: str) -> Column:
    """A key that is greatest for the smallest string (label ids are ASCII)."""
    return F.translate(F.col(c), "0123456789", "9876543210")
