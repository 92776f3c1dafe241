"""The engine: datasets under one root, files appended to them, questions asked of them (API-01 .. API-04, API-07 .. API-09, ST-05)."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.hashing import array_hash, canonical_key
from .functions.text import is_nonanswer, normalized_question
from .functions.encoding import with_repair
from .models import stages
from .operators import matching, reshape, tallies
from .operators.corpus import members, questions as question_list, response_key, with_labels
from .operators.estimate import newest_runs, pooled_rates
from .plans import compile as compiler
from .plans import route as routes
from .session import shared_table
from .sources import readers, sinks
from .sources.files import Files


#: Answers a model has to be asked for again after so many seconds (ST-05).
MEMO_SECONDS = 120
#: What a configuration may set, with its type and the least value of a number (API-04).
SETTINGS = {"label_model": str, "answer_model": str, "batch": int, "chunk": int, "workers": int, "per_label": int, "total_quotes": int, "seed": int}


class Busy(RuntimeError):
    """A dataset has a job running already."""


class Memo:
    """ST-05: values by key for a while; a key holds what a value depends on, so a change of that is another key."""

    def __init__(self, seconds: float = MEMO_SECONDS, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.clock, self._held = seconds, clock, {}

    def get(self, key: object, make: Callable[[], object]) -> object:
        at = self.clock()
        self._held = {k: v for k, v in self._held.items() if at - v[0] < self.seconds}
        if key not in self._held:
            self._held[key] = (at, make())
        return self._held[key][1]

    def forget(self) -> None:
        self._held.clear()


class Engine:
    """Everything about one root, on any file system Spark can reach; nothing is kept in memory that is not stored, but for a memo with a lifetime.

    ``roots`` are further places that hold something of each dataset (runs, answers of another tool); deleting a dataset clears them as well.
    """

    def __init__(self, spark: SparkSession, root: str, roots: tuple[str, ...] = ()):
        self.spark, self.root, self.roots = spark, root.rstrip("/"), (root.rstrip("/"), *(r.rstrip("/") for r in roots))
        self.files, self.memo = Files(spark), Memo()
        self._jobs: dict[int, stages.Job] = {}
        self._lock = threading.Lock()

    def _place(self, dataset_id: int, name: str = "", root: str | None = None) -> str:
        return f"{root or self.root}/{dataset_id}" + (f"/{name}" if name else "")

    def _meta(self, dataset_id: int) -> dict:
        path = self._place(dataset_id, "dataset.json")
        if not self.files.exists(path):
            raise KeyError(f"no dataset {dataset_id}")
        return self.files.read_json(path)

    def datasets(self) -> list[dict]:
        found = [self._place(int(n), "dataset.json") for n in self.files.folders(self.root) if n.isdigit()]
        return sorted((self.files.read_json(p) for p in found if self.files.exists(p)), key=lambda d: d["dataset_id"])

    def hashed(self, wide: DataFrame) -> DataFrame:
        """Rows of a wide file in file order with their index and hash.

        The rows are written once with their place in their partition, and numbered from there: a row's index is its place plus the rows of the
        partitions before, a prefix sum over one count per partition that is joined, not collected.
        """
        cells = F.array(*[F.col(f"`{c}`") for c in wide.columns])
        placed = shared_table(wide.withColumn("row_hash", array_hash(cells)).withColumn("_at", F.monotonically_increasing_id()))
        split = placed.withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
        counts = split.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row per partition
        return split.join(before, "_part").withColumn("row_index", (F.col("_at") + F.col("_before")).cast("long")).drop("_at", "_part", "_before")

    def upload(self, path: str, name: str, questions: list[str], metadata: list[str] = (), respondent: str | None = None) -> dict:
        """A new dataset of a first file; columns are checked before anything is written."""
        wide = readers.read_wide(self.spark, path)
        there = [c for c in questions if c in wide.columns]
        filled = wide.agg(F.count(F.lit(1)).alias("\x00"), *[F.count_if(F.trim(f"`{c}`") != "").alias(c) for c in there]).first().asDict()
        reshape.check_selection(wide.columns, list(questions), list(metadata), filled)
        dataset_id = max([d["dataset_id"] for d in self.datasets()], default=0) + 1
        meta = {"dataset_id": dataset_id, "name": name, "questions": list(questions), "metadata": list(metadata), "respondent": respondent, "uploads": []}
        self.files.write_json(meta, self._place(dataset_id, "dataset.json"))
        return self.append(dataset_id, path)

    def append(self, dataset_id: int, path: str) -> dict:
        """Another file: rows the dataset holds already (as a multiset) are flagged and add nothing."""
        meta = self._meta(dataset_id)
        rows = self.hashed(readers.read_wide(self.spark, path)).withColumn("dataset_id", F.lit(dataset_id).cast("long"))
        offset = sum(u["row_count"] for u in meta["uploads"])
        upload_id = len(meta["uploads"]) + 1
        held = self._read(dataset_id, "row_hashes")
        stored = held.where("NOT is_duplicate") if held is not None else self.spark.createDataFrame([], "dataset_id long, row_hash string")
        flagged = matching.flag_duplicates(rows.select("dataset_id", "row_index", "row_hash"), stored, ["dataset_id"])
        flagged.withColumn("upload_id", F.lit(upload_id)).write.mode("overwrite").parquet((self._place(dataset_id, f"row_hashes/upload={upload_id}")))
        flags = self.spark.read.parquet((self._place(dataset_id, f"row_hashes/upload={upload_id}")))
        fresh = rows.join(flags.where("NOT is_duplicate").select("row_index"), "row_index", "left_semi").withColumn("source_row_index", F.col("row_index") + offset)
        who = F.col(f"`{meta['respondent']}`") if meta["respondent"] in rows.columns else F.lit(None).cast("string")
        there = [q for q in meta["questions"] if q in rows.columns]
        long = reshape.unpivot_answers(fresh.withColumn("respondent_id", who), ["dataset_id", "source_row_index", "respondent_id"], there)
        number = F.create_map(*[F.lit(x) for i, q in enumerate(meta["questions"], 1) for x in (q, i)])
        texts = with_repair(long.withColumnRenamed("raw_text", "response_text").withColumn("raw_text_original", F.col("response_text")), "response_text")
        answers = texts.select(
            "dataset_id", number[F.col("source_column")].cast("long").alias("question_id"), F.col("source_column").alias("question_label"), "source_column", "source_row_index",
            response_key(F.col("dataset_id"), number[F.col("source_column")], F.col("source_row_index")).alias("response_key"), F.concat_ws(":", "dataset_id", "source_row_index").alias("respondent_key"),
            "respondent_id", F.trim("response_text").alias("response_text"), "raw_text_original", F.col("was_repaired").alias("was_encoding_repaired"), is_nonanswer(F.col("response_text")).alias("is_nonanswer"),
        )
        sinks.write_export(answers, (self._place(dataset_id, f"responses/upload={upload_id}")))
        attributes = reshape.unpivot_attributes(fresh.withColumn("respondent_key", F.concat_ws(":", "dataset_id", "source_row_index")), ["respondent_key", "source_row_index"], meta["metadata"]) if any(m in fresh.columns for m in meta["metadata"]) else None
        if attributes is not None:
            attributes.write.mode("overwrite").parquet((self._place(dataset_id, f"respondents/upload={upload_id}")))
        total, duplicate = (flags.agg(F.count(F.lit(1)), F.count_if("is_duplicate")).first())
        meta["uploads"].append({"upload_id": upload_id, "file": path.rstrip("/").rsplit("/", 1)[-1], "row_offset": offset, "row_count": total, "new_row_count": total - duplicate, "duplicate_row_count": duplicate})
        self.files.write_json(meta, self._place(dataset_id, "dataset.json"))
        return meta

    def _read(self, dataset_id: int, name: str) -> DataFrame | None:
        path = self._place(dataset_id, name)
        return self.spark.read.parquet(path).drop("upload") if self.files.exists(path) else None

    def corpus(self, dataset_id: int) -> DataFrame:
        """Responses with the records of the latest label run, null where none covered a row."""
        self._meta(dataset_id)
        base = self._read(dataset_id, "responses")
        labels = self._read(dataset_id, "labels")
        return base if labels is None else sinks.export_frame(with_labels(base, labels))

    def questions(self, dataset_id: int) -> list[dict]:
        """API-02: the questions of a dataset with their wording and number of responses."""
        return [r.asDict() for r in question_list(self.corpus(dataset_id)).orderBy("question_id").collect()]

    def label(self, dataset_id: int, records: DataFrame, run_id: str) -> None:
        """A label run, beside earlier ones."""
        records.withColumn("run_id", F.lit(run_id)).write.mode("append").parquet((self._place(dataset_id, "labels")))

    def reset(self, dataset_id: int, confirm_name: str) -> None:
        """API-06: the label runs of a dataset are forgotten, its responses stay; only with the dataset's own name."""
        if confirm_name != self._meta(dataset_id)["name"]:
            raise ValueError("the name does not match: nothing reset")
        self.files.delete(self._place(dataset_id, "labels"))
        self.memo.forget()

    def history(self, dataset_id: int) -> list[dict]:
        return [u | {"kind": "created" if i == 0 else "appended"} for i, u in enumerate(sorted(self._meta(dataset_id)["uploads"], key=lambda u: u["row_offset"]))]

    def attributes(self, dataset_id: int) -> DataFrame | None:
        found = self._read(dataset_id, "respondents")
        return None if found is None else tallies.attribute_counts(found)

    def route(self, dataset_id: int, document: dict) -> routes.Route:
        """A model's or analyst's document, checked against what the dataset has."""
        c = self.corpus(dataset_id)
        labels = {r[0] for r in members(c).select("label_id").distinct().collect()}  # as many as the taxonomy has
        has = c.agg(F.count("actionability").alias("actionability"), F.count_if("event_occurred").alias("event"), F.count_if(F.size("time_context") > 0).alias("time")).first().asDict()
        return routes.parse(document, labels, available={k for k, n in has.items() if n})

    def answer(self, dataset_id: int, route: routes.Route, **options: object) -> dict[str, DataFrame]:
        return compiler.evidence(route, self.corpus(dataset_id), **options)

    def state_key(self, dataset_id: int) -> str:
        """What is stored of a dataset, by its files' newest change: another key after every upload or run (API-07, ST-05)."""
        return canonical_key([dataset_id, self._meta(dataset_id)["uploads"], self.files.modified(self._place(dataset_id, "labels"))])

    def cache_key(self, dataset_id: int, question: str, scope: list[int] | None = None) -> str:
        """API-07: changes with the data, the scope and the sense of the question, not with its spelling."""
        return canonical_key({"state": self.state_key(dataset_id), "question": normalized_question(question), "scope": sorted(scope or [])})

    def context(self, dataset_id: int) -> dict:
        """ST-05: counts of a dataset, kept for a while and made anew when anything of it changes."""
        return self.memo.get(self.state_key(dataset_id), lambda: tallies.run_report(sinks.export_frame(self.corpus(dataset_id))).first().asDict())

    def cached_answer(self, dataset_id: int, key: str, make: Callable[[], dict]) -> tuple[dict, bool]:
        """API-07: an answer as it was stored under its key, or made and stored; and whether it was there."""
        path = self._place(dataset_id, f"answers/{key}.json")
        if self.files.exists(path):
            return self.files.read_json(path), True
        made = make()
        self.files.write_json(made, path)
        return made, False

    def config(self) -> dict:
        """API-04: the settings that differ from the defaults."""
        path = f"{self.root}/config.json"
        return self.files.read_json(path) if self.files.exists(path) else {}

    def put_config(self, patch: dict) -> dict:
        """API-04: settings changed, or taken back with null; an unknown one and a wrong value are refused as a whole."""
        for name, value in patch.items():
            kind = SETTINGS.get(name)
            if kind is None:
                raise ValueError(f"no setting {name}: expected one of {', '.join(SETTINGS)}")
            if value is not None and (not isinstance(value, kind) or isinstance(value, bool) or (kind is int and value < 1) or (kind is str and not value.strip())):
                raise ValueError(f"{name}: {value!r} is no {'positive whole number' if kind is int else 'name'}")
        merged = {k: v for k, v in (self.config() | patch).items() if v is not None or k not in patch}
        self.files.write_json(merged, f"{self.root}/config.json")
        return merged

    def recalibrate(self, runs: DataFrame) -> dict:
        """API-04, AG-26: rates measured by the newest qualifying runs (question_id, run_id, amount, base), stored beside the settings; none: nothing changes."""
        newest = newest_runs(runs, ["question_id"])
        rows = pooled_rates(newest.withColumn("kind", F.lit("tokens")), "amount", "base", ["kind"]).collect()
        if rows:
            self.files.write_json({"amount": rows[0].amount, "base": rows[0].base, "n_runs": rows[0].n_runs}, f"{self.root}/calibration.json")
        path = f"{self.root}/calibration.json"
        return self.files.read_json(path) if self.files.exists(path) else {}

    def run_job(self, dataset_id: int, work: list[stages.Stage], wait: bool = True) -> stages.Job:
        """API-03, API-09: stages one after the other; a dataset has one job at a time.  Without ``wait`` it goes on beside the caller."""
        with self._lock:
            if (running := self._jobs.get(dataset_id)) is not None and running.is_active:
                raise Busy(f"dataset {dataset_id} has a job running")
            job = self._jobs[dataset_id] = stages.Job(work)
            job.is_active = True
        if wait:
            return job.start()
        threading.Thread(target=job.start, daemon=True).start()
        return job

    def job(self, dataset_id: int) -> stages.Job | None:
        return self._jobs.get(dataset_id)

    def deletion_preview(self, dataset_id: int) -> dict[str, dict]:
        """AG-30: per root the files, bytes, runs and recorded spend that would go."""
        out = {}
        for root in self.roots:
            files = self.files.walk(self._place(dataset_id, root=root))
            runs = {p.split("run_id=")[1].split("/")[0] for p, _ in files if "run_id=" in p} | {p.rsplit("/runs/", 1)[1].split("/")[0] for p, _ in files if "/runs/" in p}
            spent = [self.files.read_json(p).get("micro_usd") for p, _ in files if p.endswith("/manifest.json")]
            known = [s for s in spent if s is not None]
            out[root] = {"files": len(files), "bytes": sum(n for _, n in files), "runs": len(runs), "micro_usd": sum(known) if known else None}
        return out

    def delete(self, dataset_id: int, confirm_name: str) -> None:
        """API-01, API-08: for good, under every root, only with the dataset's own name and while no job is running."""
        if confirm_name != self._meta(dataset_id)["name"]:
            raise ValueError("the name does not match: nothing deleted")
        if (running := self._jobs.get(dataset_id)) is not None and running.is_active:
            raise Busy(f"dataset {dataset_id} has a job running: nothing deleted")
        for root in self.roots[1:] + self.roots[:1]:
            self.files.delete(self._place(dataset_id, root=root))
        self.memo.forget()
