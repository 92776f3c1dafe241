"""API-06: ``python -m voxframe --root PLACE COMMAND``: one command per stage.

Commands that ask a model take ``--client module:name``, a ``ModelClient`` or something that makes one; none is shipped.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from pyspark.sql import functions as F

from . import registry
from .engine import Engine
from .operators import induction, review, tallies
from .operators.corpus import coded, members, taxonomy
from .operators.filters import is_uncovered
from .plans import render
from .session import local_session


def client_of(spec: str) -> object:
    """What ``module:name`` is, called if it is a class or function."""
    module, _, name = spec.partition(":")
    found = getattr(importlib.import_module(module), name)
    return found() if callable(found) and not hasattr(found, "complete") or isinstance(found, type) else found


def _texts(engine: Engine, dataset_id: int, question_id: int | None):
    c = engine.corpus(dataset_id).where(F.col("response_text").isNotNull() & ~F.coalesce("is_nonanswer", F.lit(False)))
    rows = c if question_id is None else c.where(F.col("question_id") == question_id)
    return rows.select("question_id", "response_key", F.col("response_text").alias("text"))


def _stored_taxonomy(engine: Engine, dataset_id: int):
    found = engine._read(dataset_id, "taxonomy")
    if found is None:
        raise SystemExit("no taxonomy yet: run induce first")
    return found


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="voxframe", description=__doc__)
    p.add_argument("--root", default="data")
    sub = p.add_subparsers(dest="command", required=True)
    up = sub.add_parser("upload", help="a new dataset of a file")
    up.add_argument("path")
    up.add_argument("--name", required=True)
    up.add_argument("--question", action="append", required=True)
    up.add_argument("--attribute", action="append", default=[])
    up.add_argument("--respondent")
    sub.add_parser("datasets")
    run = sub.add_parser("query", help="a registered query over a folder of tables")
    run.add_argument("name", choices=sorted(registry.queries()))
    run.add_argument("tables")
    config = sub.add_parser("config", help="show settings, or change them with NAME=VALUE")
    config.add_argument("changes", nargs="*")
    for name, text in (
        ("append", "another file of a dataset"), ("history", "its files"), ("questions", "its questions"), ("ask", "evidence for a route document"), ("induce", "a first taxonomy"), ("label", "every response"),
        ("label-incremental", "what has no record"), ("subthemes", "label members with sub-themes"), ("review", "suggest edits, or apply a list of them"), ("summarize", "counts of its categories"), ("build-lexicon", "candidate terms"),
        ("build-locations", "candidate places"), ("reset", "forget label runs"), ("delete", "for good"),
    ):
        c = sub.add_parser(name, help=text)
        c.add_argument("dataset", type=int)
        if name in ("append", "ask"):
            c.add_argument("path")
        if name == "review":
            c.add_argument("--edits")
        if name == "subthemes":
            c.add_argument("themes", help="JSON lines of label_id and sub_id")
        if name in ("induce", "label", "label-incremental", "subthemes"):
            c.add_argument("--client", required=True)
            c.add_argument("--run", default="r000001")
        if name in ("induce", "label", "build-lexicon", "build-locations"):
            c.add_argument("--question", type=int)
        if name in ("delete", "reset"):
            c.add_argument("--name", required=True)
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = local_session()
    engine = Engine(spark, args.root)
    show = lambda x: print(json.dumps(x, ensure_ascii=False, default=str))
    lines = lambda df: [print(r) for r in df.toJSON().toLocalIterator()]
    d = getattr(args, "dataset", None)
    match args.command:
        case "upload":
            show(engine.upload(args.path, args.name, args.question, args.attribute, args.respondent))
        case "datasets":
            show(engine.datasets())
        case "query":
            registry.queries()[args.name](spark, args.tables).show(50, truncate=False)
        case "config":
            changes = dict(c.split("=", 1) for c in args.changes)
            show(engine.put_config({k: int(v) if v.isdecimal() else v or None for k, v in changes.items()}) if changes else engine.config())
        case "append":
            show(engine.append(d, args.path))
        case "history":
            show(engine.history(d))
        case "questions":
            show(engine.questions(d))
        case "ask":
            route = engine.route(d, engine.files.read_json(args.path))
            blocks = engine.answer(d, route)
            counts = [(r.label_id, r.label_id, r.n) for r in blocks["selection"].collect()] if "selection" in blocks else []
            print(render.counts_block(counts, blocks["denominators"].first().asDict(), blocks["unique"].first().n_unique if "unique" in blocks else 0))
            print(render.process_note(route, blocks["unique"].first().n_unique if "unique" in blocks else 0, 0))
        case "induce":
            made, induced = induction.induce(_texts(engine, d, args.question), client_of(args.client))
            made.withColumn("run_id", F.lit(args.run)).withColumn("parent_id", F.lit(None).cast("string")).write.mode("overwrite").parquet(engine._place(d, "taxonomy"))
            lines(induced.report)
        case "label":
            records = induction.label_run(_texts(engine, d, args.question), _stored_taxonomy(engine, d).select("question_id", "label_id"), client_of(args.client))
            engine.label(d, records, args.run)
        case "label-incremental":
            prior = coded(engine.corpus(d)).select("question_id", "response_key", "label_ids", "uncategorized", "fit")
            got = induction.run_incremental(_texts(engine, d, None), _stored_taxonomy(engine, d).select("question_id", "label_id", "parent_id", "name"), prior, client_of(args.client))
            engine.label(d, got.records.where("how <> 'kept'").drop("how", "question_id"), args.run)
            show({"new": got.n_new, "pool": got.n_pool, "outcome": got.outcome})
        case "subthemes":
            c = engine.corpus(d)
            m = members(c).select("response_key", "label_id").join(c.select("response_key", F.col("response_text").alias("text")), "response_key")
            lines(induction.sub_label(m, spark.read.json(args.themes, schema="label_id string, sub_id string"), client_of(args.client)))
        case "review":
            t, c = _stored_taxonomy(engine, d), engine.corpus(d)
            if args.edits:
                parents = t.where("parent_id IS NOT NULL").select("parent_id", F.col("parent_id").alias("name")).distinct()
                done = review.Review.of(t.withColumn("description", F.lit("")), parents).apply(engine.files.read_json(args.edits))
                show(done.log)
                lines(done.taxonomy(spark))
            else:
                lines(review.suggested_edits(t, members(c)))
        case "summarize":
            c = engine.corpus(d)
            lines(tallies.category_counts(members(c), taxonomy(c)))
            lines(c.groupBy("question_id").agg(F.count_if(is_uncovered(F.col("uncategorized"), F.col("fit"))).alias("n_uncovered")))
        case "build-lexicon":
            lines(tallies.terms(_texts(engine, d, args.question), "text", []))
            lines(tallies.proper_nouns(_texts(engine, d, args.question), "text", []))
        case "build-locations":
            lines(tallies.top_spans(tallies.span_counts(engine.corpus(d))))
        case "reset":
            engine.reset(d, args.name)
        case "delete":
            engine.delete(d, args.name)


if __name__ == "__main__":
    main(sys.argv[1:])
