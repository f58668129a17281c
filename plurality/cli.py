"""Command line: list and run registered queries, evaluate a pool, make a calibration artifact.

    python -m plurality queries
    python -m plurality run relssc_winner --tables /data/sf1 --out /data/out
    python -m plurality evaluate --pool pool.jsonl --expected gold.jsonl --phase validation --out /data/report
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from plurality.operators import evaluation as E
from plurality.sources import artifacts, readers, sinks

POOL = "question_id string, pos long, answer string, confidence double, split string"
EXPECTED = "question_id string, gold string"


def whole_numbers(text: str) -> tuple[int, ...]:
    return tuple(int(x) for x in text.split(",") if x.strip())


def numbers(text: str) -> tuple[float, ...]:
    return tuple(float(x) for x in text.split(",") if x.strip())


def model_specs(values: list[str]) -> list[dict[str, str]]:
    """``NAME=PATH`` or ``NAME=PATH@BASE`` as ``name, path, base``; a bare path is named after
    its last folder. A name given twice, or an empty part, is an error."""
    out: list[dict[str, str]] = []
    for value in (v for text in values for v in text.split(",")):
        name, found, rest = value.strip().partition("=")
        path, _, base = (rest if found else name).partition("@")
        name = name if found else path.rstrip("/").rsplit("/", 1)[-1]
        if not name or not path:
            raise ValueError(f"no model in {value!r}")
        if any(x["name"] == name for x in out):
            raise ValueError(f"model {name!r} is given twice")
        out.append({"name": name, "path": path, "base": base or name})
    return out


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="plurality", description=__doc__.splitlines()[0])
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("queries", help="names of the registered queries")
    run = sub.add_parser("run", help="write a query's result as Parquet")
    run.add_argument("name")
    run.add_argument("--tables", required=True)
    run.add_argument("--out", required=True)
    ev = sub.add_parser("evaluate", help="write a report of all methods")
    ev.add_argument("--pool", required=True, nargs="+", help="JSON lines of samples, or folders of confidence files")
    ev.add_argument("--expected", required=True, help="JSON lines of questions and right answers")
    ev.add_argument("--phase", choices=E.PHASES, default="analysis")
    ev.add_argument("--artifact", help="Parquet artifact, for the test phase")
    ev.add_argument("--save-artifact", help="where a validation's parameters go")
    ev.add_argument("--model", default="model")
    ev.add_argument("--dataset", default="dataset")
    ev.add_argument("--out", required=True)
    ev.add_argument("--budgets", type=whole_numbers, default=E.Settings().budgets)
    ev.add_argument("--targets", type=whole_numbers, default=E.Settings().targets)
    ev.add_argument("--thresholds", type=numbers, default=E.Settings().thresholds)
    ev.add_argument("--cap", type=int, default=E.Settings().cap)
    return top


def evaluate(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The report that ``args`` ask for, written in three forms; also the artifact."""
    settings = E.Settings(budgets=args.budgets, thresholds=args.thresholds, cap=args.cap, targets=args.targets)
    pool = readers.json_lines(spark, artifacts.confidence_sources(spark, args.pool), POOL)
    expected = readers.json_lines(spark, args.expected, EXPECTED).select("question_id", "gold")
    artifact = spark.read.parquet(args.artifact) if args.artifact else None
    if artifact is not None and (wrong := E.scope_violations(artifact, settings, args.model, args.dataset).collect()):
        raise ValueError(f"the artifact does not fit: {sorted({r.rule for r in wrong})}")
    report = E.evaluate(pool, expected, settings, args.phase, artifact)
    sinks.write_report(report, E.COLUMNS, args.out, f"Evaluation of {args.model} on {args.dataset}: {args.phase}")
    if args.save_artifact:
        done = E.calibration_artifact(report, settings, args.model, args.dataset)
        sinks.replaced_whole(spark, args.save_artifact, lambda path: done.write.parquet(path))
    return report


def main(argv: list[str] | None = None) -> int:
    from plurality.plans import catalog

    args = parser().parse_args(argv)
    if args.command == "queries":
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    spark = SparkSession.builder.appName("plurality").getOrCreate()
    if args.command == "run":
        rows = catalog.QUERIES[args.name](spark, args.tables)
        sinks.replaced_whole(spark, args.out, lambda path: rows.write.parquet(path))
    else:
        evaluate(spark, args)
    return 0
