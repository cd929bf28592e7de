"""Commands over tables. Exit codes are part of the result: 1 where a budget is exceeded, or nothing is found."""

from __future__ import annotations

import argparse
import json
import os
import platform
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import audit, datagen, inference, report, tasks
from .sources import checkpoints, reports


def hardware() -> dict:
    """The driver's machine."""
    return {"os": f"{platform.system()} {platform.release()}", "machine": platform.machine(), "python": platform.python_version(), "cpu_cores_logical": os.cpu_count(), "accelerator": {"type": "cpu", "name": platform.processor() or "unknown"}}


def saver(spark: SparkSession, folder: str):
    """Writes frames to numbered tables below ``folder`` and reads them back."""
    made = []

    def save(df: DataFrame) -> DataFrame:
        path = f"{folder.rstrip('/')}/step-{len(made)}"
        made.append(path)
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return save


def budget(spark: SparkSession, args: argparse.Namespace) -> int:
    rows = audit.audit(audit.tensors(checkpoints.local_headers(spark, args.root)))
    total = audit.audit_pipeline(rows).head()
    print(json.dumps(total.asDict(), default=str))
    return 0 if total["within_budget"] else 1


def gen_data(spark: SparkSession, args: argparse.Namespace) -> int:
    """Screens as JSON, and a picture of each."""
    built = datagen.screens(spark, args.n)
    report.write_json(built, f"{args.out}/ground_truth")
    pictures = reports.files_of(report.drawn_screens(built), F.format_string("screen_%03d", "id"), {".png": F.col("content")})
    reports.write_files(pictures, f"{args.out}/screens", overwrite=True)
    return 0


def find(spark: SparkSession, args: argparse.Namespace) -> int:
    """Requests and recorded answers are Parquet tables; the result is written as JSON. 1 where nothing is found."""
    recorded, save = inference.replay_backend(spark.read.parquet(args.answers)), saver(spark, f"{args.out}/steps")
    requests = spark.read.parquet(args.requests)
    if args.all:
        report.write_json(tasks.find_all(requests, recorded, save), f"{args.out}/hits")
        return 0 if spark.read.text(f"{args.out}/hits").head(1) else 1
    report.write_json(tasks.find(requests, recorded, save, fallback_tiles=not args.no_tiles), f"{args.out}/hits")
    return 0 if spark.read.json(f"{args.out}/hits").where("found").head(1) else 1


def staged(task: str):
    """A task of several calls, over requests and recorded answers; its rows are written as JSON."""

    def run(spark: SparkSession, args: argparse.Namespace) -> int:
        recorded = inference.replay_backend(spark.read.parquet(args.answers))
        out = getattr(tasks, task)(spark.read.parquet(args.requests), recorded, saver(spark, f"{args.out}/steps"))
        report.write_json(out, f"{args.out}/{task}")
        return 0

    return run


def bench(spark: SparkSession, args: argparse.Namespace) -> int:
    """Trials of every variant over targets, their summaries, and the three tables of them."""
    recorded, save = inference.replay_backend(spark.read.parquet(args.answers)), saver(spark, f"{args.out}/steps")
    trials = save(tasks.bench(spark.read.parquet(args.requests), recorded, save))
    payload = save(tasks.bench_payload(trials))
    report.write_json(payload, f"{args.out}/bench")
    for name, rows in report.bench_tables(payload).items():
        rows.write.mode("overwrite").option("header", True).csv(f"{args.out}/{name}")
    return 0


def simple(task: str):
    def run(spark: SparkSession, args: argparse.Namespace) -> int:
        recorded = inference.replay_backend(spark.read.parquet(args.answers))
        report.write_json(getattr(tasks, task)(spark.read.parquet(args.requests), recorded), f"{args.out}/{task}")
        return 0

    return run


def hardware_report(spark: SparkSession, args: argparse.Namespace) -> int:
    print(json.dumps(hardware()))
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lumenbox")
    verbs = top.add_subparsers(required=True)

    def verb(name: str, run, *options: str) -> argparse.ArgumentParser:
        p = verbs.add_parser(name)
        for o in options:
            p.add_argument(f"--{o}", required=True)
        p.set_defaults(run=run)
        return p

    verb("hardware", hardware_report)
    verb("budget", budget, "root")
    verb("gen-data", gen_data, "out").add_argument("--n", type=int, default=24)
    verb("find", find, "requests", "answers", "out").add_argument("--no-tiles", action="store_true")
    verbs.choices["find"].add_argument("--all", action="store_true")
    for task in ("ocr", "guide", "diff", "redact"):
        verb(task, staged(task), "requests", "answers", "out")
    verb("bench", bench, "requests", "answers", "out")
    for task in ("describe", "ask"):
        verb(task, simple(task), "requests", "answers", "out")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(spark or SparkSession.builder.getOrCreate(), args)


if __name__ == "__main__":
    sys.exit(main())
