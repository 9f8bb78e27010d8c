"""Runs from the command line: ``python -m featurevote extract --help`` and so on.

With spark-submit, give this file as the application and the package by ``--py-files``.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from featurevote.operators.sinks import ingest_files
from featurevote.plans import infer, runs, train
from featurevote.values import FILE_GLOB, TRAIN_BATCHES


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="featurevote")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *paths: str) -> argparse.ArgumentParser:
        sub = commands.add_parser(name)
        for path in paths:
            sub.add_argument(f"--{path}", required=True)
        return sub

    ingest = command("ingest", "input", "output")
    ingest.add_argument("--glob", default=FILE_GLOB)
    ingest.add_argument("--max-files", type=int)

    extract = command("extract", "input", "output")
    extract.add_argument("--glob", default=FILE_GLOB)
    extract.add_argument("--layout", choices=("per_channel", "global"), default="per_channel")
    extract.add_argument("--batches", type=int, default=TRAIN_BATCHES)

    fit = command("train", "features", "output")
    fit.add_argument("--preset", choices=sorted(train.PRESETS), default="basic")
    fit.add_argument("--max-batch", type=int)

    vote = command("ensemble", "features", "output")
    vote.add_argument("--kind", choices=("lr", "rf"), required=True)
    vote.add_argument("--preset", choices=sorted(train.PRESETS), default="mixed_batches")
    vote.add_argument("--single-class", choices=("error", "skip", "fit"), default="error")
    vote.add_argument("--parallelism", type=int, default=1)

    predict = command("predict", "input", "output", "model")
    predict.add_argument("--kind", choices=("lr", "rf", "pipeline"), required=True)
    predict.add_argument("--glob", default=FILE_GLOB)
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName(f"featurevote {a.command}").getOrCreate()
    if a.command == "ingest":
        print(ingest_files(spark, a.input, a.output, a.glob, a.max_files))
    elif a.command == "extract":
        runs.extract(spark, a.input, a.output, a.layout, a.batches, a.glob).show(100)
    elif a.command == "train":
        metrics = runs.train_on_all(spark, a.features, a.output, a.preset, max_batch=a.max_batch)
        metrics.show()
        runs.compare_runs(metrics).show()
    elif a.command == "ensemble":
        result = runs.train_ensemble(
            spark, a.features, a.output, a.kind, a.preset,
            single_class=a.single_class, parallelism=a.parallelism,
        )
        for name in ("members", "metrics", "gain", "verdict"):
            result[name].show()
    elif a.command == "predict":
        infer.predict_files(spark, a.input, a.output, a.model, a.kind, name_glob=a.glob).show(10)


if __name__ == "__main__":
    main()
