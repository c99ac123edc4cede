"""Command line: python -m evidex score | evaluate | collect."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.dictionaries import Study, load_study
from evidex.plans.pipelines import evaluated, run_log, scored
from evidex.sources import files, providers


def _write(frames: dict[str, DataFrame], out: str) -> None:
    for name, df in frames.items():
        files.write_parquet(df, f"{out}/{name}")


def score(spark: SparkSession, a: argparse.Namespace) -> None:
    """All frames of the scoring pipeline, and its log."""
    postings = spark.read.parquet(files.require(spark, a.postings, "give a folder of postings in Parquet"))
    frames = scored(postings, load_study(a.study))
    frames["log"] = run_log(postings, frames)
    _write(frames, a.out)
    spark.read.parquet(f"{a.out}/scores").select("category", "n", "Risk", "tier", "place").orderBy("place").show(50, truncate=False)


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    """All metric frames of outputs against gold records."""
    outputs, gold, samples = (spark.read.parquet(files.require(spark, p)) for p in (a.outputs, a.gold, a.samples))
    support = files.optional(spark, a.support, spark.read.parquet) if a.support else None
    accepts = files.optional(spark, a.accepts, spark.read.parquet) if a.accepts else None
    frames = evaluated(outputs, gold, samples, load_study(a.study) if a.study else Study(), accepts=accepts, support=support)
    _write(frames, a.out)
    for name in ("levels", "accuracy", "hallucination", "consistency", "costs"):
        spark.read.parquet(f"{a.out}/{name}").show(50, truncate=False)


def collect(spark: SparkSession, a: argparse.Namespace) -> None:
    """Outputs of a provider for each sample, with tokens and seconds."""
    samples = files.only(spark.read.parquet(files.require(spark, a.samples)), "sample_id", a.subset)
    ready = providers.prompts(samples, files.read_template(spark, a.template)).withColumns({"version": F.lit(a.version), "run": F.lit(a.run)})
    settings = providers.Settings(a.model, a.temperature, a.top_p, a.seed, a.max_tokens)
    out = providers.collect_outputs(ready.repartition(a.calls), ["version", "run", "sample_id"], providers.named_provider(a.provider), settings, pause=a.pause)
    files.write_parquet(out, a.out)
    providers.call_times(spark.read.parquet(a.out), ["version", "run"]).show(truncate=False)


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="evidex")
    commands = parser.add_subparsers(required=True)
    fixed = providers.Settings()
    for run, options in (
        (score, {"postings": None, "study": None, "out": None}),
        (evaluate, {"outputs": None, "gold": None, "samples": None, "out": None, "study": "", "support": "", "accepts": ""}),
        (collect, {"samples": None, "template": None, "version": None, "provider": None, "out": None, "run": "run1", "model": "", "temperature": 0.0, "subset": "", "pause": 0.5,
                   "calls": 1, "top_p": fixed.top_p, "seed": fixed.seed, "max_tokens": fixed.max_tokens}),
    ):
        command = commands.add_parser(run.__name__, help=run.__doc__)
        for name, default in options.items():
            command.add_argument(f"--{name.replace('_', '-')}", required=default is None, default=default, type=str if default is None else type(default))
        command.set_defaults(call=run)
    a = parser.parse_args(argv)
    # The master and the rest come from whoever submits; without that Spark runs on this machine.
    a.call(SparkSession.builder.appName("evidex").getOrCreate(), a)


if __name__ == "__main__":
    main()
