"""Command line: ``python -m veilgrain generate ...`` and ``python -m veilgrain evaluate ...``.

Runs in the session that spark-submit has configured, or on a local master.
"""

from __future__ import annotations

import argparse
import json
import math
import sys
from dataclasses import fields
from functools import partial

from pyspark.sql import SparkSession

from veilgrain.operators import evaluation, experiment, reports
from veilgrain.operators.generation import MarkovModel, PrivateTextEngine, Settings
from veilgrain.sources.catalog import FileAdapter, choices
from veilgrain.workspace import ensure_importable

#: Settings that are options of a run; the budget of private tokens comes from epsilon.
_OPTIONS = [f for f in fields(Settings) if f.name not in ("max_private_tokens", "eos", "seed")]


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="veilgrain")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("generate", "evaluate"):
        one = commands.add_parser(name)
        one.add_argument("--dataset", choices=choices(), required=True)
        one.add_argument("--data", required=True, help="folder with a folder for each split")
        one.add_argument("--format", default="parquet", choices=("parquet", "json", "csv"))
        one.add_argument("--num-examples", type=int, help="draw so many training rows; all by default")
        one.add_argument("--out", required=name == "generate", help="folder of the run, or of the evaluation's result")
    run = commands.choices["generate"]
    run.add_argument("--public", required=True, help="folder of public texts (a column text), the only source of the public model")
    run.add_argument("--epsilon", type=float, required=True)
    run.add_argument("--delta", type=float, help="1 / rows by default")
    run.add_argument("--seed", type=int, help="for tests only: without it all noise is drawn from the operating system")
    run.add_argument("--vocabulary", type=int, default=64)
    run.add_argument("--waves", type=int, default=1, help="commits that the run is cut into")
    run.add_argument("--resume", action="store_true")
    run.add_argument("--no-svt", action="store_true", help="pay for every token")
    for f in _OPTIONS:
        run.add_argument(f"--{f.name.replace('_', '-')}", type=int if isinstance(f.default, int) else float, default=f.default)
    judge = commands.choices["evaluate"]
    judge.add_argument("--synthetic", help="a run's log; without it the real training split is the baseline")
    judge.add_argument("--classifier", default="linear", choices=("linear", "neural"))
    return parser


def generate(spark: SparkSession, args: argparse.Namespace) -> dict:
    options = {f.name: getattr(args, f.name) for f in _OPTIONS} | {"seed": args.seed}
    settings = Settings(**options | ({"svt_threshold": -math.inf} if args.no_svt else {}))
    engine = PrivateTextEngine(args.dataset, settings, partial(MarkovModel.learn, vocab_size=args.vocabulary))
    examples = FileAdapter(args.dataset, args.data, args.format).load(spark, "train", args.num_examples)
    done = experiment.run(engine, examples, spark.read.parquet(args.public), args.out, args.epsilon, args.delta, args.resume, args.waves)
    return {"report": done.report, "stats": done.stats, "realized_epsilon": done.realized_epsilon, "new_batches": done.new_batches, "seconds": done.seconds}


def evaluate(spark: SparkSession, args: argparse.Namespace) -> dict:
    """A trained classifier; few-shot evaluation needs a model and is ``evaluation.evaluate`` with a completion function."""
    data = FileAdapter(args.dataset, args.data, args.format)
    source = "synthetic" if args.synthetic else "real"
    train = evaluation.load_synthetic(spark, args.synthetic)[0] if args.synthetic else data.load(spark, "train", args.num_examples)
    found = evaluation.evaluate("finetune", args.dataset, train, data.load(spark, "test"), source, kind=args.classifier)
    if args.out:
        reports.save_result(found, args.out)
    return found.first().asDict(recursive=True)


def main(argv: list[str], spark: SparkSession | None = None) -> dict:
    args = _parser().parse_args(argv)
    if spark is None:
        spark = SparkSession.builder.appName(f"veilgrain {args.command}").getOrCreate()
    ensure_importable(spark)
    return generate(spark, args) if args.command == "generate" else evaluate(spark, args)


if __name__ == "__main__":
    print(json.dumps(main(sys.argv[1:]), default=str))
