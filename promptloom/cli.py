"""Command line: statistics, training, evaluation, exports and retraining over a folder of ledgers."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from promptloom.api import CacheSettings, PromptCache
from promptloom.functions import vectors as V
from promptloom.operators import pairmodel as PM
from promptloom.operators.ledger import feedback_pairs
from promptloom.operators.pairs import training_union
from promptloom.schemas import PAIRS, conform
from promptloom.sources.pairs_io import read_pairs


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="promptloom")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: str, dim: bool = True) -> argparse.ArgumentParser:
        sub = commands.add_parser(name)
        for argument in arguments:
            sub.add_argument(argument)
        if dim:
            sub.add_argument("--dim", type=int, default=64)
        return sub

    command("stats", "folder", dim=False)
    train = command("train-classifier", "pairs", "model")
    evaluate = command("eval-classifier", "model", "pairs")
    for sub in (train, evaluate):
        sub.add_argument("--threshold", type=float, default=None)
        sub.add_argument("--split", default=None)
    train.add_argument("--epochs", type=int, default=5)
    for name in ("export-feedback", "export-active-learning"):
        command(name, "folder", "out", dim=False).add_argument("--split", default="train")
    again = command("retrain", "folder", "held_out", "out")
    again.add_argument("--seed-pairs", default=None)
    again.add_argument("--least-precision", type=float, default=0.8)
    again.add_argument("--least-recall", type=float, default=0.5)
    return parser


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("promptloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    embed = lambda column: V.hash_embedding(column, args.dim).cast("array<float>")
    if args.command == "stats":
        stats = PromptCache(spark, args.folder, "all").stats()
        print(f"entries={stats['entries']} total_hits={stats['total_hits']}")
    elif args.command == "train-classifier":
        pairs = PM.embedded(read_pairs(spark, args.pairs, split=args.split), embed)
        model = PM.train(pairs, dim=args.dim, threshold=0.5 if args.threshold is None else args.threshold, settings=PM.TrainSettings(epochs=args.epochs))
        model.save(spark, args.model)
        print(json.dumps({"rows": model.card["rows"], "loss": model.card["losses"][-1]}))
    elif args.command == "eval-classifier":
        model = PM.PairModel.load(spark, args.model, args.threshold)
        row = PM.evaluate(model, PM.embedded(read_pairs(spark, args.pairs, split=args.split), embed)).first()
        print(json.dumps(row.asDict() if row else {}))
    elif args.command in ("export-feedback", "export-active-learning"):
        cache = PromptCache(spark, args.folder, "all")
        write = cache.export_feedback if args.command == "export-feedback" else cache.export_active_learning
        print(f"exported={write(args.out, split=args.split)}")
    else:
        cache = PromptCache(spark, args.folder, "all", settings=CacheSettings(dim=args.dim))
        pairs = conform(feedback_pairs(cache.ledgers.read("feedback_events"), cache.ledgers.lookups(), cache.ledgers.read("cache_entries")), PAIRS)
        if args.seed_pairs:
            pairs = training_union(pairs, read_pairs(spark, args.seed_pairs))
        held = PM.embedded(read_pairs(spark, args.held_out), embed)
        settings = PM.RetrainSettings(least_precision=args.least_precision, least_recall=args.least_recall)
        report = PM.retrain(PM.embedded(pairs.where(F.col("prompt_a").isNotNull() & F.col("prompt_b").isNotNull()), embed), held, dim=args.dim, folder=args.out, settings=settings)
        print(json.dumps({"promoted": report["promoted"]}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
