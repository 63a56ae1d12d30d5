"""Command line: run a campaign, or validate a pool. Settings come from the command line, then a JSON file, then defaults."""

from __future__ import annotations

import argparse
import json
import sys

from .errors import ConfigError, EngineError

DEFAULTS = {
    "schedule": "random:0.01 greedy:0.01*9", "learner": "rf", "target": "target", "featurizer": "lingo", "direction": "higher",
    "seed": 42, "oracle": None, "format": "auto", "allow_large_features": False, "pruning": None, "pruning_fraction": 0.1,
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="prospectra", description=__doc__)
    sub = out.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="run a campaign over a pool")
    check = sub.add_parser("validate", help="report the rows of a pool that can't be used")
    for p in (run, check):
        p.add_argument("pool")
        p.add_argument("--config", help="JSON file of settings")
        p.add_argument("--id-column", dest="identifier")
        p.add_argument("--structure-column", dest="structure")
        p.add_argument("--master", default="local[*]", help="Spark master")
        p.add_argument("--output", help="folder that driver and executors share")
    run.add_argument("--schedule", help="such as 'random:0.01 greedy:0.01*9'")
    for name in ("learner", "target", "featurizer", "oracle", "pruning"):
        run.add_argument(f"--{name}")
    run.add_argument("--direction", choices=("higher", "lower"))
    run.add_argument("--format", choices=("auto", "csv", "parquet"))
    run.add_argument("--seed", type=int)
    run.add_argument("--pruning-fraction", type=float, dest="pruning_fraction")
    run.add_argument("--allow-large-features", action="store_true", default=None, dest="allow_large_features")
    return out


def settings(args: argparse.Namespace) -> dict:
    """What was typed, over the file's settings, over the defaults; unknown names in the file are an error."""
    of_file = {}
    if args.config:
        with open(args.config) as f:
            of_file = json.load(f)
        if unknown := set(of_file) - set(DEFAULTS) - {"output", "identifier", "structure"}:
            raise ConfigError(f"unknown settings in {args.config}: {', '.join(sorted(unknown))}")
    typed = {k: v for k, v in vars(args).items() if v is not None and k not in ("command", "config", "pool", "master")}
    return DEFAULTS | of_file | typed


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    try:
        own = settings(args)
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.master(args.master).appName("prospectra").getOrCreate()
        from .operators import cycle, features
        from .sources import pools, sinks

        pool = pools.read_pool(spark, args.pool, own.get("structure"), own.get("identifier")).withColumnsRenamed({"ID": "id", "SMILES": "structure"})
        if args.command == "validate":
            report = features.validate_pool(pool)
            bad = report.where("error IS NOT NULL").select("id", "error")
            n, wrong = report.count(), bad.count()
            print(json.dumps({"rows": n, "invalid": wrong, "success_rate": (n - wrong) / n if n else 0.0}))
            if own.get("output"):
                sinks.publish(bad, f"{own['output']}/validation_report", "csv", header="true")
            return int(wrong > 0)
        if not own.get("output"):
            raise ConfigError("an output folder is needed")
        shared = {"pruning": own["pruning"], "pruning_settings": {"fraction": own["pruning_fraction"]}} if own["pruning"] else {}
        got = cycle.run_campaign(pool, own["output"], own["schedule"], own["oracle"], own["learner"], own["target"], own["featurizer"], "structure", own["direction"], own["seed"], confirmed=bool(own["allow_large_features"]), wanted=own["format"], **shared)
        print(json.dumps(got.summary, sort_keys=True))
        return 0
    except EngineError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
