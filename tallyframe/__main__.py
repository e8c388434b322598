"""Command line: ``python -m tallyframe profile|check|run|build``; prints JSON.

Run under spark-submit for a cluster; the session's own settings decide where.
"""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession

from tallyframe.operators.joincheck import JoinCheck
from tallyframe.operators.profile import profile_dict
from tallyframe.plans.models import build_models, load_models
from tallyframe.plans.spec import load_spec, run_spec, write_gated
from tallyframe.session import prepare
from tallyframe.sources.files import find_data_files, stem_of, suffix_of
from tallyframe.sources.readers import load_table
from tallyframe.sources.writers import write_output


def arguments(argv=None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tallyframe")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("profile", help="profile every data file at a path")
    one.add_argument("path")
    one = commands.add_parser("check", help="diagnose a join without building it")
    one.add_argument("left")
    one.add_argument("right")
    one.add_argument("--on", action="append", help="a key both sides share")
    one.add_argument("--left-on", action="append")
    one.add_argument("--right-on", action="append")
    one = commands.add_parser("run", help="run one spec and show what was measured")
    one.add_argument("spec")
    one.add_argument("--root", default=".")
    one.add_argument("--models", help="folder of specs it may read")
    one.add_argument("--write", metavar="FOLDER", help="write its table unless a condition blocks")
    one.add_argument("--format", choices=("parquet", "csv"), default="parquet")
    one = commands.add_parser("build", help="build a folder of specs, inputs first")
    one.add_argument("specs")
    one.add_argument("--root", default=".")
    one.add_argument("--only")
    one.add_argument("--out")
    one.add_argument("--gate", action="store_true", help="leave blocked models unwritten")
    return parser.parse_args(argv)


def _step(result) -> dict:
    return {"step": result.id, "op": result.op, "provenance": result.provenance,
            "outcome": result.outcome, "drift": result.drift, "blocking": result.blocking}


def execute(spark: SparkSession, args: argparse.Namespace):
    prepare(spark)
    if args.command == "profile":
        return {
            stem_of(path): profile_dict(load_table(spark, path), columnar=suffix_of(path) == ".parquet")
            for path in find_data_files(spark, args.path)
        }
    if args.command == "check":
        return JoinCheck(load_table(spark, args.left), load_table(spark, args.right), args.on,
                         left_on=args.left_on, right_on=args.right_on).findings()
    if args.command == "run":
        models = load_models(args.models) if args.models else {}
        results = run_spec(spark, load_spec(args.spec), base_dir=args.root, models=models)
        if args.write and results:
            name = os.path.splitext(os.path.basename(args.spec))[0]
            write_gated(results[-1], write_output, args.write, name, args.format)
        return [_step(r) for r in results]
    built = build_models(spark, load_models(args.specs), base_dir=args.root, only=args.only,
                         out_dir=args.out, gate=args.gate)
    return [{"model": m.name, "path": m.path, "blocking": m.blocking, "drift": m.drift,
             "refused": m.refused} for m in built]


def main(argv=None) -> None:
    args = arguments(argv)
    spark = SparkSession.builder.appName("tallyframe").getOrCreate()
    print(json.dumps(execute(spark, args), indent=1, default=str))


if __name__ == "__main__":
    main()
