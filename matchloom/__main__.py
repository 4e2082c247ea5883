"""Command line: python -m matchloom train | score | run | blocking | older-blocking | validate."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators import validate
from .plans import resolve
from .sources import io


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="matchloom", description="Entity resolution on Spark.")
    jobs = top.add_subparsers(dest="job", required=True)

    def job(name: str, about: str) -> argparse.ArgumentParser:
        one = jobs.add_parser(name, help=about, description=about)
        for folder in ("data", "work", "output"):
            one.add_argument(f"--{folder}", help=f"folder of {folder}; MATCHLOOM_{folder.upper()}_DIR otherwise")
        return one

    one = job("train", "fit models, log odds, rule and priors on a split with a truth file")
    one.add_argument("--truth", required=True)
    one.add_argument("--split", default="train")
    one.add_argument("--ablation", action="store_true", help="fit stage 2 without the differences, too")
    for name, about in (("score", "resolve a split with models that were trained"), ("run", "train on one split, then resolve another")):
        one = job(name, about)
        one.add_argument("--split", default="test")
        one.add_argument("--matching-only", action="store_true", help="write no candidate file")
        one.add_argument("--uncorrected", action="store_true", help="keep scores as they are where priors differ")
        one.add_argument("--single", action="store_true", help="one file a list")
        if name == "run":
            one.add_argument("--truth", required=True)
            one.add_argument("--train-split", default="train")
    one = job("blocking", "measure the candidates of a split against its truth file")
    one.add_argument("--truth", required=True)
    one.add_argument("--split", default="train")
    one = job("older-blocking", "candidate lists of the older blockers")
    one.add_argument("--split", default="train")
    one.add_argument("--single", action="store_true", help="one file")
    one = jobs.add_parser("validate", help="check a matching file, and a candidate file", description="Check a matching file, and a candidate file.")
    one.add_argument("matching")
    one.add_argument("--source1", required=True, help="TSV whose first column has the ids that need a row")
    one.add_argument("--candidates")
    one.add_argument("--targets", nargs="*", default=[], help="TSVs whose first columns have all ids that may occur")
    return top.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    """The exit code: 0, or 1 if a written or given file has an error."""
    a = _arguments(argv)
    spark = SparkSession.builder.appName("matchloom").getOrCreate()
    if a.job == "validate":
        known = None
        for path in a.targets:
            ids = io.read_ids(spark, path)
            known = ids if known is None else known.unionByName(ids)
        found = validate.validate(spark, a.matching, io.read_ids(spark, a.source1), a.candidates, known).collect()  # at most a row a rule
        for r in found:
            print(f"{r['severity']}: {r['rule']}: {r['n']} ({', '.join(r['examples'])})")
        return int(any(r["severity"] == "error" for r in found))
    base = io.Paths.from_environment()
    paths = io.Paths(a.data or base.data, a.work or base.work, a.output or base.output)
    if a.job == "train":
        print(resolve.train(spark, paths, a.truth, a.split, a.ablation))
        return 0
    if a.job in ("blocking", "older-blocking"):
        print(resolve.blocking_report(spark, paths, a.split, a.truth) if a.job == "blocking" else resolve.older_blocking(spark, paths, a.split, a.single))
        return 0
    if a.job == "run":
        resolve.train(spark, paths, a.truth, a.train_split)
    chosen = resolve.resolve(spark, paths, a.split, correct=not a.uncorrected)
    return resolve.output(spark, paths, a.split, chosen, a.matching_only, a.single)


if __name__ == "__main__":
    sys.exit(main())
