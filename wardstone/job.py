"""Command line: the three stages as jobs for ``spark-submit``.

    spark-submit --py-files wardstone.zip wardstone/job.py cohort  --tables /data/hospital --out /data/analytic
    spark-submit ...                          wardstone/job.py profile --table /data/analytic --out /data/profile
    spark-submit ...                          wardstone/job.py study   --table /data/analytic --second /data/full --out /data/results
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from wardstone.plans import cohort, modelling, profiling, rulebook as rules
from wardstone.session import tune
from wardstone.sources import load_tables, read_optional, write_results


def build(spark: SparkSession, args) -> None:
    wanted = [t for t in cohort.TABLES if t != "d_items"]
    options = cohort.Options(
        incident_after=args.incident_after, fanout=args.fanout, first_stay_only=not args.all_stays,
        screened_only=args.screened_only, drop_prevalent=args.drop_prevalent,
    )
    table = cohort.cohort_table(load_tables(spark, args.tables, wanted), options)
    write_results({args.name: table}, args.out, args.format)


def profile(spark: SparkSession, args) -> None:
    write_results(profiling.report(read_optional(spark, args.table, fmt=args.read_format)), args.out, args.format)


def study(spark: SparkSession, args) -> None:
    table = read_optional(spark, args.table, fmt=args.read_format)
    features = cohort.feature_names(table.columns, rules.SPARSE_REVISED if args.revised else rules.SPARSE)
    settings = modelling.Settings(
        rounds=args.rounds, cv_rounds=args.cv_rounds, folds=args.folds, max_iter=args.max_iter,
        penalties=args.penalties, replicates=args.replicates,
    )
    split = modelling.is_after("anchor_year_group") if args.temporal else None
    masks = modelling.race_masks() if args.by_race else modelling.study_masks()
    outcome = modelling.fit_and_evaluate(
        table, "stay_id", rules.TARGET, features, masks=masks, is_test=split, settings=settings
    )
    outcome.write(args.out, args.format)
    second = read_optional(spark, args.second, fmt=args.read_format) if args.second else None
    metrics = modelling.evaluate_second_cohort(outcome.model, second, rules.TARGET, "second cohort")
    if metrics is not None:
        write_results({"second_cohort": metrics}, args.out, args.format)


def arguments(argv=None):
    parser = argparse.ArgumentParser(prog="wardstone")
    stages = parser.add_subparsers(dest="stage", required=True)
    defaults = modelling.Settings()

    def stage(name, run):
        sub = stages.add_parser(name)
        sub.set_defaults(run=run)
        sub.add_argument("--out", required=True)
        sub.add_argument("--format", default="csv", choices=("csv", "parquet"))
        return sub

    sub = stage("cohort", build)
    sub.add_argument("--tables", required=True)
    sub.add_argument("--name", default="analytic")
    sub.add_argument("--incident-after", type=float)
    sub.add_argument("--fanout", default="faithful", choices=("faithful", "corrected"))
    for flag in ("--all-stays", "--screened-only", "--drop-prevalent"):
        sub.add_argument(flag, action="store_true")
    for name, run in (("profile", profile), ("study", study)):
        sub = stage(name, run)
        sub.add_argument("--table", required=True)
        sub.add_argument("--read-format", default="csv", choices=("csv", "parquet"))
        if name == "study":
            sub.add_argument("--second")
            sub.add_argument("--penalties", type=float, nargs="*")
            for number in ("rounds", "cv_rounds", "folds", "max_iter", "replicates"):
                sub.add_argument(f"--{number.replace('_', '-')}", type=int, default=getattr(defaults, number))
            for flag in ("--revised", "--temporal", "--by-race"):
                sub.add_argument(flag, action="store_true")
    return parser.parse_args(argv)


def main(argv=None) -> None:
    args = arguments(argv)
    args.run(tune(SparkSession.builder.appName(f"wardstone {args.stage}").getOrCreate()), args)


if __name__ == "__main__":
    main()
