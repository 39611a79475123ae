"""python -m loomtext STAGE OUT [--source DIR ...] [--config FILE]: run a stage, or all of them up to analyze."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from loomtext.plans import pipeline
from loomtext.plans.config import Config, load_config


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="loomtext", description=__doc__)
    parser.add_argument("stage", choices=["import", *pipeline.STAGES, "all"])
    parser.add_argument("out")
    parser.add_argument("--source", action="append", default=[])
    parser.add_argument("--config")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("loomtext").getOrCreate()
    config = load_config(args.config) if args.config else Config()
    if args.stage in ("import", "all"):
        pipeline.import_data(spark, args.source, args.out, config)
    for name, stage in pipeline.STAGES.items():
        if args.stage == name or args.stage == "all" and name != "predict":
            stage(spark, args.out, config)


if __name__ == "__main__":
    main()
