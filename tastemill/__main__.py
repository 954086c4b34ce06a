"""Command lines: ``python -m tastemill stage|run|mine|recommend``."""

from __future__ import annotations

import argparse
import json

from .plans.config import PipelineConfig, preset
from .plans.pipeline import recommend_from, run_mining, run_pipeline
from .session import build
from .sources import files


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tastemill")
    sub = top.add_subparsers(dest="what", required=True)
    stage = sub.add_parser("stage", help="CSV tables to Parquet")
    stage.add_argument("raw_dir")
    stage.add_argument("staging_dir")
    stage.add_argument("--force", action="store_true", help="stage again what is staged")
    run = sub.add_parser("run", help="clean, split, features and baskets")
    run.add_argument("staging_dir")
    run.add_argument("out_dir")
    run.add_argument("--options", type=json.loads, default={}, help="settings of the run as a JSON object")
    mined = sub.add_parser("mine", help="rules from a run's baskets")
    mined.add_argument("run_dir")
    mined.add_argument("out_dir")
    mined.add_argument("--preset", default="C")
    mined.add_argument("--full", action="store_true", help="the full baskets instead of the reduced ones")
    mined.add_argument("--options", type=json.loads, default={}, help="changes of the preset as a JSON object")
    advised = sub.add_parser("recommend", help="recommendations, tag DNA and genre semantics of a movie, from the latest runs of presets A, B and C")
    advised.add_argument("mined_dir")
    advised.add_argument("run_dir")
    advised.add_argument("out_dir")
    advised.add_argument("--seed", help="a movie token; the first covered movie without it")
    advised.add_argument("--options", type=json.loads, default={}, help="k, evidence, tags, min_lift, min_confidence as a JSON object")
    return top


def main(given: list[str] | None = None) -> str:
    """Runs one command and returns what it prints: where the results are."""
    args = parser().parse_args(given)
    spark = build()
    if args.what == "stage":
        files.stage_raw(spark, args.raw_dir, args.staging_dir, args.force)
        done = args.staging_dir
    elif args.what == "run":
        done = run_pipeline(spark, args.staging_dir, args.out_dir, PipelineConfig(**args.options))
    elif args.what == "recommend":
        done = recommend_from(spark, args.mined_dir, args.run_dir, args.out_dir, args.seed, **args.options)
    else:
        done = run_mining(spark, args.run_dir, args.out_dir, preset(args.preset, **args.options), not args.full)
    print(done)
    return done


if __name__ == "__main__":
    main()
