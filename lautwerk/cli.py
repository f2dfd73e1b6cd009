"""Command line: train, align, outliers, check, version."""

from __future__ import annotations

import argparse
import json
import sys

from lautwerk import __version__


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lautwerk")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("version")
    for name in ("train", "align", "outliers", "check"):
        p = commands.add_parser(name)
        p.add_argument("path")
        p.add_argument("--format", choices=("long", "wide", "gled", "arcaverborum"), default="long")
        p.add_argument("--options", default="{}", help="training options as flat JSON")
        p.add_argument("--out", help="folder that Spark writes the lines to; else they are printed")
    commands.choices["train"].add_argument("--json", action="store_true")
    for name in ("train", "align", "outliers"):
        commands.choices[name].add_argument("--progress", action="store_true", help="stages of training on the error stream")
    for name in ("lect-a", "lect-b"):
        commands.choices["align"].add_argument(f"--{name}", help="only pairs of this lect")
    args = parser.parse_args(argv)
    if args.command == "version":
        print(__version__)
        return 0
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from lautwerk.plans import render
    from lautwerk.plans.train import Options, train
    from lautwerk.sources import corpus

    spark = SparkSession.builder.appName("lautwerk").getOrCreate()
    forms = getattr(corpus, f"load_{args.format}")(spark, args.path)
    if args.command == "check":
        corpus.annotations(forms).show()
        corpus.unreadable(forms).show(50, truncate=False)
        return 0
    model = train(forms, Options.of(json.loads(args.options)))
    if args.progress:
        model.run(lambda stage, done, total: print(f"{done}/{total} {stage}", file=sys.stderr))
    if args.command == "outliers":
        model.outliers.show(20, truncate=False)
        return 0
    if args.command == "align":
        links = model.links
        for column, lect in (("lect_a", args.lect_a), ("lect_b", args.lect_b)):
            links = links.where(F.col(column) == lect) if lect else links
        lines = render.alignments(links, render.class_positions(model.observations, model.classes))
    else:
        lines = render.document(model) if args.json else render.summary(model)
    if args.out:
        lines.write.text(args.out)
    else:
        for row in lines.toLocalIterator():
            print(row.value)
    return 0


if __name__ == "__main__":
    sys.exit(main())
