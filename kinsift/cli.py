"""Command line: python -m kinsift.cli compare A B, or scan FOLDER. Options stand before or after the command."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from . import types as T
from .plans.compare import compare, scan


def number(text: str) -> float:
    try:
        return T.threshold(text)
    except ValueError as e:
        raise argparse.ArgumentTypeError(str(e)) from None


def parser() -> argparse.ArgumentParser:
    options = argparse.ArgumentParser(add_help=False, argument_default=argparse.SUPPRESS)
    options.add_argument("--lang", choices=["ts", "auto"], help="accepted; sources are TypeScript")
    options.add_argument("--format", choices=["text"], help="accepted; reports are text")
    options.add_argument("--threshold", type=number, help="similarity from which functions are alike, 0.85 if not given")
    options.add_argument("--explain", action="store_true", help="accepted; all signals are always shown")
    options.add_argument("--fail-on", choices=["do-not-extract"], help="accepted; has no effect")
    options.add_argument("--root", help="folder that paths are relative to, the current one if not given")
    top = argparse.ArgumentParser(prog="kinsift", parents=[options])
    commands = top.add_subparsers(dest="command", required=True)
    two = commands.add_parser("compare", parents=[options])
    two.add_argument("a", metavar="FILE:LINE")
    two.add_argument("b", metavar="FILE:LINE")
    whole = commands.add_parser("scan", parents=[options])
    whole.add_argument("folder")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    threshold = getattr(args, "threshold", T.STRUCTURAL_THRESHOLD)
    spark = spark or SparkSession.builder.appName("kinsift").getOrCreate()
    if args.command == "scan":
        for row in scan(spark, args.folder, threshold).select("report").toLocalIterator():
            print(row.report)
        return 0
    row = compare(spark, getattr(args, "root", os.getcwd()), args.a, args.b, threshold).first()
    if row.error:
        print(f"{row.error_at}: {row.error_text}", file=sys.stderr)
        return 1
    print(row.report)
    return 0


if __name__ == "__main__":
    sys.exit(main())
