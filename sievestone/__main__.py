"""Command line: ``spark-submit ... -m sievestone`` or ``python -m sievestone``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators import duplicates, repairs
from .plans import questions
from .plans.analysis import analyze
from .plans.catalogue import queries
from .sources.tables import read_any, write_any


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sievestone", description="Quality of machine-learning tables on Spark.")
    sub = p.add_subparsers(dest="command", required=True)
    for name, text in (("analyze", "scores and issue counts of a table"), ("check", "exit status 1 if the score is under --least"), ("fix", "write the table without repeated rows and outliers"), ("ask", "answer a question about a table's issues")):
        s = sub.add_parser(name, help=text)
        s.add_argument("path")
        s.add_argument("--key", required=True)
        s.add_argument("--label")
    sub.choices["check"].add_argument("--least", type=float, default=80.0)
    sub.choices["fix"].add_argument("--to", required=True)
    sub.choices["ask"].add_argument("--question", required=True)
    q = sub.add_parser("query", help="run a catalogued query over a folder of tables")
    q.add_argument("name")
    q.add_argument("folder")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("sievestone").getOrCreate()
    if args.command == "query":
        queries()[args.name](spark, args.folder).show(50, truncate=False)
        return 0
    table = read_any(spark, args.path)
    found = analyze(table, args.key, args.label)
    if args.command == "analyze":
        print(found.summary())
    elif args.command == "ask":
        questions.answer(questions.parse(args.question), found.issues).show(50, truncate=False)
    elif args.command == "check":
        score = found.score().first()["overall"]
        print(f"score {score}, least {args.least}")
        return int(score < args.least)
    else:
        kept = duplicates.first_of_each(table, args.key, found.data.features)
        if "outliers" in found.issues:
            kept = repairs.without(kept, args.key, found.issues["outliers"].withColumnRenamed(args.key, "key"))
        write_any(kept, args.to)
    return 0


if __name__ == "__main__":
    sys.exit(main())
