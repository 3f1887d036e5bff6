"""run, sync, report, evaluate; to be submitted with spark-submit."""

from __future__ import annotations

import argparse
import datetime as dt
import json

from pyspark.sql import SparkSession

from tallyspark.plans import run as plans
from tallyspark.sources.inbox import read_labels, read_pages
from tallyspark.sources.sinks import make_sink
from tallyspark.sources.state import State


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallyspark")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="read pages, update the state, push what is pending")
    run.add_argument("--pages", required=True, help="Parquet of pages that a reader has made")
    run.add_argument("--as-of", type=dt.date.fromisoformat, required=True)
    run.add_argument("--prune", action="store_true")
    sync = sub.add_parser("sync", help="push what is pending")
    report = sub.add_parser("report", help="write the review queue")
    report.add_argument("--out", required=True)
    evaluate = sub.add_parser("evaluate", help="compare pages with labels")
    evaluate.add_argument("--pages", required=True)
    evaluate.add_argument("--labels", required=True)
    evaluate.add_argument("--as-of", type=dt.date.fromisoformat, required=True)
    for x in (run, sync, report):
        x.add_argument("--state", required=True)
    for x in (run, sync):
        x.add_argument("--sink", default="none", help="none | file:<folder> | flaky:<folder>")
    return p


def main(argv: list[str] | None = None) -> dict:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"tallyspark {args.command}").getOrCreate()
    out: dict = {}
    if args.command == "evaluate":
        got = plans.evaluate(read_pages(spark, args.pages), read_labels(spark, args.labels), args.as_of)
        out = {k: [r.asDict() for r in df.collect()] for k, df in got.items()}
    else:
        state = State(spark, args.state)
        if args.command == "run":
            out = plans.process(read_pages(spark, args.pages), state, args.as_of)
        if args.command == "report":
            plans.report(state, args.out)
        elif sink := make_sink(args.sink):
            out |= plans.sync(state, sink, prune=getattr(args, "prune", False))
    print(json.dumps(out, default=str))
    return out


if __name__ == "__main__":
    main()
