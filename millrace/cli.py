"""``python -m millrace.cli PROGRAM ...`` runs a shipped program."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from millrace.metrics import phases, splits
from millrace.plans import programs
from millrace.session import session


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="millrace")
    top.add_argument("--master")
    top.add_argument("--reducers", type=int)
    top.add_argument("--threads", type=int)
    top.add_argument("--log-level", default="WARN")
    top.add_argument("--stats", action="store_true", help="a JSON line on stderr for each stage that ran")
    top.add_argument("--list-inputs", action="store_true", help="the first 100 input files on stderr")
    sub = top.add_subparsers(dest="program", required=True)
    for name in ("wordcount", "wordcount-parquet", "sort-tsv"):
        p = sub.add_parser(name)
        p.add_argument("--input", required=True)
    for name in ("join", "join-nested"):
        p = sub.add_parser(name)
        p.add_argument("--searches", required=True)
        p.add_argument("--pages", required=True)
    p.add_argument("--stage", help="folder of a table of the joined rows, between the two steps")
    p.add_argument("--keep-stage", action="store_true")
    for p in sub.choices.values():
        p.add_argument("--single", action="store_true", help="one sorted part")
    p = sub.add_parser("ranking-pairs")
    p.add_argument("--input", action="append", required=True, help="repeatable, or comma-separated")
    p.add_argument("--doc-input")
    p.add_argument("--body-colname", default="body_full")
    p.add_argument("--max-positive-position", type=int, default=3)
    p.add_argument("--min-negative-position", "--min-positive-position", type=int, default=4)
    p.add_argument("--num-negatives", type=int, default=4)
    p.add_argument("--seed", default="0")
    for p in sub.choices.values():
        p.add_argument("--output", required=True)
    a = top.parse_args(argv)
    spark = session(master=a.master, reducers=a.reducers, threads=a.threads, log_level=a.log_level)
    if a.list_inputs:
        given = [getattr(a, n, None) for n in ("input", "searches", "pages", "doc_input")]
        for name in splits(spark, [p for g in given if g for x in ([g] if isinstance(g, str) else g) for p in x.split(",")]):
            print(name, file=sys.stderr)
    ran: list[dict] = []
    with phases(spark, ran):
        _run(spark, a)
    for stage in ran if a.stats else []:
        print(json.dumps(stage), file=sys.stderr)


def _run(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.program == "wordcount":
        programs.wordcount_text(spark, a.input, a.output, single=a.single)
    elif a.program == "wordcount-parquet":
        programs.wordcount_parquet(spark, a.input, a.output, single=a.single)
    elif a.program == "sort-tsv":
        programs.sort_tsv(spark, a.input, a.output, single=a.single)
    elif a.program == "join":
        programs.join(spark, a.searches, a.pages, a.output, single=a.single)
    elif a.program == "join-nested":
        programs.join_nested(spark, a.searches, a.pages, a.output, single=a.single, stage=a.stage, keep=a.keep_stage)
    else:
        programs.ranking_pairs(spark, a.input, a.output, a.doc_input, a.body_colname, a.max_positive_position, a.min_negative_position, a.num_negatives, a.seed)


if __name__ == "__main__":
    main()
