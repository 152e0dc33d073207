"""Command lines of the runs: ``python -m quillmill process --input in --output out``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from quillmill import runs
from quillmill.functions.bytepairs import byte_pairs
from quillmill.functions.chunks import word_tokens
from quillmill.operators import names, review
from quillmill.sources import sinks, tables


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillmill")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("process", help="classify, clean, redact and chunk a folder")
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--workers", type=int, default=0, help="cores of a local session; a cluster has its own")
    p.add_argument("--sidecar")
    p.add_argument("--vocabulary", help="count tokens by the byte-pair ranks of this file, which all executors see")
    p.add_argument("--patterns-only", action="store_true", help="without the tagger of names and places")
    p = sub.add_parser("second-pass", help="replace what an assessment found risky")
    p.add_argument("--output", required=True)
    p.add_argument("--blocklist")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--quiet", action="store_true")
    p = sub.add_parser("apply-decisions", help="restore what a reviewer approved")
    p.add_argument("--decisions", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--reviewer", default="")
    p.add_argument("--patterns-only", action="store_true", help="without the tagger of names and places")
    p = sub.add_parser("review-pii", help="show the flags of a run")
    p.add_argument("--log", required=True)
    p.add_argument("--csv")
    p.add_argument("--file")
    p.add_argument("--type")
    p.add_argument("--summary", action="store_true")
    p.add_argument("--show", type=int, default=20)
    p = sub.add_parser("serve", help="the report and its decisions over HTTP")
    p.add_argument("--output", required=True)
    p.add_argument("--port", type=int, default=8765)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    builder = SparkSession.builder.appName("quillmill")
    if getattr(args, "workers", 0):
        builder = builder.master(f"local[{args.workers}]")
    spark = builder.getOrCreate()
    adapter = None if getattr(args, "patterns_only", True) else names.tagger(spark)
    if args.command == "process":
        for path in filter(None, (args.input, args.sidecar)):
            if not tables.exists(spark, path):
                print(f"not found: {path}", file=sys.stderr)
                return 1
        results = runs.process_folder(spark, args.input, args.output, args.dry_run, args.sidecar, adapter, byte_pairs(args.vocabulary) if args.vocabulary else word_tokens)
        sinks.show(sinks.result_lines(results, args.dry_run))
    elif args.command == "second-pass":
        if not tables.exists(spark, f"{args.output}/risk/assessments"):
            print("no risk report", file=sys.stderr)
            return 1
        stats = runs.second_pass_run(spark, args.output, tables.assessments(spark, f"{args.output}/risk/assessments"), args.blocklist, args.dry_run)
        if not args.quiet:
            stats.show(truncate=False)
    elif args.command == "apply-decisions":
        runs.apply_decisions(spark, args.output, args.decisions, args.reviewer, adapter).show(truncate=False)
    elif args.command == "review-pii":
        log = review.numbered(review.matching(tables.review_log(spark, args.log), args.file, args.type), "file", "original_text", "context")
        if args.csv:
            sinks.write_csv(sinks.flags_csv(log), args.csv)
        sinks.show(sinks.summary_lines(log) if args.summary else sinks.flag_lines(log, args.show))
    else:
        from quillmill import service

        service.serve(spark, args.output, args.port)
    return 0


if __name__ == "__main__":
    sys.exit(main())
