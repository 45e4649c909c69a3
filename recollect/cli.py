"""Command line: compact one conversation of a JSON file or of standard input."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from recollect import __version__
from recollect.plans.compaction import compact, result_messages
from recollect.sources import messages as M


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="recollect", description="Compact a conversation into a prompt block.")
    p.add_argument("-v", "--version", action="version", version=f"%(prog)s {__version__}")
    sub = p.add_subparsers(dest="command")
    c = sub.add_parser("compress", help="compact a JSON array of {role, content}")
    c.add_argument("file", nargs="?")
    c.add_argument("--stdin", action="store_true")
    c.add_argument("-p", "--provider")
    c.add_argument("-k", "--key")
    c.add_argument("--model")
    c.add_argument("--keep", type=int, default=10)
    c.add_argument("--style", default="structured")
    c.add_argument("-f", "--format", default="full")
    c.add_argument("-o", "--out")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command is None:
        parser().print_help()
        return 0
    if not args.stdin and not args.file:
        print("give a file or --stdin", file=sys.stderr)
        return 1
    spark = SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
    try:
        msgs = (M.from_stdin(spark) if args.stdin else M.from_json_files(spark, args.file)).cache()
        done = compact(msgs, args.keep, style=args.style, provider=args.provider, api_key=args.key, model=args.model)
        row = done.first()
        if row is None:
            raise ValueError("no messages to compress")
        kept = [{"role": r.role, "content": r.content} for r in result_messages(msgs, done, args.keep).orderBy("turn").collect()]
    except Exception as e:  # noqa: BLE001  every failure is a message and exit code 1
        print(f"error: {str(e).splitlines()[0]}", file=sys.stderr)
        return 1
    out = M.formatted(row.asDict(recursive=True), kept, args.format)
    if args.out:
        with open(args.out, "w", encoding="utf-8") as f:
            f.write(out)
        print(f"written to {args.out}; tokens saved: {row.saved_token_count}", file=sys.stderr)
    else:
        print(out)
        if args.format == "full":
            print(f"tokens saved: {row.saved_token_count}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
