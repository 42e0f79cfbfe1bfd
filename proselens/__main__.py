"""The command line: python -m proselens check|diff|commits|stdin|hook|rules|bench.

Exit codes: 0, 1 if a score is over --fail-over (the hook takes the settings' threshold) or a bench is not met, 2 on errors.
"""

from __future__ import annotations

import argparse
import json
import sys

from proselens.plans import report as P
from proselens.settings import Settings
from proselens.sources import files, messages


def parser() -> argparse.ArgumentParser:
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--json", action="store_true")
    shared.add_argument("--summary", action="store_true")
    shared.add_argument("--fail-over", type=float, metavar="POINT")
    shared.add_argument("--config", metavar="PATH")
    top = argparse.ArgumentParser(prog="proselens")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("check", parents=[shared]).add_argument("paths", nargs="+")
    diff = sub.add_parser("diff", parents=[shared]).add_mutually_exclusive_group()
    diff.add_argument("--staged", action="store_true")
    diff.add_argument("range", nargs="?")
    commits = sub.add_parser("commits", parents=[shared]).add_mutually_exclusive_group()
    commits.add_argument("-n", dest="number", type=int)
    commits.add_argument("range", nargs="?")
    sub.add_parser("stdin", parents=[shared]).add_argument("--format", choices=["text", "markdown"], default="text")
    sub.add_parser("rules", parents=[shared])
    sub.add_parser("bench", parents=[shared]).add_argument("manifest")
    hook = sub.add_parser("hook").add_subparsers(dest="hook", required=True)
    hook.add_parser("commit-msg", parents=[shared]).add_argument("file")
    hook.add_parser("install", parents=[shared]).add_argument("--force", action="store_true")
    hook.add_parser("uninstall", parents=[shared])
    return top


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()


def segments(spark, args, settings: Settings, warn):
    """What a command looks at."""
    if args.command == "commits":
        log = spark.createDataFrame([(0, files.commit_log(args.range, args.number))], "log_id int, log string")
        records = messages.log_records(log, ["log_id"])
        subject = "split(trim(message), '\\n')[0]"
        rows = records.selectExpr("cast(k as long) AS doc_id", "message", "hash", f"{subject} AS subject").withColumn("path", messages.commit_name())
        found = messages.message_segments(rows, ["doc_id", "path", "hash"])
        return found.select("doc_id", "path", "seg_id", "kind", "text", "line_start", "line_end", found["hash"].alias("commit"))
    changed, warnings = files.diff_documents(spark, getattr(args, "range", None), settings)
    warn(warnings)
    if args.command == "diff":
        return changed
    with open(args.file, encoding="utf-8") as f:
        return messages.with_draft(messages.message_document(spark, f.read()), changed)


def run(argv: list[str] | None = None, spark=None, out=print) -> int:
    args = parser().parse_args(argv)
    if args.command == "hook" and args.hook == "install":
        path, written = files.install_hook(args.force)
        out(f"{path} を設置した" if written else f"{path} が既にある。--force で置き換える")
        return int(not written)
    if args.command == "hook" and args.hook == "uninstall":
        path = files.uninstall_hook()
        out(f"{path} を除去した" if path else "hook は無い")
        return 0
    start = args.paths[0] if args.command == "check" else args.manifest if args.command == "bench" else "."
    settings = Settings.load(args.config, start)
    if args.command == "rules":
        out(P.rules_text(settings))
        return 0
    if args.command == "bench" and (args.summary or args.fail_over is not None):
        raise ValueError("bench は --summary と --fail-over を受け付けない")
    spark = spark or session()
    if args.command == "bench":
        scores, met = P.bench(spark, args.manifest, settings)
        if args.json:
            rows = [r.asDict(recursive=True) for r in scores.orderBy("set_ord").collect()]  # a manifest's sets
            out(json.dumps({"sets": rows, "met": met}, ensure_ascii=False, indent=2))
        else:
            out(P.bench_text(scores, met))
        return int(not met)

    def warn(rows):
        for w in rows.toLocalIterator():
            print(f"警告: {w.path}: {w.reason}", file=sys.stderr)

    if args.command == "check":
        made, warnings = P.check(spark, args.paths, settings)
        warn(warnings)
    elif args.command == "stdin":
        docs = files.one_document(spark, sys.stdin.read(), kind=args.format)
        found = files.extract_documents(docs)
        made = P.report(found, docs.join(found.select("doc_id").distinct(), "doc_id", "left_semi"), settings)
    else:
        made = P.of_segments(segments(spark, args, settings, warn), settings)
    out(P.to_json(made, args.summary) if args.json else P.to_text(made, args.summary))
    over = args.fail_over if args.fail_over is not None else settings.threshold if args.command == "hook" else None
    return int(over is not None and made.exceeds(over))


def main() -> int:
    try:
        return run()
    except Exception as e:
        print(f"誤り: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
