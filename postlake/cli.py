"""Command line: ``python -m postlake.cli --index DIR COMMAND ...``; results as text or JSON."""

from __future__ import annotations

import argparse
import json
import sys
from typing import Any

from postlake.operators.staging import clear_staged
from postlake.params import Filters, InboxRequest, QueryRequest, SearchRequest, attachment_flag, parse_date
from postlake.plans.service import MailService, payload, shown
from postlake.plans.tools import Tools
from postlake.streaming.ingest import Ingest, Run


def _date(text: str):
    try:
        return parse_date(text)
    except ValueError as e:
        raise argparse.ArgumentTypeError(f"{text!r} is no ISO date") from e


def _filters(p: argparse.ArgumentParser) -> None:
    p.add_argument("--from", dest="from_addr")
    p.add_argument("--to", dest="to_addr")
    p.add_argument("--subject")
    p.add_argument("--subject-like")
    p.add_argument("--after", dest="date_after", type=_date)
    p.add_argument("--before", dest="date_before", type=_date)
    p.add_argument("--has-attachments", action="store_true")
    p.add_argument("--no-attachments", action="store_true")
    p.add_argument("--attachment-type")
    p.add_argument("--attachment-name")
    p.add_argument("--limit", type=int)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="postlake")
    top.add_argument("--index", required=True, help="folder of the index")
    top.add_argument("--json", action="store_true")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("index")
    p.add_argument("directory")
    p.add_argument("--full", action="store_true", help="list all files, not only those since the last run")
    p.add_argument("--no-skip", action="store_true", help="read files again that haven't changed")
    p.add_argument("--limit", type=int)
    sub.add_parser("index-file").add_argument("path")
    p = sub.add_parser("stream")
    p.add_argument("directory")
    p.add_argument("checkpoint")
    p = sub.add_parser("search")
    p.add_argument("query")
    p.add_argument("--parse", action=argparse.BooleanOptionalAction)
    p.add_argument("--rerank", action=argparse.BooleanOptionalAction)
    p.add_argument("--mode", choices=("prefilter", "postfilter"), default="prefilter")
    _filters(p)
    _filters(sub.add_parser("query"))
    p = sub.add_parser("inbox")
    p.add_argument("--limit", type=int, default=50)
    p.add_argument("--account")
    p.add_argument("--after", dest="date_after", type=_date)
    p.add_argument("--before", dest="date_before", type=_date)
    sub.add_parser("inspect").add_argument("path")
    sub.add_parser("status")
    sub.add_parser("dedup").add_argument("--dry-run", action="store_true")
    p = sub.add_parser("prune")
    p.add_argument("directory")
    p.add_argument("--dry-run", action="store_true")
    p = sub.add_parser("reextract", help="all stale messages, or one")
    p.add_argument("--limit", type=int)
    p.add_argument("--path")
    p.add_argument("--message-id")
    sub.add_parser("serve", help="tools as JSON lines on standard input and output").add_argument("--root", required=True)
    p = sub.add_parser("stage")
    p.add_argument("--root", required=True)
    p.add_argument("--path")
    p.add_argument("--message-id")
    p.add_argument("--no-eml", action="store_true")
    p = sub.add_parser("clear-staged")
    p.add_argument("--root", required=True)
    p.add_argument("--hash")
    sub.add_parser("vacuum", help="remove files that only old versions of the index name").add_argument("--hours", type=float, default=24)
    sub.add_parser("rebucket", help="spread the index over another number of buckets").add_argument("buckets", type=int)
    sub.add_parser("index-vectors", help="build the vector index that searches read")
    p = sub.add_parser("migrate-paths")
    p.add_argument("old")
    p.add_argument("new")
    return top


def _progress(run: Run) -> None:
    print(f"batch {run.batches}: {run.indexed} of {run.candidates} written, {run.failed} failed, {run.batch_errors} batches lost, {run.rate:.1f}/s", file=sys.stderr)


def run(args: argparse.Namespace, spark) -> Any:
    """What a command returns: a response, or a dictionary of counts."""
    service = MailService.open(spark, args.index)
    ingest = Ingest(service.store, report=_progress)
    c = args.command
    if c in ("search", "query"):
        flag = attachment_flag(args.has_attachments, args.no_attachments, strict=False)
        f = Filters(args.from_addr, args.to_addr, args.subject, args.subject_like, args.date_after, args.date_before, flag, args.attachment_type, args.attachment_name)
        return service.search(SearchRequest(args.query, args.limit, f, args.parse, args.rerank, args.mode)) if c == "search" else service.query(QueryRequest(f, args.limit))
    if c == "inbox":
        return service.inbox(InboxRequest(args.limit, args.account, args.date_after, args.date_before))
    if c == "index":
        return vars(ingest.index(args.directory, not args.full, not args.no_skip, args.limit))
    if c == "index-file":
        return ingest.index_file(args.path)
    if c == "stream":
        ingest.stream(args.directory, args.checkpoint).awaitTermination()
        return {"status": "ok"}
    if c == "inspect":
        return service.inspect(args.path) or {"status": "not_indexed"}
    if c == "status":
        return service.status()
    if c == "dedup":
        if args.dry_run:
            from postlake.operators.maintain import duplicate_counts

            return duplicate_counts(service.store.table("emails")).first().asDict()
        return ingest.dedup()
    if c == "prune":
        return ingest.prune(args.directory, args.dry_run)
    if c == "vacuum":
        return ingest.vacuum(args.hours)
    if c == "index-vectors":
        return ingest.index_vectors()
    if c == "rebucket":
        with service.store.locked("rebucket"):
            service.store.rebucket(args.buckets)
        return {"buckets": args.buckets}
    if c == "serve":
        Tools(service, args.root).serve(sys.stdin, sys.stdout)
        return {"status": "ok"}
    if c == "reextract":
        if args.path or args.message_id:
            return ingest.reextract_one(args.path, args.message_id)
        return ingest.reextract(args.limit)
    if c == "stage":
        return service.stage(args.root, args.path, args.message_id, not args.no_eml)
    if c == "clear-staged":
        return clear_staged(args.root, args.hash)
    return ingest.migrate(args.old, args.new)


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("postlake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        out = run(args, spark)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    if args.json:
        print(payload(out))
    elif hasattr(out, "results"):
        print(getattr(out, "message", None) or shown(out.results))
    else:
        print(json.dumps(out if isinstance(out, dict) else vars(out), indent=2, ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
