"""Command line: channels, ingest, query, migrate."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from lamplight.functions import ranking, text
from lamplight.operators import catalog
from lamplight.plans import search
from lamplight.service import Service, checked_uuid
from lamplight.session import build_session
from lamplight.settings import ExtractOptions, Settings
from lamplight.sources import extract, files
from lamplight.sources.pdf import PdfText
from lamplight.sources.warehouse import Warehouse


#: Switches of an ingest, and the option each turns off.
SWITCHES = {
    "tables": "extract_tables",
    "figures": "extract_figures",
    "formulas": "extract_formulas",
    "ocr": "ocr_fallback",
    "captions": "figure_captioning",
}


class PlainText:
    """Reads the file's bytes as UTF-8 text, for files that only carry the name of a PDF."""

    tag = "plain-text"

    def items(self, content):
        return extract.text_items(F.decode(content, "UTF-8"))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lamplight")
    top.add_argument("--root", required=True, help="folder of the warehouse")
    commands = top.add_subparsers(dest="command", required=True)

    channels = commands.add_parser("channels").add_subparsers(dest="what", required=True)
    create = channels.add_parser("create")
    create.add_argument("name")
    create.add_argument("--description", default="")
    create.add_argument("--meta", action="append", default=[], metavar="KEY=VALUE")
    channels.add_parser("list")
    show = channels.add_parser("show")
    show.add_argument("channel_id")

    ingest = commands.add_parser("ingest")
    ingest.add_argument("path")
    ingest.add_argument("--channel-id", required=True)
    ingest.add_argument("--recursive", action="store_true")
    ingest.add_argument("--title", default="")
    ingest.add_argument("--meta", action="append", default=[], metavar="KEY=VALUE")

    ingest.add_argument("--stop-on-error", action="store_true", help="leave out the files after the first unreadable one")
    for name in SWITCHES:
        ingest.add_argument(f"--no-{name}", action="store_true")

    query = commands.add_parser("query")
    query.add_argument("text")
    query.add_argument("--channel-id", required=True)
    query.add_argument("--report-id")
    query.add_argument("--top-k", type=int, default=ranking.TOP_K)
    query.add_argument("--candidates", type=int, default=ranking.CANDIDATES)
    query.add_argument("--rrf-k", type=int, default=ranking.RRF_K)
    query.add_argument("--alpha", type=float, default=ranking.ALPHA)
    query.add_argument("--prf-beta", type=float, default=ranking.PRF_BETA)
    query.add_argument("--prf-topn", type=int, default=ranking.PRF_TOPN)
    query.add_argument("--neighbours", type=int, default=ranking.NEIGHBOURS)
    query.add_argument("--no-rerank", action="store_true")
    query.add_argument("--json", action="store_true")

    migrate = commands.add_parser("migrate")
    migrate.add_argument("folder")
    migrate.add_argument("--status", action="store_true")
    migrate.add_argument("--dry-run", action="store_true")
    return top


def pairs(spark, items: list[str]) -> dict[str, str]:
    row = spark.createDataFrame([(items,)], "x array<string>").select(text.key_values(F.col("x"))).first()
    if row[0] is None:
        raise ValueError("--meta takes KEY=VALUE with a non-empty key")
    return row[0]


def run(service: Service, args: argparse.Namespace) -> int:
    spark = service.spark
    if args.command == "channels":
        if args.what == "create":
            print(service.create_channel(args.name, args.description, pairs(spark, args.meta)))
        elif args.what == "list":
            for row in service.channels().toLocalIterator():
                print(row["id"], row["name"], row["created_at"].isoformat(), sep="\t")
        else:
            channel = service.channel(checked_uuid(spark, args.channel_id, "channel id")).first()
            if channel is None:
                raise LookupError(f"no channel {args.channel_id}")
            print(channel["name"])
            for row in catalog.report_table(service.reports(channel["id"])).toLocalIterator():
                print(*row, sep="\t")
    elif args.command == "ingest":
        channel = checked_uuid(spark, args.channel_id, "--channel-id")
        result = service.ingest_path(
            args.path, channel, recursive=args.recursive, title=args.title, metadata=pairs(spark, args.meta),
            options=ExtractOptions(**{option: not getattr(args, f"no_{name}") for name, option in SWITCHES.items()}),
            stop_on_error=args.stop_on_error,
        )
        done = result.stats.select("report_id", F.lit("succeeded").alias("status"))
        lost = result.rejects.select("filename", F.lit("failed").alias("status"), "fault")
        for row in lost.toLocalIterator():
            print(f"failed\t{row['filename']}\t{row['fault']}", file=sys.stderr)
        summary = catalog.batch_summary(done.select("status").unionAll(lost.select("status"))).first()
        print(f"succeeded {summary['succeeded']} / {summary['total']}")
        if not summary["total"]:
            raise LookupError(f"no PDF files in {args.path}")
        return summary["exit_code"]
    elif args.command == "query":
        report = args.report_id and checked_uuid(spark, args.report_id, "--report-id")
        rows = service.query(
            args.text, checked_uuid(spark, args.channel_id, "--channel-id"), report_id=report, top_k=args.top_k,
            candidates=args.candidates, rrf_k=args.rrf_k, alpha=args.alpha, prf_beta=args.prf_beta,
            prf_topn=args.prf_topn, neighbours=args.neighbours, rerank=not args.no_rerank,
        )
        shown = (search.as_json(rows) if args.json else search.as_preview(rows)).orderBy("position")
        for row in shown.toLocalIterator():
            print(row[1])
    elif args.status:
        found, applied = files.sql_files(spark, args.folder), service.store.read("schema_migrations")
        for row in catalog.migration_status(found, applied).toLocalIterator():
            print(row["version"], row["state"], sep="\t")
    else:
        for version in service.migrate(args.folder, args.dry_run):
            print(version)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = build_session()
    service = Service(Warehouse(spark, args.root, Settings.from_env()), extractor=PdfText())
    try:
        return run(service, args)
    except (ValueError, LookupError, FileExistsError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
