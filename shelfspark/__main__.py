"""Command line: ``python -m shelfspark build|search|follow|watch|audit|dump``."""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.operators import audit
from shelfspark.operators.search import PRESETS, preset_filters
from shelfspark.plans.engine import Engine
from shelfspark.session import get_session
from shelfspark.sources import records as R
from shelfspark.streaming.journal import deletions_of, follow
from shelfspark.streaming.source import finished, follow_journals


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="shelfspark", description="Search and audit a library of media files with Spark.")
    parser.add_argument("--library", required=True, help="folder of the snapshots")
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="resolve scan buffers into a snapshot")
    build.add_argument("volume", nargs="+", help="LETTER=FOLDER of binary scan buffers")
    build.add_argument("--full", action="store_true", help="do not carry over other volumes")
    build.add_argument("--dry-run", action="store_true", help="show what would be found and publish nothing")
    find = commands.add_parser("search", help="ranked search")
    find.add_argument("query")
    find.add_argument("--kind", action="append", default=[])
    find.add_argument("--limit", type=int, default=50)
    find.add_argument("--newest", action="store_true")
    find.add_argument("--preset", action="append", default=[], choices=list(PRESETS), help="of resolution, length and last change at most one each")
    watch = commands.add_parser("follow", help="merge change files as they arrive")
    watch.add_argument("changes")
    watch.add_argument("--checkpoint", required=True)
    watch.add_argument("--poll", help="for example '500 milliseconds'; without it, what is there now")
    live = commands.add_parser("watch", help="merge journals as they grow, from now on")
    live.add_argument("journals", help="folder of journals by volume")
    live.add_argument("--volume", action="append", default=[], help="letter of a volume to watch; without it, all")
    live.add_argument("--checkpoint", required=True)
    live.add_argument("--poll", default="500 milliseconds")
    live.add_argument("--once", action="store_true", help="merge what is there and stop")
    report = commands.add_parser("audit", help="deletions by hour and type")
    report.add_argument("buffers", nargs="+", help="LETTER=FOLDER of binary journal buffers")
    report.add_argument("--volume", action="append", default=[], help="letter of a volume to report on; without it, all")
    dump = commands.add_parser("dump", help="the first files by position, and what the tables hold")
    dump.add_argument("--rows", type=int, default=20)
    args = parser.parse_args(argv)

    spark = get_session()
    if args.command == "build":
        records = {v[0].upper(): R.scan_records(R.decode(R.read_buffers(spark, v.split("=", 1)[1]))) for v in args.volume}
        if args.dry_run:
            for letter, rows in records.items():
                print(letter)
                rows.groupBy("is_dir", "kind").agg(F.count("*").alias("n")).show()
            return
        print(Engine(spark, args.library).build(records, full=args.full))
    elif args.command == "search":
        hits = Engine(spark, args.library).search(args.query, args.kind, args.limit, order="newest" if args.newest else "relevance", **preset_filters(*args.preset)).hits
        hits.select("score", "path").show(args.limit, False)
    elif args.command == "follow":
        follow(spark, args.changes, Engine(spark, args.library).store, args.checkpoint, poll=args.poll).awaitTermination()
    elif args.command == "watch":
        options = {"volumes": ",".join(args.volume)} if args.volume else {}
        finished(follow_journals(spark, args.journals, Engine(spark, args.library).store, args.checkpoint, begin="first" if args.once else "now", poll=None if args.once else args.poll, **options))
    elif args.command == "audit":
        wanted = {v.upper() for v in args.volume}
        folders = {letter.upper(): folder for letter, folder in (b.split("=", 1) for b in args.buffers)}
        read = [deletions_of(R.decode(R.read_buffers(spark, folder)), letter) for letter, folder in folders.items() if not wanted or letter in wanted]
        if not read:
            parser.error("none of these volumes was named")
        gone = reduce(DataFrame.unionByName, read)
        audit.deletions_by_hour(gone).show(100, False)
        audit.deletions_by_extension(gone).show()
    else:
        now = Engine(spark, args.library).snapshot
        if now is None:
            parser.error("the library has no snapshot yet")
        audit.first_files(now.files, now.dirs, args.rows).show(args.rows, False)
        audit.footprint(now.files, now.dirs).show()


if __name__ == "__main__":
    main()
