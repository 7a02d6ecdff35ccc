"""Command line: ``python -m helixlake queries``, ``check``, ``run NAME TABLES [--out FOLDER] [--force]``, or
``preprocess FASTA_FOLDER METADATA_TSV OUTPUT [--settings JSON]``."""

from __future__ import annotations

import argparse
import json

from . import session
from .config import merge
from .plans import catalog, preprocess


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="helixlake", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("queries", help="list the queries")
    commands.add_parser("check", help="a smoke test of the environment")
    run = commands.add_parser("run", help="run a query over a folder of tables")
    run.add_argument("name")
    run.add_argument("tables")
    run.add_argument("--out", help="write the result as Parquet (an existing output is an error)")
    run.add_argument("--force", action="store_true", help="replace an existing output")
    run.add_argument("--master")
    whole = commands.add_parser("preprocess", help="from FASTA files to checked chunks; goes on where a run was stopped")
    whole.add_argument("folder")
    whole.add_argument("metadata", help="a table of the files: " + ", ".join(preprocess.METADATA))
    whole.add_argument("output")
    whole.add_argument("--settings", default="{}", help="settings other than the usual ones, as JSON")
    whole.add_argument("--master")
    args = parser.parse_args(argv)
    if args.command == "queries":
        print("\n".join(catalog.QUERIES))
        return 0
    if args.command == "run" and args.name not in catalog.QUERIES:
        parser.error(f"unknown query: {args.name}")
    spark = session.get_spark(master=getattr(args, "master", None))
    if args.command == "check":
        print(json.dumps(session.check_environment(spark)))
        return 0
    if args.command == "preprocess":
        done = preprocess.run_folder(spark, args.folder, args.metadata, args.output, merge(json.loads(args.settings)))
        print(json.dumps({"made": done.made, "kept": [t for t in done.digests if t not in done.made]}))
        return 0
    result = catalog.QUERIES[args.name](spark, args.tables)
    if args.out:
        from .sources.tables import publish

        publish(result, args.out, force=args.force)
    else:
        result.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
