"""The command line: `python -m gazetteer.cli --workspace DIR COMMAND ...`."""

from __future__ import annotations

import argparse
import json
import sys

from .functions.shapes import parse_region
from .pipeline import Pipeline
from .presets import check_levels, check_quality, check_tags, check_template, count_text, resolve, size_text
from .query import Tables
from .service import run_query, serve
from .session import local_session
from .sources import extracts
from .workspace import Workspace, merge

STAGES = ("blob-chunks", "header", "data", "admin-levels", "house-numbers")
INDEXES = ("hierarchy", "user-friendly-name", "coordinates")


def _region(text: str) -> str:
    parse_region(text)
    return text


def _checked(check):
    """A check as an argument's type: its message reaches the user."""

    def run(raw: str):
        try:
            return check(raw)
        except ValueError as e:
            raise argparse.ArgumentTypeError(str(e)) from None

    return run


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gazetteer")
    p.add_argument("--workspace", default="./gazetteer-data", help="folder of tables")
    p.add_argument("--data", default="./gazetteer-data/files", help="folder of extract files")
    p.add_argument("--threads", default="*", help="local worker threads")
    p.add_argument("--preset", default=None)
    p.add_argument("--abort-on-any-error", action="store_true", help="stop where a file's checksum differs")
    commands = p.add_subparsers(dest="command", required=True)

    pbf = commands.add_parser("pbf").add_subparsers(dest="action", required=True)
    ls = pbf.add_parser("ls")
    ls.add_argument("--fresh", action="store_true")
    ls.add_argument("--local", action="store_true")
    pbf.add_parser("download").add_argument("region")

    extract = commands.add_parser("extract")
    extract.add_argument("stage", choices=STAGES)
    extract.add_argument("file", nargs="?")
    extract.add_argument("--include-tags", type=_checked(check_tags), default=[])
    extract.add_argument("--ignore-tags", type=_checked(check_tags), default=[])
    extract.add_argument("--levels", type=_checked(check_levels), default=None)
    extract.add_argument("--name-priority", type=_checked(check_tags), default=None)

    commands.add_parser("index").add_argument("what", nargs="*", default=[])
    commands.add_parser("optimize").add_argument("what", nargs="*", default=[])

    query = commands.add_parser("query")
    query.add_argument("input")
    query.add_argument("--friendly-name-format", type=_checked(check_template), default=None)
    query.add_argument("--min-quality", type=_checked(check_quality), default=None)
    query.add_argument("--bounding-wkt", type=_checked(_region), default=None)
    query.add_argument("--last-admin-levels", type=_checked(check_levels), default=None)
    query.add_argument("--include-wkt", choices=["true", "false"], default="true")

    commands.add_parser("build").add_argument("files", nargs="+")
    commands.add_parser("merge").add_argument("sources", nargs="+")
    server = commands.add_parser("http-server")
    server.add_argument("--host", default="127.0.0.1")
    server.add_argument("--port", type=int, default=8080)
    return p


def run(argv: list[str], spark=None, out=print) -> int:
    args = parser().parse_args(argv)
    spark = spark or local_session("gazetteer", args.threads)
    try:
        return _run(args, spark, out)
    except (ValueError, FileNotFoundError) as e:
        out(f"error: {e}")
        return 1


def _run(args, spark, out) -> int:
    ws = Workspace(spark, args.workspace, create=args.command not in ("query", "http-server"))
    preset = resolve(args.preset)

    def file_of(wanted: str | None) -> str:
        found = extracts.find_file(ws, wanted, args.data) if wanted else None
        if found is None:
            raise ValueError(f"no such extract: {wanted}")
        return found

    if args.command == "pbf":
        if args.action == "download":
            got = extracts.download_region(ws, args.region, args.data)
            out(f"{got.path} {size_text(got.size)} md5 {got.verdict}")
            return 1 if got.verdict == "mismatch" and args.abort_on_any_error else 0
        if args.local:
            for path, size in extracts.local_files(args.data):
                out(f"{path} {size_text(size)}")
        else:
            for r in extracts.list_regions(ws, args.fresh).toLocalIterator():
                out(f"{r.region_id}\t{r.region_name}\t{r.url}")
    elif args.command == "extract":
        if args.name_priority:
            from dataclasses import replace

            preset = replace(preset, name_priority=tuple(args.name_priority))
        p = Pipeline(ws, preset)
        if args.stage == "blob-chunks":
            out(f"{count_text(p.extract_chunks(file_of(args.file)))} blobs")
        elif args.stage == "header":
            out(json.dumps(p.extract_header(file_of(args.file)), default=str))
        elif args.stage == "data":
            out(json.dumps(p.extract_data(file_of(args.file), include=tuple(args.include_tags), ignore=tuple(args.ignore_tags))))
        elif args.stage == "admin-levels":
            out(f"{count_text(p.extract_admin_levels(args.levels))} areas")
        else:
            out(f"{count_text(p.extract_house_numbers())} house numbers")
    elif args.command == "index":
        if unknown := set(args.what) - set(INDEXES):
            raise ValueError(f"no such index: {', '.join(sorted(unknown))}")
        p = Pipeline(ws, preset)
        steps = {"hierarchy": p.index_hierarchy, "user-friendly-name": p.index_text, "coordinates": p.index_coordinates}
        for name in [n for n in INDEXES if n in (args.what or INDEXES)]:
            out(f"{name}: {count_text(steps[name]())}")
    elif args.command == "optimize":
        before, after = Pipeline(ws, preset).optimize(not args.what or "delete-intermediary-data" in args.what, not args.what or "compact" in args.what)
        out(f"{size_text(before)} -> {size_text(after)}")
    elif args.command == "query":
        tables = Tables.of(ws)
        if tables.index is None:
            raise ValueError("no text index; run index first")
        levels = tuple(args.last_admin_levels) if args.last_admin_levels is not None else None
        found = run_query(tables, args.input, template=args.friendly_name_format, min_quality=args.min_quality, region=args.bounding_wkt, levels=levels, include_wkt=args.include_wkt == "true")
        out(json.dumps(found, indent=2, ensure_ascii=False))
    elif args.command == "build":
        Pipeline(ws, preset).build([file_of(f) for f in args.files])
        out(f"built {args.workspace}: {size_text(ws.size())}")
    elif args.command == "merge":
        areas, houses = merge(ws, [Workspace(spark, s, create=False) for s in args.sources])
        out(f"{count_text(areas)} areas, {count_text(houses)} house numbers")
        Pipeline(ws, preset).index()
    elif args.command == "http-server":
        server = serve(ws, args.host, args.port)
        out(f"http://{args.host}:{args.port}")
        try:
            server.serve_forever()
        except KeyboardInterrupt:
            server.shutdown()
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
