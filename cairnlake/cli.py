"""Commands over a saved catalog; a thin layer that parses arguments and prints DataFrames."""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.catalog import Catalog
from cairnlake.operators import ingest, manifest, policy, reconcile, reports, scope
from cairnlake.sources import enrich, files


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="cairnlake")
    out.add_argument("--db", required=True, help="folder of the catalog's snapshots")
    out.add_argument("--explain", action="store_true", help="print plans before they run, and the seconds they took")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, *flags: str, path: bool = True) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        if path:
            p.add_argument("path", nargs="?")
        p.add_argument("--where", action="append", default=[])
        for flag in flags:
            p.add_argument(flag, action="store_true")
        return p

    p = commands.add_parser("scan")
    p.add_argument("paths", nargs="+")
    p.add_argument("--role", choices=("source", "archive"), help="of a new root, source if not given")
    p.add_argument("--add", action="store_true")
    command("worklist", "--include-archived", "--include-excluded")
    one = command("ls", "--include-archived", "--include-excluded").add_mutually_exclusive_group()
    one.add_argument("--archived", nargs="?", const="archived", choices=("archived", "show"))
    one.add_argument("--unarchived", action="store_true")
    one.add_argument("--unhashed", action="store_true")
    p = command("facts", "--all", "--include-archived", "--include-excluded", path=False)
    p.add_argument("arguments", nargs="*")
    p.add_argument("--limit", type=int, default=reports.DEFAULT_LIMIT)
    p = command("facts-delete", "--yes", path=False)
    p.add_argument("key")
    p.add_argument("path", nargs="?")
    p.add_argument("--on", choices=("source", "object"), required=True)
    p = commands.add_parser("facts-prune")
    p.add_argument("--stale", action="store_true", required=True)
    p.add_argument("--yes", action="store_true")
    p = command("coverage", "--include-archived", "--include-excluded", "--included-only")
    p.add_argument("--archive")
    for name in ("exclude-set", "exclude-clear"):
        command(name, "--dry-run")
    command("exclude-list")
    p = command("cluster", "--include-archived", "--show-archived", path=False)
    p.add_argument("--dest", required=True)
    p.add_argument("--pattern", default="{filename}")
    p.add_argument("-o", "--output", required=True)
    p = commands.add_parser("apply")
    p.add_argument("manifest")
    p.add_argument("--root", action="append", default=[])
    for flag in ("--dry-run", "--allow-cross-archive-duplicates", "--yes"):
        p.add_argument(flag, action="store_true")
    one = p.add_mutually_exclusive_group()
    one.add_argument("--rename", action="store_true")
    one.add_argument("--move", action="store_true")
    p = commands.add_parser("import-facts")
    p.add_argument("lines", help="file or folder of JSON lines, - for standard input")
    p.add_argument("--allow-archived", action="store_true")
    p = commands.add_parser("process", help="run a program for each work-list line and add its facts to the line")
    p.add_argument("--lines", default="-", help="file or folder of JSON lines, - for standard input")
    one = p.add_mutually_exclusive_group(required=True)
    one.add_argument("--fact", metavar="KEY")
    one.add_argument("--kv", action="store_true")
    one.add_argument("--json", action="store_true")
    p.add_argument("program", nargs=argparse.REMAINDER, help="the program and its arguments; {} is the path")
    return out


def _latest(db: str) -> str | None:
    found = sorted(n for n in (os.listdir(db) if os.path.isdir(db) else ()) if n.startswith("snapshot-") and os.path.isdir(f"{db}/{n}/roots"))
    return f"{db}/{found[-1]}" if found else None


def _shown(df: DataFrame, explain: bool, widths: tuple[int, ...] | None = None) -> None:
    """Print the rows: tab-separated, or as a table with headings where ``widths`` are given."""
    started = time.monotonic()
    if explain:
        df.explain("formatted")
    if widths:
        print(reports.table_text(df, widths))
    else:
        for row in df.toLocalIterator():
            print("\t".join("" if v is None else str(v) for v in row))
    if explain:
        print(f"{time.monotonic() - started:.3f} s", file=sys.stderr)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of a path, or of standard input, which the driver reads."""
    if path != "-":
        return files.read_lines(spark, path)
    return spark.createDataFrame(list(enumerate(sys.stdin.read().splitlines())), "ln long, line string")


def _scan(spark: SparkSession, cat: Catalog, path: str, role: str | None, add: bool, show) -> Catalog:
    root = scope.root_of(cat, path)
    if root is not None and add:
        raise SystemExit(f"{path} is already in the {root['role']} root {root['path']}; scan it without --add")
    if root is not None and root["path"] == path and root["role"] != (role or root["role"]):
        raise SystemExit(f"{path} is a root with the role {root['role']}, not {role}")
    if root is None:
        if not add:
            raise SystemExit(f"{path} is in no root; --add makes it one")
        cat = reconcile.add_root(cat, path, role or "source")
        root = scope.root_of(cat, path)
    prefix, unread = path[len(root["path"]) :].strip("/"), []
    done = reconcile.scan(cat, files.listing(spark, root["id"], root["path"], prefix, unread), [root["id"]], prefix or None)
    show(done.counters)
    for error in unread:
        print(f"warning: not read: {error}", file=sys.stderr)
    return done.catalog


def _ls_footer(cat: Catalog, listed: DataFrame, where: list[str], path: str | None, state: str | None, keep: dict) -> str:
    hidden = scope.ls_footer(cat, where, path, keep["include_archived"]).first()
    parts = [f"{hidden['excluded']} excluded hidden"] if hidden["excluded"] and not keep["include_excluded"] else []
    parts += [f"{hidden['unhashed']} unhashed skipped, use --unhashed to see"] if hidden["unhashed"] and state in ("archived", "show", "unarchived") else []
    return f"{scope.ls_sources(listed).first()['sources']} sources" + (f" ({', '.join(parts)})" if parts else "")


KEY_WIDTHS, VALUE_WIDTHS = (40, 12, 8, 8), (40, 12, 8)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("cairnlake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    at = _latest(args.db)
    cat, after = Catalog.load(spark, at) if at else Catalog.empty(spark), None
    where, path = getattr(args, "where", []), getattr(args, "path", None)
    path = os.path.abspath(path) if path else None
    keep = {k: getattr(args, k) for k in ("include_archived", "include_excluded") if hasattr(args, k)}
    show = lambda df, widths=None: _shown(df, args.explain, widths)
    if args.command == "scan":
        after = cat
        for p in map(os.path.realpath, args.paths):
            after = _scan(spark, after, p, args.role, args.add, show)
        if len(args.paths) > 1:
            print(f"{len(args.paths)} paths scanned, {after.sources.where('present = 1').count()} sources present")
    elif args.command == "process":
        mode = "fact" if args.fact else "kv" if args.kv else "json"
        lines, errors = enrich.processed(_lines(spark, args.lines), [w for w in args.program if w != "--"], mode, args.fact)
        show(lines)
        for row in errors.toLocalIterator():
            print(f"warning: {row['path']}: {row['error']}", file=sys.stderr)
    elif args.command == "worklist":
        show(files.json_lines(scope.worklist(cat, where, path, **keep)))
    elif args.command == "ls":
        state = args.archived or ("unarchived" if args.unarchived else "unhashed" if args.unhashed else None)
        here = scope.root_of(cat, os.getcwd()) if path is None else None
        below = path or (os.getcwd() if here else None)
        listed = scope.ls(cat, where, below, state, **keep)
        show(files.path_lines(files.relative_paths(listed, os.getcwd())))
        print(_ls_footer(cat, listed, where, below, state, keep), file=sys.stderr)
    elif args.command == "facts":
        key = next((a for a in args.arguments if not scope.looks_like_path(a)), None)
        below = next((os.path.abspath(a) for a in args.arguments if scope.looks_like_path(a)), None)
        if key:
            show(reports.fact_values(cat, key, args.limit, where, below, **keep), VALUE_WIDTHS)
        else:
            show(reports.fact_keys(cat, where, below, **keep, hidden=args.all), KEY_WIDTHS)
    elif args.command == "facts-delete":
        show(policy.delete_preview(cat, args.key, args.on, where, path))
        after = policy.delete_facts(cat, args.key, args.on, where, path) if args.yes else None
    elif args.command == "facts-prune":
        show(policy.prune_preview(cat))
        after = policy.prune_stale(cat) if args.yes else None
    elif args.command == "coverage":
        out = reports.coverage(cat, where, path, args.archive, args.include_archived, included_only=args.included_only, by_root=path is None)
        out = out if args.include_excluded else out.drop("excluded", "excluded_pct")
        show(out, tuple(40 if c == "path" else 12 for c in out.columns))
    elif args.command == "exclude-set":
        show(policy.exclude_preview(cat, where, path))
        after = None if args.dry_run else policy.exclude_set(cat, where, path)
    elif args.command in ("exclude-list", "exclude-clear"):
        show(policy.exclude_list(cat, where, path))
        after = policy.exclude_clear(cat, where, path) if args.command == "exclude-clear" and not args.dry_run else None
    elif args.command == "cluster":
        made = manifest.generate(cat, where, os.path.abspath(args.dest), args.pattern, args.include_archived)
        files.write_manifest(made, args.output, time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()))
        if args.show_archived:
            show(made.archived)
    elif args.command == "apply":
        if args.move and not args.yes:
            raise SystemExit("--move needs --yes")
        made = files.read_manifest(spark, args.manifest)
        plan = manifest.plan_apply(cat, made, args.root)
        mode = "rename" if args.rename else "move" if args.move else "copy"
        after, counts = files.execute(cat, plan, made.archive_root_id, mode, args.dry_run, args.allow_cross_archive_duplicates)
        print(counts)
        after = None if args.dry_run else after
    else:
        done = ingest.import_facts(cat, _lines(spark, args.lines), args.allow_archived)
        show(done.counters.select(F.to_json(F.struct("*"))))
        after = done.catalog
    if after is not None:
        after.save(f"{args.db}/snapshot-{time.time_ns():020d}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
