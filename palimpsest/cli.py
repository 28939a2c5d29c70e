"""Command line: ``python -m palimpsest.cli --store DIR COMMAND``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.engine import Engine
from palimpsest.functions.names import show_kind, show_time
from palimpsest.operators.checkout import Policy
from palimpsest.plans.scope import Rect, Scope, parse_area, selection
from palimpsest.store import Store


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="palimpsest")
    top.add_argument("--store", default=".palimpsest")
    top.add_argument("--json", action="store_true", help="one JSON document instead of text")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, *arguments: str, select: bool = False) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for a in arguments:
            p.add_argument(a)
        if select:
            for option in ("--in", "--region", "--kind", "--scope"):
                p.add_argument(option, action="append", default=[], dest=option[2:] + "_")
        return p

    add("init")
    add("commit", "world", select=True).add_argument("--no-cache", action="store_true")
    add("status", "world", select=True)
    out = add("checkout", "world", "commit", select=True)
    for flag in ("keep-post-commit-files", "keep-post-commit-chunks", "keep-tombstoned-chunks"):
        out.add_argument(f"--{flag}", action="store_true")
    out.add_argument("--on-missing-blob", choices=("abort", "skip"), default="abort")
    out.add_argument("--on-missing-file", choices=("sibling", "derived", "error"), default="sibling")
    add("log").add_argument("--stat", action="store_true")
    d = add("diff", select=True)
    d.add_argument("--old")
    d.add_argument("--new")
    d.add_argument("--world")
    d.add_argument("--chunk", action="append", default=[], help="DIM:X,Z: compare these chunks only, whether there or not")
    add("verify")
    r = add("ref")
    r.add_argument("action", choices=("list", "create", "delete", "activate"))
    r.add_argument("name", nargs="?")
    r.add_argument("commit", nargs="?")
    r.add_argument("--force", action="store_true")
    s = add("scope")
    s.add_argument("action", choices=("list", "create", "delete"))
    s.add_argument("name", nargs="?")
    s.add_argument("areas", nargs="*")
    s.add_argument("--force", action="store_true")
    c = add("cache")
    c.add_argument("action", choices=("update", "clean"))
    c.add_argument("world", nargs="?")
    return top


def rows(frame: DataFrame) -> list[dict]:
    """Rows as JSON objects, nulls shown."""
    shown = frame.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))
    return [json.loads(r[0]) for r in shown.toLocalIterator()]


def scope_of(args: argparse.Namespace, store: Store) -> Scope:
    return selection(args.in_, args.region_, args.kind_, [store.resolve_scope(n) for n in args.scope_])


def run(spark: SparkSession, args: argparse.Namespace) -> object:
    """The result of a command, as what JSON can show."""
    if args.command == "init":
        Store.init(spark, args.store)
        return {"store": args.store}
    store = Store(spark, args.store)
    engine = Engine(store)
    match args.command:
        case "commit":
            done = engine.commit(args.world, scope_of(args, store))
            if not args.no_cache:
                engine.update_cache(args.world)
            return done
        case "status":
            return engine.status(args.world, scope_of(args, store))
        case "checkout":
            names = ("keep_post_commit_files", "keep_post_commit_chunks", "keep_tombstoned_chunks", "on_missing_blob", "on_missing_file")
            policy = Policy(**{n: getattr(args, n) for n in names})
            return engine.checkout(args.world, store.resolve(args.commit), policy, scope_of(args, store))
        case "log":
            return rows(engine.log(args.stat).withColumn("time", show_time(F.col("created_at_ms"))))
        case "diff":
            scope = scope_of(args, store)
            named = [(a.dim, kind, x, z) for a in map(parse_area, args.chunk) for x, z in a.chunks or () for kind in sorted(scope.kinds or (0,))]
            keys = spark.createDataFrame(named, "dim int, kind int, x int, z int") if named else None
            if args.world:
                found = engine.diff_world(args.world, store.resolve(args.old) if args.old else None, scope, keys=keys)
            else:
                new = store.resolve(args.new) if args.new else store.active().commit_id
                found = engine.diff_commits(store.resolve(args.old) if args.old else None, new, scope, keys=keys)
            return rows(found.orderBy("dim", "kind", "x", "z").withColumn("kind", show_kind(F.col("kind"))))
        case "verify":
            return rows(engine.verify())
        case "ref":
            if args.action == "list":
                return [vars(r) for r in store.refs()]
            if args.action == "create":
                return vars(store.create_ref(args.name, store.resolve(args.commit) if args.commit else None, args.force))
            return {"deleted": store.delete_ref(args.name)} if args.action == "delete" else vars(store.activate_ref(args.name))
        case "scope":
            if args.action == "create":
                areas = [parse_area(a) for a in args.areas]
                everywhere = Rect(-(1 << 31), -(1 << 31), (1 << 31) - 1, (1 << 31) - 1)
                places = [(a.dim, a.rect or next((Rect(x, z, x, z) for x, z in a.chunks or ()), everywhere)) for a in areas]
                store.create_scope(args.name, places, args.force)
            elif args.action == "delete":
                return {"deleted": store.delete_scope(args.name)}
            return [{"name": n, "areas": [[d, *vars(r).values()] for d, r in a], "created_at_ms": t} for n, a, t in store.scopes()]
        case _:
            return engine.update_cache(args.world) if args.action == "update" else {"removed": engine.clean_cache()}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0: done; 1: failed; 2 (by argparse): a command that cannot be read."""
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("palimpsest").getOrCreate()
    try:
        result, code = {"ok": True, "command": args.command, "data": run(spark, args)}, 0
    except Exception as e:
        result, code = {"ok": False, "command": args.command, "error": str(e).splitlines()[0] if str(e) else type(e).__name__}, 1
    if args.json:
        print(json.dumps(result, default=str))
    elif code:
        print(f"error: {result['error']}", file=sys.stderr)
    else:
        data = result["data"]
        for line in data if isinstance(data, list) else [data]:
            print("  ".join(f"{k}={v}" for k, v in line.items()))
    return code


if __name__ == "__main__":
    sys.exit(main())
