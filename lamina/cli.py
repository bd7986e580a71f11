"""Command line: python -m lamina.cli --data DIR COMMAND."""

from __future__ import annotations

import argparse
import json
import os
import signal
import sys

from lamina.functions.text import human_bytes
from lamina.session import build_session
from lamina.sources import backup, config


def _engine(args):
    from lamina.plans.tools import Engine

    return Engine(build_session("lamina", memory=args.memory), args.data, config.load(os.path.join(args.data, "config.toml")))


def _held(root: str) -> int | None:
    """Process id of a live writer of the store."""
    path = os.path.join(root, "semantic", "lock")
    if not os.path.exists(path):
        return None
    with open(path) as f:
        owner = int(f.read() or 0)
    return owner if owner and os.path.exists(f"/proc/{owner}") else None


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lamina", description=__doc__)
    parser.add_argument("--data", default=os.path.expanduser("~/.lamina"))
    parser.add_argument("--memory", default="2g")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("init", "run", "stats", "stop", "consolidate"):
        sub.add_parser(name)
    inspect = sub.add_parser("inspect")
    inspect.add_argument("id", nargs="?")
    inspect.add_argument("--query")
    export = sub.add_parser("export")
    export.add_argument("--format", choices=("json", "ndjson"), default="json")
    export.add_argument("--scope")
    export.add_argument("--limit", type=int, default=200)
    sub.add_parser("backup").add_argument("target")
    restore = sub.add_parser("restore")
    restore.add_argument("archive")
    restore.add_argument("--force", action="store_true")
    args = parser.parse_args(argv)
    show = lambda value: print(json.dumps(value, indent=2, ensure_ascii=False, default=str))

    if args.command == "init":
        backup.scaffold(args.data)
        return 0
    if args.command == "stop":
        owner = _held(args.data)
        if owner:
            os.kill(owner, signal.SIGTERM)
        return 0
    if args.command in ("backup", "restore"):
        if _held(args.data):
            print("the store is in use; stop it first", file=sys.stderr)
            return 1
        if args.command == "backup":
            backup.backup(args.data, args.target)
        else:
            backup.restore(args.archive, args.data, args.force)
        return 0

    engine = _engine(args)
    try:
        if args.command == "run":
            from lamina.plans.server import Server

            Server(engine).serve(sys.stdin, sys.stdout)
        elif args.command == "stats":
            show(engine.stats() | {"disk": human_bytes(backup.disk_bytes(args.data))})
        elif args.command == "consolidate":
            show(engine.consolidate())
        elif args.command == "inspect":
            if args.query:
                show(engine.recall(query=args.query, limit=5))
            else:
                items = engine.store.items().drop("embedding")
                row = items.where(items["id"] == args.id).first()
                show(row.asDict() if row else None)
                return 0 if row else 1
        else:
            found = engine.export(args.scope, args.limit)
            if args.format == "json":
                show(found)
            else:
                for layer, rows in found.items():
                    for row in rows:
                        print(json.dumps({"layer": layer} | row, ensure_ascii=False, default=str))
        return 0
    finally:
        engine.close()


if __name__ == "__main__":
    sys.exit(main())
