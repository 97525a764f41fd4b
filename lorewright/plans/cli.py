"""Command line: init, compile, serve, version."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from lorewright import __version__
from lorewright.plans import config as cfg
from lorewright.plans import display


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("lorewright").config("spark.sql.session.timeZone", "UTC").config("spark.speculation", "false").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lorewright")
    p.add_argument("--config", default=str(Path.home() / ".lorewright" / "config.yaml"))
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("init", help="create a project folder")
    s.add_argument("name")
    for name, what in (("compile", "build the stores of a project"), ("serve", "answer requests")):
        s = sub.add_parser(name, help=what)
        s.add_argument("--dir", "-d", default=".")
        s.add_argument("--offline", action="store_true", help="use the deterministic stand-ins for models")
    s.add_argument("--agent", "-a", default="agent.yaml")
    s.add_argument("--port", "-p", type=int)
    sub.add_parser("version", help="print the version")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if args.command == "version":
            print(__version__)
        elif args.command == "init":
            from lorewright.sources.project import create_project

            print(*create_project(args.name, args.name), sep="\n")
        elif args.command == "compile":
            from lorewright.plans.engine import compile_folder

            told = compile_folder(session(), args.dir, cfg.load(args.config), offline=args.offline)
            display.say("done", f"{told['chunks']} chunks, {told['triples']} triples")
            if told["failed_batches"]:
                display.say("warning", f"{told['failed_batches']} batches failed: {'; '.join(told['errors'][:3])}")
        else:
            from lorewright.plans.engine import Engine
            from lorewright.plans.service import serve

            c = cfg.load(args.config)
            engine = Engine.open(session(), args.dir, c, args.agent, offline=args.offline)
            port = args.port or (engine.agent.get("server") or {}).get("port") or c.port
            display.banner(engine.name, {"version": __version__, "port": port, "vectors": engine.vectors.count(), "triples": engine.facts.count(), "chat": f"http://localhost:{port}/v1/chat/completions", "tools": f"http://localhost:{port}/mcp"})
            serve(engine, port).serve_forever()
    except (OSError, ValueError) as e:
        display.say("error", str(e))
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
