"""Command line: python -m tripleloom.cli --path DIR COMMAND ..."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys

from pyspark.sql import SparkSession

from tripleloom.clients import CommandClient, load_env
from tripleloom.engine import Engine
from tripleloom.serve import App, server


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tripleloom")
    p.add_argument("--path", required=True, help="folder of the graph")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("ingest")
    i.add_argument("source")
    i.add_argument("--adapter", default="universal", choices=["universal", "vault"])
    i.add_argument("--strict", action="store_true")
    i.add_argument("--dry-run", action="store_true")
    i.add_argument("--max-facts", type=int)
    sub.add_parser("stats")
    sub.add_parser("embed")
    sub.add_parser("community")
    r = sub.add_parser("resolve")
    r.add_argument("--threshold", type=float, default=0.85)
    v = sub.add_parser("provenance")
    v.add_argument("entity")
    v.add_argument("--limit", type=int, default=1000, help="triples shown at most; 0 is all")
    n = sub.add_parser("aliases")
    n.add_argument("entity")
    g = sub.add_parser("purge")
    g.add_argument("layer")
    sub.add_parser("compact")
    s = sub.add_parser("similar")
    s.add_argument("entity")
    s.add_argument("-k", type=int, default=10)
    s.add_argument("--kind")
    w = sub.add_parser("path")
    w.add_argument("start")
    w.add_argument("end")
    q = sub.add_parser("query")
    q.add_argument("question")
    q.add_argument("--mode", default="local", choices=["local", "global", "drift"])
    q.add_argument("--hops", type=int, default=2)
    x = sub.add_parser("extract")
    x.add_argument("source")
    x.add_argument("--command", dest="client", nargs="+", required=True, help="command that answers a prompt on its standard input")
    v = sub.add_parser("serve")
    v.add_argument("--host", default="127.0.0.1")
    v.add_argument("--port", type=int, default=8000)
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    e = Engine(spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate(), a.path)
    if a.command == "serve":
        env = load_env(".env", dict(os.environ))
        app = App(e, env.get("TRIPLELOOM_API_KEY"), int(env.get("TRIPLELOOM_RATE_LIMIT") or 0))
        logging.basicConfig(level=logging.INFO, format="%(message)s")
        server(app, a.host, a.port).serve_forever()
    if a.command in ("ingest", "extract"):
        if a.command == "extract":
            r = e.ingest(a.source, "llm", client=CommandClient(tuple(a.client)))
        else:
            r = e.ingest(a.source, a.adapter, a.dry_run, a.strict, a.max_facts)
        print(r.summary())
        return 0
    out = {
        "stats": lambda: e.stats(),
        "embed": lambda: e.embed(),
        "community": lambda: e.communities(),
        "resolve": lambda: e.resolve(a.threshold),
        "provenance": lambda: [r.asDict() for r in (e.provenance(a.entity).limit(a.limit) if a.limit else e.provenance(a.entity)).collect()],
        "aliases": lambda: e.aliases_for(a.entity),
        "purge": lambda: {"deleted": e.store.purge(a.layer)},
        "compact": lambda: e.store.compact() or {"batches": len(e.store.batches())},
        "similar": lambda: [r.asDict() for r in e.similar(a.entity, a.k, a.kind).collect()],
        "path": lambda: e.path_between(a.start, a.end),
        "query": lambda: e.ask(a.question, a.mode, a.hops),
    }[a.command]()
    print(json.dumps(out, default=str, ensure_ascii=False, indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
