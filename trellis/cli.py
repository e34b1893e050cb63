"""Command line: ingest, query, info, impact, trace, report, routes, drift, version."""

from __future__ import annotations

import argparse
import sys

import trellis
from trellis.engine import Engine
from trellis.plans import ingest
from trellis.session import local_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="trellis")
    sub = p.add_subparsers(dest="what", required=True)
    for name, args in {
        "ingest": ["root", "store"], "update": ["root", "store"], "query": ["store", "text"], "info": ["store"], "impact": ["store", "node"], "trace": ["store", "start", "end"], "explain": ["store", "node"],
        "report": ["store"], "communities": ["store"], "namespaces": ["store"], "drift": ["store"], "version": [],
    }.items():
        s = sub.add_parser(name)
        for a in args:
            s.add_argument(a)
        if name == "query":
            s.add_argument("--budget", type=int, default=4000)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.what == "version":
        print(trellis.__version__)
        return 0
    spark = local_session("*", "trellis")
    if a.what == "ingest":
        print("version", ingest.ingest(spark, a.root, a.store))
    elif a.what == "update":
        print("version %d, %d documents" % ingest.ingest_changes(spark, a.root, a.store))
    else:
        e = Engine.open(spark, a.store)
        if a.what == "trace":
            print(" -> ".join(e.trace(a.start, a.end) or ["no path"]))
        elif a.what == "report":
            print(e.report())
        else:
            shown = {"query": lambda: e.search(a.text, budget=a.budget), "info": e.info, "impact": lambda: e.impact(a.node), "explain": lambda: e.explain(a.node), "communities": lambda: e.communities(True), "namespaces": e.namespaces, "drift": e.drift}[a.what]
            shown().show(50, truncate=80)
    return 0


if __name__ == "__main__":
    sys.exit(main())
