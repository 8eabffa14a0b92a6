"""The command line: queries by name, one request, the catalogue, plans and health."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime

#: Commands, and the options that each of them takes.
OPTIONS = {
    "list": [],
    "run": ["name", "limit"],
    "explain": ["name"],
    "search": ["repository", "query", "limit", "cutoff", "branch"],
    "context": ["repository", "query", "budget", "cutoff", "format"],
    "catalogue": [],
    "counts": [],
    "constraints": [],
    "doctor": [],
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("palimpsest", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, options in OPTIONS.items():
        c = sub.add_parser(name)
        c.add_argument("folder", help="the folder of the tables")
        if "name" in options:
            c.add_argument("name")
        for o in ("repository", "query"):
            if o in options:
                c.add_argument(f"--{o}", required=True)
        if "limit" in options:
            c.add_argument("--limit", type=int, default=10)
        if "budget" in options:
            c.add_argument("--budget", type=int, default=30_000)
        if "cutoff" in options:
            c.add_argument("--cutoff", type=datetime.fromisoformat)
        if "branch" in options:
            c.add_argument("--branch", choices=["lexical", "structured", "dense"], default="lexical")
        if "format" in options:
            c.add_argument("--format", choices=["json", "text"], default="json")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    from . import sinks
    from .functions import vectors as vx
    from .operators import requests, search
    from .plans import catalog, registry, retrieval
    from .runtime import ship
    from .session import local
    from .sources.landed import health

    spark = local()
    ship(spark)
    queries = registry.queries()
    if a.command == "list":
        print("\n".join(sorted(queries)))
    elif a.command in ("run", "explain"):
        if a.name not in queries:
            print(f"no query {a.name}", file=sys.stderr)
            return 2
        df = queries[a.name](spark, a.folder)
        df.explain("formatted") if a.command == "explain" else df.show(a.limit, truncate=80)
    elif a.command in ("search", "context"):
        try:
            if a.command == "context":
                items = retrieval.agent_context(spark, a.folder, a.repository, a.query, a.budget, a.cutoff)
                out = sinks.pack_json(items) if a.format == "json" else sinks.pack_text(items)
                print("\n".join(r.pack for r in out.collect()))
            else:
                r = requests.normalised(a.repository, a.query, a.limit, a.cutoff)
                vector = [float(x) for x in vx.hash_embedding(r.query, catalog.DIMENSIONS)]
                q = spark.createDataFrame([("request", r.repository_id, r.query, r.cutoff, vector)], "query_id string, repository_id string, query string, cutoff timestamp, vector array<float>")
                rows = retrieval.rows(spark, a.folder)
                found = search.dense(q, rows, retrieval.embeddings(spark, a.folder), r.limit) if a.branch == "dense" else getattr(search, a.branch)(q, rows, r.limit)
                print(json.dumps([x.asDict() for x in found.orderBy("rank").collect()], indent=1))
        except requests.RequestError as e:
            print(e, file=sys.stderr)
            return 2
    else:
        name = {"catalogue": "ref_q8_catalogue", "counts": "ref_a2_counts", "constraints": "ref_c0_constraints"}.get(a.command)
        (queries[name](spark, a.folder) if name else health(spark)).show(100, truncate=60)
    return 0


if __name__ == "__main__":
    sys.exit(main())
