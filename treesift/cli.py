"""`python -m treesift.cli QUERY... --snapshot FOLDER`: a search from the command line.

With `--socket` a running server is asked, which needs no session here; if there is none, the snapshot is searched.
With `--serve` it becomes that server.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from . import server
from .api import MODES, SORTS, Engine
from .operators.ingest import ingest
from .sources import snapshot
from .sources.listing import crawl


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="treesift", description="Search files by name, path and attributes.")
    p.add_argument("query", nargs="*", help="terms and filters; several arguments are joined by spaces")
    where = p.add_mutually_exclusive_group()
    where.add_argument("--snapshot", help="folder of a snapshot to search")
    where.add_argument("--crawl", help="folder to crawl and search")
    p.add_argument("--socket", help="ask the server at this path first")
    p.add_argument("--serve", help="answer requests at this path until stopped")
    p.add_argument("--mode", default="exact", choices=sorted(MODES))
    p.add_argument("--path", action="store_true", help="compare terms with whole paths")
    p.add_argument("--sort", default="name", choices=sorted(SORTS))
    order = p.add_mutually_exclusive_group()
    order.add_argument("--asc", action="store_true", default=None)
    order.add_argument("--desc", dest="asc", action="store_false")
    p.add_argument("-n", "--limit", type=int)
    p.add_argument("--in", dest="root", help="only below this folder")
    p.add_argument("--folders-first", action="store_true")
    p.add_argument("--no-hidden", action="store_true")
    p.add_argument("--count", action="store_true", help="print the number of matches only")
    p.add_argument("--json", action="store_true", help="print the response")
    p.add_argument("-0", dest="null", action="store_true", help="end paths with a NUL")
    return p.parse_args(argv)


def request(a: argparse.Namespace) -> dict:
    return {
        "v": 1, "q": " ".join(a.query), "mode": a.mode, "scope": "path" if a.path else "name", "sort": a.sort, "asc": a.asc, "limit": a.limit, "scopeRoot": a.root,
        "foldersFirst": a.folders_first, "hideHidden": a.no_hidden, "countOnly": a.count, "fields": ["path", "size"] if a.json else ["path"],
    }


def render(a: argparse.Namespace, response: dict) -> str:
    if a.json:
        return json.dumps(response, ensure_ascii=False) + "\n"
    if a.count:
        return f"{response['total']}\n"
    end = "\0" if a.null else "\n"
    return "".join(p + end for p in response["paths"])


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    a, out = arguments(sys.argv[1:] if argv is None else argv), out or sys.stdout
    response = server.ask(a.socket, request(a)) if a.socket else None
    if response is None:
        spark = spark or SparkSession.builder.appName("treesift").getOrCreate()
        try:
            entries = snapshot.load(spark, a.snapshot) if a.snapshot else ingest(crawl(spark, a.crawl or "."))
        except snapshot.SnapshotError as e:
            print(e, file=sys.stderr)
            return 1
        if a.serve:
            server.Server(Engine(entries.persist()), a.serve).serve_forever()
            return 0
        response = Engine(entries).handle(request(a))
    if not response["ok"]:
        print(response["error"]["msg"], file=sys.stderr)
        return 2
    out.write(render(a, response))
    return 0


if __name__ == "__main__":
    sys.exit(main())
