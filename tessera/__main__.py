"""``python -m tessera build STORE PATH...``, ``query STORE [JSON]``, ``worker STORE [N]``."""

from __future__ import annotations

import argparse
import asyncio
import json
import os
import sys

from pyspark.sql import SparkSession

from .plans.engine import Engine
from .service import Service
from .sources.ntriples import is_source
from .sources.store import TripleStore


def sources(path: str) -> list[str]:
    """A file, or the N-Triples and TriG files of a directory."""
    return sorted(os.path.join(path, n) for n in os.listdir(path) if is_source(n)) if os.path.isdir(path) else [path]


async def _serve(service: Service) -> None:
    """A request a line in, an answer a line out, in the order they finish."""

    async def one(line: str) -> None:
        try:
            r = json.loads(line)
            action = r.pop("action", "query")
            answer = await (service.query_async(r) if action == "query" else service.insert_async(r["data"]) if action == "insert" else service.delete_async(r["data"], r.get("are_hashes", False)))
        except Exception as e:
            answer = {"error": f"{type(e).__name__}: {e}"}
        print(json.dumps(answer), flush=True)

    loop, tasks = asyncio.get_running_loop(), set()
    while line := await loop.run_in_executor(None, sys.stdin.readline):
        if line.strip():
            t = asyncio.create_task(one(line))
            tasks.add(t)
            t.add_done_callback(tasks.discard)
    await asyncio.gather(*tasks)


def main(argv: list[str] | None = None) -> None:
    a = argparse.ArgumentParser(prog="tessera", description=__doc__)
    a.add_argument("action", choices=["build", "query", "worker"])
    a.add_argument("store")
    a.add_argument("rest", nargs="*")
    x = a.parse_args(argv)
    spark = SparkSession.builder.appName("tessera").config("spark.scheduler.mode", "FAIR").getOrCreate()
    store = TripleStore(spark, x.store)
    if x.action == "build":
        print(json.dumps(store.build([p for r in x.rest for p in sources(r)])))
    elif x.action == "query":
        print(json.dumps(Engine(store.graph(), store.config, index=store.index()).query(json.loads(x.rest[0] if x.rest else sys.stdin.read()))))
    else:
        service = Service(store, int(x.rest[0]) if x.rest else 4)
        asyncio.run(_serve(service))
        service.close()


if __name__ == "__main__":
    main()
