"""Asynchronous requests over one session: queries run side by side, writes one after another."""

from __future__ import annotations

import asyncio
import hashlib
import json
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from .config import EngineConfig
from .plans.engine import Engine
from .sources.store import TripleStore


class TimeoutError(Exception):  # noqa: A001
    """A request took too long."""


class Service:
    """``workers`` threads serve queries; answers are cached by request and store version."""

    def __init__(self, store: TripleStore, workers: int = 4, config: EngineConfig | None = None, make_engine: Callable[[TripleStore], Engine] | None = None) -> None:
        self.store, self.config = store, config or store.config
        self._readers = ThreadPoolExecutor(workers, "tessera-query")
        self._writer = ThreadPoolExecutor(1, "tessera-write")
        self._cache: dict[str, tuple[float, dict]] = {}
        self._make = make_engine or (lambda s: Engine(s.graph(), s.config, index=s.index()))

    def _query(self, opts: dict, asked: float) -> dict:
        began = time.time()
        wanted = {k: v for k, v in opts.items() if k != "use_cache"}
        key = hashlib.md5(json.dumps([self.store.version(), wanted], sort_keys=True).encode()).hexdigest()
        hit = self._cache.get(key)
        if opts.get("use_cache", True) and hit and began - hit[0] < self.config.cache_ttl_s:
            return hit[1] | {"cached": True, "waited_s": began - asked, "took_s": time.time() - began}
        self.store.spark.sparkContext.setLocalProperty("spark.scheduler.pool", "queries")
        try:
            answer = self._make(self.store).query(wanted)
        except Exception as e:  # an error is an answer; the worker lives on
            return {"error": f"{type(e).__name__}: {e}"[:2000], "waited_s": began - asked, "took_s": time.time() - began}
        self._cache = {k: v for k, v in self._cache.items() if began - v[0] < self.config.cache_ttl_s} | {key: (began, answer)}
        return answer | {"cached": False, "waited_s": began - asked, "took_s": time.time() - began}

    async def _run(self, pool: ThreadPoolExecutor, call: Callable[[], dict], timeout: float | None) -> dict:
        try:
            return await asyncio.wait_for(asyncio.get_running_loop().run_in_executor(pool, call), timeout or self.config.async_timeout_s)
        except asyncio.TimeoutError:
            raise TimeoutError("the request took too long") from None

    async def query_async(self, opts: dict, timeout: float | None = None) -> dict:
        asked = time.time()
        return await self._run(self._readers, lambda: self._query(opts, asked), timeout)

    async def insert_async(self, data: list[dict], timeout: float | None = None) -> dict:
        return await self._run(self._writer, lambda: self.store.insert(data), timeout)

    async def delete_async(self, data: list[dict], are_hashes: bool = False, timeout: float | None = None) -> dict:
        return await self._run(self._writer, lambda: self.store.delete(data, are_hashes), timeout)

    def close(self) -> None:
        self._readers.shutdown()
        self._writer.shutdown()
