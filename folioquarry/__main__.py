"""Command line: ``python -m folioquarry watch [--once] [--force]`` and ``python -m folioquarry serve``."""

from __future__ import annotations

import argparse
import json
import logging
import signal
import threading
from dataclasses import replace
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from .config import Config, load_config
from .embed import preflight
from .plans import ingest
from .plans.api import Library
from .plans.store import Store
from .streaming import watch

log = logging.getLogger("folioquarry")


def open_library(spark: SparkSession, store: Store, config: Config) -> Library:
    """The tools over the store's current version; after a scan it is opened again."""
    return Library(spark, config, store.read("shelves"), store.read("documents").withColumnRenamed("id", "doc_id"), store.read("chunks"), f"{config.store.path}/requests")


def run_watcher(spark: SparkSession, config: Config, once: bool, force: bool) -> None:
    """One full pass, and unless ``once`` a watch over requests until SIGINT or SIGTERM."""
    store = Store(spark, config.store.path, config.store.buckets)
    ingest.sync_shelves(store, config)
    if once:
        log.info("%s", ingest.scan_all(spark, store, config, force))
        return
    feed = f"{config.store.path}/requests"
    watch.request(spark, feed, force=force)
    query = watch.watch(spark, feed, config, lambda name, forced: ingest.scan_shelf(spark, store, config.shelves[name], config, forced), f"{config.store.path}/watch-checkpoint")
    for number in (signal.SIGINT, signal.SIGTERM):
        signal.signal(number, lambda *_: threading.Thread(target=query.stop).start())
    watch.tick(spark, query, feed, config)


def make_server(config: Config, library) -> ThreadingHTTPServer:
    """``POST /tools/NAME`` with the arguments as JSON; ``library()`` gives the tools."""
    class Handler(BaseHTTPRequestHandler):
        def answer(self, code: int, body: dict) -> None:
            data = json.dumps(body, default=str, ensure_ascii=False).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self.answer(200, {"tools": list(Library.TOOLS)})

        def do_POST(self) -> None:
            name = self.path.removeprefix("/tools/")
            if name not in Library.TOOLS:
                return self.answer(404, {"error": f"no tool {name!r}"})
            try:
                given = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                self.answer(200, getattr(library(), name)(**given))
            except (ValueError, TypeError) as e:
                self.answer(400, {"error": str(e)})
            except Exception as e:
                log.exception("%s failed", name)
                self.answer(500, {"error": str(e)})

        def log_message(self, text: str, *args) -> None:
            log.debug(text, *args)

    return ThreadingHTTPServer((config.server.host, config.server.port), Handler)


def main(argv: list[str] | None = None) -> int:
    args = argparse.ArgumentParser("folioquarry")
    args.add_argument("--config")
    kinds = args.add_subparsers(dest="command", required=True)
    watcher = kinds.add_parser("watch")
    watcher.add_argument("--once", action="store_true")
    watcher.add_argument("--force", action="store_true")
    server = kinds.add_parser("serve")
    server.add_argument("--host")
    server.add_argument("--port", type=int)
    given = args.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    config = load_config(given.config)
    config = replace(config, embedding=preflight(config.embedding))
    spark = SparkSession.builder.appName("folioquarry").getOrCreate()
    if given.command == "watch":
        run_watcher(spark, config, given.once, given.force)
        return 0
    place = {k: v for k, v in (("host", given.host), ("port", given.port)) if v is not None}
    store = Store(spark, config.store.path, config.store.buckets)
    http = make_server(replace(config, server=replace(config.server, **place)), lambda: open_library(spark, store, config))
    for number in (signal.SIGINT, signal.SIGTERM):
        signal.signal(number, lambda *_: threading.Thread(target=http.shutdown).start())
    http.serve_forever()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
