"""The running program: scan, watch, commit and serve together.

    python -m quern --directory DIR [--port 8080] [--extensions md,rs] [--config FILE] [--stdio]

Searches are answered from the last commit from the start on, while the first scan still runs.
"""

from __future__ import annotations

import argparse
import logging
import os
import threading

from pyspark.sql import SparkSession

from quern import config, serve
from quern.plans.index import IndexStore
from quern.session import local_session
from quern.sources import fileindex
from quern.streaming import changes, live

DRAIN_SECONDS = 10
log = logging.getLogger("quern.app")


class App:
    """Everything that runs for one directory."""

    def __init__(self, spark: SparkSession, conf: config.Config, quiet: float = live.QUIET):
        self.spark, self.conf = spark, conf
        self.store = IndexStore(spark, f"file://{os.path.abspath(conf.index_path)}")
        self.service = serve.Service(spark, self.store, conf)
        self.index_dir = os.path.dirname(os.path.abspath(conf.index_path))
        read = lambda paths: fileindex.read_paths(paths, conf.directory, conf.extensions, conf.max_bytes)
        listing = lambda: fileindex.list_tree(spark, conf.directory, conf.extensions, self.index_dir)
        self.indexer = live.Indexer(self.store, read, listing, quiet, batch_size=conf.batch_size, batch_ms=conf.batch_timeout_ms, on_commit=self.service.cache.clear)
        self.stopped, self.watching, self.scanned, self.query = threading.Event(), threading.Event(), threading.Event(), None
        self.server = serve.http_server(self.service, conf.bind, conf.port)
        self.threads: list[threading.Thread] = []

    def _spawn(self, run) -> None:
        self.threads.append(threading.Thread(target=run, daemon=True))
        self.threads[-1].start()

    def _scan(self) -> None:
        # Only what changes after the watcher's first look comes as an event.
        self.watching.wait(DRAIN_SECONDS)
        try:
            log.info("scanned %s: %s", self.conf.directory, self.indexer.rescan())
        finally:
            self.scanned.set()

    def _watch(self) -> None:
        """One start of the stream; ends when it is stopped, raises when it fails."""
        self.query = live.start(self.spark, self.conf.directory, self.indexer, f"file://{self.index_dir}/stream", f"{self.index_dir}/seen", self.conf.extensions, self.index_dir, self.conf.batch_timeout_ms)
        while self.query.isActive and not os.listdir(f"{self.index_dir}/seen") and not self.stopped.wait(0.05):
            pass
        self.watching.set()
        if self.stopped.is_set():
            self.query.stop()
        self.query.awaitTermination()

    def start(self, serving: bool = True) -> None:
        os.makedirs(f"{self.index_dir}/seen", exist_ok=True)
        self.serving = serving
        self.ticker = live.ticking(self.indexer, self.stopped)
        self._spawn(lambda: changes.supervise(self._watch, self.stopped.is_set))
        self._spawn(self._scan)
        if serving:
            self._spawn(self.server.serve_forever)

    def close(self) -> None:
        """Stop watching, wait a while for the scan, commit what waits, stop serving."""
        self.stopped.set()
        if self.query is not None:
            self.query.stop()
        self.scanned.wait(DRAIN_SECONDS)
        self.ticker.join()
        if self.serving:
            self.server.shutdown()
        self.server.server_close()


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser("quern", description="Search the documents of a directory.")
    p.add_argument("--config")
    p.add_argument("--directory")
    p.add_argument("--port", type=int)
    p.add_argument("--bind")
    p.add_argument("--index-path")
    p.add_argument("--extensions", type=lambda v: v.split(","))
    for name in ("max-file-size-mb", "batch-size", "batch-timeout-ms"):
        p.add_argument(f"--{name}", type=int)
    p.add_argument("--stdio", action="store_true", help="answer JSON-RPC on standard input instead of HTTP")
    given = vars(p.parse_args(arguments))
    stdio, file = given.pop("stdio"), given.pop("config")
    conf = config.load(file, **given)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(name)s %(message)s")
    app = App(local_session(), conf)
    app.start(serving=not stdio)
    try:
        if stdio:
            serve.stdio(app.service)
        else:
            log.info("serving %s on http://%s:%d", conf.directory, conf.bind, app.server.server_port)
            threading.Event().wait()
    except KeyboardInterrupt:
        pass
    finally:
        app.close()
        app.spark.stop()
