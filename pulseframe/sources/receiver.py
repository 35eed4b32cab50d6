"""A receiver for pushed line protocol: bodies that are POSTed land as files, which a file stream follows.

Landing first makes the push source replayable: a restarted query reads from
its checkpoint, and the pusher gets its answer only once the body is on disk.
"""

from __future__ import annotations

import os
import threading
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession

from pulseframe.sources.datatypes import Datatype
from pulseframe.sources.files import line_measurements, lines


class Receiver:
    """Listens on a port (0: any free one) while it is open; every body becomes one file in the folder."""

    def __init__(self, folder: str, host: str = "127.0.0.1", port: int = 0):
        os.makedirs(folder, exist_ok=True)

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                body = self.rfile.read(int(self.headers.get("Content-Length", 0)))
                name = uuid.uuid4().hex
                with open(f"{folder}/.{name}", "wb") as f:
                    f.write(body)
                os.rename(f"{folder}/.{name}", f"{folder}/{name}.lines")  # seen whole or not at all
                self.send_response(204)
                self.end_headers()

            def log_message(self, *_):
                pass

        self._server = ThreadingHTTPServer((host, port), Handler)
        self.port = self._server.server_address[1]

    def __enter__(self) -> Receiver:
        threading.Thread(target=self._server.serve_forever, daemon=True).start()
        return self

    def __exit__(self, *_) -> None:
        self._server.shutdown()
        self._server.server_close()


def pushed(spark: SparkSession, folder: str, kind: Datatype) -> DataFrame:
    """The measurements of a type among what a receiver lands, as a stream."""
    return line_measurements(lines(spark, folder, "*.lines", stream=True), kind)


def pushed_socket(spark: SparkSession, host: str, port: int, kind: Datatype) -> DataFrame:
    """The same from a plain socket of lines; for trials, since a socket can't be read again."""
    return line_measurements(spark.readStream.format("socket").option("host", host).option("port", port).load(), kind)
