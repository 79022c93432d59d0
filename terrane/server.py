"""Extracts over HTTP: /south,west,north,east.pbf (or .vex, .txt)."""

from __future__ import annotations

from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .functions.tiles import parse_box
from .operators.extract import extract
from .operators.store import load, load_index
from .sources.files import suffix, write_to

PORT = 9002
USAGE = "Ask for /south,west,north,east.pbf (or .vex, .txt), in degrees.\n"


def serve(spark, path: str, port: int = PORT) -> ThreadingHTTPServer:
    """A server for a store; call serve_forever() on it. Each request plans one extract on the store as it is then."""

    class Handler(BaseHTTPRequestHandler):
        def _box(self):
            name = self.path.lstrip("/")
            fmt = suffix(name, ("pbf", "vex", "txt"))
            return parse_box(name[: -len(fmt) - 1]), fmt

        def _say(self, code: int, text: str = "") -> None:
            self.send_response(code)
            self.send_header("Content-Type", "text/plain" if text else "application/osm")
            self.end_headers()
            if self.command != "HEAD":
                self.wfile.write(text.encode())

        def do_HEAD(self):
            try:
                self._box()
            except ValueError:
                return self._say(400, USAGE)
            self._say(200)

        def do_GET(self):
            try:
                box, fmt = self._box()
            except ValueError:
                return self._say(400, USAGE)
            try:
                found = extract(load(spark, path), box, index=load_index(spark, path))
            except Exception as e:  # noqa: BLE001  told to the client
                return self._say(500, f"{type(e).__name__}\n")
            self.send_response(200)
            self.send_header("Content-Type", "application/osm")
            self.end_headers()
            write_to(found, fmt, self.wfile)

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer(("", port), Handler)
