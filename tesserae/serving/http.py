"""An HTTP server over a database: POST /schema, /transact and /query."""

from __future__ import annotations

import json
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from itertools import chain

from tesserae.database import Database
from tesserae.errors import SerializationError
from tesserae.serving.requests import REFUSALS, QueryRequest, refusal, text_pieces
from tesserae.sources.schema import MANY, ONE, VALUE_TYPES

#: Bytes of a request's body; a larger transaction is a stream's or a DataFrame's.
MAX_BODY = 64 << 20
#: Characters of an answer that are sent at once.
_PIECE = 1 << 16


def _schema(db: Database, body: bytes) -> dict:
    """{"attributes": [{"ident", "value_type", "is_unique"?, "cardinality"?}]}: all are checked before the first is added."""
    try:
        wanted = [(a["ident"], a.get("value_type", "String"), a.get("is_unique", False), a.get("cardinality", ONE)) for a in json.loads(body)["attributes"]]
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise SerializationError(f"no schema: {e}") from e
    for ident, kind, unique, cardinality in wanted:
        if not isinstance(ident, str) or kind not in VALUE_TYPES or type(unique) is not bool or cardinality not in (ONE, MANY):
            raise SerializationError(f"no attribute: {ident!r} of {kind!r}, unique {unique!r}, {cardinality!r}")
    for ident, kind, unique, cardinality in wanted:
        db.add_attribute(ident, kind, unique, cardinality)
    return {"status": "success", "attributes_added": len(wanted)}


def _transact(db: Database, body: bytes, edn: bool) -> dict:
    try:
        text = body.decode()
    except UnicodeDecodeError as e:
        raise SerializationError(f"no UTF-8: {e}") from e
    report = db.transact(text) if edn else db.transact_json(text)
    return {"tx_id": report.tx_id, "timestamp": report.timestamp, "datoms_written": report.datoms_written}


class _Handler(BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.1"
    server: "Server"

    def log_message(self, *parts) -> None:
        pass

    def _answer(self, status: int, whole: dict) -> None:
        out = json.dumps(whole).encode()
        self.send_response(status)
        self.send_header("Content-Type", "application/json")
        self.send_header("Content-Length", str(len(out)))
        self.end_headers()
        self.wfile.write(out)

    def _stream(self, kind: str, pieces: Iterator[str]) -> None:
        """Chunks; the closing one is sent only after the last row, so a client can tell an answer that broke off."""
        self.send_response(200)
        self.send_header("Content-Type", kind)
        self.send_header("Transfer-Encoding", "chunked")
        self.end_headers()
        held, size = [], 0
        for piece in chain(pieces, [None]):
            if piece is not None:
                held.append(piece)
                size += len(piece)
            if held and (piece is None or size >= _PIECE):
                out = "".join(held).encode()
                self.wfile.write(b"%x\r\n%s\r\n" % (len(out), out))
                held, size = [], 0
        self.wfile.write(b"0\r\n\r\n")

    def do_POST(self) -> None:
        length = self.headers.get("Content-Length", "")
        if not length.isdigit() or int(length) > MAX_BODY:
            # The body is left unread, so the connection can't be used again.
            self.close_connection = True
            return self._answer(413 if length.isdigit() else 411, {"error": f"a body of known length, up to {MAX_BODY} bytes"})
        body, db = self.rfile.read(int(length)), self.server.db
        edn = "application/edn" in self.headers.get("Accept", "")
        try:
            if self.path == "/query":
                pieces = text_pieces(QueryRequest.from_json(body).frame(db), "edn" if edn else "json")
                pieces = chain([next(pieces)], pieces)
            elif self.path == "/transact":
                return self._answer(200, _transact(db, body, "application/edn" in self.headers.get("Content-Type", "")))
            elif self.path == "/schema":
                return self._answer(200, _schema(db, body))
            else:
                return self._answer(404, {"error": f"no {self.path}"})
        except REFUSALS as e:
            return self._answer(400, {"error": refusal(e)})
        try:
            self._stream("application/edn" if edn else "application/json", pieces)
        except (*REFUSALS, OSError):
            self.close_connection = True


class Server(ThreadingHTTPServer):
    """Serves until shutdown(). Reads run side by side; of transactions that race, the loser is refused with `Superseded` and can be sent again.

    There is no authentication, so it listens to this machine alone unless told otherwise.
    """

    daemon_threads = True

    def __init__(self, db: Database, host: str = "127.0.0.1", port: int = 3000):
        self.db = db
        super().__init__((host, port), _Handler)
