"""Command line: python -m tesserae --path DIR query|transact|schema|compact|vacuum|serve|shell."""

from __future__ import annotations

import argparse
import json
import sys
import threading
from collections.abc import Iterable
from pathlib import Path
from typing import TextIO

from pyspark.sql import SparkSession

from tesserae.config import Settings
from tesserae.database import Database
from tesserae.serving.requests import REFUSALS, QueryRequest, refusal, text_pieces

HELP = """A query ([:find ...]) or a transaction ([[:db/add ...] ...]), over as many lines as its brackets take; or
.schema    the attributes
.asof N    queries read what holds at N microseconds; without N, now
.history   queries read all that was ever written, or no longer
.format F  json, edn or table
.compact   folds transactions into the compacted part
.quit      ends"""


def open_brackets(text: str) -> int:
    """Brackets that text opens and doesn't close, those in strings and comments left out; an open string counts as one."""
    depth, quoted, skip, comment = 0, False, False, False
    for c in text:
        if comment:
            comment = c != "\n"
        elif skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == "\\":
            skip = True
        elif c in '";':
            quoted, comment = c == '"', c == ";"
        else:
            depth += (c in "([{") - (c in ")]}")
    return depth + quoted


def is_query(text: str) -> bool:
    return text.lstrip().removeprefix("[").lstrip().startswith(":find")


def show(db: Database, request: QueryRequest, form: str, out: TextIO) -> None:
    df = request.frame(db)
    if form == "table":
        # Spark's table, of the first rows: all of them are in the other forms.
        print(df._show_string(100, False), file=out, end="")
        return
    for piece in text_pieces(df, form):
        out.write(piece)
    out.write("\n")


def show_schema(db: Database, out: TextIO) -> None:
    for a in sorted(db.store.manifest().catalog.at().values(), key=lambda a: a.ident):
        print(f"{a.ident} {a.value_type} {a.cardinality}{' unique' if a.unique else ''}", file=out)


def run_transaction(db: Database, text: str, out: TextIO) -> None:
    r = db.transact_json(text) if text.lstrip().startswith("{") else db.transact(text)
    print(json.dumps({"tx_id": r.tx_id, "timestamp": r.timestamp, "datoms_written": r.datoms_written}), file=out)


def shell(db: Database, lines: Iterable[str], out: TextIO) -> None:
    """Reads commands, queries and transactions until .quit or the end. What is refused is told, and the shell goes on."""
    as_of, history, form, held = None, False, "table", ""
    for line in lines:
        if not held and not line.strip():
            continue
        held += line if line.endswith("\n") else line + "\n"
        if not held.lstrip().startswith(".") and open_brackets(held) > 0:
            continue
        text, held = held.strip(), ""
        try:
            match text.split():
                case [".quit" | ".exit"]:
                    return
                case [".help"]:
                    print(HELP, file=out)
                case [".schema"]:
                    show_schema(db, out)
                case [".asof"]:
                    as_of = None
                case [".asof", n] if n.isdigit():
                    as_of = int(n)
                case [".history"]:
                    history = not history
                case [".format", ("json" | "edn" | "table") as form]:
                    pass
                case [".compact"]:
                    db.compact()
                case [first, *_] if first.startswith("."):
                    print(f"no command {text}; .help lists them", file=out)
                case _ if is_query(text):
                    show(db, QueryRequest(text, as_of, None, history), form, out)
                case _:
                    run_transaction(db, text, out)
        except REFUSALS as e:
            print(refusal(e), file=out)
    if held.strip():
        print("the last text lacks closing brackets and was not run", file=out)


def serve(db: Database, host: str, http_port: int, flight_port: int) -> None:
    """Both servers, until interrupted."""
    from tesserae.serving import flight, http

    rows = flight.Server(db, host, flight_port)
    threading.Thread(target=rows.serve, daemon=True).start()
    texts = http.Server(db, host, http_port)
    print(f"HTTP on {host}:{texts.server_port}, Flight on {host}:{rows.port}", flush=True)
    try:
        texts.serve_forever()
    except KeyboardInterrupt:
        pass
    finally:
        texts.server_close()
        rows.shutdown()


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tesserae", description="Bitemporal Datalog over a log of facts.")
    p.add_argument("--path", required=True, help="the database's folder, as Spark names it")
    p.add_argument("--config", help="a TOML file of settings")
    todo = p.add_subparsers(dest="todo", required=True)
    q = todo.add_parser("query")
    q.add_argument("text")
    q.add_argument("--as-of", type=int, help="a valid time in microseconds")
    q.add_argument("--rules", help="a file of rules")
    q.add_argument("--history", action="store_true")
    q.add_argument("--inputs", default="[]", help="the inputs of :in as a JSON array")
    q.add_argument("--format", choices=["json", "edn", "table"], default="json")
    t = todo.add_parser("transact")
    t.add_argument("file", help="EDN or JSON; - for standard input")
    todo.add_parser("schema")
    todo.add_parser("compact")
    todo.add_parser("vacuum")
    s = todo.add_parser("serve")
    s.add_argument("--host", default="127.0.0.1")
    s.add_argument("--http-port", type=int, default=3000)
    s.add_argument("--flight-port", type=int, default=3001)
    todo.add_parser("shell")
    return p


def run(db: Database, a: argparse.Namespace, out: TextIO) -> int:
    try:
        match a.todo:
            case "query":
                rules = Path(a.rules).read_text() if a.rules else None
                request = QueryRequest.from_json(json.dumps({"query": a.text, "as_of": a.as_of, "rules": rules, "history": a.history, "inputs": json.loads(a.inputs)}))
                show(db, request, a.format, out)
            case "transact":
                run_transaction(db, sys.stdin.read() if a.file == "-" else Path(a.file).read_text(), out)
            case "schema":
                show_schema(db, out)
            case "compact":
                db.compact()
            case "vacuum":
                print(f"{db.vacuum()} folders deleted", file=out)
            case "serve":
                serve(db, a.host, a.http_port, a.flight_port)
            case "shell":
                shell(db, sys.stdin, out)
    except (*REFUSALS, OSError, ValueError) as e:
        print(refusal(e), file=sys.stderr)
        return 1
    return 0


def main(argv: list[str] | None = None) -> int:
    a = arguments().parse_args(argv)
    spark = SparkSession.builder.appName("tesserae").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    settings = Settings.load(a.config) if a.config else Settings()
    try:
        return run(Database(spark, a.path, settings), a, sys.stdout)
    finally:
        spark.stop()


if __name__ == "__main__":
    sys.exit(main())
