"""The servers and the command line over a log."""

import http.client
import io
import json
import threading

import pyarrow as pa
import pyarrow.flight as fl
import pytest

from tesserae.__main__ import arguments, is_query, open_brackets, run, shell
from tesserae.database import Database
from tesserae.errors import InvalidQuery, SerializationError
from tesserae.serving import flight, http as web
from tesserae.serving.requests import QueryRequest
from tesserae.sources.edn import Fact


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, "file://" + str(tmp_path / "db"))


@pytest.fixture
def served(db):
    server = web.Server(db, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def post(path, body, **headers):
        c = http.client.HTTPConnection("127.0.0.1", server.server_port, timeout=120)
        c.request("POST", path, body if isinstance(body, str | bytes) else json.dumps(body), {k.replace("_", "-"): v for k, v in headers.items()})
        r = c.getresponse()
        return r.status, r.getheader("Content-Type"), r.read().decode()

    yield post
    server.shutdown()
    server.server_close()


@pytest.fixture
def client(db):
    server = flight.Server(db, port=0)
    yield fl.connect(f"grpc://127.0.0.1:{server.port}")
    server.shutdown()


def test_http_schema_transact_and_query(served, db):
    attributes = [{"ident": ":well/name", "is_unique": True}, {"ident": ":well/depth", "value_type": "Int64"}, {"ident": ":well/tag", "cardinality": "many"}]
    assert json.loads(served("/schema", {"attributes": attributes})[2]) == {"status": "success", "attributes_added": 3}
    known = db.store.manifest().catalog.at()
    assert known[":well/name"].unique and known[":well/depth"].value_type == "Int64" and known[":well/tag"].cardinality == "many"
    facts = [{"e": 5, "ident": ":well/name", "v": 'North "shaft"'}, {"e": 5, "ident": ":well/depth", "v": 40}, {"e": 6, "ident": ":well/name", "v": "South"}, {"e": 6, "ident": ":well/depth", "v": 55}]
    status, _, body = served("/transact", {"facts": facts})
    at = json.loads(body)["timestamp"]
    assert status == 200 and json.loads(body) == {"tx_id": 4, "timestamp": at, "datoms_written": 4}
    assert served("/transact", "[[:db/retract 6 :well/depth 55]]", Content_Type="application/edn")[0] == 200
    both = "[:find ?n ?d :where [?w :well/name ?n] [?w :well/depth ?d]]"
    status, kind, body = served("/query", {"query": both})
    assert (status, kind, json.loads(body)) == (200, "application/json", [{"n": 'North "shaft"', "d": 40}])
    assert served("/query", {"query": both}, Accept="application/edn")[1:] == ("application/edn", '[{:n "North \\"shaft\\"" :d 40}]')
    assert len(json.loads(served("/query", {"query": both, "as_of": at})[2])) == 2
    rules = "[[(deep ?w) [?w :well/depth ?d] [(> ?d 50)]]]"
    assert json.loads(served("/query", {"query": "[:find ?w :in $ % :where (deep ?w)]", "rules": rules, "as_of": at})[2]) == [{"w": 6}]
    assert json.loads(served("/query", {"query": "[:find ?w :in $ ?n :where [?w :well/name ?n]]", "inputs": ["South"]})[2]) == [{"w": 6}]
    assert json.loads(served("/query", {"query": "[:find ?o :where [6 :well/depth ?d ?t ?o]]", "history": True})[2]) in ([{"o": True}, {"o": False}], [{"o": False}, {"o": True}])
    assert json.loads(served("/query", {"query": "[:find ?w :where [?w :well/name \"none\"]]"})[2]) == []


def test_http_refuses_and_goes_on(served, db):
    before = db.store.manifest().last_tx
    bad = [
        ("/query", "no json"), ("/query", {"query": 3}), ("/query", {"query": "[:find"}), ("/query", {"query": "[:find ?x :where [?x :un/known ?y]]"}), ("/query", {"query": "[:find 1]", "asof": 3}),
        ("/transact", {"facts": [{"e": 1, "ident": ":a/b", "v": None}]}), ("/transact", b"\xff"), ("/schema", {"attributes": [{"ident": ":a/ok"}, {"ident": ":a/b", "value_type": "Decimal"}]}), ("/schema", "[]"),
    ]
    for path, body in bad:
        status, _, answer = served(path, body)
        assert status == 400 and json.loads(answer)["error"], (path, body)
    assert served("/nowhere", {})[0] == 404
    assert served("/query", "", Content_Length=str(web.MAX_BODY + 1))[0] == 413
    assert db.store.manifest().last_tx == before  # a schema with one bad attribute adds none


def test_http_sends_long_answers_whole(served, db):
    db.transact([Fact(i, ":note/text", f"{i} " + "ä" * 500) for i in range(1, 401)], 10)
    rows = json.loads(served("/query", {"query": "[:find ?e ?t :where [?e :note/text ?t]]"})[2])
    assert {r["e"]: r["t"] for r in rows} == {i: f"{i} " + "ä" * 500 for i in range(1, 401)}


def batch(**columns):
    return pa.RecordBatch.from_pydict(columns)


def test_flight_puts_and_gets(client, db):
    first = batch(e=[1, 2, 1], ident=[":kiln/heat", ":kiln/heat", ":kiln/heat"], v_int=[900, 1100, 950])
    second = batch(e=[3, 2], ident=[":kiln/heat", ":kiln/heat"], v_int=[700, 1200])
    writer, answers = client.do_put(fl.FlightDescriptor.for_command(b""), first.schema)
    writer.write_batch(first)
    writer.write_batch(second)
    writer.done_writing()
    assert int.from_bytes(answers.read().to_pybytes(), "big") == 2 == db.store.manifest().last_tx  # a transaction a batch
    writer.close()
    ask = json.dumps({"query": "[:find ?k ?h :where [?k :kiln/heat ?h]]"}).encode()
    info = client.get_flight_info(fl.FlightDescriptor.for_command(ask))
    assert info.schema.names == ["k", "h"] and info.schema.field("h").type == pa.int64()
    got = client.do_get(info.endpoints[0].ticket).read_all()
    assert got.schema.equals(info.schema) and sorted(zip(*got.to_pydict().values())) == [(1, 950), (2, 1200), (3, 700)]
    none = client.do_get(fl.Ticket(json.dumps({"query": "[:find ?k :where [?k :kiln/heat 1]]"}).encode())).read_all()
    assert none.num_rows == 0 and none.schema.names == ["k"]


def test_flight_refuses(client, db, monkeypatch):
    db.transact([Fact(1, ":kiln/heat", 900)], 5)
    for query in ("[:find (pull ?k [:kiln/heat]) :where [?k :kiln/heat _]]", "[:find ?k"):
        with pytest.raises(fl.FlightError):
            client.get_flight_info(fl.FlightDescriptor.for_command(json.dumps({"query": query}).encode()))
    with pytest.raises(fl.FlightError):
        client.do_get(fl.Ticket(b"no json")).read_all()
    for bad in (batch(e=[1], v_int=[3]), batch(e=[1], ident=[":kiln/heat"], weight=[3]), batch(e=["x"], ident=[":kiln/heat"], v_int=[3])):
        with pytest.raises(SerializationError):
            flight.facts_frame(db, bad)
    monkeypatch.setattr(flight, "BATCH_ROWS", 7)
    db.transact([Fact(i, ":kiln/mark", i / 4) for i in range(1, 31)], 6)
    got = client.do_get(fl.Ticket(json.dumps({"query": "[:find ?k ?m :where [?k :kiln/mark ?m]]"}).encode())).read_all()
    assert sorted(zip(*got.to_pydict().values())) == [(i, i / 4) for i in range(1, 31)]


def test_requests():
    r = QueryRequest.from_json('{"query": "q", "inputs": [[1, 2], [["a", 3]]], "rules": null}')
    assert r.inputs == [[1, 2], [("a", 3)]] and r.rules is None
    for bad in ("[]", "{}", '{"query": "q", "as_of": "x"}', '{"query": "q", "as_of": true}', '{"query": "q", "more": 1}'):
        with pytest.raises(InvalidQuery):
            QueryRequest.from_json(bad)


def test_brackets_and_kinds():
    assert [open_brackets(t) for t in ("[:find ?x", "[(a) {b #{c}}]", '["]" ; ]\n', '["\\"]"]', "[\\( 1]", '["open')] == [1, 0, 1, 0, 0, 2]
    assert is_query(" [ :find ?x]") and not is_query("[[:db/add 1 :a/b 2]]")


def test_shell(db):
    said = io.StringIO()
    shell(db, ["\n", "[[:db/add 4 :bell/tone \"G\" #inst \"1970-01-01T00:00:01Z\"]\n", " [:db/add 4 :bell/kg 12]]\n", ".format json\n", "[:find ?t\n", ":where [4 :bell/tone ?t]]\n", ".schema\n", "[:find ?x]\n", ".asof 5\n",
               "[:find ?t :where [4 :bell/tone ?t]]\n", ".asof\n", ".what\n", ".compact\n", ".quit\n", "[:find nothing\n"], said)
    lines = said.getvalue().splitlines()
    assert json.loads(lines[0])["datoms_written"] == 2 and lines[1] == '[{"t":"G"}]' and lines[2:4] == [":bell/kg Int64 one", ":bell/tone String one"]
    assert lines[4].startswith(("PlanError", "ParseError")) and ".what" in lines[-1] and db.store.manifest().covered
    said = io.StringIO()
    shell(db, ["[:find ?t\n"], said)
    assert "not run" in said.getvalue()


def test_commands(db, tmp_path, capsys):
    facts = tmp_path / "facts.json"
    facts.write_text('{"facts": [{"e": 8, "ident": ":loom/width", "v": 3}], "tx_time": 40}')

    def told(*words):
        out = io.StringIO()
        return run(db, arguments().parse_args(["--path", "given", *words]), out), out.getvalue()

    assert told("transact", str(facts)) == (0, '{"tx_id": 1, "timestamp": 40, "datoms_written": 1}\n')
    ask = "[:find ?l :in $ ?w :where [?l :loom/width ?w]]"
    assert told("query", ask, "--inputs", "[3]", "--format", "edn") == (0, "[{:l 8}]\n")
    assert told("query", ask, "--inputs", "[3]", "--as-of", "40") == (0, '[{"l":8}]\n')
    assert "|8  |" in told("query", ask, "--inputs", "[3]", "--format", "table")[1]
    assert told("schema") == (0, ":loom/width Int64 one\n") and told("compact") == (0, "") and told("vacuum") == (0, "0 folders deleted\n")
    assert told("query", "[:find") [0] == 1 and "ParseError" in capsys.readouterr().err
    assert told("transact", str(tmp_path / "none"))[0] == 1
