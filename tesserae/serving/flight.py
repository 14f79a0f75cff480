"""An Arrow Flight server over a database: queries by ticket, transactions by record batch."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.flight as fl
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tesserae.database import Database
from tesserae.errors import SerializationError
from tesserae.serving.requests import REFUSALS, QueryRequest, refusal
from tesserae.sources.wire import WIRE_SCHEMA

#: Rows of a batch that is sent.
BATCH_ROWS = 16384


def _batches(df: DataFrame, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows in batches; the driver holds those of one partition at a time."""
    rows = df.toLocalIterator()
    while some := [tuple(r) for r in islice(rows, BATCH_ROWS)]:
        columns = [pa.array([r[i] for r in some], f.type) for i, f in enumerate(schema)]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def facts_frame(db: Database, batch: pa.RecordBatch) -> DataFrame:
    """A batch in the ingest schema; columns it lacks are null, and rows without `seq` are in their order."""
    names = set(batch.schema.names)
    if len(names) != batch.num_columns or not {"e", "ident"} <= names:
        raise SerializationError("a batch has the columns e and ident, and none twice")
    if unknown := sorted(names - set(WIRE_SCHEMA.names)):
        raise SerializationError("the ingest schema has no " + ", ".join(unknown))
    columns = []
    for f in to_arrow_schema(WIRE_SCHEMA):
        if f.name in names:
            try:
                columns.append(batch.column(f.name).cast(f.type))
            except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as e:
                raise SerializationError(f"{f.name} is of type {f.type}") from e
        elif f.name == "seq":
            columns.append(pa.array(range(batch.num_rows), pa.int64()))
        else:
            columns.append(pa.nulls(batch.num_rows, f.type))
    rows = pa.Table.from_arrays(columns, names=WIRE_SCHEMA.names)
    return db.store.spark.createDataFrame(rows).select(*[F.col(f.name).cast(f.dataType) for f in WIRE_SCHEMA])


class Server(fl.FlightServerBase):
    """Tickets and commands are requests for queries as JSON. A put writes each record batch as one transaction, in their order,

    and is answered with the last one's number in eight bytes, big end first (0 where there was no batch). A batch that is refused ends the put;
    those before it stand. Pull has no columns and is refused. Without authentication: it listens to this machine alone unless told otherwise.
    """

    def __init__(self, db: Database, host: str = "127.0.0.1", port: int = 3001):
        super().__init__(f"grpc://{host}:{port}")
        self.db = db

    def _frame(self, request: bytes) -> DataFrame:
        try:
            return QueryRequest.from_json(request).frame(self.db, tabular=True)
        except REFUSALS as e:
            raise fl.FlightServerError(refusal(e)) from e

    def get_flight_info(self, context, descriptor: fl.FlightDescriptor) -> fl.FlightInfo:
        """The result's schema, from the plan alone, and a ticket for this server."""
        schema = to_arrow_schema(self._frame(descriptor.command or b"").schema)
        return fl.FlightInfo(schema, descriptor, [fl.FlightEndpoint(descriptor.command, [])], -1, -1)

    def do_get(self, context, ticket: fl.Ticket) -> fl.GeneratorStream:
        df = self._frame(ticket.ticket)
        schema = to_arrow_schema(df.schema)

        def found() -> Iterator[pa.RecordBatch]:
            try:
                yield from _batches(df, schema)
            except REFUSALS as e:
                raise fl.FlightServerError(refusal(e)) from e

        return fl.GeneratorStream(schema, found())

    def do_put(self, context, descriptor, reader, writer) -> None:
        last = 0
        try:
            for chunk in reader:
                last = self.db.transact(facts_frame(self.db, chunk.data)).tx_id
        except REFUSALS as e:
            raise fl.FlightServerError(refusal(e)) from e
        writer.write(pa.py_buffer(last.to_bytes(8, "big")))
