"""The star-schema tables as attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .wide import WideTable

#: A turn's id is its conversation's times this, and its number.
TURNS = 1 << 24
#: Rows that a file may have for ids by place.
FILE_ROWS = 1 << 40

#: Table: key and attributes (ident to column); a * marks references.
TABLES: dict[str, tuple[str, dict[str, str]]] = {
    "region": ("r_regionkey", {":region/name": "r_name"}),
    "nation": ("n_nationkey", {":nation/name": "n_name", ":nation/region": "*n_regionkey"}),
    "customer": ("c_custkey", {":customer/name": "c_name", ":customer/nation": "*c_nationkey", ":customer/acctbal": "c_acctbal", ":customer/segment": "c_mktsegment"}),
    "supplier": ("s_suppkey", {":supplier/name": "s_name", ":supplier/nation": "*s_nationkey", ":supplier/acctbal": "s_acctbal"}),
    "part": ("p_partkey", {":part/name": "p_name", ":part/brand": "p_brand", ":part/type": "p_type", ":part/size": "p_size", ":part/price": "p_retailprice"}),
    "orders": ("o_orderkey", {":order/customer": "*o_custkey", ":order/status": "o_orderstatus", ":order/total": "o_totalprice", ":order/date": "o_orderdate", ":order/priority": "o_orderpriority"}),
    # No columns of lineitem are unique, so a row's id is its place in its file.
    "lineitem": ("", {":item/order": "*l_orderkey", ":item/part": "*l_partkey", ":item/supplier": "*l_suppkey", ":item/number": "l_linenumber", ":item/quantity": "l_quantity", ":item/price": "l_extendedprice", ":item/discount": "l_discount", ":item/tax": "l_tax", ":item/flag": "l_returnflag", ":item/status": "l_linestatus", ":item/shipdate": "l_shipdate"}),
    "documents": ("doc_id", {":doc/lang": "lang", ":doc/source": "source", ":doc/chars": "n_chars"}),
    "labels": ("doc_id", {":doc/quality": "quality", ":doc/toxic": "toxic"}),
}


def tables(spark: SparkSession, sf_dir: str, names: list[str]) -> list[WideTable]:
    """These tables; `turns` is conversations, an entity a turn with a reference to the turn before."""
    out = []
    for n in names:
        if n == "turns":
            out.append(_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
            continue
        key, columns = TABLES[n]
        frame = spark.read.parquet(f"{sf_dir}/{n}.parquet")
        out.append(WideTable(n, frame, F.col(key) if key else row_id(frame), {i: F.col(c.lstrip("*")) for i, c in columns.items()}, frozenset(i for i, c in columns.items() if c[0] == "*")))
    return out


def row_id(frame: DataFrame) -> Column:
    """An id for each row of a table of Parquet files: its file's number among the table's, by name, and its place in the file. The same in every scan, whatever is filtered."""
    place = F.col("_metadata.row_index")
    files = sorted(frame.inputFiles())
    if len(files) < 2:
        return place
    number = F.create_map(*[x for i, f in enumerate(files) for x in (F.lit(f.rsplit("/", 1)[-1]), F.lit(i).cast("long"))])
    return number[F.col("_metadata.file_name")] * FILE_ROWS + place


def _turns(frame: DataFrame) -> WideTable:
    key = F.col("conv_id").cast("long") * TURNS + F.col("turn")
    columns = {":turn/conv": F.col("conv_id"), ":turn/role": F.col("role"), ":turn/no": F.col("turn"), ":turn/prev": F.when(F.col("turn") > 0, key - 1)}
    return WideTable("turns", frame, key, columns, frozenset({":turn/prev"}))
