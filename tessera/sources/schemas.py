"""Typed declarations of the seven star-schema tables, as stored in delimited text files."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "char": T.StringType(),
    "string": T.StringType(),
    "date": T.DateType(),
}

# The column layout of the public TPC-H tables (no partsupp, no l_comment).
_LAYOUT = {
    "lineitem": "l_orderkey int, l_partkey int, l_suppkey int, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag char, l_linestatus char, l_shipdate date, l_commitdate date, l_receiptdate date, l_shipinstruct string, l_shipmode string",
    "orders": "o_orderkey int, o_custkey int, o_orderstatus char, o_totalprice double, o_orderdate date, o_orderpriority string, o_clerk string, o_shippriority int, o_comment string",
    "customer": "c_custkey int, c_name string, c_address string, c_nationkey int, c_phone string, c_acctbal double, c_mktsegment string, c_comment string",
    "part": "p_partkey int, p_name string, p_mfgr string, p_brand string, p_type string, p_size int, p_container string, p_retailprice double, p_comment string",
    "supplier": "s_suppkey int, s_name string, s_address string, s_nationkey int, s_phone string, s_acctbal double, s_comment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int, n_comment string",
    "region": "r_regionkey int, r_name string, r_comment string",
}


def _struct(layout: str) -> T.StructType:
    pairs = [column.split() for column in layout.split(", ")]
    return T.StructType([T.StructField(name, _TYPES[kind], True) for name, kind in pairs])


TABLES: dict[str, T.StructType] = {table: _struct(layout) for table, layout in _LAYOUT.items()}
