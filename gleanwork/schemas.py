"""Shapes of the tables that flow through a run. Importing them needs no session."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"int": T.IntegerType(), "bigint": T.LongType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "binary": T.BinaryType(), "strings": T.ArrayType(T.StringType())}


def _shape(columns: str, **nested: T.DataType) -> T.StructType:
    pairs = [c.split() for c in columns.split(", ")]
    return T.StructType([T.StructField(name, nested.get(kind) or _TYPES[kind]) for name, kind in pairs])


HITS = _shape("query_rank int, query string, result_rank int, url string")
PAYLOADS = _shape("url string, status int, content_type string, content_length string, content binary")
VERDICTS = _shape("sha256 string, response string, model_name string")
VERDICT = _shape("label string, confidence double, reasons strings, is_underage_or_ambiguous boolean")
LEDGER = _shape("id bigint, url string, sha256 string, phash string, filepath string, category string, created_at string, model_name string, confidence double")
AUDIT = _shape(
    "filepath string, url string, category string, width int, height int, luma_stddev double, sat_stddev double, sat_mean double, colorfulness double, flat_ratio double, "
    "laplacian_var double, edge_density double, entropy double, edge_mean double, brightness double, flagged boolean, flags strings, llm auditor, error string",
    auditor=_shape("quality string, is_gray boolean, reason string"),
)
