"""Families of column types, read from the schema and never from the data."""

from __future__ import annotations

from pyspark.sql import types as T


def kind_of(data_type: T.DataType) -> str:
    """One of text, integer, number, temporal, boolean or other."""
    if isinstance(data_type, (T.StringType, T.VarcharType, T.CharType)):
        return "text"
    if isinstance(data_type, T.IntegralType):
        return "integer"
    if isinstance(data_type, (T.FractionalType, T.DecimalType)):
        return "number"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "temporal"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    return "other"


def kind_of_name(type_name: str) -> str:
    """The same families for a type name taken from a catalog."""
    name = type_name.lower()
    if name.startswith(("string", "varchar", "char")):
        return "text"
    if name in ("tinyint", "smallint", "int", "integer", "bigint"):
        return "integer"
    if name.startswith(("decimal", "float", "double", "real")):
        return "number"
    if name.startswith(("date", "timestamp")):
        return "temporal"
    if name == "boolean":
        return "boolean"
    return "other"


def is_key_name(name: str) -> bool:
    """True for names that end in `id` as a word part, or in `key`."""
    low = name.lower()
    return low == "id" or low.endswith(("_id", "key"))
