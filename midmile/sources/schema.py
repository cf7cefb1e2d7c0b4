"""Short schema texts that need no running session."""

from __future__ import annotations

from pyspark.sql import types as T

_POINT = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])
_KINDS = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(),
    "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType(), "timestamp_ntz": T.TimestampNTZType(),
    "point": _POINT, "floats": T.ArrayType(T.FloatType()), "strings": T.ArrayType(T.StringType()),
}


def columns(spec: str) -> T.StructType:
    """``"id string, severity int"`` as a schema."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (c.split() for c in spec.split(","))])
