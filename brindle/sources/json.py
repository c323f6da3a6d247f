"""JSON schema helpers: merging of conflicting types, null fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Numeric types from tight to wide.
_LADDER = [T.IntegerType(), T.LongType(), T.DecimalType(38, 18), T.DoubleType()]


def merge_types(a: T.DataType, b: T.DataType) -> T.DataType:
    """Type that holds both: null gives way, structs and arrays merge inside, numbers widen, else string."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        names = sorted(set(a.fieldNames()) | set(b.fieldNames()))
        merged = []
        for n in names:
            kinds = [s[n].dataType for s in (a, b) if n in s.fieldNames()]
            merged.append(T.StructField(n, kinds[0] if len(kinds) == 1 else merge_types(*kinds), True))
        return T.StructType(merged)
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(merge_types(a.elementType, b.elementType), a.containsNull or b.containsNull)
    if a in _LADDER and b in _LADDER:
        return max(a, b, key=_LADDER.index)
    return T.StringType()


def null_types_to_string(t: T.DataType) -> T.DataType:
    """Fields that held only nulls read as strings."""
    if isinstance(t, T.NullType):
        return T.StringType()
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, null_types_to_string(f.dataType), True) for f in t.fields])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(null_types_to_string(t.elementType), t.containsNull)
    return t


def parse_json_column(df: DataFrame, column: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON texts of a column as columns; without a schema it is inferred over all texts.

    Each distinct shape of record is reduced to a schema on the executors; only
    the merged schema, one short text, reaches the driver.
    """
    if schema is None:
        text = df.agg(F.schema_of_variant_agg(F.try_parse_json(F.col(column)))).first()[0]
        schema = text.replace("OBJECT<", "STRUCT<")
    return df.select(F.from_json(F.col(column), schema).alias("j")).select("j.*")
