"""Canonical JSON of values of any nesting, as a Column: one text for one value.

Keys are sorted by code point at every depth, null fields of objects are left out, nulls of arrays stay, there is no white
space, numbers are written as the shortest text that gives them back. The rewriting follows the schema, so it is built
once for a query and runs in the JVM; only doubles pass through Python, whose texts the rest of the library has.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Short escapes of JSON; other control characters have six characters.
_SHORT = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def quoted(x: Column) -> Column:
    """A JSON string."""
    plain = F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    escaped = plain
    for code in range(32):
        escaped = F.replace(escaped, F.lit(chr(code)), F.lit(_SHORT.get(chr(code), f"\\u{code:04x}")))
    return F.concat(F.lit('"'), F.when(x.rlike(r"[\x00-\x1f]"), escaped).otherwise(plain), F.lit('"'))


def _finite(x: Column, bad: Column) -> Column:
    return F.when(bad, F.raise_error(F.lit("a number is not finite")).cast("string")).otherwise(x)


def _infinite(x: Column) -> Column:
    return F.isnan(x) | (F.abs(x) == float("inf"))


def _double(x: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:  # null comes as NaN, and no other NaN comes out
        return values.astype(object).map(lambda v: None if v is None or v != v else repr(float(v)))

    return _finite(run(x), _infinite(x))


def _doubles(x: Column) -> Column:
    """Texts of an array of doubles; null stays null."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda a: None if a is None else [None if v is None or v != v else repr(float(v)) for v in a])

    bad = F.exists(x, lambda v: F.coalesce(_infinite(v), F.lit(False)))
    return F.when(bad, F.raise_error(F.lit("a number is not finite")).cast("array<string>")).otherwise(run(x))


def _object(pairs: list[tuple[Column, Column]]) -> Column:
    """pairs of quoted key and value, null values left out."""
    members = F.filter(F.array(*(F.when(v.isNotNull(), F.concat(k, F.lit(":"), v)) for k, v in pairs)), lambda m: m.isNotNull()) if pairs else F.array().cast("array<string>")
    return F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))


def has_doubles(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return has_doubles(kind.elementType)
    if isinstance(kind, T.MapType):
        return has_doubles(kind.valueType)
    if isinstance(kind, T.StructType):
        return any(has_doubles(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.DoubleType, T.FloatType))


def value(x: Column, kind: T.DataType) -> Column:
    """The canonical JSON of x, null for null. Doubles within arrays and maps can be plain elements only."""
    if isinstance(kind, T.StringType):
        return F.when(x.isNotNull(), quoted(x))
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return x.cast("string")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return _double(x.cast("double"))
    if isinstance(kind, T.StructType):
        pairs = [(F.lit(_key(f.name)), value(x[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(x.isNotNull(), _object(pairs))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.DoubleType, T.FloatType)):
            texts = _doubles(x.cast("array<double>"))
        elif has_doubles(kind.elementType):
            raise TypeError("doubles in objects of an array have no canonical form here")
        else:
            texts = F.transform(x, lambda v: value(v, kind.elementType))
        return F.concat(F.lit("["), F.array_join(texts, ",", "null"), F.lit("]"))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        if has_doubles(kind.valueType):
            raise TypeError("doubles in a map have no canonical form here")
        entries = F.filter(F.transform(F.array_sort(F.map_keys(x)), lambda k: F.struct(k.alias("key"), value(x[k], kind.valueType).alias("text"))), lambda e: e["text"].isNotNull())
        return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(":"), e["text"])), ","), F.lit("}"))
    if isinstance(kind, T.NullType):
        return F.lit(None).cast("string")
    raise TypeError(f"{kind.simpleString()} has no canonical form")


def _key(name: str) -> str:
    import json

    return json.dumps(name, ensure_ascii=False)


def rows(df: DataFrame, *columns: str) -> Column:
    """The canonical JSON of the named columns (all, if none are named) as one object."""
    fields = sorted((f for f in df.schema.fields if not columns or f.name in columns), key=lambda f: f.name)
    return _object([(F.lit(_key(f.name)), value(F.col(f"`{f.name}`"), f.dataType)) for f in fields])
