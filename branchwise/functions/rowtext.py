"""Canonical row text and row hash, as native column expressions.

A row's text is the composite form ``(f1,f2,...)`` of all its columns in order. NULL becomes an
empty field; a text field is double-quoted when it is empty or holds a quote, backslash,
parenthesis, comma or white space, with quotes and backslashes doubled inside. That keeps
NULL and '' apart and makes the text unambiguous. Floating point numbers are written exactly, in
hexadecimal; instants as microseconds since 1970, whatever the session's
time zone; local times (without a zone) as their own text. The row hash is the first 16 hex digits of ``md5(row text)``
read as a signed 64-bit integer.

All expressions are native and no Python runs per row. Rows of scalar columns stay inside
whole-stage codegen; an array's elements go through ``transform``, which Spark evaluates element by element outside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values that must stay as they are for equal fingerprints:
# characters that force a text field into double quotes, written as a regex class
# (quote, backslash, parentheses, comma, space, tab, newline, carriage return, form feed,
# vertical tab).
SPECIAL_CHARS = r'["\\(), \t\n\r\f\x0B]'
DOUBLED_CHARS = r'(["\\])'

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_NUMERIC_ELEMENTS = _INTEGRAL + (T.DecimalType, T.FloatType, T.DoubleType, T.DateType)

# The rule is emitted as one Spark SQL expression (parsed once in the JVM), which keeps
# building the plan cheap for wide tables and namespaces with many tables.


def _ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def quote_sql(x: str) -> str:
    """Quote a non-null text field when the composite form needs it."""
    return (f"CASE WHEN {x} = '' OR {x} RLIKE r'{SPECIAL_CHARS}' "
            f"THEN concat('\"', regexp_replace({x}, r'{DOUBLED_CHARS}', '$1$1'), '\"') ELSE {x} END")


def _always_quoted(x: str) -> str:
    # For text that always holds a special character but never a quote or backslash.
    return f"concat('\"', {x}, '\"')"


def float_sql(e: str) -> str:
    """Exact text of a floating point number: hexadecimal digits and a power of two, ``-0x1.8p3``."""
    return f"CASE WHEN {e} IS NOT NULL THEN format_string('%a', CAST({e} AS DOUBLE)) END"


def value_sql(e: str, dt: T.DataType, depth: int = 0) -> str:
    """Canonical, unquoted text of a value of type ``dt`` (NULL stays NULL)."""
    if isinstance(dt, (T.StringType, T.CharType, T.VarcharType)):
        return f"CAST({e} AS STRING)"
    if isinstance(dt, _INTEGRAL) or isinstance(dt, (T.DecimalType, T.DateType)):
        return f"CAST({e} AS STRING)"
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return float_sql(e)
    if isinstance(dt, T.BooleanType):
        return f"CASE WHEN {e} THEN 't' WHEN NOT {e} THEN 'f' END"
    if isinstance(dt, T.TimestampType):
        return f"CAST(unix_micros({e}) AS STRING)"
    if isinstance(dt, T.TimestampNTZType):
        return f"CAST({e} AS STRING)"
    if isinstance(dt, T.BinaryType):
        return f"concat(r'\\x', lower(hex({e})))"
    if isinstance(dt, T.ArrayType):
        v = f"x_{depth}"
        et = dt.elementType
        # NULL elements are a bare NULL, so the string of that name is quoted.
        inner = f"if({v} = 'NULL', '\"NULL\"', {quote_sql(v)})" if isinstance(et, T.StringType) else value_sql(v, et, depth + 1)
        return (f"CASE WHEN {e} IS NOT NULL THEN concat('[', array_join(transform({e}, {v} -> "
                f"coalesce({inner}, 'NULL')), ','), ']') END")
    if isinstance(dt, T.StructType):
        fields = [(f"{e}.{_ident(f.name)}", f.dataType) for f in dt.fields]
        return f"CASE WHEN {e} IS NOT NULL THEN {composite_sql(fields, depth + 1)} END"
    if isinstance(dt, T.MapType):
        raise ValueError("map columns have no defined entry order; fingerprint a sorted array instead")
    if isinstance(dt, T.NullType):
        return "CAST(NULL AS STRING)"
    raise ValueError(f"no canonical text rule for type {dt.simpleString()}")


def field_sql(e: str, dt: T.DataType, depth: int = 0) -> str:
    """One field of the composite form: never NULL, quoted where needed."""
    v = value_sql(e, dt, depth)
    if isinstance(dt, (T.StringType, T.CharType, T.VarcharType, T.BinaryType)):
        q = quote_sql(v) if not isinstance(dt, (T.StringType,)) else quote_sql(e)
    elif isinstance(dt, _INTEGRAL) or isinstance(dt, (T.DecimalType, T.FloatType, T.DoubleType, T.BooleanType,
                                                      T.DateType, T.NullType, T.TimestampType)):
        # Digits, signs, points, letters: never a special character, never empty.
        q = v
    elif isinstance(dt, T.TimestampNTZType):
        # Always holds a space, never a quote or backslash.
        q = _always_quoted(v)
    elif isinstance(dt, T.ArrayType) and isinstance(dt.elementType, _NUMERIC_ELEMENTS):
        # Numbers hold no special character: the text needs quotes exactly when it has a comma.
        q = f"CASE WHEN size({e}) > 1 THEN {_always_quoted(v)} ELSE {v} END"
    else:
        q = quote_sql(v)
    return f"coalesce({q}, '')"


def composite_sql(fields: list[tuple[str, T.DataType]], depth: int = 0) -> str:
    """``(f1,f2,...)`` of typed SQL expressions."""
    if not fields:
        return "'()'"
    # Every part is non-null, so concat_ws drops nothing.
    return "concat('(', concat_ws(',', " + ", ".join(field_sql(e, dt, depth) for e, dt in fields) + "), ')')"


def row_text_sql(schema: T.StructType, columns: list[str] | None = None) -> str:
    return composite_sql([(_ident(f.name), f.dataType) for f in _fields(schema, columns)])


def row_text(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Composite text of the given columns of ``df`` (all, in order, by default)."""
    return F.expr(row_text_sql(df.schema, columns))


def hash_sql(text: str) -> str:
    """First 16 hex digits of md5(text) as a signed 64-bit integer."""
    return f"CAST(conv(substring(md5({text}), 1, 16), 16, -10) AS BIGINT)"


def row_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    return F.expr(hash_sql(row_text_sql(df.schema, columns)))


def _fields(schema: T.StructType, columns: list[str] | None) -> list[T.StructField]:
    by_name = {f.name: f for f in schema.fields}
    if columns is None:
        return list(schema.fields)
    missing = [c for c in columns if c not in by_name]
    if missing:
        raise ValueError(f"columns not in table: {missing}")
    return [by_name[c] for c in columns]
