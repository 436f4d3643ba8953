"""Canonical JSON of nested values: keys sorted, no spaces, letters beyond ASCII as they are, so that equal values have equal digests.

Serialised by the column's type, recursively, in expressions: structs and maps by key, arrays in their order, whole numbers, booleans
and nulls plainly, strings with the escapes of JSON. Fractions are told as decimals are; binary floating point is refused, as its digits
differ between engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DecimalType, IntegralType, MapType, NullType, StringType, StructType

#: The short escapes of JSON; other control characters are written by their number.
_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def _string(value: Column, line_ends: bool) -> Column:
    """A JSON string; ``line_ends``: with line ends made LF before."""
    text = F.regexp_replace(value, "\r\n|\r", "\n") if line_ends else value
    plain = text
    for sign, told in _ESCAPES.items():
        plain = F.replace(plain, F.lit(sign), F.lit(told))
    for code in range(32):
        if chr(code) not in _ESCAPES:
            plain = F.replace(plain, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), F.when(F.regexp_like(text, F.lit(r'[\x00-\x1f"\\]')), plain).otherwise(text), F.lit('"'))


def _told(value: Column, kind: DataType, line_ends: bool) -> Column:
    joined = lambda parts, a, b: F.concat(F.lit(a), F.array_join(parts, ","), F.lit(b))
    if isinstance(kind, StringType):
        out = _string(value, line_ends)
    elif isinstance(kind, (IntegralType, BooleanType, DecimalType)):
        out = value.cast("string")
    elif isinstance(kind, StructType):
        names = sorted(kind.fieldNames())
        parts = [F.concat(_string(F.lit(n), False), F.lit(":"), _told(value[n], kind[n].dataType, line_ends)) for n in names]
        out = F.when(value.isNotNull(), joined(F.array(*parts), "{", "}") if parts else F.lit("{}"))
    elif isinstance(kind, ArrayType):
        out = joined(F.transform(value, lambda x: _told(x, kind.elementType, line_ends)), "[", "]")
    elif isinstance(kind, MapType) and isinstance(kind.keyType, StringType):
        entries = F.array_sort(F.map_entries(value), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        out = joined(F.transform(entries, lambda e: F.concat(_string(e["key"], False), F.lit(":"), _told(e["value"], kind.valueType, line_ends))), "{", "}")
    elif isinstance(kind, NullType):
        return F.lit("null")
    else:
        raise TypeError(f"no canonical form of {kind.simpleString()}")
    return F.coalesce(out, F.lit("null"))


def canonical_json(rows: DataFrame, column: str, line_ends: bool = False) -> Column:
    """The canonical JSON of a column of ``rows``; ``line_ends``: line ends inside strings, but not in keys, are made LF."""
    return _told(F.col(column), rows.schema[column].dataType, line_ends)


def record_digest(rows: DataFrame, column: str, schema: str) -> Column:
    """sha256 of a record under the name of its format, so that a later format cannot reuse an old digest."""
    return F.sha2(F.concat(F.lit('{"record":'), canonical_json(rows, column, True), F.lit(',"schema":'), _string(F.lit(schema), False), F.lit("}")), 256)
