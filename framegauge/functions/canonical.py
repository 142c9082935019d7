"""Canonical JSON text of nested columns, and digests over it.

Keys are sorted at every level, nulls are kept, nothing is spaced, and characters beyond ASCII are escaped, so the text
does not depend on the order of columns or of map entries.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical_json(value: Column, kind: T.DataType) -> Column:
    """value, of type kind, as canonical JSON.

    Maps must have text keys. Floating-point numbers are written as decimals of up to 16 places, the shortest text for
    metrics from 0.0001 to 10^16; not-a-number and infinities are an error of the cast.
    """
    if isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(json.dumps(f.name) + ":"), canonical_json(value[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        body = F.when(value.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))
    elif isinstance(kind, T.MapType):
        entry = lambda e: F.concat(_quoted(e["key"]), F.lit(":"), canonical_json(e["value"], kind.valueType))
        in_order = F.array_sort(F.map_entries(value), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        body = F.concat(F.lit("{"), F.array_join(F.transform(in_order, entry), ","), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        body = F.concat(F.lit("["), F.array_join(F.transform(value, lambda e: canonical_json(e, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.StringType):
        body = _quoted(value)
    elif isinstance(kind, T.BooleanType):
        body = value.cast("string")
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        # a point with one digit at least, and no zeros beyond it
        body = F.regexp_replace(F.regexp_replace(value.cast("decimal(38,16)").cast("string"), "0+$", ""), "\\.$", ".0")
    else:
        body = value.cast("string")
    return F.coalesce(body, F.lit("null"))


def _quoted(text: Column) -> Column:
    plain = F.to_json(F.struct(text.alias("v")), {"ignoreNullFields": "false"})
    inner = F.substr(plain, F.lit(6), F.length(plain) - 6)  # without {"v": and }
    four = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def escaped(c: Column) -> Column:
        n = F.ascii(c)
        pair = F.concat(four(F.floor((n - 0x10000) / 0x400) + 0xD800), four((n - 0x10000) % 0x400 + 0xDC00))
        return F.when(n < 128, c).when(n < 0x10000, four(n)).otherwise(pair)

    return F.when(text.isNull(), F.lit(None).cast("string")).when(inner.rlike("^[\\x00-\\x7f]*$"), inner).otherwise(F.array_join(F.transform(F.split(inner, "(?<=.)(?=.)"), escaped), ""))


def canonical_digest(value: Column, kind: T.DataType) -> Column:
    return F.sha2(canonical_json(value, kind), 256)


def canonical_constant(value: Any) -> Column:
    """A driver-side value as the same text."""
    return F.lit(json.dumps(value, sort_keys=True, separators=(",", ":")))
