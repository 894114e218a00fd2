"""Canonical JSON of typed columns as Column expressions: keys sorted at every depth, nulls kept, no blanks, strings and numbers as Python's json module writes them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Escapes of JSON strings: fixed values; other control characters are written by their number.
ESCAPES = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


@F.pandas_udf(T.StringType())
def _canonical_text(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else json.dumps(json.loads(x), ensure_ascii=False, sort_keys=True, separators=(",", ":")))


def canonical_text(c: Column) -> Column:
    """JSON text of any form, nested keys and numbers included, in canonical form. An Arrow UDF: only Python knows its numbers' forms."""
    return _canonical_text(c)


def json_string(c: Column) -> Column:
    few = many = c
    for plain, written in ESCAPES.items():
        if plain in '\\"':
            few = F.replace(few, F.lit(plain), F.lit(written))
        many = F.replace(many, F.lit(plain), F.lit(written))
    for k in range(0x20):
        if chr(k) not in ESCAPES:
            many = F.replace(many, F.lit(chr(k)), F.lit(f"\\u{k:04x}"))
    return F.concat(F.lit('"'), F.when(c.rlike(r"[\x00-\x1f]"), many).otherwise(few), F.lit('"'))


def json_double(c: Column) -> Column:
    """The shortest digits that give the number back, in Python's form: plain from 1e-4 to below 1e16, else with an exponent of two digits at least."""
    s = c.cast("string")
    # Java may print 17 digits where 16 do
    shorter = F.regexp_replace(F.regexp_replace(F.format_string("%.15e", c), "e\\+?(-?)0?([0-9]+)$", "E$1$2"), r"(\.[0-9]+?)0*E", "$1E")
    s = F.when((F.length(F.regexp_replace(s, r"E.*$|[-.]", "")) >= 17) & (shorter.cast("double") == c), shorter).otherwise(s)
    sign = F.when(s.startswith("-"), "-").otherwise("")
    digits = F.regexp_replace(F.regexp_extract(s, r"^-?([0-9.]+)E", 1), r"\.0$|\.", "")
    e = F.regexp_extract(s, r"E(-?[0-9]+)$", 1).cast("int")
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
    padded = F.rpad(digits, F.greatest(e + 1, F.length(digits)), "0")
    large = F.concat(F.substring(padded, F.lit(1), e + 1), F.lit("."), F.when(F.length(padded) > e + 1, F.substring(padded, e + 2, F.length(padded))).otherwise("0"))
    rest = F.substring(digits, F.lit(2), F.length(digits))
    power = F.concat(F.when(e < 0, "-").otherwise("+"), F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.length(F.abs(e).cast("string"))), "0"))
    written = F.concat(F.substring(digits, 1, 1), F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""), F.lit("e"), power)
    return F.when(~s.contains("E"), s).otherwise(F.concat(sign, F.when((e >= -4) & (e < 0), small).when((e >= 0) & (e < 16), large).otherwise(written)))


def canonical_json(c: Column, t: T.DataType, raw: tuple[str, ...] = ()) -> Column:
    """``c`` of type ``t`` as canonical JSON text; string fields named in ``raw`` hold canonical JSON already."""
    if isinstance(t, T.StructType):
        fields = []
        for f in sorted(t.fields, key=lambda f: f.name):
            own = c.getField(f.name)
            value = F.coalesce(own, F.lit("null")) if f.name in raw else canonical_json(own, f.dataType)
            fields += [F.lit(("," if fields else "{") + json.dumps(f.name, ensure_ascii=False) + ":"), value]
        out = F.concat(*fields, F.lit("}")) if fields else F.lit("{}")
    elif isinstance(t, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: canonical_json(x, t.elementType)), ","), F.lit("]"))
    elif isinstance(t, T.MapType):
        entries = F.array_sort(F.transform(F.map_entries(c), lambda x: F.struct(x["key"].alias("key"), canonical_json(x["value"], t.valueType).alias("value"))))
        out = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda x: F.concat(json_string(x["key"]), F.lit(":"), x["value"])), ","), F.lit("}"))
    elif isinstance(t, T.StringType):
        out = json_string(c)
    elif isinstance(t, (T.DoubleType, T.FloatType)):
        out = json_double(c.cast("double"))
    elif isinstance(t, (T.BooleanType, T.IntegralType, T.DecimalType)):
        out = c.cast("string")
    elif isinstance(t, T.NullType):
        return F.lit("null")
    else:
        raise TypeError(f"no JSON form of {t.simpleString()}")
    return F.coalesce(F.when(c.isNotNull(), out), F.lit("null"))
