"""B-P19: nested results as rows (section, metric, value, text)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# the sections of a training result; fields of other names go to "other"
SECTIONS = ("modelInfo", "bestParameters", "bestTrial", "trainMetrics", "validationMetrics", "testMetrics")
OTHER = "other"
_LEAF = "array<struct<metric:string,value:double,text:string>>"


def _leaves(x: Column, kind: T.DataType, path: Column, places: int) -> Column:
    """All leaves below a column as an array; a NULL struct, map or array has none."""
    none = F.array().cast(_LEAF)
    if isinstance(kind, T.StructType):
        parts = [_leaves(x[f.name], f.dataType, F.concat(path, F.lit(f".{f.name}")), places) for f in kind]
        return F.when(x.isNotNull(), F.concat(*parts)).otherwise(none) if parts else none
    if isinstance(kind, T.MapType):
        each = F.transform(F.array_sort(F.map_entries(x)), lambda e: _leaves(e["value"], kind.valueType, F.concat(path, F.lit("."), e["key"].cast("string")), places))
        return F.coalesce(F.flatten(each), none)
    if isinstance(kind, T.ArrayType):
        each = F.transform(x, lambda e, i: _leaves(e, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), places))
        return F.coalesce(F.flatten(each), none)
    number = isinstance(kind, T.NumericType)
    value = F.round(x.cast("double"), places) if number else F.lit(None).cast("double")
    text = F.lit(None).cast("string") if number else x.cast("string")
    return F.array(F.struct(path.alias("metric"), value.alias("value"), text.alias("text"))).cast(_LEAF)


def _row(section: str, start: int):
    return lambda r: F.struct(F.lit(section).alias("section"), F.substr(r["metric"], F.lit(start)).alias("metric"),
                              r["value"].alias("value"), r["text"].alias("text"))


def flatten_report(df: DataFrame, keys: Sequence[str] = (), sections: Sequence[str] = SECTIONS, places: int = 4) -> DataFrame:
    """``keys..., section, metric, value, text``: a row for each leaf of the nested columns of ``df``.

    Structs, maps and arrays are walked by schema to any depth.  A column named in ``sections`` is a section, and the metric
    is the path below it (its own name, if it is no nested column); the others are metrics of the section "other", with
    their whole path.  Numbers are rounded to ``places`` in ``value``; other leaves are ``text``."""
    rows = []
    for f in df.schema:
        if f.name in keys:
            continue
        found = _leaves(F.col(f"`{f.name}`"), f.dataType, F.lit(f.name), places)
        section = f.name if f.name in sections else OTHER
        drop = len(f.name) + 2 if f.name in sections and isinstance(f.dataType, (T.StructType, T.MapType)) else 1
        rows.append(F.transform(found, _row(section, drop)))
    return df.select(*keys, F.explode(F.concat(*rows)).alias("_r")).select(*keys, "_r.*")
