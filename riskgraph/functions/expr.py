"""Scalar expressions: keys, labels, risk bands, thresholds,
clipping, filling, embedding layout and seeded ordering.  Everything is a
native ``Column`` expression, so it stays inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgraph.operators.quantiles import column_quantiles

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's (band edges, labels, weights).
# ---------------------------------------------------------------------------
# five-band risk scale: >=0.8 Very High, >=0.6 High, >=0.4 Medium, >=0.2 Low, else Very Low
BANDS_FIVE = [(0.8, "Very High Risk"), (0.6, "High Risk"), (0.4, "Medium Risk"),
              (0.2, "Low Risk")]
BAND_FIVE_ELSE = "Very Low Risk"
# three-band scale: >=0.7 High, >=0.4 Medium, else Low
BANDS_THREE = [(0.7, "High Risk"), (0.4, "Medium Risk")]
BAND_THREE_ELSE = "Low Risk"
# rate bands of an actual pest rate
RATE_ZERO = "No Risk (0.0)"
RATE_BANDS = [(0.2, "Low Risk (0.0-0.2)"), (0.5, "Medium Risk (0.2-0.5)"),
              (0.8, "High Risk (0.5-0.8)")]
RATE_ELSE = "Very High Risk (0.8-1.0)"
# outcome labels of the TargetProxy node
TARGET_LABELS = {0: "no_pest", 1: "pest"}
# composite link score weights
COMPOSITE_WEIGHTS = {"adamic_adar_score": 0.4, "jaccard_score": 0.3,
                     "common_neighbors_count": 0.2, "preferential_attachment_score": 0.1}
DEFAULT_SEED = 42


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def country_month_key(ctry: str | Column = "ctry_code", month: str | Column = "month") -> Column:
    """B-P1: ``<country>_<month>`` composite id."""
    return F.concat_ws("_", _c(ctry).cast("string"), _c(month).cast("string"))


def target_label(col: str | Column = "target_proxy") -> Column:
    """B-P2: 0 -> ``no_pest``, anything else -> ``pest``."""
    return F.when(_c(col) == 0, F.lit(TARGET_LABELS[0])).otherwise(F.lit(TARGET_LABELS[1]))


def has_pest(col: str | Column = "target_proxy") -> Column:
    """B-P2: boolean outcome."""
    return _c(col) == 1


def cast_counters(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """B-P3: cast outcome and counters to int."""
    return df.withColumns({c: F.col(c).cast("int") for c in cols})


def risk_band(col: str | Column, scale: str = "five") -> Column:
    """B-P4 / B-P5 / B-P6 as one chained ``CASE WHEN``."""
    x = _c(col)
    if scale == "five":
        bands, other = BANDS_FIVE, BAND_FIVE_ELSE
        expr = None
        for edge, name in bands:
            expr = F.when(x >= edge, name) if expr is None else expr.when(x >= edge, name)
        return expr.otherwise(other)
    if scale == "three":
        expr = None
        for edge, name in BANDS_THREE:
            expr = F.when(x >= edge, name) if expr is None else expr.when(x >= edge, name)
        return expr.otherwise(BAND_THREE_ELSE)
    if scale == "rate":
        expr = F.when(x == 0, RATE_ZERO)
        lo = 0.0
        for edge, name in RATE_BANDS:
            expr = expr.when((x > lo) & (x <= edge), name)
            lo = edge
        return expr.otherwise(RATE_ELSE)
    raise ValueError(f"unknown band scale {scale!r}")


def threshold(col: str | Column, t: float, strict: bool = False) -> Column:
    """B-P7: ``score >= t`` (or ``> t``) as 0/1 int."""
    x = _c(col)
    return ((x > t) if strict else (x >= t)).cast("int")


def clip(col: str | Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """B-P8: clamp; NULL stays NULL (``greatest``/``least`` skip NULLs)."""
    x = _c(col)
    return F.when(x.isNull(), F.lit(None)).otherwise(F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def fill_constant(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """B-P9: NULL/NaN -> constant per column."""
    out = df
    for c, v in values.items():
        x = F.col(c)
        dtype = dict(df.dtypes)[c]
        if dtype in ("double", "float"):
            x = F.nanvl(x, F.lit(None).cast(dtype))
        out = out.withColumn(c, F.coalesce(x, F.lit(v)))
    return out


def fill_median(df: DataFrame, cols: Sequence[str], fitted: Mapping[str, float] | None = None) -> DataFrame:
    """B-P10: NULL -> exact column median, all columns in one distributed job
    (``operators.quantiles``); a column without any value stays NULL."""
    medians = fitted if fitted is not None else median_values(df, cols)
    types = dict(df.dtypes)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(medians[c]).cast(types[c])) for c in cols if c in medians})


def median_values(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    return {c: q[0] for c, q in column_quantiles(df, cols, [0.5]).items()}


def drop_null_rows(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """B-P11."""
    return df.dropna(subset=list(subset))


def has_missing(arr: str | Column) -> Column:
    """B-P12: embedding NULL as a whole or containing a NULL/NaN element."""
    a = _c(arr)
    return a.isNull() | F.exists(a, lambda x: x.isNull() | F.isnan(x))


def embedding_to_columns(df: DataFrame, col: str, prefix: str, n: int,
                         width: int = 0, drop: bool = True) -> DataFrame:
    """B-P13: ``array<double>`` -> ``prefix_i`` columns (``width`` pads i)."""
    cols = [F.col(col)[i].alias(f"{prefix}{str(i).zfill(width) if width else i}") for i in range(n)]
    keep = [c for c in df.columns if not (drop and c == col)]
    return df.select(*keep, *cols)


def columns_to_embedding(df: DataFrame, prefix: str, out: str = "embedding",
                         drop: bool = True) -> DataFrame:
    """B-P13 inverse: columns found by name prefix, in numeric order."""
    names = embedding_columns(df.columns, prefix)
    arr = F.array(*[F.col(c).cast("double") for c in names])
    keep = [c for c in df.columns if not (drop and c in names)]
    return df.select(*keep, arr.alias(out))


def embedding_columns(columns: Iterable[str], prefix: str) -> list[str]:
    found = [c for c in columns if c.startswith(prefix) and c[len(prefix):].isdigit()]
    return sorted(found, key=lambda c: int(c[len(prefix):]))


def rename_select(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """B-P14: rename and keep exactly the mapped columns, in mapping order."""
    return df.select(*[F.col(src).alias(dst) for src, dst in mapping.items()])


def one_hot_categories(df: DataFrame, col: str) -> list[str]:
    """Fitted category list of B-P16 (distinct values, alphabetical).  The
    number of categories of a categorical feature is small by definition;
    the list is a model parameter, not data."""
    return [r[0] for r in df.select(col).distinct().orderBy(col).collect()]


def one_hot_drop_first(df: DataFrame, col: str, categories: Sequence[str],
                       prefix: str | None = None) -> DataFrame:
    """B-P16: dummies with the alphabetically first category as baseline;
    an unseen category encodes as all zeros (fitted once, T10)."""
    prefix = prefix or col
    cats = sorted(categories)[1:]
    return df.withColumns({f"{prefix}_{c}": (F.col(col) == F.lit(c)).cast("double") for c in cats}) \
             .na.fill(0.0, subset=[f"{prefix}_{c}" for c in cats])


def seeded_order(key: str | Column, seed: int = DEFAULT_SEED) -> Column:
    """Deterministic pseudo-random order: md5('<seed>:<key>'), equal in Spark and DuckDB."""
    return F.md5(F.concat(F.lit(f"{seed}:"), _c(key).cast("string")))


def seeded_unit(key: str | Column, seed: int = DEFAULT_SEED, salt: str = "") -> Column:
    """Uniform [0,1) double from the first 13 hex digits of md5(seed:salt:key)."""
    h = F.md5(F.concat(F.lit(f"{seed}:{salt}"), _c(key).cast("string")))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / float(16 ** 13)


def class_probabilities(df: DataFrame, col: str = "probability", names: Sequence[str] | None = None,
                        pred: str = "predicted_class") -> DataFrame:
    """B-P20: ML vector -> one column per class; predicted class = argmax."""
    from pyspark.ml.functions import vector_to_array
    arr = vector_to_array(F.col(col))
    names = list(names or ["prob_0", "prob_1"])
    out = df.withColumns({n: arr[i] for i, n in enumerate(names)})
    return out.withColumn(pred, (F.array_position(arr, F.array_max(arr)) - 1).cast("int"))


def round_doubles(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double/float column at the query boundary (§2 convention)."""
    cols = []
    for name, dtype in df.dtypes:
        if dtype in ("double", "float"):
            cols.append(F.round(F.col(name).cast("double"), places).alias(name))
        elif dtype.startswith("array<double") or dtype.startswith("array<float"):
            cols.append(F.transform(F.col(name), lambda x: F.round(x.cast("double"), places)).alias(name))
        else:
            cols.append(F.col(name))
    return df.select(*cols)


DOUBLE = T.DoubleType()
