"""Column expressions: ratios, buckets, row-wise statistics, cleaning. All run inside codegen."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Age limits in years with the bucket number below each limit.
AGE_LIMITS = [(27, 1), (40, 2), (50, 3), (65, 4), (99, 5)]
DAYS_SENTINEL = 365243


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def to_number(value: Column | str) -> Column:
    """Text or number to double; anything unreadable becomes null."""
    return as_col(value).try_cast("double")


def safe_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Zero, null or unreadable denominators give null, never infinity."""
    return F.try_divide(to_number(numerator), to_number(denominator))


def not_value(value: Column | str, junk) -> Column:
    """Keep every row except those equal to ``junk``; null rows stay."""
    return ~as_col(value).eqNullSafe(F.lit(junk))


def sentinel_to_null(df: DataFrame, columns: Iterable[str], sentinel=DAYS_SENTINEL) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: F.nullif(F.col(c), F.lit(sentinel)) for c in present})


def finite_or_null(value: Column | str) -> Column:
    c = as_col(value).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def positive_part(value: Column | str) -> Column:
    """Clip at zero, keeping null (``greatest`` would turn null into zero)."""
    c = as_col(value)
    return F.when(c.isNotNull(), F.greatest(c, F.lit(0)))


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0; unknown counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def age_bucket(days_birth: Column | str) -> Column:
    years = -as_col(days_birth).cast("double") / F.lit(365)
    out = F.when(years < AGE_LIMITS[0][0], AGE_LIMITS[0][1])
    for limit, code in AGE_LIMITS[1:]:
        out = out.when(years < limit, code)
    return out.otherwise(0)


def date_parts(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """``_year``, ``_month`` and ``_dayofweek`` (Monday is 0) for every timestamp column."""
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]
    parts = {}
    for c in columns:
        parts[f"{c}_year"] = F.year(c)
        parts[f"{c}_month"] = F.month(c)
        parts[f"{c}_dayofweek"] = F.weekday(c)
    return df.withColumns(parts)


# --- row-wise statistics over a list of columns; null entries are skipped -----------------


def _present(columns: Sequence[str]) -> Column:
    return F.array_compact(F.array(*[F.col(c).cast("double") for c in columns]))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def row_sum(columns: Sequence[str]) -> Column:
    return _total(_present(columns))


def row_product(columns: Sequence[str]) -> Column:
    """Product of the present values; 1 if all are null."""
    return F.aggregate(_present(columns), F.lit(1.0), lambda acc, x: acc * x)


def row_min(columns: Sequence[str]) -> Column:
    return F.array_min(_present(columns))


def row_max(columns: Sequence[str]) -> Column:
    return F.array_max(_present(columns))


def row_mean(columns: Sequence[str]) -> Column:
    values = _present(columns)
    return F.try_divide(_total(values), F.size(values))


def row_median(columns: Sequence[str]) -> Column:
    ordered = F.array_sort(_present(columns))
    n = F.size(ordered)
    low = F.get(ordered, F.floor((n - 1) / F.lit(2)).cast("int"))
    high = F.get(ordered, F.floor(n / F.lit(2)).cast("int"))
    return F.when(n > 0, (low + high) / F.lit(2))


def row_variance(columns: Sequence[str]) -> Column:
    """Sample variance; null with fewer than two values."""
    values = _present(columns)
    mean = F.try_divide(_total(values), F.size(values))
    squares = _total(F.transform(values, lambda x: (x - mean) * (x - mean)))
    return F.when(F.size(values) > 1, F.try_divide(squares, F.size(values) - 1))


def row_weighted_sum(weights: Mapping[str, float]) -> Column:
    """Plain weighted sum; any null input makes the result null."""
    terms = [F.col(c).cast("double") * F.lit(float(w)) for c, w in weights.items()]
    out = terms[0]
    for term in terms[1:]:
        out = out + term
    return out


def row_kurtosis(columns: Sequence[str]) -> Column:
    """Bias-corrected excess kurtosis; null below four values, 0 without spread."""
    values = _present(columns)
    n = F.size(values).cast("double")
    mean = F.try_divide(_total(values), n)
    second = _total(F.transform(values, lambda x: F.pow(x - mean, F.lit(2.0))))
    fourth = _total(F.transform(values, lambda x: F.pow(x - mean, F.lit(4.0))))
    adjust = F.lit(3.0) * F.try_divide((n - 1) * (n - 1), (n - 2) * (n - 3))
    lead = F.try_divide(n * (n + 1) * (n - 1), (n - 2) * (n - 3))
    value = lead * F.try_divide(fourth, second * second) - adjust
    return F.when(n < 4, F.lit(None).cast("double")).when(second == 0, F.lit(0.0)).otherwise(value)


# --- column names -------------------------------------------------------------------------


def clean_name(name: str, rule: str = "underscore") -> str:
    """``underscore``: runs of other characters become one ``_``, outer ``_`` are cut.
    ``delete``: white space becomes ``_``, other characters vanish."""
    if rule == "underscore":
        return re.sub(r"[^A-Za-z0-9_]+", "_", name).strip("_")
    return re.sub(r"[^0-9a-zA-Z_]+", "", re.sub(r"\s+", "_", name))


def clean_names(df: DataFrame, rule: str = "underscore") -> DataFrame:
    """Sanitized column names; a name met before gets ``_2``, ``_3`` ..."""
    seen: set[str] = set()
    renamed = []
    for column in df.columns:
        base = clean_name(column, rule)
        name, count = base, 1
        while name.lower() in seen:
            count += 1
            name = f"{base}_{count}"
        seen.add(name.lower())
        renamed.append(name)
    return df.toDF(*renamed)
