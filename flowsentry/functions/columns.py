"""Column naming, typing and safe numeric access."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsentry.config import COLUMN_ALIASES, NON_FEATURE_COLUMNS

_CANONICAL = {alias: name for name, aliases in COLUMN_ALIASES.items() for alias in aliases}


def col(name: str) -> Column:
    """Column by exact name, also when it holds dots or slashes."""
    return F.col("`" + name.replace("`", "``") + "`")


def canonical_name(name: str) -> str:
    trimmed = name.strip()
    return _CANONICAL.get(trimmed.lower(), trimmed)


def unique_names(names: Iterable[str]) -> list[str]:
    """Number repeated names ``x``, ``x.1``, ``x.2`` so each can be addressed."""
    taken: set[str] = set()
    result = []
    for name in names:
        candidate, n = name, 0
        while candidate in taken:
            n += 1
            candidate = f"{name}.{n}"
        taken.add(candidate)
        result.append(candidate)
    return result


def canonicalize_columns(df: DataFrame) -> DataFrame:
    """Rename every known header spelling to its canonical name."""
    return df.toDF(*unique_names(canonical_name(c) for c in df.columns))


def first_existing(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """The first candidate present in ``df``, compared without case."""
    by_lower = {c.lower(): c for c in df.columns}
    return next((by_lower[c.lower()] for c in candidates if c.lower() in by_lower), None)


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def to_double(c: Column) -> Column:
    """Parse to double; unreadable text and NaN become null."""
    value = c.try_cast("double")
    return F.when(~F.isnan(value), value)


def number(df: DataFrame, name: str, default: float = 0.0) -> Column:
    """A numeric column with a default; a constant when the column does not exist."""
    fallback = F.lit(float(default))
    if name not in df.columns:
        return fallback
    text = isinstance(df.schema[name].dataType, T.StringType)
    value = col(name).try_cast("double") if text else col(name).cast("double")
    return F.coalesce(F.nanvl(value, fallback), fallback)


def finite(c: Column) -> Column:
    """Null for NaN and both infinities."""
    return F.when(~(F.isnan(c) | (F.abs(c) == F.lit(float("inf")))), c)


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def numeric_and_categorical(df: DataFrame, features: Sequence[str]) -> tuple[list[str], list[str]]:
    types = {f.name: f.dataType for f in df.schema.fields}
    numeric = [c for c in features if is_numeric(types[c])]
    return numeric, [c for c in features if c not in numeric]


def feature_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Every column but labels, ids, endpoints and the ones named in ``exclude``."""
    hidden = set(NON_FEATURE_COLUMNS) | {canonical_name(c) for c in exclude}
    chosen = [c for c in df.columns if c not in hidden]
    if not chosen:
        raise ValueError("no feature columns left after exclusions")
    return chosen


FLOW_TIME_FORMATS = ["yyyy-MM-dd HH:mm:ss[.SSSSSS]", "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy h:mm:ss a"]


def flow_time(df: DataFrame, name: str = "timestamp") -> Column:
    """Flow timestamp as ``timestamp``; unreadable text becomes null."""
    if name not in df.columns:
        return F.lit(None).cast("timestamp")
    data_type = df.schema[name].dataType
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return col(name).cast("timestamp")
    text = F.trim(col(name).cast("string"))
    parsed = [F.try_to_timestamp(text, F.lit(fmt)) for fmt in FLOW_TIME_FORMATS]
    return F.coalesce(text.try_cast("timestamp"), *parsed)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def floor_bucket(value: Column, width: int) -> Column:
    """Number of the tumbling bucket of ``width`` that holds an integer value."""
    w = F.lit(width)
    return ((value - F.pmod(value, w)) / w).cast("bigint")


def unit_hash(key: Column, seed: int) -> Column:
    """A repeatable uniform number in [0, 1) per key."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double") * F.lit(2.0**-53)
