"""Attack labels."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry.config import LABEL_CLASSES, REPORT_CLASS_ORDER
from flowsentry.functions.columns import col

BENIGN = "BENIGN"
UNKNOWN = "UNKNOWN"


def label_column(df: DataFrame) -> str:
    for name in ("label", "Label", " Label", "class", "Class"):
        if name in df.columns:
            return name
    raise ValueError("no label column: expected label or class")


def _lookup(mapping: dict) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))


def normalize_label(label: Column) -> Column:
    """Canonical class of a label; unknown text passes through trimmed, null is UNKNOWN."""
    text = F.trim(label.cast("string"))
    # A dash lost to a wrong decoding (U+0096 or U+FFFD) still means the dash.
    key = F.lower(F.translate(text, "\u0096�", "––"))
    return F.coalesce(F.try_element_at(_lookup(LABEL_CLASSES), key), text, F.lit(UNKNOWN))


def with_labels(df: DataFrame) -> DataFrame:
    """Replace the raw label by ``multiclass_label`` and add ``binary_label``."""
    raw = label_column(df)
    named = df.withColumn("multiclass_label", normalize_label(col(raw)))
    if raw != "multiclass_label":
        named = named.drop(raw)
    return named.withColumn("binary_label", (F.col("multiclass_label") != BENIGN).cast("int"))


def is_attack_label(label: Column) -> Column:
    return ~F.upper(F.trim(F.coalesce(label, F.lit("")))).isin("", BENIGN)


def class_rank(label: Column) -> Column:
    """Position of a class in reports; classes outside the fixed order come last."""
    order = {name: i for i, name in enumerate(REPORT_CLASS_ORDER)}
    return F.coalesce(F.try_element_at(_lookup(order), label), F.lit(9999))
