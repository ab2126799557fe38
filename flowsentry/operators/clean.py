"""Cleaning of flow tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsentry.functions.columns import col, finite
from flowsentry.functions.labels import UNKNOWN, with_labels
from flowsentry.session import materialize


def infinities_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN and both infinities by null in every floating-point column."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[finite(col(c)).alias(c) if c in floating else col(c) for c in df.columns])


def drop_sparse_rows(df: DataFrame, max_missing_fraction: float = 0.30) -> DataFrame:
    """Keep rows whose share of null cells, over all columns, is at most the limit."""
    nulls = sum(col(c).isNull().cast("int") for c in df.columns)
    return df.filter(nulls / F.lit(len(df.columns)) <= max_missing_fraction)


def all_null_columns(df: DataFrame) -> list[str]:
    """Columns without a single value: one aggregate, one row back."""
    filled = df.agg(*[F.bool_or(col(c).isNotNull()).alias(f"c{i}") for i, c in enumerate(df.columns)])
    row = filled.first()
    return [c for i, c in enumerate(df.columns) if not row[f"c{i}"]]


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    return df.drop(*all_null_columns(df))


#: Cells of the filter for rows that may be repeated.
CELLS = 1 << 20


def drop_duplicate_rows(df: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Keep the first (lowest id) of rows that agree on every other column; null equals null.

    Hashes of rows are counted first, as narrow rows. A row in whose cell no hash repeats is kept as it is, without a
    shuffle: the cells with a repeated hash are a broadcast of fixed size. Only the other rows are compared in full.
    """
    others = [c for c in df.columns if c != id_col]
    # Nulls are left out of a hash, so which columns are null is hashed as well.
    hashed = F.xxhash64(*[col(c) for c in others], F.concat(*[F.when(col(c).isNull(), "1").otherwise("0") for c in others]))
    repeated = df.select(hashed.alias("_h")).groupBy("_h").agg(F.count("*").alias("_n")).filter(F.col("_n") > 1)
    cells = F.broadcast(materialize(repeated.select(F.pmod("_h", F.lit(CELLS)).alias("_cell")).distinct(), "repeated-cells"))
    marked = df.withColumn("_cell", F.pmod(hashed, F.lit(CELLS)))
    single = marked.join(cells, "_cell", "left_anti").select(*[col(c) for c in df.columns])
    again = marked.join(cells, "_cell", "left_semi")
    kept = again.groupBy(*[col(c) for c in others]).agg(F.min(id_col).alias(id_col))
    return single.unionByName(kept.select(*[col(c) for c in df.columns]))


def clean_flows(
    df: DataFrame, max_missing_fraction: float = 0.30, drop_unknown_labels: bool = True
) -> DataFrame:
    """Labels, infinities, sparse rows, empty columns and duplicates, in that order."""
    labelled = with_labels(df)
    if drop_unknown_labels:
        labelled = labelled.filter(F.col("multiclass_label") != UNKNOWN)
    kept = drop_sparse_rows(infinities_to_null(labelled), max_missing_fraction)
    return drop_duplicate_rows(drop_all_null_columns(kept))
