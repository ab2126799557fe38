"""Column statistics used for imputation, scaling and class weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.functions.columns import col
from flowsentry.operators.prefix import quantiles
from flowsentry.session import materialize


def long_form(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per cell: feature name and value."""
    return df.select(*[col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "feature", "value"
    )


def numeric_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per feature: exact median, and mean and population deviation after median imputation."""
    # Equal values collapse before the shuffle; the input is read once, into these counts.
    counted = materialize(long_form(df, columns).groupBy("feature", "value").agg(F.count("*").alias("n")), "value-counts")
    medians = quantiles(counted, "value", [0.5], by=["feature"], weight="n").select(
        "feature", F.col("quantile").alias("median")
    )
    moments = counted.groupBy("feature").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing"),
        F.sum(F.col("value") * F.col("n")).alias("s"),
    )
    filled = (
        counted.join(F.broadcast(medians), "feature", "left")
        .join(F.broadcast(moments), "feature")
        .withColumn("x", F.coalesce("value", "median"))
        .withColumn("mean", (F.coalesce("s", F.lit(0.0)) + F.col("missing") * F.col("median")) / F.col("rows"))
    )
    return filled.groupBy("feature").agg(
        F.first("rows").alias("rows"),
        F.first("missing").alias("missing"),
        F.first("median").alias("median"),
        F.first("mean").alias("mean"),
        F.sqrt(
            F.sum(F.col("n") * F.pow(F.col("x") - F.col("mean"), 2)) / F.first("rows")
        ).alias("std"),
    )


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per feature: the most frequent value (smallest text wins ties)."""
    cells = df.select(*[col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], list(columns), "feature", "value"
    )
    counted = cells.filter(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count("*").alias("n"))
    return counted.groupBy("feature").agg(
        F.max("n").alias("n"), F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode")
    )


def class_weights(df: DataFrame, label: str = "binary_label") -> DataFrame:
    """Balanced weight of each class: half the rows over the class's rows."""
    counts = df.agg(
        F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg")
    )
    total = F.col("n_pos") + F.col("n_neg")
    usable = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return counts.select(
        "n_pos",
        "n_neg",
        F.when(usable, 0.5 * total / F.col("n_pos")).otherwise(1.0).alias("w_pos"),
        F.when(usable, 0.5 * total / F.col("n_neg")).otherwise(1.0).alias("w_neg"),
    )


def with_class_weight(df: DataFrame, label: str = "binary_label", out: str = "weight") -> DataFrame:
    w = class_weights(df, label).first()
    return df.withColumn(out, F.when(F.col(label) == 1, F.lit(w["w_pos"])).otherwise(F.lit(w["w_neg"])))
