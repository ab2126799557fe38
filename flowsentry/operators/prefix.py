"""Ordered computations over a whole table without a single-task window.

Spark runs a window without a partition key, or with one hot key, in one task. The
operators here cut the ordering key into ranges first. The range bounds are plain
numbers taken from the data by ``approxQuantile``; whatever they are, the result is
exact, and because they are literals in the plan a recomputed task sees the same ranges.

A running total is then: totals per range (a small table) plus a window inside a range.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsentry.session import materialize

RANGE = "_range"


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; keys come from the left side."""
    other = right.select(*[F.col(c).alias(f"_right_{c}") if c in keys else F.col(c) for c in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(other, on, how).drop(*[f"_right_{k}" for k in keys])


def range_count(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def range_bounds(df: DataFrame, key: str, n: int | None = None) -> list[float]:
    """Sorted quantiles of a numeric key; a value held by many rows appears more than once."""
    n = n or range_count(df)
    numbers = df.select(F.col(key).cast("double").alias(key))
    probs = [i / n for i in range(1, n)]
    return sorted(numbers.approxQuantile(key, probs, 1.0 / (4 * n)))


def with_range(df: DataFrame, key: str, bounds: Sequence[float], out: str = RANGE) -> DataFrame:
    """Number the range of ``bounds`` that holds the key."""
    distinct = sorted(set(bounds))
    if not distinct:
        return df.withColumn(out, F.lit(0))
    bucketizer = Bucketizer(
        splits=[-math.inf, *distinct, math.inf], inputCol="_range_key", outputCol="_bucket", handleInvalid="keep"
    )
    cut = bucketizer.transform(df.withColumn("_range_key", F.col(key).cast("double")))
    return cut.withColumn(out, F.col("_bucket").cast("int")).drop("_range_key", "_bucket")


def running_totals(
    df: DataFrame,
    key: str,
    sums: Mapping[str, Column],
    by: Sequence[str] = (),
    descending: bool = False,
) -> DataFrame:
    """Totals per distinct key and their running totals in key order.

    One row per (``by``, ``key``) with, for each name in ``sums``: the total at the key
    (``name``), through the key (``cum_name``) and over the group (``total_name``); plus
    ``next_key``, the key that follows. Equal keys collapse in the map-side aggregation, so
    neither a hot key nor a hot group reaches one task. ``key`` must be numeric and not null.
    """
    by = list(by)
    bounds = range_bounds(df, key)
    points = df.groupBy(*by, key).agg(*[F.sum(expr).alias(name) for name, expr in sums.items()])
    points = with_range(points, key, bounds)

    order = F.col(key).desc() if descending else F.col(key).asc()
    range_order = F.col(RANGE).desc() if descending else F.col(RANGE).asc()
    group = by or [F.lit(0)]

    ranges = points.groupBy(*by, RANGE).agg(
        *[F.sum(name).alias(f"_sum_{name}") for name in sums],
        (F.max(key) if descending else F.min(key)).alias("_first_key"),
    )
    # At most one row per group and range: a window over this table stays small.
    before = Window.partitionBy(*group).orderBy(range_order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    ranges = ranges.select(
        *by,
        RANGE,
        *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in sums],
        *[F.sum(f"_sum_{n}").over(whole).alias(f"total_{n}") for n in sums],
        F.lead("_first_key").over(Window.partitionBy(*group).orderBy(range_order)).alias("_next_first"),
    )
    if not by:
        # Bounded by the number of ranges, never by the data.
        ranges = F.broadcast(ranges)

    inside = Window.partitionBy(*by, RANGE).orderBy(order)
    through = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = points.select(
        *by,
        key,
        RANGE,
        *sums,
        *[F.sum(n).over(through).alias(f"_local_{n}") for n in sums],
        F.lead(key).over(inside).alias("_next_local"),
    )
    return null_safe_join(local, ranges, [*by, RANGE]).select(
        *by,
        key,
        *sums,
        *[(F.col(f"_before_{n}") + F.col(f"_local_{n}")).alias(f"cum_{n}") for n in sums],
        *[F.col(f"total_{n}") for n in sums],
        F.coalesce("_next_local", "_next_first").alias("next_key"),
    )


def _order_ranges(df: DataFrame, key: str, tie: str) -> DataFrame:
    """Ranges of (key, tie) in order. A key value held by many rows gets a range of its own, which
    is then cut further by the tie column, into as many parts as it fills ranges. So there are
    never more than about twice as many ranges as asked for."""
    bounds = range_bounds(df, key)
    hot = sorted({b for b in bounds if bounds.count(b) > 1})
    after_hot = [math.nextafter(h, math.inf) for h in hot]
    cut = with_range(df, key, [*bounds, *after_hot], out="_r1")
    if not hot:
        return cut.withColumn("_r2", F.lit(0))
    tie_bounds = range_bounds(df, tie)
    cut = with_range(cut, tie, tie_bounds, out="_tie_range")
    parts = F.create_map(*[F.lit(x) for h in hot for x in (h, bounds.count(h) + 1)])
    share = F.floor(F.col("_tie_range") * parts[F.col(key).cast("double")] / F.lit(len(set(tie_bounds)) + 1))
    return cut.withColumn("_r2", F.coalesce(share, F.lit(0)).cast("int")).drop("_tie_range")


def with_ordinal(
    df: DataFrame, key: str, tie: str, by: Sequence[str] = (), out: str = "ordinal"
) -> DataFrame:
    """Number rows 1, 2, 3, ... in order of (key, tie) inside each group.

    ``tie`` must make the order total. Keys must be numeric and not null.
    """
    by = list(by)
    cut = _order_ranges(df, key, tie)
    group = by or [F.lit(0)]
    before = (
        Window.partitionBy(*group).orderBy("_r1", "_r2").rowsBetween(Window.unboundedPreceding, -1)
    )
    sizes = cut.groupBy(*by, "_r1", "_r2").agg(F.count("*").alias("_n"))
    offsets = sizes.select(
        *by, "_r1", "_r2", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    if not by:
        offsets = F.broadcast(offsets)
    local = Window.partitionBy(*by, "_r1", "_r2").orderBy(key, tie)
    numbered = cut.withColumn("_local", F.row_number().over(local))
    return (
        null_safe_join(numbered, offsets, [*by, "_r1", "_r2"])
        .withColumn(out, F.col("_before") + F.col("_local"))
        .select(*df.columns, out)
    )


def cut_points(
    df: DataFrame,
    key: str,
    tie: str,
    sizes: Mapping[str, Callable[[Column], Column]],
    by: Sequence[str] = (),
) -> DataFrame:
    """Where the first k rows of each group end, in order of (key, tie).

    ``sizes`` names each cut and gives its k as a function of the group's row count. One row per group: ``n`` and, per cut, ``<name>_k``, ``<name>_key`` and
    ``<name>_tie``. See :func:`within_cut`. Rows are never sorted: keys are counted, and only
    rows that share the key at a cut are looked at again.
    """
    by = list(by)
    names = list(sizes)
    counted = running_totals(df, key, {"n": F.lit(1)}, by=by)
    with_k = counted.select(
        *by, key, "n", "cum_n", "total_n", *[sizes[c](F.col("total_n")).alias(f"{c}_k") for c in names]
    )
    before = F.col("cum_n") - F.col("n")

    def at_cut(c: str) -> Column:
        return (before < F.col(f"{c}_k")) & (F.col(f"{c}_k") <= F.col("cum_n"))

    found = with_k.groupBy(*by).agg(
        F.first("total_n").alias("n"),
        *[F.first(f"{c}_k").alias(f"{c}_k") for c in names],
        *[F.max(F.when(at_cut(c), F.col(key))).alias(f"{c}_key") for c in names],
        *[F.max(F.when(at_cut(c), F.col(f"{c}_k") - before)).alias(f"_{c}_take") for c in names],
        *[F.max(F.when(at_cut(c), F.col("n"))).alias(f"_{c}_ties") for c in names],
    )
    # One row per group, read again below and by the caller.
    found = materialize(found, "cuts")
    # A cut inside a run of equal keys is settled by the tie column.
    split_run = found.select(
        *by,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("_cut"),
                        F.col(f"{c}_key").alias(key),
                        F.col(f"_{c}_take").alias("_take"),
                        F.col(f"_{c}_ties").alias("_ties"),
                    )
                    for c in names
                ]
            )
        ).alias("s"),
    ).select(*by, "s.*").filter(F.col("_take") < F.col("_ties"))
    if split_run.isEmpty():
        return found.select(
            *by,
            "n",
            *[F.col(f"{c}_k") for c in names],
            *[F.col(f"{c}_key") for c in names],
            *[F.lit(None).cast("bigint").alias(f"{c}_tie") for c in names],
        )
    tied = null_safe_join(df.select(*by, key, tie), split_run, [*by, key])
    ranked = running_totals(tied, tie, {"n": F.lit(1), "take_n": F.col("_take")}, by=[*by, "_cut"])
    settled = (
        ranked.filter(F.col("cum_n") == F.col("take_n"))
        .groupBy(*(by or [F.lit(0).alias("_all")]))
        .agg(*[F.max(F.when(F.col("_cut") == c, F.col(tie))).alias(f"{c}_tie") for c in names])
    )
    if by:
        joined = null_safe_join(found, settled, by, "left")
    else:
        joined = found.withColumn("_all", F.lit(0)).join(settled, "_all", "left")
    return joined.select(
        *by,
        "n",
        *[F.col(f"{c}_k") for c in names],
        *[F.col(f"{c}_key") for c in names],
        *[F.col(f"{c}_tie") for c in names],
    )


def within_cut(key: Column, tie: Column, cut: str) -> Column:
    """True for the rows a cut of :func:`cut_points` keeps (its columns must be joined in)."""
    cut_key, cut_tie = F.col(f"{cut}_key"), F.col(f"{cut}_tie")
    return F.coalesce(
        (key < cut_key) | ((key == cut_key) & (cut_tie.isNull() | (tie <= cut_tie))), F.lit(False)
    )


def quantiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Exact linearly interpolated quantiles: one row per group and probability.

    Columns: ``by``, ``q`` and ``quantile``. Null values are ignored. ``weight`` names a column
    that tells how many rows a row stands for.
    """
    by = list(by)
    times = F.col(weight) if weight else F.lit(1)
    present = df.select(*by, F.col(value).cast("double").alias("_v"), times.alias("_w"))
    counted = running_totals(present.filter(F.col("_v").isNotNull()), "_v", {"n": F.col("_w")}, by=by)
    wanted = counted.withColumn("q", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    pos = (F.col("total_n") - 1) * F.col("q")
    lo = F.floor(pos) + 1
    # The upper neighbour is the same value inside a run of equal values, else the next one.
    hi_value = F.when(F.col("cum_n") >= lo + 1, F.col("_v")).otherwise(F.coalesce("next_key", "_v"))
    at_lo = (F.col("cum_n") - F.col("n") < lo) & (lo <= F.col("cum_n"))
    return wanted.filter(at_lo).select(
        *by, "q", (F.col("_v") + (hi_value - F.col("_v")) * (pos - F.floor(pos))).alias("quantile")
    )
