"""Train / validation / test splits and repeatable sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry.config import CascadeConfig
from flowsentry.functions.columns import flow_time
from flowsentry.operators.prefix import cut_points, null_safe_join, with_ordinal, within_cut

LAST_MICROS = 2**52  # sorts after every real time and is still exact as a double


def _half_even(c: Column) -> Column:
    return F.bround(c.cast("double"), 0).cast("bigint")


def split_sizes(test_size: float, val_size: float) -> dict:
    """Sizes of the head that is train, and of the head that is train plus validation."""

    def head(n: Column) -> Column:
        return n - _half_even(n * F.lit(test_size))

    return {
        "train": lambda n: head(n) - _half_even(head(n) * F.lit(val_size)),
        "head": head,
    }


def _label_split(df: DataFrame, key: str, tie: str) -> DataFrame:
    split = (
        F.when(within_cut(F.col(key), F.col(tie), "train"), F.lit("train"))
        .when(within_cut(F.col(key), F.col(tie), "head"), F.lit("val"))
        .otherwise(F.lit("test"))
    )
    return df.withColumn("split", split)


def _with_cuts(df: DataFrame, key: str, tie: str, sizes: dict, by: list[str]) -> DataFrame:
    cuts = cut_points(df.select(*by, key, tie), key, tie, sizes, by)
    wanted = [f"{c}_{part}" for c in sizes for part in ("key", "tie")]
    if by:
        return null_safe_join(df, cuts.select(*by, *wanted), by)
    # Without groups the cuts are one row of numbers: they go into the plan as literals.
    row = cuts.first()
    return df.select("*", *[F.lit(row[c]).cast("bigint").alias(c) for c in wanted])


def _apply_cuts(df: DataFrame, key: str, tie: str, sizes: dict, by: list[str]) -> DataFrame:
    cut = _with_cuts(df, key, tie, sizes, by)
    return _label_split(cut, key, tie).select(*df.columns, "split")


def temporal_split(
    df: DataFrame,
    by_file: bool = True,
    test_size: float = 0.20,
    val_size: float = 0.20,
    time_col: str = "timestamp",
) -> DataFrame:
    """Add ``split``: earliest rows train, then val, latest test; per source file or over all.

    Rows without a time come last; equal times keep row_id order. Only a narrow (file, time,
    row_id) projection is counted; the wide rows just compare against the cuts.
    """
    if by_file and "source_file" not in df.columns:
        raise ValueError("a split by file needs a source_file column")
    time_key = F.coalesce(F.unix_micros(flow_time(df, time_col)), F.lit(LAST_MICROS))
    keyed = df.withColumn("_t", time_key)
    by = ["source_file"] if by_file else []
    return _apply_cuts(keyed, "_t", "row_id", split_sizes(test_size, val_size), by).drop("_t")


def sample_key(id_col: Column, seed: int) -> Column:
    """Order of a seeded shuffle: 52 hash bits, exact as a double."""
    return F.shiftrightunsigned(F.xxhash64(id_col, F.lit(seed)), 12)


def stratified_split(
    df: DataFrame, test_size: float = 0.20, val_size: float = 0.20, seed: int = 42, label: str = "binary_label"
) -> DataFrame:
    """Random split that keeps the label shares: a seeded hash order is cut per label."""
    keyed = df.withColumn("_h", sample_key(F.col("row_id"), seed))
    return _apply_cuts(keyed, "_h", "row_id", split_sizes(test_size, val_size), [label]).drop("_h")


def split_flows(df: DataFrame, cfg: CascadeConfig) -> DataFrame:
    if cfg.split_strategy == "random":
        return stratified_split(df, cfg.test_size, cfg.val_size, cfg.seed)
    if cfg.split_strategy in ("temporal", "temporal_by_file"):
        return temporal_split(df, cfg.split_strategy == "temporal_by_file", cfg.test_size, cfg.val_size)
    raise ValueError("split_strategy must be random, temporal or temporal_by_file")


def sample_rows(df: DataFrame, n: int, seed: int = 42, id_col: str = "row_id") -> DataFrame:
    """Exactly min(n, rows) rows, the same ones for the same seed, without sorting the table."""
    keyed = df.withColumn("_h", sample_key(F.col(id_col), seed))
    cut = _with_cuts(keyed, "_h", id_col, {"keep": lambda total: F.least(total, F.lit(n))}, [])
    return cut.filter(within_cut(F.col("_h"), F.col(id_col), "keep")).select(*df.columns)


def consecutive_sample(
    df: DataFrame, n: int, seed: int = 42, key: str = "_t", id_col: str = "row_id"
) -> DataFrame:
    """A run of n neighbouring rows in time order, starting at a seeded position."""
    numbered = with_ordinal(df, key, id_col, out="_ord")
    total = df.count()
    if total <= n:
        return df
    start = _seeded_start(total - n + 1, seed)
    return numbered.filter((F.col("_ord") > start) & (F.col("_ord") <= start + n)).drop("_ord")


def _seeded_start(choices: int, seed: int) -> int:
    import random

    return random.Random(seed).randrange(choices)


def time_order(df: DataFrame, nulls_first: bool = False, time_col: str = "timestamp") -> DataFrame:
    """Add ``_t``, a numeric time key that sorts missing times last (or first)."""
    missing = -LAST_MICROS if nulls_first else LAST_MICROS
    return df.withColumn("_t", F.coalesce(F.unix_micros(flow_time(df, time_col)), F.lit(missing)))


def calibration_split(splits: DataFrame, cfg: CascadeConfig) -> DataFrame:
    """Divide validation rows: ``part`` is calib for a benign sample, gate for the rest."""
    if not 0.05 <= cfg.calibration_fraction <= 0.95:
        raise ValueError("calibration_fraction must be between 0.05 and 0.95")
    val = splits.filter(F.col("split") == "val")
    benign = val.filter(F.col("binary_label") == 0)
    n = benign.count()
    if n < cfg.min_calibration_benign:
        raise ValueError("validation holds too few benign rows for calibration")
    n_cal = max(50, min(round(n * cfg.calibration_fraction), n - 50))
    # The sample is the head of a seeded order; its end goes into the plan as two numbers.
    keyed = benign.select("row_id", sample_key(F.col("row_id"), cfg.seed).alias("_h"))
    row = cut_points(keyed, "_h", "row_id", {"keep": lambda total: F.least(total, F.lit(n_cal))}).first()
    marked = val.withColumns({c: F.lit(row[c]).cast("bigint") for c in ("keep_key", "keep_tie")})
    calib = (F.col("binary_label") == 0) & within_cut(sample_key(F.col("row_id"), cfg.seed), F.col("row_id"), "keep")
    return marked.select(*val.columns, F.when(calib, F.lit("calib")).otherwise(F.lit("gate")).alias("part"))
