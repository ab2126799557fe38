"""Sliding windows of consecutive rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsentry.config import SEQUENCE_LENGTH
from flowsentry.operators.prefix import with_ordinal

BLOCK = 8192


def sequence_windows(
    df: DataFrame,
    values: str,
    key: str = "_t",
    tie: str = "row_id",
    seq_len: int = SEQUENCE_LENGTH,
    by: Sequence[str] = (),
    block: int = BLOCK,
) -> DataFrame:
    """One row per full window: its last row's id, its ordinal, and the ``seq_len`` values.

    Rows are numbered in (key, tie) order and cut into blocks. The last seq_len-1 rows of a
    block are copied into the next one, so no window crosses a task boundary however long the
    sequence of one group is.
    """
    if seq_len > block:
        raise ValueError("seq_len must not exceed the block size")
    by = list(by)
    numbered = with_ordinal(df.select(*by, key, tie, values), key, tie, by=by, out="ordinal")
    index = F.col("ordinal") - 1
    home = F.floor(index / F.lit(block)).cast("bigint")
    offset = index % block
    blocks = F.when(
        offset >= block - (seq_len - 1), F.array(home, home + 1)
    ).otherwise(F.array(home))
    spread = numbered.withColumn("_home", home).withColumn("_block", F.explode(blocks))
    rows = Window.partitionBy(*by, "_block").orderBy("ordinal").rowsBetween(-(seq_len - 1), 0)
    return (
        spread.withColumn("window", F.collect_list(values).over(rows))
        .filter((F.col("_block") == F.col("_home")) & (F.col("ordinal") >= seq_len))
        .select(*by, tie, "ordinal", "window")
    )


def align_scores(
    rows: DataFrame, window_scores: DataFrame, seq_len: int = SEQUENCE_LENGTH, by: Sequence[str] = ()
) -> DataFrame:
    """Score per row: a window's score belongs to its last row; rows before the first full
    window copy the first score. ``rows`` has row_id and ordinal, ``window_scores`` has row_id,
    ordinal and score."""
    by = list(by)
    scored = rows.join(window_scores.select("row_id", "score"), "row_id", "left")
    first = window_scores.filter(F.col("ordinal") == seq_len).select(*by, F.col("score").alias("_first"))
    if by:
        filled = scored.join(first, by, "left")
    else:
        row = first.first()  # a single window
        filled = scored.withColumn("_first", F.lit(row["_first"] if row else None).cast("double"))
    return filled.select(
        *rows.columns,
        F.coalesce(
            "score", F.when(F.col("ordinal") < seq_len, F.col("_first")), F.lit(0.0)
        ).alias("score"),
    )
