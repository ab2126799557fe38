"""Sharding by proportional stratified interleaving: every shard has the mixture of all rows.

The rows of each source are ranked in seeded order. Their fractional ranks (rank - 1/2) / n spread every
source evenly over [0, 1); sorted by these, rows are cut into shards of equal counts, so any stretch of
the order, and so any shard, holds each source in proportion (law `rows`).

No rank is taken in one task. Seeded digests, and then fractional ranks, are dealt into cells of a
bounded number of rows. A row's rank is the number of rows in the cells before it, from a running
total over the small table of cells (itself in two levels), plus its place in its own cell.

Defined results: a null text has size 1 and the CRC of no bytes; a null source is a stratum of its own.
Null ids and ties are ordered by digest, id, source, size and CRC; rows equal in all of these may change
places, which no output column shows. Extra columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import written

#: Rows of a cell, on average, and cells of a group of cells.
CELL_ROWS, CELL_GROUP = 1000, 1000
SEED = "shards"


def _before(cells: DataFrame, by: list[str]) -> DataFrame:
    """cells (by..., cell, n) with the number of rows in earlier cells of the same `by`, as column before."""
    group = F.floor(F.col("cell") / CELL_GROUP)
    cells = cells.withColumn("_group", group)
    totals = cells.groupBy(*by, "_group").agg(F.sum("n").alias("_n"))
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_groups_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*by, "_group").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    own = cells.withColumn("_cells_before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    joined = own.alias("l").join(totals.alias("r"), [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*by, "_group"]])
    return joined.select(*(F.col(f"l.{c}").alias(c) for c in [*by, "cell"]), (F.col("_groups_before") + F.col("_cells_before")).alias("before"))


def _ranked(rows: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    """rows (with column cell) with rank: rows before them, from 0, in the order of (cell, order) inside `by`."""
    cells = _before(rows.groupBy(*by, "cell").agg(F.count("*").alias("n")), by)
    place = F.row_number().over(Window.partitionBy(*by, "cell").orderBy(*order)) - 1
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*by, "cell"]]
    joined = rows.alias("l").join(cells.alias("r"), on).select("l.*", "r.before")
    return joined.withColumn("rank", F.col("before") + place).drop("before", "cell")


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot and grown_shard (null under this law)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.col(source_col).alias("_source"),
        (F.octet_length(text) + 1).cast("long").alias("_size"),
        F.crc32(text.cast("binary")).cast("long").alias("_crc"),
        digest.alias("_digest"),
    )
    rows = written(rows, "shard-rows")
    total = rows.count()
    cells = max(1, -(-total // CELL_ROWS))
    tie = ["_digest", "_id", "_source", "_size", "_crc"]
    drawn = F.conv(F.substring("_digest", 1, 8), 16, 10).cast("long")
    dealt = rows.withColumn("cell", F.floor(drawn * F.lit(cells) / F.lit(2.0**32)))
    # A null source is marked, so that joins and windows treat it as one stratum.
    dealt = dealt.withColumn("stratum", F.when(F.col("_source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("_source").cast("string"))))
    counts = dealt.groupBy("stratum").agg(F.count("*").alias("n"))
    ranked = _ranked(dealt, ["stratum"], tie).join(counts, "stratum")
    # Twice the fractional rank in whole numbers: (2 rank + 1) / (2 n).
    fraction = (2 * F.col("rank") + 1) / (2 * F.col("n"))
    spread = ranked.withColumn("fraction", fraction).withColumn("cell", F.least(F.floor(F.col("fraction") * cells), F.lit(cells - 1).cast("long")))
    spread = spread.withColumnRenamed("rank", "own_rank").drop("n")
    placed = _ranked(spread, [], ["fraction", "stratum", "own_rank"])
    own = F.expr(f"((rank + 1) * {shards} - 1) div {max(1, total)}")
    out = placed.withColumn("shard", own.cast("int"))
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        (F.col("rank") - F.expr(f"shard * {total}L div {shards}")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
