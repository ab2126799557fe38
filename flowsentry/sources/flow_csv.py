"""Flow CSV folders."""

from __future__ import annotations

import csv
from collections import defaultdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsentry.functions.columns import canonical_name, unique_names
from flowsentry.schema import FLOW_TEXT
from flowsentry.session import materialize

MAX_BROADCAST_BLOCKS = 1_000_000


def list_files(spark: SparkSession, folder: str, pattern: str = "*.[cC][sS][vV]") -> DataFrame:
    """Files below a folder with their size (path, length): a listing, contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(folder)
        .select("path", "length")
    )


def flow_paths(spark: SparkSession, folder: str) -> list[str]:
    """Sorted CSV paths; paths that differ only in case count once."""
    paths = sorted(r["path"] for r in list_files(spark, folder).select("path").collect())
    if not paths:
        raise FileNotFoundError(f"no CSV files below {folder}")
    return list({p.lower(): p for p in reversed(paths)}.values())[::-1]


def header_columns(header: str) -> list[str]:
    """Column names of a header line: trimmed, canonical, repeated ones numbered."""
    names = next(csv.reader([header.lstrip("﻿")]))
    return unique_names(canonical_name(n) for n in unique_names(n.strip() for n in names))


def flow_schema(columns: list[str]) -> T.StructType:
    return T.StructType(
        [
            T.StructField(c, T.StringType() if c.lower() in FLOW_TEXT else T.DoubleType(), True)
            for c in columns
        ]
    )


def file_heads(spark: SparkSession, paths: list[str]) -> dict[str, tuple[str, bool]]:
    """For each file its first line, and whether its text is not valid UTF-8 (a replacement
    character appears). One pass over the text for all files; a row per file comes back."""
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("at")).alias("place"),
        "value",
    )
    heads = lines.groupBy("path").agg(
        F.min_by("value", "place").alias("header"), F.bool_or(F.col("value").contains("�")).alias("legacy")
    )
    return {_plain(r["path"]): (r["header"], r["legacy"]) for r in heads.collect()}


def _plain(path: str) -> str:
    return path.replace("file:///", "file:/")


def read_flow_folder(
    spark: SparkSession, folder: str, check_encoding: bool = True, header: str | None = None
) -> DataFrame:
    """Every flow CSV below a folder as one table with ``source_file`` and ``row_id``.

    Files are grouped by header, each group is one scan, and groups are united by name (absent
    columns become null). Files that are not UTF-8 are read as windows-1252; empty files are left
    out. With ``header``, which all files then share, and without ``check_encoding`` no text is
    read beforehand.
    """
    paths = flow_paths(spark, folder)
    heads = file_heads(spark, paths) if check_encoding or header is None else {}
    groups: dict[tuple, list[str]] = defaultdict(list)
    for path in paths:
        line, legacy = heads.get(_plain(path), (header, False))
        line = header if header is not None else line
        if line is None:
            continue
        encoding = "windows-1252" if legacy and check_encoding else "UTF-8"
        groups[(tuple(header_columns(line)), encoding)].append(path)
    scans = [
        spark.read.schema(flow_schema(list(columns)))
        .option("header", "true")
        .option("enforceSchema", "true")
        .option("encoding", encoding)
        .option("positiveInf", "Infinity")
        .option("negativeInf", "-Infinity")
        .option("ignoreLeadingWhiteSpace", "true")
        .option("ignoreTrailingWhiteSpace", "true")
        .csv(files)
        .select(
            "*",
            F.col("_metadata.file_path").alias("_path"),
            F.col("_metadata.file_block_start").alias("_block"),
        )
        for (columns, encoding), files in groups.items()
    ]
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)
    named = united.withColumn("source_file", F.substring_index("_path", "/", -1))
    return number_rows(named)


def number_rows(scan: DataFrame) -> DataFrame:
    """Add ``row_id``: position over all files in path order, from 0.

    Rows of one file block are neighbours in their task, so a row's place in its block is its
    running id minus the smallest running id of the block. Only the per-block counts are
    brought together, in one task: a row per 128 MB of text. Up to a million blocks they are
    broadcast and the rows are not shuffled; beyond that the join decides for itself.
    """
    marked = scan.withColumn("_mid", F.monotonically_increasing_id())
    blocks = marked.groupBy("_path", "_block").agg(F.min("_mid").alias("_first"), F.count("*").alias("_n"))
    before = Window.orderBy("_path", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        "_path", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    offsets = materialize(offsets, "block-offsets")
    if offsets.count() <= MAX_BROADCAST_BLOCKS:
        offsets = F.broadcast(offsets)
    columns = [c for c in scan.columns if c not in ("_path", "_block")]
    return marked.join(offsets, ["_path", "_block"]).select(
        *[F.col(f"`{c}`") for c in columns], (F.col("_before") + F.col("_mid") - F.col("_first")).alias("row_id")
    )


def union_files(*frames: DataFrame) -> DataFrame:
    """Union by name; a column absent from one side becomes null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def file_diagnostics(spark: SparkSession, requested: DataFrame, folder: str, rows: DataFrame) -> DataFrame:
    """Per requested file name: does it exist, its size, and how many rows were loaded.

    ``rows`` has column source_file; files that were requested but are absent still show.
    """
    listing = list_files(spark, folder).select(
        F.substring_index("path", "/", -1).alias("source_file"), F.col("length").alias("input_file_size_bytes")
    )
    loaded = rows.groupBy("source_file").agg(F.count("*").alias("raw_rows_loaded"))
    return (
        requested.select("source_file")
        .join(listing, "source_file", "left")
        .join(loaded, "source_file", "left")
        .select(
            "source_file",
            F.col("input_file_size_bytes").isNotNull().alias("input_file_exists"),
            F.coalesce("input_file_size_bytes", F.lit(0)).alias("input_file_size_bytes"),
            F.coalesce("raw_rows_loaded", F.lit(0)).alias("raw_rows_loaded"),
        )
    )
