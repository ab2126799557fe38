"""Signature alert text, policy lists and split-id files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.functions.signature_text import parse_alert_lines
from flowsentry.schema import SIGNATURE_ALERT


def read_alert_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Every ``alert_fast.txt`` below a folder; the parent folder names the capture."""
    lines = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "alert_fast.txt")
        .text(folder)
        .select("value", F.col("_metadata.file_path").alias("source_file"))
    )
    parsed = parse_alert_lines(lines).withColumn(
        "pcap_name", F.element_at(F.split("source_file", "/"), -2)
    )
    return parsed.select(*SIGNATURE_ALERT.fieldNames())


def read_policy(spark: SparkSession, path: str) -> DataFrame:
    """Signature ids of a policy list, one per line, ``#`` starts a comment line.

    A line that is not a number is an error, and so is an empty list.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("line"))
    kept = lines.filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    sids = kept.select("line", F.col("line").try_cast("int").alias("sid"))
    bad = sids.filter(F.col("sid").isNull()).limit(1).collect()
    if bad:
        raise ValueError(f"invalid signature id in policy list {path}: {bad[0]['line']!r}")
    distinct = sids.select("sid").distinct()
    if distinct.isEmpty():
        raise ValueError(f"no signature ids in policy list {path}")
    return distinct


def policy(spark: SparkSession, sids: list[int]) -> DataFrame:
    return spark.createDataFrame([(s,) for s in sids], "sid int")


def read_split_ids(spark: SparkSession, path: str) -> DataFrame:
    """Test row ids of a split file: test_row_ids, test_ids, test, else any list named like test."""
    doc = spark.read.option("multiLine", "true").json(path)
    lists = [f.name for f in doc.schema.fields if f.dataType.typeName() == "array"]
    preferred = [n for n in ("test_row_ids", "test_ids", "test") if n in lists]
    others = [n for n in lists if "test" in n.lower()]
    chosen = next(iter(preferred + others), None)
    if chosen is None:
        raise ValueError(f"no list of test rows in {path}")
    ids = F.col(f"`{chosen}`").cast("array<bigint>")
    return doc.select(F.explode(ids).alias("row_id")).distinct()


def rows_in(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("row_id"), "row_id", "left_semi")


def rows_not_in(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("row_id"), "row_id", "left_anti")
