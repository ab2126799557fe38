"""Decoded packet fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.schema import PACKET


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """Packet-field CSVs (quoted, with header), plus the capture file they come from."""
    return (
        spark.read.schema(PACKET)
        .option("header", "true")
        .csv(path)
        .select("*", F.col("_metadata.file_name").alias("capture"))
    )
