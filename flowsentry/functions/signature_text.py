"""Signature alert lines: fields, capture day and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry.config import CAPTURE_DAYS

# Fixed patterns of the alert text format.
IDS_PATTERN = r"\[(\d+):(\d+):(\d+)\]"
PRIORITY_PATTERN = r"\[Priority:\s*(\d+)\]"
PROTO_PATTERN = r"\{([^}]+)\}"
ENDPOINTS_PATTERN = r"(\S+?)(?::(\d+))?\s+->\s+(\S+?)(?::(\d+))?$"

ALERT_FIELDS = [
    "timestamp",
    "gid",
    "sid",
    "rev",
    "message",
    "priority",
    "proto",
    "src_ip",
    "src_port",
    "dst_ip",
    "dst_port",
]


def _group(text: Column, pattern: str, n: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, n), F.lit(""))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _made_once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns, made once a row: neither a filter on them nor a column from them is moved below the
    generator, where it would make them again."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def parse_alert_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Add the alert fields to each line that has ids and endpoints; drop the others."""
    cut = _made_once(lines, _parts=F.split(_strip(F.col(line)), r"\[\*\*\]")).filter(F.size("_parts") >= 3)
    parts = F.col("_parts")
    stripped = _made_once(
        cut,
        _time=_strip(F.get(parts, F.lit(0))),
        _ids=_strip(F.get(parts, F.lit(1))),
        _tail=_strip(F.concat_ws(" ", F.transform(F.slice(parts, 3, F.size(parts)), _strip))),
    ).filter((F.col("_time") != "") & F.col("_ids").rlike(IDS_PATTERN))
    # The message is what follows the ids, the endpoints what follows the protocol.
    tail = F.col("_tail")
    ends = F.when(tail.rlike(PROTO_PATTERN), _strip(F.regexp_replace(tail, r"^.*?\{[^}]+\}", ""))).otherwise(tail)
    head = F.regexp_replace(F.col("_ids"), r"^.*?\[\d+:\d+:\d+\]", "")
    return (
        _made_once(stripped, _ends=ends)
        .filter(F.col("_ends").rlike(ENDPOINTS_PATTERN))
        .withColumn("timestamp", F.col("_time"))
        .withColumn("gid", _group(F.col("_ids"), IDS_PATTERN, 1).try_cast("int"))
        .withColumn("sid", _group(F.col("_ids"), IDS_PATTERN, 2).try_cast("int"))
        .withColumn("rev", _group(F.col("_ids"), IDS_PATTERN, 3).try_cast("int"))
        .withColumn("message", F.regexp_replace(_strip(head), r'^"+|"+$', ""))
        .withColumn("priority", _group(F.col("_tail"), PRIORITY_PATTERN, 1).try_cast("int"))
        .withColumn("proto", _group(F.col("_tail"), PROTO_PATTERN, 1))
        .withColumn("src_ip", _group(F.col("_ends"), ENDPOINTS_PATTERN, 1))
        .withColumn("src_port", _group(F.col("_ends"), ENDPOINTS_PATTERN, 2).try_cast("int"))
        .withColumn("dst_ip", _group(F.col("_ends"), ENDPOINTS_PATTERN, 3))
        .withColumn("dst_port", _group(F.col("_ends"), ENDPOINTS_PATTERN, 4).try_cast("int"))
        .drop("_parts", "_time", "_ids", "_tail", "_ends")
    )


def capture_day(source_file: Column) -> Column:
    """Capture day named inside a flow file name (one spelling per day)."""
    text = source_file.cast("string")
    day = F.when(text.contains("Wednesday-WorkingHours"), F.lit("Wednesday-workingHours"))
    for name in CAPTURE_DAYS:
        day = day.when(text.contains(name), F.lit(name))
    return day


def alert_time(text: Column, day: Column) -> Column:
    """Time of an alert line: ``MM/DD-clock`` in 2017, else the capture day's date plus the clock."""
    trimmed = F.trim(text.cast("string"))
    month, dom = F.substring(trimmed, 1, 2), F.substring(trimmed, 4, 2)
    dated = F.concat(F.lit("2017-"), month, F.lit("-"), dom, F.lit(" "), F.substring(trimmed, 7, 40))
    base = F.lit(None).cast("string")
    for name, date in CAPTURE_DAYS.items():
        base = F.when(day == name, F.lit(date)).otherwise(base)
    # Only text that does not start with two two-digit numbers falls back to the day table.
    has_date = month.rlike(r"^\d{2}$") & dom.rlike(r"^\d{2}$")
    clock = F.regexp_extract(trimmed, r"^[^-]*-(.*)$", 1)
    return F.when(has_date, dated.try_cast("timestamp")).otherwise(
        F.concat(base, F.lit(" "), F.nullif(clock, F.lit(""))).try_cast("timestamp")
    )
