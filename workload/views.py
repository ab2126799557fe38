"""Flow, alert, packet, upload and score tables derived from the given tables.

Each view exists twice: as a DataFrame and as SQL text for the comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.functions.signature_text import capture_day
from flowsentry.session import apply_settings, materialize, scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    apply_settings(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Triggers in which a stream reads the events, at least, and rows of a trigger, at most.
TRIGGERS, TRIGGER_ROWS = 4, 5_000_000
#: Bytes of a row group of an event file: the tasks of a trigger share its groups.
GROUP_BYTES = 4 << 20
_event_files: dict = {}


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files in order, one file a trigger.

    All cores look for the rows of a file, one task writes them, and its row groups are read by many again.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    e = table(spark, sf_dir, "events")
    if key not in _event_files:
        path = scratch_path(spark, "event-files")
        first, last, rows = e.agg(F.min("event_id"), F.max("event_id"), F.count("*")).first()
        pieces = max(TRIGGERS, -(-rows // TRIGGER_ROWS))
        step = max(1, -(-((last or 0) - (first or 0) + 1) // pieces))
        for k in range(pieces):  # one after the other, as the reader takes files in the order of their times
            low = (first or 0) + k * step
            piece = e.filter(F.col("event_id").between(low, low + step - 1)).repartition(1)
            piece.write.mode("append").option("parquet.block.size", GROUP_BYTES).parquet(path)
        _event_files[key] = path
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(_event_files[key])


def events(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    source = event_stream(spark, sf_dir) if stream else table(spark, sf_dir, "events")
    return source.select(
        F.col("event_id").alias("row_id"),
        # Alert lines carry no year and mean 2017, so the flows move there as well.
        F.expr("CAST(ts AS TIMESTAMP) - INTERVAL '7' YEAR").alias("ts"),
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


EVENTS = """
ev AS (
  SELECT event_id AS row_id, ts - INTERVAL 7 YEAR AS ts, user_id, event_type, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
  FROM events
)"""

FILES = [
    "Monday-WorkingHours.pcap_ISCX.csv",
    "Tuesday-WorkingHours.pcap_ISCX.csv",
    "Wednesday-workingHours.pcap_ISCX.csv",
    "Thursday-WorkingHours-Morning-WebAttacks.pcap_ISCX.csv",
    "Friday-WorkingHours-Afternoon-DDos.pcap_ISCX.csv",
]
PORTS = [80, 443, 8080, 21, 22, 23]


def _case(value, options, other):
    out = F.when(F.lit(False), F.lit(options[0]))
    for i, option in enumerate(options):
        out = out.when(value == i, F.lit(option))
    return out.otherwise(other)


def raw_flows(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """Flows with their raw label spelling."""
    k, row = F.col("k"), F.col("row_id")
    label = (
        F.when(F.col("event_type") == "error", F.when(k < 50, F.lit(" DDoS")).otherwise(F.lit("dos hulk")))
        .when(F.col("event_type") == "signup", F.lit("portscan"))
        .when(F.col("event_type") == "purchase", F.lit("normal"))
        .when(F.col("event_type") == "click", F.lit("Benign "))
        .otherwise(F.lit("BENIGN"))
    )
    return events(spark, sf_dir, stream).select(
        "row_id",
        _case(row % 5, FILES[:4], F.lit(FILES[4])).alias("source_file"),
        F.col("ts").alias("timestamp"),
        F.concat(
            F.lit("10.0."), F.floor(F.col("user_id") / 256).cast("string"), F.lit("."), (F.col("user_id") % 256).cast("string")
        ).alias("source_ip"),
        F.concat(F.lit("192.168.0."), (k % 10).cast("string")).alias("destination_ip"),
        (1024 + row % 5000).cast("int").alias("source_port"),
        _case(k % 8, PORTS, 1000 + k).cast("int").alias("destination_port"),
        F.when(row % 3 == 0, F.lit("UDP")).otherwise(F.lit("TCP")).alias("protocol"),
        k.cast("double").alias("total_fwd_packets"),
        (row % 10).cast("double").alias("total_backward_packets"),
        ((row % 200) * F.lit(1e6)).alias("flow_duration"),
        F.when(row % 4 == 0, F.col("value")).otherwise(F.col("value") * 1e5).alias("flow_bytes_s"),
        (F.col("value") * 200).alias("flow_packets_s"),
        (row % 5).cast("double").alias("syn_flag_count"),
        (row % 7).cast("double").alias("rst_flag_count"),
        label.alias("label"),
        "value",
        "k",
        "user_id",
        "event_type",
    )


FLOWS = (
    EVENTS
    + """,
raw_flows AS (
  SELECT row_id,
    CASE row_id % 5 WHEN 0 THEN 'Monday-WorkingHours.pcap_ISCX.csv'
      WHEN 1 THEN 'Tuesday-WorkingHours.pcap_ISCX.csv'
      WHEN 2 THEN 'Wednesday-workingHours.pcap_ISCX.csv'
      WHEN 3 THEN 'Thursday-WorkingHours-Morning-WebAttacks.pcap_ISCX.csv'
      ELSE 'Friday-WorkingHours-Afternoon-DDos.pcap_ISCX.csv' END AS source_file,
    ts AS "timestamp",
    '10.0.' || CAST(user_id // 256 AS VARCHAR) || '.' || CAST(user_id % 256 AS VARCHAR) AS source_ip,
    '192.168.0.' || CAST(k % 10 AS VARCHAR) AS destination_ip,
    CAST(1024 + row_id % 5000 AS INTEGER) AS source_port,
    CAST(CASE k % 8 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 8080 WHEN 3 THEN 21
      WHEN 4 THEN 22 WHEN 5 THEN 23 ELSE 1000 + k END AS INTEGER) AS destination_port,
    CASE WHEN row_id % 3 = 0 THEN 'UDP' ELSE 'TCP' END AS protocol,
    CAST(k AS DOUBLE) AS total_fwd_packets,
    CAST(row_id % 10 AS DOUBLE) AS total_backward_packets,
    CAST(row_id % 200 AS DOUBLE) * CAST(1e6 AS DOUBLE) AS flow_duration,
    CASE WHEN row_id % 4 = 0 THEN value ELSE value * CAST(1e5 AS DOUBLE) END AS flow_bytes_s,
    value * CAST(200 AS DOUBLE) AS flow_packets_s,
    CAST(row_id % 5 AS DOUBLE) AS syn_flag_count,
    CAST(row_id % 7 AS DOUBLE) AS rst_flag_count,
    CASE event_type WHEN 'error' THEN CASE WHEN k < 50 THEN ' DDoS' ELSE 'dos hulk' END
      WHEN 'signup' THEN 'portscan' WHEN 'purchase' THEN 'normal' WHEN 'click' THEN 'Benign '
      ELSE 'BENIGN' END AS label,
    value, k, user_id, event_type
  FROM ev
),
flows AS (
  SELECT *, CASE event_type WHEN 'error' THEN CASE WHEN k < 50 THEN 'DDoS' ELSE 'DoS Hulk' END
      WHEN 'signup' THEN 'PortScan' ELSE 'BENIGN' END AS multiclass_label,
    CASE WHEN event_type IN ('error', 'signup') THEN 1 ELSE 0 END AS binary_label
  FROM raw_flows
)"""
)


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowsentry.functions.labels import with_labels

    raw = raw_flows(spark, sf_dir)
    return with_labels(raw)


def dirty_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows with unknown labels, infinities, missing cells, an empty column and repeated rows."""
    raw = raw_flows(spark, sf_dir)
    k = F.col("k")

    def gap(name):
        return F.when(~((k >= 90) & (F.col("value") < 20)), F.col(name)).alias(name)

    dirty = raw.select(
        "row_id",
        "source_file",
        "timestamp",
        F.when(k != 13, F.col("label")).alias("label"),
        F.when(k == 17, F.lit(float("inf")))
        .when(k == 18, F.lit(float("-inf")))
        .when(k == 19, F.lit(float("nan")))
        .otherwise(F.col("flow_bytes_s"))
        .alias("flow_bytes_s"),
        gap("flow_packets_s"),
        gap("flow_duration"),
        gap("total_fwd_packets"),
        gap("syn_flag_count"),
        F.lit(None).cast("double").alias("simillarhttp"),
    )
    last = raw.agg(F.max("row_id")).first()[0]
    repeated = dirty.withColumn("row_id", F.col("row_id") + last + 1).filter(
        F.col("label").isNull() | (F.col("label") != "portscan")
    )
    return dirty.unionByName(repeated)


DIRTY = (
    FLOWS
    + """,
dirty0 AS (
  SELECT row_id, source_file, "timestamp",
    CASE WHEN k <> 13 THEN label END AS label,
    CASE k WHEN 17 THEN CAST('Infinity' AS DOUBLE) WHEN 18 THEN CAST('-Infinity' AS DOUBLE)
      WHEN 19 THEN CAST('NaN' AS DOUBLE) ELSE flow_bytes_s END AS flow_bytes_s,
    CASE WHEN NOT (k >= 90 AND value < 20) THEN flow_packets_s END AS flow_packets_s,
    CASE WHEN NOT (k >= 90 AND value < 20) THEN flow_duration END AS flow_duration,
    CASE WHEN NOT (k >= 90 AND value < 20) THEN total_fwd_packets END AS total_fwd_packets,
    CASE WHEN NOT (k >= 90 AND value < 20) THEN syn_flag_count END AS syn_flag_count,
    CAST(NULL AS DOUBLE) AS simillarhttp
  FROM raw_flows
),
dirty AS (
  SELECT * FROM dirty0
  UNION ALL
  SELECT d.row_id + (SELECT max(row_id) FROM raw_flows) + 1, d.* EXCLUDE (row_id) FROM dirty0 d
  WHERE d.label IS NULL OR d.label <> 'portscan'
),
labelled AS (
  SELECT row_id, source_file, "timestamp", flow_bytes_s, flow_packets_s, flow_duration,
    total_fwd_packets, syn_flag_count, simillarhttp,
    CASE lower(trim(label)) WHEN 'ddos' THEN 'DDoS' WHEN 'dos hulk' THEN 'DoS Hulk'
      WHEN 'portscan' THEN 'PortScan' WHEN 'normal' THEN 'BENIGN' WHEN 'benign' THEN 'BENIGN'
      ELSE 'UNKNOWN' END AS multiclass_label
  FROM dirty
),
finite AS (
  SELECT * REPLACE (CASE WHEN isnan(flow_bytes_s) OR isinf(flow_bytes_s) THEN NULL ELSE flow_bytes_s END AS flow_bytes_s),
    CASE WHEN multiclass_label <> 'BENIGN' THEN 1 ELSE 0 END AS binary_label
  FROM labelled WHERE multiclass_label <> 'UNKNOWN'
)"""
)


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signature alerts raised by error and click flows: some reversed, shifted or without a time."""
    f = raw_flows(spark, sf_dir).filter(F.col("event_type").isin("error", "click"))
    k = F.col("k")
    swap = k < 50
    port = F.col("source_port") + F.when(k % 3 == 1, 1).otherwise(0)
    time = F.timestamp_micros(F.unix_micros("timestamp") + ((k % 7) - 3) * 1_000_000)
    return f.select(
        F.col("row_id").alias("alert_id"),
        capture_day(F.col("source_file")).alias("pcap_name"),
        F.when(k % 25 == 0, F.lit("")).otherwise(F.date_format(time, "MM/dd-HH:mm:ss.SSSSSS")).alias("timestamp"),
        F.lit(1).alias("gid"),
        F.when(F.col("event_type") == "error", F.lit(491)).otherwise(553 + k % 3).cast("int").alias("sid"),
        F.lit(1).alias("rev"),
        (k % 4).cast("int").alias("priority"),
        F.when(k % 2 == 0, F.col("protocol"))
        .when(F.col("protocol") == "TCP", F.lit("6"))
        .otherwise(F.lit("17.0"))
        .alias("proto"),
        F.when(swap, F.col("destination_ip")).otherwise(F.col("source_ip")).alias("src_ip"),
        F.when(swap, F.col("destination_port")).otherwise(port).cast("int").alias("src_port"),
        F.when(swap, F.col("source_ip")).otherwise(F.col("destination_ip")).alias("dst_ip"),
        F.when(swap, port).otherwise(F.col("destination_port")).cast("int").alias("dst_port"),
    ).withColumn("message", F.concat(F.lit("signature "), F.col("sid").cast("string")))


def _day(source_file: str) -> str:
    return (
        f"CASE WHEN contains({source_file}, 'Monday-WorkingHours') THEN 'Monday-WorkingHours' "
        f"WHEN contains({source_file}, 'Tuesday-WorkingHours') THEN 'Tuesday-WorkingHours' "
        f"WHEN contains({source_file}, 'Wednesday-workingHours') OR contains({source_file}, 'Wednesday-WorkingHours') "
        "THEN 'Wednesday-workingHours' "
        f"WHEN contains({source_file}, 'Thursday-WorkingHours') THEN 'Thursday-WorkingHours' "
        f"WHEN contains({source_file}, 'Friday-WorkingHours') THEN 'Friday-WorkingHours' END"
    )


DAY_SQL = _day("source_file")

ALERTS = (
    FLOWS
    + f""",
alerts0 AS (
  SELECT *, source_port + CASE WHEN k % 3 = 1 THEN 1 ELSE 0 END AS port,
    "timestamp" + to_seconds((k % 7) - 3) AS seen
  FROM raw_flows WHERE event_type IN ('error', 'click')
),
alerts AS (
  SELECT row_id AS alert_id, {DAY_SQL} AS pcap_name,
    CASE WHEN k % 25 = 0 THEN '' ELSE strftime(seen, '%m/%d-%H:%M:%S.%f') END AS "timestamp",
    CAST(1 AS INTEGER) AS gid,
    CAST(CASE WHEN event_type = 'error' THEN 491 ELSE 553 + k % 3 END AS INTEGER) AS sid,
    CAST(1 AS INTEGER) AS rev, CAST(k % 4 AS INTEGER) AS priority,
    CASE WHEN k % 2 = 0 THEN protocol WHEN protocol = 'TCP' THEN '6' ELSE '17.0' END AS proto,
    CASE WHEN k < 50 THEN destination_ip ELSE source_ip END AS src_ip,
    CAST(CASE WHEN k < 50 THEN destination_port ELSE port END AS INTEGER) AS src_port,
    CASE WHEN k < 50 THEN source_ip ELSE destination_ip END AS dst_ip,
    CAST(CASE WHEN k < 50 THEN port ELSE destination_port END AS INTEGER) AS dst_port,
    'signature ' || CAST(CASE WHEN event_type = 'error' THEN 491 ELSE 553 + k % 3 END AS VARCHAR) AS message,
    CASE WHEN k % 25 = 0 THEN NULL ELSE seen END AS seen, protocol AS p
  FROM alerts0
)"""
)


def alert_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert text lines; some lack ids, ports, priority or endpoints."""
    a = alerts(spark, sf_dir)
    i = F.col("alert_id")
    src = F.when(i % 10 == 3, F.col("src_ip")).otherwise(F.concat_ws(":", "src_ip", F.col("src_port").cast("string")))
    dst = F.when(i % 10 == 3, F.col("dst_ip")).otherwise(F.concat_ws(":", "dst_ip", F.col("dst_port").cast("string")))
    line = F.concat(
        F.coalesce(F.nullif("timestamp", F.lit("")), F.lit("")),
        F.lit(" [**] "),
        F.when(i % 11 == 5, F.lit("")).otherwise(F.concat(F.lit("[1:"), F.col("sid").cast("string"), F.lit(":2]"))),
        F.lit(' "'),
        F.col("message"),
        F.lit('" [**] '),
        F.when(i % 7 == 2, F.lit("")).otherwise(
            F.concat(F.lit("[Priority: "), F.col("priority").cast("string"), F.lit("] "))
        ),
        F.concat(F.lit("{"), F.col("proto"), F.lit("} ")),
        src,
        F.when(i % 13 == 6, F.lit(" ")).otherwise(F.lit(" -> ")),
        dst,
    )
    return a.select("alert_id", line.alias("value"))


ALERT_LINES = (
    ALERTS
    + """,
alert_lines AS (
  SELECT alert_id, "timestamp" || ' [**] '
    || CASE WHEN alert_id % 11 = 5 THEN '' ELSE '[1:' || CAST(sid AS VARCHAR) || ':2]' END
    || ' "' || message || '" [**] '
    || CASE WHEN alert_id % 7 = 2 THEN '' ELSE '[Priority: ' || CAST(priority AS VARCHAR) || '] ' END
    || '{' || proto || '} '
    || src_ip || CASE WHEN alert_id % 10 = 3 THEN '' ELSE ':' || CAST(src_port AS VARCHAR) END
    || CASE WHEN alert_id % 13 = 6 THEN ' ' ELSE ' -> ' END
    || dst_ip || CASE WHEN alert_id % 10 = 3 THEN '' ELSE ':' || CAST(dst_port AS VARCHAR) END AS value
  FROM alerts
)"""
)


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packet fields as text, one per line item, with the capture they belong to."""
    li = table(spark, sf_dir, "lineitem")
    epoch = F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) + F.col("l_linenumber")
    tcp = F.col("l_partkey") % 4 != 0
    sport = (F.col("l_partkey") % 3).cast("string")
    dport = (
        F.when(F.col("l_linestatus") == "O", F.lit(80)).otherwise(1000 + F.col("l_partkey") % 120).cast("string")
    )
    return li.select(
        F.concat(F.lit("cap_"), (F.col("l_suppkey") % 10).cast("string"), F.lit(".pcap")).alias("capture"),
        epoch.cast("string").alias("frame.time_epoch"),
        F.concat(F.lit("10.1.0."), (F.col("l_suppkey") % 10).cast("string")).alias("ip.src"),
        F.when(
            F.col("l_partkey") % 97 != 0, F.concat(F.lit("10.2.0."), (F.col("l_partkey") % 20).cast("string"))
        ).alias("ip.dst"),
        F.when(tcp, F.lit("6")).otherwise(F.lit("17")).alias("ip.proto"),
        F.when(tcp, sport).alias("tcp.srcport"),
        F.when(tcp, dport).alias("tcp.dstport"),
        F.when(~tcp, sport).alias("udp.srcport"),
        F.when(~tcp, dport).alias("udp.dstport"),
        (F.col("l_quantity") * 30).cast("bigint").cast("string").alias("frame.len"),
        F.when(F.col("l_returnflag") == "R", F.lit("1")).otherwise(F.lit("0")).alias("tcp.flags.syn"),
        F.when(F.col("l_returnflag") == "A", F.lit("True")).otherwise(F.lit("False")).alias("tcp.flags.ack"),
    )


PACKETS = """
packets AS (
  SELECT 'cap_' || CAST(l_suppkey % 10 AS VARCHAR) || '.pcap' AS capture,
    CAST(epoch(l_shipdate) AS BIGINT) + l_linenumber AS t,
    '10.1.0.' || CAST(l_suppkey % 10 AS VARCHAR) AS src_ip,
    '10.2.0.' || CAST(l_partkey % 20 AS VARCHAR) AS dst_ip,
    CASE WHEN l_partkey % 4 <> 0 THEN '6' ELSE '17' END AS protocol,
    CAST(l_partkey % 3 AS VARCHAR) AS src_port,
    CASE WHEN l_linestatus = 'O' THEN '80' ELSE CAST(1000 + l_partkey % 120 AS VARCHAR) END AS dst_port,
    CAST(l_quantity * 30 AS BIGINT) AS length,
    l_returnflag = 'R' AS syn, l_returnflag = 'A' AS ack
  FROM lineitem WHERE l_partkey % 97 <> 0
),
live_flows AS (
  SELECT *, round(d, 6) AS duration_sec, round(packet_count / d, 6) AS packets_per_sec,
    round(byte_count / d, 6) AS bytes_per_sec
  FROM (
    SELECT capture, src_ip, dst_ip, src_port, dst_port, protocol,
      CAST(min(t) AS DOUBLE) AS start_time, CAST(max(t) AS DOUBLE) AS end_time,
      count(*) AS packet_count, CAST(sum(length) AS BIGINT) AS byte_count,
      CAST(count(*) FILTER (WHERE syn) AS BIGINT) AS syn_count,
      CAST(count(*) FILTER (WHERE ack) AS BIGINT) AS ack_count,
      greatest(CAST(max(t) - min(t) AS DOUBLE), CAST(0.000001 AS DOUBLE)) AS d
    FROM packets GROUP BY ALL)
)"""


def uploads(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """Upload log in event order: many repeats, stale ranges and overlaps."""
    k, row = F.col("k"), F.col("row_id")
    start = (row % 97) * 10
    content = F.sha2(F.concat_ws("-", "event_type", (k % 30).cast("string")), 256)
    return events(spark, sf_dir, stream).select(
        row.alias("arrival"),
        F.concat(F.lit("tenant_"), (F.col("user_id") % 3).cast("string")).alias("tenant_id"),
        F.concat(F.lit("src_"), F.col("user_id").cast("string")).alias("source_id"),
        F.concat(F.lit("e"), (row % 2).cast("string")).alias("file_epoch"),
        start.alias("start_offset"),
        (start + 1 + k * 10).alias("end_offset"),
        content.alias("content_hash"),
        F.sha2(F.concat_ws("-", (k % 45).cast("string"), (F.floor(F.col("value")) % 3).cast("string")), 256).alias(
            "batch_hash"
        ),
        F.concat(
            F.lit("data/uploads/"),
            F.substring(content, 1, 12),
            F.lit("_"),
            _case(k % 6, ["ddos", "portscan", "bot", "benign", "webattack"], F.lit("attack unknown")),
            F.lit(".pcap"),
        ).alias("file_path"),
        F.when(k % 5 == 0, F.lit("flow_csv")).otherwise(F.lit("pcap")).alias("file_type"),
        F.col("ts").alias("upload_ts"),
    )


UPLOADS = (
    EVENTS
    + """,
uploads AS (
  SELECT row_id AS arrival, 'tenant_' || CAST(user_id % 3 AS VARCHAR) AS tenant_id,
    'src_' || CAST(user_id AS VARCHAR) AS source_id, 'e' || CAST(row_id % 2 AS VARCHAR) AS file_epoch,
    (row_id % 97) * 10 AS start_offset, (row_id % 97) * 10 + 1 + k * 10 AS end_offset,
    sha256(event_type || '-' || CAST(k % 30 AS VARCHAR)) AS content_hash,
    sha256(CAST(k % 45 AS VARCHAR) || '-' || CAST(CAST(floor(value) AS BIGINT) % 3 AS VARCHAR)) AS batch_hash,
    'data/uploads/' || substr(sha256(event_type || '-' || CAST(k % 30 AS VARCHAR)), 1, 12) || '_'
      || CASE k % 6 WHEN 0 THEN 'ddos' WHEN 1 THEN 'portscan' WHEN 2 THEN 'bot' WHEN 3 THEN 'benign'
         WHEN 4 THEN 'webattack' ELSE 'attack unknown' END || '.pcap' AS file_path,
    CASE WHEN k % 5 = 0 THEN 'flow_csv' ELSE 'pcap' END AS file_type,
    ts AS upload_ts
  FROM ev
)"""
)


def capture_packets(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """Typed packets of two captures that have no flow file."""
    f = raw_flows(spark, sf_dir, stream)
    return f.filter((F.col("k") % 6).isin(1, 2)).select(
        F.when(F.col("k") % 6 == 1, F.lit("portscan.pcap")).otherwise(F.lit("bot.pcap")).alias("capture"),
        F.col("timestamp").alias("time"),
        F.lit("10.9.0.1").alias("src_ip"),
        F.lit("10.9.0.2").alias("dst_ip"),
        F.lit("0").alias("src_port"),
        F.col("destination_port").cast("string").alias("dst_port"),
        F.col("protocol").alias("protocol"),
        F.unix_timestamp("timestamp").cast("double").alias("t"),
        F.col("k").alias("length"),
        (F.col("syn_flag_count") >= 3).alias("syn"),
        F.lit(False).alias("ack"),
    )


# Verdicts of the closed days of these captures, under the limits of CAPTURE_RULES in packet_queries.
CAPTURE_VERDICTS = """
cap AS (
  SELECT CASE k % 6 WHEN 1 THEN 'portscan.pcap' ELSE 'bot.pcap' END AS capture, date_trunc('day', "timestamp") AS d,
    floor(epoch("timestamp")) AS s, *
  FROM raw_flows WHERE k % 6 IN (1, 2)
),
cap_flows AS (
  SELECT *, round(packet_count / dur, 6) AS pps, round(byte_count / dur, 6) AS bps
  FROM (
    SELECT d, capture, destination_port, protocol, count(*) AS packet_count, sum(k) AS byte_count,
      count(*) FILTER (WHERE syn_flag_count >= 3) AS syn,
      greatest(CAST(max(s) - min(s) AS DOUBLE), CAST(0.000001 AS DOUBLE)) AS dur
    FROM cap GROUP BY ALL)
),
cap_evidence AS (
  SELECT d, capture, count(*) AS number_of_flows, count(DISTINCT destination_port) AS unique_dst_ports,
    CAST(sum(syn) AS BIGINT) AS total_syn_count,
    count(*) FILTER (WHERE packet_count >= 2 AND round(dur, 6) >= 1 AND pps >= CAST(0.0002 AS DOUBLE)
      AND bps >= CAST(0.015 AS DOUBLE)) AS high_rate_flow_count
  FROM cap_flows GROUP BY ALL
),
cap_verdicts AS (
  SELECT *, CASE WHEN scan THEN 'PortScanLike' WHEN high_rate_flow_count > 0 THEN 'HighRateFlow' ELSE 'BENIGN' END AS attack_type,
    CASE WHEN scan OR high_rate_flow_count > 0 THEN 'attack' ELSE 'benign' END AS prediction
  FROM (SELECT *, unique_dst_ports >= 6 AND total_syn_count >= 5 AS scan FROM cap_evidence)
  WHERE d + INTERVAL 1 DAY <= (SELECT max("timestamp") FROM cap)
)"""


SPLITS = (
    FLOWS
    + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY "timestamp", row_id) AS rn,
    count(*) OVER (PARTITION BY source_file) AS n
  FROM flows
),
sized AS (
  SELECT *, n - CAST(round_even(n * CAST(0.2 AS DOUBLE), 0) AS BIGINT) AS head FROM ranked
),
splits AS (
  SELECT * EXCLUDE (rn, n, head), CASE
    WHEN rn <= head - CAST(round_even(head * CAST(0.2 AS DOUBLE), 0) AS BIGINT) THEN 'train'
    WHEN rn <= head THEN 'val' ELSE 'test' END AS split
  FROM sized
)"""
)


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowsentry.operators.split import temporal_split

    return temporal_split(flows(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits with a real-valued score, a score with many ties, and the inputs of the cascade."""
    rows = splits(spark, sf_dir).select(
        "row_id",
        "source_file",
        "multiclass_label",
        "binary_label",
        "split",
        F.col("value").alias("score"),
        F.floor("value").cast("double").alias("tied"),
        (F.col("value") / 500.0).alias("rf_score"),
        (F.col("k") / 99.0).alias("gate_prob"),
        ((F.col("k") % 20 == 3)).cast("int").alias("snort_pred"),
        "k",
    )
    # The scored table is read several times by every query on it.
    return materialize(rows, "scored")


SCORED = (
    SPLITS
    + """,
scored AS (
  SELECT row_id, source_file, multiclass_label, binary_label, split, value AS score,
    floor(value) AS tied, value / CAST(500 AS DOUBLE) AS rf_score,
    CAST(k AS DOUBLE) / CAST(99 AS DOUBLE) AS gate_prob,
    CASE WHEN k % 20 = 3 THEN 1 ELSE 0 END AS snort_pred, k
  FROM splits
)"""
)
