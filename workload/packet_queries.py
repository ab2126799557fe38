"""Packets, flow evidence, verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsentry.config import LiveRules
from flowsentry.functions.uploads import capture_name, first_score, row_prediction
from flowsentry.operators import evidence, packets
from flowsentry.streaming.pipeline import drain
from flowsentry.streaming.windows import stream_verdicts
from workload import views
from workload.registry import query

# The given line items are sparse in time; these limits make both live rules fire on some captures.
LIVE = LiveRules(
    sustained_min_packets=2,
    sustained_min_duration_sec=1.0,
    high_rate_packets_per_sec=1e-6,
    high_rate_bytes_per_sec=1e-3,
    portscan_min_dst_ports=60,
    portscan_min_syn_count=180,
)


#: For the captures of views.capture_packets: both rules fire on some of their days.
CAPTURE_RULES = LiveRules(
    sustained_min_packets=2,
    sustained_min_duration_sec=1.0,
    high_rate_packets_per_sec=0.0002,
    high_rate_bytes_per_sec=0.015,
    portscan_min_dst_ports=6,
    portscan_min_syn_count=5,
)


def live_flows(spark, sf):
    fields = packets.packet_fields(views.packets(spark, sf), keep=["capture"])
    return packets.packets_to_flows(fields, by=["capture"])


@query(
    "packets_to_flows",
    f"""WITH {views.PACKETS} SELECT capture, src_ip, dst_ip, src_port, dst_port, protocol, start_time, end_time,
    packet_count, byte_count, syn_count, ack_count, duration_sec, packets_per_sec, bytes_per_sec FROM live_flows""",
)
def packets_to_flows(spark, sf):
    return live_flows(spark, sf)


EVIDENCE_SQL = (
    views.PACKETS
    + """,
live AS (SELECT capture, count(*) AS number_of_flows, count(DISTINCT dst_port) AS unique_dst_ports,
  CAST(sum(syn_count) AS BIGINT) AS total_syn_count, CAST(sum(packet_count) AS BIGINT) AS total_packets,
  CAST(sum(byte_count) AS BIGINT) AS total_bytes,
  coalesce(max(packets_per_sec) FILTER (WHERE packet_count >= 2 AND duration_sec >= 1), 0) AS max_packets_per_sec,
  coalesce(max(bytes_per_sec) FILTER (WHERE packet_count >= 2 AND duration_sec >= 1), 0) AS max_bytes_per_sec,
  count(*) FILTER (WHERE packet_count >= 2 AND duration_sec >= 1 AND packets_per_sec >= CAST(1e-6 AS DOUBLE)
    AND bytes_per_sec >= CAST(1e-3 AS DOUBLE)) AS high_rate_flow_count
  FROM live_flows GROUP BY capture),
verdicts AS (SELECT *, high_rate_flow_count > 0 AS high,
    unique_dst_ports >= 60 AND total_syn_count >= 180 AS scan FROM live)"""
)


@query("live_evidence", f"WITH {EVIDENCE_SQL} SELECT * FROM live")
def live_evidence(spark, sf):
    return packets.live_evidence(live_flows(spark, sf), ["capture"], LIVE)


HIGH = """printf('sustained high-rate flow: max_packets_per_sec=%.2f, max_bytes_per_sec=%.2f',
  max_packets_per_sec, max_bytes_per_sec)"""
SCAN = "printf('extreme SYN-backed port spread: dst_ports=%d, syn_count=%d', unique_dst_ports, total_syn_count)"
QUIET = """printf('no live flow rule threshold exceeded: max_sustained_packets_per_sec=%.2f < 0.00 or '
  || 'max_sustained_bytes_per_sec=%.2f < 0.00; dst_ports=%d and syn_count=%d do not meet extreme portscan thresholds',
  max_packets_per_sec, max_bytes_per_sec, unique_dst_ports, total_syn_count)"""


@query(
    "live_verdict",
    f"""WITH {EVIDENCE_SQL} SELECT capture, CASE WHEN high OR scan THEN 'attack' ELSE 'benign' END AS prediction,
    CASE WHEN scan THEN 'PortScanLike' WHEN high THEN 'HighRateFlow' ELSE 'BENIGN' END AS attack_type,
    CASE WHEN high OR scan THEN 'high' ELSE 'info' END AS severity,
    CASE WHEN high AND scan THEN {HIGH} || '; ' || {SCAN} WHEN high THEN {HIGH} WHEN scan THEN {SCAN}
      ELSE {QUIET} END AS detection_reason FROM verdicts""",
)
def live_verdict(spark, sf):
    verdict = packets.live_verdict(packets.live_evidence(live_flows(spark, sf), ["capture"], LIVE), LIVE)
    return verdict.select("capture", "prediction", "attack_type", "severity", "detection_reason")


WINDOW_LIVE = LiveRules(portscan_min_dst_ports=28, portscan_min_syn_count=40, sustained_min_packets=10**9)
WINDOW = 100


def event_packets(spark, sf):
    """One packet per event, in event order inside its source file."""
    f = views.flows(spark, sf)
    return f.select(
        "source_file",
        F.unix_micros("timestamp").alias("order_key"),
        "row_id",
        F.col("source_ip").alias("src_ip"),
        F.col("destination_ip").alias("dst_ip"),
        F.col("source_port").cast("string").alias("src_port"),
        F.col("destination_port").cast("string").alias("dst_port"),
        F.col("protocol").alias("protocol"),
        F.unix_timestamp("timestamp").cast("double").alias("t"),
        F.col("k").alias("length"),
        (F.col("syn_flag_count") >= 3).alias("syn"),
        F.lit(False).alias("ack"),
    )


@query(
    "window_mining",
    f"""WITH {views.FLOWS},
    p AS (SELECT *, (row_number() OVER (PARTITION BY source_file ORDER BY "timestamp", row_id) - 1) // {WINDOW} AS window_id
      FROM flows),
    f AS (SELECT source_file, window_id, source_ip, destination_ip, source_port, destination_port, protocol,
      count(*) FILTER (WHERE syn_flag_count >= 3) AS syn FROM p GROUP BY ALL),
    e AS (SELECT source_file, window_id, count(DISTINCT destination_port) AS ports, sum(syn) AS syn FROM f GROUP BY ALL),
    v AS (SELECT *, ports >= 28 AND syn >= 40 AS attack FROM e)
    SELECT source_file, count(*) AS windows, count(*) FILTER (WHERE attack) AS attack_windows,
      CAST(min(window_id) FILTER (WHERE attack) AS BIGINT) AS first_attack_window,
      CASE WHEN bool_or(attack) THEN 'PortScanLike' END AS first_attack_type FROM v GROUP BY source_file""",
)
def window_mining(spark, sf):
    windowed = packets.packet_windows(event_packets(spark, sf), "source_file", "order_key", "row_id", WINDOW)
    return packets.first_attack_windows(packets.window_verdicts(windowed, "source_file", WINDOW_LIVE), "source_file")


# --- evidence ---------------------------------------------------------------

LABEL_SQL = (
    views.FLOWS
    + """,
per_label AS (SELECT source_file, trim(label) AS label, count(*) AS n, min(row_id) AS first,
  upper(trim(label)) NOT IN ('', 'BENIGN') AS attack FROM raw_flows GROUP BY ALL),
label_evidence AS (SELECT source_file, CAST(coalesce(sum(n) FILTER (WHERE attack), 0) AS BIGINT) AS attack_label_count,
  CAST(sum(n) AS BIGINT) AS total_rows, coalesce(string_agg(label, '|' ORDER BY label) FILTER (WHERE attack), '') AS attack_labels,
  coalesce(first(label ORDER BY n DESC, first) FILTER (WHERE attack), '') AS most_common_attack_label,
  CASE WHEN bool_or(attack) THEN 'attack' ELSE 'benign' END AS prediction FROM per_label GROUP BY source_file)"""
)


@query("label_evidence", f"WITH {LABEL_SQL} SELECT * FROM label_evidence")
def label_evidence(spark, sf):
    e = evidence.label_evidence(views.raw_flows(spark, sf))
    return e.withColumn("attack_labels", F.array_join("attack_labels", "|"))


def artifact_rows(spark, sf):
    """Exported predictions whose flags are spelled in several ways."""
    f = views.flows(spark, sf)
    k = F.col("k")
    return f.select(
        "row_id",
        "source_file",
        F.when(k % 5 == 0, F.lit("1.0")).when(k % 5 == 1, F.lit("false")).when(k % 5 == 2, F.lit("")).otherwise(F.lit("?")).alias("cascade_pred"),
        F.when(k % 3 == 0, F.lit("attack")).when(k % 3 == 1, F.lit("0")).otherwise(F.lit(" ")).alias("binary_label"),
        "multiclass_label",
        F.when(k % 4 == 0, F.lit("n/a")).otherwise((F.col("value") / 500).cast("string")).alias("cascade_score"),
        F.when(k % 4 == 0, (k / 99.0).cast("string")).alias("gate_prob"),
    )


ARTIFACT_SQL = (
    views.FLOWS
    + """,
artifact AS (SELECT row_id, source_file, multiclass_label,
  CASE WHEN k % 5 = 0 THEN 'attack' WHEN k % 5 = 1 THEN 'benign' WHEN k % 3 = 0 THEN 'attack' WHEN k % 3 = 1 THEN 'benign'
    WHEN multiclass_label <> 'BENIGN' THEN 'attack' ELSE 'benign' END AS prediction,
  CASE WHEN k % 4 = 0 THEN CAST(k AS DOUBLE) / CAST(99 AS DOUBLE) ELSE value / CAST(500 AS DOUBLE) END AS score
  FROM flows),
artifact_evidence AS (SELECT a.source_file, n AS attack_prediction_count, total AS total_rows, a.row_id AS sample_row_id,
  a.score AS sample_score, a.multiclass_label AS sample_label, CASE WHEN n > 0 THEN 'attack' ELSE 'benign' END AS prediction
  FROM (SELECT source_file, count(*) FILTER (WHERE prediction = 'attack') AS n, count(*) AS total,
    coalesce(min(row_id) FILTER (WHERE prediction = 'attack'), min(row_id)) AS pick FROM artifact GROUP BY source_file) g
  JOIN artifact a ON a.row_id = g.pick)"""
)


@query("row_decode", f"WITH {ARTIFACT_SQL} SELECT row_id, prediction, score FROM artifact")
def row_decode(spark, sf):
    a = artifact_rows(spark, sf)
    return a.select(
        "row_id",
        row_prediction(F.col("cascade_pred"), F.col("binary_label"), F.col("multiclass_label")).alias("prediction"),
        first_score(F.col("cascade_score"), F.col("gate_prob")).alias("score"),
    )


@query("artifact_evidence", f"WITH {ARTIFACT_SQL} SELECT * FROM artifact_evidence")
def artifact_evidence(spark, sf):
    return evidence.artifact_evidence(artifact_rows(spark, sf))


@query(
    "sample_prediction",
    f"""WITH {views.FLOWS}, r AS (SELECT row_id, source_file, CASE WHEN value > 40 THEN '1' ELSE '0' END AS cascade_pred
      FROM flows)
    SELECT * FROM r WHERE row_id = (SELECT coalesce(min(row_id) FILTER (WHERE cascade_pred = '1'), min(row_id)) FROM r)""",
)
def sample_prediction(spark, sf):
    rows = views.flows(spark, sf).select(
        "row_id", "source_file", F.when(F.col("value") > 40, F.lit("1")).otherwise(F.lit("0")).alias("cascade_pred")
    )
    return evidence.sample_prediction(rows, "attack")


@query(
    "file_verdict",
    f"""WITH {views.FLOWS}, g AS (SELECT source_file, count(*) AS rows_scored,
      count(*) FILTER (WHERE value / CAST(500 AS DOUBLE) > CAST(0.1 AS DOUBLE)) AS row_attack_count,
      max(value / CAST(500 AS DOUBLE)) AS max_score, round(avg(value / CAST(500 AS DOUBLE)), 9) AS mean_score
      FROM flows GROUP BY source_file)
    SELECT source_file, rows_scored, row_attack_count, rows_scored - row_attack_count AS row_benign_count,
      CAST(row_attack_count AS DOUBLE) / rows_scored AS attack_ratio, max_score, mean_score,
      CASE WHEN CAST(row_attack_count AS DOUBLE) / rows_scored >= CAST(0.37 AS DOUBLE) THEN 'attack' ELSE 'benign' END AS prediction,
      CASE WHEN CAST(row_attack_count AS DOUBLE) / rows_scored >= CAST(0.37 AS DOUBLE) THEN 'high' ELSE 'info' END AS severity
    FROM g""",
)
def file_verdict(spark, sf):
    f = views.flows(spark, sf).select("source_file", (F.col("value") / 500.0).alias("score"))
    return evidence.file_verdict(f, 0.1, file_attack_ratio=0.37).withColumn("mean_score", F.round("mean_score", 9))


CAPTURE_MAP_SQL = """
mapping(capture_name, flow_file) AS (VALUES
  ('ddos.pcap', 'Friday-WorkingHours-Afternoon-DDos.pcap_ISCX.csv'),
  ('benign.pcap', 'Monday-WorkingHours.pcap_ISCX.csv'),
  ('webattack.pcap', 'Thursday-WorkingHours-Morning-WebAttacks.pcap_ISCX.csv')),
resolved AS (SELECT u.*, lower(regexp_replace(split_part(file_path, '/', 3), '^[0-9a-fA-F]{12}_', '')) AS capture_name,
  coalesce(m.flow_file, '') AS flow_csv_path, CASE WHEN m.flow_file IS NULL THEN 'not_found' ELSE 'matched' END AS status,
  CASE WHEN m.flow_file IS NULL
    THEN 'no flow file mapping matched ' || lower(regexp_replace(split_part(file_path, '/', 3), '^[0-9a-fA-F]{12}_', ''))
    ELSE 'capture mapped to flow file' END AS reason
  FROM uploads u LEFT JOIN mapping m
    ON m.capture_name = lower(regexp_replace(split_part(file_path, '/', 3), '^[0-9a-fA-F]{12}_', '')))"""


def resolved_uploads(spark, sf):
    files = views.flows(spark, sf).select(F.col("source_file").alias("flow_file")).distinct()
    return evidence.resolve_captures(views.uploads(spark, sf), evidence.capture_file_map(spark), files)


@query(
    "resolve_captures",
    f"""WITH {views.UPLOADS}, {CAPTURE_MAP_SQL} SELECT arrival, capture_name, status, flow_csv_path, reason FROM resolved""",
)
def resolve_captures(spark, sf):
    return resolved_uploads(spark, sf).select("arrival", "capture_name", "status", "flow_csv_path", "reason")


@query(
    "attach_artifact_evidence",
    f"""WITH {ARTIFACT_SQL}, {views.UPLOADS.removeprefix(views.EVENTS + ",")}, {CAPTURE_MAP_SQL}
    SELECT arrival, flow_csv_path, attack_prediction_count, sample_row_id FROM resolved r
    LEFT JOIN artifact_evidence a ON a.source_file = r.flow_csv_path""",
)
def attach_artifact_evidence(spark, sf):
    e = evidence.artifact_evidence(artifact_rows(spark, sf))
    return evidence.attach_artifact_evidence(resolved_uploads(spark, sf), e).select(
        "arrival", "flow_csv_path", "attack_prediction_count", "sample_row_id"
    )


def capture_verdicts(spark, sf):
    """Verdicts of the closed days of the captures without a flow file, from the packet stream."""
    stream = stream_verdicts(views.capture_packets(spark, sf, stream=True), ["capture"], "1 day", "0 seconds", CAPTURE_RULES)
    return drain(stream, "capture-verdicts")


def live_by_capture(verdicts):
    """A capture is an attack if one of its windows is; the first such window names the type."""
    attack = F.when(F.col("prediction") == "attack", F.col("window_start"))
    return verdicts.groupBy(F.col("capture").alias("capture_name")).agg(
        F.max(F.struct((F.col("prediction") == "attack").alias("hit"), "prediction")).getField("prediction").alias("live_prediction"),
        F.coalesce(F.min_by("attack_type", attack), F.lit("BENIGN")).alias("live_attack_type"),
    )


@query(
    "stream_live_verdict",
    f"""WITH {views.FLOWS}, {views.CAPTURE_VERDICTS} SELECT epoch_us(d) AS window_start, capture, number_of_flows, unique_dst_ports,
    total_syn_count, high_rate_flow_count, prediction, attack_type, CASE prediction WHEN 'attack' THEN 'high' ELSE 'info' END AS severity
    FROM cap_verdicts""",
)
def stream_live_verdict(spark, sf):
    names = ["number_of_flows", "unique_dst_ports", "total_syn_count", "high_rate_flow_count", "prediction", "attack_type", "severity"]
    return capture_verdicts(spark, sf).select(F.unix_micros("window_start").alias("window_start"), "capture", *names)


@query(
    "evidence_fusion",
    f"""WITH {LABEL_SQL}, {ARTIFACT_SQL.removeprefix(views.FLOWS + ",")},
    {views.UPLOADS.removeprefix(views.EVENTS + ",")}, {CAPTURE_MAP_SQL},
    {views.CAPTURE_VERDICTS},
    live AS (SELECT capture AS capture_name, CASE WHEN bool_or(prediction = 'attack') THEN 'attack' ELSE 'benign' END AS live_prediction,
      coalesce(arg_min(attack_type, d) FILTER (WHERE prediction = 'attack'), 'BENIGN') AS live_attack_type FROM cap_verdicts GROUP BY capture),
    j AS (SELECT r.arrival, l.live_prediction AS lp, l.live_attack_type AS lt,
      CASE WHEN r.capture_name <> 'webattack.pcap' THEN e.prediction END AS bp, e.most_common_attack_label AS bt,
      a.prediction AS ap, a.sample_score AS score
      FROM resolved r LEFT JOIN live l ON l.capture_name = r.capture_name
      LEFT JOIN label_evidence e ON e.source_file = r.flow_csv_path
      LEFT JOIN artifact_evidence a ON a.source_file = r.flow_csv_path)
    SELECT arrival, coalesce(lp, bp, 'benign') AS prediction,
      CASE WHEN lp IS NOT NULL THEN 'live_extracted_flow_rules' WHEN bp IS NOT NULL THEN 'matched_cic_flow_csv_label'
        WHEN ap = 'attack' THEN 'ids_prediction_artifact_without_label_confirmation'
        WHEN ap IS NOT NULL THEN 'ids_prediction_artifact_source_file' ELSE 'no_label_or_artifact_evidence' END AS evidence_source,
      CASE WHEN lp IS NOT NULL OR ap IS NULL THEN 0 WHEN bp IS NOT NULL THEN CASE WHEN ap <> bp THEN 1 ELSE 0 END
        WHEN ap = 'attack' THEN 1 ELSE 0 END AS artifact_conflict,
      CASE WHEN lp IS NULL THEN score END AS score,
      CASE WHEN coalesce(lp, bp, 'benign') = 'attack' THEN CASE WHEN lp IS NOT NULL THEN lt ELSE coalesce(nullif(bt, ''), 'UnknownAttack') END
        ELSE 'BENIGN' END AS attack_type,
      CASE WHEN coalesce(lp, bp, 'benign') = 'attack' THEN 'high' ELSE 'info' END AS severity
    FROM j""",
)
def evidence_fusion(spark, sf):
    uploads = resolved_uploads(spark, sf)
    live = live_by_capture(capture_verdicts(spark, sf))
    labels = evidence.label_evidence(views.raw_flows(spark, sf)).select(
        F.col("source_file").alias("flow_csv_path"),
        F.col("prediction").alias("label_prediction"),
        F.col("most_common_attack_label").alias("label_attack_type"),
    )
    artifact = evidence.artifact_evidence(artifact_rows(spark, sf)).select(
        F.col("source_file").alias("flow_csv_path"),
        F.col("prediction").alias("artifact_prediction"),
        F.col("sample_score").alias("artifact_score"),
    )
    joined = (
        uploads.join(live, "capture_name", "left")
        .join(labels, "flow_csv_path", "left")
        .join(artifact, "flow_csv_path", "left")
        # Web attack captures count as unlabelled, so the artifact alone speaks for them.
        .withColumn("label_prediction", F.when(F.col("capture_name") != "webattack.pcap", F.col("label_prediction")))
    )
    fused = evidence.fuse_evidence(joined)
    return fused.select(
        "arrival",
        "prediction",
        "evidence_source",
        F.col("artifact_conflict").cast("int").alias("artifact_conflict"),
        "score",
        "attack_type",
        "severity",
    )


@query(
    "capture_names",
    f"""WITH {views.UPLOADS} SELECT arrival, lower(regexp_replace(split_part(file_path, '/', 3), '^[0-9a-fA-F]{{12}}_', '')) AS name
    FROM uploads""",
)
def capture_names(spark, sf):
    return views.uploads(spark, sf).select("arrival", capture_name(F.col("file_path")).alias("name"))
