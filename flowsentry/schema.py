"""Fixed schemas of events, alerts, packets and result tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


S, L, I, D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()

UPLOAD_EVENT = _fields(
    tenant_id=S,
    source_id=S,
    file_epoch=S,
    start_offset=L,
    end_offset=L,
    effective_start_offset=L,
    file_path=S,
    file_type=S,
    original_filename=S,
    batch_hash=S,
    content_hash=S,
    decision=S,
    upload_time=S,
)

# A topic record as the stream sources deliver it.
TOPIC_RECORD = _fields(topic=S, partition=I, offset=L, value=S)

EVIDENCE = T.MapType(S, S)

ALERT = _fields(
    alert_id=S,
    tenant_id=S,
    source_id=S,
    severity=S,
    prediction=S,
    attack_type=S,
    stage=S,
    evidence=EVIDENCE,
    timestamp=S,
)

SIGNATURE_ALERT = _fields(
    timestamp=S,
    gid=I,
    sid=I,
    rev=I,
    message=S,
    priority=I,
    proto=S,
    src_ip=S,
    src_port=I,
    dst_ip=S,
    dst_port=I,
    source_file=S,
    pcap_name=S,
)

PACKET_FIELDS = [
    "frame.time_epoch",
    "ip.src",
    "ip.dst",
    "ip.proto",
    "tcp.srcport",
    "tcp.dstport",
    "udp.srcport",
    "udp.dstport",
    "frame.len",
    "tcp.flags.syn",
    "tcp.flags.ack",
]

PACKET = T.StructType([T.StructField(name, S, True) for name in PACKET_FIELDS])

# Flow columns that are text; every other flow column is a number.
FLOW_TEXT = {"label", "multiclass_label", "timestamp", "source_ip", "destination_ip", "flow_id", "simillarhttp"}

METRIC_COLUMNS = [
    "method",
    "operating_point",
    "threshold_source",
    "threshold",
    "accuracy",
    "precision",
    "recall",
    "f1",
    "far",
    "roc_auc",
    "pr_auc",
    "tp",
    "fp",
    "tn",
    "fn",
]
