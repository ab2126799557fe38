"""Sources and sinks: the views are written in the formats of the inputs and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.functions import uploads as U
from flowsentry.functions.labels import with_labels
from flowsentry.plans.alerts import build_alerts
from flowsentry.schema import PACKET_FIELDS, UPLOAD_EVENT
from flowsentry.session import scratch_path
from flowsentry.sources import flow_csv, packets, reports, signature_files, topics
from flowsentry.streaming.pipeline import append_stream, fresh_checkpoint
from workload import views
from workload.registry import query
from workload.upload_queries import judged

# Header spellings of two exports of the same tool.
LONG_HEADER = {
    "row": "Flow ID",
    "source_ip": "Source IP",
    "destination_port": " Destination Port",
    "total_fwd_packets": "Total Fwd Packets",
    "flow_bytes_s": "Flow Bytes/s",
    "label": " Label",
}
SHORT_HEADER = {
    "row": "Flow ID",
    "source_ip": "Src IP",
    "destination_port": "Dst Port",
    "total_fwd_packets": "Tot Fwd Pkts",
    "label": "Label",
}


def flow_folder(spark: SparkSession, sf: str) -> str:
    """Flow CSVs: most UTF-8 with long headers and infinities, others windows-1252 with short ones."""
    folder = scratch_path(spark, "flow-csv")
    raw = views.raw_flows(spark, sf).withColumn("row", F.col("row_id").cast("string"))
    raw = raw.withColumn("flow_bytes_s", F.when(F.col("k") == 17, float("inf")).otherwise(F.col("flow_bytes_s")))
    # The writer knows no windows-1252, where byte 96 is a dash; ISO-8859-1 writes U+0096 as that byte.
    for part, names, encoding, dash in (("long", LONG_HEADER, "UTF-8", "\u2013"), ("short", SHORT_HEADER, "ISO-8859-1", "\u0096")):
        label = F.when(F.col("k") == 99, F.lit(f"Web Attack {dash} XSS")).otherwise(F.trim("label"))
        own = raw.withColumn("label", label)
        own = own.filter((F.col("row_id") % 3 == 0) if part == "short" else (F.col("row_id") % 3 != 0))
        named = own.select(*[F.col(c).alias(n) for c, n in names.items()])
        named.repartition(3, "Flow ID").write.option("header", "true").option("encoding", encoding).csv(f"{folder}/{part}")
    return folder


@query(
    "flow_folder",
    f"""WITH {views.FLOWS} SELECT CAST(row_id AS VARCHAR) AS flow_id, source_ip, CAST(destination_port AS DOUBLE) AS destination_port,
      total_fwd_packets, CASE WHEN row_id % 3 <> 0 THEN CAST(k = 17 AS INTEGER) END AS infinite,
      CASE WHEN row_id % 3 <> 0 AND k <> 17 THEN round(flow_bytes_s, 6) END AS flow_bytes_s,
      CASE WHEN k = 99 THEN 'Web Attack - XSS' ELSE multiclass_label END AS multiclass_label
    FROM flows""",
)
def flow_folder_query(spark, sf):
    """Six CSV files, two headers, two encodings, as one table with canonical names and classes."""
    flows = with_labels(flow_csv.read_flow_folder(spark, flow_folder(spark, sf)))
    infinite = F.col("flow_bytes_s") == float("inf")
    return flows.select(
        "flow_id",
        "source_ip",
        "destination_port",
        "total_fwd_packets",
        infinite.cast("int").alias("infinite"),
        F.when(~infinite, F.round("flow_bytes_s", 6)).alias("flow_bytes_s"),
        "multiclass_label",
    )


@query(
    "flow_folder_ids",
    f"""WITH {views.FLOWS} SELECT count(*) AS flows, count(*) AS ids, CAST(0 AS BIGINT) AS first, count(*) - 1 AS last FROM flows""",
)
def flow_folder_ids(spark, sf):
    """Row ids run from 0 over all files."""
    flows = flow_csv.read_flow_folder(spark, flow_folder(spark, sf))
    return flows.agg(
        F.count("*").alias("flows"), F.count_distinct("row_id").alias("ids"), F.min("row_id").alias("first"), F.max("row_id").alias("last")
    )


@query(
    "file_diagnostics",
    f"""WITH {views.FLOWS} SELECT CAST(1 AS INTEGER) AS input_file_exists, count(*) AS rows FROM flows
    UNION ALL SELECT 0, 0""",
)
def file_diagnostics(spark, sf):
    """Files that were asked for: those that exist with their rows, and absent ones."""
    folder = flow_folder(spark, sf)
    flows = flow_csv.read_flow_folder(spark, folder)
    names = flow_csv.list_files(spark, folder).select(F.substring_index("path", "/", -1).alias("source_file"))
    wanted = names.unionByName(names.select(F.concat(F.lit("absent-"), "source_file").alias("source_file")))
    found = flow_csv.file_diagnostics(spark, wanted, folder, flows)
    sized = found.filter(F.col("input_file_exists") == (F.col("input_file_size_bytes") > 0))
    return sized.groupBy(F.col("input_file_exists").cast("int").alias("input_file_exists")).agg(F.sum("raw_rows_loaded").alias("rows"))


def _renamed(spark: SparkSession, folder: str, name: str) -> None:
    """Give the only part file of a folder a name."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    (part,) = [s.getPath() for s in system.listStatus(path) if s.getPath().getName().startswith("part-")]
    system.rename(part, hadoop.Path(f"{folder}/{name}"))


@query(
    "alert_folder",
    f"""WITH {views.ALERT_LINES} SELECT 'capture_' || CAST(alert_id % 3 AS VARCHAR) AS pcap_name, count(*) AS alerts,
      count(*) FILTER (WHERE alert_id % 7 <> 2) AS with_priority,
      count(*) FILTER (WHERE alert_id % 10 <> 3) AS with_ports FROM alert_lines
    WHERE alert_id % 11 <> 5 AND alert_id % 13 <> 6 AND trim(split_part(value, '[**]', 1)) <> '' GROUP BY ALL""",
)
def alert_folder(spark, sf):
    """Alert text of three captures, each in a folder that names it."""
    folder, lines = scratch_path(spark, "alert-text"), views.alert_lines(spark, sf)
    for k in range(3):
        lines.filter(F.col("alert_id") % 3 == k).select("value").coalesce(1).write.text(f"{folder}/capture_{k}")
        _renamed(spark, f"{folder}/capture_{k}", "alert_fast.txt")
    return signature_files.read_alert_folder(spark, folder).groupBy("pcap_name").agg(
        F.count("*").alias("alerts"), F.count("priority").alias("with_priority"), F.count("src_port").alias("with_ports")
    )


@query("policy_file", f"""WITH {views.FLOWS} SELECT DISTINCT CAST(1000 + k AS INTEGER) AS sid FROM flows""")
def policy_file(spark, sf):
    """A policy list with comments, blank lines and repeated ids."""
    path = scratch_path(spark, "policy")
    line = F.when(F.col("row_id") % 5 == 0, F.lit("# comment")).when(F.col("row_id") % 5 == 1, F.lit("  "))
    flows = views.raw_flows(spark, sf)
    sid = (1000 + F.col("k")).cast("string")
    flows.select(F.explode(F.array(sid, F.coalesce(line, sid))).alias("value")).write.text(path)
    return signature_files.read_policy(spark, path)


@query("split_id_file", f"""WITH {views.FLOWS} SELECT row_id FROM flows WHERE row_id % 7 = 0""")
def split_id_file(spark, sf):
    """Rows named by a split file."""
    path, flows = scratch_path(spark, "split-ids"), views.raw_flows(spark, sf).select("row_id")
    ids = flows.agg(
        F.collect_list(F.when(F.col("row_id") % 7 == 0, F.col("row_id"))).alias("test_row_ids"),
        F.collect_list(F.when(F.col("row_id") % 7 == 1, F.col("row_id"))).alias("train_row_ids"),
    )
    ids.write.json(path)
    return signature_files.rows_in(flows, signature_files.read_split_ids(spark, path))


@query(
    "packet_files",
    """SELECT '10.1.0.' || CAST(l_suppkey % 10 AS VARCHAR) AS source, count(*) AS packets,
      count(*) FILTER (WHERE l_partkey % 97 <> 0) AS with_destination,
      CAST(sum(CAST(trunc(l_quantity * 30) AS BIGINT)) AS BIGINT) AS bytes FROM lineitem GROUP BY 1""",
)
def packet_files(spark, sf):
    """Decoded packet fields as quoted CSVs."""
    path = scratch_path(spark, "packet-csv")
    fields = [F.col(f"`{c}`") for c in PACKET_FIELDS]
    views.packets(spark, sf).select(*fields).write.option("header", "true").option("quoteAll", "true").csv(path)
    read = packets.read_packets(spark, path)
    return read.groupBy(F.col("`ip.src`").alias("source")).agg(
        F.count("*").alias("packets"), F.count("`ip.dst`").alias("with_destination"), F.sum(F.col("`frame.len`").cast("bigint")).alias("bytes")
    )


@query(
    "prediction_files",
    f"""WITH {views.SPLITS} SELECT split, count(*) AS rows, CAST(sum(binary_label) AS BIGINT) AS attacks,
      (SELECT count(*) FROM splits) AS n_total FROM splits GROUP BY split""",
)
def prediction_files(spark, sf):
    """Predictions by split, a CSV report and a JSON summary, written and read back."""
    folder, splits = scratch_path(spark, "reports"), views.splits(spark, sf).select("row_id", "split", "binary_label")
    reports.write_predictions(splits, f"{folder}/predictions")
    back = spark.read.parquet(f"{folder}/predictions")
    reports.write_report(back.groupBy("split").agg(F.count("*").alias("rows"), F.sum("binary_label").alias("attacks")), f"{folder}/report")
    reports.write_summary(reports.run_summary(back, {"seed": 42}), f"{folder}/summary")
    report = spark.read.schema("split string, rows bigint, attacks bigint").option("header", "true").csv(f"{folder}/report")
    summary = spark.read.json(f"{folder}/summary").select("n_total").first()
    return report.withColumn("n_total", F.lit(summary["n_total"]).cast("bigint"))


MESSAGES = f"""WITH {views.UPLOADS} SELECT 'alert.tenant.' || tenant_id AS topic, tenant_id, source_id,
    CASE WHEN file_type = 'pcap' THEN 'HighRateFlow' ELSE 'UnknownAttack' END AS attack_type,
    CAST(arrival AS VARCHAR) AS source_offset, CAST(1 AS INTEGER) AS named
  FROM uploads WHERE contains(lower(file_path), 'attack')"""


def _message_fields(records: DataFrame) -> DataFrame:
    """Fields of alert messages; ids and times differ from run to run, so only their presence shows."""
    def part(name):
        return F.get_json_object("value", f"$.{name}")

    named = part("alert_id").isNotNull() & part("timestamp").isNotNull()
    return records.select(
        "topic",
        part("tenant_id").alias("tenant_id"),
        part("source_id").alias("source_id"),
        part("attack_type").alias("attack_type"),
        part("evidence.kafka_offset").alias("source_offset"),
        named.cast("int").alias("named"),
    )


@query("alert_messages", MESSAGES)
def alert_messages(spark, sf):
    """Alerts as topic records."""
    return _message_fields(topics.to_records(build_alerts(judged(spark, sf)), U.alert_topic(F.col("tenant_id"))))


@query("published_alerts", MESSAGES)
def published_alerts(spark, sf):
    """Alerts published as files by topic and read back."""
    folder = scratch_path(spark, "published")
    records = topics.to_records(build_alerts(judged(spark, sf)), U.alert_topic(F.col("tenant_id")))
    topics.publish(records, folder=folder)
    return _message_fields(spark.read.schema("value string, topic string").json(folder))


@query(
    "topic_stream",
    f"""WITH {views.UPLOADS} SELECT 'raw.tenant.' || tenant_id AS topic, arrival AS "offset", tenant_id, source_id, start_offset, end_offset, content_hash
    FROM uploads""",
)
def topic_stream(spark, sf):
    """Topic records in five files, read as a stream of one file a trigger and parsed."""
    folder, out = scratch_path(spark, "topic-files"), scratch_path(spark, "topic-events")
    u = views.uploads(spark, sf)
    event = F.to_json(F.struct(*[c for c in UPLOAD_EVENT.fieldNames() if c in u.columns]))
    records = u.select(U.raw_topic(F.col("tenant_id")).alias("topic"), F.lit(0).alias("partition"), F.col("arrival").alias("offset"), event.alias("value"))
    records.repartition(5, "offset").write.json(folder)
    events = topics.parse_events(topics.stream_topic_files(spark, folder, files_per_trigger=1))
    slim = events.select("topic", "offset", "tenant_id", "source_id", "start_offset", "end_offset", "content_hash")
    append_stream(slim, out, fresh_checkpoint(slim, "topics")).awaitTermination()
    return spark.read.schema(slim.schema).parquet(out)
