"""Upload log: validation, de-duplication, topics, alerts per tenant."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsentry.functions import uploads as U
from flowsentry.operators import uploads
from flowsentry.plans.alerts import AlertStore, build_alerts, tenant_alert_counts
from flowsentry.session import materialize, scratch_path
from flowsentry.sources.topics import consumed, malformed, parse_events, to_records
from workload import views
from workload.registry import query

# One upload after the other per source: the list of accepted hashes travels with the recursion.
DEDUP_SQL = """
WITH RECURSIVE {uploads},
numbered AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, source_id ORDER BY arrival) AS i FROM {table}),
walk AS (
  SELECT tenant_id, source_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS arrival,
    CAST([] AS VARCHAR[]) AS contents, CAST([] AS VARCHAR[]) AS batches,
    CAST(0 AS BIGINT) AS end0, CAST(0 AS BIGINT) AS end1, CAST(NULL AS VARCHAR) AS decision,
    CAST(NULL AS BIGINT) AS effective_start_offset, CAST(NULL AS VARCHAR) AS reason
  FROM (SELECT DISTINCT tenant_id, source_id FROM uploads)
  UNION ALL
  SELECT tenant_id, source_id, i, arrival,
    CASE WHEN accepted THEN list_append(contents, content_hash) ELSE contents END,
    CASE WHEN accepted THEN list_append(batches, file_epoch || batch_hash) ELSE batches END,
    CASE WHEN accepted AND file_epoch = 'e0' THEN end_offset ELSE end0 END,
    CASE WHEN accepted AND file_epoch = 'e1' THEN end_offset ELSE end1 END,
    CASE WHEN dup_content OR dup_batch THEN 'drop_duplicate' WHEN stale THEN 'drop_stale'
      WHEN start_offset < last_end THEN 'trim_overlap' ELSE 'forward' END,
    CASE WHEN accepted AND start_offset < last_end THEN last_end ELSE start_offset END,
    CASE WHEN dup_content THEN 'content_hash_match' WHEN dup_batch THEN 'batch_hash_match' END
  FROM (
    SELECT *, NOT (dup_content OR dup_batch OR stale) AS accepted FROM (
      SELECT n.*, w.contents, w.batches, w.end0, w.end1,
        CASE n.file_epoch WHEN 'e0' THEN w.end0 ELSE w.end1 END AS last_end,
        coalesce(list_contains(w.contents, n.content_hash), false) AS dup_content,
        coalesce(list_contains(w.batches, n.file_epoch || n.batch_hash), false) AS dup_batch,
        n.end_offset <= CASE n.file_epoch WHEN 'e0' THEN w.end0 ELSE w.end1 END AS stale
      FROM walk w JOIN numbered n ON n.tenant_id = w.tenant_id AND n.source_id = w.source_id AND n.i = w.i + 1))
)"""
DEDUP_CTE = DEDUP_SQL.format(uploads=views.UPLOADS.strip(), table="uploads")
GAPS = """,
gaps AS (SELECT * REPLACE (CASE WHEN arrival % 11 <> 0 THEN content_hash END AS content_hash,
  CASE WHEN arrival % 13 <> 0 THEN batch_hash END AS batch_hash) FROM uploads)"""
GAPS_CTE = DEDUP_SQL.format(uploads=views.UPLOADS.strip() + GAPS, table="gaps")

# A source starts anew after more than two idle days of its own, and after a reset of its tenant (noon of each tenth day).
SESSIONS = """,
paced AS (SELECT *, upload_ts - lag(upload_ts) OVER (PARTITION BY tenant_id, source_id ORDER BY arrival) AS idle,
  CAST(floor((epoch(upload_ts) - 43200) / 864000) AS BIGINT) AS resets FROM uploads),
sessions AS (SELECT * REPLACE (source_id || '#' || session AS source_id), source_id AS own FROM (SELECT *,
  sum(CASE WHEN idle > INTERVAL 2 DAY OR resets > before THEN 1 ELSE 0 END) OVER (PARTITION BY tenant_id, source_id ORDER BY arrival) AS session
  FROM (SELECT *, lag(resets) OVER (PARTITION BY tenant_id, source_id ORDER BY arrival) AS before FROM paced)))"""
SESSIONS_CTE = DEDUP_SQL.format(uploads=views.UPLOADS.strip() + SESSIONS, table="sessions").replace(
    "FROM (SELECT DISTINCT tenant_id, source_id FROM uploads)", "FROM (SELECT DISTINCT tenant_id, source_id FROM sessions)"
)

DECIDED = """ SELECT arrival, tenant_id, source_id, decision, effective_start_offset,
  CASE WHEN decision IN ('forward', 'trim_overlap') THEN 1 ELSE 0 END AS should_forward, reason
  FROM walk WHERE i > 0"""
DECISIONS = DEDUP_CTE + DECIDED


@query("upload_dedup", DECISIONS)
def upload_dedup(spark, sf):
    return _decisions(views.uploads(spark, sf))


@query("upload_dedup_missing_hash", GAPS_CTE + DECIDED)
def upload_dedup_missing_hash(spark, sf):
    """A missing hash makes no duplicate; the upload is judged by its offsets."""
    log = views.uploads(spark, sf)
    return _decisions(
        log.withColumns(
            {
                "content_hash": F.when(F.col("arrival") % 11 != 0, F.col("content_hash")),
                "batch_hash": F.when(F.col("arrival") % 13 != 0, F.col("batch_hash")),
            }
        )
    )


def _decisions(log):
    return uploads.dedupe_uploads(log).select(
        "arrival",
        "tenant_id",
        "source_id",
        "decision",
        "effective_start_offset",
        F.col("should_forward").cast("int").alias("should_forward"),
        "reason",
    )


@query(
    "upload_first_copies",
    f"""WITH {views.UPLOADS} SELECT tenant_id, source_id, content_hash, min(arrival) AS arrival FROM uploads GROUP BY ALL""",
)
def upload_first_copies(spark, sf):
    return uploads.first_copies(views.uploads(spark, sf))


@query(
    "upload_validate",
    f"""WITH {views.UPLOADS}, v AS (SELECT arrival,
      start_offset - CASE WHEN arrival % 97 = 0 THEN 1 ELSE 0 END AS s, end_offset - 1 AS e,
      CASE WHEN tenant_id = 'tenant_2' THEN '  ' ELSE tenant_id END AS tenant, source_id AS source,
      CASE WHEN file_type = 'flow_csv' THEN 0 ELSE 5 END AS bytes FROM uploads)
    SELECT arrival, CASE WHEN s < 0 OR e < 0 THEN 'offsets must be non-negative'
      WHEN e <= s THEN 'end_offset must be greater than start_offset'
      WHEN trim(tenant) = '' THEN 'tenant_id/source_id cannot be empty'
      WHEN bytes <= 0 THEN 'empty payload' END AS reject_reason FROM v""",
)
def upload_validate(spark, sf):
    u = views.uploads(spark, sf)
    tenant = F.when(F.col("tenant_id") == "tenant_2", F.lit("  ")).otherwise(F.col("tenant_id"))
    start = F.col("start_offset") - F.when(F.col("arrival") % 97 == 0, 1).otherwise(0)
    size = F.when(F.col("file_type") == "flow_csv", 0).otherwise(5)
    return u.select(
        "arrival",
        U.reject_reason(tenant, F.col("source_id"), start, F.col("end_offset") - 1, size).alias("reject_reason"),
    )


@query(
    "upload_names",
    f"""WITH {views.UPLOADS} SELECT arrival, 'tenant_x_' || tenant_id AS safe_tenant,
      substr(content_hash, 1, 12) || '_' || regexp_replace(split_part(file_path, '/', 3), '[^A-Za-z0-9_.-]+', '_', 'g') AS stored,
      'raw.tenant.' || tenant_id AS topic FROM uploads""",
)
def upload_names(spark, sf):
    u = views.uploads(spark, sf)
    return u.select(
        "arrival",
        U.safe_part(F.concat(F.lit(" tenant x: "), F.col("tenant_id"))).alias("safe_tenant"),
        U.stored_name(F.col("file_path"), F.col("content_hash")).alias("stored"),
        U.raw_topic(F.col("tenant_id")).alias("topic"),
    )


def topic_records(spark, sf):
    """Upload events as topic records; some values are broken or not objects, some lack the tenant."""
    u = views.uploads(spark, sf)
    named = u.withColumn("tenant", F.when(F.col("file_epoch") == "e0", F.col("tenant_id")))
    good = F.to_json(F.struct(F.col("tenant").alias("tenant_id"), "source_id", "file_path", "start_offset"))
    k = F.col("end_offset") % 7
    value = F.when(k == 0, F.substring(good, 1, 20)).when(k == 3, F.lit("[1, 2]")).otherwise(good)
    return named.select(
        F.when(F.col("source_id") == "src_1", F.lit("raw")).otherwise(U.raw_topic(F.col("tenant_id"))).alias("topic"),
        F.lit(0).alias("partition"),
        F.col("arrival").alias("offset"),
        value.alias("value"),
    )


RECORDS_SQL = (
    views.UPLOADS
    + """,
records AS (SELECT *, CASE WHEN source_id = 'src_1' THEN 'raw' ELSE 'raw.tenant.' || tenant_id END AS topic,
  CASE WHEN file_epoch = 'e0' THEN tenant_id END AS tenant, end_offset % 7 NOT IN (0, 3) AS good FROM uploads)"""
)


@query(
    "consumed_events",
    f"""WITH {RECORDS_SQL} SELECT topic, arrival AS offset, coalesce(tenant, '') AS tenant_id, source_id, file_path,
    '' AS decision FROM records WHERE good""",
)
def consumed_events(spark, sf):
    return consumed(topic_records(spark, sf))


@query(
    "malformed_events",
    f"""WITH {RECORDS_SQL} SELECT topic, arrival AS offset FROM records WHERE NOT good""",
)
def malformed_events(spark, sf):
    return malformed(topic_records(spark, sf)).select("topic", "offset")


@query(
    "tenant_isolation",
    f"""WITH {RECORDS_SQL} SELECT arrival AS offset, CASE WHEN good AND tenant IS NOT NULL THEN tenant
      WHEN topic = 'raw' THEN 'unknown_tenant' ELSE tenant_id END AS tenant,
      CASE WHEN topic LIKE 'raw.tenant.tenant_1%' THEN 1 ELSE 0 END AS in_pattern FROM records""",
)
def tenant_isolation(spark, sf):
    """Records that are not whole objects belong to the tenant their topic names."""
    return parse_events(topic_records(spark, sf)).select(
        "offset",
        U.tenant_of(F.col("tenant_id"), F.col("topic")).alias("tenant"),
        U.topic_matches(F.col("topic"), "raw.tenant.tenant_1*").cast("int").alias("in_pattern"),
    )


@query(
    "keyword_prediction",
    f"""WITH {views.UPLOADS} SELECT arrival, CASE WHEN contains(lower(file_path), 'attack') THEN 'attack' ELSE 'benign' END
    AS prediction FROM uploads""",
)
def keyword_prediction(spark, sf):
    return views.uploads(spark, sf).select("arrival", U.keyword_prediction(F.col("file_path")).alias("prediction"))


def judged(spark, sf):
    u = views.uploads(spark, sf)
    return u.select(
        "tenant_id",
        "source_id",
        "file_path",
        "file_type",
        F.lit(None).cast("string").alias("original_filename"),
        "batch_hash",
        "content_hash",
        F.lit("forward").alias("decision"),
        U.raw_topic(F.col("tenant_id")).alias("topic"),
        F.col("arrival").alias("offset"),
        U.keyword_prediction(F.col("file_path")).alias("prediction"),
        F.lit("high").alias("severity"),
        F.when(F.col("file_type") == "pcap", F.lit("HighRateFlow")).alias("attack_type"),
        F.lit(None).cast("string").alias("stage"),
        F.create_map(F.lit("evidence_source"), F.lit("keyword")).alias("evidence"),
    )


@query(
    "alert_records",
    f"""WITH {views.UPLOADS} SELECT tenant_id, source_id, 'high' AS severity, 'attack' AS prediction,
      CASE WHEN file_type = 'pcap' THEN 'HighRateFlow' ELSE 'UnknownAttack' END AS attack_type,
      '{{"batch_hash":"' || batch_hash || '","content_hash":"' || content_hash || '","evidence_source":"keyword","file_name":"'
        || split_part(file_path, '/', 3) || '","file_path":"' || file_path || '","file_type":"' || file_type
        || '","gateway_decision":"forward","kafka_offset":"' || CAST(arrival AS VARCHAR)
        || '","kafka_topic":"raw.tenant.' || tenant_id || '"}}' AS evidence,
      'alert.tenant.' || tenant_id AS topic
    FROM uploads WHERE contains(lower(file_path), 'attack')""",
)
def alert_records(spark, sf):
    alerts = build_alerts(judged(spark, sf))
    return alerts.select(
        "tenant_id",
        "source_id",
        "severity",
        "prediction",
        "attack_type",
        U.evidence_summary(F.col("evidence")).alias("evidence"),
        U.alert_topic(F.col("tenant_id")).alias("topic"),
    )


@query(
    "tenant_counts",
    f"""WITH {views.UPLOADS} SELECT tenant_id, count(*) AS alerts FROM uploads
    WHERE contains(lower(file_path), 'attack') GROUP BY tenant_id""",
)
def tenant_counts(spark, sf):
    return tenant_alert_counts(build_alerts(judged(spark, sf)))


NESTED = """'{"attack_ratio":' || CASE WHEN file_type = 'pcap' THEN '0.5' ELSE '2' END || ',"files":["' || batch_hash || '",[1],{}]'
  || CASE WHEN arrival % 3 = 0 THEN '' ELSE ',"inner":{' || CASE WHEN arrival % 2 = 0 THEN '"deep":{"tenant":"' || tenant_id || '"}' ELSE '"deep":{}' END || '}' END || '}'"""


@query("evidence_nested", f"""WITH {views.UPLOADS} SELECT arrival, {NESTED} AS evidence FROM uploads""")
def evidence_nested(spark, sf):
    u = views.uploads(spark, sf)
    tenant = F.when(F.col("arrival") % 2 == 0, F.col("tenant_id")).otherwise(F.lit(""))
    inner = F.concat(F.lit('{"deep":{"none":null,"tenant":"'), tenant, F.lit('","empty":""}}'))
    inner = F.when(F.col("arrival") % 3 == 0, F.lit('""')).otherwise(inner)
    ratio = F.when(F.col("file_type") == "pcap", F.lit("0.5")).otherwise(F.lit("2"))
    text = F.concat(
        F.lit('{"note":null,"inner":'), inner, F.lit(',"files":[null,"","'), F.col("batch_hash"), F.lit('",[1,null],{"x":""}],"attack_ratio":'), ratio, F.lit("}")
    )
    return u.select("arrival", U.nested_evidence(text).alias("evidence"))


@query(
    "alert_store",
    f"""WITH {views.UPLOADS}, hits AS (SELECT *, arrival % 2 AS commit FROM uploads WHERE contains(lower(file_path), 'attack'))
    SELECT tenant_id, count(*) FILTER (WHERE commit = 1 OR tenant_id <> 'tenant_0') AS listed, count(*) FILTER (WHERE commit = 0) AS before
    FROM hits GROUP BY tenant_id""",
)
def alert_store(spark, sf):
    """Two commits with a clearing of one tenant between, then compacted: alerts listed, and those before the second."""
    store = AlertStore(spark, scratch_path(spark, "alert-store"))
    log = judged(spark, sf)
    for part in (0, 1):
        store.append(build_alerts(log.filter(F.col("offset") % 2 == part)))
        if part == 0:
            before = materialize(tenant_alert_counts(store.alerts()).withColumnRenamed("alerts", "before"), "stored")
            store.clear("tenant_0")
    store.compact()
    return tenant_alert_counts(store.alerts()).withColumnRenamed("alerts", "listed").join(before, "tenant_id")


@query(
    "content_groups",
    """SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_file FROM documents GROUP BY 1""",
)
def content_groups(spark, sf):
    return uploads.content_groups(views.table(spark, sf, "documents"), "text", "doc_id")
