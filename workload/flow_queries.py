"""Cleaning, splitting and rate rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsentry.config import RateRules
from flowsentry.functions import columns as C
from flowsentry.functions.labels import normalize_label
from flowsentry.operators import clean, metrics, rules, signature, split, stats
from flowsentry.operators.evidence import labelled_samples
from flowsentry.sources.flow_csv import union_files
from flowsentry.sources.reports import run_summary
from workload import views
from workload.registry import query

# The given events are sparse in time: with the 2-second default no window ever fills.
WIDE = RateRules(
    portscan_window_s=86400.0,
    bruteforce_window_s=86400.0,
    portscan_min_ports=4,
    portscan_max_packets=1_000_000,
    portscan_max_duration_us=1e12,
    bruteforce_min_attempts=2,
)

RULES_SQL = (
    views.FLOWS
    + """,
marked AS (
  SELECT *, floor(epoch_us("timestamp") / 86400000000) AS w,
    total_fwd_packets + total_backward_packets AS packets
  FROM flows
),
scanning AS (
  SELECT source_ip, w FROM marked WHERE packets <= 1000000 AND flow_duration <= 1e12
  GROUP BY source_ip, w HAVING count(DISTINCT destination_port) >= 4
),
hammering AS (
  SELECT source_ip, destination_port, w FROM marked WHERE destination_port IN (21, 22, 23)
  GROUP BY ALL HAVING count(*) >= 2
),
rules AS (
  SELECT m.*,
    CASE WHEN packets >= 20 AND (flow_packets_s > 40000 OR flow_bytes_s > 15000000) THEN 1 ELSE 0 END AS rate_V,
    CASE WHEN m.destination_port IN (80, 443, 8080) AND flow_duration > 60000000 AND packets < 20
      AND flow_bytes_s < 100 THEN 1 ELSE 0 END AS rate_L,
    CASE WHEN syn_flag_count >= 3 AND packets <= 10 THEN 1 ELSE 0 END AS rate_S,
    CASE WHEN rst_flag_count >= 5 AND packets <= 20 THEN 1 ELSE 0 END AS rate_R,
    CASE WHEN s.source_ip IS NOT NULL AND packets <= 1000000 THEN 1 ELSE 0 END AS rate_P,
    CASE WHEN h.source_ip IS NOT NULL THEN 1 ELSE 0 END AS rate_B
  FROM marked m
  LEFT JOIN scanning s ON m.source_ip = s.source_ip AND m.w = s.w
  LEFT JOIN hammering h ON m.source_ip = h.source_ip AND m.w = h.w AND m.destination_port = h.destination_port
),
fired AS (
  SELECT *, CASE WHEN rate_V = 1 THEN 'V' ELSE '' END || CASE WHEN rate_L = 1 THEN 'L' ELSE '' END
    || CASE WHEN rate_S = 1 THEN 'S' ELSE '' END || CASE WHEN rate_R = 1 THEN 'R' ELSE '' END
    || CASE WHEN rate_P = 1 THEN 'P' ELSE '' END || CASE WHEN rate_B = 1 THEN 'B' ELSE '' END AS letters,
    rate_V + rate_L + rate_S + rate_R + rate_P + rate_B AS fires,
    CASE WHEN k % 20 = 3 THEN 1 ELSE 0 END AS snort_pred,
    CASE WHEN k % 20 = 3 THEN CAST(0.5 AS DOUBLE) + k ELSE 0 END AS snort_score
  FROM rules
)"""
)


def flagged(spark, sf):
    return rules.rule_flags(views.flows(spark, sf), WIDE)


def external_table(spark, sf):
    """A signature prediction table over a part of the rows, by its accepted column names."""
    f = views.raw_flows(spark, sf)
    hit = F.col("k") % 20 == 3
    return f.select(
        F.col("row_id").cast("string").alias("Row_ID"),
        F.when(hit, F.lit("1")).otherwise(F.lit("0")).alias("prediction"),
        F.when(hit, (F.lit(0.5) + F.col("k")).cast("string")).otherwise(F.lit("n/a")).alias("score"),
    ).filter(F.col("prediction") == "1")


def _row_rule(name, fn, column):
    @query(name, f"WITH {RULES_SQL} SELECT row_id, {column} AS fired FROM rules")
    def run(spark, sf):
        f = views.flows(spark, sf)
        return f.select("row_id", fn(f, RateRules()).cast("int").alias("fired"))


_row_rule("rule_volumetric", rules.volumetric, "rate_V")
_row_rule("rule_slowhttp", rules.slow_http, "rate_L")
_row_rule("rule_synflood", rules.syn_flood, "rate_S")
_row_rule("rule_rst", rules.rst_anomaly, "rate_R")


@query("rule_portscan", f"WITH {RULES_SQL} SELECT row_id, rate_P AS fired FROM rules")
def rule_portscan(spark, sf):
    return rules.with_windowed_rules(views.flows(spark, sf), WIDE).select("row_id", F.col("_P").cast("int").alias("fired"))


@query("rule_bruteforce", f"WITH {RULES_SQL} SELECT row_id, rate_B AS fired FROM rules")
def rule_bruteforce(spark, sf):
    return rules.with_windowed_rules(views.flows(spark, sf), WIDE).select("row_id", F.col("_B").cast("int").alias("fired"))


@query(
    "rule_table",
    f"""WITH {RULES_SQL} SELECT row_id, 0 AS signature_pred, CAST(0 AS DOUBLE) AS signature_score,
    letters AS rule_fired, rate_V, rate_L, rate_S, rate_R, rate_P, rate_B FROM fired""",
)
def rule_table(spark, sf):
    return rules.signature_table(views.flows(spark, sf), WIDE)


@query(
    "rule_totals",
    f"""WITH {RULES_SQL}, t AS (SELECT count(*) AS n, sum(rate_V) v, sum(rate_L) l, sum(rate_S) s, sum(rate_R) r,
      sum(rate_P) p, sum(rate_B) b FROM fired)
    SELECT rule, CAST(f AS BIGINT) AS fires, n AS rows, CAST(f AS DOUBLE) / n AS fraction FROM (
      SELECT 'V' AS rule, v AS f, n FROM t UNION ALL SELECT 'L', l, n FROM t UNION ALL SELECT 'S', s, n FROM t
      UNION ALL SELECT 'R', r, n FROM t UNION ALL SELECT 'P', p, n FROM t UNION ALL SELECT 'B', b, n FROM t)""",
)
def rule_totals(spark, sf):
    return rules.rule_totals(flagged(spark, sf))


@query(
    "rule_or_merge",
    f"""WITH {RULES_SQL} SELECT row_id, snort_pred AS signature_pred, snort_score AS signature_score,
    letters || CASE WHEN snort_pred = 1 THEN 'X' ELSE '' END AS rule_fired,
    rate_V, rate_L, rate_S, rate_R, rate_P, rate_B, snort_pred AS rate_X FROM fired""",
)
def rule_or_merge(spark, sf):
    table = rules.signature_table(views.flows(spark, sf), WIDE)
    return signature.or_merge(table, signature.read_signature_table(external_table(spark, sf)))


@query(
    "rule_ablation",
    f"""WITH {RULES_SQL} SELECT row_id,
    CAST(greatest(rate_V, rate_S, rate_P) AS DOUBLE) AS score_vsp,
    CAST(CASE WHEN fires > 0 THEN 1 ELSE 0 END AS DOUBLE) AS score_any, CAST(fires AS DOUBLE) AS score_count,
    CAST(CASE WHEN fires > 0 OR snort_pred = 1 THEN 1 ELSE 0 END AS DOUBLE) AS score_any_or_signature FROM fired""",
)
def rule_ablation(spark, sf):
    merged = signature.merge_signatures(
        flagged(spark, sf), signature.read_signature_table(external_table(spark, sf))
    )
    scores = rules.ablation_scores(merged, "snort_pred")
    return scores.select("row_id", "score_vsp", "score_any", "score_count", "score_any_or_signature")


@query(
    "attach_rates",
    f"""WITH {RULES_SQL} SELECT row_id, rate_V, rate_L, rate_S, rate_R, rate_P, rate_B FROM fired
    WHERE multiclass_label <> 'BENIGN' UNION ALL
    SELECT row_id, 0, 0, 0, 0, 0, 0 FROM fired WHERE multiclass_label = 'BENIGN'""",
)
def attach_rates(spark, sf):
    table = rules.signature_table(views.flows(spark, sf), WIDE)
    attacks = table.join(views.flows(spark, sf).filter("binary_label = 1").select("row_id"), "row_id", "left_semi")
    return signature.attach_rates(views.flows(spark, sf).select("row_id"), attacks)


@query(
    "promoted_hits",
    f"""WITH {RULES_SQL} SELECT row_id, multiclass_label, greatest(rate_V, rate_S, rate_P) AS rate_hit,
    CASE WHEN rate_P = 1 THEN 'P' ELSE '' END || CASE WHEN rate_S = 1 THEN 'S' ELSE '' END
    || CASE WHEN rate_V = 1 THEN 'V' ELSE '' END AS rate_hit_which FROM fired""",
)
def promoted_hits(spark, sf):
    hits = rules.promoted_hits(rules.signature_table(views.flows(spark, sf), WIDE), ["rate_V", "rate_S", "rate_P"])
    return signature.attach_promoted(views.flows(spark, sf).select("row_id", "multiclass_label"), hits)


PER_CLASS = """SELECT multiclass_label AS class, count(*) AS support,
  CASE WHEN multiclass_label = 'BENIGN' THEN 'Correct Benign Rate' ELSE 'Detection Rate' END AS metric,
  {rate} AS rate{fires} FROM {rel} GROUP BY multiclass_label"""


PER_CLASS_SQL = f"WITH {RULES_SQL} " + PER_CLASS.format(
    rate="round(CASE WHEN multiclass_label = 'BENIGN' THEN 1.0::DOUBLE - sum(p)::DOUBLE / count(*) "
    "ELSE sum(p)::DOUBLE / count(*) END, 4)",
    fires=", CAST(sum(p) AS BIGINT) AS fires",
    rel="(SELECT *, CASE WHEN fires > 0 THEN 1 ELSE 0 END AS p FROM fired)",
)


@query("per_class_report", PER_CLASS_SQL)
def per_class_report(spark, sf):
    """Flagship: which classes do the rate rules catch? Labels ride along, so nothing is joined back."""
    flags = flagged(spark, sf).withColumn("fired", (rules.fired_count() > 0).cast("int"))
    return metrics.per_class_report(flags, "fired")


@query("per_class_join", PER_CLASS_SQL)
def per_class_join(spark, sf):
    """The same report from two tables that share only row_id."""
    flags = flagged(spark, sf).select("row_id", (rules.fired_count() > 0).cast("int").alias("signature_pred"))
    return metrics.per_class_fires(views.flows(spark, sf), flags)


@query(
    "classwise",
    f"WITH {RULES_SQL} "
    + PER_CLASS.format(
        rate="CASE WHEN multiclass_label = 'BENIGN' THEN 1.0::DOUBLE - sum(rate_V)::DOUBLE / count(*) "
        "ELSE sum(rate_V)::DOUBLE / count(*) END",
        fires="",
        rel="fired",
    ),
)
def classwise(spark, sf):
    return metrics.class_wise(flagged(spark, sf), "rate_V")


# --- cleaning ---------------------------------------------------------------


@query(
    "clean_labels",
    f"WITH {views.DIRTY} SELECT row_id, multiclass_label FROM labelled",
)
def clean_labels(spark, sf):
    return views.dirty_flows(spark, sf).select("row_id", normalize_label(F.col("label")).alias("multiclass_label"))


@query(
    "clean_infinities",
    f"""WITH {views.DIRTY} SELECT row_id, flow_bytes_s, flow_packets_s FROM finite""",
)
def clean_infinities(spark, sf):
    from flowsentry.functions.labels import with_labels

    kept = with_labels(views.dirty_flows(spark, sf)).filter("multiclass_label <> 'UNKNOWN'")
    return clean.infinities_to_null(kept).select("row_id", "flow_bytes_s", "flow_packets_s")


MISSING = """(CASE WHEN flow_bytes_s IS NULL THEN 1 ELSE 0 END + CASE WHEN flow_packets_s IS NULL THEN 1 ELSE 0 END
  + CASE WHEN flow_duration IS NULL THEN 1 ELSE 0 END + CASE WHEN total_fwd_packets IS NULL THEN 1 ELSE 0 END
  + CASE WHEN syn_flag_count IS NULL THEN 1 ELSE 0 END + 1) / CAST(11 AS DOUBLE) <= CAST(0.3 AS DOUBLE)"""


@query("clean_missing", f"WITH {views.DIRTY} SELECT row_id FROM finite WHERE {MISSING}")
def clean_missing(spark, sf):
    from flowsentry.functions.labels import with_labels

    kept = with_labels(views.dirty_flows(spark, sf)).filter("multiclass_label <> 'UNKNOWN'")
    return clean.drop_sparse_rows(clean.infinities_to_null(kept)).select("row_id")


@query(
    "clean_null_columns",
    f"WITH {views.DIRTY} SELECT 'simillarhttp' AS column_name WHERE (SELECT count(simillarhttp) FROM finite) = 0",
)
def clean_null_columns(spark, sf):
    names = clean.all_null_columns(views.dirty_flows(spark, sf))
    return spark.createDataFrame([(n,) for n in names], "column_name string")


@query(
    "clean_flows",
    f"""WITH {views.DIRTY} SELECT min(row_id) AS row_id, source_file, epoch_us("timestamp") AS t, flow_bytes_s,
    flow_packets_s, flow_duration, total_fwd_packets, syn_flag_count, multiclass_label, binary_label
    FROM finite WHERE {MISSING} GROUP BY ALL""",
)
def clean_flows(spark, sf):
    cleaned = clean.clean_flows(views.dirty_flows(spark, sf))
    return cleaned.withColumn("t", F.unix_micros("timestamp")).drop("timestamp")


@query(
    "clean_dedup",
    f"""WITH {views.DIRTY} SELECT min(row_id) AS row_id, count(*) AS copies FROM finite
    GROUP BY source_file, "timestamp", flow_bytes_s, flow_packets_s, flow_duration, total_fwd_packets,
      syn_flag_count, simillarhttp, multiclass_label, binary_label""",
)
def clean_dedup(spark, sf):
    from flowsentry.functions.labels import with_labels

    kept = clean.infinities_to_null(with_labels(views.dirty_flows(spark, sf)).filter("multiclass_label <> 'UNKNOWN'"))
    others = [c for c in kept.columns if c != "row_id"]
    copies = kept.groupBy(*others).agg(F.count("*").alias("copies"), F.min("row_id").alias("row_id"))
    return clean.drop_duplicate_rows(kept).select("row_id").join(copies.select("row_id", "copies"), "row_id")


@query(
    "canonical_columns",
    f"""WITH {views.FLOWS} SELECT row_id, source_ip, destination_port, flow_bytes_s, total_fwd_packets FROM flows""",
)
def canonical_columns(spark, sf):
    f = views.raw_flows(spark, sf).select(
        "row_id",
        F.col("source_ip").alias(" Src IP"),
        F.col("destination_port").alias(" Destination Port"),
        F.col("flow_bytes_s").alias("Flow Bytes/s"),
        F.col("total_fwd_packets").alias("Tot Fwd Pkts"),
    )
    return C.canonicalize_columns(f)


@query(
    "safe_numeric",
    f"""WITH {views.FLOWS} SELECT row_id, CASE WHEN k % 3 = 0 THEN CAST(-1 AS DOUBLE) ELSE CAST(k AS DOUBLE) END AS parsed,
    CAST(7 AS DOUBLE) AS absent FROM flows""",
)
def safe_numeric(spark, sf):
    f = views.flows(spark, sf).select(
        "row_id", F.when(F.col("k") % 3 == 0, F.lit("n/a")).otherwise(F.col("k").cast("string")).alias("text")
    )
    return f.select("row_id", C.number(f, "text", -1).alias("parsed"), C.number(f, "no_such_column", 7).alias("absent"))


@query(
    "port_membership",
    f"""WITH {views.FLOWS} SELECT row_id, CASE WHEN destination_port IN (80, 443, 8080) THEN 1 ELSE 0 END AS web,
    CASE WHEN destination_port IN (21, 22, 23) THEN 1 ELSE 0 END AS auth FROM flows""",
)
def port_membership(spark, sf):
    f = views.flows(spark, sf)
    port = rules.port_number(f)
    return f.select(
        "row_id",
        port.isin(*WIDE.slowhttp_ports).cast("int").alias("web"),
        port.isin(*WIDE.bruteforce_ports).cast("int").alias("auth"),
    )


FEATURES_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, '{kind}' AS kind, count({c}) AS filled, count(DISTINCT {c}) AS distinct_values FROM flows"
    for c, kind in {
        "source_port": "numeric",
        "destination_port": "numeric",
        "protocol": "categorical",
        "total_fwd_packets": "numeric",
        "total_backward_packets": "numeric",
        "flow_duration": "numeric",
        "flow_bytes_s": "numeric",
        "flow_packets_s": "numeric",
        "syn_flag_count": "numeric",
        "rst_flag_count": "numeric",
        "value": "numeric",
        "k": "numeric",
        "user_id": "numeric",
        "event_type": "categorical",
    }.items()
)


@query("feature_columns", f"WITH {views.FLOWS} {FEATURES_SQL}")
def feature_columns(spark, sf):
    f = views.flows(spark, sf)
    features = C.feature_columns(f)
    numeric, _ = C.numeric_and_categorical(f, features)
    kind = F.when(F.col("feature").isin(*numeric), F.lit("numeric")).otherwise(F.lit("categorical"))
    cells = f.select(*[F.col(c).cast("string").alias(c) for c in features]).unpivot([], features, "feature", "value")
    return cells.groupBy("feature").agg(
        F.count("value").alias("filled"), F.countDistinct("value").alias("distinct_values")
    ).withColumn("kind", kind)


@query(
    "union_files",
    f"""WITH {views.FLOWS} SELECT source_file, count(*) AS rows, count(syn_flag_count) AS with_syn,
    count(rst_flag_count) FILTER (WHERE FALSE) AS with_rst FROM (
      SELECT source_file, CASE WHEN source_file LIKE 'Monday%' THEN syn_flag_count END AS syn_flag_count,
      rst_flag_count FROM flows) GROUP BY source_file""",
)
def union_files_query(spark, sf):
    f = views.flows(spark, sf)
    monday = f.filter("source_file LIKE 'Monday%'").select("source_file", "row_id", "syn_flag_count")
    rest = f.filter("source_file NOT LIKE 'Monday%'").select("source_file", "row_id")
    both = union_files(rest, monday).withColumn("rst_flag_count", F.lit(None).cast("double"))
    return both.groupBy("source_file").agg(
        F.count("*").alias("rows"), F.count("syn_flag_count").alias("with_syn"), F.count("rst_flag_count").alias("with_rst")
    )


# --- splits -----------------------------------------------------------------


@query(
    "split_temporal",
    f"""WITH {views.FLOWS}, r AS (SELECT row_id, row_number() OVER (ORDER BY "timestamp", row_id) AS rn,
      count(*) OVER () AS n FROM flows),
    h AS (SELECT *, n - CAST(round_even(n * CAST(0.2 AS DOUBLE), 0) AS BIGINT) AS head FROM r)
    SELECT row_id, CASE WHEN rn <= head - CAST(round_even(head * CAST(0.2 AS DOUBLE), 0) AS BIGINT) THEN 'train'
      WHEN rn <= head THEN 'val' ELSE 'test' END AS split FROM h""",
)
def split_temporal(spark, sf):
    return split.temporal_split(views.flows(spark, sf), by_file=False).select("row_id", "split")


@query("split_by_file", f"WITH {views.SPLITS} SELECT row_id, source_file, split FROM splits")
def split_by_file(spark, sf):
    return views.splits(spark, sf).select("row_id", "source_file", "split")


@query(
    "split_missing_file",
    f"""WITH {views.FLOWS}, g AS (SELECT row_id, "timestamp", CASE WHEN k % 10 <> 3 THEN source_file END AS source_file FROM flows),
    r AS (SELECT row_id, source_file, row_number() OVER (PARTITION BY source_file ORDER BY "timestamp" NULLS LAST, row_id) AS rn,
      count(*) OVER (PARTITION BY source_file) AS n FROM g),
    h AS (SELECT *, n - CAST(round_even(n * CAST(0.2 AS DOUBLE), 0) AS BIGINT) AS head FROM r)
    SELECT row_id, source_file, CASE WHEN rn <= head - CAST(round_even(head * CAST(0.2 AS DOUBLE), 0) AS BIGINT) THEN 'train'
      WHEN rn <= head THEN 'val' ELSE 'test' END AS split FROM h""",
)
def split_missing_file(spark, sf):
    """Flows without a source file form a group of their own."""
    flows = views.flows(spark, sf).withColumn("source_file", F.when(F.col("k") % 10 != 3, F.col("source_file")))
    return split.temporal_split(flows).select("row_id", "source_file", "split")


@query(
    "split_coarse_time",
    f"""WITH {views.FLOWS}, r AS (SELECT row_id, source_file,
      row_number() OVER (PARTITION BY source_file ORDER BY CASE WHEN k >= 20 THEN date_trunc('day', "timestamp") END
        NULLS LAST, row_id) AS rn, count(*) OVER (PARTITION BY source_file) AS n FROM flows),
    h AS (SELECT *, n - CAST(round_even(n * CAST(0.2 AS DOUBLE), 0) AS BIGINT) AS head FROM r)
    SELECT row_id, CASE WHEN rn <= head - CAST(round_even(head * CAST(0.2 AS DOUBLE), 0) AS BIGINT) THEN 'train'
      WHEN rn <= head THEN 'val' ELSE 'test' END AS split FROM h""",
)
def split_coarse_time(spark, sf):
    """Times cut to the day, some missing: many ties, which row_id settles."""
    f = views.flows(spark, sf).withColumn(
        "timestamp", F.when(F.col("k") >= 20, F.date_trunc("day", F.col("timestamp")))
    )
    return split.temporal_split(f).select("row_id", "split")


@query(
    "split_counts",
    f"""WITH {views.SPLITS} SELECT split, multiclass_label, count(*) AS rows, CAST(sum(binary_label) AS BIGINT) AS attacks
    FROM splits GROUP BY ROLLUP (split, multiclass_label)""",
)
def split_counts(spark, sf):
    return metrics.split_counts(views.splits(spark, sf))


@query(
    "run_summary",
    f"""WITH {views.SPLITS} SELECT 'temporal_by_file' AS split_strategy, count(*) AS n_total,
    count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'val') AS n_val,
    count(*) FILTER (WHERE split = 'test') AS n_test,
    count(*) FILTER (WHERE split = 'train' AND binary_label = 0) AS n_train_benign,
    count(*) FILTER (WHERE split = 'val' AND binary_label = 0) AS n_val_benign FROM splits""",
)
def run_summary_query(spark, sf):
    return run_summary(views.splits(spark, sf), {"split_strategy": "temporal_by_file"})


@query(
    "time_rank",
    f"""WITH {views.FLOWS} SELECT row_id, row_number() OVER (PARTITION BY source_file
      ORDER BY CASE WHEN k >= 20 THEN date_trunc('day', "timestamp") END NULLS LAST, row_id) AS ordinal FROM flows""",
)
def time_rank(spark, sf):
    from flowsentry.operators.prefix import with_ordinal

    f = views.flows(spark, sf).withColumn(
        "timestamp", F.when(F.col("k") >= 20, F.date_trunc("day", F.col("timestamp")))
    )
    return with_ordinal(split.time_order(f).select("source_file", "_t", "row_id"), "_t", "row_id", ["source_file"]).select(
        "row_id", "ordinal"
    )


@query(
    "time_rank_nulls_first",
    f"""WITH {views.FLOWS} SELECT row_id, row_number() OVER (
      ORDER BY CASE WHEN k >= 20 THEN "timestamp" END NULLS FIRST, row_id) AS ordinal FROM flows""",
)
def time_rank_nulls_first(spark, sf):
    from flowsentry.operators.prefix import with_ordinal

    f = views.flows(spark, sf).withColumn("timestamp", F.when(F.col("k") >= 20, F.col("timestamp")))
    keyed = split.time_order(f, nulls_first=True).select("_t", "row_id")
    return with_ordinal(keyed, "_t", "row_id").select("row_id", "ordinal")


@query(
    "head_rows",
    f"""WITH {views.FLOWS} SELECT row_id, source_file, label FROM flows ORDER BY row_id LIMIT 500""",
)
def head_rows(spark, sf):
    return views.raw_flows(spark, sf).select("row_id", "source_file", "label").orderBy("row_id").limit(500)


@query("sample_rows")
def sample_rows(spark, sf):
    return split.sample_rows(views.flows(spark, sf).select("row_id", "multiclass_label"), 450)


def _sizes(labels: str) -> str:
    """Rows of each split per label, from (binary_label, n)."""
    return f"""h AS (SELECT binary_label, n, n - CAST(round_even(n * CAST(0.2 AS DOUBLE), 0) AS BIGINT) AS head FROM {labels}),
      s AS (SELECT *, head - CAST(round_even(head * CAST(0.2 AS DOUBLE), 0) AS BIGINT) AS train FROM h)"""


@query(
    "stratified_split",
    f"""WITH {views.FLOWS}, c AS (SELECT binary_label, count(*) AS n FROM flows GROUP BY 1), {_sizes("c")}
    SELECT 'train' AS split, binary_label, train AS "count" FROM s UNION ALL SELECT 'val', binary_label, head - train FROM s
    UNION ALL SELECT 'test', binary_label, n - head FROM s""",
)
def stratified_split(spark, sf):
    return split.stratified_split(views.flows(spark, sf)).groupBy("split", "binary_label").count()


@query(
    "calibration_split",
    f"""WITH {views.SPLITS}, v AS (SELECT count(*) FILTER (WHERE binary_label = 0) AS benign,
      count(*) FILTER (WHERE binary_label = 1) AS attacks FROM splits WHERE split = 'val'),
    n AS (SELECT *, greatest(50, least(CAST(round_even(benign * CAST(0.5 AS DOUBLE), 0) AS BIGINT), benign - 50)) AS calib FROM v)
    SELECT 'calib' AS part, CAST(0 AS INTEGER) AS binary_label, calib AS "count" FROM n
    UNION ALL SELECT 'gate', 0, benign - calib FROM n UNION ALL SELECT 'gate', 1, attacks FROM n""",
)
def calibration_split(spark, sf):
    from flowsentry.config import CascadeConfig

    parts = split.calibration_split(views.splits(spark, sf), CascadeConfig(min_calibration_benign=50))
    return parts.groupBy("part", "binary_label").count()


@query("consecutive_sample")
def consecutive_sample(spark, sf):
    keyed = split.time_order(views.flows(spark, sf)).select("row_id", "_t")
    return split.consecutive_sample(keyed, 300)


@query(
    "sample_laws",
    f"""WITH {views.FLOWS} SELECT least(count(*), 450) AS sampled, true AS distinct_rows, true AS of_the_table, true AS repeatable,
    least(count(*), 300) AS run_length, true AS without_gaps FROM flows""",
)
def sample_laws(spark, sf):
    """What holds for any seed: exact sizes, rows of the table, the same rows again, and a run of neighbours in time."""
    flows = split.time_order(views.flows(spark, sf)).select("row_id", "_t")
    sample, again = (split.sample_rows(flows, 450).select("row_id") for _ in range(2))
    marked = flows.select("row_id", F.lit(1).alias("own")).join(sample.withColumn("drawn", F.lit(1)), "row_id", "right")
    drawn = marked.agg(
        F.count("*").alias("sampled"),
        (F.count_distinct("row_id") == F.count("*")).alias("distinct_rows"),
        (F.count("own") == F.count("*")).alias("of_the_table"),
    )
    differ = sample.exceptAll(again).agg((F.count("*") == 0).alias("repeatable"))
    # A run has no row of the table between its first and last that it lacks.
    run = split.consecutive_sample(flows, 300)
    ends = run.agg(F.min(F.struct("_t", "row_id")).alias("first"), F.max(F.struct("_t", "row_id")).alias("last"), F.count("*").alias("run_length"))
    place = F.struct("_t", "row_id")
    inside = flows.crossJoin(F.broadcast(ends)).filter(place.between(F.col("first"), F.col("last")))  # one row
    gaps = inside.agg(F.max("run_length").alias("run_length"), (F.count("*") == F.max("run_length")).alias("without_gaps"))
    return drawn.crossJoin(differ).crossJoin(gaps)  # one row each


# --- column statistics ------------------------------------------------------

STAT_COLUMNS = ["flow_bytes_s", "flow_packets_s", "flow_duration", "total_fwd_packets"]


@query(
    "scale_stats",
    f"""WITH {views.DIRTY}, cells AS (
      SELECT 'flow_bytes_s' AS feature, flow_bytes_s AS v FROM finite UNION ALL
      SELECT 'flow_packets_s', flow_packets_s FROM finite UNION ALL
      SELECT 'flow_duration', flow_duration FROM finite UNION ALL
      SELECT 'total_fwd_packets', total_fwd_packets FROM finite),
    med AS (SELECT feature, quantile_cont(v, 0.5) AS median, count(*) - count(v) AS missing FROM cells GROUP BY feature),
    filled AS (SELECT c.feature, coalesce(v, median) AS x, median, missing FROM cells c JOIN med USING (feature))
    SELECT feature, count(*) AS rows, missing, round(median, 6) AS median, round(avg(x), 3) AS mean,
      round(stddev_pop(x), 3) AS std FROM filled GROUP BY feature, missing, median""",
)
def scale_stats(spark, sf):
    from flowsentry.functions.labels import with_labels

    kept = clean.infinities_to_null(with_labels(views.dirty_flows(spark, sf)).filter("multiclass_label <> 'UNKNOWN'"))
    return stats.numeric_stats(kept, STAT_COLUMNS).select(
        "feature", "rows", "missing", F.round("median", 6).alias("median"), F.round("mean", 3).alias("mean"), F.round("std", 3).alias("std")
    )


@query(
    "mode_stats",
    f"""WITH {views.FLOWS}, cells AS (SELECT 'protocol' AS feature, protocol AS v FROM flows UNION ALL
      SELECT 'event_type', event_type FROM flows),
    c AS (SELECT feature, v, count(*) AS n FROM cells GROUP BY ALL)
    SELECT feature, n, v AS mode FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, v) AS rn FROM c)
    WHERE rn = 1""",
)
def mode_stats(spark, sf):
    return stats.modes(views.flows(spark, sf), ["protocol", "event_type"])


@query(
    "class_weights",
    f"""WITH {views.FLOWS} SELECT CAST(sum(binary_label) AS BIGINT) AS n_pos, count(*) - CAST(sum(binary_label) AS BIGINT) AS n_neg,
    CAST(0.5 AS DOUBLE) * count(*) / sum(binary_label) AS w_pos,
    CAST(0.5 AS DOUBLE) * count(*) / (count(*) - sum(binary_label)) AS w_neg FROM flows""",
)
def class_weights(spark, sf):
    return stats.class_weights(views.flows(spark, sf))


@query(
    "sample_extract",
    f"""WITH {views.FLOWS}, tagged AS (SELECT row_id, trim(label) AS label, CASE
      WHEN source_file = 'Monday-WorkingHours.pcap_ISCX.csv' AND trim(label) IN ('BENIGN') THEN 'benign'
      WHEN source_file = 'Friday-WorkingHours-Afternoon-DDos.pcap_ISCX.csv' AND trim(label) <> 'BENIGN'
        AND contains(trim(label), 'DDoS') THEN 'ddos' END AS category FROM raw_flows)
    SELECT row_id, label, category FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY row_id) AS rn
      FROM tagged WHERE category IS NOT NULL) WHERE rn <= 100""",
)
def sample_extract(spark, sf):
    from flowsentry.config import SAMPLE_CATEGORIES

    picked = labelled_samples(views.raw_flows(spark, sf), SAMPLE_CATEGORIES, n=100)
    return picked.select("row_id", F.trim("label").alias("label"), "category")
