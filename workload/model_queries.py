"""Models fitted on the flow features of whole tables.

All models run with their default settings, and so does the cascade but for one: it escalates at p <= 0.3 instead of
0.2. At scale 0.01 the default leaves 192 escalated rows for the gate, eight fewer than the guard of the pool (200)
wants; much smaller tables are refused by that guard, as they should be.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsentry.config import CascadeConfig, ScorerConfig
from flowsentry.functions.labels import with_labels
from flowsentry.functions.uploads import capture_name
from flowsentry.models import baselines
from flowsentry.models.gate import GateConfig
from flowsentry.models.preprocess import fit_preprocessor
from flowsentry.models.projection import FourierFeatures, projected, svd_components
from flowsentry.models.scorer import RotationScorer
from flowsentry.models.versions import ModelVersions
from flowsentry.operators import evidence, metrics
from flowsentry.operators.split import time_order
from flowsentry.operators.signature import read_signature_table
from flowsentry.plans.ablation import cascade_report, rule_report
from flowsentry.plans.cascade import batch_status, comparison, run_cascade
from flowsentry.plans.file_inference import infer_files
from flowsentry.session import materialize, scratch_path
from flowsentry.streaming.pipeline import fresh_checkpoint, upload_stream
from flowsentry.streaming.scoring import FileVerdicts, scored_stream, upload_judge
from workload import views
from workload.flow_queries import WIDE, external_table
from workload.metric_queries import CASCADE, RATES_SQL, with_pvalues
from workload.packet_queries import capture_verdicts, live_by_capture
from workload.stream_queries import RESOLVED_CTE, upload_events
from workload.registry import query

NOT_FEATURES = ["value", "k", "user_id", "event_type"]
SCORER, GATE, CASCADE_CONFIG = ScorerConfig(), GateConfig(), CascadeConfig(alpha_escalate=0.30)


def flow_features(spark, sf):
    return views.flows(spark, sf).drop(*NOT_FEATURES)


def split_features(spark, sf):
    return views.splits(spark, sf).drop(*NOT_FEATURES)


def features(spark, sf):
    f = flow_features(spark, sf)
    numeric = [c for c, t in f.dtypes if t in ("int", "double") and c != "binary_label"]
    prep = fit_preprocessor(f, numeric)
    return materialize(
        prep.transform(time_order(f)).select("row_id", "binary_label", "_t", "features"), "features"
    ), prep.dims


@query(
    "preprocess",
    f"""WITH {views.FLOWS}, s AS (SELECT avg(flow_packets_s) AS m, stddev_pop(flow_packets_s) AS d FROM flows)
    SELECT row_id, round((flow_packets_s - m) / d, 6) AS scaled, CASE WHEN protocol = 'TCP' THEN 1 ELSE 0 END AS tcp,
    CASE WHEN protocol = 'UDP' THEN 1 ELSE 0 END AS udp FROM flows, s""",
)
def preprocess(spark, sf):
    f = views.flows(spark, sf).select("row_id", "flow_packets_s", "protocol")
    prep = fit_preprocessor(f, ["flow_packets_s", "protocol"])
    x = F.col("features")
    return prep.transform(f).select(
        "row_id", F.round(x[0], 6).alias("scaled"), x[1].cast("int").alias("tcp"), x[2].cast("int").alias("udp")
    )


@query("svd_rff")
def svd_rff(spark, sf):
    rows, dims = features(spark, sf)
    components = svd_components(rows, "features", dims, 8)
    fourier = FourierFeatures.draw(components.shape[1], 192, 0.10, 42)
    z = rows.select("row_id", projected(F.col("features"), components, fourier).alias("z"))
    norm = F.aggregate("z", F.lit(0.0), lambda a, v: a + v * v)
    return z.select("row_id", norm.alias("squared_norm"))


_scorers: dict = {}


def published_scorer(spark, sf):
    """One fit per application and folder, saved as a version that the queries load; with the split features."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _scorers:
        s = materialize(split_features(spark, sf), "split-features")
        benign = s.filter("binary_label = 0")
        scorer = RotationScorer.fit(
            benign.filter("split = 'train'").drop("split"), benign.filter("split = 'val'").drop("split"), SCORER
        )
        models = ModelVersions(spark, scratch_path(spark, "models"), RotationScorer.load)
        models.publish(scorer)
        _scorers[key] = models, s
    return _scorers[key]


@query("selfsup_score")
def selfsup_score(spark, sf):
    models, s = published_scorer(spark, sf)
    return models.current()[1].predict(s.filter("split = 'test'")).select("row_id", "rf_score", "rf_pred")


@query(
    "selfsup_laws",
    f"""WITH {views.SPLITS} SELECT count(*) AS scored, count(*) FILTER (WHERE split = 'val') AS validation, true AS in_range,
    true AS share_above_threshold, CAST(200 AS BIGINT) AS trees, true AS within_depth, true AS shares_sum_to_one
    FROM splits WHERE split = 'test' OR (split = 'val' AND binary_label = 0)""",
)
def selfsup_laws(spark, sf):
    """What holds for any fit: scores in [0, 1], the 0.97 share of benign validation rows at or below the threshold,
    200 trees, each with shares that sum to one at its leaves."""
    models, s = published_scorer(spark, sf)
    scorer = models.current()[1]
    rows = scorer.predict(s.filter("split = 'test' OR (split = 'val' AND binary_label = 0)"))
    val = F.col("split") == "val"
    laws = rows.agg(
        F.count("*").alias("scored"),
        F.count_if(val).alias("validation"),
        F.bool_and(F.col("rf_score").between(0.0, 1.0)).alias("in_range"),
        # At most 3 % lie above; at least 97 % do not, but for the row the quantile is interpolated at.
        (F.abs(F.count_if(val & (F.col("rf_pred") == 0)) - SCORER.threshold_quantile * F.count_if(val)) <= 1).alias("share_above_threshold"),
    )
    leaf = F.col("feature") < 0
    total = F.aggregate("shares", F.lit(0.0), lambda a, v: a + v)
    trees = scorer.forest.nodes.agg(
        F.count_distinct("tree").alias("trees"),
        (F.max("node") < 2 ** (SCORER.max_depth + 1)).alias("within_depth"),
        F.bool_and(~leaf | (F.abs(total - 1) < 1e-5)).alias("shares_sum_to_one"),
    )
    return laws.crossJoin(trees)  # one row each


@query(
    "stream_scored",
    f"""WITH {views.SPLITS} SELECT row_id, CAST(1 AS INTEGER) AS model_version, true AS in_range, true AS as_in_batch FROM splits""",
)
def stream_scored(spark, sf):
    """All flows scored by the published model as they arrive, beside the scores of one batch."""
    models, s = published_scorer(spark, sf)
    flows = with_labels(views.raw_flows(spark, sf, stream=True)).drop(*NOT_FEATURES)
    results = scratch_path(spark, "stream-scored")
    scored_stream(flows, models, results, fresh_checkpoint(flows, "stream-scored"), ["row_id"]).awaitTermination()
    streamed = spark.read.parquet(results).drop("batch")
    batch = models.current()[1].predict(s).select("row_id", F.col("rf_score").alias("want"), F.col("rf_pred").alias("want_pred"))
    same = (F.abs(F.col("rf_score") - F.col("want")) < 1e-6) & (F.col("rf_pred") == F.col("want_pred"))
    return streamed.join(batch, "row_id").select(
        "row_id", "model_version", F.col("rf_score").between(0.0, 1.0).alias("in_range"), same.alias("as_in_batch")
    )


STREAM_ROUTES = f"""WITH {views.FLOWS}, {views.UPLOADS.removeprefix(views.EVENTS + ',')}, {views.CAPTURE_VERDICTS},
live AS (SELECT capture, CASE WHEN bool_or(prediction = 'attack') THEN 'attack' ELSE 'benign' END AS prediction FROM cap_verdicts GROUP BY capture),
{RESOLVED_CTE.split("judged AS")[0].strip().rstrip(",")},
files AS (SELECT DISTINCT source_file FROM flows)
SELECT arrival AS offset, CASE WHEN file_type = 'flow_csv' THEN 'model' WHEN s.source_file IS NOT NULL THEN 'resolved_model' ELSE 'live_rules' END AS route,
  CASE WHEN file_type = 'flow_csv' THEN 'error' WHEN s.source_file IS NOT NULL THEN 'by_model' ELSE coalesce(l.prediction, 'benign') END AS prediction,
  true AS by_newest_verdict
FROM routed r LEFT JOIN files s ON s.source_file = r.flow_file AND r.file_type <> 'flow_csv' LEFT JOIN live l ON l.capture = r.name"""


@query("stream_routed", STREAM_ROUTES)
def stream_routed(spark, sf):
    """Uploads judged as they arrive: files by the published model, once each, other captures by their live verdicts.

    The twin names no verdict of a model; that it is the one of file inference is compared here.
    """
    models, s = published_scorer(spark, sf)
    uploads = upload_events(spark, sf, stream=True)
    live = live_by_capture(capture_verdicts(spark, sf))
    named = views.uploads(spark, sf).select("file_path", capture_name(F.col("file_path")).alias("capture_name")).distinct()
    live = named.join(live, "capture_name").select(
        "file_path",
        F.col("live_prediction").alias("prediction"),
        F.col("live_attack_type").alias("attack_type"),
        F.lit("live verdict of a window").alias("detection_reason"),
    )
    files, mapping = s.select(F.col("source_file").alias("flow_file")).distinct(), evidence.capture_file_map(spark)
    verdicts = FileVerdicts(models, lambda: s.drop("split"), scratch_path(spark, "file-verdicts"))
    judge = upload_judge(verdicts, lambda batch: evidence.resolve_captures(batch, mapping, files).drop("status", "reason"), materialize(live, "live"))
    kept = scratch_path(spark, "routed")

    def keep(batch):
        judged = judge(batch)
        judged.select("offset", "route", "prediction", "flow_csv_path").write.mode("append").parquet(kept)
        return judged

    results, alerts = scratch_path(spark, "results"), scratch_path(spark, "alerts")
    upload_stream(uploads, keep, results, alerts, fresh_checkpoint(uploads, "uploads")).awaitTermination()
    want = infer_files(s.select("source_file").distinct(), s.drop("split"), models.current()[1]).select(
        F.col("source_file").alias("flow_csv_path"), F.col("prediction").alias("want")
    )
    by_model = F.col("route") == "resolved_model"
    routed = spark.read.parquet(kept).join(want, "flow_csv_path", "left")
    return routed.select(
        "offset",
        "route",
        F.when(by_model, F.lit("by_model")).otherwise(F.col("prediction")).alias("prediction"),
        (~by_model | (F.col("prediction") == F.col("want"))).alias("by_newest_verdict"),
    )


@query(
    "rotation_set",
    f"""WITH {views.FLOWS} SELECT r AS rotation, count(*) AS rows FROM flows, range(4) AS t(r) GROUP BY r""",
)
def rotation_set_query(spark, sf):
    from flowsentry.models.projection import draw_rotations
    from flowsentry.models.scorer import rotation_set

    rows, dims = features(spark, sf)
    spread = rotation_set(rows.select("row_id", F.col("features").cast("array<float>").alias("z")), "z", draw_rotations(dims, 4, 42))
    return spread.filter(F.size("rotated") == dims).groupBy(F.col("rotation").cast("bigint").alias("rotation")).agg(
        F.count("*").alias("rows")
    )


_results: dict = {}


def cascade_result(spark, sf):
    """One run of the cascade per application and folder: three queries report on it."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _results:
        signatures = read_signature_table(external_table(spark, sf))
        scorer = published_scorer(spark, sf)[0].current()[1]
        _results[key] = run_cascade(flow_features(spark, sf), signatures, CASCADE_CONFIG, SCORER, GATE, scorer=scorer)
    return _results[key]


@query("cascade_run")
def cascade_run(spark, sf):
    return cascade_result(spark, sf).metrics


@query("cascade_status")
def cascade_status(spark, sf):
    result = cascade_result(spark, sf)
    return batch_status(result, CASCADE_CONFIG)


@query("cascade_report")
def cascade_report_query(spark, sf):
    return metrics.headline_table(cascade_report(cascade_result(spark, sf).predictions, test_optimistic=True))


@query("file_inference")
def file_inference(spark, sf):
    models, s = published_scorer(spark, sf)
    known = s.select("source_file").distinct()
    wanted = known.unionByName(known.select(F.concat(F.lit("absent-"), F.col("source_file")).alias("source_file")))
    return infer_files(wanted, s, models.current()[1])


@query("iforest")
def iforest(spark, sf):
    rows, _ = features(spark, sf)
    forest = baselines.IsolationForest.fit(rows.filter("binary_label = 0"))
    return forest.score(rows).select("row_id", "score")


@query("ocsvm")
def ocsvm(spark, sf):
    rows, dims = features(spark, sf)
    model = baselines.OneClassSvm.fit(rows.filter("binary_label = 0"), dims)
    return model.score(rows).select("row_id", "score")


@query("seq_recon")
def seq_recon(spark, sf):
    rows, dims = features(spark, sf)
    model = baselines.SequenceReconstruction.fit(rows.filter("binary_label = 0"), dims)
    return model.score(rows)


# The isotonic fit at a point is the largest, over all beginnings up to it, of the smallest mean of a
# stretch that ends at it or later. Between points it is linear, beyond the ends constant.
ISOTONIC_SQL = f"""WITH {views.SCORED},
pts AS (SELECT score AS x, CAST(count(*) AS DOUBLE) AS w, CAST(sum(binary_label) AS DOUBLE) AS s FROM scored WHERE split = 'val' GROUP BY score),
cum AS (SELECT x, row_number() OVER (ORDER BY x) AS i, sum(w) OVER (ORDER BY x) AS cw, sum(s) OVER (ORDER BY x) AS cs, w, s FROM pts),
means AS (SELECT a.i AS a, b.i AS b, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.w) AS m FROM cum a JOIN cum b ON b.i >= a.i),
ends AS (SELECT a, b AS i, min(m) OVER (PARTITION BY a ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m FROM means),
fit AS (SELECT x, iso, lead(x) OVER (ORDER BY x) AS next_x, lead(iso) OVER (ORDER BY x) AS next_iso
  FROM (SELECT i, max(m) AS iso FROM ends GROUP BY i) JOIN cum USING (i)),
found AS (SELECT t.row_id, t.score, f.* FROM (SELECT * FROM scored WHERE split = 'test') t ASOF LEFT JOIN fit f ON t.score >= f.x)
SELECT row_id, score, round(CASE WHEN x IS NULL THEN (SELECT iso FROM fit ORDER BY x LIMIT 1) WHEN next_x IS NULL THEN iso
  ELSE iso + (next_iso - iso) * (score - x) / (next_x - x) END, 9) AS score_isotonic FROM found"""


@query("isotonic", ISOTONIC_SQL)
def isotonic(spark, sf):
    s = views.scored(spark, sf)
    model = baselines.fit_isotonic(s.filter("split = 'val'"), "score")
    fitted = baselines.apply_isotonic(model, s.filter("split = 'test'"), "score")
    return fitted.select("row_id", "score", F.round("score_isotonic", 9).alias("score_isotonic"))


# --- comparisons that SQL can express ---------------------------------------

DETECTORS_SQL = f"""
long AS (SELECT 0 AS position, 'rf' AS model, binary_label, CASE WHEN rf_score > CAST(0.2 AS DOUBLE) THEN 1 ELSE 0 END AS pred,
    rf_score AS score FROM pv WHERE split = 'test'
  UNION ALL SELECT 1, 'signature', binary_label, snort_pred, CAST(snort_pred AS DOUBLE) FROM pv WHERE split = 'test'
  UNION ALL SELECT 2, 'rf_conformal', binary_label, CASE WHEN rf_pvalue <= CAST(0.05 AS DOUBLE) THEN 1 ELSE 0 END,
    CAST(1 AS DOUBLE) - rf_pvalue FROM pv WHERE split = 'test'
  UNION ALL SELECT 3, 'hybrid_cascade', binary_label, cascade_pred, cascade_score FROM cascaded WHERE split = 'test'),
km AS (SELECT position, model, count(*) FILTER (WHERE binary_label = 1 AND pred = 1) AS tp,
  count(*) FILTER (WHERE binary_label = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE binary_label = 0 AND pred = 1) AS fp,
  count(*) FILTER (WHERE binary_label = 1 AND pred = 0) AS fn FROM long GROUP BY ALL),
lg AS (SELECT model, score, sum(binary_label) AS pos, count(*) AS n FROM long GROUP BY ALL),
lc AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS k FROM lg
  WINDOW w AS (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
la AS (SELECT model, CAST(sum((2 * tp - pos) * (n - pos)) AS DOUBLE) / (CAST(2 AS DOUBLE) * sum(pos) * (sum(n) - sum(pos))) AS roc_auc,
  round(sum(CAST(pos * tp AS DOUBLE) / k) / sum(pos), 9) AS pr_auc FROM lc GROUP BY model)"""


@query(
    "detector_comparison",
    f"WITH {CASCADE}, {DETECTORS_SQL} SELECT position, model, {RATES_SQL}, roc_auc, pr_auc FROM km JOIN la USING (model)",
)
def detector_comparison(spark, sf):
    from flowsentry.operators.cascade import cascade_decision

    decided = cascade_decision(with_pvalues(spark, sf).filter("split = 'test'")).select(
        "*",
        (F.col("rf_score") > 0.2).cast("int").alias("rf_pred"),
        (F.col("rf_pvalue") <= 0.05).cast("int").alias("conformal_pred"),
        F.col("snort_pred").cast("double").alias("snort_score"),
    )
    return comparison(materialize(decided, "decided")).withColumn("pr_auc", F.round("pr_auc", 9))


@query("rule_report")
def rule_report_query(spark, sf):
    from flowsentry.operators.rules import rule_flags
    from flowsentry.operators.signature import merge_signatures

    flags = rule_flags(views.splits(spark, sf), WIDE)
    merged = materialize(merge_signatures(flags, read_signature_table(external_table(spark, sf))), "rule-flags")
    return rule_report(merged)
