"""Metrics, operating points, conformal p-values, cascade, sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsentry.operators import cascade, conformal, curves, metrics, prefix, sequences, split
from workload import views
from workload.registry import query
from workload.signature_queries import RATES_SQL

D = "CAST({} AS DOUBLE)"


def _curve(name: str, rel: str, score: str, where: str = "TRUE") -> str:
    """CTEs of the score curve: distinct scores from the top with running counts."""
    return f"""
{name}_g AS (SELECT {score} AS score, CAST(sum(binary_label) AS BIGINT) AS pos, count(*) AS n
  FROM {rel} WHERE {where} GROUP BY 1),
{name} AS (SELECT *, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS k,
  CAST(sum(pos) OVER () AS BIGINT) AS p, CAST(sum(n) OVER () AS BIGINT) AS total,
  lead(score) OVER (ORDER BY score DESC) AS next
  FROM {name}_g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""




def _step(x: str) -> str:
    """What leads from a threshold to the one just above or below it."""
    return f"greatest(abs({x}) * {2.0**-53 * (1 + 2.0**-52)!r}::DOUBLE, 1e-12::DOUBLE)"


def _cut(curve: str, gain: str) -> str:
    """Threshold of the best cut, including the cut that flags nothing."""
    return f"""(SELECT CASE WHEN score IS NULL THEN next + {_step("next")} WHEN next IS NULL THEN score - {_step("score")}
      WHEN (score + next) / 2 > next THEN (score + next) / 2 ELSE score END FROM (
      SELECT score, next, {gain} AS gain, k FROM {curve}
      UNION ALL SELECT NULL, max(score), 0, 0 FROM {curve}) ORDER BY gain DESC, k LIMIT 1)"""


def acc_cut(curve):
    return _cut(curve, "2 * tp - k")


def bal_cut(curve):
    return _cut(curve, "CAST(tp AS HUGEINT) * (total - p) - CAST(k - tp AS HUGEINT) * p")


def f1_cut(curve):
    return f"(SELECT score FROM {curve} ORDER BY CAST(2 * tp AS DOUBLE) / (k + p) DESC, score LIMIT 1)"


def far_cut(curve, far):
    above = f"max(score) FILTER (WHERE k - tp > floor((total - p) * CAST({far} AS DOUBLE)))"
    return f"(SELECT {above} + {_step(above)} FROM {curve})"


CURVES = views.SCORED + "," + _curve("c", "scored", "score") + "," + _curve("t", "scored", "tied")
VAL_CURVES = (
    views.SCORED
    + ","
    + _curve("c", "scored", "score", "split = 'val'")
    + ","
    + _curve("t", "scored", "tied", "split = 'val'")
    + ","
    + _curve("tc", "scored", "score", "split = 'test'")
)

ROC = """(SELECT CAST(sum((2 * tp - pos) * (n - pos)) AS DOUBLE) / (CAST(2 AS DOUBLE) * max(p) * (max(total) - max(p))) FROM {c})"""
PR = """(SELECT round(sum(CAST(pos * tp AS DOUBLE) / k) / max(p), 9) FROM {c})"""


def _tables(spark, sf):
    s = views.scored(spark, sf)
    return curves.score_table(s, "score", "binary_label"), curves.score_table(s, "tied", "binary_label")


def _pair(real, tied, column):
    """One row per score column."""
    return real.select(F.lit("real").alias("scores"), column).unionByName(tied.select(F.lit("tied").alias("scores"), column))


def _both(expr_c: str, expr_t: str, out: str, cte: str = CURVES) -> str:
    return f"WITH {cte} SELECT 'real' AS scores, {expr_c} AS {out} UNION ALL SELECT 'tied', {expr_t}"


@query("roc_auc", _both(ROC.format(c="c"), ROC.format(c="t"), "roc_auc"))
def roc_auc(spark, sf):
    real, tied = _tables(spark, sf)
    return _pair(curves.roc_auc(real), curves.roc_auc(tied), "roc_auc")


@query("pr_auc", _both(PR.format(c="c"), PR.format(c="t"), "pr_auc"))
def pr_auc(spark, sf):
    real, tied = _tables(spark, sf)
    r = F.round("pr_auc", 9).alias("pr_auc")
    return _pair(curves.average_precision(real), curves.average_precision(tied), r)


@query("thr_accuracy", _both(acc_cut("c"), acc_cut("t"), "threshold"))
def thr_accuracy(spark, sf):
    real, tied = _tables(spark, sf)
    return _pair(curves.accuracy_cut(real), curves.accuracy_cut(tied), "threshold")


@query("thr_balanced", _both(bal_cut("c"), bal_cut("t"), "threshold"))
def thr_balanced(spark, sf):
    real, tied = _tables(spark, sf)
    return _pair(curves.balanced_cut(real), curves.balanced_cut(tied), "threshold")


@query("thr_far", _both(far_cut("c", 8.1e-4), far_cut("t", 0.05), "threshold"))
def thr_far(spark, sf):
    real, tied = _tables(spark, sf)
    return _pair(curves.far_cut(real), curves.far_cut(tied, 0.05), "threshold")


@query("thr_f1", _both(f1_cut("c"), f1_cut("t"), "threshold"))
def thr_f1(spark, sf):
    real, tied = _tables(spark, sf)
    return _pair(curves.f1_cut(real), curves.f1_cut(tied), "threshold")


@query(
    "thr_by_file",
    f"""WITH {views.SCORED}, g AS (SELECT source_file, tied AS score, CAST(sum(binary_label) AS BIGINT) AS pos, count(*) AS n
      FROM scored GROUP BY ALL),
    c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS k, sum(pos) OVER (PARTITION BY source_file) AS p,
      lead(score) OVER (PARTITION BY source_file ORDER BY score DESC) AS next FROM g
      WINDOW w AS (PARTITION BY source_file ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
    f AS (SELECT source_file, score, row_number() OVER (PARTITION BY source_file
      ORDER BY CAST(2 * tp AS DOUBLE) / (k + p) DESC, score) AS rn FROM c)
    SELECT source_file, score AS threshold FROM f WHERE rn = 1""",
)
def thr_by_file(spark, sf):
    table = curves.score_table(views.scored(spark, sf), "tied", "binary_label", by=["source_file"])
    return curves.f1_cut(table, by=["source_file"])


@query(
    "score_curve",
    f"WITH {CURVES} SELECT score, pos, n, tp AS cum_pos, k AS cum_n, p AS total_pos, total AS total_n, next AS next_key FROM c",
)
def score_curve(spark, sf):
    return curves.score_table(views.scored(spark, sf), "score", "binary_label")


@query(
    "quantiles",
    f"""WITH {views.SCORED} SELECT CAST(q AS DOUBLE) AS q, round(quantile, 9) AS quantile FROM (
      SELECT 0.0 AS q, quantile_cont(score, 0.0) AS quantile FROM scored UNION ALL
      SELECT 0.5, quantile_cont(score, 0.5) FROM scored UNION ALL SELECT 0.95, quantile_cont(score, 0.95) FROM scored UNION ALL
      SELECT 0.97, quantile_cont(score, 0.97) FROM scored UNION ALL SELECT 1.0, quantile_cont(score, 1.0) FROM scored)""",
)
def quantiles(spark, sf):
    q = prefix.quantiles(views.scored(spark, sf), "score", [0.0, 0.5, 0.95, 0.97, 1.0])
    return q.withColumn("quantile", F.round("quantile", 9))


@query(
    "quantiles_by_file",
    f"""WITH {views.SCORED} SELECT source_file, CAST(0.9 AS DOUBLE) AS q, round(quantile_cont(tied, 0.9), 9) AS quantile
    FROM scored GROUP BY source_file""",
)
def quantiles_by_file(spark, sf):
    q = prefix.quantiles(views.scored(spark, sf), "tied", [0.9], by=["source_file"])
    return q.withColumn("quantile", F.round("quantile", 9))


@query(
    "quantiles_missing_file",
    f"""WITH {views.SCORED}, g AS (SELECT tied, CASE WHEN row_id % 10 <> 3 THEN source_file END AS source_file FROM scored)
    SELECT source_file, CAST(0.9 AS DOUBLE) AS q, round(quantile_cont(tied, 0.9), 9) AS quantile FROM g GROUP BY source_file""",
)
def quantiles_missing_file(spark, sf):
    """Rows without a source file form a group of their own."""
    scored = views.scored(spark, sf).withColumn("source_file", F.when(F.col("row_id") % 10 != 3, F.col("source_file")))
    q = prefix.quantiles(scored, "tied", [0.9], by=["source_file"])
    return q.withColumn("quantile", F.round("quantile", 9))


PRED = "CASE WHEN score >= CAST(60 AS DOUBLE) THEN 1 ELSE 0 END"
CONFUSION = f"""k AS (SELECT count(*) FILTER (WHERE y = 1 AND p = 1) AS tp, count(*) FILTER (WHERE y = 0 AND p = 0) AS tn,
  count(*) FILTER (WHERE y = 0 AND p = 1) AS fp, count(*) FILTER (WHERE y = 1 AND p = 0) AS fn
  FROM (SELECT binary_label AS y, {PRED} AS p FROM scored))"""


@query(
    "binary_metrics",
    f"""WITH {CURVES}, {CONFUSION} SELECT {RATES_SQL}, {ROC.format(c='c')} AS roc_auc, {PR.format(c='c')} AS pr_auc FROM k""",
)
def binary_metrics(spark, sf):
    s = views.scored(spark, sf).withColumn("pred", (F.col("score") >= 60.0).cast("int"))
    return metrics.scored_metrics(s, "binary_label", "pred", "score").withColumn("pr_auc", F.round("pr_auc", 9))


@query(
    "metrics_by_file",
    f"""WITH {views.SCORED}, k AS (SELECT source_file, count(*) FILTER (WHERE y = 1 AND p = 1) AS tp,
      count(*) FILTER (WHERE y = 0 AND p = 0) AS tn, count(*) FILTER (WHERE y = 0 AND p = 1) AS fp,
      count(*) FILTER (WHERE y = 1 AND p = 0) AS fn
      FROM (SELECT source_file, binary_label AS y, {PRED} AS p FROM scored) GROUP BY source_file)
    SELECT source_file, {RATES_SQL} FROM k""",
)
def metrics_by_file(spark, sf):
    s = views.scored(spark, sf).withColumn("pred", (F.col("score") >= 60.0).cast("int"))
    return metrics.binary_metrics(s, "binary_label", "pred", by=["source_file"])


def points_sql(method: str, score: str, curve: str, test_curve: str, names: list[tuple[str, str, str]]) -> str:
    """Metric rows of one method: the thresholds applied to the test rows."""
    union = " UNION ALL ".join(f"SELECT '{op}' AS operating_point, '{src}' AS threshold_source, {thr} AS threshold" for op, src, thr in names)
    return f"""SELECT '{method}' AS method, operating_point, threshold_source, threshold, {RATES_SQL},
      {ROC.format(c=test_curve)} AS roc_auc, {PR.format(c=test_curve)} AS pr_auc FROM (
      SELECT operating_point, threshold_source, threshold,
        count(*) FILTER (WHERE binary_label = 1 AND {score} >= threshold) AS tp,
        count(*) FILTER (WHERE binary_label = 0 AND {score} < threshold) AS tn,
        count(*) FILTER (WHERE binary_label = 0 AND {score} >= threshold) AS fp,
        count(*) FILTER (WHERE binary_label = 1 AND {score} < threshold) AS fn
      FROM scored, ({union}) WHERE split = 'test' GROUP BY ALL)"""


def _names(val: str, test: str | None = None):
    names = [
        ("val_accuracy_calibrated", "validation", acc_cut(val)),
        ("val_balanced_accuracy_calibrated", "validation", bal_cut(val)),
        ("val_f1_calibrated", "validation", f1_cut(val)),
        ("val_far_calibrated_8.10e-04", "validation", far_cut(val, 8.1e-4)),
    ]
    if test:
        names += [
            ("test_f1_optimal", "test", f1_cut(test)),
            ("test_far_matched_8.10e-04", "test", far_cut(test, 8.1e-4)),
        ]
    return names


def points(spark, sf, method, score, optimistic=False):
    s = views.scored(spark, sf)
    val, test = s.filter("split = 'val'"), s.filter("split = 'test'")
    rows = metrics.operating_points(method, val, test, score=score, test_optimistic=optimistic)
    return rows.withColumn("pr_auc", F.round("pr_auc", 9))


@query("operating_points", f"WITH {VAL_CURVES} " + points_sql("value score", "score", "c", "tc", _names("c", "tc")))
def operating_points(spark, sf):
    return points(spark, sf, "value score", "score", optimistic=True)


HEADLINE_CTE = VAL_CURVES + "," + _curve("tt", "scored", "tied", "split = 'test'")
COMPARISON = (
    f"({points_sql('value score', 'score', 'c', 'tc', _names('c'))} UNION ALL "
    f"{points_sql('tied score', 'tied', 't', 'tt', _names('t'))})"
)


@query("comparison_table", f"WITH {HEADLINE_CTE} SELECT * FROM {COMPARISON}")
def comparison_table(spark, sf):
    s = views.scored(spark, sf).filter("split IN ('val', 'test')")
    both = F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).alias("score")) for m, c in (("value score", "score"), ("tied score", "tied"))])
    rows = metrics.operating_table(s.select(F.inline(both), F.col("split").alias("part"), F.col("binary_label").alias("label")))
    return rows.withColumn("pr_auc", F.round("pr_auc", 9))


@query(
    "headline_table",
    f"WITH {HEADLINE_CTE} SELECT * FROM {COMPARISON} WHERE operating_point = 'val_balanced_accuracy_calibrated'",
)
def headline_table(spark, sf):
    rows = comparison_table(spark, sf)
    return metrics.headline_table(rows, headline="val_balanced_accuracy_calibrated")


@query(
    "main_metrics_row",
    f"WITH {HEADLINE_CTE} SELECT method AS model, accuracy, tp FROM {COMPARISON} WHERE method = 'tied score' "
    "AND operating_point = 'val_f1_calibrated'",
)
def main_metrics_row(spark, sf):
    rows = comparison_table(spark, sf).filter("operating_point = 'val_f1_calibrated'")
    numbered = rows.select(
        F.col("method").alias("model"), "accuracy", "tp", F.when(F.col("method") == "tied score", 1).otherwise(2).alias("position")
    )
    return metrics.main_metrics_row(numbered, "tied score").drop("position")


@query(
    "persist_points",
    f"""WITH {VAL_CURVES} SELECT row_id, split, CASE WHEN score >= {acc_cut('c')} THEN 1 ELSE 0 END AS y_pred_accuracy,
    CASE WHEN score >= {bal_cut('c')} THEN 1 ELSE 0 END AS y_pred_balanced,
    CASE WHEN score >= {f1_cut('c')} THEN 1 ELSE 0 END AS y_pred_f1,
    CASE WHEN score >= {far_cut('c', 8.1e-4)} THEN 1 ELSE 0 END AS y_pred_far FROM scored WHERE split <> 'train'""",
)
def persist_points(spark, sf):
    s = views.scored(spark, sf)
    table = curves.score_table(s.filter("split = 'val'"), "score", "binary_label")
    cuts = curves.all_cuts(table).first().asDict()
    return metrics.persist_points(s.filter("split <> 'train'"), cuts).select(
        "row_id", "split", *[f"y_pred_{n}" for n in ("accuracy", "balanced", "f1", "far")]
    )


# --- conformal and cascade --------------------------------------------------

PVALUE = (
    views.SCORED
    + """,
cal AS (SELECT rf_score FROM scored WHERE split = 'val' AND binary_label = 0),
both_sides AS (SELECT rf_score, 1 AS c FROM cal UNION ALL SELECT rf_score, 0 FROM scored),
ge AS (SELECT rf_score, sum(c) OVER (ORDER BY rf_score DESC RANGE UNBOUNDED PRECEDING) AS ge FROM both_sides),
pv AS (SELECT s.*, (CAST(1 AS DOUBLE) + g.ge) / ((SELECT count(*) FROM cal) + CAST(1 AS DOUBLE)) AS rf_pvalue
  FROM scored s JOIN (SELECT DISTINCT rf_score, ge FROM ge) g ON s.rf_score = g.rf_score)"""
)


def with_pvalues(spark, sf, smoothing=False):
    s = views.scored(spark, sf)
    cal = s.filter("split = 'val' AND binary_label = 0")
    return conformal.conformal_pvalues(s, cal, "rf_score", smoothing=smoothing, out="rf_pvalue")


@query("conformal_p_bounds", f"WITH {PVALUE} SELECT row_id, true AS between_bounds, count(*) OVER () AS rows FROM pv")
def conformal_p_bounds(spark, sf):
    """The smoothed p-value lies between the plain one and the plain one without the row's ties."""
    plain, smooth = (with_pvalues(spark, sf, smoothing=s).select("row_id", F.col("rf_pvalue").alias(f"p{int(s)}"), "rf_score") for s in (False, True))
    s = views.scored(spark, sf)
    cal = s.filter("split = 'val' AND binary_label = 0")
    ties = cal.groupBy(F.col("rf_score").alias("tied")).agg(F.count("*").alias("ties"))
    n = cal.count()
    both = plain.join(smooth.drop("rf_score"), "row_id").join(ties, F.col("rf_score") == F.col("tied"), "left")
    low = F.col("p0") - F.coalesce("ties", F.lit(0)) / F.lit(n + 1.0)
    between = (F.col("p1") <= F.col("p0") + 1e-12) & (F.col("p1") >= low - 1e-12)
    return both.select("row_id", between.alias("between_bounds"), F.lit(plain.count()).cast("long").alias("rows"))


@query("conformal_p", f"WITH {PVALUE} SELECT row_id, rf_pvalue FROM pv")
def conformal_p(spark, sf):
    return with_pvalues(spark, sf).select("row_id", "rf_pvalue")


@query("conformal_p_smoothed")
def conformal_p_smoothed(spark, sf):
    return with_pvalues(spark, sf, smoothing=True).select("row_id", "rf_pvalue")


@query(
    "conformal_decide",
    f"""WITH {PVALUE} SELECT row_id, CASE WHEN rf_pvalue <= CAST(0.05 AS DOUBLE) THEN 1 ELSE 0 END AS conformal_pred FROM pv""",
)
def conformal_decide(spark, sf):
    return with_pvalues(spark, sf).select(
        "row_id", conformal.conformal_decision(F.col("rf_pvalue"), 0.05).alias("conformal_pred")
    )


@query(
    "conformal_threshold",
    f"WITH {PVALUE} SELECT CAST(0.95 AS DOUBLE) AS q, round(quantile_cont(rf_score, 0.95), 9) AS quantile FROM cal",
)
def conformal_threshold(spark, sf):
    s = views.scored(spark, sf)
    q = conformal.conformal_threshold(s.filter("split = 'val' AND binary_label = 0"), 0.05, "rf_score")
    return q.withColumn("quantile", F.round("quantile", 9))


CASCADE = (
    PVALUE
    + """,
esc AS (SELECT *, rf_pvalue <= CAST(0.2 AS DOUBLE) AS e FROM pv),
cascaded AS (SELECT row_id, split, binary_label, CASE WHEN e THEN 1 ELSE 0 END AS escalated,
  CASE WHEN snort_pred = 1 OR (e AND gate_prob >= CAST(0.5 AS DOUBLE)) THEN 1 ELSE 0 END AS cascade_pred,
  CASE WHEN snort_pred = 1 THEN greatest(CASE WHEN e THEN greatest(rf_score, gate_prob) ELSE rf_score END, CAST(1 AS DOUBLE))
    WHEN e THEN greatest(rf_score, gate_prob) ELSE rf_score END AS cascade_score FROM esc)"""
)


@query("cascade", f"WITH {CASCADE} SELECT row_id, escalated, cascade_pred, cascade_score FROM cascaded")
def cascade_query(spark, sf):
    return cascade.cascade_decision(with_pvalues(spark, sf)).select("row_id", "escalated", "cascade_pred", "cascade_score")


@query(
    "gate_where_escalated",
    f"""WITH {CASCADE} SELECT e.row_id, CASE WHEN e THEN gate_prob ELSE 0 END AS gate_prob FROM esc e""",
)
def gate_where_escalated(spark, sf):
    def score_pool(pool):
        return pool.withColumn("gate_prob", F.col("k") / 99.0)

    gated = cascade.gate_where_escalated(with_pvalues(spark, sf).drop("gate_prob"), score_pool)
    return gated.select("row_id", "gate_prob")


@query(
    "pool_counts",
    f"""WITH {CASCADE} SELECT split, count(*) AS n, count(*) FILTER (WHERE binary_label = 0) AS n_benign,
    count(*) FILTER (WHERE binary_label = 1) AS n_attack, count(*) FILTER (WHERE e) AS escalated,
    count(*) FILTER (WHERE e AND binary_label = 1) AS escalated_attack,
    CAST(count(*) FILTER (WHERE e) AS DOUBLE) / count(*) AS escalated_frac FROM esc GROUP BY split""",
)
def pool_counts(spark, sf):
    return metrics.pool_counts(with_pvalues(spark, sf), ["split"], 0.20)


@query(
    "pool_guard",
    f"""WITH {CASCADE}, p AS (SELECT split, count(*) FILTER (WHERE e) AS n, count(*) FILTER (WHERE e AND binary_label = 1) AS a
      FROM esc GROUP BY split) SELECT split, CASE WHEN n >= 200 AND a >= 50 AND n - a >= 50 THEN 1 ELSE 0 END AS usable FROM p""",
)
def pool_guard(spark, sf):
    pools = metrics.pool_counts(with_pvalues(spark, sf), ["split"], 0.20)
    usable = cascade.pool_is_usable(F.col("escalated"), F.col("escalated_attack"))
    return pools.select("split", usable.cast("int").alias("usable"))


@query(
    "final_score",
    f"""WITH {views.SCORED} SELECT row_id, CASE WHEN snort_pred = 1 OR k % 10 = 7 THEN CAST(1 AS DOUBLE) ELSE gate_prob END
    AS final_score FROM scored""",
)
def final_score(spark, sf):
    s = views.scored(spark, sf).withColumn("rate_hit", (F.col("k") % 10 == 7).cast("int"))
    return cascade.final_score(s, rate_hit="rate_hit").select("row_id", "final_score")


# --- sequences --------------------------------------------------------------


@query(
    "seq_windows",
    f"""WITH {views.FLOWS}, o AS (SELECT row_id, total_fwd_packets AS v,
      row_number() OVER (ORDER BY "timestamp", row_id) AS ordinal FROM flows),
    w AS (SELECT row_id, ordinal, list(CAST(v AS BIGINT)) OVER (ORDER BY ordinal ROWS 9 PRECEDING) AS l FROM o)
    SELECT row_id, ordinal, array_to_string(l, ',') AS win FROM w WHERE ordinal >= 10""",
)
def seq_windows(spark, sf):
    f = split.time_order(views.flows(spark, sf)).select("_t", "row_id", F.col("total_fwd_packets").cast("bigint").alias("v"))
    w = sequences.sequence_windows(f, "v", block=256)
    return w.select("row_id", "ordinal", F.array_join(F.col("window").cast("array<string>"), ",").alias("win"))


@query(
    "seq_align",
    f"""WITH {views.FLOWS}, o AS (SELECT row_id, source_file, total_fwd_packets AS v,
      row_number() OVER (PARTITION BY source_file ORDER BY "timestamp", row_id) AS ordinal FROM flows),
    w AS (SELECT row_id, source_file, ordinal, CASE WHEN ordinal >= 10 THEN sum(v) OVER
      (PARTITION BY source_file ORDER BY ordinal ROWS 9 PRECEDING) END AS s FROM o)
    SELECT row_id, coalesce(s, max(CASE WHEN ordinal = 10 THEN s END) OVER (PARTITION BY source_file), 0) AS score FROM w""",
)
def seq_align(spark, sf):
    f = split.time_order(views.flows(spark, sf)).select("source_file", "_t", "row_id", F.col("total_fwd_packets").alias("v"))
    by = ["source_file"]
    windows = sequences.sequence_windows(f, "v", by=by)
    scores = windows.select("source_file", "row_id", "ordinal", F.aggregate("window", F.lit(0.0), lambda a, x: a + x).alias("score"))
    rows = prefix.with_ordinal(f.drop("v"), "_t", "row_id", by=by).drop("_t")
    return sequences.align_scores(rows, scores, by=by).select("row_id", "score")
