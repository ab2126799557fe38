"""Detection metrics and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsentry.config import HEADLINE_FALLBACKS, TARGET_FAR
from flowsentry.functions.labels import BENIGN, UNKNOWN, class_rank
from flowsentry.operators.curves import all_cuts, areas, score_table
from flowsentry.session import materialize

RATES = ["accuracy", "precision", "recall", "f1", "far"]
COUNTS = ["tp", "tn", "fp", "fn"]


def confusion(label: Column, pred: Column) -> dict[str, Column]:
    y, p = label.cast("int") == 1, pred.cast("int") == 1
    return {
        "tp": F.count_if(y & p),
        "tn": F.count_if(~y & ~p),
        "fp": F.count_if(~y & p),
        "fn": F.count_if(y & ~p),
    }


def rates() -> list[Column]:
    """Rates from columns tp, tn, fp, fn; a zero denominator gives 0."""
    tp, tn, fp, fn = (F.col(c) for c in COUNTS)

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    return [
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(fp, fp + tn).alias("far"),
    ]


def binary_metrics(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts and rates of a 0/1 prediction."""
    counts = df.groupBy(*by).agg(*[c.alias(n) for n, c in confusion(F.col(label), F.col(pred)).items()])
    return counts.select(*by, *rates(), *COUNTS)


def scored_metrics(df: DataFrame, label: str, pred: str, score: str) -> DataFrame:
    """Counts, rates and both areas as one row."""
    return _with_areas(binary_metrics(df, label, pred), score_table(df, score, label))


def _with_areas(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Attach both areas, two numbers, to every row."""
    area = areas(table).first()
    return rows.select("*", *[F.lit(area[c]).cast("double").alias(c) for c in ("roc_auc", "pr_auc")])


def class_wise(df: DataFrame, pred: str, label: str = "multiclass_label") -> DataFrame:
    """Per class: support and detection rate (benign: share left alone), in report order."""
    grouped = df.groupBy(F.coalesce(F.col(label), F.lit(UNKNOWN)).alias("class")).agg(
        F.count("*").alias("support"), F.sum(F.col(pred).cast("bigint")).alias("fires")
    )
    return _class_rates(grouped).select("class", "support", "metric", "rate").orderBy(
        class_rank(F.col("class")), "class"
    )


def per_class_fires(labels: DataFrame, preds: DataFrame, pred: str = "signature_pred") -> DataFrame:
    """Per class: support, fires and rate rounded to 4 digits; rows without a prediction did not fire."""
    joined = labels.select("row_id", "multiclass_label").join(preds.select("row_id", pred), "row_id", "left")
    return per_class_report(joined, pred)


def per_class_report(df: DataFrame, pred: str, label: str = "multiclass_label") -> DataFrame:
    grouped = df.groupBy(F.col(label).alias("class")).agg(
        F.count("*").alias("support"),
        F.count_if(F.coalesce(F.col(pred), F.lit(0)) == 1).alias("fires"),
    )
    return (
        _class_rates(grouped)
        .select("class", "support", "metric", F.round("rate", 4).alias("rate"), "fires")
        .orderBy(F.col("support").desc(), "class")
    )


def _class_rates(grouped: DataFrame) -> DataFrame:
    benign = F.col("class") == BENIGN
    share = F.col("fires") / F.col("support")
    return grouped.select(
        "*",
        F.when(benign, F.lit("Correct Benign Rate")).otherwise(F.lit("Detection Rate")).alias("metric"),
        F.when(benign, 1.0 - share).otherwise(share).alias("rate"),
    )


def split_counts(splits: DataFrame) -> DataFrame:
    """Rows per split and label with all subtotals (null marks a total)."""
    return splits.rollup("split", "multiclass_label").agg(
        F.count("*").alias("rows"),
        F.sum(F.col("binary_label").cast("bigint")).alias("attacks"),
    )


def pool_counts(scored: DataFrame, by: Sequence[str], alpha_escalate: float) -> DataFrame:
    """Size, classes and share of the escalated pool per group."""
    esc = F.col("rf_pvalue") <= alpha_escalate
    return scored.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("binary_label") == 0).alias("n_benign"),
        F.count_if(F.col("binary_label") == 1).alias("n_attack"),
        F.count_if(esc).alias("escalated"),
        F.count_if(esc & (F.col("binary_label") == 1)).alias("escalated_attack"),
        (F.count_if(esc) / F.count("*")).alias("escalated_frac"),
    )


def operating_points(
    method: str,
    val: DataFrame,
    test: DataFrame,
    score: str = "score",
    label: str = "binary_label",
    extra: dict[str, float] | None = None,
    **options,
) -> DataFrame:
    """Thresholds chosen on ``val``, reported on ``test``, for one score: see operating_table."""
    parts = [
        df.select(F.lit(method).alias("method"), F.lit(part).alias("part"), F.col(score).cast("double").alias("score"), F.col(label).alias("label"))
        for part, df in (("val", val), ("test", test))
    ]
    rows = operating_table(parts[0].unionByName(parts[1]), **options)
    return rows.select("*", *[F.lit(v).alias(k) for k, v in (extra or {}).items()])


def operating_table(
    scores: DataFrame,
    target_far: float = TARGET_FAR,
    include: Sequence[str] = ("accuracy", "balanced", "f1", "far"),
    test_optimistic: bool = False,
    suffix: str = "",
) -> DataFrame:
    """One metric row per method and operating point, for any number of methods in one pass.

    ``scores``: method, part (val or test), score and label. All curves are one score table grouped by method and
    part; thresholds come from the val curves and are joined, a few rows a method, with the test curves, whose
    running totals give the counts. Rows are read once.
    """
    names = {
        "accuracy": f"val_accuracy_calibrated{suffix}",
        "balanced": f"val_balanced_accuracy_calibrated{suffix}",
        "f1": "val_f1_calibrated",
        "far": f"val_far_calibrated_{target_far:.2e}",
    }
    by = ["method", "part"]
    table = materialize(score_table(scores, "score", "label", by=by), "score-tables")
    points = [("val", names[k], "validation", k) for k in include]
    if test_optimistic:
        points += [("test", "test_f1_optimal", "test", "f1"), ("test", f"test_far_matched_{target_far:.2e}", "test", "far")]
    cuts = all_cuts(table, target_far, by=by)
    rows = F.array(
        *[
            F.struct(F.lit(part).alias("of"), F.lit(op).alias("operating_point"), F.lit(src).alias("threshold_source"), F.col(k).alias("threshold"))
            for part, op, src, k in points
        ]
    )
    chosen = cuts.select("*", F.inline(rows)).filter(F.col("of") == F.col("part")).select("method", "operating_point", "threshold_source", "threshold")
    test = table.filter("part = 'test'")
    point = ["method", "operating_point", "threshold_source", "threshold"]
    flagged = F.col("score") >= F.col("threshold")
    hits = F.coalesce(F.sum(F.when(flagged, F.col("pos"))), F.lit(0))
    alarms = F.coalesce(F.sum(F.when(flagged, F.col("n") - F.col("pos"))), F.lit(0))
    attacks, all_rows = F.coalesce(F.max("total_pos"), F.lit(0)), F.coalesce(F.max("total_n"), F.lit(0))
    counts = chosen.join(test, "method", "left").groupBy(*point).agg(
        hits.alias("tp"), (all_rows - attacks - alarms).alias("tn"), alarms.alias("fp"), (attacks - hits).alias("fn")
    )
    return counts.join(areas(test, by=["method"]), "method", "left").select(*point, *rates(), "roc_auc", "pr_auc", *COUNTS)


def persist_points(df: DataFrame, thresholds: dict[str, float], score: str = "score") -> DataFrame:
    """Add one 0/1 prediction column per operating point."""
    return df.select(
        "*", *[(F.col(score) >= F.lit(t)).cast("int").alias(f"y_pred_{name}") for name, t in thresholds.items()]
    )


def headline_table(rows: DataFrame, headline: str = "val_accuracy_calibrated") -> DataFrame:
    """One row per method at the pre-declared operating point, else at the first fallback it has;
    best accuracy first."""
    order = list(dict.fromkeys([headline, *HEADLINE_FALLBACKS]))
    rank = F.lit(None).cast("int")
    for i, op in reversed(list(enumerate(order))):
        rank = F.when(F.col("operating_point") == op, F.lit(i)).otherwise(rank)
    # A false-alarm row is the last resort.
    rank = F.when(rank.isNull() & F.col("operating_point").startswith("val_far_calibrated_"), len(order)).otherwise(rank)
    best = Window.partitionBy("method").orderBy("_rank", "operating_point")
    return (
        rows.withColumn("_rank", rank)
        .filter(F.col("_rank").isNotNull())
        .withColumn("_rn", F.row_number().over(best))
        .filter(F.col("_rn") == 1)
        .drop("_rank", "_rn")
        .orderBy(F.col("accuracy").desc(), "method")
    )


def main_metrics_row(metrics: DataFrame, main_model: str, position: str = "position") -> DataFrame:
    """The first row of the main model, else the last row."""
    is_main = F.col("model") == main_model
    pick = F.struct(is_main.cast("int"), F.when(is_main, -F.col(position)).otherwise(F.col(position)))
    every = F.struct(*[F.col(c) for c in metrics.columns])
    return metrics.agg(F.max_by(every, pick).alias("r")).select("r.*")
