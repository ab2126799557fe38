"""Score curves: operating thresholds, ROC-AUC and average precision.

Everything starts from one table per score column: counts per distinct score with running
totals from the highest score down. A threshold t predicts an attack where score >= t.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry.config import TARGET_FAR
from flowsentry.operators.prefix import running_totals

EPSILON = 1e-12
# Half a unit in the last place of any double, and a little more: adding it gives the next one.
_STEP = 2.0**-53 * (1 + 2.0**-52)
WIDE = "decimal(38,0)"


def _step(x: Column) -> Column:
    return F.greatest(F.abs(x) * F.lit(_STEP), F.lit(EPSILON))


def just_above(x: Column) -> Column:
    """x plus 1e-12, or the next larger double where that is more."""
    return x + _step(x)


def just_below(x: Column) -> Column:
    """x less 1e-12, or the next smaller double where that is less."""
    return x - _step(x)


def score_table(df: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Distinct scores, highest first: rows ``n`` and attacks ``pos`` with running and full totals."""
    slim = df.select(*by, F.col(score).cast("double").alias("score"), F.col(label).cast("bigint").alias("_y"))
    return running_totals(slim, "score", {"pos": F.col("_y"), "n": F.lit(1)}, by=by, descending=True)


def _threshold(best_score: Column, best_next: Column, nothing: Column, everything: Column) -> Column:
    """Threshold that realises a cut below ``best_score``."""
    return (
        F.when(nothing, just_above(F.col("max_score")))
        .when(everything, just_below(best_score))
        .when((best_score + best_next) / 2 > best_next, (best_score + best_next) / 2)
        .otherwise(best_score)  # no double lies between the two
    )


def _best(objective: Column) -> list[Column]:
    """Cut with the largest objective; the tightest one (highest score) wins ties."""
    pick = F.struct(objective.alias("gain"), F.col("score"))
    row = F.struct(
        objective.alias("gain"), F.col("score").alias("score"), F.col("next_key").alias("next")
    )
    return [F.max_by(row, pick)]


def accuracy_cut(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy-optimal threshold (column ``threshold``), exact over all achievable cuts.

    Objectives are compared as integers: attacks caught twice minus rows flagged. Flagging
    nothing scores 0, so it wins whenever no cut does better. An empty input gives 0.
    """
    return _cut(table, by, _accuracy_gain(), "threshold")


def _accuracy_gain() -> Column:
    return (2 * F.col("cum_pos") - F.col("cum_n")).cast(WIDE)


def _balanced_gain() -> Column:
    """tpr + tnr - 1, scaled by both class sizes to stay an integer."""
    pos, n = F.col("total_pos").cast("decimal(19,0)"), F.col("total_n").cast("decimal(19,0)")
    hit = F.col("cum_pos").cast("decimal(19,0)")
    false = (F.col("cum_n") - F.col("cum_pos")).cast("decimal(19,0)")
    gain = (hit * (n - pos).cast("decimal(19,0)") - false * pos).cast(WIDE)
    one_class = (F.col("total_pos") == 0) | (F.col("total_pos") == F.col("total_n"))
    return F.when(one_class, _accuracy_gain()).otherwise(gain)


def _cut(table: DataFrame, by: Sequence[str], gain: Column, out: str) -> DataFrame:
    best = table.groupBy(*by).agg(_best(gain)[0].alias("b"), F.max("score").alias("max_score"))
    found = _threshold(F.col("b.score"), F.col("b.next"), F.col("b.gain") <= 0, F.col("b.next").isNull())
    return best.select(*by, F.coalesce(found, F.lit(0.0)).alias(out))


def balanced_cut(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Threshold with the best mean of detection rate and benign rate; with one class only, the
    accuracy-optimal one."""
    return _cut(table, by, _balanced_gain(), "threshold")


def far_cut(table: DataFrame, target_far: float = TARGET_FAR, by: Sequence[str] = ()) -> DataFrame:
    """Smallest threshold whose false-alarm rate stays within the target.

    That is just above the (floor(n*far)+1)-th highest benign score. Without benign rows: +infinity.
    """
    negatives = F.col("cum_n") - F.col("cum_pos")
    total = F.col("total_n") - F.col("total_pos")
    allowed = F.floor(total * F.lit(target_far))
    has_benign = F.col("n") > F.col("pos")
    found = table.groupBy(*by).agg(
        F.max(F.when(negatives > allowed, F.col("score"))).alias("above"),
        F.min(F.when(has_benign, F.col("score"))).alias("lowest"),
    )
    value = (
        F.when(F.col("lowest").isNull(), F.lit(float("inf")))
        .when(F.col("above").isNull(), F.least(F.col("lowest") - 1.0, just_below(F.col("lowest"))))
        .otherwise(just_above(F.col("above")))
    )
    return found.select(*by, value.alias("threshold"))


def f1_cut(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """F1-optimal threshold; the loosest one wins ties."""
    f1 = (2 * F.col("cum_pos")) / (F.col("cum_n") + F.col("total_pos"))
    return table.groupBy(*by).agg(F.max_by("score", F.struct(f1, -F.col("score"))).alias("threshold"))


def all_cuts(table: DataFrame, target_far: float = TARGET_FAR, by: Sequence[str] = ()) -> DataFrame:
    """The four validation thresholds of each score in one pass: one row a group, one column each."""
    negatives = F.col("cum_n") - F.col("cum_pos")
    allowed = F.floor((F.col("total_n") - F.col("total_pos")) * F.lit(target_far))
    f1 = (2 * F.col("cum_pos")) / (F.col("cum_n") + F.col("total_pos"))
    row = table.groupBy(*by).agg(
        _best(_accuracy_gain())[0].alias("acc"),
        _best(_balanced_gain())[0].alias("bal"),
        F.max("score").alias("max_score"),
        F.max(F.when(negatives > allowed, F.col("score"))).alias("above"),
        F.min(F.when(F.col("n") > F.col("pos"), F.col("score"))).alias("lowest"),
        F.max_by("score", F.struct(f1, -F.col("score"))).alias("f1"),
    )

    def cut(name: str) -> Column:
        b = F.col(name)
        found = _threshold(b["score"], b["next"], b["gain"] <= 0, b["next"].isNull())
        return F.coalesce(found, F.lit(0.0))

    far = (
        F.when(F.col("lowest").isNull(), F.lit(float("inf")))
        .when(F.col("above").isNull(), F.least(F.col("lowest") - 1.0, just_below(F.col("lowest"))))
        .otherwise(just_above(F.col("above")))
    )
    return row.select(
        *by, cut("acc").alias("accuracy"), cut("bal").alias("balanced"), F.col("f1"), far.alias("far")
    )


def roc_auc(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve, ties counted half; null with one class only."""
    neg = F.col("n") - F.col("pos")
    strip = (2 * F.col("cum_pos") - F.col("pos")).cast("decimal(19,0)") * neg.cast("decimal(19,0)")
    sums = table.groupBy(*by).agg(
        F.sum(strip.cast(WIDE)).alias("area"),
        F.max("total_pos").alias("p"),
        (F.max("total_n") - F.max("total_pos")).alias("q"),
    )
    area = F.col("area").cast("double") / (2.0 * F.col("p") * F.col("q"))
    return sums.select(*by, F.when((F.col("p") > 0) & (F.col("q") > 0), area).alias("roc_auc"))


def average_precision(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Average precision: precision at each distinct score weighted by the recall it adds."""
    step = F.col("pos") * F.col("cum_pos") / F.col("cum_n")
    sums = table.groupBy(*by).agg(
        F.sum(step).alias("s"), F.max("total_pos").alias("p"), F.max("total_n").alias("t")
    )
    usable = (F.col("p") > 0) & (F.col("p") < F.col("t"))
    return sums.select(*by, F.when(usable, F.col("s") / F.col("p")).alias("pr_auc"))


def areas(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Both areas in one pass over the score table."""
    neg = F.col("n") - F.col("pos")
    strip = (2 * F.col("cum_pos") - F.col("pos")).cast("decimal(19,0)") * neg.cast("decimal(19,0)")
    sums = table.groupBy(*by).agg(
        F.sum(strip.cast(WIDE)).alias("area"),
        F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")).alias("s"),
        F.max("total_pos").alias("p"),
        (F.max("total_n") - F.max("total_pos")).alias("q"),
    )
    usable = (F.col("p") > 0) & (F.col("q") > 0)
    return sums.select(
        *by,
        F.when(usable, F.col("area").cast("double") / (2.0 * F.col("p") * F.col("q"))).alias("roc_auc"),
        F.when(usable, F.col("s") / F.col("p")).alias("pr_auc"),
    )
