import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsentry.operators import curves as C
from flowsentry.operators import metrics as M


def _data(seed, n=300, ties=True):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        y = int(rng.random() < 0.3)
        s = rng.gauss(y * 0.8, 1.0)
        rows.append((y, round(s, 1) if ties else s))
    return rows


def _cuts(rows):
    """(k, tp, threshold) for every achievable cut, tightest first."""
    scores = sorted({s for _, s in rows}, reverse=True)
    out = [(0, 0, scores[0] + 1e-12)]
    for i, s in enumerate(scores):
        k = sum(1 for _, v in rows if v >= s)
        tp = sum(1 for y, v in rows if v >= s and y)
        out.append((k, tp, (s + scores[i + 1]) / 2 if i + 1 < len(scores) else s - 1e-12))
    return out


@pytest.mark.parametrize("seed,ties", [(1, True), (2, False)])
def test_thresholds_against_brute_force(spark, seed, ties):
    rows = _data(seed, ties=ties)
    table = C.score_table(spark.createDataFrame(rows, "label int, score double"))
    n, p = len(rows), sum(y for y, _ in rows)
    cuts = _cuts(rows)
    acc = max(cuts, key=lambda c: (2 * c[1] - c[0], -c[0]))
    bal = max(cuts, key=lambda c: (c[1] * (n - p) - (c[0] - c[1]) * p, -c[0]))
    got = C.all_cuts(table, 0.05).first()
    assert got["accuracy"] == acc[2] == C.accuracy_cut(table).first()[0]
    assert got["balanced"] == bal[2] == C.balanced_cut(table).first()[0]
    scores = sorted({s for _, s in rows})
    f1 = max(scores, key=lambda s: (2 * sum(y for y, v in rows if v >= s) / (sum(1 for _, v in rows if v >= s) + p), -s))
    assert got["f1"] == f1 == C.f1_cut(table).first()[0]
    benign = sorted((s for y, s in rows if not y), reverse=True)
    far = benign[int(math.floor(len(benign) * 0.05))] + 1e-12
    assert got["far"] == far == C.far_cut(table, 0.05).first()[0]
    assert sum(1 for s in benign if s >= far) <= 0.05 * len(benign)


def test_areas_against_pairs(spark):
    rows = _data(3)
    table = C.score_table(spark.createDataFrame(rows, "label int, score double"))
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    got = C.areas(table).first()
    assert got["roc_auc"] == pytest.approx(auc, abs=1e-12)
    ap, before = 0.0, 0
    for s in sorted({s for _, s in rows}, reverse=True):
        k, tp = sum(1 for _, v in rows if v >= s), sum(1 for y, v in rows if v >= s and y)
        ap, before = ap + (tp - before) / len(pos) * tp / k, tp
    assert got["pr_auc"] == pytest.approx(ap, abs=1e-12)


def test_single_class_and_extremes(spark):
    benign = C.score_table(spark.createDataFrame([(0, 1.0), (0, 2.0)], "label int, score double"))
    got = C.all_cuts(benign, 1.0).first()
    assert got["accuracy"] == got["balanced"] == 2.0 + 1e-12  # flagging nothing is best
    assert got["far"] == 0.0  # every benign row may be flagged
    assert C.areas(benign).first()["roc_auc"] is None
    attacks = C.score_table(spark.createDataFrame([(1, 1.0), (1, 2.0)], "label int, score double"))
    got = C.all_cuts(attacks).first()
    assert got["accuracy"] == 1.0 - 1e-12 and got["far"] == math.inf
    empty = C.score_table(spark.createDataFrame([], "label int, score double"))
    assert C.accuracy_cut(empty).first()[0] == 0.0


def test_metrics_are_zero_safe(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, p int")
    r = M.binary_metrics(df, "y", "p").first()
    assert (r["accuracy"], r["precision"], r["recall"], r["f1"], r["far"], r["tn"]) == (1.0, 0.0, 0.0, 0.0, 0.0, 2)


def test_headline_falls_back_in_order(spark):
    rows = [
        ("a", "val_accuracy_calibrated", 0.5),
        ("a", "val_balanced_accuracy_calibrated", 0.9),
        ("b", "val_far_calibrated_8.10e-04", 0.7),
        ("b", "val_f1_calibrated", 0.99),
        ("c", "val_balanced_accuracy_calibrated_isotonic", 0.6),
        ("c", "val_balanced_accuracy_calibrated", 0.8),
        ("d", "test_f1_optimal", 1.0),
    ]
    df = spark.createDataFrame(rows, "method string, operating_point string, accuracy double")
    got = [(r["method"], r["accuracy"]) for r in M.headline_table(df).collect()]
    assert got == [("b", 0.7), ("c", 0.6), ("a", 0.5)]


def test_main_row(spark):
    df = spark.createDataFrame([("x", 1), ("main", 2), ("main", 3), ("y", 4)], "model string, position int")
    assert M.main_metrics_row(df, "main").first()["position"] == 2
    assert M.main_metrics_row(df, "absent").first()["position"] == 4


def test_class_reports(spark):
    df = spark.createDataFrame(
        [(1, "BENIGN", 1), (2, "BENIGN", 0), (3, "BENIGN", 0), (4, "Bot", 1), (5, "Odd", 0)],
        "row_id long, multiclass_label string, signature_pred int",
    )
    got = [(r["class"], round(r["rate"], 3)) for r in M.class_wise(df, "signature_pred").collect()]
    assert got == [("Bot", 1.0), ("BENIGN", 0.667), ("Odd", 0.0)]
    fires = M.per_class_fires(df, df.filter("row_id <> 4")).collect()
    assert {r["class"]: r["fires"] for r in fires} == {"BENIGN": 1, "Bot": 0, "Odd": 0}
    assert fires[0]["rate"] == 0.6667


def test_far_with_hot_scores(spark):
    rng = np.random.default_rng(0)
    rows = [(0, 0.0)] * 400 + [(1, 1.0)] * 30 + [(0, 1.0)] * 3 + [(0, float(v)) for v in rng.random(200)]
    df = spark.createDataFrame(rows, "label int, score double")
    t = C.far_cut(C.score_table(df), 0.01).first()[0]
    assert df.filter((F.col("label") == 0) & (F.col("score") >= t)).count() <= 0.01 * 603


@pytest.mark.parametrize("base", [2e4, 3.7e9, 1e15, -5e7])
def test_thresholds_hold_at_any_magnitude(spark, base):
    ups = [base]
    for _ in range(5):
        ups.append(math.nextafter(ups[-1], math.inf))
    benign = C.score_table(spark.createDataFrame([(0, s) for s in ups], "label int, score double"))
    cut = C.all_cuts(benign, 0.34).first()
    assert sum(s >= cut["far"] for s in ups) == 2  # a third of six, not one more
    assert cut["accuracy"] > max(ups)  # flags nothing
    mixed = C.score_table(spark.createDataFrame([(int(i > 2), s) for i, s in enumerate(ups)], "label int, score double"))
    assert [s >= C.all_cuts(mixed, 0.0).first()["accuracy"] for s in ups] == [False] * 3 + [True] * 3
    attacks = C.score_table(spark.createDataFrame([(1, s) for s in ups], "label int, score double"))
    assert C.all_cuts(attacks, 0.1).first()["accuracy"] < min(ups)
