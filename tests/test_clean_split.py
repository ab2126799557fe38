import datetime as dt

import pytest
from pyspark.sql import functions as F

from flowsentry.config import CascadeConfig
from flowsentry.functions.columns import canonical_name, flow_time, unique_names
from flowsentry.functions.labels import normalize_label
from flowsentry.operators.clean import clean_flows
from flowsentry.operators.split import (
    calibration_split,
    consecutive_sample,
    sample_rows,
    split_flows,
    stratified_split,
    temporal_split,
    time_order,
)


def test_names():
    assert canonical_name(" Flow Bytes/s") == "flow_bytes_s"
    assert canonical_name("Total Bwd packets") == "total_backward_packets"
    assert canonical_name(" Fwd Header Length ") == "Fwd Header Length"
    assert unique_names(["a", "a", "b", "a"]) == ["a", "a.1", "b", "a.2"]


def test_labels(spark):
    texts = ["Web Attack – XSS", "Web Attack \x96 XSS", "Web Attack � Sql Injection", " ddos", "New Thing ", None]
    df = spark.createDataFrame([(t,) for t in texts], "label string")
    got = [r[0] for r in df.select(normalize_label(F.col("label"))).collect()]
    assert got == [
        "Web Attack - XSS",
        "Web Attack - XSS",
        "Web Attack - Sql Injection",
        "DDoS",
        "New Thing",
        "UNKNOWN",
    ]


def test_clean_keeps_the_first_copy_and_drops_empty_columns(spark):
    inf = float("inf")
    rows = [
        (0, "f", "BENIGN", 1.0, None, 5.0, None),
        (1, "f", "benign", 1.0, None, 5.0, None),  # same label after normalisation: a copy of row 0
        (2, "f", "DDoS", inf, None, 5.0, None),  # one infinity: still few enough gaps
        (3, "f", "DDoS", float("nan"), None, 5.0, None),  # NaN and infinity both mean missing: a copy
        (4, "f", "DDoS", -inf, None, None, None),  # too many gaps
        (5, "f", None, 1.0, None, 5.0, None),  # no label
    ]
    df = spark.createDataFrame(rows, "row_id long, source_file string, label string, a double, b double, c double, d string")
    out = clean_flows(df, max_missing_fraction=0.40)
    assert sorted(out.columns) == ["a", "binary_label", "c", "multiclass_label", "row_id", "source_file"]
    assert sorted(r["row_id"] for r in out.collect()) == [0, 2]
    kept = clean_flows(df, max_missing_fraction=0.40, drop_unknown_labels=False)
    assert sorted(r["row_id"] for r in kept.collect()) == [0, 2, 5]


def test_flow_times(spark):
    df = spark.createDataFrame([("7/3/2017 8:55",), ("03/07/2017 08:55:58",), ("2017-07-03 08:55:58.25",), ("x",)], "timestamp string")
    got = [r[0] for r in df.select(flow_time(df)).collect()]
    assert got[0] == dt.datetime(2017, 7, 3, 8, 55)
    assert got[2] == dt.datetime(2017, 7, 3, 8, 55, 58, 250000)
    assert got[3] is None


def _frame(spark, n=203):
    base = dt.datetime(2017, 7, 3)
    rows = [
        (i, f"f{i % 3}" if i % 2 else "hot", None if i % 11 == 0 else base + dt.timedelta(minutes=(i * 37) % 50), i % 4 == 0)
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, "row_id long, source_file string, timestamp timestamp, a boolean")
    return rows, df.withColumn("binary_label", F.col("a").cast("int")).drop("a")


def _expected(rows):
    order = sorted(rows, key=lambda r: (r[2] is None, r[2] or 0, r[0]) if r[2] else (True, dt.datetime.max, r[0]))
    n = len(order)
    n_test = round(n * 0.2)
    n_val = round((n - n_test) * 0.2)
    n_train = n - n_test - n_val
    return {r[0]: "train" if i < n_train else "val" if i < n_train + n_val else "test" for i, r in enumerate(order)}


def test_temporal_split(spark):
    rows, df = _frame(spark)
    assert {r["row_id"]: r["split"] for r in temporal_split(df, by_file=False).collect()} == _expected(rows)
    want = {}
    for f in {r[1] for r in rows}:
        want |= _expected([r for r in rows if r[1] == f])
    assert {r["row_id"]: r["split"] for r in temporal_split(df).collect()} == want


def test_random_split_keeps_label_shares_and_is_repeatable(spark):
    _, df = _frame(spark, 400)
    a = {r["row_id"]: (r["split"], r["binary_label"]) for r in stratified_split(df, seed=1).collect()}
    assert a == {r["row_id"]: (r["split"], r["binary_label"]) for r in stratified_split(df.repartition(3), seed=1).collect()}
    for label, n in ((1, 100), (0, 300)):
        own = [s for s, y in a.values() if y == label]
        assert own.count("test") == round(n * 0.2)
    with pytest.raises(ValueError):
        split_flows(df, CascadeConfig(split_strategy="other"))


def test_samples_have_the_exact_size(spark):
    _, df = _frame(spark, 300)
    first = {r["row_id"] for r in sample_rows(df, 77, seed=5).collect()}
    assert len(first) == 77
    assert first == {r["row_id"] for r in sample_rows(df.repartition(7), 77, seed=5).collect()}
    assert first != {r["row_id"] for r in sample_rows(df, 77, seed=6).collect()}
    assert sample_rows(df, 1000).count() == 300
    run = time_order(df)
    ids = sorted((r["_t"], r["row_id"]) for r in run.collect())
    picked = sorted((r["_t"], r["row_id"]) for r in consecutive_sample(run, 40).collect())
    start = ids.index(picked[0])
    assert picked == ids[start : start + 40]


def test_calibration_split_is_a_partition_of_validation(spark):
    _, df = _frame(spark, 1200)
    s = temporal_split(df)
    parts = calibration_split(s, CascadeConfig(min_calibration_benign=50)).collect()
    assert {r["row_id"] for r in parts} == {r["row_id"] for r in s.filter("split = 'val'").collect()}
    calib = [r for r in parts if r["part"] == "calib"]
    benign = [r for r in parts if r["binary_label"] == 0]
    assert all(r["binary_label"] == 0 for r in calib)
    assert len(calib) == max(50, min(round(len(benign) * 0.5), len(benign) - 50))
    with pytest.raises(ValueError):
        calibration_split(s, CascadeConfig(calibration_fraction=0.99))
    with pytest.raises(ValueError):
        calibration_split(s, CascadeConfig(min_calibration_benign=10_000))


def test_duplicates_are_found_without_shuffling_single_rows(spark, monkeypatch):
    from pyspark.sql import functions as F

    from flowsentry.operators import clean

    rows = spark.range(300).select(
        F.col("id").alias("row_id"), F.when(F.col("id") % 7 != 0, F.col("id") % 40).alias("a"), F.when(F.col("id") % 5 != 0, (F.col("id") % 3).cast("string")).alias("b")
    )
    want = {}
    for r in rows.collect():
        want.setdefault((r["a"], r["b"]), []).append(r["row_id"])
    for cells in (clean.CELLS, 1):
        monkeypatch.setattr(clean, "CELLS", cells)
        got = {(r["a"], r["b"]): r["row_id"] for r in clean.drop_duplicate_rows(rows).collect()}
        assert got == {k: min(v) for k, v in want.items()}


def test_nested_evidence(spark):
    from pyspark.sql import functions as F

    from flowsentry.functions.uploads import nested_evidence

    texts = ['{"b":null,"a":{"y":"","x":[1,null,"",{"q":null}]},"c":""}', "[1, null]", "broken", "", None, '"text"', '{"z":{"z":{"z":{"a":"","k":"\u00e9"}}}}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", nested_evidence(F.col("t")).alias("e"))
    got = {r["i"]: r["e"] for r in df.collect()}
    assert got == {0: '{"a":{"x":[1,{}]}}', 1: "[1, null]", 2: "broken", 3: "", 4: None, 5: '"text"', 6: '{"z":{"z":{"z":{"k":"\u00e9"}}}}'}
