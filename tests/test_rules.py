import datetime as dt

from pyspark.sql import functions as F

from flowsentry.config import RateRules
from flowsentry.operators.rules import promoted_hits, rule_flags, signature_table, with_windowed_rules

BASE = dt.datetime(2017, 7, 3, 12, 0, 0)


def _flow(i, src, port, second, packets=2.0, duration=100.0):
    return (i, src, port, BASE + dt.timedelta(seconds=second), packets, 0.0, duration)


def _frame(spark, rows):
    return spark.createDataFrame(
        rows,
        "row_id long, source_ip string, destination_port int, timestamp timestamp, total_fwd_packets double, "
        "total_backward_packets double, flow_duration double",
    )


def test_default_windows(spark):
    rows = [_flow(i, "scan", 1000 + i, 0.5) for i in range(200)]
    rows += [_flow(1000 + i, "almost", 1000 + i, 0.5) for i in range(199)]
    # 200 ports, but over two tumbling windows
    rows += [_flow(2000 + i, "slow", 1000 + i, 1.0 + (i % 2) * 1.5) for i in range(200)]
    # a heavy flow of the scanner is not part of the scan
    rows += [_flow(3000, "scan", 5, 0.5, packets=50.0)]
    rows += [_flow(4000 + i, "brute", 22, 0.1 * i) for i in range(10)]
    rows += [_flow(5000 + i, "gentle", 22, 0.1 * i) for i in range(9)]
    rows += [_flow(6000, None, 22, 0.1)]
    got = with_windowed_rules(_frame(spark, rows)).select("row_id", "_P", "_B").collect()
    assert {r["row_id"] for r in got if r["_P"]} == set(range(200))
    assert {r["row_id"] for r in got if r["_B"]} == set(range(4000, 4010))
    assert len(got) == len(rows)


def test_windows_of_different_length(spark):
    rows = [_flow(i, "a", 22, i) for i in range(5)] + [_flow(10 + i, "a", 100 + i, i) for i in range(4)]
    cfg = RateRules(portscan_window_s=10, portscan_min_ports=5, bruteforce_window_s=60, bruteforce_min_attempts=5)
    got = with_windowed_rules(_frame(spark, rows), cfg).collect()
    assert all(r["_P"] for r in got)
    assert {r["row_id"] for r in got if r["_B"]} == set(range(5))


def test_row_rules_on_text_and_missing_columns(spark):
    df = spark.createDataFrame(
        [(1, "25", "50000", "bad"), (2, "5", "50000", "0"), (3, "30", "Infinity", "4")],
        "row_id long, total_fwd_packets string, flow_packets_s string, syn_flag_count string",
    )
    got = {r["row_id"]: r for r in signature_table(df).collect()}
    assert got[1]["rule_fired"] == "V" and got[2]["rule_fired"] == "" and got[3]["rule_fired"] == "V"
    assert all(r["signature_pred"] == 0 and r["signature_score"] == 0.0 for r in got.values())
    fast = {r["row_id"]: r for r in signature_table(df, RateRules(fast_path_letters=("V", "S"))).collect()}
    assert [fast[i]["signature_pred"] for i in (1, 2, 3)] == [1, 0, 1]


def test_slow_http_and_flags(spark):
    df = spark.createDataFrame(
        [(1, 80.0, 6.1e7, 5.0, 10.0, 0.0, 0.0), (2, 22.0, 6.1e7, 5.0, 10.0, 3.0, 5.0)],
        "row_id long, destination_port double, flow_duration double, total_fwd_packets double, flow_bytes_s double, "
        "syn_flag_count double, rst_flag_count double",
    )
    got = {r["row_id"]: (r["rate_L"], r["rate_S"], r["rate_R"]) for r in rule_flags(df).collect()}
    assert got == {1: (1, 0, 0), 2: (0, 1, 1)}


def test_promoted_letters_are_sorted(spark):
    df = spark.createDataFrame([(1, 1, 0, 1), (2, 0, 0, 0)], "row_id long, rate_V int, rate_S int, rate_P int")
    got = {r["row_id"]: (r["rate_hit"], r["rate_hit_which"]) for r in promoted_hits(df, ["rate_V", "rate_S", "rate_P"]).collect()}
    assert got == {1: (1, "PV"), 2: (0, "")}
    assert df.filter(F.col("rate_V") == 1).count() == 1
