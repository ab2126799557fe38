import datetime as dt
import random

import pytest

from flowsentry.functions.signature_text import parse_alert_lines
from flowsentry.operators import signature as S

DAY = "Monday-WorkingHours"
BASE = dt.datetime(2017, 7, 3, 12, 0, 0)


def _flows(spark, rows):
    schema = (
        "row_id long, source_file string, protocol string, source_ip string, source_port int, destination_ip string, "
        "destination_port int, timestamp timestamp"
    )
    return spark.createDataFrame([(r[0], f"{DAY}.pcap_ISCX.csv", *r[1:]) for r in rows], schema)


def _alerts(spark, rows):
    schema = "alert_id long, pcap_name string, proto string, src_ip string, src_port int, dst_ip string, dst_port int, timestamp string"
    return spark.createDataFrame([(r[0], DAY, *r[1:]) for r in rows], schema)


def _text(t):
    return "" if t is None else t.strftime("%m/%d-%H:%M:%S.%f")


def _pred(df):
    return {r["row_id"]: r["signature_pred"] for r in df.collect()}


def test_lines(spark):
    lines = [
        '07/03-18:55:58.598308 [**] [1:1000009:1] "TEST ANY IP" [**] [Priority: 0] {TCP} 8.8.8.8:80 -> 192.168.1.2:50000',
        '07/03-18:55:58.598308 [**] [1:5:2] "ping" [**] {ICMP} 8.8.8.8 -> 192.168.1.2',
        "07/03-18:55:58 [**] no ids [**] {TCP} 1.1.1.1:1 -> 2.2.2.2:2",
        '07/03-18:55:58 [**] [1:5:2] "no endpoints" [**] {TCP} nothing here',
        "",
        "garbage",
    ]
    rows = parse_alert_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r["sid"], r["message"], r["priority"], r["proto"], r["src_port"], r["dst_port"]) for r in rows] == [
        (1000009, "TEST ANY IP", 0, "TCP", 80, 50000),
        (5, "ping", None, "ICMP", None, None),
    ]


def test_band_is_inclusive_and_direction_free(spark):
    at = lambda s: BASE + dt.timedelta(seconds=s)
    flows = _flows(
        spark,
        [
            (1, "6", "a", 10, "b", 80, at(0)),
            (2, "6", "a", 10, "b", 80, at(2)),
            (3, "6", "b", 80, "a", 10, at(-2)),
            (4, "6", "a", 10, "b", 80, at(2.000001)),
            (5, "6", "a", 10, "b", 80, None),
            (6, "17", "a", 10, "b", 80, at(0)),
        ],
    )
    alerts = _alerts(spark, [(1, "TCP", "a", 10, "b", 80, _text(at(0)))])
    assert _pred(S.match_flows(flows, alerts)) == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0}
    assert _pred(S.match_flows(flows, alerts, ignore_time=True)) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 0}
    timeless = _alerts(spark, [(1, "6", "a", 10, "b", 80, "")])
    assert _pred(S.match_flows(flows, timeless)) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 0}


def test_fallback_only_without_any_exact_candidate(spark):
    far = BASE + dt.timedelta(hours=1)
    flows = _flows(
        spark,
        [
            (1, "6", "a", 5010, "b", 80, far),  # exact candidate, but out of the band
            (2, "6", "a", 5011, "b", 80, BASE),  # would match by pair and service port
        ],
    )
    exact = _alerts(spark, [(1, "6", "a", 5010, "b", 80, _text(BASE))])
    assert _pred(S.match_flows(flows, exact)) == {1: 0, 2: 0}
    free = _alerts(spark, [(1, "6", "a", 5099, "b", 80, _text(BASE))])
    assert _pred(S.match_flows(flows, free)) == {1: 0, 2: 1}
    hits = S.match_alerts(flows, free).first()
    assert (hits["kind"], hits["hit"]) == ("fallback", True)


def test_missing_ports_equal_missing_ports(spark):
    flows = _flows(spark, [(1, "1", "a", None, "b", None, BASE), (2, "1", "a", 7, "b", None, BASE)])
    alerts = _alerts(spark, [(1, "ICMP", "b", None, "a", None, _text(BASE))])
    assert _pred(S.match_flows(flows, alerts)) == {1: 1, 2: 0}


def _brute(flows, alerts, band=2.0):
    def service(p, q):
        ports = [x for x in (p, q) if x is not None]
        known = [x for x in ports if x <= 1024]
        return min(known) if known else min(ports) if ports else None

    hit_flows, hit_alerts = set(), {}
    for a in alerts:
        aid, proto, s, sp, d, dp, t = a
        exact = [f for f in flows if f[1] == proto and ((f[2:6] == (s, sp, d, dp)) or (f[2:6] == (d, dp, s, sp)))]
        found, kind = exact, "exact"
        if not exact:
            kind = "none"
            if s is not None and d is not None and service(sp, dp) is not None:
                kind = "fallback"
                found = [
                    f
                    for f in flows
                    if f[1] == proto and {f[2], f[4]} == {s, d} and service(f[3], f[5]) == service(sp, dp)
                ]
        ok = [f for f in found if t is None or (f[6] is not None and abs((f[6] - t).total_seconds()) <= band)]
        hit_flows |= {f[0] for f in ok}
        hit_alerts[aid] = (kind, bool(ok))
    return hit_flows, hit_alerts


def test_random_against_brute_force_with_a_hot_conversation(spark):
    rng = random.Random(11)

    def end(hot):
        return ("h1", 80) if hot else (rng.choice(["a", "b", "c"]), rng.choice([80, 443, 2000, 3000, None]))

    def record(i, hot):
        (s, sp), (d, dp) = (("h0", 5000), ("h1", 80)) if hot else (end(False), end(False))
        if rng.random() < 0.5:
            s, sp, d, dp = d, dp, s, sp
        t = None if rng.random() < 0.05 else BASE + dt.timedelta(milliseconds=rng.randrange(60_000))
        return (i, rng.choice(["TCP", "UDP"]), s, sp, d, dp, t)

    flows = [record(i, i % 3 == 0) for i in range(400)]
    alerts = [record(i, i % 3 == 0) for i in range(120)]
    want_flows, want_alerts = _brute(flows, alerts)
    f = _flows(spark, flows)
    a = _alerts(spark, [(*r[:6], _text(r[6])) for r in alerts])
    assert {k for k, v in _pred(S.match_flows(f, a)).items() if v} == want_flows
    assert {r["alert_id"]: (r["kind"], r["hit"]) for r in S.match_alerts(f, a).collect()} == want_alerts


def test_tables_to_join_must_be_unique(spark):
    table = spark.createDataFrame([(1, 1), (1, 0)], "row_id long, pred int")
    with pytest.raises(ValueError):
        S.assert_unique(S.read_signature_table(table))
    with pytest.raises(ValueError):
        S.read_signature_table(table.drop("pred"))
    with pytest.raises(ValueError):
        S.flow_keys(table)


def test_alert_lines_are_cut_once(spark):
    """Filters and fields use the parts of a line as they are, instead of cutting the line again."""
    from flowsentry.functions.signature_text import parse_alert_lines

    lines = spark.createDataFrame([(1, '07/03-10:00:00.000001 [**] [1:491:2] "x" [**] [Priority: 2] {TCP} 10.0.0.1:80 -> 10.0.0.2:81')], "i int, value string")
    parsed = parse_alert_lines(lines)
    assert parsed.drop("value").first()[:] == (1, "07/03-10:00:00.000001", 1, 491, 2, "x", 2, "TCP", "10.0.0.1", 80, "10.0.0.2", 81)
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("concat_ws(") == 1
