"""Signature alerts: policy filter, matching to flows, and merging into other tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry.config import RATE_COLUMNS, SIGNATURE_PRED_NAMES, SIGNATURE_SCORE_NAMES
from flowsentry.functions import network
from flowsentry.functions.columns import col, first_existing, floor_bucket, flow_time, micros, to_double
from flowsentry.functions.signature_text import alert_time, capture_day
from flowsentry.session import materialize

ALERT_IDENTITY = ["pcap_name", "timestamp", "sid", "proto", "src_ip", "src_port", "dst_ip", "dst_port"]

EXACT_KEY = ["day", "proto", "conv"]
FALLBACK_KEY = ["day", "proto", "pair", "service"]


def policy_filter(alerts: DataFrame, sids: DataFrame) -> DataFrame:
    """Alerts whose signature id is on the policy list (a table with column ``sid``)."""
    return alerts.join(sids.select("sid").distinct(), "sid", "left_semi")


def top_signatures(alerts: DataFrame, n: int = 20) -> DataFrame:
    """The n most frequent (sid, message) pairs."""
    return (
        alerts.groupBy("sid", "message")
        .count()
        .orderBy(F.col("count").desc(), "sid", "message")
        .limit(n)
    )


def distinct_alerts(alerts: DataFrame, id_col: str = "alert_id") -> DataFrame:
    """First alert of each identity (capture, time, signature, protocol, endpoints)."""
    others = [c for c in alerts.columns if c not in ALERT_IDENTITY]
    first = F.min_by(F.struct(*[col(c) for c in others]), F.col(id_col)).alias("_first")
    return alerts.groupBy(*ALERT_IDENTITY).agg(first).select(
        *[F.col(c) if c in ALERT_IDENTITY else F.col(f"_first.`{c}`").alias(c) for c in alerts.columns]
    )


def _keys(src_ip: Column, src_port: Column, dst_ip: Column, dst_port: Column) -> list[Column]:
    a, b = network.address(src_ip), network.address(dst_ip)
    p, q = network.port(src_port), network.port(dst_port)
    return [
        network.conversation(a, p, b, q).alias("conv"),
        network.address_pair(a, b).alias("pair"),
        network.service_port(p, q).alias("service"),
    ]


def flow_keys(flows: DataFrame) -> DataFrame:
    """Matching keys of flows: capture day, protocol, direction-free conversation, time."""
    names = {
        what: first_existing(flows, options)
        for what, options in {
            "protocol": ["protocol", "Protocol"],
            "source_ip": ["source_ip", "Source IP", "src_ip"],
            "source_port": ["source_port", "Source Port", "src_port"],
            "destination_ip": ["destination_ip", "Destination IP", "dst_ip"],
            "destination_port": ["destination_port", "Destination Port", "dst_port"],
            "source_file": ["source_file", "sourcefile", "source"],
            "timestamp": ["timestamp", "Timestamp"],
        }.items()
    }
    absent = [what for what, name in names.items() if name is None]
    if absent:
        raise ValueError(f"flows lack required columns: {absent}")
    return flows.select(
        "row_id",
        capture_day(col(names["source_file"])).alias("day"),
        network.protocol(col(names["protocol"])).alias("proto"),
        *_keys(*[col(names[c]) for c in ("source_ip", "source_port", "destination_ip", "destination_port")]),
        micros(flow_time(flows, names["timestamp"])).alias("t"),
    )


def alert_keys(alerts: DataFrame) -> DataFrame:
    """Matching keys of alerts; alerts without a day or protocol are kept and match nothing."""
    return alerts.select(
        "alert_id",
        F.col("pcap_name").cast("string").alias("day"),
        network.protocol(F.col("proto")).alias("proto"),
        *_keys(F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port")),
        micros(alert_time(F.col("timestamp"), F.col("pcap_name"))).alias("t"),
    )


def _near(points: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """What a point of each (key, time bucket) needs to know about ``points`` near it.

    With buckets as wide as the band, any point of the same bucket is in reach, and of the two
    neighbour buckets only the last and the first time matter. So one row per (key, bucket)
    answers "is there a point within the band?" without forming a single pair. Points of one
    bucket combine on the map side, so a hot key does not reach one task.
    """
    bucket = floor_bucket(F.col("t"), width)
    none = F.lit(None).cast("bigint")

    def entry(shift: int, here: bool, prev: Column, nxt: Column) -> Column:
        return F.struct(
            (bucket + shift).alias("bucket"), F.lit(here).alias("here"), prev.alias("prev"), nxt.alias("next")
        )

    spread = F.array(
        entry(0, True, none, none), entry(1, False, F.col("t"), none), entry(-1, False, none, F.col("t"))
    )
    return (
        points.filter(F.col("t").isNotNull())
        .select(*keys, F.inline(spread))
        .groupBy(*keys, "bucket")
        .agg(F.bool_or("here").alias("here"), F.max("prev").alias("prev_t"), F.min("next").alias("next_t"))
    )


def _mark_near(
    rows: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    width: int,
    out: str,
) -> DataFrame:
    """Add boolean ``out``: does ``points`` hold the row's key within the band of its time?"""
    near = _near(points, keys, width)
    joined = rows.withColumn("bucket", floor_bucket(F.col("t"), width)).join(near, [*keys, "bucket"], "left")
    hit = (
        F.col("here")
        | F.coalesce(F.col("prev_t") >= F.col("t") - width, F.lit(False))
        | F.coalesce(F.col("next_t") <= F.col("t") + width, F.lit(False))
    )
    return joined.select(*rows.columns, F.coalesce(hit, F.lit(False)).alias(out))


def _mark_key(rows: DataFrame, points: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """Add boolean ``out``: does ``points`` hold the row's key at all?"""
    known = points.select(*keys).distinct().withColumn("_known", F.lit(True))
    return rows.join(known, list(keys), "left").select(
        *rows.columns, F.coalesce("_known", F.lit(False)).alias(out)
    )


def alert_kinds(flows: DataFrame, alerts: DataFrame) -> DataFrame:
    """Which key each alert may use: exact when some flow shares its conversation (whatever the
    time), else fallback on address pair and service port, else none. Takes keyed frames."""
    marked = _mark_key(alerts, flows.filter(_matchable()), EXACT_KEY, "_has_exact")
    kind = (
        F.when(F.col("_has_exact"), F.lit("exact"))
        .when(_matchable() & F.col("pair").isNotNull() & F.col("service").isNotNull(), F.lit("fallback"))
        .otherwise(F.lit("none"))
    )
    return marked.withColumn("kind", kind).drop("_has_exact")


def _matchable() -> Column:
    return F.col("day").isNotNull() & F.col("proto").isNotNull()


def _band(window_seconds: float) -> int:
    return max(1, int(window_seconds * 1_000_000))


def _settled_alerts(flows: DataFrame, alerts: DataFrame, ignore_time: bool) -> tuple[DataFrame, dict]:
    """Keyed alerts with their kind, written once because several lookups read them, and the
    number of timed and timeless alerts of each kind."""
    a = alert_kinds(flows, alert_keys(alerts))
    if ignore_time:
        a = a.withColumn("t", F.lit(None).cast("bigint"))
    a = materialize(a, "alerts")
    sizes = a.groupBy("kind").agg(F.count("t").alias("timed"), F.count_if(F.col("t").isNull()).alias("timeless"))
    return a, {r["kind"]: (r["timed"], r["timeless"]) for r in sizes.collect()}


def match_flows(
    flows: DataFrame, alerts: DataFrame, window_seconds: float = 2.0, ignore_time: bool = False
) -> DataFrame:
    """Per flow: is it hit by an alert? Columns row_id, signature_pred, signature_score.

    An alert hits every flow of its conversation, in either direction, within the time window
    (inclusive). Alerts without any flow of their conversation fall back to address pair and
    service port. An alert without a time hits all its candidates.
    """
    f = flow_keys(flows)
    a, sizes = _settled_alerts(f, alerts, ignore_time)
    width = _band(window_seconds)
    hit = F.lit(False)
    for kind, keys in (("exact", EXACT_KEY), ("fallback", FALLBACK_KEY)):
        timed, timeless = sizes.get(kind, (0, 0))
        of_kind = a.filter(F.col("kind") == kind)
        if timed:
            f = _mark_near(f, of_kind, keys, width, f"{kind}_near")
            hit = hit | F.col(f"{kind}_near")
        if timeless:
            f = _mark_key(f, of_kind.filter(F.col("t").isNull()), keys, f"{kind}_any")
            hit = hit | F.col(f"{kind}_any")
    pred = F.coalesce(_matchable() & hit, F.lit(False)).cast("int")
    return f.select("row_id", pred.alias("signature_pred"), pred.cast("double").alias("signature_score"))


def match_alerts(
    flows: DataFrame, alerts: DataFrame, window_seconds: float = 2.0, ignore_time: bool = False
) -> DataFrame:
    """Per alert: the kind of key it used and whether it hit a flow (alert_id, kind, hit)."""
    f = flow_keys(flows).filter(_matchable())
    a, sizes = _settled_alerts(f, alerts, ignore_time)
    width = _band(window_seconds)
    timeless = F.col("t").isNull()
    # A timeless alert of exact kind has a candidate by definition.
    hit = timeless & (F.col("kind") == "exact")
    for kind, keys in (("exact", EXACT_KEY), ("fallback", FALLBACK_KEY)):
        timed_n, timeless_n = sizes.get(kind, (0, 0))
        of_kind = a.filter(F.col("kind") == kind).select(*keys).distinct()
        # Only flows that share a key with some alert matter; the rest goes before grouping.
        near = f.join(of_kind, keys, "left_semi")
        if timed_n:
            a = _mark_near(a, near, keys, width, f"{kind}_near")
            hit = hit | (~timeless & (F.col("kind") == kind) & F.col(f"{kind}_near"))
        if timeless_n and kind == "fallback":
            a = _mark_key(a, near, keys, "fallback_any")
            hit = hit | (timeless & (F.col("kind") == kind) & F.col("fallback_any"))
    return a.select("alert_id", "kind", hit.alias("hit"))


def hit_counts(alert_hits: DataFrame) -> DataFrame:
    return alert_hits.agg(
        F.count_if(F.col("hit") & (F.col("kind") == "exact")).alias("exact_hits"),
        F.count_if(F.col("hit") & (F.col("kind") == "fallback")).alias("fallback_hits"),
        F.count("*").alias("alerts"),
    )


def read_signature_table(df: DataFrame) -> DataFrame:
    """Normalise a prediction table: row_id, snort_pred, snort_score and rule flags if present."""
    row_id = first_existing(df, ["row_id"])
    pred = first_existing(df, SIGNATURE_PRED_NAMES)
    score = first_existing(df, SIGNATURE_SCORE_NAMES)
    if row_id is None or pred is None:
        raise ValueError("a signature table needs row_id and a prediction column")
    zero = F.lit(0.0)
    pred_value = F.coalesce(to_double(col(pred)), zero).cast("int")
    score_value = F.coalesce(to_double(col(score)), zero) if score else pred_value.cast("double")
    rates = [F.coalesce(to_double(col(c)), zero).cast("int").alias(c) for c in RATE_COLUMNS if c in df.columns]
    return df.select(
        to_double(col(row_id)).cast("bigint").alias("row_id"),
        pred_value.alias("snort_pred"),
        score_value.alias("snort_score"),
        *rates,
    ).filter(F.col("row_id").isNotNull())


def assert_unique(table: DataFrame, key: str = "row_id") -> None:
    """Refuse a lookup table that would multiply rows."""
    repeated = table.groupBy(key).count().filter("count > 1").limit(1).count()
    if repeated:
        raise ValueError(f"{key} repeats in the table to be joined")


def merge_signatures(base: DataFrame, table: DataFrame) -> DataFrame:
    """Left join of a normalised signature table; rows without a match get zeros and matched 0."""
    rates = [c for c in RATE_COLUMNS if c in table.columns]
    fill = {"snort_pred": 0, "snort_score": 0.0, "matched": 0, **{c: 0 for c in rates}}
    slim = table.select("row_id", "snort_pred", "snort_score", *rates, F.lit(1).alias("matched"))
    return base.drop("snort_pred", "snort_score", "matched", *rates).join(slim, "row_id", "left").fillna(fill)


def coverage(merged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows the signature table covers."""
    return merged.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.sum("matched").alias("matched_rows"),
        (F.sum("matched") / F.greatest(F.count("*"), F.lit(1))).alias("coverage_frac"),
    )


def or_merge(rules: DataFrame, table: DataFrame) -> DataFrame:
    """Add signature fires to a rule table: OR of flags, larger score, flag rate_X, letter X."""
    slim = table.select("row_id", "snort_pred", "snort_score")
    joined = rules.join(slim, "row_id", "left").fillna({"snort_pred": 0, "snort_score": 0.0})
    fired = F.col("snort_pred") == 1
    kept = [c for c in rules.columns if c not in ("signature_pred", "signature_score", "rule_fired")]
    return joined.select(
        *kept,
        ((F.col("signature_pred") == 1) | fired).cast("int").alias("signature_pred"),
        F.greatest("signature_score", "snort_score").alias("signature_score"),
        F.concat(F.coalesce("rule_fired", F.lit("")), F.when(fired, F.lit("X")).otherwise(F.lit(""))).alias(
            "rule_fired"
        ),
        F.col("snort_pred").alias("rate_X"),
    )


def attach_rates(base: DataFrame, rules: DataFrame) -> DataFrame:
    """Left join of rule flags by row_id; a missing row did not fire."""
    rates = [c for c in [*RATE_COLUMNS, "rate_X"] if c in rules.columns]
    slim = rules.select("row_id", *[F.coalesce(to_double(col(c)), F.lit(0.0)).cast("int").alias(c) for c in rates])
    return base.drop(*rates).join(slim, "row_id", "left").fillna({c: 0 for c in rates})


def attach_promoted(base: DataFrame, hits: DataFrame) -> DataFrame:
    """Left join of promoted rule hits by row_id; a missing row did not fire."""
    return base.join(hits, "row_id", "left").fillna({"rate_hit": 0, "rate_hit_which": ""})
