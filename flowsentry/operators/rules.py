"""The six rate rules and the signature table they produce."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry.config import RATE_COLUMNS, RULE_LETTERS, RateRules
from flowsentry.functions.columns import floor_bucket, flow_time, micros, number


def total_packets(df: DataFrame) -> Column:
    return number(df, "total_fwd_packets") + number(df, "total_backward_packets")


def port_number(df: DataFrame, name: str = "destination_port") -> Column:
    return number(df, name, -1).try_cast("int")


def volumetric(df: DataFrame, cfg: RateRules) -> Column:
    """V: many packets at an extreme packet or byte rate."""
    fast = (number(df, "flow_packets_s") > cfg.volumetric_packets_s) | (
        number(df, "flow_bytes_s") > cfg.volumetric_bytes_s
    )
    return (total_packets(df) >= cfg.volumetric_min_packets) & fast


def slow_http(df: DataFrame, cfg: RateRules) -> Column:
    """L: a web port held open for long with hardly any traffic."""
    return (
        F.coalesce(port_number(df).isin(*cfg.slowhttp_ports), F.lit(False))
        & (number(df, "flow_duration") > cfg.slowhttp_duration_us)
        & (total_packets(df) < cfg.slowhttp_max_packets)
        & (number(df, "flow_bytes_s") < cfg.slowhttp_max_bytes_s)
    )


def syn_flood(df: DataFrame, cfg: RateRules) -> Column:
    """S: several SYN flags in a short flow."""
    return (number(df, "syn_flag_count") >= cfg.syn_min) & (total_packets(df) <= cfg.syn_max_packets)


def rst_anomaly(df: DataFrame, cfg: RateRules) -> Column:
    """R: several RST flags in a short flow."""
    return (number(df, "rst_flag_count") >= cfg.rst_min) & (total_packets(df) <= cfg.rst_max_packets)


def _micro_flow(df: DataFrame, cfg: RateRules) -> Column:
    return (total_packets(df) <= cfg.portscan_max_packets) & (
        number(df, "flow_duration") <= cfg.portscan_max_duration_us
    )


def _auth_port(df: DataFrame, cfg: RateRules) -> Column:
    return F.coalesce(port_number(df).isin(*cfg.bruteforce_ports), F.lit(False))


def _window_inputs(df: DataFrame, window_s: float, cfg: RateRules) -> DataFrame:
    return df.select(
        "*",
        floor_bucket(micros(flow_time(df)), int(window_s * 1_000_000)).alias("_window"),
        _micro_flow(df, cfg).alias("_micro"),
        _auth_port(df, cfg).alias("_auth"),
    )


def _busy_sources(windowed: DataFrame, cfg: RateRules) -> DataFrame:
    """Per source and window: does it scan ports, and which auth ports does it hammer?

    Counting per (source, window, port) first combines on the map side, so a source that sends
    a third of all flows shuffles at most one row per port and task.
    """
    per_port = (
        windowed.filter(F.col("source_ip").isNotNull() & F.col("_window").isNotNull())
        .filter(F.col("_micro") | F.col("_auth"))
        .groupBy("source_ip", "_window", "destination_port")
        .agg(F.bool_or("_micro").alias("_probed"), F.count_if("_auth").alias("_attempts"))
        .filter(F.col("destination_port").isNotNull())
    )
    hammered = F.when(F.col("_attempts") >= cfg.bruteforce_min_attempts, F.col("destination_port"))
    return (
        per_port.groupBy("source_ip", "_window")
        .agg(
            F.count_if("_probed").alias("_ports"),
            # Bounded: only ports from the fixed auth list can get here.
            F.collect_set(hammered).alias("_hammered"),
        )
        .select(
            "source_ip",
            "_window",
            (F.col("_ports") >= cfg.portscan_min_ports).alias("_scans"),
            "_hammered",
        )
        .filter(F.col("_scans") | (F.size("_hammered") > 0))
    )


def with_windowed_rules(df: DataFrame, cfg: RateRules = RateRules()) -> DataFrame:
    """Add boolean ``_P`` (port scan) and ``_B`` (brute force)."""
    if "source_ip" not in df.columns or "destination_port" not in df.columns:
        return df.select("*", F.lit(False).alias("_P"), F.lit(False).alias("_B"))
    columns = df.columns

    def flagged(frame: DataFrame, window_s: float) -> DataFrame:
        windowed = _window_inputs(frame, window_s, cfg)
        busy = _busy_sources(windowed, cfg)
        # Only flows that can count as a probe or an attempt meet the busy sources; the other wide
        # rows pass by as a union and are not shuffled.
        concerned = (F.col("_micro") | F.col("_auth")) & F.col("source_ip").isNotNull() & F.col("_window").isNotNull()
        concerned = F.coalesce(concerned, F.lit(False))
        # Few (source, window) pairs are busy: AQE broadcasts them when their measured size
        # allows, and splits a skewed source otherwise.
        met = windowed.filter(concerned).join(busy, ["source_ip", "_window"], "left").select(*windowed.columns, "_scans", "_hammered")
        none = {c: F.lit(None).cast(busy.schema[c].dataType) for c in ("_scans", "_hammered")}
        return met.unionByName(windowed.filter(~concerned).withColumns(none))

    scans = F.col("_micro") & F.coalesce(F.col("_scans"), F.lit(False))
    hammers = F.col("_auth") & F.coalesce(
        F.array_contains("_hammered", F.col("destination_port")), F.lit(False)
    )
    if cfg.portscan_window_s == cfg.bruteforce_window_s:
        both = flagged(df, cfg.portscan_window_s)
        return both.select(*columns, scans.alias("_P"), hammers.alias("_B"))
    with_p = flagged(df, cfg.portscan_window_s).select(*columns, scans.alias("_P"))
    return flagged(with_p, cfg.bruteforce_window_s).select(*columns, "_P", hammers.alias("_B"))


def rule_flags(df: DataFrame, cfg: RateRules = RateRules()) -> DataFrame:
    """Add one 0/1 column per rule: rate_V, rate_L, rate_S, rate_R, rate_P, rate_B."""
    windowed = with_windowed_rules(df, cfg)
    rules = {
        "V": volumetric(df, cfg),
        "L": slow_http(df, cfg),
        "S": syn_flood(df, cfg),
        "R": rst_anomaly(df, cfg),
        "P": F.col("_P"),
        "B": F.col("_B"),
    }
    return windowed.select(
        *[c for c in windowed.columns if c not in ("_P", "_B")],
        *[rules[x].cast("int").alias(f"rate_{x}") for x in RULE_LETTERS],
    )


def fired_letters(letters=tuple(RULE_LETTERS)) -> Column:
    return F.concat(*[F.when(F.col(f"rate_{x}") == 1, F.lit(x)).otherwise(F.lit("")) for x in letters])


def fired_count(columns=tuple(RATE_COLUMNS)) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) for c in columns])


def signature_table(df: DataFrame, cfg: RateRules = RateRules()) -> DataFrame:
    """Prediction table keyed by row_id: fast-path flag and score, letters, rule flags."""
    flags = rule_flags(df, cfg)
    fast = [f"rate_{x}" for x in cfg.fast_path_letters]
    count = fired_count(fast) if fast else F.lit(0)
    return flags.select(
        "row_id",
        (count > 0).cast("int").alias("signature_pred"),
        count.cast("double").alias("signature_score"),
        fired_letters().alias("rule_fired"),
        *RATE_COLUMNS,
    )


def rule_totals(flags: DataFrame) -> DataFrame:
    """Fires and share of rows per rule, in rule order."""
    sums = flags.agg(F.count("*").alias("rows"), *[F.sum(c).alias(c) for c in RATE_COLUMNS])
    entries = [
        F.struct(F.lit(x).alias("rule"), F.col(f"rate_{x}").cast("bigint").alias("fires"))
        for x in RULE_LETTERS
    ]
    return sums.select("rows", F.inline(F.array(*entries))).select(
        "rule", "fires", "rows", F.try_divide(F.col("fires"), F.col("rows")).alias("fraction")
    )


def ablation_scores(flags: DataFrame, signature_col: str = "signature_pred") -> DataFrame:
    """Scores of the rule-only detectors: V|S|P, any rule, number of rules, any rule or signature."""
    any_rule = (fired_count() > 0).cast("double")
    return flags.select(
        "*",
        F.greatest("rate_V", "rate_S", "rate_P").cast("double").alias("score_vsp"),
        any_rule.alias("score_any"),
        fired_count().cast("double").alias("score_count"),
        F.greatest(any_rule, (F.col(signature_col) == 1).cast("double")).alias("score_any_or_signature"),
    )


def promoted_hits(table: DataFrame, promoted: list[str]) -> DataFrame:
    """One indicator over the promoted rule columns and the sorted letters that fired."""
    if not promoted:
        raise ValueError("name at least one rate column to promote")
    letters = F.array_compact(
        F.array(*[F.when(F.col(c).cast("int") == 1, F.lit(c.removeprefix("rate_"))) for c in promoted])
    )
    hit = reduce(lambda a, b: a | b, [F.coalesce(F.col(c).cast("int") == 1, F.lit(False)) for c in promoted])
    return table.select(
        "row_id", hit.cast("int").alias("rate_hit"), F.array_join(F.array_sort(letters), "").alias("rate_hit_which")
    )
