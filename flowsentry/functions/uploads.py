"""Upload events, alert records and their small predicates."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from flowsentry.config import FALSE_SPELLINGS, TRUE_SPELLINGS
from flowsentry.functions.labels import is_attack_label

UNSAFE_RUN = r"[^A-Za-z0-9_.-]+"


def safe_part(c: Column) -> Column:
    """Text usable as one path segment."""
    return F.regexp_replace(F.trim(c), UNSAFE_RUN, "_")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stored_name(filename: Column, content_hash: Column) -> Column:
    """File name an upload is stored under: 12 hash characters, then the safe base name."""
    base = base_name(F.coalesce(F.nullif(filename, F.lit("")), F.lit("upload.pcap")))
    cleaned = F.coalesce(F.nullif(F.regexp_replace(base, UNSAFE_RUN, "_"), F.lit("")), F.lit("upload.pcap"))
    return F.concat(F.substring(content_hash, 1, 12), F.lit("_"), cleaned)


def capture_name(path: Column) -> Column:
    """Base name of a capture without the stored-name prefix, lower case."""
    return F.lower(F.trim(F.regexp_replace(base_name(path), "^[0-9a-fA-F]{12}_", "")))


def content_hash(payload: Column) -> Column:
    return F.sha2(payload, 256)


def reject_reason(
    tenant_id: Column,
    source_id: Column,
    start_offset: Column | None = None,
    end_offset: Column | None = None,
    payload_bytes: Column | None = None,
) -> Column:
    """Why an upload is refused; null for a valid one."""
    reason = F.when(F.lit(False), F.lit(""))
    if start_offset is not None and end_offset is not None:
        reason = reason.when((start_offset < 0) | (end_offset < 0), F.lit("offsets must be non-negative"))
        reason = reason.when(end_offset <= start_offset, F.lit("end_offset must be greater than start_offset"))
    for part in (tenant_id, source_id):
        reason = reason.when(
            F.coalesce(F.trim(part), F.lit("")) == "", F.lit("tenant_id/source_id cannot be empty")
        )
    if payload_bytes is not None:
        reason = reason.when(F.coalesce(payload_bytes, F.lit(0)) <= 0, F.lit("empty payload"))
    return reason


def raw_topic(tenant_id: Column) -> Column:
    return F.concat(F.lit("raw.tenant."), tenant_id)


def alert_topic(tenant_id: Column) -> Column:
    return F.concat(F.lit("alert.tenant."), tenant_id)


def tenant_of(tenant_id: Column, topic: Column) -> Column:
    """Tenant of a record: its own id, else the topic's third part, else a fixed name."""
    from_topic = F.regexp_extract(F.coalesce(topic, F.lit("")), r"^[^.]*\.[^.]*\.(.+)$", 1)
    return F.coalesce(
        F.nullif(tenant_id, F.lit("")), F.nullif(from_topic, F.lit("")), F.lit("unknown_tenant")
    )


def topic_matches(topic: Column, pattern: str) -> Column:
    """Topic glob: ``*`` is any text, everything else is literal, the whole name must match."""
    special = set("\\.[]{}()+-?^$|&#~")
    parts = ["".join("\\" + ch if ch in special else ch for ch in piece) for piece in pattern.split("*")]
    return topic.rlike("^" + ".*".join(parts) + "$")


def keyword_prediction(file_path: Column, force_attack: bool = False) -> Column:
    if force_attack:
        return F.lit("attack")
    return F.when(F.lower(F.coalesce(file_path, F.lit(""))).contains("attack"), F.lit("attack")).otherwise(
        F.lit("benign")
    )


def row_prediction(cascade_pred: Column, binary_label: Column, multiclass_label: Column) -> Column:
    """Decode an exported row: the first readable flag decides, else the label."""
    verdict = F.lit(None).cast("string")
    for flag in (binary_label, cascade_pred):
        text = F.trim(F.coalesce(flag.cast("string"), F.lit("")))
        verdict = (
            F.when(text.isin(*TRUE_SPELLINGS), F.lit("attack"))
            .when(text.isin(*FALSE_SPELLINGS), F.lit("benign"))
            .otherwise(verdict)
        )
    by_label = F.when(is_attack_label(multiclass_label), F.lit("attack")).otherwise(F.lit("benign"))
    return F.coalesce(verdict, by_label)


def first_score(*scores: Column) -> Column:
    """First score that parses as a number."""
    return F.coalesce(*[F.trim(s.cast("string")).try_cast("double") for s in scores])


def evidence_summary(evidence: Column) -> Column:
    """Evidence map as JSON with sorted keys and without empty values."""
    kept = F.map_filter(evidence, lambda _, v: v.isNotNull() & (v != ""))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept))))


def _sanitized(value):
    if isinstance(value, dict):
        return {k: _sanitized(v) for k, v in value.items() if v is not None and v != ""}
    if isinstance(value, list):
        return [_sanitized(v) for v in value if v is not None and v != ""]
    return value


def nested_evidence(evidence: Column) -> Column:
    """Evidence given as JSON text of any depth: keys sorted, nulls and empty texts left out at every depth.

    A value that is no object stays as it is; so does text that is not JSON. Null stays null.
    """

    @F.pandas_udf("string")
    def summary(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                value = json.loads(text)
            except (TypeError, ValueError, RecursionError):
                return text
            if not isinstance(value, dict):
                return text
            return json.dumps(_sanitized(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)

        return texts.map(one, na_action="ignore")

    return summary(evidence)
