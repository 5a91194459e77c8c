"""Thresholds as one document: defaults, validated overrides, the latest of a compacted topic."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Thresholds:
    """Settings of the flow and DNS detections; every one can be overridden by a document."""

    beacon_min_conns: int = 6
    beacon_score: float = 0.8
    autocorr_score: float = 0.7
    strobe_min_conns: int = 90
    exfil_bytes: float = 50e6
    low_exfil_bytes: float = 5e6
    long_connection_seconds: float = 3600.0
    cumulative_seconds: float = 300.0
    rare_history: int = 15
    dns_min_queries: int = 50
    dns_min_subdomains: int = 30
    fqdn_min_ips: int = 2


def merged(now: Thresholds, document: str | dict | None) -> Thresholds:
    """``now`` with a document's values: unknown keys are dropped, values of a wrong type or sign ignored."""
    try:
        doc = json.loads(document) if isinstance(document, str) else document
    except ValueError:
        return now
    if not isinstance(doc, dict):
        return now
    good = {}
    for f in fields(Thresholds):
        v = doc.get(f.name)
        if isinstance(v, (int, float)) and not isinstance(v, bool) and v > 0 and (isinstance(getattr(now, f.name), float) or float(v).is_integer()):
            good[f.name] = type(getattr(now, f.name))(v)
    return replace(now, **good)


def latest(topic: DataFrame, key: str, order: str = "offset") -> Thresholds:
    """Thresholds by the last document of a key in a compacted topic (key, value, offset)."""
    row = topic.filter(F.col("key") == key).agg(F.max_by("value", order).alias("v")).first()
    return merged(Thresholds(), row["v"] if row else None)
