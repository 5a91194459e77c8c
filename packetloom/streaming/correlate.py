"""Correlation of findings as a stream: incidents and corroborations over a trailing window, each told once.

A finding counts from the time it arrived. Entities are evaluated at ticks, as a service that looks at its state
every so often would do; between two ticks nothing can be told, so state need not be finer: per slot between ticks,
detector and category it keeps how many findings came, the strongest, and the first and last time. A slot is exact,
as the window is a whole number of ticks and its start excluded: it is in the window as a whole or not at all.

What an entity has can only call for something new when findings arrive, when findings leave the window (another
reason may come to the fore), or when the window's number changes (everything may be told anew). Timers stand at
these ticks alone, not at every tick. They fire when the watermark has passed them, so all rows up to the tick are
there, and the result does not depend on how rows fall into batches. When an entity's last finding has aged and the
window in which it was told something has ended, its state is gone.

Risk, tactics, chains and corroborations are those of operators.findings, and so are their fixed values.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.findings import CORRELATED, FAMILIES, FAMILY_CAPS, ML_DETECTORS, OTHER_CAP, STAGES

TICK, WINDOW = 30, 86_400
TOLD = (
    "tenant string, src_ip string, finding_id string, detector_id string, reason string, category string, severity int, risk double, n_findings long, "
    "n_tactics int, detectors array<string>, first_seen timestamp, last_seen timestamp, evaluated_at timestamp"
)
NAMES = [c.split()[0] for c in TOLD.split(", ")]


@dataclass(frozen=True)
class Rules:
    risk: float = 12.0
    min_tactics: int = 2
    half_life: float = 3600.0
    ml: tuple[str, ...] = ML_DETECTORS


@dataclass
class Slot:
    """Findings of one detector and category between two ticks; times in microseconds."""

    n: int
    severity: float
    at: int  # of the strongest, the latest of equals
    first: int
    last: int

    def add(self, severity: float, at: int) -> None:
        self.n += 1
        self.severity, self.at = max((self.severity, self.at), (severity, at))
        self.first, self.last = min(self.first, at), max(self.last, at)


def decide(slots: dict[tuple[int, str, str], Slot], now: float, rules: Rules) -> list[dict]:
    """What the slots of one entity's window call for at ``now`` (seconds): an incident at most, and corroborations."""
    if not slots:
        return []
    best: dict[str, tuple[float, int]] = {}
    behaviour: dict[str, dict[str, float]] = defaultdict(dict)
    stages, start = set(), None
    for (_, detector, category), s in slots.items():
        best[detector] = max(best.get(detector, (-math.inf, 0)), (s.severity, s.at))
        stage = STAGES.get(category)
        if stage is not None:
            stages.add(stage)
            start = min(start or (s.first, stage), (s.first, stage))
        if category and detector:
            behaviour[category][detector] = max(behaviour[category].get(detector, -math.inf), s.severity)
    per: dict[str, float] = defaultdict(float)
    for detector, (severity, at) in best.items():
        per[FAMILIES.get(detector, detector)] += severity * 0.5 ** (max(0.0, now - at / 1e6) / rules.half_life)
    risk = math.floor(sum(min(v, FAMILY_CAPS.get(k, OTHER_CAP)) for k, v in per.items()) * 1000 + 0.5) / 1000
    n = sum(s.n for s in slots.values())
    # stages rise to a new height after the first if any is above the first
    chain, tactics = bool(stages) and max(stages) > start[1], len(stages)
    reason = "kill-chain" if chain and tactics >= rules.min_tactics else "multi-tactic" if tactics >= rules.min_tactics and n >= 2 else "risk-threshold" if risk >= rules.risk else None
    most = int(max(s.severity for s in slots.values()))
    span = {"first_seen": min(s.first for s in slots.values()), "last_seen": max(s.last for s in slots.values()), "risk": risk, "n_findings": n, "n_tactics": tactics}
    out = []
    if reason:
        out.append({"told": reason, "detector_id": "correlation_incident", "reason": reason, "category": "incident", "severity": max(1, min(10, most + (2 if chain else 1))), "detectors": sorted(best), **span})
    for category, found in sorted(behaviour.items()):
        if any(d in rules.ml for d in found) and any(d not in rules.ml for d in found):
            out.append({"told": f"corrob:{category}", "detector_id": "correlation_corroboration", "reason": "corroboration", "category": category, "severity": min(10, int(max(found.values())) + 2), "detectors": sorted(found), **span})
    return out


class Correlator(StatefulProcessor):
    """See the module. Rows: detector_id, category, severity, event_time."""

    def __init__(self, rules: Rules, seconds: int, tick: int):
        if seconds % tick:
            raise ValueError("the window must be a whole number of ticks")
        self.rules, self.seconds, self.tick, self.reach = rules, seconds, tick, seconds // tick

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "slot long, detector string, category string", "n long, severity double, at long, first long, last long")
        self.told = handle.getMapState("told", "bucket long, what string", "at long")

    def _wake(self, slot: int) -> None:
        """Timers at the ticks at which a slot enters, leaves, and meets a window of another number."""
        at = slot * self.tick
        for t in (at, at + self.seconds, (at // self.seconds + 1) * self.seconds):
            self.handle.registerTimer(t * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        touched: dict[tuple[int, str, str], Slot] = {}
        width = self.tick * 1_000_000
        for f in rows:
            for detector, category, severity, t in zip(f["detector_id"], f["category"], f["severity"], f["event_time"], strict=True):
                at = pd.Timestamp(t).value // 1000
                name = (-(-at // width), detector or "", category or "")
                severity = 0.0 if severity is None or severity != severity else float(severity)
                slot = touched.get(name)
                if slot is None:
                    if self.slots.containsKey(name):
                        slot = touched[name] = Slot(*self.slots.getValue(name))
                    else:
                        touched[name] = Slot(1, severity, at, at, at)
                        continue
                slot.add(severity, at)
        for name, s in touched.items():
            self.slots.updateValue(name, (s.n, s.severity, s.at, s.first, s.last))
        for slot in {name[0] for name in touched}:
            self._wake(slot)
        yield pd.DataFrame([], columns=NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() // 1000
        tick, bucket = now // self.tick, now // self.seconds
        live, gone = {}, []
        for name, value in self.slots.iterator():
            if name[0] <= tick - self.reach:
                gone.append(tuple(name))
            elif name[0] <= tick:  # what came later belongs to later ticks
                live[tuple(name)] = Slot(*value)
        for name in gone:
            self.slots.removeKey(name)
        told = set()
        for b, what in [tuple(k) for k in self.told.keys()]:
            if b < bucket:
                self.told.removeKey((b, what))
            else:
                told.add((b, what))
        out = []
        for x in decide(live, now, self.rules):
            what = x.pop("told")
            if (bucket, what) not in told:
                self.told.updateValue((bucket, what), (now,))
                self.handle.registerTimer((bucket + 1) * self.seconds * 1000)  # forgotten then
                kind = "incident" if x["reason"] != "corroboration" else "corrob"
                x |= {"tenant": key[0], "src_ip": key[1], "finding_id": f"{kind}-{key[0]}|{key[1]}-{bucket}-{what.removeprefix('corrob:')}", "evaluated_at": pd.Timestamp(now, unit="s")}
                x |= {c: pd.Timestamp(x[c] * 1000) for c in ("first_seen", "last_seen")}
                out.append(x)
        yield pd.DataFrame(out, columns=NAMES)

    def close(self) -> None:
        pass


def correlated(findings: DataFrame, rules: Rules = Rules(), seconds: int = WINDOW, tick: int = TICK, ts: str = "arrived", lateness: str = "60 seconds") -> DataFrame:
    """A stream of findings as a stream of incidents and corroborations, per tenant and source address.

    findings: tenant, src_ip, detector_id, category, severity, and when they arrived; a detector_version, where there is
    one. Outputs of correlation do not correlate again, nor does the structured classifier of applications (version
    2.0). Repeated findings count as often as they arrive, as they do in batch. A finding without a source belongs to none. Told once per
    entity, window number (``seconds`` each since the epoch) and reason or category: finding_id says which, so a repeated batch gives the same.
    """
    keep = ~F.coalesce(F.col("detector_id").isin(*CORRELATED), F.lit(False)) & F.col("src_ip").isNotNull()
    if "detector_version" in findings.columns:
        keep &= ~F.coalesce((F.col("detector_id") == "ndpi_risk") & (F.col("detector_version") == "2.0"), F.lit(False))
    rows = findings.filter(keep).select(F.coalesce("tenant", F.lit("")).alias("tenant"), "src_ip", "detector_id", "category", F.col("severity").cast("double").alias("severity"), F.col(ts).cast("timestamp").alias("event_time"))
    rows = rows.withWatermark("event_time", lateness).groupBy("tenant", "src_ip")
    return rows.transformWithStateInPandas(statefulProcessor=Correlator(rules, seconds, tick), outputStructType=TOLD, outputMode="Append", timeMode="EventTime")
