"""Settings: YAML files merged over defaults, dotted keys, parameter specifications and constraints."""

from __future__ import annotations

import random
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pulseframe.operators.detectors import DETECTORS, Detector

# The default settings, with the names that configuration files use.
DEFAULTS: dict[str, Any] = {
    "detector": {
        "default": {"useFlinkTimeWindow": True, "windowDuration": 60, "windowSize": 50, "windowSlide": 1},
        "baseline": {"inactivityPurgeTime": 600, "maxHistory": 50, "percentile": 0.10, "threshold": 25},
        "changepoint": {"maxHistory": 60, "triggerCount": 40, "ignoreOutlierNormalCount": 1, "inactivityPurgeTime": 60, "minimumEventInterval": 10, "severityThreshold": 30},
        "distdiff": {"recentsCount": 20, "minimumChange": 1.05, "zThreshold": 5.0, "dropExtremeN": 2, "inactivityPurgeTime": 1200},
        "loss": {"maxHistory": 30, "lossCount": 10, "consecutiveCount": 5},
        "mode": {"maxHistory": 30, "minFrequency": 6, "minProminence": 3, "threshold": 7.5, "inactivityPurgeTime": 60},
        "spike": {"inactivityPurgeTime": 60, "lag": 50, "threshold": 50, "influence": 0.01},
        "threshold": {"threshold": 1000},
    },
    "eventGrouping": {
        "graph": {"pruneIntervalCount": 500, "pruneIntervalTime": 43200, "pruneAge": 1200},
        "time": {"maximumEventInterval": 10, "maximumGroupDuration": 7200},
        "frequentFilter": {"small": {"interval": 60, "count": 5, "cooldown": 120, "severity": 25}, "medium": {"interval": 120, "count": 15, "cooldown": 240, "severity": 50}, "large": {"interval": 360, "count": 100, "cooldown": 720, "severity": 75}},
    },
    "flink": {"maxLateness": 20, "checkpointInterval": 600},
}
#: Setting to field, where it isn't just the case.
_FIELDS = {"inactivityPurgeTime": "inactivity"}


def snake(name: str) -> str:
    return _FIELDS.get(name) or "".join(f"_{c.lower()}" if c.isupper() else c for c in name)


def merge(base: Any, over: Any) -> Any:
    """over laid on base: maps key by key, lists of maps as one map, all else replaced."""
    base, over = (_as_map(x) for x in (base, over))
    if isinstance(base, Mapping) and isinstance(over, Mapping):
        return {k: merge(base[k], over[k]) if k in base and k in over else over.get(k, base.get(k)) for k in [*base, *(k for k in over if k not in base)]}
    return over


def _as_map(x: Any) -> Any:
    if isinstance(x, list) and x and all(isinstance(y, Mapping) for y in x):
        out: dict[str, Any] = {}
        for y in x:
            out |= y
        return out
    return x


def flatten(settings: Mapping[str, Any], prefix: str = "") -> dict[str, Any]:
    """Nested maps as dotted keys."""
    out: dict[str, Any] = {}
    for k, v in settings.items():
        v = _as_map(v)
        out |= flatten(v, f"{prefix}{k}.") if isinstance(v, Mapping) else {f"{prefix}{k}": v}
    return out


def unflatten(settings: Mapping[str, Any]) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for k, v in settings.items():
        node, names = out, k.split(".")
        for n in names[:-1]:
            node = node.setdefault(n, {})
        node[names[-1]] = v
    return out


def load(folder: str | None = None, overrides: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """The defaults, under the folder's YAML files in order of name, under dotted overrides."""
    import yaml

    out: Any = DEFAULTS
    if folder:
        for p in sorted([*Path(folder).glob("*.yaml"), *Path(folder).glob("*.yml")]):
            out = merge(out, yaml.safe_load(p.read_text()) or {})
    return merge(out, unflatten(overrides or {}))


@dataclass(frozen=True)
class Spec:
    """A parameter's name, default and bounds."""

    name: str
    default: float
    low: float | None = None
    high: float | None = None

    def valid(self, value: float) -> bool:
        return (self.low is None or value >= self.low) and (self.high is None or value <= self.high)

    def draw(self, r: random.Random) -> float:
        """A random value within the bounds, whole where the default is."""
        low, high = self.low if self.low is not None else 0, self.high if self.high is not None else 1000
        return r.randint(int(low), int(high)) if isinstance(self.default, int) else r.uniform(low, high)


_LONG = 2**31 - 1
_TINY = 5e-324
# Defaults and bounds of the detectors' parameters.
SPECS: dict[str, Spec] = {s.name: s for s in (
    Spec("detector.baseline.maxHistory", 50, 1, 300), Spec("detector.baseline.percentile", 0.1, 0.0, 1.0), Spec("detector.baseline.threshold", 25, 0, 100), Spec("detector.baseline.inactivityPurgeTime", 600, 0, _LONG),
    Spec("detector.changepoint.maxHistory", 60, 1, 600), Spec("detector.changepoint.triggerCount", 40, 1, 600), Spec("detector.changepoint.ignoreOutlierNormalCount", 1, 0, 600), Spec("detector.changepoint.inactivityPurgeTime", 60, 0, _LONG), Spec("detector.changepoint.minimumEventInterval", 10, 0, 600), Spec("detector.changepoint.severityThreshold", 30, 0, 100),
    Spec("detector.distdiff.recentsCount", 20, 0, 600), Spec("detector.distdiff.minimumChange", 1.05, 1.0, 10.0), Spec("detector.distdiff.zThreshold", 5.0, 0.0, 50.0), Spec("detector.distdiff.dropExtremeN", 2, 0, 300), Spec("detector.distdiff.inactivityPurgeTime", 600, 0, _LONG),
    Spec("detector.loss.maxHistory", 30, 1, 600), Spec("detector.loss.lossCount", 10, 0, 600), Spec("detector.loss.consecutiveCount", 5, 0, 600),
    Spec("detector.mode.maxHistory", 30, 0, 600), Spec("detector.mode.minFrequency", 6, 1, 600), Spec("detector.mode.minProminence", 3, 1, 600), Spec("detector.mode.threshold", 7.5, 0.0, 100.0), Spec("detector.mode.inactivityPurgeTime", 60, 0, _LONG),
    Spec("detector.spike.inactivityPurgeTime", 60, 0, _LONG), Spec("detector.spike.lag", 500, 0, 600), Spec("detector.spike.threshold", 30.0, _TINY, 1000.0), Spec("detector.spike.influence", 0.01, 0.0, 1.0),
)}


@dataclass(frozen=True)
class Constraint:
    """left <op> right / divide + add, over parameters of one detector."""

    left: str
    op: str
    right: str
    divide: float = 1.0
    add: float = 0.0

    def holds(self, values: Mapping[str, float]) -> bool:
        if self.left not in values or self.right not in values:
            return True
        a, b = values[self.left], values[self.right] / self.divide + self.add
        return {"<": a < b, ">": a > b, "==": a == b}[self.op]

    def forbidden(self) -> str:
        """As a tuner's forbidden clause, which names what must not be."""
        right = self.right.replace(".", "_") + (f" / {self.divide:g}" if self.divide != 1 else "") + (f" + {self.add:g}" if self.add else "")
        return f"{{ {self.left.replace('.', '_')} {dict(zip('<>', ('>=', '<='), strict=True)).get(self.op, '!=')} {right} }}"


CONSTRAINTS = (
    Constraint("detector.mode.minFrequency", "<", "detector.mode.maxHistory"),
    Constraint("detector.mode.minProminence", "<", "detector.mode.maxHistory"),
    Constraint("detector.changepoint.triggerCount", "<", "detector.changepoint.maxHistory"),
    Constraint("detector.changepoint.minimumEventInterval", "<", "detector.changepoint.inactivityPurgeTime"),
    Constraint("detector.distdiff.dropExtremeN", "<", "detector.distdiff.recentsCount", 2.0, -1.0),
)


def problems(settings: Mapping[str, Any]) -> list[str]:
    """What is wrong with dotted settings: values out of bounds and constraints that don't hold. A purge time of 0 switches it off, so nothing is held against it."""
    out = [f"{k} = {v} is out of {SPECS[k].low} to {SPECS[k].high}" for k, v in settings.items() if k in SPECS and not SPECS[k].valid(v)]
    for c in CONSTRAINTS:
        if not c.holds(settings) and not (c.right.endswith("inactivityPurgeTime") and settings[c.right] == 0):
            out.append(f"{c.left} {c.op} {c.right} doesn't hold")
    return out


def validate(settings: Mapping[str, Any], throw: bool = True) -> bool:
    found = problems(settings)
    if found and throw:
        raise ValueError("; ".join(found))
    return not found


def build_detector(kind: str, settings: Mapping[str, Any] | None = None, overrides: Mapping[str, Any] | None = None) -> Detector:
    """A detector with the settings' values for its kind, under its own overrides; validated."""
    if kind not in DETECTORS:
        raise ValueError(f"no detector {kind}")
    key = kind.removesuffix("_windowed")
    values = dict(_as_map((settings or DEFAULTS)["detector"].get(key, {}))) | dict(overrides or {})
    validate({f"detector.{key}.{k}": v for k, v in values.items() if isinstance(v, int | float) and not isinstance(v, bool)})
    known = DETECTORS[kind].__dataclass_fields__
    return DETECTORS[kind](**{snake(k): v for k, v in values.items() if snake(k) in known})


def random_settings(kinds: Iterable[str], r: random.Random, tries: int = 10_000) -> dict[str, float]:
    """Random valid values of all parameters of those detectors."""
    specs = [s for s in SPECS.values() if s.name.split(".")[1] in kinds]
    for _ in range(tries):
        values = {s.name: s.draw(r) for s in specs}
        if not problems(values):
            return values
    raise RuntimeError("no valid values found")


def tuner_text(kinds: Iterable[str]) -> str:
    """The parameters, their bounds and what is forbidden, as a tuner's parameter file."""
    specs = [s for s in SPECS.values() if s.name.split(".")[1] in kinds]
    lines = [f"{s.name.replace('.', '_')} {'integer' if isinstance(s.default, int) else 'real'} [{s.low}, {s.high}] [{s.default}]" for s in specs]
    return "\n".join(lines + [c.forbidden() for c in CONSTRAINTS if c.left.split(".")[1] in kinds]) + "\n"
