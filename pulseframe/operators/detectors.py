"""The detectors: each is a state and a pure step from one measurement to its events.

A step gets (time in ms, value or None, lossy) in arrival order and gives
events; time is used for gaps only. The same steps run over sorted batches and
in streaming queries, where ``dump`` and ``load`` carry the state as JSON.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from typing import Any, ClassVar

import numpy as np

from pulseframe.functions.severity import severity

NANOS = 1_000_000


@dataclass
class Event:
    """What a detector found; the stream is added where it runs."""

    event_type: str
    severity: int
    time_ms: int
    latency_ns: int
    description: str
    tags: dict[str, str] = field(default_factory=dict)


class Detector:
    """Parameters are the dataclass fields of a subclass; ``state`` is a dict of JSON values."""

    name: ClassVar[str]
    value_needed: ClassVar[bool] = True
    inactivity: float

    def start(self) -> dict[str, Any]:
        raise NotImplementedError

    def step(self, state: dict[str, Any], t: int, value: float | None, lossy: bool) -> list[Event]:
        raise NotImplementedError

    @staticmethod
    def dump(state: dict[str, Any]) -> str:
        return json.dumps(state, default=np.ndarray.tolist)

    @staticmethod
    def load(text: str) -> dict[str, Any]:
        return json.loads(text)

    def describe(self, state: dict[str, Any], value: float) -> dict[str, float] | None:
        """Numbers to look at before a step is taken; none by default."""
        return None

    def steps(self, state: dict[str, Any], times: list, values: list, lossy: list, told: Callable | None = None) -> list[Event]:
        """The events of many rows in order. ``told`` gets times and columns of what ``describe`` says before the steps."""
        out = []
        for t, v, x in zip(times, values, lossy, strict=True):
            detail = self.describe(state, v) if told and v is not None and not x else None
            if detail:
                told([t], {k: [y] for k, y in detail.items()})
            out += self.step(state, t, v, x)
        return out

    def parameters(self) -> dict[str, Any]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def _stale(self, state: dict[str, Any], t: int, zero_disables: bool) -> bool:
        if state["last"] is None:
            return True
        return not (zero_disables and self.inactivity == 0) and t - state["last"] > self.inactivity * 1000


def percentile(values: list[float], percent: float) -> float:
    """The estimate at percent * (n + 1) / 100 between the sorted values, ends held."""
    s, at = sorted(values), percent * (len(values) + 1) / 100
    if at < 1:
        return s[0]
    if at >= len(s):
        return s[-1]
    k = math.floor(at)
    return s[k - 1] + (at - k) * (s[k] - s[k - 1])


@dataclass
class Baseline(Detector):
    """A percentile of the last values; an event if it moves by more than the threshold's severity.

    ``percentile`` is in percent, so the default of 0.1 is nearly the least
    value. An inactivity of 0 resets on any positive gap.
    """

    max_history: int = 50
    percentile: float = 0.10
    threshold: int = 25
    inactivity: float = 600
    name: ClassVar[str] = "baseline"

    def start(self):
        return {"last": None, "recent": [], "result": 0.0}

    def step(self, state, t, value, lossy):
        lossy = lossy or value is None
        if self._stale(state, t, False):
            if lossy:
                state["last"] = None
            else:
                state["last"], state["recent"] = t, [value]
            return []
        state["last"] = max(state["last"], t)
        if lossy:
            return []
        recent = state["recent"]
        recent.append(value)
        del recent[: -self.max_history]
        old, state["result"] = state["result"], percentile(recent, self.percentile)
        if len(recent) < self.max_history:
            return []
        s = severity(old, state["result"])
        return [Event("baseline_events", s, t, 0, f"Observed baseline changed from {old} to {state['result']}")] if s > self.threshold else []


@dataclass
class Loss(Detector):
    """Runs of loss, and its count, among the last measurements. A count of 0 switches its event off."""

    max_history: int = 30
    loss_count: int = 10
    consecutive_count: int = 5
    name: ClassVar[str] = "loss"
    value_needed: ClassVar[bool] = False

    def start(self):
        return {"recent": []}

    def step(self, state, t, value, lossy):
        recent = state["recent"]
        before = sum(x for _, x in recent)
        recent.append([t, int(lossy)])
        del recent[: -self.max_history]
        count, run = sum(x for _, x in recent), 0
        while run < len(recent) and recent[-1 - run][1]:
            run += 1
        out = []
        if 0 < self.consecutive_count <= run:
            out.append(Event("consecutive_loss", run // self.max_history, t, (t - recent[-run][0]) * NANOS, f"{run} consecutive lost measurements"))
        if self.loss_count > 0 and count > before and count >= self.loss_count:
            out.append(Event("loss_ratio", count // self.max_history, t, 0, f"{count} of the last {len(recent)} measurements lost"))
        return out


@dataclass
class Mode(Detector):
    """The commonest value, on two significant digits; an event if another takes its place clearly enough.

    Equal counts go to the larger value. The value that resets isn't kept.
    """

    max_history: int = 30
    min_frequency: int = 6
    min_prominence: int = 3
    threshold: float = 7.5
    inactivity: float = 60
    name: ClassVar[str] = "mode"

    def __post_init__(self):
        if self.max_history < 5:
            raise ValueError("max_history must be at least 5")

    def start(self):
        return {"last": None, "recent": [], "mode": None}

    @staticmethod
    def bucket(v: int) -> int:
        size = 10 ** max(0, len(str(abs(v))) - 2)
        return v // size * size

    @staticmethod
    def scale_severity(old: int, new: int) -> int:
        digits = lambda v: len(str(abs(v))) if v else 0
        a, b = digits(old), digits(new)
        by = 10 ** max(0, (a - 1 if a == b else max(min(a, b), 1)) - 1)
        return severity(float(int(old / by)), float(int(new / by)))

    def step(self, state, t, value, lossy):
        if self._stale(state, t, True):
            state.update(last=t, recent=[], mode=None)
            return []
        state["last"] = max(state["last"], t)
        if lossy or value is None:
            return []
        recent = state["recent"]
        recent.append(int(value))
        del recent[: -self.max_history]
        if len(recent) < self.max_history:
            return []
        counts = sorted(((n, v) for v, n in Counter(map(self.bucket, recent)).items()), reverse=True)
        (n, mode), second = counts[0], counts[1][0] if len(counts) > 1 else -2
        old = state["mode"]
        if old == mode or n < self.min_frequency or n - second < self.min_prominence:
            return []
        state["mode"] = mode
        if old is None or all(self.bucket(v) != old for v in recent):
            return []
        # a larger relative change is asked of small modes; without a logarithm any change counts, or none
        least = math.inf if old == 1 else -math.inf if old < 0 else self.threshold if old == 0 else max(self.threshold, old / math.log(old))
        if abs(old - mode) < least:
            return []
        return [Event("mode_events", self.scale_severity(old, mode), t, 0, f"Mode changed from {old} to {mode}!")]


@dataclass
class Spike(Detector):
    """Smoothed z-score: a value far off the mean of the last ones is a spike, and is kept with little influence."""

    lag: int = 50
    threshold: float = 50
    influence: float = 0.01
    inactivity: float = 60
    name: ClassVar[str] = "spike"

    def start(self):
        return {"last": None, "history": [], "mean": 0.0, "std": 0.0, "value": None}

    def signal(self, state, value: float) -> int:
        """-1, 0 or 1, and the history moves on."""
        h, sign, kept = state["history"], 0, value
        if len(h) >= self.lag and abs(value - state["mean"]) > self.threshold * state["std"]:
            sign = 1 if value > state["mean"] else -1
            kept = self.influence * value + (1 - self.influence) * h[-1]
        h.append(kept)
        del h[: -self.lag]
        mean = sum(h) / len(h)
        state["mean"], state["std"] = mean, math.sqrt(sum((x - mean) ** 2 for x in h) / len(h))
        return sign

    def describe(self, state, value):
        """Of the step to come: the value, the mean, the bound on the value's other side, the distance over the value, the signal."""
        if state["last"] is None or not state["history"]:
            return None
        reach, off = self.threshold * state["std"], abs(value - state["mean"])
        sign = 0 if len(state["history"]) < self.lag or off <= reach else 1 if value > state["mean"] else -1
        return {"value": value, "mean": state["mean"], "bound": value - reach if value > state["mean"] else value + reach, "distance": off + value, "signal": float(sign)}

    def step(self, state, t, value, lossy):
        if self._stale(state, t, True):
            state.update(self.start(), last=t, value=value)
            return []
        state["last"] = max(state["last"], t)
        if lossy or value is None:
            return []
        old, state["value"] = state["value"], value
        sign = self.signal(state, value)
        if not sign:
            return []
        return [Event("spike_events", severity(old if old is not None else 0.0, value), t, 0, "Positive" if sign > 0 else "Negative")]


def distribution_difference(old: list[float], recent: list[float], step: float) -> float:
    """How far two sorted samples' distributions part at most, on a scale of their length.

    Kept as it is known: the largest difference so far is kept with its sign
    until the end, and equal values count as one of the values walked.
    """
    i = j = depth = 0
    total, diff, most = len(old) + len(recent), 0.0, 0.0
    while i < len(old) and j < len(recent):
        a, b = old[i], recent[j]
        depth += 1
        if a == b:
            while i < len(old) and old[i] == a:
                i += 1
            while j < len(recent) and recent[j] == b:
                j += 1
            continue
        if a < b:
            i, diff = i + 1, diff - step
        else:
            j, diff = j + 1, diff + step
        if abs(diff) > most:
            most = diff
    diff += (step if j >= len(recent) and i < len(old) else -step) * (total - depth)
    return max(abs(diff), most) * math.sqrt(total / 2)


@dataclass
class DistDiff(Detector):
    """Whether the last values are distributed unlike those before them. An inactivity of 0 resets on any positive gap."""

    recents_count: int = 20
    minimum_change: float = 1.05
    z_threshold: float = 5.0
    drop_extreme_n: int = 2
    inactivity: float = 1200
    name: ClassVar[str] = "distdiff"

    def start(self):
        return {"last": None, "recent": [], "long": [], "times": [], "in_event": False}

    def compare(self, long: list[float], recent: list[float], in_event: bool) -> tuple[float, int | None, float, float]:
        """(z, severity or None, old mean, recent mean)."""
        n = self.drop_extreme_n
        old, new = sorted(long)[n : len(long) - n], sorted(recent)[n : len(recent) - n]
        z = distribution_difference(old, new, 1.0 / self.recents_count)
        a, b = sum(old), sum(new)
        means = a / len(old), b / len(new)
        if in_event or z < self.z_threshold:
            return z, None, *means
        low, high = min(a, b), max(a, b)
        change = high / low if low else math.inf if high else math.nan
        if change < self.minimum_change or abs(a - b) < self.recents_count:
            return z, None, *means
        spread = old[-1] - old[0]
        if new[-1] - new[0] > 0.25 * spread and abs(means[0] - means[1]) < 2 * spread:
            return z, None, *means
        return z, severity(means[0] / 1000, means[1] / 1000), *means

    def event(self, s: int, t: int, latency_ms: int, old: float, new: float, windowed: bool) -> Event:
        return Event("distdiff_events", s, t, latency_ms * NANOS, f"Distribution of values has changed. Mean has changed from {old} to {new}", {"windowed": str(windowed).lower()})

    def step(self, state, t, value, lossy):
        if self._stale(state, t, False):
            if lossy or value is None:
                state["last"] = None
            else:
                state.update(last=t, recent=[value], long=[], times=[t], in_event=False)
            return []
        state["last"] = max(state["last"], t)
        if lossy or value is None:
            return []
        recent, long = state["recent"], state["long"]
        recent.append(value)
        state["times"] = [*state["times"], t][-(self.recents_count + 1) :]
        if len(recent) > self.recents_count:
            long.append(recent.pop(0))
        del long[: -self.recents_count]
        if len(long) < self.recents_count:
            return []
        z, s, old, new = self.compare(long, recent, state["in_event"])
        out = []
        if s is not None:
            out.append(self.event(s, t, t - state["times"][0], old, new, False))
            state["in_event"] = True
        if z < self.z_threshold / 2:
            state["in_event"] = False
        return out


@dataclass
class WindowedDistDiff(DistDiff):
    """The same comparison of the halves of the last 2 * recents_count arrivals, sorted by time. The event is at the first that arrived."""

    window_slide: int = 1
    name: ClassVar[str] = "distdiff_windowed"

    def start(self):
        return {"window": [], "seen": 0, "in_event": False}

    def step(self, state, t, value, lossy):
        if lossy or value is None:
            return []
        size, window = 2 * self.recents_count, state["window"]
        window.append([t, value])
        del window[:-size]
        state["seen"] += 1
        if len(window) < size or state["seen"] % self.window_slide:
            return []
        ordered = sorted(window, key=lambda x: x[0])
        half = self.recents_count
        z, s, old, new = self.compare([v for _, v in ordered[:half]], [v for _, v in ordered[half:]], state["in_event"])
        out = []
        if s is not None:
            out.append(self.event(s, window[0][0], ordered[half][0] - ordered[0][0], old, new, True))
            state["in_event"] = True
        if z < self.z_threshold / 2:
            state["in_event"] = False
        return out


@dataclass
class Changepoint(Detector):
    """Bayesian online changepoint detection over normal distributions.

    Runs are columns of mean, variance, n, probability and start; the newest
    comes first.
    The last run is left out when the likeliest is looked for, and the mean
    after a change is that of the newest run, so the value itself.
    """

    max_history: int = 60
    trigger_count: int = 40
    ignore_outlier_normal_count: int = 1
    inactivity: float = 60
    minimum_event_interval: float = 10
    severity_threshold: int = 30
    name: ClassVar[str] = "changepoint"
    HAZARD: ClassVar[float] = 1 / 200

    def start(self):
        return {"last": None, "event": None, **self._fresh()}

    @staticmethod
    def _fresh():
        return {"runs": [], "normal": [], "old": None, "at": 0, "odd": 0, "back": 0}

    @staticmethod
    def densities(runs: np.ndarray, y: float) -> np.ndarray:
        """How likely y is under each run's normal distribution; one without a spread gets a hundredth of y as its variance."""
        mean, variance = runs[0], np.where(np.abs(runs[1]) < 1e-15, y / 100, runs[1])
        with np.errstate(all="ignore"):
            usual = np.exp(-((y - mean) ** 2) / (2 * variance)) / np.sqrt(2 * np.pi * variance)
        return np.where(variance > 0, usual, np.where(variance < 0, np.nan, np.where(y == mean, np.inf, 0.0)))

    def update(self, runs: np.ndarray, y: float, t: int) -> np.ndarray:
        """The runs after one more value: a new one, and each known one longer by it."""
        k = runs.shape[1]
        n = np.arange(1.0, k + 1)
        likely = self.densities(runs, y) * runs[3]
        before = np.where(n == 1, 0.0, n)
        mean = (runs[0] * before + y) / (before + 1)
        variance = (runs[1] * n + (y - mean) * (y - runs[0])) / (n + 1)
        out = np.empty((5, k + 1))
        # the new run starts from a mean of 0 and a variance of 1e8, and takes what the others lose
        out[:, 0] = y, 1e8 / 2, 1.0, np.cumsum(likely * self.HAZARD)[-1] if k else 0.0, t
        out[:, 1:] = mean, variance, n, likely * (1 - self.HAZARD), runs[4]
        while out.shape[1] > self.max_history:
            out[3, -2] += out[3, -1]
            out = out[:, :-1]
        total = np.cumsum(out[3])[-1]
        if total == 0:
            out[3] = 0.0
            out[3, 0] = 1.0
        else:
            with np.errstate(invalid="ignore"):
                out[3] /= total
        return out

    def describe(self, state, value):
        """Of the runs so far: how many, which is likeliest and with what, how the value fits it, and the anomalies in a row."""
        runs = np.asarray(state["runs"], float).reshape(5, -1)
        if not runs.shape[1]:
            return None
        at = self.likeliest(runs[3])
        mean, variance, n, probability, _ = runs[:, at].tolist()
        density = float(self.densities(runs[:, at : at + 1], value)[0])
        return {"value": value, "runs": float(runs.shape[1]), "likeliest": float(at), "mean": mean, "variance": variance, "n": n, "probability": probability, "density": density, "odd": float(state["odd"])}

    @staticmethod
    def likeliest(by: np.ndarray) -> int:
        """The first of the largest, the last run aside."""
        if len(by) < 2:
            return 0
        if np.isnan(by).any():  # nothing is over what isn't a number, so the first that comes is kept
            return max(range(len(by) - 1), key=by.__getitem__)
        return int(by[:-1].argmax())

    def step(self, state, t, value, lossy):
        if lossy or value is None:
            return []
        if self._stale(state, t, True):
            state.update(self._fresh(), last=t)
            return []
        state["last"] = max(state["last"], t)
        runs = np.asarray(state["runs"], float).reshape(5, -1)
        state["at"] = min(state["at"], runs.shape[1] - 1)
        if state["odd"] == 0:
            state["normal"] = runs
            if runs.shape[1]:
                best = runs[:3, self.likeliest(runs[2])].tolist()
                state["old"] = [*best, -2.0, int(runs[4, state["at"]])]
            else:
                state["old"] = [0.0, 1e8, 0, -2.0, t]
        runs = state["runs"] = self.update(runs, value, t)
        likely = self.likeliest(runs[3])
        if likely != state["at"]:
            state["odd"] += 1
            if self.likeliest(self.densities(runs, value)) == runs.shape[1] - 2:
                state["back"] += 1
                if state["back"] > self.ignore_outlier_normal_count:
                    normal = np.asarray(state["normal"], float).reshape(5, -1)
                    state.update(odd=0, back=0, runs=self.update(normal, value, t))
                    return []
            else:
                state["back"] = 0
        else:
            state["odd"] = state["back"] = 0
        state["at"] = likely
        out = []
        if state["odd"] > self.trigger_count:
            old, new = state["old"], runs[:, int((runs[2] == 1).argmax())].tolist()
            s = severity(old[0], new[0])
            if s > self.severity_threshold:
                if t - (state["event"] or 0) > self.minimum_event_interval * 1000:
                    state["event"] = t
                    way = "decreased" if old[0] > new[0] else "increased"
                    out.append(Event("changepoint_events", s, t, (t - old[4]) * NANOS, f"Latency {way} from {int(old[0])} to {int(new[0])}"))
                state.update(self._fresh(), last=t)
            state["odd"] = 0
        return out


    def steps(self, state, times, values, lossy, told=None):
        """By blocks while the likeliest run stays, else row by row. A block that ends early is followed by a short one, one without rows by a pause."""
        rows = [(t, v) for t, v, x in zip(times, values, lossy, strict=True) if v is not None and not x]
        ts, vs = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float)
        out, i, block, pause = [], 0, 64, 0
        while i < len(rows):
            if not pause and state["odd"] == state["back"] == 0 and np.shape(state["runs"])[-1] == self.max_history > 2:
                want = min(block, len(rows) - i)
                done = self._settled(state, ts[i : i + want], vs[i : i + want], told)
                block, pause = min(2 * block, 2048) if done == want else 64, 0 if done else self.max_history
                i += done
            if i < len(rows):
                out += super().steps(state, [rows[i][0]], [rows[i][1]], [False], told)
                i, pause = i + 1, max(0, pause - 1)
        return out

    def _settled(self, state, ts: np.ndarray, ys: np.ndarray, told) -> int:
        """Takes rows as long as the likeliest run has the same place, and says how many; the numbers are those of single steps.

        Of full runs, mean and variance at each place follow from the values
        alone, so they are made a place at a time for the whole block; only
        the probabilities go row by row.
        """
        latest = np.maximum.accumulate(np.append(state["last"], ts))
        if self.inactivity:
            stale = np.flatnonzero(ts - latest[:-1] > self.inactivity * 1000)
            if len(stale):
                ts, ys = ts[: stale[0]], ys[: stale[0]]
        runs, k, b, at = np.asarray(state["runs"], float), self.max_history, len(ys), state["at"]
        if not b:
            return 0
        mean, variance, p = np.empty((k, b + 1)), np.empty((k, b + 1)), np.empty((b + 1, k))
        mean[:, 0], variance[:, 0], p[0] = runs[0], runs[1], runs[3]
        mean[0, 1:], variance[0, 1:] = ys, 1e8 / 2
        with np.errstate(all="ignore"):
            for n in range(1, k):
                before = 0.0 if n == 1 else float(n)
                mean[n, 1:] = (mean[n - 1, :-1] * before + ys) / (before + 1)
                variance[n, 1:] = (variance[n - 1, :-1] * n + (ys - mean[n, 1:]) * (ys - mean[n - 1, :-1])) / (n + 1)
            density = self.densities(np.stack([mean[:, :-1], variance[:, :-1]]), ys)
            likely, part, total = np.empty(k), np.empty(k), np.empty(k)
            lost, kept = self.HAZARD, 1 - self.HAZARD
            multiply, add = np.multiply, np.add.accumulate
            for d, old, new in zip(np.ascontiguousarray(density.T), p, p[1:], strict=False):
                multiply(d, old, out=likely)
                multiply(likely, lost, out=part)
                add(part, out=total)
                multiply(likely, kept, out=part)
                new[0] = total[-1]
                new[1:] = part[:-1]
                new[-1] += part[-1]
                add(new, out=total)
                new /= total[-1]
        plain = np.isfinite(p[1:]).all(axis=1) & (p[1:, :-1].argmax(axis=1) == at)
        m = b if plain.all() else int(plain.argmin())
        if told and m:
            best, rows = p[:m, :-1].argmax(axis=1), np.arange(m)
            told(ts[:m], {"value": ys[:m], "runs": np.full(m, float(k)), "likeliest": best.astype(float), "mean": mean[best, rows], "variance": variance[best, rows], "n": runs[2, best], "probability": p[rows, best], "density": density[best, rows], "odd": np.zeros(m)})
        if m:
            starts = np.concatenate([ts[:m][::-1][:k].astype(float), runs[4]])[:k]
            state.update(runs=np.stack([mean[:, m], variance[:, m], runs[2], p[m], starts]), last=int(latest[m]))
        return m


@dataclass
class Threshold(Detector):
    """Every value over the threshold is an event of severity 10."""

    threshold: float = 1000
    name: ClassVar[str] = "threshold"

    def start(self):
        return {}

    def step(self, state, t, value, lossy):
        return [Event("threshold_events", 10, t, 0, f"Value was {value}")] if value is not None and value > self.threshold else []


DETECTORS: dict[str, type[Detector]] = {d.name: d for d in (Baseline, Changepoint, DistDiff, WindowedDistDiff, Loss, Mode, Spike, Threshold)}
