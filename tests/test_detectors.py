"""The detectors' steps against known values."""

import pytest

from pulseframe.functions.severity import severity
from pulseframe.operators import detectors as D

T0 = 1_000_000_000_000


def feed(detector, rows, restart=False):
    state, out = detector.start(), []
    for t, v, lossy in rows:
        if restart:
            state = detector.load(detector.dump(state))
        out += detector.step(state, t, v, lossy)
    return out


def shift(n, low=225000.0, high=22500000.0):
    return [(T0 + i, low if i < n else high, False) for i in range(2 * n)]


@pytest.mark.parametrize("pair, expected", [((200, 800), 100), ((1, 2), 14), ((10, 12), 5), ((100, 110), 8), ((1000, 1100), 29), ((50, 75), 27), ((500, 505), 2), ((0, 5), 100), ((0, 0), 0), ((-5, 5), 1)])
def test_severity(pair, expected):
    assert severity(*pair) == expected


@pytest.mark.parametrize("detector, n", [(D.Baseline(), 120), (D.Mode(), 120), (D.Changepoint(), 120), (D.Spike(), 100)])
def test_a_shift_is_found_and_state_survives_restarts(detector, n):
    assert feed(detector, shift(n)[:n]) == []
    found = feed(detector, shift(n))
    assert found and found == feed(detector, shift(n), restart=True)


def test_changepoint_tells_the_means():
    (e,) = feed(D.Changepoint(), shift(120))
    assert e.severity == 100 and e.description == "Latency increased from 602542 to 22500000"


def test_distribution_differences_of_a_jump():
    rows = [(T0 + 10 * i, 1000.0, False) for i in range(100)] + [(T0 + 1000 + i, 1000000.0, False) for i in range(100)]
    (keyed,) = feed(D.DistDiff(), rows)
    assert (keyed.time_ms, keyed.latency_ns, keyed.severity, keyed.tags) == (1000000001002, 182_000_000, 100, {"windowed": "false"})
    assert "1000.0 to 63437.5" in keyed.description
    (windowed,) = feed(D.WindowedDistDiff(), rows)
    assert (windowed.time_ms, windowed.latency_ns, windowed.severity) == (1000000000630, 200_000_000, 100)


def test_smoothed_z_score_signals():
    # A published example series and its signals.
    series = [1, 1, 1.1, 1, 0.9, 1, 1, 1.1, 1, 0.9, 1, 1.1, 1, 1, 0.9, 1, 1, 1.1, 1, 1, 1, 1, 1.1, 0.9, 1, 1.1, 1, 1, 0.9, 1, 1.1, 1, 1, 1.1, 1, 0.8, 0.9, 1, 1.2, 0.9, 1, 1, 1.1, 1.2, 1, 1.5, 1, 3, 2, 5, 3, 2, 1, 1, 1, 0.9, 1, 1, 3, 2.6, 4, 3, 3.2, 2, 1, 1, 0.8, 4, 4, 2, 2.5, 1, 1, 1]
    signals = [0] * 45 + [1, 0, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 1, 1, 0, 0, 0, 1, 1, 1, 1, 0, 0, 0]
    d = D.Spike(lag=30, threshold=5, influence=0)
    state = d.start()
    assert [d.signal(state, float(x)) for x in series] == signals


def test_gaps_reset_only_beyond_the_purge_time():
    d = D.Baseline(max_history=2, inactivity=10, threshold=0)
    rows = [(0, 1.0, False), (10_000, 9.0, False), (20_000, 9.0, False)]
    assert [e.time_ms for e in feed(d, rows)] == [10_000, 20_000]
    assert feed(d, [(0, 1.0, False), (10_001, 9.0, False)]) == []
    assert feed(D.Baseline(max_history=1, inactivity=0), [(i, 1.0, False) for i in range(5)]) == []  # 0 resets on any gap
    assert D.Mode(inactivity=0)._stale({"last": 0}, 10**9, True) is False


def test_percentile_estimate():
    v = [float(x) for x in range(1, 51)]
    assert D.percentile(v, 0.1) == 1.0 and D.percentile(v, 100) == 50.0 and D.percentile(v, 50) == 25.5 and D.percentile([3.0], 50) == 3.0


def test_loss_counts_runs_and_ratio():
    rows = [(i * 1000, None, i in (2, 3, 4, 6)) for i in range(8)]
    found = feed(D.Loss(max_history=5, loss_count=3, consecutive_count=2), rows)
    assert [(e.event_type, e.time_ms, e.latency_ns) for e in found] == [("consecutive_loss", 3000, 10**9), ("consecutive_loss", 4000, 2 * 10**9), ("loss_ratio", 4000, 0), ("loss_ratio", 6000, 0)]
    assert feed(D.Loss(5, 0, 0), rows) == []


def test_mode_buckets_and_severity_of_small_values():
    assert [D.Mode.bucket(v) for v in (225, 1999, 7, 0, -225)] == [220, 1900, 7, 0, -230]
    assert D.Mode.scale_severity(9, 1) == severity(9.0, 1.0)
    with pytest.raises(ValueError):
        D.Mode(max_history=4)


def test_nulls_and_losses_give_no_events():
    for cls in D.DETECTORS.values():
        if cls is not D.Loss:
            assert feed(cls(), [(i, None, True) for i in range(200)]) == []


def test_descriptions_tell_the_signal_to_come():
    d = D.Spike(lag=30, threshold=5, influence=0)
    state, told, given = d.start(), [], []
    d.step(state, 0, 1.0, False)
    for i, x in enumerate([1.0, 1.1] * 20 + [9.0, 1.0]):
        detail = d.describe(state, x)
        told.append(int(detail["signal"]) if detail else 0)
        given.append(len(d.step(state, i + 1, x, False)))
    assert told == given and sum(told) == 1


def test_blocks_of_changepoint_give_what_single_steps_give(monkeypatch):
    """Noise, jumps, outliers, gaps and nulls, in batches that cut anywhere; nearly all rows go by blocks."""
    values = [1000 + i * 7919 % 701 / 100 + (300_000 if i // 1500 % 2 else 0) + (50_000 if i % 977 == 0 else 0) for i in range(6000)]
    rows = [(T0 + 1000 * i + (10**6 if i > 4000 else 0), None if i % 501 == 0 else v, i % 503 == 0) for i, v in enumerate(values)]
    d, want, single = D.Changepoint(60, 4, 1, 900, 10, 5), [], 0
    state, told = d.start(), []
    for t, v, x in rows:
        if v is not None and not x and (detail := d.describe(state, v)):
            told.append((t, detail))
        want += d.step(state, t, v, x)
    step = D.Changepoint.step

    def counted(self, *a):
        nonlocal single
        single += 1
        return step(self, *a)

    monkeypatch.setattr(D.Changepoint, "step", counted)
    state, out, got = d.start(), [], []
    note = lambda times, columns: got.extend((t, {k: columns[k][i] for k in columns}) for i, t in enumerate(times))
    for i in range(0, len(rows), 1700):
        out += d.steps(state, *zip(*rows[i : i + 1700], strict=True), note)
    assert len(want) >= 3 and out == want and single < 2000
    assert [t for t, _ in got] == [t for t, _ in told]
    assert all(a == pytest.approx(b, rel=1e-9) for (_, a), (_, b) in zip(got, told, strict=True))
