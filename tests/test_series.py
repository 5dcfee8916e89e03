"""Spikes and grids on small series against brute force; blocks of a day force every case across block edges."""

import datetime as dt
import math
import random

import numpy as np
import pytest

from gleanery.operators import grid as G, report_times as R, spikes as S

UTC = dt.timezone.utc
DAY0 = dt.datetime(2024, 1, 1, tzinfo=UTC)


def brute(rows, field, jump):
    out = set()
    for source in {r[1] for r in rows}:
        first = {}
        for r in sorted(rows):
            value = r[3 + ["temperature", "dew", "speed"].index(field)]
            if r[1] == source and value is not None:
                first.setdefault(r[2], value)
        t = sorted(first)
        x = [first[k] for k in t]
        steps = sorted(abs(b - a) for a, b in zip(x, x[1:]))
        least = max(jump, 2.5 * (steps[max(0, math.ceil(0.9 * len(steps) - 1e-9) - 1)] if steps else 0)) - 1e-9
        for i in range(2, len(x)):
            for k in (1, 2):
                if i + k + 1 < len(x) and all(abs(x[p] - x[q]) >= least for p in range(i, i + k) for q in (i - 2, i - 1, i + k, i + k + 1)):
                    out |= {(source, t[p], "spike") for p in range(i, i + k)}
        i = 0
        while i < len(x):
            j = i
            while j + 1 < len(x) and x[j + 1] == x[j] and t[j + 1] - t[j] < dt.timedelta(days=30):
                j += 1
            if j - i >= 5 and t[j] - t[i] >= dt.timedelta(hours=12):
                out |= {(source, t[p], "stuck") for p in range(i, j + 1)}
            i = j + 1
        out |= {(source, k, "impossible") for k, v in zip(t, x) if (v > 75 if field == "speed" else abs(v) > 60)}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_spikes_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows, n = [], 0
    for source, every in (("hot", 60), ("thin", 600), ("one", 6000)):
        t, value = DAY0, 10.0
        for k in range(420 if source == "hot" else 60):
            t += dt.timedelta(minutes=every if rng.random() > 0.02 else every * 30)
            value = value if 100 < k < 125 else value + rng.choice([-1, 0, 0, 1])
            shown = value + rng.choice([9, -12, 70]) if rng.random() < 0.06 else value
            shown = None if rng.random() < 0.03 else shown
            rows.append((n := n + 1, source, t, shown, None if shown is None else shown - rng.choice([2, 2, 2, -1]), abs(value) + (20 if rng.random() < 0.05 else 0)))
            if rng.random() < 0.05:
                rows.append((n := n + 1, *rows[-1][1:]))
    df = spark.createDataFrame(rows, "id long, source string, at timestamp, temperature double, dew double, speed double")
    got = {(r.id, r.field, r.kind) for r in S.implausible(df, S.Limits(block_days=1)).collect()}
    want = set()
    hot = brute(rows, "temperature", 6.0)
    for field, jump in S.Limits().jump:
        cases = brute(rows, field, jump)
        if field == "dew":
            known = {c[:2] for c in hot}
            cases |= {(r[1], r[2], "impossible") for r in rows if r[4] is not None and r[3] is not None and r[4] > r[3] and (r[1], r[2]) not in known}
        column = 3 + ["temperature", "dew", "speed"].index(field)
        want |= {(r[0], field, k) for r in rows for s, t, k in cases if (r[1], r[2]) == (s, t) and r[column] is not None}
    assert got == want and len(want) > 50


def test_chart_clips_before_it_updates():
    x = np.array([10.0] * 20 + [90.0] + [10.0] * 5 + [11.0] * 3)
    found = S.signals(x, np.zeros(1, int), 6.0, S.Limits())
    assert found[20] and not found[22:26].any()
    assert not S.signals(np.zeros(0), np.zeros(0, int), 6.0, S.Limits()).any()
    twice = S.signals(np.concatenate((x, x[15:])), np.array([0, len(x)]), 6.0, S.Limits())
    assert (twice[: len(x)] == found).all() and twice[len(x) + 5]


@pytest.mark.parametrize("seed", range(20))
def test_chart_misses_no_spike(seed):
    """Everything that the exact check finds with all readings as suspects, it finds with the chart's."""
    rng = np.random.default_rng(seed)
    n = 4000
    x = np.cumsum(rng.normal(0, rng.choice([0.2, 2.0, 6.0]), n)) + np.repeat(rng.normal(0, 15, n // 100), 100)
    hit = rng.random(n) < 0.05
    x[hit] += rng.choice([-1, 1], hit.sum()) * rng.uniform(6, 40, hit.sum())
    series, everything = np.zeros(n, int), np.ones(n, bool)
    found, every = (set(S.spike_sizes(x, s, series, 6.0)[0].tolist()) for s in (S.signals(x, np.zeros(1, int), 6.0, S.Limits()), everything))
    assert found == every and found and S.spike_sizes(x, ~everything, series, 6.0)[0].size == 0


def test_no_readings(spark):
    empty = spark.createDataFrame([], "id long, source string, at timestamp, temperature double, dew double, speed double")
    assert S.implausible(empty).count() == 0
    nothing = spark.createDataFrame([(1, "a", DAY0, None, None, None)], empty.schema)
    assert S.implausible(nothing).count() == 0


def test_times_of_reports(spark):
    cases = [
        ("31", "1200", "2024-03-01 10:00:00", "2024-01-31 12:00:00"),
        ("30", "1200", "2024-03-01 10:00:00", "2024-01-30 12:00:00"),
        ("29", "0000", "2024-03-01 10:00:00", "2024-02-29 00:00:00"),
        ("01", "1001", "2024-03-01 10:00:00", "2024-02-01 10:01:00"),
        ("01", "1000", "2024-03-01 10:00:00", "2024-03-01 10:00:00"),
        ("31", "2359", "2024-01-01 00:00:00", "2023-12-31 23:59:00"),
        ("00", "1000", "2024-03-01 10:00:00", None),
        ("32", "1000", "2024-03-01 10:00:00", None),
        ("01", "2400", "2024-03-01 10:00:00", None),
        ("4", "1000", "2024-03-01 10:00:00", None),
        (None, "1000", "2024-03-01 10:00:00", None),
        ("01", "1000", None, None),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, d string, t string, r string")
    got = df.select("i", R.observed_at(df.d, df.t, df.r.cast("timestamp")).cast("string").alias("at")).orderBy("i").collect()
    assert [r["at"] for r in got] == [c[3] for c in cases]


def test_grid_equals_brute_force(spark):
    rng = random.Random(5)
    rows, want = [], set()
    for source, every in (("a", 60), ("b", 7), ("c", 1440), ("d", 90)):
        t = int(DAY0.timestamp())
        times = []
        for _ in range(50):
            t += rng.choice([every * 20, every * 60, every * 190, 86400 * 3 if every > 7 else 3600])
            if rng.random() < 0.03:
                t += rng.choice([30 * 86400, 30 * 86400 - 60, 31 * 86400])
            times.append(t)
            rows += [(source, dt.datetime.fromtimestamp(t, UTC), 1.0)] * rng.choice([1, 1, 2])
        slot = lambda x, e=every: x // 86400 * 86400 + x % 86400 // (e * 60) * e * 60
        for x, y in zip(times, times[1:]):
            if y - x < 30 * 86400:
                at = slot(x)
                while True:
                    at = at + every * 60 if (at + every * 60) // 86400 == at // 86400 else (at // 86400 + 1) * 86400
                    if at >= slot(y):
                        break
                    want.add((source, at))
    df = spark.createDataFrame(rows + [("a", None, 1.0), ("a", DAY0, None), ("none", DAY0, 2.0)], "source string, at timestamp, value double")
    sources = spark.createDataFrame([("a", 60), ("b", 7), ("c", 1440), ("d", 90), ("none", None)], "source string, every int")
    out = G.regular_grid(df, sources).collect()
    got = {(r.source, int(r.slot.replace(tzinfo=UTC).timestamp())) for r in out if r.status != "observed"}
    assert got == want and want
    assert all((r.value is None) == (r.status == "missing") for r in out)
    assert G.regular_grid(df.limit(0), sources).count() == 0


def test_filling_a_low_rank_matrix(spark):
    """Held-out cells of sources that move together come back near."""
    rng = np.random.default_rng(3)
    wave = 8 * np.sin(np.arange(240) / 24 * 2 * np.pi)
    rows, held = [], {}
    for s in range(12):
        for h in range(240):
            at, value = DAY0 + dt.timedelta(hours=h), float(10 + s + (0.5 + s / 10) * wave[h] + rng.normal(0, 0.1))
            if rng.random() < 0.15 and 0 < h < 239:
                held[(f"s{s}", at.replace(tzinfo=None))] = value
            else:
                rows.append((f"s{s}", at, value))
    df = spark.createDataFrame(rows, "source string, at timestamp, value double")
    sources = spark.createDataFrame([(f"s{s}", 60) for s in range(12)], "source string, every int")
    out = {(r.source, r.slot): r for r in G.regular_grid(df, sources).collect()}
    errors = [abs(out[k].value - v) for k, v in held.items() if out[k].status == "filled"]
    assert len(errors) > 0.9 * len(held) and float(np.mean(errors)) < 0.8
    seen = {(a, b.replace(tzinfo=None)): c for a, b, c in rows}
    assert all(abs(out[k].value - v) < 1e-9 and out[k].status == "observed" for k, v in seen.items())
