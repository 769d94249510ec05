"""Trajectories of poses against loops in plain Python."""

import bisect
import math
import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import poses as P
from strandline.operators import scans

KIND = "k string, i long, t double, pose struct<position array<double>, rotation array<double>>"


def turn(rng):
    q = [rng.gauss(0, 1) for _ in range(4)]
    n = math.sqrt(sum(x * x for x in q))
    return [x / n for x in q]


def made(seed, sizes):
    rng = random.Random(seed)
    rows = []
    for k, n in sizes.items():
        t = 0.0
        for i in range(n):
            t += rng.choice([0.1, 0.5, 2.0])
            rows.append((k, i, t, ([rng.uniform(-3, 3) for _ in range(3)], turn(rng))))
    return rows


def least(a, b, speed, turning):
    way = math.dist(a[0], b[0]) / speed
    return max(way, 2 * math.acos(min(1, abs(sum(x * y for x, y in zip(a[1], b[1]))))) / turning)


def at(track, t):
    """The pose of [(time, pose), ...] at a time."""
    times = [x[0] for x in track]
    if t <= times[0] or len(track) == 1:
        return track[0][1]
    if t >= times[-1]:
        return track[-1][1]
    j = bisect.bisect_right(times, t) - 1
    if times[j] == t:
        return track[j][1]
    (ta, a), (tb, b) = track[j], track[j + 1]
    s = (t - ta) / (tb - ta)
    dot = sum(x * y for x, y in zip(a[1], b[1]))
    sign = -1 if dot < 0 else 1
    angle = math.acos(min(1, abs(dot)))
    wa, wb = (1 - s, s) if abs(dot) > 0.9995 else (math.sin((1 - s) * angle) / math.sin(angle), math.sin(s * angle) / math.sin(angle))
    q = [x * wa + y * wb * sign for x, y in zip(a[1], b[1])]
    n = math.sqrt(sum(x * x for x in q))
    return [x + (y - x) * s for x, y in zip(a[0], b[0])], [x / n for x in q]


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: r[0]), sorted(want, key=lambda r: r[0])):
        assert g[0] == pytest.approx(w[0], abs=1e-9)
        assert list(g[1][0]) == pytest.approx(list(w[1][0]), abs=1e-9) and list(g[1][1]) == pytest.approx(list(w[1][1]), abs=1e-7)


def tracks(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.k, []).append((r.t, (r.pose.position, r.pose.rotation)))
    return out


@pytest.fixture
def data(spark, monkeypatch):
    monkeypatch.setattr(scans, "BLOCK", 6)
    rows = made(5, {"a": 50, "b": 1, None: 20})
    by = {}
    for k, _, t, p in rows:
        by.setdefault(k, []).append((t, p))
    return spark.createDataFrame(rows, KIND).repartition(3), by


def test_arrivals_respect_the_limits(spark, data):
    df, by = data
    got = {(r.k, r.i): r.arrival for r in P.arrivals(df, ["k"], "i", "t", 2.0, 1.0).collect()}
    for k, track in by.items():
        t = None
        for i, (asked, p) in enumerate(track):
            t = asked if t is None else max(asked, t + least(track[i - 1][1], p, 2.0, 1.0))
            assert got[k, i] == pytest.approx(t, abs=1e-9)


def test_poses_at_any_time(spark, data):
    df, by = data
    rng = random.Random(2)
    asked = [(k, n, rng.uniform(-1, 60)) for k in by for n in range(30)] + [("a", 100 + n, t) for n, (t, _) in enumerate(by["a"])] + [("none", 0, 1.0)]
    rows = P.pose_at(spark.createDataFrame(asked, "k string, n long, at double"), df, ["k"], "at", "t", 3.0).collect()
    assert len(rows) == len(asked)
    for r in rows:
        if r.k == "none":
            assert r.pose is None
        else:
            same([(0, (r.pose.position, r.pose.rotation))], [(0, at(by[r.k], r["at"]))])


def trimmed(track, lo, hi):
    times = sorted({lo, hi} | {t for t, _ in track if lo < t < hi})
    return [(t, at(track, t)) for t in times]


def test_trim_keeps_the_part_and_its_ends(spark, data):
    df, by = data
    spans = [("a", 5.0, 17.3), ("b", 0.0, 9.0), (None, 4.0, 4.0)]
    got = tracks(P.trim(df, spark.createDataFrame(spans, "k string, lo double, hi double"), ["k"], "t", "lo", "hi", 2.0))
    for k, lo, hi in spans:
        same(got[k], trimmed(by[k], lo, hi))


TARGET = ([1.0, 2.0, 3.0], [0.5, 0.5, 0.5, 0.5])
COMMANDS = "k string, when double, target struct<position array<double>, rotation array<double>>, now double, last double"


def test_drive_to_a_target(spark, data):
    df, by = data
    commands = [("a", 8.0, TARGET, 7.5, None), (None, 100.0, TARGET, 3.0, None), ("b", 0.0, TARGET, 2.0, None)]
    got = tracks(P.drive_to(df, spark.createDataFrame(commands, COMMANDS), ["k"], "t", 1.5, 0.5, 4.0))
    for k, when, target, now, _ in commands:
        here = at(by[k], now)
        same(got[k], [(now, here), (now + max(max(when, now) - now, least(here, target, 1.5, 0.5)), target)])


@pytest.mark.parametrize("when,now,last", [(80.0, None, None), (6.0, None, None), (10.0, 4.0, None), (10.0, 4.0, 8.0), (10.0, 4.0, 12.0), (10.0, 4.0, 3.0), (4.0, 5.0, None)])
def test_schedule_a_target(spark, data, when, now, last):
    df, by = data
    got = tracks(P.schedule(df, spark.createDataFrame([("a", when, TARGET, now, last)], COMMANDS), ["k"], "t", 1.5, 0.5, 4.0))
    track = by["a"]
    same(got[None], by[None])
    if now is not None and when <= now:
        same(got["a"], track)
        return
    start, end = track[0][0], track[-1][0]
    if now is not None:
        start = max(now, start)
        end = now if last is None or when <= last else max(last, now)
    end = min(end, when)
    start = min(start, end)
    want = trimmed(track, start, end)
    want.append((end + max(when - end, least(at(track, end), TARGET, 1.5, 0.5)), TARGET))
    same(got["a"], want)
