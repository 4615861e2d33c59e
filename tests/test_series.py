"""Series operators against brute force, and on awkward input."""

import random

import pytest
from pyspark.sql import functions as F

from dashgrid.operators.grid import regular_grid
from dashgrid.operators.rolling import daily_distance, rolling_totals
from dashgrid.operators.spikes import SpikeParams, find_spikes
from dashgrid.session import DAY_MS, PERIOD_START_MS

READ = "id bigint, vehicleId bigint, timestamp bigint, odoKm int, batteryPct int, rangeKm int"
BATCH = "rowId bigint, vehicleId bigint, capturedAt timestamp_ntz, odo int, battery int, range int"
HOUR = 3_600_000


def readings(spark, rows):
    return spark.createDataFrame(rows, READ)


def batch(spark, rows):
    d = spark.createDataFrame([(r[0], r[1], r[2], *r[3:]) for r in rows], "rowId bigint, vehicleId bigint, ms bigint, odo int, battery int, range int")
    return d.withColumn("capturedAt", F.expr("TIMESTAMP_NTZ'1970-01-01' + make_dt_interval(0, 0, 0, ms / 1000)")).drop("ms")


def trip(n=60, v=1):
    """A vehicle that drives 20 km every eight hours and is charged now and then."""
    out = []
    for i in range(n):
        battery = 90 - i % 6 * 12
        out.append([i + 1, v, PERIOD_START_MS + i * 8 * HOUR, 5000 + 20 * i, battery, 2 * battery])
    return out


def flags(spark, r, b=(), **kw):
    got = find_spikes(readings(spark, r), batch(spark, [*b]), SpikeParams(**kw)).collect()
    return {(x.record, x.record_id, x.field) for x in got}


def test_clean_source_has_no_cases(spark):
    r = trip()
    b = [(100 + i, 1, x[2], x[3], x[4], x[5]) for i, x in enumerate(r)]
    assert flags(spark, r, b) == set()


def test_spikes_bounds_and_clocks(spark):
    r = trip()
    r[20][3] = 50400          # a digit too many
    r[40][3] = 800            # a digit lost
    r[30][3] = -5
    r[50][2] = 0              # broken clock, odometer fine
    assert flags(spark, r) == {("readings", 21, "odoKm"), ("readings", 41, "odoKm"), ("readings", 31, "odoKm"), ("readings", 51, "timestamp")}


def test_stuck_odometer(spark):
    r = trip()
    for i in range(21, 31):
        r[i][3] = r[20][3]    # moved on by 200 km when it shows the truth again
    got = flags(spark, r)
    assert ("readings", 21, "odoKm") not in got
    assert {("readings", i + 1, "odoKm") for i in range(24, 31)} <= got and len(got) <= 10


def test_parked_vehicle_is_not_stuck(spark):
    r = trip()
    for i in range(21, 60):
        r[i][3] = r[20][3] + max(0, i - 31) * 20   # stands still, then drives as before
    assert flags(spark, r) == set()


def test_lasting_level_is_no_case(spark):
    r = trip()
    for i in range(30, 60):
        r[i][3] -= 4500
    assert flags(spark, r) == set()


def test_dense_slots_with_spikes_at_their_extremes(spark):
    r, spikes = [], set()
    for i, x in enumerate(trip(40)):
        for k, odo in enumerate([x[3]] * 7 + [x[3] - 2000 + 311 * (i % 5), x[3] + 2500 + 677 * (i % 7)]):
            r.append([10 * i + k, 1, x[2] + 1000 * k, odo, None, None])
            spikes |= {("readings", 10 * i + k, "odoKm")} if k > 6 else set()
    assert flags(spark, r) == spikes


def test_dense_source_with_spread_spikes(spark):
    rng, r, spikes = random.Random(11), [], set()
    for slot in range(40):   # 60 records in each five-minute slot, one in twenty of them far off
        for k in range(60):
            bad = rng.random() < 0.05
            r.append([60 * slot + k, 1, PERIOD_START_MS + 300_000 * slot + 4000 * k, 5000 + slot // 4 + (rng.choice((-1, 1)) * rng.randrange(400, 4000) if bad else 0), None, None])
            spikes |= {("readings", 60 * slot + k, "odoKm")} if bad else set()
    assert flags(spark, r) == spikes


def test_shards_agree_with_whole_sources(spark):
    rng, r = random.Random(4), [[i, v, x[2], x[3], x[4], x[5]] for v in (1, 2) for i, x in enumerate(trip(600, v), 1000 * v)]
    for x in rng.sample(r, 60):
        x[3] += rng.choice((-1, 1)) * rng.randrange(300, 900)
    for i in range(300, 330):
        r[i][3] = r[299][3]      # goes on for longer than a shard is
    b = [[5000 + i, x[1], x[2], x[3], x[4] if i % 9 else 5, x[5]] for i, x in enumerate(r) if i % 3 == 0]
    assert flags(spark, r, b, shard_slots=40, halo_slots=60) == flags(spark, r, b)


def test_rows_without_source_or_clock_join_nothing(spark):
    r = [[i, None if i % 2 else 1, PERIOD_START_MS if i % 2 else 5, 5000, None, None] for i in range(4000)] + [[9000, 1, PERIOD_START_MS, 5000, None, None]]
    assert flags(spark, r) == {("readings", i, "timestamp") for i in range(0, 4000, 2)}
    plan = find_spikes(readings(spark, r), batch(spark, []))._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan


def test_stuck_value_beside_the_moved_on_one(spark):
    r = [[i, 1, x[2], x[3], None, None] for i, x in enumerate(trip(40))]
    r += [[100 + i, 1, r[i][2] + 1000, r[5][3], None, None] for i in range(5, 13)]   # a second display, frozen at slot 5
    got = flags(spark, r)
    assert {("readings", 100 + i, "odoKm") for i in range(8, 13)} <= got <= {("readings", 100 + i, "odoKm") for i in range(6, 13)}


def test_batch_levels(spark):
    r = trip()
    b = [[100 + i, 1, x[2], x[3], x[4], x[5]] for i, x in enumerate(r)]
    b[10][4] += 25
    b[12][5] = 999
    b[14][4] = 143
    b += [[300, 1, b[10][2], None, b[10][4], None]]   # a repeated run counts too
    for i in range(41, 46):
        b[i][4] = b[40][4]
    want = {("batch_rows", 110, "battery"), ("batch_rows", 112, "range"), ("batch_rows", 114, "battery"), ("batch_rows", 300, "battery")}
    want |= {("batch_rows", 100 + i, "battery") for i in range(41, 46) if abs(b[i][4] - r[i][4]) >= 10}
    assert flags(spark, r, b) == want
    reasons = {(x.record_id, x.field): x.reason for x in find_spikes(readings(spark, r), batch(spark, b)).collect()}
    assert reasons[112, "range"] == "spike" and {reasons[i, f] for i, f in reasons if i > 140 and i < 150} == {"stuck"}


def test_batch_levels_without_saved_readings(spark):
    b = [[100 + i, 1, x[2], x[3], x[4], x[5]] for i, x in enumerate(trip())]
    b[9][4] += 30
    b[26][5] -= 70
    assert flags(spark, [], b) == {("batch_rows", 109, "battery"), ("batch_rows", 126, "range")}
    still = [[100 + i, 1, x[2], x[3], 71 if 20 <= i < 25 else x[4], 142 if 20 <= i < 25 else x[5]] for i, x in enumerate(trip())]
    got = flags(spark, [], still)
    assert {("batch_rows", 100 + i, f) for i in (22, 23, 24) for f in ("battery", "range")} <= got <= {("batch_rows", 100 + i, f) for i in range(20, 25) for f in ("battery", "range")}
    full = [[100 + i, 1, x[2], x[3], 80 if i % 4 else 60, 160 if i % 4 else 120] for i, x in enumerate(trip())]
    assert flags(spark, [], full) == set()   # charged to the same level again and again


def test_spikes_on_awkward_rows(spark):
    r = trip(20) + [[None, 1, PERIOD_START_MS, 5000, None, None], [200, None, PERIOD_START_MS, 7, None, None], [201, 1, None, 5000, 50, 100], [202, 1, PERIOD_START_MS, None, None, None]]
    r += [r[3]] * 2
    b = [(1, None, None, None, 120, None), (2, 1, None, None, None, None), (3, 7, PERIOD_START_MS, 5, 50, 90)]
    assert flags(spark, r, b) == {("batch_rows", 1, "battery")}
    assert flags(spark, []) == set()
    extra = readings(spark, trip(5)).selectExpr("*", "1 AS v", "'x' AS slot", "2 AS cur", "3 AS record")
    assert find_spikes(extra, batch(spark, []).selectExpr("*", "1 AS v", "2 AS slot")).count() == 0


def pchip(xs, ys, x):
    """Monotone cubic through all knots, by the textbook formulas."""
    h = [b - a for a, b in zip(xs, xs[1:])]
    d = [(b - a) / w for a, b, w in zip(ys, ys[1:], h)]
    s = [0.0] * len(xs)
    for i in range(1, len(xs) - 1):
        if d[i - 1] * d[i] > 0:
            w0, w1 = 2 * h[i] + h[i - 1], h[i] + 2 * h[i - 1]
            s[i] = (w0 + w1) / (w0 / d[i - 1] + w1 / d[i])

    def end(h0, h1, d0, d1):
        v = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        if v * d0 <= 0:
            return 0.0
        return 3 * d0 if d0 * d1 <= 0 and abs(v) > 3 * abs(d0) else v

    if len(xs) == 2:
        s = [d[0], d[0]]
    else:
        s[0], s[-1] = end(h[0], h[1], d[0], d[1]), end(h[-1], h[-2], d[-1], d[-2])
    i = max(k for k in range(len(h)) if xs[k] <= x)
    t = (x - xs[i]) / h[i]
    return (ys[i] * (1 + 2 * t) * (1 - t) ** 2 + h[i] * s[i] * t * (1 - t) ** 2 + ys[i + 1] * t * t * (3 - 2 * t) + h[i] * s[i + 1] * t * t * (t - 1))


@pytest.mark.parametrize("shard", [1, 3, 7, 1000])
def test_grid_against_brute_force(spark, shard):
    rng = random.Random(5)
    rows, want = [], {}
    for v in range(4):
        days = sorted(rng.sample(range(19400, 19490), 25))
        ys = [1000.0]
        for _ in days[1:]:
            ys.append(ys[-1] + rng.choice([0, 5, 40, -3]))
        rows += [(v, d * DAY_MS + 77, y) for d, y in zip(days, ys)]
        segments, start = [], 0
        for i in range(1, len(days) + 1):
            if i == len(days) or days[i] - days[i - 1] > 9:
                segments.append((start, i))
                start = i
        for d in range(days[0], days[-1] + 1):
            want[v, d] = ("observed", ys[days.index(d)]) if d in days else ("gap", None)
        for a, z in segments:
            for d in range(days[a], days[z - 1] + 1):
                if d not in days:
                    want[v, d] = ("filled", pchip(days[a:z], ys[a:z], d))
    g = regular_grid(spark.createDataFrame(rows, "s bigint, t bigint, y double"), "s", "t", "y", shard_cells=shard, max_gap=9)
    got = {(r.source, r.cell): (r.status, r.value) for r in g.collect()}
    assert got.keys() == want.keys()
    for k, (status, value) in want.items():
        assert got[k][0] == status and (value is None and got[k][1] is None or abs(got[k][1] - value) < 1e-6), k


def test_grid_on_awkward_rows(spark):
    s = "s bigint, t bigint, y int, source string, x int, n int, own string, ok boolean"
    rows = [(1, 0, 5, "a", 1, 1, "b", True), (1, 0, 5, "a", 1, 1, "b", True), (1, 3 * DAY_MS, 8, "a", 1, 1, "b", True), (1, DAY_MS, 999, "z", 1, 1, "b", False), (1, 2 * DAY_MS, None, None, None, None, None, None),
            (None, 0, 1, None, 1, 1, None, None), (2, None, 1, None, 1, 1, None, None), (3, 9 * DAY_MS, 4, "a", 1, 1, "b", None)]
    d = spark.createDataFrame(rows, s)
    got = {(r.source, r.cell): (r.n, r.value, r.status) for r in regular_grid(d, "s", "t", "y", ok=F.col("ok")).collect()}
    assert got == {(1, 0): (2, 5.0, "observed"), (1, 1): (1, 6.0, "observed"), (1, 2): (0, 7.0, "filled"), (1, 3): (1, 8.0, "observed"), (3, 9): (1, None, "observed")}
    assert regular_grid(d.where("s > 9"), "s", "t", "y").count() == 0


def test_rolling_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(3), rng.randrange(100, 190), float(rng.randrange(9))) for _ in range(120)]
    got = rolling_totals(spark.createDataFrame(rows, "s bigint, d bigint, a double"), "s", "d", ["a"], (1, 7, 30, 45)).collect()
    days = {}
    for s, d, a in rows:
        days[s, d] = days.get((s, d), 0) + a
    assert len(got) == sum(max(d for t, d in days if t == s) - min(d for t, d in days if t == s) + 1 for s in range(3))
    for r in got:
        for w in (1, 7, 30, 45):
            total = sum(days.get((r.source, r.day - k), 0) for k in range(w))
            assert r[f"a_{w}d"] == total and abs(r[f"a_{w}d_avg"] - total / w) < 1e-9


def test_rolling_on_awkward_rows(spark):
    d = spark.createDataFrame([(1, 5, None, "x"), (1, 5, 2.0, "x"), (1, 5, 2.0, "x"), (None, 5, 1.0, "x"), (1, None, 1.0, "x"), (1, 7, 1.0, None)], "s bigint, day bigint, a double, source string")
    got = {r.day: (r.a, r.a_7d) for r in rolling_totals(d, "s", "day", ["a"]).collect()}
    assert got == {5: (4.0, 4.0), 6: (0.0, 4.0), 7: (1.0, 5.0)}
    assert rolling_totals(d.where("s > 9"), "s", "day", ["a"]).count() == 0


def test_daily_distance(spark):
    d = spark.createDataFrame([(1, 1, 0, 100), (2, 1, HOUR, 110), (3, 1, DAY_MS, None), (4, 1, 2 * DAY_MS, 150), (5, 1, 3 * DAY_MS, 20)], "id bigint, s bigint, t bigint, o int")
    got = {r.day: (r.km, r.n) for r in daily_distance(d, "s", "t", "o", "id").collect()}
    assert got == {0: (10.0, 2), 1: (0.0, 0), 2: (40.0, 1), 3: (0.0, 1)}
