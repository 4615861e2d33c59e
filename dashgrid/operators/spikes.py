"""Implausible values in measurements, judged by each source's own behaviour.

Method: per source a *track* is built from all its records, one entry per five-minute slot that holds each
distinct value with its number of records. A Hampel filter (rolling median and median absolute deviation,
weighted by each value's share of its slot) runs over the odometer's track and over the residuals of battery
and range against what the slot's other records tell; stuck values are runs: an odometer value shown again
after the source's other records (first showings, batch values) moved on, a battery or range shown alike by
successive photos while the expected level left it; physical bounds come first. Every raw row is then held
against its own slot by an equi-join.

Scale: equal values of a slot are counted map-side, so a source that holds a third of all rows contributes
each slot's distinct values once. Sources with more than ``shard_slots`` slots are cut into time shards; a
shard also gets the days that hold at least ``halo_slots`` slots on either side, which all windows stay within (a
lookup for the last or next anchor ends at the halo). Shards, not sources, are the unit of work, in numpy
over many shards at once. Raw rows meet the track on (source, slot), a key that spreads a hot source over
its slots; rows without a source join nothing, rows without a usable clock meet salted extents of their source.

Defined results: null values and nulls in any other column give no case for that value; a row without
a source or with a clock outside the period is judged by the bounds (and, if its source is known, by
the extent of the source's plausible values); repeated rows are each judged; an empty table gives no
rows; extra columns are ignored. Source ids are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import DAY_MS, PERIOD_END_MS, PERIOD_START_MS

MAD_SCALE = 1.4826
#: Weight of a slot's readings, or batch values, in the rolling windows; up to 16 records share it without a rest.
VOTE = 720_720
#: Kinds of values in a track: odometer, battery and range as saved, and as extracted from photos.
ODO, BATCH_ODO, BATTERY, RANGE, BATCH_BATTERY, BATCH_RANGE = range(6)
_KIND = 1 << 40
#: A source's extent is handed out this many times, so that rows without a usable clock don't meet in one task.
SALTS = 8
BANDS = ("h_lo", "h_hi", "n_lo", "n_hi", "b_lo", "b_hi", "r_lo", "r_hi")
STUCK = ("stuck_o", "stuck_b", "stuck_r")


@dataclass(frozen=True)
class SpikeParams:
    """Thresholds, in the units of the fields."""

    start_ms: int = PERIOD_START_MS
    end_ms: int = PERIOD_END_MS
    slot_ms: int = 300_000
    half: int = 6               # slots on either side in the odometer's rolling median
    n_sigma: float = 3.0
    odo_max: int = 999_999
    odo_floor: float = 150.0    # least deviation of an odometer spike, km
    stuck_km: float = 20.0      # distance after which an unchanged odometer counts as stuck
    stuck_max_km: float = 20_000.0  # beyond it the level has changed
    step_max_km: int = 400      # a longer step doesn't count for a source's usual rate
    rate_factor: float = 2.0    # times the usual rate that may be driven unseen
    battery_floor: float = 10.0
    range_max: int = 999
    range_floor: float = 12.0
    stuck_level: float = 10.0   # deviation from which an unchanged battery or range counts as stuck
    level_half: int = 12        # photos on either side in the residuals' rolling median
    ratio_half: int = 25        # slots on either side for the km-per-percent ratio
    shard_slots: int = 4096
    halo_slots: int = 256


def _millis(c: str) -> Column:
    """Epoch milliseconds of a zone-less timestamp column, whatever the session's zone."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})")


def _values(readings: DataFrame, batch_rows: DataFrame, p: SpikeParams) -> DataFrame:
    """(v, slot, kv): every usable value of every record, its kind packed above it."""
    def side(rows: DataFrame, ms: Column, fields: dict[str, tuple[int, int]]) -> DataFrame:
        packed = F.array(*(F.when(F.col(c).between(0, top), F.col(c).cast("long") + F.lit(kind * _KIND)) for c, (kind, top) in fields.items()))
        rows = rows.where(F.col("vehicleId").isNotNull() & ms.between(p.start_ms, p.end_ms - 1))
        return rows.select(F.col("vehicleId").cast("long").alias("v"), F.floor(ms / p.slot_ms).alias("slot"), F.explode(F.array_compact(packed)).alias("kv"))

    return side(readings, F.col("timestamp"), {"odoKm": (ODO, p.odo_max), "batteryPct": (BATTERY, 100), "rangeKm": (RANGE, p.range_max)}).unionByName(
        side(batch_rows, _millis("capturedAt"), {"odo": (BATCH_ODO, p.odo_max), "battery": (BATCH_BATTERY, 100), "range": (BATCH_RANGE, p.range_max)}))


def _shards(readings: DataFrame, batch_rows: DataFrame, p: SpikeParams) -> DataFrame:
    """(v, day, parts) of sources with more slots than a shard holds: the shards a day's slots go to, and whether as their own.

    A day's slots are counted by bits, map-side; the running sums go over at most one row per day of the period.
    """
    a_day = DAY_MS // p.slot_ms
    ms = lambda r, c: r.where("vehicleId is not null").select(F.col("vehicleId").cast("long").alias("v"), c.alias("ms"))
    at = ms(readings, F.col("timestamp")).unionByName(ms(batch_rows, _millis("capturedAt"))).where(F.col("ms").between(p.start_ms, p.end_ms - 1))
    at = at.select("v", F.floor(F.col("ms") / (a_day * p.slot_ms)).alias("day"), (F.floor(F.col("ms") / p.slot_ms) % a_day).cast("int").alias("s"))
    words = -(-a_day // 64)
    bits = [F.bit_or(F.when(F.floor(F.col("s") / 64) == i, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("s") % 64))).alias(f"w{i}") for i in range(words)]
    days = at.groupBy("v", "day").agg(*bits)
    days = days.select("v", "day", sum((F.coalesce(F.bit_count(f"w{i}"), F.lit(0)) for i in range(words)), F.lit(0)).alias("n"))
    up = F.sum("n").over(W.partitionBy("v").orderBy("day"))
    days = days.withColumns({"end": up, "total": F.sum("n").over(W.partitionBy("v"))}).where(F.col("total") >= 2 * p.shard_slots)
    last = F.floor(F.col("total") / p.shard_slots) - 1  # the last shard takes the rest
    own = F.least(F.floor((F.col("end") - F.col("n")) / p.shard_slots), last)
    back = F.when((own > 0) & (F.col("end") - F.col("n") < own * p.shard_slots + a_day + p.halo_slots), own - 1)
    on = F.when((own < last) & (F.col("end") + p.halo_slots > (own + 1) * p.shard_slots), own + 1)
    part = lambda c, mine: F.when(c.isNotNull(), F.struct(c.alias("shard"), F.lit(mine).alias("own")))
    return days.select("v", "day", F.array_compact(F.array(part(own, True), part(back, False), part(on, False))).alias("parts"))


def judge_track(readings: DataFrame, batch_rows: DataFrame, p: SpikeParams) -> DataFrame:
    """One row per source and slot: bands and stuck values of its fields; and the source's extent under slots below zero."""
    counted = _values(readings, batch_rows, p).groupBy("v", "slot", "kv").agg(F.count(F.lit(1)).alias("n"))
    day = F.floor(F.col("slot") / (DAY_MS // p.slot_ms))
    one = F.array(F.struct(F.lit(0).cast("long").alias("shard"), F.lit(True).alias("own")))
    rows = counted.withColumn("day", day).join(_shards(readings, batch_rows, p), ["v", "day"], "left").withColumn("part", F.explode(F.coalesce("parts", one)))
    rows = rows.select("v", "part.shard", "slot", "kv", "n", "part.own").repartition("v", "shard").sortWithinPartitions("v", "shard", "slot", "kv")
    schema = "v long, slot long, " + ", ".join(f"{c} double" for c in BANDS) + ", " + ", ".join(f"{c} array<int>" for c in STUCK)
    out = rows.mapInArrow(_judge_batches(p), schema)
    # a source's extents come from each of its shards; all else has one row anyway
    wide = {"h_lo": F.min, "n_lo": F.min, "h_hi": F.max, "n_hi": F.max}
    return out.groupBy("v", "slot").agg(*(wide.get(c, F.first)(c).alias(c) for c in BANDS), *(F.first(c).alias(c) for c in STUCK))


def _judge_batches(p: SpikeParams, rows: int = 60_000):
    """Judges whole shards, as many at a time as make about so many rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append({c: b.column(c).to_numpy(zero_copy_only=False) for c in b.schema.names})
            size += b.num_rows
            if size >= rows:
                whole = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
                same = (whole["v"] == whole["v"][-1]) & (whole["shard"] == whole["shard"][-1])
                cut = size - int(same.sum())  # rows are sorted, so the last shard's are the last
                if cut:
                    yield _judge({c: a[:cut] for c, a in whole.items()}, p)
                held, size = [{c: a[cut:] for c, a in whole.items()}], size - cut
        if size:
            yield _judge({c: np.concatenate([h[c] for h in held]) for c in held[0]}, p)

    return run


def _pick(values: np.ndarray, weights: np.ndarray, starts: np.ndarray, ends: np.ndarray, rank) -> np.ndarray:
    """Of each segment, sorted by value, the value at a 0-based rank (a function of the total weight); NaN if it weighs nothing."""
    sums = np.concatenate([[0], np.cumsum(weights)])
    total = sums[ends] - sums[starts]
    at = np.searchsorted(sums[1:], sums[starts] + rank(total), side="right")
    return np.where(total > 0, values[np.minimum(at, len(values) - 1)] if len(values) else 0, np.nan)


_LOW, _HIGH = (lambda n: (n - 1) // 2), (lambda n: n // 2)


def _windows(offsets: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries of the owners lo to hi (excluded) of every window: (window, entry, starts, ends of the windows)."""
    first, n = offsets[lo], offsets[hi] - offsets[lo]
    ends = np.cumsum(n)
    starts = ends - n
    window = np.repeat(np.arange(len(lo)), n)
    return window, np.arange(len(window)) - starts[window] + first[window], starts, ends


def _by_value(window: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Order by window, then value; windows come in order already."""
    return np.lexsort((values, window))


def _filled(known: np.ndarray, start: np.ndarray, strictly: bool) -> np.ndarray:
    """Per place the last known place at or (strictly) before it within its group; -1 if there is none."""
    at = np.maximum.accumulate(np.where(known, np.arange(len(known)), -1)) if len(known) else known.astype(int)
    if strictly:
        at = np.concatenate([[-1], at[:-1]])
    return np.where(at >= start, at, -1)


def _next(known: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Per place the next known place after it within its group; -1 if there is none."""
    n = len(known)
    at = n - 1 - _filled(known[::-1], np.zeros(n, int), True)[::-1]
    return np.where(at < end, at, -1)


def _take(a: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.where(at >= 0, a[at], np.nan)


def _span(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sums over places lo to hi (excluded); NaN counts as nothing."""
    s = np.concatenate([[0.0], np.cumsum(np.nan_to_num(a))])
    return s[hi] - s[lo]


def _over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, NaN where b is 0 or either is missing."""
    return a / np.where(b == 0, np.nan, b)


def _or(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(a), b, a)


def _runs(group: np.ndarray, value: np.ndarray, place: np.ndarray, step: int | None) -> np.ndarray:
    """Length of the run each showing ends: showings of one value by one group, at successive places if ``step`` is 1."""
    order = np.lexsort((place, value, group))
    g, x, q = group[order], value[order], place[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (x[1:] != x[:-1])
    if step is not None:
        new[1:] |= q[1:] - q[:-1] != step
    i = np.arange(len(g))
    out = np.empty(len(g), np.int64)
    out[order] = i - np.maximum.accumulate(np.where(new, i, 0)) + 1
    return out


def _lists(slots: int, owner: np.ndarray, values: np.ndarray) -> list[np.ndarray]:
    """Offsets and values of one list per slot; owners are in order."""
    return [np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=slots))]), values]


def _judge(d: dict[str, np.ndarray], p: SpikeParams) -> pa.RecordBatch:
    """Bands and stuck values of whole shards; NaN stands for what isn't known."""
    v, shard, slot_, n = d["v"], d["shard"], d["slot"], d["n"]
    kind, val = d["kv"] // _KIND, d["kv"] % _KIND
    new_group = np.r_[True, (v[1:] != v[:-1]) | (shard[1:] != shard[:-1])]
    new_slot = new_group | np.r_[True, slot_[1:] != slot_[:-1]]
    heads = np.flatnonzero(new_slot)
    S, owner = len(heads), np.cumsum(new_slot) - 1
    slot, own, group = slot_[heads], d["own"][heads].astype(bool), (np.cumsum(new_group) - 1)[heads]
    bounds = np.searchsorted(group, np.arange(group[-1] + 2))
    start, end, i = bounds[group], bounds[group + 1], np.arange(S)
    around = lambda h: (np.maximum(start, i - h), np.minimum(end, i + h + 1))

    def of(*kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Owners, values and counts of the kinds' entries, and the offsets of the slots in them."""
        m = np.isin(kind, kinds)
        return owner[m], val[m].astype(float), n[m], np.concatenate([[0], np.cumsum(np.bincount(owner[m], minlength=S))])

    def level(k: int) -> tuple[np.ndarray, np.ndarray]:
        _, x, w, at = of(k)
        total = np.concatenate([[0], np.cumsum(w)])
        return (_pick(x, w, at[:-1], at[1:], _LOW) + _pick(x, w, at[:-1], at[1:], _HIGH)) / 2, total[at[1:]] - total[at[:-1]]

    # odometer: the Hampel centre and scale, and the band spanned by what was shown before and after
    xo, x, xn, at = of(ODO, BATCH_ODO)
    batch = kind[np.isin(kind, (ODO, BATCH_ODO))] == BATCH_ODO
    # a slot's readings, and likewise its batch values, have one vote together, shared by their counts
    seat = 2 * xo + batch
    votes = np.maximum(1, xn * VOTE // np.maximum(1, np.bincount(seat, xn, 2 * S).astype(np.int64)[seat]))
    lo, hi = around(p.half)
    window, entry, s, e = _windows(at, lo, hi)
    order = _by_value(window, x[entry])
    entry, near = entry[order], votes[entry[order]]
    side = xo[entry]
    value = x[entry]
    med = _pick(value, near, s, e, _LOW)
    q1, q3 = (_pick(value, near, s, e, f) for f in (lambda t: t // 4, lambda t: 3 * t // 4))
    sides = [(_pick(value, w, s, e, _LOW), _pick(value, w, s, e, _HIGH)) for w in (near * (side < window), near * (side > window))]
    off = np.abs(value - med[window])
    order = _by_value(window, off)
    mad = _pick(off[order], near[order], s, e, _LOW)
    there = np.bincount(np.unique(seat) // 2, minlength=S).astype(float)
    few = (2 * _span(there, lo, i) < p.half) | (2 * _span(there, np.minimum(i + 1, hi), hi) < p.half)
    tol = np.maximum(p.odo_floor, p.n_sigma * MAD_SCALE * mad)
    slack = p.odo_floor + np.where(few, 2 * (q3 - q1), 0)  # one-sided near a source's ends
    h_lo, h_hi = med - tol, med + tol
    n_lo = _or(np.fmin(sides[0][0], sides[1][0]) - slack, h_lo)
    n_hi = _or(np.fmax(sides[0][1], sides[1][1]) + slack, h_hi)
    ok = ~((x < h_lo[xo]) & (x < n_lo[xo]) | (x > h_hi[xo]) & (x > n_hi[xo]))
    # stuck: a run of an odometer value that goes on while its anchors (first showings and batch values) have moved on
    run = np.zeros(len(x), np.int64)
    run[~batch] = _runs(group[xo[~batch]], x[~batch], xo[~batch], None)
    shown, fresh = ok & ~batch, ok & (run == 1)
    cur, low, first = np.full(S, -np.inf), np.full(S, np.inf), np.full(S, -np.inf)
    np.maximum.at(cur, xo[shown], x[shown])
    np.minimum.at(low, xo[shown], x[shown])
    np.maximum.at(first, xo[fresh], x[fresh])
    cur, low, first = (np.where(np.isinf(a), np.nan, a) for a in (cur, low, first))
    bo = np.flatnonzero(batch & ok)
    bo_at = np.concatenate([[0], np.cumsum(np.bincount(xo[bo], minlength=S))])
    bcur = _pick(x[bo], xn[bo], bo_at[:-1], bo_at[1:], _LOW)
    seen = lambda a: ~np.isnan(a)
    prev = _take(first, _filled(seen(first), start, True))
    gap = slot - _take(slot.astype(float), _filled(seen(cur), start, True))
    anchor = _or(bcur, first)
    step = np.where(first > prev, np.minimum(p.step_max_km, first - prev), 0.0)
    rate = np.maximum(*(_span(step, a, z) / np.maximum(1, slot[z - 1] - slot[a]) for a, z in (around(p.ratio_half), (start, end))))  # the whole shard's where it stood still for long
    pa_, na = _filled(seen(anchor), start, False), _next(seen(anchor), end)
    p_val, n_val, p_slot, n_slot = _take(anchor, pa_), _take(anchor, na), _take(slot.astype(float), pa_), _take(slot.astype(float), na)
    share = (slot - p_slot) / np.maximum(1, n_slot - p_slot)
    # a slot's own first showing may be misread upwards, so the next anchor must bear it out
    reckoned = np.where(na < 0, p_val, np.where(~seen(bcur) & seen(first), np.fmin(p_val, n_val), p_val + share * (n_val - p_val)))
    # the distance up to the next anchor can't all have been driven after the last unchanged record
    moved = np.where(seen(bcur), np.nan, n_val - p.stuck_km - p.rate_factor * rate * _take(gap, na))
    moved = np.fmin(reckoned - p.stuck_km, moved)
    stuck = ok & (run > 1) & (x < moved[xo]) & (x > (reckoned - p.stuck_max_km)[xo])
    lists = [_lists(S, xo[stuck], x[stuck])]

    # battery and range of photos: what the slot's saved records tell, one from the other by the source's ratio if need be
    (b, _), (r, _), (bb, nbb), (br, nbr) = (level(k) for k in (BATTERY, RANGE, BATCH_BATTERY, BATCH_RANGE))
    wide = around(p.ratio_half)
    ratio = lambda c, per: _over(_span(np.where(seen(c) & seen(per), c, np.nan), *wide), _span(np.where(seen(c) & seen(per), per, np.nan), *wide))
    k = ratio(r, b)
    eb, er = _or(b, _over(r, k)), _or(r, b * k)
    k = _or(np.where(k == 0, np.nan, k), ratio(br, bb))
    k[k == 0] = np.nan
    km = _or(bcur, reckoned)
    unsaved = ~seen(b) & ~seen(r)
    frozen = _frozen(p, group, start, km, k, bb, br) & unsaved
    eb, er = _expect_unsaved(p, start, end, km, k, unsaved, bb, br, eb, er)
    out = {"h_lo": h_lo, "h_hi": h_hi, "n_lo": n_lo, "n_hi": n_hi}
    for c, shown_, count, told, floor, which in (("b", bb, nbb, eb, p.battery_floor, BATCH_BATTERY), ("r", br, nbr, er, p.range_floor, BATCH_RANGE)):
        told = _or(told, np.where(count > 1, shown_, np.nan))  # the photo's other runs
        known = np.flatnonzero(seen(shown_) & seen(told))
        res = (shown_ - told)[known]
        g = np.searchsorted(group[known], group[known]), np.searchsorted(group[known], group[known], side="right")
        j = np.arange(len(known))
        window, entry, s, e = _windows(np.arange(len(known) + 1), np.maximum(g[0], j - p.level_half), np.minimum(g[1], j + p.level_half + 1))
        ones = np.ones(len(entry), np.int64)
        centre = _pick(res[entry][_by_value(window, res[entry])], ones, s, e, _LOW)
        off = np.abs(res[entry] - centre[window])
        width = np.maximum(floor, p.n_sigma * MAD_SCALE * _pick(off[_by_value(window, off)], ones, s, e, _LOW))
        out |= {f"{c}_lo": np.full(S, np.nan), f"{c}_hi": np.full(S, np.nan)}
        out[f"{c}_lo"][known], out[f"{c}_hi"][known] = told[known] + centre - width, told[known] + centre + width
        eo, ex, _, _ = of(which)
        photo = np.cumsum(np.bincount(eo, minlength=S) > 0)  # photos that show the field, numbered
        still = (_runs(group[eo], ex, photo[eo], 1) > 1) & ~unsaved[eo] & (np.abs(ex - told[eo]) >= p.stuck_level) | frozen[eo] & (ex == shown_[eo])
        lists.append(_lists(S, eo[still], ex[still]))
    return _rows(v[heads], slot, own, bounds, low, cur, out, lists, p)


def _expect_unsaved(p: SpikeParams, start, end, km, k, unsaved, bb, br, eb, er) -> tuple[np.ndarray, np.ndarray]:
    """Fills the expected battery and range of slots whose readings saved neither.

    One field tells the other by the km-per-percent ratio if a neighbouring slot, less what was driven since, bears it
    out; else two neighbours that agree tell it.
    """
    level_b, level_r = _or(eb, bb), _or(er, br)
    known = ~np.isnan(level_b + level_r + km)
    last, following = _filled(known, start, True), _next(known, end)
    used, left = km - _take(km, last), _take(km, following) - km
    out = []
    for e, of, level, floor, per in ((eb, br / k, level_b, p.battery_floor, k), (er, bb * k, level_r, p.range_floor, 1.0)):
        before, after = _take(level, last) - used / per, _take(level, following) + left / per
        borne_out = (np.abs(of - before) <= floor) | (np.abs(of - after) <= floor)
        told = np.where(borne_out, of, np.where(np.abs(before - after) <= floor, (before + after) / 2, np.nan))
        out.append(np.where(np.isnan(e) & unsaved, told, e))
    return out[0], out[1]


def _frozen(p: SpikeParams, group, start, km, k, bb, br) -> np.ndarray:
    """Photos of a display that shows the same battery and range, which the source shows in one run of at least three
    photos only, after driving too far for that."""
    S, photo = len(km), np.flatnonzero(~np.isnan(bb + br))
    out = np.zeros(S, bool)
    if not len(photo):
        return out
    g, pair = group[photo], bb[photo] * 4096 + br[photo]
    begins = np.r_[True, (g[1:] != g[:-1]) | (pair[1:] != pair[:-1])]
    _, which, shows = np.unique(np.stack([g, pair]), axis=1, return_inverse=True, return_counts=True)
    which = which.ravel()
    one_run = (np.bincount(which, begins)[which] == 1) & (shows[which] >= 3) & (shows[which] < np.bincount(g)[g])
    known = np.zeros(S, bool)
    known[photo[begins & ~np.isnan(km[photo])]] = True
    driven = km - _take(km, _filled(known, start, False))
    out[photo[one_run & ~begins]] = True
    return out & (driven > p.battery_floor * k) & (driven > p.range_floor)


def _rows(v, slot, own, bounds, low, cur, bands, lists, p: SpikeParams) -> pa.RecordBatch:
    """The shards' own slots, and their extents under slots -1, -2 ... for records whose clock is no help."""
    at = np.flatnonzero(own)
    groups = np.repeat(np.arange(len(bounds) - 1), SALTS)
    known = ~np.isnan(low)
    least = np.fmin.reduceat(np.where(known, low, np.inf), bounds[:-1])[groups] - p.odo_floor
    most = np.fmax.reduceat(np.where(known, cur, -np.inf), bounds[:-1])[groups] + p.odo_floor
    extent = {"h_lo": least, "n_lo": least, "h_hi": most, "n_hi": most}
    blank = np.full(len(groups), np.nan)
    cols = [pa.array(np.r_[v[at], v[bounds[:-1]][groups]]), pa.array(np.r_[slot[at], np.tile(-1 - np.arange(SALTS), len(bounds) - 1)])]
    for c in BANDS:
        a = np.r_[bands[c][at], extent.get(c, blank)]
        cols.append(pa.array(a, mask=~np.isfinite(a)))
    for offsets, values in lists:
        size = np.r_[np.diff(offsets)[at], np.zeros(len(groups), int)]
        mine = own[np.repeat(np.arange(len(slot)), np.diff(offsets))]
        full = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(values[mine].astype(np.int32)), mask=pa.array(size == 0))
        cols.append(full)
    return pa.RecordBatch.from_arrays(cols, names=["v", "slot", *BANDS, *STUCK])


def find_spikes(readings: DataFrame, batch_rows: DataFrame, p: SpikeParams = SpikeParams()) -> DataFrame:
    """Every implausible value as (record, record_id, field, vehicle_id, value, reason)."""
    in_time = F.coalesce(F.col("timestamp").between(p.start_ms, p.end_ms - 1), F.lit(False))
    salted = -1 - F.pmod(F.xxhash64("id", "odoKm"), F.lit(SALTS))
    none = lambda t, *names: [F.lit(None).cast(t).alias(c) for c in names]
    rows = readings.select(F.lit("readings").alias("record"), F.col("id").alias("record_id"), F.col("vehicleId").alias("v"), F.when(in_time, F.expr(f"timestamp div {p.slot_ms}")).otherwise(salted).alias("slot"),
                           F.when(F.col("timestamp").isNotNull() & ~in_time, F.col("timestamp")).alias("bad_time"), F.col("odoKm").alias("odo"), *none("int", "battery", "range"))
    ms = _millis("capturedAt")
    rows = rows.unionByName(batch_rows.select(F.lit("batch_rows").alias("record"), F.col("rowId").alias("record_id"), F.col("vehicleId").alias("v"), F.floor(ms / p.slot_ms).alias("slot"),
                                              *none("bigint", "bad_time"), *none("int", "odo"), "battery", "range"))
    track = judge_track(readings, batch_rows, p)
    # rows without a source or a time have nothing to meet, and must not meet each other in one task
    homeless = F.col("v").isNull() | F.col("slot").isNull()
    alone = rows.where(homeless).select("*", *none("double", *BANDS), *none("array<int>", *STUCK))
    rows = rows.where(~homeless).join(track, ["v", "slot"], "left").select(*alone.columns).unionByName(alone)

    def judged(field: str, c: str, top: int, spike: Column, stuck: str) -> Column:
        x = F.col(c)
        reason = F.when(~x.between(0, top), "bounds").when(F.array_contains(stuck, x), "stuck").when(spike, "spike")
        return F.struct(F.lit(field).alias("field"), x.cast("long").alias("value"), reason.alias("reason"))

    beyond = lambda c, lo, hi: (F.col(c) < F.col(lo)) | (F.col(c) > F.col(hi))
    odo = (F.col("odo") < F.col("h_lo")) & (F.col("odo") < F.col("n_lo")) | (F.col("odo") > F.col("h_hi")) & (F.col("odo") > F.col("n_hi"))
    found = F.array(
        F.struct(F.lit("timestamp").alias("field"), F.col("bad_time").alias("value"), F.when(F.col("bad_time").isNotNull(), "bounds").alias("reason")),
        judged("odoKm", "odo", p.odo_max, odo, "stuck_o"), judged("battery", "battery", 100, beyond("battery", "b_lo", "b_hi"), "stuck_b"),
        judged("range", "range", p.range_max, beyond("range", "r_lo", "r_hi"), "stuck_r"))
    return rows.select("record", "record_id", F.col("v").alias("vehicle_id"), F.explode(F.filter(found, lambda x: x["reason"].isNotNull())).alias("f")).select(
        "record", "record_id", "f.field", "vehicle_id", "f.value", "f.reason")
