"""Mergeable percentiles with bounded error: relative-rank compactors that protect the high tail.

A sketch is a stack of levels; an item of level h stands for 2**h values. A full level is sorted, its
highest items stay, and of a growing part of the lower ones every second moves up a level, as relative
compactors do. The error of a rank is thus proportional to the number of values above it: p99.9 is as
good, relatively, as the median. Up to ``exact_up_to(k)`` values nothing is compacted and all
percentiles are exact. Sketches of partitions, days or separate sets of rows merge into those of the whole.

Scale: every task folds its rows into one small sketch per group before the shuffle, so a group with a
third of all rows costs each task one sketch; a task that meets very many groups hands on early what it has.
Behind the shuffle they are merged in two levels, branches and groups; at last the sketches are sorted by group, so each
group gives one row however many there are.

Defined results: null values are left out, and so is NaN; negative and zero values count; a null group
column is a group of its own; repeated rows count each; an empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECTIONS = 3
DEFAULT_K = 32
#: Branches of the tree in which a group's sketches are merged.
BRANCHES = 32
#: A task hands on its sketches when they hold this many items.
FLUSH_ITEMS = 2_000_000


def exact_up_to(k: int = DEFAULT_K) -> int:
    return 2 * k * SECTIONS


def rank_error(k: int = DEFAULT_K, sigmas: float = 3.0) -> float:
    """Bound of |estimated - true rank| / (number of values at or above it), at so many standard deviations.

    The constant is empirical for this schedule of sections: merges of thousands of equal, identical, sorted and
    reversed parts stay under half of the bound at three deviations (tests hold single and merged sketches to it).
    """
    return sigmas * (0.0512 / SECTIONS) ** 0.5 / k


class Sketch:
    """Relative-rank compactors, high ranks protected."""

    __slots__ = ("k", "levels", "states", "n")

    def __init__(self, k: int = DEFAULT_K):
        self.k, self.levels, self.states, self.n = k, [np.empty(0)], [0], 0

    def add(self, values: np.ndarray) -> None:
        self.levels[0] = np.concatenate([self.levels[0], values])
        self.n += len(values)
        self._compress()

    def merge(self, other: Sketch) -> None:
        for h, items in enumerate(other.levels):
            if h == len(self.levels):
                self.levels.append(np.empty(0))
                self.states.append(0)
            self.levels[h] = np.concatenate([self.levels[h], items])
            self.states[h] |= other.states[h]
        self.n += other.n
        self._compress()

    def _compress(self) -> None:
        h = 0
        while h < len(self.levels):
            # the deeper the history of a level, the more sections protect its tail
            sections = SECTIONS + max(0, int(self.n >> h).bit_length() - (2 * self.k * SECTIONS).bit_length())
            room = 2 * self.k * sections
            if len(self.levels[h]) > room:
                items, state = np.sort(self.levels[h]), self.states[h]
                trailing = (~state & (state + 1)).bit_length() - 1
                spared = room // 2 + (sections - min(trailing + 1, sections)) * self.k
                cut = (len(items) - spared) & ~1
                coin = (state * 0x9E3779B1 + h * 0x85EBCA77 + self.n * 0xC2B2AE3D) >> 7 & 1
                if h + 1 == len(self.levels):
                    self.levels.append(np.empty(0))
                    self.states.append(0)
                self.levels[h + 1] = np.concatenate([self.levels[h + 1], items[coin:cut:2]])
                self.levels[h], self.states[h] = items[cut:], state + 1
            h += 1

    def size(self) -> int:
        return sum(map(len, self.levels))

    def quantiles(self, qs: Sequence[float]) -> list[float]:
        """For each q the least value whose cumulative weight reaches q * n."""
        items = np.concatenate(self.levels)
        weights = np.concatenate([np.full(len(x), 1 << h, dtype=np.int64) for h, x in enumerate(self.levels)])
        order = np.argsort(items, kind="stable")
        ends = np.cumsum(weights[order])
        at = np.searchsorted(ends, np.maximum(1, np.ceil(np.asarray(qs) * self.n - 1e-9)), side="left")
        return items[order][np.minimum(at, len(items) - 1)].tolist()

    def to_bytes(self) -> bytes:
        head = struct.pack("<IQI", self.k, self.n, len(self.levels)) + struct.pack(f"<{len(self.levels)}Q", *self.states)
        return head + struct.pack(f"<{len(self.levels)}I", *map(len, self.levels)) + np.concatenate(self.levels).astype("<f8").tobytes()

    @staticmethod
    def from_bytes(b: bytes) -> Sketch:
        k, n, m = struct.unpack_from("<IQI", b)
        s = Sketch(k)
        s.n, s.states = n, [*struct.unpack_from(f"<{m}Q", b, 16)]
        sizes = struct.unpack_from(f"<{m}I", b, 16 + 8 * m)
        s.levels = [x.copy() for x in np.split(np.frombuffer(b, "<f8", offset=16 + 12 * m), np.cumsum(sizes)[:-1])]
        return s


def _fold(groups: list[str], metrics: list[str], k: int, ready: bool, last: bool = False):
    """Rows (or, ready, sketches) into one sketch per group and metric of the task.

    A task may hand on a group's sketch early and begin it anew, but not in the last fold: that one gets
    its sketches sorted by group and metric, and hands on only those of groups that are over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Sketch] = {}
        over: dict[tuple, Sketch] = {} if last else held

        def flush() -> pa.RecordBatch:
            keys = [*over]
            cols = [pa.array([x[i] for x in keys], type=types[i]) for i in range(len(groups))]
            out = pa.RecordBatch.from_arrays([*cols, pa.array([x[-1] for x in keys], pa.string()), pa.array([s.to_bytes() for s in over.values()], pa.binary())],
                                             names=[*groups, "metric", "sketch"])
            over.clear()
            return out

        types: list[pa.DataType] = []
        for b in batches:
            t = pa.Table.from_batches([b])
            types = [t.schema.field(g).type for g in groups]
            if ready:
                for *key, metric, raw in zip(*(t[c].to_pylist() for c in [*groups, "metric", "sketch"])):
                    new = Sketch.from_bytes(raw)
                    if (old := held.get(x := (*key, metric))) is None:
                        if last:
                            over.update(held)
                            held.clear()
                        held[x] = new
                    else:
                        old.merge(new)
            else:
                code = np.zeros(b.num_rows, dtype=np.int64)
                for g in groups:
                    d = t[g].combine_chunks().dictionary_encode(null_encoding="encode")
                    code = code * (len(d.dictionary) + 1) + d.indices.to_numpy()
                named, first, code = np.unique(code, return_index=True, return_inverse=True)
                names = [*zip(*(t[g].take(pa.array(first)).to_pylist() for g in groups))] if groups else [()] * len(named)
                for m in metrics:
                    v = t[m].combine_chunks().cast(pa.float64()).to_numpy(zero_copy_only=False)
                    good = ~np.isnan(v)
                    c, v = code[good], v[good]
                    order = np.argsort(c, kind="stable")
                    c, v = c[order], v[order]
                    starts = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else []
                    for a, z in zip(starts, [*starts[1:], len(c)]):
                        held.setdefault((*names[c[a]], m), Sketch(k)).add(v[a:z])
            if sum(s.size() for s in over.values()) > FLUSH_ITEMS:
                yield flush()
        if last:
            over.update(held)
        if over:
            yield flush()

    return run


def sketch_groups(df: DataFrame, groups: Sequence[str], metrics: Sequence[str], k: int = DEFAULT_K) -> DataFrame:
    """One mergeable sketch per group and metric: (groups..., metric, sketch)."""
    keep = df.select(*groups, *metrics)
    schema = T.StructType([*(keep.schema[g] for g in groups), T.StructField("metric", T.StringType()), T.StructField("sketch", T.BinaryType())])
    return merge_sketches(keep.mapInArrow(_fold([*groups], [*metrics], k, False), schema), groups, folded=True)


def merge_sketches(sketches: DataFrame, groups: Sequence[str], folded: bool = False) -> DataFrame:
    """Sketches of any sets of rows into those of the whole, per ``groups`` and metric."""
    s = sketches.select(*groups, "metric", "sketch")
    if not folded:  # fold within each task before anything is shuffled
        s = s.mapInArrow(_fold([*groups], [], 0, True), s.schema)
    # a level of the tree in between, so that the last task of a group reads a bounded number of sketches, not one per task
    spread = s.withColumn("_branch", F.pmod(F.spark_partition_id(), F.lit(BRANCHES)))
    s = spread.repartition(*groups, "metric", "_branch").drop("_branch").mapInArrow(_fold([*groups], [], 0, True), s.schema)
    return s.repartition(*groups, "metric").sortWithinPartitions(*groups, "metric").mapInArrow(_fold([*groups], [], 0, True, last=True), s.schema)


def read_sketches(sketches: DataFrame, qs: dict[str, float]) -> DataFrame:
    """Adds n and one column per quantile, and drops the sketch."""
    keep = [f for f in sketches.schema.fields if f.name != "sketch"]
    schema = T.StructType([*keep, T.StructField("n", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in qs)])
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [Sketch.from_bytes(x) for x in b.column("sketch").to_pylist()]
            values = np.array([s.quantiles([*qs.values()]) for s in got]).reshape(len(got), len(qs))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array([s.n for s in got], pa.int64()), *(pa.array(values[:, i]) for i in range(len(qs)))],
                                             names=[*names, "n", *qs])

    return sketches.mapInArrow(run, schema)
