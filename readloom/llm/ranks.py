"""Percentiles with bounded error: deterministic rank-interval summaries that merge.

A summary is a sorted list of values; each has its weight ``w`` (how often it occurs at
least), and bounds of how many values lie below (``low``) and up to it (``high``). Merging
adds bounds, compressing drops values as long as the permitted uncertainty holds, and the
error that has come together can be read off the bounds at any time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Summary(NamedTuple):
    value: np.ndarray
    w: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @property
    def n(self) -> int:
        return int(self.high[-1]) if len(self.high) else 0


def exact_summary(values: np.ndarray, counts: np.ndarray) -> Summary:
    """Of sorted different values with their counts."""
    counts = counts.astype(np.int64)
    high = np.cumsum(counts)
    return Summary(values.astype(np.float64), counts, high - counts, high)


def merge(a: Summary, b: Summary) -> Summary:
    """The summary of both inputs; rank uncertainties add, so relative ones don't grow."""
    if not len(a.value) or not len(b.value):
        return b if not len(a.value) else a
    value = np.union1d(a.value, b.value)

    def at(s: Summary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        after = np.searchsorted(s.value, value, "left")
        there = (after < len(s.value)) & (s.value[np.minimum(after, len(s.value) - 1)] == value)
        here = np.minimum(after, len(s.value) - 1)
        before = after - 1
        low = np.where(before >= 0, (s.low + s.w)[np.maximum(before, 0)], 0)
        high = np.where(after < len(s.value), (s.high - s.w)[here], s.n)
        return np.where(there, s.w[here], 0), np.where(there, s.low[here], low), np.where(there, s.high[here], high)

    (wa, la, ha), (wb, lb, hb) = at(a), at(b)
    return Summary(value, wa + wb, la + lb, ha + hb)


def uncertainty(s: Summary) -> int:
    """The largest number of ranks between which the summary can't tell."""
    if not len(s.value):
        return 0
    inside = s.high - s.low - s.w
    between = (s.high - s.w)[1:] - (s.low + s.w)[:-1]
    return int(max(inside.max(), between.max(initial=0)))


def compress(s: Summary, permitted: float) -> Summary:
    """Drop values while neighbours stay within ``permitted`` ranks of each other; ends stay."""
    if len(s.value) <= 2:
        return s
    below, upto = (s.high - s.w).tolist(), (s.low + s.w).tolist()
    kept, last = [0], upto[0]
    for i in range(1, len(below) - 1):
        if below[i + 1] - last > permitted:
            kept.append(i)
            last = upto[i]
    kept.append(len(below) - 1)
    return Summary(*(part[kept] for part in s))


def percentile(s: Summary, pct: float) -> float | None:
    """The smallest value for which at least ``pct`` % of the values are not larger, within the error."""
    if not len(s.value):
        return None
    rank = max(1, -(-int(round(pct * 1_000_000)) * s.n // 100_000_000))
    middle = (s.low + s.w + s.high) / 2
    return float(s.value[min(np.searchsorted(middle, rank, "left"), len(s.value) - 1)])


_PARTS = "grp string, measure string, part long, n long, error long, value array<double>, w array<long>, low array<long>, high array<long>"
_NAMES = ["grp", "measure", "part", "n", "error", "value", "w", "low", "high"]


def _batch(rows: list[tuple], part: int) -> pa.RecordBatch:
    columns = [
        pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
        pa.array([part] * len(rows), pa.int64()), pa.array([r[2].n for r in rows], pa.int64()),
        pa.array([uncertainty(r[2]) for r in rows], pa.int64()), pa.array([r[2].value for r in rows], pa.list_(pa.float64())),
        *[pa.array([r[2][k] for r in rows], pa.list_(pa.int64())) for k in (1, 2, 3)],
    ]
    return pa.RecordBatch.from_arrays(columns, names=_NAMES)


class _Pool:
    """Summaries by group, of bounded number: the pool is emptied when it holds too many."""

    def __init__(self, epsilon: float, most: int):
        self.epsilon, self.most, self.held = epsilon, most, {}

    def add(self, key: tuple, summary: Summary) -> None:
        old = self.held.get(key)
        new = merge(old, summary) if old else summary
        if len(new.value) > 4 / self.epsilon:
            new = compress(new, self.epsilon * new.n)
        self.held[key] = new

    def take(self, part: int) -> Iterator[pa.RecordBatch]:
        rows = [(*key, compress(s, self.epsilon * s.n)) for key, s in self.held.items()]
        self.held = {}
        for at in range(0, len(rows), 1000):
            yield _batch(rows[at : at + 1000], part)


def _runs(codes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted different (code, value) pairs and their counts."""
    if not len(codes):
        return codes, values, codes
    if np.issubdtype(values.dtype, np.integer):
        least, span = int(values.min()), int(values.max()) - int(values.min()) + 1
        cells = (int(codes.max()) + 1) * span
        if cells <= max(4 * len(codes), 1 << 16):
            counted = np.bincount(codes * span + (values - least), minlength=cells)
            at = np.flatnonzero(counted)
            return at // span, at % span + least, counted[at]
    order = np.lexsort((values, codes))
    codes, values = codes[order], values[order]
    first = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]) | (values[1:] != values[:-1])))
    return codes[first], values[first], np.diff(np.append(first, len(codes)))


def _summarise(bounds: dict[str, tuple], epsilon: float, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        pool = _Pool(epsilon, most)
        for batch in batches:
            group = batch.column(0).dictionary_encode()
            names = group.dictionary.to_pylist()
            code = pc.fill_null(group.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            for k, (measure, (least, greatest)) in enumerate(bounds.items()):
                column = batch.column(k + 1)
                if pa.types.is_list(column.type):
                    # Null lists hold nothing; offsets give each value its row.
                    rows = pc.list_parent_indices(column).to_numpy(zero_copy_only=False)
                    flat = column.flatten()
                else:
                    rows, flat = np.arange(len(column)), column
                if flat.null_count:
                    good = pc.is_valid(flat).to_numpy(zero_copy_only=False)
                    rows, flat = rows[good], flat.drop_null()
                values = flat.to_numpy(zero_copy_only=False)
                if np.issubdtype(values.dtype, np.integer):
                    values = values.astype(np.int64)
                else:
                    told = ~np.isnan(values)
                    rows, values = rows[told], values[told]
                if least is not None or greatest is not None:
                    inside = np.ones(len(values), dtype=bool)
                    if least is not None:
                        inside &= values >= least
                    if greatest is not None:
                        inside &= values <= greatest
                    rows, values = rows[inside], values[inside]
                codes = code[rows]
                if (codes < 0).any():
                    values, codes = values[codes >= 0], codes[codes >= 0]
                codes, values, counts = _runs(codes, values)
                cuts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else []
                for a, b in zip(cuts, [*cuts[1:], len(codes)]):
                    pool.add((names[codes[a]], measure), exact_summary(values[a:b], counts[a:b]))
            if len(pool.held) > most:
                yield from pool.take(part)
        yield from pool.take(part)

    return run


def _merge_parts(epsilon: float, fan: int):
    def run(found: pa.Table) -> pa.Table:
        pool, part, rows = _Pool(epsilon, 1 << 30), 0, 0
        for batch in found.to_batches():
            for row in batch.to_pylist():
                part, rows = row["part"] // fan, rows + 1
                pool.add((row["grp"], row["measure"]), _summary(row))
        return pa.Table.from_batches(pool.take(part))

    return run


def _summary(row: dict) -> Summary:
    return Summary(np.array(row["value"], dtype=float), *(np.array(row[c], dtype=np.int64) for c in ("w", "low", "high")))


class Measure(NamedTuple):
    """A number or an array of numbers; values outside ``least`` to ``most`` count nowhere."""

    column: Column
    least: float | None = None
    most: float | None = None


def summaries(
    df: DataFrame, group: Column, measures: dict[str, Measure], epsilon: float = 0.001, fan: int = 256, most: int = 20_000
) -> DataFrame:
    """One summary per group and measure, to keep, to merge with others and to ask.

    Columns ``grp, measure, part, n, error`` and the arrays of the summary; ``error`` is the
    uncertainty in ranks that has come together. Null and NaN values and rows without group
    count nowhere; repeated rows count each; an empty table has no summaries. Every task
    compresses to ``epsilon`` of its ranks and holds at most ``most`` summaries at a time;
    summaries then merge ``fan`` at a time, level by level, so that no task ever takes more
    than ``fan`` of one group, and a group with most of the rows costs one small summary a
    task. With few different values nothing is dropped and ranks are exact.
    """
    if not 0 < epsilon < 1:
        raise ValueError("epsilon must be between 0 and 1")
    named = df.select(group.cast("string").alias("grp"), *[m.column.alias(f"m{k}") for k, m in enumerate(measures.values())])
    bounds = {name: (m.least, m.most) for name, m in measures.items()}
    return merge_summaries(named.mapInArrow(_summarise(bounds, epsilon, most), _PARTS), epsilon, fan)


def merge_summaries(parts: DataFrame, epsilon: float = 0.001, fan: int = 256, levels: int = 2) -> DataFrame:
    """One summary per group and measure of any summaries: of partitions, days or files.

    ``levels`` times the summaries whose ``part`` falls into the same of ``fan`` times fewer
    numbers merge. Merging adds uncertainties; each level may then compress to one more
    ``epsilon`` of the ranks. ``error`` tells what it has come to.
    """
    parts = parts.withColumn("part", F.pmod("part", F.lit(fan**levels)))
    for level in range(levels):
        slot = F.floor(F.col("part") / fan)
        parts = parts.groupBy("grp", "measure", slot).applyInArrow(_merge_parts(epsilon * (level + 2), fan), _PARTS)
    return parts


def _ask(pcts: Sequence[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                s = _summary(row)
                rows += [(row["grp"], row["measure"], p, percentile(s, p), row["n"], row["error"]) for p in pcts]
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = (pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["grp", "measure", "pct", "pct_value", "n", "error"]
            )

    return run


def percentiles(found: DataFrame, pcts: Sequence[float]) -> DataFrame:
    """``grp, measure, pct, pct_value, n, error`` of summaries.

    ``pct_value`` is the smallest value for which at least ``pct`` % of the values are not larger,
    up to ``error`` ranks. Groups without values have no rows.
    """
    return found.mapInArrow(_ask(pcts), "grp string, measure string, pct double, pct_value double, n long, error long")
