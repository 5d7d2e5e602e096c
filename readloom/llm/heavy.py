"""The most frequent values of a column: a hierarchy of count-sketches over hash-bit prefixes.

Pass one hashes each value and adds a signed one to a count-sketch of the hash's prefix on
every level; prefixes of 16 bits are counted exactly. The merged sketches are linear and of
a size that follows from the share asked for. Heavy prefixes are followed from level to
level; the values under the heavy ones are then counted in a second scan.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXACT_BITS = 16


class TooManyPrefixes(ValueError):
    """More prefixes than the limit are heavy: the sketch is too narrow for the threshold."""


def width_bits_for(share: float) -> int:
    """Bits of a width of at least 32 / share.

    At most 1 / share values reach the share. If all do, a row's error is a sixth of the share
    (one deviation), and two of them meet in a row's counter with opposite signs in one case of 64; of
    9 rows five would have to fail at once to lose one, about 1 in 10 million.
    """
    return max(8, math.ceil(math.log2(32 / share)))


class PrefixSketch:
    """Count-sketches of the prefixes of 64-bit hashes, ``step`` bits longer on every level, up to ``bits``."""

    def __init__(self, width_bits: int = 13, depth: int = 9, step: int = 8, bits: int = 40):
        self.width_bits, self.depth = width_bits, depth
        self.levels = [*range(EXACT_BITS + step, bits, step), bits]
        draw = np.random.default_rng(20_231)
        # Odd multipliers for bucket and sign, one pair a level and row.
        shape = (len(self.levels), depth)
        self.bucket_by = draw.integers(0, 2**63, shape, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.sign_by = draw.integers(0, 2**63, shape, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift_by = draw.integers(0, 2**63, shape, dtype=np.uint64)
        self.first = np.zeros(1 << EXACT_BITS, dtype=np.int64)
        self.counts = np.zeros((*shape, 1 << width_bits), dtype=np.int64)

    @property
    def total(self) -> int:
        return int(self.first.sum())

    def flat(self) -> np.ndarray:
        return np.concatenate((self.first, self.counts.ravel()))

    def load(self, flat: np.ndarray) -> None:
        self.first, self.counts = flat[: self.first.size], flat[self.first.size :].reshape(self.counts.shape)

    def _places(self, level: int, row: int, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            mixed = prefix ^ (prefix >> np.uint64(31))
            bucket = (mixed * self.bucket_by[level, row] + self.shift_by[level, row]) >> np.uint64(64 - self.width_bits)
            sign = (mixed * self.sign_by[level, row] + self.shift_by[level, row]) >> np.uint64(63)
        return bucket.astype(np.int64), 1 - 2 * sign.astype(np.int64)

    def add(self, hashes: np.ndarray, n: np.ndarray | None = None) -> None:
        """Add hashes (uint64), each ``n`` times."""
        n = np.ones(len(hashes), dtype=np.int64) if n is None else n
        self.first += np.bincount((hashes >> np.uint64(64 - EXACT_BITS)).astype(np.int64), n, self.first.size).astype(np.int64)
        narrow = 1 << self.width_bits <= 4 * len(hashes)
        for level, bits in enumerate(self.levels):
            prefix = hashes >> np.uint64(64 - bits)
            for row in range(self.depth):
                bucket, sign = self._places(level, row, prefix)
                if narrow:
                    self.counts[level, row] += np.bincount(bucket, sign * n, 1 << self.width_bits).astype(np.int64)
                else:
                    np.add.at(self.counts[level, row], bucket, sign * n)

    def estimate(self, level: int, prefix: np.ndarray) -> np.ndarray:
        """The median of the rows' signed counts."""
        rows = []
        for row in range(self.depth):
            bucket, sign = self._places(level, row, prefix)
            rows.append(sign * self.counts[level, row, bucket])
        return np.median(rows, axis=0)

    def heavy(self, least: float, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Prefixes of the last level of which all shorter ones reach ``least`` too, with their estimates.

        At most ``total / least`` prefixes a level can truly reach it; more than ``most`` by their
        estimates raise ``TooManyPrefixes``.
        """
        prefix, done = np.flatnonzero(self.first >= least).astype(np.uint64), EXACT_BITS
        estimate = self.first[prefix.astype(np.int64)]
        for level, bits in enumerate(self.levels):
            more = bits - done
            kept, told, n = [prefix[:0]], [estimate[:0]], 0
            for at in range(0, len(prefix), 1024):
                part = prefix[at : at + 1024]
                children = ((part[:, None] << np.uint64(more)) | np.arange(1 << more, dtype=np.uint64)[None, :]).ravel()
                guess = self.estimate(level, children)
                kept.append(children[guess >= least])
                told.append(guess[guess >= least])
                n += len(kept[-1])
                if n > most:
                    raise TooManyPrefixes(f"more than {most} prefixes of {bits} bits seem to reach {least:.0f} rows")
            prefix, estimate, done = np.concatenate(kept), np.concatenate(told), bits
        return prefix, estimate


def _sketch(options: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = PrefixSketch(**options)
        for batch in batches:
            hashes = batch.column(0).drop_null().to_numpy(zero_copy_only=False).view(np.uint64)
            hashes, n = np.unique(hashes, return_counts=True)
            sketch.add(hashes, n)
        flat = sketch.flat()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(flat[at])], names=["slot", "n"])

    return run


def exact_frequent(values: DataFrame, share: float) -> tuple[DataFrame, int]:
    """``value, n_estimated, n_rows`` by counting every value, and the number of rows; combined before the shuffle."""
    total = values.count()
    counted = values.groupBy("value").agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > share * total)
    return counted.select("value", F.col("n_rows").alias("n_estimated"), "n_rows"), total


def frequent_values(
    df: DataFrame,
    value: Column,
    share: float,
    slack: float = 0.5,
    width_bits: int | None = None,
    depth: int = 9,
    most_counters: int = 60_000_000,
) -> DataFrame:
    """``value, n_estimated, n_rows``: values that make up more than ``share`` of the rows with a value.

    Memory and what reaches the driver follow from ``share`` alone, whatever the number of rows
    and of different values: about ``27 * 32 / share`` counters and 65 536 (see ``width_bits_for``),
    and at most ``4 / (share * slack)`` candidates. Prefixes are followed while their estimate
    reaches ``share * slack`` of the rows. The second scan counts the candidates exactly, so that no value
    below the share comes out and hash collisions don't matter. Where the sketch is too small for the
    share (more candidates than that, by a ``width_bits`` too narrow) or would need more than
    ``most_counters`` counters, every value is counted instead.

    Null values are no rows. Ties all come out; an empty table or column gives no rows; the
    order of rows and files doesn't matter. A value that holds a third of all rows is counted
    in every task before the shuffle.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be above 0 and at most 1")
    values = df.select(value.alias("value")).where("value is not null")
    options = {"width_bits": width_bits or width_bits_for(share), "depth": depth}
    if depth * 3 << options["width_bits"] > most_counters:
        return exact_frequent(values, share)[0]
    parts = values.select(F.xxhash64("value").alias("h")).mapInArrow(_sketch(options), "slot int, n long")
    merged = parts.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    sketch = PrefixSketch(**options)
    flat = np.zeros(sketch.flat().size, dtype=np.int64)
    flat[merged.column("slot").to_numpy()] = merged.column("n").to_numpy()
    sketch.load(flat)
    total = sketch.total
    try:
        prefixes, estimates = sketch.heavy(max(1.0, total * share * slack), int(4 / (share * slack)) + 16)
    except TooManyPrefixes:
        return exact_frequent(values, share)[0]
    found = df.sparkSession.createDataFrame(
        [(int(h), int(e)) for h, e in zip(prefixes.view(np.int64), estimates)], "p long, n_estimated long"
    )
    # At most 4 / (share * slack) candidates are broadcast.
    exact = (
        values.withColumn("p", F.shiftrightunsigned(F.xxhash64("value"), 64 - sketch.levels[-1]))
        .join(F.broadcast(found.select("p")), "p", "left_semi")
        .groupBy("p", "value")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .where(F.col("n_rows") > share * total)
    )
    return exact.join(F.broadcast(found), "p").select("value", "n_estimated", "n_rows")
