"""Binned features, and the sums that the splits of a level of trees follow from.

Every feature becomes a byte, its bin; a row's bytes are one binary value, written once. A level of trees needs, for each open node,
feature and bin, two sums over the node's rows. Tasks add them up in numpy, Spark adds up the tasks' lines, and only those sums
reach the driver: windows x nodes x features x bins, `CELLS` at a time at most, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.functions.cleaning import is_finite
from panelloom.sources.shipping import ship

#: Sums that a pass gathers at most.
CELLS = 1 << 21
#: Pairs of bins that two features may have to be counted together.
_PAIRS = 1 << 12
#: Rows that a task adds up at a time.
ROWS = 1 << 15
#: Lines of sums in one batch.
_LINES = 1 << 16
#: Features sketched in one aggregation.
_SKETCHED = 200
#: Row draws are whole numbers below this prime.
PRIME = (1 << 31) - 1


def even_cuts(low: float, high: float, bins: int) -> np.ndarray:
    """Ends of bins of one width: the quantiles of ranks, which lie evenly between `low` and `high`."""
    return low + (high - low) * np.arange(1, bins) / bins


def sketched_cuts(rows: DataFrame, features: list[str], bins: int, accuracy: int = 10_000) -> dict[str, np.ndarray]:
    """Ends of bins that hold about equally many rows, from quantile sketches; equal ends are one."""
    shares, found = [k / bins for k in range(1, bins)], {}
    for k in range(0, len(features), _SKETCHED):
        block = features[k: k + _SKETCHED]
        line = rows.agg(*[F.percentile_approx(F.col(f"`{c}`").cast("double"), shares, accuracy).alias(f"q{i}") for i, c in enumerate(block)]).first()
        for i, c in enumerate(block):
            found[c] = np.unique([v for v in line[i] or [] if v is not None and np.isfinite(v)])
    return found


def row_draw(key: list[str]) -> Column:
    """A number below PRIME for the row's key of whole numbers; nulls count as -1."""
    draw = F.lit(0).cast("bigint")
    for k in key:
        draw = F.pmod(draw * 1_000_003 + F.coalesce(F.col(k).cast("bigint"), F.lit(-1)), F.lit(PRIME))
    return draw


def drawn(draw: np.ndarray, seed: int, share: float) -> np.ndarray:
    """A repeatable sample of rows: the same whatever the engine and however the rows are partitioned."""
    if share >= 1:
        return np.ones(len(draw), bool)
    mixed = _below_prime(draw + seed * 7_919_773 % PRIME)
    mixed = _below_prime(mixed * mixed)
    return _below_prime(mixed * 48_271 + 12_345) < int(share * PRIME)


def _below_prime(value: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 to 2^62 modulo PRIME, without a division: 2^31 is 1 there."""
    folded = (value & PRIME) + (value >> 31)
    return folded - (folded >= PRIME) * PRIME


def binned(table: DataFrame, features: list[str], cuts: list[np.ndarray], y: str, key: list[str], year: Column) -> DataFrame:
    """(year, draw, y, x) of the rows with a finite target: x holds a byte for each feature, the number of its cuts below the value.

    A missing value is above all cuts.
    """
    ship(table.sparkSession)
    if any(len(c) > 255 for c in cuts):
        raise ValueError("at most 256 bins")
    rows = table.filter(is_finite(F.col(y))).select(
        year.cast("int").alias("year"), row_draw(key).alias("draw"), F.col(y).cast("double").alias("y"),
        *[F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(features)])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.empty((batch.num_rows, len(cuts)), np.uint8)
            for i, ends in enumerate(cuts):
                x[:, i] = np.searchsorted(ends, batch.column(3 + i).to_numpy(zero_copy_only=False), side="left")
            starts = np.arange(batch.num_rows + 1, dtype=np.int32) * len(cuts)
            packed = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(starts), pa.py_buffer(x)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], packed], ["year", "draw", "y", "x"])

    return rows.mapInArrow(each, "year int, draw long, y double, x binary")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The bytes of a binary column of values of one length: a line for each feature, so that a feature's bins lie together."""
    _, offsets, data = column.buffers()
    first = np.frombuffer(offsets, np.int32)[column.offset] if len(column) else 0
    raw = np.frombuffer(data, np.uint8)[first: first + len(column) * width] if data is not None else np.zeros(0, np.uint8)
    return np.ascontiguousarray(raw.reshape(len(column), width).T)


class Sums:
    """Two sums for each cell of a task; a block of cells belongs to a node and holds `bins` for each of its features."""

    def __init__(self, cells: int, bins: int):
        self.bins = bins
        self.one, self.two = np.zeros(cells), np.zeros(cells)

    def add(self, block: int, x: np.ndarray, one: np.ndarray, two: np.ndarray | None) -> None:
        """Bins `x` (feature, row) of rows with their numbers; `two` None counts rows. Two features share a pass where their pairs of bins are few."""
        bins, rows = self.bins, len(one)
        step = 2 if bins * bins <= min(rows, _PAIRS) else 1
        for j in range(0, len(x), step):
            at = block + j * bins
            if j + step > len(x) or step == 1:
                cell = x[j].astype(np.intp)
                self.one[at: at + bins] += np.bincount(cell, one, bins)
                self.two[at: at + bins] += np.bincount(cell, two, bins)
                continue
            cell = (x[j].astype(np.uint16) * np.uint16(bins) + x[j + 1]).astype(np.intp)
            for sums, weights in ((self.one, one), (self.two, two)):
                both = np.bincount(cell, weights, bins * bins).reshape(bins, bins)
                sums[at: at + bins] += both.sum(axis=1)
                sums[at + bins: at + 2 * bins] += both.sum(axis=0)

    def lines(self) -> Iterator[pa.RecordBatch]:
        used = np.flatnonzero((self.one != 0) | (self.two != 0))
        for k in range(0, len(used), _LINES):
            cell = used[k: k + _LINES]
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(self.one[cell]), pa.array(self.two[cell])], ["cell", "one", "two"])


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ROWS or more, so that the cost of a numpy call is shared by many."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= ROWS:
            yield pa.concat_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.concat_batches(held)


def gather(rows: DataFrame, cells: int, bins: int, add: Callable[[pa.RecordBatch, Sums], None], tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """The sums of all rows, which `add` puts into a task's `Sums` batch by batch.

    The lines of `tasks` tasks are added up by the driver where they are no more than CELLS together, which saves a shuffle for
    each level of each tree; beyond that by the executors, so that only `cells` lines come.
    """
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(cells, bins)
        for batch in joined(batches):
            add(batch, sums)
        yield from sums.lines()

    lines = rows.mapInArrow(each, "cell long, one double, two double")
    if tasks * cells > CELLS:
        lines = lines.groupBy("cell").agg(F.sum("one").alias("one"), F.sum("two").alias("two"))
    found = lines.toArrow()
    at = found.column("cell").to_numpy()
    return tuple(np.bincount(at, found.column(c).to_numpy(), cells) for c in ("one", "two"))
