"""Best-fit decreasing packing of tokenised documents into sequences of a fixed length.

Best-fit decreasing takes pieces from the longest to the shortest and puts each into the open window with the least
room that still holds it. Equal lengths are alike to it, so the whole plan follows from how many pieces there are of
each length: at most `capacity` numbers, whatever the corpus. The plan is made once for the whole corpus, from those
counts, with runs of equal windows; every piece then finds its place by its length and its number among the pieces of
that length. Nothing but the counts reaches the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.llm.common import number_rows, release, ship, slices
from panelloom.llm.tokens import encoder

CAPACITY = 1024
END_ID = 0


class OpenWindows:
    """Runs of equal open windows by remaining capacity, under a segment tree that finds the tightest fit."""

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves <= capacity:
            self.leaves *= 2
        self.any = [False] * (2 * self.leaves)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _mark(self, remaining: int) -> None:
        node = remaining + self.leaves
        self.any[node] = bool(self.runs[remaining])
        while node > 1:
            node //= 2
            self.any[node] = self.any[2 * node] or self.any[2 * node + 1]

    def push(self, remaining: int, first: int, count: int) -> None:
        if remaining and count:
            self.runs[remaining].append((first, count))
            self._mark(remaining)

    def pop(self, remaining: int) -> tuple[int, int]:
        run = self.runs[remaining].pop()
        self._mark(remaining)
        return run

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity >= length that an open window has."""
        node = length + self.leaves
        if self.any[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self.any[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.any[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """The plan, one line per run: length, first number, pieces, first window, pieces per window, offset in the window.

    Piece number `first number + i` of its length goes to window `first window + i // per`, at
    `offset + i % per * length`.
    """
    windows, plan, fresh = OpenWindows(capacity), [], 0
    for length in sorted(counts, reverse=True):
        number, left = 0, counts[length]
        while left:
            room = windows.tightest(length)
            if room is None:
                room = capacity
                per = room // length
                first, have = fresh, -(-left // per)
                fresh += have
            else:
                per = room // length
                first, have = windows.pop(room)
            used = min(left, have * per)
            full, rest = divmod(used, per)
            plan.append((length, number, used, first, per, capacity - room))
            windows.push(room - per * length, first, full)
            if rest:
                windows.push(room - rest * length, first + full, 1)
            windows.push(room, first + full + bool(rest), have - full - bool(rest))
            number, left = number + used, left - used
    return np.array(plan, np.int64).reshape(-1, 6)


def cut_documents(docs: DataFrame, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces of tokenised documents: doc_id, start, length, ids_crc32, doc_tokens, with `keep_ids` also the ids.

    A document is its ids and END_ID after them, cut into windows of `capacity` and what is left at its end.
    """
    ship(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType
    fields = [T.StructField("doc_id", id_type)] + [T.StructField(c, T.LongType())
                                                   for c in ("start", "length", "ids_crc32", "doc_tokens")]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in slices(batch.column(1)):
                yield _pieces(batch.slice(first, last - first), capacity, keep_ids)
        release()

    return docs.select("doc_id", "text").mapInArrow(cut, T.StructType(fields))


def _pieces(batch: pa.RecordBatch, capacity: int, keep_ids: bool) -> pa.RecordBatch:
    ids, at = encoder().encode_column(batch.column(1))
    ids = np.insert(ids, at[1:], END_ID)
    at = at + np.arange(len(at))
    tokens = np.diff(at)
    pieces = -(-tokens // capacity)
    row = np.repeat(np.arange(len(tokens)), pieces)
    start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
    length = np.minimum(capacity, tokens[row] - start)
    begin = at[row] + start
    raw = memoryview(ids.astype("<u4").tobytes())
    crc = [zlib.crc32(raw[4 * a: 4 * (a + n)]) for a, n in zip(begin.tolist(), length.tolist())]
    columns = [batch.column(0).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
               pa.array(tokens[row])]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    if keep_ids:
        offsets = np.append(begin, begin[-1] + length[-1] if len(begin) else 0).astype(np.int32)
        columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32))))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names)


def pack(docs: DataFrame, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Every piece of `docs` (doc_id, text) with its sequence_id and its offset there, packed best fit decreasing.

    Null and empty texts are a document of END_ID alone; repeated rows are packed as often as they occur; a null
    doc_id stays null; other columns are ignored. An empty table gives no rows. Sequence ids are gapless from 0 and
    offsets inside a sequence too; ties go by the order in which tasks wrote the pieces.
    """
    pieces = number_rows(cut_documents(docs, capacity, keep_ids), ["length"], "_number", "pieces")
    counts = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most `capacity` rows
    plan = best_fit_decreasing({r["length"]: r["n"] for r in counts}, capacity)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, number):
        import pandas as pd

        length, number = length.to_numpy(np.int64), number.to_numpy(np.int64)
        line = np.empty(len(length), np.int64)
        for value in np.unique(length):
            own = length == value
            lo, hi = np.searchsorted(plan[:, 0], [value, value + 1])
            line[own] = lo + np.searchsorted(plan[lo:hi, 1], number[own], side="right") - 1
        i = number - plan[line, 1]
        per = plan[line, 4]
        return pd.DataFrame({"sequence_id": plan[line, 3] + i // per, "offset": plan[line, 5] + i % per * length})

    placed = pieces.withColumn("_place", place("length", "_number"))
    return placed.select(*[c for c in pieces.columns if c != "_number"], "_place.sequence_id", "_place.offset")
