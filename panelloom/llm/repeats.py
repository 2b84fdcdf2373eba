"""Removal of byte strings of LENGTH or more that occur anywhere else, by column-wise construction over text pieces.

Where can equal windows of LENGTH bytes be? Each window names the least hashed gram inside it, its anchor; equal windows
name equal anchors at equal places. Consecutive windows with one anchor form a piece of at most 2 * LENGTH bytes, so
the search falls apart into groups of pieces with equal anchors, and pieces with an anchor of their own are done. Equal
pieces are counted; only different pieces with equal anchors need their bytes.

One anchor may lie in a passage that very many texts share, with other bytes around it. Its pieces are told apart before
they are ordered: windows whose anchor is `lo` to `hi` bytes behind their start have the bytes from `lo` before the anchor
in common, LENGTH - (hi - lo) of them, if they are equal. So a piece falls into parts of at most STEP windows each, and
only parts that agree in these bytes form a group. Equal parts are counted, and parts that no other agrees with are done.

Groups of different parts go through the column-wise construction of a collection's Burrows-Wheeler transform (Bauer, Cox, Rosone 2013; with
common prefixes: Bauer, Cox, Rosone, Sciortino 2012): round by round one symbol of every part is put in front of its
suffix, from the right end of the parts to the left; the suffixes are kept in order by a stable sort on the new symbol
and the last order, and the common prefixes of neighbours follow from the last ones by range minima. Parts are aligned
at their anchors, so that windows that may be equal start in the same round, and only a round's own suffixes are kept:
one a part, bounded memory and no files. A window is repeated if a neighbour shares LENGTH bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.llm.common import join_groups, maybe_in, ship, slices, utf8
from panelloom.sources.storage import materialize

LENGTH = 400
GRAM = 32
#: Windows of a part, by the distance from their start to their anchor.
STEP = 93
#: Different parts of a group that go through the construction together; more are compared by window digests.
GROUP = 1 << 10
#: Parts, of whole groups, that one construction holds at least before it starts: with GROUP more at most.
AT_ONCE = 1 << 12
#: Windows cut into pieces at once; longer texts are cut in several goes.
_CHUNK = 1 << 21
_PLACE = np.uint64(24)
_MIX = [np.uint64(v) for v in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place that has so many."""
    n = len(raw) - GRAM + 1
    lanes = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    h = lanes[:n] * _MIX[0]
    for k in range(1, GRAM // 8):
        h ^= h >> np.uint64(31)
        h += lanes[8 * k: 8 * k + n]
        h *= _MIX[k % 4]
    h ^= h >> np.uint64(29)
    return h


def anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """Place of the first least hash (by its upper 40 bits) in each window of `width` places."""
    n = len(hashes)
    key = (hashes >> _PLACE << _PLACE) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = key
    grid = padded.reshape(blocks, width)
    head = np.minimum.accumulate(grid, axis=1).reshape(-1)
    tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(tail[: n - width + 1], head[width - 1: n])
    return (least & np.uint64((1 << 24) - 1)).astype(np.int64)


def pieces(raw: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Pieces of the texts raw[at[i]:at[i+1]]: text, start, windows, anchor (all from the text's start), its hash and a digest."""
    from xxhash import xxh3_64_intdigest

    empty = np.zeros(0, np.int64)
    if len(raw) < length:
        return empty, empty, empty, empty, empty, empty
    hashes = gram_hashes(raw)
    anchor = anchors(hashes, length - GRAM + 1)
    text = np.repeat(np.arange(len(at) - 1), np.maximum(np.diff(at) - length + 1, 0))
    count = np.maximum(np.diff(at) - length + 1, 0)
    place = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + at[text]
    own = anchor[place]
    new = np.ones(len(text), bool)
    new[1:] = (own[1:] != own[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    windows = np.diff(np.append(first, len(text)))
    begin, text, own = place[first], text[first], own[first]
    view = memoryview(raw)
    digests = np.array([xxh3_64_intdigest(view[a: a + n + length - 1]) for a, n in zip(begin.tolist(), windows.tolist())], np.uint64)
    return text, begin - at[text], windows, own - begin, hashes[own].view(np.int64), digests.view(np.int64)


def piece_table(texts: DataFrame, length: int) -> DataFrame:
    """All pieces of `texts` (digest, copy, text): digest, copy, start, windows, anchor, mark (its hash), piece."""
    ship(texts.sparkSession)
    names = ["start", "windows", "anchor", "mark", "piece"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in slices(batch.column(2), _CHUNK):
                part = batch.slice(first, last - first)
                raw, at = utf8(part.column(2))
                for k in range(0, max(1, len(raw) if len(at) == 2 else 1), _CHUNK):  # a long text alone: in several goes
                    bounds = at if len(at) > 2 else np.array([0, max(0, min(len(raw), k + _CHUNK + length - 1) - k)])
                    text, start, windows, anchor, mark, piece = pieces(np.ascontiguousarray(raw[k: k + bounds[-1]]), bounds, length)
                    rows = pa.array(text)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(rows), part.column(1).take(rows), pa.array(start + k), pa.array(windows, pa.int32()),
                         pa.array(anchor, pa.int32()), pa.array(mark), pa.array(piece)], ["digest", "copy", *names])

    schema = "digest binary, copy string, start long, windows int, anchor int, mark long, piece long"
    return texts.select("digest", "copy", "text").mapInArrow(cut, schema)


def repeated_windows(group: np.ndarray, data: list[bytes], anchor: np.ndarray, length: int, reach: int) -> list[np.ndarray]:
    """For different strings, groups in order: which windows of each also start in another string of its group.

    Rounds run over columns, places relative to `anchor` (0 to `reach`), from right to left; a string without a symbol in a
    column takes part with one that agrees with nothing.
    """
    n = len(data)
    sizes = np.array([len(d) for d in data])
    columns = reach + length
    raw = np.frombuffer(b"".join(data), np.uint8)
    base = np.cumsum(sizes) - sizes
    place = np.arange(columns) - reach + anchor[:, None]
    there = (place >= 0) & (place < sizes[:, None])
    symbols = np.where(there, raw[np.clip(base[:, None] + place, 0, len(raw) - 1)].astype(np.int16), np.int16(256)).T.copy()
    there = there.T
    shared = np.zeros((n, reach + 1), bool)
    order, common = np.arange(n), np.zeros(n + 1, np.int64)
    key = np.unique(group, return_inverse=True)[1] * 257
    for column in range(columns - 1, -1, -1):
        ranked = (key + symbols[column])[order]
        moved = np.argsort(ranked, kind="stable")
        ranked, order = ranked[moved], order[moved]
        same = (ranked[1:] == ranked[:-1]) & there[column][order[1:]]
        a, b = moved[:-1][same] + 1, moved[1:][same] + 1  # least common prefix between old ranks a - 1 and b - 1
        fresh = np.zeros(n + 1, np.int64)
        if len(a):
            fresh[1:n][same] = 1 + np.minimum.reduceat(common, np.stack([a, b], axis=1).ravel())[::2]
        common = fresh
        if column <= reach:
            shared[order, column] = (common[:n] >= length) | (common[1:] >= length)
    out = []
    for i in range(n):
        first = reach - anchor[i]
        out.append(shared[i, first: first + sizes[i] - length + 1])
    return out


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def part_table(data: DataFrame, length: int) -> DataFrame:
    """The parts of pieces (mark, piece, anchor, data): mark, piece, group, part, start (its first window in the piece),
    windows, offset (where the bytes that its group shares begin in it) and its bytes.

    Equal windows are in parts of one group at equal distance from `offset`: both name a group by the bytes from
    `lo` before the anchor that all windows of a part cover.
    """
    reach = length - GRAM
    lo = F.col("_side") * STEP
    hi = F.least(lo + (STEP - 1), F.lit(reach))
    start, last = F.greatest(F.lit(0), F.col("anchor") - hi), F.least(F.octet_length("data") - length, F.col("anchor") - lo)
    sides = (data.withColumn("_side", F.explode(F.sequence(F.lit(0), F.lit(reach // STEP))))
             .select("*", lo.alias("_lo"), hi.alias("_hi"), start.alias("start"), (last - start + 1).alias("windows")).filter("windows > 0"))
    return sides.select(
        "mark", "piece", "start", "windows", (F.col("anchor") - F.col("_lo") - F.col("start")).alias("offset"),
        F.xxhash64("mark", "_side", F.substring("data", F.col("anchor") - F.col("_lo") + 1, length - (F.col("_hi") - F.col("_lo")))).alias("group"),
        F.substring("data", F.col("start") + 1, F.col("windows") + (length - 1)).alias("bytes")).withColumn("part", F.xxhash64("bytes"))


def _constructed(rows: DataFrame, length: int) -> DataFrame:
    """(group, part, first, last) runs of repeated windows of `rows` (group, part, offset, bytes: different parts)."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def solve(some: list[tuple]) -> pa.RecordBatch:
            groups = np.array([r[0] for r in some], np.int64)
            flags = repeated_windows(groups, [r[3] for r in some], np.array([r[2] for r in some], np.int64), length, STEP - 1)
            found = [(r[0], r[1], a, b) for r, f in zip(some, flags) for a, b in runs(f)]
            columns = list(zip(*found)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                                               pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32())],
                                              ["group", "part", "first", "last"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if len(held) >= AT_ONCE and row[0] != held[-1][0]:
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)

    ordered = rows.select("group", "part", "offset", "bytes").repartition("group").sortWithinPartitions("group", "part")
    return ordered.mapInArrow(each, "group long, part long, first int, last int")


def _by_digests(rows: DataFrame, length: int) -> DataFrame:
    """The same for groups too large for one task: a row for each window, counted by a 128-bit digest of its bytes."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            found = []
            for group, part, _, data in zip(*(c.to_pylist() for c in batch.columns)):
                view = memoryview(data)
                found += [(group, part, k, xxh3_128_digest(view[k: k + length])) for k in range(len(data) - length + 1)]
            columns = list(zip(*found)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                                              pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.binary())],
                                             ["group", "part", "first", "window"])

    windows = rows.select("group", "part", "offset", "bytes").mapInArrow(each, "group long, part long, first int, window binary")
    twice = windows.groupBy("window").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("window")
    return windows.join(twice, "window").select("group", "part", "first", (F.col("first") + 1).cast("int").alias("last"))


def _shared(data: DataFrame, length: int) -> DataFrame:
    """(mark, piece, first, last): runs of windows of different pieces (mark, piece, anchor, data) that other pieces hold too."""
    cut = part_table(data, length)
    parts = materialize(cut.drop("bytes"), "parts")
    kinds = parts.groupBy("group", "part").agg(F.count(F.lit(1)).alias("n"), F.max("windows").alias("windows"),
                                               F.min(F.struct("mark", "piece", "start")).alias("one"), F.max("offset").alias("offset"))
    kinds = materialize(kinds, "part-kinds")
    whole = kinds.filter("n > 1").select("group", "part", F.lit(0).alias("first"), F.col("windows").alias("last"))
    groups = kinds.groupBy("group").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").withColumn("many", F.col("_n") > GROUP)
    wanted = join_groups(kinds, materialize(groups, "part-groups"), "group", "_n", kinds.count())
    wanted = wanted.select("group", "part", "many", "offset", "windows", F.col("one.mark").alias("mark"), F.col("one.piece").alias("piece"),
                           F.col("one.start").alias("start"))
    rows = materialize(wanted.join(data.select("mark", "piece", "data"), ["mark", "piece"]).select(
        "group", "part", "many", "offset", F.substring("data", F.col("start") + 1, F.col("windows") + (length - 1)).alias("bytes")), "part-bytes")
    found = whole.unionByName(_constructed(rows.filter("NOT many"), length)).unionByName(_by_digests(rows.filter("many"), length))
    return parts.join(found, ["group", "part"]).select(
        "mark", "piece", (F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last")).alias("last"))


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(digest, spans): for each different text with repeats, the byte ranges (a, b) covered by repeated windows.

    Equal texts share a digest (MD5), and their spans, so copies are worked on once however many there are.
    """
    texts = keyed(docs)
    cut = materialize(piece_table(texts.filter(F.octet_length("text") >= length), length), "pieces")
    marks = (cut.groupBy("mark").agg(F.count(F.lit(1)).alias("_n"), F.min("piece").alias("_least"), F.max("piece").alias("_most"))
             .filter("_n > 1").select("mark", "_n", (F.col("_least") != F.col("_most")).alias("differ")))
    marks = materialize(marks, "shared-marks")
    # copies of a text have the same pieces: they count, but one of them stands for all
    known = materialize(join_groups(cut, marks, "mark", "_n", cut.count()).groupBy("digest", "start", "windows", "anchor", "mark", "piece", "differ")
                        .agg(F.count(F.lit(1)).alias("n"), F.min("copy").alias("copy")), "known-pieces")
    kinds = materialize(known.groupBy("mark", "piece", "differ").agg(
        F.sum("n").alias("n"), F.min(F.struct("digest", "copy", "start", "windows", "anchor")).alias("one")), "piece-kinds")
    each = kinds.filter("n > 1").select("mark", "piece", F.lit(0).alias("first"), F.col("one.windows").alias("last"))
    data = materialize(_fetch(kinds.filter("differ").select("mark", "piece", "one.*"), texts, length), "piece-data")
    found = _shared(data, length)
    spans = known.join(each.unionByName(found), ["mark", "piece"]).select(
        "digest", (F.col("start") + F.col("first")).alias("a"), (F.col("start") + F.col("last") - 1 + length).alias("b"))
    return spans.groupBy("digest").agg(F.collect_set(F.struct("a", "b")).alias("spans"))  # bounded by the text's length


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), its digest, and the doc_id as text, by which one of several copies is chosen."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("digest"),
                       F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("copy"))


def _fetch(wanted: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """The bytes of each wanted piece: mark, piece, anchor, data. The texts that hold them are met once each."""
    lists = wanted.groupBy("digest", "copy").agg(F.collect_list(F.struct("mark", "piece", "anchor", "start", "windows")).alias("parts"))
    lists = materialize(lists, "wanted-pieces")
    may = maybe_in(texts.select("digest", "copy", "text"), lists, "digest", "_may").filter("_may").drop("_may")
    met = may.join(lists, ["digest", "copy"])
    rows = met.select(F.col("text").cast("binary").alias("raw"), F.explode("parts").alias("p"))
    data = F.substring(F.col("raw"), (F.col("p.start") + 1).cast("int"), (F.col("p.windows") + (length - 1)).cast("int"))
    return rows.select("p.mark", "p.piece", "p.anchor", data.alias("data")).dropDuplicates(["mark", "piece"])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with `keep_text` the bytes.

    Every byte goes that lies in a string of `length` bytes which also starts anywhere else, in this text or another, as
    the texts are given; matches end at a text's ends. Null counts as empty; repeated rows are each other's repeats; a
    null doc_id stays null; other columns are ignored; an empty table gives no rows.
    """
    spans = materialize(repeated_spans(docs, length), "repeats")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in slices(batch.column(1)):
                part = batch.slice(first, last - first)
                raw, at = utf8(part.column(1))
                view, rows = memoryview(raw), []
                for own, a, b in zip(part.column(2).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                    cuts = merged([(s["a"], s["b"]) for s in own or ()])
                    ends = [0, *(x for c in cuts for x in c), b - a]
                    kept = b"".join(view[a + x: a + y] for x, y in zip(ends[::2], ends[1::2]))
                    rows.append((b - a, b - a - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), kept))
                columns = list(zip(*rows))
                arrays = [part.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3])]
                yield pa.RecordBatch.from_arrays(arrays + ([pa.array(columns[4], pa.binary())] if keep_text else []), schema.names)

    fields = [docs.schema["doc_id"]] + [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
    fields.append(T.StructField("kept_sha256", T.StringType()))
    schema = T.StructType(fields + ([T.StructField("kept", T.BinaryType())] if keep_text else []))
    texts = maybe_in(keyed(docs), spans, "digest", "_may")
    whole = texts.filter("NOT _may").withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    rows = texts.filter("_may").join(spans, "digest", "left").select(*whole.columns).unionByName(whole)
    return rows.select("doc_id", "text", "spans").mapInArrow(take, schema)
