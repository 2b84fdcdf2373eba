"""Benchmark passages in documents within an edit distance: CGK embedding, bit-sampling LSH, exact verification.

The CGK embedding (Chakraborty, Goldenberg, Koucky 2016) walks over a string: at each step it emits the symbol under the
pointer and moves on if a random bit of (step, symbol) says so. Two strings few edits apart fall into step again and again,
so their emitted strings differ in few places: edit distance has become Hamming distance, and sampling a few places of
the emitted string is a locality-sensitive hash. An item-sized window is embedded in stretches that begin at each of its bytes;
a window is a candidate if one stretch agrees with the item's in all sampled places of one repetition. How many repetitions a
length class takes is found on its items with all the edits that are allowed, so that the target recall is reached. Candidates are
verified exactly: the best alignment of the item inside the window, grown by the allowed distance, by bit-parallel dynamic programming.

A walk is taken from every byte of a text whose next few bytes are those of a stretch: text without spaces and passages behind
punctuation are searched like any other. Items under LONG bytes are too short for walks; they are found by counts of shared grams that no
copy within the allowed edits falls below. Benchmark items are a stated query set: blocks of BLOCK items go to the tasks, which read
every document whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.llm.common import release, ship, slices, utf8

#: Edits allowed, as a share of the item's bytes; and the recall sought among items with so many random edits.
RATE = 0.15
RECALL = 0.95
#: Calibration raises an error where more repetitions would be needed.
MOST_REPETITIONS = 64
#: Items sent to the tasks at once.
BLOCK = 4096
#: Length classes, calibrated each for itself: the bytes a stretch begins with, its steps, and how many of them are sampled.
STRETCHES = {256: (8, 72, 11), 160: (8, 64, 11), 112: (8, 56, 10), 88: (8, 48, 9), 64: (7, 44, 9), 24: (5, 24, 5)}
SPANS = tuple(STRETCHES)
#: Items of so many bytes are searched by walks; shorter ones are a class for each length.
LONG = 24
#: Hash tables of first bytes.
_TABLE = 20
#: Places looked up together, and diagonals by items counted together, at most.
_CHUNK = 1 << 18
_CELLS = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LANE = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def normalise(raw: np.ndarray, at: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case bytes with single spaces, `gap` zero bytes after each text; its bounds, each byte's place in raw."""
    space = _SPACE[raw]
    first = np.zeros(len(raw), bool)
    first[at[:-1][at[:-1] < len(raw)]] = True
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1] & ~first[1:]
    place = np.flatnonzero(keep)
    count = np.searchsorted(place, at)
    begin = count[:-1] + gap * np.arange(len(at) - 1)
    out = np.zeros(len(place) + gap * (len(at) - 1) + 8, np.uint8)
    to = np.arange(len(place)) + gap * np.repeat(np.arange(len(at) - 1), np.diff(count))
    symbols = _LOWER[raw[place]]
    symbols[space[place]] = 32
    out[to] = symbols
    origin = np.zeros(len(out), np.int64)
    origin[to] = place
    return out, begin, begin + np.diff(count), origin


def grams(text: np.ndarray, size: int) -> np.ndarray:
    """The bytes from each place on as a number, `size` (at most 8) of them; the end of text is padded by 8 zero bytes."""
    return np.ndarray(max(0, len(text) - 7), "<u8", text, strides=(1,)) & _LANE[size]


def plain(text: str | None) -> bytes:
    return b" ".join((text or "").encode().lower().split())


# -- long items: walks ---------------------------------------------------------------------

@dataclass
class Walk:
    """One repetition: a random bit for each step and symbol, and the sampled steps, all beyond the first bytes."""

    bits: np.ndarray
    steps: list[int]


def walks(span: int, repetitions: int, seed: int = 42) -> list[Walk]:
    first, steps, samples = STRETCHES[span]
    rng, cuts = np.random.default_rng(seed), np.linspace(2 * first, steps, samples + 1).astype(int)
    return [Walk(rng.integers(0, 2, (steps, 256)).astype(np.int32), [int(rng.integers(a, b)) for a, b in zip(cuts, cuts[1:])])
            for _ in range(repetitions)]


@dataclass
class Stretches:
    """Items of one block and one length class: stretches (item, offset), each repetition's sorted keys of them, and filters."""

    span: int
    ids: list
    texts: list[bytes]
    item: np.ndarray
    offset: np.ndarray
    walks: list[Walk]
    keys: list[tuple[np.ndarray, np.ndarray]]
    filters: list[list[np.ndarray]]
    bits: int
    first: np.ndarray


def _slot(key: np.ndarray, bits: int) -> np.ndarray:
    return (key * _MIX) >> np.uint64(64 - bits)


def embed(text: np.ndarray, starts: np.ndarray, walk: Walk, filters: list[np.ndarray] | None, bits: int) -> tuple[np.ndarray, np.ndarray] | list[np.ndarray]:
    """Keys of the sampled symbols of the walks from `starts`: with `filters` only of walks whose prefixes are in them,
    and which; without, the keys of all prefixes."""
    which, prefixes = np.arange(len(starts), dtype=np.int32), []
    at, key, sampled = starts.astype(np.int32), np.zeros(len(starts), np.uint64), 0
    for step in range(walk.steps[-1] + 1):
        symbol = text.take(at, mode="clip")
        if step == walk.steps[sampled]:
            key = key * _MIX + (symbol.astype(np.uint64) + np.uint64(1))
            if filters is None:
                prefixes.append(key)
            else:
                own = filters[sampled][_slot(key, bits)]
                which, at, key, symbol = which[own], at[own], key[own], symbol[own]
            sampled += 1
        at += walk.bits[step].take(symbol)
    return prefixes if filters is None else (which, key)


def prepare_walks(ids: list, texts: list[bytes], span: int, used: list[Walk]) -> Stretches:
    """A stretch begins at each byte of an item that leaves room for the bytes it covers on average."""
    first, steps, _ = STRETCHES[span]
    begin = np.append(0, np.cumsum([len(t) + steps for t in texts]))
    text = np.frombuffer(b"".join(t + bytes(steps) for t in texts) + bytes(8), np.uint8)
    count = [max(1, len(t) - steps // 2 + 1) for t in texts]
    item = np.repeat(np.arange(len(texts)), count)
    offset = np.concatenate([np.arange(n) for n in count])
    starts = begin[item] + offset
    heads = np.zeros(1 << _TABLE, bool)
    heads[_slot(grams(text, first)[starts], _TABLE)] = True
    bits = min(18, max(10, len(starts).bit_length() + 3))
    keys, filters = [], []
    for walk in used:
        prefixes = embed(text, starts, walk, None, bits)
        order = np.argsort(prefixes[-1])
        keys.append((prefixes[-1][order], order))
        levels = []
        for prefix in prefixes:
            level = np.zeros(1 << bits, bool)
            level[_slot(prefix, bits)] = True
            levels.append(level)
        filters.append(levels)
    return Stretches(span, ids, texts, item, offset, used, keys, filters, bits, heads)


def walked(text: np.ndarray, queries: list[Stretches], begin: np.ndarray) -> Iterator[tuple[Stretches, tuple[int, int, int, int]]]:
    """The query and (item, text, diagonal, diagonal) wherever one stretch agrees in all sampled symbols of one repetition.

    A text is the one that the stretch itself is in, wherever the item's window would begin.
    """
    for size in sorted({STRETCHES[q.span][0] for q in queries}):
        own = [q for q in queries if STRETCHES[q.span][0] == size]
        heads = np.logical_or.reduce([q.first for q in own])
        lanes = np.ndarray(max(0, len(text) - 7), "<u8", text, strides=(1,))
        for low in range(0, len(lanes), _CHUNK):
            slot = _slot(lanes[low: low + _CHUNK] & _LANE[size], _TABLE)
            hit = np.flatnonzero(heads[slot])
            for q in own:
                starts = low + hit[q.first[slot[hit]]]
                for walk, (keys, order), filters in zip(q.walks, q.keys, q.filters):
                    which, key = embed(text, starts, walk, filters, q.bits)
                    if not len(key):
                        continue
                    lo, hi = np.searchsorted(keys, key), np.searchsorted(keys, key, side="right")
                    n = hi - lo
                    stretch = order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                    place = np.repeat(starts[which], n)
                    doc = np.searchsorted(begin, place, side="right") - 1
                    for i, d, line in zip(q.item[stretch].tolist(), doc.tolist(), (place - q.offset[stretch]).tolist()):
                        yield q, (i, d, line, line)


# -- short items: grams --------------------------------------------------------------------

@dataclass
class Queries:
    """Short items of one block and one length: their grams, where each occurs, how many a place must share; strips as shifts."""

    size: int
    ids: list
    texts: list[bytes]
    length: np.ndarray
    needed: np.ndarray
    shift: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    tables: list[tuple[np.uint64, np.uint64, np.ndarray]]


def gram_size(length: int, rate: float) -> int:
    """So short that every copy within the allowed edits shares a gram."""
    return max(1, min(3 if length >= 10 else 2 if length >= 5 else length, length // (int(rate * length) + 1)))


def _tables(keys: np.ndarray) -> list[tuple[np.uint64, np.uint64, np.ndarray]]:
    """Hash tables of places in `keys`; a key whose slot is taken goes to the next table."""
    tables, left, factor = [], np.arange(len(keys)), int(_MIX)
    while len(left):
        bits = min(22, max(10, int(len(left)).bit_length() + 5))
        shift, odd = np.uint64(64 - bits), np.uint64(factor)
        table = np.full(1 << bits, -1, np.int32)
        slot = (keys[left] * odd) >> shift
        table[slot] = left
        tables.append((odd, shift, table))
        left = left[table[slot] != left]
        factor = factor * 0xD1342543DE82EF95 % (1 << 64) | 1
    return tables


def _lookup(q: Queries, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of `key` that are grams of an item, and which."""
    at, which, rest = [], [], None
    for odd, shift, table in q.tables:
        own = key if rest is None else key[rest]
        slot = table[(own * odd) >> shift]
        taken = np.flatnonzero(slot >= 0)
        slot = slot[taken]
        place = taken if rest is None else rest[taken]
        same = q.keys[slot] == key[place]
        at.append(place[same])
        which.append(slot[same])
        rest = place[~same]
        if not len(rest):
            break
    return (np.concatenate(at), np.concatenate(which)) if at else (np.zeros(0, np.int64),) * 2


def prepare(ids: list, texts: list[bytes], span: int, repetitions: int, rate: float = RATE) -> Stretches | Queries:
    """Walks of so many repetitions for a length class; for items shorter than all of them, grams."""
    if span >= LONG:
        return prepare_walks(ids, texts, span, walks(span, repetitions))
    size = gram_size(span, rate)
    length = np.array([len(t) for t in texts], np.int64)
    slack = (rate * length).astype(np.int64)
    begin = np.append(0, np.cumsum(length + size))
    keys = grams(np.frombuffer(b"".join(t + bytes(size) for t in texts) + bytes(8), np.uint8), size)
    at = np.concatenate([np.arange(max(0, n - size + 1)) + b for n, b in zip(length.tolist(), begin.tolist())])
    at = at[np.argsort(keys[at], kind="stable")]
    item = np.searchsorted(begin, at, side="right") - 1
    different, first = np.unique(keys[at], return_index=True)
    shift = np.ceil(np.log2(slack + 1)).astype(np.int64)
    return Queries(size, ids, texts, length, np.maximum(length - size + 1 - slack * size, 1), shift, different, np.append(first, len(at)), item, at - begin[item], _tables(different))


def candidates(text: np.ndarray, q: Queries, begin: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(item, text, first and last diagonal) wherever an item shares as many grams as it needs within two strips of diagonals.

    Texts are told apart by the places of the shared grams themselves.
    """
    reach = int((q.length + (1 << q.shift)).max())
    most = max(4 * reach, min(_CHUNK, _CELLS // max(1, int((1.0 / (1 << q.shift)).sum()))))
    keys = grams(text, q.size)
    for low in range(0, max(1, len(keys) - reach), most - reach):
        at, which = _lookup(q, keys[low: low + most])
        n = q.first[which + 1] - q.first[which]
        total = int(n.sum())
        if not total:
            continue
        use = np.repeat(q.first[which] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(total)
        item = q.item[use]
        diagonal = np.repeat(at, n) - q.offset[use] + q.length[item]
        wide = ((most + q.length) >> q.shift) + 2
        base = np.append(0, np.cumsum(wide))
        cell = base[item] + (diagonal >> q.shift[item])
        count = np.bincount(cell, minlength=base[-1] + 1).astype(np.int32)
        needed = np.repeat(q.needed.astype(np.int32), wide)
        enough = np.flatnonzero(count[:-1] + count[1:] >= needed)
        if not len(enough):
            continue
        in_one = np.zeros(base[-1] + 1, bool)
        in_one[enough] = in_one[enough + 1] = True
        hit = np.flatnonzero(in_one[cell])
        lit = np.zeros(base[-1] + 1, bool)
        lit[enough] = True
        place = np.repeat(at, n)[hit] + low
        doc = np.searchsorted(begin, place, side="right") - 1
        for back in (0, 1):  # a gram counts for the pair of strips that begins with its own, and for the one before
            own = np.flatnonzero(lit[cell[hit] - back] & (cell[hit] - back >= base[item[hit]]))
            group = np.stack([cell[hit][own] - back, doc[own]])
            if back == 0:
                groups, diagonals = [group], [diagonal[hit][own]]
            else:
                groups.append(group)
                diagonals.append(diagonal[hit][own])
        group, line = np.concatenate(groups, axis=1), np.concatenate(diagonals)
        order = np.lexsort((line, group[1], group[0]))
        group, line = group[:, order], line[order]
        edge = np.flatnonzero(np.append(True, (group[:, 1:] != group[:, :-1]).any(axis=0)))
        last = np.append(edge[1:], len(line)) - 1
        whose = np.searchsorted(base, group[0, edge], side="right") - 1
        shifted = low - q.length[whose]
        enough = last - edge + 1 >= q.needed[whose]
        yield from zip(*(x[enough].tolist() for x in (whose, group[1, edge], line[edge] + shifted, line[last] + shifted)))


def best_alignment(item: bytes, text: bytes) -> tuple[int, int]:
    """Least edit distance between the item and any part of text, and where the first such part ends."""
    n, seen = len(item), {}
    for i, c in enumerate(item):
        seen[c] = seen.get(c, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score, best, end = full, 0, n, n, 0
    for j, c in enumerate(text):
        match = seen.get(c, 0)
        diagonal = (((match & plus) + plus) ^ plus) | match | minus
        up = minus | ~(diagonal | plus) & full
        down = plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1 & full, down << 1 & full
        plus = down | ~(diagonal | up) & full
        minus = up & diagonal
        if score < best:
            best, end = score, j + 1
    return best, end


def _merged(found: list[tuple[int, int, int, int]], near: int = 16) -> Iterator[tuple[int, int, int, int]]:
    """Candidates of one item and text whose diagonals overlap or lie near each other are one."""
    now = None
    for i, doc, low, high in found:
        if now and now[:2] == (i, doc) and low <= now[3] + near:
            now = (i, doc, now[2], max(high, now[3]))
        else:
            if now:
                yield now
            now = (i, doc, low, high)
    if now:
        yield now


def find(raw: np.ndarray, at: np.ndarray, queries: list[Stretches | Queries], rate: float) -> list[tuple[int, object, int, int, int]]:
    """(text, item id, distance, first and last byte in the text) of each item's best window in each text."""
    text, begin, end, origin = normalise(raw, at, 8)
    data, out = text.tobytes(), {}
    proposed = {id(q): set(candidates(text, q, begin)) if isinstance(q, Queries) else set() for q in queries}
    for q, place in walked(text, [q for q in queries if isinstance(q, Stretches)], begin):
        proposed[id(q)].add(place)
    for q in queries:
        for i, doc, low, high in _merged(sorted(proposed[id(q)])):
            item, best = q.texts[i], out.get((doc, q.ids[i]))
            slack = int(rate * len(item))
            if best and best[0] == 0:
                continue
            a, b = max(begin[doc], low - slack), min(end[doc], high + len(item) + slack)
            if b - a < len(item) - slack:
                continue
            window = data[a:b]
            place = window.find(item)
            distance, stop = (0, place + len(item)) if place >= 0 else best_alignment(item, window)
            if distance <= slack and (best is None or distance < best[0]):
                first = max(a, a + stop - len(item))
                base = at[doc]
                out[doc, q.ids[i]] = (distance, int(origin[first] - base), int(origin[a + stop - 1] - base) + 1)
    return [(doc, item, *found) for (doc, item), found in out.items()]


def edited(text: bytes, rate: float, rng: np.random.Generator) -> bytes:
    """A text with about rate * len random insertions, deletions and replacements."""
    out = bytearray(text)
    for _ in range(max(1, int(rate * len(text)))):
        at, kind = int(rng.integers(len(out))), rng.integers(3)
        if kind == 0:
            out.insert(at, int(rng.integers(97, 123)))
        elif kind == 1 and len(out) > 1:
            del out[at]
        else:
            out[at] = int(rng.integers(97, 123))
    return bytes(out)


def calibrate(texts: list[bytes], span: int, rate: float, recall: float, most: int = MOST_REPETITIONS, trials: int = 400) -> int:
    """Repetitions (at most `most`) after which `recall` of items with all allowed edits, at random places, are candidates.

    Raises ValueError if more would be needed. Short items (span under LONG) take none: what they ask for loses no copy.
    """
    if span < LONG:
        return 0
    rng = np.random.default_rng(7)
    some = [texts[k] for k in rng.permutation(len(texts))[:trials]]
    copies = [edited(some[k % len(some)], rate, rng) for k in range(trials)]
    pad = b" zz ".ljust(STRETCHES[span][1], b"~")
    data = np.frombuffer(b"".join(c + pad for c in copies) + bytes(8), np.uint8)
    begin = np.cumsum([0] + [len(c) + len(pad) for c in copies])[:-1]
    found = np.zeros(trials, bool)
    for n, walk in enumerate(walks(span, most), 1):
        q = prepare_walks(list(range(len(some))), some, span, [walk])
        for _, (i, copy, _, _) in walked(data, [q], begin):
            found[copy] |= some[copy % len(some)] == some[i]
        if found.mean() >= recall:
            return n
    raise ValueError(f"recall {recall} is out of reach for items of {span} bytes or more with {rate} of them edited")


def _schema(id_type: T.DataType, item_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("doc_id", id_type), T.StructField("item_id", item_type)]
                        + [T.StructField(c, T.LongType()) for c in ("distance", "start", "end")])


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[object, bytes]]]:
    """The items in blocks of about BLOCK; each block is read when its turn comes."""
    items = benchmark.select("item_id", "text").filter(F.col("text").isNotNull())
    count = max(1, -(-items.count() // BLOCK))
    for k in range(count):
        block = items.filter(F.pmod(F.xxhash64("text"), F.lit(count)) == k).collect()
        yield [(r["item_id"], plain(r["text"])) for r in block]


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, recall: float = RECALL) -> DataFrame:
    """Items of `benchmark` (item_id, text) found in `docs` (doc_id, text): one row for each row of docs and item.

    doc_id, item_id, distance (edits between the item and its best place, both in lower case with single spaces) and the
    place, start and end in UTF-8 bytes of the text as it is; the start is exact up to the distance. Found are places
    with at most rate * length edits; the search is a hash with a recall calibrated at that many edits, the distance is exact. Null and empty texts and
    items hold and are nothing; repeated rows count each, items of one id together; null ids stay null; other columns are ignored; empty
    tables give no rows.
    """
    ship(docs.sparkSession)
    schema = _schema(docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType)
    found = None
    for block in _blocks(benchmark):
        part = _search(docs, block, rate, recall, schema)
        found = part if found is None else found.unionByName(part)
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, recall: float = RECALL) -> DataFrame:
    """The rows of `docs`, all columns as they are, in whose text no item is found (see `leaks`)."""
    ship(docs.sparkSession)
    where = docs.columns.index("text")
    for block in _blocks(benchmark):
        plans = _plans(block, recall, rate)

        def clean(batches: Iterator[pa.RecordBatch], plans=plans) -> Iterator[pa.RecordBatch]:
            queries = [prepare(ids, texts, span, n, rate) for span, ids, texts, n in plans]
            for batch in batches:
                for first, last in slices(batch.column(where)):
                    part = batch.slice(first, last - first)
                    keep = np.ones(part.num_rows, bool)
                    if queries:
                        keep[[r[0] for r in find(*utf8(part.column(where)), queries, rate)]] = False
                    yield part.filter(pa.array(keep))
            release()

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def _plans(items: list[tuple[object, bytes]], recall: float, rate: float) -> list[tuple]:
    """For each length class its item ids, texts and repetitions."""
    groups: dict[int, list[tuple[object, bytes]]] = {}
    for item_id, text in items:
        if text:
            groups.setdefault(next((s for s in SPANS if len(text) >= s), len(text)), []).append((item_id, text))
    return [(span, [i for i, _ in own], [t for _, t in own], calibrate([t for _, t in own], span, rate, recall)) for span, own in groups.items()]


def _search(docs: DataFrame, items: list[tuple[object, bytes]], rate: float, recall: float, schema: T.StructType) -> DataFrame:
    plans = _plans(items, recall, rate)
    item_type = schema["item_id"].dataType

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [prepare(ids, texts, span, n, rate) for span, ids, texts, n in plans]
        if not queries:
            return
        arrow_item = pa.int64() if isinstance(item_type, T.LongType) else None
        for batch in batches:
            for first, last in slices(batch.column(1)):
                part = batch.slice(first, last - first)
                rows = find(*utf8(part.column(1)), queries, rate)
                if rows:
                    doc, item, *rest = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(doc)), pa.array(item, arrow_item), *(pa.array(x, pa.int64()) for x in rest)],
                        ["doc_id", "item_id", "distance", "start", "end"])

    return docs.select("doc_id", "text").mapInArrow(search, schema)
