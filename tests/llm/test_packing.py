"""Packing against a plain best-fit decreasing, and ids against the tokenizer library."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelloom.llm import packing
from panelloom.llm.tokens import encoder

TEXTS = ["", None, "  a  b  c", "one two", "   x <|endoftext|> y", "é è　 ü\n\n  x'll 'S  ", "a\tb \t c\x1c d", " ",
         "thetion word, " * 900, "x" * 99 + " " + "ñ" * 50]


def plain(lengths, capacity):
    """Windows' contents by best fit decreasing, one piece at a time."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits)[1]] -= n
        else:
            room.append(capacity - n)
    return sorted(room)


def test_ids_equal_the_library():
    ids, at = encoder().encode_column(pa.array(TEXTS))
    for i, text in enumerate(TEXTS):
        assert encoder().library().encode(text or "", add_special_tokens=False).ids == ids[at[i]: at[i + 1]].tolist()


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 65, 500) if seed % 2 else rng.integers(5, 30, 300)
    counts = {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True))}
    filled = {}
    for length, _, pieces, first, per, offset in packing.best_fit_decreasing(counts, 64):
        for i in range(pieces):
            filled.setdefault(first + i // per, []).append((offset + i % per * length, length))
    assert sum(len(x) for x in filled.values()) == len(lengths)
    assert sorted(filled) == list(range(len(filled)))
    for window in filled.values():
        end = 0
        for at, n in sorted(window):
            assert at == end
            end += n
        assert end <= 64
    assert sorted(64 - sum(n for _, n in w) for w in filled.values()) == plain(lengths.tolist(), 64)


def test_every_id_is_packed_once(spark):
    rows = [(i if i != 3 else None, t, i) for i, t in enumerate(TEXTS + TEXTS[3:5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id int")
    got = packing.pack(docs.repartition(3), keep_ids=True).toPandas()
    for i, text, _ in rows:
        own = got[got.doc_id.isna()] if i is None else got[got.doc_id == i]
        own = own.sort_values("start")
        ids = encoder().library().encode(text or "", add_special_tokens=False).ids + [0]
        assert [x for piece in own.ids for x in piece] == ids
        assert own.length.sum() == len(ids) == own.doc_tokens.iloc[0]
        assert [zlib.crc32(np.array(p, "<u4").tobytes()) for p in own.ids] == own.ids_crc32.tolist()
    for _, window in got.groupby("sequence_id"):
        window = window.sort_values("offset")
        assert window.offset.tolist() == (window.length.cumsum() - window.length).tolist()
        assert window.length.sum() <= 1024
    assert sorted(got.sequence_id.unique()) == list(range(got.sequence_id.nunique()))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs).count() == 0
    assert packing.pack(docs.withColumn("offset", F.lit(1)), keep_ids=True).columns[-2:] == ["sequence_id", "offset"]
