"""Decontamination: alignment against full dynamic programming, planted passages, recall against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from panelloom.llm import decontaminate as dec
from panelloom.llm.common import utf8


def plain_alignment(item, text):
    rows = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        above, rows = rows, [i] + [0] * len(text)
        for j, d in enumerate(text, 1):
            rows[j] = min(above[j] + 1, rows[j - 1] + 1, above[j - 1] + (c != d))
    return min(rows), rows.index(min(rows))


def sentence(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def words():
    rng = random.Random(2)
    return ["the", "of", "a", "is"] * 40 + ["".join(rng.choice("aeiourstnlé") for _ in range(rng.randint(2, 10))) for _ in range(800)]


def test_alignment_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(300):
        item = bytes(rng.integers(97, 100, rng.integers(1, 90)).tolist())
        text = bytes(rng.integers(97, 100, rng.integers(0, 60)).tolist())
        assert dec.best_alignment(item, text) == plain_alignment(item, text)


def test_normalised_bytes_know_their_place():
    texts = ["  A  b\n", None, "", "É x", "   ", "z"]
    raw, at = utf8(pa.array(texts))
    out, begin, end, origin = dec.normalise(raw, at, 8)
    assert [out[a:b].tobytes().strip().decode() for a, b in zip(begin, end)] == ["a b", "", "", "É x", "", "z"]
    for k in np.flatnonzero(out > 32):
        assert dec._LOWER[raw[origin[k]]] == out[k]


@pytest.mark.parametrize("rate,least", [(0.0, 1.0), (0.05, 0.97), (0.1, 0.9)])
def test_recall_of_planted_items(words, rate, least):
    rng, nrng = random.Random(4), np.random.default_rng(4)
    items = [dec.plain(sentence(rng, rng.randint(14, 60), words)) for _ in range(150)]
    n = dec.calibrate(items, 64, dec.RATE, dec.RECALL)
    assert n < dec.MOST_REPETITIONS
    queries = [dec.prepare(list(range(150)), items, 64, n)]
    docs = [f"{sentence(rng, 80, words)} {(dec.edited(t, rate, nrng) if rate else t).decode('utf8', 'ignore')} {sentence(rng, 80, words)}" for t in items]
    docs += [sentence(rng, 300, words) for _ in range(150)]
    got = {(r[0], r[1]): r[2:] for r in dec.find(*utf8(pa.array(docs)), queries, dec.RATE)}
    truth = {}
    for d in range(150):
        distance = plain_alignment(items[d], dec.plain(docs[d]))[0]
        if distance <= dec.RATE * len(items[d]):
            truth[d, d] = distance
    hits = [k for k in truth if k in got]
    assert len(hits) >= least * len(truth)
    assert all(k in truth for k in got)  # nothing in clean documents
    assert np.mean([got[k][0] == truth[k] for k in hits]) > 0.95
    for (d, i), (_, start, end) in got.items():
        if rate == 0:
            assert dec.plain(docs[d].encode()[start:end].decode()) == items[i]


def test_leaks(spark, words, monkeypatch):
    rng = random.Random(9)
    items = [sentence(rng, 40, words), sentence(rng, 5, words), "short", sentence(rng, 30, words)]
    benchmark = spark.createDataFrame([(10, items[0]), (11, items[1]), (12, items[2]), (None, items[3]), (14, None), (15, ""), (10, items[0])],
                                      "item_id long, text string")
    lead = sentence(rng, 20, words)
    docs = [(1, f"{lead} {''.join(c.upper() if c.isascii() else c for c in items[0])} tail"), (2, items[1]), (3, f"{lead} Short {lead}"), (None, items[3].replace(" ", "\n ")),
            (5, None), (6, ""), (7, lead), (8, (lead + " ") * 3000 + items[0]), (1, f"{lead} {items[0]} tail")]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int").repartition(3)
    for block in (4096, 2):
        monkeypatch.setattr(dec, "BLOCK", block)
        got = sorted(((r["doc_id"] or -1, r["item_id"] or -1, r["distance"]) for r in dec.leaks(frame, benchmark).collect()))
        assert got == [(-1, -1, 0), (1, 10, 0), (1, 10, 0), (2, 11, 0), (3, 12, 0), (8, 10, 0)]
    assert dec.leaks(frame.limit(0), benchmark).count() == 0
    assert dec.leaks(frame, benchmark.limit(0)).count() == 0


@pytest.mark.parametrize("rate", [0.08, 0.12, 0.15])
def test_recall_up_to_the_allowed_edits(words, rate):
    rng, nrng = random.Random(6), np.random.default_rng(6)
    items = [dec.plain(sentence(rng, rng.randint(14, 60), words)) for _ in range(200)] + [dec.plain(sentence(rng, 6, words)) for _ in range(40)]
    queries = [dec.prepare(i, t, s, n) for s, i, t, n in dec._plans(list(enumerate(items)), dec.RECALL, dec.RATE)]
    copies = [dec.edited(t, rate, nrng) for t in items]
    docs = [f"{sentence(rng, 60, words)} {c.decode('utf8', 'ignore')} {sentence(rng, 60, words)}" for c in copies]
    truth = {(d, d) for d in range(len(items)) if plain_alignment(items[d], dec.plain(docs[d]))[0] <= dec.RATE * len(items[d])}
    got = {(r[0], r[1]) for r in dec.find(*utf8(pa.array(docs)), queries, dec.RATE)}
    for few in (range(200), range(200, 240)):
        own = {k for k in truth if k[0] in few}
        assert len(own & got) >= 0.93 * len(own)


def test_text_without_spaces_and_behind_punctuation(words):
    rng = random.Random(7)
    signs = [chr(c) for c in range(0x4E00, 0x4E00 + 900)]
    run = lambda n: "".join(rng.choice(signs) for _ in range(n))
    items = [run(60) for _ in range(20)] + ["abc " + sentence(rng, 3, words) for _ in range(20)] + [sentence(rng, 20, words) for _ in range(20)]
    queries = [dec.prepare(i, t, s, n) for s, i, t, n in dec._plans([(k, dec.plain(t)) for k, t in enumerate(items)], dec.RECALL, dec.RATE)]
    docs = [run(300) + t + run(300) if k < 20 else f"{sentence(rng, 30, words)} <b>\"{t}\"</b> {sentence(rng, 30, words)}" for k, t in enumerate(items)]
    got = {(r[0], r[1]): r[2] for r in dec.find(*utf8(pa.array(docs)), queries, dec.RATE)}
    assert [got.get((k, k)) for k in range(60)] == [0] * 60


def test_an_items_tail_at_the_start_of_a_document(words):
    rng = random.Random(8)
    item = dec.plain(sentence(rng, 150, words))[:600]
    queries = [dec.prepare(i, t, s, n) for s, i, t, n in dec._plans([(0, item)], dec.RECALL, dec.RATE)]
    docs = [sentence(rng, 200, words), item[80:].decode("utf8", "ignore") + " " + sentence(rng, 50, words)]
    want = plain_alignment(item, dec.plain(docs[1]))[0]
    assert want <= 90
    for first in (0, 1):
        found = [r[:3] for r in dec.find(*utf8(pa.array(docs[first:])), queries, dec.RATE)]
        assert found == [(1 - first, 0, want)]


def test_each_length_class_reaches_its_recall(words):
    """Copies with all allowed edits, for each class; one that can't reach it raises."""
    rng, nrng = random.Random(12), np.random.default_rng(12)
    for span, longest in zip(dec.SPANS, (400, *dec.SPANS)):
        items = [dec.plain(sentence(rng, longest, words))[: rng.randrange(span, longest)] for _ in range(120)]
        n = dec.calibrate(items, span, dec.RATE, dec.RECALL)
        assert 1 <= n < dec.MOST_REPETITIONS
        copies = [f"{sentence(rng, 20, words)} {dec.edited(t, dec.RATE, nrng).decode('utf8', 'ignore')} {sentence(rng, 20, words)}" for t in items]
        truth = {d for d in range(120) if plain_alignment(items[d], dec.plain(copies[d]))[0] <= dec.RATE * len(items[d])}
        got = {r[0] for r in dec.find(*utf8(pa.array(copies)), [dec.prepare(list(range(120)), items, span, n)], dec.RATE) if r[0] == r[1]}
        assert len(truth & got) >= 0.9 * len(truth) and len(truth) > 30
    with pytest.raises(ValueError, match="out of reach"):
        dec.calibrate(items, 24, 0.45, 0.99, most=2)
