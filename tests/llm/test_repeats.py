"""Repeated byte strings against a dictionary of all windows."""

import collections
import hashlib
import random

import numpy as np
import pytest

from panelloom.llm import repeats


def plain(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[i: i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i: i + length]] > 1:
                gone[i: i + length] = True
        kept = bytes(np.frombuffer(r, np.uint8)[~gone])
        out.append((len(r), int(gone.sum()), len(repeats.runs(gone)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    letters = "abcdefghijé "

    def text(n):
        return "".join(rng.choice(letters) for _ in range(n))

    passages = [text(n) for n in (300, 399, 420, 700, 1500)]
    out = [None, "", "short", text(900), "ab" * 700, "x" * 1000, "x" * 399, text(5000)]
    for _ in range(40):
        parts = [text(rng.randint(0, 500))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 60)
            parts += [p[a: len(p) - rng.randint(0, 60)], text(rng.randint(0, 300))]
        out.append("".join(parts))
    near = list(text(1800))
    for _ in range(25):  # near copies: different pieces with equal anchors
        copy = near[:]
        copy[rng.randrange(len(copy))] = "#"
        out.append("".join(copy))
    out += [out[10]] * 3 + [passages[3] + passages[3], text(450) * 2]
    return out


@pytest.mark.parametrize("group", [1 << 10, 3])
def test_removed_bytes(spark, texts, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    rows = [(i if i != 8 else None, t, 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int").repartition(4)
    got = {r["doc_id"]: tuple(r)[1:] for r in repeats.remove_repeats(docs).collect()}
    assert len(got) == len(rows)
    for (i, _, _), want in zip(rows, plain(texts, 400)):
        assert got[i] == want, i


def test_kept_bytes_and_repeated_rows(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdé") for _ in range(600))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text[:450] + "tail")], "doc_id long, text string")
    got = sorted((r["doc_id"], bytes(r["kept"])) for r in repeats.remove_repeats(docs, keep_text=True).collect())
    assert got == [(1, b""), (1, b""), (2, b"tail")]
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def test_long_texts_are_cut_in_several_goes(spark, monkeypatch, texts):
    monkeypatch.setattr(repeats, "_CHUNK", 700)
    frame = spark.createDataFrame([(b"d", "c", "".join(t or "" for t in texts[3:20]))], "digest binary, copy string, text string")
    raw = frame.first()["text"].encode()
    covered = np.zeros(len(raw) - 399, int)
    # the function is pickled with its module's values at the workers, so the cutting is run here
    for k in range(0, len(raw), 700):
        part = np.frombuffer(raw[k: k + 700 + 399], np.uint8)
        _, start, windows, anchor, _, _ = repeats.pieces(part, np.array([0, len(part)]), 400)
        for a, n, o in zip(start + k, windows, anchor):
            covered[a: a + n] += 1
            assert 0 <= o and o + repeats.GRAM <= n + 399
    assert (covered == 1).all()


def test_construction_on_random_groups():
    rng = np.random.default_rng(3)
    for _ in range(30):
        group, data, anchor = [], [], []
        for g in range(4):
            core = bytes(rng.integers(97, 99, 900).tolist())
            for _ in range(int(rng.integers(1, 6))):
                o = int(rng.integers(0, 369))
                windows = int(rng.integers(1, o + 2))
                piece = bytearray(core[400 - o: 400 - o + windows + 399])
                if rng.integers(2):
                    piece[int(rng.integers(len(piece)))] = 120
                group.append(g)
                data.append(bytes(piece))
                anchor.append(o)
        got = repeats.repeated_windows(np.array(group), data, np.array(anchor), 400, 368)
        for i in range(len(data)):
            others = {(data[j][k: k + 400], k - anchor[j]) for j in range(len(data)) if j != i and group[j] == group[i]
                      for k in range(len(data[j]) - 399)}
            want = [(data[i][k: k + 400], k - anchor[i]) in others for k in range(len(data[i]) - 399)]
            assert got[i].tolist() == want


def test_equal_windows_share_a_group(spark):
    rng = np.random.default_rng(5)
    core = bytes(rng.integers(97, 123, 800).tolist())
    rows = []
    for i in range(60):  # pieces of one anchor at place 400 of the core, with bytes of their own on either side
        anchor = int(rng.integers(0, 369))
        windows = int(rng.integers(1, anchor + 2))
        piece = bytearray(core[400 - anchor: 400 - anchor + windows + 399])
        for side in (slice(0, max(0, anchor - int(rng.integers(0, 369)))), slice(anchor + 32 + int(rng.integers(0, 369)), None)):
            piece[side] = bytes(rng.integers(97, 123, len(piece[side])).tolist())
        rows.append((7, i, anchor, bytes(piece)))
    frame = spark.createDataFrame(rows, "mark long, piece long, anchor int, data binary")
    parts = repeats.part_table(frame, 400).collect()
    seen, covered = collections.defaultdict(set), collections.Counter()
    for r in parts:
        assert r["windows"] <= repeats.STEP and len(r["bytes"]) == r["windows"] + 399 and 0 <= r["offset"] < repeats.STEP
        for k in range(r["windows"]):
            covered[r["piece"], r["start"] + k] += 1
            seen[bytes(r["bytes"][k: k + 400])].add((r["group"], r["offset"] - k))
    assert covered == {(i, k): 1 for _, i, _, d in rows for k in range(len(d) - 399)}
    assert all(len(v) == 1 for v in seen.values())
    held = collections.defaultdict(set)
    for _, i, _, d in rows:
        for k in range(len(d) - 399):
            held[d[k: k + 400]].add((i, k))
    want = {x for v in held.values() if len({i for i, _ in v}) > 1 for x in v}
    assert want
    got = {(r["piece"], k) for r in repeats._shared(frame, 400).collect() for k in range(r["first"], r["last"])}
    assert got == want


def test_a_passage_of_very_many_texts_falls_apart(spark):
    rng = random.Random(9)

    def text(n):
        return "".join(rng.choice("abcdefgh ") for _ in range(n))

    passage, longer = text(300), text(420)
    texts = [text(500) + passage + text(500) for _ in range(150)] + [text(500) + longer + text(500) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in repeats.remove_repeats(docs).collect()}
    assert [got[i] for i in range(len(texts))] == plain(texts, 400)
    assert sum(g[1] > 0 for g in got.values()) == 30
    least = lambda raw: np.argmin(repeats.gram_hashes(np.frombuffer(raw, np.uint8)[-300:]))
    rows = [(0, i, 100 + int(least(passage.encode())), (t[400:500] + passage + t[800:900]).encode()) for i, t in enumerate(texts[:150])]
    groups = repeats.part_table(spark.createDataFrame(rows, "mark long, piece long, anchor int, data binary"), 400).groupBy("group").count()
    assert groups.agg({"count": "max"}).first()[0] == 1
