"""The recurrent network: numeric gradients, window arithmetic against one text at a time, held-out accuracy."""

import os
import zlib

import numpy as np
import pytest

from panelloom.llm import langid
from panelloom.llm.queries import op2_langid

SF = "/root/testdata/sf0.001"


def test_gradients_are_numeric_slopes():
    rng = np.random.default_rng(1)
    model = langid.initial(["a", "b", "c"], 4, rng)
    x, y = rng.integers(0, 256, (9, 6)).astype(np.uint8), rng.integers(0, 3, 6)
    valid = (np.arange(9)[:, None] < rng.integers(3, 10, 6)).astype(np.float32)
    loss, grads = langid.loss_and_gradients(model, x, y, valid)
    assert loss > 0
    for name in ("Uf", "Ub", "Vf", "Vb", "c", "Wf", "Wb"):
        w = model.weights[name]
        close = []
        for _ in range(12):
            at = tuple(rng.integers(0, n) for n in w.shape)
            if name[0] == "W":
                at = (at[0], int(x[rng.integers(3), rng.integers(6)]))
            old, step = w[at], 1e-2
            w[at] = old + step
            up, _ = langid.loss_and_gradients(model, x, y, valid)
            w[at] = old - step
            down, _ = langid.loss_and_gradients(model, x, y, valid)
            w[at] = old
            close.append(abs((up - down) / (2 * step) - grads[name][at]) < 2e-3 + 0.05 * abs(grads[name][at]))
        assert np.mean(close) >= 0.75, name  # the clipped gates have kinks


def test_prediction_reads_whole_texts():
    rng = np.random.default_rng(2)
    model = langid.initial(["a", "b"], 4, rng)
    texts = [rng.integers(1, 256, n).astype(np.uint8) for n in (0, 1, 63, 64, 65, 500, 40_000)]
    raw, at = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    mean, votes = langid.predict(model, raw, at)
    for i, t in enumerate(texts):
        alone, own = langid.predict(model, t, np.array([0, len(t)]))
        assert np.allclose(mean[i], alone[0], atol=1e-5) and np.allclose(votes[i], own[0])
        assert len(t) == 0 or abs(mean[i].sum() - 1) < 1e-4
    changed = raw.copy()
    changed[-1] ^= 7  # the last byte of the longest text counts
    assert not np.array_equal(langid.predict(model, changed, at)[0][-1], mean[-1])


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_held_out_accuracy(spark):
    got = op2_langid(spark, SF).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(got) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in got)


def test_odd_rows(spark):
    rows = [(1, "the thing is the other " * 20, "en"), (2, "die der das und nicht " * 20, "de"), (None, "the", "en"), (4, None, "en"),
            (5, "", None), (6, "123 !?", None), (7, "é" * 300, None), (8, "the " * 200_000, "en"), (1, "the thing is", "en")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    model = langid.train([b"the thing is the other", b"die der das und nicht"] * 8, ["en", "de"] * 8, steps=30)
    got = langid.identify(docs, model).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert by[4] == by[5] == by[6] == ("und", 0.0)
    assert by[7][0] in ("en", "de") and by[8][0] == "en"
    assert langid.identify(docs.limit(0), model).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, langid.fit(docs.limit(0))).collect()} == {"und"}
