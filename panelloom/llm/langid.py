"""Language identification with a bidirectional gated recurrent network over bytes, trained and run in numpy.

Each direction is a GRU whose gates use piecewise-linear sigmoids and tangents; since a byte is one of 256 values, the
input's share of the gates is a table row. Every byte position gets language probabilities from both directions' states.
A document's probabilities are the mean over all its positions. Texts are read whole, as consecutive windows of WINDOW
bytes that are batched across documents, so a long text costs what its bytes cost and no more memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.llm.common import release, ship, slices, utf8

WINDOW = 64
HIDDEN = 8
#: The training sample: about so many documents of each language, so many windows of each document.
SAMPLE_DOCUMENTS = 800
SAMPLE_WINDOWS = 4
#: Documents in the sample at most, over all languages: with more than 64 of them each has fewer than SAMPLE_DOCUMENTS.
SAMPLE_TOTAL = 64 * SAMPLE_DOCUMENTS
#: Every label is learned; more than so many are an error.
LANGUAGES = 4096
UNKNOWN = "und"
_BATCH = 4096


def _clip(x, low, high):
    return np.clip(x, low, high, out=x)


@dataclass
class Model:
    """Weights by name: W?, U? of the forward (f) and backward (b) direction, V?, c of the labels."""

    languages: list[str]
    weights: dict[str, np.ndarray]


def initial(languages: list[str], hidden: int, rng: np.random.Generator) -> Model:
    w = {}
    for d in "fb":
        w["W" + d] = rng.normal(0, 0.3, (3 * hidden, 256)).astype(np.float32)
        w["W" + d][: 2 * hidden] += 0.5
        w["U" + d] = (rng.normal(0, 0.4 / np.sqrt(hidden), (3 * hidden, hidden))).astype(np.float32)
        w["V" + d] = rng.normal(0, 0.5, (len(languages), hidden)).astype(np.float32)
    w["c"] = np.zeros((len(languages), 1), np.float32)
    return Model(languages, w)


def _run(x: np.ndarray, W: np.ndarray, U: np.ndarray, steps: range, keep: list | None = None) -> Iterator[np.ndarray]:
    """States after each step of one direction over byte columns x (time, batch); `keep` gets what training needs."""
    hidden, batch = U.shape[1], x.shape[1]
    h = np.zeros((hidden, batch), np.float32)
    g, u = np.empty((3 * hidden, batch), np.float32), np.empty((3 * hidden, batch), np.float32)
    for t in steps:
        np.take(W, x[t], axis=1, out=g, mode="clip")
        np.dot(U, h, out=u)
        g[: 2 * hidden] += u[: 2 * hidden]
        gates = _clip(g[: 2 * hidden], 0, 1)
        z, r, n = gates[:hidden], gates[hidden:], g[2 * hidden:]
        if keep is not None:
            keep.append((t, h.copy(), z.copy(), r.copy(), u[2 * hidden:].copy()))
        u[2 * hidden:] *= r
        n += u[2 * hidden:]
        _clip(n, -1, 1)
        if keep is not None:
            keep[-1] += (n.copy(),)
        h -= n
        h *= z
        h += n
        yield h


def _softmax(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(axis=0)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=0)
    return logits


def loss_and_gradients(model: Model, x: np.ndarray, y: np.ndarray, valid: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy over valid positions of windows x (time, batch) with labels y, and backpropagation through time."""
    w, (steps, batch) = model.weights, x.shape
    hidden, classes = w["Uf"].shape[1], len(model.languages)
    kept: dict[str, list] = {"f": [], "b": []}
    order = {"f": range(steps), "b": range(steps - 1, -1, -1)}
    states = {}
    for d in "fb":
        states[d] = np.empty((steps, hidden, batch), np.float32)
        for t, h in zip(order[d], _run(x, w["W" + d], w["U" + d], order[d], kept[d])):
            states[d][t] = h
    total = max(1, int(valid.sum()))
    grads = {k: np.zeros_like(v) for k, v in w.items()}
    target = np.zeros((classes, batch), np.float32)
    target[y, np.arange(batch)] = 1
    dlogits, loss = np.empty((steps, classes, batch), np.float32), 0.0
    for t in range(steps):
        p = _softmax(w["Vf"] @ states["f"][t] + w["Vb"] @ states["b"][t] + w["c"])
        loss -= float((np.log(np.maximum((p * target).sum(axis=0), 1e-9)) * valid[t]).sum())
        dlogits[t] = (p - target) * valid[t] / total
    grads["c"] = dlogits.sum(axis=(0, 2))[:, None]
    for d in "fb":
        grads["V" + d] = np.einsum("tkb,thb->kh", dlogits, states[d], optimize=True)
        V, U = w["V" + d], w["U" + d]
        da = np.empty((steps, 3 * hidden, batch), np.float32)
        dh = np.zeros((hidden, batch), np.float32)
        for t, before, z, r, u, n in reversed(kept[d]):
            dh = dh + V.T @ dlogits[t]
            dn = dh * (1 - z) * (np.abs(n) < 1)
            da[t, :hidden] = dh * (before - n) * ((z > 0) & (z < 1))
            da[t, hidden: 2 * hidden] = dn * u * ((r > 0) & (r < 1))
            da[t, 2 * hidden:] = dn
            through = da[t].copy()
            through[2 * hidden:] *= r
            grads["U" + d] += through @ before.T
            dh = dh * z + U.T @ through
        flat, at = da.transpose(1, 0, 2).reshape(3 * hidden, -1), x.reshape(-1)
        grads["W" + d] = np.stack([np.bincount(at, row, 256) for row in flat]).astype(np.float32)
    return loss / total, grads


def train(windows: list[bytes], labels: list[str], hidden: int = HIDDEN, steps: int = 300, batch: int = 256, seed: int = 0) -> Model:
    """A model from byte windows and their languages: Adam on balanced batches, a falling rate, fixed seed."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    model = initial(languages, hidden, rng)
    x, valid = pad(windows)
    y = np.array([languages.index(v) for v in labels])
    by_class = [np.flatnonzero(y == k) for k in range(len(languages))]
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.weights.items()}
    for step in range(1, steps + 1):
        pick = np.array([rng.choice(by_class[k]) for k in rng.integers(len(languages), size=batch)])
        _, grads = loss_and_gradients(model, x[:, pick], y[pick], valid[:, pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = 0.02 * (1 - step / (steps + 1)) * min(1, 5 / max(norm, 1e-9))
        for k, g in grads.items():
            m, v = moment[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            model.weights[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def pad(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows as columns (time, batch) filled up with zero bytes, and which positions are their own."""
    x = np.zeros((len(windows), WINDOW), np.uint8)
    sizes = np.array([min(len(v), WINDOW) for v in windows])
    for i, v in enumerate(windows):
        x[i, : sizes[i]] = np.frombuffer(v[:WINDOW], np.uint8)
    return np.ascontiguousarray(x.T), np.ascontiguousarray((np.arange(WINDOW)[:, None] < sizes).astype(np.float32))


def predict(model: Model, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts raw[at[i]:at[i+1]]: mean probabilities and shares of position labels, both (text, language)."""
    w, classes = model.weights, len(model.languages)
    sizes = np.diff(at)
    count = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), count)
    begin = at[text] + (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
    length = np.minimum(WINDOW, at[text + 1] - begin)
    padded = np.append(raw, np.zeros(WINDOW, np.uint8))
    windows = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)
    sums, votes = np.zeros((len(text), classes)), np.zeros((len(text), classes))
    for k in range(0, len(text), _BATCH):
        x = np.ascontiguousarray(windows[begin[k: k + _BATCH]].T)
        own = length[k: k + _BATCH]
        x[np.arange(WINDOW)[:, None] >= own] = 0
        ahead = np.empty((WINDOW, classes, x.shape[1]), np.float32)
        for t, h in enumerate(_run(x, w["Wf"], w["Uf"], range(WINDOW))):
            np.dot(w["Vf"], h, out=ahead[t])
        ahead += w["c"]
        back = range(WINDOW - 1, -1, -1)
        total, vote = np.zeros((classes, x.shape[1]), np.float32), np.zeros((classes, x.shape[1]), np.float32)
        for t, h in zip(back, _run(x, w["Wb"], w["Ub"], back)):
            p = _softmax(ahead[t] + w["Vb"] @ h)
            p *= own > t
            total += p
            vote += (p == p.max(axis=0)) & (own > t)
        sums[k: k + _BATCH], votes[k: k + _BATCH] = total.T, vote.T
    out = [np.stack([np.bincount(text, column, len(sizes)) for column in x.T], axis=1) / np.maximum(sizes, 1)[:, None]
           for x in (sums, votes)]
    return out[0], out[1]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_windows(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS, windows: int = SAMPLE_WINDOWS) -> list[tuple[str, str]]:
    """(lang, text of a window) from about `documents` documents of each learned language, chosen by a hash of doc_id."""
    own = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0)
                      & ~held_out(F.col("doc_id")))
    counts = own.groupBy("lang").agg(F.count(F.lit(1)).alias("count")).limit(LANGUAGES + 1).collect()
    if not counts:
        return []
    if len(counts) > LANGUAGES:
        raise ValueError(f"lang has more than {LANGUAGES} different values")
    documents = min(documents, max(1, SAMPLE_TOTAL // len(counts)))
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1.0, documents / r["count"]))])
    draw = F.pmod(F.xxhash64(F.lit("langid"), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    some = own.filter(draw < F.try_element_at(share, F.col("lang")))
    room = F.greatest(F.length("text") - WINDOW + 1, F.lit(1))
    pieces = F.array(*[F.substring(F.col("text"), (F.pmod(F.xxhash64(F.lit(i), F.col("doc_id")), room) + 1).cast("int"), F.lit(WINDOW))
                       for i in range(windows)])
    rows = some.select("lang", F.explode(pieces).alias("window")).collect()
    return sorted((r["lang"], r["window"]) for r in rows)


def fit(docs: DataFrame) -> Model | None:
    """A model from `docs` (doc_id, text, lang) without the held-out quarter; None if nothing is labelled."""
    sample = training_windows(docs)
    if not sample:
        return None
    return train([w.encode() for _, w in sample], [lang for lang, _ in sample])


def identify(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id or the columns `keep`, then lang_pred, score, position_share.

    The score is the mean probability of the predicted language over all byte positions, position_share the share of
    positions that carry its label. Null texts and texts without a letter are 'und' with score 0, and so is everything
    without a model. Repeated rows stay and agree; ties go to the first language by name; an empty table gives no rows. Names in
    `keep` must not be those of the columns added: rows with any names travel as one struct.
    """
    ship(docs.sparkSession)
    keep = keep or ["doc_id"]
    languages = model.languages if model else []

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in slices(batch.column(where), 8 << 20):
                part = batch.slice(first, last - first)
                lettered = np.array(part.column(0).to_pylist(), bool)
                if model is None:
                    lettered[:] = False
                raw, at = utf8(part.column(where))
                best, score, share = np.zeros(len(lettered), int), np.zeros(len(lettered)), np.zeros(len(lettered))
                if lettered.any():
                    mean, votes = predict(model, raw, at)
                    best = mean.argmax(axis=1)
                    rows = np.arange(len(best))
                    score, share = np.minimum(mean[rows, best], 1) * lettered, votes[rows, best] * lettered
                names = [languages[k] if ok else UNKNOWN for k, ok in zip(best, lettered)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1: 1 + len(keep)], pa.array(names, pa.string()), pa.array(score), pa.array(np.minimum(share, 1.0))],
                    [*keep, "lang_pred", "score", "position_share"])
        release()

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(lettered.alias("_lettered"), *keep, *([] if "text" in keep else ["text"]))
    where = rows.columns.index("text")
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                                                            T.StructField("position_share", T.DoubleType())])
    return rows.mapInArrow(label, schema)
