"""Personal data: fixed patterns, and a character BiLSTM with a CRF on top for forms that the patterns do not know.

The network reads characters in overlapping windows and scores begin/inside/outside tags of the four kinds and of a
fifth that no pattern finds, secrets (keys, tokens, passwords); the CRF adds learned transitions between tags, and Viterbi
finds the best tags of each window. Where windows overlap, a character keeps the tag from the window it lies deepest in. A
span that reaches the end of what has been read is followed into the next windows. It is trained in numpy, by the CRF's exact gradient through both LSTMs,
on labelled spans: corpus snippets with forms put into them, whose places are therefore known, and with numbers, dates
and hashes that are nothing. A span that the network adds must hold what its kind needs and may not touch a pattern's. A
secret is a whole word of letters and digits, 16 or more, that something is set to.

Each kind holds a digit or an at sign (or the words at, dot), so windows without any of these are known to be outside.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.llm.common import release, ship, slices

#: The kinds that have patterns, in the order of results, and all.
KINDS = ["email", "ip", "card", "phone"]
ALL_KINDS = [*KINDS, "secret"]
TAGS = ["O"] + [f"{b}-{k}" for k in ALL_KINDS for b in "BI"]
WINDOW = 48
HIDDEN = 12
#: Corpus snippets around which training examples are made.
SNIPPETS = 400
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARK = r"[0-9@]|(?i: at | dot |[\[(](?:at|dot)[\])])"
_MARK = re.compile(MARK)
_AT = r"(?:@| ?[\[(](?i:at)[\])] ?| (?i:at) )"
_DOT = r"(?:\.| ?\[\.\] ?| ?[\[(](?i:dot)[\])] ?| (?i:dot) )"
_WRITTEN = re.compile(rf"[A-Za-z0-9._%+-]+{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+")
_IN_SECRET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-+/")
_SET_TO = re.compile(r"(?:[=:][\x20]?[\"'`]?|(?i:bearer)[\x20])\Z")
#: A span with a tag among so many last characters of what has been read is followed further.
_BORDER = 4
_OTHER = 128


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = sum(int(c) if k % 2 == 0 else (2 * int(c)) // 10 + (2 * int(c)) % 10 for k, c in enumerate(reversed(number)))
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern local@domain, leftmost first: found from the at signs, since a local part cannot hold one."""
    free, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at)
        if domain:
            start = at
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, domain.end()
                free = domain.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the patterns' matches that pass their checks, by start and kind."""
    found = [(a, b, 0) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found.append((*m.span(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(number := digits(m[0])) <= 19 and luhn(number):
            found.append((*m.span(), 2))
    if "+" in text:
        found += [(*m.span(), 3) for m in _PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], s[2]))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{ALL_KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2])))


def encode(text: str) -> np.ndarray:
    """Character classes: ASCII as it is, letters beyond it as one class, everything else as another."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    out = np.minimum(codes, _OTHER).astype(np.uint8)
    for k in np.flatnonzero(codes >= _OTHER):
        out[k] = 1 if text[k].isalpha() else 2
    return out


@dataclass
class Tagger:
    weights: dict[str, np.ndarray]


def initial(rng: np.random.Generator, hidden: int = HIDDEN) -> Tagger:
    w = {}
    for d in "fb":
        w["W" + d] = rng.normal(0, 0.3, (4 * hidden, _OTHER))
        w["W" + d][hidden: 2 * hidden] += 0.5  # forget gates start open
        w["U" + d] = rng.normal(0, 0.6 / np.sqrt(hidden), (4 * hidden, hidden))
        w["V" + d] = rng.normal(0, 0.3, (len(TAGS), hidden))
    w["c"], w["A"], w["S"] = np.zeros((len(TAGS), 1)), np.zeros((len(TAGS), len(TAGS))), np.zeros(len(TAGS))
    return Tagger({k: v.astype(np.float32) for k, v in w.items()})


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _lstm(x: np.ndarray, W: np.ndarray, U: np.ndarray, steps: range, keep: list | None = None) -> np.ndarray:
    """Hidden states (time, hidden, batch) of one direction."""
    hidden, batch = U.shape[1], x.shape[1]
    h, c = np.zeros((hidden, batch), W.dtype), np.zeros((hidden, batch), W.dtype)
    out = np.empty((x.shape[0], hidden, batch), W.dtype)
    for t in steps:
        a = W[:, x[t]] + U @ h
        gates, g = _sigmoid(a[: 3 * hidden]), np.tanh(a[3 * hidden:])
        i, f, o = gates[:hidden], gates[hidden: 2 * hidden], gates[2 * hidden:]
        new = f * c + i * g
        tc = np.tanh(new)
        if keep is not None:
            keep.append((t, h, c, i, f, o, g, tc))
        h, c = o * tc, new
        out[t] = h
    return out


def emissions(w: dict[str, np.ndarray], x: np.ndarray, kept: dict[str, list] | None = None):
    steps = x.shape[0]
    f = _lstm(x, w["Wf"], w["Uf"], range(steps), None if kept is None else kept["f"])
    b = _lstm(x, w["Wb"], w["Ub"], range(steps - 1, -1, -1), None if kept is None else kept["b"])
    return np.einsum("kh,thb->tkb", w["Vf"], f) + np.einsum("kh,thb->tkb", w["Vb"], b) + w["c"], f, b


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def loss_and_gradients(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """CRF negative log-likelihood of tags y (time, batch) for characters x, and its gradient through time."""
    kept: dict[str, list] = {"f": [], "b": []}
    e, hf, hb = emissions(w, x, kept)
    steps, tags, batch = e.shape
    cols, A = np.arange(batch), w["A"]
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0] + w["S"][:, None]
    for t in range(1, steps):
        alpha[t] = e[t] + _logsum(alpha[t - 1][:, None] + A[:, :, None], 0)
    for t in range(steps - 2, -1, -1):
        beta[t] = _logsum(A[:, :, None] + (e[t + 1] + beta[t + 1])[None], 1)
    z = _logsum(alpha[-1], 0)
    gold = e[0, y[0], cols] + w["S"][y[0]]
    de = np.exp(alpha + beta - z)
    grads = {k: np.zeros_like(v) for k, v in w.items()}
    grads["S"] = de[0].sum(axis=1) - np.bincount(y[0], minlength=tags)
    for t in range(1, steps):
        gold = gold + e[t, y[t], cols] + A[y[t - 1], y[t]]
        pair = np.exp(alpha[t - 1][:, None] + A[:, :, None] + (e[t] + beta[t])[None] - z)
        grads["A"] += pair.sum(axis=2)
        np.subtract.at(grads["A"], (y[t - 1], y[t]), 1)
    for t in range(steps):
        de[t, y[t], cols] -= 1
    grads["c"] = de.sum(axis=(0, 2))[:, None]
    for d, states in (("f", hf), ("b", hb)):
        grads["V" + d] = np.einsum("tkb,thb->kh", de, states, optimize=True)
        V, U = w["V" + d], w["U" + d]
        hidden = U.shape[1]
        da = np.empty((steps, 4 * hidden, batch), e.dtype)
        dh, dc = np.zeros((hidden, batch), e.dtype), np.zeros((hidden, batch), e.dtype)
        for t, h, c, i, f, o, g, tc in reversed(kept[d]):
            dh = dh + V.T @ de[t]
            dc = dc + dh * o * (1 - tc * tc)
            da[t, :hidden] = dc * g * i * (1 - i)
            da[t, hidden: 2 * hidden] = dc * c * f * (1 - f)
            da[t, 2 * hidden: 3 * hidden] = dh * tc * o * (1 - o)
            da[t, 3 * hidden:] = dc * i * (1 - g * g)
            grads["U" + d] += da[t] @ h.T
            dh, dc = U.T @ da[t], dc * f
        flat, at = da.transpose(1, 0, 2).reshape(4 * hidden, -1), x.reshape(-1)
        grads["W" + d] = np.stack([np.bincount(at, row, _OTHER) for row in flat])
    return float((z - gold).sum()) / batch, {k: (g / batch).astype(w[k].dtype) for k, g in grads.items()}


def viterbi(w: dict[str, np.ndarray], e: np.ndarray) -> np.ndarray:
    """Best tags (time, batch)."""
    score, back = e[0] + w["S"][:, None], []
    for t in range(1, len(e)):
        ways = score[:, None] + w["A"][:, :, None]
        back.append(ways.argmax(axis=0))
        score = ways.max(axis=0) + e[t]
    tags = np.empty((len(e), e.shape[2]), np.int64)
    tags[-1] = score.argmax(axis=0)
    for t in range(len(e) - 2, -1, -1):
        tags[t] = back[t][tags[t + 1], np.arange(e.shape[2])]
    return tags


def _number(rng, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _word(rng) -> str:
    return "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(3, 9)))


def example(rng: np.random.Generator) -> tuple[str, int]:
    """A form and its kind number, or -1 for something that is nothing."""
    pick = int(rng.integers(17))
    name, host, end = f"{_word(rng)}{rng.choice(['', '.', '_', '7'])}{_word(rng)}", _word(rng), str(rng.choice(["com", "org", "net", "de"]))
    for _ in range(int(rng.choice([0, 0, 0, 1, 2, 3]))):
        host += f"{rng.choice(['-', '', ''])}{_word(rng)}"
    if pick == 0:
        return f"{name}@{host}.{end}", 0
    if pick == 1:
        at, dot = rng.choice(["at", "[at]", "(at)"]), rng.choice(["dot", "[dot]", "(dot)"])
        return (f"{name} {at} {host} {dot} {end}", f"{name} {at} {host} {dot} {end}".upper())[int(rng.integers(4) == 0)], 0
    if pick == 2:
        return f"{name}@{host}[.]{end}", 0
    if pick == 3:
        return ".".join(str(v) for v in rng.integers(0, 256, 4)), 1
    if pick == 4:
        return str(rng.choice([" ", "-"])).join(_number(rng, 4) for _ in range(4)), 2
    if pick == 5:
        return f"+{rng.integers(1, 99)} ({_number(rng, 3)}) {_number(rng, 3)}-{_number(rng, 4)}", 3
    if pick == 6:
        return f"({_number(rng, 3)}) {_number(rng, 3)}-{_number(rng, 4)}", 3
    if pick == 7:
        sep = str(rng.choice(["-", "."]))
        return f"{_number(rng, 3)}{sep}{_number(rng, 3)}{sep}{_number(rng, 4)}", 3
    if pick == 8:
        return f"{rng.integers(1900, 2030)}-{rng.integers(1, 13):02}-{rng.integers(1, 29):02}", -1
    if pick == 9:
        said = str(rng.choice(["", "", "commit ", "commit: ", "sha256: ", "digest = ", "id="]))
        return said + _drawn(rng, "0123456789abcdef", int(rng.integers(8, 65))), -1
    if pick == 10:
        return _number(rng, int(rng.integers(1, 14))), -1
    if pick == 11:
        return f"{rng.integers(0, 30)}.{rng.integers(0, 30)}" + (f".{rng.integers(0, 30)}" if rng.integers(2) else ""), -1
    if pick == 12:
        return f"{_word(rng)} at {_word(rng)}", -1
    letters = "0123456789abcdef" if rng.integers(2) else "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_-"
    return _drawn(rng, letters, int(rng.choice([20, 24, 32, 40, 40, 48, 64]))), 4


def _drawn(rng, letters: str, n: int) -> str:
    return "".join(rng.choice(list(letters), n))


def setting(rng: np.random.Generator) -> tuple[str, str]:
    """What stands before and behind a secret."""
    name = str(rng.choice(["key", "api_key", "apikey", "token", "access_token", "secret", "client_secret", "password", "passwd", "auth"]))
    quote = str(rng.choice(['"', "'", ""]))
    return f"{name}{rng.choice([' = ', '=', ': ', ':'])}{quote}", quote


def training_windows(snippets: list[str], count: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Windows of characters and tags (time, batch): corpus snippets with one or two labelled forms put in."""
    x, y = np.zeros((count, WINDOW), np.uint8), np.zeros((count, WINDOW), np.int64)
    for n in range(count):
        text, tags = "", []
        for _ in range(int(rng.integers(1, 3))):
            around = str(rng.choice(snippets)) if snippets else f"{_word(rng)} {_word(rng)} "
            cut = int(rng.integers(0, max(1, len(around) - 20)))
            lead = around[cut: cut + int(rng.integers(2, 24))]
            form, kind = example(rng)
            before, behind = setting(rng) if kind == 4 else ("", "")
            text += f"{lead} {before}{form}{behind}"
            tags += [0] * (len(lead) + 1 + len(before)) + ([2 * kind + 1] + [2 * kind + 2] * (len(form) - 1) if kind >= 0 else [0] * len(form)) + [0] * len(behind)
        tail = str(rng.choice(snippets))[:WINDOW] if snippets else _word(rng)
        text, tags = f"{text} {tail}", tags + [0] * (len(tail) + 1)
        start = int(rng.integers(0, max(1, len(text) - WINDOW + 1)))
        part = encode(text[start: start + WINDOW])
        x[n, : len(part)], y[n, : len(part)] = part, tags[start: start + len(part)]
    return np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)


def train(snippets: list[str], steps: int = 400, batch: int = 96, seed: int = 0) -> Tagger:
    rng = np.random.default_rng(seed)
    tagger = initial(rng)
    x, y = training_windows(snippets, 4000, rng)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in tagger.weights.items()}
    for step in range(1, steps + 1):
        pick = rng.integers(0, x.shape[1], batch)
        _, grads = loss_and_gradients(tagger.weights, x[:, pick], y[:, pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = 0.02 * (1 - step / (steps + 1))
        for k, g in grads.items():
            g = g * min(1.0, 5 / max(norm, 1e-9))
            m, v = moment[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            tagger.weights[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return tagger


def passes(kind: int, text: str) -> bool:
    """What a span added by the network must hold."""
    if kind == 0:
        return bool(re.search(r"@|\b(?i:at)\b", text)) and bool(re.search(r"[.]|\b(?i:dot)\b", text))
    if kind == 4:
        return len(text) >= 16 and bool(digits(text)) and any(c.isalpha() for c in text) and not set(text) - _IN_SECRET
    number = digits(text)
    if kind == 1:
        parts = text.split(".")
        return len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 14 <= len(number) <= 19 and luhn(number)
    return 10 <= len(number) <= 15 and not set(text) - set("+0123456789 ().-") and not number == text


def tag_texts(tagger: Tagger, texts: list[str], batch: int = 2048) -> list[list[tuple[int, int, int]]]:
    """Spans (start, end, kind) of the network in each text, from overlapping windows around marks."""
    step = WINDOW // 2
    codes = [encode(text) for text in texts]
    tags = [np.zeros(len(c), np.int64) for c in codes]
    depth = [np.full(len(c), -1) for c in codes]
    wanted = set()
    for n, text in enumerate(texts):
        for m in _MARK.finditer(text):
            k = m.start() // step
            wanted.update(((n, max(0, k - 1)), (n, k)))  # both windows that hold the place
    read: set[tuple[int, int]] = set()
    while wanted:
        windows = [(n, k * step) for n, k in sorted(wanted)]
        for k in range(0, len(windows), batch):
            _decode(tagger, windows[k: k + batch], codes, tags, depth)
        read |= wanted
        further = set()
        for n, at in windows:  # spans that go on where nothing has been read
            end, k = min(at + WINDOW, len(codes[n])), at // step
            if end < len(codes[n]) and depth[n][end] < 0 and tags[n][end - _BORDER: end].any():
                further.update(((n, end // step - 1), (n, end // step)))
            if at and depth[n][at - 1] < 0 and tags[n][at: at + _BORDER].any():
                further.update(((n, k - 1), (n, max(0, k - 2))))
        wanted = further - read
    return [_spans_of(t) for t in tags]


def _decode(tagger: Tagger, windows: list[tuple[int, int]], codes: list, tags: list, depth: list) -> None:
    """Writes the best tags of the windows (text, place) into `tags` wherever they lie deeper than `depth`."""
    step = WINDOW // 2
    own_depth = np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])
    x = np.zeros((len(windows), WINDOW), np.uint8)
    for row, (n, at) in zip(x, windows):
        piece = codes[n][at: at + WINDOW]
        row[: len(piece)] = piece
    best = viterbi(tagger.weights, emissions(tagger.weights, np.ascontiguousarray(x.T))[0]).T
    for row, (n, at) in zip(best, windows):
        size = min(WINDOW, len(codes[n]) - at)
        # the text's own ends are no window edges
        deep = np.where(np.arange(size) < step, own_depth[:size] if at else WINDOW, own_depth[:size])
        deeper = deep > depth[n][at: at + size]
        tags[n][at: at + size][deeper] = row[:size][deeper]
        depth[n][at: at + size][deeper] = deep[deeper]


def _spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    kind = (tags - 1) // 2
    kind[tags == 0] = -1
    begins = (kind >= 0) & ((tags % 2 == 1) | (kind != np.append(-1, kind[:-1])))
    out = []
    for a in np.flatnonzero(begins).tolist():
        b = a + 1
        while b < len(tags) and kind[b] == kind[a] and not begins[b]:
            b += 1
        out.append((a, b, int(kind[a])))
    return out


def all_spans(tagger: Tagger | None, texts: list[str]) -> list[tuple[list, list]]:
    """For each text its pattern spans, and those with what the network adds."""
    base = [base_spans(t) for t in texts]
    added = tag_texts(tagger, texts) if tagger else [[] for _ in texts]
    out = []
    for text, own, more in zip(texts, base, added):
        spans = list(own)
        for a, b, k in more:
            piece = text[a:b]
            a, b = a + len(piece) - len(piece.lstrip()), b - (len(piece) - len(piece.rstrip()))
            if k == 0:
                a, b = _whole_address(text, a, b)
            if k == 4:
                a, b = _whole_word(text, a, b)
                if not _SET_TO.search(text, max(0, a - 8), a):
                    continue
            whole = k == 4 or not (text[a - 1: a].isdigit() and a) and not text[b: b + 1].isdigit()
            if a < b and whole and passes(k, text[a:b]) and all(b <= s or e <= a for s, e, _ in spans):
                spans.append((a, b, k))
        out.append((own, sorted(spans, key=lambda s: (s[0], s[2]))))
    return out


def _whole_address(text: str, a: int, b: int) -> tuple[int, int]:
    """The written address that text[a:b] is a part of, or a, b: a local part has 64 characters at most, a domain 255."""
    for m in _WRITTEN.finditer(text, max(0, a - 64), b + 255):
        if m.start() < b and a < m.end():
            return m.span()
    return a, b


def _whole_word(text: str, a: int, b: int) -> tuple[int, int]:
    """The word of a secret's characters that holds the middle of text[a:b]; empty where that is another character."""
    a = b = (a + b) // 2
    while a and text[a - 1] in _IN_SECRET:
        a -= 1
    while b < len(text) and text[b] in _IN_SECRET:
        b += 1
    return a, b


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span, overlapping ones merged, replaced by its first kind in brackets."""
    out, free = [], 0
    for a, b, k in spans:
        if a >= free:
            out += [text[free:a], f"[{ALL_KINDS[k].upper()}]"]
        free = max(free, b)
    return "".join(out) + text[free:]


def fit(docs: DataFrame, snippets: int = SNIPPETS) -> Tagger:
    """A tagger trained around about `snippets` places of the corpus, chosen by a hash of the text."""
    total = docs.filter("length(text) > 20").count()
    draw = F.pmod(F.xxhash64(F.lit("pii"), "text"), F.lit(1 << 30))
    some = docs.filter("length(text) > 20").filter(draw < int(min(1.0, snippets / max(1, total)) * (1 << 30)))
    room = F.greatest(F.length("text") - 80, F.lit(1))
    rows = some.select(F.substring(F.col("text"), (F.pmod(F.xxhash64("text"), room) + 1).cast("int"), F.lit(80)).alias("s")).collect()
    return train(sorted(t for t in (re.sub(r"[0-9@+\n]", "", r["s"]) for r in rows) if t))


def scan(docs: DataFrame, tagger: Tagger | None, keep: list[str] | None = None, redact: bool = False) -> DataFrame:
    """Per row of `docs` (doc_id, text): the columns `keep` (doc_id), n_email, n_ip, n_card, n_phone, base_sha256, spans,
    and with `redact` the text with its spans replaced.

    Counts and digest are of the pattern spans, spans lists all, secrets too. Places are code points, ends exclusive. Null and empty
    texts have none (a redacted null stays null); repeated rows agree; a null doc_id stays null; an empty table gives no
    rows. Names in `keep` must not be those of the columns added: rows with any names travel as one struct. Texts without a
    digit or at sign do not reach Python, or are passed on as they are with `redact`.
    """
    ship(docs.sparkSession)
    keep = keep or ["doc_id"]
    marked = F.coalesce(F.col("text").rlike(MARK), F.lit(False))
    sent = F.col("text") if redact else F.when(marked, F.col("text"))
    rows = docs.select(sent.alias("_text"), marked.alias("_marked"), *keep)
    names = [f"n_{k}" for k in KINDS] + ["base_sha256", "spans"] + (["text"] if redact else [])
    types = [T.LongType()] * 4 + [T.StringType()] * (3 if redact else 2)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(n, t) for n, t in zip(names, types)])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in slices(batch.column(0)):
                part = batch.slice(first, last - first)
                texts, wanted = part.column(0).to_pylist(), part.column(1).to_pylist()
                some = [n for n, t in enumerate(texts) if t and wanted[n]]
                found = dict(zip(some, all_spans(tagger, [texts[n] for n in some])))
                own = [found.get(n, ([], [])) for n in range(len(texts))]
                counts = [pa.array([sum(s[2] == k for s in base) for base, _ in own], pa.int64()) for k in range(4)]
                shas = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in own]
                columns = [*part.columns[2:], *counts, pa.array(shas), pa.array([joined(s) for _, s in own])]
                if redact:
                    columns.append(pa.array([w if not s else redacted(w, s) for w, (_, s) in zip(texts, own)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [*keep, *names])
        release()

    return rows.mapInArrow(find, schema)
