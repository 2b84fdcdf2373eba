"""Personal data: patterns against the plain regular expressions, the network's gradient, and what it adds."""

import hashlib
import random
import re

import numpy as np
import pytest

from panelloom.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    out = []
    for k, kind in enumerate(pii.KINDS):
        for m in re.finditer(PATTERNS[kind], text):
            number = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "phone": 10 <= len(number) <= 15,
                  "card": 14 <= len(number) <= 19 and sum(sum(map(int, str(int(c) * (1 + i % 2)))) for i, c in enumerate(number[::-1])) % 10 == 0}
            if ok[kind]:
                out.append((*m.span(), k))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_patterns_on_random_strings():
    rng = random.Random(1)
    parts = ["a", "b.c", "@", "@x.de", ".", "..", " ", "-", "+", "1", "25", "255.", "256", "4539 1488 0343 6467", "é", "+49 (30) 1234-5678",
             "1.2.3.4", "(", ")", "79927398713", "%", "_", "\n", "0000", "@@", "x@y", "001.02.3.255"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        assert pii.base_spans(text) == plain(text), text


def test_patterns_take_linear_time():
    for text in ("9" * 200_000, "1." * 100_000, "a" * 200_000 + "@", "+1" * 50_000, "@a." * 50_000):
        pii.base_spans(text)


def test_gradients_are_numeric_slopes():
    rng = np.random.default_rng(5)
    w = {k: v.astype(np.float64) for k, v in pii.initial(rng, 4).weights.items()}
    x, y = (v[:9] for v in pii.training_windows([], 3, rng))
    _, grads = pii.loss_and_gradients(w, x, y)
    for name in w:
        for _ in range(5):
            at = tuple(int(rng.integers(0, n)) for n in w[name].shape)
            at = (at[0], int(x[3, 1])) if name[0] == "W" else at
            old = w[name][at]
            w[name][at] = old + 1e-5
            up = pii.loss_and_gradients(w, x, y)[0]
            w[name][at] = old - 1e-5
            down = pii.loss_and_gradients(w, x, y)[0]
            w[name][at] = old
            assert (up - down) / 2e-5 == pytest.approx(grads[name][at], abs=1e-4)


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(2)
    w, e = {"A": rng.normal(size=(9, 9)), "S": rng.normal(size=9)}, rng.normal(size=(3, 9, 2))
    best = pii.viterbi(w, e)
    for b in range(2):
        paths = {(i, j, k): w["S"][i] + e[0, i, b] + w["A"][i, j] + e[1, j, b] + w["A"][j, k] + e[2, k, b]
                 for i in range(9) for j in range(9) for k in range(9)}
        assert tuple(best[:, b]) == max(paths, key=paths.get)


@pytest.fixture(scope="module")
def tagger():
    rng = random.Random(0)
    snippets = [" ".join("".join(rng.choice("aeinrst") for _ in range(rng.randint(2, 9))) for _ in range(12)) for _ in range(200)]
    return pii.train(snippets), snippets


def test_held_out_tags(tagger):
    model, snippets = tagger
    x, y = pii.training_windows(snippets, 500, np.random.default_rng(77))
    tags = pii.viterbi(model.weights, pii.emissions(model.weights, x)[0])
    assert (tags == y).mean() > 0.95 and (tags == y)[y > 0].mean() > 0.85


def test_overlapping_windows_agree_on_places(tagger):
    model, _ = tagger
    form = "(415) 555-2671"
    found = 0
    for lead in range(1, 130, 3):
        text = "in the " * 30
        text = text[:lead] + " " + form + " " + text
        found += (lead + 1, lead + 1 + len(form), 3) in pii.all_spans(model, [text])[0][1]
    assert found >= 35  # of 43


def test_secrets_are_whole_words_that_something_is_set_to(tagger):
    model, _ = tagger
    rng = random.Random(4)
    found = wrong = 0
    for n in range(60):
        value = "".join(rng.choice("0123456789abcdef") for _ in range((32, 40, 64)[n % 3]))
        lead = "in the tern rest " * (n % 5) + "at " * (n % 7)
        text = f'{lead}{("token", "api_key", "secret")[n % 3]} = "{value}" and rest'
        a = text.index(value)
        spans = pii.all_spans(model, [text])[0][1]
        found += (a, a + len(value), 4) in spans
        wrong += any(k == 4 and (s, e) != (a, a + len(value)) for s, e, k in spans)
        wrong += any(k == 4 for _, _, k in pii.all_spans(model, [f"{lead}rest {value} in the tern"])[0][1])
    assert found >= 54 and wrong == 0


def test_spans_are_followed_into_windows_without_a_mark(tagger):
    model, _ = tagger
    texts = [f"{'rest in ' * n}anna.stern [at] {'ternstri' * 6} [dot] com rest in tern" for n in range(12)]
    texts += [f"{'rest in ' * n}ANNA.STERN AT TERNSTRIN DOT COM rest in tern" for n in range(12)]
    spans = [[t[a:b].lower() for a, b, k in own if k == 0] for t, (_, own) in zip(texts, pii.all_spans(model, texts))]
    whole = [len(x) == 1 and x[0].startswith("anna.stern") and x[0].endswith("com") for x in spans]
    assert sum(whole[:12]) >= 8 and sum(whole) >= 18


def test_a_word_of_any_length_is_followed_to_its_end():
    class Always:  # says that every character lies in a secret
        weights = pii.initial(np.random.default_rng(0)).weights
    Always.weights["S"][:] = -100
    Always.weights["S"][9] = 100
    Always.weights["A"][:] = -100
    Always.weights["A"][9:, 10] = 100
    text = "1" + "x" * 500
    assert pii.tag_texts(Always, [text])[0][-1][1] == len(text)
    assert pii.tag_texts(Always, ["x" * 300 + "1", "", "x"])[0][0][0] == 0


def test_scan(spark, tagger):
    model, _ = tagger
    texts = ["mail a.b@c.de and 1.2.3.4", None, "", "clean words only", "é é +49 (30) 1234-5678", "x " * 60_000 + "4539 1488 0343 6467",
             "1.2.3.400 and 4539 1488 0343 6468 at 2020-10-11", "mail a.b@c.de and 1.2.3.4"]
    rows = [(i if i != 3 else None, t, "no") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(3)
    got = pii.scan(docs, model, redact=True).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, t, _ in rows:
        base = plain(t or "")
        assert [by[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == n for s in base) for n in range(4)]
        assert by[i]["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert set(pii.joined(base).split(",")) - {""} <= set(by[i]["spans"].split(","))
    assert by[0]["text"] == "mail [EMAIL] and [IP]" and by[1]["text"] is None and by[2]["text"] == ""
    assert by[6]["spans"] == "" and by[None]["text"] == "clean words only"
    assert by[5]["text"].endswith("x [CARD]")
    assert pii.scan(docs.limit(0), model).count() == 0
