"""Quality counts against plain Python, bounds against summed probabilities, and the promise on false rejections."""

import math
import random
import re

import numpy as np
import pytest

from panelloom.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i: i + 8]) for i in range(len(words) - 7)]
    repeated = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            repeated |= set(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(repeated))


def test_counts_of_odd_texts():
    rng = random.Random(3)
    texts = ["", None, " \n\t", "a b c d e f g h", "a b c d e f g h i " * 3, "x\x0by\x0cz\x1cw é",
             "line one\nline one\n\n \nline two\r\nline two\r\n", "ab " * 40]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 60))) + "#|é" for _ in range(60)]
    for text in texts:
        assert quality.measures((text or "").encode()) == plain(text), text


@pytest.mark.parametrize("k,n,delta", [(0, 10, .05), (3, 50, .01), (12, 400, .001), (5, 5, .05)])
def test_bound_is_exact(k, n, delta):
    p = quality.upper_bound(k, n, delta)
    if k == n:
        assert p == 1
        return
    tail = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    assert tail == pytest.approx(delta, rel=1e-6)


def place(rule, step):
    return tuple(step if r == rule else 0 for r in quality.RULES)


def draw(rng, good_rates, n_good, n_bad=100):
    """Both halves of a stratum: good documents reach the given states at the given rates, bad ones every state."""
    out = {}
    for half in (False, True):
        n = rng.multinomial(n_good, [*good_rates.values(), 1 - sum(good_rates.values())])
        good = dict(zip([*good_rates, (0,) * len(quality.RULES)], map(int, n), strict=True))
        bad = dict.fromkeys(good_rates, n_bad // len(good_rates))
        out["s", half, True], out["s", half, False] = good, bad
    return out


def true_rate(rates, state):
    return sum(p for steps, p in rates.items() if any(0 < s <= x for s, x in zip(state, steps, strict=True)))


@pytest.mark.parametrize("rates", [
    {place("duplicate_lines", 2): 0.004, place("duplicate_lines", 1): 0.016},
    # each rule stays within the risk alone, the two together do not
    {place("duplicate_lines", 1): 0.007, place("symbols_per_word", 1): 0.007},
])
def test_false_rejections_of_all_rules_together_stay_within_the_risk(rates):
    rng, wrong, some = np.random.default_rng(1), 0, 0
    for _ in range(200):
        found = quality.choose(draw(rng, rates, 2000), 0.01, 0.05)
        wrong += bool(found) and true_rate(rates, found["s"]) > 0.01
        some += bool(found)
    assert wrong <= 20
    assert some or 0.007 not in rates.values()


def test_chain_takes_the_cheapest_rule_first_and_leaves_what_is_not_worth_it():
    a, b, c = place("duplicate_lines", 3), place("symbols_per_word", 1), place("chars_per_word", 2)
    none = (0,) * len(quality.RULES)
    links = quality.chain({none: 990, a: 1, c: 9}, {a: 50, b: 30, c: 15, none: 5})
    assert links == [b, tuple(map(max, b, place("duplicate_lines", 1))) ]
    assert quality.chain({none: 5}, {}) == quality.chain({}, {a: 3}) == quality.chain({none: 5}, {none: 5}) == []


def test_holm_passes_the_level_of_a_finished_chain_on():
    """160 good holdout documents certify 2 % at 5 %, not at half of that: only after the other stratum has ended."""
    none, b = (0,) * len(quality.RULES), place("symbols_per_word", 1)

    def stratum(name, n):
        return {(name, False, True): {none: n}, (name, False, False): {b: 9}, (name, True, True): {none: n}, (name, True, False): {b: 9}}

    assert 0.98**160 <= 0.05 and 0.98**160 > 0.025
    assert quality.choose(stratum("big", 500) | stratum("small", 160), 0.02, 0.05) == {"big": b, "small": b}
    assert quality.choose(stratum("other", 160) | stratum("small", 160), 0.02, 0.05) == {}


def test_kept_documents(spark):
    rng = random.Random(5)
    words = ["w%d" % i for i in range(500)]
    rows, labels = [], []
    for i in range(2400):
        bad = i % 8 == 0
        text = " ".join(rng.choice(words) + ("###" if bad else "") for _ in range(40))
        rows.append((i, text, "en" if i % 3 else None, 1))
        if i % 6 < 5:
            labels.append((i, 0 if bad else 1, 0))
    labels += [(1, 0, 0), (None, 1, 1), (5, None, 0), (2, 1, 0)]
    rows += [(None, None, "en", 1), (9001, "", None, 1), (1, rows[1][1], "en", 1), (9002, "## " * 30, "xx", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int").repartition(4)
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.quality_rules(docs, labelled, risk=0.02).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] < 2400:
            assert r["kept"] == (r["doc_id"] % 8 != 0), r
        elif r["doc_id"] == 9002:
            assert r["base_failed"] and not r["kept"]  # thirty equal words
        else:
            assert r["n_words"] == 0 and r["base_failed"] and not r["kept"]
    unlabelled = quality.quality_rules(docs, labelled.limit(0)).filter("kept = base_failed").count()
    assert unlabelled == 0
    assert quality.quality_rules(docs.limit(0), labelled).count() == 0
