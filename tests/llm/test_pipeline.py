"""Every stage of the pipeline against plain versions, with planted cases."""

import os
import random
import re

import pytest

import corpus_pipeline
from panelloom.llm import decontaminate, langid, pii, simhash
from panelloom.llm.tokens import encoder

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def groups_by_all_pairs(rows):
    """Row numbers by component: fingerprints of whole texts, links up to four differing bits."""
    fps = [simhash.fingerprint((text or "").encode()) for text in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= simhash.DISTANCE:
                parent[top(i)] = top(j)
    found = {}
    for i in range(len(rows)):
        found.setdefault(top(i), []).append(i)
    return list(found.values())


@pytest.fixture(scope="module")
def words():
    rng = random.Random(1)
    return ["".join(rng.choice("aeioustrnlm") for _ in range(rng.randint(2, 9))) for _ in range(900)]


def test_one_of_each_against_all_pairs(spark, words):
    rng = random.Random(8)
    texts = [None, "", "  ", "one two", "ONE two", "one two three four five six"]
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(60, 300))]
        texts.append(" ".join(base))
        for change in rng.sample([1, 1, 1, 2, 6, 20], 2):
            near = base[:]
            for _ in range(change):
                near[rng.randrange(len(near))] = rng.choice(words)
            texts.append(" ".join(near))
    texts += [texts[9]] * 40
    rows = [(None if i in (12, 150) else i, t, "en", "s", 1, 2.0, "x") for i, t in enumerate(texts)]
    rows += [rows[20], rows[12], (7, "a text of its own under a known id", None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA + ", _row double, component_id string").repartition(4)
    groups = groups_by_all_pairs([r[1] for r in rows])
    assert sum(len(g) > 1 for g in groups) > 20
    got = simhash.one_of_each(docs)
    assert got.dtypes == docs.dtypes
    want = [min(((rows[i][0] is None, rows[i][0] or 0), i) for i in g)[1] for g in groups]
    key = lambda r: (r[0], r[1])
    assert sorted(map(repr, (key(rows[i]) for i in want))) == sorted(map(repr, (key(r) for r in got.collect())))
    assert simhash.one_of_each(docs.limit(0)).count() == 0


CLASHING = ["score", "lang_pred", "position_share", "_lettered", "spans", "n_email", "n_ip", "base_sha256", "_text", "_marked", "_whole", "row", "_row", "_digest", "fp",
            "component_id", "item_id", "start", "length", "_id", "_part", "_number", "sequence_id", "offset", "count", "window", "s"]


def test_stages_keep_columns_with_clashing_names(spark, words):
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice(words) for _ in range(40))
    rows = [(i, text() + (" a.b@c.org" if i % 2 else ""), "en", "s", 1, *[float(100 * i + k) for k in range(len(CLASHING))]) for i in range(6)]
    docs = spark.createDataFrame(rows + rows[:1], SCHEMA + "".join(f", `{c}` double" for c in CLASHING))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.dtypes == docs.dtypes
        held = {r["doc_id"]: tuple(r[c] for c in CLASHING) for r in got.collect()}
        assert held == {r[0]: r[5:] for r in rows}
        assert got.count() == (6 if name == "simhash_near_dedup" else 7)  # a repeated row stays everywhere else
    assert corpus_pipeline.packed(spark, docs, SF).agg({"length": "sum"}).first()[0] > 7 * 40


def test_every_label_is_learned(spark, monkeypatch):
    rows = [(i, "some words of text", f"l{i % 90}", "s", 1) for i in range(900)]
    docs = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(langid, "SAMPLE_TOTAL", 450)
    sample = langid.training_windows(docs, windows=1)
    assert len({lang for lang, _ in sample}) > 80 and len(sample) < 700
    monkeypatch.setattr(langid, "LANGUAGES", 80)
    with pytest.raises(ValueError, match="more than 80"):
        langid.training_windows(docs)


def test_stages_on_odd_rows(spark, words):
    rng = random.Random(3)

    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))

    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    rows = [(1, text(50), "en", "s", 1), (None, text(40), None, None, None), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (5, "123 !!", "de", "s", 6),
            (6, text(30) + " " + item + " " + text(30), "en", "s", 1), (7, f"{text(20)} a.b@c.org {text(20)}", "en", "t", 3), (8, text(60_000), "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = corpus_pipeline.identified(spark, docs, SF)
    assert kept.schema.names == docs.schema.names
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 6, 7, 8]
    assert {r["doc_id"]: r["lang"] for r in kept.collect()}[None] in ("en", "de")
    clean = corpus_pipeline.decontaminated(spark, kept, SF)
    assert sorted((r["doc_id"] or -1) for r in clean.collect()) == [-1, 1, 7, 8]
    safe = {r["doc_id"]: r for r in corpus_pipeline.redacted(spark, clean, SF).collect()}
    assert "[EMAIL]" in safe[7]["text"] and safe[7]["n_chars"] == len(safe[7]["text"])
    assert safe[8]["text"] == rows[-1][1] and safe[None]["n_chars"] is None
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    read = sorted(r["doc_id"] for r in corpus_pipeline.identified(spark, docs, SF).collect())
    assert all(re.search(r"[^\W\d_]", texts[i]) for i in read) and len(read) > 0.9 * len(texts)
    single = {min(read[i] for i in g) for g in groups_by_all_pairs([texts[i] for i in read])}
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    leaked = {r["doc_id"] for r in decontaminate.leaks(docs, benchmark).collect()}
    items = [decontaminate.plain(r["text"]) for r in benchmark.collect()]
    assert {i for i, t in texts.items() if any(x in decontaminate.plain(t) for x in items)} <= leaked
    pieces = corpus_pipeline.run(spark, SF).toPandas()
    assert set(pieces.doc_id) == single - leaked
    for _, own in pieces.groupby("doc_id"):
        i = own.doc_id.iloc[0]
        if not re.search(pii.MARK, texts[i]):
            assert own.doc_tokens.iloc[0] == own.length.sum() == len(encoder().library().encode(texts[i], add_special_tokens=False).ids) + 1
    filled = pieces.groupby("sequence_id").length.sum()
    assert (filled <= 1024).all() and len(filled) <= 1.01 * (pieces.length.sum() / 1024 + 1)
