"""Licence rules on whole licence texts, notices, wrapped and decorated lines."""

import random
import textwrap

import duckdb
import pyarrow as pa

from panelloom.llm import licenses

S = licenses.SENTENCES


def text_of(ids, width=60, prefix=""):
    paragraphs = [textwrap.fill(S[i] + ("" if S[i].endswith(":") else "."), width) for i in ids]
    return "\n\n".join("\n".join(prefix + line for line in p.split("\n")) for p in paragraphs)


def test_every_sentence_has_a_trigger_and_a_rule():
    for s in S.values():
        assert any(t in s.lower() for t in licenses.TRIGGERS), s
    assert {i for _, ids in licenses.RULES for i in ids} == set(S)
    assert len({licenses.normalised(s) for s in S.values()}) == len(S)


def test_scan(spark):
    mit, bsd2, bsd3 = (next(ids for _, ids in licenses.RULES if len(ids) == n and ids[0].startswith(p))
                       for n, p in ((4, "mit"), (4, "bsd"), (5, "bsd")))
    cases = [
        (1, "words\nReleased under the MIT License.", "MIT"),
        (2, "no full stop\nLicensed under CC BY-NC 4.0.\nmore", "CC-BY-NC-4.0"),
        (3, None, ""), (4, "", ""), (5, "a licensed thing with copyright and no rule", ""),
        (6, "Copyright 2020 me\n\n" + text_of(mit), "MIT"),
        (7, text_of(bsd2), "BSD-2-Clause"), (8, text_of(bsd3), "BSD-3-Clause"),
        (9, text_of(bsd3, 50, " * "), "BSD-3-Clause"),
        (10, text_of(mit[:3]), ""), (11, text_of(mit[::-1]), ""),
        (12, "// SPDX-License-Identifier: Apache-2.0\ncode();\nAll rights reserved.", "Apache-2.0,all-rights-reserved"),
        (13, "x. " * 50_000 + "licensed under the apache license version 2.0! Y", "Apache-2.0"),
        (None, "Is it? All rights reserved!", "all-rights-reserved"),
        (1, "words\nReleased under the MIT License.", "MIT"),
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in cases], "doc_id long, text string, licenses string")
    got = licenses.scan(docs).collect()
    assert sorted(((r["doc_id"] or -1, r["licenses"]) for r in got)) == sorted((i or -1, want) for i, _, want in cases)
    assert {r["doc_id"]: r["sentences"] for r in got}[8] == " ".join(bsd3)
    assert licenses.scan(docs.limit(0)).count() == 0


def test_no_shuffle_and_no_python(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Arrow" not in plan and "Python" not in plan


def test_every_rule_plain_and_in_comments(spark):
    rows, want = [], {}
    for name, ids in licenses.RULES:
        for prefix in ("", "# ", " * ", "// ", "dnl ", "-- "):
            for gap in ("blank", "none", "list"):
                lines = []
                for n, i in enumerate(ids):
                    lines += textwrap.wrap((f"{n}. " if gap == "list" and n else "") + S[i] + ("" if S[i][-1] == ":" or i == "apache.copy" else "."), 70)
                    lines += [""] if gap == "blank" and n + 1 < len(ids) else []
                    lines += ["    https://www.example.org/LICENSE-2.0"] if i == "apache.copy" else []
                rows.append((len(rows), "\n".join((prefix + line).rstrip() if not line else prefix + line for line in lines)))
                want[rows[-1][0]] = name
    rows += [(len(rows), "# " + S["mpl.grant"].replace("Public ", "Public\n# ") + ". If a copy\n# of the MPL was not distributed")]
    want[rows[-1][0]] = "MPL-2.0"
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: (got[i], want[i], rows[i][1]) for i in got if want[i] not in got[i].split(",")} == {}


def test_sql_cuts_alike(spark):
    """Known sentences glued by every kind of boundary, comment mark, list mark and odd character, against the SQL."""
    rng = random.Random(11)
    glue = [". ", ".\n", "\n", "\n\n", "\n \n", "\n# \n# ", "\n * ", ": \n", ":\n1. ", "\n(b) ", "\n2.\t", "\n\n  https://e.org/x ", " http://e.org ", "! ",
            "?\r\n", "\r", "\f", " */\n", ": */\n", ":-->\n", "\ndnl ", "\n@rem ", "\r\nREM ", " v. ", "\nv. ", ",V! ", "(v.", "\x01", "1\x02 ", "\x05\n",
            "\n\n\n", "\u2028dnl ", "\u00e9 ", "..."]
    sentences = [*S.values(), "words", "v. 2", "x", ""]
    texts = []
    for _ in range(1200):
        own = rng.choice(licenses.RULES)[1]
        parts = [S[i] for i in own] if rng.random() < 0.7 else rng.choices(sentences, k=rng.randint(1, 5))
        text = "".join(p + "".join(rng.choices(glue, k=rng.randint(1, 3))) for p in parts)
        for _ in range(rng.randint(0, 3)):
            at = text.find(" ", rng.randrange(len(text) + 1))
            text = text if at < 0 else text[:at] + rng.choice(["\n", "\n# ", "\n * ", " "]) + text[at + 1:]
        texts.append(text)
    rows = [*enumerate(texts), (-1, None), (-2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in licenses.scan(docs).collect())
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [i for i, _ in rows], "text": pa.array([t for _, t in rows], pa.string())}))
    want = sorted(con.execute(licenses.oracle_sql()).fetchall())
    assert [(a, b, rows[a[0]][1]) for a, b in zip(got, want, strict=True) if a != b][:3] == []
    assert sum(bool(r[1]) for r in got) > 500
