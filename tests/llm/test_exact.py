"""Exact duplicates against plain grouping, over files written one after the other."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from panelloom.llm import common, exact

SCHEMA = "doc_id long, text string, digest int, file string, `_metadata` string"


def plain(rows):
    """{row number: (keep row number, group size, sha)} by the rule itself."""
    groups = {}
    for k, (doc_id, text) in enumerate(rows):
        groups.setdefault(re.sub(r"[ \t-\r]+", " ", text or ""), []).append(((doc_id is None, doc_id or 0), k))
    return {k: (min(own)[0], len(own), hashlib.sha256(t.encode()).hexdigest()) for t, own in groups.items() for _, k in own}


ROWS = [(7, "a b"), (3, "a \t\n b"), (9, "a b"), (5, None), (4, ""), (6, " "), (8, "\n\r"), (None, "a b"), (None, "lonely"), (1, "x" * 3_000_000),
        (2, "x" * 3_000_000), (10, "x" * 2_999_999 + "y"), (11, "Ab"), (12, "ab"), (13, "ab "), (14, "same"), (14, "same"), (15, "é"), (16, "é")]
ROWS += [(100 + i, "copied text") for i in range(60)] + [(200 + i, f"text {i % 20}") for i in range(40)]


def written(spark, path, rows, mode="overwrite"):
    frame = spark.createDataFrame([(i, t, 1, "f", "m") for i, t in rows], SCHEMA)
    frame.repartition(3).write.mode(mode).parquet(path)


def compare(got, rows):
    want = plain(rows)
    expected = [(rows[k][0], None if least[0] else least[1], size, sha) for k, (least, size, sha) in want.items()]
    found = [(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert sum(r["kept"] for r in got) == len({sha for _, _, sha in want.values()})
    assert all(r["keep_id"] == r["doc_id"] for r in got if r["kept"])


@pytest.mark.parametrize("heavy", [1024, 10])
def test_groups_equal_plain_grouping(spark, tmp_path, monkeypatch, heavy):
    monkeypatch.setattr(common, "HEAVY_SHARE", heavy)
    path = str(tmp_path / "documents.parquet")
    written(spark, path, ROWS)
    compare(exact.exact_duplicates(spark, path).collect(), ROWS)


@pytest.mark.parametrize("bits", [1, 0])
def test_a_digest_that_collides_loses_nothing(spark, tmp_path, bits):
    """Two values of the digest, and one: all texts meet, and only their bytes tell them apart."""
    path = str(tmp_path / "documents.parquet")
    written(spark, path, ROWS)
    weak = lambda text: F.unhex(F.lpad(F.conv(F.substring(F.sha2(text, 256), 1, 1), 16, 2), 4, "0").substr(1, bits + 1) if bits else F.lit("00"))
    compare(exact.exact_duplicates(spark, path, digest=weak).collect(), ROWS)


def test_state_goes_on_with_new_files_only(spark, tmp_path):
    path, state = str(tmp_path / "documents.parquet"), str(tmp_path / "state")
    written(spark, path, ROWS[20:])
    compare(exact.exact_duplicates(spark, path, state, trigger_bytes=1).collect(), ROWS[20:])  # a trigger for each file
    first = {r["digest"]: r["n"] for r in exact.remembered(spark, state).collect()}
    exact.remember(spark, path, state)
    assert first == {r["digest"]: r["n"] for r in exact.remembered(spark, state).collect()}
    written(spark, path, ROWS[:20], "append")  # a smaller doc_id may come late
    compare(exact.exact_duplicates(spark, path, state).collect(), ROWS)
    places = exact.remembered(spark, state).filter("keep_row IS NULL OR keep_file IS NULL").count()
    assert places == 0


def test_one_file_and_no_rows(spark, tmp_path):
    path = str(tmp_path / "folder")
    spark.createDataFrame(ROWS, "doc_id long, text string").coalesce(1).write.parquet(path)
    one, = [str(p) for p in (tmp_path / "folder").glob("part-*.parquet")]
    compare(exact.exact_duplicates(spark, one).collect(), ROWS)
    none = str(tmp_path / "none.parquet")
    written(spark, none, [])
    assert exact.exact_duplicates(spark, none).count() == 0


def test_no_python_in_the_plan_and_settings_restored(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    written(spark, path, ROWS)
    found = exact.exact_duplicates(spark, path)
    plan = found._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert spark.conf.get(exact._STATE + ".rocksdb.boundedMemoryUsage", None) in (None, "false")
