"""The registered queries of the text operators: their columns on the smallest tables, and their SQL."""

import os

import oracle
import pytest

from panelloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")

COLUMNS = {
    "op1_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op2_langid": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op3_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op4_quality": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op5_decontaminate": "doc_id bigint, item_id bigint, distance bigint, start bigint, end bigint",
    "op6_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op7_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op8_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op9_licenses": "doc_id bigint, licenses string, rules string, sentences string, n_sentences bigint",
    "op10_repeats": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op11_exact": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op12_clustering": "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    "op13_repair": "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string",
}


@pytest.mark.parametrize("name", list(QUERIES))
def test_columns(spark, name):
    types = dict(QUERIES[name](spark, SF).dtypes)
    for column, kind in (c.split() for c in COLUMNS[name].split(", ")):
        assert types[column] == kind


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_sql(spark, name):
    assert oracle.difference(QUERIES[name](spark, SF), oracle.connect(SF), ORACLE_SQL[name]) is None
