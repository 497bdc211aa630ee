"""The named queries over whole test tables: against SQL where there is a counterpart, else their contract."""

import os
import zlib

import pytest

import __spark_entry__ as entry_points
from cohortlib.llm import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "conversations", "labels", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str(tuple(round(r[i], 5) if isinstance(r[i], float) else r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.all_sql()))
def test_against_sql(spark, con, name):
    got = queries.all_queries()[name](spark, DATA)
    want = con.execute(queries.all_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert table(got.columns, map(tuple, got.collect())) == table(columns, want.fetchall())


def test_one_query_for_each_operator():
    names = entry_points.queries()
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names


COLUMNS = {
    "op1_fingerprints": {"n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op2_byte_bpe": {"n_tokens", "ids_sha256", "decoded_sha256"},
    "op3_ppm": {"held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op4_simhash": {"fingerprint", "component_id"},
    "op5_host_rules": {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op6_mixing": {"size", "source_size", "target", "taken"},
    "op8_ordinal": {"expected_grade", "p_good", "kept"},
    "op9_language_id": {"held_out", "lang_pred", "score"},
    "op10_paragraphs": {"text", "n_removed"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_one_row_for_each_document(spark, con, name):
    got = queries.all_queries()[name](spark, DATA)
    assert COLUMNS[name] <= set(got.columns)
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(x for x, in con.execute("SELECT doc_id FROM documents").fetchall())


def test_languages_of_held_out_documents(spark, con):
    want = dict(con.execute("SELECT doc_id, lang FROM documents").fetchall())
    held = [r for r in queries.op9_language_id(spark, DATA).collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(r.held_out for r in held) and sum(r.lang_pred == want[r.doc_id] for r in held) / len(held) > 0.95
