"""Near-dedup drops documents, not ids: repeated and null ids lose no clean document and keep no near copy."""

import pytest

pytest.importorskip("interlace.llm.queries")

from interlace.llm import minhash  # noqa: E402

BASE = " ".join(f"word{i}" for i in range(60))
NEAR, CLEAN, OTHER = BASE + " more", " ".join(f"clean{i}" for i in range(40)), " ".join(f"other{i}" for i in range(40))


def kept(spark, rows):
    return sorted(((r.doc_id, r.text, r.key) for r in minhash.one_of_each(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, key string")).collect()), key=str)


def test_a_near_copy_takes_no_other_document_of_its_id(spark):
    assert kept(spark, [(3, BASE), (5, NEAR), (5, CLEAN)]) == [(3, BASE, "x"), (5, CLEAN, "x")]


def test_a_null_id_takes_no_other_null_id(spark):
    rows = [(3, BASE), (None, NEAR), (None, CLEAN), (None, OTHER), (None, None), (None, "")]
    assert kept(spark, rows) == sorted([(d, t, "x") for d, t in rows if t != NEAR], key=str)


def test_one_row_of_a_class_under_one_id(spark):
    for d in (5, None):
        got = kept(spark, [(d, BASE), (d, NEAR), (d, BASE), (7, CLEAN)])
        assert len(got) == 2 and (7, CLEAN, "x") in got
