"""Measures of whole texts against brute force."""

from __future__ import annotations

import math

import pytest

from chronoloom.operators import findings, text
from chronoloom.plans import queries as plans

from .oracle import SF_DIR


def entropy(t):
    return sum(-t.count(c) / len(t) * math.log2(t.count(c) / len(t)) for c in set(t))


def test_entropy_of_whole_texts(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    got = {r.doc_id: r.entropy for r in plans.QUERIES["document_entropy"](spark, SF_DIR).collect()}
    assert got == {d: pytest.approx(entropy(t)) if t is not None else None for d, t in docs.items()}


def test_entropy_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "aaaa"), (None, "ab"), (5, "漢\U0001f600" * 30_000 + "\n")]
    got = {r.doc_id: r.entropy for r in text.text_entropy(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1], got[2], got[3], got[None]) == (None, 0.0, 0.0, 1.0) and got[5] == pytest.approx(entropy(rows[4][1]))


def test_clean_code_is_measured_once(spark):
    """The findings' plan holds the measures once, not in every use of them."""
    files = spark.createDataFrame([("a.py", "x = 77\n" * 40), ("b.py", None), ("c.py", "")], "path string, content string").repartition(2)
    got = findings.classify_clean_code(text.clean_code(files))
    assert [(r.subject, r.value_num) for r in got.collect()] == [("a.py", 2.0)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
