"""The pipeline: each stage's rows against plain versions, and what it promises of columns."""

from __future__ import annotations

import pytest

import corpus_pipeline
from chronoloom.llm import toxicity
from chronoloom.llm.common import table
from ..oracle import SF_DIR
from . import brute


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before and after each stage."""
    docs = table(spark, SF_DIR, "documents")
    columns, out = docs.columns, [docs.collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, docs, SF_DIR)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert got.columns == columns and dict(got.dtypes) == dict(docs.dtypes), name
        path = str(tmp_path_factory.mktemp("stage") / name)
        got.write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "mixing", "bpe"]


def test_toxic_documents_go(spark, stages):
    labels = [(r.doc_id, r.toxic) for r in table(spark, SF_DIR, "labels").collect()]
    scores = brute.toxicity([(r.doc_id, r.text) for r in stages[0]], labels)
    kept = [r for r, x in zip(stages[0], scores) if x[0] < toxicity.THRESHOLD]
    assert sorted(map(str, stages[1])) == sorted(map(str, kept)) and len(kept) < len(stages[0])


def test_repeated_lines_go(stages):
    texts = brute.line_dedup([(r.doc_id, r.text) for r in stages[1]])
    assert sorted((r.doc_id, r.text, r.n_chars) for r in stages[2]) == sorted((r.doc_id, t, len(t)) for r, t in zip(stages[1], texts))


def test_near_copies_go(stages):
    gone = brute.keep_first([(r.doc_id, r.text) for r in stages[2]])
    assert sorted(map(str, stages[3])) == sorted(str(r) for r in stages[2] if r.doc_id not in gone)
    assert gone


def test_mixture(spark, stages):
    quality = {}
    for r in table(spark, SF_DIR, "labels").collect():
        quality[r.doc_id] = max(r.quality, quality.get(r.doc_id, 0))
    taken = brute.mixture([(r.doc_id, r.source, r.text) for r in stages[3]], quality)
    by = {r.doc_id: r for r in stages[3]}
    assert sorted(map(str, stages[4])) == sorted(str(by[t[0]]) for t in taken)


def test_encoded(stages):
    other = brute.encoding()
    texts = sorted((r.doc_id, r.text) for r in stages[4])
    got = sorted(stages[5], key=lambda r: r.doc_id)
    assert [(r.doc_id, r.ids, r.exact) for r in got] == [(d, other.encode_ordinary(t), True) for d, t in texts]


def test_run_gives_the_same(spark, stages):
    got = corpus_pipeline.run(spark, SF_DIR).collect()
    assert sorted(map(str, got)) == sorted(map(str, stages[5]))


def test_stages_with_odd_rows(spark, tmp_path):
    """Nulls in every column, empty, blank and very long texts, repeated rows, extra columns with clashing names."""
    from . import messy

    messy.labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    docs = messy.clashing(messy.docs(spark))
    n = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, docs, str(tmp_path))
        if name != "bpe":
            assert got.columns == docs.columns, name
        got.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name in ("toxicity", "line_dedup"):
            assert docs.count() == n
    ids = {r.doc_id for r in docs.collect()}
    # 8 is longer than what its source may give
    assert 5 not in ids and 4 not in ids and {1, 6, 14} <= ids


def test_no_rows(spark, tmp_path):
    from . import messy

    messy.labels(spark, []).write.parquet(str(tmp_path / "labels.parquet"))
    messy.docs(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
