"""Scalar expressions on values of every kind."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from chronoloom.functions import scalars as S
from chronoloom.operators import history


def each(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_paths(spark):
    assert each(spark, ["a/lib/x", "b/lib/x", "./lib/x", "/lib/x", "lib\\x", " lib/x ", "a/a/x", None], S.path_key) == ["lib/x", "lib/x", "lib/x", "lib/x", "lib/x", "lib/x", "a/x", None]
    assert each(spark, ["a/lib/x", "x", "./lib/y/z"], S.top_dir) == ["lib", "", "lib"]
    assert each(spark, ["a.b/c.py", ".env", "x", "a.tar.gz", "end."], S.extension) == [".py", "no_extension", "no_extension", ".gz", "no_extension"]
    assert each(spark, ["https://x.org/a/b.git", "b"], S.repository_name) == ["b.git", "b"]
    assert each(spark, ["a.py", "a.MD", "Makefile", ".env", "a/b.min", "x.lock", "src.v2/run"], S.is_source_file) == [True, False, True, True, False, False, True]


def test_summary_lines(spark):
    lines = [" 3 files changed, 10 insertions(+), 2 deletions(-)", " 1 file changed, 1 deletion(-)", "nothing"]
    assert [tuple(x) for x in each(spark, lines, S.tolerant_shortstat)] == [(3, 10, 2), (1, 0, 1), (0, 0, 0)]
    assert [tuple(x) for x in each(spark, lines, S.strict_shortstat)] == [(3, 10, 2), (-1, -1, -1), (-1, -1, -1)]


def test_versions(spark):
    assert [x and tuple(x) for x in each(spark, ["1.2.3", "^1.2.3", ">=0.10.2", "v3.4.5", "1.2", "1.2.3-rc", "any", None], S.semver)] == [(1, 2, 3), (1, 2, 3), (0, 10, 2), (3, 4, 5), None, None, None, None]
    pairs = [("1.0.0", "2.0.0", "major"), ("1.0.0", "1.1.0", "minor"), ("1.0.0", "1.0.1", "patch"), ("1.0.0", "1.0.0", "current"), ("2.0.0", "1.9.9", "current"), ("any", "1.0.0", "unknown"), ("1.0.0", None, "unknown")]
    df = spark.createDataFrame(pairs, "a string, b string, e string")
    assert all(r.x == r.e for r in df.select("e", S.freshness(F.col("a"), F.col("b")).alias("x")).collect())


def test_times(spark):
    got = each(spark, ["2024-01-02 10:00:00 +0900", "2024-01-02T10:00:00+09:00", "2024-01-02T10:00:00Z", "yesterday", None], S.git_timestamp)
    assert [g.utc for g in got] == [datetime.datetime(2024, 1, 2, 1)] * 2 + [datetime.datetime(2024, 1, 2, 10), None, None]
    assert [g.local for g in got[:3]] == [datetime.datetime(2024, 1, 2, 10)] * 3
    t = [datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 2, 12)]
    df = spark.createDataFrame([t, t[::-1]], "a timestamp, b timestamp")
    assert [tuple(r) for r in df.select(S.days_between(F.col("a"), F.col("b")), S.days_between(F.col("a"), F.col("b"), signed=True)).collect()] == [(1.5, 1.5), (1.5, -1.5)]


@pytest.mark.parametrize("text, ok", [("2024-01-02", True), ("2024-01-02T10:00:00Z", True), ("2 weeks ago", True), ("1 day ago", True), ("yesterday", True), ("--all", False), ("2024-01-02; rm", False), ("", False)])
def test_date_arguments(text, ok):
    assert S.is_date_argument(text) is ok


def test_subjects(spark):
    subjects = ["fix: crash", "Fixes #3", "fix typo in docs", "prefix the name", "resolve issue", "bug in format"]
    assert each(spark, subjects, S.is_fix) == [True, True, False, False, True, False]
    assert each(spark, ["a  b\t c ", ""], S.squeeze) == ["a b c", ""]


def test_entropy(spark):
    assert each(spark, ["aaaa", "abab", "abcd", ""], S.entropy) == [0.0, 1.0, 2.0, 0.0]


@pytest.mark.parametrize("pattern, hits", [
    ("*", {"a.md", "doc/b.md", "src/c.py", "src/doc/d.py"}), ("*.md", {"a.md", "doc/b.md"}), ("/doc/", {"doc/b.md"}), ("doc/", {"doc/b.md", "src/doc/d.py"}), ("c.py", {"src/c.py"}), ("src", {"src/c.py", "src/doc/d.py"}),
])
def test_owners(spark, pattern, hits):
    files = spark.createDataFrame([(f,) for f in ("a.md", "doc/b.md", "src/c.py", "src/doc/d.py")], "file string")
    rules = spark.createDataFrame([(0, pattern, "@x")], "rule_idx int, pattern string, owners string")
    assert {r.file for r in history.declared_owners(files, rules).where("owners is not null").collect()} == hits
