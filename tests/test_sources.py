"""Logs, patches, blame and status as relations; results as JSON, slices and cursors."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from chronoloom.operators import coupling, history, szz
from chronoloom.sources import logs, session, sinks

LOG = (
    "\x1ea1\x1fp0\x1fAnn\x1fann@x.org\x1fG\x1f2024-01-02T10:00:00+02:00\x1ffix: a bug\x1f\n\n3\t1\tlib/a.py\n-\t-\timg.png\n2\t0\tlib/{old => new}/b.py\n"
    "\x1eb2\x1fp1 p2\x1f\x1f\x1fN\x1f2024-01-03T23:30:00Z\x1fMerge \x1f\n\n1\t1\told.py => new.py\n5\t0\tlib/{ => deep}/c.py\n"
    "\x1ec3\x1f\x1fBob\x1fb@x\x1fB\x1fnonsense\x1f\x1f\n"
)
PATCH = (
    "\x1ea1\x1f\ndiff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -5,3 +5,2 @@ def f\n keep\n-first gone\n-second gone\n+++ plus in text\n@@ -20 +19 @@\n-last\n"
    "diff --git a/new.py b/new.py\nnew file mode 100644\n--- /dev/null\n+++ b/new.py\n@@ -0,0 +1,2 @@\n+if (x) {}\n+first gone\n"
    "diff --git a/dead.py b/dead.py\n--- a/dead.py\n+++ /dev/null\n@@ -1 +0,0 @@\n-bye\n\\ No newline at end of file\n"
)


@pytest.fixture
def written(tmp_path):
    def write(text):
        (tmp_path / "log.txt").write_text(text)
        return str(tmp_path / "log.txt")

    return write


def test_commits_and_changes(spark, written):
    log = logs.records(spark, written(LOG))
    got = {r.rev: r for r in logs.commits(log).collect()}
    assert set(got) == {"a1", "b2", "c3"} and got["b2"].is_merge and got["b2"].author == "" and not got["a1"].is_merge
    assert got["a1"].ts == datetime.datetime(2024, 1, 2, 8) and got["a1"].ts_local == datetime.datetime(2024, 1, 2, 10) and got["a1"].subject == "fix: a bug"
    assert got["c3"].parents == []
    changes = {(r.rev, r.file): (r.old_file, r.status, r.insertions, r.deletions) for r in logs.file_changes(log).collect()}
    assert changes == {
        ("a1", "lib/a.py"): (None, "M", 3, 1), ("a1", "img.png"): (None, "M", 0, 0), ("a1", "lib/new/b.py"): ("lib/old/b.py", "R", 2, 0),
        ("b2", "new.py"): ("old.py", "R", 1, 1), ("b2", "lib/deep/c.py"): ("lib/c.py", "R", 5, 0),
    }


def test_empty_log(spark, written):
    assert logs.commits(logs.records(spark, written(""))).count() == 0


def test_patches_to_bugs(spark, written):
    lines = logs.diff_lines(logs.records(spark, written(PATCH))).cache()
    got = [(r.file, r.op, r.old_line, r.content) for r in lines.orderBy("line_seq").collect()]
    assert got == [
        ("x.py", " ", 5, "keep"), ("x.py", "-", 6, "first gone"), ("x.py", "-", 7, "second gone"), ("x.py", "+", None, "++ plus in text"), ("x.py", "-", 20, "last"),
        ("new.py", "+", None, "if (x) {}"), ("new.py", "+", None, "first gone"), ("dead.py", "-", 1, "bye"),
    ]
    assert {r.file: r.complexity for r in history.proxy_complexity(lines).collect()} == {"new.py": 1}
    # the line that is added elsewhere has moved, short ones count
    assert {(r.file, r.old_line) for r in szz.deleted_not_moved(lines).collect()} == {("x.py", 7), ("x.py", 20), ("dead.py", 1)}
    text = "^deadbeef1 3 7 1\nauthor Eve\nauthor-time 1672574400\nsummary x\n\tsecond gone\nabc1234 1 20 1\nauthor Eve\nauthor-time 1672574400\n\tlast"
    blame = logs.blame_lines(spark.createDataFrame([("a1", "x.py", text)], "rev string, file string, text string"))
    assert {(r.intro_rev, r.line_no, r.intro_author, r.intro_ts) for r in blame.collect()} == {("deadbeef1", 7, "Eve", datetime.datetime(2023, 1, 1, 12)), ("abc1234", 20, "Eve", datetime.datetime(2023, 1, 1, 12))}
    fixes = spark.sql("SELECT 'a1' AS rev, TIMESTAMP '2023-01-02 12:00:00' AS ts")
    about = spark.createDataFrame([("abc1234", "refactor: move it")], "rev string, subject string")
    matches = szz.szz(fixes, lines, blame, about)
    assert [(r.intro_rev, r.fix_rev) for r in matches.collect()] == [("deadbeef1", "a1")]
    assert [(r.matches, r.fixes, r.mean_days) for r in szz.lifetimes(matches).collect()] == [(1, 1, 1.0)]
    lines.unpersist()


def test_status_and_shortlog(spark):
    s = spark.createDataFrame([("M  a",), (" M b",), ("MM c",), ("?? d e",), ("",)], "value string")
    assert sorted((r.kind, r.file) for r in logs.status(s).collect()) == [("staged", "a"), ("staged", "c"), ("unstaged", "b"), ("unstaged", "c"), ("untracked", "d e")]
    a = spark.createDataFrame([("    12\tAnn B <a@b>",), ("x",)], "value string")
    assert [tuple(r) for r in logs.shortlog(a).collect()] == [("Ann B", 12)]


def test_coupling_of_two_commits(spark):
    changes = spark.createDataFrame([("1", "A"), ("1", "B"), ("2", "A"), ("2", "B"), ("2", "C"), ("3", "A")], "rev string, file string")
    got = {(r.a, r.b): (r.n, r.confidence) for r in coupling.logical_coupling(changes, least=1).collect()}
    assert got == {("A", "B"): (2, 1.0), ("A", "C"): (1, 1.0), ("B", "C"): (1, 1.0)}


def test_drift_of_layers(spark):
    changes = spark.createDataFrame([("a", "ui/screen"), ("a", "data/repo"), ("b", "ui/other")], "rev string, file string")
    layers = spark.createDataFrame([(x, f"{x}/") for x in ("ui", "data", "core", "net")], "layer string, pattern string")
    assert tuple(coupling.drift_summary(changes, layers).first()) == (2, 1, 1, 6)


def test_results_small_and_large(spark, tmp_path):
    df = spark.range(300).selectExpr("id", "null AS none", "array(1, 2) AS a")
    small = sinks.offload(df.limit(2), str(tmp_path / "no"))
    assert small == {"status": "inline", "rows": [{"id": i, "none": None, "a": [1, 2]} for i in range(2)]}
    large = sinks.offload(df, str(tmp_path / "yes"), threshold=1000)
    assert large["status"] == "offloaded" and large["count"] == 300 and large["structure"] == {"id": "number", "none": "null", "a": "array(2)"}
    assert spark.read.json(large["path"]).count() == 300


def test_slices_and_cursors():
    value = {"a": [{"b": list(range(600))}], "c": "x"}
    assert sinks.read_slice(value, "a.0.b", 10, 3) == [10, 11, 12] and len(sinks.read_slice(value, "a.0.b", 0, 9999)) == 500 and sinks.read_slice(value, "c") == "x"
    with pytest.raises(KeyError):
        sinks.read_slice(value, "a.5")
    assert sinks.offset_of(sinks.cursor(70)) == 70 and sinks.offset_of(None) == 0
    for bad in ("?", "e30=", sinks.cursor(-1)):
        with pytest.raises(ValueError):
            sinks.offset_of(bad)


def test_sizes_of_what_is_written_do_not_grow(spark):
    """The estimated size of a loop's rows stays as it is; it had the digits of all joins before."""
    df = spark.range(3).toDF("k")
    for _ in range(12):
        df = session.written(df.join(df.withColumnRenamed("k", "j"), F.col("k") == F.col("j")).select("k"))
    assert sorted(r.k for r in df.collect()) == [0, 1, 2]
    assert len(df._jdf.queryExecution().optimizedPlan().stats().simpleString()) < 100


def test_commits_between_refs_of_a_circle(spark):
    """Rounds end though a commit is its own parent, and others are their own ancestors."""
    parents = spark.createDataFrame([("0", "0"), ("1", "0"), ("2", "1"), ("3", "4"), ("4", "5"), ("5", "3"), ("6", "5"), ("6", "1")], "rev string, parent string")
    commits = spark.createDataFrame([(str(i),) for i in range(8)], "rev string")
    got = lambda a, b: {r.rev for r in history.between_refs(commits, parents, a, b).collect()}
    assert got("6", "2") == {"6", "3", "4", "5", "2"} and got("3", "none") == {"3", "4", "5"} and got("2", "2") == set()
