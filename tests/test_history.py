"""History operators on small relations: reachability, renames, clocks, prefixes, pins, cycles."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from chronoloom.functions import windows
from chronoloom.operators import coupling, history, security, szz, text, velocity


def commits(spark, revs):
    return spark.createDataFrame([(i, r, "a") for i, r in enumerate(revs)], "seq long, rev string, author string")


@pytest.mark.parametrize("seed", [1, 2])
def test_between_refs_of_a_deep_graph(spark, seed):
    """A chain of 70 commits with branches and merges, against a plain walk."""
    rng = random.Random(seed)
    edges = [(f"c{i}", f"c{i - 1}") for i in range(1, 70)] + [(f"b{i}", f"b{i - 1}" if i % 7 else f"c{i}") for i in range(1, 60)] + [(f"c{i}", f"b{rng.randint(1, i - 2)}") for i in range(20, 70, 9)]
    up = {}
    for a, b in edges:
        up.setdefault(a, set()).add(b)

    def reach(x):
        seen, todo = {x}, [x]
        while todo:
            for y in up.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    known = {x for e in edges for x in e}
    parents = spark.createDataFrame(edges, "rev string, parent string")
    for a, b in (("c69", "b59"), ("c3", "nothing")):
        got = {r.rev for r in history.between_refs(commits(spark, known), parents, a, b).collect()}
        assert got == ((reach(a) if a in known else set()) ^ (reach(b) if b in known else set()))


def test_history_through_many_names(spark):
    rows = [(f"r{i}", f"n{i}", f"n{i - 1}" if i else None) for i in range(12)] + [("x", "n0", "n11"), ("y", "other", None)]
    changes = spark.createDataFrame(rows, "rev string, file string, old_file string")
    assert history.file_history(changes, "n11").count() == 13 and history.file_history(changes, "n2").count() == 13
    assert history.file_history(changes, "other").count() == 1 and history.file_history(changes, "none").count() == 0


def test_the_authors_clock(spark):
    """10 in the morning where the author is, though one o'clock at night in UTC."""
    rows = [("a", "x", datetime.datetime(2024, 1, 2, 1), datetime.datetime(2024, 1, 2, 10)), ("b", "x", datetime.datetime(2024, 1, 8, 15), datetime.datetime(2024, 1, 8, 22))]
    df = spark.createDataFrame(rows, "rev string, author string, ts timestamp, ts_local timestamp_ntz").withColumn("subject", F.lit("s"))
    assert [tuple(r) for r in velocity.velocity(df, "day").collect()] == [("2024-01-02", 1, 0), ("2024-01-08", 1, 1)]
    assert [r.rev for r in velocity.burnout_commits(df).collect()] == ["b"] and velocity.burnout_share(df).first().burnout == 1
    assert [r.rev for r in velocity.burnout_commits(df.drop("ts_local")).collect()] == ["a"]


def test_periods_are_in_order(spark):
    rows = [(str(i), datetime.datetime(2024, 1 + (i * 5) % 12, 3, 12)) for i in range(12)]
    got = [r.period for r in velocity.velocity(spark.createDataFrame(rows, "rev string, ts timestamp"), "month").collect()]
    assert got == sorted(got) and len(got) == 12
    empty = spark.createDataFrame([], "rev string, author string, ts timestamp")
    one = velocity.velocity_summary(empty).first()
    assert (one.periods, one.commits, one["mean"], one.trend, one.slope, one.gini) == (0, 0, None, "stable", None, None)


@pytest.mark.parametrize("seed", range(4))
def test_prefix_of_all(spark, seed):
    rng = random.Random(seed)
    rows = [(f"a{i:02}", rng.choice([1, 1, 2, 3, 9])) for i in range(rng.randint(1, 30))]
    share = rng.choice([0.1, 0.5, 0.9])
    df = spark.createDataFrame(rows, "author string, n long")
    got = {r.author for r in windows.threshold_prefix(df, [], "n", [F.desc("n"), F.col("author")], share).collect()}
    expected, total = set(), 0
    for a, n in sorted(rows, key=lambda x: (-x[1], x[0])):
        if total < share * sum(n for _, n in rows):
            expected.add(a)
        total += n
    assert got == expected


def test_rank_share(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 2), ("d", 5)], "file string, n long")
    assert {r.file: r.r for r in windows.rank_share(df, "n", "r").collect()} == {"a": 0.25, "b": 0.75, "c": 0.75, "d": 1.0}


def test_carry_forward(spark):
    df = spark.createDataFrame([("x", 1, None), ("x", 2, "a"), ("x", 3, None), ("x", 4, "b"), ("y", 1, None)], "k string, i int, v string")
    got = df.withColumn("c", windows.carry_forward("v", ["k"], "i")).orderBy("k", "i").collect()
    assert [r.c for r in got] == [None, "a", "a", "b", None]


@pytest.mark.parametrize("kind, content, pins", [
    ("dart", "dependencies:\n  a: 1.2.3\n  b: 1\n  c: ^1.0.0\n  d: any\n  e: path:../e\n  f: git:x\nversion: 1.0.0\n", {"a": True, "b": False, "c": False, "d": False, "e": True, "f": True}),
    ("npm", '{"dependencies": {"a": "1.0.0", "b": "~1.0.0", "c": "*"}, "version": "1.0.0"}', {"a": True, "b": False, "c": False}),
    ("npm", "no json", {}),
    ("python", "# x\na==1.0\nb>=1\nc\nd[extra]==2\n-r more.txt\n", {"a": True, "b": False, "c": False, "d": True}),
    ("go", "module m\nrequire (\n\tx.org/a v1.0.0\n)\nrequire x.org/b v0.1.0\n", {"x.org/a": True, "x.org/b": True}),
    ("rust", '[package]\nversion = "1.0.0"\n[dependencies]\na = "1.0.100"\nb = "1.0"\nc = "=1"\n[dev-dependencies]\nd = { version = "1.2.3", features = [] }\n', {"a": True, "b": False, "c": True, "d": True}),
    ("ruby", "source 'x'\ngem 'a', '>= 5.0'\ngem 'b', '~> 1.0'\ngem 'c'\ngem \"d\", \"1.0\"\n", {"a": True, "b": False, "c": False, "d": True}),
])
def test_pins(kind, content, pins):
    assert {n: p for n, _, p in security.parse_manifest(kind, content)} == pins


def test_freshness_of_a_repeated_package(spark):
    deps = spark.createDataFrame([("npm", "m", "a", "1.0.0")], "ecosystem string, manifest string, name string, declared string")
    registry = spark.createDataFrame([("npm", "a", v) for v in ("1.0.0", "2.0.0", "1.5.0")], "ecosystem string, name string, latest string")
    assert security.dependency_freshness(deps, registry).first().status == "major"


def test_tracing_of_deleted_lines(spark):
    """Two deleted lines that blame gives to one commit, a moved one, and one from a refactoring."""
    t = lambda d: datetime.datetime(2023, 1, d, 12)
    diff = spark.createDataFrame([("f", "a", "-", 5, "int total = 0;"), ("f", "a", "-", 6, "int other = 1;"), ("f", "a", "-", 7, "moved_line_of_code()"), ("f", "b", "+", None, "moved_line_of_code( )".replace("( )", "()")), ("f", "a", "-", 8, "x = renamed;")],
                                 "rev string, file string, op string, old_line int, content string")
    blame = spark.createDataFrame([("f", "a", n, r, "Ann", t(1)) for n, r in ((5, "^i"), (6, "i"), (7, "i"), (8, "g"))], "rev string, file string, line_no int, intro_rev string, intro_author string, intro_ts timestamp")
    fixes = spark.createDataFrame([("f", t(2))], "rev string, ts timestamp")
    known = spark.createDataFrame([("i", "feat: it"), ("g", "refactor: move things")], "rev string, subject string")
    got = szz.szz(fixes, diff, blame, known)
    assert [(r.intro_rev, r.fix_rev, r.file) for r in got.collect()] == [("i", "f", "a")] * 2
    one = szz.lifetimes(got).first()
    assert (one.matches, one.fixes, one.mean_days) == (2, 1, 1.0)
    assert [(r["first"], r["last"]) for r in szz.deleted_ranges(diff).collect()] == [(5, 6), (8, 8)]


def test_numbers_of_old_lines(spark):
    rows = [("r", "f", 1, i, op, 5) for i, op in enumerate(" -+- +")]
    got = szz.numbered_lines(spark.createDataFrame(rows, "rev string, file string, hunk int, line_seq int, op string, old_start int")).orderBy("line_seq").collect()
    assert [r.old_line for r in got] == [5, 6, None, 7, 8, None]


def test_layers_by_pattern(spark):
    changes = spark.createDataFrame([("a", "lib/ui/x.dart"), ("a", "lib/data/y.dart"), ("b", "lib/ui/z.dart"), ("c", "doc/x")], "rev string, file string")
    layers = spark.createDataFrame([("ui", "(^|/)ui/"), ("data", "DATA/"), ("none", "^nothing")], "layer string, pattern string")
    got = {r.rev: r.layers for r in coupling.commit_layers(changes, layers).collect()}
    assert got == {"a": ["data", "ui"], "b": ["ui"]}
    one = coupling.drift_summary(changes, layers).first()
    assert (one.commits, one.drift_commits, one.coupled_pairs, one.possible_pairs) == (3, 1, 1, 3)


@pytest.mark.parametrize("seed", [3, 4])
def test_cycles_of_a_graph(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randint(0, 40):02}", f"n{rng.randint(0, 40):02}") for _ in range(55)]
    up = {}
    for a, b in edges:
        up.setdefault(a, set()).add(b)

    def reach(x):
        seen, todo = set(), list(up.get(x, ()))
        while todo:
            y = todo.pop()
            if y not in seen:
                seen.add(y)
                todo += up.get(y, ())
        return seen

    nodes = {x for e in edges for x in e}
    r = {x: reach(x) for x in nodes}
    expected = {(x, min(y for y in nodes if y == x or y in r[x] and x in r[y])) for x in nodes if any(y != x and y in r[x] and x in r[y] for y in nodes)}
    got = {(q.node, q.cycle) for q in text.import_cycles(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == expected


def test_pairs_of_a_large_commit(spark):
    rows = [("big", f"f{i:03}") for i in range(150)] + [("small", "f001"), ("small", "f149"), ("one", "f000")]
    got = {(r.a, r.b): r.n for r in coupling.cochange_pairs(spark.createDataFrame(rows, "rev string, file string")).collect()}
    assert len(got) == 150 * 149 // 2 and got["f001", "f149"] == 2 and got["f000", "f149"] == 1


def test_runs_are_sorted_once(spark):
    """Equal, null and extreme numbers; no hash table of all rows, where there were two."""
    low, high = -(1 << 63), (1 << 63) - 1
    rows = [("a", n) for n in (3, 1, 2, 2, 2, 7, 9, 8, 9, None, None)] + [("b", None), ("c", 5), ("c", 5), ("d", low), ("d", low), ("d", low + 1), ("d", high), ("d", high), (None, 4), (None, 5)]
    out = windows.islands(spark.createDataFrame(rows, "k string, n long").repartition(3), ["k"], "n")
    expected = {("a", 1, 3), ("a", 7, 9), ("a", None, None), ("b", None, None), ("c", 5, 5), ("d", low, low + 1), ("d", high, high), (None, 4, 5)}
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(expected) and set(got) == expected and out.columns == ["k", "first", "last"]
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "Aggregate" not in plan


def test_rows_with_their_ranks_are_made_once(spark):
    """Both sides of the join read written rows, not what makes them; the plan had it twice before."""
    out = windows.rank_share(spark.range(4).select(F.col("id").alias("n")), "n", "r")
    assert sorted(r.r for r in out.collect()) == [0.25, 0.5, 0.75, 1.0]
    assert "Range" not in out._jdf.queryExecution().optimizedPlan().toString()
