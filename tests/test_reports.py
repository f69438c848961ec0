"""Findings, rules and reports of the whole audit, against plain versions over the collected findings."""

from __future__ import annotations

import json
import re
from collections import Counter

import pytest

from chronoloom.functions import lexical
from chronoloom.operators import findings, workspace
from chronoloom.plans import queries as plans

from .oracle import SF_DIR


@pytest.fixture(scope="module")
def audit(spark):
    return [r.asDict() for r in plans.QUERIES["findings_ranked"](spark, SF_DIR).collect()]


def test_families_of_the_audit(spark, audit):
    n = Counter(r["category"] for r in audit)
    assert {"cleanCode", "dependency", "ownership", "churn", "velocity", "compliance", "bugHotspot", "complexity"} <= set(n)
    assert n["secret"] == plans.QUERIES["secret_candidates"](spark, SF_DIR).count()
    assert {r.severity: r.n for r in plans.QUERIES["severity_counts"](spark, SF_DIR).collect()} == Counter(r["severity"] for r in audit)


def test_order_of_the_audit(audit):
    keys = [(-r["severity_rank"], r["category"] != "compound", -(r["value_num"] or 0.0)) for r in audit]
    assert keys == sorted(keys)
    assert all(findings.RANK[r["severity"]] == r["severity_rank"] and json.loads(r["evidence"]) is not None for r in audit)


def rules(found):
    """(metric, subject) of the eight rules, from their definitions."""
    of = lambda c: [f for f in found if f["category"] == c]
    churn, hot = {f["subject"] for f in of("churn")}, {f["subject"] for f in of("bugHotspot")}
    owned = of("ownership")
    single = [f for f in owned if f["severity_rank"] >= 7]
    out = [("bug_hotspot_x_single_owner", f["subject"]) for f in of("bugHotspot") if f["subject"] in {s["subject"] for s in single}]
    out += [("complexity_x_churn", f["subject"]) for f in of("complexity") if f["severity_rank"] >= 6 and f["subject"] in churn]
    out += [("cross_module_coupling", f["subject"]) for f in of("coupling") if f["severity_rank"] >= 6 and json.loads(f["evidence"])["cross_module"]]
    out += [("real_complexity_x_churn", f["subject"]) for f in of("lexicalComplexity") if f["severity_rank"] >= 6 and f["subject"] in churn]
    out += [("minor_contributors_x_hotspot", f["subject"]) for f in owned if f["metric"] == "minor_contributor_count" and f["subject"] in hot]
    if any(f["severity"] == "critical" for f in of("dependency")):
        config = re.compile(r"(pubspec\.yaml|package\.json|requirements\.txt|go\.mod|cargo\.toml|gemfile)$|\.env|^config/|/config/")
        out += [("stale_dependency_x_secret", f["subject"]) for f in of("secret") if config.search(f["subject"].lower())]
    risk = Counter(json.loads(f["evidence"]).get("top_author") for f in single if f["metric"] == "single_author_ownership" and f["subject"] in hot)
    out += [("knowledge_loss_risk", a) for a, n in risk.items() if n >= 2 and a]
    if any(f["metric"] == "burnout_commit_share" and f["severity_rank"] >= 6 for f in of("velocity")) and any(f["severity_rank"] >= 4 for f in of("bugHotspot")):
        out.append(("burnout_x_bug_introduction", "repository"))
    return Counter(out)


def test_rules_over_the_audit(spark, audit):
    got = plans.QUERIES["compound_rules"](spark, SF_DIR).collect()
    assert Counter((r.metric, r.subject) for r in got) == rules(audit)


def test_the_audit_as_a_payload(spark, audit):
    row = plans.QUERIES["report_payload"](spark, SF_DIR).first()
    got = json.loads(row.payload)
    every = [*audit, *(r.asDict() for r in plans.QUERIES["compound_rules"](spark, SF_DIR).collect())]
    material = [r for r in every if r["severity_rank"] >= findings.MATERIAL]
    key = lambda r: (-r["severity_rank"], -(r["value_num"] or 0.0), r["subject"], r["metric"])
    for name, test, most in (("findings", lambda r: r["category"] != "compound", 12), ("compounds", lambda r: r["category"] == "compound", 8)):
        mine = [(r["severity"], r["subject"], r["metric"]) for r in got[name]]
        assert mine == [(r["severity"], r["subject"], r["metric"]) for r in sorted(filter(test, material), key=key)][:most]
    assert got["summary"] == Counter(r["severity"] for r in material) and row.report == "repository_audit"
    assert [t["score"] for t in got["refactoring_targets"]] and len(got["refactoring_targets"]) <= 5


@pytest.mark.parametrize("name, families", [
    ("technical_report", {"ownership", "complexity", "churn", "coupling", "drift", "bugHotspot", "volatility", "refactoring", "cleanCode", "lexicalComplexity", "importCycle"}),
    ("security_report", {"secret", "compliance", "dependency"}), ("pm_report", {"busFactor", "ownership", "bugHotspot", "velocity"}),
    ("code_review_report", {"secret", "complexity", "cleanCode", "lexicalComplexity", "ownership", "churn", "bugHotspot"}),
])
def test_reports_are_bounded(spark, name, families):
    rows = plans.QUERIES[name](spark, SF_DIR).collect()
    got = json.loads(rows[0].payload)
    assert len(rows) == 1 and len(got["findings"]) <= 8 and len(got["compounds"]) <= 5
    assert {f["category"] for f in got["findings"]} <= families and sum(got["summary"].values()) >= len(got["findings"])
    ranks = [f["severity_rank"] for f in got["findings"]]
    assert ranks == sorted(ranks, reverse=True) and min(ranks, default=4) >= findings.MATERIAL


def test_clean_code_by_hand(spark):
    """Every measure, magic numbers too, of all files anew."""
    files = {r.path: r.content for r in plans.relation(spark, SF_DIR, "files").collect()}
    magic = re.compile(r"(?<![\"\w.])\b([2-9]\d*|\d{2,})\b(?![\"w.])")
    expected = {}
    for path, content in files.items():
        lines = re.sub("\n$", "", content.replace("\r\n", "\n")).split("\n")
        bare = [b for b in (re.sub(r"//.*$|#.*$", "", x).strip(" ") for x in lines) if b]
        long = [b for b in bare if len(b) > 5]
        lead = [re.match(r"[ \t]*", x)[0] for x in lines]
        deep = max((len(x) + 3 * x.count("\t")) // 4 for x in lead)
        n = [len(lines) > 500, deep >= 5, sum(len(x) > 120 for x in lines) > 0.1 * len(lines), sum(len(magic.findall(b)) for b in bare) > 10, len(long) - len(set(long)) > 0.1 * len(lines)]
        if any(n):
            expected[path] = sum(n)
    got = {r.subject: r.value_num for r in plans.QUERIES["clean_code_findings"](spark, SF_DIR).collect()}
    assert got == expected and got


@pytest.mark.parametrize("name, table, column", [("lexical_suite", "documents", "text"), ("lexical_pages", "pages", "html")])
def test_lexical_metrics_of_tables(spark, name, table, column):
    """Every row of the table, as the metrics of its own text."""
    got = {r.path: tuple(r)[1:] for r in plans.QUERIES[name](spark, SF_DIR).collect()}
    rows = spark.read.parquet(f"{SF_DIR}/{table}.parquet").collect()
    path = (lambda r: f"{r.source}/{r.doc_id}.txt") if table == "documents" else (lambda r: f"p{r.page_id}.html")
    assert got == {path(r): lexical.measure(path(r), r[column]) for r in rows}


def test_paths_inside_a_root(spark):
    paths = ["a/b", "../x", "a/../../x", "/root/a", "/root/../a", "/rooted/a", "./a", "a//b", "..", "/root/a/../../root/b"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r.ok for r in df.select(workspace.inside(df.p, "/root").alias("ok")).collect()] == [True, False, False, True, False, False, True, True, False, True]


def test_scans_and_resources(spark):
    assert workspace.check_scan("log") == "log"
    with pytest.raises(ValueError):
        workspace.check_scan("push")
    shelf = workspace.Registry(spark)
    shelf.register("My report", spark.range(3))
    assert shelf.read("My report").count() == 3
    with pytest.raises(KeyError):
        shelf.read("other")


def test_layers_by_directory(spark):
    df = spark.createDataFrame([("lib/ui/x",), ("lib/uix/y",), ("lib/ui",)], "p string")
    assert [r.ok for r in df.select(workspace.under(df.p, "lib/ui/").alias("ok")).collect()] == [True, False, False]


@pytest.mark.parametrize("name", ["pm_report", "security_report"])
def test_only_findings_are_written(spark, monkeypatch, name):
    """Reports that read a relation once or twice don't write it, and rules read written findings."""
    seen = []
    real = plans.written
    monkeypatch.setattr(plans, "written", lambda df: seen.append(df.columns) or real(df))
    plans.QUERIES[name](spark, SF_DIR)
    assert seen == [findings.COLUMNS]
