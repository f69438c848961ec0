"""Compliance of commits, changelogs, dependencies and secrets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def compliance(commits: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """(rev, unsigned, empty_subject, unrecognised, unconventional) of every commit."""
    email = ~F.col("email").isin(allowed) if allowed else F.lit(False)
    odd = ~F.col("subject").rlike(S.CONVENTIONAL) & ~F.col("subject").startswith("Merge ")
    return commits.select("rev", (F.coalesce("sig", F.lit("N")) != "G").alias("unsigned"), (F.trim("subject") == "").alias("empty_subject"), email.alias("unrecognised"), odd.alias("unconventional"))


def compliance_counts(commits: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    c = compliance(commits, allowed)
    return c.agg(F.count("*").alias("commits"), *[F.count_if(k).alias(k) for k in c.columns[1:]])


def change_kind(subject):
    """breaking, fix, feature or other."""
    kind = F.lower(F.regexp_extract(subject, S.CONVENTIONAL_LOG, 1))
    return F.when(F.contains(F.upper(subject), F.lit("BREAKING CHANGE")) | F.contains(subject, F.lit("!:")), "breaking").when(kind == "fix", "fix").when(kind == "feat", "feature").otherwise("other")


def changelog(commits: DataFrame) -> DataFrame:
    """(kind, commits, subjects): subjects in log order."""
    d = commits.withColumn("kind", change_kind(F.col("subject")))
    return d.groupBy("kind").agg(F.count("*").alias("commits"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "subject"))), lambda x: x["subject"]).alias("subjects"))


def changelog_entries(commits: DataFrame, changes: DataFrame, matches: DataFrame) -> DataFrame:
    """(rev, kind, author, subject, files, origins): of fixes also the commits that brought the bug, with its days."""
    files = changes.groupBy("rev").agg(F.array_sort(F.collect_set("file")).alias("files"))
    d = commits.select("rev", "author", "subject", change_kind(F.col("subject")).alias("kind"))
    origins = fix_origins(d.where("kind = 'fix'"), matches).groupBy(F.col("fix_rev").alias("rev")).agg(F.array_sort(F.collect_list(F.struct("intro_rev", F.round("days", 2).alias("days")))).alias("origins"))
    out = d.join(files, "rev", "left").join(origins, "rev", "left")
    return out.select("rev", "kind", "author", "subject", F.coalesce("files", F.array().cast("array<string>")).alias("files"), F.coalesce("origins", F.array().cast("array<struct<intro_rev:string,days:double>>")).alias("origins"))


def changelog_summary(commits: DataFrame) -> DataFrame:
    """One row: commits and the sorted names of contributors, empty ones left out."""
    return commits.agg(F.count("*").alias("commits"), F.array_sort(F.collect_set(F.nullif("author", F.lit("")))).alias("contributors"))


def fix_origins(fixes: DataFrame, matches: DataFrame) -> DataFrame:
    """Distinct (fix, introducing commit) with the signed days between."""
    d = matches.join(fixes.select(F.col("rev").alias("fix_rev")), "fix_rev", "left_semi").groupBy("fix_rev", "intro_rev").agg(F.min("intro_ts").alias("intro_ts"), F.min("fix_ts").alias("fix_ts"))
    return d.select("fix_rev", "intro_rev", S.days_between(F.col("intro_ts"), F.col("fix_ts"), signed=True).alias("days"))


LOCKS = {"dart": "pubspec.lock", "npm": "package-lock.json", "python": "poetry.lock", "go": "go.sum", "rust": "Cargo.lock", "ruby": "Gemfile.lock"}
MANIFESTS = {"dart": "pubspec.yaml", "npm": "package.json", "python": "requirements.txt", "go": "go.mod", "rust": "Cargo.toml", "ruby": "Gemfile"}


def manifests(files: DataFrame) -> DataFrame:
    """(ecosystem, path, content, has_lock) of manifests at any depth."""
    kinds = F.create_map(*[F.lit(x) for e, m in MANIFESTS.items() for x in (m, e)])
    locks = F.create_map(*[F.lit(x) for e, m in LOCKS.items() for x in (e, m)])
    name, parent = F.element_at(F.split("path", "/"), -1), F.regexp_extract("path", "^(.*/)?", 1)
    found = files.select("path", "content", F.element_at(kinds, name).alias("ecosystem"), parent.alias("__dir")).where("ecosystem is not null")
    present = files.select(F.col("path").alias("__lock"), F.lit(True).alias("has_lock"))
    out = found.withColumn("__want", F.concat("__dir", F.element_at(locks, F.col("ecosystem"))))
    return out.join(present, out["__want"] == present["__lock"], "left").select("ecosystem", "path", "content", F.coalesce("has_lock", F.lit(False)).alias("has_lock"))


def parse_manifest(ecosystem: str, text: str) -> list[tuple[str, str, bool]]:
    """(name, declared version, pinned) of one manifest; manifests are few and small."""
    import json
    import re

    out: list[tuple[str, str, bool]] = []
    if ecosystem == "npm":
        try:
            data = json.loads(text)
        except ValueError:
            return []
        for part in ("dependencies", "devDependencies"):
            for n, v in (data.get(part) or {}).items() if isinstance(data, dict) else ():
                v = str(v)
                out.append((n, v, not re.match(r"[\^~>]", v) and v not in ("*", "latest")))
        return out
    section = None
    for raw in text.splitlines():
        line = raw.split("#")[0].rstrip() if ecosystem != "go" else raw.split("//")[0].rstrip()
        bare = line.strip()
        if not bare:
            continue
        if ecosystem == "dart":
            if not line[0].isspace():
                section = bare.rstrip(":") if bare.endswith(":") else None
            elif section in ("dependencies", "dev_dependencies") and (m := re.match(r"  ([\w-]+):\s*(.*)$", line)):
                v = m[2].strip().strip("'\"")
                out.append((m[1], v, v.startswith(("path:", "git:")) or bool(re.match(r"\d+\.\d+\.\d+", v))))
        elif ecosystem == "python":
            if not bare.startswith("-") and (m := re.match(r"([\w.\-]+)(?:\[[^\]]*\])?\s*(.*)$", bare)):
                out.append((m[1], m[2].strip(), "==" in m[2]))
        elif ecosystem == "go":
            if bare.startswith("require ("):
                section = "require"
            elif bare == ")":
                section = None
            elif m := re.match(r"(?:require\s+)?([\w./\-]+)\s+(v[\w.\-+]+)", bare) if section or bare.startswith("require ") else None:
                out.append((m[1], m[2], True))
        elif ecosystem == "rust":
            if bare.startswith("["):
                section = bare.strip("[]")
            elif section in ("dependencies", "dev-dependencies") and (m := re.match(r"([\w-]+)\s*=\s*(.*)$", bare)):
                v = re.search(r'"([^"]*)"', m[2])
                out.append((m[1], v[1] if v else "", bool(v and re.match(r"=|\d+\.\d+\.\d+$", v[1]))))
        elif ecosystem == "ruby":
            if m := re.match(r"gem\s+['\"]([^'\"]+)['\"](?:\s*,\s*['\"]([^'\"]*)['\"])?", bare):
                out.append((m[1], m[2] or "", bool(m[2]) and not m[2].startswith("~>")))
    return out


def dependencies(found: DataFrame) -> DataFrame:
    """(ecosystem, manifest, name, declared, pinned) of `manifests`."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            rows = [(e, p, n, v, b) for e, p, t in zip(pdf["ecosystem"], pdf["path"], pdf["content"]) for n, v, b in parse_manifest(e, t or "")]
            yield pd.DataFrame(rows, columns=["ecosystem", "manifest", "name", "declared", "pinned"])

    return found.select("ecosystem", "path", "content").mapInPandas(run, "ecosystem string, manifest string, name string, declared string, pinned boolean")


def manifest_counts(found: DataFrame, deps: DataFrame) -> DataFrame:
    """(ecosystem, manifest, total, pinned, floating, has_lock) of every manifest, also of those without dependencies."""
    n = deps.groupBy("ecosystem", "manifest").agg(F.count("*").alias("total"), F.count_if("pinned").alias("pinned"))
    out = found.select("ecosystem", F.col("path").alias("manifest"), "has_lock").join(n, ["ecosystem", "manifest"], "left")
    total, pinned = (F.coalesce(c, F.lit(0)) for c in ("total", "pinned"))
    return out.select("ecosystem", "manifest", total.alias("total"), pinned.alias("pinned"), (total - pinned).alias("floating"), "has_lock")


def dependency_risk(found: DataFrame, deps: DataFrame) -> DataFrame:
    """One row: dependencies, floating ones, missing locks, risk."""
    d = deps.agg(F.count("*").alias("total"), F.count_if(~F.col("pinned")).alias("floating"))
    m = found.agg(F.count_if(~F.col("has_lock")).alias("missing_locks"))
    risk = F.when(F.col("total") == 0, "none").when((F.col("floating") > 0.5 * F.col("total")) | (F.col("missing_locks") > 0), "high").when(F.col("floating") > 0, "medium").otherwise("low")
    return d.crossJoin(m).withColumn("risk", risk)


def dependency_freshness(deps: DataFrame, registry: DataFrame) -> DataFrame:
    """Dependencies with the latest version (of several the last by text) and how far behind they are; unknown without one."""
    latest = registry.groupBy("ecosystem", "name").agg(F.max("latest").alias("latest"))
    return deps.join(latest, ["ecosystem", "name"], "left").withColumn("status", S.freshness(F.col("declared"), F.col("latest")))


SECRET = "(AKIA[0-9A-Z]{16}|xox[abprs]-[0-9A-Za-z-]{10,}|-----BEGIN [A-Z ]*PRIVATE KEY-----|(?i:api[_-]?key|secret|token|password)\\s*[:=]\\s*[\"']?([A-Za-z0-9+/_\\-]{8,}))"


def secrets(lines: DataFrame, text: str = "content", least_entropy: float = 2.5) -> DataFrame:
    """Lines with a likely secret; its middle is masked. Rules are this engine's own."""
    hit = F.regexp_extract(text, SECRET, 0)
    value = F.when(F.regexp_extract(text, SECRET, 2) != "", F.regexp_extract(text, SECRET, 2)).otherwise(hit)
    found = lines.where(F.col(text).rlike(SECRET) & ~F.contains(text, F.lit("${{")) & ~F.lower(text).rlike("example|placeholder|changeme"))
    found = found.withColumn("__v", value).where(S.entropy(F.col("__v")) >= least_entropy)
    return found.withColumn("masked", F.concat(F.left("__v", F.lit(3)), F.lit("***"), F.right("__v", F.lit(3)))).drop("__v")
