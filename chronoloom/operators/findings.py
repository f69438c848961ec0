"""From metrics to findings in bands, compounds of findings, ranked and bounded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.windows import order_statistics, rank_share, top_one
from ..sources.session import written

RANK = {"info": 1, "healthy": 2, "low": 3, "elevated": 4, "moderate": 5, "high": 6, "critical": 7}
MATERIAL = RANK["elevated"]
COLUMNS = ["category", "source", "severity", "severity_rank", "subject", "metric", "value_num", "value_str", "band", "evidence"]


def severity_rank(severity: Column) -> Column:
    return reduce(lambda c, kv: c.when(severity == kv[0], kv[1]), list(RANK.items())[1:], F.when(severity == "info", RANK["info"]))


def findings(df: DataFrame, category: str, source: str | list[str], severity: Column, subject: Column, metric: str, value: Column, band: Column, evidence: dict[str, Column] | None = None) -> DataFrame:
    """Rows with a severity as findings; evidence is a JSON text."""
    source = [source] if isinstance(source, str) else source
    out = df.withColumn("__sev", severity).where("__sev is not null")
    facts = F.to_json(F.struct(*[c.alias(k) for k, c in evidence.items()])) if evidence else F.lit("{}")
    return out.select(
        F.lit(category).alias("category"), F.array(*[F.lit(s) for s in source]).alias("source"), F.col("__sev").alias("severity"), severity_rank(F.col("__sev")).alias("severity_rank"),
        subject.alias("subject"), F.lit(metric).alias("metric"), value.cast("double").alias("value_num"), F.lit(None).cast("string").alias("value_str"), band.alias("band"), facts.alias("evidence"))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def against(df: DataFrame, value: str) -> DataFrame:
    """Rows, written once as they are read twice, with the statistics of all rows beside them; the statistics are one row."""
    df = written(df)
    return df.crossJoin(F.broadcast(order_statistics(df, value)))


def classify_bus_factor(each: DataFrame) -> DataFrame:
    """Of (author, commits): the share of the most active author."""
    d = each.agg(F.sum("commits").alias("total"), F.max_by("author", F.struct("commits", "author")).alias("author"), F.max("commits").alias("top")).where("total > 0")
    s = F.col("top") / F.col("total")
    return findings(d, "busFactor", "busFactor", F.when(s > 0.5, "critical").when(s >= 0.3, "moderate").otherwise("healthy"), F.lit("repository"), "top_author_share", s, F.lit("share of the most active author"), {"top_author": F.col("author")})


def classify_ownership(owned: DataFrame) -> DataFrame:
    """Of `history.ownership`: single owners, and files with many minor contributors."""
    s = F.col("top_changes") / F.col("total")
    one = findings(owned, "ownership", "fileOwnership", F.when(s > 0.5, "critical").when(s >= 0.3, "moderate"), F.col("file"), "single_author_ownership", s, F.lit("share of the main author"), {"top_author": F.col("top_author")})
    minor = findings(owned, "ownership", "fileOwnership", F.when(F.col("minor") >= 3, "elevated"), F.col("file"), "minor_contributor_count", F.col("minor"), F.lit("three or more minor contributors"), {"top_author": F.col("top_author")})
    return one.unionByName(minor)


def classify_hotspots(by_file: DataFrame) -> DataFrame:
    """Of lifetimes by file: long-lived against the mean of all, frequent against the ninth decile."""
    by_file = written(by_file)
    whole = by_file.agg((F.sum("minutes") / 1440.0 / F.sum("matches")).alias("__mean"), F.coalesce(F.percentile("matches", F.lit(0.9)), F.lit(0.0)).alias("__p90"))
    d = by_file.crossJoin(F.broadcast(whole))
    life = F.when(F.col("mean_days") > 2 * F.col("__mean"), RANK["critical"]).when(F.col("mean_days") > F.col("__mean"), RANK["elevated"]).otherwise(0)
    top = F.greatest(life, F.when(F.col("matches") >= F.col("__p90"), RANK["high"]).otherwise(0))
    sev = F.when(top == 7, "critical").when(top == 6, "high").when(top == 4, "elevated")
    return findings(d, "bugHotspot", "bugHotspots", sev, F.col("file"), "bug_hotspot", F.col("matches"), F.lit("lifetime or count above the others"), {"mean_days": F.col("mean_days")})


def classify_complexity(proxy: DataFrame) -> DataFrame:
    d = against(proxy.where(S.is_source_file(F.col("file"))), "complexity")
    c = F.col("complexity")
    return findings(d, "complexity", "codeQuality", F.when(c > 2 * F.col("median"), "high").when(c > F.col("median"), "elevated"), F.col("file"), "proxy_complexity", c, F.lit("above the median"))


def classify_top_decile(df: DataFrame, category: str, source: str, value: str) -> DataFrame:
    """Churn and volatility: at or above the ninth decile."""
    d = against(df, value)
    return findings(d, category, source, F.when((F.col(value) >= F.col("p90")) & (F.col(value) > 0), "elevated"), F.col("file"), value, F.col(value), F.lit("top decile"))


def classify_coupling(pairs: DataFrame) -> DataFrame:
    c = F.col("confidence")
    return findings(pairs, "coupling", "logicalCoupling", F.when(c > 0.6, "high").when(c >= 0.3, "moderate"), F.concat("a", F.lit(" <-> "), "b"), "co_change_confidence", c, F.lit("changed together"), {"cross_module": F.col("cross_module"), "n": F.col("n")})


def classify_dependencies(fresh: DataFrame) -> DataFrame:
    s = F.col("status")
    return findings(fresh, "dependency", "dependencyDrift", F.when(s == "major", "critical").when(s == "minor", "moderate").when(s == "patch", "low"), F.col("name"), "version_behind", F.lit(None), s, {"declared": F.col("declared"), "latest": F.col("latest")})


def classify_compliance(checked: DataFrame) -> DataFrame:
    """Each kind of issue once, with up to five samples."""
    out = []
    for kind, sev in (("unsigned", "moderate"), ("unrecognised", "moderate"), ("empty_subject", "low"), ("unconventional", "low")):
        d = checked.where(F.col(kind)).agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set(F.when(F.col(kind), F.col("rev")))), 1, 5).alias("sample")).where("n > 0")
        out.append(findings(d, "compliance", "compliance", F.lit(sev), F.lit("repository"), kind, F.col("n"), F.lit("commits with the issue"), {"sample": F.col("sample")}))
    return union(out)


def classify_lexical(metrics: DataFrame) -> DataFrame:
    """The worst metric of each file; of equal ones the first."""
    def level(pairs):
        c = F.lit(0)
        for test, sev in reversed(pairs):
            c = F.when(test, RANK[sev]).otherwise(c)
        return c

    m = F.col
    levels = [
        ("cyclomatic", m("cyclomatic"), [(m("cyclomatic") > 50, "critical"), (m("cyclomatic") > 20, "high"), (m("cyclomatic") > 10, "elevated")]),
        ("maintainability", m("maintainability"), [(m("maintainability") < 65, "high"), (m("maintainability") < 85, "elevated")]),
        ("abc", m("abc"), [(m("abc") > 30, "high"), (m("abc") > 15, "elevated")]),
        ("npath", m("npath"), [(m("npath") > 1000, "high"), (m("npath") > 200, "elevated")]),
        ("cognitive", m("cognitive"), [(m("cognitive") > 25, "high"), (m("cognitive") > 15, "elevated")]),
        ("halstead_bugs", m("halstead_bugs"), [(m("halstead_bugs") > 2.0, "elevated")]),
    ]
    worst = F.array_max(F.array(*[F.struct(level(steps).alias("rank"), F.lit(-i).alias("o"), F.lit(name).alias("name"), v.cast("double").alias("v")) for i, (name, v, steps) in enumerate(levels)]))
    d = metrics.withColumn("__w", worst).where("__w.rank > 0")
    sev = F.when(m("__w.rank") == 7, "critical").when(m("__w.rank") == 6, "high").otherwise("elevated")
    out = findings(d, "lexicalComplexity", "universalLexicalMetrics", sev, F.col("path"), "lexical", F.col("__w.v"), F.col("__w.name"))
    return out.withColumn("metric", F.col("band"))


def classify_clean_code(measured: DataFrame) -> DataFrame:
    n = F.size("issues")
    return findings(measured, "cleanCode", "cleanCode", F.when(n >= 3, "high").when(n >= 1, "elevated"), F.col("path"), "clean_code_issues", n, F.array_join("issues", "; "))


def classify_velocity(trend: DataFrame, slope: DataFrame, gini: DataFrame, share: DataFrame) -> DataFrame:
    """Slowing down, unequal work, and off-hours; all inputs are one row."""
    t = trend.crossJoin(slope)
    s = F.col("numerator") / F.nullif("denominator", F.lit(0))
    a = findings(t, "velocity", "commitVelocity", F.when((F.col("trend") == "decelerating") & (s < 0), "elevated"), F.lit("repository"), "velocity_trend", s, F.lit("fewer commits in the second half"))
    g = F.col("numerator") / F.nullif("denominator", F.lit(0))
    b = findings(gini, "velocity", "commitVelocity", F.when(g > 0.6, "high"), F.lit("repository"), "author_gini", g, F.lit("few authors make most commits"))
    r = F.col("burnout") / F.nullif("total", F.lit(0))
    c = findings(share, "velocity", "commitVelocity", F.when(r > 0.15, "high"), F.lit("repository"), "burnout_commit_share", r, F.lit("commits out of hours"))
    return union([a, b, c])


def classify_count(df: DataFrame, category: str, metric: str) -> DataFrame:
    """Mega or suspicious commits: any of them."""
    d = df.agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("rev")), 1, 5).alias("sample")).where("n > 0")
    return findings(d, category, category, F.lit("moderate"), F.lit("repository"), metric, F.col("n"), F.lit("commits found"), {"sample": F.col("sample")})


def classify_drift(summary: DataFrame, smells: DataFrame) -> DataFrame:
    ratio, density = F.col("drift_commits") / F.nullif("commits", F.lit(0)), F.col("coupled_pairs") / F.nullif("possible_pairs", F.lit(0))
    a = findings(summary, "drift", "architectureDrift", F.when(ratio > 0.15, "elevated"), F.lit("repository"), "drift_ratio", ratio, F.lit("commits over several layers"))
    b = findings(summary, "drift", "architectureDrift", F.when(density > 0.5, "elevated"), F.lit("repository"), "coupling_density", density, F.lit("layers that change together"))
    c = findings(smells, "drift", "architectureDrift", F.when(F.col("smell") == "scattered", "moderate").otherwise("high"), F.col("subject"), "architecture_smell", F.col("value"), F.col("smell"))
    return union([a, b, c])


def classify_refactoring(found: DataFrame, least: int = 5) -> DataFrame:
    d = found.agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return findings(d, "refactoring", "refactoring", F.lit("elevated"), F.lit("repository"), "refactoring_commits", F.col("n"), F.lit("much refactoring"))


def classify_secrets(found: DataFrame, subject: str) -> DataFrame:
    return findings(found, "secret", "detectSecrets", F.lit("critical"), F.coalesce(F.col(subject), F.lit("unknown")), "exposed_secret", F.lit(None), F.col("masked"))


def classify_cycles(members: DataFrame) -> DataFrame:
    d = members.groupBy("cycle").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    return findings(d, "importCycle", "dartAst", F.lit("high"), F.col("cycle"), "import_cycle", F.size("nodes"), F.array_join("nodes", " -> "))


DOWN = {"critical": "high", "high": "moderate", "moderate": "elevated", "elevated": "low"}


def in_refactoring_context(found: DataFrame, renamed: DataFrame) -> DataFrame:
    """Findings on renamed files (old_file or file of `renamed`) one band lower, with a note."""
    names = renamed.select(S.path_key(F.col("file")).alias("__k")).unionByName(renamed.select(S.path_key(F.col("old_file")).alias("__k"))).where("__k is not null").distinct().withColumn("__hit", F.lit(True))
    d = found.join(names, S.path_key(found["subject"]) == names["__k"], "left")
    lower = reduce(lambda c, kv: c.when(F.col("severity") == kv[0], kv[1]), list(DOWN.items())[1:], F.when(F.col("severity") == "critical", DOWN["critical"])).otherwise(F.col("severity"))
    sev = F.when(F.col("__hit"), lower).otherwise(F.col("severity"))
    band = F.when(F.col("__hit"), F.concat("band", F.lit(" (renamed)"))).otherwise(F.col("band"))
    d = d.withColumn("severity", sev).withColumn("band", band)
    return d.withColumn("severity_rank", severity_rank(F.col("severity"))).select(*COLUMNS)


def compounds(found: DataFrame) -> DataFrame:
    """The eight rules over findings of different kinds."""
    of = lambda c: found.where(F.col("category") == c)
    first = lambda c, *tests: top_one(reduce(lambda d, t: d.where(t), tests, of(c)), ["subject"], [F.desc("severity_rank"), F.col("metric"), F.col("band")]).select("subject", F.struct("severity", "band").alias("other"))

    def make(d, metric, band, sources, severity="critical", subject=None, evidence=None):
        subject = F.col("subject") if subject is None else subject
        return findings(d, "compound", [*sources, "compound"], F.lit(severity), subject, metric, F.lit(len(sources) + 1), F.lit(band), evidence or {"severity": F.col("severity"), "band": F.col("band"), "other": F.col("other")})

    hot, owned, churn = of("bugHotspot"), of("ownership"), first("churn")
    single = F.col("severity_rank") >= RANK["critical"]
    rules = [
        make(hot.join(first("ownership", single), "subject"), "bug_hotspot_x_single_owner", "bug hotspot of a single owner", ["bugHotspots", "fileOwnership"]),
        make(of("complexity").where(F.col("severity_rank") >= RANK["high"]).join(churn, "subject"), "complexity_x_churn", "complex code that changes much", ["codeQuality"]),
        make(of("coupling").where((F.col("severity_rank") >= RANK["high"]) & (F.get_json_object("evidence", "$.cross_module") == "true")), "cross_module_coupling", "strong coupling across modules", ["logicalCoupling"], "high", evidence={"evidence": F.col("evidence")}),
        make(of("lexicalComplexity").where(F.col("severity_rank") >= RANK["high"]).join(churn, "subject"), "real_complexity_x_churn", "measured complexity in code that changes much", ["universalLexicalMetrics", "codeQuality"]),
        make(owned.where("metric = 'minor_contributor_count'").join(first("bugHotspot"), "subject"), "minor_contributors_x_hotspot", "many minor contributors on a bug hotspot", ["fileOwnership", "bugHotspots"], "high"),
    ]
    low = F.lower("subject")
    config = low.rlike("(pubspec\\.yaml|package\\.json|requirements\\.txt|go\\.mod|cargo\\.toml|gemfile)$") | F.contains(low, F.lit(".env")) | low.startswith("config/") | F.contains(low, F.lit("/config/"))
    stale = of("dependency").where(F.col("severity") == "critical").agg(F.array_sort(F.collect_list("subject")).alias("other")).where(F.size("other") > 0)
    rules.append(make(of("secret").where(config).crossJoin(F.broadcast(stale)), "stale_dependency_x_secret", "secret beside outdated dependencies", ["detectSecrets", "dependencyDrift"]))
    by_owner = owned.where((F.col("metric") == "single_author_ownership") & single).join(hot.select("subject").distinct(), "subject", "left_semi")
    risk = by_owner.groupBy(F.get_json_object("evidence", "$.top_author").alias("author")).agg(F.array_sort(F.collect_list("subject")).alias("files")).where((F.size("files") >= 2) & F.col("author").isNotNull())
    rules.append(make(risk, "knowledge_loss_risk", "one owner of several bug hotspots", ["fileOwnership", "bugHotspots"], subject=F.col("author"), evidence={"at_risk_files": F.col("files")}))
    tired = of("velocity").where((F.col("metric") == "burnout_commit_share") & (F.col("severity_rank") >= RANK["high"])).agg(F.count("*").alias("n")).where("n > 0")
    active = hot.where(F.col("severity_rank") >= MATERIAL).agg(F.array_sort(F.collect_list("subject")).alias("files")).where(F.size("files") > 0)
    rules.append(make(tired.crossJoin(active), "burnout_x_bug_introduction", "work out of hours beside bug hotspots", ["commitVelocity", "bugHotspots"], "high", subject=F.lit("repository"), evidence={"active_bug_hotspots": F.col("files")}))
    return union(rules)


def refactoring_targets(churn: DataFrame, complexity: DataFrame, lexical: DataFrame | None = None, top: int = 5, least: float = 0.25) -> DataFrame:
    """(file, score): rank of churn times rank of complexity; measured complexity before the proxy."""
    c = rank_share(churn.where(S.is_source_file(F.col("file"))).select("file", "changes"), "changes", "churn_rank")
    p = rank_share(complexity.select("file", "complexity"), "complexity", "r").select("file", F.struct(F.col("complexity").cast("double").alias("v"), "r").alias("proxy"))
    j = c.join(p, "file", "left")
    if lexical is not None:
        m = rank_share(lexical.select(F.col("path").alias("file"), "cyclomatic"), "cyclomatic", "r").select("file", F.struct(F.col("cyclomatic").cast("double").alias("v"), "r").alias("measured"))
        j = j.join(m, "file", "left").withColumn("best", F.coalesce("measured", "proxy"))
    else:
        j = j.withColumn("best", F.col("proxy"))
    out = j.where("best is not null").select("file", "changes", F.col("best.v").alias("complexity"), (F.col("churn_rank") * F.col("best.r")).alias("score"))
    return out.where(F.col("score") >= least).orderBy(F.desc("score"), "file").limit(top)


def ranked(found: DataFrame) -> DataFrame:
    """Findings by severity, compounds first, then value."""
    return found.orderBy(F.desc("severity_rank"), F.desc(F.col("category") == "compound"), F.desc(F.coalesce("value_num", F.lit(0.0))), "subject", "metric")


def severity_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("severity").agg(F.count("*").alias("n"))


def report(found: DataFrame, name: str, most: int = 8, most_compounds: int = 5, targets: DataFrame | None = None) -> DataFrame:
    """One row (report, payload): a bounded JSON document of the material findings."""
    both = written(found.unionByName(compounds(found)).where(F.col("severity_rank") >= MATERIAL))
    compound = F.col("category") == "compound"
    order = [F.desc("severity_rank"), F.desc(F.coalesce("value_num", F.lit(0.0))), "subject", "metric"]

    def top(test, k, name):
        """The first k of a kind: a bounded sort, then one array."""
        row = F.struct((-F.col("severity_rank")).alias("n"), (-F.coalesce("value_num", F.lit(0.0))).alias("v"), F.col("subject").alias("s"), F.col("metric").alias("m"), F.struct(*COLUMNS).alias("f"))
        return both.where(test).orderBy(*order).limit(k).agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["f"]).alias(name))

    body = top(~compound, most, "findings").crossJoin(top(compound, most_compounds, "compounds"))
    counts = both.groupBy("severity").agg(F.count("*").alias("c")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "c")))).alias("summary"))
    out = body.crossJoin(counts)
    if targets is not None:
        out = out.crossJoin(targets.agg(F.array_sort(F.collect_list(F.struct("file", "score"))).alias("refactoring_targets")))
    return out.select(F.lit(name).alias("report"), F.to_json(F.struct(*out.columns)).alias("payload"))
