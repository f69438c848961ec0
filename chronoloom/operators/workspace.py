"""Refs, single commits, paths inside a root, signatures of sources, guidance for findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import history

#: Scans that only read; a source of logs takes no other.
READING = frozenset("blame branch cat-file describe diff log ls-files merge-base rev-list rev-parse shortlog show status tag".split())


def check_scan(name: str) -> str:
    """The name of a scan that only reads; raises for any other."""
    if name not in READING:
        raise ValueError(f"not a scan that only reads: {name}")
    return name


def branches(refs: DataFrame, current: str | None = None) -> DataFrame:
    """(name, is_current) of branches; a leading mark of the current one is no part of its name."""
    name = F.regexp_replace(F.trim("name"), "^\\* ", "")
    marked = F.trim("name").startswith("* ")
    return refs.where("kind = 'branch'").select(name.alias("name"), (marked if current is None else name == current).alias("is_current"))


def show(commits: DataFrame, rev: str) -> DataFrame:
    """The commit of a revision; no row if there is none."""
    return commits.where(F.col("rev") == rev).limit(1)


def health(commits: DataFrame, refs: DataFrame, status: DataFrame, current: str | None = None) -> DataFrame:
    """One row: commits, last time and subject, the current branch, and whether anything isn't committed."""
    branch = branches(refs, current).agg(F.max(F.when(F.col("is_current"), F.col("name"))).alias("branch"))
    dirty = status.agg((F.count("*") > 0).alias("dirty"))
    return history.repository_health(commits).crossJoin(branch).crossJoin(dirty)


def normal_path(path: Column) -> Column:
    """A path without . and empty parts; .. takes the part before it, and stays where there is none."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    none = F.array().cast("array<string>")

    def step(s, x):
        up = (x == "..") & (F.size(s) > 0) & (F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit("..")) != "..")
        return F.when(up, F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(x)))

    return F.array_join(F.aggregate(parts, none, step), "/")


def inside(path: Column, root: str) -> Column:
    """Whether a path, relative to the root or absolute, lies inside it."""
    top = "/".join(p for p in root.split("/") if p)
    whole = normal_path(F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(f"/{top}/"), path)))
    return whole.startswith(top + "/") if top else ~whole.startswith("..")


def under(path: Column, prefix: str) -> Column:
    """Whether a path lies in a layer given by its directory, which is no pattern."""
    return path.startswith(prefix.rstrip("/") + "/")


SIGNATURE = r"(?m)^[ \t]*(?:(?:static|final|async|public|private|protected|override)[ \t]+)*[A-Za-z_][\w<>?,\[\]]*[ \t]+([A-Za-z_]\w*)[ \t]*\([^;{}=]*\)[ \t]*(?:async[ \t]*)?(?:\{|=>)"
CALL = r"\b([A-Za-z_]\w*)[ \t]*\("
_NO_CALL = ("if", "for", "while", "switch", "catch", "return", "assert", "super", "this", "function", "do", "else")


def signatures(files: DataFrame) -> DataFrame:
    """(path, name, is_private) of functions that source texts define: by pattern, not by a parser."""
    found = files.select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(SIGNATURE), 1))).alias("name"))
    return found.where(~F.col("name").isin(*_NO_CALL)).withColumn("is_private", F.col("name").startswith("_"))


def invocations(files: DataFrame) -> DataFrame:
    """(path, name, calls): names before a bracket, definitions left out."""
    found = files.select("path", F.explode(F.regexp_extract_all("content", F.lit(CALL), 1)).alias("name")).where(~F.col("name").isin(*_NO_CALL))
    each = found.groupBy("path", "name").agg(F.count("*").alias("n"))
    own = signatures(files).select("path", "name", F.lit(1).alias("__own"))
    out = each.join(own, ["path", "name"], "left").withColumn("calls", F.col("n") - F.coalesce("__own", F.lit(0)))
    return out.where("calls > 0").select("path", "name", "calls")


def changed_sources(changes: DataFrame, files: DataFrame, suffix: str = ".dart", most: int = 10) -> DataFrame:
    """The first `most` source files by name that some changes touch, with their texts."""
    names = changes.where(F.col("file").endswith(suffix)).select(F.col("file").alias("path")).distinct().orderBy("path").limit(most)
    return files.join(F.broadcast(names), "path", "left_semi")


#: What to judge of a comment, by aspect.
CRITERIA = {
    "accuracy": "says what the code does now",
    "reason": "gives a reason that the code can't show",
    "length": "is no longer than what it explains needs",
    "audience": "can be understood without the history of the change",
}


def comments_to_judge(commits: DataFrame, diff_lines: DataFrame, aspects: tuple = tuple(CRITERIA)) -> DataFrame:
    """Changed comments, a row for each aspect with what to judge; the judgement is the reader's."""
    pairs = [F.struct(F.lit(a).alias("aspect"), F.lit(CRITERIA[a]).alias("criterion")) for a in aspects]
    return history.changed_comments(commits, diff_lines).select("*", F.inline(F.array(*pairs)))


#: Guidance by source of findings: what a finding means, and what to do.
HINTS = {
    "busFactor": ("work rests on few people", "pair on what only one person knows"),
    "fileOwnership": ("a file has one main author, or many passing ones", "name a second owner and review changes together"),
    "bugHotspots": ("bugs come back here, or live long", "test before the next change, then simplify"),
    "codeQuality": ("much change meets complex code", "split the file where it changes most"),
    "codeVolatility": ("many people change this often", "look for a part that wants its own module"),
    "logicalCoupling": ("files change together", "put what changes together in one place, or cut the link"),
    "dependencyDrift": ("versions are behind", "update major versions one at a time"),
    "compliance": ("commits miss a rule", "check the rule before a push"),
    "universalLexicalMetrics": ("a text is hard to follow", "extract the worst block into a function"),
    "cleanCode": ("a file is long, deep or repeats itself", "remove copies first"),
    "commitVelocity": ("the pace or its spread changed", "ask before you conclude: numbers show no reasons"),
    "architectureDrift": ("commits cross layers", "move shared parts below both"),
    "refactoring": ("much is being rebuilt", "expect findings on moved files to fade"),
    "detectSecrets": ("a secret may be in the text", "revoke it, then remove it from the history"),
    "dartAst": ("sources import one another in a circle", "turn one import around by an interface"),
    "mega_commits": ("a commit is too large to review", "send smaller ones"),
    "suspicious_commits": ("a subject or line warns", "read it"),
    "compound": ("two signals meet", "begin here"),
}


def with_hints(found: DataFrame) -> DataFrame:
    """Findings with (source, meaning, advice) for each of their sources that has guidance; the table of hints is fixed."""
    hints = found.sparkSession.createDataFrame([(k, *v) for k, v in HINTS.items()], "source string, meaning string, advice string")
    return found.withColumn("source", F.explode("source")).join(F.broadcast(hints), "source")


class Registry:
    """Results of a session by name, as views that its SQL can read."""

    def __init__(self, spark):
        self.spark, self.names = spark, {}

    def register(self, name: str, df: DataFrame) -> str:
        view = "resource_" + "".join(c if c.isalnum() else "_" for c in name.lower())
        df.createOrReplaceTempView(view)
        self.names[name] = view
        return view

    def read(self, name: str) -> DataFrame:
        if name not in self.names:
            raise KeyError(name)
        return self.spark.table(self.names[name])
