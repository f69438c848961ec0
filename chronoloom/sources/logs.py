"""Relations from the text that version control prints, parsed by built-in functions only.

Records are kept apart by U+001E and fields by U+001F, which logs are told to print; a file of any
size is split at records by the reader. Bytes that aren't UTF-8 become U+FFFD.

LOG_FORMAT with --numstat gives commits and file_changes, PATCH_FORMAT with --patch diff_lines, and
blame with --line-porcelain blame_lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S

RECORD, FIELD = "\x1e", "\x1f"
LOG_FORMAT = "%x1e%H%x1f%P%x1f%an%x1f%ae%x1f%G?%x1f%aI%x1f%s%x1f"
PATCH_FORMAT = "%x1e%H%x1f"


def records(spark: SparkSession, path: str) -> DataFrame:
    """(value): the records of a log, in files of any number."""
    return spark.read.option("lineSep", RECORD).text(path).where(F.trim("value") != "")


def _fields(df: DataFrame, names: list[str]) -> DataFrame:
    """The last field takes what is left, separators too."""
    parts = F.split("value", FIELD, len(names))
    return df.select(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])


LOG_FIELDS = ["rev", "parents", "author", "email", "sig", "when", "subject", "tail"]


def commits(log: DataFrame) -> DataFrame:
    """commits, without seq; parents is an array. Empty authors stay empty."""
    d = _fields(log, LOG_FIELDS)
    parents = F.filter(F.split(F.trim("parents"), " "), lambda p: p != "")
    t = S.git_timestamp(F.col("when"))
    return d.select(F.trim("rev").alias("rev"), parents.alias("parents"), "author", "email", "sig", t["utc"].alias("ts"), t["local"].alias("ts_local"), "subject", (F.size(parents) > 1).alias("is_merge"))


def file_changes(log: DataFrame) -> DataFrame:
    """file_changes of a numeric summary; '-' for binary files counts as 0 lines."""
    lines = _fields(log, LOG_FIELDS).select(F.trim("rev").alias("rev"), F.explode(F.split("tail", "\r?\n")).alias("line")).where(F.col("line").rlike("^(\\d+|-)\t(\\d+|-)\t."))
    cells = F.split("line", "\t", 3)
    name = F.get(cells, F.lit(2))
    braces = "^(.*)\\{(.*) => (.*)\\}(.*)$"
    side = lambda i: F.when(name.rlike(braces), F.regexp_replace(F.concat(F.regexp_extract(name, braces, 1), F.regexp_extract(name, braces, i), F.regexp_extract(name, braces, 4)), "//+", "/")).when(F.instr(name, " => ") > 0, F.get(F.split(name, " => "), F.lit(i - 2)))
    number = lambda i: F.coalesce(F.get(cells, F.lit(i)).try_cast("bigint"), F.lit(0).cast("bigint"))
    return lines.select("rev", F.coalesce(side(3), name).alias("file"), side(2).alias("old_file"), F.when(side(2).isNotNull(), "R").otherwise("M").alias("status"), number(0).alias("insertions"), number(1).alias("deletions"))


def diff_lines(patches: DataFrame) -> DataFrame:
    """diff_lines of patches: deleted and unchanged lines with their number before the commit."""
    d = _fields(patches, ["rev", "patch"]).select(F.trim("rev").alias("rev"), F.posexplode(F.split("patch", "\n")).alias("line_seq", "line"))
    run = W.partitionBy("rev").orderBy("line_seq").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("part", F.sum(F.when(F.col("line").startswith("diff --git "), 1).otherwise(0)).over(run))
    inside = W.partitionBy("rev", "part").orderBy("line_seq").rowsBetween(W.unboundedPreceding, 0)
    hunk = "^@@ -(\\d+)(?:,\\d+)? \\+\\d+(?:,\\d+)? @@"
    d = d.withColumn("hunk", F.sum(F.when(F.col("line").rlike(hunk), 1).otherwise(0)).over(inside).cast("int"))
    name = lambda sign: F.last(F.when((F.col("hunk") == 0) & F.col("line").startswith(sign + " "), F.regexp_extract("line", "^... (?:[ab]/)?([^\t]*)", 1)), ignorenulls=True).over(inside)
    start = F.last(F.when(F.col("line").rlike(hunk), F.regexp_extract("line", hunk, 1).try_cast("int")), ignorenulls=True).over(inside)
    d = d.withColumn("after", name("+++")).withColumn("before", name("---")).withColumn("old_start", start)
    d = d.where((F.col("hunk") > 0) & F.col("line").rlike("^[+ -]")).withColumn("op", F.substring("line", 1, 1))
    old = F.col("op").isin("-", " ")
    run = W.partitionBy("rev", "part", "hunk").orderBy("line_seq").rowsBetween(W.unboundedPreceding, 0)
    number = F.when(old, F.col("old_start") + F.sum(F.when(old, 1).otherwise(0)).over(run) - 1).cast("int")
    gone = F.col("after") == "/dev/null"
    return d.select("rev", F.when(gone, F.col("before")).otherwise(F.col("after")).alias("file"), F.col("before").alias("old_file"), "hunk", "line_seq", "op", number.alias("old_line"), F.expr("substring(line, 2)").alias("content"))


def blame_lines(blames: DataFrame) -> DataFrame:
    """blame_lines of (rev, file, text); a boundary's ^ is dropped."""
    d = blames.select("rev", "file", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    head = "^\\^?([0-9a-f]{7,64}) \\d+ (\\d+)( \\d+)?$"
    run = W.partitionBy("rev", "file").orderBy("p").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("n", F.sum(F.when(F.col("line").rlike(head), 1).otherwise(0)).over(run)).where("n > 0")
    first = lambda pattern, group: F.max(F.when(F.col("line").rlike(pattern), F.regexp_extract("line", pattern, group)))
    each = d.groupBy("rev", "file", "n").agg(first(head, 1).alias("intro_rev"), first(head, 2).cast("int").alias("line_no"), first("^author (.*)$", 1).alias("intro_author"), first("^author-time (\\d+)$", 1).alias("t"))
    return each.select("rev", "file", "line_no", "intro_rev", "intro_author", F.timestamp_seconds(F.col("t").cast("bigint")).alias("intro_ts"))


def status(lines: DataFrame) -> DataFrame:
    """(kind, file) of porcelain status lines: staged, unstaged, untracked; a file may be two."""
    x, y, name = F.substring("value", 1, 1), F.substring("value", 2, 1), F.expr("substring(value, 4)")
    kinds = F.when(x == "?", F.array(F.lit("untracked"))).otherwise(F.array_compact(F.array(F.when(x != " ", F.lit("staged")), F.when(y != " ", F.lit("unstaged")))))
    return lines.where(F.length("value") > 3).select(F.explode(kinds).alias("kind"), name.alias("file"))


def shortlog(lines: DataFrame) -> DataFrame:
    """(author, commits) of a summary of authors."""
    p = "^\\s*(\\d+)\\s+(.+?)(?: <[^>]*>)?$"
    return lines.where(F.col("value").rlike(p)).select(F.regexp_extract("value", p, 2).alias("author"), F.regexp_extract("value", p, 1).cast("bigint").alias("commits"))
