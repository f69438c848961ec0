"""Churn, volatility, ownership of commits and files, hygiene filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.windows import threshold_prefix
from ..sources.session import written


def commit_window(commits: DataFrame, since=None, until=None, limit: int | None = None, newer_than: int | None = None, up_to: int | None = None) -> DataFrame:
    """Commits of a time window or of a range of positions, newest `limit` ones; taken before any join."""
    out = commits
    for test in (since is not None and F.col("ts") >= since, until is not None and F.col("ts") <= until, newer_than is not None and F.col("seq") > newer_than, up_to is not None and F.col("seq") <= up_to):
        if test is not False:
            out = out.where(test)
    return out.orderBy(F.desc("seq")).limit(limit) if limit is not None else out


def target_files(changes: DataFrame, targets: DataFrame) -> DataFrame:
    """Changes of exactly the target files."""
    return changes.join(targets.select("file").distinct(), "file", "left_semi")


def file_churn(changes: DataFrame) -> DataFrame:
    """(file, changes): commits that list a file."""
    return changes.groupBy("file").agg(F.count("*").alias("changes"))


def churn_by_author(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """(file, author, changes)."""
    return changes.select("rev", "file").join(commits.select("rev", "author"), "rev").groupBy("file", "author").agg(F.count("*").alias("changes"))


def churn_with_authors(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """(file, total, authors): authors is a map of changes by author."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("author", "changes"))))
    return churn_by_author(commits, changes).groupBy("file").agg(F.sum("changes").alias("total"), entries.alias("authors"))


def volatility(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """(file, changes, authors, score): changes times distinct authors with a name."""
    by_author = churn_by_author(commits, changes)
    out = by_author.groupBy("file").agg(F.sum("changes").alias("changes"), F.count(F.nullif("author", F.lit(""))).alias("authors"))
    return out.withColumn("score", F.col("changes") * F.col("authors"))


def bus_factor(commits: DataFrame, by: list[str] | None = None, share: float = 0.5) -> DataFrame:
    """The fewest authors who made `share` of the commits, most active first."""
    by = by or []
    counts = commits.groupBy(*by, "author").agg(F.count("*").alias("commits"))
    return threshold_prefix(counts, by, "commits", [F.desc("commits"), F.col("author")], share)


def file_bus_factor(commits: DataFrame, changes: DataFrame, targets: DataFrame, share: float = 0.5) -> DataFrame:
    """(file, bus_factor, developers) of every target, also of those never changed."""
    each = churn_by_author(commits, target_files(changes, targets)).groupBy("file").agg(F.sort_array(F.collect_list("changes"), asc=False).alias("n"), F.sum("changes").alias("total"))
    pair = lambda sum_, k: F.struct(sum_.cast("long").alias("s"), k.cast("long").alias("k"))
    step = lambda a, x: F.when(a["s"] < share * F.col("total"), pair(a["s"] + x, a["k"] + 1)).otherwise(a)
    each = each.select("file", F.aggregate("n", pair(F.lit(0), F.lit(0)), step)["k"].alias("bus_factor"), F.size("n").cast("long").alias("developers"))
    out = targets.select("file").distinct().join(each, "file", "left")
    return out.select("file", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("bus_factor", "developers")])


def mega_commits(commits: DataFrame, changes: DataFrame, lines: int = 500, files: int = 20) -> DataFrame:
    """Commits of at least so many changed lines or files, with a line that describes them."""
    size = changes.groupBy("rev").agg(F.count("*").alias("files"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"))
    big = size.where((F.col("insertions") + F.col("deletions") >= lines) | (F.col("files") >= files))
    text = F.concat("rev", F.lit(" - "), "author", F.lit(" ("), F.date_format("ts", "yyyy-MM-dd"), F.lit("): "), "subject")
    return big.join(commits, "rev").select("rev", "files", "insertions", "deletions", text.alias("described"))


def suspicious_commits(commits: DataFrame, diff_lines: DataFrame | None = None) -> DataFrame:
    """Commits with a warning word in the subject, or else in an added line."""
    pattern = S.word_pattern(S.SUSPICIOUS_WORDS)
    hit = F.col("subject").rlike(pattern)
    if diff_lines is None:
        return commits.where(hit).select("rev", "author", "subject")
    lines = diff_lines.where((F.col("op") == "+") & F.col("content").rlike(pattern)).select("rev").distinct().withColumn("__line", F.lit(True))
    return commits.join(lines, "rev", "left").where(hit | F.col("__line").isNotNull()).select("rev", "author", "subject")


COMMENT = "(//|/\\*|\\*/|^\\s*\\*\\s|#\\s|<!--|--\\s|^\\s*#)"
DOCS_ONLY = "(?i)^(docs|readme|documentation|chore\\(docs\\)):?"


def changed_comments(commits: DataFrame, diff_lines: DataFrame) -> DataFrame:
    """(rev, file, hunk, block): hunks with an added comment, of commits not about documents only."""
    worth = commits.where(~F.coalesce(F.col("subject").rlike(DOCS_ONLY), F.lit(False))).select("rev")
    hunks = diff_lines.join(worth, "rev", "left_semi").groupBy("rev", "file", "hunk").agg(
        F.bool_or((F.col("op") == "+") & F.col("content").rlike(COMMENT)).alias("commented"),
        F.array_sort(F.collect_list(F.struct("line_seq", F.concat("op", "content").alias("line")))).alias("lines"),
    )
    return hunks.where("commented").select("rev", "file", "hunk", F.array_join("lines.line", "\n").alias("block"))


def high_churn(commits: DataFrame, changes: DataFrame, share: float = 0.1, top: int = 5) -> DataFrame:
    """The files changed by at least `share` of the commits, the `top` ones."""
    total = commits.agg(F.count("*").alias("__total"))
    out = file_churn(changes).crossJoin(F.broadcast(total)).where((F.col("__total") > 0) & (F.col("changes") >= F.ceil(F.col("__total") * share)))
    return out.orderBy(F.desc("changes"), "file").limit(top).drop("__total")


def contributions(commits: DataFrame) -> DataFrame:
    """(author, commits), merges left out."""
    return commits.where(~F.col("is_merge")).groupBy("author").agg(F.count("*").alias("commits"))


def range_summary(changes: DataFrame) -> DataFrame:
    """One row: files, insertions and deletions of a set of changes."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return changes.agg(F.countDistinct("file").alias("files"), zero("insertions"), zero("deletions"))


def stats_by_extension(changes: DataFrame) -> DataFrame:
    return changes.groupBy(S.extension(F.col("file")).alias("extension")).agg(F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"))


def release_delta(commits: DataFrame, changes: DataFrame, top: int = 10) -> DataFrame:
    """The files with most changed lines among some commits."""
    inside = changes.join(commits.select("rev"), "rev", "left_semi")
    sums = inside.groupBy("file").agg(F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"))
    return sums.withColumn("changed", F.col("insertions") + F.col("deletions")).orderBy(F.desc("changed"), "file").limit(top)


def release_summary(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """One row: commits, insertions, deletions, files and contributors of some commits."""
    inside = changes.join(commits.select("rev"), "rev", "left_semi")
    return commits.agg(F.count("*").alias("commits"), F.countDistinct("author").alias("contributors")).crossJoin(range_summary(inside))


def with_blast_radius(files: DataFrame, hotspots: DataFrame, matrix: DataFrame, most: int = 3) -> DataFrame:
    """Files with a flag for bug hotspots, and the first files by name that change together with them.

    matrix: (a, b, ...), as `coupling.cochange_matrix` gives it; only partners of `files` are kept.
    """
    near = matrix.join(F.broadcast(files.select(F.col("file").alias("a"))), "a", "left_semi").groupBy("a").agg(F.slice(F.array_sort(F.collect_set("b")), 1, most).alias("blast_radius"))
    hot = hotspots.select("file").distinct().withColumn("is_bug_hotspot", F.lit(True))
    out = files.join(hot, "file", "left").join(near, F.col("file") == F.col("a"), "left").drop("a")
    return out.withColumn("is_bug_hotspot", F.coalesce("is_bug_hotspot", F.lit(False))).withColumn("blast_radius", F.coalesce("blast_radius", F.array().cast("array<string>")))


def refactorings(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """Commits that rename, that simplify (over 50 deletions, insertions under a fifth), or say so."""
    each = changes.groupBy("rev").agg(
        F.array_sort(F.collect_list(F.when(F.col("status").startswith("R"), F.concat("old_file", F.lit(" -> "), "file")))).alias("renamed"),
        F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"),
    )
    out = commits.join(each, "rev", "left").select(
        "rev", "subject", F.coalesce("renamed", F.array().cast("array<string>")).alias("renamed"), F.coalesce("insertions", F.lit(0)).alias("insertions"), F.coalesce("deletions", F.lit(0)).alias("deletions"))
    out = out.withColumn("simplifies", (F.col("deletions") > 50) & (F.col("insertions") < 0.2 * F.col("deletions")))
    return out.where(F.col("subject").rlike(S.word_pattern(S.REFACTOR_WORDS)) | (F.size("renamed") > 0) | F.col("simplifies"))


def proxy_complexity(diff_lines: DataFrame) -> DataFrame:
    """(file, complexity): control words in added lines; the sign of the line counts as part of it."""
    n = F.regexp_count(F.concat("op", "content"), F.lit(r"\b(if|for|while|switch|&&|\|\||\?)\b"))
    return diff_lines.where("op = '+'").groupBy("file").agg(F.sum(n).alias("complexity")).where("complexity > 0")


def directory_shares(changes: DataFrame) -> DataFrame:
    """(directory, touches, share) over files in a directory."""
    d = changes.where(F.instr("file", "/") > 0).groupBy(F.substring_index("file", "/", 1).alias("directory")).agg(F.count("*").alias("touches"))
    return d.withColumn("share", F.col("touches") / F.sum("touches").over(W.partitionBy(F.lit(1))))


def file_history(changes: DataFrame, file: str) -> DataFrame:
    """Changes of a file under its names before renames, each older name one step further, to the first one."""
    renames = written(changes.where("old_file is not null").select(F.col("file").alias("__new"), F.col("old_file").alias("__old")).distinct())
    known = names = changes.sparkSession.createDataFrame([(file,)], "file string")
    while True:
        names = written(names.join(renames, names["file"] == renames["__new"]).select(F.col("__old").alias("file")).join(known, "file", "left_anti").distinct())
        if not names.take(1):
            return changes.join(F.broadcast(known), "file", "left_semi")
        known = known.unionByName(names)


def between_refs(commits: DataFrame, parents: DataFrame, a: str, b: str) -> DataFrame:
    """Commits reachable from one of two revisions but not from both.

    What lies 2^k parents back is joined with itself, so the rounds grow with the logarithm of the
    history's depth; each is checkpointed. They end when a round reaches nothing new: a commit that is its
    own ancestor has parents at any distance. A revision that isn't known reaches nothing.
    """
    jump = written(parents.where("parent is not null").select("rev", F.col("parent").alias("up")).distinct())
    seed = commits.sparkSession.createDataFrame([(a, True, False), (b, False, True)], "rev string, a boolean, b boolean")
    both = lambda df: df.groupBy("rev").agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b"))
    seen, known = written(both(seed)), 2
    while True:
        seen = written(both(seen.unionByName(seen.join(jump, "rev").select(F.col("up").alias("rev"), "a", "b"))))
        now = seen.agg(F.count_if("a") + F.count_if("b")).first()[0]
        if now == known:
            return commits.join(seen.where("a <> b"), "rev", "left_semi")
        known = now
        jump = written(jump.select("rev", F.col("up").alias("mid")).join(jump.select(F.col("rev").alias("mid"), "up"), "mid").select("rev", "up").distinct())


def tags_between(refs: DataFrame, old: str, new: str) -> DataFrame:
    """Tags in the order of their names after `old` up to `new`; up to the last one without `new`."""
    tags = refs.where("kind = 'tag'").select("name")
    has = tags.where(F.col("name") == new).limit(1).count()
    out = tags.where(F.col("name") > old)
    return (out.where(F.col("name") <= new) if has else out).orderBy("name")


def repository_health(commits: DataFrame) -> DataFrame:
    """One row: commits, last time, last subject."""
    return commits.agg(F.count("*").alias("commits"), F.max("ts").alias("last_ts"), F.max_by("subject", "seq").alias("last_subject"))


def ownership(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """(file, top_author, top_changes, total, minor): the main author and those under 5 percent."""
    each = churn_by_author(commits, changes).groupBy("file").agg(
        F.min(F.struct((-F.col("changes")).alias("n"), "author")).alias("top"), F.sum("changes").alias("total"), F.collect_list("changes").alias("each"))
    minor = F.size(F.filter("each", lambda x: x < 0.05 * F.col("total"))).cast("long")
    return each.select("file", F.col("top.author").alias("top_author"), (-F.col("top.n")).alias("top_changes"), "total", minor.alias("minor"))


def ownership_drift(long: DataFrame, recent: DataFrame) -> DataFrame:
    """Main author over a long and a recent window; drifted where both exist and differ."""
    a = long.select("file", F.col("top_author").alias("long_owner"), F.col("total").alias("changes"))
    b = recent.select("file", F.col("top_author").alias("recent_owner"))
    out = a.join(b, "file", "left").withColumn("recent_owner", F.coalesce("recent_owner", F.lit("")))
    return out.withColumn("drifted", (F.col("recent_owner") != "") & (F.col("recent_owner") != F.col("long_owner")))


def declared_owners(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(file, owners): of the rules that match a file the last one; rules are a small table."""
    pairs = files.select("file").distinct().join(F.broadcast(rules), S.owners_match(F.col("pattern"), F.col("file")), "left")
    return pairs.groupBy("file").agg(F.max_by("owners", "rule_idx").alias("owners"))


def ownership_summary(drift: DataFrame, declared: DataFrame) -> DataFrame:
    """One row: files, files whose owner changed, files that no rule owns."""
    a = drift.agg(F.count("*").alias("files"), F.count_if("drifted").alias("drifted"))
    return a.crossJoin(declared.agg(F.count_if(F.col("owners").isNull()).alias("unowned")))
