"""Scalar expressions: Column in, Column out, all of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_pattern(words: str) -> str:
    """A case-insensitive pattern of whole ASCII words."""
    return f"(?i)(^|[^A-Za-z0-9_])({words})($|[^A-Za-z0-9_])"


FIX_WORDS = "fix|fixes|fixed|fixing|bug|bugs|patch|issue|resolve|resolves|resolved"
NOT_FIX_WORDS = "typo|docs?|documentation|readme|format|formatting|style|cleanup|refactor"
REFACTOR_WORDS = "refactor|rewrite|restructure|clean|cleanup"
REFACTOR_SUBJECT_WORDS = (
    "refactor(ing|ed)?|rewrite|rewrote|rename(d|s)?|restructure(d)?|reformat(ted)?|format(ting)?|style|clean|cleanup|clean-up|"
    "move(d)?|extract(ed)?|inline(d)?"
)
SUSPICIOUS_WORDS = (
    "password|passwd|secret|api_key|apikey|credentials|creds|bypass|backdoor|hack|workaround|kludge|temporary|temp|wip|fixme|fix me|"
    "todo|to-do|do not touch|dont touch|magic|dirty|ugly|hotfix|quick fix|oops|wtf"
)
CONVENTIONAL = "(?i)^(build|chore|ci|docs|feat|fix|perf|refactor|revert|style|test)(\\([a-z0-9\\-]+\\))?!?: .+"
CONVENTIONAL_LOG = "(?i)^(build|chore|ci|docs|feat|fix|perf|refactor|revert|style|test)(\\([^)]+\\))?!?:\\s*(.+)$"


def is_fix(subject: Column) -> Column:
    return subject.rlike(word_pattern(FIX_WORDS)) & ~subject.rlike(word_pattern(NOT_FIX_WORDS))


def path_key(path: Column) -> Column:
    """Trim, turn back-slashes, strip one leading a/ or b/, then leading ./ and /."""
    p = F.regexp_replace(F.trim(path), "\\\\", "/")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(p, "^[ab]/", ""), "^(\\./)+", ""), "^/+", "")


def top_dir(path: Column) -> Column:
    key = path_key(path)
    return F.when(F.instr(key, "/") > 0, F.substring_index(key, "/", 1)).otherwise("")


def extension(path: Column) -> Column:
    """The last dot of the whole path and what follows, unless it is the first or last character."""
    e = F.regexp_extract(path, "^.+(\\.[^.]+)$", 1)
    return F.when(e != "", e).otherwise("no_extension")


def repository_name(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def days_between(a: Column, b: Column, signed: bool = False) -> Column:
    """Whole minutes between two times over 1440."""
    seconds = F.unix_timestamp(b) - F.unix_timestamp(a)
    minutes = F.floor(F.abs(seconds) / 60)
    if signed:
        minutes = minutes * F.signum(seconds.cast("double"))
    return minutes / 1440.0


def tolerant_shortstat(line: Column) -> Column:
    """struct(files, insertions, deletions) of a summary line; missing parts are 0."""
    part = lambda p: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(line, p, 1), F.lit("")), F.lit("999999999")).cast("long"), F.lit(0))
    return F.struct(part("(\\d+) files? changed").alias("files"), part("(\\d+) insertion").alias("insertions"), part("(\\d+) deletion").alias("deletions"))


def strict_shortstat(line: Column) -> Column:
    """The same, with -1 for all three unless the line has all three."""
    s = tolerant_shortstat(line)
    whole = line.rlike("files? changed") & line.rlike("insertion") & line.rlike("deletion")
    return F.struct(*[F.when(whole, s[k]).otherwise(-1).alias(k) for k in ("files", "insertions", "deletions")])


def semver(text: Column) -> Column:
    """struct(major, minor, patch) of x.y.z after one prefix of ^ ~ >= <= > < = v; null otherwise."""
    bare = F.regexp_replace(F.trim(text), "^(\\^|~|>=|<=|>|<|=|v)", "")
    part = lambda i: F.regexp_extract(bare, "^(\\d{1,9})\\.(\\d{1,9})\\.(\\d{1,9})$", i)
    return F.when(bare.rlike("^\\d{1,9}\\.\\d{1,9}\\.\\d{1,9}$"), F.struct(*[part(i).cast("int").alias(k) for i, k in ((1, "major"), (2, "minor"), (3, "patch"))]))


def freshness(declared: Column, latest: Column) -> Column:
    """major, minor or patch behind, current, or unknown."""
    a, b = semver(declared), semver(latest)
    same = (a["major"] == b["major"]) & (a["minor"] == b["minor"])
    return (
        F.when(a.isNull() | b.isNull(), "unknown").when(b["major"] > a["major"], "major").when((a["major"] == b["major"]) & (b["minor"] > a["minor"]), "minor")
        .when(same & (b["patch"] > a["patch"]), "patch").otherwise("current")
    )


def owners_match(pattern: Column, path: Column) -> Column:
    """The five forms of an ownership pattern."""
    tail = F.substr(pattern, F.lit(2))
    return (
        F.when(pattern == "*", True).when(pattern.startswith("*."), path.endswith(tail))
        .when(pattern.startswith("/"), path.startswith(tail))
        .when(pattern.endswith("/"), path.startswith(pattern) | F.contains(path, F.concat(F.lit("/"), pattern)))
        .otherwise((path == pattern) | path.endswith(F.concat(F.lit("/"), pattern)) | path.startswith(F.concat(pattern, F.lit("/"))))
    )


NOT_SOURCE = "md|txt|json|yaml|yml|lock|png|jpg|jpeg|gif|svg|ico|pdf|csv|xml|html|css|toml|ini|cfg|log|map|min"


def is_source_file(path: Column) -> Column:
    """Not of a known data, document or media extension; no extension or a leading dot is source."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    dot = F.length(name) - F.length(F.substring_index(name, ".", -1))
    return F.when(dot <= 1, True).otherwise(~name.rlike(f"\\.({NOT_SOURCE})$"))


def entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters, in bits."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.aggregate(F.array_sort(F.array_distinct(chars)), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))


def git_timestamp(text: Column) -> Column:
    """struct(utc, local): the instant and the author's wall clock of an ISO time with offset; null for other text."""
    plain = F.regexp_replace(F.trim(text), " ([+-]\\d{2}):?(\\d{2})$", "$1:$2")
    return F.struct(plain.try_cast("timestamp").alias("utc"), F.substring(plain, 1, 19).try_cast("timestamp_ntz").alias("local"))


def is_date_argument(text: str) -> bool:
    """Whether a date filter is an ISO date, `N units ago` or yesterday."""
    import re

    return bool(re.fullmatch(r"\d{4}-\d{2}-\d{2}([T ][\d:]+(Z|[+-]\d{2}:?\d{2})?)?|\d+ (second|minute|hour|day|week|month|year)s? ago|yesterday", text.strip()))
