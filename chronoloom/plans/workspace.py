"""Queries over refs, renames, patches, manifests and findings, each with SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import coupling, findings, history, security, szz, text, velocity, workspace
from .queries import _FIX, _NOTFIX, _OWN, _OWNERSHIP, _PAIRS, _W, CF, _m, query


@query("""WITH p AS (SELECT rev, parent FROM parents), ra AS (WITH RECURSIVE r(rev) AS (SELECT '1008' UNION SELECT parent FROM p JOIN r USING (rev)) SELECT rev FROM r),
rb AS (WITH RECURSIVE r(rev) AS (SELECT '704' UNION SELECT parent FROM p JOIN r USING (rev)) SELECT rev FROM r)
SELECT rev, author, subject FROM commits WHERE (rev IN (SELECT rev FROM ra)) <> (rev IN (SELECT rev FROM rb))""", "commits", "parents")
def commits_between_refs(r, spark, d):
    return history.between_refs(r("commits"), r("parents"), "1008", "704").select("rev", "author", "subject")


@query("WITH n AS (WITH RECURSIVE n(file) AS (SELECT 'n190' UNION SELECT old_file FROM renamed JOIN n USING (file) WHERE old_file IS NOT NULL) SELECT file FROM n) SELECT rev, file, old_file FROM renamed WHERE file IN (SELECT file FROM n)", "renamed")
def history_of_file(r, spark, d):
    return history.file_history(r("renamed"), "n190").select("rev", "file", "old_file")


@query("SELECT name FROM refs WHERE kind = 'tag' AND name > 'vNATION_12' AND (name <= 'vNATION_3' OR NOT EXISTS (SELECT 1 FROM refs WHERE kind = 'tag' AND name = 'vNATION_3'))", "refs")
def tags_between(r, spark, d):
    return history.tags_between(r("refs"), "vNATION_12", "vNATION_3")


_SIZES = "SELECT count(*) AS commits, count(DISTINCT author) AS contributors FROM commits WHERE seq > 1000 AND seq <= 9000"


@query(f"""SELECT * FROM ({_SIZES}), (SELECT count(DISTINCT file) AS files, coalesce(sum(insertions), 0)::BIGINT AS insertions, coalesce(sum(deletions), 0)::BIGINT AS deletions FROM file_changes JOIN commits USING (rev) WHERE seq > 1000 AND seq <= 9000)""", *CF)
def release_summary(r, spark, d):
    return history.release_summary(history.commit_window(r("commits"), newer_than=1000, up_to=9000), r("file_changes"))


@query(f"""WITH {_PAIRS}, x AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
t AS (SELECT file, (sum(insertions) + sum(deletions))::BIGINT AS changed FROM file_changes JOIN commits USING (rev) WHERE seq > 1000 AND seq <= 9000 GROUP BY file ORDER BY changed DESC, file LIMIT 10),
n AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY b) AS n FROM (SELECT DISTINCT a, b FROM x WHERE a IN (SELECT file FROM t)))
SELECT file, changed, contains(file, '7') AS is_bug_hotspot, coalesce((SELECT string_agg(b, ',' ORDER BY b) FROM n WHERE n.a = t.file AND n.n <= 3), '') AS blast_radius FROM t""", *CF)
def release_delta_with_radius(r, spark, d):
    fc = r("file_changes")
    top = history.release_delta(history.commit_window(r("commits"), newer_than=1000, up_to=9000), fc)
    out = history.with_blast_radius(top, fc.where("file like '%7%'"), coupling.cochange_matrix(fc))
    return out.select("file", "changed", "is_bug_hotspot", F.array_join("blast_radius", ",").alias("blast_radius"))


@query(r"SELECT file, sum(len(regexp_extract_all(op || content, '\b(if|for|while|switch|&&|\|\||\?)\b')))::BIGINT AS complexity FROM patch_lines WHERE op = '+' GROUP BY file HAVING complexity > 0", "patch_lines")
def proxy_complexity(r, spark, d):
    return history.proxy_complexity(r("patch_lines"))


_COMMENT = r"(//|/\*|\*/|^\s*\*\s|#\s|<!--|--\s|^\s*#)"


@query(f"""SELECT rev, file, hunk, string_agg(op || content, chr(10) ORDER BY line_seq, op || content) AS block FROM patch_lines WHERE rev IN (SELECT rev FROM commits WHERE NOT {_m('subject', '^(docs|readme|documentation|chore[(]docs[)]):?')})
GROUP BY rev, file, hunk HAVING bool_or(op = '+' AND regexp_matches(content, '{_COMMENT}'))""", "commits", "patch_lines")
def changed_comments(r, spark, d):
    return history.changed_comments(r("commits"), r("patch_lines"))


@query(f"""SELECT rev, author, subject FROM commits WHERE {_m('subject', _W.format(S.SUSPICIOUS_WORDS))} OR rev IN (SELECT rev FROM patch_lines WHERE op = '+' AND {_m('content', _W.format(S.SUSPICIOUS_WORDS))})""", "commits", "patch_lines")
def suspicious_commits_and_lines(r, spark, d):
    return history.suspicious_commits(r("commits"), r("patch_lines"))


_MANIFEST = """m AS (SELECT concat('m', p_partkey::VARCHAR, '/', (['pubspec.yaml', 'package.json', 'requirements.txt', 'go.mod', 'Cargo.toml', 'Gemfile'])[p_size % 6 + 1]) AS manifest,
(['dart', 'npm', 'python', 'go', 'rust', 'ruby'])[p_size % 6 + 1] AS ecosystem, ([4, 4, 3, 2, 3, 3])[p_size % 6 + 1]::BIGINT AS total, ([2, 2, 1, 2, 2, 1])[p_size % 6 + 1]::BIGINT AS pinned, p_partkey % 3 <> 0 AS has_lock FROM part)"""


@query(f"WITH {_MANIFEST} SELECT ecosystem, manifest, total, pinned, total - pinned AS floating, has_lock FROM m")
def manifest_counts(r, spark, d):
    found = security.manifests(r("manifest_files"))
    return security.manifest_counts(found, security.dependencies(found))


@query(f"""WITH {_MANIFEST} SELECT sum(total)::BIGINT AS total, sum(total - pinned)::BIGINT AS floating, count(*) FILTER (WHERE NOT has_lock) AS missing_locks,
CASE WHEN sum(total) = 0 THEN 'none' WHEN sum(total - pinned) > 0.5 * sum(total) OR count(*) FILTER (WHERE NOT has_lock) > 0 THEN 'high' WHEN sum(total - pinned) > 0 THEN 'medium' ELSE 'low' END AS risk FROM m""")
def dependency_risk(r, spark, d):
    found = security.manifests(r("manifest_files"))
    return security.dependency_risk(found, security.dependencies(found))


_KIND = r"CASE WHEN contains(upper(subject), 'BREAKING CHANGE') OR contains(subject, '!:') THEN 'breaking' WHEN regexp_matches(subject, '^fix(\([^)]+\))?!?:\s*.+$', 'i') THEN 'fix' WHEN regexp_matches(subject, '^feat(\([^)]+\))?!?:\s*.+$', 'i') THEN 'feature' ELSE 'other' END"


@query(f"""WITH o AS (SELECT intro_rev AS rev, string_agg(fix_rev, ',' ORDER BY fix_rev) AS origins FROM (SELECT DISTINCT intro_rev, fix_rev FROM szz_matches) GROUP BY 1),
n AS (SELECT rev, string_agg(file, ',' ORDER BY file) AS files FROM (SELECT DISTINCT rev, file FROM file_changes) GROUP BY 1)
SELECT rev, {_KIND} AS kind, author, coalesce(files, '') AS files, CASE WHEN {_KIND} = 'fix' THEN coalesce(origins, '') ELSE '' END AS origins FROM commits LEFT JOIN o USING (rev) LEFT JOIN n USING (rev)""", *CF, "szz_matches")
def changelog_entries(r, spark, d):
    """With the roles of the made matches turned, as their fixes are no commits."""
    m = r("szz_matches").select(F.col("intro_rev").alias("fix_rev"), F.col("fix_rev").alias("intro_rev"), "intro_ts", "fix_ts")
    out = security.changelog_entries(r("commits"), r("file_changes"), m)
    return out.select("rev", "kind", "author", F.array_join("files", ",").alias("files"), F.array_join("origins.intro_rev", ",").alias("origins"))


@query("SELECT (SELECT count(*) FROM commits) AS commits, string_agg(author, ',' ORDER BY author) AS contributors FROM (SELECT DISTINCT author FROM commits WHERE author <> '')", "commits")
def changelog_summary(r, spark, d):
    return security.changelog_summary(r("commits")).withColumn("contributors", F.array_join("contributors", ","))


@query("""WITH b AS (SELECT date_trunc('week', ts) AS period, count(*) AS total, count(*) FILTER (WHERE hour(ts) < 9 OR hour(ts) >= 17) AS burnout FROM commits GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY period) - 1 AS i, count(*) OVER () AS n FROM b),
h AS (SELECT max(n) AS n, avg(total) FILTER (WHERE i < n // 2) AS f, avg(total) FILTER (WHERE i >= n // 2) AS s, (count(*) * sum(i * total) - sum(i) * sum(total))::DOUBLE / (count(*) * sum(i * i) - sum(i) * sum(i))::DOUBLE AS slope FROM n),
x AS (SELECT count(*) AS x FROM commits GROUP BY author), o AS (SELECT x, row_number() OVER (ORDER BY x) AS i, count(*) OVER () AS n FROM x)
SELECT (SELECT count(*) FROM b) AS periods, (SELECT sum(total)::BIGINT FROM b) AS commits, (SELECT sum(burnout)::BIGINT FROM b) AS burnout, floor(1e6 * (SELECT avg(total) FROM b))::BIGINT AS mean_e6,
CASE WHEN n < 4 THEN 'stable' WHEN s > f * 1.2 THEN 'accelerating' WHEN s < f * 0.8 THEN 'decelerating' ELSE 'stable' END AS trend, floor(1e6 * slope)::BIGINT AS slope_e6, (SELECT floor(1e6 * (sum((2 * i - n - 1) * x)::DOUBLE / (max(n) * sum(x))::DOUBLE))::BIGINT FROM o) AS gini_e6 FROM h""", "commits")
def velocity_summary(r, spark, d):
    e6 = lambda c: F.floor(1e6 * F.col(c)).cast("long").alias(f"{c}_e6")
    return velocity.velocity_summary(r("commits")).select("periods", "commits", "burnout", e6("mean"), "trend", e6("slope"), e6("gini"))


@query(f"""WITH f AS (SELECT rev FROM commits WHERE NOT is_merge AND {_m('subject', _FIX)} AND NOT {_m('subject', _NOTFIX)} AND {_m('subject', 'fix|bug|patch|issue|resolv')})
SELECT file, coalesce(n, 0) AS changes, coalesce(k, 0) AS fixes FROM (SELECT file, count(*) AS n FROM file_changes WHERE deletions > 5 GROUP BY file) FULL JOIN (SELECT file, count(*) AS k FROM file_changes JOIN f USING (rev) GROUP BY file) USING (file)""", *CF)
def churn_and_fixes(r, spark, d):
    """Files of either count, zeros for what the other lacks."""
    fc, fixes = r("file_changes"), szz.fix_commits(r("commits"))
    n = history.file_churn(fc.where("deletions > 5"))
    k = history.file_churn(fc.join(fixes.select("rev"), "rev", "left_semi")).withColumnRenamed("changes", "fixes")
    return szz.key_union(n, k).select("file", "changes", "fixes")


@query("SELECT severity, count(*) AS n FROM made_findings GROUP BY severity", "made_findings")
def severity_counts_of_findings(r, spark, d):
    return findings.severity_counts(r("made_findings"))


@query("SELECT row_number() OVER (ORDER BY severity_rank DESC, value_num DESC, subject, metric) AS place, subject, metric, severity FROM made_findings", "made_findings")
def findings_in_order(r, spark, d):
    got = findings.ranked(r("made_findings")).select("subject", "metric", "severity", F.monotonically_increasing_id().alias("i"))
    return got.select(F.row_number().over(W.partitionBy(F.lit(1)).orderBy("i")).cast("long").alias("place"), "subject", "metric", "severity")


_RULES = """f AS (SELECT * FROM made_findings),
o1 AS (SELECT DISTINCT subject FROM f WHERE category = 'ownership' AND severity_rank >= 7), ch AS (SELECT DISTINCT subject FROM f WHERE category = 'churn'), h AS (SELECT DISTINCT subject FROM f WHERE category = 'bugHotspot'),
ks AS (SELECT json_extract_string(evidence, '$.top_author') AS author, count(*) AS k FROM f WHERE category = 'ownership' AND metric = 'single_author_ownership' AND severity_rank >= 7 AND subject IN (SELECT subject FROM h) GROUP BY 1)"""


@query(f"""WITH {_RULES}
SELECT 'bug_hotspot_x_single_owner' AS metric, subject, 'critical' AS severity FROM f WHERE category = 'bugHotspot' AND subject IN (SELECT subject FROM o1)
UNION ALL SELECT 'complexity_x_churn', subject, 'critical' FROM f WHERE category = 'complexity' AND severity_rank >= 6 AND subject IN (SELECT subject FROM ch)
UNION ALL SELECT 'cross_module_coupling', subject, 'high' FROM f WHERE category = 'coupling' AND severity_rank >= 6 AND json_extract_string(evidence, '$.cross_module') = 'true'
UNION ALL SELECT 'real_complexity_x_churn', subject, 'critical' FROM f WHERE category = 'lexicalComplexity' AND severity_rank >= 6 AND subject IN (SELECT subject FROM ch)
UNION ALL SELECT 'minor_contributors_x_hotspot', subject, 'high' FROM f WHERE category = 'ownership' AND metric = 'minor_contributor_count' AND subject IN (SELECT subject FROM h)
UNION ALL SELECT 'stale_dependency_x_secret', subject, 'critical' FROM f WHERE category = 'secret' AND subject LIKE 'config/%' AND EXISTS (SELECT 1 FROM f WHERE category = 'dependency' AND severity = 'critical')
UNION ALL SELECT 'knowledge_loss_risk', author, 'critical' FROM ks WHERE k >= 2 AND author IS NOT NULL
UNION ALL SELECT 'burnout_x_bug_introduction', 'repository', 'high' WHERE EXISTS (SELECT 1 FROM f WHERE category = 'velocity' AND metric = 'burnout_commit_share' AND severity_rank >= 6) AND EXISTS (SELECT 1 FROM f WHERE category = 'bugHotspot' AND severity_rank >= 4)""", "made_findings")
def all_compound_rules(r, spark, d):
    """The eight rules over findings of every kind."""
    return findings.compounds(r("made_findings")).select("metric", "subject", "severity")


@query(f"""WITH {_OWN}, l AS ({_OWNERSHIP}) SELECT (SELECT count(*) FROM l) AS files, 0::BIGINT AS drifted, (SELECT count(DISTINCT file) FROM file_changes WHERE file NOT LIKE '%.md') AS unowned""", *CF)
def ownership_summary(r, spark, d):
    own = history.ownership(r("commits"), r("file_changes"))
    rules = spark.createDataFrame([(0, "*.md", "@writers")], "rule_idx int, pattern string, owners string")
    return history.ownership_summary(history.ownership_drift(own, own), history.declared_owners(r("file_changes"), rules))


@query("SELECT name, name = 'vNATION_4' AS is_current FROM refs WHERE kind = 'branch'", "refs")
def branches(r, spark, d):
    return workspace.branches(r("refs"), "vNATION_4")


@query("SELECT rev, author, subject FROM commits WHERE rev = '77'", "commits")
def show_commit(r, spark, d):
    return workspace.show(r("commits"), "77").select("rev", "author", "subject")


@query("SELECT (SELECT count(*) FROM commits) AS commits, (SELECT max(ts) FROM commits) AS last_ts, (SELECT arg_max(subject, seq) FROM commits) AS last_subject, (SELECT max(name) FROM refs WHERE kind = 'branch' AND name = 'vNATION_4') AS branch, true AS dirty", "commits", "refs")
def workspace_health(r, spark, d):
    return workspace.health(r("commits"), r("refs"), r("renamed"), "vNATION_4")


@query("SELECT file, file LIKE 'Brand#1%' OR file LIKE 'Brand#2%' AS in_layer FROM (SELECT DISTINCT file FROM file_changes)", "file_changes")
def files_inside(r, spark, d):
    """Paths that climb out of their root and come back, or don't."""
    f = F.col("file")
    way = F.when(f.startswith("Brand#1"), F.concat(F.lit("./x/../"), f)).when(f.startswith("Brand#2"), F.concat(F.lit("/root/"), f)).otherwise(F.concat(F.lit("x/../../"), f))
    return r("file_changes").select("file").distinct().select("file", workspace.inside(way, "/root").alias("in_layer"))


_CODE = "(VALUES ('sum', false, 0, 1, 0), ('_add', true, 2, 2, 0), ('go', false, 0, 0, 1), ('print', false, 1, 1, 2)) v(name, is_private, n, m, kind)"


@query(f"SELECT path, name, is_private FROM code_files, {_CODE} WHERE kind = 0 OR kind = 1 AND contains(content, 'void go')", "code_files")
def signatures(r, spark, d):
    return workspace.signatures(r("code_files"))


@query("SELECT path, '_add' AS name, 2::BIGINT AS calls FROM code_files UNION ALL SELECT path, unnest(['sum', 'print']), 1 FROM code_files WHERE contains(content, 'void go')", "code_files")
def invocations(r, spark, d):
    return workspace.invocations(r("code_files"))


@query("SELECT path AS src, 'lib/a.dart' AS dst FROM code_files WHERE path IN (SELECT path FROM code_files ORDER BY path LIMIT 10)", "code_files")
def imports_of_changed_sources(r, spark, d):
    changes = r("code_files").select(F.col("path").alias("file"))
    return text.dart_imports(workspace.changed_sources(changes, r("code_files")))


@query(f"""SELECT rev, file, hunk, unnest(['accuracy', 'audience', 'length', 'reason']) AS aspect FROM patch_lines WHERE rev IN (SELECT rev FROM commits WHERE NOT {_m('subject', '^(docs|readme|documentation|chore[(]docs[)]):?')})
GROUP BY rev, file, hunk HAVING bool_or(op = '+' AND regexp_matches(content, '{_COMMENT}'))""", "commits", "patch_lines")
def comments_to_judge(r, spark, d):
    return workspace.comments_to_judge(r("commits"), r("patch_lines")).select("rev", "file", "hunk", "aspect")


_HINTED = ", ".join(f"('{k}', '{v[1].replace(chr(39), chr(39) * 2)}')" for k, v in workspace.HINTS.items())


@query(f"SELECT subject, metric, source, advice FROM (SELECT *, unnest([CASE category WHEN 'bugHotspot' THEN 'bugHotspots' WHEN 'ownership' THEN 'fileOwnership' WHEN 'coupling' THEN 'logicalCoupling' ELSE category END, 'compound']) AS source FROM made_findings) JOIN (VALUES {_HINTED}) h(source, advice) USING (source)", "made_findings")
def findings_with_hints(r, spark, d):
    c = F.col("category")
    name = F.when(c == "bugHotspot", "bugHotspots").when(c == "ownership", "fileOwnership").when(c == "coupling", "logicalCoupling").otherwise(c)
    return workspace.with_hints(r("made_findings").withColumn("source", F.array(name, F.lit("compound")))).select("subject", "metric", "source", "advice")
