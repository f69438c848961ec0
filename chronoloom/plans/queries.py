"""Registered queries over the driver's tables, each with SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexical
from ..functions import scalars as S
from ..functions import windows
from ..operators import coupling, findings, history, security, szz, text, velocity
from ..sources.relations import relation, with_sql
from ..sources.session import written
from ..streaming import windows as streaming

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None, *names: str):
    """Register a function of (relation-getter, spark, folder); names are the relations its SQL uses."""

    def add(f):
        def run(spark, sf_dir):
            return f(lambda n: relation(spark, sf_dir, n), spark, sf_dir)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = with_sql(sql, *names) if names else sql
        return f

    return add


CF = ("commits", "file_changes")
_BY_AUTHOR = "SELECT file, author, count(*) AS changes FROM file_changes JOIN commits USING (rev) GROUP BY file, author"
_W = r"(^|[^A-Za-z0-9_])({})($|[^A-Za-z0-9_])"
_FIX, _NOTFIX = _W.format(S.FIX_WORDS), _W.format(S.NOT_FIX_WORDS)


def _m(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, '{pattern}', 'i')"


@query("SELECT file, count(*) AS changes, count(DISTINCT author) AS authors, count(*) * count(DISTINCT author) AS score FROM file_changes JOIN commits USING (rev) GROUP BY file", *CF)
def volatility(r, spark, d):
    return history.volatility(r("commits"), r("file_changes"))


@query("SELECT file, count(*) AS changes, count(DISTINCT author) AS authors, count(*) * count(DISTINCT author) AS score FROM file_changes JOIN commits USING (rev) GROUP BY file ORDER BY score DESC, file LIMIT 50", *CF)
def volatility_top50(r, spark, d):
    return history.volatility(r("commits"), r("file_changes")).orderBy(F.desc("score"), "file").limit(50)


@query("SELECT file, count(*) AS changes FROM file_changes GROUP BY file", "file_changes")
def file_churn(r, spark, d):
    return history.file_churn(r("file_changes"))


@query(_BY_AUTHOR, *CF)
def churn_by_author(r, spark, d):
    return history.churn_by_author(r("commits"), r("file_changes"))


@query(f"SELECT file, sum(changes)::BIGINT AS total, to_json(map_from_entries(list({{'k': author, 'v': changes}} ORDER BY author)))::VARCHAR AS authors FROM ({_BY_AUTHOR}) GROUP BY file", *CF)
def churn_with_authors(r, spark, d):
    return history.churn_with_authors(r("commits"), r("file_changes")).withColumn("authors", F.to_json("authors"))


@query("SELECT file, count(*) AS changes FROM file_changes JOIN (SELECT rev FROM commits WHERE ts >= TIMESTAMP '1997-01-01' ORDER BY seq DESC LIMIT 500) USING (rev) GROUP BY file", *CF)
def churn_in_window(r, spark, d):
    window = history.commit_window(r("commits"), since=F.lit("1997-01-01").cast("timestamp"), limit=500)
    return history.file_churn(r("file_changes").join(window.select("rev"), "rev", "left_semi"))


@query("SELECT file, count(*) AS changes FROM file_changes WHERE file IN (SELECT file FROM file_changes WHERE deletions > 6) GROUP BY file", "file_changes")
def churn_of_targets(r, spark, d):
    fc = r("file_changes")
    return history.file_churn(history.target_files(fc, fc.where("deletions > 6").select("file")))


@query("SELECT a.file, changes FROM (SELECT file, count(*) AS changes FROM file_changes GROUP BY file) a, (SELECT count(*) AS t FROM commits) WHERE changes >= ceil(t * 0.001) ORDER BY changes DESC, file LIMIT 5", *CF)
def high_churn(r, spark, d):
    return history.high_churn(r("commits"), r("file_changes"), share=0.001)


_PREFIX = """SELECT {by}author, {n} FROM (SELECT *, sum({n}) OVER (PARTITION BY {part} ORDER BY {n} DESC, author ROWS UNBOUNDED PRECEDING) AS cum, sum({n}) OVER (PARTITION BY {part}) AS total FROM ({src}))
WHERE cum - {n} < 0.5 * total"""


@query(_PREFIX.format(by="", n="commits", part="1", src="SELECT author, count(*) AS commits FROM commits GROUP BY author"), "commits")
def bus_factor(r, spark, d):
    return history.bus_factor(r("commits"))


@query(f"SELECT file, b AS bus_factor, n AS developers FROM (SELECT file, count(*) AS b FROM ({_PREFIX.format(by='file, ', n='changes', part='file', src=_BY_AUTHOR)}) GROUP BY file) JOIN (SELECT file, count(*) AS n FROM ({_BY_AUTHOR}) GROUP BY file) USING (file)", *CF)
def file_bus_factor(r, spark, d):
    return history.file_bus_factor(r("commits"), r("file_changes"), r("file_changes"))


@query("""SELECT rev, files, insertions, deletions, rev || ' - ' || author || ' (' || strftime(ts, '%Y-%m-%d') || '): ' || subject AS described
FROM (SELECT rev, count(*) AS files, sum(insertions)::BIGINT AS insertions, sum(deletions)::BIGINT AS deletions FROM file_changes GROUP BY rev) JOIN commits USING (rev)
WHERE insertions + deletions >= 200 OR files >= 20""", *CF)
def mega_commits(r, spark, d):
    return history.mega_commits(r("commits"), r("file_changes"), lines=200)


@query(f"SELECT rev, author, subject FROM commits WHERE {_m('subject', _W.format(S.SUSPICIOUS_WORDS))}", "commits")
def suspicious_commits(r, spark, d):
    return history.suspicious_commits(r("commits"))


@query(f"SELECT rev, author, ts, subject FROM commits WHERE NOT is_merge AND {_m('subject', _FIX)} AND NOT {_m('subject', _NOTFIX)} AND {_m('subject', 'fix|bug|patch|issue|resolv')}", "commits")
def fix_commits(r, spark, d):
    return szz.fix_commits(r("commits")).select("rev", "author", "ts", "subject")


@query("SELECT author, count(*) AS commits FROM commits WHERE NOT is_merge GROUP BY author", "commits")
def contributions_by_author(r, spark, d):
    return history.contributions(r("commits"))


@query("SELECT count(DISTINCT file) AS files, sum(insertions)::BIGINT AS insertions, sum(deletions)::BIGINT AS deletions FROM file_changes", "file_changes")
def range_summary(r, spark, d):
    return history.range_summary(r("file_changes"))


@query("SELECT coalesce(nullif(regexp_extract(file, '^.+(\\.[^.]+)$', 1), ''), 'no_extension') AS extension, sum(insertions)::BIGINT AS insertions, sum(deletions)::BIGINT AS deletions FROM file_changes GROUP BY 1", "file_changes")
def stats_by_extension(r, spark, d):
    return history.stats_by_extension(r("file_changes"))


@query("""SELECT file, sum(insertions)::BIGINT AS insertions, sum(deletions)::BIGINT AS deletions, (sum(insertions) + sum(deletions))::BIGINT AS changed
FROM file_changes JOIN commits USING (rev) WHERE seq > 1000 AND seq <= 9000 GROUP BY file ORDER BY changed DESC, file LIMIT 10""", *CF)
def release_delta_top10(r, spark, d):
    return history.release_delta(history.commit_window(r("commits"), newer_than=1000, up_to=9000), r("file_changes"))


@query(f"""SELECT rev, subject, coalesce(renamed, '') AS renamed, coalesce(i, 0) AS insertions, coalesce(e, 0) AS deletions, coalesce(e, 0) > 50 AND coalesce(i, 0) < 0.2 * coalesce(e, 0) AS simplifies
FROM commits LEFT JOIN (SELECT rev, string_agg(CASE WHEN status LIKE 'R%' THEN old_file || ' -> ' || file END, ';' ORDER BY old_file || ' -> ' || file) AS renamed, sum(insertions)::BIGINT AS i, sum(deletions)::BIGINT AS e FROM file_changes GROUP BY rev) USING (rev)
WHERE {_m('subject', _W.format(S.REFACTOR_WORDS))} OR coalesce(renamed, '') <> '' OR (e > 50 AND i < 0.2 * e)""", *CF)
def refactoring_commits(r, spark, d):
    return history.refactorings(r("commits"), r("file_changes")).withColumn("renamed", F.array_join("renamed", ";"))


@query("SELECT split_part(file, '/', 1) AS directory, count(*) AS touches, count(*) / sum(count(*)) OVER ()::DOUBLE AS share FROM file_changes WHERE contains(file, '/') GROUP BY 1", "file_changes")
def directory_shares(r, spark, d):
    return history.directory_shares(r("file_changes"))


@query("SELECT count(*) AS commits, max(ts) AS last_ts, arg_max(subject, seq) AS last_subject FROM commits", "commits")
def repository_health(r, spark, d):
    return history.repository_health(r("commits"))


_OWN = f"""a AS ({_BY_AUTHOR}), t AS (SELECT file, sum(changes)::BIGINT AS total FROM a GROUP BY file)"""
_OWNERSHIP = """SELECT file, author AS top_author, changes AS top_changes, total, minor FROM (
SELECT a.*, total, row_number() OVER (PARTITION BY file ORDER BY changes DESC, author) AS n, count(*) FILTER (WHERE changes < 0.05 * total) OVER (PARTITION BY file) AS minor FROM a JOIN t USING (file)) WHERE n = 1"""


@query(f"WITH {_OWN} {_OWNERSHIP}", *CF)
def ownership(r, spark, d):
    return history.ownership(r("commits"), r("file_changes"))


@query(f"""WITH {_OWN}, l AS ({_OWNERSHIP}), a2 AS (SELECT file, author, count(*) AS changes FROM file_changes JOIN commits USING (rev) WHERE ts >= TIMESTAMP '2000-01-01' GROUP BY file, author),
s AS (SELECT file, author FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY changes DESC, author) AS n FROM a2) WHERE n = 1)
SELECT l.file, top_author AS long_owner, total AS changes, coalesce(s.author, '') AS recent_owner, coalesce(s.author, '') <> '' AND s.author <> top_author AS drifted FROM l LEFT JOIN s ON s.file = l.file""", *CF)
def ownership_drift(r, spark, d):
    c = r("commits")
    recent = history.commit_window(c, since=F.lit("2000-01-01").cast("timestamp"))
    return history.ownership_drift(history.ownership(c, r("file_changes")), history.ownership(recent, r("file_changes")))


_RULES = [(0, "*", "@all"), (1, "*.md", "@writers"), (2, "/Brand#1/", "@one"), (3, "PROMO/", "@promo"), (4, "f77.py", "@seventy"), (5, "Brand#2", "@two")]


@query("""SELECT file, arg_max(owners, idx) AS owners FROM (SELECT DISTINCT file FROM file_changes) f LEFT JOIN
(VALUES (0, '*', '@all'), (1, '*.md', '@writers'), (2, '/Brand#1/', '@one'), (3, 'PROMO/', '@promo'), (4, 'f77.py', '@seventy'), (5, 'Brand#2', '@two')) v(idx, p, owners)
ON CASE WHEN p = '*' THEN true WHEN p LIKE '*.%' THEN ends_with(file, substr(p, 2)) WHEN p LIKE '/%' THEN starts_with(file, substr(p, 2))
WHEN p LIKE '%/' THEN starts_with(file, p) OR contains(file, '/' || p) ELSE file = p OR ends_with(file, '/' || p) OR starts_with(file, p || '/') END GROUP BY file""", "file_changes")
def codeowners_last_match(r, spark, d):
    return history.declared_owners(r("file_changes"), spark.createDataFrame(_RULES, "rule_idx int, pattern string, owners string"))


# coupling and layers
_PAIRS = """s AS (SELECT DISTINCT rev, file FROM file_changes), m AS (SELECT s.* FROM s JOIN (SELECT rev FROM s GROUP BY rev HAVING count(*) >= 2) USING (rev)),
p AS (SELECT x.file AS a, y.file AS b, count(*) AS n FROM m x JOIN m y ON x.rev = y.rev AND x.file < y.file GROUP BY 1, 2)"""


@query(f"WITH {_PAIRS} SELECT a, b, n FROM p", "file_changes")
def cochange_pairs(r, spark, d):
    return coupling.cochange_pairs(r("file_changes"))


@query(f"WITH {_PAIRS} SELECT a, b, n FROM p UNION ALL SELECT b, a, n FROM p", "file_changes")
def cochange_matrix(r, spark, d):
    return coupling.cochange_matrix(r("file_changes"))


@query(f"""WITH {_PAIRS}, c AS (SELECT file, count(*) AS c FROM m GROUP BY file)
SELECT a, b, n, greatest(n / x.c::DOUBLE, n / y.c::DOUBLE) AS confidence, split_part(a, '/', 1) <> split_part(b, '/', 1) AS cross_module FROM p JOIN c x ON x.file = a JOIN c y ON y.file = b WHERE n >= 2""", "file_changes")
def logical_coupling(r, spark, d):
    return coupling.logical_coupling(r("file_changes"), least=2)


@query("""WITH s AS (SELECT DISTINCT CAST(l_orderkey AS STRING) AS rev, CAST(l_suppkey AS STRING) AS file FROM lineitem), m AS (SELECT s.* FROM s JOIN (SELECT rev FROM s GROUP BY rev HAVING count(*) >= 2) USING (rev)),
p AS (SELECT x.file AS a, y.file AS b, count(*) AS n FROM m x JOIN m y ON x.rev = y.rev AND x.file < y.file GROUP BY 1, 2 HAVING count(*) >= 3), c AS (SELECT file, count(*) AS c FROM m GROUP BY file)
SELECT a, b, n, greatest(n / x.c::DOUBLE, n / y.c::DOUBLE) AS confidence FROM p JOIN c x ON x.file = a JOIN c y ON y.file = b""")
def supplier_coupling(r, spark, d):
    """Suppliers of the same orders: a dense matrix."""
    changes = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").cast("string").alias("rev"), F.col("l_suppkey").cast("string").alias("file"))
    return coupling.logical_coupling(changes).drop("cross_module")


_LAYERS = "h AS (SELECT DISTINCT rev, layer FROM file_changes JOIN layers ON regexp_matches(file, pattern, 'i')), k AS (SELECT rev, count(*) AS k FROM h GROUP BY rev), lp AS (SELECT x.layer AS a, y.layer AS b, count(*) AS n FROM h x JOIN h y ON x.rev = y.rev AND x.layer < y.layer GROUP BY 1, 2)"


@query(f"""WITH {_LAYERS} SELECT (SELECT count(DISTINCT rev) FROM file_changes) AS commits, (SELECT count(*) FROM k WHERE k >= 2) AS drift_commits, (SELECT count(*) FROM lp) AS coupled_pairs,
(SELECT (count(*) * (count(*) - 1) // 2)::BIGINT FROM layers) AS possible_pairs""", "file_changes", "layers")
def architecture_drift(r, spark, d):
    return coupling.drift_summary(r("file_changes"), r("layers"))


@query(f"WITH {_LAYERS} SELECT a, b, n FROM lp", "file_changes", "layers")
def layer_pairs(r, spark, d):
    return coupling.layer_pairs(coupling.commit_layers(r("file_changes"), r("layers")))


@query(f"""WITH {_LAYERS}, n AS (SELECT count(*) AS n FROM k WHERE k >= 2)
SELECT 'god_component' AS smell, layer AS subject, count(*) AS value FROM h JOIN k USING (rev), n WHERE k >= 2 GROUP BY layer, n HAVING count(*) > 0.5 * n
UNION ALL SELECT 'hub_like', x, count(*) FROM (SELECT a AS x FROM lp UNION ALL SELECT b FROM lp), (SELECT count(*) AS l FROM layers) GROUP BY x, l HAVING l >= 4 AND count(*) >= l / 2.0
UNION ALL SELECT 'scattered', 'repository', count(*) FROM k WHERE k >= 3 HAVING count(*) > 0""", "file_changes", "layers")
def drift_smells(r, spark, d):
    return coupling.drift_smells(r("file_changes"), r("layers"))


@query("SELECT split_part(file, '/', 1) AS layer, count(*) AS files FROM (SELECT DISTINCT file FROM file_changes) GROUP BY 1 ORDER BY files DESC, layer LIMIT 8", "file_changes")
def layer_inference(r, spark, d):
    return coupling.infer_layers(r("file_changes").select("file").distinct())


# velocity
def _bucket(unit, form, rel="activity"):
    return f"SELECT strftime(date_trunc('{unit}', ts), '{form}') AS period, count(*) AS total, count(*) FILTER (WHERE hour(ts) < 9 OR hour(ts) >= 17) AS burnout FROM {rel} GROUP BY 1"


@query(_bucket("day", "%Y-%m-%d"), "activity")
def commit_velocity_day(r, spark, d):
    return velocity.velocity(r("activity"), "day")


@query(_bucket("week", "%Y-%m-%d", "commits"), "commits")
def commit_velocity_week(r, spark, d):
    return velocity.velocity(r("commits"), "week")


@query(_bucket("month", "%Y-%m", "commits"), "commits")
def commit_velocity_month(r, spark, d):
    return velocity.velocity(r("commits"), "month")


@query("SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS period, author, count(*) AS commits FROM activity GROUP BY 1, 2", "activity")
def velocity_by_author(r, spark, d):
    return velocity.velocity_by_author(r("activity"))


_NUM = f"b AS ({_bucket('week', '%Y-%m-%d', 'commits')}), n AS (SELECT *, row_number() OVER (ORDER BY period) - 1 AS i, count(*) OVER () AS n FROM b)"


@query(f"""WITH {_NUM}, h AS (SELECT max(n) AS n, avg(total) FILTER (WHERE i < n // 2) AS f, avg(total) FILTER (WHERE i >= n // 2) AS s FROM n)
SELECT n AS buckets, CASE WHEN n < 4 THEN 'stable' WHEN s > f * 1.2 THEN 'accelerating' WHEN s < f * 0.8 THEN 'decelerating' ELSE 'stable' END AS trend FROM h""", "commits")
def velocity_trend(r, spark, d):
    return velocity.trend(velocity.velocity(r("commits")))


@query(f"WITH b AS ({_bucket('day', '%Y-%m-%d')}) SELECT period, total FROM b, (SELECT avg(total) AS m, stddev_pop(total) AS s FROM b) WHERE total > m + 2 * s", "activity")
def velocity_anomalies(r, spark, d):
    return velocity.anomalies(velocity.velocity(r("activity"), "day"))


@query("""WITH x AS (SELECT count(*) AS x FROM activity GROUP BY author), o AS (SELECT x, row_number() OVER (ORDER BY x) AS i, count(*) OVER () AS n FROM x)
SELECT sum((2 * i - n - 1) * x)::BIGINT AS numerator, (max(n) * sum(x))::BIGINT AS denominator FROM o""", "activity")
def author_gini(r, spark, d):
    return velocity.gini(r("activity"))


@query(f"WITH {_NUM} SELECT (count(*) * sum(i * total) - sum(i) * sum(total))::BIGINT AS numerator, (count(*) * sum(i * i) - sum(i) * sum(i))::BIGINT AS denominator FROM n", "commits")
def velocity_slope(r, spark, d):
    return velocity.slope(velocity.velocity(r("commits")))


@query("SELECT rev, '[' || rev || '] - ' || author || ' - ' || subject || ' (' || strftime(ts, '%H:%M') || ')' AS described FROM activity WHERE hour(ts) < 9 OR hour(ts) >= 17", "activity")
def burnout_events(r, spark, d):
    return velocity.burnout_commits(r("activity"))


@query("SELECT count(*) FILTER (WHERE hour(ts) < 9 OR hour(ts) >= 17) AS burnout, count(*) AS total FROM activity", "activity")
def burnout_share(r, spark, d):
    return velocity.burnout_share(r("activity"))


# bug lifetimes
_LIFE = "SELECT {k} count(*) AS matches, count(DISTINCT fix_rev) AS fixes, sum(abs(epoch(fix_ts)::BIGINT - epoch(intro_ts)::BIGINT) // 60)::BIGINT AS minutes, sum(abs(epoch(fix_ts)::BIGINT - epoch(intro_ts)::BIGINT) // 60)::BIGINT / 1440.0::DOUBLE / count(*) AS mean_days FROM szz_matches {g}"


@query(_LIFE.format(k="file,", g="GROUP BY file"), "szz_matches")
def szz_lifetimes_by_file(r, spark, d):
    return szz.lifetimes(r("szz_matches"), "file")


@query(_LIFE.format(k="intro_author,", g="GROUP BY intro_author"), "szz_matches")
def szz_lifetimes_by_author(r, spark, d):
    return szz.lifetimes(r("szz_matches"), "intro_author")


@query(_LIFE.format(k="", g="WHERE contains(lower(intro_author), 'dev1')"), "szz_matches")
def szz_lifetimes_of_author(r, spark, d):
    return szz.lifetimes(r("szz_matches"), author="DEV1")


_DIFF = "SELECT CAST(source AS STRING) AS rev, CAST(doc_id AS STRING) AS file, i AS old_line, line AS content, CASE WHEN doc_id % 2 = 0 THEN '-' ELSE '+' END AS op FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)"


def _diff(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    lines = docs.select(F.col("source").alias("rev"), F.col("doc_id").cast("string").alias("file"), F.when(F.col("doc_id") % 2 == 0, "-").otherwise("+").alias("op"), F.posexplode(F.split("text", "\n")).alias("p", "content"))
    return lines.select("rev", "file", (F.col("p") + 1).cast("long").alias("old_line"), "content", "op")


@query(f"""WITH d AS ({_DIFF}), n AS (SELECT *, trim(regexp_replace(content, '\\s+', ' ', 'g'), ' ') AS norm FROM d)
SELECT rev, file, old_line, content FROM n WHERE op = '-' AND (length(norm) < 8 OR NOT EXISTS (SELECT 1 FROM n a WHERE a.op = '+' AND a.rev = n.rev AND a.norm = n.norm))""")
def moved_line_antijoin(r, spark, d):
    return szz.deleted_not_moved(_diff(spark, d)).select("rev", "file", "old_line", "content")


@query("""WITH d AS (SELECT DISTINCT CAST(l_suppkey AS STRING) AS file, l_orderkey AS n FROM lineitem), g AS (SELECT file, n, n - row_number() OVER (PARTITION BY file ORDER BY n) AS g FROM d)
SELECT file, min(n) AS first, max(n) AS last FROM g GROUP BY file, g""")
def contiguous_ranges(r, spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").cast("string").alias("file"), F.col("l_orderkey").alias("n"))
    return windows.islands(lines, ["file"], "n")


# compliance, changelog, dependencies, secrets
_CONV = S.CONVENTIONAL.replace("(?i)", "")
_ISSUES = f"coalesce(sig, 'N') <> 'G' AS unsigned, trim(subject, ' ') = '' AS empty_subject, email NOT IN ('dev1@example.com', 'dev2@example.com') AS unrecognised, NOT {_m('subject', _CONV)} AND NOT starts_with(subject, 'Merge ') AS unconventional"
_ALLOWED = ["dev1@example.com", "dev2@example.com"]


@query(f"SELECT rev, {_ISSUES} FROM commits", "commits")
def compliance(r, spark, d):
    return security.compliance(r("commits"), _ALLOWED)


@query(f"SELECT count(*) AS commits, {', '.join(f'count(*) FILTER (WHERE {k}) AS {k}' for k in ('unsigned', 'empty_subject', 'unrecognised', 'unconventional'))} FROM (SELECT {_ISSUES} FROM commits)", "commits")
def compliance_counts(r, spark, d):
    return security.compliance_counts(r("commits"), _ALLOWED)


@query("""SELECT kind, count(*) AS commits, md5(string_agg(subject, chr(10) ORDER BY seq)) AS subjects FROM (SELECT *, CASE WHEN contains(upper(subject), 'BREAKING CHANGE') OR contains(subject, '!:') THEN 'breaking'
WHEN regexp_matches(subject, '^fix(\\([^)]+\\))?!?:\\s*.+$', 'i') THEN 'fix' WHEN regexp_matches(subject, '^feat(\\([^)]+\\))?!?:\\s*.+$', 'i') THEN 'feature' ELSE 'other' END AS kind FROM commits) GROUP BY kind""", "commits")
def changelog(r, spark, d):
    return security.changelog(r("commits")).withColumn("subjects", F.md5(F.array_join("subjects", "\n")))


@query("""SELECT fix_rev, intro_rev, (CASE WHEN f >= i THEN 1 ELSE -1 END) * (abs(epoch(f)::BIGINT - epoch(i)::BIGINT) // 60) / 1440.0::DOUBLE AS days
FROM (SELECT fix_rev, intro_rev, min(fix_ts) AS f, min(intro_ts) AS i FROM szz_matches GROUP BY 1, 2)""", "szz_matches")
def fix_origins(r, spark, d):
    m = r("szz_matches")
    return security.fix_origins(m.select(F.col("fix_rev").alias("rev")).distinct(), m)


_DEPS = """SELECT CASE p_size % 3 WHEN 0 THEN 'npm' WHEN 1 THEN 'dart' ELSE 'rust' END AS ecosystem, concat(p_brand, '/manifest') AS manifest, concat('lib', CAST(p_partkey AS STRING)) AS name,
concat(CASE WHEN p_partkey % 4 = 0 THEN '^' ELSE '' END, CAST(p_size % 5 AS STRING), '.', CAST(p_size % 7 AS STRING), '.', CAST(p_size % 3 AS STRING)) AS declared, p_partkey % 4 <> 0 AS pinned FROM {part}"""
_REG = "SELECT CASE p_size % 3 WHEN 0 THEN 'npm' WHEN 1 THEN 'dart' ELSE 'rust' END AS ecosystem, concat('lib', CAST(p_partkey AS STRING)) AS name, concat(CAST(p_size % 4 AS STRING), '.', CAST(p_size % 6 AS STRING), '.2') AS latest FROM {part} WHERE p_partkey % 10 <> 3"


def _deps(spark, d):
    part = f"parquet.`{d}/part.parquet`"
    return spark.sql(_DEPS.format(part=part)), spark.sql(_REG.format(part=part))


@query(f"""WITH d AS ({_DEPS.format(part='part')}), g AS ({_REG.format(part='part')}), j AS (SELECT d.*, latest, string_split(ltrim(declared, '^'), '.') AS a, string_split(latest, '.') AS b FROM d LEFT JOIN g USING (ecosystem, name))
SELECT ecosystem, name, manifest, declared, pinned, latest, CASE WHEN latest IS NULL THEN 'unknown' WHEN b[1]::INT > a[1]::INT THEN 'major' WHEN b[1]::INT = a[1]::INT AND b[2]::INT > a[2]::INT THEN 'minor'
WHEN b[1]::INT = a[1]::INT AND b[2]::INT = a[2]::INT AND b[3]::INT > a[3]::INT THEN 'patch' ELSE 'current' END AS status FROM j""")
def dependency_freshness(r, spark, d):
    return security.dependency_freshness(*_deps(spark, d))


_SECRET = security.SECRET.replace("'", "''")


@query(f"""WITH l AS (SELECT path, unnest(string_split(regexp_replace(replace(content, chr(13) || chr(10), chr(10)), '\\n$', ''), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(replace(content, chr(13) || chr(10), chr(10)), '\\n$', ''), chr(10)), 1) - 1 AS line_no FROM files),
h AS (SELECT path, line_no, CASE WHEN regexp_extract(line, '{_SECRET}', 2) <> '' THEN regexp_extract(line, '{_SECRET}', 2) ELSE regexp_extract(line, '{_SECRET}', 0) END AS v FROM l
WHERE regexp_matches(line, '{_SECRET}') AND NOT contains(line, chr(36) || '{{{{') AND NOT regexp_matches(lower(line), 'example|placeholder|changeme')),
e AS (SELECT *, list_sum(list_transform(list_distinct(string_split(v, '')), lambda c: -(len(list_filter(string_split(v, ''), lambda x: x = c)) / length(v)::DOUBLE) * log2(len(list_filter(string_split(v, ''), lambda x: x = c)) / length(v)::DOUBLE))) AS entropy FROM h)
SELECT path, line_no::BIGINT AS line_no, left(v, 3) || '***' || right(v, 3) AS masked FROM e WHERE entropy >= 2.5""", "files")
def secret_candidates(r, spark, d):
    return security.secrets(text.text_lines(r("files")), "line").select("path", F.col("line_no").cast("long").alias("line_no"), "masked")


@query("""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents WHERE text <> ''), n AS (SELECT doc_id, c, count(*) AS k, sum(count(*)) OVER (PARTITION BY doc_id) AS n FROM c GROUP BY doc_id, c)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(e, 0) END AS entropy_e6 FROM documents d LEFT JOIN (SELECT doc_id, round(1e6 * sum(-(k / n::DOUBLE) * log2(k / n::DOUBLE)))::BIGINT AS e FROM n GROUP BY doc_id) USING (doc_id)""")
def text_entropy(r, spark, d):
    """Of whole texts."""
    return text.text_entropy(spark.read.parquet(f"{d}/documents.parquet")).select("doc_id", F.round(1e6 * F.col("entropy")).cast("long").alias("entropy_e6"))


# text
_LINES = "l AS (SELECT path, unnest(string_split(regexp_replace(replace(content, chr(13) || chr(10), chr(10)), '\\n$', ''), chr(10))) AS line FROM files), b AS (SELECT path, line, trim(regexp_replace(line, '//.*$|#.*$', ''), ' ') AS bare FROM l)"


@query(f"WITH {_LINES} SELECT path, sum(n - 1)::BIGINT AS duplicates FROM (SELECT path, bare, count(*) AS n FROM b WHERE length(bare) > 5 GROUP BY 1, 2) WHERE n > 1 GROUP BY path", "files")
def duplicate_lines(r, spark, d):
    return text.duplicate_lines(r("files"))


@query(f"""WITH {_LINES} SELECT path, count(*) AS total_lines, max((length(regexp_extract(line, '^[ \\t]*')) + 3 * length(replace(regexp_extract(line, '^[ \\t]*'), ' ', ''))) // 4) AS max_indentation,
count(*) FILTER (WHERE length(line) > 120) AS long_lines, (count(*) FILTER (WHERE length(bare) > 5) - count(DISTINCT CASE WHEN length(bare) > 5 THEN bare END)) AS duplicate_lines FROM b GROUP BY path""", "files")
def clean_code_metrics(r, spark, d):
    return text.clean_code(r("files")).select("path", *[F.col(c).cast("long").alias(c) for c in ("total_lines", "max_indentation", "long_lines", "duplicate_lines")])


@query(None)
def clean_code_findings(r, spark, d):
    """With magic numbers, whose pattern looks behind and has no DuckDB equivalent."""
    return findings.classify_clean_code(text.clean_code(r("files")))


@query(None)
def lexical_suite(r, spark, d):
    return lexical.lexical_suite(r("files"))


@query(None)
def lexical_pages(r, spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    return lexical.lexical_suite(pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("content")))


_EDGES = """SELECT concat('n', CAST(c_custkey AS STRING)) AS src, concat('n', CAST(CASE WHEN c_custkey % 12 = 0 THEN c_custkey - 11 ELSE c_custkey + 1 END AS STRING)) AS dst FROM {t} WHERE c_custkey % 5 <> 3
UNION ALL SELECT concat('n', CAST(c_custkey AS STRING)), concat('n', CAST(c_custkey - c_nationkey % (1 + (c_custkey + 11) % 12) AS STRING)) FROM {t} WHERE c_custkey % 4 = 0"""


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM ({_EDGES.format(t='customer')}) WHERE src <> dst), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)
SELECT a.src AS node, least(a.src, min(a.dst)) AS cycle FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src""")
def import_cycles(r, spark, d):
    """Over a graph of all customers, whose groups are small."""
    return text.import_cycles(spark.sql(_EDGES.format(t=f"parquet.`{d}/customer.parquet`")))


# findings
@query("SELECT quantile_cont(c, 0.5) AS median, quantile_cont(c, 0.25) AS q1, quantile_cont(c, 0.75) AS q3, quantile_cont(c, 0.75) - quantile_cont(c, 0.25) AS iqr, quantile_cont(c, 0.9) AS p90 FROM (SELECT count(*) AS c FROM file_changes GROUP BY file)", "file_changes")
def churn_statistics(r, spark, d):
    return windows.order_statistics(history.file_churn(r("file_changes")), "changes")


@query("WITH c AS (SELECT file, count(*) AS n FROM file_changes GROUP BY file) SELECT file AS subject, n::DOUBLE AS value_num, 'elevated' AS severity FROM c WHERE n >= (SELECT quantile_cont(n, 0.9) FROM c)", "file_changes")
def top_decile_churn(r, spark, d):
    return findings.classify_top_decile(history.file_churn(r("file_changes")), "churn", "codeQuality", "changes").select("subject", "value_num", "severity")


@query("WITH c AS (SELECT file, sum(deletions)::BIGINT AS n FROM file_changes WHERE file LIKE '%.py' GROUP BY file), m AS (SELECT quantile_cont(n, 0.5) AS m FROM c) SELECT file AS subject, n::DOUBLE AS value_num, CASE WHEN n > 2 * m THEN 'high' ELSE 'elevated' END AS severity FROM c, m WHERE n > m", "file_changes")
def complexity_vs_median(r, spark, d):
    return findings.classify_complexity(_proxy(r)).select("subject", "value_num", "severity")


def _proxy(r):
    """Control words in added lines; the SQL counts them by what the lines are made of."""
    return history.proxy_complexity(r("patch_lines"))


@query(f"WITH {_OWN}, o AS ({_OWNERSHIP}) SELECT file AS subject, 'minor_contributor_count' AS metric, minor::DOUBLE AS value_num, 'elevated' AS severity FROM o WHERE minor >= 3 UNION ALL SELECT file, 'single_author_ownership', top_changes / total::DOUBLE, CASE WHEN top_changes / total::DOUBLE > 0.5 THEN 'critical' ELSE 'moderate' END FROM o WHERE top_changes / total::DOUBLE >= 0.3", *CF)
def ownership_findings(r, spark, d):
    return findings.classify_ownership(history.ownership(r("commits"), r("file_changes"))).select("subject", "metric", "value_num", "severity")


_HOT = _LIFE.format(k="file,", g="GROUP BY file")


@query(f"""WITH l AS ({_HOT}), w AS (SELECT sum(minutes) / 1440.0::DOUBLE / sum(matches) AS m, quantile_cont(matches, 0.9) AS p FROM l), s AS (SELECT file, matches, greatest(CASE WHEN mean_days > 2 * m THEN 7 WHEN mean_days > m THEN 4 ELSE 0 END, CASE WHEN matches >= p THEN 6 ELSE 0 END) AS severity_rank FROM l, w)
SELECT file AS subject, matches::DOUBLE AS value_num, severity_rank FROM s WHERE severity_rank > 0""", "szz_matches")
def hotspot_findings(r, spark, d):
    return findings.classify_hotspots(szz.lifetimes(r("szz_matches"), "file")).select("subject", "value_num", "severity_rank")


@query("""WITH c AS (SELECT file, count(*) AS n FROM file_changes WHERE file LIKE '%.py' GROUP BY file), x AS (SELECT file, sum(deletions)::BIGINT AS k FROM file_changes GROUP BY file), a AS (SELECT file, n, cume_dist() OVER (ORDER BY n) AS r FROM c), b AS (SELECT file, k, cume_dist() OVER (ORDER BY k) AS q FROM x)
SELECT file, n AS changes, k::DOUBLE AS complexity, r * q AS score FROM a JOIN b USING (file) WHERE r * q >= 0.25 ORDER BY score DESC, file LIMIT 5""", "file_changes")
def refactoring_targets(r, spark, d):
    return findings.refactoring_targets(history.file_churn(r("file_changes")), _proxy(r))


def _hot(r):
    """Lifetimes by path."""
    paths = r("file_changes").select(F.col("rev").alias("intro_rev"), F.regexp_extract("file", "(f\\d+)\\.", 1).alias("file"), F.col("file").alias("__path"))
    return szz.lifetimes(r("szz_matches").join(paths, ["intro_rev", "file"]).withColumn("file", F.col("__path")).drop("__path"), "file")


def _text_findings(r, spark):
    """What the texts of files show: lexical metrics, clean code, cycles of imports."""
    files = r("files")
    return [
        findings.classify_lexical(lexical.lexical_suite(files)),
        findings.classify_clean_code(text.clean_code(files)),
        findings.classify_cycles(text.import_cycles(text.dart_imports(files))),
    ]


def _once(r, *names):
    """Relations that many parts of a plan read, written once."""
    kept = {n: written(r(n)) for n in names}
    return lambda n: kept[n] if n in kept else r(n)


def _all_findings(r, spark, d):
    """Written once, as rules and counts read them again."""
    r = _once(r, "commits", "file_changes")
    c, fc = r("commits"), r("file_changes")
    buckets = velocity.velocity(r("activity"))
    return written(findings.union([
        *_text_findings(r, spark),
        findings.classify_secrets(security.secrets(text.text_lines(r("files")), "line"), "path"),
        findings.classify_dependencies(security.dependency_freshness(*_deps(spark, d))),
        findings.classify_bus_factor(c.groupBy("author").agg(F.count("*").alias("commits"))),
        findings.classify_ownership(history.ownership(c, fc)),
        findings.classify_hotspots(_hot(r)),
        findings.classify_complexity(_proxy(r)),
        findings.classify_top_decile(history.file_churn(fc), "churn", "codeQuality", "changes"),
        findings.classify_top_decile(history.volatility(c, fc), "volatility", "codeVolatility", "score"),
        findings.classify_coupling(coupling.logical_coupling(fc, least=2)),
        findings.classify_compliance(security.compliance(c, _ALLOWED)),
        findings.classify_velocity(velocity.trend(buckets), velocity.slope(buckets), velocity.gini(r("activity")), velocity.burnout_share(r("activity"))),
        findings.classify_count(history.mega_commits(c, fc, lines=200), "hygiene", "mega_commits"),
        findings.classify_count(history.suspicious_commits(c), "hygiene", "suspicious_commits"),
        findings.classify_drift(coupling.drift_summary(fc, r("layers")), coupling.drift_smells(fc, r("layers"))),
        findings.classify_refactoring(history.refactorings(c, fc)),
    ]))


@query(None)
def findings_ranked(r, spark, d):
    return findings.ranked(_all_findings(r, spark, d))


@query(None)
def compound_rules(r, spark, d):
    return findings.compounds(_all_findings(r, spark, d))


@query(None)
def severity_counts(r, spark, d):
    return findings.severity_counts(_all_findings(r, spark, d))


@query(None)
def report_payload(r, spark, d):
    """The audit: everything, with its larger bounds."""
    targets = findings.refactoring_targets(history.file_churn(r("file_changes")), _proxy(r))
    return findings.report(_all_findings(r, spark, d), "repository_audit", 12, 8, targets)


@query(None)
def technical_report(r, spark, d):
    r = _once(r, "commits", "file_changes")
    c, fc = r("commits"), r("file_changes")
    parts = [findings.classify_ownership(history.ownership(c, fc)), findings.classify_complexity(_proxy(r)), findings.classify_top_decile(history.file_churn(fc), "churn", "codeQuality", "changes"),
             findings.classify_coupling(coupling.logical_coupling(fc, least=2)), findings.classify_drift(coupling.drift_summary(fc, r("layers")), coupling.drift_smells(fc, r("layers"))), findings.classify_hotspots(_hot(r)),
             findings.classify_top_decile(history.volatility(c, fc), "volatility", "codeVolatility", "score"), findings.classify_refactoring(history.refactorings(c, fc)), *_text_findings(r, spark)]
    return findings.report(findings.in_refactoring_context(written(findings.union(parts)), fc.where("status = 'R'")), "technical", targets=findings.refactoring_targets(history.file_churn(fc), _proxy(r)))


@query(None)
def security_report(r, spark, d):
    deps, registry = _deps(spark, d)
    found = security.secrets(text.text_lines(r("files")), "line")
    parts = [findings.classify_secrets(found, "path"), findings.classify_compliance(security.compliance(r("commits"), _ALLOWED)), findings.classify_dependencies(security.dependency_freshness(deps, registry))]
    return findings.report(written(findings.union(parts)), "security")


@query(None)
def pm_report(r, spark, d):
    c, fc = r("commits"), r("file_changes")
    buckets = velocity.velocity(r("activity"))
    parts = [findings.classify_bus_factor(c.groupBy("author").agg(F.count("*").alias("commits"))), findings.classify_ownership(history.ownership(c, fc)), findings.classify_hotspots(szz.lifetimes(r("szz_matches"), "file")),
             findings.classify_velocity(velocity.trend(buckets), velocity.slope(buckets), velocity.gini(r("activity")), velocity.burnout_share(r("activity")))]
    return findings.report(written(findings.union(parts)), "pm")


@query(None)
def code_review_report(r, spark, d):
    r = _once(r, "commits", "file_changes")
    c, fc = r("commits"), r("file_changes")
    parts = [findings.classify_secrets(security.secrets(text.text_lines(r("files")), "line"), "path"), findings.classify_complexity(_proxy(r)), findings.classify_clean_code(text.clean_code(r("files"))),
             findings.classify_lexical(lexical.lexical_suite(r("files"))), findings.classify_ownership(history.ownership(c, fc)), findings.classify_top_decile(history.file_churn(fc), "churn", "codeQuality", "changes"),
             findings.classify_hotspots(_hot(r))]
    return findings.report(findings.in_refactoring_context(written(findings.union(parts)), fc.where("status = 'R'")), "code_review", targets=findings.refactoring_targets(history.file_churn(fc), _proxy(r)))


@query(_bucket("week", "%Y-%m-%d").replace("AS burnout", "AS off_hours"), "activity")
def streaming_velocity(r, spark, d):
    """Weekly counts by Structured Streaming over the events, run to its end."""
    return streaming.weekly_counts(spark, d)


from . import workspace  # noqa: E402, F401
