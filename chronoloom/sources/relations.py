"""Canonical relations, and adapters that present other tables as them.

commits(seq, rev, author, email, sig, ts, subject, is_merge)   seq: log order, larger is newer
file_changes(rev, file, old_file, status, insertions, deletions)
diff_lines(rev, file, hunk, line_seq, op, old_line, content)   op: + - or blank
blame_lines(rev, file, line_no, intro_rev, intro_author, intro_ts)
files(path, content)    refs(kind, name, rev)    codeowners(rule_idx, pattern, owners)
layers(layer, pattern)  dependencies(ecosystem, manifest, name, declared)  registry_versions(ecosystem, name, latest)

The adapter texts are SQL that Spark and DuckDB both run, so that a query and its oracle start from
the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "commits": "seq bigint, rev string, author string, email string, sig string, ts timestamp, subject string, is_merge boolean",
    "file_changes": "rev string, file string, old_file string, status string, insertions bigint, deletions bigint",
    "diff_lines": "rev string, file string, hunk int, line_seq int, op string, old_line int, content string",
    "blame_lines": "rev string, file string, line_no int, intro_rev string, intro_author string, intro_ts timestamp",
    "files": "path string, content string",
    "refs": "kind string, name string, rev string",
    "codeowners": "rule_idx int, pattern string, owners string",
    "layers": "layer string, pattern string",
    "dependencies": "ecosystem string, manifest string, name string, declared string",
    "registry_versions": "ecosystem string, name string, latest string",
}

ADAPTERS = {
    "commits": """
SELECT CAST(o_orderkey AS BIGINT) AS seq, CAST(o_orderkey AS STRING) AS rev, concat('dev', CAST(o_custkey % 150 AS STRING)) AS author,
  concat('dev', CAST(o_custkey % 150 AS STRING), CASE WHEN o_custkey % 10 = 0 THEN '@other.org' ELSE '@example.com' END) AS email,
  CASE o_orderstatus WHEN 'F' THEN 'G' WHEN 'O' THEN 'N' ELSE 'B' END AS sig, o_orderdate AS ts,
  CASE WHEN o_orderpriority = '1-URGENT' THEN concat('fix: defect ', CAST(o_orderkey AS STRING)) WHEN o_orderpriority = '2-HIGH' THEN 'feat(core): new option'
    WHEN o_orderpriority = '3-MEDIUM' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'refactor: rewrite parser' ELSE 'resolve issue in format' END
    WHEN o_orderpriority = '4-NOT SPECIFIED' THEN CASE WHEN o_orderkey % 7 = 0 THEN 'temporary hack, TODO' ELSE 'update notes' END
    ELSE CASE WHEN o_orderkey % 11 = 0 THEN 'feat!: BREAKING CHANGE of layout' WHEN o_orderkey % 13 = 0 THEN '' ELSE 'docs: readme' END END AS subject,
  o_orderkey % 17 = 0 AS is_merge
FROM orders""",
    "file_changes": """
SELECT CAST(l_orderkey AS STRING) AS rev, concat(p_brand, '/', p_type, '/f', CAST(l_partkey AS STRING), CASE WHEN l_partkey % 9 = 0 THEN '.md' ELSE '.py' END) AS file,
  CASE WHEN l_partkey % 50 = 0 THEN concat('old/f', CAST(l_partkey AS STRING)) END AS old_file, CASE WHEN l_partkey % 50 = 0 THEN 'R' ELSE 'M' END AS status,
  CAST(sum(l_quantity) AS BIGINT) AS insertions, CAST(sum(l_linenumber) AS BIGINT) AS deletions
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey, l_partkey, p_brand, p_type""",
    "activity": """
SELECT CAST(event_id AS BIGINT) AS seq, CAST(event_id AS STRING) AS rev, concat('u', CAST(user_id AS STRING)) AS author, ts, event_type AS subject
FROM events""",
    "files": "SELECT concat(source, '/', CAST(doc_id AS STRING), '.txt') AS path, text AS content FROM documents",
    "szz_matches": """
SELECT CAST(l_orderkey AS STRING) AS intro_rev, o_orderdate AS intro_ts, concat('dev', CAST(o_custkey % 150 AS STRING)) AS intro_author,
  concat(CAST(l_orderkey AS STRING), ':', CAST(l_linenumber AS STRING)) AS fix_rev, l_shipdate AS fix_ts, concat('f', CAST(l_partkey AS STRING)) AS file
FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "layers": "SELECT DISTINCT p_type AS layer, concat('/', p_type, '/') AS pattern FROM part",
}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of ADAPTERS over the Parquet tables in a folder."""
    text = ADAPTERS[name]
    for t in ("orders", "lineitem", "part", "events", "documents", "nation"):
        for word in ("FROM", "JOIN"):
            text = text.replace(f"{word} {t}", f"{word} parquet.`{sf_dir}/{t}.parquet`")
    return spark.sql(text)


def with_sql(body: str, *names: str) -> str:
    """DuckDB SQL that defines the named relations before `body`."""
    heads = [f"{n} AS ({ADAPTERS[n]})" for n in names]
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join(heads)}, {body[5:]}"
    return f"WITH {', '.join(heads)} {body}"


_FILE = "concat(p_brand, '/', p_type, '/f', CAST(l_partkey AS STRING), CASE WHEN l_partkey % 9 = 0 THEN '.md' ELSE '.py' END)"
#: Relations made for what the tables lack: parents, renames, refs, patches, manifests, findings.
ADAPTERS |= {
    "parents": """
SELECT CAST(o_orderkey AS STRING) AS rev, CAST(o_orderkey - 1 AS STRING) AS parent FROM orders WHERE o_orderkey % 8 <> 1 AND o_orderkey > 1
UNION ALL SELECT CAST(o_orderkey AS STRING), CAST(CAST(floor(o_orderkey / 2) AS BIGINT) AS STRING) FROM orders WHERE o_orderkey % 16 = 0""",
    "renamed": """
SELECT CAST(p_partkey AS STRING) AS rev, concat('n', CAST(p_partkey AS STRING)) AS file,
  CASE WHEN p_partkey > 2 THEN concat('n', CAST(CAST(floor(p_partkey / 3) AS BIGINT) AS STRING)) END AS old_file FROM part""",
    "refs": "SELECT CASE WHEN n_regionkey = 4 THEN 'branch' ELSE 'tag' END AS kind, concat('v', n_name) AS name, CAST(n_nationkey AS STRING) AS rev FROM nation",
    "patch_lines": f"""
SELECT CAST(l_orderkey AS STRING) AS rev, {_FILE} AS file, CAST(l_partkey % 3 AS INT) AS hunk, 1 AS line_seq, '+' AS op, repeat(' if (a) b;', CAST(sum(l_linenumber) AS INT)) AS content
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey, l_partkey, p_brand, p_type
UNION ALL
SELECT DISTINCT CAST(l_orderkey AS STRING), {_FILE}, CAST(l_partkey % 3 AS INT), 2, CASE WHEN l_partkey % 2 = 0 THEN '+' ELSE '-' END,
  CASE WHEN l_partkey % 5 = 0 THEN '// about it' WHEN l_partkey % 7 = 0 THEN 'temporary; call(a)' ELSE 'call(b)' END
FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "manifest_files": """
SELECT concat('m', CAST(p_partkey AS STRING), '/', CASE p_size % 6 WHEN 0 THEN 'pubspec.yaml' WHEN 1 THEN 'package.json' WHEN 2 THEN 'requirements.txt' WHEN 3 THEN 'go.mod' WHEN 4 THEN 'Cargo.toml' ELSE 'Gemfile' END) AS path,
  replace(CASE p_size % 6
    WHEN 0 THEN 'name: x|dependencies:|  one: 1.2.3|  two: ^1.0.0|  three: 1|  four: "path:../x"|other: 1.0.0'
    WHEN 1 THEN '{"name": "x", "dependencies": {"one": "1.2.3", "two": "^1.0.0", "three": "latest"}, "devDependencies": {"four": "2.0.0"}}'
    WHEN 2 THEN '# needs|one==1.2|two>=1.0|three|'
    WHEN 3 THEN 'module x|go 1.21|require (|  a.org/one v1.2.3|  a.org/two v0.1.0 // indirect|)|'
    WHEN 4 THEN '[package]|version = "1.0.0"|[dependencies]|one = "1.0.100"|two = "1"|three = { version = "=1.2" }|[features]|four = "1.0.0"'
    ELSE 'source "x"|gem "one", ">= 5.0"|gem "two", "~> 1.0"|gem "three"|' END, '|', chr(10)) AS content
FROM part
UNION ALL
SELECT concat('m', CAST(p_partkey AS STRING), '/', CASE p_size % 6 WHEN 0 THEN 'pubspec.lock' WHEN 1 THEN 'package-lock.json' WHEN 2 THEN 'poetry.lock' WHEN 3 THEN 'go.sum' WHEN 4 THEN 'Cargo.lock' ELSE 'Gemfile.lock' END), ''
FROM part WHERE p_partkey % 3 <> 0""",
    "made_findings": """
SELECT CASE p_partkey % 10 WHEN 0 THEN 'bugHotspot' WHEN 1 THEN 'ownership' WHEN 2 THEN 'ownership' WHEN 3 THEN 'complexity' WHEN 4 THEN 'churn' WHEN 5 THEN 'coupling' WHEN 6 THEN 'lexicalComplexity' WHEN 7 THEN 'secret' WHEN 8 THEN 'dependency' ELSE 'velocity' END AS category,
  CASE WHEN p_partkey % 10 = 7 AND p_size % 2 = 0 THEN concat('config/f', CAST(p_size AS STRING)) WHEN p_partkey % 10 = 9 THEN 'repository' ELSE concat('src/f', CAST(p_size AS STRING)) END AS subject,
  CASE p_partkey % 10 WHEN 1 THEN 'single_author_ownership' WHEN 2 THEN 'minor_contributor_count' WHEN 9 THEN CASE WHEN p_size % 2 = 0 THEN 'burnout_commit_share' ELSE 'author_gini' END ELSE concat('m', CAST(p_partkey AS STRING)) END AS metric,
  CASE p_size % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'elevated' WHEN 3 THEN 'moderate' ELSE 'low' END AS severity,
  CASE p_size % 5 WHEN 0 THEN 7 WHEN 1 THEN 6 WHEN 2 THEN 4 WHEN 3 THEN 5 ELSE 3 END AS severity_rank,
  CAST(p_partkey AS DOUBLE) AS value_num, CAST(NULL AS STRING) AS value_str, concat('band ', CAST(p_partkey AS STRING)) AS band,
  CASE p_partkey % 10 WHEN 1 THEN concat('{"top_author":"dev', CAST(p_size % 4 AS STRING), '"}') WHEN 5 THEN CASE WHEN p_partkey % 20 = 5 THEN '{"cross_module":true}' ELSE '{"cross_module":false}' END ELSE '{}' END AS evidence
FROM part""",
}
ADAPTERS["code_files"] = """
SELECT concat('lib/c', CAST(p_partkey AS STRING), '.dart') AS path,
  replace(concat('import "a.dart";|class C {|  int sum(int a) {|    return _add(a) + _add(1);|  }|  int _add(int a) => a;|', CASE WHEN p_size % 2 = 0 THEN '  void go() { print(sum(2)); }|' ELSE '' END, '}|'), '|', chr(10)) AS content
FROM part"""
