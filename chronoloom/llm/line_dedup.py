"""Line dedup by overlapping three-line windows.

The lines of a text, trimmed, form overlapping windows of three in a row; blank lines are passed
over. A window whose lines occur anywhere else in the corpus is repeated: its first occurrence
stays (smallest doc_id, then text hash, then position), and the lines that later ones cover are
removed, overlapping windows merged.

Windows are keyed by 128 bits of hash. Only hash, place and count are shuffled, and the first
occurrence is a minimum, which is combined before the shuffle: a window that is in every document
is no hot key.

Defined results: a null text stays null and an empty one empty, with 0 lines removed. A text of
fewer than three non-blank lines has no window and stays as it is. Rows equal in doc_id and text
are one document: each gets the same result. Null doc_ids come first in the order. Line ends are
U+000A; lines that stay, blank ones included, keep their exact bytes. Other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, table

#: Bytes up to which the table of removed places is broadcast; beyond, documents are joined by shuffle.
MAX_BROADCAST_BYTES = 8_000_000
P = "__line_"


def _windows(docs: DataFrame) -> DataFrame:
    """(h1, h2, doc, tie, places) of every window; places are line numbers from 0."""
    lines = F.split("text", "\n")
    numbered = F.transform(lines, lambda x, i: F.struct(F.trim(x).alias("t"), i.alias("i")))
    kept = F.filter(numbered, lambda x: x["t"] != "")
    base = docs.where(F.instr("text", "\n") > 0).select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("tie"), kept.alias("l"))
    base = base.where(F.size("l") >= 3)
    at = F.sequence(F.lit(0), F.size("l") - 3)
    window = F.transform(at, lambda i: F.struct(
        F.xxhash64(F.get("l", i)["t"], F.get("l", i + 1)["t"], F.get("l", i + 2)["t"]).alias("h1"),
        F.xxhash64(F.lit("second"), F.get("l", i + 2)["t"], F.get("l", i)["t"], F.get("l", i + 1)["t"]).alias("h2"),
        F.get("l", i)["i"].alias("a"), F.get("l", i + 1)["i"].alias("b"), F.get("l", i + 2)["i"].alias("c"),
    ))
    return base.select("doc", "tie", F.explode(window).alias("w")).select("doc", "tie", "w.*")


def removed_places(docs: DataFrame) -> DataFrame:
    """(doc, tie, places) of the documents that lose lines."""
    windows = _windows(docs)
    first = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("doc", "tie", "a")).alias("first")).where("n > 1").select("h1", "h2", "first")
    again = windows.join(first, ["h1", "h2"]).where(~F.struct("doc", "tie", "a").eqNullSafe(F.col("first")))
    return again.groupBy("doc", "tie").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array("a", "b", "c"))))).alias("places"))


def dedup_lines(docs: DataFrame, with_count: bool = False) -> DataFrame:
    """`docs` with the lines of later occurrences removed from `text`; with_count adds n_removed."""
    gone = removed_places(docs).select(F.col("doc").alias(P + "doc"), F.col("tie").alias(P + "tie"), F.col("places").alias(P + "places"))
    gone = checkpointed(gone)
    size = gone.agg(F.coalesce(F.sum(F.size(P + "places") * 4 + 48), F.lit(0))).first()[0]
    gone = F.broadcast(gone) if size <= MAX_BROADCAST_BYTES else gone
    joined = docs.join(gone, docs["doc_id"].eqNullSafe(F.col(P + "doc")) & (F.xxhash64(docs["text"]) == F.col(P + "tie")), "left")
    places = F.col(P + "places")

    def without(lines):
        """What lies between removed places, so that the work is linear in lines and places."""

        def run(i):
            start = F.when(i == 0, 0).otherwise(F.get(places, i - 1) + 1)
            return F.slice(lines, start + 1, F.coalesce(F.get(places, i), F.size(lines)) - start)

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(places)), run)), "\n")

    text = F.when(places.isNull(), F.col("text")).otherwise(F.get(F.transform(F.array(F.split("text", "\n")), without), 0))
    out = [text.alias("text") if c == "text" else docs[c] for c in docs.columns]
    if with_count:
        out.append(F.coalesce(F.size(P + "places"), F.lit(0)).cast("long").alias("n_removed"))
    return joined.select(*out)


def query(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), with_count=True)


ORACLE_SQL = """
WITH l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
f AS (
  SELECT doc_id, text, i, trim(line, ' ') AS t, row_number() OVER (PARTITION BY doc_id, text ORDER BY i) AS k
  FROM l WHERE trim(line, ' ') <> ''),
w AS (
  SELECT a.doc_id, a.text, a.i AS a, b.i AS b, c.i AS c, a.t || chr(10) || b.t || chr(10) || c.t AS window_text
  FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.text = b.text AND b.k = a.k + 1
  JOIN f c ON a.doc_id = c.doc_id AND a.text = c.text AND c.k = a.k + 2),
r AS (SELECT *, row_number() OVER (PARTITION BY window_text ORDER BY doc_id, a) AS nth FROM w),
g AS (
  SELECT DISTINCT doc_id, text, unnest([a, b, c]) AS i FROM r WHERE nth > 1),
k AS (
  SELECT l.doc_id, l.text, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL) AS kept, count(g.i) AS n_removed
  FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.text = l.text AND g.i = l.i GROUP BY 1, 2)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.kept, '') END AS text, coalesce(k.n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id AND k.text = d.text
"""
