"""Mixing sources to target weights, by Efraimidis-Spirakis sampling.

Every document gets an exponential key -ln(u) / w: u is uniform from a hash of seed, epoch and
doc_id, w its quality weight. Sorted by key within its source, documents form a weighted sample
without replacement at every length, so the sample of a token budget is a prefix by token sums. A
budget above the source's tokens first takes the source whole as often as it fits (complete
epochs), then selects the rest by keys.

Target weights are given by source (a dict, or a DataFrame of source and weight); without them a
source's weight is its number of tokens to the power of `temperature`.

Prefix sums don't need a source on one machine: keys are cut into bands of about equal mass by a
function of the key alone, as many as the rows need, sums of bands are added up, and a window runs
in each (source, band) only.

Whole documents are not sorted: what a source gives is a prefix of its order, so the last row of the
prefix is found on the narrow table, and documents are held against it where they lie.

Defined results: tokens are runs of characters above U+0020. Rows with null text or no tokens are
left out. A null source is a source of its own; sources without target, or with one that is null or
not above 0, take no part. A quality label other than 0 and 1 has the weight of none. doc_id may be of
any type. Null doc_ids hash as -1. Ties of keys are broken by doc_id, then text; rows equal in both are interchangeable
and each counts. An epoch is numbered from 1; `copy_no` says which pass a row belongs to. A
document that crosses the end of the budget is left out, so the budget is never exceeded. Other
columns are kept when asked for with `keep`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpointed, shuffles_freed, table

SEED = 17
#: Rows that a band of keys should have at most, and the least number of bands.
BAND_ROWS, LEAST_BANDS = 100_000, 16
#: Labels, and cuts of sources, up to which they are broadcast; beyond, the same join is done by shuffle.
MAX_BROADCAST_ROWS = 500_000
#: Share of a source in the mixture: its share of tokens to this power, so small ones gain.
TEMPERATURE = 0.5
#: Tokens of the mixture as a share of the corpus.
BUDGET_PERCENT = 100
#: Weights by the label of quality; text without label has the middle one.
WEIGHTS = {1: 4, 0: 1, None: 2}
PREFIX = "__mix_"


def token_count(text):
    """Runs of characters above U+0020."""
    return F.regexp_count(text, F.lit("[^\\x00-\\x20]+")).cast("long")


def uniform(doc_id, epoch: int, seed: int):
    """A number in (0, 1) from the first 52 bits of an MD5, alike in Spark and SQL."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), F.coalesce(doc_id.cast("string"), F.lit("-1"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def best_labels(labels: DataFrame) -> DataFrame:
    """One label of quality for each document; several count as the best."""
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").alias(PREFIX + "label_id")).agg(F.max("quality").alias(PREFIX + "quality"))


def quality_weights(docs: DataFrame, best: DataFrame) -> DataFrame:
    """`docs` with the weight of its quality label."""
    weight = F.when(F.col(PREFIX + "quality") == 1, WEIGHTS[1]).when(F.col(PREFIX + "quality") == 0, WEIGHTS[0]).otherwise(WEIGHTS[None])
    joined = docs.join(best, docs["doc_id"] == best[PREFIX + "label_id"], "left")
    return joined.withColumn(PREFIX + "weight", weight).drop(PREFIX + "label_id", PREFIX + "quality")


def source_key(source):
    """A null source is one of its own."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def source_targets(sizes: DataFrame, temperature: float = TEMPERATURE, percent: int = BUDGET_PERCENT, targets=None) -> DataFrame:
    """Token budgets by source from (source, tokens): few rows, one for each source.

    targets: {source: weight}, a DataFrame (source, weight), or None for weights by temperature.
    """
    p = PREFIX
    every = W.partitionBy(F.lit(1))
    sizes = sizes.withColumn(p + "total", F.sum(p + "tokens").over(every))
    if targets is None:
        sizes = sizes.withColumn(p + "share", F.pow(F.col(p + "tokens").cast("double"), temperature))
    else:
        if isinstance(targets, dict):
            targets = sizes.sparkSession.createDataFrame([(k, float(v)) for k, v in targets.items()], "source string, weight double")
        given = targets.groupBy(source_key(F.col("source")).alias(p + "source")).agg(F.sum(F.col("weight").cast("double")).alias(p + "share"))
        sizes = sizes.join(given.where(F.col(p + "share") > 0), p + "source")
    budget = F.floor(F.col(p + "total") * percent / 100 * F.col(p + "share") / F.sum(p + "share").over(every))
    return sizes.withColumn(p + "budget", budget.cast("long"))


def _keyed(docs: DataFrame, best: DataFrame, seed: int) -> DataFrame:
    """Documents with their weight, source and key."""
    p = PREFIX
    base = quality_weights(docs, best).withColumn(p + "source", source_key(F.col("source")))
    return base.withColumn(p + "key", -F.log(uniform(F.col("doc_id"), 0, seed)) / F.col(p + "weight"))


def _ranked(docs: DataFrame, best: DataFrame, temperature: float, percent: int, seed: int, targets, columns=()) -> DataFrame:
    """A row for each document with tokens: position and tokens before it in its source, the source's
    whole epochs, and whether the rest of the budget holds it. The narrow table is written once."""
    p = PREFIX
    base = docs.select(F.col("doc_id"), F.col("source"), token_count(F.col("text")).alias(p + "n"), F.xxhash64("text").alias(p + "tie"), *columns)
    narrow = checkpointed(_keyed(base.where(F.col(p + "n") > 0), best, seed))
    sizes = checkpointed(narrow.groupBy(p + "source").agg(F.sum(p + "n").alias(p + "tokens"), F.count("*").alias(p + "rows")))
    most = sizes.agg(F.max(p + "rows")).first()[0] or 0
    n_bands = max(LEAST_BANDS, -(-most // BAND_ROWS))
    target = source_targets(sizes.drop(p + "rows"), temperature, percent, targets)
    plan = target.select(F.col(p + "source"), p + "tokens", p + "budget", F.floor(F.col(p + "budget") / F.col(p + "tokens")).cast("long").alias(p + "whole"))
    band = F.least(F.lit(n_bands - 1), F.floor(F.lit(n_bands) * (1 - F.exp(-2 * F.col(p + "key"))))).cast("int")
    keyed = narrow.withColumn(p + "band", band)
    bands = keyed.groupBy(p + "source", p + "band").agg(F.sum(p + "n").alias(p + "sum"), F.count("*").alias(p + "rows"))
    before = W.partitionBy(p + "source").orderBy(p + "band").rowsBetween(W.unboundedPreceding, -1)
    bands = bands.select(F.col(p + "source"), F.col(p + "band"), F.coalesce(F.sum(p + "sum").over(before), F.lit(0)).alias(p + "base"), F.coalesce(F.sum(p + "rows").over(before), F.lit(0)).alias(p + "base_rows"))
    offsets = bands.join(plan, p + "source")
    inside = W.partitionBy(p + "source", p + "band").orderBy(p + "key", "doc_id", p + "tie")
    run = keyed.join(offsets, [p + "source", p + "band"])
    run = run.withColumn(p + "nth", F.row_number().over(inside) - F.rank().over(inside) + 1)
    run = run.withColumn(p + "position", F.row_number().over(inside) + F.col(p + "base_rows"))
    run = run.withColumn(p + "before", F.sum(p + "n").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col(p + "n") + F.col(p + "base"))
    return run.withColumn(p + "fits", F.col(p + "before") + F.col(p + "n") <= F.col(p + "budget") - F.col(p + "whole") * F.col(p + "tokens"))


def mix_sources(docs: DataFrame, labels: DataFrame, temperature: float = TEMPERATURE, percent: int = BUDGET_PERCENT, seed: int = SEED, keep: list[str] | None = None, targets=None) -> DataFrame:
    """The mixture: (doc_id, source, copy_no, position, n_tokens, tokens_before) and `keep`.

    position counts a source's documents in an epoch by key, from 1; tokens_before are the tokens
    before a row in its source's budget. Columns of `keep` are sorted with the rest; for whole
    documents there is `mixed_documents`.
    """
    keep = keep or []
    p = PREFIX
    run = _ranked(docs, best_labels(labels), temperature, percent, seed, targets, [F.col(c).alias(p + "keep_" + c) for c in keep])
    copies = (F.col(p + "whole") + F.when(F.col(p + "fits"), 1).otherwise(0)).cast("int")
    out = run.where(copies > 0).withColumn(p + "copy", F.explode(F.sequence(F.lit(1), copies)))
    return out.select(
        "doc_id", "source", F.col(p + "copy").cast("long").alias("copy_no"), F.col(p + "position").cast("long").alias("position"), F.col(p + "n").alias("n_tokens"),
        ((F.col(p + "copy") - 1) * F.col(p + "tokens") + F.col(p + "before")).cast("long").alias("tokens_before"), *[F.col(p + "keep_" + c).alias(c) for c in keep if c not in ("doc_id", "source")],
    )


def mixed_documents(docs: DataFrame, labels: DataFrame, temperature: float = TEMPERATURE, percent: int = BUDGET_PERCENT, seed: int = SEED, targets=None) -> DataFrame:
    """The mixture with the columns of `docs`, a row for each time that a document is taken.

    Texts are not moved, unless there are more labels than are broadcast; then once, to join them.
    Of repeated rows on both sides of the end of a budget, which are interchangeable, as many are
    taken as fit: only these are numbered.
    """
    p = PREFIX
    best = checkpointed(best_labels(labels))
    best = broadcast_if_small(best, best.count(), MAX_BROADCAST_ROWS)
    with shuffles_freed(docs.sparkSession):
        run = _ranked(docs, best, temperature, percent, seed, targets)
    place = [F.col(p + "key").alias("key"), F.col("doc_id").alias("doc_id"), F.col(p + "tie").alias("tie")]
    last = F.max(F.when(F.col(p + "fits"), F.struct(*place, F.col(p + "nth").alias("nth")))).alias(p + "last")
    after = F.min(F.when(~F.col(p + "fits"), F.struct(*place))).alias(p + "after")
    cuts = run.groupBy(p + "source").agg(F.max(p + "whole").alias(p + "whole"), last, after)
    end = F.when(F.col(p + "last").isNotNull(), F.struct(*[F.col(f"{p}last.{k}").alias(k) for k in ("key", "doc_id", "tie")]))
    cuts = cuts.select(p + "source", p + "whole", end.alias(p + "end"), F.col(p + "last.nth").alias(p + "most"), F.coalesce(end == F.col(p + "after"), F.lit(False)).alias(p + "split"))
    cuts = checkpointed(cuts)
    sources, split = cuts.agg(F.count("*"), F.coalesce(F.max(p + "split"), F.lit(False))).first()
    rows = docs.where(F.col("text").rlike("[^\\x00-\\x20]")).withColumn(p + "tie", F.xxhash64("text"))
    rows = _keyed(rows, best, seed).join(broadcast_if_small(cuts, sources, MAX_BROADCAST_ROWS), p + "source")
    here = F.struct(*place)
    numbered = F.col(p + "split") & (here == F.col(p + "end"))
    inside = F.coalesce(here <= F.col(p + "end"), F.lit(False))
    if split:
        one = W.partitionBy(p + "source").orderBy(F.lit(1))
        tied = rows.where(numbered).withColumn(p + "in", F.row_number().over(one) <= F.col(p + "most"))
        rows = rows.where(~F.coalesce(numbered, F.lit(False))).withColumn(p + "in", inside).unionByName(tied)
    else:
        rows = rows.withColumn(p + "in", inside)
    copies = (F.col(p + "whole") + F.when(F.col(p + "in"), 1).otherwise(0)).cast("int")
    return rows.where(copies > 0).withColumn(p + "copy", F.explode(F.sequence(F.lit(1), copies))).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL = """
WITH q AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
b AS (
  SELECT d.doc_id, d.source, len(regexp_extract_all(d.text, '[^\\x00-\\x20]+'))::BIGINT AS n,
    CASE q.quality WHEN 1 THEN 4 WHEN 0 THEN 1 ELSE 2 END AS w
  FROM documents d LEFT JOIN q ON q.doc_id = d.doc_id WHERE d.text IS NOT NULL),
k AS (
  SELECT *, -ln((('0x' || substr(md5('17:0:' || coalesce(doc_id::VARCHAR, '-1')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / w AS key
  FROM b WHERE n > 0),
t AS (
  SELECT source, tokens, floor(total * 100 / 100 * sqrt(tokens) / sum(sqrt(tokens)) OVER ())::BIGINT AS budget
  FROM (SELECT source, sum(n)::BIGINT AS tokens, sum(sum(n)) OVER () AS total FROM k GROUP BY source)),
r AS (
  SELECT k.doc_id, k.source, k.n, t.tokens, t.budget, t.budget // t.tokens AS whole,
    row_number() OVER o AS position, (sum(k.n) OVER (o ROWS UNBOUNDED PRECEDING))::BIGINT - k.n AS before
  FROM k JOIN t ON t.source IS NOT DISTINCT FROM k.source WINDOW o AS (PARTITION BY k.source ORDER BY k.key, k.doc_id))
SELECT doc_id, source, copy_no, position, n AS n_tokens, ((copy_no - 1) * tokens + before)::BIGINT AS tokens_before
FROM (SELECT *, unnest(range(1, 1 + whole + CASE WHEN before + n <= budget - whole * tokens THEN 1 ELSE 0 END)) AS copy_no FROM r)
"""
