"""Window computations that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.session import written


def threshold_prefix(df: DataFrame, by: list[str], weight: str, order: list[Column], share: float) -> DataFrame:
    """The smallest prefix of each group, largest weights first, whose sum reaches `share` of the group's.

    order is by falling weight, then by what breaks ties. Without groups no task holds all rows:
    rows of equal weight are counted as one level, and only the level that the share ends in is
    ordered.
    """
    if not by:
        return _prefix_of_all(df, weight, order[1:], share)
    part = W.partitionBy(*[F.col(c) for c in by])
    running = part.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = df.withColumn("__total", F.sum(weight).over(part)).withColumn("__cum", F.sum(weight).over(running))
    return out.where(F.col("__cum") - F.col(weight) < share * F.col("__total")).drop("__cum", "__total")


def _prefix_of_all(df, weight, ties, share):
    levels = df.groupBy(F.col(weight).alias("__w")).agg(F.count("*").alias("__k"))
    whole = W.partitionBy(F.lit(1))
    mass = F.col("__w") * F.col("__k")
    levels = levels.withColumn("__total", F.sum(mass).over(whole)).withColumn("__before", F.sum(mass).over(whole.orderBy(F.desc("__w")).rowsBetween(W.unboundedPreceding, 0)) - mass)
    left = share * F.col("__total") - F.col("__before")
    levels = levels.where(left > 0).withColumn("__take", F.least(F.col("__k"), F.ceil(left / F.col("__w"))))
    whole_levels = df.join(levels.where("__take = __k").select("__w"), df[weight] == F.col("__w"), "left_semi")
    last = levels.where("__take < __k").select("__w", "__take").first()
    if last is None:
        return whole_levels
    return whole_levels.unionByName(df.where(F.col(weight) == last["__w"]).orderBy(*ties).limit(last["__take"]))


def top_one(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group; order must break ties."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")


def rank_share(df: DataFrame, value: str, name: str) -> DataFrame:
    """`df`, written once as it is read twice, with the share of values that are not larger; only distinct values are ordered."""
    df = written(df)
    levels = df.groupBy(F.col(value).alias("__v")).agg(F.count("*").alias("__k"))
    whole = W.partitionBy(F.lit(1))
    share = F.sum("__k").over(whole.orderBy("__v").rowsBetween(W.unboundedPreceding, 0)) / F.sum("__k").over(whole)
    ranks = levels.select(F.col("__v"), share.alias(name))
    return df.join(ranks, df[value].eqNullSafe(ranks["__v"])).drop("__v")


def carry_forward(value: str, by: list[str], order: str) -> Column:
    """The last value that isn't null up to each row."""
    return F.last(value, ignorenulls=True).over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0))


def islands(df: DataFrame, by: list[str], number: str) -> DataFrame:
    """(by, first, last) of runs of consecutive numbers; null numbers of a group are one run.

    Rows are sorted once, by group, and no task keeps them in a hash table: a run's last row takes the
    largest first number up to its own, whatever the order of equal rows.
    """
    order = W.partitionBy(*by).orderBy(number)
    n, before, after = F.col(number), F.col("__before"), F.col("__after")
    d = df.select(*by, number, F.lag(number).over(order).alias("__before"), F.lead(number).over(order).alias("__after"), F.row_number().over(order).alias("__n"))
    opens = before.isNull() | (before != n) & (before != n - 1)
    closes = F.when(n.isNull(), F.col("__n") == 1).otherwise(after.isNull() | (after != n) & (after - 1 != n))
    d = d.select(*by, number, closes.alias("__closes"), F.max(F.when(opens, n)).over(order).alias("first"))
    return d.where("__closes").select(*by, "first", n.alias("last"))


def order_statistics(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Linear-interpolated median, quartiles, their distance, and ninth decile; 0 for no rows."""
    q = lambda p: F.coalesce(F.percentile(value, F.lit(p)), F.lit(0.0))
    aggs = [q(0.5).alias("median"), q(0.25).alias("q1"), q(0.75).alias("q3"), (q(0.75) - q(0.25)).alias("iqr"), q(0.9).alias("p90")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
