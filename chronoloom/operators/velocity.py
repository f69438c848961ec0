"""Commits over time: buckets, trend, anomalies, inequality, slope, off-hours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OFF_HOURS = (9, 17)


def off_hours(ts, start: int = OFF_HOURS[0], end: int = OFF_HOURS[1]):
    return (F.hour(ts) < start) | (F.hour(ts) >= end)


def clock(commits: DataFrame) -> str:
    """The column of the author's own wall clock; times without zone are taken as such."""
    return "ts_local" if "ts_local" in commits.columns else "ts"


def _period(commits, granularity):
    start = F.date_trunc(granularity.upper(), F.col(clock(commits)))
    return F.date_format(start, "yyyy-MM" if granularity == "month" else "yyyy-MM-dd").alias("period")


def velocity(commits: DataFrame, granularity: str = "week") -> DataFrame:
    """(period, total, burnout) by day, week from Monday, or month of the author's clock, in order; no empty ones."""
    return commits.groupBy(_period(commits, granularity)).agg(F.count("*").alias("total"), F.count_if(off_hours(clock(commits))).alias("burnout")).orderBy("period")


def velocity_by_author(commits: DataFrame, granularity: str = "week") -> DataFrame:
    return commits.groupBy(_period(commits, granularity), "author").agg(F.count("*").alias("commits"))


def _numbered(buckets: DataFrame) -> DataFrame:
    whole = W.partitionBy(F.lit(1))
    return buckets.withColumn("i", F.row_number().over(whole.orderBy("period")) - 1).withColumn("n", F.count("*").over(whole))


def trend(buckets: DataFrame) -> DataFrame:
    """One row: trend by the means of both halves; the odd bucket belongs to the second."""
    half = F.floor(F.col("n") / 2)
    a = _numbered(buckets).agg(F.max("n").alias("n"), F.avg(F.when(F.col("i") < half, F.col("total"))).alias("first"), F.avg(F.when(F.col("i") >= half, F.col("total"))).alias("second"))
    word = F.when(F.coalesce("n", F.lit(0)) < 4, "stable").when(F.col("second") > F.col("first") * 1.2, "accelerating").when(F.col("second") < F.col("first") * 0.8, "decelerating").otherwise("stable")
    return a.select(F.coalesce("n", F.lit(0)).alias("buckets"), word.alias("trend"))


def anomalies(buckets: DataFrame) -> DataFrame:
    """Buckets above the mean by more than two population deviations, of three at least."""
    s = buckets.agg(F.count("*").alias("__n"), F.avg("total").alias("__mean"), F.stddev_pop("total").alias("__sd"))
    return buckets.crossJoin(F.broadcast(s)).where("__n >= 3 and total > __mean + 2 * __sd").select("period", "total")


def gini(commits: DataFrame) -> DataFrame:
    """One row: inequality of commits among authors, as numerator and denominator."""
    each = commits.groupBy("author").agg(F.count("*").alias("x"))
    # equal counts share one row, so that only distinct counts are ordered
    level = each.groupBy("x").agg(F.count("*").alias("k"))
    below = F.coalesce(F.sum("k").over(W.partitionBy(F.lit(1)).orderBy("x").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("k").over(W.partitionBy(F.lit(1)))
    part = level.withColumn("__b", below).withColumn("__n", whole)
    num = F.sum(F.col("x") * F.col("k") * (2 * F.col("__b") + F.col("k") - F.col("__n")))
    return part.agg(num.alias("numerator"), (F.max("__n") * F.sum(F.col("x") * F.col("k"))).alias("denominator"))


def slope(buckets: DataFrame) -> DataFrame:
    """One row: numerator and denominator of the least-squares slope over bucket numbers."""
    i, y = F.col("i").cast("long"), F.col("total")
    a = _numbered(buckets).agg(F.count("*").alias("n"), F.sum(i).alias("si"), F.sum(y).alias("sy"), F.sum(i * y).alias("siy"), F.sum(i * i).alias("sii"))
    return a.select((F.col("n") * F.col("siy") - F.col("si") * F.col("sy")).alias("numerator"), (F.col("n") * F.col("sii") - F.col("si") * F.col("si")).alias("denominator"))


def burnout_commits(commits: DataFrame, start: int = OFF_HOURS[0], end: int = OFF_HOURS[1]) -> DataFrame:
    ts = clock(commits)
    text = F.concat(F.lit("["), "rev", F.lit("] - "), "author", F.lit(" - "), "subject", F.lit(" ("), F.date_format(ts, "HH:mm"), F.lit(")"))
    return commits.where(off_hours(ts, start, end)).select("rev", text.alias("described"))


def burnout_share(commits: DataFrame) -> DataFrame:
    return commits.agg(F.count_if(off_hours(clock(commits))).alias("burnout"), F.count("*").alias("total"))


def velocity_summary(commits: DataFrame, granularity: str = "week") -> DataFrame:
    """One row: periods, commits, their mean by period, out of hours, trend, slope and inequality (null where undefined)."""
    buckets = velocity(commits, granularity)
    ratio = lambda df, name: df.select((F.col("numerator") / F.nullif("denominator", F.lit(0))).alias(name))
    whole = buckets.agg(F.count("*").alias("periods"), F.coalesce(F.sum("total"), F.lit(0)).alias("commits"), F.avg("total").alias("mean"), F.coalesce(F.sum("burnout"), F.lit(0)).alias("burnout"))
    return whole.crossJoin(trend(buckets).select("trend")).crossJoin(ratio(slope(buckets), "slope")).crossJoin(ratio(gini(commits), "gini"))
