"""Calendar spines, gap filling, buckets and labels."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.schema import BUCKET_DAYS, FEED_START, SPINE_DAYS


def summary(daily: DataFrame, measure: str, days: int = SPINE_DAYS) -> DataFrame:
    """(day, count) for the newest day of daily (1) and the days before it, days + 1 rows; days that are missing count 0, an empty daily gives none.

    The spine is days + 1 rows whatever the table holds, so it is what gets broadcast.
    """
    newest = daily.agg(F.max("day").alias("newest"))
    spine = newest.where("newest is not null").select("newest", F.explode(F.sequence(F.date_sub("newest", days), F.col("newest"), F.expr("INTERVAL 1 DAY"))).alias("spine_day"))
    joined = spine.join(daily.select(F.col("day").alias("d"), F.col(measure).alias("n")), F.col("spine_day") == F.col("d"), "left")
    return joined.select((F.datediff("newest", "spine_day") + 1).alias("day"), F.coalesce("n", F.lit(0)).cast("long").alias("count"))


def gap_fill(series: DataFrame, order: str | None = None) -> DataFrame:
    """(day, count) for each whole number from the least day to the largest; missing ones count 0.

    Of a day that repeats the last count is taken, by the column named as order; rows of a DataFrame have no
    order of their own, so without it the largest is.
    """
    once = series.groupBy("day").agg((F.max_by("count", order) if order else F.max("count")).alias("count"))
    ends = once.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).where("lo is not null")
    spine = ends.select(F.explode(F.sequence("lo", "hi")).alias("day"))
    return spine.join(once, "day", "left").select("day", F.coalesce("count", F.lit(0)).alias("count"))


def buckets(series: DataFrame, size: int = BUCKET_DAYS) -> DataFrame:
    """(bucket, count): sums of size days each, from the newest; the last bucket may be short."""
    least = series.agg(F.min("day").alias("lo"))
    return series.crossJoin(F.broadcast(least)).groupBy(F.floor((F.col("day") - F.col("lo")) / size).cast("long").alias("bucket")).agg(F.sum("count").cast("long").alias("count"))


def day_label(day: Column) -> Column:
    """`0` for the newest day, `-n` for those before it."""
    return F.when(day == 1, "0").otherwise((1 - day).cast("string"))


def bucket_label(bucket: Column, size: int = BUCKET_DAYS) -> Column:
    return (-(bucket + 1) * size).cast("string")


def event_label(day: Column) -> Column:
    return F.when(day == 1, "Today").otherwise((1 - day).cast("string"))


def axis_top(count: Column, rounded: bool = False) -> Column:
    """The end of an axis: the largest count and a twentieth, or the next thousand."""
    return F.ceil(F.max(count) / 1000) * 1000 if rounded else F.max(count) * 1.05


def chart(series: DataFrame, days: int) -> DataFrame:
    """(ordinal, label, count), oldest first by ordinal: the newest days of a summary, filled, in buckets if there are more than 30.

    The series is restated by its day, as no order survives a view.
    """
    newest = gap_fill(series.orderBy("day").limit(days))
    if days > BUCKET_DAYS:
        rows = buckets(newest).select(F.col("bucket").alias("n"), bucket_label(F.col("bucket")).alias("label"), "count")
    else:
        rows = newest.select(F.col("day").cast("long").alias("n"), day_label(F.col("day")).alias("label"), "count")
    return rows.withColumn("ordinal", F.row_number().over(Window.orderBy(F.desc("n")))).select("ordinal", "label", "count")  # at most a few hundred rows


def event_chart(events: DataFrame, days: int) -> DataFrame:
    """(ordinal, label, count): the newest days that are there, oldest first; nothing is filled in."""
    newest = events.orderBy(F.asc_nulls_last("day")).limit(days)
    return newest.select(F.row_number().over(Window.orderBy(F.desc_nulls_first("day"))).alias("ordinal"), event_label(F.col("day")).alias("label"), "count")


def months(spark: SparkSession, as_of: datetime | date | str, start: str = FEED_START) -> DataFrame:
    """(month, label, value): first days of the months from as_of's back to start."""
    first = F.trunc(F.lit(str(as_of)[:10]).cast("date"), "MM")
    listed = spark.range(1).select(F.explode(F.sequence(first, F.lit(start).cast("date"), F.expr("INTERVAL -1 MONTH"))).alias("month"))
    return listed.select("month", F.date_format("month", "MMM yyyy").alias("label"), F.date_format("month", "yyyy-MM").alias("value"))


def month_bounds(choice: str, as_of: datetime | str) -> tuple[str, str]:
    """Start and end (exclusive) of `all` or of a month `YYYY-MM`, in UTC."""
    if choice == "all":
        return f"{FEED_START} 00:00:00", str(as_of)
    year, month = map(int, choice.split("-"))
    return f"{year:04d}-{month:02d}-01 00:00:00", f"{year + month // 12:04d}-{month % 12 + 1:02d}-01 00:00:00"
