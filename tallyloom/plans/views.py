"""The relations over the record log and the feed log. Each is a lazy DataFrame; order is the caller's (DEFAULT_ORDER)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.days import age_day, floor_day
from tallyloom.functions.identity import level2
from tallyloom.operators.timeseries import summary
from tallyloom.schema import PUBLISHER, RECENT, SCHEMA_COLLECTION, WEEK, at

#: What readers who ask for no order get; null times come first going down, last going up.
DEFAULT_ORDER: dict[str, list[str]] = {}


def _since(as_of: datetime | str, interval: str) -> Column:
    return at(as_of) - F.expr(interval)


def collection_count(collection: DataFrame, as_of: datetime | str, recent: str = RECENT) -> DataFrame:
    rows = collection.where(F.col("did") != PUBLISHER)
    return rows.groupBy("collection").agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col("createdAt") >= _since(as_of, recent)).alias("recent_count"), F.min("createdAt").alias("min"), F.max("createdAt").alias("max"))


def collection_daily_summary(collection: DataFrame, as_of: datetime | str) -> DataFrame:
    return collection.groupBy(age_day(F.col("createdAt"), as_of).alias("day")).agg(F.count(F.lit(1)).alias("count"))


def did_active_summary(collection: DataFrame, as_of: datetime | str, window: str = WEEK) -> DataFrame:
    rows = collection.where(F.col("createdAt") >= _since(as_of, window))
    return rows.groupBy(floor_day(F.col("createdAt"), as_of).alias("day")).agg(F.count_distinct("did").alias("count"))


def did_count(collection: DataFrame) -> DataFrame:
    return collection.groupBy("did").agg(F.count(F.lit(1)).alias("count"), F.min("createdAt").alias("min"), F.max("createdAt").alias("max"))


def active_collection_summary(daily_collection_stats: DataFrame) -> DataFrame:
    return summary(daily_collection_stats, "active_collection_count")


def new_collection_summary(daily_collection_stats: DataFrame) -> DataFrame:
    return summary(daily_collection_stats, "new_collection_count")


def active_did_summary(daily_active_did: DataFrame) -> DataFrame:
    return summary(daily_active_did, "active_did_count")


def new_did_summary(daily_active_did: DataFrame) -> DataFrame:
    return summary(daily_active_did, "new_did_count")


def collection_min_max_did(collection: DataFrame) -> DataFrame:
    """First and last record of each name, ties by did and rkey.

    One pass of least structs, which combine before the shuffle; a window would move all rows of a name to
    one task. Rows without a time stand last among the first and first among the last.
    """
    t = F.col("createdAt")
    first = F.min(F.struct(t.isNull().alias("n"), t.alias("t"), "did", "rkey"))
    last = F.min(F.struct(t.isNotNull().alias("n"), (-F.unix_micros(t.cast("timestamp"))).alias("m"), "did", "rkey", t.alias("t")))
    ends = collection.groupBy("collection").agg(first.alias("a"), last.alias("z"))
    return ends.select("collection", F.col("a.did").alias("min_did"), F.col("a.rkey").alias("min_rkey"), F.col("a.t").alias("min_created_at"), F.col("z.did").alias("max_did"), F.col("z.rkey").alias("max_rkey"), F.col("z.t").alias("max_created_at"))


def distinct_collections(collection: DataFrame) -> DataFrame:
    return collection.select("collection").distinct()


def distinct_schema_rkeys(collection: DataFrame) -> DataFrame:
    return collection.where((F.col("collection") == SCHEMA_COLLECTION) & (F.col("did") != PUBLISHER)).select("rkey").distinct()


def collection_lv2(collection: DataFrame) -> DataFrame:
    return collection.where(F.col("collection").contains(".")).select(level2(F.col("collection")).alias("nsidlv2")).distinct()


def _first_seen(event_logs: DataFrame, *key: str) -> DataFrame:
    return event_logs.groupBy(*key).agg(F.min("create_at").alias("first_seen"))


def event_logs_summary(event_logs: DataFrame, as_of: datetime | str, window: str = WEEK) -> DataFrame:
    """One row of totals and of what was first seen in the window.

    The log is reduced once to creator, feed and server; all six numbers come from that. Feeds are counted
    as `creator:feed` texts in the total and as pairs among the new.
    """
    since, new = _since(as_of, window), lambda: F.count_if(F.col("first_seen") >= since)
    base = event_logs.groupBy("creator_did", "rkey", "server_did").agg(F.min("create_at").alias("first_seen"))
    seen = lambda *key: base.groupBy(*key).agg(F.min("first_seen").alias("first_seen"))
    creators = seen("creator_did").agg(F.count("creator_did").alias("total_creators"), new().alias("new_creators"))
    servers = seen("server_did").agg(F.count("server_did").alias("total_servers"), new().alias("new_servers"))
    pairs = seen("creator_did", "rkey")
    feeds = pairs.agg(new().alias("new_creator_rkeys"))
    texts = pairs.select(F.concat("creator_did", F.lit(":"), "rkey").alias("t")).where("t is not null").distinct().agg(F.count("t").alias("total_creator_rkeys"))
    one = creators.crossJoin(servers).crossJoin(texts).crossJoin(feeds)  # one row each
    return one.select("total_creators", "total_servers", "total_creator_rkeys", "new_creators", "new_servers", "new_creator_rkeys")


def new_entities(event_logs: DataFrame, as_of: datetime | str, window: str = WEEK) -> DataFrame:
    return event_logs_summary(event_logs, as_of, window).select("new_creators", "new_servers", "new_creator_rkeys")


def new_creators(event_logs: DataFrame, as_of: datetime | str, window: str = WEEK) -> DataFrame:
    return _first_seen(event_logs, "creator_did").agg(F.count_if(F.col("first_seen") >= _since(as_of, window)).alias("count"))


def unique_did_count(collection: DataFrame) -> DataFrame:
    return collection.agg(F.count_distinct("did").alias("unique_did_count"))


def unique_did_count_view(unique_did: DataFrame) -> DataFrame:
    return unique_did.agg(F.count(F.lit(1)).alias("unique_did_count"))


def collection_stats(collection: DataFrame) -> DataFrame:
    """Distinct dids and records of each name in three nested sums: no row is multiplied, each level combines before its shuffle."""
    records = collection.groupBy("collection", "did", "rkey").agg(F.min("createdAt").alias("lo"), F.max("createdAt").alias("hi"), F.count(F.lit(1)).alias("n"))
    dids = records.groupBy("collection", "did").agg(F.count(F.lit(1)).alias("records"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    return dids.groupBy("collection").agg(F.count("did").alias("unique_did"), F.sum("records").alias("unique_rkey"), F.min("lo").alias("min_createdat"), F.max("hi").alias("max_createdat"), F.sum("n").alias("total_count"))


DEFAULT_ORDER |= {
    "collection_count_view": ["max desc"],
    "did_count_view": ["count desc"],
    **dict.fromkeys(("collection_daily_summary_view", "did_active_summary_view", "active_collection_summary_view", "new_collection_summary_view", "active_did_summary_view", "new_did_summary_view"), ["day"]),
}
