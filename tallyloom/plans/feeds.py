"""Feed servers in a range of time, masked as lists show them, and the cards over all."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.identity import mask_did, mask_server
from tallyloom.plans.views import event_logs_summary


def servers(event_logs: DataFrame, start: str, end: str, inclusive_end: bool = False) -> DataFrame:
    """(server_did, unique_creator_did, unique_creator_rkey, min_create_at, max_create_at) of events in the range; its end is exclusive unless asked for.

    Nested sums: a server that holds most events is combined before each shuffle.
    """
    t, kind = F.col("create_at"), event_logs.schema["create_at"].dataType
    lo, hi = (F.lit(x).cast(kind) for x in (start, end))
    rows = event_logs.where((t >= lo) & ((t <= hi) if inclusive_end else (t < hi)))
    feeds = rows.groupBy("server_did", "creator_did", "rkey").agg(F.min(t).alias("lo"), F.max(t).alias("hi"))
    creators = feeds.groupBy("server_did", "creator_did").agg(F.count(F.lit(1)).alias("feeds"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return creators.groupBy("server_did").agg(F.count("creator_did").alias("unique_creator_did"), F.sum("feeds").alias("unique_creator_rkey"), F.min("lo").alias("min_create_at"), F.max("hi").alias("max_create_at"))


def masked(found: DataFrame, at_render: bool = False) -> DataFrame:
    """servers() with names hidden, before any search or sort; at_render hides what follows the method as well."""
    name = mask_server(F.col("server_did"), F.col("unique_creator_rkey"))
    return found.withColumn("server_did", mask_did(name) if at_render else name)


def cards(event_logs: DataFrame, as_of: datetime | str) -> DataFrame:
    """The summary row with feeds per creator (null without creators); missing numbers are 0."""
    one = event_logs_summary(event_logs, as_of)
    return one.select(*(F.coalesce(c, F.lit(0)).alias(c) for c in one.columns), F.try_divide("total_creator_rkeys", "total_creators").alias("feeds_per_creator"))
