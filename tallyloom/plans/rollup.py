"""Daily roll-ups: yesterday's rows, backfills, and the merges that store them.

Selects give day rows only; a day without activity has none. First-seen tables (entity, first time) can be
kept and handed in, so that a nightly run reads one day of the log and not its history.
"""

from __future__ import annotations

import logging
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom import schema
from tallyloom.operators.upsert import upsert
from tallyloom.schema import PUBLISHER, at
from tallyloom.sources.storage import Store

log = logging.getLogger(__name__)


def _yesterday(collection: DataFrame, as_of: datetime | str) -> DataFrame:
    """Rows of the day before as_of's: bounds are literals, so they are pushed to the scan."""
    today = F.lit(str(as_of)[:10] + " 00:00:00").cast("timestamp_ntz")
    return collection.where((F.col("createdAt") >= today - F.expr("INTERVAL 1 DAY")) & (F.col("createdAt") < today))


def _without_publisher(collection: DataFrame) -> DataFrame:
    return collection.where(F.col("did") != PUBLISHER)


def first_seen(collection: DataFrame, entity: str) -> DataFrame:
    """(entity, first_at); an entity whose rows have no time has none."""
    return collection.groupBy(entity).agg(F.min("createdAt").alias("first_at"))


def _new_by_day(seen: DataFrame, name: str) -> DataFrame:
    return seen.groupBy(F.col("first_at").cast("date").alias("day")).agg(F.count(F.lit(1)).cast("int").alias(name))


def _active_by_day(rows: DataFrame, entity: str, name: str) -> DataFrame:
    return rows.groupBy(F.col("createdAt").cast("date").alias("day")).agg(F.count_distinct(entity).cast("int").alias(name))


def daily_active_did(collection: DataFrame, as_of: datetime | str, seen: DataFrame | None = None) -> DataFrame:
    """(day, active_did_count, new_did_count) for yesterday."""
    new = _new_by_day(_yesterday((seen if seen is not None else first_seen(collection, "did")).withColumnRenamed("first_at", "createdAt"), as_of).withColumnRenamed("createdAt", "first_at"), "new_did_count")
    active = _active_by_day(_yesterday(collection, as_of), "did", "active_did_count")
    return active.join(new, "day", "left").select("day", "active_did_count", F.coalesce("new_did_count", F.lit(0)).alias("new_did_count"))


def daily_active_collection(collection: DataFrame, as_of: datetime | str) -> DataFrame:
    """(day, active_collection_count) for yesterday."""
    return _active_by_day(_yesterday(_without_publisher(collection), as_of), "collection", "active_collection_count")


def daily_new_collection(collection: DataFrame, as_of: datetime | str, seen: DataFrame | None = None) -> DataFrame:
    """(day, new_collection_count) for yesterday."""
    seen = seen if seen is not None else first_seen(_without_publisher(collection), "collection")
    return _new_by_day(_yesterday(seen.withColumnRenamed("first_at", "createdAt"), as_of).withColumnRenamed("createdAt", "first_at"), "new_collection_count")


def _from(rows: DataFrame, column: str, since: str) -> DataFrame:
    return rows.where(F.col(column) >= F.lit(f"{since} 00:00:00").cast("timestamp_ntz"))


def backfill_did(collection: DataFrame, since: str) -> DataFrame:
    """(day, active_did_count, new_did_count) for all days from since on, today's part included."""
    active = _active_by_day(_from(collection, "createdAt", since), "did", "active_did_count")
    new = _new_by_day(_from(first_seen(collection, "did"), "first_at", since), "new_did_count")
    return active.join(new, "day", "full_outer").select("day", F.coalesce("active_did_count", F.lit(0)).alias("active_did_count"), F.coalesce("new_did_count", F.lit(0)).alias("new_did_count"))


def backfill_active_collection(collection: DataFrame, since: str) -> DataFrame:
    return _active_by_day(_from(_without_publisher(collection), "createdAt", since), "collection", "active_collection_count")


def backfill_new_collection(collection: DataFrame, since: str) -> DataFrame:
    return _new_by_day(_from(first_seen(_without_publisher(collection), "collection"), "first_at", since), "new_collection_count")


def stored_first_seen(store: Store, entity: str) -> DataFrame | None:
    """The kept first times, of which ingest appends each batch's least; None if they aren't kept."""
    table = store.table(f"first_seen_{entity}")
    return table.read().groupBy(entity).agg(F.min("first_at").alias("first_at")) if table.exists() else None


def rebuild_first_seen(store: Store) -> None:
    """Keeps first times from now on, from the log as it is; also rewrites what appends have left as one row an entity."""
    for entity, rows in (("did", lambda c: c), ("collection", _without_publisher)):
        seen = stored_first_seen(store, entity)
        store.table(f"first_seen_{entity}").replace(first_seen(rows(store.read("collection")), entity) if seen is None else seen)


def append_first_seen(store: Store, rows: DataFrame) -> None:
    """Adds a batch's least times, if first times are kept."""
    for entity, part in (("did", rows), ("collection", _without_publisher(rows))):
        table = store.table(f"first_seen_{entity}")
        if table.exists():
            table.append(first_seen(part, entity))


def merge(store: Store, name: str, updates: DataFrame) -> DataFrame:
    """Merges updates into a stored table and gives its new version."""
    table = store.table(name)
    return table.replace(upsert(table.read(), updates, schema.KEYS[name], schema.DEFAULTS.get(name)))


def run_daily(store: Store, as_of: datetime | str) -> list[str]:
    """The nightly job: did counts, then both collection counts. A step that fails is logged and doesn't stop the next; gives the steps that failed. Running it again changes nothing."""
    collection = store.read("collection")
    steps = (
        ("daily_active_did", lambda: daily_active_did(collection, as_of, stored_first_seen(store, "did"))),
        ("daily_collection_stats", lambda: daily_active_collection(collection, as_of)),
        ("daily_collection_stats", lambda: daily_new_collection(collection, as_of, stored_first_seen(store, "collection"))),
    )
    return _run(store, steps)


def backfill(store: Store, since: str) -> list[str]:
    """Recounts all days from since on."""
    collection = store.read("collection")
    steps = (
        ("daily_active_did", lambda: backfill_did(collection, since)),
        ("daily_collection_stats", lambda: backfill_active_collection(collection, since)),
        ("daily_collection_stats", lambda: backfill_new_collection(collection, since)),
    )
    return _run(store, steps)


def _run(store: Store, steps) -> list[str]:
    failed = []
    for name, make in steps:
        try:
            merge(store, name, make())
            log.info("merged %s", name)
        except Exception:
            log.exception("merging %s failed", name)
            failed.append(name)
    return failed
