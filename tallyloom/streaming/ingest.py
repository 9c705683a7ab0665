"""Ingest of records, in one go or as a stream: idempotent inserts, distinct sets, positions.

A stream hands each micro-batch to the same code as a batch load, so results are the same. Exact distinct
sets are kept by anti-joins against what is stored; streaming sketches would only come near.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyloom.functions.identity import level2
from tallyloom.operators.numbering import in_order
from tallyloom.operators.upsert import append_new, upsert
from tallyloom.plans.rollup import append_first_seen, rebuild_first_seen
from tallyloom.schema import DEDUP_KEY, KEYS, UNKNOWN_DAY
from tallyloom.sources.storage import Store, drop_path, scratch_path


def deduplicated(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """rows once for each key that known doesn't hold; rows without a time all stay."""
    timed = rows.where("createdAt is not null").dropDuplicates(DEDUP_KEY)
    if known is not None:
        timed = timed.join(known.where("createdAt is not null").select(*DEDUP_KEY), DEDUP_KEY, "left_anti").select(*rows.columns)
    return timed.unionByName(rows.where("createdAt is null"))


def numbered(rows: DataFrame, after: int, scratch: str | None = None) -> DataFrame:
    """rows with ids from after + 1 on in the order of time; tasks number their range, so no task sorts all.

    Rows of one time, creator, key, server and event follow each other in any order. scratch: where rows are kept
    meanwhile; it may go once the result is stored.
    """
    order = [c for c in ("time_us", "creator_did", "rkey", "server_did", "event") if c in rows.columns]
    ranged = rows.drop("id").repartitionByRange(*order).sortWithinPartitions(*order)
    return in_order(ranged, scratch).withColumn("id", (F.col("position") + after + 1).cast("int")).drop("position")


def insert(store: Store, rows: DataFrame, position_us: int | None = None, service: str = "collection", tag: str | None = None) -> None:
    """Appends records and keeps the distinct sets, the first times and the position of the service.

    tag: names this batch. Records of a batch that was begun before under that name are taken out first, so that
    a crash between two of the writes leaves nothing twice; the other writes add what isn't there or take minima.
    """
    collection = store.table("collection")
    if tag:
        collection.withdraw(tag)
    unknown = F.lit(f"{UNKNOWN_DAY} 00:00:00").cast("timestamp_ntz")
    told = F.when(F.col("createdAt") != unknown, F.col("createdAt"))
    lo, hi = rows.agg(F.min(told), F.max(told)).first()
    # Only records of the times that the batch has can repeat it; the bounds are pushed to the scan. The time that stands for an unknown one is no bound.
    known = collection.read().where(F.col("createdAt").between(F.lit(lo).cast("timestamp_ntz"), F.lit(hi).cast("timestamp_ntz")) | (F.col("createdAt") == unknown))
    begun = collection.exists()
    collection.append(deduplicated(rows.select(*DEDUP_KEY), known), tag)
    for name, part, of in (("unique_did", rows, F.col("did")), ("collection_lv2", rows.where(F.col("collection").contains(".")), level2(F.col("collection")))):
        key = KEYS[name][0]
        kept = store.table(name)
        kept.append(append_new(kept.read(), part.select(of.alias(key)), [key]))
    if begun:
        append_first_seen(store, rows)
    else:  # a log that begins here has its first times kept; for one filled otherwise, rebuild_first_seen() begins it
        rebuild_first_seen(store)
    if position_us is not None:
        _mark(store, service, position_us)


def _mark(store: Store, service: str, position: int) -> None:
    """Moves a service's position on; never back, as batches needn't come in the order of time."""
    cursor = store.table("cursor")
    old = cursor.read()
    at = old.sparkSession.createDataFrame([(service, position)], "service string, position long").select("service", F.col("position").cast("decimal(20,0)").alias("cursor"))
    ahead = at.join(old.withColumnRenamed("cursor", "old"), "service", "left").select("service", F.greatest("cursor", "old").cast("decimal(20,0)").alias("cursor"))
    cursor.replace(upsert(old, ahead, KEYS["cursor"]))


def insert_events(store: Store, rows: DataFrame) -> None:
    """Appends feed events under new ids."""
    logs = store.table("event_logs")
    old = logs.read()
    last = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    scratch = scratch_path(rows.sparkSession)
    try:
        logs.append(numbered(rows, last, scratch).select(*old.columns))
    finally:
        drop_path(rows.sparkSession, scratch)


def stream(source: DataFrame, store: Store, checkpoint: str, to_records: Callable[[DataFrame], DataFrame], position: str | None = None, service: str = "collection", once: bool = True) -> StreamingQuery:
    """Feeds a streaming source into the store batch by batch; position names a column of source in microseconds.

    A batch that is repeated after a failure inserts nothing twice: its files carry its number and are taken out
    before it is begun again, and the last whole batch's number is kept with the position, so that a batch not
    after it is skipped.
    """

    def handle(batch: DataFrame, number: int) -> None:
        marks = store.table("cursor")
        mark = f"{service}#batch"
        done = marks.read().where(F.col("service") == mark).select(F.col("cursor").cast("long")).first()
        if done and done[0] >= number:
            return
        batch = batch.persist()
        try:
            newest = batch.agg(F.max(position)).first()[0] if position else None
            insert(store, to_records(batch), newest, service, f"{service}-{number}")
            _mark(store, mark, number)
        finally:
            batch.unpersist()

    writer = source.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
