"""The materialised per-name statistics: unreadable until refreshed, then as of the last refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyloom.plans.views import collection_stats
from tallyloom.sources.storage import Store


def refresh_collection_stats(store: Store) -> DataFrame:
    return store.table("collection_stats").replace(collection_stats(store.read("collection")))
