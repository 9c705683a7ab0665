"""Table schemas and the constants that carry meaning."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Columns of the tables (keys in KEYS below); times of records are without a zone, those of feed events with one.
TABLES = {
    "collection": "did string not null, collection string not null, rkey string not null, createdAt timestamp_ntz",
    "event_logs": "id int not null, event string not null, time_us bigint not null, create_at timestamp not null, creator_did string not null, rkey string not null, server_did string not null",
    "cursor": "service string not null, cursor decimal(20,0) not null",
    "unique_did": "did string not null",
    "collection_lv2": "nsidlv2 string not null",
    "daily_active_did": "day date not null, active_did_count int not null, new_did_count int",
    "daily_collection_stats": "day date not null, active_collection_count int not null, new_collection_count int not null, new_did_count int not null",
    "daily_active_collection": "day date not null, active_collection_count int not null",
    "collection_stats": "collection string, unique_did bigint, unique_rkey bigint, min_createdat timestamp_ntz, max_createdat timestamp_ntz, total_count bigint",
    "first_seen_did": "did string not null, first_at timestamp_ntz",
    "first_seen_collection": "collection string not null, first_at timestamp_ntz",
    "dns_txt": "name string, data array<string>",
    "did_docs": "did string, doc_json string",
    "records": "repo string, collection string, rkey string, value_json string",
}
KEYS = {"cursor": ["service"], "unique_did": ["did"], "collection_lv2": ["nsidlv2"], "daily_active_did": ["day"], "daily_collection_stats": ["day"], "daily_active_collection": ["day"], "event_logs": ["id"]}
#: What an insert that leaves the column out gets.
DEFAULTS = {"daily_active_did": {"new_did_count": 0}, "daily_collection_stats": {"active_collection_count": 0, "new_collection_count": 0, "new_did_count": 0}}
#: Rows that repeat in all four columns are one; a row without a time repeats none.
DEDUP_KEY = ["did", "collection", "rkey", "createdAt"]

# Publisher that some relations leave out, record type whose rkey names a schema, prefix of transaction keys, day that stands for an unknown time.
PUBLISHER = "did:web:lexicon.store"
SCHEMA_COLLECTION = "com.atproto.lexicon.schema"
TRANSACTION_PREFIX = "ge.shadowcaster"
UNKNOWN_DAY = "1900-01-01"
FEED_START = "2024-10-01"
RECENT = "INTERVAL 72 HOURS"
WEEK = "INTERVAL 7 DAYS"
SPINE_DAYS = 365
BUCKET_DAYS = 30


def at(as_of: datetime | str) -> Column:
    """as_of as a literal without a zone, so that comparisons reach the scan."""
    return F.lit(str(as_of)).cast("timestamp_ntz")
