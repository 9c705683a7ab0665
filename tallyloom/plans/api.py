"""What clients ask: a small query grammar over named relations, lists, details and cards."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import identity
from tallyloom.functions.days import lag_minutes
from tallyloom.operators import namespaces
from tallyloom.plans import feeds, views
from tallyloom.schema import RECENT, TRANSACTION_PREFIX, UNKNOWN_DAY, at


@dataclass(frozen=True)
class QuerySpec:
    """A relation with equality filters, columns, order and limit."""

    relation: str
    filters: dict[str, str] = field(default_factory=dict)
    select: tuple[str, ...] = ()
    order: tuple[tuple[str, bool], ...] = ()  # column, descending
    limit: int | None = None

    @classmethod
    def parse(cls, url: str) -> QuerySpec:
        """`/relation?col=eq.value&select=a,b&order=col.desc&limit=n`."""
        parts = urlsplit(url)
        filters, select, order, limit = {}, (), (), None
        for key, value in parse_qsl(parts.query, keep_blank_values=True):
            if key == "select":
                select = tuple(value.split(","))
            elif key == "order":
                order = tuple((c.partition(".")[0], c.endswith(".desc")) for c in value.split(","))
            elif key == "limit":
                limit = int(value)
            elif value.startswith("eq."):
                filters[key] = value[3:]
            else:
                raise ValueError(f"{key}={value}: only eq is known")
        return cls(parts.path.strip("/"), filters, select, order, limit)


def ordered(column: str, descending: bool) -> Column:
    """Nulls first going down, last going up."""
    return F.desc_nulls_first(column) if descending else F.asc_nulls_last(column)


class Service:
    """Named relations over tables, as of one time. Relations are lazy; cache() keeps one while it is asked for often."""

    def __init__(self, spark: SparkSession, tables: Callable[[str], DataFrame], as_of: datetime | str):
        self.spark, self.tables, self.as_of = spark, tables, as_of
        self._kept: dict[str, DataFrame] = {}
        t, now = tables, as_of
        self.relations: dict[str, Callable[[], DataFrame]] = {
            "collection_count_view": lambda: views.collection_count(t("collection"), now),
            "collection_daily_summary_view": lambda: views.collection_daily_summary(t("collection"), now),
            "did_active_summary_view": lambda: views.did_active_summary(t("collection"), now),
            "did_count_view": lambda: views.did_count(t("collection")),
            "active_collection_summary_view": lambda: views.active_collection_summary(t("daily_collection_stats")),
            "new_collection_summary_view": lambda: views.new_collection_summary(t("daily_collection_stats")),
            "active_did_summary_view": lambda: views.active_did_summary(t("daily_active_did")),
            "new_did_summary_view": lambda: views.new_did_summary(t("daily_active_did")),
            "collection_min_max_did_view": lambda: views.collection_min_max_did(t("collection")),
            "distinct_collections": lambda: views.distinct_collections(t("collection")),
            "distinct_schema_rkeys": lambda: views.distinct_schema_rkeys(t("collection")),
            "collection_lv2_view": lambda: views.collection_lv2(t("collection")),
            "event_logs_summary": lambda: views.event_logs_summary(t("event_logs"), now),
            "new_entities_last_7days": lambda: views.new_entities(t("event_logs"), now),
            "new_creators_last_7days": lambda: views.new_creators(t("event_logs"), now),
            "unique_did_count": lambda: views.unique_did_count(t("collection")),
            "unique_did_count_view": lambda: views.unique_did_count_view(t("unique_did")),
        }
        self.functions: dict[str, Callable[..., DataFrame]] = {
            "get_event_logs_by_server": lambda start_date, end_date, inclusive_end=False: feeds.servers(t("event_logs"), start_date, end_date, inclusive_end),
        }

    def table(self, name: str) -> DataFrame:
        """A relation, or else a table or snapshot of that name."""
        if name in self._kept:
            return self._kept[name]
        return self.relations[name]() if name in self.relations else self.tables(name)

    def cache(self, name: str) -> DataFrame:
        self._kept.setdefault(name, self.table(name).cache())
        return self._kept[name]

    def register(self) -> None:
        """All relations as temporary views for SQL."""
        for name in self.relations:
            self.table(name).createOrReplaceTempView(name)

    def query(self, spec: QuerySpec | str) -> DataFrame:
        """The rows a spec or URL asks for. A limit applies after the order asked for, else the relation's own."""
        spec = QuerySpec.parse(spec) if isinstance(spec, str) else spec
        df = self.table(spec.relation)
        for column, value in spec.filters.items():
            df = df.where(F.col(column) == F.lit(value).cast(df.schema[column].dataType))
        order = spec.order or tuple((c.split(" ")[0], c.endswith(" desc")) for c in views.DEFAULT_ORDER.get(spec.relation, []))
        if order:
            df = df.orderBy(*(ordered(*o) for o in order))
        if spec.limit is not None:
            df = df.limit(spec.limit)
        return df.select(*spec.select) if spec.select else df

    def call(self, name: str, **arguments) -> DataFrame:
        return self.functions[name](**arguments)

    def overview(self, rules: DataFrame, exclude_transactions: bool = False) -> DataFrame:
        return overview(self.table("collection_count_view"), self.table("unique_did_count_view"), rules, self.as_of, exclude_transactions)


def without_transactions(counts: DataFrame, exclude: bool = True) -> DataFrame:
    return counts.where(~F.col("collection").startswith(TRANSACTION_PREFIX)) if exclude else counts


def new_flag(counts: DataFrame, as_of: datetime | str, recent: str = RECENT) -> DataFrame:
    """counts with is_new: first seen after, not at, the bound; false without a time."""
    return counts.withColumn("is_new", F.coalesce(F.col("min") > at(as_of) - F.expr(recent), F.lit(False)))


def earliest(counts: DataFrame, as_of: datetime | str) -> DataFrame:
    """The one row seen first before as_of, ties by name; none if all are later."""
    return counts.where(F.col("min") < at(as_of)).orderBy("min", "collection").limit(1)


def overview(counts: DataFrame, users: DataFrame, rules: DataFrame, as_of: datetime | str, exclude_transactions: bool = False) -> DataFrame:
    """(total_collections, new_collections, registrants, total_users): one row."""
    shown = new_flag(without_transactions(counts, exclude_transactions), as_of)
    totals = shown.agg(F.count(F.lit(1)).alias("total_collections"), F.count_if("is_new").alias("new_collections"))
    owners = namespaces.registrants(shown, rules).agg(F.count_distinct("registrant").alias("registrants"))
    return totals.crossJoin(owners).crossJoin(users.select(F.col("unique_did_count").alias("total_users")))  # one row each


def cursor_lag(cursor: DataFrame, as_of: datetime | str, service: str | None = None) -> DataFrame:
    """(service, lag_minutes)."""
    rows = cursor.where(F.col("service") == service) if service else cursor
    return rows.select("service", lag_minutes(F.col("cursor"), as_of).alias("lag_minutes"))


def listed(rows: DataFrame, search: str | None, column: str, keys: tuple[str, ...], sort: str | None, descending: bool = False) -> DataFrame:
    """rows whose column holds the search text, in the order of a key; an unknown key leaves the order. Texts sort by Unicode collation."""
    out = rows.where(identity.like_text(F.col(column), search.strip() if search else None)) if search else rows
    if sort not in keys:
        return out
    by = F.collate(F.col(sort), "UNICODE") if rows.schema[sort].dataType.typeName().startswith("string") else F.col(sort)
    return out.orderBy(by.desc_nulls_first() if descending else by.asc_nulls_last())


def collection_list(counts: DataFrame, search: str | None = None, sort: str | None = None, descending: bool = False) -> DataFrame:
    """counts searched and sorted, with the labels that times have in the list."""
    out = counts.withColumn("min_label", identity.sentinel_label(F.col("min"), UNKNOWN_DAY)).withColumn("max_label", identity.sentinel_label(F.col("max"), UNKNOWN_DAY))
    return listed(out, search, "collection", ("collection", "count", "recent_count", "min", "max"), sort, descending)


def server_list(found: DataFrame, search: str | None = None, sort: str | None = "unique_creator_rkey", descending: bool = True) -> DataFrame:
    return listed(feeds.masked(found), search, "server_did", ("server_did", "unique_creator_did", "unique_creator_rkey", "min_create_at", "max_create_at"), sort, descending)


def latest_record(collection: DataFrame, name: str) -> DataFrame:
    """(did, rkey) of the newest record of a name; one without a time counts as newest. Ties by did and rkey."""
    return collection.where(F.col("collection") == name).orderBy(F.desc_nulls_first("createdAt"), "did", "rkey").limit(1).select("did", "rkey")


def in_days(rows: DataFrame, column: str, start: str | None, end: str | None) -> DataFrame:
    """rows whose time lies in whole days from start to end, both included, `yyyy/mm/dd` or ISO; no end: open; no start: all rows."""
    if not start:
        return rows
    day = lambda text: F.lit(text.replace("/", "-")).cast("date").cast("timestamp_ntz")
    out = rows.where(F.col(column) >= day(start))
    return out.where(F.col(column) < day(end) + F.expr("INTERVAL 1 DAY")) if end else out


def collection_tree(counts: DataFrame, schema_keys: DataFrame, tlds: DataFrame | None, search: str | None = None, min_days: tuple[str | None, str | None] = (None, None), max_days: tuple[str | None, str | None] = (None, None), with_schema_only: bool = False) -> DataFrame:
    """The tree of the names that pass the filters; tlds None: roots of any kind."""
    rows = counts.where(identity.like_text(F.col("collection"), search.strip())) if search and search.strip() else counts
    rows = in_days(in_days(rows, "min", *min_days), "max", *max_days)
    return namespaces.tree(rows, schema_keys, tlds, with_schema_only)


def stats_card(stats: DataFrame, name: str) -> DataFrame:
    """A name's row of the snapshot, with the labels of its times."""
    return stats.where(F.col("collection") == name).withColumn("min_label", identity.sentinel_label(F.col("min_createdat"), UNKNOWN_DAY)).withColumn("max_label", identity.sentinel_label(F.col("max_createdat"), UNKNOWN_DAY))


def schema_check(names: DataFrame, dns_txt: DataFrame, did_docs: DataFrame, records: DataFrame, schema_collection: str) -> DataFrame:
    """(collection, dns_name, did, endpoint, value_json, status) for each name: the steps from a name to its published schema over lookup tables.

    status: ok, or the first step that found nothing: no dns record, no did, no did document, no endpoint, no record.
    """
    asked = names.select("collection", identity.nsid_dns(F.col("collection")).alias("dns_name"))
    txt = dns_txt.groupBy(F.col("name").alias("dns_name")).agg(F.min(identity.txt_value(F.col("data"))).alias("txt"))
    docs = did_docs.groupBy("did").agg(F.min("doc_json").alias("doc_json"))
    found = records.where(F.col("collection") == schema_collection).groupBy(F.col("repo").alias("did"), F.col("rkey").alias("collection")).agg(F.min("value_json").alias("value_json"))
    out = asked.join(txt, "dns_name", "left").withColumn("did", identity.did_from_txt(F.col("txt"))).join(docs, "did", "left").withColumn("endpoint", identity.service_endpoint(F.col("doc_json"))).join(found, ["did", "collection"], "left")
    status = F.when(F.col("txt").isNull(), "no dns record").when(F.col("did").isNull(), "no did").when(F.col("doc_json").isNull(), "no did document").when(F.col("endpoint").isNull(), "no endpoint").when(F.col("value_json").isNull(), "no record").otherwise("ok")
    return out.select("collection", "dns_name", "did", "endpoint", "value_json", status.alias("status"))


def record_lookup(uris: DataFrame, did_docs: DataFrame, records: DataFrame) -> DataFrame:
    """(uri, repo, collection, rkey, endpoint, value_json) of each `at://` address."""
    repo, name, key = identity.at_uri_parts(F.col("uri"))
    asked = uris.select("uri", repo.alias("repo"), name.alias("collection"), key.alias("rkey"))
    docs = did_docs.groupBy(F.col("did").alias("repo")).agg(F.min("doc_json").alias("doc_json"))
    held = records.groupBy("repo", "collection", "rkey").agg(F.min("value_json").alias("value_json"))
    return asked.join(docs, "repo", "left").join(held, ["repo", "collection", "rkey"], "left").select("uri", "repo", "collection", "rkey", identity.service_endpoint(F.col("doc_json")).alias("endpoint"), "value_json")
