"""Dotted namespaces: prefix trees, public suffixes, registrants. Set operations only, no recursion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.numbering import in_order
from tallyloom.sources.storage import scratch_path


def prefixes(name: Column, least: int = 2) -> Column:
    """The dotted prefixes of name from `least` labels on; none if it has fewer."""
    parts = F.split(name, "[.]")
    lengths = F.when(F.size(parts) >= least, F.sequence(F.lit(least), F.size(parts))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(lengths, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def parent(name: Column) -> Column:
    """name without its last label; null for roots, which have two."""
    parts = F.split(name, "[.]")
    return F.when(F.size(parts) > 2, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "."))


def tree(names: DataFrame, schema_keys: DataFrame, tlds: DataFrame | None = None, with_schema_only: bool = False) -> DataFrame:
    """(node, parent, depth, is_data, has_schema, id_path) of the tree of names.

    names: column collection; schema_keys: column rkey; tlds: column tld, roots must begin with one (in any
    case). with_schema_only drops subtrees without a schema. Nodes below a name of the data go, though a
    flag that came from them stays with their ancestors. id_path: the ordinals among siblings along the path, in
    the order of Unicode collation, equal ones by code points.
    """
    data = names.select("collection").where(F.size(F.split("collection", "[.]")) >= 2).distinct()
    if tlds is not None:
        data = data.join(tlds.select(F.lower("tld").alias("tld")).distinct(), F.lower(F.split_part("collection", F.lit("."), F.lit(1))) == F.col("tld"), "left_semi")
    keys = schema_keys.select(F.col("rkey").alias("collection")).distinct().withColumn("is_key", F.lit(True))
    data = _kept(data.join(keys, "collection", "left").select("collection", F.coalesce("is_key", F.lit(False)).alias("is_key")))
    # The least depth at which a name lies below another one of the data: what is deeper is hidden.
    above = data.select("collection", F.explode(F.filter(prefixes(F.col("collection")), lambda p: p != F.col("collection"))).alias("node"))
    hidden = above.join(data.select(F.col("collection").alias("node")), "node", "left_semi").groupBy("collection").agg(F.min(F.size(F.split("node", "[.]"))).alias("last"))
    # One row a name and prefix; a node's flags are sums over its names.
    every = data.join(hidden, "collection", "left").select("collection", "is_key", F.explode(prefixes(F.col("collection"))).alias("node"), "last")
    own, depth = F.col("node") == F.col("collection"), F.size(F.split("node", "[.]"))
    nodes = every.where(F.col("last").isNull() | (depth <= F.col("last"))).groupBy("node").agg(F.max(own).alias("is_data"), F.max(own & F.col("is_key")).alias("own_schema"), F.max("is_key").alias("below_schema"))
    if with_schema_only:
        nodes = nodes.where("below_schema")
    kept = nodes.select("node", F.coalesce(parent(F.col("node")), F.lit("")).alias("parent"), depth.alias("depth"), "is_data", F.when(F.col("is_data"), F.col("own_schema")).otherwise(F.col("below_schema")).alias("has_schema"))
    # Siblings follow each other in one order of all nodes; a node's ordinal is its place less that of its parent's first.
    order = [F.col("parent"), F.collate("node", "UNICODE"), F.col("node")]
    placed = in_order(kept.repartitionByRange(*order).sortWithinPartitions(*order))
    first = placed.groupBy("parent").agg(F.min("position").alias("first"))
    ranked = _kept(placed.join(first, "parent").withColumn("ordinal", F.col("position") - F.col("first") + 1).drop("position", "first"))
    path = ranked.select("node", F.posexplode(prefixes(F.col("node"))).alias("level", "prefix")).join(ranked.select(F.col("node").alias("prefix"), "ordinal"), "prefix")
    ids = path.groupBy("node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", "ordinal"))), lambda x: x["ordinal"].cast("string")), "-").alias("id_path"))
    return ranked.drop("ordinal").join(ids, "node").select("node", "parent", "depth", "is_data", "has_schema", "id_path")


def _kept(df: DataFrame) -> DataFrame:
    """df written once to the shared folder: what is read several times isn't computed again."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def suffix_labels(domains: DataFrame, rules: DataFrame, column: str = "domain") -> DataFrame:
    """(domain, labels): how many last labels of each distinct domain are its public suffix.

    Suffixes are tried longest first. An exception rule decides at once for the labels after its first; else
    the longest plain or wildcard rule; else the last label.
    """
    once = domains.select(F.col(column).alias("domain")).distinct()
    kinds = rules.select(F.when(F.col("rule").startswith("!"), "exception").when(F.col("rule").startswith("*."), "wild").otherwise("plain").alias("kind"), F.regexp_replace("rule", r"^(!|\*\.)", "").alias("key")).distinct()
    parts = F.split("domain", "[.]")
    tail = lambda i: F.array_join(F.slice(parts, i + 1, F.size(parts) - i), ".")
    tries = once.select("domain", F.size(parts).alias("n"), F.explode(F.sequence(F.lit(0), F.size(parts) - 1)).alias("i"))
    keyed = tries.select("domain", "n", "i", F.explode(F.array(F.struct(F.lit("plain").alias("kind"), tail(F.col("i")).alias("key")), F.struct(F.lit("exception").alias("kind"), tail(F.col("i")).alias("key")), F.struct(F.lit("wild").alias("kind"), F.when(F.col("i") + 1 < F.col("n"), tail(F.col("i") + 1)).alias("key")))).alias("try"))
    hits = keyed.select("domain", "n", "i", "try.kind", "try.key").join(kinds, ["kind", "key"])
    best = hits.groupBy("domain").agg(F.max("n").alias("n"), F.min(F.when(F.col("kind") == "exception", F.col("i"))).alias("e"), F.min(F.when(F.col("kind") != "exception", F.col("i"))).alias("m"))
    found = best.select("domain", F.when(F.col("e").isNotNull(), F.greatest(F.col("n") - F.col("e") - 1, F.lit(1))).otherwise(F.col("n") - F.col("m")).alias("found"))
    return once.join(found, "domain", "left").select("domain", F.coalesce("found", F.lit(1)).alias("labels"))


def public_suffix(domains: DataFrame, rules: DataFrame, column: str = "domain") -> DataFrame:
    """(domain, suffix) of each distinct domain."""
    parts = F.split("domain", "[.]")
    return suffix_labels(domains, rules, column).select("domain", F.array_join(F.slice(parts, F.size(parts) - F.col("labels") + 1, F.col("labels")), ".").alias("suffix"))


def registrants(names: DataFrame, rules: DataFrame, column: str = "collection") -> DataFrame:
    """(collection, registrant) of each distinct name: the labels of its suffix, which stand first in a name, and one more."""
    once = names.select(F.col(column).alias("collection")).distinct()
    turned = once.withColumn("domain", F.array_join(F.reverse(F.split("collection", "[.]")), "."))
    parts = F.split("collection", "[.]")
    return turned.join(suffix_labels(turned, rules), "domain").select("collection", F.array_join(F.slice(parts, F.lit(1), F.least(F.size(parts), F.col("labels") + 1)), ".").alias("registrant"))
