"""Sharding by extendible hashing.

A directory maps prefixes of a row's hash to shards. There is one bucket to begin with; a bucket whose rows
pass the byte limit is split on its next hash bit, others are left alone, until every shard fits. What a bucket
holds are sums by prefix: they are taken once, by a prefix about as long as the data need, and added up from
there, STEP levels at a time; so the directory is found without moving a row, and rows are read again only for
buckets that are still too large at that depth.

Defined results: a null text counts 0 bytes, a null id hashes as the empty text; an empty table has no
shards. Rows of one id are told apart by their texts. Rows alike in both have all bits in common: once the
bits are used up they are numbered and cut into runs of the limit. A row larger than the limit has a shard
of its own, marked oversize. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import Scratch

#: Bits of the hash: what 15 hexadecimal digits of an MD5 give.
BITS = 60
#: Levels that one aggregation settles.
STEP = 8
#: Levels beyond those that equal buckets would need.
SPARE = 4


def row_hash(id_col: Column, text_col: Column) -> Column:
    """60 bits of the MD5 of id and text."""
    name = F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text_col, F.lit("")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def prefix(depth: int) -> Column:
    return F.shiftright("h", BITS - depth)


def _levels(sums: DataFrame, top: int, deep: int, limit: int) -> DataFrame:
    """(fine, depth, shard_bytes) of (fine, bytes), sums by prefixes of `deep` bits: the first depth from top on at which the bucket of each fits, null if none does.

    The sums of all depths come from one exchange: a window by the shortest prefix also holds the longer ones.
    """
    keys: list[Column] = []
    sums = sums.withColumnRenamed("bytes", f"s{deep}")
    for d in range(top, deep):
        keys.append(F.shiftright("fine", deep - d))
        sums = sums.withColumn(f"s{d}", F.sum(f"s{deep}").over(Window.partitionBy(*keys)))
    fits, held = F.lit(None).cast("int"), F.lit(None).cast("long")
    for d in range(deep, top - 1, -1):
        fits = F.when(F.col(f"s{d}") <= limit, d).otherwise(fits)
        held = F.when(F.col(f"s{d}") <= limit, F.col(f"s{d}")).otherwise(held)
    return sums.select("fine", fits.alias("depth"), held.alias("shard_bytes"))


def _directory(sums: DataFrame, top: int, deep: int, limit: int) -> DataFrame:
    """_levels for any number of levels: sums of longer prefixes are added up to shorter ones, then what shorter ones settle holds for the longer."""
    mid = max(top, deep - STEP)
    own = _levels(sums, mid, deep, limit)
    if mid == top:
        return own
    shorter = F.shiftright("fine", deep - mid)
    above = _directory(sums.groupBy(shorter.alias("fine")).agg(F.sum("bytes").alias("bytes")), top, mid, limit).select(F.col("fine").alias("up"), F.col("depth").alias("up_depth"), F.col("shard_bytes").alias("up_bytes"))
    return own.join(above, shorter == F.col("up")).select("fine", F.coalesce("up_depth", "depth").alias("depth"), F.coalesce("up_bytes", "shard_bytes").alias("shard_bytes"))


def assign(df: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, bytes, shard, depth, shard_bytes, oversize) of each row. shard: the depth and the bits of the bucket, `depth:bits`, and `.run` where rows alike are cut into runs."""
    kept = Scratch(df.sparkSession)
    rows = kept(df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("bytes"), row_hash(F.col(id_col), F.col(text_col).cast("string")).alias("h")))
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    top, deep = 0, min(BITS, math.ceil(math.log2(max(1, total / limit))) + SPARE)
    done: list[DataFrame] = []
    left = rows
    while True:
        found = kept(_directory(left.groupBy(prefix(deep).alias("fine")).agg(F.sum("bytes").alias("bytes")), top, deep, limit))
        open_now = found.where("depth is null").count()
        # A directory has some 2 ** SPARE entries a shard: fewer than rows, but it grows with the data, so it is joined by key and not broadcast by force.
        placed = left.withColumn("fine", prefix(deep)).join(found, "fine")
        done.append(placed.where("depth is not null").selectExpr("doc_id", "bytes", f"concat(depth, ':', lpad(bin(shiftright(h, {BITS} - depth)), depth, '0')) as shard", "depth", "shard_bytes", "false as oversize"))
        if not open_now:
            break
        left = kept(placed.where("depth is null").select("doc_id", "bytes", "h"))
        if deep == BITS:
            done.append(_runs(kept, left, limit))
            break
        top, deep = deep, min(BITS, deep + STEP)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _runs(kept: Scratch, rows: DataFrame, limit: int) -> DataFrame:
    """Rows that have all bits in common, so the same bytes: each task's rows are numbered and cut into runs that fit."""
    dealt = kept(rows.withColumn("part", F.spark_partition_id()))
    numbered = dealt.withColumn("n", F.row_number().over(Window.partitionBy("h", "part").orderBy("bytes")) - 1)
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("bytes"), F.lit(1))))
    runs = numbered.withColumn("run", F.floor(F.col("n") / each).cast("long"))
    sums = runs.groupBy("h", "part", "run").agg(F.sum("bytes").alias("shard_bytes"))
    return runs.join(sums, ["h", "part", "run"]).select("doc_id", "bytes", F.concat(F.lit(f"{BITS}:"), F.lpad(F.bin("h"), BITS, "0"), F.lit("."), F.col("part"), F.lit("."), F.col("run")).alias("shard"), F.lit(BITS).alias("depth"), "shard_bytes", (F.col("bytes") > limit).alias("oversize"))
