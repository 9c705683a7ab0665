"""URL filters: path rules, and a Bloom filter cascade for exact membership of hosts in a list.

The cascade encodes the listed keys in a first Bloom filter, then the other keys of the corpus that it
takes for listed in a second, then the listed keys that the second takes for others in a third, and so on
until no key is taken wrongly. Over the corpus's complete key universe membership is then exact, and it
is tested by looking up bits in literals: no join, no Python. A level is one binary literal in the plan.

A list too long for one cascade is cut into slices by hash, each with its own. Tasks carry SLICES of them at
most; if there are more, judge() reads the table once for each SLICES, each time for the keys of those.

Defined results: a url that is null or has no `://` has an empty host and path; the empty host is never
listed. Keys of equal value count once. An empty universe or list gives a cascade that allows all.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import Scratch

#: Largest size of a slice's first filter, in bytes; the others are smaller.
MAX_FILTER_BYTES = 16 << 20
#: Slices whose filters travel with a task.
SLICES = 8
#: Words of a filter that reach the driver as one row.
CHUNK = 1024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """What stands after the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def parse_rule(verdict: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    return Rule(verdict, host.translate(str.maketrans(UPPER, LOWER)), slash + path)


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(position, F.lit(64)).cast("int"))


@dataclass(frozen=True)
class Filter:
    bits: int
    probes: int
    seed: int
    data: bytes  # words of 64 bits, the highest byte first

    def positions(self, key: Column) -> list[Column]:
        first = F.pmod(F.xxhash64(key, F.lit(2 * self.seed)), F.lit(self.bits))
        step = F.pmod(F.xxhash64(key, F.lit(2 * self.seed + 1)), F.lit(self.bits))
        return [F.pmod(first + step * i, F.lit(self.bits)) for i in range(self.probes)]

    def may_hold(self, key: Column) -> Column:
        def all_set(held: Column) -> Column:
            out = F.lit(True)
            for p in self.positions(key):
                word, bit = F.shiftright(p, 6), p.bitwiseAND(63)
                byte = F.conv(F.hex(F.substring(held, (word * 8 + 8 - F.shiftright(bit, 3)).cast("int"), F.lit(1))), 16, 10).cast("int")
                out &= F.getbit(byte, bit.bitwiseAND(7).cast("int")) == 1
            return out

        # One literal for all probes.
        return F.get(F.transform(F.array(F.lit(bytearray(self.data))), all_set), F.lit(0))


@dataclass(frozen=True)
class Cascade:
    """levels[s]: the filters of slice s; a key belongs to the slice that its hash gives."""

    levels: tuple[tuple[Filter, ...], ...]

    def slice_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(len(self.levels)))

    def holds(self, key: Column, first: int = 0, count: int | None = None) -> Column:
        """Whether key is listed; exact for every key of the universe. With first and count for keys of those slices only."""
        some = range(first, min(len(self.levels), first + (count or len(self.levels))))
        out = F.lit(False)
        for i in some:
            out = F.when(self.slice_of(key) == i, _member(self.levels[i], key)).otherwise(out) if len(self.levels) > 1 else _member(self.levels[0], key)
        return out


def _member(levels: tuple[Filter, ...], key: Column) -> Column:
    """Odd levels say listed, even ones the opposite; the first level that doesn't hold a key decides."""
    out = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels) - 1, -1, -1):
        out = F.when(levels[i].may_hold(key), out).otherwise(F.lit(i % 2 == 1))
    return out


def _plan(n: int, others: int, level: int) -> tuple[int, int]:
    """Bits and probes: the first level lets so many others through that the next ones stay small, the others half."""
    rate = 0.5 if level else min(0.5, max(1e-6, n / (math.sqrt(2) * max(1, others))))
    bits = max(64, math.ceil(n * math.log2(1 / rate) / math.log(2)))
    return -(-bits // 64) * 64, max(1, round(math.log2(1 / rate)))


def _fill(keys: DataFrame, bits: int, probes: int, seed: int) -> Filter:
    """Sets bits where the data are; what reaches the driver are the words of one filter as hexadecimal text, CHUNK a row, not keys."""
    empty = Filter(bits, probes, seed, b"")
    at = keys.select(F.explode(F.array(*empty.positions(F.col("key")))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(_bit(F.col("at"))).alias("v"))
    chunks = words.groupBy(F.floor(F.col("w") / CHUNK).alias("c")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("w") % CHUNK).cast("int").alias("i"), "v"))).alias("held"))
    text = F.expr(f"array_join(transform(sequence(0, {CHUNK - 1}), i -> lpad(hex(coalesce(held[i], 0L)), 16, '0')), '')")
    data = bytearray(-(-bits // (64 * CHUNK)) * CHUNK * 8)
    for r in chunks.select("c", text.alias("words")).collect():
        data[r.c * CHUNK * 8 : (r.c + 1) * CHUNK * 8] = bytes.fromhex(r.words)
    return Filter(bits, probes, seed, bytes(data[: bits // 8]))


def build(universe: DataFrame, key_col: str, listed: Column, max_bytes: int = MAX_FILTER_BYTES, level_limit: int = 64) -> Cascade:
    """The cascade of universe's keys for which listed is true (null: false).

    A key that occurs both as listed and as not listed is listed. Where the first filter would pass max_bytes,
    keys are cut into slices by hash, as many as it takes; all filters are held by the driver.
    """
    kept = Scratch(universe.sparkSession)
    keys = kept(universe.where(F.col(key_col).isNotNull()).groupBy(F.col(key_col).cast("string").alias("key")).agg(F.max(F.coalesce(listed, F.lit(False))).alias("listed")))
    total = keys.agg(F.count_if("listed"), F.count_if(~F.col("listed"))).first()
    slices = max(1, math.ceil(_plan(max(1, total[0]), total[1], 0)[0] / 8 / max_bytes))
    out = []
    for s in range(slices):
        own = keys if slices == 1 else keys.where(F.pmod(F.xxhash64("key", F.lit(-1)), F.lit(slices)) == s)
        levels: list[Filter] = []
        while True:
            i = len(levels)
            wanted = F.col("listed") == F.lit(i % 2 == 0)
            # Level i encodes keys of its side that all the levels before hold: those on which the cascade so far is wrong.
            wrong = own.where(wanted & (_member(tuple(levels), F.col("key")) != F.col("listed"))) if i else own.where(wanted)
            n = wrong.count()
            if not n:
                break
            if i >= level_limit:
                raise ValueError("the cascade doesn't end; two keys hash alike at each level")
            others = (total[1] if i == 0 else n) // slices + 1
            levels.append(_fill(wrong, *_plan(n, others, i), seed=1000 * s + i))
        out.append(tuple(levels))
    kept.drop_but()
    return Cascade(tuple(out))


def judge(df: DataFrame, rules: list[Rule], cascade: Cascade, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict): the longest rule that fits decides, else whether the host is listed."""
    parts = df.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    host, path = F.col("host"), F.col("path")
    out = None
    for first in range(0, len(cascade.levels), SLICES):
        some = parts if len(cascade.levels) <= SLICES else parts.where(cascade.slice_of(host).between(first, first + SLICES - 1))
        rule, verdict = F.lit(None).cast("string"), F.when((host != "") & cascade.holds(host, first, SLICES), "block").otherwise("allow")
        for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
            rule = F.when(r.fits(host, path), r.name).otherwise(rule)
            verdict = F.when(r.fits(host, path), r.verdict).otherwise(verdict)
        judged = some.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
        out = judged if out is None else out.unionAll(judged)
    return out
