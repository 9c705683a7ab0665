"""SimHash near-duplicates by deletion variants.

Fingerprints of 64 bits are cut into three segments. Of two that differ in at most four bits, one segment
differs in at most one; so both have the same variant of that segment with that bit left out. Each distinct
fingerprint is indexed under its 64 one-wildcard variants, equal variants meet, and pairs are verified by
their distance. Copies share a fingerprint and are indexed once.

Within a variant no list of pairs is made: a task finds the connected parts among the fingerprints that
meet and hands on a spanning forest. A variant with more than BLOCK fingerprints is cut into blocks, and
each pair of blocks is a group of its own, so a task never holds more than two blocks and no link is lost.

What doesn't scale: a segment has 21 bits, so fingerprints without any relation meet as often as
n * n / 2**21 a variant; beyond some hundred million distinct fingerprints that outgrows the rest.

Defined results: a null, empty or blank text has fingerprint 0; fewer words than a shingle make one
shingle; repeated rows stay, each with its component; a null id is never a component's name, a component
of null ids only has a null name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import Scratch, arrow_map, id_and_text, utf8
from tallyloom.llm.components import components

SHINGLE = 4
SEED = 42
DISTANCE = 4
#: Bits of the three segments, from the lowest.
SEGMENTS = (22, 21, 21)
#: Fingerprints of one variant that a task compares at a time.
BLOCK = 4096
NEVER = 1 << 62
#: Up to this size groups are compared all at once, by their distance in the sorted batch.
SMALL = 24
#: Shingles whose bits are unpacked at a time.
UNPACK = 65_536


def shingle_hashes(text: bytes | None) -> list[bytes]:
    """XXH64 of each shingle of the text, as 8 bytes."""
    words = (text or b"").lower().split()  # of bytes: A-Z only, and blank, tab to carriage return only
    if not words:
        return []
    digest = xxhash.xxh64_digest
    if len(words) < SHINGLE:
        return [digest(b" ".join(words), SEED)]
    return [digest(s, SEED) for s in map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))]


def fingerprints(texts: list[bytes | None]) -> np.ndarray:
    """The SimHash of each text as uint64: a bit is set if it is in over half the hashes."""
    ones = np.zeros((len(texts), 64), np.int64)
    total = np.zeros(len(texts), np.int64)
    held: list[bytes] = []
    owner: list[int] = []
    rows = 0

    def unpack() -> None:
        nonlocal rows
        sizes = np.array([len(x) // 8 for x in held])
        bits = np.unpackbits(np.frombuffer(b"".join(held), np.uint8)).reshape(-1, 64)
        np.add.at(ones, owner, np.add.reduceat(bits, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0, dtype=np.int32))
        held.clear()
        owner.clear()
        rows = 0

    for i, text in enumerate(texts):
        hashes = shingle_hashes(text)
        total[i] = len(hashes)
        for a in range(0, len(hashes), UNPACK):
            held.append(b"".join(hashes[a : a + UNPACK]))
            owner.append(i)
            rows += len(held[-1]) // 8
            if rows >= UNPACK:
                unpack()
    if held:
        unpack()
    return np.packbits(2 * ones > total[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def forest(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among prints, found breadth first against what isn't reached yet."""
    left = np.unique(prints)
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    queue: list[np.uint64] = []
    while len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
        at = queue.pop()
        near = np.bitwise_count(left ^ at) <= DISTANCE
        if near.any():
            got = left[near]
            a.append(got)
            b.append(np.full(len(got), at))
            queue += list(got)
            left = left[~near]
    none = np.empty(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _batch(a: np.ndarray, b: np.ndarray, key: np.ndarray, block: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(key, pa.int64()), pa.array(block, pa.int32())], ["a", "b", "key", "block"])


def _linked(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Of (key, fingerprint) sorted by key: a forest's edges for each key, with block -1; of keys with over block fingerprints, the fingerprints by blocks."""
    key, prints, blocks = np.empty(0, np.int64), np.empty(0, np.uint64), 0

    def solve(key: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        """Whole groups only."""
        a, b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        size = np.diff(cut)
        for i in np.flatnonzero(size > SMALL):
            x, y = forest(prints[cut[i] : cut[i + 1]])
            a.append(x)
            b.append(y)
        few = np.repeat((size > 1) & (size <= SMALL), size)
        key, prints = key[few], prints[few]
        for d in range(1, min(SMALL, len(key))):
            near = (key[d:] == key[:-d]) & (np.bitwise_count(prints[d:] ^ prints[:-d]) <= DISTANCE)
            a.append(prints[d:][near])
            b.append(prints[:-d][near])
        x, y = np.concatenate(a), np.concatenate(b)
        pairs = np.unique(np.stack([np.maximum(x, y), np.minimum(x, y)]), axis=1) if len(x) else np.empty((2, 0), np.uint64)
        return _batch(pairs[0].copy(), pairs[1].copy(), np.zeros(pairs.shape[1], np.int64), np.full(pairs.shape[1], -1, np.int32))

    def hand_on(whole: bool) -> Iterator[pa.RecordBatch]:
        nonlocal key, prints, blocks
        if not len(key):
            return
        last = len(key) if whole else int(np.searchsorted(key, key[-1]))
        if blocks:  # the first key is being cut into blocks
            own = int(np.searchsorted(key, key[0], "right"))
            if own < len(key) or whole:
                yield _batch(prints[:own], prints[:own], key[:own], np.full(own, blocks, np.int32))
                key, prints, last, blocks = key[own:], prints[own:], last - own, 0
        if last > 0:
            yield solve(key[:last], prints[:last])
            key, prints = key[last:], prints[last:]
        while len(key) and key[0] == key[-1] and len(key) > block:
            yield _batch(prints[:block], prints[:block], key[:block], np.full(block, blocks, np.int32))
            key, prints, blocks = key[block:], prints[block:], blocks + 1

    for batch in batches:
        key = np.concatenate([key, batch.column(0).to_numpy(zero_copy_only=False)])
        prints = np.concatenate([prints, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        yield from hand_on(False)
    yield from hand_on(True)


def _meet(kept: Scratch, rows: DataFrame, block: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _linked(batches, block)

    return kept(rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "a long, b long, key long, block int"))


def variants(fp: Column) -> Column:
    """An array of the 64 one-wildcard variants: number of the bit left out, and the segment's other bits."""
    masks, low = [], 0
    for width in SEGMENTS:
        whole = (1 << width) - 1 << low
        masks += [whole & ~(1 << i) for i in range(low, low + width)]
        low += width
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    return F.transform(F.expr(f"array({', '.join(f'named_struct({chr(39)}bit{chr(39)}, {i}, {chr(39)}mask{chr(39)}, {m}L)' for i, m in enumerate(signed))})"), lambda x: F.xxhash64(x["bit"], fp.bitwiseAND(x["mask"])))


def link(prints: DataFrame, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """(a, b): edges that join the distinct fingerprints of column fp exactly as far as links of up to DISTANCE bits do."""
    kept = scratch or Scratch(prints.sparkSession)
    rows = prints.select(F.explode(variants(F.col("fp"))).alias("key"), "fp")
    met = _meet(kept, rows, block)
    edges = met.where("block = -1").select("a", "b")
    cut = met.where("block >= 0")
    if cut.limit(1).count():
        # Of keys cut into blocks, each pair of blocks meets: blocks are as many as the key's fingerprints / BLOCK.
        most = cut.groupBy("key").agg(F.max("block").alias("most"))
        pairs = cut.join(most, "key").select(F.explode(F.sequence(F.lit(0), F.col("most"))).alias("other"), "key", "block", F.col("a").alias("fp"))
        # Two blocks are never cut again: a last block can hold up to a batch more than the others.
        again = _meet(kept, pairs.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "fp"), NEVER)
        edges = edges.unionAll(again.where("block = -1").select("a", "b"))
    return edges.distinct()


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, text_hash) of each whole text; fp holds the 64 bits as a long."""

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fingerprints(utf8(batch.column(1))).view(np.int64))], ["doc_id", "text_hash", "fp"])

        return step

    rows = id_and_text(df, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    return arrow_map(rows, make, "doc_id long, text_hash long, fp long")


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, text_hash, fp, component_id): the component is named by its smallest id."""
    kept = scratch or Scratch(df.sparkSession)
    docs = kept(fingerprint(df, id_col, text_col))
    distinct = kept(docs.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(link(distinct, scratch=kept), scratch=kept)
    # Written, so that the joins are of plain exchanges, which Spark can split where one root or fingerprint holds most rows.
    known = kept(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    names = kept(known.groupBy("root").agg(F.min("first").alias("component_id")))
    named = kept(known.join(names, "root").select("fp", "component_id"))
    kept.drop_but(docs, named)
    return docs.join(named, "fp")


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row."""
    return dedup(df, id_col, text_col).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df without near-duplicates: of each component one row stays, that of the smallest id (of equal ids, the least text hash)."""
    kept_files = Scratch(df.sparkSession)
    found = kept_files(dedup(df, id_col, text_col, kept_files))
    kept_files.drop_but(found)
    # By fingerprint for null names: those of one component without an id are told apart by it.
    name = F.coalesce(F.col("component_id"), F.col("fp"))
    best = found.groupBy(F.col("component_id").isNull().alias("unnamed"), name.alias("name")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("kept"))
    kept = best.select(F.col("kept.doc_id").alias("kept_id"), F.col("kept.text_hash").alias("kept_hash")).distinct()
    mine, theirs = df[id_col].cast("long"), F.xxhash64(df[text_col].cast("string"))
    out = df.join(kept, mine.eqNullSafe(kept["kept_id"]) & (theirs == kept["kept_hash"]), "left_semi")
    if found.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count():
        # Rows repeated with their id: the columns are set aside so that no name can clash.
        rows = out.select(F.struct(*[out[c] for c in out.columns]).alias("row"), mine.alias("kept_id"), theirs.alias("kept_hash"))
        out = rows.dropDuplicates(["kept_id", "kept_hash"]).select("row.*")
    return out
