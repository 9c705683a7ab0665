"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import Scratch, ship


def _mark(edges: DataFrame) -> tuple[int, int]:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("hi", "lo")), F.lit(0))).first())


def _stars(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's edges (hi, lo) as stars: each node with the least that it reaches within most edges that follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}
        n = 0

        def find(i: int) -> int:
            while (up := root.setdefault(i, i)) != i:
                root[i] = i = root[up]
            return i

        def flush() -> pa.RecordBatch:
            out = [(i, find(i)) for i in list(root)]
            root.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out if x[0] != x[1]], pa.int64()) for k in (0, 1)], ["hi", "lo"])

        for batch in batches:
            for hi, lo in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if n == most:
                    yield flush()
                    n = 0
                n += 1
                i, j = find(hi), find(lo)
                root[max(i, j)] = min(i, j)
        if root:
            yield flush()

    return run


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, scratch: Scratch | None = None, small: int = 0) -> DataFrame:
    """(node, root) of each node that has an edge to another; root is the least node that can be reached, its own row included.

    Each round is two partial minima and two joins on the node and is written to the shared folder, so a
    hub of any degree costs no more than its rows and a lost executor repeats one round at most. The number
    of rounds grows with the logarithm of the longest chain. Nodes are longs; null ends are no edges.
    Files of earlier rounds go; the last one's belongs to scratch, if one is given.

    small: so many edges at a time are made stars in the task that reads them, before the first exchange; if no more
    are left after it, they are solved in one task, and there are no rounds. 0: rounds only.
    """
    kept = Scratch(edges.sparkSession)
    now = edges.where(f"{a} <> {b}").select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    if small:
        ship(edges.sparkSession)
        now = now.mapInArrow(_stars(small), "hi long, lo long")
    now = kept(now.distinct())
    mark = _mark(now)
    if 0 < mark[0] <= small:
        now, mark = kept(now.coalesce(1).mapInArrow(_stars(small), "hi long, lo long")), (0, 0)
    for _ in range(rounds):
        if not mark[0]:
            break
        both = now.selectExpr("hi as u", "lo as v").unionAll(now.selectExpr("lo as u", "hi as v"))
        # Minima are written: then both sides of the joins are plain exchanges, and Spark can split a hub's rows among tasks.
        least = kept(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, "u").selectExpr("v as hi", "m as lo").distinct()
        large = kept(large)
        low = kept(large.groupBy("hi").agg(F.min("lo").alias("m")))
        small = large.join(low, "hi").where("lo <> m").selectExpr("lo as hi", "m as lo").unionAll(low.selectExpr("hi", "m as lo"))
        now = kept(small.distinct())
        kept.drop_but(now)
        last, mark = mark, _mark(now)
        if mark == last:
            break
    else:
        raise RuntimeError("the components didn't settle")
    kept.drop_but(now)
    if scratch:
        scratch.adopt(kept)
    return now.selectExpr("hi as node", "lo as root").unionAll(now.selectExpr("lo as node", "lo as root").distinct())
