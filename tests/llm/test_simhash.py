import random

import numpy as np
import xxhash

from tallyloom.llm import components, simhash_dedup
from tallyloom.llm.common import materialise


def slow_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def slow_components(prints):
    """prints: list of (id, print) -> name of each row's component."""
    root = {p: p for _, p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    own = list(root)
    for i, p in enumerate(own):
        for q in own[:i]:
            if (p ^ q).bit_count() <= 4:
                root[find(p)] = find(q)
    names = {}
    for i, p in prints:
        if i is not None:
            names[find(p)] = min(i, names.get(find(p), i))
    return [names.get(find(p)) for _, p in prints]


def test_fingerprints_match_the_definition():
    rng = random.Random(1)
    texts = [None, "", " \n\t", "Solo", "Zwei Wörter", "a B\x0bc\rd", "x " * 300_000] + [" ".join(rng.choice(["Aa", "é", "cc\xa0d", "D,", " e"]) for _ in range(rng.randrange(1, 90))) for _ in range(60)]
    short = [t for t in texts if not t or len(t) < 10_000]
    assert [int(x) for x in simhash_dedup.fingerprints([t.encode() if t is not None else None for t in short])] == [slow_print(t) for t in short]
    assert int(simhash_dedup.fingerprints([texts[6].encode()])[0]) == xxhash.xxh64_intdigest(b"x x x x", 42)


def test_links_join_what_brute_force_joins(spark):
    rng = random.Random(2)
    prints = []
    for _ in range(40):
        p = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 40])):
            prints.append(p)
            for _ in range(rng.randrange(6)):
                p ^= 1 << rng.randrange(64)
    rows = [(i, p) for i, p in enumerate(prints)]
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in set(prints)], "fp long")
    want = slow_components(rows)
    for block in (7, 4096):
        roots = {r.node: r.root for r in components.components(simhash_dedup.link(frame, block)).collect()}
        got = [roots.get(q := (p - (1 << 64) if p >> 63 else p), q) for p in prints]
        assert len(set(zip(got, want))) == len(set(want)) == len(set(got))


def test_whole_operator_and_kept_rows(spark):
    base = " ".join(f"w{i % 37}x{i}" for i in range(400))
    near = base.replace("w5x5 ", "w5y5 ")
    rows = [(9, base, "s", 1), (3, base, None, 2), (4, near, "t", 3), (7, None, "t", 4), (8, "  ", "t", 5), (None, "", "t", 6), (11, "other words stand here alone", "t", 7), (11, "other words stand here alone", "t", 7), (None, "a text that has no id at all", "u", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    got = simhash_dedup.report(df).collect()
    want = slow_components([(r[0], slow_print(r[1])) for r in rows])
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == sorted((str(r[0]), f"{slow_print(r[1]):016x}", str(w)) for r, w in zip(rows, want))
    kept = simhash_dedup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["3", "7", "11", "None"])
    empty = df.where("false")
    assert simhash_dedup.report(empty).count() == 0 and simhash_dedup.keep_one(empty).count() == 0


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    hub = [(1000, 1000 + i) for i in range(1, 300)]
    loose = [(5000, 5000), (None, 3), (2, None)]
    found = materialise(components.components(spark.createDataFrame(chain + hub + loose, "a long, b long")))
    assert {(r.node, r.root) for r in found.collect()} == {(i, 0) for i in range(61)} | {(1000 + i, 1000) for i in range(300)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_edges_are_solved_without_rounds(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [tuple(x) for x in rng.integers(-150, 150, (170, 2)).tolist()] + [(i, i + 1) for i in range(1000, 1080)] + [(None, 3), (7, 7)]
    edges = spark.createDataFrame(rows, "a long, b long").repartition(3)
    want = {(r.node, r.root) for r in materialise(components.components(edges)).collect()}
    written = []
    write = components.Scratch.__call__
    monkeypatch.setattr(components.Scratch, "__call__", lambda self, df: written.append(df) or write(self, df))
    for small in (1000, 7):  # 7: more are left, so that rounds follow
        written.clear()
        assert {(r.node, r.root) for r in components.components(edges, small=small).collect()} == want
        assert (len(written) == 2) == (small == 1000)
    assert components.components(edges.where("false"), small=9).count() == 0


def test_forest_spans_each_part():
    rng = np.random.default_rng(3)
    prints = np.unique(rng.integers(0, 1 << 12, 500, dtype=np.uint64))
    a, b = simhash_dedup.forest(prints)
    rows = [(i, int(p)) for i, p in enumerate(prints)]
    assert len(a) == len(prints) - len(set(slow_components(rows)))
    assert (np.bitwise_count(a ^ b) <= 4).all()


def test_last_blocks_larger_than_others_lose_no_link(spark, monkeypatch):
    rng = random.Random(4)
    first = [rng.getrandbits(62) for _ in range(400)]
    low = [p for p in first] + [p | 1 << 62 for p in first]
    high = [rng.getrandbits(62) - (1 << 63) for _ in range(300)]
    high += [p + (1 << 62) for p in high]
    monkeypatch.setattr(simhash_dedup, "variants", lambda fp: simhash_dedup.F.array(simhash_dedup.F.when(fp < 0, 1).otherwise(2).cast("long")))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was, parts = spark.conf.get(key), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # both keys in one task
    want = {frozenset(x) for x in zip(first, low[400:])} | {frozenset(x) for x in zip(high[:300], high[300:])}
    try:
        for batch in (100, 330):
            spark.conf.set(key, str(batch))
            edges = simhash_dedup.link(spark.createDataFrame([(p,) for p in low + high], "fp long").coalesce(1), 40).collect()
            assert want <= {frozenset((r.a, r.b)) for r in edges}
    finally:
        spark.conf.set(key, was)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
