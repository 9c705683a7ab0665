import random

import numpy as np
import pyarrow as pa

from tallyloom.llm import passages
from tallyloom.llm.vectors import shingles, word_counts, word_hashes


def slow_tree(values, lo, hi, least):
    """Nodes of the Cartesian tree at least that wide, the first of equal values on top."""
    if hi - lo + 1 < least:
        return []
    k = min(range(lo, hi + 1), key=lambda i: (values[i], i))
    return [(lo, k, hi), *slow_tree(values, lo, k - 1, least), *slow_tree(values, k + 1, hi, least)]


def test_windows_are_the_trees_wide_nodes():
    rng = np.random.default_rng(1)
    owner = np.repeat([0, 2, 3], [300, 7, 90])
    tokens = rng.integers(0, 1 << 63, len(owner), dtype=np.uint64)
    for least in (1, 5, 46):
        for f in range(3):
            h = passages.ranks(tokens, f)
            value, first, last, k = passages.compact_windows(tokens, owner, f, least)
            begin = {t: int(np.searchsorted(owner, t)) for t in (0, 2, 3)}
            want = {(begin[t] + max(a, k - least + 1), begin[t] + min(b, k + least - 1) - least + 1, begin[t] + k) for t in begin for a, k, b in slow_tree(h[owner == t], 0, int((owner == t).sum()) - 1, least)}
            assert set(zip(first.tolist(), last.tolist(), k.tolist())) == want
            assert (value == h[k]).all()


def test_joint_windows_are_the_runs_with_both_minima():
    rng = np.random.default_rng(2)
    owner = np.repeat([0, 1], [200, 120])
    tokens = rng.integers(0, 1 << 63, len(owner), dtype=np.uint64)
    for least in (1, 5, 46):
        both = [passages.ranks(tokens, f) for f in (4, 5)]
        got = passages.joint_windows(*(passages.compact_windows(tokens, owner, f, least) for f in (4, 5)))
        runs = {}
        for v, w, a, b, k in zip(*(x.tolist() for x in got)):
            for s in range(a, b + 1):
                assert s not in runs and s <= k < s + least
                runs[s] = v, w
        want = {s: tuple(int(h[s : s + least].min()) for h in both) for s in range(len(tokens) - least + 1) if owner[s] == owner[s + least - 1]}
        assert runs == want


def test_loops_are_one_window():
    tokens = np.tile(np.arange(7, dtype=np.uint64), 60)
    for f in range(3):
        value, first, last, k = passages.compact_windows(tokens, np.zeros(len(tokens), np.int64), f)
        assert len(value) == 1 and first[0] == 0 and k[0] < 7 and last[0] == len(tokens) - passages.LEAST


def test_word_hashes_and_shingles():
    texts = [b"Ab, c\n\xc3\xa9x", None, b"", b"ab c", b"  z" * 3, b"w" * 3_000_000 + b" ab"]
    h, owner, a, b = word_hashes(texts)
    got = [[texts[o][i:j].lower() for o, i, j in zip(owner, a, b) if o == t] for t in range(len(texts))]
    assert got == [[b"ab", b"c", b"\xc3\xa9x"], [], [], [b"ab", b"c"], [b"z"] * 3, [b"w" * 3_000_000, b"ab"]]
    assert h[0] == h[3] == h[-1] and h[1] == h[4] and len(set(h.tolist())) == 5
    assert word_counts(texts).tolist() == [3, 0, 0, 2, 3, 2] and len(word_counts([])) == 0
    s, at = shingles(h, owner, 2)
    assert at.tolist() == [0, 1, 3, 5, 6, 8] and s[0] == s[2] and s[3] == s[4]
    assert len(shingles(h[:1], owner[:1], 2)[0]) == 0


def say(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def test_planted_passages(spark):
    rng = random.Random(2)
    shared, near, hot = say(rng, 60), say(rng, 200), say(rng, 55)
    edited = list(near)
    edited[50], edited[120] = "changed", "again"
    texts = {
        1: say(rng, 80) + shared + say(rng, 90),
        2: say(rng, 10) + shared,
        3: say(rng, 300),
        4: near,
        5: say(rng, 20) + edited + say(rng, 20),
        6: say(rng, 100) + shared[:40] + say(rng, 100),  # too short
        7: say(rng, 30),
        8: say(rng, 70),
        9: None,
        10: [],
        11: (p := say(rng, 60)) + say(rng, 30) + p,  # within one text
    }
    texts[12] = list(texts[8])
    texts[13], texts[14] = say(rng, 70) + ["so", "on"] * 100 + say(rng, 9), say(rng, 5) + ["so", "on"] * 60
    for i in range(20, 60):
        texts[i] = say(rng, rng.randrange(5, 60)) + hot + say(rng, rng.randrange(5, 60))
    rows = [(i, None if t is None else (", " if i == 2 else " ").join(t).upper() if i == 2 else " ".join(t or []), "x") for i, t in texts.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = {r.doc_id: r for r in passages.repeated(df).collect()}
    assert len(got) == len(rows)
    cls = {i: r.class_id for i, r in got.items()}
    assert cls[1] == cls[2] == 1 and cls[4] == cls[5] == 4 and cls[8] == cls[12] == 8 and cls[13] == cls[14] == 13 and {cls[i] for i in range(20, 60)} == {20}
    assert all(cls[i] == i and got[i].n_passages == 0 and got[i].passages == "" for i in (3, 6, 7, 9, 10, 11))
    assert got[1].passages == "80:140" and got[2].passages == "10:70" and got[12].passages == "0:70" and got[4].passages == "0:200"
    assert got[13].passages.startswith("70:270") and got[14].passages == "5:125"
    for i in range(20, 60):
        a, b = map(int, got[i].passages.split(":"))
        at = texts[i].index(hot[0])
        assert abs(a - at) <= 6 and abs(b - at - 55) <= 6
    empty = passages.repeated(df.where("false"))
    assert empty.count() == 0


def test_repeated_ids_and_null_ids(spark):
    rng = random.Random(3)
    text = " ".join(say(rng, 80))
    rows = [(None, text), (None, text), (3, text), (3, text), (2, "short"), (2, "short")]
    got = passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.class_id, r.n_passages) for r in got) == [("2", 2, 0), ("2", 2, 0), ("3", 3, 1), ("3", 3, 1), ("None", 3, 1), ("None", 3, 1)]


def test_grow_and_verify():
    x = np.arange(200, dtype=np.uint64)
    y = np.concatenate([np.arange(1000, 1050), np.arange(20, 140), np.arange(2000, 2010)]).astype(np.uint64)
    span = lambda k, a, b: (k << 32) | (a << 16) | b
    assert passages.verify_pair(x, y, [(span(60, 40, 60), span(90, 50, 60))]) == [(20, 139, 50, 169)]
    assert passages.verify_pair(x, y[:80], [(span(30, 10, 10), span(60, 10, 10))]) == []


def brute(x, y, kx, ky, least, jaccard, far):
    for a in range(max(0, kx - far), kx + 1):
        for b in range(max(kx, a + least - 1), min(len(x), kx + far + 1)):
            p = set(x[a : b + 1])
            for c in range(max(0, ky - far), ky + 1):
                for d in range(max(ky, c + least - 1), min(len(y), ky + far + 1)):
                    q = set(y[c : d + 1])
                    if len(p & q) >= jaccard * len(p | q) - 1e-9:
                        return True
    return False


def test_verify_is_brute_force():
    rng = random.Random(5)
    least, met = 6, [0, 0]
    for _ in range(400):
        x = [rng.randrange(10**6) for _ in range(rng.randrange(8, 17))]
        y = list(x)
        for _ in range(rng.randrange(1, 5)):
            at = rng.randrange(len(y))
            y[at : at + rng.randrange(3)] = [rng.randrange(10**6) for _ in range(rng.randrange(3))]
            y = y or [1]
        both = [(i, y.index(t)) for i, t in enumerate(x) if t in y]
        if not both:
            continue
        kx, ky = rng.choice(both)
        near = brute(x, y, kx, ky, least, 0.8, 2 * least)
        for longest in (True, False):
            got = passages.verify_pair(np.array(x, np.uint64), np.array(y, np.uint64), [(kx << 32, ky << 32)], least, longest=longest)
            assert got or not near
            for a, b, c, d in got:
                p, q = set(x[a : b + 1]), set(y[c : d + 1])
                assert a <= kx <= b and c <= ky <= d and min(b - a, d - c) + 1 >= least and len(p & q) >= 0.8 * len(p | q) - 1e-9
        met[near] += 1
    assert min(met) > 20


def test_insertions_and_deletions_are_alike():
    rng = random.Random(6)
    for one, more, two in ((40, 8, 40), (45, 10, 45), (35, 7, 35), (48, 12, 48), (51, 8, 30)):
        for _ in range(5):
            p, q = say(rng, one), say(rng, two)
            short = say(rng, 30) + p + q + say(rng, 30)
            long = say(rng, 20) + p + say(rng, more) + q + say(rng, 40)
            x, y = (passages._tokens([" ".join(t).encode()])[0] for t in (short, long))
            kx, ky = 30 + one // 2, 20 + one // 2
            for u, v, span in ((x, y, (kx << 32, ky << 32)), (y, x, (ky << 32, kx << 32))):
                assert passages.verify_pair(u, v, [span])


def test_windows_meet_their_keys_first():
    rng = random.Random(4)
    rows = sorted({(rng.randrange(12) if rng.random() < 0.7 else 100 + i, rng.randrange(6), rng.randrange(3)) for i in range(90)} | {(50, 1, i) for i in range(9)} | {(51, 1, 0), (51, 1, 1), (51, 2, 0)})
    rows = [r for r in rows for _ in range(rng.choice([1, 1, 3]))]  # copies read by several tasks
    spread = [(7, 3, 4, 9, 9), (5, 2, 2, 1, 1)]  # with a hub already
    want = set(spread)
    for key in {r[0] for r in rows}:
        own = sorted({r[1:] for r in rows if r[0] == key})
        if len({n for n, _ in own}) > 1:
            want |= {(key, n, s, *own[0]) for n, s in own}
    whole = [(*r, None, None) for r in rows] + spread
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*whole)], ["key", "node", "span", "hub", "hub_span"])
    for size in (1, 2, 3, 7, 1000):
        got = [tuple(r.values()) for b in passages._met(batch.slice(i, size) for i in range(0, len(whole), size)) for r in b.to_pylist()]
        assert set(got) == want and len(got) == len(want)


def copies(rng, n):
    """A passage of 50 words, and copies with one word changed: alike to it, but not to each other."""
    first = say(rng, 50)
    out = [first]
    for i in range(n):
        out.append([*first[: (at := 10 + i % 30)], f"new{i}", *first[at + 1 :]])
    return out


def sets_of(n, pairs):
    root = list(range(n))
    for i, j in pairs:
        root[passages._find(root, i)] = passages._find(root, j)
    return [passages._find(root, i) for i in range(n)]


def test_order_within_a_key_does_not_matter():
    rng = np.random.default_rng(8)
    rows = np.stack([np.sort(rng.integers(-40, 40, 400)), rng.integers(-5, 5, 400), rng.integers(0, 3, 400)], 1)
    out = []
    for _ in range(3):
        mixed = rows[np.lexsort((rng.random(len(rows)), rows[:, 0]))]
        batch = pa.RecordBatch.from_arrays([*(pa.array(c) for c in mixed.T), *(pa.nulls(len(mixed), pa.int64()),) * 2], ["key", "node", "span", "hub", "hub_span"])
        for size in (1, 7, 400):
            out.append([tuple(r.values()) for b in passages._met(batch.slice(i, size) for i in range(0, len(mixed), size)) for r in b.to_pylist()])
    kinds = {int(k): sorted({(int(n), int(s)) for q, n, s in rows if q == k}) for k in rows[:, 0]}
    assert out[0] == [(k, n, s, *own[0]) for k, own in kinds.items() if len({n for n, _ in own}) > 1 for n, s in own]
    assert all(x == out[0] for x in out)


def test_forest_is_brute_force():
    rng = random.Random(7)
    texts = copies(rng, 40) + [say(rng, 20) + t for t in copies(rng, 5)]
    same = say(rng, 12)
    texts = [say(rng, 30) + t + say(rng, 30) for t in texts] + [say(rng, 40) + same + say(rng, 40) for _ in range(9)]
    texts += [list(t) for t in texts[:8]] + [["so", "on"] * 50, ["so", "on"] * 60]
    rng.shuffle(texts)
    tokens = [passages._tokens([" ".join(t).encode()])[0] for t in texts]
    n = len(tokens)
    for k in range(3):
        at = np.array([rng.randrange(len(t)) if k else min(35, len(t) - 1) for t in tokens])
        slices = [t[max(0, a - 45) : a + 46] for t, a in zip(tokens, at)]
        at = np.minimum(at, 45)
        rows = np.arange(n) % 50
        joined = [(1, 3), (3, 9)] if k == 2 else []
        # Equal windows of one node stand for each other.
        alike = {(i, j) for i in range(n) for j in range(i) if rows[i] != rows[j] and passages.verify_pair(slices[i], slices[j], [(int(at[i]) << 32, int(at[j]) << 32)])}
        equal = [(i, j) for i in range(n) for j in range(i) if at[i] == at[j] and slices[i].tobytes() == slices[j].tobytes()]
        want = sets_of(n, [*alike, *joined, *equal])
        out = passages.forest(rows, at, slices, joined)
        assert all((i, j) in alike or (j, i) in alike for i, j in out)
        got = sets_of(n, [*out, *joined, *equal])
        assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_least_sets():
    rng = np.random.default_rng(3)
    for n in (1, 5, 9, 30):
        t = rng.integers(0, 12, n).astype(np.uint64)
        want = min(len(set(t[a : a + 9].tolist())) for a in range(n - 8)) if n >= 9 else n
        assert passages.least_sets(t, 9) == want


def test_copies_that_differ_meet_their_original(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(say(rng, 30) + t + say(rng, 30))) for i, t in enumerate(copies(rng, 60))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in passages.repeated(df).collect()}
    assert sum(c == 0 for c in got.values()) >= 59


def test_blocks_lose_no_link(spark):
    rng = random.Random(9)
    texts = [" ".join(say(rng, 30) + t + say(rng, 30)) for t in copies(rng, 20)]
    held = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    many = spark.createDataFrame([(5, i, 31 << 32 | 106, None) for i in range(21)], "key long, node long, span long, link long")
    for block in (4, 100):
        pairs = [(r.a, r.b) for r in passages.span_groups(many, held, block).collect()]
        assert len(set(sets_of(21, pairs))) == 1
    linked = many.selectExpr("key", "node", "span", "if(node % 2 = 0, 77L, null) as link")
    assert len(passages.span_groups(linked, held, 100).collect()) == 10


def near_copy(rng, passage, share):
    """passage with words changed until about that share of five-word shingles is left alike."""
    out = list(passage)
    while True:
        p, q = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (passage, out))
        if len(p & q) <= share * len(p | q):
            return out, len(p & q) / len(p | q)
        before = list(out)
        at = rng.randrange(len(out))
        out[at : at + rng.randrange(2)] = [f"new{rng.randrange(10**9)}"] * rng.randrange(2)
        q = {tuple(out[i : i + 5]) for i in range(len(out) - 4)}
        if len(p & q) < share * len(p | q) or len(out) < 50:
            return before, len(p & {tuple(before[i : i + 5]) for i in range(len(before) - 4)}) / len(p | {tuple(before[i : i + 5]) for i in range(len(before) - 4)})


def test_recall_by_likeness(spark):
    """Pairs of texts that share one passage alike to 0.8 or more; and pairs that share none alike so far."""
    rng = random.Random(10)
    rows, bands = [], {}
    for i in range(600):
        share = (0.8, 0.88, 0.95, 1.0)[i % 4]
        passage = say(rng, rng.randrange(50, 80))
        other, likeness = near_copy(rng, passage, share)
        if likeness < 0.8 or len(other) < 50:
            continue
        rows += [(2 * i, " ".join(say(rng, 40) + passage + say(rng, 40))), (2 * i + 1, " ".join(say(rng, 20) + other + say(rng, 50)))]
        bands.setdefault(min(int(likeness * 20) / 20, 1.0), []).append(2 * i)
    clean = range(10_000, 10_200)
    phrases = [say(rng, 12) for _ in range(3)]  # shared, but too short
    rows += [(i, " ".join(say(rng, 60) + phrases[i % 3] + say(rng, 60))) for i in clean]
    got = {r.doc_id: r for r in passages.repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    recall = {band: sum(got[i + 1].class_id == i for i in ids) / len(ids) for band, ids in sorted(bands.items())}
    print(recall, {b: len(x) for b, x in bands.items()})
    assert recall[1.0] == 1 and min(recall.values()) >= 0.95
    assert all(got[i].n_passages == 0 and got[i].class_id == i for i in clean)


def test_one_very_long_text_and_its_parts(spark):
    rng = random.Random(11)
    words = say(rng, 60_000)
    rows = [(0, " ".join(words)), (1, " ".join(words[31_000:31_200])), (2, " ".join(say(rng, 30) + words[59_900:]))]
    got = {r.doc_id: r for r in passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].passages == "31000:31200,59900:60000" and got[1].class_id == got[2].class_id == 0 and got[2].passages == "30:130"


def variants(rng, passage, n):
    """Texts that each have two words of the passage changed, far apart: not alike to it, but of most runs' minima."""
    out = []
    for i in range(n):
        out.append(list(passage))
        for at in (rng.randrange(5, 20), rng.randrange(30, 45)):
            out[-1][at] = f"new{i}x{at}"
    return out


def test_a_key_that_one_text_has_often_meets_with_each_place(spark):
    rng = random.Random(12)
    here, there = [], []
    for i in range(8):
        passage = say(rng, 50)
        before = [w for v in variants(rng, passage, 24) for w in v + say(rng, 30)]
        here.append((2 * i, " ".join(say(rng, 40) + before + passage + say(rng, 30))))
        there.append((2 * i + 1, " ".join(say(rng, 25) + passage + say(rng, 25))))
    apart = spark.createDataFrame(spark.sparkContext.parallelize(here + there, 2), "doc_id long, text string")
    assert [len(p) for p in apart.rdd.glom().collect()] == [8, 8]
    got = {r.doc_id: r for r in passages.repeated(apart).collect()}
    for i, text in here:
        a, b = map(int, got[i + 1].passages.split(":"))
        assert got[i + 1].class_id == i and a <= 25 and b >= 75
        n = len(text.split())
        spans = [tuple(map(int, p.split(":"))) for p in got[i].passages.split(",")]
        assert any(a <= n - 80 and b >= n - 30 for a, b in spans)


def test_places_of_a_minimum_have_their_windows():
    rng = np.random.default_rng(4)
    for least in (4, 6, 46):
        parts = [rng.integers(0, 9, 60), np.tile(rng.integers(0, 99, 7), 60), rng.integers(0, 30, 150)]
        owner = np.repeat([0, 1, 2], [len(p) for p in parts])
        tokens = passages.mix(np.concatenate(parts).astype(np.uint64))
        h = passages.ranks(tokens, 3)
        value, first, last, k, end = passages.compact_windows(tokens, owner, 3, least, places=True)
        place = {s: q for a, b, *q in zip(first.tolist(), last.tolist(), k.tolist(), end.tolist()) for s in range(a, b + 1)}
        for s in range(len(tokens) - least + 1):
            if owner[s] != owner[s + least - 1]:
                assert s not in place
                continue
            want, (a, b) = s + int(h[s : s + least].argmin()), place[s]
            # Between two places is a loop.
            assert want in (a, b) or a < want < b and any((tokens[a : b - d] == tokens[a + d : b]).all() for d in range(1, least + 1) if a + d < b)
        assert least < 7 or sum(a < 480 and b > 60 for a, b in zip(first.tolist(), last.tolist())) < 10


def test_one_minimum_over_many_records_is_met_at_each():
    rng = random.Random(13)
    lost = 0
    for _ in range(60):
        head = say(rng, 40)
        records = [head + say(rng, 12) for _ in range(40)]
        one = " ".join(w for r in records for w in r)
        two = " ".join(say(rng, 20) + records[20][30:] + records[21][:30] + say(rng, 20))
        x, y = (passages._tokens([t.encode()])[0] for t in (one, two))
        at = [{(r["key"], r["span"]) for b in passages._windows_of([t.encode()], np.array([0])) for r in b.to_pylist()} for t in (one, two)]
        lost += not any(passages.verify_pair(x, y, [(s, z)]) for k, s in at[0] for q, z in at[1] if k == q)
    assert lost == 0


def test_equal_windows_of_one_text_are_each_linked():
    rng = random.Random(14)
    passage = say(rng, 110)
    other = [*passage[:90], "new", *passage[91:]]
    tokens = [passages._tokens([" ".join(t).encode()])[0][5:96] for t in (passage, passage, other)]
    out = passages.forest(np.array([1, 1, 2]), np.array([45, 45, 45]), tokens)
    assert sorted(map(sorted, out)) == [[0, 2], [1, 2]]


def test_reach_is_brute_force():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 40):
        for _ in range(60):
            worth = np.where(rng.random(n) < 0.7, 0.2, -0.8 / rng.integers(1, 4, n))
            at = int(rng.integers(0, n))
            good = [(a, b) for a in range(at + 1) for b in range(at, n) if worth[a : b + 1].sum() >= -1e-9]
            want = (min(a for a, _ in good), max(b for _, b in good)) if good else (at, at - 1)
            assert passages._reach(passages._bounds(worth), at) == want


def test_may_hold_is_brute_force():
    rng = random.Random(15)
    least, met = 6, [0, 0]
    for _ in range(600):
        x = rng.sample(range(40), rng.randrange(6, 22))
        y = [t for t in x if rng.random() < 0.9] + rng.sample(range(40, 60), rng.randrange(4))
        rng.shuffle(y)
        kx, ky = rng.randrange(len(x)), rng.randrange(len(y))
        x, y = x[: kx + 2 * least + 1], y[: ky + 2 * least + 1]
        x, kx = x[max(0, kx - 2 * least) :], min(kx, 2 * least)
        y, ky = y[max(0, ky - 2 * least) :], min(ky, 2 * least)
        best = []
        for u, v, k in ((x, y, kx), (y, x, ky)):
            best.append(max((sum(t in v for t in u[a : b + 1]) / (b - a + 1) for a in range(k + 1) for b in range(max(k, a + least - 1), len(u))), default=0))
        want = min(best) > 0 and 1 / best[0] + 1 / best[1] <= 1 + 1 / 0.8 + 1e-4
        assert min(len(x), len(y)) < least or passages._may_hold(np.array(x), np.array(y), kx, ky, least, 0.8, 60) == want
        met[want] += 1
    assert min(met) > 50


def test_minima_between_the_same_ends_are_narrowed_down_once(monkeypatch):
    """Two texts with many minima in common in intervals that could be alike, but aren't: no sums over them for each minimum."""
    x = np.concatenate([np.append(np.arange(40 * i, 40 * i + 40), 10_000 + np.arange(11 * i, 11 * i + 11)) for i in range(30)]).astype(np.uint64)
    y = np.where(x >= 10_000, x + np.uint64(10_000), x)
    spans = [(k << 32, k << 32) for k in np.flatnonzero(x < 10_000).tolist()]
    long = []
    flags = passages._flags
    monkeypatch.setattr(passages, "_flags", lambda n, ids: long.append(len(ids) > 4 * passages.LEAST + 1) or flags(n, ids))
    assert passages.verify_pair(x, y, spans) == []
    assert sum(long) < len(spans)
