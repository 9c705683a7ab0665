"""Near-duplicate passages across texts by compact windows.

The tokens of a text are its five-word shingles. Under one hash function a Cartesian tree by least value parts
all runs of tokens into compact windows [l, k, r]: the runs within l and r that hold k have their minimum there.
Runs of LEAST tokens are what counts, as every longer passage is made of them; so nodes at least that wide are
kept, read off the minima of all runs of LEAST tokens, which change where one node gives way to the next.

Two runs whose token sets are alike to a share of J have the same minimum with probability J under each function.
Two functions have to agree: in each text the windows of a pair of functions are joined by their intervals, and
each overlap that still holds a run of LEAST tokens is a joint window, keyed by both minima. A text has about
4 / LEAST joint windows a token and pair. Texts meet by equal keys under any of PAIRS pairs of functions, so the
shortest passages alike to just 0.8 are missed by all about once in 60 times, longer or liker ones more rarely,
and repeated ones never.

Who meets isn't paired all with all. Among the texts that a task reads together, a key's first window is its hub,
and only hubs go on to the exchange; there the first of a key's hubs is that of the others. Each window is verified
with its hub on whole texts. Groups whose windows all lie in passages that link their texts by then are done. In the
others the tokens around all windows are compared: an index of the tokens that a group's windows share gives, for
each window, those that have enough in common with it, and a forest of alike windows goes on to verification on
whole texts, so that likeness that doesn't lead through a hub is found too. Groups over BLOCK windows are cut into blocks, and each pair
of blocks is a group of its own.

Verification narrows down on both sides what around the common minimum can be alike, tries long intervals first,
then all near the minimum; token sets alike to JACCARD or more are accepted. Where a passage holds one token twice, the last
step is a bound that may try too few intervals.

Nodes are distinct texts, by a 64-bit hash; copies are met once, and told apart again by their ids.
Words are runs of characters other than ASCII punctuation and white space, A-Z lower-cased.

Defined results: texts of fewer than LEAST tokens, null or empty ones have no passage. A passage that
repeats within one text only doesn't count. Repeated rows are copies of each other. Ids are cast to long.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import Scratch, id_and_text, small_batches, utf8
from tallyloom.llm.components import components
from tallyloom.llm.vectors import mix, same_runs, shingles, word_counts, word_hashes

SHINGLE = 5
#: Tokens of the shortest passage: those of 50 words.
LEAST = 46
JACCARD = 0.8
#: Pairs of hash functions, of which one has to agree.
PAIRS = 4
#: Windows of one group that are compared in one task; larger groups are cut into pairs of blocks.
BLOCK = 512
#: Cells of a table of windows and tokens up to which a group is counted by one product.
DENSE = 1 << 20
#: Pairs of windows whose tokens are compared at a time.
PIECE = 256
#: Sums of tokens kept while two texts are verified, about.
KNOWN = 1 << 20
#: Texts verified with one other at a time.
GUESTS = 256
#: Bytes of texts hashed at a time, about.
CHARS = 1 << 20
#: Nodes that a task remembers, so that copies are read once; when full it begins anew.
SEEN = 1 << 20
#: Links between texts up to which one task finds what they join; more go through rounds.
EDGES = 200_000
WINDOW = "key long, node long, span long, hub long, hub_span long"


def ranks(tokens: np.ndarray, function: int) -> np.ndarray:
    """A hash function of its own for each number, of tokens that are hashes already."""
    salt, odd = mix(np.array([2 * function + 1, 2 * function + 2], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    h = (tokens ^ salt) * (odd | np.uint64(1))
    return h ^ (h >> np.uint64(32))


def _tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, text of each)."""
    words, owner, _, _ = word_hashes(texts)
    tokens, first = shingles(words, owner, SHINGLE)
    return tokens, owner[first]


def run_minima(packed: np.ndarray, least: int) -> np.ndarray:
    """The minimum of each run of least values, from minima of runs of 1, 2, 4, ... values; two of the longest cover a run."""
    size = 1
    while 2 * size <= least:
        packed = np.minimum(packed[:-size], packed[size:])
        size *= 2
    return np.minimum(packed[: len(packed) - (least - size)], packed[least - size :])


def compact_windows(tokens: np.ndarray, owner: np.ndarray, function: int, least: int = LEAST, places: bool = False) -> tuple[np.ndarray, ...]:
    """(value, first, last, k) of each compact window: value is its minimum, at k; first and last are the starts of its first and last run of `least` tokens.

    Windows follow each other by their runs. Those of one value that follow each other are one: text in a loop
    gives one window, not one a round. Positions count from the first of all tokens; no window passes a text's end.

    places: they are one only where the minimum comes round at one distance with the same tokens between, and the last
    place is given too. What lies between the first and the last place of such a loop has the tokens of the loop, as
    what follows the first has; so whatever is alike around some place in it is alike around one of these two.
    """
    none = np.empty(0, np.int64)
    if len(tokens) < least:
        return (np.empty(0, np.uint64), none, none, none, none)[: 4 + places]
    h = ranks(tokens, function)
    low = np.uint64(max(1, int(len(tokens) - 1).bit_length()))
    # The place in the last bits parts equal values, the first of them first.
    minima = run_minima((h >> low << low) | np.arange(len(h), dtype=np.uint64), least)
    whole = owner[: len(minima)] == owner[least - 1 :]
    value = minima >> low
    change = np.concatenate([[True], (value[1:] != value[:-1]) | (owner[1 : len(minima)] != owner[: len(minima) - 1])])
    change[1:] |= whole[1:] != whole[:-1]
    place = (minima & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    if places:
        moved = np.flatnonzero(~change[1:] & whole[1:] & (place[1:] != place[:-1])) + 1
        change[moved] = True
        one, two = place[moved - 1], place[moved]
        loop = np.flatnonzero((one[1:] == two[:-1]) & ((two - one)[1:] == (two - one)[:-1])) + 1
        loop = loop[same_runs(tokens, one[loop - 1], one[loop], (two - one)[loop])]
        change[moved[loop]] = False
    start = np.flatnonzero(change)
    end = np.append(start[1:], len(minima)) - 1
    kept = whole[start]
    start, end = start[kept], end[kept]
    k = place[start]
    return (h[k], start, end, k, place[end]) if places else (h[k], start, end, k)


def joint_windows(one: tuple[np.ndarray, ...], two: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """(value of one, value of two, first, last, k of one) of each overlap of two functions' windows: an interval join of two lists in order, both of which cover the same runs."""
    first = np.unique(np.concatenate([one[1], two[1]]))
    i, j = np.searchsorted(one[1], first, "right") - 1, np.searchsorted(two[1], first, "right") - 1
    return one[0][i], two[0][j], first, np.minimum(one[2][i], two[2][j]), one[3][i]


def _chunks(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of some MB; a larger text is a range of its own."""
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t or b"") + 1
        if size >= CHARS or i + 1 == len(texts):
            yield a, i + 1
            a, size = i + 1, 0


def _rows(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "node", "span", "hub", "hub_span"])


def _windows_of(texts: list[bytes | None], node: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Joint windows of some texts. Of a key that several texts have, the first goes without a hub, and all with that first one as hub; of a key of one text all go without a hub, however often it is there."""
    tokens, owner = _tokens(texts)
    if not len(tokens):
        return
    begin = np.searchsorted(owner, np.arange(len(texts)))
    size = np.diff(np.append(begin, len(owner)))
    for p in range(PAIRS):
        *one, last = compact_windows(tokens, owner, 2 * p, places=True)
        two = compact_windows(tokens, owner, 2 * p + 1)
        a, b, start, _, k = joint_windows(one, two)
        last = joint_windows((*one[:3], last), two)[4]
        more = np.flatnonzero(last != k)
        a, b, start, k = (np.append(x, y[more]) for x, y in ((a, a), (b, b), (start, start), (k, last)))
        text = owner[start]
        key = mix(mix(a + np.uint64(p)) + b).view(np.int64)
        span = (k - begin[text]) << 32 | size[text]
        own = node[text]
        order = np.argsort(key)
        again = np.flatnonzero(key[order[1:]] == key[order[:-1]])
        several = np.unique(np.append(again, again + 1))  # places of keys that occur twice
        some = order[several]
        order[several] = some[np.lexsort((span[some], own[some], key[some]))]
        key, own, span = key[order], own[order], span[order]
        new = np.append(True, key[1:] != key[:-1])[: len(key)]
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        shared = np.zeros(len(key), bool)
        shared[head[own != own[head]]] = True
        shared = shared[head]
        out = new | ~shared
        none = pa.nulls(int(out.sum()), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(own[out]), pa.array(span[out]), none, none], ["key", "node", "span", "hub", "hub_span"])
        if shared.any():
            yield _rows(key[shared], own[shared], span[shared], own[head][shared], span[head][shared])


def windows(rows: DataFrame) -> DataFrame:
    """(key, node, span, hub, hub_span) of the joint windows of (node, text): span packs the minimum's place and the number of the text's tokens.

    hub is null for windows that are to meet those of texts hashed elsewhere; see _windows_of.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[bytes | None, int]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            yield from _windows_of([t for t, _ in held], np.array([n for _, n in held], np.int64))
            held.clear()
            size = 0

        for batch in batches:
            for text, node in zip(utf8(batch.column(1)), batch.column(0).to_pylist(), strict=True):
                if node in seen or not text:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                if size and size + len(text) > CHARS:
                    yield from flush()
                held.append((text, node))
                size += len(text)
        if held:
            yield from flush()

    return rows.mapInArrow(run, WINDOW)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of windows sorted by key: those with a hub as they are; of the others those whose key two nodes have, with the key's first by node and span as hub.

    The last key of a batch waits for the next one. Of those without a hub a key has a row for each piece of texts
    hashed together, or the places in one text, so that few wait.
    """

    def solve(key: np.ndarray, node: np.ndarray, span: np.ndarray) -> Iterator[pa.RecordBatch]:
        same = key[1:] == key[:-1]
        again = np.zeros(len(key), bool)
        again[1:] = same
        again[:-1] |= same
        key, node, span = key[again], node[again], span[again]
        if not len(key):
            return
        order = np.lexsort((span, node, key))
        key, node, span = key[order], node[order], span[order]
        new = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]) | (span[1:] != span[:-1]))
        key, node, span = key[new], node[new], span[new]
        cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(cut, len(key)))
        head = np.repeat(cut, size)
        shared = np.repeat(np.logical_or.reduceat(node != node[head], cut), size)
        if shared.any():
            head = head[shared]
            yield _rows(key[shared], node[shared], span[shared], node[head], span[head])

    held = (np.empty(0, np.int64),) * 3
    for batch in batches:
        with_hub = batch.column(3).is_valid().to_numpy(zero_copy_only=False)
        if with_hub.any():
            yield batch.filter(pa.array(with_hub))
        held = tuple(np.append(x, batch.column(c).to_numpy(zero_copy_only=False)[~with_hub]) for c, x in enumerate(held))
        if len(held[0]):
            c = int(held[0].searchsorted(held[0][-1]))
            yield from solve(*(x[:c] for x in held))
            held = tuple(x[c:] for x in held)
    yield from solve(*held)


def meet(rows: DataFrame) -> DataFrame:
    """(key, node, span, hub, hub_span): windows of keys that two nodes have, each with its hub, hubs with themselves.

    Windows that have a hub from their own task stay spread by their node; of each key just the hubs come together.
    They are sorted by the key alone, as Spark has a faster sort for one number.
    """
    by = F.when(F.col("hub").isNull(), F.col("key")).otherwise(F.xxhash64("key", "node"))
    return rows.repartition(by).sortWithinPartitions("key").mapInArrow(_met, WINDOW)


def _find(root: list[int], i: int) -> int:
    while root[i] != i:
        root[i] = root[root[i]]
        i = root[i]
    return i


def least_sets(tokens: np.ndarray, least: int) -> int:
    """The least number of distinct tokens in a run of `least` tokens."""
    n = len(tokens)
    if n < least or len(np.unique(tokens)) == n:
        return min(n, least)
    runs = np.lib.stride_tricks.sliding_window_view(_previous(tokens), least)
    return int((runs < np.arange(len(runs))[:, None]).sum(1).min())


@lru_cache(2)
def _spread(least: int, far: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of all intervals of at least `least` around place `far`, among 2 * far + 1."""
    a, b = np.divmod(np.arange((far + 1) ** 2), far + 1)
    long = b + far - a + 1 >= least
    return a[long], b[long] + far


def best_shares(inside: np.ndarray, intervals: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The largest share of any of the intervals, for each row: 1 for what is inside, 0 for what isn't, much less beyond a text's ends."""
    sums = np.zeros((inside.shape[1] + 1, len(inside)), np.float32)
    np.cumsum(inside.T, axis=0, out=sums[1:])
    a, b = intervals
    return ((sums[b + 1] - sums[a]) / (b - a + 1).astype(np.float32)[:, None]).max(0)


def may_be_alike(one: np.ndarray, two: np.ndarray, jaccard: float) -> np.ndarray:
    """Whether shares of own tokens inside that are no larger than these can belong to alike sets: 1 / J is the sum of their inverses less one."""
    return 1 / np.maximum(one, 1e-6) + 1 / np.maximum(two, 1e-6) <= 1 + 1 / jaccard + 1e-4


def forest(node: np.ndarray, at: np.ndarray, tokens: list[np.ndarray], joined: list[tuple[int, int]] = (), least: int = LEAST) -> list[tuple[int, int]]:
    """Pairs of rows that, with those joined already, link windows just as far as alike ones of different nodes do. at: where the common minimum is among a window's tokens.

    Windows of equal tokens of two nodes are alike and stand for each other; those of one node each have to be linked. Alike passages have J / (1 + J) of both sides' tokens in
    common, and a side has as many as any run of it at least: only windows with so many tokens in common are tried,
    and those are counted by an index of the tokens that two windows have. Of these the largest shares that runs
    have inside the other window have to allow alike sets. Each two are looked at once, if they aren't linked by then.
    """
    root = list(range(len(tokens)))
    for i, j in joined:
        root[_find(root, i)] = _find(root, j)
    out: list[tuple[int, int]] = []
    same: dict[tuple[int, bytes], int] = {}
    stands: list[int] = []  # one row for each content
    others: dict[int, int] = {}  # for such a row one of equal content and another node
    for i, t in enumerate(tokens):
        first = same.setdefault((int(at[i]), t.tobytes()), i)
        if first == i or node[i] == node[first] and _find(root, i) != _find(root, first):
            stands.append(i)
            continue
        if node[i] != node[first]:
            others.setdefault(first, i)
            if _find(root, i) != _find(root, first):
                out.append((first, i))
        root[_find(root, i)] = _find(root, first)
    n = len(stands)
    _, ids = np.unique(np.concatenate([tokens[i] for i in stands]), return_inverse=True)
    window = np.repeat(np.arange(n), [len(tokens[i]) for i in stands])
    pairs = np.unique(ids.astype(np.int64) * n + window)
    token, window = np.divmod(pairs, n)
    often = np.bincount(token)[token] > 1
    token, window = token[often], window[often]
    shared, token = np.unique(token, return_inverse=True)
    begin = np.searchsorted(token, np.arange(int(token.max(initial=-1)) + 2))
    by_window = np.argsort(window, kind="stable")
    mine, cut = token[by_window], np.searchsorted(window[by_window], np.arange(n + 1))
    # Which shared tokens a window has; the last column, which none has, is for all other tokens.
    has = np.zeros((n, len(shared) + 1), bool)
    has[window, token] = True
    column = np.full(int(ids.max(initial=-1)) + 2, len(shared))
    column[shared] = np.arange(len(shared))
    # All windows with their minima in one column; -1: beyond the text's ends.
    far = least - 1
    grid = np.full((n, 2 * far + 1), -1, np.int16 if ids.max(initial=0) < 32_000 else np.int32)
    ends = np.append(0, np.cumsum([len(tokens[i]) for i in stands]))
    for w, i in enumerate(stands):
        grid[w, far - at[i] : far - at[i] + len(tokens[i])] = ids[ends[w] : ends[w + 1]]
    ordered = np.sort(grid, axis=1)
    twice = ((ordered[:, 1:] == ordered[:, :-1]) & (ordered[:, 1:] >= 0)).any(1)
    smallest = np.array([least_sets(tokens[i], least) if w else min(len(tokens[i]), least) for i, w in zip(stands, twice.tolist(), strict=True)])
    needed = JACCARD / (1 + JACCARD) * smallest - 1e-9
    intervals = _spread(least, far)
    owners, doubled = node[stands], np.array([i in others for i in stands])
    # (p, q) of what has enough in common, a few thousand at a time.
    held: list[np.ndarray] = []
    size = 0

    def settle() -> None:
        nonlocal size
        pairs = np.concatenate(held, axis=1)
        held.clear()
        size = 0
        kin = np.array([_find(root, i) for i in stands])
        pairs = pairs[:, (kin[pairs[0]] != kin[pairs[1]]) & ((owners[pairs[0]] != owners[pairs[1]]) | doubled[pairs].any(0))]
        for a in range(0, pairs.shape[1], PIECE):
            p, q = pairs[:, a : a + PIECE]
            fits = twice[p] | twice[q]
            near = np.flatnonzero(~fits)
            for own, other in ((p, q), (q, p)):  # either side must have J of some run inside the other
                g = grid[own[near]]
                shares = best_shares(np.where(g < 0, np.float32(-1000), has[other[near][:, None], column[g]].astype(np.float32)), intervals)
                if own is p:
                    enough = shares >= JACCARD - 1e-4
                    near, first = near[enough], shares[enough]
            fits[near[may_be_alike(first, shares, JACCARD)]] = True
            for i, j in zip(p[fits].tolist(), q[fits].tolist(), strict=True):
                i, j = stands[i], stands[j]
                if node[i] == node[j]:
                    i, j = others.get(i, i), j if i in others else others.get(j, j)
                if node[i] != node[j] and _find(root, i) != _find(root, j) and verify_pair(tokens[i], tokens[j], [(int(at[i]) << 32, int(at[j]) << 32)], least, longest=False):
                    root[_find(root, j)] = _find(root, i)
                    out.append((i, j))

    if n * len(begin) <= DENSE:  # all counts at once
        ones = has.astype(np.float32)
        held.append(np.stack(np.nonzero(np.triu(ones @ ones.T >= needed[:, None] + needed[None, :] - 1e-3, 1))))
        settle()
        return out
    for p in range(n - 1):
        own = mine[cut[p] : cut[p + 1]]
        if len(own) < needed[p] + needed.min():
            continue
        common = np.bincount(np.concatenate([window[begin[t] : begin[t + 1]] for t in own]), minlength=n)
        near = np.flatnonzero(common[p + 1 :] >= needed[p + 1 :] + needed[p]) + p + 1
        if len(near):
            held.append(np.stack([np.full(len(near), p), near]))
            size += len(near)
            if size >= 16 * PIECE:
                settle()
    if held:
        settle()
    return out


def spelled(many: DataFrame, held: DataFrame) -> DataFrame:
    """(key, node, span, link, tokens, at) of (key, node, span, link): the tokens LEAST - 1 to either side of each window's minimum, eight bytes each. Each text is read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, which, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2))
            for lo, hi in _chunks(texts):
                tokens, owner = _tokens(texts[lo:hi])
                cut = np.searchsorted(owner, np.arange(hi - lo + 1))
                out = []
                for i in range(lo, hi):
                    own = tokens[cut[i - lo] : cut[i - lo + 1]]
                    for w in which[i]:
                        k = w["span"] >> 32
                        a = min(k, LEAST - 1)
                        out.append((w["key"], node[i], w["span"], w["link"], own[k - a : k + LEAST].tobytes(), a))
                        if len(out) >= 4096:
                            yield _spelled_batch(out)
                            out = []
                if out:
                    yield _spelled_batch(out)

    by_node = many.groupBy("node").agg(F.collect_list(F.struct("key", "span", "link")).alias("which"))
    return by_node.join(held, "node").select("node", "which", "text").mapInArrow(run, "key long, node long, span long, link long, tokens binary, at long")


def _spelled_batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["key", "node", "span", "link", "tokens", "at"])


def _spanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, sa, sb) of (group, node, span, link, tokens, at) sorted by group: a forest's for each group."""
    group, rows = None, []

    def solve() -> Iterator[pa.RecordBatch]:
        if len({r[0] for r in rows}) < 2:
            return
        node, span, link, tokens, at = zip(*rows, strict=True)
        first: dict[int, int] = {}
        joined = [(i, first.setdefault(name, i)) for i, name in enumerate(link) if name is not None]
        pairs = forest(np.array(node), np.array(at), [np.frombuffer(t, np.uint64) for t in tokens], joined)
        out = [(node[i], node[j], span[i], span[j]) for i, j in pairs]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b", "sa", "sb"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != group:
                yield from solve()
                group, rows = row[0], []
            rows.append(row[1:])
    yield from solve()


def span_groups(many: DataFrame, held: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b, sa, sb): of the windows of each key, pairs that join all whose tokens are alike, but for those that have one link and so are joined already. Keys with over block windows are cut into blocks, each pair of blocks a group of its own."""
    sizes = many.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    rows = spelled(many, held).join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node", "span"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    group = F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")))
    rows = rows.select(group.alias("group"), "node", "span", "link", "tokens", "at")
    return rows.repartition("group").sortWithinPartitions("group", "node", "span").mapInArrow(_spanned, "a long, b long, sa long, sb long")


def _grow(inside: np.ndarray, at: int, share: float, sums: np.ndarray | None = None) -> tuple[int, int]:
    """The longest interval around at of which a share of tokens is inside, trimmed to tokens that are. sums: what _sums gives, if it is at hand."""
    sums = _sums(inside, share) if sums is None else sums
    best = np.maximum.accumulate(sums[: at : -1])[::-1]  # the largest sum up to each end or a later one
    left = sums[: at + 1]
    # Only starts whose sum is below all before them can begin the longest interval.
    lows = np.flatnonzero(left < np.minimum.accumulate(np.append(np.inf, left[:-1])))
    reach = np.searchsorted(-best, -left[lows] + 1e-9, "right") - 1
    good = reach >= 0
    if not good.any():
        return at, at
    lows, reach = lows[good], reach[good]
    i = int((reach - lows).argmax())
    lo, hi = int(lows[i]), at + int(reach[i])
    own = np.flatnonzero(inside[lo : hi + 1])
    return (lo + int(own[0]), lo + int(own[-1])) if len(own) else (at, at)


def _from_none(worth: np.ndarray) -> np.ndarray:
    out = np.zeros(len(worth) + 1)
    np.cumsum(worth, out=out[1:])
    return out


def _sums(inside: np.ndarray, share: float) -> np.ndarray:
    """Sums of what tokens are worth, from none to all."""
    return _from_none(inside - share)


def _flags(n: int, ids: np.ndarray) -> np.ndarray:
    out = np.zeros(n, bool)
    out[ids] = True
    return out


def _bounds(worth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What _reach looks positions up in: of the sums of what tokens are worth, the least up to each place and the largest from it on, both with their signs turned, so that they rise."""
    sums = -_from_none(worth)
    return np.maximum.accumulate(sums), np.minimum.accumulate(sums[::-1])[::-1]


def _reach(bounds: tuple[np.ndarray, np.ndarray], at: int) -> tuple[int, int]:
    """First and last position of all intervals around at whose sum isn't negative; (at, at - 1) if there are none."""
    low, high = bounds
    least, most = low[at], high[at + 1]
    if most > least + 1e-9:
        return at, at - 1
    return int(low.searchsorted(most - 1e-9)), int(high.searchsorted(least + 1e-9, "right")) - 2


def _around(weight: np.ndarray, at: int) -> tuple[int, int]:
    """The interval around at with the largest sum."""
    sums = _from_none(weight)
    return int(sums[: at + 1].argmin()), at + int(sums[at + 1 :].argmax())


def _brings(where: np.ndarray, value: np.ndarray, outside: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each of falling ends the largest sum of the first tokens, of their value for those with where >= end and what is outside for others."""
    if not len(where):
        return np.zeros(len(ends))
    return np.cumsum(np.where(where >= ends[:, None], value, outside), axis=1).max(1)


def _previous(x: np.ndarray) -> np.ndarray:
    """The place of the last equal value before each, or -1."""
    order = np.argsort(x, kind="stable")
    ordered = x[order]
    out = np.full(len(x), -1)
    again = (ordered[1:] == ordered[:-1]).nonzero()[0]
    out[order[again + 1]] = order[again]
    return out


def _search(x: np.ndarray, y: np.ndarray, kx: int, ky: int, least: int, jaccard: float) -> Iterator[tuple[int, int, int, int]]:
    """Intervals around kx and ky that may be alike, the best d of each x interval: all x intervals are tried that can be part of a pair.

    Alike is (1 + J) common >= J (own x + own y), so for one x interval the best on y has the largest sum of 1 for
    each token that is inside and -J for each that isn't. Where y has no token twice that is exact, else a bound: of
    a token's places only the nearest to ky on either side can add to a set.
    """
    n = int(max(x.max(), y.max())) + 1
    before, after = np.full(n, -1), np.full(n, len(x))
    before[x[: kx + 1]] = np.arange(kx + 1)  # the last of equal ones stays
    after[x[kx:][::-1]] = np.arange(len(x) - 1, kx - 1, -1)
    before, after = before[y], after[y]
    within = _flags(n, y)[x]
    nearest = np.zeros(len(y), bool)
    last, first = np.full(n, -1), np.full(n, len(y))
    last[y[: ky + 1]] = np.arange(ky + 1)
    first[y[ky:][::-1]] = np.arange(len(y) - 1, ky - 1, -1)
    nearest[last[last >= 0]] = nearest[first[first < len(y)]] = True
    value = nearest.astype(float)
    outside = -jaccard * value / np.maximum(1, np.bincount(y[nearest], minlength=n)[y])
    # The end of y's interval is no nearer than least to its start.
    starts = np.arange(min(ky, len(y) - least) + 1)
    ends = np.maximum(ky, starts + least - 1) + 1
    step = max(1, (1 << 20) // len(y))
    # What each end can bring at most: the best on its own side of ky, and all that lies across.
    low, high = np.arange(len(y)) <= ky, np.arange(len(y)) > ky
    by_a = _brings(before[low][::-1], value[low][::-1], outside[low][::-1], np.arange(kx, -1, -1))[::-1]
    by_a += (1 + jaccard) * np.cumsum(np.bincount(before[high & nearest & (before >= 0)], minlength=kx + 1)[::-1])[::-1]
    by_b = np.append(0.0, _brings(-after[high], value[high], outside[high], -np.arange(kx, len(x))))[1:] if high.any() else np.zeros(len(x) - kx)
    by_b = np.maximum(by_b, 0.0) + (1 + jaccard) * np.cumsum(np.bincount(after[low & nearest & (after < len(x))], minlength=len(x))[kx:] * (np.arange(kx, len(x)) > kx))
    # x's interval has at least so many tokens of its own; only starts that some end can make up for are left.
    tokens = np.append(0.0, np.cumsum(1 / np.bincount(x, minlength=n)[x]))
    most = np.maximum.accumulate((by_b - jaccard * tokens[kx + 1 :])[::-1])[::-1]
    begins = np.arange(min(kx, len(x) - least) + 1)
    begins = begins[by_a[begins] + jaccard * tokens[begins] + most[np.maximum(kx, begins + least - 1) - kx] >= -1e-9]
    if not len(begins):
        return
    # All starts at once, the last first: which tokens are the first of their kind from a start on, and what is alike enough at each end.
    begins, e = begins[::-1], int(begins[0])
    place = np.arange(e, len(x))
    fresh = (_previous(x)[None, e:] < begins[:, None]) & (place >= begins[:, None])
    own, common = fresh.cumsum(1), (fresh & within[None, e:]).cumsum(1)
    least_own = jaccard * own - 1e-9
    # Ends that aren't inside only make a longer interval less alike.
    good = (common >= least_own) & ((place == begins[:, None] + least - 1) | (within[begins][:, None] & within[None, e:]))
    good &= place >= np.maximum(kx, begins + least - 1)[:, None]
    good &= by_a[begins][:, None] + np.concatenate([np.zeros(max(0, kx - e)), by_b[max(0, e - kx) :]]) >= least_own
    for r in good.any(1).nonzero()[0].tolist():
        a, own_a, b = int(begins[r]), own[r], place[good[r]]
        for i in range(0, len(b), step):
            part = b[i : i + step]
            inside = (before >= a)[None, :] | (after[None, :] <= part[:, None])
            sums = np.zeros((len(part), len(y) + 1))
            np.cumsum(np.where(inside, value[None, :], outside[None, :]), axis=1, out=sums[:, 1:])
            high = np.maximum.accumulate(sums[:, ::-1], axis=1)[:, ::-1]
            gain = high[:, ends] - sums[:, starts]
            c = gain.argmax(1)
            spare = gain[np.arange(len(part)), c] - jaccard * own_a[part - e]
            if spare.max() < -1e-9:
                continue
            for o in np.argsort(-spare):
                if spare[o] < -1e-9:
                    break
                yield a, int(part[o]), int(c[o]), int(ends[c[o]]) + int(sums[o, ends[c[o]] :].argmax()) - 1


@lru_cache(2)
def _inverse_lengths(least: int) -> np.ndarray:
    """1 / length of intervals by how far they go to the left and to the right, up to 2 * least; 0 where they are shorter than least."""
    length = np.arange(2 * least + 1)[:, None] + np.arange(2 * least + 1)[None, :] + 1
    return np.where(length >= least, 1 / length, 0).astype(np.float32)


@lru_cache(4 * LEAST)
def _counts(n: int) -> np.ndarray:
    return np.arange(n)


def _may_hold(x: np.ndarray, y: np.ndarray, kx: int, ky: int, least: int, jaccard: float, n: int) -> bool:
    """Whether intervals around kx and ky, no further than 2 * least from them, have large enough shares of the other side's tokens, which are below n; True where a token repeats."""
    in_x, in_y = _flags(n, x), _flags(n, y)
    if np.count_nonzero(in_x) < len(x) or np.count_nonzero(in_y) < len(y):
        return True
    inside_x = in_y[x]
    # Without repeated tokens both sides have as many inside; J of the shortest run is needed.
    if np.count_nonzero(inside_x) < jaccard * least - 1e-3:
        return False
    sides: list[tuple[np.ndarray, int]] = []
    for inside, k in ((inside_x, kx), (in_x[y], ky)):
        sums = np.zeros(len(inside) + 1, np.float32)
        inside.cumsum(out=sums[1:])
        sides.append((sums, k))
        # Whether any interval has a share of J: of each start the best end that is far enough.
        worth = sums - np.float32(jaccard - 2e-3) * _counts(len(sums))
        best = np.maximum.accumulate(worth[::-1])[::-1]
        starts = min(k, len(inside) - least) + 1
        if (best[np.maximum(_counts(starts) + least, k + 1)] < worth[:starts]).all():
            return False
    shares = [((sums[k + 1 :] - sums[: k + 1, None]) * _inverse_lengths(least)[k::-1, : len(sums) - 1 - k]).max() for sums, k in sides]
    return bool(min(shares) >= jaccard - 1e-3 and may_be_alike(shares[0], shares[1], jaccard))


def verify_pair(x: np.ndarray, y: np.ndarray, spans: list[tuple[int, int]], least: int = LEAST, jaccard: float = JACCARD, longest: bool = True, named: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int, int, int]]:
    """The alike passages (first and last token on each side) of two texts, from their windows with a minimum in common.

    Of two alike passages each has a share of J of its own tokens on the other side, whatever their lengths. What can
    hold such passages around the common minimum is narrowed down on either side in turn; nothing is lost by that.
    Of what is left the longest intervals are tried first, with the shares that several ratios of lengths need, then
    the best intervals, and then all that lie within 2 * least of the common minimum. longest False: only the last.
    named: the distinct tokens of x in order, and the number of each of x's tokens among them, if they are at hand.
    """
    if min(len(x), len(y)) < least:
        return []
    found: list[tuple[int, int, int, int]] = []
    failed: set[tuple[int, int, int, int]] = set()
    names, x = named or np.unique(x, return_inverse=True)
    ids = np.minimum(names.searchsorted(y), len(names) - 1)
    new = (names[ids] != y).nonzero()[0]
    others, ids[new] = np.unique(y[new], return_inverse=True)
    ids[new] += len(names)
    n, y = len(names) + len(others), ids
    # A token outside weighs on its text once, however often it is there.
    out_x, out_y = (-jaccard / np.bincount(z, minlength=n)[z] for z in (x, y))

    bounds_x = _bounds(np.where(_flags(n, y)[x], 1 - jaccard, out_x))
    # Most minima of two texts are narrowed down to the same few intervals: of those the bounds are kept.
    known: dict[tuple[bool, int, int, int, int], tuple[np.ndarray, np.ndarray]] = {}
    room = KNOWN

    def bounds(turned: bool, a: int, b: int, c: int, d: int) -> tuple[np.ndarray, np.ndarray]:
        """Of x's tokens a to b by what y's c to d hold; turned: of y's by what x's hold."""
        nonlocal room
        out = known.get((turned, a, b, c, d))
        if out is None:
            u, v = x[a : b + 1], y[c : d + 1]
            out = _bounds(np.where(_flags(n, u)[v], 1 - jaccard, out_y[c : d + 1]) if turned else np.where(_flags(n, v)[u], 1 - jaccard, out_x[a : b + 1]))
            room -= len(out[0])
            if room < 0:
                known.clear()
                room = KNOWN - len(out[0])
            known[turned, a, b, c, d] = out
        return out

    def alike(a: int, b: int, c: int, d: int) -> bool:
        if d - c + 1 < least or b - a + 1 < least or (a, b, c, d) in failed:
            return False
        p, q = _flags(n, x[a : b + 1]), _flags(n, y[c : d + 1])
        if (p & q).sum() >= jaccard * (p | q).sum() - 1e-9:
            found.append((a, b, c, d))
            return True
        failed.add((a, b, c, d))
        return False

    def narrowed(kx: int, ky: int) -> tuple[int, int, int, int] | None:
        a, b = _reach(bounds_x, kx)
        c, d = 0, len(y) - 1
        while b - a + 1 >= least:
            last = a, b, c, d
            e, f = _reach(bounds(True, a, b, c, d), ky - c)
            c, d = c + e, c + f
            if d - c + 1 < least:
                return None
            e, f = _reach(bounds(False, a, b, c, d), kx - a)
            a, b = a + e, a + f
            if last == (a, b, c, d):
                return last
        return None

    def tries(a: int, b: int, c: int, d: int, kx: int, ky: int, longest: bool) -> Iterator[tuple[int, int, int, int]]:
        u, v, k, m = x[a : b + 1], y[c : d + 1], kx - a, ky - c
        # Where nothing near the minimum can be alike, longer alike passages have other minima, from which they are found.
        far = 2 * least
        e0, g0 = max(0, k - far), max(0, m - far)
        p, q = u[e0 : k + far + 1], v[g0 : m + far + 1]
        if min(len(p), len(q)) >= least and not _may_hold(p, q, k - e0, m - g0, least, jaccard, n):
            return
        shares = [jaccard, 2 * jaccard / (1 + jaccard)]
        for i, j in ((1, 1), (0, 0)) if longest else ():
            e, f = _grow(_flags(n, v)[u], k, shares[i])
            g, h = _grow(_flags(n, u[e : f + 1])[v], m, shares[j])
            e, f = _grow(_flags(n, v[g : h + 1])[u], k, shares[i])
            yield a + e, a + f, c + g, c + h
        e, f, g, h = 0, len(u) - 1, 0, len(v) - 1
        while longest:
            last = e, f, g, h
            e, f = _around(np.where(_flags(n, v[g : h + 1])[u], 1.0, -jaccard), k)
            g, h = _around(np.where(_flags(n, u[e : f + 1])[v], 1.0, -jaccard), m)
            if last == (e, f, g, h) or (a + e, a + f, c + g, c + h) in seen:
                break
            seen.add((a + e, a + f, c + g, c + h))
            yield a + e, a + f, c + g, c + h
        # All intervals as far as 2 * least from the minimum.
        if min(len(p), len(q)) >= least:
            local = np.unique(np.concatenate([p, q]), return_inverse=True)[1]
            p, q = local[: len(p)], local[len(p) :]
            for o in _search(p, q, k - e0, m - g0, least, jaccard):
                yield a + e0 + o[0], a + e0 + o[1], c + g0 + o[2], c + g0 + o[3]

    seen: set[tuple[int, int, int, int]] = set()
    tried: set[tuple[int, int, int, int]] = set()
    for sx, sy in spans:
        kx, ky = sx >> 32, sy >> 32
        if any(a <= kx <= b and c <= ky <= d for a, b, c, d in found) or kx >= len(x) or ky >= len(y):
            continue
        left = narrowed(kx, ky)
        if left is not None:
            seen.clear()
            # Long intervals in what is left are tried from one minimum in it.
            if not any(alike(*t) for t in tries(*left, kx, ky, longest and left not in tried)):
                tried.add(left)
    return found


def verify(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """(node, other, first, last): passages, first to last token, of node that are alike to some of other, found from windows (a, b, sa, sb) of two texts each.

    The shorter text of a pair travels with it; the longer one, as host, once for GUESTS of its pairs. Of a host the
    passages with several texts are joined, and other is the node itself.
    """
    longer = F.col("sa").bitwiseAND(0xFFFFFFFF) >= F.col("sb").bitwiseAND(0xFFFFFFFF)
    pick = lambda x, y, name: F.when(longer, F.col(x)).otherwise(F.col(y)).alias(name)
    sided = pairs.select(pick("a", "b", "host"), pick("b", "a", "guest"), F.struct(pick("sa", "sb", "h"), pick("sb", "sa", "g")).alias("w"))
    together = sided.groupBy("host", "guest").agg(F.collect_set("w").alias("spans"))
    sizes = together.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / GUESTS).alias("parts"))
    guests = together.join(sizes, "host").join(held.select(F.col("node").alias("guest"), "text"), "guest")
    guests = guests.select("host", F.pmod(F.xxhash64("guest"), F.col("parts")).alias("part"), F.lit(1).alias("kind"), "guest", "spans", "text")
    hosts = sizes.join(held.withColumnRenamed("node", "host"), "host").select("host", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("guest"), F.lit(None).cast(guests.schema["spans"].dataType).alias("spans"), "text")
    rows = hosts.unionByName(guests).repartition("host", "part").sortWithinPartitions("host", "part", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, x, named, own = None, np.empty(0, np.uint64), None, []
        out: list[tuple] = []

        def close() -> None:
            """The host's passages, those that overlap or touch as one."""
            last = None
            for a, b in sorted(own):
                if last and a <= last[1] + 1:
                    last[1] = max(last[1], b)
                else:
                    last = [a, b]
                    merged.append(last)
            out.extend((host, host, a, b) for a, b in merged)
            own.clear()
            merged.clear()

        merged: list[list[int]] = []
        for batch in batches:
            hosts, kind, guests, texts = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), utf8(batch.column(5))
            spans = batch.column(4)
            ends = np.cumsum(spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            both = list(zip(*(c.to_pylist() for c in spans.flatten().flatten()), strict=True))
            for lo, hi in _chunks(texts):
                tokens, owner = _tokens(texts[lo:hi])
                cut = np.searchsorted(owner, np.arange(hi - lo + 1))
                for i in range(lo, hi):
                    y = tokens[cut[i - lo] : cut[i - lo + 1]]
                    if kind[i] == 0:
                        close()
                        host, x = hosts[i], y.copy()
                        named = np.unique(x, return_inverse=True)
                        continue
                    found = verify_pair(x, y, sorted(both[ends[i - 1] if i else 0 : ends[i]]), named=named)
                    own.extend(p[:2] for p in found)
                    out.extend((guests[i], host, p[2], p[3]) for p in found)
                    if len(out) >= 4096:
                        yield _found_batch(out)
                        out.clear()
        close()
        if out:
            yield _found_batch(out)

    return rows.mapInArrow(run, "node long, other long, first long, last long")


def _found_batch(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["node", "other", "first", "last"])


def joined_parts(parts: DataFrame) -> DataFrame:
    """(node, parts) of (node, first, last): runs that overlap or touch are one; in order. A node's rows are sorted, not gathered; what is gathered are its separate runs."""
    by = Window.partitionBy("node").orderBy("first", "last")
    before = F.max("last").over(by.rowsBetween(Window.unboundedPreceding, -1))
    begun = parts.withColumn("new", F.when(before.isNull() | (F.col("first") > before + 1), 1).otherwise(0))
    runs = begun.withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0))).groupBy("node", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return runs.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("parts"))


def _sized(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, node, tokens) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(2))
            for a, b in _chunks(texts):
                n = word_counts(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.maximum(0, n - SHINGLE + 1), pa.int64())], ["doc_id", "node", "tokens"])

    return id_and_text(df, id_col, text_col).select("doc_id", node_of().alias("node"), "text").mapInArrow(run, "doc_id long, node long, tokens long")


def node_of():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def repeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, n_passages, repeated_words, passages) of each row.

    passages: `first:end` of each run of words that other rows hold too, end exclusive, joined by commas and
    in order; runs that overlap or touch are one. class_id: the smallest id among the rows that passages link.
    """
    small_batches(df.sparkSession)
    kept = Scratch(df.sparkSession)
    docs = kept(_sized(df, id_col, text_col))
    texts = id_and_text(df, id_col, text_col).select(node_of().alias("node"), "text")
    met = kept(meet(windows(texts)))
    wanted = met.select("node").distinct()
    held = kept(texts.join(wanted, "node", "left_semi").groupBy("node").agg(F.any_value("text").alias("text")))
    first = kept(verify(met.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"), F.col("hub_span").alias("sa"), F.col("span").alias("sb")), held))
    # A local hub's window is listed twice, but only where three nodes have its key. Windows in passages that link their texts have those texts' root as link; groups that aren't of one link are looked at whole.
    star = kept(components(first.select(F.col("node").alias("a"), F.col("other").alias("b")), scratch=kept, small=EDGES))
    state = star.join(joined_parts(first.select("node", "first", "last").distinct()), "node")
    inside = F.exists("parts", lambda p: (F.shiftright("span", 32) >= p["first"]) & (F.shiftright("span", 32) <= p["last"]))
    rows = kept(met.join(state, "node", "left").select("key", "node", "span", F.when(inside, F.col("root")).alias("link")))
    open_now = rows.groupBy("key").agg(F.max(F.col("link").isNull()).alias("open"), F.min("link").alias("least"), F.max("link").alias("most"), F.count(F.lit(1)).alias("n")).where("n > 2 and (open or least < most)").select("key")
    many = kept(rows.join(open_now, "key", "left_semi").distinct())
    second = kept(verify(kept(span_groups(many, held)), held))
    found = first.unionAll(second)
    # Copies of a text long enough are one passage, from end to end.
    nodes = docs.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("rows"), F.max("tokens").alias("tokens"))
    whole = nodes.where(f"rows > 1 and tokens >= {LEAST}").selectExpr("node", "0L as first", "tokens - 1 as last")
    parts = joined_parts(found.select("node", "first", "last").unionAll(whole).distinct())
    more = second.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b"))
    roots = components(star.selectExpr("node as a", "root as b").unionAll(more), scratch=kept, small=EDGES)
    # Written, so that the joins are of plain exchanges, which Spark can split where one root or text holds most rows.
    known = kept(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    names = kept(known.groupBy("root").agg(F.min("first_id").alias("class_id")))
    known = kept(known.join(names, "root").join(parts, "node", "left").select("node", "class_id", "parts"))
    kept.drop_but(docs, known)
    out = docs.select("doc_id", "node").join(known, "node")
    alone = F.col("parts").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, 0).otherwise(F.size("parts")).cast("long").alias("n_passages"),
        F.coalesce(F.expr(f"aggregate(parts, 0L, (s, x) -> s + x.last - x.first + {SHINGLE})"), F.lit(0).cast("long")).alias("repeated_words"),
        F.coalesce(F.expr(f"array_join(transform(parts, x -> concat(x.first, ':', x.last + {SHINGLE})), ',')"), F.lit("")).alias("passages"),
    )
