"""Benchmark decontamination: BM25 with block-max WAND, then shingle overlap.

The test items are few, the corpus is not, so the items are indexed and every training passage is a query.
A passage is three neighbouring chunks of a text, each as long as the longest question of all: a question's
span lies in one passage whole, and so does any copy drawn out to twice that length. The index holds postings by term with the largest impact of each term in each block of
items. A passage is first weighed against all blocks at once: the sum of its terms' block maxima bounds
every score in the block. Where a block may pass, WAND with block maxima finds all items above threshold.

The threshold of an item is what it scores at least if a passage holds OVERLAP of its shingles: no more
terms than shingles can be missing, so the item's own score less its largest impacts, as many as shingles
may be missing. So no item that verification would accept is lost.

An item is verified by the share of the distinct five-word shingles of its question that the passage holds,
and of its answer, if there is one, that the whole text holds, as answers may stand apart. A question or answer
of fewer words is one shingle of its own length: its words have to follow each other somewhere. Words are runs of
characters other than ASCII punctuation and white space, lower-cased.

Many items are cut into slices, each an index of its own; frequencies of terms, mean length and passages are
those of all items, so that results don't depend on the slices.

Defined results: null texts and items, and questions without words, match nothing; an answer without words
isn't tested. Repeated items are reported each, repeated documents each; a null id stays null. Ids are cast to long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import arrow_map, id_and_text, small_batches
from tallyloom.llm.vectors import shingles, word_hashes

SHINGLE = 5
OVERLAP = 0.8
K1, B = 1.2, 0.75
#: Items of a block; blocks are larger where there would be more than BLOCKS. A term's maxima in all blocks are one row of a dense table.
ITEMS = 4
BLOCKS = 64
#: Least number of words of a chunk.
CHUNK = 64
#: Largest size of the items that one pass takes; more are cut into slices, each with its own pass.
SLICE_BYTES = 16 << 20
#: Words weighed at a time.
WORDS = 200_000


def _words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes([None if t is None else t.lower().encode("utf-8", "surrogatepass") for t in texts])[:2]


class Statistics:
    """What all slices have in common: frequencies of terms, mean length, longest question."""

    def __init__(self, questions: list[str | None]):
        hashes, owner = _words(questions)
        lengths = np.bincount(owner, minlength=len(questions))
        pairs = np.unique(np.stack([hashes, owner.astype(np.uint64)]), axis=1) if len(hashes) else np.empty((2, 0), np.uint64)
        self.terms, self.frequency = np.unique(pairs[0], return_counts=True)
        self.items, self.words, self.longest = len(questions), int(lengths.sum()), int(lengths.max(initial=0))

    def __add__(self, other: Statistics) -> Statistics:
        out = Statistics([])
        out.terms, at = np.unique(np.concatenate([self.terms, other.terms]), return_inverse=True)
        out.frequency = np.bincount(at, np.concatenate([self.frequency, other.frequency]), len(out.terms)).astype(np.int64)
        out.items, out.words, out.longest = self.items + other.items, self.words + other.words, max(self.longest, other.longest)
        return out

    def idf(self, terms: np.ndarray) -> np.ndarray:
        n = self.frequency[np.searchsorted(self.terms, terms)]
        return np.log1p((self.items - n + 0.5) / (n + 0.5))


def _parts(words: np.ndarray) -> tuple[int, np.ndarray]:
    """(size of a shingle, distinct shingles) of a question or an answer."""
    size = min(SHINGLE, max(1, len(words)))
    return size, np.unique(shingles(words, np.zeros(len(words), np.int64), size)[0])


class Index:
    def __init__(self, ids: list, questions: list[str | None], answers: list[str | None], whole: Statistics | None = None):
        self.ids, n = ids, len(ids)
        whole = whole or Statistics(questions)
        (asked, of), (told, by) = _words(questions), _words(answers)
        words = [asked[of == i] for i in range(n)]
        self.sets = [(_parts(w), _parts(told[by == i])) for i, w in enumerate(words)]
        length = np.array([len(w) for w in words], np.float64)
        self.chunk = max(CHUNK, whole.longest)
        self.terms = np.unique(np.concatenate(words)) if n else np.empty(0, np.uint64)
        at = [np.unique(np.searchsorted(self.terms, w), return_counts=True) for w in words]
        idf = whole.idf(self.terms)
        mean = max(1.0, whole.words / max(1, whole.items))
        self.size = max(ITEMS, -(-n // BLOCKS))
        self.most = np.zeros((len(self.terms) + 1, -(-n // self.size) if n else 0), np.float32)
        self.least = np.full(n, np.inf)
        rows: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        for i, (t, tf) in enumerate(at):
            impact = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[i] / mean))
            for term, x in zip(t.tolist(), impact.tolist(), strict=True):
                rows[term].append((i, x))
            np.maximum.at(self.most, (t, i // self.size), (impact * (1 + 1e-6)).astype(np.float32))
            missing = int((1 - OVERLAP) * len(self.sets[i][0][1]) + 1e-9)
            if len(t):
                self.least[i] = np.sort(impact)[: len(impact) - missing].sum() * (1 - 1e-6)
        self.postings = [(np.array([i for i, _ in r], np.int64), np.array([x for _, x in r])) for r in rows]
        self.block_least = np.array([self.least[b : b + self.size].min() for b in range(0, n, self.size)])
        # Maxima rounded up to steps so small that a passage's sum fits an integer of two bytes; four if the steps would be coarse.
        largest = np.sort(self.most.max(1, initial=0))[::-1][: 3 * self.chunk].sum() if n else 1.0
        steps = 65_000 / max(1e-9, float(largest)) - 1
        kind, self.steps = (np.uint16, steps) if steps >= 16 else (np.uint32, 1024.0)
        self.rounded = np.ceil(self.most * self.steps).astype(kind)
        self.rounded_least = np.where(np.isfinite(self.block_least), np.floor(self.block_least * self.steps), np.inf)

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """The term of each word, or the number of terms for words that no item has."""
        if not len(self.terms):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, len(self.terms))

    def retrieve(self, terms: np.ndarray, block: int) -> list[tuple[int, float]]:
        """All (item, score) of a block that score at least their threshold for a passage of these distinct terms: WAND over the block's stretch of each posting list."""
        goal, begin, end = float(self.block_least[block]), block * self.size, (block + 1) * self.size
        lists = []
        for t in terms[self.most[terms, block] > 0].tolist():
            items, impacts = self.postings[t]
            lo, hi = np.searchsorted(items, (begin, end))
            lists.append((items[lo:hi].tolist(), impacts[lo:hi].tolist(), float(self.most[t, block])))
        at = [0] * len(lists)
        out: list[tuple[int, float]] = []
        live = list(range(len(lists)))
        while live:
            live.sort(key=lambda k: lists[k][0][at[k]])
            bound, pivot = 0.0, -1
            for k in live:
                bound += lists[k][2]
                if bound >= goal:
                    pivot = lists[k][0][at[k]]
                    break
            if pivot < 0:
                break
            first = lists[live[0]][0][at[live[0]]]
            ahead = [k for k in live if lists[k][0][at[k]] <= pivot]
            if first == pivot:
                score = sum(lists[k][1][at[k]] for k in ahead)
                if score >= self.least[pivot]:
                    out.append((pivot, score))
            for k in ahead:
                while at[k] < len(lists[k][0]) and (lists[k][0][at[k]] < pivot or first == pivot == lists[k][0][at[k]]):
                    at[k] += 1
            live = [k for k in live if at[k] < len(lists[k][0])]
        return out

    def search(self, texts: list[str | None]) -> dict[tuple[int, int], tuple[float, float, float | None, int]]:
        """(text, item) -> best (share of the question, of the answer (-1: none), score, first word of the passage) of verified items."""
        found: dict[tuple[int, int], tuple[float, float, float, int]] = {}
        if not len(self.block_least):
            return found
        hashes, owner = _words(texts)
        if not len(hashes):
            return found
        term = self.lookup(hashes)
        first = np.searchsorted(owner, np.arange(len(texts)))
        place = np.arange(len(hashes)) - first[owner]
        starts = np.flatnonzero(place % self.chunk == 0)  # first words of chunks
        joined = [np.append(owner[starts[d:]] == owner[starts[:-d]], [False] * d)[: len(starts)] for d in (1, 2)]  # this chunk and the next but d are in one text
        known = term < len(self.terms)
        chunk = np.searchsorted(starts, np.flatnonzero(known), "right") - 1
        term = term[known]
        # The distinct terms of each passage, which is a chunk and the next two of its text.
        after = [(chunk >= d) & joined[d - 1][np.maximum(chunk - d, 0)] for d in (1, 2)]
        pairs = np.sort(np.concatenate([chunk, *(chunk[a] - d for d, a in enumerate(after, 1))]) * len(self.terms) + np.concatenate([term, *(term[a] for a in after)]))
        pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)]]
        passage, term = np.divmod(pairs, len(self.terms))
        cut = np.searchsorted(passage, np.arange(len(starts) + 1))
        filled = np.flatnonzero(np.diff(cut))
        weight = np.zeros((len(starts), self.rounded.shape[1]), self.rounded.dtype)
        a = 0
        while a < len(filled):
            b = max(a + 1, int(np.searchsorted(cut[filled], cut[filled[a]] + WORDS)))
            lo, hi = int(cut[filled[a]]), int(cut[filled[b - 1] + 1])
            weight[filled[a:b]] = np.add.reduceat(self.rounded[term[lo:hi]], cut[filled[a:b]] - lo, axis=0, dtype=self.rounded.dtype)
            a = b
        def share(part: tuple[int, np.ndarray], lo: int, hi: int) -> float:
            return float(np.isin(part[1], shingles(hashes[lo:hi], owner[lo:hi], part[0])[0]).mean()) if len(part[1]) else -1.0

        for c, block in np.argwhere(weight >= self.rounded_least[None, :]).tolist():
            lo, end = int(starts[c]), c + 1 + int(joined[0][c]) + int(joined[1][c])
            hi = int(starts[end]) if end < len(starts) else len(hashes)
            for item, score in self.retrieve(term[cut[c] : cut[c + 1]], block):
                question, answer = self.sets[item]
                asked = share(question, lo, hi)
                if asked >= OVERLAP:
                    text = int(owner[lo])
                    told = share(answer, int(first[text]), int(np.searchsorted(owner, text, "right")))
                    if told < 0 or told >= OVERLAP:
                        found[text, item] = max(found.get((text, item), (0.0,)), (asked, told, round(score, 6), int(place[lo])))
        return found


def indexes(benchmark: DataFrame, id_col: str = "item_id", question_col: str = "text", answer_col: str | None = None) -> list[Index]:
    """The items' indexes, each of SLICE_BYTES at most; a single item may be larger."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("item"), F.col(question_col).cast("string").alias("q"), (F.col(answer_col) if answer_col else F.lit(None)).cast("string").alias("a")).where("q is not null")
    size = F.octet_length("q") + F.coalesce(F.octet_length("a"), F.lit(0)) + 64
    total = rows.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()[0]
    slices = -(-total // SLICE_BYTES)
    taken, whole = [], Statistics([])
    for s in range(slices):
        got = sorted(rows.where(F.pmod(F.xxhash64("q", "item"), F.lit(slices)) == s).collect(), key=lambda r: (r.item is None, r.item, r.q, r.a or ""))
        if got:
            taken.append(([r.item for r in got], [r.q for r in got], [r.a for r in got]))
            whole += Statistics(taken[-1][1])
    return [Index(*t, whole) for t in taken]


def leaks(df: DataFrame, benchmark: list[Index], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, passage_word): the best passage of each verified item in each text."""
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, passage_word long"
    rows = id_and_text(df, id_col, text_col)
    out = df.sparkSession.createDataFrame([], schema)
    for index in benchmark:
        sent = df.sparkSession.sparkContext.broadcast(index)

        def make(sent=sent):
            own = sent.value

            def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
                found = own.search(batch.column(1).to_pylist())
                if found:
                    keys = sorted(found)
                    best = [found[k] for k in keys]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k[0] for k in keys])), pa.array([own.ids[k[1]] for k in keys], pa.int64()), pa.array([b[2] for b in best], pa.float64()), pa.array([b[0] for b in best], pa.float64()), pa.array([None if b[1] < 0 else b[1] for b in best], pa.float64()), pa.array([b[3] for b in best], pa.int64())], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "passage_word"])

            return step

        found = arrow_map(rows, make, schema)
        out = found if len(benchmark) == 1 else out.unionAll(found)
    return out


def keep_clean(df: DataFrame, benchmark: list[Index], text_col: str = "text") -> DataFrame:
    """The rows of df whose text holds no item; one pass for each slice of the items."""
    small_batches(df.sparkSession)
    at = df.columns.index(text_col)
    for index in benchmark:
        sent = df.sparkSession.sparkContext.broadcast(index)

        def make(sent=sent):
            own = sent.value

            def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
                dirty = {k[0] for k in own.search(batch.column(at).to_pylist())}
                yield batch.filter(pa.array([i not in dirty for i in range(batch.num_rows)])) if dirty else batch

            return step

        df = arrow_map(df, make, df.schema)
    return df
