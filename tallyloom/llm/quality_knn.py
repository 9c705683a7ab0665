"""Quality by the votes of nearest neighbours in a latent-semantic space.

Terms are words (by a hash, in WORDS terms), pairs of neighbouring byte classes (letters by case and sound,
digits, each mark of its own) and words that repeat one of the two before them. Their weighted counts in a sample
of labelled texts are factored, words and signs having the same weight together; the labelled vectors are broadcast, and each text is compared with all of them, block by block,
by exact cosines. The NEIGHBOURS nearest vote for their label by their similarity; those as near as the
last of them vote too, so ties need no order.

Learned: at most SAMPLE rows a label, chosen by a hash of the id among labelled rows that aren't held out.

Defined results: a null, empty or otherwise term-less text gets the share of label 1 among labelled rows;
so does every text if one of the labels has no row. Rows that label a document twice count by their mean
(half: label 1). Null labels and ids are left out of learning. Ids are cast to long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import arrow_map, id_and_text, in_holdout, small_batches, utf8
from tallyloom.llm.vectors import word_hashes

SAMPLE = 1500
DIMENSIONS = 48
NEIGHBOURS = 15
THRESHOLD = 0.3
#: Texts compared at a time with all labelled vectors.
ROWS = 512
#: Terms of words.
WORDS = 1024
#: Weight of the terms for repeated words, of which there are few kinds.
REPEAT = 3.0


def _byte_classes() -> tuple[np.ndarray, int]:
    """Upper and lower vowels and consonants, digits, blank, line end, other control, bytes of other letters; each mark apart."""
    table, n = np.zeros(256, np.int64), 9
    for b in range(256):
        c = chr(b)
        if b >= 128:
            table[b] = 8
        elif c.isalpha():
            table[b] = 2 * c.isupper() + (c.lower() in "aeiou")
        elif c.isdigit():
            table[b] = 4
        elif c == " ":
            table[b] = 5
        elif c == "\n":
            table[b] = 6
        elif b < 32 or b == 127:
            table[b] = 7
        else:
            table[b], n = n, n + 1
    return table, n


CLASS, CLASSES = _byte_classes()
SIGNS = CLASSES * CLASSES
TERMS = SIGNS + WORDS + 3


def counts(texts: list[bytes | None]) -> np.ndarray:
    """[text, term]: root of each term's share of the text."""
    out = np.zeros((len(texts), TERMS))
    for i, t in enumerate(texts):
        if t and len(t) > 1:
            x = CLASS[np.frombuffer(t, np.uint8)]
            out[i, :SIGNS] = np.bincount(x[:-1] * CLASSES + x[1:], minlength=SIGNS) / (len(t) - 1)
    h, owner, _, _ = word_hashes(texts)
    total = np.bincount(owner, minlength=len(texts))
    out[:, SIGNS:-3] = np.bincount(owner * WORDS + (h % np.uint64(WORDS)).astype(np.int64), minlength=len(texts) * WORDS).reshape(-1, WORDS) / np.maximum(1, total)[:, None]
    for gap in (1, 2):
        again = (h[gap:] == h[:-gap]) & (owner[gap:] == owner[:-gap])
        out[:, TERMS - 4 + gap] = np.bincount(owner[gap:][again], minlength=len(texts)) / np.maximum(1, total)
    out[:, TERMS - 1] = (total > 0) * 0.01
    return np.sqrt(out, out=out)


class Model:
    def __init__(self, terms: np.ndarray, labels: np.ndarray, prior: float):
        self.prior = float(prior)
        self.labels = labels.astype(np.float64)
        present = np.count_nonzero(terms, axis=0)
        weight = np.log((1 + len(terms)) / (1 + present)) + 0.25
        weight[-3:] = REPEAT
        self.used = np.flatnonzero(present)  # terms that no labelled text has lie outside the space
        self.weight = weight[self.used]
        x = np.empty((len(terms), len(self.used)))
        for a in range(0, len(terms), ROWS):  # so that of the whole matrix, some 60 MB, there is no second copy
            x[a : a + ROWS] = self._unit(terms[a : a + ROWS, self.used] * self.weight)
        # The widest axes by subspace iteration from a fixed start.
        k = min(DIMENSIONS, len(self.used), len(x))
        axes = np.linalg.qr(np.random.default_rng(0).normal(size=(len(self.used), min(2 * k, len(self.used), len(x)))))[0]
        for _ in range(12):
            axes = np.linalg.qr(x.T @ (x @ axes))[0]
        values, turned = np.linalg.eigh((x @ axes).T @ (x @ axes))
        vectors, keep = axes @ turned, np.argsort(values)[::-1][:k]
        self.axes = vectors[:, keep] * np.where(np.abs(vectors[:, keep]).max(0) == vectors[:, keep].max(0), 1.0, -1.0)
        self.vectors = self._unit(x @ self.axes)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        for a in range(0, len(texts), ROWS):
            self._vote(texts[a : a + ROWS], out[a : a + ROWS])
        return out

    def _vote(self, texts: list[bytes | None], out: np.ndarray) -> None:
        """Puts the scores of a block into out. Its matrices, some of them 12 MB, are changed in place and gone before the next block's."""
        terms = counts(texts)[:, self.used]
        some = terms.any(1)
        terms *= self.weight
        terms /= np.maximum(np.sqrt(np.einsum("ij,ij->i", terms, terms)), 1e-12)[:, None]
        x = self._unit(terms @ self.axes)
        del terms
        near = x @ self.vectors.T
        np.round(near, 9, out=near)  # so that equal texts are equally near wherever they are in a block
        k = min(NEIGHBOURS, near.shape[1])
        least = np.concatenate([np.partition(part, near.shape[1] - k, axis=1)[:, near.shape[1] - k] for part in np.array_split(near, 8)])
        near[near < least[:, None]] = 0
        np.maximum(near, 0, out=near)
        total = near.sum(1)
        voted = (total > 0) & some
        out[voted] = np.clip((near @ self.labels)[voted] / total[voted], 0, 1)


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | float:
    """Learns from labelled rows that aren't held out; where a label has no row, only the share of label 1."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).where("doc_id is not null and y is not null")
    known = known.where(~in_holdout(F.col("doc_id"))).groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    known.persist()  # ids and marks alone; read three times, so that each id's marks are brought together once
    try:
        total, ones = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
        picked = {r.doc_id: r.y for y in (0, 1) for r in known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).collect()}
    finally:
        known.unpersist()
    prior = ones / total if total else 0.5
    if not picked:
        return prior

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                terms = [x.astype(np.float32) for x in counts(utf8(part.column(1)))]
                places = [np.flatnonzero(x).astype(np.uint16) for x in terms]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([at.tobytes() for at in places], pa.binary()), pa.array([x[at].tobytes() for x, at in zip(terms, places)], pa.binary())], ["doc_id", "places", "shares"])

        return step

    # Only the terms that a text has reach the driver: a text lacks most, and all of 2 * SAMPLE texts were 32 MB, held several times by the JVM and Python.
    rows = arrow_map(id_and_text(df, id_col, text_col).where(F.col("doc_id").isin(sorted(picked))), make, "doc_id long, places binary, shares binary").collect()
    seen = sorted({(r.doc_id, bytes(r.places), bytes(r.shares)) for r in rows})  # repeated ids with other texts: each counts
    del rows
    y = np.array([picked[i] for i, _, _ in seen])
    if not len(y) or y.min() == y.max():
        return prior
    terms = np.zeros((len(seen), TERMS), np.float32)
    for own, (_, places, shares) in zip(terms, seen):
        own[np.frombuffer(places, np.uint16)] = np.frombuffer(shares, np.float32)
    return Model(terms, y, prior)


def score(df: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each whole text."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # 2 * SAMPLE vectors and the axes: some MB

    def make():
        own = sent.value

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts = utf8(batch.column(1))
            s = np.full(len(texts), own) if isinstance(own, float) else own.score(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

        return step

    out = arrow_map(id_and_text(df, id_col, text_col), make, "doc_id long, score double")
    return out.select("doc_id", in_holdout(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(df: DataFrame, model: Model | float, text_col: str = "text") -> DataFrame:
    """The rows of df whose text is predicted to be of label 1, whole and in their columns."""
    small_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def make():
        own = sent.value

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts = utf8(batch.column(at))
            s = np.full(len(texts), own) if isinstance(own, float) else own.score(texts)
            yield batch.filter(pa.array(s >= THRESHOLD))

        return step

    return arrow_map(df, make, df.schema)
