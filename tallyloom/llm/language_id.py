"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled text. A text is parsed into the longest phrases
that occur in the labelled text; the fewer phrases it takes, each worth log2 of the labelled length in bits,
the nearer the language. Each letter of the labelled texts is a symbol; a symbol that a language doesn't have
is a phrase of its own.

Thousands of stretches of BLOCK symbols are parsed in step, each as if a phrase began with it, and AHEAD symbols
on into the next one. Where a phrase begins at one place in both, the parse of the whole text goes on as the next
stretch's does; as phrases' parts are phrases too, that is soon. Where it isn't, the parse goes on symbol by symbol
until they meet. So the parse is that of the whole text.

Learned: of each language up to SAMPLE_TEXTS whole texts, chosen by a hash of the id among rows with a language
that aren't held out and have SAMPLE_CHARS characters at most, as long as they have so many together; if there are
only longer texts, a shortest one. That bounds the automata; everything else covers all rows and whole texts.
The model grows with the number of languages, of which none is left out.

Defined results: a null text, or one without letters, is `und` with score 0; so is every text if there is no
labelled one. Equal entropies: the language that sorts first. Score: 1 - bits of the best / bits of the next
best (1 if there is one language only). Ids are cast to long.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import arrow_map, id_and_text, in_holdout

SAMPLE_TEXTS = 64
SAMPLE_CHARS = 32_768
#: Symbols of a stretch, and those after it that are parsed as well.
BLOCK = 1024
AHEAD = 128
GAP, OTHER = 0, 1
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@lru_cache(2)
def classes(alphabet: str) -> np.ndarray:
    """The symbol of each code point: runs of other characters than letters are one gap, letters beyond the alphabet one symbol that no language has."""
    table = np.where(_letters(), OTHER, GAP).astype(np.uint16 if len(alphabet) < 65_000 else np.uint32)
    table[[ord(c) for c in alphabet]] = np.arange(2, len(alphabet) + 2)
    return table


def symbols(text: str, table: np.ndarray) -> np.ndarray:
    x = table[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    if len(x) > 1:
        keep = np.ones(len(x), bool)
        keep[1:] = (x[1:] != GAP) | (x[:-1] != GAP)
        x = x[keep]
    return x


def automaton(text: np.ndarray) -> list[dict[int, int]]:
    """Steps of the suffix automaton of text, for each state: symbol -> state. State 0 is the empty phrase."""
    goto: list[dict[int, int]] = [{}]
    length, link, last = [0], [-1], 0
    for c in text.tolist():
        new = len(goto)
        goto.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in goto[p]:
            goto[p][c] = new
            p = link[p]
        if p >= 0:
            q = goto[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(goto)
                goto.append(dict(goto[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and goto[p].get(c) == q:
                    goto[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return goto


class Steps:
    """The steps of all automata in one table by hash, at most a quarter full: (state, symbol) -> state."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys = np.full((1 << self.bits) + len(keys) + 1, _EMPTY)
        self.values = np.zeros(len(self.keys), np.int32)
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):  # each free place takes the first that wants it; the others go on to the next
            free = self.keys[at[left]] == _EMPTY
            taken, first = np.unique(at[left[free]], return_index=True)
            won = left[free][first]
            self.keys[taken], self.values[taken] = keys[won], values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            at[left] += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The state after each step, -1 where there is none."""
        at = self._home(keys)
        held = self.keys.take(at)
        out = np.where(held == keys, self.values.take(at), -1)
        on = np.flatnonzero((held != keys) & (held != _EMPTY))
        while len(on):
            at[on] += 1
            held = self.keys[at[on]]
            hit = held == keys[on]
            out[on[hit]] = self.values[at[on[hit]]]
            on = on[~hit & (held != _EMPTY)]
        return out


class Model:
    def __init__(self, samples: dict[str, list[str]]):
        self.langs = sorted(samples)
        self.alphabet = "".join(sorted({c for lang in self.langs for text in samples[lang] for c in text.lower() if c.isalpha()}))
        self.width = len(self.alphabet) + 2
        table = classes(self.alphabet)
        # State 0 is that of no phrase: where a text begins, and after a symbol that a language doesn't have.
        keys, values, self.bits, at = [], [], [], 1
        self.begin = np.zeros((len(self.langs), self.width), np.int32)
        for k, lang in enumerate(self.langs):
            text = np.concatenate([np.append(symbols(t, table), GAP) for t in samples[lang]])
            goto = automaton(text)
            for c, t in goto[0].items():
                self.begin[k, c] = at + t
            keys.append(np.array([(at + s) * self.width + c for s, steps in enumerate(goto) for c in steps], np.uint64))
            values.append(np.array([at + t for steps in goto for t in steps.values()], np.int32))
            self.bits.append(float(np.log2(len(text) + 1)))
            at += len(goto)
        self.steps = Steps(np.concatenate(keys), np.concatenate(values)) if keys else None

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """[language, text]: phrases each text takes."""
        langs, out = len(self.langs), np.zeros((len(self.langs), len(texts)), np.int64)
        parts = np.array([-(-len(t) // BLOCK) for t in texts], np.int64)
        first = np.append(0, np.cumsum(parts))
        lanes = int(first[-1])
        if not lanes or not langs:
            return out
        owner = np.repeat(np.arange(len(texts)), parts)
        offset = (np.arange(lanes) - first[owner]) * BLOCK
        long = np.array([len(t) for t in texts])[owner]
        size = np.minimum(long - offset, BLOCK + AHEAD)
        flat = np.concatenate([*texts, np.zeros(BLOCK + AHEAD, texts[0].dtype)])
        begin = np.append(0, np.cumsum([len(t) for t in texts]))[owner] + offset
        order = np.argsort(-size, kind="stable")
        start, sizes = begin[order], size[order]
        live = np.searchsorted(-sizes, -np.arange(BLOCK + AHEAD), "left")  # stretches longer than t
        state = np.zeros((langs, lanes), np.int32)
        begins = np.zeros((BLOCK + AHEAD, langs, lanes), bool)
        row = np.arange(langs)[:, None]
        for t in range(int(sizes[0])):
            n = live[t]
            symbol = flat[start[:n] + t]
            keys = state[:, :n].astype(np.uint64) * np.uint64(self.width) + symbol
            step = self.steps.get(keys.ravel()).reshape(langs, n)
            new = step < 0
            begins[t, :, :n] = new
            state[:, :n] = np.where(new, self.begin[row, symbol], step)
        back = np.argsort(order)
        begins, state = begins[:, :, back], state[:, back]
        count = np.cumsum(begins, axis=0, dtype=np.int16)  # phrases that begin up to a place

        def told(k: int, lane: int, a: int, b: int) -> int:
            """Phrases of a stretch that begin at a or later, before b."""
            return int(count[b - 1, k, lane] - (count[a - 1, k, lane] if a else 0)) if b > a else 0

        # Where the parse of a stretch meets that of the next one, -1 if it doesn't in AHEAD symbols.
        meets = np.full((langs, lanes), -1)
        follows = np.flatnonzero(owner[1:] == owner[:-1])
        if len(follows):
            both = begins[BLOCK:, :, follows] & begins[:AHEAD, :, follows + 1]
            meets[:, follows] = np.where(both.any(0), both.argmax(0), -1)
        last = np.append(owner[1:] != owner[:-1], True)
        whole = count[size - 1, :, np.arange(lanes)].T.astype(np.int64)  # to the end of what is parsed
        end = np.where(last[None, :], whole, count[(BLOCK + np.maximum(meets, 0) - 1), row, np.arange(lanes)[None, :]])
        head = np.zeros((langs, lanes), np.int64)
        after = follows + 1
        entry = meets[:, follows]
        head[:, after] = np.where(entry > 0, count[np.maximum(entry - 1, 0), row, after[None, :]], 0)
        for k in range(langs):
            out[k] = np.bincount(owner, end[k] - head[k], len(texts)).astype(np.int64)
            for i in np.unique(owner[~last & (meets[k] < 0)]).tolist():
                out[k, i] = self._walk(k, texts[i], int(first[i]), meets[k], begins[:, k], state[k], told)
        return out

    def _walk(self, k: int, text: np.ndarray, first: int, meets: np.ndarray, begins: np.ndarray, state: np.ndarray, told) -> int:
        """Phrases of a text of which some stretches don't meet soon."""
        lane, at, total = 0, 0, 0  # from `at` on the parse is that of this stretch
        final = (len(text) - 1) // BLOCK
        while lane < final:
            to = int(meets[first + lane])
            if to >= 0:
                total += told(k, first + lane, at, BLOCK + to)
                lane, at = lane + 1, to
                continue
            place = min(len(text), (lane + 1) * BLOCK + AHEAD)
            total += told(k, first + lane, at, place - lane * BLOCK)
            now = int(state[first + lane])
            steps = self._known()
            for place in range(place, len(text)):
                symbol = int(text[place])
                step = steps.get(now * self.width + symbol)
                if step is None:
                    if begins[place % BLOCK, first + place // BLOCK]:
                        lane, at = place // BLOCK, place % BLOCK
                        break
                    total += 1
                    step = int(self.begin[k, symbol])
                now = step
            else:
                return total
        return total + told(k, first + lane, at, len(text) - lane * BLOCK)

    def _known(self) -> dict[int, int]:
        if not hasattr(self, "_dict"):
            full = np.flatnonzero(self.steps.keys != _EMPTY)
            self._dict = dict(zip(self.steps.keys[full].tolist(), self.steps.values[full].tolist(), strict=True))
        return self._dict

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        table = classes(self.alphabet)
        cut = [symbols(t or "", table) for t in texts]
        has = np.array([bool((x != GAP).any()) for x in cut])
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        count, a = np.zeros((len(self.langs), len(cut)), np.int64), 0
        while a < len(cut):  # some thousand stretches at a time; a longer text is one go
            b, size = a + 1, len(cut[a])
            while b < len(cut) and size + len(cut[b]) <= 2048 * BLOCK:
                size, b = size + len(cut[b]), b + 1
            count[:, a:b], a = self.phrases(cut[a:b]), b
        bits = count * np.array(self.bits)[:, None] / np.maximum(1, [len(x) for x in cut])[None, :]
        best = bits.argmin(0)
        ranked = np.sort(bits, 0)
        score = 1 - ranked[0] / np.maximum(ranked[1], 1e-12) if len(self.langs) > 1 else np.ones(len(texts))
        return [self.langs[b] if h else "und" for b, h in zip(best, has, strict=True)], np.where(has, np.clip(score, 0, 1), 0.0).tolist()


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from rows that have a language and a text and aren't held out."""
    # A null id counts as held out, so sampled rows have ids.
    rows = df.where(~in_holdout(F.col(id_col))).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and doc_id is not null and text is not null")
    rank, size = F.xxhash64("doc_id"), F.char_length("text")
    longer = F.when(size > SAMPLE_CHARS, size).otherwise(0)
    # By language and by a further hash, so that partial sums bound what is shuffled and no language meets in one task.
    picked = rows.where(r"text rlike r'\p{L}'").groupBy("lang", F.pmod(rank, F.lit(SAMPLE_TEXTS)).alias("slot")).agg(F.min(F.struct(longer.alias("longer"), rank.alias("r"), F.col("doc_id"))).alias("least"))
    chosen: dict[str, list[int]] = {}
    for r in sorted(picked.collect(), key=lambda r: (r.lang, r.least)):
        if not r.least.longer or r.lang not in chosen:
            chosen.setdefault(r.lang, []).append(r.least.doc_id)
    samples: dict[str, list[str]] = {}
    if chosen:
        wanted = df.sparkSession.createDataFrame([(lang, i) for lang, ids in chosen.items() for i in ids], "lang string, doc_id long")  # SAMPLE_TEXTS a language
        found = rows.join(F.broadcast(wanted), ["lang", "doc_id"], "left_semi").distinct().withColumn("r", F.xxhash64("doc_id")).collect()
        for r in sorted(found, key=lambda r: (r.lang, len(r.text) > SAMPLE_CHARS, r.r, r.doc_id, r.text)):
            have = samples.setdefault(r.lang, [])
            if not have or sum(map(len, have)) + len(r.text) <= SAMPLE_CHARS:
                have.append(r.text)
    return Model(samples)


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each whole text, from the text alone."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # bounded by SAMPLE_CHARS a language

    def make():
        own = sent.value

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            lang, score = own.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

        return step

    out = arrow_map(id_and_text(df, id_col, text_col), make, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", in_holdout(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
