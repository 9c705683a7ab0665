"""Byte-level BPE with the tokenizers library.

A rank file (token bytes, rank) is turned into a vocabulary over mapped characters and a list of merges:
the merge of a token is the pair left when its own bytes are merged by lower ranks only. Text is cut by the
pattern of the vocabulary, each match is merged apart; matches are looked up in a bounded table of those
already merged in the task, as most of a corpus repeats them.

Defined results: a null text has no tokens and decodes to nothing; ids outside the vocabulary decode to
nothing; characters that tokens split are put together again by decode_pieces(), and what stays incomplete
becomes U+FFFD, as in any lenient UTF-8 decoder. Long texts are cut match by match, never shortened.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from tallyloom.llm.common import arrow_map, id_and_text, small_batches

#: Matches kept in a task's table before it is emptied: some 100 MB at most with words of usual length.
KEEP = 400_000
#: Longer matches aren't kept.
KEEP_CHARS = 64

# What the classes of the pattern hold among the first 256 code points.
LATIN_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
LATIN_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN_SPACE = "\t-\r \x85\xa0"


def byte_chars() -> dict[int, str]:
    """A printable character for each byte: itself where it is visible, else one from U+0100 on."""
    table, spare = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 255 and b != 173:
            table[b] = chr(b)
        else:
            table[b] = chr(spare)
            spare += 1
    return table


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that make up token last; None if its bytes can't be merged to two."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        least, at = ranks[token], -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1], least)
            if r < least:
                least, at = r, i
        if at < 0:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


def model_json(ranks: dict[bytes, int]) -> str:
    """A tokenizers file with the vocabulary and merges of a rank table; a match that is a token itself is taken whole."""
    chars = byte_chars()
    mapped = {token: "".join(chars[b] for b in token) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.__getitem__):
        pair = merge_of(token, ranks)
        if pair:
            merges.append((mapped[pair[0]], mapped[pair[1]]))
    return Tokenizer(models.BPE(vocab={mapped[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True)).to_str()


def latin_pattern(pattern: str) -> str | None:
    """The pattern for texts of the first 256 code points, in the classes Python's re knows; None if it holds more than those."""
    out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{LATIN_SPACE}{LATIN_LETTER}{LATIN_NUMBER}]").replace(r"\p{L}", f"[{LATIN_LETTER}]").replace(r"\p{N}", f"[{LATIN_NUMBER}]").replace(r"\s", f"[{LATIN_SPACE}]").replace(r"\S", f"[^{LATIN_SPACE}]")
    return None if r"\p" in out else out


class Codec:
    """Encodes and decodes with one vocabulary; made once a task."""

    def __init__(self, model: str, pattern: str):
        self.merge = Tokenizer.from_str(model).model.tokenize
        self.mapping = str.maketrans({chr(b): c for b, c in byte_chars().items()})
        self.any = regex.compile(pattern)
        latin = latin_pattern(pattern)
        self.latin = re.compile(latin) if latin else self.any
        back = {c: b for b, c in byte_chars().items()}
        vocab = Tokenizer.from_str(model).get_vocab()
        self.bytes_of = [b""] * (max(vocab.values(), default=-1) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        self.known: dict[str, bytes] = {}

    def pieces(self, text: str):
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.any
        return self.latin

    def match(self, word: str) -> bytes:
        """The ids of one match, as little-endian unsigned 32-bit integers."""
        ids = self.known.get(word)
        if ids is None:
            tokens = self.merge(word.encode().decode("latin-1").translate(self.mapping))
            ids = struct.pack(f"<{len(tokens)}I", *(t.id for t in tokens))
            if len(word) <= KEEP_CHARS:
                if len(self.known) >= KEEP:
                    self.known.clear()
                self.known[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        known, match = self.known, self.match
        return b"".join([known.get(w) or match(w) for w in self.pieces(text).findall(text)]) if text else b""

    def offsets(self, text: str | None) -> list[tuple[int, int]]:
        """Start and end in characters of each token; tokens inside one character get the whole character."""
        out: list[tuple[int, int]] = []
        for m in self.pieces(text).finditer(text) if text else ():
            starts = [i for i, c in enumerate(m[0]) for _ in range(len(c.encode()))]
            at = 0
            for i in np.frombuffer(self.match(m[0]), "<u4").tolist():
                n = len(self.bytes_of[i])
                out.append((m.start() + starts[at], m.start() + starts[at + n - 1] + 1))
                at += n
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        of, n = self.bytes_of, len(self.bytes_of)
        return b"".join([of[i] if 0 <= i < n else b"" for i in ids])

    def decode_pieces(self, ids: Iterable[int]) -> Iterator[str]:
        """The text of each token in turn; a split character comes with the token that ends it."""
        whole = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            yield whole.decode(self.decode([i]))
        yield whole.decode(b"", final=True)


def _codec(df: DataFrame, ranks_path: str, pattern: str):
    """Gives tasks the vocabulary, of a fixed size of some MB, by a broadcast."""
    sent = df.sparkSession.sparkContext.broadcast(model_json(load_ranks(ranks_path)))
    return lambda: Codec(sent.value, pattern)


def encode_texts(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """(doc_id, ids, and with offsets the start and end characters of each token)."""
    codec = _codec(df, ranks_path, pattern)

    def make():
        own = codec()

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts = batch.column(1).to_pylist()
            columns = [batch.column(0), pa.array([np.frombuffer(own.encode(t), "<u4").astype(np.int32) for t in texts], pa.list_(pa.int32()))]
            if offsets:
                spans = [own.offsets(t) for t in texts]
                columns += [pa.array([[s[k] for s in x] for x in spans], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "starts", "ends"][: len(columns)])

        return step

    return arrow_map(id_and_text(df, id_col, text_col), make, "doc_id long, ids array<int>" + ", starts array<int>, ends array<int>" * offsets)


def decode_ids(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, n_tokens, data): the bytes that each list of ids stands for; a null list stands for none."""
    codec = _codec(df, ranks_path, pattern)
    small_batches(df.sparkSession)

    def make():
        own = codec()

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            ids = [x or [] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, ids), pa.int64()), pa.array([own.decode(x) for x in ids], pa.binary())], ["doc_id", "n_tokens", "data"])

        return step

    return arrow_map(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")), make, "doc_id long, n_tokens long, data binary")


def round_trip(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each whole text: encoded, then decoded from the ids, in one pass."""
    codec = _codec(df, ranks_path, pattern)

    def make():
        own = codec()

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            rows = []
            for text in batch.column(1).to_pylist():
                ids = own.encode(text)
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(np.frombuffer(ids, "<u4").tolist())).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return step

    return arrow_map(id_and_text(df, id_col, text_col), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
