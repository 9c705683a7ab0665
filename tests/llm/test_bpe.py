import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tallyloom.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    ranks = byte_bpe.load_ranks(PATH)
    own = byte_bpe.Codec(byte_bpe.model_json(ranks), public_tokenizers.PATTERN)
    return own, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(5)
    fixed = [None, "", " ", "  a  b\n\n c ", "don't I'll", "<|endoftext|>", "x\u00a0y\u2003z\x1c\x85", "日本語のテキスト", "👩‍👩‍👧 ok", "é\u0301" * 9, "½²٣ five", "a" * 5000, "\ufeff\u200b"]
    return fixed + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x250), rng.randrange(0xD000), rng.randrange(0x1F300, 0x1F700)])) for _ in range(rng.randrange(200))) for _ in range(400)]


def test_ids_are_tiktokens_and_come_back(both):
    own, ref = both
    for t in texts():
        ids = np.frombuffer(own.encode(t), "<u4").tolist()
        assert ids == ref.encode_ordinary(t or "")
        assert own.decode(ids) == (t or "").encode()
        assert "".join(own.decode_pieces(ids)) == (t or "")


def test_offsets_and_split_characters(both):
    own, _ = both
    text = "na\u00efve 👩 x"
    ids = np.frombuffer(own.encode(text), "<u4").tolist()
    spans = own.offsets(text)
    assert len(spans) == len(ids)
    for i, (a, b) in zip(ids, spans, strict=True):
        piece = own.bytes_of[i]
        assert piece in text[a:b].encode()
    assert {i for a, b in spans for i in range(a, b)} == set(range(len(text)))
    assert "".join(own.decode_pieces(ids[:-1] + [10**6])) in text
    half = own.encode("👩")[:4]
    assert "".join(own.decode_pieces(np.frombuffer(half, "<u4").tolist())) == "\ufffd"


def test_emptied_table_changes_nothing(both, monkeypatch):
    own, ref = both
    monkeypatch.setattr(byte_bpe, "KEEP", 3)
    text = " ".join(f"word{i}" for i in range(50))
    assert np.frombuffer(own.encode(text), "<u4").tolist() == ref.encode_ordinary(text)


def test_operators(spark, both):
    own, ref = both
    rows = [(i, t, "x") for i, t in enumerate(texts()[:40])] + [(3, "again", "y"), (None, "no id", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(byte_bpe.round_trip(df, PATH, public_tokenizers.PATTERN).collect(), key=str)
    want = []
    for i, t, _ in rows:
        ids = np.array(ref.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == sorted(w for w in want if w[0] is not None) and len(got) == len(want)
    coded = byte_bpe.encode_texts(df, PATH, public_tokenizers.PATTERN, offsets=True)
    assert all(len(r.ids) == len(r.starts) == len(r.ends) for r in coded.collect())
    back = byte_bpe.decode_ids(coded, PATH, public_tokenizers.PATTERN)
    assert sorted(bytes(r.data) for r in back.collect()) == sorted((t or "").encode() for _, t, _ in rows)
    assert byte_bpe.round_trip(df.where("false"), PATH, public_tokenizers.PATTERN).count() == 0
