import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from tallyloom.llm import byte_bpe, decontaminate, quality_knn, queries, simhash_dedup
from tests.llm.test_decontaminate import slow_leaks
from tests.llm.test_secrets import slow_base
from tests.llm.test_simhash import slow_components, slow_print

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        out.append((name, before, docs))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_stay(stages):
    for _, before, after in stages[:-1]:
        assert [f.name for f in after.schema] == [f.name for f in before.schema] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality(stages, spark):
    _, before, after = stages[0]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = set(texts(after))
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0 and i in texts(before)]
    assert np.mean([(i in kept) == bool(labels[i]) for i in held]) > 0.8  # some fifteen bad texts to learn from
    scores = {r.doc_id: r.predicted for r in queries.op5_quality(spark, SF).collect()}
    assert kept == {i for i, p in scores.items() if p}


def test_near_duplicates(stages):
    _, before, after = stages[1]
    rows = [(i, slow_print(t)) for i, t in texts(before).items()]
    assert set(texts(after)) == set(slow_components(rows))


def test_decontamination(stages, spark):
    _, before, after = stages[2]
    items = [(r.item_id, r.text, None) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {d for d, _ in slow_leaks(list(texts(before).items()), items)}
    assert set(texts(after)) == set(texts(before)) - dirty


def test_secrets(stages):
    _, before, after = stages[3]
    old, new = texts(before), texts(after)
    assert set(old) == set(new)
    for i, t in old.items():
        if slow_base(t):
            assert new[i] != t and not slow_base(new[i])
    assert sum(old[i] != new[i] for i in old) < 0.2 * len(old)
    assert all(r.n_chars == len(r.text) for r in after.collect() if old[r.doc_id] != r.text)


def test_tokens(stages, spark):
    _, before, after = stages[4]
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, t in texts(before).items():
        ids = np.array(ref.encode_ordinary(t), "<u4").tobytes()
        want[i] = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in after.collect()} == want
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == {tuple(r) for r in after.collect()}


def test_clashing_columns_and_empty_tables_pass_the_stages(spark):
    df = spark.sql("select 1L as doc_id, 'password=12345678 and so on' as text, 'x' as row, 'y' as kept_id, 5L as n_chars, cast(null as string) as fp, 'z' as _text")
    index = decontaminate.indexes(spark.read.parquet(f"{SF}/benchmark.parquet"))
    for frame in (df, df.where("false"), df.unionAll(df)):
        for f in (lambda d: quality_knn.keep_good(d, 1.0), simhash_dedup.keep_one, lambda d: decontaminate.keep_clean(d, index), lambda d: corpus_pipeline.secret_scan(spark, d, SF)):
            out = f(frame)
            assert out.columns == df.columns and out.count() <= frame.count()
    assert corpus_pipeline.secret_scan(spark, df, SF).first().text == "[secret] and so on"


def test_odd_rows_pass_the_whole_pipeline(spark, tmp_path):
    """Null, empty, very long and repeated texts, ids and columns."""
    base = spark.read.parquet(f"{SF}/documents.parquet")
    good = max((r.text for r in base.limit(60).collect()), key=len)
    long = " ".join(good.split() * (200_000 // len(good.split())))
    odd = [(None, None), (None, good + " one"), (9001, None), (9002, ""), (9003, "  "), (9004, long), (9005, good + " two three"), (9005, good + " two three"), (9006, "token=abcdefgh " * 2000)]
    rows = spark.createDataFrame([(i, t, None, None, None) for i, t in odd], base.schema)
    base.unionAll(rows).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in got}
    assert len(got) == len({(r.doc_id, r.decoded_sha256) for r in got}) and len(got) > 0.5 * base.count()
    assert kept <= {r.doc_id for r in base.collect()} | {i for i, _ in odd}
    assert sum(r.doc_id == 9005 for r in got) <= 1
    empty = tmp_path / "empty"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").where("false").write.parquet(str(empty / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
