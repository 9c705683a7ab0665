import random
import tracemalloc
import zlib

import numpy as np
import pytest

from tallyloom.llm import language_id, quality_knn

WORDS = {"aa": "lorum ipsat dolan sitor amec", "bb": "kvist sköld bjärn fyrk øst", "cc": "ñandu queso llave rayo año"}


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 0


def docs(rng, n=240):
    out = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        out.append((i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randrange(8, 300))), lang, "s"))
    return out


def slow_phrases(text, sample):
    """Greedy longest phrases of the whole text found by search."""
    text, sample = "".join(map(chr, text.tolist())), "".join(map(chr, sample.tolist()))
    n = i = 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i : j + 1] in sample:
            j += 1
        i, n = j, n + 1
    return n


SCRIPTS = {"ru": "".join(map(chr, range(0x430, 0x450))), "el": "".join(map(chr, range(0x3B1, 0x3C9))), "zh": "".join(map(chr, range(0x4E00, 0x4E00 + 900))), "ja": "".join(map(chr, range(0x4E00 + 500, 0x4E00 + 1000))) + "".join(map(chr, range(0x3041, 0x3090))), "en": "abcdefghijklmnopqrstuvwxyz"}


def in_script(rng, lang, n):
    letters = SCRIPTS[lang]
    return "".join(" " if rng.random() < 0.15 else letters[min(int(rng.expovariate(6 / len(letters))), len(letters) - 1)] for _ in range(n))


@pytest.mark.parametrize("block,ahead", [(64, 8), (256, 64), (1024, 128)])
def test_phrases_are_the_longest_of_whole_texts(monkeypatch, block, ahead):
    monkeypatch.setattr(language_id, "BLOCK", block)
    monkeypatch.setattr(language_id, "AHEAD", ahead)
    rng = random.Random(1)
    samples = {k: [in_script(rng, k, 1500), in_script(rng, k, 700)] for k in SCRIPTS}
    model = language_id.Model(samples)
    table = language_id.classes(model.alphabet)
    texts = [in_script(rng, k, 10_000) for k in SCRIPTS] + [" ".join(in_script(rng, rng.choice(list(SCRIPTS)), 60) for _ in range(60))]
    # Copies of what was learned, loops, single letters, letters that no language has, lengths at a stretch's end.
    texts += [samples["en"][0], samples["zh"][1] + samples["zh"][0] * 2, "so on " * 700, "a", "ž ž", "..a,,", "", "ж" * 3000, samples["ru"][0][100:] + "ü" + samples["ru"][0]]
    texts += [in_script(rng, "en", n).replace(" ", "e") for n in (block - 1, block, block + 1, block + ahead, 2 * block, 2 * block + 1)]
    cut = [language_id.symbols(t, table) for t in texts]
    got = model.phrases(cut)
    for k, lang in enumerate(model.langs):
        sample = np.concatenate([np.append(language_id.symbols(t, table), 0) for t in samples[lang]])
        assert got[k].tolist() == [slow_phrases(t, sample) for t in cut]
    assert model.predict(texts[:5])[0] == list(SCRIPTS)


def test_every_language_and_letter_is_learned(spark):
    rng = random.Random(2)
    tongues = {f"l{i:03}": ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(3)) for _ in range(12)] for i in range(230)}
    rows = [(i, "".join(rng.choice(tongues[lang]) for _ in range(80)), lang) for i, lang in enumerate(list(tongues) * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df)
    assert len(model.langs) >= 228
    got = {r.doc_id: r.lang_pred for r in language_id.predict(df, model).collect()}
    assert np.mean([got[i] == lang for i, _, lang in rows if lang in model.langs]) > 0.99


def test_samples_are_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_CHARS", 100)
    rows = [(i, "abc def " * 5, "short") for i in range(1, 30)] + [(40 + i, "xyz " * (50 + i), "long") for i in range(10)] + [(60, "pq", "both"), (61, "rs" * 200, "both"), (62, "rs" * 201, "both"), (63, "rs" * 203, "both")]
    learned = {}
    monkeypatch.setattr(language_id, "Model", lambda samples: learned.update(samples))
    language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = {t for _, t, _ in rows}
    assert all(t in texts for own in learned.values() for t in own)
    assert len(learned["short"]) == 2 and len(learned["long"]) == 1 and (held(60) or learned["both"] == ["pq"])


def test_equal_entropies_go_to_the_first_name():
    model = language_id.Model({"b": ["abab"], "a": ["abab"], "c": ["zzzz"]})
    assert model.predict(["abab ab", "q", None]) == (["a", "a", "und"], [0.0, 0.0, 0.0])


def test_language_operator(spark):
    rows = docs(random.Random(3)) + [(900, None, "aa", "s"), (901, " 12 ,.", None, "s"), (None, "lorum ipsat", "bb", "s"), (902, "queso llave " * 20_000, None, "s"), (7, "kvist sköld", "aa", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = language_id.predict(df, language_id.train(df)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.held_out == held(r.doc_id) for r in got)
    pred = {r.doc_id: r.lang_pred for r in got}
    true = {i: lang for i, _, lang, _ in rows}
    own = [i for i in range(240) if held(i) and i != 7]
    assert np.mean([pred[i] == true[i] for i in own]) > 0.95
    assert pred[900] == pred[901] == "und" and pred[902] == "cc" and pred[None] == "aa"
    nothing = df.where("lang is null")
    assert {r.lang_pred for r in language_id.predict(nothing, language_id.train(nothing)).collect()} == {"und"}
    assert language_id.predict(df.where("false"), language_id.train(df.where("false"))).count() == 0


def test_held_out_rows_teach_nothing(spark):
    rows = [(i, "kvist sköld bjärn" if held(i) else "lorum ipsat dolan", "bb" if held(i) else "aa", "s") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert language_id.train(df).langs == ["aa"]


@pytest.fixture(scope="module")
def quality_rows():
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(300):
        good = i % 4 > 0
        words = [rng.choice("the quick brown fox jumps over a lazy dog and runs far away from here today".split()) for _ in range(rng.randrange(20, 200))]
        rows.append((i, " ".join(words) + "." if good else "!! ".join(w.upper() for w in words), "en", "s"))
        labels.append((i, int(good), 0))
    return rows, labels + [(5, 1, 0), (5, 0, 0), (None, 1, 1), (6, None, 0)]


def test_quality_operator(spark, quality_rows):
    rows, labels = quality_rows
    rows = rows + [(800, None, None, None), (801, "", None, None), (802, "THE!! DOG!! RUNS!! FAR!! AWAY!! " * 20_000, None, None), (None, "the dog runs", None, None), (3, rows[3][1], None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality string, score string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality_knn.train(df, marks)
    got = quality_knn.score(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    by = {r.doc_id: r for r in got}
    assert all(by[i].predicted == int(i % 4 > 0) for i in range(300) if held(i))
    assert by[800].score == by[801].score == pytest.approx(model.prior) and by[802].predicted == 0
    assert {r.score for r in got if r.doc_id == 3} == {by[3].score}
    kept = quality_knn.keep_good(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}
    one = quality_knn.train(df, marks.where("quality = 1"))
    assert one == 1.0 and {r.score for r in quality_knn.score(df, one).collect()} == {1.0}
    assert quality_knn.train(df, marks.where("false")) == 0.5
    assert quality_knn.score(df.where("false"), model).count() == 0


def test_votes_are_the_nearest(quality_rows):
    rows, labels = quality_rows
    texts = [r[1].encode() for r in rows]
    terms, y = quality_knn.counts(texts[:200]), np.array([m[1] for m in labels[:200]])
    model = quality_knn.Model(terms, y, 0.5)
    x = quality_knn.counts(texts[200:])[:, model.used] * model.weight
    x = x / np.linalg.norm(x, axis=1, keepdims=True) @ model.axes
    near = np.round(x / np.linalg.norm(x, axis=1, keepdims=True) @ model.vectors.T, 9)
    want = []
    for row in near:
        least = sorted(row)[-quality_knn.NEIGHBOURS]
        votes = [(max(s, 0), v) for s, v in zip(row, y) if s >= least]
        want.append(sum(s * v for s, v in votes) / sum(s for s, _ in votes))
    assert np.allclose(model.score(texts[200:]), want, atol=1e-6)


def test_scores_of_a_block_take_little_memory():
    rng = np.random.default_rng(7)
    texts = [bytes(rng.integers(32, 127, 1000, np.uint8)) for _ in range(quality_knn.ROWS)]
    model = quality_knn.Model(quality_knn.counts(texts[:300]), np.arange(300) % 2, 0.5)
    model.vectors, model.labels = np.tile(model.vectors, (10, 1)), np.tile(model.labels, 10)
    want = np.concatenate([model.score([t]) for t in texts])
    tracemalloc.start()
    got = model.score(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    block = quality_knn.ROWS * max(len(model.vectors), quality_knn.TERMS) * 8
    assert peak < 3.2 * block and np.allclose(got, want, atol=1e-6)


def test_labels_are_read_once(spark, quality_rows):
    rows, labels = quality_rows
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").mapInArrow(count, "doc_id long, quality int, toxic int")
    model = quality_knn.train(df, marks)
    assert len(model.labels) == sum(not held(i) for i in range(300)) and read.value == len(labels)
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_only_terms_that_texts_have_reach_the_driver(spark, quality_rows, monkeypatch):
    rows, labels = quality_rows
    df, marks = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    brought = []

    def collect(self, plain=type(df).collect):
        got = plain(self)
        brought.append(sum(len(x) for r in got for x in r if isinstance(x, bytes | bytearray)))
        return got

    monkeypatch.setattr(type(df), "collect", collect)
    model = quality_knn.train(df, marks)
    learned = [r for r in rows if not held(r[0])]
    terms = quality_knn.counts([r[1].encode() for r in learned]).astype(np.float32)
    assert len(learned) == len(model.labels) and 0 < sum(brought) <= 6 * np.count_nonzero(terms) < terms.nbytes / 4
    marked = {i: y for i, y, _ in labels}
    y = np.array([0.5 if r[0] == 5 else marked[r[0]] for r in learned]) >= 0.5
    whole = quality_knn.Model(terms.astype(np.float64), y, model.prior)
    assert np.array_equal(whole.vectors, model.vectors) and np.array_equal(whole.axes, model.axes) and np.array_equal(whole.labels, model.labels)


def test_model_holds_its_matrix_once():
    rng = np.random.default_rng(8)
    terms = rng.random((2000, quality_knn.TERMS), np.float32)
    tracemalloc.start()
    quality_knn.Model(terms, np.arange(2000) % 2, 0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.6 * terms.size * 8
