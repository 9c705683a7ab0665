import random
import re

from tallyloom.llm import decontaminate


def words(text):
    return re.findall(r"[^\x00-\x20!-/:-@\[-`{-\x7f]+", (text or "").lower())


def runs(w, size):
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def holds(w, part):
    """Whether words hold enough of a part's shingles; a shorter part is one."""
    p = words(part)
    size = min(5, len(p))
    return not p or len(runs(p, size) & runs(w, size)) >= 0.8 * len(runs(p, size))


def slow_leaks(docs, items):
    """Items of which some passage of three chunks holds enough of the question, and the text enough of the answer."""
    chunk = max([64] + [len(words(q)) for _, q, _ in items])
    out = set()
    for d, text in docs:
        w = words(text)
        for at in range(0, max(1, len(w)), chunk):
            out |= {(d, i) for i, q, a in items if words(q) and holds(w[at : at + 3 * chunk], q) and holds(w, a)}
    return out


def corpus(rng):
    vocab = [f"w{i}" for i in range(300)] + ["the", "of", "Über"] * 60
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(rng.randrange(5, 60)), say(rng.randrange(5, 12)) if i % 3 == 0 else None) for i in range(70)]
    items += [(100, None, "x"), (101, "too few words", None), (102, items[0][1], items[0][2]), (103, "", ""), (104, "seldom said", None), (105, items[3][1], "Paris"), (106, items[6][1], "new york city"), (107, items[9][1], " ".join(f"far{i}" for i in range(20)))]
    docs = [(-1, None), (-2, ""), (-3, say(30_000) + " " + items[4][1]), (-4, f"it is Seldom, said {items[3][1]}"), (-5, f"{items[3][1]} paris {items[6][1]} York city new"), (-6, f"New York city {say(500)} {items[6][1]}"), (-7, items[9][1] + say(900) + " " + items[-1][2])]
    for d in range(300):
        parts = [say(rng.randrange(0, 200))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            i, q, a = rng.choice(items[:70])
            w = (q + " " + (a or "")).split()
            for _ in range(rng.choice([0, 0, 1, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            parts += [", ".join(w).upper() if rng.random() < 0.2 else " ".join(w), say(rng.randrange(0, 200))]
        docs.append((d, "\n".join(parts)))
    return docs, items


def test_finds_what_brute_force_finds(spark):
    docs, items = corpus(random.Random(8))
    df = spark.createDataFrame([(d, t, "k") for d, t in docs] + [(5, dict(docs)[5], "again")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string, answer string")
    want = slow_leaks(docs, items)
    assert len(want) > 80
    index = decontaminate.indexes(bench, answer_col="answer")
    got = decontaminate.leaks(df, index).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want | {(5, i) for d, i in want if d == 5}
    assert all(r.question_overlap >= 0.8 and (r.answer_overlap is None or r.answer_overlap >= 0.8) for r in got)
    kept = decontaminate.keep_clean(df, index)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.where("item_id = 'k'").collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_scores_are_bm25_and_blocks_lose_nothing():
    docs, items = corpus(random.Random(9))
    items = [x for x in items if x[1]][:70]
    index = decontaminate.Index([i for i, _, _ in items], [q for _, q, _ in items], [None] * len(items))
    import numpy as np

    for _, text in docs[3:60]:
        terms = np.unique(index.lookup(decontaminate._words([text])[0]))
        terms = terms[terms < len(index.terms)]
        got = {i: s for b in range(len(index.block_least)) for i, s in index.retrieve(terms, b)}
        exact = np.zeros(len(items))
        for t in terms:
            exact[index.postings[t][0]] += index.postings[t][1]
        want = {i: s for i, s in enumerate(exact) if s >= index.least[i]}
        assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_slices_and_empty_tables(spark, monkeypatch):
    docs, items = corpus(random.Random(10))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([i[:2] for i in items], "item_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string, answer string")
    rows = lambda found: sorted(map(str, found.collect()))
    whole = rows(decontaminate.leaks(df, decontaminate.indexes(bench, answer_col="answer")))
    clean = rows(decontaminate.keep_clean(df, decontaminate.indexes(bench, answer_col="answer")))
    for size in (5000, 1000):
        monkeypatch.setattr(decontaminate, "SLICE_BYTES", size)
        cut = decontaminate.indexes(bench, answer_col="answer")
        assert len(cut) > 2
        assert rows(decontaminate.leaks(df, cut)) == whole and rows(decontaminate.keep_clean(df, cut)) == clean
    for a, b in ((df.where("false"), bench), (df, bench.where("false")), (df, bench.where("text is null"))):
        index = decontaminate.indexes(b)
        assert decontaminate.leaks(a, index).count() == 0 and decontaminate.keep_clean(a, index).count() == a.count()


def test_copies_drawn_out_are_found_at_any_place():
    rng = random.Random(11)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    longest = say(90).split()
    index = decontaminate.Index([1, 2], [" ".join(longest), say(30)], [None, None])
    for before in range(0, 200, 7):
        text = f"{say(before)} {' '.join(longest[:40])} {say(80)} {' '.join(longest[40:])} {say(60)}"
        assert [k[1] for k in index.search([text])] == [0]
