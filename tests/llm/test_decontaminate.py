import random

import numpy as np

from branchwise.llm import decontaminate as D


def table_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
        row = new
    return row[-1]


def test_common_subsequence_against_table():
    rnd = random.Random(1)
    for _ in range(200):
        a, b = ([rnd.choice([b"a", b"b", b"c", b"d"]) for _ in range(rnd.randint(1, 90))] for _ in range(2))
        assert D.common_subsequence(D.masks_of(a), len(a), b) == table_lcs(a, b)


def test_hashes_tell_words_apart_as_text_does():
    rnd = random.Random(2)
    texts = ["", None, " ", "a", "A b, b; a!", "é É İ ß", "x" * 5000 + " y", *("".join(rnd.choices("ab é.\n'", k=rnd.randint(0, 80))) for _ in range(200))]
    every = {}
    for t in texts:
        assert len(D.hashes(t)) == len(D.words(t))
        for w, h in zip(D.words(t), D.hashes(t).tolist()):
            assert every.setdefault(w, h) == h
    assert len(set(every.values())) == len(every)
    long = "long words " * 900_000 + "z" * 5_000_000 + " end"
    assert D.hashes(long).tolist() == [D.hashes(w)[0] for w in ("long", "words")] * 900_000 + [D.hashes("z" * 5_000_000)[0], D.hashes("end")[0]]


def test_basis_spans_leading_directions(spark):
    rng = np.random.default_rng(0)
    rows = [[int(x) for x in rng.choice(40, 12)] for _ in range(300)]
    df = spark.createDataFrame([(r, 1.0) for r in rows], "f array<int>, weight double").repartition(3)
    q = D.fit_basis(df, np.ones(D.FEATURES), rank=45, passes=2)
    a = np.zeros((300, D.FEATURES))
    for x, r in zip(a, rows):
        np.add.at(x, r, 1)
        x /= np.linalg.norm(x)
    assert np.allclose(q.T @ q, np.eye(45), atol=1e-8)
    assert np.linalg.norm(a - a @ q @ q.T) < 1e-6 * np.linalg.norm(a)


def plain_gram(passages, idf):
    out = np.zeros((D.FEATURES, D.FEATURES), np.float32)
    for f in passages:
        at, n = np.unique(f, return_counts=True)
        x = n * idf[at]
        out[np.ix_(at, at)] += np.outer(x, x) / (x @ x)
    return out


def test_corpus_directions_come_from_every_document(spark, monkeypatch):
    rnd, seen = random.Random(7), []
    texts = ["one two three"] * 5000 + [" ".join(rnd.choices([f"u{k}" for k in range(30)], k=rnd.choice([0, 3, 40, 100]))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    bench = spark.createDataFrame([(1, "these are words of an item and nothing else of the sort")], "item_id long, text string")
    model = D._model
    monkeypatch.setattr(D, "_model", lambda items, corpus, *a: seen.append((corpus, a[1])) or model(items, corpus, *a))
    assert D.find_leaks(docs, bench).count() == 0
    (got, idf), = seen
    found = [D.features(D.hashes(t)) for t in texts]
    want = plain_gram([f[a:a + D.WINDOW] for f in found for a in range(0, len(f), D.WINDOW)], idf) * (D.CORPUS_ROWS / len(texts))
    assert np.allclose(got @ got.T, want, atol=1e-3 * want.max())


def corpus():
    rnd = random.Random(3)
    vocabulary = [f"w{k}x" for k in range(3000)] + ["the", "of", "and"] * 500
    text = lambda n: " ".join(rnd.choices(vocabulary, k=n))
    items = [(i, text(rnd.randint(14, 70)) + ". " + text(6) + ".") for i in range(25)]
    docs, leaks = [], set()
    for d in range(150):
        body = text(rnd.randint(0, 700))
        if d % 3 == 0:
            i = rnd.randrange(25)
            leak = items[i][1].split(" ")
            if d % 2:  # a paraphrase: some words changed or put in, the answer left
                for _ in range(len(leak) // 8):
                    leak[rnd.randrange(len(leak) - 6)] = "other"
                leak.insert(3, "indeed")
            docs.append((d, f"{body}\n{' '.join(leak).upper() if d % 4 == 0 else ' '.join(leak)}; {text(100)}"))
            leaks.add((d, i))
        else:
            docs.append((d, body))
    return items, docs, leaks


def test_finds_leaks_and_nothing_else(spark):
    items, docs, leaks = corpus()
    docs += [(None, None), (200, ""), (201, items[2][1]), (201, items[2][1]), (None, items[3][1]), (202, "the of " * 100000 + items[4][1])]
    leaks |= {(201, 2), (None, 3), (202, 4)}
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, common string").repartition(4)
    bench = spark.createDataFrame([*items, (90, None), (91, "too short"), (92, items[2][1])], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in D.find_leaks(df, bench).collect()}
    assert got.keys() == leaks | {(d, 92) for d, i in leaks if i == 2}
    assert all(r.cosine >= D.COSINE - 1e-6 and r.common >= D.PARAPHRASE for r in got.values())


def plain_leaks(items, docs):
    """Every pair by a subsequence with every passage's surroundings."""
    out = set()
    for i, t in items:
        item = D.words(t)
        said, masks = D.words(D._ENDS.split(t.strip())[-1]), D.masks_of(item)
        answer = D.masks_of(said)
        for d, body in docs:
            found = D.words(body)
            for here in range(0, max(len(found) - D.STEP, 1), D.STEP):
                around = found[max(0, here - len(item)):here + D.WINDOW + len(item)]
                common = D.common_subsequence(masks, len(item), around) / len(item)
                if common >= D.VERBATIM or common >= D.PARAPHRASE and D.common_subsequence(answer, len(said), around) >= D.ANSWER * len(said):
                    out.add((d, i))
                    break
    return out


def planted(rnd, vocabulary, items, n_docs, change):
    docs, leaks = [], set()
    for d in range(n_docs):
        i = rnd.randrange(len(items))
        leak = items[i][1].split(" ")
        for at in rnd.sample(range(len(leak)), int(change * len(leak))):
            leak[at] = rnd.choice(vocabulary)
        docs.append((d, " ".join(rnd.choices(vocabulary, k=rnd.randint(40, 300)) + leak + rnd.choices(vocabulary, k=60))))
        leaks.add((d, items[i][0]))
    return docs, leaks


def found_by(spark, items, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    return {(r.doc_id, r.item_id) for r in D.find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}


def test_many_unlike_items(spark):
    rnd = random.Random(11)
    vocabulary = [f"v{k}" for k in range(20000)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randint(16, 59)))) for i in range(3000)]
    for change in (0, 0.15):
        docs, leaks = planted(rnd, vocabulary, items, 40, change)
        assert found_by(spark, items, docs) == leaks
        assert plain_leaks([x for x in items if x[0] in {i for _, i in leaks}], docs) == leaks


def test_recall_of_the_latent_search_alone(spark):
    rnd = random.Random(13)
    vocabulary = [f"v{k}" for k in range(20000)] + ["the", "of", "and"] * 3000
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randint(16, 90)))) for i in range(3000)]
    for change in (0, 0.2):
        docs, leaks = planted(rnd, vocabulary, items, 60, change)
        want = plain_leaks([x for x in items if x[0] in {i for _, i in leaks}], docs)
        df, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
        got = {(r.doc_id, r.item_id) for r in D.find_leaks(df, bench, short=0, held=0.0).collect()}  # no index
        assert len(want) > 40 and not got - want and len(got) >= 0.9 * len(want)
        assert D.find_leaks(df, bench, cosine=2.0, short=0, held=0.0).count() == 0  # nothing comes past the method


def test_parts_of_long_items_have_answers_of_their_own(spark):
    rnd = random.Random(14)
    word = lambda: f"q{rnd.randrange(5000)}"
    sentences = [" ".join(word() for _ in range(20)) + "." for _ in range(15)]
    said = [D.hashes(s).tolist() for s in sentences]
    items = D.read_items(spark.createDataFrame([(1, " ".join(sentences))], "item_id long, text string"), "item_id", "text", None)
    assert len(items) == 3 and [a.tolist() in said for _, _, a in items] == [True] * 3
    given = D.read_items(spark.createDataFrame([(1, " ".join(sentences), "forty two")], "item_id long, text string, answer string"), "item_id", "text", "answer")
    assert [a.tolist() for _, _, a in given] == [D.hashes("forty two").tolist()] * 3


def test_workers_need_no_copy_of_the_package(spark):
    import pickle

    sample = spark.createDataFrame([([1, 2], 1.0, None)], "f array<int>, weight double, block int")
    items = [(1, D.hashes("one two three four five six"), D.hashes("five six"))]
    model = D._model(items, sample, np.ones(D.FEATURES, np.int64), np.ones(D.FEATURES), D.SHORT, D.HELD)
    assert b"branchwise" not in pickle.dumps(model)


def test_short_items(spark):
    rnd = random.Random(12)
    vocabulary = [f"v{k}" for k in range(3000)] + ["the", "of", "and"] * 200
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randint(5, 9)))) for i in range(200)]
    for change in (0, 0.2):
        docs, leaks = planted(rnd, vocabulary, items, 100, change)
        want = plain_leaks(items, docs)
        assert leaks <= want and found_by(spark, items, docs) == want


def test_empty_tables(spark):
    items, docs, _ = corpus()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert D.find_leaks(df.limit(0), bench).count() == 0
    assert D.find_leaks(df, bench.limit(0)).count() == 0


def test_recall_against_plain_search_on_given_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: b" ".join(D.words(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: b" ".join(D.words(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    got = {(r.doc_id, r.item_id) for r in D.op1_decontaminate(spark, sf).collect()}
    assert len(want) > 10 and len(want & got) >= 0.9 * len(want) and not got - want
