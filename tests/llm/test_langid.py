import numpy as np

from branchwise.llm import langid as L

EN = "the cat and the dog were running over the hill with that other thing"
DE = "der hund und die katze sind über den berg gelaufen und schlafen jetzt"


def slow_bundle(text):
    """Trigram by trigram, from the letter vectors."""
    slots = L.once("letter slots", L._slots)
    s = [0] + [int(slots[ord(c)]) for c in text.lower()] + [0]
    s = [c for i, c in enumerate(s) if i == 0 or c or s[i - 1]]
    v = L._letters()[2].astype(int)
    return sum((np.roll(v[a], 2) * np.roll(v[b], 1) * v[c] for a, b, c in zip(s, s[1:], s[2:])), np.zeros(L.DIM))


def test_bundle_against_trigram_loop():
    for text in (EN, DE, "a", "é ß,, x", "..", "aa  bb\n" * 300):
        assert (L.bundle(L.codes(text)) == slow_bundle(text)).all()


def test_train_and_identify(spark):
    rows = [(i, EN, "en", 7.0) for i in range(5)] + [(9, DE, "de", 7.0)] * 4 + [(10, EN, None, 7.0), (11, None, "en", 1.0),
            (12, "123 ..!", "fr", 1.0), (None, "", "de", 2.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double").repartition(3)
    langs, protos = model = L.train(df)
    assert langs == ["de", "en"]
    assert (protos[1] == 5 * slow_bundle(EN)).all() and (protos[0] == 4 * slow_bundle(DE)).all()
    got = L.identify(df, model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    for r in got.collect():
        want = {EN: "en", DE: "de"}.get(r.text, "und")
        assert r.lang_pred == want and 0 <= r.score <= 1 and (want == "und") == (r.score == 0)
    one = spark.createDataFrame([(1, (EN + " ") * 30000)], "doc_id long, text string")
    assert L.identify(one, model).head().lang_pred == "en"


def test_prototypes_do_not_depend_on_partitions(spark):
    rows = [(k, text, lang) for k in range(12) for text, lang in ((EN, "en"), (DE, "de"), ("a", "en"), ("ß 1", "de"), ("x  y", "en"))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = [12 * (slow_bundle(DE) + slow_bundle("ß 1")), 12 * (slow_bundle(EN) + slow_bundle("a") + slow_bundle("x y"))]
    for n in (1, 3, 11):
        langs, protos = L.train(df.repartition(n))
        assert langs == ["de", "en"] and (protos == np.array(want)).all()


def test_no_labels_and_no_rows(spark):
    df = spark.createDataFrame([(1, EN, None)], "doc_id long, text string, lang string")
    model = L.train(df)
    assert L.identify(df, model).head().lang_pred == "und"
    assert L.train(df.limit(0))[0] == [] and L.identify(df.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = L.op10_language_id(spark, sf).where("held_out").join(lang, "doc_id").collect()
    assert len(got) > 200 and sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
