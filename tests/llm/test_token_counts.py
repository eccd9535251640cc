import random

import public_tokenizers
from tokenizers import Tokenizer

from branchwise.llm import token_counts as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(texts):
    tok = Tokenizer.from_file(PATH)
    return [len(e.ids) for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_pattern_cuts_as_the_library_does_for_every_code_point():
    pre, own = Tokenizer.from_file(PATH).pre_tokenizer, T.Pieces(PATH, T.newer_letters(PATH))
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    bad = []
    for at in range(0, len(points), 200):
        text = "".join(f"a {chr(c)}{chr(c)} 1{chr(c)}!" for c in points[at:at + 200])
        cuts = [e for _, (_, e) in pre.pre_tokenize_str(text)]
        got, k = [], 0
        for p in own.split(text):
            got.append(k := k + len(p))
        if cuts != got:
            bad.append(at)
    assert not bad and "".join(own.split("  \n x  y")) == "  \n x  y"


def test_counts_against_the_library(spark):
    rnd = random.Random(2)
    bits = ["the", " the", "  ", "\n\n", "é", "ß", "漢字", "👍🏽", "'ll", "12345", "<|endoftext|>", "<|endoftext", "!?", "\t", "\x1c", "\xa0", "x" * 50]
    texts = ["".join(rnd.choices(bits, k=rnd.randint(0, 60))) for _ in range(300)]
    texts += [None, "", " ", "<|endoftext|>" * 3, "word " * 60000, "q" * 3000]
    rows = [(i if i % 7 else None, t, 1) for i, t in enumerate(texts)] + [(5, "dup dup", 1)] * 3
    texts += ["dup dup"] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(4)
    got = [(r.doc_id, r.n_bytes, r.n_tokens) for r in T.count_tokens(df, PATH, size=20).collect()]
    want = [(r[0], len((t or "").encode()), n) for r, t, n in zip(rows, texts, expected(texts))]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert T.count_tokens(df, PATH).count() == 0


def test_query_on_given_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {d.doc_id: (len(d.text.encode()), n, n > 1024) for d, n in zip(docs, expected([d.text for d in docs]))}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in T.op4_token_counts(spark, sf).collect()}
    assert got == want
