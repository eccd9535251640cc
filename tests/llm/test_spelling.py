import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from branchwise.llm import spelling as S

UPPER = {c: c + 32 for c in range(65, 91)}


def plain_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plainly(rows):
    words = plain_words(rows)
    around = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, vs in around.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(around[w]), words[form[w]] if form[w] else None))
    return out


def corpus():
    rnd = random.Random(6)
    stock = ["".join(rnd.choices("abcé", k=rnd.randint(4, 7))) for _ in range(60)]
    stock += ["aaaaaa", "aaaaa", "aaaaaaa", "Straßen", "ÿÿÿÿÿ", "ÿÿÿÿÀ", "x×y÷z", "abcdefghijkl", "abcdefghijkm", "abcdefghijk", "long" * 300, "long" * 300 + "e",
              "long" * 299 + "lung", "short"]
    weights = [1 / (k % 17 + 1) for k in range(len(stock))]
    rows = [(k if k % 11 else None, " ".join(rnd.choices(stock, weights, k=rnd.randint(0, 120)))) for k in range(250)]
    # a chain of forms, each of at least twice the count of the one before
    chain = ["wordsaaa", "wordsaab", "wordsabb", "wordsbbb", "wordbbbb", "worbbbbb"]
    rows += [(1000 + k, f"{w}, " * (4 << k)) for k, w in enumerate(chain)]
    return rows + [(7, None), (8, ""), (9, "12 4! 中"), (10, "Repeat repeat REPEAT"), (10, "Repeat repeat REPEAT")]


def test_words_forms_and_roots_against_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(6)
    expected = plainly(rows)
    assert len({r[2] for r in expected}) > 5 and ("wordsaaa", "wordsaab", "worbbbbb") in {r[:3] for r in expected}
    for blocks in (S.MAX_BLOCKS, 16):  # many false positives change nothing
        got = S.variants(df, max_blocks=blocks).collect()
        assert len(got) == len(expected) and {tuple(r) for r in got} == expected


def test_hashes_of_edits_and_filters(spark):
    word = "spellings"
    value, p = S.polynomial(S.points(word)), S.points(word)
    for k in range(len(word)):
        cut = value[k:k + 1] + (value[-1:] - value[k + 1:k + 2]) * np.uint64(pow(S._BASE, -1, 1 << 64))
        assert cut[0] == S.polynomial(S.points(word[:k] + word[k + 1:]))[-1]
        swap = value[-1:] + (np.uint64(ord("z")) - p[k:k + 1]) * S.powers(20)[k]
        assert swap[0] == S.polynomial(S.points(word[:k] + "z" + word[k + 1:]))[-1]
    words = ["".join(x) for x in {tuple(random.Random(k).choices("abcdefgh", k=8)) for k in range(3000)}]
    shard, blocks, letters = S.filters(spark.createDataFrame([(w, 1) for w in words], "word string, n long").repartition(3))
    assert letters == "abcdefgh" and len(blocks) == len(words) // S.PER_BLOCK
    h = lambda ws: np.array([int(S.polynomial(S.points(w))[-1]) for w in ws], np.uint64)
    assert len(S.held(h(words), shard[8], blocks)) == len(words)  # none of its words is missed
    others = ["".join(random.Random(-k).choices("ijklmnop", k=8)) for k in range(1, 5000)]
    assert len(S.held(h(others), shard[8], blocks)) < 50
    lengths = {n: 10**6 for n in range(5, 25)}
    assert sum(n for _, n in S.shards(lengths).values()) <= S.MAX_BLOCKS


def test_edge_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.variants(empty).count() == 0
    alone = spark.createDataFrame([(1, "lonely " * 5)], "doc_id long, text string")
    assert [tuple(r) for r in S.variants(alone, noise=1 << 40).collect()] == [("lonely", None, "lonely", 5, 0, None)]
    with pytest.raises(ValueError):
        S.filters(spark.createDataFrame([("abcde", 3), ("abcdef", 3)], "word string, n long"), max_blocks=1)
