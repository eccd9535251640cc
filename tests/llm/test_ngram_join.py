import random
import re

import numpy as np
import pytest

from branchwise.llm import ngram_join as N

UPPER = {c: c + 32 for c in range(65, 91)}


def shingles(text, k=3):
    words = [w for w in re.split("[\x20\x09-\x0D]+", (text or "").translate(UPPER)) if w]
    return {tuple(words[i:i + k]) for i in range(max(len(words) - k + 1, 1))} if words else set()


def linked(x, y, share=90):
    return bool(x) and bool(y) and 100 * len(x & y) >= share * len(x | y)


def plainly(rows, share=90):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if linked(sets[i], sets[j], share):
                up[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids, default=None)))
    return sorted(out, key=repr)


def edited(rnd, words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"e{rnd.randrange(10**6)}"
    return words


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(400)}"
    rows = []
    for n in (9, 10, 11, 12, 20, 29, 30, 31, 45, 60, 100, 150, 300):  # near copies around the threshold
        base = [word() for _ in range(n)]
        for k in range(6):
            rows.append(" ".join(edited(rnd, base, rnd.randint(0, max(1, n // 25)))))
            rows.append(" ".join(base[:n - rnd.randint(0, max(1, n // 9))]))
            rows.append(" ".join([*base, *(word() for _ in range(rnd.randint(0, max(1, n // 9))))]))
    crowd = [word() for _ in range(120)]  # a large group of near copies: all its tokens are frequent
    rows += [" ".join(edited(rnd, crowd, rnd.randint(0, 3))) for _ in range(120)]
    passages = [" ".join(word() for _ in range(40)) for _ in range(3)]  # texts of shared passages, alike or not
    rows += [" ".join([*rnd.sample(passages, rnd.randint(1, 3)), *(word() for _ in range(rnd.randint(0, 12)))]) for _ in range(120)]
    rows += [" ".join(word() for _ in range(rnd.randint(1, 80))) for _ in range(60)]
    rows += ["a", "A", "a b", "A\tB ", "b a", "a b c", "same same same same", None, "", " \n", "é É", "é é", "É é"]
    rnd.shuffle(rows)
    return [(k if k % 13 else None, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize(("seed", "limits"), [(1, (N.FREQUENT, N.MAX_FREQUENT)), (2, (3, 1 << 20)), (3, (3, 40))])
def test_components_against_all_pairs(spark, seed, limits):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, sid int, prefix string").repartition(5)
    got = N.ngram_join(df, frequent=limits[0], most=limits[1]).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plainly(rows)


def test_similar_sets_share_a_key():
    rnd = random.Random(5)
    often = np.sort(np.array(rnd.sample(range(1 << 12), 3000), np.uint64))  # most tokens are frequent
    found = 0
    for _ in range(4000):
        n = rnd.randint(9, 90)
        base = rnd.sample(range(1 << 12), n + 12)
        common = n - rnd.randint(0, n // 12)
        x = set(base[:n])
        y = set(base[:common]) | set(base[n:n + rnd.randint(0, n // 10)])
        if x == y or not linked(x, y):
            continue
        found += 1
        keys, sketches = [], []
        for s in (x, y):
            own = np.array(sorted(s), np.uint64)
            key, singles = N.keys_of(*N.ordered(own, often))
            assert len(key) <= 2 * (n // 8 + 2) and singles <= len(key)
            keys.append(set(key.tolist()))
            sketches.append(N.sketch(own))
        assert keys[0] & keys[1]
        big, small = N.sketch(own, 1024), N.sketch(own, 512)
        assert (big[:8] ^ big[8:] == small).all()  # a fold is the sketch of half the bits
        assert sum(int(v).bit_count() for v in (sketches[0] ^ sketches[1]).view(np.uint64)) <= len(x ^ y)
    assert found > 500


def test_edge_cases(spark):
    assert N.ngram_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = " ".join(f"t{k}" for k in range(30_000))
    rows = [(4, long), (2, long + " more"), (9, long.upper()), (9, None), (3, "only")]
    got = N.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == [(2, 29_999, 2), (3, 1, 3), (4, 29_998, 2), (9, 0, 9), (9, 29_998, 2)]
    with pytest.raises(ValueError):
        N.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), share=60)
