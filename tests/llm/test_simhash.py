import random
import re

import numpy as np
import pytest
import xxhash

from branchwise.llm import simhash as S


def plain_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, bits=4):
    """Smallest index reachable from each."""
    fps = np.array(fps, dtype=np.uint64)
    root = np.arange(len(fps))
    near = [np.flatnonzero(np.bitwise_count(fps ^ f) <= bits) for f in fps]
    while True:
        new = np.array([root[n].min() for n in near])
        if (new == root).all():
            return root
        root = new


def test_fingerprints_against_definition():
    rnd = random.Random(1)
    texts = [None, "", " \n\t", "One", "ÀB c\x0bD e  F G", "a b c d", "A B\nC D"]
    texts += [" ".join(rnd.choices(["Xy", "b", "ç", "dd"], k=n)) for n in (5, 40, 70000)]
    assert [S.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]
    assert S.fingerprint("a b c d") == S.fingerprint("A B\nC D")


@pytest.mark.parametrize("bits", [0, 2, 4])
def test_trie_join_against_all_pairs(bits):
    rnd = np.random.default_rng(bits)
    base = rnd.integers(0, 1 << 63, 60, dtype=np.uint64)
    keys = np.unique(np.concatenate([base] + [base ^ np.uint64(1 << int(a) | 1 << int(b)) for a, b in rnd.integers(0, 64, (30, 2))]))
    want = {(i, j) for i in range(len(keys)) for j in range(i + 1, len(keys)) if int(keys[i] ^ keys[j]).bit_count() <= bits}
    got = [(int(i), int(j)) for a, b in S.join_tries(keys, None, 0, bits) for i, j in zip(a, b)]
    assert len(got) == len(set(got)) and set(got) == want
    left, right = keys[::2], keys[1::2]
    got = {(int(left[i]), int(right[j])) for a, b in S.join_tries(left, right, 0, bits) for i, j in zip(a, b)}
    assert got == {(int(x), int(y)) for x in left for y in right if int(x ^ y).bit_count() <= bits}


def test_every_near_pair_shares_a_node():
    rnd = random.Random(3)
    for n in (10, 10**8, 10**11):
        orders, r = S.choose_bands(n, 4, 8192)
        for _ in range(200):
            x = rnd.getrandbits(64)
            y = x
            for b in rnd.sample(range(64), 4):
                y ^= 1 << b
            keys = [S.permuted(np.array([x, y], np.uint64), o) for o in orders]
            assert all(int(k[0] ^ k[1]).bit_count() == 4 for k in keys)
            assert any(int(k[0] ^ k[1]) >> (64 - sum(w for _, w in o[:r])) == 0 for k, o in zip(keys, orders))


@pytest.mark.parametrize("node_rows", [8192, 16])
def test_components_against_brute_force(spark, node_rows):
    rnd = random.Random(node_rows)
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(1, 200))) for _ in range(60)] + [None, "", "\n"]
    for t in list(texts[:30]):
        for _ in range(rnd.randint(1, 6)):
            w = (t or "").split(" ")
            w[rnd.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    hub = " ".join(rnd.choices(words, k=400)).split(" ")
    for k in range(60):
        texts.append(" ".join(hub[:k * 5] + ["x"] + hub[k * 5 + 1:]))
    texts += [texts[5]] * 40
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, root string").repartition(5)
    got = {r.doc_id: r for r in S.near_duplicates(df, node_rows=node_rows).collect()}
    want = plain_components([plain_fingerprint(t) for t in texts])
    assert len(got) == len(texts)
    assert [got[i].component_id for i in range(len(texts))] == want.tolist()
    assert [got[i].fp % 2**64 for i in range(len(texts))] == [plain_fingerprint(t) for t in texts]


def test_chain_of_links(spark):
    """A path of 300 nodes, each linked to the next only."""
    edges = spark.createDataFrame([(k * 7919 % 301 - 150, (k + 1) * 7919 % 301 - 150) for k in range(300)], "a long, b long")
    roots = {r.root for r in S.components(edges).collect()}
    assert roots == {-150}


def test_null_ids_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (None, "z"), (4, "z"), (4, "z"), (3, "Z")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in S.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, None), (None, 3), (4, 3), (4, 3), (3, 3)], key=str)
    assert S.near_duplicates(df.limit(0)).count() == 0


def test_query_on_given_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    fps = [plain_fingerprint(d.text) for d in docs]
    root = plain_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.op3_simhash(spark, sf).collect()}
    assert got == {d.doc_id: (f"{fps[i]:016x}", docs[root[i]].doc_id) for i, d in enumerate(docs)}
