import hashlib
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from branchwise.llm import mixing as M


def plain_targets(sizes):
    """Water filling, one source at a time, in fractions."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    out, left, free = {}, Fraction(sum(sizes.values())), set(order)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = Fraction(3 * sizes[s])
            left -= out[s]
            free.remove(s)
    return out


def plain_mix(rows):
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, _, t in rows]
    by = {}
    for (_, s, _), n in zip(rows, sizes):
        by[s] = by.get(s, 0) + n
    target = plain_targets(by)
    out = []
    for s in by:
        docs = sorted((hashlib.md5(f"17:{'' if d is None else d}:{hashlib.sha256((t or '').encode()).hexdigest()}".encode()).hexdigest(),
                       d is not None, d or 0, n) for (d, x, t), n in zip(rows, sizes) if x == s)
        at, goal = 0, int(target[s])
        for _, known, d, n in docs:
            part = goal % by[s] if by[s] else 0
            taken = (goal // by[s] * n if by[s] else 0) + max(0, min(at + n, part) - at)
            out.append((d if known else None, n, by[s], float(target[s]), taken))
            at += n
    return sorted(out, key=str)


def rows_of(n, seed):
    rnd = random.Random(seed)
    sources = ["b", "a", None, "ä", "Z", "tiny", "void"]
    rows = [(i, "a" if rnd.random() < 0.4 else rnd.choice(sources[:5]), " ".join(["w"] * rnd.randint(0, 60))) for i in range(n)]
    return rows + [(n, "tiny", "x y"), (n + 1, "void", None), (n + 2, "void", " \n"), (None, "b", "q q"), (7, "b", "same"), (7, "b", "same"),
                   (n + 3, "Z", "word " * 20000)]


@pytest.mark.parametrize("slots, bucket_rows", [(1 << 20, 4096), (300, 10), (40, 1000)])
def test_against_plain_mix(spark, slots, bucket_rows):
    rows = rows_of(200, slots)
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, source string, text string, taken string").repartition(3)
    out = M.mix(df, slots=slots, bucket_rows=bucket_rows)
    assert out.columns == ["doc_id", "source", "size", "source_size", "target", "taken"]
    got = sorted(((r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in out.collect()), key=str)
    want = plain_mix(rows)
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-6 for g, w in zip(got, want))
    assert all(g[4] <= 3 * g[1] for g in got)


def test_a_third_of_the_rows_without_an_id(spark):
    rows = rows_of(100, 5) + [(None, "a", "one two three")] * 60 + [(None, "a", f"w{k} " * (k % 7)) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(7)
    got = sorted(((r.doc_id, r["size"], r.source_size, r.taken) for r in M.mix(df, bucket_rows=16).collect()), key=str)
    assert got == [w[:3] + w[4:] for w in plain_mix(rows)]
    turns = df.where("doc_id is null").select(M.shuffle_key("doc_id", "text", 17).alias("t")).distinct().count()
    assert turns > 50  # texts without an id are shuffled as well


def test_every_stretch_of_the_schedule_is_near_the_shares(spark):
    plan = spark.createDataFrame([(0, 5000), (1, 0), (2, 1500), (3, 1), (4, 3499)], "sid int, need long")
    slots = M.schedule(plan, chunk=64).orderBy("slot").collect()
    assert len(slots) == 10000
    for sid, need in ((0, 5000), (2, 1500), (3, 1), (4, 3499)):
        assert sorted(r.k for r in slots if r.sid == sid) == list(range(need))
        for a in range(0, 9000, 1000):
            n = sum(r.sid == sid for r in slots[a:a + 1000])
            assert abs(n - need / 10) < 12


def test_empty_and_wordless_tables(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    assert M.mix(df).count() == 0
    df = spark.createDataFrame([(1, "a", None), (2, None, "")], "doc_id long, source string, text string")
    assert [(r["size"], r.target, r.taken) for r in M.mix(df).collect()] == [(0, 0.0, 0)] * 2


def test_reruns_agree(spark):
    sf = "/root/testdata/sf0.001"
    one, two = (M.op7_mixing(spark, sf).orderBy("doc_id").collect() for _ in range(2))
    assert one == two
    assert abs(sum(r.taken for r in one) - sum(r["size"] for r in one)) <= 20
    assert M.mix(spark.read.parquet(f"{sf}/documents.parquet").withColumn("source", F.lit("x"))).where("taken <> size").count() == 0
