import random
import re

import pytest

from branchwise.llm import quality as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    seen = {}
    for i, w in enumerate(windows):
        seen.setdefault(w, []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))


def texts():
    rnd = random.Random(4)
    out = [None, "", " \n\x0b", "one", "a b c d e f g h", "a " * 8, "a " * 9, "x\n\nx\n x\nx", "é\x85ü #*$ |"]
    for _ in range(80):
        part = rnd.choices("abcd", k=rnd.randint(1, 12))
        out.append(rnd.choice([" ", "\n", "  "]).join(rnd.choices("abcdefgh", k=rnd.randint(0, 60)) + part * rnd.randint(1, 4)))
    return out + [" ".join(f"w{k % 997}" for k in range(60000))]


def test_measures_and_verdict_against_brute_force(spark):
    every = texts()
    df = spark.createDataFrame([(i % 90 or None, t, "clash") for i, t in enumerate(every)], "doc_id long, text string, kept string")
    order = [r for r, _, _ in Q.plan_cascade(df)]
    assert sorted(order) == sorted(Q.RULES)
    got = Q.judge(df, order, measures=Q.MEASURES).collect()
    for r in got:
        want = brute(r.text)
        assert tuple(r[m] for m in Q.MEASURES) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert r.kept == (not any(rule(Q.Text(r.text)) for rule in Q.RULES.values())) and not (r.kept and r.base_failed)
    assert len(got) == len(every)


def test_order_is_by_rejection_per_cost_and_changes_no_verdict(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, text string")
    plan = Q.plan_cascade(df)
    per_cost = [share / cost for _, cost, share in plan]
    assert per_cost == sorted(per_cost, reverse=True)
    names = list(Q.RULES)
    one, two = (sorted((r.doc_id, r.kept, r.rejected_by or "") for r in Q.judge(df, o).collect()) for o in (names, names[::-1]))
    assert one == two
    every = dict(enumerate(texts()))
    assert all(by == next((n for n in names if Q.RULES[n](Q.Text(every[i]))), "") for i, _, by in one)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert Q.judge(df, [r for r, _, _ in Q.plan_cascade(df)]).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query_and_labels(spark, sf):
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = Q.op9_quality(spark, sf).collect()
    assert len(got) == len(docs)
    assert all(tuple(r[m] for m in Q.MEASURES) == brute(docs[r.doc_id]) for r in got)
    good = [r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()]
    kept = {r.doc_id: r.kept or r.base_failed for r in got}
    assert sum(kept[d] for d in good) >= 0.97 * len(good)
