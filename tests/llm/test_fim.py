import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from branchwise.llm import fim as M

TOKEN = re.compile("[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plainly(doc_id, text, seed=42):
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b, c = "".join(tokens[:lo]), "".join(tokens[lo:hi]), "".join(tokens[hi:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


def texts():
    rnd = random.Random(4)
    bits = ["word", " ", "  ", "\n", "\t", "\x0b", "\x0c", "é", "漢字", "👍🏽", "\xa0", " ", "\x1c", "<", "<P", ">", "S>", "x" * 400]
    out = ["".join(rnd.choices(bits, k=rnd.randint(0, 50))) for _ in range(400)]
    return out + [None, "", " ", "\n\n", "a", " a ", "a <P> b", "b <S>", "<M>", "<P", "q" * 200_000, "w " * 100_000, " é" * 50_000 + "\n",
                  ("long" * 500 + " s ") * 300]


def test_offsets_come_exactly_from_the_model_and_its_residuals():
    for t in texts():
        at = M.boundaries(t or "")
        assert at.tolist() == [0, *np.cumsum([len(x) for x in TOKEN.findall(t or "")]).tolist()]
        for error in (1, 7, M.ERROR):
            index = M.RankIndex(at, error)
            ranks = np.arange(len(at))
            assert (index.offset(ranks) == at).all()
            assert np.abs(at - index.predict(ranks)).max() <= error
    even = M.RankIndex(M.boundaries("word " * 10_000))
    assert len(even.starts) == 1  # one line holds what is regular


def test_against_a_plain_version(spark):
    rows = [(k if k % 9 else None, t, "x", 1) for k, t in enumerate(texts())] + [(3, "again and again", "y", 2)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, cut long").repartition(5)
    out = M.fill_in_middle(df)
    assert set(out.columns) == {"doc_id", "text", "cut", "n", "form", "output", "prefix_chars", "middle_chars", "segments", "residual"}
    got = out.withColumn("back", M.restore(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows) and {r.form for r in got} == {"plain", "spm", "psm"}
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plainly(r.doc_id, r.text)
        assert r.back == (r.text or "") and r.residual <= M.ERROR


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert M.fill_in_middle(df).count() == 0
