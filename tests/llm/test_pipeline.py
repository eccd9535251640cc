import os
import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as P  # noqa: E402
from branchwise.llm import decontaminate, langid, secret_scan, simhash  # noqa: E402
from branchwise.llm.common import written  # noqa: E402
from branchwise.session import ensure_checkpoint_dir  # noqa: E402

from test_mixing import plain_mix  # noqa: E402
from test_secret_scan import brute  # noqa: E402
from test_simhash import plain_components, plain_fingerprint  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def masked(text):
    out, at, runs = "", 0, []
    for s, _, _, e in brute(text):
        if runs and runs[-1][1] > s:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    for s, e in runs:
        out, at = out + text[at:s] + "[redacted]", e
    return out + text[at:]


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["language_id", "near_duplicates", "benchmark_decontamination", "secret_scans", "mixing_sources"]
    one = written(P.language_id(spark, docs, SF), "t")
    assert one.columns == COLUMNS
    have = {r.doc_id: r for r in docs.collect()}
    kept = {r.doc_id: r for r in one.collect()}
    assert kept == {d: r for d, r in have.items() if any(map(str.isalpha, r.text or ""))}

    two = written(P.near_duplicates(spark, one, SF), "t")
    ids = sorted(kept)
    root = plain_components([plain_fingerprint(kept[d].text) for d in ids])
    want = {ids[k]: kept[ids[k]] for k in set(root.tolist())}
    have = {r.doc_id: r for r in two.collect()}
    assert two.columns == COLUMNS and have == want and two.count() == len(want)

    three = written(P.benchmark_decontamination(spark, two, SF), "t")
    items = [b" ".join(decontaminate.words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {d: r for d, r in have.items() if not any(i in b" ".join(decontaminate.words(r.text)) for i in items)}
    have = {r.doc_id: r for r in three.collect()}
    assert three.columns == COLUMNS and have == want

    four = written(P.secret_scans(spark, three, SF), "t")
    got = {r.doc_id: r for r in four.collect()}
    assert four.columns == COLUMNS and got.keys() == have.keys()
    for d, r in got.items():
        assert r.text == masked(have[d].text) and (r.n_chars == len(r.text) or r.text == have[d].text)

    five = P.mixing_sources(spark, four, SF)
    assert five.columns == [*COLUMNS, "size", "source_size", "target", "taken"]
    rows = sorted(((r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in five.collect()), key=str)
    want = plain_mix([(r.doc_id, r.source, r.text) for r in got.values()])
    assert [r[:3] + r[4:] for r in rows] == [w[:3] + w[4:] for w in want]


def test_nulls_repeated_rows_clashing_columns_and_empty_tables(spark):
    en = "the cat and the dog were running over the hill with that other thing of theirs on a day that was long "
    key = "password=abcdefgh"
    rows = [(1, en, "en", "s", 5, "x"), (1, en, "en", "s", 5, "x"), (2, en, "en", None, 5, None), (3, None, "en", "s", None, "x"),
            (4, "", None, "s", 0, "x"), (5, "1 2 3", "en", "s", 5, "x"), (None, en, "en", "t", 5, "x"), (None, "der hund und die katze", "de", "t", 5, "x"),
            (None, "der hund und die katze", "de", "t", 5, "x"), (9, f"der mann sagt {key} und geht nach hause", "de", "t", 40, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size string"
    docs = spark.createDataFrame(rows, schema).withColumnRenamed("size", "component_id").repartition(3)
    out = docs
    for _, stage in P.STAGES[:4]:
        out = written(stage(spark, out, SF), "t")
        assert out.columns == docs.columns
    got = {(r.doc_id, r.text) for r in out.collect()}
    assert out.count() == 3
    assert got == {(1, en), (None, "der hund und die katze"), (9, "der mann sagt [redacted] und geht nach hause")}
    last = P.mixing_sources(spark, out, SF)
    assert last.count() == 3 and set(docs.columns) < set(last.columns)
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0


def test_run_leaves_only_its_result(spark):
    root = ensure_checkpoint_dir(spark)
    before = set(os.listdir(root))
    out = P.run(spark, SF)
    new = set(os.listdir(root)) - before
    assert len(new) == 1 and "mixing_sources" in new.pop() and out.count() > 50


def test_a_leak_takes_no_other_rows_of_its_id(spark):
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").head().text
    rows = [(None, f"before it {leak} after it"), (None, "the clean row has no id"), (1, "a clean row with an id"), (1, leak), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = P.benchmark_decontamination(spark, docs, SF)
    assert got.columns == docs.columns and {tuple(r) for r in got.collect()} == {rows[1], rows[2], rows[4]}


def test_decontamination_looks_at_no_sample(spark, monkeypatch):
    def cut(*a, **k):
        raise AssertionError("part of the documents")

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    monkeypatch.setattr(type(docs), "sample", cut)
    assert 0 < P.benchmark_decontamination(spark, docs, SF).count() < docs.count()


def test_decontamination_learns_from_every_document(spark, monkeypatch):
    rnd, seen, model = random.Random(9), [], decontaminate._model
    texts = [" ".join(rnd.choices([f"w{k}" for k in range(30)], k=rnd.choice([0, 3, 40, 70]))) for _ in range(4000)]
    for k, d in enumerate((0, 1777, 3111, 3999)):  # a word of its own in the first, the last and two other documents
        texts[d] = " ".join([f"rare{k}"] * 5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    monkeypatch.setattr(decontaminate, "_model", lambda items, *a: seen.append(a[:3]) or model(items, *a))
    assert P.benchmark_decontamination(spark, docs, SF).count() == len(texts)
    (corpus, frequency, idf), = seen
    found = [decontaminate.features(decontaminate.hashes(t)) for t in texts]
    used = np.unique(np.concatenate(found))
    there = np.array([np.isin(used, f) for f in found])
    assert len(used) == 34 and frequency[used].tolist() == there.sum(axis=0).tolist() and frequency.sum() == there.sum()
    passages = [f[a:a + decontaminate.WINDOW] for f in found for a in range(0, len(f), decontaminate.WINDOW)]
    x = np.array([(f[:, None] == used).sum(axis=0) * idf[used] for f in passages])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = x.T @ x * decontaminate.CORPUS_ROWS / len(texts)
    assert np.allclose(corpus[used] @ corpus[used].T, want, atol=0.01 * want.diagonal().min())
    assert not np.delete(corpus, used, axis=0).any()


def test_every_group_keeps_one_row_whatever_the_ids(spark):
    a, b, c = (" ".join(f"{w}{k}" for k in range(60)) for w in ("apple", "brick", "cloud"))
    rows = [(1, a, "x"), (1, b, "x"), (0, b, "y"), (0, b, "x"), (None, b, "a"), (None, c, "z"), (None, c, "y"), (1, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = P.near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=str) == sorted(
        [(1, a, "x"), (0, b, "x"), (None, c, "y"), (1, None, "x")], key=str)


def test_unlearned_scripts_and_noise_go(spark):
    rnd = random.Random(5)
    scripts = {"greek": (0x3B1, 0x3C9), "cyrillic": (0x430, 0x44F), "cjk": (0x4E00, 0x9FA5), "hangul": (0xAC00, 0xD7A3), "arabic": (0x627, 0x64A)}
    text = lambda letters: " ".join("".join(rnd.choices(letters, k=rnd.randint(2, 9))) for _ in range(60))
    noise = [text([chr(c) for c in range(a, z + 1)]) for a, z in scripts.values() for _ in range(20)]
    noise += [text("bcdfghjklmnpqrstvwxz") for _ in range(20)] + [text("0123456789") + " a" for _ in range(20)]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    extra = spark.createDataFrame([(-1 - k, t, None) for k, t in enumerate(noise)], docs.schema)
    got = {r.doc_id: r.text for r in P.language_id(spark, docs.unionByName(extra), SF).collect()}
    clean = {r.doc_id for r in docs.where(langid.held_out()).collect() if any(map(str.isalpha, r.text or ""))}
    assert [noise[-1 - d] for d in got if d < 0] == []
    assert len(clean - got.keys()) <= 0.01 * len(clean)


@pytest.mark.parametrize("module", [langid, simhash, decontaminate, secret_scan])
def test_stage_operators_say_what_edge_cases_give(module):
    assert "Defined results" in module.__doc__
