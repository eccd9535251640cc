"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 (``DIM`` entries, drawn from a fixed seed). A trigram
binds its letters by multiplying their vectors, each rolled by its place, so ``abc`` and ``cba``
differ. A text bundles (adds) the vectors of its trigrams; a language's prototype bundles all its
training texts. A document goes to the language whose prototype has the largest cosine.

Letters are the lower-cased Unicode letters; the 26 of ASCII have slots of their own, the others
share ``SLOTS - 27`` slots by a hash of their code point. Each run of anything else is one space, and
texts begin and end with one.

Bundling is a sum, so training is one pass: each task adds its texts' vectors per language and
sends one row per language and block of dimensions; only prototypes (``DIM`` numbers per
language, at most ``MAX_LANGS``) come to the driver and are broadcast. Texts are read whole.

Defined results: a text that is null, empty or has no letter is ``und`` with score 0; without any
labelled text everything is ``und`` with score 0; of equal cosines the first language in code point
order wins; the score is the cosine, 0 where negative. Rows whose label is null teach nothing.
Repeated rows count as often as they occur, null ids are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from branchwise.llm.common import once, table

DIM = 1024
SLOTS = 64
MAX_LANGS = 2000
#: Four standard deviations of the cosine of unlike vectors; fewer labelled rows than this say little of a language's spread.
NOISE, FEW = 4 / DIM**0.5, 100
#: Code points worked on at once, so that a task's memory doesn't depend on a text's length.
CHUNK = 1 << 18


def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letter vectors, rolled for the first, second and third place; int8."""
    v = np.random.default_rng(20240229).integers(0, 2, (SLOTS, DIM), dtype=np.int8) * 2 - 1
    return np.roll(v, 2, axis=1), np.roll(v, 1, axis=1), v


def _slots() -> np.ndarray:
    """Slot of every code point; 0 for what is no letter."""
    points = range(0x110000)
    is_letter = np.fromiter((chr(c).isalpha() for c in points), bool, len(points))
    hashed = 27 + (np.arange(0x110000, dtype=np.uint64) * 2654435761 % 2**32 >> 16) % (SLOTS - 27)
    out = np.where(is_letter, hashed, 0).astype(np.int32)
    out[ord("a"):ord("z") + 1] = np.arange(1, 27)
    return out


def codes(text: str) -> np.ndarray:
    """Slots of the letters of a text, with one 0 for each run of other characters and at both ends."""
    s = once("letter slots", _slots)[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    s = np.concatenate(([0], s, [0])).astype(np.int32)
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] > 0) | (s[:-1] > 0)
    return s[keep]


def bundle(codes_: np.ndarray) -> np.ndarray:
    """Sum of the vectors of all trigrams of a coded text; float64, whole numbers."""
    total = np.zeros(DIM)
    first, second, third = once("letter vectors", _letters)
    for at in range(0, max(len(codes_) - 2, 0), CHUNK):
        c = codes_[at:at + CHUNK + 2]
        within = (c[1:-1] > 0) | ((c[:-2] > 0) & (c[2:] > 0))  # two spaces in a row are a seam between texts
        grams, n = np.unique(((c[:-2] * SLOTS + c[1:-1]) * SLOTS + c[2:])[within], return_counts=True)
        for k in range(0, len(grams), 4096):
            g, m = grams[k:k + 4096], n[k:k + 4096].astype(np.float32)
            bound = first[g // SLOTS**2] * second[g // SLOTS % SLOTS] * third[g % SLOTS]
            total += m @ bound.astype(np.float32)
    return total


def train(df: DataFrame, text: str = "text", label: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes, from every row of ``df`` with a label and letters."""

    def partial(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            for t, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if t and (c := codes(t)).any():
                    by.setdefault(lang, []).append(c)
            for lang, texts in by.items():  # the spaces at both ends keep texts apart, ``bundle`` leaves the seams out
                sums[lang] = sums.get(lang, 0) + bundle(np.concatenate(texts))
            if len(sums) > MAX_LANGS:
                yield from send(sums)
                sums = {}
        yield from send(sums)

    def send(sums):
        if sums:
            yield pa.RecordBatch.from_pydict({
                "lang": [x for x in sums for _ in range(DIM)], "dim": np.tile(np.arange(DIM, dtype=np.int32), len(sums)),
                "v": np.concatenate(list(sums.values()))})

    known = df.where(F.col(label).isNotNull()).select(F.col(text).cast("string"), F.col(label).cast("string"))
    sums = known.mapInArrow(partial, "lang string, dim int, v double").groupBy("lang", "dim").agg(F.sum("v").alias("v"))
    rows = (sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("dim", "v"))).alias("p"))
            .select("lang", F.col("p.v").alias("p")).orderBy("lang").limit(MAX_LANGS + 1).collect())
    if len(rows) > MAX_LANGS:
        raise ValueError(f"over {MAX_LANGS} labels; prototypes are broadcast and need a bound")
    return [r.lang for r in rows], np.array([r.p for r in rows]).reshape(len(rows), DIM)


def identify(df: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text",
             pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the predicted language and its cosine to every row."""
    langs, protos = model
    norms = np.linalg.norm(protos, axis=1, keepdims=True)
    unit = protos / np.where(norms > 0, norms, 1)

    def predict(t: str | None) -> tuple[str, float]:
        if not t or not langs or not (c := codes(t)).any():
            return "und", 0.0
        v = bundle(c)
        cos = unit @ v / (np.linalg.norm(v) or 1)
        best = int(cos.argmax())
        return langs[best], float(min(max(cos[best], 0.0), 1.0))

    def judge(texts):
        import pandas as pd

        return pd.DataFrame([predict(t) for t in texts], columns=["pred", "score"])

    judged = F.pandas_udf(judge, "pred string, score double")(F.col(text).cast("string"))
    keep = [F.col(f"`{c}`") for c in df.columns if c not in (pred, score)]
    return (df.select(*keep, judged.alias("__lang"))
            .select(*keep, F.col("__lang.pred").alias(pred), F.col("__lang.score").alias(score)))


def floors(judged: DataFrame, label: str = "lang", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """__lang and __floor, the least score of a text in it: half of the lowest hundredth's among the labelled rows judged right.

    A language of fewer than ``FEW`` such rows, which mostly judge themselves, has no more than the ``NOISE`` of unlike texts.
    At most ``MAX_LANGS`` rows.
    """
    half = F.percentile_approx(score, 0.01, 10000) / 2
    floor = F.when(F.count("*") < FEW, F.least(half, F.lit(NOISE))).otherwise(half)
    right = judged.where(F.col(label).cast("string") == F.col(pred))
    return right.groupBy(F.col(pred).alias("__lang")).agg(floor.alias("__floor"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()).select("text", "lang"))
    out = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify(out, model).select("doc_id", "held_out", "lang_pred", "score")
