"""Fill-in-middle transformation with a learned rank index.

A text is cut into tokens, white space before a word belonging to it; n tokens have n + 1 boundaries, and a boundary's
rank is the number of tokens before it. For each text a piecewise-linear model of its boundary offsets is fitted:
a segment begins at a boundary and takes as many of the next ones as one slope through its beginning can meet within
``ERROR`` code points (``fit``: the cone of slopes that are still allowed narrows with each boundary; the first one that
empties it begins the next segment). What the prediction lacks is stored per rank, in one byte, so a cut is found by
finding its segment, predicting, and adding the residual (``RankIndex.offset``), which is exact. A text's index takes a byte
a token and three numbers a segment and lives while its row is worked on; nothing is shuffled, gathered or broadcast.

Two hashes of the seed and the id choose the two ranks to cut at, a third whether the text is left plain, a fourth
the order: ``psm`` is prefix, suffix, middle, ``spm`` suffix, prefix, middle, each with its mark before it. A text that holds a
mark stays plain, so a transformed one can always be taken apart (``restore``).

Defined results: null and empty texts are plain, with an empty output and 0 tokens; a text of white space is one token. A null id
hashes as an empty one. Repeated rows are transformed alike; texts may be of any length; empty tables give empty
results. Result columns replace input columns of the same name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from branchwise.llm.common import table

#: Marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Code points that a prediction may be off, at most; residuals are kept in one byte.
ERROR = 100
#: Boundaries that are added to a segment's cone at once.
STEP = 256


def boundaries(text: str) -> np.ndarray:
    """Offsets of all token boundaries, in code points, from 0 to the text's length."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    word = np.ones(len(points) + 1, bool)
    word[:-1] = (points != 0x20) & ((points < 0x09) | (points > 0x0D))
    word[-1] = False
    ends = np.flatnonzero(word[:-1] & ~word[1:]) + 1
    last = [len(points)] if len(points) and not word[-2] else []
    return np.concatenate(([0], ends, last)).astype(np.int64)


def fit(offsets: np.ndarray, error: int = ERROR) -> tuple[np.ndarray, np.ndarray]:
    """First ranks and slopes of segments that meet all offsets within ``error``."""
    starts, slopes = [], []
    at, n = 0, len(offsets)
    while at < n:
        low, high, upto = -np.inf, np.inf, at + 1
        while upto < n:
            run = np.arange(1, min(STEP, n - upto) + 1) + (upto - 1 - at)
            rise = offsets[upto:upto + len(run)] - offsets[at]
            lows = np.maximum(np.maximum.accumulate((rise - error) / run), low)
            highs = np.minimum(np.minimum.accumulate((rise + error) / run), high)
            fits = int(np.argmin(lows <= highs)) if lows[-1] > highs[-1] else len(run)
            if fits:
                low, high = lows[fits - 1], highs[fits - 1]
            upto += fits
            if fits < len(run):
                break
        starts.append(at)
        slopes.append((low + high) / 2 if upto > at + 1 else 0.0)
        at = upto
    return np.array(starts, np.int64), np.array(slopes)


class RankIndex:
    """Offset of the boundary of any rank: a segment's prediction plus the rank's stored residual."""

    def __init__(self, offsets: np.ndarray, error: int = ERROR):
        if not 0 < error < 127:
            raise ValueError("residuals are kept in one byte")
        self.starts, self.slopes = fit(offsets, error)
        self.bases = offsets[self.starts]
        ranks = np.arange(len(offsets))
        self.residuals = np.zeros(len(offsets), np.int8)
        self.residuals[:] = offsets - self.predict(ranks)

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.starts, ranks, "right") - 1
        return self.bases[k] + np.rint(self.slopes[k] * (ranks - self.starts[k])).astype(np.int64)

    def offset(self, ranks: np.ndarray) -> np.ndarray:
        return self.predict(ranks) + self.residuals[ranks]


def draw(doc_id: str, seed: int, k: int) -> Column:
    """The k-th of the row's hashes, as an unsigned number of 32 bits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def cuts(text: Column, first: Column, second: Column, error: int = ERROR) -> Column:
    """n (tokens), a, b (offsets of the two cuts in order), segments and residual (the largest) of each text."""
    kind = "n long, a long, b long, segments int, residual int"

    def judge(texts: pa.Array, first_: pa.Array, second_: pa.Array) -> pa.Array:
        rows = []
        for t, x, y in zip(texts, first_.to_pylist(), second_.to_pylist(), strict=True):  # one text at a time in memory
            at = boundaries(t.as_py() or "")
            n = len(at) - 1
            index = RankIndex(at, error)
            a, b = index.offset(np.sort([x % (n + 1), y % (n + 1)])).tolist()
            rows.append((n, a, b, len(index.starts), int(np.abs(index.residuals).max())))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        types = [pa.int64()] * 3 + [pa.int32()] * 2
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                          names=["n", "a", "b", "segments", "residual"])

    return F.arrow_udf(judge, kind)(text, first, second)


def fill_in_middle(df: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm_rate: int = 80,
                   error: int = ERROR) -> DataFrame:
    """The columns of ``df`` with n, form, output, prefix_chars and middle_chars, segments and residual of each text's index.

    ``rate`` percent of the texts are transformed, ``spm_rate`` percent of them as spm.
    """
    new = ["n", "form", "output", "prefix_chars", "middle_chars", "segments", "residual"]
    keep = [c for c in df.columns if c not in new]
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    out = df.select(*(F.col(f"`{c}`").alias(f"__{c}") for c in keep), whole.alias("text"),
                    *(draw(f"`{doc_id}`", seed, k).alias(f"h{k + 1}") for k in range(4)))
    out = out.withColumn("cut", cuts(F.col("text"), F.col("h1"), F.col("h2"), error))
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_rate, "spm").otherwise("psm")
    a, b = F.col("cut.a"), F.col("cut.b")
    part = lambda x, y: F.substring(F.col("text"), (x + 1).cast("int"), (y - x).cast("int"))
    head, middle, tail = part(F.lit(0), a), part(a, b), part(b, F.lit(2**31 - 1))
    out = out.withColumn("form", form)
    output = F.when(F.col("form") == "plain", F.col("text")).when(
        F.col("form") == "psm", F.concat(F.lit(PREFIX), head, F.lit(SUFFIX), tail, F.lit(MIDDLE), middle)).otherwise(
        F.concat(F.lit(SUFFIX), tail, F.lit(PREFIX), head, F.lit(MIDDLE), middle))
    changed = F.col("form") != "plain"
    return out.select(*(F.col(f"`__{c}`").alias(c) for c in keep), F.col("cut.n").alias("n"), "form", output.alias("output"),
                      F.when(changed, a).alias("prefix_chars"), F.when(changed, b - a).alias("middle_chars"),
                      F.col("cut.segments").alias("segments"), F.col("cut.residual").alias("residual"))


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of. No mark can arise where the parts meet, so the marks cut it apart."""
    after = lambda mark: F.split_part(output, F.lit(mark), F.lit(2))
    upto = lambda part, mark: F.split_part(part, F.lit(mark), F.lit(1))
    middle = after(MIDDLE)
    return F.when(form == "plain", output).when(
        form == "psm", F.concat(upto(after(PREFIX), SUFFIX), middle, upto(after(SUFFIX), MIDDLE))).otherwise(
        F.concat(upto(after(PREFIX), MIDDLE), middle, upto(after(SUFFIX), PREFIX)))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
     t AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens,
                  CAST(('0x' || substr(h, 1, 8)) AS UBIGINT) AS h1, CAST(('0x' || substr(h, 9, 8)) AS UBIGINT) AS h2,
                  CAST(('0x' || substr(h, 17, 8)) AS UBIGINT) AS h3, CAST(('0x' || substr(h, 25, 8)) AS UBIGINT) AS h4 FROM d),
     c AS (SELECT *, CAST(len(tokens) AS BIGINT) AS n, CAST(least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS BIGINT) AS lo,
                  CAST(greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS BIGINT) AS hi,
                  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                       WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
     p AS (SELECT doc_id, n, form, text, array_to_string(tokens[1:lo], '') AS a, array_to_string(tokens[lo + 1:hi], '') AS b,
                  array_to_string(tokens[hi + 1:], '') AS c FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(coalesce(a, '')) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(coalesce(b, '')) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', a, '<S>', c, '<M>', b) ELSE concat('<S>', c, '<P>', a, '<M>', b) END)
           AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""
