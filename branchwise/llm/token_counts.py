"""Token counts: pieces are counted once per distinct pre-token and joined to frequencies.

A byte-level BPE tokenizer splits a text into pre-tokens by a pattern and merges inside each, so a
text's token count is the sum over its distinct pre-tokens of frequency times pieces; ids are never
made. Texts are split in the map tasks. The pre-tokens of a dictionary (the most frequent
``DICTIONARY`` ones of a sample of at most ``SAMPLE_ROWS`` documents, counted once and broadcast) are summed
there, which keeps hot words out of the shuffle; every other (document, pre-token, frequency) is
shuffled by pre-token, where its pieces are counted once in the task that has all its rows, and
the products go back to their documents as sums. The dictionary decides where a pre-token is counted, never
whether. The task that holds a pre-token's rows keeps at most ``CACHE`` counts.

A row is known by its partition and place there (its ``id`` may be null or repeated); the split runs
once per query, its output goes straight to the shuffle.

Special tokens of the file (``<|endoftext|>``) inside a text count as one token each and cut it, as the
library does by default; none are added.

Defined results: null texts count as empty: no bytes, no tokens. Repeated rows have a result each, null ids stay
null, an empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import unicodedata
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from branchwise.llm.common import once, table

SAMPLE_ROWS = 4000
DICTIONARY = 200_000
CACHE = 1_000_000
OVER = 1024
#: How GPT-2 style byte-level tokenizers cut a text. The white space of the library has no U+001C-001F.
_S = r"\t-\r\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
def pattern(letter: str, number: str, other: str) -> str:
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|[{_S}]+(?![^{_S}])|[{_S}]+"


def newer_letters(path: str) -> str:
    """Letters and numbers that ``regex`` knows and the tokenizer's own Unicode tables don't, as ranges.

    Asks the library for the code points that Python's tables have no category for; the tests compare
    all code points.
    """
    from tokenizers import Tokenizer

    pre = Tokenizer.from_file(path).pre_tokenizer
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    odd = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"
           and len(pre.pre_tokenize_str(f"a{c}1")) == 3]  # joined to neither the letter nor the number
    ranges: list[list[int]] = []
    for c in map(ord, odd):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in ranges)


class Pieces:
    """Counts the pieces of pre-tokens with the library; checks that the file is of the kind meant."""

    def __init__(self, path: str, newer: str):
        import json

        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True):
            raise ValueError(f"{path}: not a plain byte-level tokenizer")
        for t in spec["added_tokens"]:
            if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
                raise ValueError(f"{path}: added token {t}")
        self.model = Tokenizer.from_file(path).model
        self.letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.special = [t["content"] for t in spec["added_tokens"]]
        other = rf"[^{_S}\p{{L}}\p{{N}}]"
        self.split_plain = regex.compile(pattern(r"\p{L}", r"\p{N}", other)).findall
        self.newer = regex.compile(f"[{newer}]").search if newer else lambda text: None
        self.split_newer = regex.compile("(?V1)" + pattern(
            rf"[\p{{L}}--[{newer}]]", rf"[\p{{N}}--[{newer}]]", f"(?:{other}|[{newer}])")).findall if newer else None
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, longest_first))) if self.special else None
        self.known: dict[str, int] = {}

    def count(self, pre_token: str) -> int:
        n = self.known.get(pre_token)
        if n is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            n = self.known[pre_token] = len(self.model.tokenize(self.letters.pre_tokenize_str(pre_token)[0][0]))
        return n

    def split(self, text: str) -> list[str]:
        return (self.split_newer if self.newer(text) else self.split_plain)(text)

    def pre_tokens(self, text: str) -> tuple[Counter, int]:
        """Frequencies of the pre-tokens, and how many special tokens there are."""
        if self.cut is None or not any(s in text for s in self.special):
            return Counter(self.split(text)), 0
        out, parts = Counter(), self.cut.split(text)
        for part in parts:
            out.update(self.split(part))
        return out, len(parts) - 1


def dictionary(df: DataFrame, path: str, newer: str, sample_rows: int, size: int) -> dict[str, int]:
    """Pieces of the most frequent pre-tokens of a bounded sample of the texts."""
    rows = df.count()
    sample = df.sample(min(1.0, sample_rows / max(rows, 1)), 11).limit(2 * sample_rows)

    def split(batches):
        pieces = once(f"pieces {path}", lambda: Pieces(path, newer))
        for batch in batches:
            n = Counter()
            for t in batch.column(0).to_pylist():
                n.update(pieces.pre_tokens(t or "")[0])
            yield pa.RecordBatch.from_pydict({"p": pa.array(n.keys(), pa.string()), "n": pa.array(n.values(), pa.int64())})

    counts = sample.mapInArrow(split, "p string, n long").groupBy("p").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "p").limit(size).select("p")

    def count(batches):
        pieces = once(f"pieces {path}", lambda: Pieces(path, newer))
        for batch in batches:
            yield pa.RecordBatch.from_pydict(
                {"p": batch.column(0), "n": pa.array([pieces.count(p) for p in batch.column(0).to_pylist()], pa.int64())})

    found = top.mapInArrow(count, "p string, n long").toArrow()
    return dict(zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True))


def count_tokens(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text",
                 sample_rows: int = SAMPLE_ROWS, size: int = DICTIONARY) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row of ``df``."""
    spark, newer = df.sparkSession, newer_letters(path)
    texts = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    near = spark.sparkContext.broadcast(dictionary(texts.select("text"), path, newer, sample_rows, size))
    id_type = dict(texts.dtypes)["doc_id"]

    def split(batches):
        pieces, known = once(f"pieces {path}", lambda: Pieces(path, newer)), near.value
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, len(batch), 64):
                chunk = batch.slice(at, 64)
                rows, tokens, size_, rest_row, rest, times = [], [], [], [], [], []
                for t in chunk.column(1).to_pylist():
                    found, n = pieces.pre_tokens(t or "")
                    here = part << 40 | place
                    place += 1
                    for p, k in found.items():
                        if (m := known.get(p)) is None:
                            rest_row.append(here)
                            rest.append(p)
                            times.append(k)
                        else:
                            n += m * k
                    rows.append(here)
                    tokens.append(n)
                    size_.append(len((t or "").encode("utf-8", "surrogatepass")))
                none = len(rest)
                yield pa.RecordBatch.from_arrays([
                    pa.array(rows + rest_row, pa.int64()),
                    pa.concat_arrays([chunk.column(0), pa.nulls(none, chunk.column(0).type)]),
                    pa.array(size_ + [None] * none, pa.int64()), pa.array([None] * len(rows) + rest, pa.string()),
                    pa.array(tokens + times, pa.int64())], names=["row", "doc_id", "n_bytes", "piece", "n"])

    def price(batches):
        pieces = once(f"pieces {path}", lambda: Pieces(path, newer))
        for batch in batches:
            codes = batch.column("piece").dictionary_encode()  # null: a document's own row, its n is a sum already
            each = pa.array([pieces.count(p) for p in codes.dictionary.to_pylist()], pa.int64())
            n = pc.multiply(batch.column("n"), pc.fill_null(each.take(codes.indices), 1))
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(3)] + [n],
                                             names=["row", "doc_id", "n_bytes", "n"])

    kind = f"row long, doc_id {id_type}, n_bytes long"
    found = texts.mapInArrow(split, f"{kind}, piece string, n long")
    # a pre-token's rows meet in one task; documents' own rows go anywhere
    dealt = found.repartition(F.when(F.col("piece").isNull(), F.col("row")).otherwise(F.xxhash64("piece")))
    sums = dealt.mapInArrow(price, f"{kind}, n long")
    out = sums.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"),
                                  F.sum("n").alias("n_tokens"))
    return out.select("doc_id", "n_bytes", "n_tokens")


def op4_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    out = count_tokens(table(spark, sf_dir, "documents"), path)
    return out.withColumn("over_limit", F.col("n_tokens") > OVER)
