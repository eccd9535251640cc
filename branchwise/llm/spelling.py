"""Spelling variants by Bloom-guided neighbourhoods.

Runs of letters are counted over all texts (``vocabulary``): each task counts in a dictionary of bounded size, so a word that
fills a third of all texts is a few rows before the shuffle. Frequent enough words form the vocabulary.

Two words are near if one inserted, deleted or replaced code point turns one into the other (``near_pairs``). The vocabulary
is hashed into blocked Bloom filters, one for each word length (a shard): a word sets ``PROBES`` bits in each of two 64-bit blocks;
the second is looked at only where the first holds all its bits. The bits are gathered by block in a distributed sum and broadcast;
they take ``MAX_BLOCKS`` blocks at most (and one a length), however many words there are: more words only mean more false positives. Every word's edits are probed: its deletions in the shard of
the words shorter by one, its replacements in its own, by letters that the vocabulary has (at most 90). A hash is a
polynomial in the word's code points, so an edit's hash takes a few operations on the word's own, for long words too, and an
edit is spelled out only if its blocks hold all its bits. Insertions need no probe, they are the longer word's deletions, and of two
words that differ in a letter only the one with the smaller letter is probed. Positives are joined to the vocabulary
word by word, which removes the false ones; every true pair comes out once.

A word's form is its most frequent near word (ties: smallest in code-point order) if that is ``RATIO`` times as frequent at
least, so forms lead upwards and never in circles; ``roots`` follows them by pointer doubling over written tables.

Defined results: null and empty texts have no words. A null id hashes as an empty one. Repeated rows count each. Words may be of any
length. Empty tables give empty results. Other columns of the input are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from branchwise.llm.common import once, table, written

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
#: Of the runs of one text, one in so many loses a code point.
NOISE = 97
#: Bits a word sets in each of its two blocks; words for each block of 64 bits, and blocks at most (16 MB).
PROBES, PER_BLOCK, MAX_BLOCKS = 4, 2, 1 << 21
#: Words a task counts before it sends its counts on.
HELD = 1 << 18
#: Edits probed at once, and characters of positives sent on at once.
CHUNK, SENT = 1 << 18, 1 << 22

_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BASE = 0x9E3779B97F4A7C15


def vocabulary(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH,
               least_count: int = LEAST_COUNT, noise: int = NOISE) -> DataFrame:
    """word, n: lower-cased runs of letters, counted over all texts.

    Where ``noise`` divides the CRC-32 of ``<doc_id>:<run>`` the run's code point number CRC-32 % length is left out first.
    """
    run = re.compile(f"[{LETTERS}]+")

    def count(batches):
        sums: Counter[str] = Counter()

        def send():
            held = [w for w in sums if len(w) >= least_length]
            return pa.RecordBatch.from_pydict({"word": pa.array(held, pa.string()), "n": pa.array([sums[w] for w in held], pa.int64())})

        for batch in batches:
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not t:
                    continue
                own = Counter(run.findall(t.encode("utf-8", "surrogatepass").translate(_UPPER).decode("utf-8", "surrogatepass")))
                start = zlib.crc32(b"%s:" % (key or "").encode())
                for w, n in own.items():
                    if len(w) < least_length:
                        continue
                    h = zlib.crc32(w.encode(), start)
                    if h % noise == 0:
                        k = h % len(w)
                        w = w[:k] + w[k + 1:]
                    sums[w] += n
                if len(sums) >= HELD:
                    yield send()
                    sums.clear()
        yield send()

    docs = df.select(F.col(f"`{doc_id}`").cast("string").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))
    counted = docs.mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def powers(n: int) -> np.ndarray:
    """_BASE to the powers 0 to n."""
    store = once("spelling-powers", lambda: {"p": np.ones(1, np.uint64)})
    if len(store["p"]) <= n:
        more = np.full(2 * n + 1, _BASE, np.uint64)
        more[0] = 1
        store["p"] = np.multiply.accumulate(more)
    return store["p"]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads a polynomial's value over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def places(h: np.ndarray, first: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each hash in its shard, and the bits it sets there."""
    bits = np.zeros(len(h), np.uint64)
    for k in range(PROBES):
        bits |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
    return first + ((h >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64), bits


def held(h: np.ndarray, shard: tuple[int, int], blocks: np.ndarray) -> np.ndarray:
    """Places of the hashes that both their blocks hold."""
    at = np.arange(len(h))
    for _ in range(2):
        h = mixed(h)
        block, bits = places(h, *shard)
        found = blocks[block] & bits == bits
        at, h = at[found], h[found]
    return at


def points(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.uint64)


def polynomial(p: np.ndarray) -> np.ndarray:
    """Values of all prefixes, from the empty one to the whole; sums wrap around at 64 bits."""
    powers_ = powers(len(p))
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(p * powers_[:len(p)], dtype=np.uint64)))


def shards(lengths: dict[int, int], max_blocks: int = MAX_BLOCKS) -> dict[int, tuple[int, int]]:
    """length -> (first block, blocks) of its filter; lengths: words of each length."""
    total = sum(lengths.values())
    scale = min(1.0, max_blocks / max(1, total // PER_BLOCK + len(lengths)))
    out, at = {}, 0
    for n, k in sorted(lengths.items()):
        out[n] = (at, max(1, int(k / PER_BLOCK * scale)))
        at += out[n][1]
    return out


def filters(words: DataFrame, max_blocks: int = MAX_BLOCKS) -> tuple[dict[int, tuple[int, int]], np.ndarray, str]:
    """The shards, all their blocks, and the vocabulary's letters. Words of more lengths than ``max_blocks`` are an error."""
    lengths = {r[0]: r[1] for r in words.groupBy(F.char_length("word").alias("l")).count().collect()}
    if len(lengths) > max_blocks:
        raise ValueError("more word lengths than blocks")
    shard = shards(lengths, max_blocks)

    def hashed(batches):
        for batch in batches:
            found: dict[int, list[int]] = {}
            letters: set[str] = set()
            for w in batch.column(0).to_pylist():
                found.setdefault(len(w), []).append(int(polynomial(points(w))[-1]))
                letters.update(w)
            at, bit = [np.array([-1 - ord(c) for c in letters], np.int64)], [np.zeros(len(letters), np.uint64)]
            for n, values in found.items():
                h = np.array(values, np.uint64)
                for _ in range(2):
                    h = mixed(h)
                    block, bits = places(h, *shard[n])
                    at.append(block)
                    bit.append(bits)
            yield pa.RecordBatch.from_pydict({"block": np.concatenate(at), "bits": np.concatenate(bit).view(np.int64)})

    rows = words.select("word").mapInArrow(hashed, "block long, bits long").groupBy("block").agg(F.bit_or("bits").alias("bits"))
    rows = rows.toArrow()
    at, bits = rows.column("block").to_numpy(), rows.column("bits").to_numpy().view(np.uint64)
    out = np.zeros(sum(n for _, n in shard.values()), np.uint64)
    out[at[at >= 0]] = bits[at >= 0]
    return shard, out, "".join(sorted(chr(-1 - x) for x in at[at < 0]))


def positives(word: str, shard: dict[int, tuple[int, int]], blocks: np.ndarray, letters: np.ndarray):
    """Edits of ``word`` that the filters may hold."""
    p, n = points(word), len(word)
    value, base = polynomial(p), powers(n)
    if n - 1 in shard:
        own = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))  # of a run of one letter any deletion is the same word
        tail = value[n] - value[own + 1]
        for k in own[held(value[own] + tail * np.uint64(pow(_BASE, -1, 1 << 64)), shard[n - 1], blocks)].tolist():
            yield word[:k] + word[k + 1:]
    step = max(1, CHUNK // max(len(letters), 1))
    for at in range(0, n, step):
        old = p[at:at + step]
        k, c = np.nonzero(letters[None, :] > old[:, None])
        hit = held(value[n] + (letters[c] - old[k]) * base[at + k], shard[n], blocks)
        for i, x in zip((at + k[hit]).tolist(), letters[c[hit]].tolist(), strict=True):
            yield word[:i] + chr(x) + word[i + 1:]


def near_pairs(words: DataFrame, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """a, n_a, b, n_b: each pair of near words of the table (word, n) once."""
    shard, blocks, letters = filters(words, max_blocks)
    shared = words.sparkSession.sparkContext.broadcast((shard, blocks, letters))

    def probe(batches):
        shard_, blocks_, letters_ = shared.value
        codes = np.array([ord(c) for c in letters_], np.uint64)
        for batch in batches:
            left, counts, right, size = [], [], [], 0
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for edit in positives(w, shard_, blocks_, codes):
                    left.append(w)
                    counts.append(n)
                    right.append(edit)
                    size += len(edit)
                    if size >= SENT:
                        yield pa.RecordBatch.from_pydict({"a": left, "n_a": pa.array(counts, pa.int64()), "edit": right})
                        left, counts, right, size = [], [], [], 0
            yield pa.RecordBatch.from_pydict({"a": pa.array(left, pa.string()), "n_a": pa.array(counts, pa.int64()),
                                              "edit": pa.array(right, pa.string())})

    found = words.mapInArrow(probe, "a string, n_a long, edit string")
    known = words.select(F.col("word").alias("b"), F.col("n").alias("n_b"))
    return found.join(known, F.col("edit") == F.col("b")).select("a", "n_a", "b", "n_b")


def roots(forms: DataFrame) -> DataFrame:
    """word, root for each row (word, form) with a form; forms must not lead in circles."""
    step = written(forms.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(step.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        moved = step.where("moved").limit(1).count()
        step = step.select("word", "root")
        if not moved:
            return step


def variants(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
             ratio: float = RATIO, noise: int = NOISE, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary."""
    words = written(vocabulary(df, doc_id, text, least_length, least_count, noise), "spelling-words")
    pairs = written(near_pairs(words, max_blocks), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("n_b").alias("near_n"), F.col("b").alias("near")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("n_a").alias("near_n"), F.col("a").alias("near")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    judged = words.join(best, "word", "left")
    accepted = -F.col("best.m") >= ratio * F.col("n")
    judged = written(judged.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(accepted, F.col("best.near")).alias("form"),
                                   F.when(accepted, -F.col("best.m")).alias("form_n")), "spelling-forms")
    found = judged.join(roots(judged), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents").select("doc_id", "text"))
