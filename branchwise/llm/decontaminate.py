"""Benchmark decontamination by latent semantic retrieval.

Passages (windows of ``WINDOW`` words, one every ``STEP``) are TF-IDF vectors over hashed words. The corpus' leading directions come from
a randomised decomposition of the Gram matrix of the passages (windows side by side) of all documents: a random start matrix is multiplied by it, as sums over
partitions, and the product gives the directions by Nystroem's formula (``directions``). The benchmark's items are dealt into blocks, and each
block's basis spans the leading directions of its items, which weigh more, and of the corpus, whose passages together weigh as those
of ``CORPUS_ROWS`` documents on the average (``block_basis``). Document frequencies count all documents. Then every passage of every document is
projected and compared with every benchmark item by cosine; the benchmark is the stated query set. A passage is a candidate for an item if enough of it lies along the item,
as a share of its own length and relative to what the basis holds of the item, and enough of its projection.

Items of fewer than ``SHORT`` words are a small part of any passage, and of an item that its basis holds less than ``HELD`` of, a
cosine says little: only for these an index of their rarest words (``Anchors``) names every passage that can pass the check.

Candidates are checked on the words around the passage: the longest common subsequence with the item, as a share of the latter,
must reach ``VERBATIM``, or ``PARAPHRASE`` where the answer's words are found in order as well (the ``answer`` column, else the
item's last sentence). Items of over ``LONGEST`` words are cut into passages of about that many; a document matches if one passage does. The
answer of such a part is the ``answer`` column, else the last sentence that ends in it.

A word is known by a 64-bit hash of its letters, worked out for all of a text at once. The bases and the items of ``GROUP`` blocks
are broadcast at a time as plain arrays (``FEATURES`` by ``RANK`` numbers a block, 33 MB at most); a larger benchmark takes several
passes over the documents, which are scanned where they lie, whole and in pieces of bounded size. Nothing but findings is shuffled. At most
``MAX_ITEMS`` items of ``MAX_CHARS`` characters come to the driver; more is an error, to be split into several runs.

Defined results: null and empty texts match nothing. Items that are null, or of fewer than ``LEAST`` words,
can't be told from chance and match nothing. Repeated benchmark items match alike, once per item id; repeated document ids
have one row per item. Rows without an id are scanned and reported with a null id. Empty tables give empty
results.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from branchwise.llm.common import once, table

FEATURES = 1 << 14
RANK = 64
#: Items of a block, and blocks worked on at once.
BLOCK, GROUP = 56, 8
WINDOW, STEP = 32, 16
#: The passages of all documents are added up, none is left out; their sum weighs at most as much as those of so many.
CORPUS_ROWS = 1500
ITEM_WEIGHT = 100.0
#: A candidate's least cosine in the latent space, and the least share of its own length that lies along the item.
COSINE, ALONG = 0.3, 0.25
#: Items of fewer words, or of which a basis holds a smaller share, are looked up in the index.
SHORT, HELD = 16, 0.8
VERBATIM, PARAPHRASE, ANSWER = 0.8, 0.6, 0.75
LEAST, LONGEST = 5, 96
MAX_ITEMS, MAX_CHARS = 20_000, 20_000_000
#: Words of a document projected at once, words looked up in the index at once, bytes hashed at once, and words multiplied at once.
CHUNK, LOOKUP, BYTES, TOGETHER = 1 << 14, 1 << 13, 1 << 20, 1 << 17

_ENDS = re.compile(r"(?<=[.!?])\s+")
#: ASCII punctuation and white space part words.
_PART = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
_BASE = 0x9E3779B97F4A7C15


def parted(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass").translate(_PART)


def words(text: str | None) -> list[bytes]:
    return parted(text).split() if text else []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE to the powers 0 to n, and their inverses; products wrap around at 64 bits."""
    store = once("decontaminate-powers", dict)
    if len(store.get("up", ())) <= n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            row = np.full(n + 1, base, np.uint64)
            row[0] = 1
            store[name] = np.multiply.accumulate(row)
    return store["up"], store["down"]


def _hashed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and hashes of the runs of anything but blanks: a polynomial in their bytes, mixed."""
    up, down = _powers(max(len(data), BYTES))
    word = np.zeros(len(data) + 2, bool)
    np.not_equal(data, 32, out=word[1:-1])
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data * up[:len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return starts, h ^ (h >> np.uint64(31))


def hashes(text: str | None) -> np.ndarray:
    """A hash of each of ``words(text)``."""
    if not text:
        return np.zeros(0, np.uint64)
    data = parted(text)
    parts, at = [], 0
    while at < len(data):
        end = data.rfind(b" ", at, at + BYTES) if at + BYTES < len(data) else len(data)
        if end < at:  # one word longer than a piece
            end = data.find(b" ", at + BYTES)
            end = len(data) if end < 0 else end
        parts.append(_hashed(np.frombuffer(data, np.uint8, max(end - at, 1), at))[1])
        at = max(end, at + 1)
    return np.concatenate(parts)


def hashes_of(texts: pa.Array, together: int = 1 << 17):
    """``hashes`` of each text, short texts hashed together; about ``together`` bytes of texts are in memory at once."""
    held: list[bytes] = []

    def send():
        if held:
            ends = np.cumsum([len(d) + 1 for d in held])
            starts, h = _hashed(np.frombuffer(b" ".join(held), np.uint8))
            yield from np.split(h, np.searchsorted(starts, ends[:-1]))
            held.clear()

    size = 0
    for t in texts:
        text = t.as_py() or ""
        if len(text) > together:
            yield from send()
            yield hashes(text)
            size = 0
            continue
        held.append(parted(text))
        size += len(held[-1])
        if size > together:
            yield from send()
            size = 0
    yield from send()


def features(hashed: np.ndarray) -> np.ndarray:
    return (hashed & np.uint64(FEATURES - 1)).astype(np.int64)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each feature, and documents; over all rows."""
    def count(batches):
        n, there = np.zeros(FEATURES + 1, np.int64), np.zeros(FEATURES, bool)
        for batch in batches:
            for found in hashes_of(batch.column(0)):
                there[features(found)] = True
                n[:-1] += there
                n[FEATURES] += 1
                there[:] = False
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"f": at.astype(np.int32), "n": n[at]})

    sums = texts.mapInArrow(count, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(FEATURES + 1, np.int64)
    out[sums.column("f").to_numpy()] = sums.column("n").to_numpy()
    return out[:-1], int(out[-1])


def padded(parts: Sequence[np.ndarray], width: int) -> np.ndarray:
    """Features cut into rows of ``width``; each part's last row is filled with FEATURES."""
    rows = [-(-len(f) // width) for f in parts]
    out = np.full((sum(rows), width), FEATURES, np.int64)
    flat, at = out.ravel(), 0
    for f, n in zip(parts, rows):
        flat[at:at + len(f)] = f
        at += n * width
    return out


def windows(batch: pa.RecordBatch):
    """(passages, weights) of all texts of a batch, some at a time."""
    held, size = [], 0
    for found in hashes_of(batch.column(0)):
        f = features(found)
        for at in range(0, len(f), TOGETHER):
            held.append(f[at:at + TOGETHER])
            size += len(held[-1])
            if size >= TOGETHER:
                rows = padded(held, WINDOW)
                yield rows, np.ones(len(rows))
                held, size = [], 0
    if held:
        rows = padded(held, WINDOW)
        yield rows, np.ones(len(rows))


def listed(batch: pa.RecordBatch):
    """(passages, weights) of a batch of f array<int>, weight double."""
    for at in range(0, len(batch), 1024):
        part = batch.slice(at, 1024)
        f = [np.asarray(x, np.int64) for x in part.column("f").to_pylist()]
        if width := max(map(len, f)):
            own = np.array([len(x) > 0 for x in f])
            yield padded(f, width), part.column("weight").to_numpy(zero_copy_only=False)[own]


def gram_product(rows: DataFrame, cut, basis: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The Gram matrix of all passages that ``cut`` makes of the rows' batches, times ``basis``. A passage's length is its weight.

    Each task adds up its own passages; the sums are dealt by feature and added there.
    """
    rank = basis.shape[1]
    project = np.vstack([basis * idf[:, None], np.zeros((1, rank))]).astype(np.float32)
    shared = rows.sparkSession.sparkContext.broadcast((project, np.append(idf, 0)))

    def multiply(batches):
        project, weights = shared.value
        out = None
        for batch in batches:
            for f, weight in cut(batch):
                out = np.zeros((rank, FEATURES + 1)) if out is None else out
                inside = np.sort(f, axis=1)
                before = np.zeros(f.shape, np.int64)  # how often the word stood in the passage
                for k in range(1, f.shape[1]):
                    before[:, k] = np.where(inside[:, k] == inside[:, k - 1], before[:, k - 1] + 1, 0)
                square = ((2 * before + 1) * (weights**2)[inside]).sum(axis=1)
                y, part = project[f[:, 0]], np.empty((len(f), rank), np.float32)
                for k in range(1, f.shape[1]):
                    y += np.take(project, f[:, k], axis=0, out=part, mode="clip")
                y = (y * (weight**2 / np.maximum(square, 1e-30))[:, None]).T
                flat = f.ravel()
                for k in range(rank):
                    out[k] += np.bincount(flat, np.repeat(y[k], f.shape[1]), FEATURES + 1)
        if out is not None:
            at = np.flatnonzero(out[:, :-1].any(axis=0))
            values = pa.array((out[:, at] * weights[at]).T.astype(np.float32).ravel())
            values = pa.FixedSizeListArray.from_arrays(values, rank).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), values], names=["f", "v"])

    def add(batches):
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            f, v = batch.column("f").to_numpy(), batch.column("v").flatten().to_numpy().reshape(-1, rank)
            order = np.argsort(f, kind="stable")
            first = np.flatnonzero(np.diff(f[order], prepend=-1))
            for at, x in zip(f[order][first].tolist(), np.add.reduceat(v[order], first, axis=0, dtype=np.float64)):
                out[at] = out[at] + x if at in out else x
        if out:
            values = pa.FixedSizeListArray.from_arrays(pa.array(np.stack([*out.values()]).astype(np.float32).ravel()), rank).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array([*out], pa.int32()), values], names=["f", "v"])

    sums = rows.mapInArrow(multiply, "f int, v array<float>").repartition("f").mapInArrow(add, "f int, v array<float>").toArrow()
    shared.destroy()  # its files go from the driver and the executors; a lost task is done by now
    out = np.zeros((FEATURES, rank))
    for batch in sums.to_batches():
        out[batch.column("f").to_numpy()] = batch.column("v").flatten().to_numpy().reshape(-1, rank)
    return out


def _start(rank: int, seed: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((FEATURES, rank)))[0]


def fit_basis(passages: DataFrame, idf: np.ndarray, rank: int = RANK, passes: int = 1, seed: int = 1) -> np.ndarray:
    """Orthonormal columns that span the leading directions of the passages: f array<int>, weight double."""
    basis = _start(rank, seed)
    for _ in range(passes):
        basis = np.linalg.qr(gram_product(passages, listed, basis, idf))[0]
    return basis


def directions(rows: DataFrame, cut, idf: np.ndarray, rank: int = RANK, seed: int = 1) -> np.ndarray:
    """FEATURES by ``rank``: columns whose outer products add up to the Gram matrix of all passages, as far as these hold it.

    One pass over the rows: with a start S and the product Y = G S, G is nearly Y (S' Y)^-1 Y' (Nystroem).
    """
    start = _start(rank, seed)
    y = gram_product(rows, cut, start, idf)
    core = start.T @ y
    w, v = np.linalg.eigh((core + core.T) / 2)
    held = w > 1e-6 * max(w[-1], 1e-30)
    out = np.zeros((FEATURES, rank))
    out[:, held] = y @ (v[:, held] / np.sqrt(w[held]))
    return out


def block_basis(found: Sequence[np.ndarray], corpus: np.ndarray, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """The leading directions of a block's items (the features of each) and of the corpus; zero columns where there are fewer."""
    rows = np.zeros((len(found) + corpus.shape[1], FEATURES))
    for row, f in zip(rows, found):
        at, n = np.unique(f, return_counts=True)
        row[at] = n * idf[at]
        row *= ITEM_WEIGHT / (np.linalg.norm(row) or 1)
    rows[len(found):] = corpus.T
    w, u = np.linalg.eigh(rows @ rows.T)
    held = np.flatnonzero(w > 1e-10 * max(w[-1], 1e-30))[-rank:]
    out = np.zeros((FEATURES, rank))
    out[:, :len(held)] = rows.T @ (u[:, held] / np.sqrt(w[held]))
    return out


class Item:
    """A benchmark passage: bit masks of its words' places, for subsequences of whole words."""

    def __init__(self, item_id, found: Sequence, answer: Sequence):
        self.id, self.n, self.masks = item_id, len(found), masks_of(found)
        self.n_answer, self.answer = len(answer), masks_of(answer)
        self.times = Counter(found)
        self.known = frozenset(found)

    def at_most(self, text: Iterable) -> int:
        """No subsequence with ``text`` is longer: the item's words that occur there at all."""
        return sum(map(self.times.__getitem__, self.known.intersection(text)))


def least_common(n: int, answered: bool) -> int:
    """Words in order that an item of n words must share with a text."""
    return math.ceil((PARAPHRASE if answered else VERBATIM) * n - 1e-9)


class Anchors:
    """Index of the items' rarest words, by hash.

    A passage with ``least`` of an item's n words in order holds at least least - (n - a) of the a rarest: the others are n - a.
    a is chosen so that this is a tenth of the item, once at least. No passage that can pass the check lacks them.
    """

    def __init__(self, items: Sequence[tuple[int, np.ndarray, bool]], frequency: np.ndarray):
        """items: each one's place in the list of all, its words' hashes, whether it has an answer."""
        pairs: list[tuple[int, int]] = []
        self.place = np.array([k for k, _, _ in items], np.int64)
        self.need, self.span = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
        for k, (_, found, answered) in enumerate(items):
            n, least, taken = len(found), least_common(len(found), answered), 0
            times = Counter(found.tolist())
            for w in sorted(times, key=lambda w: (frequency[w & (FEATURES - 1)], w)):
                if taken >= n - least + max(1, n // 10):
                    break
                taken += times[w]
                pairs.append((w, k))
            self.need[k], self.span[k] = least - (n - taken), WINDOW + 2 * n
        pairs.sort()
        self.words, counts = np.unique(np.array([w for w, _ in pairs], np.uint64), return_counts=True)
        self.items = np.array([k for _, k in pairs], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)

    def arrays(self) -> tuple:
        return self.place, self.need, self.span, self.words, self.items, self.starts


def anchored(index: tuple, found: np.ndarray):
    """(item's place, word's place): enough anchors of the item stand in a span that begins there."""
    places, need, span, known, items, starts = index
    if not len(known):
        return
    reach = int(span.max())
    for base in range(0, len(found), LOOKUP):
        piece = found[base:base + LOOKUP + reach]
        row = np.minimum(np.searchsorted(known, piece), len(known) - 1)
        at = np.flatnonzero(known[row] == piece)
        if not len(at):
            continue
        row = row[at]
        n = starts[row + 1] - starts[row]
        k = items[np.repeat(starts[row] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        wide = len(piece) + reach + 1
        key = np.sort(k * wide + np.repeat(at, n))
        k, a = key // wide, key % wide
        enough = (np.searchsorted(key, key + span[k]) - np.arange(len(key)) >= need[k]) & (a < LOOKUP)
        yield from zip(places[k[enough]].tolist(), (a[enough] + base).tolist())


def masks_of(found: Sequence) -> dict:
    out: dict = {}
    for k, w in enumerate(found):
        out[w] = out.get(w, 0) | 1 << k
    return out


def common_subsequence(masks: dict, n: int, text: Iterable) -> int:
    """Length of the longest common subsequence; the bits of one integer are a row of the table."""
    row = full = (1 << n) - 1
    for w in text:
        if m := masks.get(w):
            hit = row & m
            row = (row + hit | row - hit) & full
    return n - row.bit_count()


def read_items(benchmark: DataFrame, item_id: str, text: str, answer: str | None) -> list[tuple]:
    """(id, hashes of the words, hashes of the answer's) of each item or part of one."""
    size = benchmark.agg(F.count("*"), F.coalesce(F.sum(F.length(text)), F.lit(0))).first()
    if size[0] > MAX_ITEMS or size[1] > MAX_CHARS:
        raise ValueError(f"{size[0]} items, {size[1]} characters: over the bound of what the driver holds; run parts of the benchmark")
    out = []
    columns = [F.col(f"`{item_id}`").alias("i"), F.col(f"`{text}`").alias("t"), (F.col(f"`{answer}`") if answer else F.lit(None)).alias("a")]
    for r in benchmark.select(*columns).distinct().collect():
        found = hashes(r.t)
        if len(found) < LEAST:
            continue
        ends = np.cumsum([len(words(s)) for s in _ENDS.split(r.t.strip())]).tolist()  # of its sentences
        parts = max(1, round(len(found) / LONGEST))
        cuts = [len(found) * k // parts for k in range(parts + 1)]
        for a, z in zip(cuts, cuts[1:]):
            said = hashes(r.a) if answer and r.a else np.zeros(0, np.uint64)
            if not len(said) and (within := [e for e in ends if a < e <= z]):
                before = max((e for e in ends if e < within[-1]), default=0)
                said = found[max(before, a):within[-1]]
            out.append((r.i, found[a:z], said))
    return sorted(out, key=lambda x: (str(x[0]), x[1].tolist()))


def find_leaks(df: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
               item_text: str = "text", answer: str | None = None, cosine: float = COSINE,
               short: int = SHORT, held: float = HELD) -> DataFrame:
    """doc_id, item_id, cosine, common (share of the item found in order) and answered, for each leak."""
    docs = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    items = read_items(benchmark, item_id, item_text, answer)
    kind = f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {benchmark.schema[item_id].dataType.simpleString()}"
    frequency, n = document_frequencies(docs.select("text"))
    idf = np.log((1 + n) / (1 + frequency)) + 1e-3

    corpus = directions(docs.select("text"), windows, idf) * math.sqrt(min(1.0, CORPUS_ROWS / max(n, 1)))
    found = None
    for at in range(0, max(len(items), 1), BLOCK * GROUP):
        part = _search(docs, items[at:at + BLOCK * GROUP], corpus, frequency, idf, kind, cosine, short, held)
        found = part if found is None else found.unionByName(part)
    best = F.max(F.struct("common", "cosine", "answered"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.cosine", "b.common", "b.answered")


def _model(items: list[tuple], corpus: np.ndarray | DataFrame, frequency: np.ndarray, idf: np.ndarray, short: int, least_held: float) -> tuple:
    """What a worker needs, as plain tuples and arrays. corpus: its ``directions``, or passages (f array<int>, weight double) to take them from."""
    if isinstance(corpus, DataFrame):
        corpus = directions(corpus.select("f", "weight"), listed, idf)
    blocks = max(1, -(-len(items) // BLOCK))
    weighted = []
    for b in range(blocks):  # one basis in full precision at a time
        basis = block_basis([features(w) for _, w, _ in items[b * BLOCK:(b + 1) * BLOCK]], corpus, idf)
        weighted.append(np.vstack([basis * idf[:, None], np.zeros((1, RANK))]).astype(np.float32))
    targets, shares = [], np.ones(len(items))
    for b in range(blocks):
        own = np.zeros((len(items[b * BLOCK:(b + 1) * BLOCK]), RANK), np.float32)
        for k, (_, w, _) in enumerate(items[b * BLOCK:(b + 1) * BLOCK]):
            f = features(w)
            own[k] = weighted[b][f].sum(axis=0)
            at, n = np.unique(f, return_counts=True)
            shares[b * BLOCK + k] = np.linalg.norm(own[k]) / max(np.linalg.norm(n * idf[at]), 1e-9)
        targets.append(own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9))
    looked_up = [(k, w, bool(len(said))) for k, (_, w, said) in enumerate(items) if len(w) < short or shares[k] < least_held]
    square = np.append(idf**2, 0).astype(np.float32)
    return items, np.hstack(weighted), square, targets, shares.astype(np.float32), Anchors(looked_up, frequency).arrays()


def _search(docs: DataFrame, items: list[tuple], corpus: np.ndarray, frequency: np.ndarray, idf: np.ndarray, kind: str, cosine: float,
            short: int, least_held: float) -> DataFrame:
    """doc_id, item_id, cosine, common, answered: what is found of some items, one row at least for each leak."""
    model = docs.sparkSession.sparkContext.broadcast(_model(items, corpus, frequency, idf, short, least_held))
    name = f"decontaminate-items-{uuid.uuid4().hex}"
    pad = FEATURES

    def passages(hashed: np.ndarray):
        """Sums of the projections and of the squares of each ``STEP`` words; whole steps."""
        project, square = model.value[1:3]
        f = hashed.reshape(-1, STEP)
        x, part = project[f[:, 0]], np.empty((len(f), project.shape[1]), np.float32)
        for k in range(1, STEP):
            x += np.take(project, f[:, k], axis=0, out=part, mode="clip")
        return x, square[f].sum(axis=1)

    def candidates(hashed: list[np.ndarray]):
        """(text, item, place, cosine) of the latent candidates of some texts, worked on together."""
        targets, shares = model.value[3:5]
        steps = [max(2, -(-len(f) // STEP)) for f in hashed]  # the last passage of a text may be padded
        first = np.concatenate(([0], np.cumsum(steps)))
        padded = np.full(first[-1] * STEP, pad, np.int64)
        for f, at in zip(hashed, first.tolist()):
            padded[at * STEP:at * STEP + len(f)] = f
        for at in range(0, first[-1] - 1, CHUNK // STEP):
            x, own = passages(padded[at * STEP:at * STEP + CHUNK + STEP])
            x, own = x[:-1] + x[1:], np.sqrt(own[:-1] + own[1:])
            text = np.searchsorted(first, np.arange(at, at + len(x)), "right") - 1
            apart = np.arange(at, at + len(x)) + 1 == first[text + 1]  # the last step of one text and the first of the next
            for b, target in enumerate(targets):
                part = x[:, b * RANK:(b + 1) * RANK]
                norm = np.sqrt(np.maximum(np.einsum("ij,ij->i", part, part), 1e-18))
                least = ALONG * own[:, None] * shares[b * BLOCK:b * BLOCK + len(target)]
                score = np.empty((len(x), len(target)), np.float32)
                for a in range(0, len(x), 64):  # small products stay on the task's own core
                    np.matmul(part[a:a + 64], target.T, out=score[a:a + 64])
                score[apart] = -1
                w, i = np.nonzero(score >= np.maximum(cosine * norm[:, None], least))
                yield from zip(text[w].tolist(), (b * BLOCK + i).tolist(), ((at + w - first[text[w]]) * STEP).tolist(), (score[w, i] / norm[w]).tolist())

    def search(found: np.ndarray, hashed: np.ndarray, latent: list[tuple]):
        """Leaks in one text: item -> (cosine, common, answered)."""
        plain, project, _, targets, _, index = model.value
        items_ = once(name, lambda: [Item(i, w.tolist(), said.tolist()) for i, w, said in plain])
        out: dict = {}
        seen: set = set()

        def check(k: int, here: int, near: float) -> None:
            item = items_[k]
            if (k, here) in seen or (best := out.get(item.id)) and best[1] >= VERBATIM:
                return
            seen.add((k, here))
            around = found[max(0, here - item.n):here + WINDOW + item.n].tolist()
            if item.at_most(around) < PARAPHRASE * item.n:
                return
            common = common_subsequence(item.masks, item.n, around) / item.n
            if common < PARAPHRASE:
                return
            answered = bool(item.n_answer) and common_subsequence(item.answer, item.n_answer, around) >= ANSWER * item.n_answer
            if (common >= VERBATIM or answered) and (not best or common > best[1]):
                out[item.id] = (near, common, answered)

        for _, k, place, near in latent:
            check(k, place, near)
        last = max(-(-len(found) // STEP) - 2, 0)
        for k, a in dict.fromkeys(anchored(index, found)):
            n, b = items_[k].n, k // BLOCK
            for place in range(max(0, -((WINDOW + n - 1 - a) // STEP)), min(last, (a + n) // STEP) + 1):
                if (k, place * STEP) not in seen:
                    v = project[hashed[place * STEP:place * STEP + WINDOW], b * RANK:(b + 1) * RANK].sum(axis=0)
                    check(k, place * STEP, float(v @ targets[b][k % BLOCK] / max(np.linalg.norm(v), 1e-9)))
        return out

    def scan(batches):
        for batch in batches:
            rows, held, size = [], [], 0

            def work():
                hashed = [features(found) for _, found in held]
                latent: dict[int, list] = {}
                for hit in candidates(hashed):
                    latent.setdefault(hit[0], []).append(hit)
                for n, (key, found) in enumerate(held):
                    rows.extend((key, i, *x) for i, x in search(found, hashed[n], latent.get(n, [])).items())
                held.clear()

            if model.value[0]:
                for key, found in zip(batch.column(0).to_pylist(), hashes_of(batch.column(1)), strict=True):
                    if len(found):
                        held.append((key, found))
                        size += len(found)
                    if size >= CHUNK:
                        work()
                        size = 0
                if held:
                    work()
            if rows:
                d, i, c, s, a = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d, batch.schema.field(0).type), pa.array(i), pa.array(c, pa.float64()), pa.array(s, pa.float64()), pa.array(a)],
                    names=["doc_id", "item_id", "cosine", "common", "answered"])

    return docs.mapInArrow(scan, f"{kind}, cosine double, common double, answered boolean")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
