"""Quality rules as a short-circuit cascade, ordered by rejection per cost.

Every rule says whether it rejects a text. A sample of at most ``SAMPLE_ROWS`` documents measures what each rule
costs (seconds per character, its statistics included) and what share it rejects; the cascade runs the rules by
rejection per cost, largest first, and a text leaves it at the first rule that rejects. The order changes how much work is
done, never the verdict: a text is kept if no rule rejects it. Costs are clocked, so the order may
differ between runs; what is reported of a rejected text is the first rule of the fixed list that rejects it, which doesn't. Measures
that are asked for are worked out for every text, whatever the cascade spares.

Words are runs of anything but ASCII white space. The base statistics (``measure``) are exact for whole texts:
repeats are words in 8-word windows that occur twice or more, found by numbering 1-, 2-, 4- and
8-word windows in turn (two windows are equal if their halves' numbers are).

Defined results: null and empty texts have no words, fail the base rule and are not kept. Repeated
rows and null ids are judged like others, an empty table gives an empty result.
"""

from __future__ import annotations

import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from branchwise.llm.common import table

SAMPLE_ROWS = 1000
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Used for a rule that took no measurable time on the sample.
LEAST_COST = 1e-12

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = "#*$%&|<>"


def window_repeats(words: list[str], window: int = WINDOW) -> int:
    """Words in windows of ``window`` (a power of 2) words that occur twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers: dict[str, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    width = 1
    while width < window:
        pairs = ids[:-width] * (int(ids.max()) + 1) + ids[width:]
        _, ids, times = np.unique(pairs, return_inverse=True, return_counts=True)
        width *= 2
    twice = np.flatnonzero(times[ids] > 1)
    if not len(twice):
        return 0
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + window, -1)
    return int((np.cumsum(cover) > 0).sum())


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    return len(lines) - len(set(lines))


class Text:
    """A text with statistics that are made when a rule first asks for them."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.made: dict[str, object] = {}

    def get(self, name: str):
        if name not in self.made:
            self.made[name] = STATISTICS[name](self)
        return self.made[name]


STATISTICS = {
    "words": lambda t: _WORD.findall(t.text),
    "n_words": lambda t: len(t.get("words")),
    "word_chars": lambda t: sum(map(len, t.get("words"))),
    "n_symbols": lambda t: sum(map(t.text.count, _SYMBOLS)),
    "n_dup_lines": lambda t: duplicate_lines(t.text),
    "n_lines": lambda t: t.text.count("\n") + 1,
    "n_repeat_words": lambda t: window_repeats(t.get("words")),
    "n_upper": lambda t: sum(map(str.isupper, t.text)),
    "n_alpha_words": lambda t: sum(any(map(str.isalpha, w)) for w in t.get("words")),
    "n_stutter": lambda t: sum(map(str.__eq__, t.get("words"), t.get("words")[1:])),
    "top_word": lambda t: max(Counter(t.get("words")).values(), default=0),
}

#: Rule -> does it reject? Shares are compared as whole numbers, so ties are exact.
RULES = {
    "too_few_words": lambda t: t.get("n_words") < MIN_WORDS,
    "repeated_windows": lambda t: 100 * t.get("n_repeat_words") > MAX_REPEAT_PERCENT * t.get("n_words"),
    "symbols": lambda t: 100 * t.get("n_symbols") > 10 * t.get("n_words"),
    "repeated_lines": lambda t: 2 * t.get("n_dup_lines") > t.get("n_lines"),
    "stutter": lambda t: 5 * t.get("n_stutter") > t.get("n_words"),
    "word_length": lambda t: not 2 * t.get("n_words") <= t.get("word_chars") <= 14 * t.get("n_words"),
    "no_letters": lambda t: 100 * t.get("n_alpha_words") < 70 * t.get("n_words"),
    "shouting": lambda t: 2 * t.get("n_upper") > t.get("word_chars"),
    "one_word": lambda t: 100 * t.get("top_word") > 40 * t.get("n_words"),
}
BASE = ("too_few_words", "repeated_windows")


def plan_cascade(df: DataFrame, text: str = "text", rules: dict = RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, seconds per character, share rejected) in the order in which the cascade runs them."""
    rows = df.count()
    sample = df.select(F.col(f"`{text}`").cast("string").alias("text"))
    sample = sample.sample(min(1.0, sample_rows / max(rows, 1)), 7).limit(2 * sample_rows)

    def clock(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            size = sum(len(t or "") for t in texts)
            took, rejected = [], []
            for rule in rules.values():
                fresh = [Text(t) for t in texts]
                began = time.perf_counter()
                rejected.append(sum(map(rule, fresh)))
                took.append(time.perf_counter() - began)
            k = len(rules)
            yield pa.RecordBatch.from_pydict({
                "rule": list(rules), "s": pa.array(took, pa.float64()), "rejected": pa.array(rejected, pa.int64()),
                "chars": pa.array([size] * k, pa.int64()), "n": pa.array([len(texts)] * k, pa.int64())})

    seen = sample.mapInArrow(clock, "rule string, s double, rejected long, chars long, n long")
    sums = {r.rule: r for r in seen.groupBy("rule").agg(*(F.sum(c).alias(c) for c in ("s", "rejected", "chars", "n"))).collect()}
    found = [(name, max(sums[name].s / max(sums[name].chars, 1), LEAST_COST), sums[name].rejected / max(sums[name].n, 1))
             if name in sums else (name, LEAST_COST, 0.0) for name in rules]
    return sorted(found, key=lambda x: (-x[2] / x[1], x[1], x[0]))


def judge(df: DataFrame, order: list[str], text: str = "text", rules: dict = RULES, measures: tuple = (),
          base: tuple = BASE) -> DataFrame:
    """Adds ``measures``, base_failed, kept and rejected_by (the first of ``rules`` that rejects the text)."""
    stats = [f"__{m}" for m in measures]

    def run(texts):
        import pandas as pd

        rows = []
        for t in map(Text, texts):
            kept = not any(rules[name](t) for name in order)
            why = None if kept else next(name for name in rules if rules[name](t))
            rows.append((*(t.get(m) for m in measures), any(rules[b](t) for b in base), kept, why))
        return pd.DataFrame(rows, columns=[*stats, "__base_failed", "__kept", "__rejected_by"])

    kind = "".join(f"{s} long, " for s in stats) + "__base_failed boolean, __kept boolean, __rejected_by string"
    new = [*measures, "base_failed", "kept", "rejected_by"]
    keep = [F.col(f"`{c}`") for c in df.columns if c not in new]
    out = df.select(*keep, F.pandas_udf(run, kind)(F.col(f"`{text}`").cast("string")).alias("__judged"))
    return out.select(*keep, *(F.col(f"__judged.__{c}").alias(c) for c in new))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    order = [name for name, _, _ in plan_cascade(docs)]
    return judge(docs, order, measures=MEASURES).select("doc_id", *MEASURES, "base_failed", "kept", "rejected_by")
