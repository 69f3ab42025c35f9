"""Quality classifier: a generalised additive model with pairwise interactions.

A document becomes about thirty numbers (lengths, shares of character classes, repetition, word shape),
computed over its whole text by array operations on whole batches. Every feature is cut into bins at its
quantiles. Cyclic boosting visits the features in turn; each visit fits a shallow tree of at most
``LEAVES`` leaves to the gradients of the log loss and adds it, scaled, to that feature's lookup table. The
pairs whose joint bins explain most of what is left get two-dimensional tables, boosted in the same way by
trees of four leaves. A score is the logistic of a sum of table entries, so scoring is bin look-ups and
additions.

Training uses labelled rows of the training folds only, crc32(doc_id as text) mod 5 not 0, and at most about
``TRAIN_ROWS`` of them, chosen by a hash of their doc_id. No label, language, source or id is a feature.

Defined cases: null and empty texts have all features 0 and are scored like any text; rows that repeat are
scored alike; with no usable label, or labels of one kind, the score is the smoothed share of label 1, and
0.5 without any; a doc_id labelled twice trains on both rows; a null doc_id is never trained on and not
held out. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.llm.runtime import text_batches
from tracegrid.llm.textvec import U64, chunks, lowered, mix, raw, span_hashes, word_spans

TRAIN_ROWS = 40_000
FOLDS = 5
BINS = 48
PAIR_BINS = 12
PAIRS = 8
LEAVES = 4
ROUNDS = 120
PAIR_ROUNDS = 40
RATE = 0.12
RIDGE = 1.0
THRESHOLD = 0.3

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" \t",
    "newline": b"\n",
    "stop": b".!?",
    "comma": b",;:",
    "mark": b"!",
    "symbol": b"#$%&*+<=>@[]^_{|}~\\/",
    "quote": b"\"'()`-",
}
FEATURE_NAMES = [
    "log_bytes", "log_words", "log_lines", *[f"share_{k}" for k in _CLASSES], "share_other", "word_mean", "word_sd", "word_max",
    "distinct_words", "repeated_lines", "line_mean", "words_per_stop", "upper_start", "share_one_byte", "share_long", "top_word",
    "repeated_pairs", "digit_words",
]


def _per_row(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return sums[ptr[1:]] - sums[ptr[:-1]]


def _distinct(h: np.ndarray, row: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct hashes in each row, and the count of its most frequent one."""
    n = len(ptr) - 1
    if not len(h):
        return np.zeros(n), np.zeros(n)
    key = np.sort((row.astype(U64) << U64(40)) | (h >> U64(24)))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    owner = (key[first] >> U64(40)).astype(np.int64)
    runs = np.diff(np.append(first, len(key)))
    top = np.zeros(n)
    np.maximum.at(top, owner, runs)
    return np.bincount(owner, minlength=n).astype(float), top


def features(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURE_NAMES`` for each text of a column."""
    data, ptr = raw(column)
    low, lptr = lowered(column)
    n = np.diff(ptr).astype(np.float64)
    safe = np.maximum(n, 1)
    shares = []
    for chars in _CLASSES.values():
        table = np.zeros(256, np.uint8)
        table[list(chars)] = 1
        shares.append(_per_row(table[data], ptr) / safe)
    other = _per_row((data >= 128).view(np.uint8), ptr) / safe
    starts, ends, wptr = word_spans(low, lptr)
    size = (ends - starts).astype(np.float64)
    words = np.diff(wptr).astype(np.float64)
    many = np.maximum(words, 1)
    mean = _per_row(size, wptr) / many
    sd = np.sqrt(np.maximum(_per_row(size * size, wptr) / many - mean * mean, 0))
    longest = np.zeros(len(n))
    row = np.repeat(np.arange(len(n)), np.diff(wptr))
    np.maximum.at(longest, row, size)
    h = span_hashes(low, starts, ends)
    distinct, top = _distinct(h, row, wptr)
    pairs = mix(h[:-1] * U64(3) + h[1:]) if len(h) > 1 else h[:0]
    same = row[1:] == row[:-1]
    pair_count = np.bincount(row[1:][same], minlength=len(n)).astype(float)
    pairs_distinct, _ = _distinct(pairs[same], row[1:][same], wptr)
    digits = (low[starts] >= 48) & (low[starts] <= 57) if len(starts) else np.zeros(0, bool)
    # lines: runs of bytes other than newline
    inside = data != 10
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = ptr[(ptr > 0) & (ptr < len(data))]
    before[edges] = False
    after[edges - 1] = False
    lstart, lend = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    line_ptr = np.searchsorted(lstart, ptr)
    lines = np.diff(line_ptr).astype(np.float64)
    line_row = np.repeat(np.arange(len(n)), np.diff(line_ptr))
    lines_distinct, _ = _distinct(span_hashes(data, lstart, lend), line_row, line_ptr)
    upper_table = np.zeros(256, bool)
    upper_table[list(_CLASSES["upper"])] = True
    upper_start = np.zeros(len(n))
    if len(data):
        is_upper = upper_table[data]
        lead = np.ones(len(data), bool)
        lead[1:] = ~(upper_table[data[:-1]] | ((data[:-1] >= 97) & (data[:-1] <= 122)))
        upper_start = _per_row((is_upper & lead).view(np.uint8), ptr) / many
    stops = shares[5] * n
    cols = [
        np.log1p(n), np.log1p(words), np.log1p(lines), *shares, other, mean, sd, longest,
        distinct / many, 1 - lines_distinct / np.maximum(lines, 1), np.log1p(n / np.maximum(lines, 1)), words / np.maximum(stops, 1),
        upper_start, _per_row(size == 1, wptr) / many, _per_row(size >= 12, wptr) / many, top / many,
        1 - pairs_distinct / np.maximum(pair_count, 1), _per_row(digits, wptr) / many,
    ]
    out = np.stack(cols, axis=1)
    out[n == 0] = 0
    return out


# ---------------------------------------------------------------- the model


def best_steps(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """The step function of at most ``leaves`` steps over ordered bins that lowers the loss most, grown greedily."""
    out = np.zeros(len(g))
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain = lambda a, b: a * a / (b + RIDGE)
    parts = [(0, len(g))]
    for _ in range(leaves - 1):
        best = (1e-9, None, 0, 0, 0)
        for k, (lo, hi) in enumerate(parts):
            if hi - lo < 2:
                continue
            at = np.arange(lo + 1, hi)
            lg, lh = cg[at] - cg[lo], ch[at] - ch[lo]
            tg, th = cg[hi] - cg[lo], ch[hi] - ch[lo]
            own = np.where((lh > 1) & (th - lh > 1), gain(lg, lh) + gain(tg - lg, th - lh) - gain(tg, th), -1)
            j = int(own.argmax())
            if own[j] > best[0]:
                best = (float(own[j]), k, lo, int(at[j]), hi)
        if best[1] is None:
            break
        parts[best[1]] = (best[2], best[3])
        parts.append((best[3], best[4]))
    for lo, hi in parts:
        out[lo:hi] = -(cg[hi] - cg[lo]) / (ch[hi] - ch[lo] + RIDGE)
    return out


def best_quadrants(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The tree of one cut on each axis that lowers the loss most over a grid of bins, and its gain."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tg, th = cg[-1, -1], ch[-1, -1]
    a, b = cg[:-1, :-1], ch[:-1, :-1]
    rg, rh = cg[:-1, -1:], ch[:-1, -1:]
    dg, dh = cg[-1:, :-1], ch[-1:, :-1]
    quads = [(a, b), (rg - a, rh - b), (dg - a, dh - b), (tg - rg - dg + a, th - rh - dh + b)]
    total = sum(x * x / (y + RIDGE) for x, y in quads)
    i, j = np.unravel_index(int(total.argmax()), total.shape)
    leaf = [-(np.broadcast_to(x, total.shape)[i, j]) / (np.broadcast_to(y, total.shape)[i, j] + RIDGE) for x, y in quads]
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaf
    return out, float(total[i, j] - tg * tg / (th + RIDGE))


@dataclass
class AdditiveModel:
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for j, (e, t) in enumerate(zip(self.edges, self.tables)):
            z += t[np.searchsorted(e, x[:, j], side="right")]
        if self.pairs:
            coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.pair_edges)]
            for (a, b), t in zip(self.pairs, self.pair_tables):
                z += t[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-z))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="nearest"))


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    if not len(y):
        return AdditiveModel()
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = AdditiveModel(base=float(np.log(share / (1 - share))))
    if y.min() == y.max():
        return model
    model.edges = [_edges(x[:, j], BINS) for j in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    z = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            g, h = slopes()
            size = len(model.tables[j])
            step = RATE * best_steps(np.bincount(b, g, size), np.bincount(b, h, size))
            model.tables[j] += step
            z += step[b]
    model.pair_edges = [_edges(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.pair_edges)]
    sizes = [len(e) + 1 for e in model.pair_edges]

    def grids(a: int, b: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell, shape = coarse[a] * sizes[b] + coarse[b], (sizes[a], sizes[b])
        return np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    usable = [j for j, s in enumerate(sizes) if s > 1]
    gains = sorted(((best_quadrants(*grids(a, b, g, h))[1], a, b) for i, a in enumerate(usable) for b in usable[i + 1 :]), reverse=True)
    model.pairs = [(a, b) for _, a, b in gains[:PAIRS]]
    model.pair_tables = [np.zeros((sizes[a], sizes[b])) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(model.pairs):
            step = RATE * best_quadrants(*grids(a, b, *slopes()))[0]
            model.pair_tables[k] += step
            z += step[coarse[a], coarse[b]]
    return model


# ---------------------------------------------------------------- over tables


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True for the fifth of rows that no model learns from; false where there is no id."""
    own = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(own.cast("string")), F.lit(FOLDS)) == 0, F.lit(False))


def training_ids(labels: DataFrame, target: str, bound: int) -> DataFrame:
    """At most about ``bound`` labelled training rows ``(doc_id, y)``, chosen by a hash of the id."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1) & ~held_out())
    n = usable.count()
    part = usable if n <= bound else usable.filter(F.pmod(F.xxhash64("doc_id", F.lit(target)), F.lit(1_000_000)) < int(1_000_000 * bound / n))
    return part.select(F.col("doc_id").cast("long").alias("label_id"), F.col(target).cast("int").alias("y"))


def train(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> AdditiveModel:
    text_batches(docs.sparkSession)
    own = training_ids(labels, "quality", bound)  # bounded, so it may be broadcast
    sample = docs.join(F.broadcast(own), F.col("doc_id") == F.col("label_id")).select("y", "label_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in chunks(batch.column(2)):
                x = features(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(x)), batch.column(1).slice(start, len(x)), *[pa.array(x[:, j]) for j in range(x.shape[1])]], ["y", "label_id", *FEATURE_NAMES]
                )

    schema = "y int, label_id long, " + ", ".join(f"{k} double" for k in FEATURE_NAMES)
    got = sample.mapInArrow(run, schema).toPandas().sort_values(["label_id", "y", *FEATURE_NAMES])
    return fit(got[FEATURE_NAMES].to_numpy(float), got["y"].to_numpy(float))


def score(docs: DataFrame, model: AdditiveModel, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """``keep`` (doc_id by default) and the score, as column ``name``, for every row."""
    text_batches(docs.sparkSession)
    names = keep or ["doc_id"]
    part = docs.select(*[F.col(f"`{c}`") for c in names], F.col("text").alias("__scored_text"))
    schema = part.drop("__scored_text").withColumn(name, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            s = [model.score(features(t)) for _, t in chunks(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(s) if s else np.zeros(0))], [*names, name])

    return part.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    out = score(docs, train(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject; columns as they were, one called ``score`` too."""
    names = docs.columns
    out = score(docs, train(docs, labels), names, "__quality_score")
    return out.filter(F.col("__quality_score") >= THRESHOLD).select(*[F.col(f"`{c}`") for c in names])
