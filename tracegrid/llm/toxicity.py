"""Toxicity: a counterfactual-regularised classifier.

Features are the words of a text and their beginnings of ``PREFIXES`` bytes, as 64-bit hashes, each at the
levels 1, 2 and 4 that its count in the text reaches. All that occur in at least ``MIN_DOCS`` training texts
and whose share differs clearly between labels (``MIN_Z`` standard errors) are kept, together with all identity
terms; the training rows are bounded, and so are their features. A logistic model is fitted to them with a ridge and a counterfactual
penalty: for every labelled text that names an identity group, ``SWAPS`` copies are made in which all terms at
once are swapped for terms of the other groups of their kinds. Text and copies go through the same features, and
the squared change of the score's logit over all of them (words, beginnings, counts) is penalised. A group's
name alone then moves a score very little, which keeps neutral mentions of groups from being flagged. Terms are
listed for English, German, French and Spanish; a name that is not listed is a word like any other.

Training uses labelled rows of the training folds only, crc32(doc_id as text) mod 5 not 0, and at most about
``TRAIN_ROWS`` of them, chosen by a hash of their doc_id. No label, language, source or id is a feature.

Defined cases: null and empty texts have no feature and get the base score; rows that repeat are scored
alike; without a usable label, or with labels of one kind, the score is the smoothed share of label 1, and 0.5
without any; a null doc_id is not held out and never trained on. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrid.llm.quality import held_out, training_ids
from tracegrid.llm.runtime import text_batches
from tracegrid.llm.textvec import U64, chunks, lowered, mix, signed, span_hashes, word_spans, words

TRAIN_ROWS = 20_000
PREFIXES = (5, 7)
LEVELS = (1, 2, 4)
MIN_DOCS = 6
MIN_Z = 5.0
RIDGE = 1e-3
PENALTY = 10.0
SWAPS = 3
STEPS = 400
RATE = 0.1
THRESHOLD = 0.5

# Terms that name groups, by language and kind; a swap replaces a term by one of the same kind.
IDENTITY_TERMS = {
    "religion": "christian muslim jewish hindu buddhist atheist catholic protestant sikh".split(),
    "religions": "christians muslims jews hindus buddhists atheists catholics protestants sikhs".split(),
    "gender": "man woman boy girl male female transgender nonbinary".split(),
    "genders": "men women boys girls males females".split(),
    "orientation": "gay lesbian bisexual straight heterosexual homosexual queer".split(),
    "origin": "african american arab asian british chinese european french german indian italian japanese latino mexican polish russian spanish turkish".split(),
    "colour": "black white brown".split(),
    "age": "young old elderly teenage".split(),
    "ability": "deaf blind disabled autistic paralyzed".split(),
    "de religion": "christlich muslimisch jüdisch hinduistisch buddhistisch katholisch evangelisch".split(),
    "de religions": "christen muslime juden hindus buddhisten atheisten katholiken protestanten".split(),
    "de gender": "männer frauen jungen mädchen".split(),
    "de orientation": "schwul lesbisch bisexuell heterosexuell homosexuell".split(),
    "de origin": "afrikanisch amerikanisch arabisch asiatisch chinesisch deutsch französisch indisch italienisch polnisch russisch spanisch türkisch".split(),
    "fr religion": "chrétien musulman juif hindou bouddhiste athée catholique protestant sikh".split(),
    "fr religions": "chrétiens musulmans juifs hindous bouddhistes athées catholiques protestants sikhs".split(),
    "fr gender": "homme femme garçon fille".split(),
    "fr orientation": "lesbienne bisexuel hétérosexuel homosexuel".split(),
    "fr origin": "africain américain arabe asiatique chinois allemand français indien italien polonais russe espagnol turc".split(),
    "es religion": "cristiano musulmán judío hindú budista ateo católico protestante".split(),
    "es religions": "cristianos musulmanes judíos hindúes budistas ateos católicos protestantes".split(),
    "es gender": "hombre mujer niño niña".split(),
    "es orientation": "lesbiana bisexual heterosexual homosexual".split(),
    "es origin": "africano americano árabe asiático chino alemán francés indio italiano polaco ruso español turco".split(),
}
# A word that several kinds list is swapped within the first of them.


# Each term as bytes: its place in its kind, and the kind.
_KIND_OF: dict[bytes, tuple[int, list[bytes]]] = {}
for _terms in IDENTITY_TERMS.values():
    for _i, _t in enumerate(_terms):
        _KIND_OF.setdefault(_t.encode(), (_i, [x.encode() for x in _terms]))


def _hashes(terms: list[str]) -> np.ndarray:
    return words(pa.array(terms))[0]


def token_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of all words of a column and the row of each; a feature may repeat within a row."""
    data, ptr = lowered(column)
    starts, ends, wptr = word_spans(data, ptr)
    row = np.repeat(np.arange(len(wptr) - 1), np.diff(wptr))
    parts = [span_hashes(data, starts, ends)]
    rows = [row]
    for k in PREFIXES:
        long = ends - starts > k
        parts.append(mix(span_hashes(data, starts[long], starts[long] + k) + U64(k)))
        rows.append(row[long])
    return np.concatenate(parts), np.concatenate(rows)


def _levels(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each feature of a row once for every level its count there reaches, in order of rows."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    start = np.flatnonzero(first)
    count = np.diff(np.append(start, len(h)))
    h, row = h[start], row[start]
    keys = np.concatenate([h[count >= k] ^ U64(k - 1 << 48) for k in LEVELS])
    rows = np.concatenate([row[count >= k] for k in LEVELS])
    order = np.lexsort((keys, rows))
    return keys[order], rows[order]


@dataclass
class ToxicityModel:
    base: float = 0.0
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def __post_init__(self) -> None:
        self.may = np.zeros(1 << 16, bool)
        self.may[(self.keys & U64(0xFFFF)).astype(np.int64)] = True

    def hits(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Rows and feature numbers of the model's features that occur in a column, each once per row."""
        h, row = token_features(column)
        if not len(self.keys):
            return row[:0], row[:0]
        maybe = self.may[(h & U64(0xFFFF)).astype(np.int64)]
        h, row = _levels(h[maybe], row[maybe])
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        own = self.keys[at] == h
        return row[own], at[own]

    def score(self, column: pa.Array) -> np.ndarray:
        row, at = self.hits(column)
        z = self.base + np.bincount(row, self.weights[at], len(column))
        return 1 / (1 + np.exp(-z))


def swapped_copies(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Lower-cased copies of the texts that hold terms, and the row of each: every term is moved on in its kind by one step."""
    data, ptr = lowered(column)
    starts, ends, wptr = word_spans(data, ptr)
    held = np.flatnonzero(np.isin(span_hashes(data, starts, ends), _hashes([t.decode() for t in _KIND_OF])))
    row = np.searchsorted(wptr, held, "right") - 1
    rows, copies = [], []
    for r in np.unique(row).tolist():
        own = held[np.searchsorted(row, r) : np.searchsorted(row, r, "right")]
        text = data[ptr[r] : ptr[r + 1]].tobytes()
        spans = list(zip((starts[own] - ptr[r]).tolist(), (ends[own] - ptr[r]).tolist()))
        seed = zlib.crc32(text)
        for copy in range(SWAPS):
            parts, last = [], 0
            for a, b in spans:
                i, kind = _KIND_OF[text[a:b]]
                parts += [text[last:a], kind[(i + 1 + (seed + copy) % (len(kind) - 1)) % len(kind)]]
                last = b
            rows.append(r)
            copies.append(b"".join([*parts, text[last:]]).decode())
    return np.array(rows, np.int64), pa.array(copies, pa.large_string())


def fit(row: np.ndarray, at: np.ndarray, y: np.ndarray, n_features: int, kinds: list[np.ndarray], changes: list[np.ndarray] | None = None) -> tuple[float, np.ndarray]:
    """Weights over binary features (``row`` has feature ``at``).

    ``changes`` has, for each swapped copy of a row, the features that it gains (their number + 1) and loses (the same,
    negative). ``kinds`` are the feature numbers of swappable terms, for rows without copies.
    """
    share = (y.sum() + 0.5) / (len(y) + 1)
    base, w = float(np.log(share / (1 - share))), np.zeros(n_features)
    # Without copies, one counterfactual per mention and swap: the logit changes by w[other] - w[own].
    own, other = [], []
    rng = np.random.default_rng(7)
    for kind in kinds:
        found = at[np.isin(at, kind)]
        for _ in range(SWAPS if len(kind) > 1 else 0):
            own.append(found)
            other.append(kind[(np.searchsorted(kind, found) + rng.integers(1, len(kind), len(found))) % len(kind)])
    a = np.concatenate(own) if own else np.zeros(0, np.int64)
    b = np.concatenate(other) if other else np.zeros(0, np.int64)
    changes = changes or []
    copy = np.repeat(np.arange(len(changes)), [len(c) for c in changes])
    moved = np.concatenate([np.zeros(0, np.int64), *changes]).astype(np.int64)
    sign, moved = np.sign(moved).astype(float), np.abs(moved) - 1
    weight = np.where(y == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)) / len(y)
    moment, spread, m0, s0 = np.zeros(n_features), np.zeros(n_features), 0.0, 0.0
    for t in range(1, STEPS + 1):
        z = base + np.bincount(row, w[at], len(y))
        err = weight * (1 / (1 + np.exp(-z)) - y)
        grad = np.bincount(at, err[row], n_features) + RIDGE * w
        if len(a):
            gap = (w[b] - w[a]) * (2 * PENALTY / len(a))
            grad += np.bincount(b, gap, n_features) - np.bincount(a, gap, n_features)
        if len(changes):
            change = np.bincount(copy, sign * w[moved], len(changes)) * (2 * PENALTY / len(changes))
            grad += np.bincount(moved, sign * change[copy], n_features)
        g0 = float(err.sum())
        moment, spread = 0.9 * moment + 0.1 * grad, 0.99 * spread + 0.01 * grad * grad
        m0, s0 = 0.9 * m0 + 0.1 * g0, 0.99 * s0 + 0.01 * g0 * g0
        fix, fix2 = 1 - 0.9**t, 1 - 0.99**t
        rate = RATE * min(1.0, 2 * (1 - t / (STEPS + 1)))  # even at first, then down to nothing, so that it settles
        w -= rate * (moment / fix) / (np.sqrt(spread / fix2) + 1e-8)
        base -= rate * (m0 / fix) / (np.sqrt(s0 / fix2) + 1e-8)
    return base, w


def train(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> ToxicityModel:
    text_batches(docs.sparkSession)
    own = training_ids(labels, "toxic", bound)  # bounded, so it may be broadcast
    sample = docs.join(F.broadcast(own), F.col("doc_id") == F.col("label_id")).select("y", "label_id", "text")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(0).to_numpy()
            for start, texts in chunks(batch.column(2)):
                h, row = _levels(*token_features(texts))
                keys, inverse = np.unique(h, return_inverse=True)
                ones = np.bincount(inverse, y[start + row], len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(np.bincount(inverse, minlength=len(keys)).astype(np.int64)), pa.array(ones)], ["h", "n", "ones"])

    total = own.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones")).first()
    n, n1 = int(total["n"]), int(total["ones"] or 0)
    if not n:
        return ToxicityModel()
    share = (n1 + 0.5) / (n + 1)
    prior = float(np.log(share / (1 - share)))
    if n1 in (0, n):
        return ToxicityModel(prior)
    z = (F.col("ones") - F.col("n") * F.lit(n1 / n)) / F.sqrt(F.col("n") * F.lit(n1 / n * (1 - n1 / n)))
    picked = (
        sample.mapInArrow(counts, "h long, n long, ones long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))
        .filter(F.col("n") >= MIN_DOCS).withColumn("z", F.abs(z)).filter(F.col("z") >= MIN_Z)
        .toPandas()
    )
    kinds = [_hashes(terms) for terms in IDENTITY_TERMS.values()]
    keys = np.unique(np.concatenate([picked["h"].to_numpy(np.int64).view(U64), *kinds]))
    model = ToxicityModel(prior, keys, np.zeros(len(keys)))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in chunks(batch.column(2)):
                row, at = model.hits(texts)
                ptr = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
                changes: list[list[np.ndarray]] = [[] for _ in range(len(texts))]
                of, copies = swapped_copies(texts)
                copy, gets = model.hits(copies)
                for k, r in enumerate(of.tolist()):
                    had, has = at[ptr[r] : ptr[r + 1]], gets[np.searchsorted(copy, k) : np.searchsorted(copy, k, "right")]
                    changes[r].append(np.concatenate([np.setdiff1d(has, had) + 1, -1 - np.setdiff1d(had, has)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), batch.column(1).slice(start, len(texts)), pa.ListArray.from_arrays(pa.array(ptr), pa.array(at.astype(np.int32))), pa.array(changes, pa.list_(pa.list_(pa.int32())))], ["y", "label_id", "at", "changes"]
                )

    got = sample.mapInArrow(found, "y int, label_id long, at array<int>, changes array<array<int>>").toPandas().sort_values(["label_id", "y"])
    if not len(got):
        return ToxicityModel()
    sizes = got["at"].map(len).to_numpy(np.int64)
    row = np.repeat(np.arange(len(got)), sizes)
    at = np.concatenate([np.asarray(v, np.int64) for v in got["at"]])
    base, weights = fit(row, at, got["y"].to_numpy(float), len(keys), [], [np.asarray(c, np.int64) for v in got["changes"] for c in v])
    return ToxicityModel(base, keys, weights)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [model.score(t) for _, t in chunks(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(s) if s else np.zeros(0))], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
