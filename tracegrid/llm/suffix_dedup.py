"""Suffix-array dedup: every byte covered by a ``LENGTH``-byte string that starts more than once goes.

The suffix array is sparse. Every window of ``LENGTH`` bytes has an anchor, its leftmost ``KGRAM``-byte string
of least hash, so equal windows have equal anchors at equal places and only anchored suffixes need sorting.
The windows of one anchor occurrence are consecutive; the text they span is its context.

1. Contexts are counted by a 128-bit hash. One that occurs twice makes all its windows repeats.
2. Anchors that still have a lone context beside others are open. One copy of each of their contexts is
   fetched, and its suffix from the anchor on goes into the distributed merge sort: each task sorts its
   suffixes into runs, cuts the runs at shared splitters and front-codes them (length of the prefix shared
   with the suffix before, then the rest). For each range, runs are merged by a loser tree whose matches
   start behind the prefixes already known to be equal; it yields sorted suffixes with their common
   prefix lengths. Neighbours that share an anchor form a group, and within a group windows are compared.
3. An anchor with more than ``GROUP_CONTEXTS`` distinct contexts is not gathered in one task: its windows are
   counted by fingerprint over the whole cluster instead, with the same result.
4. Repeated windows become byte ranges; each text is cut once, with ranges merged.

Defined cases: a null text is empty; texts shorter than ``LENGTH`` lose nothing; rows that repeat doc_id and
text are different documents and so repeat each other; a null doc_id is kept as null; an empty table gives
no rows. Cuts may fall inside a UTF-8 sequence, as they work on bytes. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrid.llm.runtime import materialised, text_batches
from tracegrid.llm.textvec import U64, chunks, mix, powers, raw, signed

LENGTH = 400
KGRAM = 64
GROUP_CONTEXTS = 20_000
RANGE_BYTES = 8 << 20
RUN_BYTES = 24 << 20
CHUNK_BYTES = 4 << 20
SEGMENT = 1 << 19
HITS = 1 << 19
SPLITS = 1 << 24
_LOW = U64((1 << 23) - 1)
_BASE2 = 0xC2B2AE3D27D4EB4F

ANCHORS = "doc_id long, text_hash long, a int, b int, p int, anchor long, c1 long, c2 long, head long"
RUN = "range long, lcp binary, rest_size binary, rest binary, left_size binary, left binary, meta binary"


# ---------------------------------------------------------------- anchors


def _sums(data: np.ndarray, base2: bool = False) -> np.ndarray:
    n = len(data)
    pw = powers(n + 1)[0]
    if base2:
        steps = np.full(n + 1, _BASE2, U64)
        steps[0] = 1
        pw = np.cumprod(steps, dtype=U64)
    out = np.zeros(n + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * pw[:n], out=out[1:])
    return out


def _inverses2(n: int) -> np.ndarray:
    """Powers 0..n-1 of the inverse of the second base."""
    inv = np.full(n, pow(_BASE2, -1, 1 << 64), U64)
    inv[0] = 1
    return np.cumprod(inv, dtype=U64)


def second_prints(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The second fingerprint of the strings of ``length`` bytes that start at ``at``."""
    sums = _sums(data, True)
    return mix((sums[at + length] - sums[at]) * _inverses2(len(data) + 1)[at])


def anchors(data: np.ndarray, ptr: np.ndarray, length: int = LENGTH, k: int = KGRAM) -> tuple[np.ndarray, ...]:
    """row, first window, last window, anchor place, anchor hash, two context hashes, first eight bytes."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none.view(U64), none.view(U64), none.view(U64), none
    sums, inv = _sums(data), powers(n + 1)[1]
    h = mix((sums[k:] - sums[: n - k + 1]) * inv[: n - k + 1])
    width, count = length - k + 1, n - length + 1
    key = (h & ~_LOW) | np.arange(len(h)).astype(U64)
    pad = -len(key) % width
    blocks = np.concatenate([key, np.full(pad, ~U64(0), U64)]).reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    p = (np.minimum(after[:count], before[width - 1 : width - 1 + count]) & _LOW).astype(np.int64)
    cross = np.zeros(count + 1, np.int64)
    inner = np.unique(ptr[(ptr > 0) & (ptr < n)])
    np.add.at(cross, np.clip(inner - length + 1, 0, count), 1)
    np.add.at(cross, np.minimum(inner, count), -1)
    at = np.flatnonzero(np.cumsum(cross)[:count] == 0)
    if not len(at):
        return none, none, none, none, none.view(U64), none.view(U64), none.view(U64), none
    own = p[at]
    change = np.concatenate([[True], (own[1:] != own[:-1]) | (np.diff(at) != 1)])
    a, b = at[change], at[np.append(change[1:], True)]
    place = p[a]
    row = np.searchsorted(ptr, a, side="right") - 1
    c1 = mix((sums[b + length] - sums[a]) * inv[a])
    # the second base has its inverse powers only where contexts start
    second = _sums(data, True)
    c2 = mix((second[b + length] - second[a]) * _inverses2(len(data) + 1)[a] + (b - a).astype(U64))
    head = np.zeros(len(place), U64)
    for j in range(8):
        head = (head << U64(8)) | data[place + j].astype(U64)
    return row, a - ptr[row], b - ptr[row], place - ptr[row], h[place], c1, c2, signed(head ^ U64(1 << 63))


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "text_hash", "a", "b", "p", "anchor", "c1", "c2", "head"]
    for batch in batches:
        for start, texts in chunks(batch.column(2), SEGMENT):
            data, ptr = raw(texts)
            if len(data) <= SEGMENT:
                parts = [(0, anchors(data, ptr))]
            else:  # one long text, in pieces that share LENGTH - 1 bytes
                cuts = range(0, len(data) - LENGTH + 1, SEGMENT - LENGTH + 1)
                parts = [(s, anchors(data[s : s + SEGMENT], np.array([0, min(SEGMENT, len(data) - s)]))) for s in cuts]
            for shift, (row, a, b, p, anchor, c1, c2, head) in parts:
                at = pa.array(start + row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), *[pa.array((v + shift).astype(np.int32)) for v in (a, b, p)], *[pa.array(signed(v)) for v in (anchor, c1, c2)], pa.array(head)], names
                )


def _compressed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and the text's bytes, compressed, as they are shuffled twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            data, ptr = raw(batch.column(2))
            body = memoryview(data)
            z = [squeeze(body[s:e]) for s, e in zip(ptr[:-1], ptr[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(z, pa.binary())], ["doc_id", "text_hash", "z"])

    return docs.mapInArrow(run, "doc_id long, text_hash long, z binary")


# ---------------------------------------------------------------- runs and their merge


def common_prefix(x: bytes, y: bytes, known: int = 0) -> int:
    """Length of the common prefix of two strings that agree in the first ``known`` bytes."""
    lo, hi = known, min(len(x), len(y))
    step = 16
    while lo < hi:
        end = min(hi, lo + step)
        if x[lo:end] == y[lo:end]:
            lo, step = end, step * 4
        elif end - lo == 1:
            return lo
        else:
            hi, step = end, max(1, (end - lo) // 2)
    return lo


def front_coded(suffixes: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Common prefix of each sorted suffix with the one before, and what follows it."""
    lcp = np.zeros(len(suffixes), np.int32)
    rest = []
    prev = b""
    for i, s in enumerate(suffixes):
        lcp[i] = common_prefix(prev, s)
        rest.append(s[lcp[i] :])
        prev = s
    return lcp, rest


def unfolded(lcp: np.ndarray, sizes: np.ndarray, rest: bytes) -> Iterator[tuple[bytes, int]]:
    """The suffixes of a front-coded run, each with its common prefix with the one before."""
    prev, at = b"", 0
    for h, n in zip(lcp.tolist(), sizes.tolist()):
        prev = prev[:h] + rest[at : at + n]
        at += n
        yield prev, h


def merged(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[int, bytes, int]]:
    """Merge sorted runs by a loser tree: (run, suffix, common prefix with the suffix yielded before).

    Each waiting suffix carries its common prefix with the last winner it lost to. The longer one wins
    unread; equal ones are compared from there on.
    """
    n = len(runs)
    size = 1
    while size < n:
        size *= 2
    head: list[bytes | None] = [None] * size
    shared = [0] * size

    def pull(i: int) -> None:
        head[i], shared[i] = next(runs[i], (None, 0)) if i < n else (None, 0)

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = head[a], head[b]
        if y is None:
            return a, b
        if x is None or shared[a] < shared[b]:
            return b, a
        if shared[a] > shared[b]:
            return a, b
        h = common_prefix(x, y, shared[a])
        if x[h : h + 1] < y[h : h + 1] or (len(x) == h == len(y) and a < b):
            shared[b] = h
            return a, b
        shared[a] = h
        return b, a

    for i in range(size):
        pull(i)
        shared[i] = 0
    losers = [0] * size
    level = list(range(size))
    node = size
    while len(level) > 1:
        node //= 2
        nxt = []
        for j in range(0, len(level), 2):
            w, lost = play(level[j], level[j + 1])
            losers[node + j // 2] = lost
            nxt.append(w)
        level = nxt
    winner = level[0]
    while head[winner] is not None:
        yield winner, head[winner], shared[winner]  # type: ignore[misc]
        pull(winner)
        node = (winner + size) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def _runs(splitters: list[int], parts: dict[int, int]):
    """Sorted, front-coded runs of the contexts that a task holds, one row for each range they reach.

    A range is one of first eight bytes; beginnings in ``parts`` are so common that theirs is split further,
    by anchor, which keeps the contexts of one anchor together.
    """

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        held.sort(key=lambda x: (x[0], x[1], x[2]))
        start = 0
        while start < len(held):
            r, end = held[start][0], start
            while end < len(held) and held[end][0] == r:
                end += 1
            part = held[start:end]
            lcp, rest = front_coded([x[1] for x in part])
            sizes = lambda parts: np.array([len(x) for x in parts], np.int32).tobytes()
            left = [x[2] for x in part]
            row = [r, lcp.tobytes(), sizes(rest), b"".join(rest), sizes(left), b"".join(left), np.array([x[3] for x in part], np.int64).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *[pa.array([v], pa.binary()) for v in row[1:]]], ["range", "lcp", "rest_size", "rest", "left_size", "left", "meta"])
            start = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        total = 0
        for doc, text_hash, text, found in _texts(batches):
            for c in found:
                a, b, p = c["a"], c["b"], c["p"]
                suffix, left = text[p : b + LENGTH], text[a:p]
                range_ = bisect_right(splitters, c["head"]) * SPLITS + c["anchor"] % parts.get(c["head"], 1)
                held.append((range_, suffix, left, (doc is None, doc or 0, text_hash, a, c["n"])))
                total += len(suffix) + len(left)
            if total > RUN_BYTES:
                yield from flush(held)
                held, total = [], 0
        yield from flush(held)

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """doc_id, text_hash, text bytes and the list column of rows ``doc_id, text_hash, z, found``."""
    inflate = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), inflate(batch.column(2)[i].as_py()), batch.column(3)[i].as_py() or []


def repeated_windows(contexts: list[bytes], lefts: np.ndarray, groups: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, first window and last window of all runs of windows that occur twice in their group.

    Windows are compared at equal distance to the anchor, which is ``lefts`` bytes behind a context's start, by
    two fingerprints of 64 bits from different bases; the second is taken only where the first occurs twice.
    Of each window only a key is held: fingerprints are computed over ``SEGMENT`` bytes of contexts at a time, and
    about ``HITS`` of the windows found are compared at a time, all of one key together.
    """
    none = np.zeros(0, np.int64)
    base = np.concatenate([[0], np.cumsum([len(c) for c in contexts], dtype=np.int64)])
    count = np.diff(base) - length + 1
    first = np.concatenate([[0], np.cumsum(count)])
    blocks = [0]
    while blocks[-1] < len(contexts):
        blocks.append(max(blocks[-1] + 1, int(np.searchsorted(base, base[blocks[-1]] + SEGMENT, side="right")) - 1))
    blocks = list(zip(blocks[:-1], blocks[1:]))

    key = np.empty(first[-1], U64)
    for i, j in blocks:
        data = np.frombuffer(b"".join(contexts[i:j]), np.uint8)
        ctx = np.repeat(np.arange(i, j), count[i:j])
        t = np.arange(first[i], first[j]) - first[ctx]
        at = base[ctx] - base[i] + t
        sums, inv = _sums(data), powers(len(data) + 1)[1]
        fp = mix((sums[at + length] - sums[at]) * inv[at])
        place = groups[ctx].astype(U64) * U64(1 << 20) + (lefts[ctx] - t).astype(U64)
        key[first[i] : first[j]] = mix(fp + mix(place))
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    del ordered
    if not len(twice):
        return none, none, none
    found = np.zeros(len(key), bool)
    for s in range(0, len(key), HITS):
        part = key[s : s + HITS]
        found[s : s + HITS] = twice[np.minimum(np.searchsorted(twice, part), len(twice) - 1)] == part
    hit = np.flatnonzero(found)
    k1 = key[hit]
    del key, twice, found

    k2 = np.empty(len(hit), U64)
    for i, j in blocks:
        s, e = np.searchsorted(hit, [first[i], first[j]])
        if s < e:
            ctx = np.searchsorted(first, hit[s:e], side="right") - 1
            data = np.frombuffer(b"".join(contexts[i:j]), np.uint8)
            k2[s:e] = second_prints(data, base[ctx] - base[i] + hit[s:e] - first[ctx], length)
    sure = np.zeros(len(hit), bool)
    cuts = np.unique(np.sort(k1)[HITS::HITS])
    slice_ = np.searchsorted(cuts, k1, side="right").astype(np.int32)
    for i in range(len(cuts) + 1):
        own = np.flatnonzero(slice_ == i)
        order = own[np.lexsort((k2[own], k1[own]))]
        same = (k1[order][1:] == k1[order][:-1]) & (k2[order][1:] == k2[order][:-1])
        sure[order[1:][same]] = True
        sure[order[:-1][same]] = True
    del k1, k2
    hit = hit[sure]
    if not len(hit):
        return none, none, none
    new = np.concatenate([[True], np.diff(hit) != 1])
    heads = np.searchsorted(hit, first)
    new[heads[heads < len(hit)]] = True  # a context's first hit
    last = np.append(new[1:], True)
    ctx = np.searchsorted(first, hit[new], side="right") - 1
    return ctx, hit[new] - first[ctx], hit[last] - first[ctx]


def _merge_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Byte ranges (doc_id, text_hash, lo, hi) of the repeated windows of one range's lone contexts."""
    runs, lefts, metas = [], [], []
    for batch in batches:
        for i in range(batch.num_rows):
            get = lambda name: batch.column(name)[i].as_py()  # noqa: B023, E731
            runs.append(unfolded(np.frombuffer(get("lcp"), np.int32), np.frombuffer(get("rest_size"), np.int32), get("rest")))
            ends = np.concatenate([[0], np.cumsum(np.frombuffer(get("left_size"), np.int32))]).tolist()
            lefts.append((get("left"), ends))
            metas.append(np.frombuffer(get("meta"), np.int64).reshape(-1, 5))
    seen = [0] * len(runs)
    contexts: list[bytes] = []
    left_sizes: list[int] = []
    groups: list[int] = []
    rows: list[np.ndarray] = []
    total, group = 0, 0

    def flush() -> pa.RecordBatch:
        meta = np.stack(rows)
        c, lo, hi = repeated_windows(contexts, np.array(left_sizes), np.array(groups))
        lone = meta[c, 4] == 1
        c, lo, hi = c[lone], lo[lone], hi[lone]
        doc = pa.array(meta[c, 1], mask=meta[c, 0] == 1)
        return pa.RecordBatch.from_arrays([doc, pa.array(meta[c, 2]), pa.array(meta[c, 3] + lo), pa.array(meta[c, 3] + hi + LENGTH)], ["doc_id", "text_hash", "lo", "hi"])

    for r, suffix, shared in merged(runs):
        if shared < KGRAM:
            group += 1
            if total > CHUNK_BYTES:
                yield flush()
                contexts, left_sizes, groups, rows, total = [], [], [], [], 0
        body, ends = lefts[r]
        k = seen[r]
        seen[r] += 1
        left = body[ends[k] : ends[k + 1]]
        contexts.append(left + suffix)
        left_sizes.append(len(left))
        groups.append(group)
        rows.append(metas[r][k])
        total += len(left) + len(suffix)
    if contexts:
        yield flush()


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each window of the contexts of crowded anchors."""
    for doc, text_hash, text, found in _texts(batches):
        for c in found:
            data = np.frombuffer(text[c["a"] : c["b"] + LENGTH], np.uint8)
            sums, inv = _sums(data), powers(len(data) + 1)[1]
            t = np.arange(len(data) - LENGTH + 1)
            fp, fp2 = signed(mix((sums[t + LENGTH] - sums[t]) * inv[t])), signed(second_prints(data, t, LENGTH))
            n = len(t)
            yield pa.RecordBatch.from_arrays(
                [pa.array([doc] * n, pa.int64()), pa.array(np.full(n, text_hash)), pa.array(c["a"] + t), pa.array(np.full(n, c["anchor"])), pa.array(c["p"] - c["a"] - t), pa.array(fp), pa.array(fp2), pa.array(np.full(n, c["n"]))],
                ["doc_id", "text_hash", "lo", "anchor", "o", "fp", "fp2", "n"],
            )


# ---------------------------------------------------------------- over tables


def _with_texts(found: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, text_hash, z and the list ``found`` of the rows of one document."""
    fields = [c for c in found.columns if c not in ("doc_id", "text_hash")]
    own = found.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).agg(F.collect_list(F.struct(*fields)).alias("found"))
    one = texts.join(own, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")))
    return one.select("doc_id", "text_hash", "z", "found")


def repeated_ranges(docs: DataFrame, texts: DataFrame, group_contexts: int = GROUP_CONTEXTS) -> DataFrame:
    """doc_id, text_hash, lo, hi: byte ranges covered by repeated windows; ranges may overlap."""
    spark = docs.sparkSession
    found = materialised(docs.mapInArrow(_anchor_rows, ANCHORS), "suffix-anchors")
    contexts = materialised(found.groupBy("anchor", "c1", "c2").agg(F.count(F.lit(1)).alias("n")), "suffix-contexts")
    per_anchor = contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.count_if(F.col("n") == 1).alias("lone"))
    open_ = per_anchor.filter("kinds > 1 AND lone > 0").select("anchor", (F.col("kinds") > group_contexts).alias("crowded"))
    named = contexts.join(open_, "anchor", "left").filter("n > 1 OR crowded IS NOT NULL").select("c1", "c2", "n", "crowded")
    members = materialised(found.join(named, ["c1", "c2"]), "suffix-members")
    whole = members.filter("n > 1").select("doc_id", "text_hash", F.col("a").cast("long").alias("lo"), (F.col("b") + LENGTH).cast("long").alias("hi"))

    one_each = members.filter("crowded IS NOT NULL")
    lone = one_each.filter("n = 1")
    copies = one_each.filter("n > 1").dropDuplicates(["c1", "c2"])
    picked = materialised(lone.unionByName(copies).select("doc_id", "text_hash", "a", "b", "p", "anchor", "head", "n", "crowded"), "suffix-open")
    calm = picked.filter("NOT crowded")
    size = calm.agg(F.sum(F.col("b") - F.col("a") + LENGTH)).first()[0] or 0
    ranges = max(1, -(-int(size) // RANGE_BYTES))
    splitters: list[int] = []
    if ranges > 1:
        # quantiles by a percentile sketch: the answer is as long as there are ranges, and any cut sorts right
        splitters = sorted(set(calm.agg(F.percentile_approx("head", [i / ranges for i in range(1, ranges)], 10_000)).first()[0]))
    # fewer beginnings than ranges hold more than a range's bytes
    heads = calm.groupBy("head").agg(F.sum(F.col("b") - F.col("a") + LENGTH).alias("bytes")).filter(F.col("bytes") > RANGE_BYTES).collect() if ranges > 1 else []
    parts = {r["head"]: min(SPLITS, -(-int(r["bytes"]) // RANGE_BYTES)) for r in heads}
    runs = _with_texts(calm, texts).mapInArrow(_runs(splitters, parts), RUN)
    partial = runs.groupBy("range").applyInArrow(_merge_range, "doc_id long, text_hash long, lo long, hi long")
    out = whole.unionByName(partial)

    if not picked.filter("crowded").isEmpty():
        text_batches(spark)
        windows = materialised(_with_texts(picked.filter("crowded"), texts).mapInArrow(_window_rows, "doc_id long, text_hash long, lo long, anchor long, o long, fp long, fp2 long, n long"), "suffix-windows")
        twice = windows.groupBy("anchor", "o", "fp", "fp2").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
        hit = windows.filter("n = 1").join(twice, ["anchor", "o", "fp", "fp2"])
        out = out.unionByName(hit.select("doc_id", "text_hash", "lo", (F.col("lo") + LENGTH).alias("hi")))
    return out


CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(keep_bytes: bool):
    """The columns ``CUT`` of each text, and with ``keep_bytes`` what is left of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inflate = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            kept_texts = []
            for z, lows, highs in zip(batch.column(1), batch.column(2), batch.column(3)):
                text = inflate(z.as_py())
                kept, removed, spans = text, 0, 0
                if lows.is_valid and len(lows):
                    lo, hi = lows.values.to_numpy(), highs.values.to_numpy()
                    order = np.argsort(lo, kind="stable")
                    lo, hi = lo[order], np.maximum.accumulate(hi[order])
                    new = np.concatenate([[True], lo[1:] > hi[:-1]])
                    lo, hi = lo[new], hi[np.append(np.flatnonzero(new)[1:] - 1, len(hi) - 1)]
                    kept = b"".join(text[s:e] for s, e in zip([0, *hi.tolist()], [*lo.tolist(), len(text)]))
                    removed, spans = int((hi - lo).sum()), len(lo)
                for col, v in zip(cols, (len(text), removed, spans, hashlib.sha256(kept).hexdigest())):
                    col.append(v)
                if keep_bytes:
                    kept_texts.append(kept)
            out = [batch.column(0), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_bytes:
                out, names = [*out, pa.array(kept_texts, pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(out, names)

    return run


def remove_repeats(docs: DataFrame, keep_bytes: bool = True, group_contexts: int = GROUP_CONTEXTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the remaining bytes ``kept``, for every row."""
    text_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    texts = _compressed(own)
    found = repeated_ranges(own, texts, group_contexts)
    lists = found.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).agg(F.collect_list(F.struct("lo", "hi")).alias("r"))
    joined = texts.join(lists, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left")
    return joined.select("doc_id", "z", F.col("r.lo").alias("lows"), F.col("r.hi").alias("highs")).mapInArrow(_cut(keep_bytes), CUT + ", kept binary" * keep_bytes)
