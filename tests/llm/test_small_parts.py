"""Parts of the operators against plain versions of themselves."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tracegrid.llm import minhash, packing, quality, sharding, suffix_dedup, textvec, toxicity, warc


def words_of(text):
    import re

    return re.findall("[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


TEXTS = ["Hello, hello wörld! 12", None, "", "   ", "a" * 300, "one two three four five six seven", "one two three four five six seven", "É é\nÀ", "x"]


def test_words_do_not_cross_rows():
    h, ptr = textvec.words(pa.array(TEXTS))
    assert np.diff(ptr).tolist() == [len(words_of(t)) for t in TEXTS]
    seen = {}
    for i, t in enumerate(TEXTS):
        for w, x in zip(words_of(t), h[ptr[i] : ptr[i + 1]].tolist()):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    sliced, sptr = textvec.words(pa.array(TEXTS).slice(4, 3))
    assert sliced.tolist() == h[ptr[4] : ptr[7]].tolist() and sptr.tolist() == (ptr[4:8] - ptr[4]).tolist()


def test_shingles_and_occurrences():
    h, ptr = textvec.words(pa.array(["a b a b a b a b", "a b a b a", "x y"]))
    s, sptr = textvec.shingles(h, ptr)
    assert np.diff(sptr).tolist() == [4, 1, 0] and s[0] == s[2] == s[4] and s[1] == s[3]
    x = textvec.with_occurrence(s, sptr)
    assert len(set(x[:4].tolist())) == 4 and x[0] == x[4]


def test_chunks_cover_all_rows():
    column = pa.array([str(i) * (i % 7) for i in range(100)] + [None, "z" * 5000])
    parts = list(textvec.chunks(column, 64))
    assert sum(len(p) for _, p in parts) == len(column) and [s for s, _ in parts] == np.cumsum([0, *[len(p) for _, p in parts[:-1]]]).tolist()


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = row[:]
        for j, y in enumerate(b):
            row[j + 1] = prev[j] + 1 if x == y else max(prev[j + 1], row[j])
    return row[-1]


def test_banded_alignment_is_exact_within_the_threshold():
    rng = random.Random(5)
    for _ in range(300):
        a = [rng.randrange(30) for _ in range(rng.randrange(1, 60))]
        b = list(a)
        for _ in range(rng.randrange(8)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = [rng.randrange(30)] * rng.randrange(2)
        if not b:
            continue
        true = lcs(a, b)
        sim = true / (len(a) + len(b) - true)
        got = minhash.aligned_similarity(np.array(a, np.uint64), np.array(b, np.uint64))
        assert got == pytest.approx(sim) if sim >= 0.8 else got < 0.8


def test_sketch_keeps_order():
    x = textvec.mix(np.arange(50).astype(np.uint64))
    assert (minhash.order_sketch(x) == minhash.order_sketch(x.copy())).all()
    assert (minhash.order_sketch(x) == minhash.order_sketch(x[::-1])).sum() == 0 and len(minhash.order_sketch(x[:3])) == 0


def test_bin_packing():
    rng = np.random.default_rng(1)
    for n in (1, 5, 200, 3000):
        sizes = rng.integers(1, 1024, n)
        bins, offsets = packing.best_fit_decreasing(sizes)
        bound = packing.lower_bound(sizes)
        used = bins.max() + 1
        assert bound <= used <= bound * 1.25 + 1
        for b in range(used):
            own = np.flatnonzero(bins == b)
            own = own[np.argsort(offsets[own])]
            assert offsets[own].tolist() == np.concatenate([[0], np.cumsum(sizes[own])[:-1]]).tolist() and sizes[own].sum() <= 1024
    assert packing.lower_bound(np.array([600] * 7)) == 7 and packing.lower_bound(np.array([513, 513, 511])) == 2
    assert packing.cut(1) == [(0, 1)] and packing.cut(1024) == [(0, 1024)] and packing.cut(2500) == [(0, 452), (452, 1024), (1476, 1024)]


def test_ids_are_those_of_tokenizers():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    inner = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    inner.encode_special_tokens = True
    rng = random.Random(2)
    odd = ["", " ", "\n", "a\n b", "a \nb", "  a   b  ", "it's 12x", "é è\xa0", "x\r\n\t y", "<|endoftext|> z", "日本 語", "\U0001f600!!"]
    made = ["".join(rng.choice("ab é1'.,\n\t s") for _ in range(60)) for _ in range(300)]
    for text in odd + made:
        want = np.array(inner.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert packing.encoder()(text) == want
        assert packing.encoder(public.path("byte_bpe_50k.json"))(text) == want


def test_ids_of_very_long_whitespace():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    inner = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    for run in (" " * 1_000_001, "\n" * 1_000_001, " \n\xa0" * 400_000):
        for text in (run, f"a b{run}c  d"):
            assert packing.encoder()(text) == np.array(inner.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_smallest_capacity():
    rng = np.random.default_rng(3)
    for _ in range(50):
        sizes = rng.integers(1, 100, rng.integers(1, 12))
        k = int(rng.integers(1, 5))

        def feasible(cap, sizes=sizes, k=k):
            used, load = 1, 0
            for s in sizes:
                if s > cap:
                    return False
                used, load = (used, load + s) if load + s <= cap else (used + 1, s)
            return used <= k

        assert sharding.smallest_capacity(sizes, k) == next(c for c in range(1, 2000) if feasible(c))


def test_loser_tree_merges_front_coded_runs():
    rng = random.Random(4)
    for n_runs in (1, 2, 3, 7):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(0, 30))) for _ in range(n_runs)]
        coded = []
        for r in runs:
            lcp, rest = suffix_dedup.front_coded(r)
            coded.append(suffix_dedup.unfolded(lcp, np.array([len(x) for x in rest], np.int32), b"".join(rest)))
        out = list(suffix_dedup.merged(coded))
        assert [s for _, s, _ in out] == sorted(x for r in runs for x in r)
        for (_, a, _), (_, b, h) in zip(out, out[1:]):
            assert h == suffix_dedup.common_prefix(a, b)


def test_anchors_agree_on_equal_windows():
    rng = np.random.default_rng(6)
    shared = rng.integers(97, 123, 700).astype(np.uint8)
    data = np.concatenate([rng.integers(97, 123, 333).astype(np.uint8), shared, rng.integers(97, 123, 250).astype(np.uint8), shared])
    row, a, b, p, h, *_ = suffix_dedup.anchors(data, np.array([0, len(data)]))
    assert (np.diff(a) > 0).all() and sum(b - a + 1) == len(data) - 399
    place = {int(i): int(q) for x, y, q in zip(a, b, p) for i in range(x, y + 1)}
    shift = 333 + 700 + 250 - 333
    assert all(place[i + shift] - place[i] == shift for i in range(333, 333 + 300))


def peak_mb(f, *args):
    tracemalloc.start()
    out = f(*args)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return out, peak


def test_the_largest_group_of_contexts_takes_little_memory():
    rng = np.random.default_rng(10)
    n, shared = suffix_dedup.GROUP_CONTEXTS, rng.integers(97, 123, 400, np.uint8).tobytes()
    lefts = rng.integers(97, 123, (n, 336), np.uint8)
    contexts = [x.tobytes() + (shared if i % 2 else shared[:-1] + b"!") for i, x in enumerate(lefts)]
    textvec.powers(textvec.CHUNK_BYTES)
    (ctx, lo, hi), peak = peak_mb(suffix_dedup.repeated_windows, contexts, np.full(n, 336), np.zeros(n, np.int64))
    # the last window of each context occurs again, and a few before it by chance
    assert ctx.tolist() == list(range(n)) and (lo > 320).all() and (hi == 336).all()
    assert peak < 200  # 1,220 when all windows were compared at once


def test_anchors_of_long_and_many_texts_take_little_memory():
    rng = np.random.default_rng(11)
    long, short = (rng.integers(97, 123, n, np.uint8).tobytes().decode() for n in (3_000_000, 2048))
    textvec.powers(textvec.CHUNK_BYTES)
    for texts in ([long], [short] * 1000):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)))] * 2 + [pa.array(texts)], ["doc_id", "text_hash", "text"])
        rows, peak = peak_mb(lambda: pa.Table.from_batches(suffix_dedup._anchor_rows([batch])))  # noqa: B023
        size = pa.compute.add(pa.compute.subtract(rows["b"], rows["a"]), 1)
        assert pa.compute.sum(size).as_py() == sum(len(t) - 399 for t in texts)
        assert peak < 100  # 340 and 225 when chunks were of 4 and 2 MB


@pytest.mark.parametrize("segment,hits", [(1, 1), (1500, 7), (1 << 19, 1 << 19)])
def test_repeated_windows_in_any_slices(monkeypatch, segment, hits):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
    monkeypatch.setattr(suffix_dedup, "HITS", hits)
    rng = random.Random(12)
    for _ in range(20):
        contexts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(6, 12))) for _ in range(rng.randrange(1, 40))]
        lefts = [rng.randrange(0, len(c) - 2) for c in contexts]
        groups = [rng.randrange(3) for _ in contexts]
        windows = [(groups[i], lefts[i] - t, c[t : t + 6], i, t) for i, c in enumerate(contexts) for t in range(len(c) - 5)]
        want = {w[3:] for w in windows if sum(w[:3] == x[:3] for x in windows) > 1}
        got = suffix_dedup.repeated_windows(contexts, np.array(lefts), np.array(groups), 6)
        runs = list(zip(*(x.tolist() for x in got)))
        assert sorted((c, t) for c, lo, hi in runs for t in range(lo, hi + 1)) == sorted(want)
        assert all((c, lo - 1) not in want and (c, hi + 1) not in want for c, lo, hi in runs)


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(7)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9 and (0, 1) in model.pairs
    assert quality.AdditiveModel().score(x[:2]).tolist() == [0.5, 0.5] and quality.fit(x[:5], np.ones(5)).score(x[:1])[0] > 0.9


def test_identity_terms_move_no_score():
    rng = np.random.default_rng(8)
    n = 600
    y = (rng.random(n) < 0.3).astype(float)
    # feature 0 insults; 1 and 2 name groups, and group 1 is named more in toxic texts
    has = np.stack([y * (rng.random(n) < 0.95), rng.random(n) < 0.1 + 0.4 * y, rng.random(n) < 0.3], axis=1).astype(bool)
    row, at = np.nonzero(has)
    _, biased = toxicity.fit(row, at, y, 3, [])
    _, fair = toxicity.fit(row, at, y, 3, [np.array([1, 2])])
    assert abs(fair[1] - fair[2]) < 0.5 * abs(biased[1] - biased[2]) and fair[0] > 2


def test_warc_parser():
    import gzip

    one = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 30\r\n\r\nHTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\n\r" + b"\r\n\r\n"
    two = b"WARC/1.0\r\nWARC-Type: metadata\r\nX: a\r\n b\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    whole = b"junk\r\n" + one + two + one[:-20]
    for data in (whole, gzip.compress(whole), gzip.compress(one) + gzip.compress(two)):
        got = list(warc.records(warc.inflated(data)))
        assert [dict(h)["warc-type"] for h, _ in got] == ["response", "metadata"] and len(got[0][1]) == 30 and dict(got[1][0])["x"] == "a b"
