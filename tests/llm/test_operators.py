"""Each operator on odd rows, and against a brute-force version on real ones."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tracegrid.llm import ann, decontaminate, entry, line_dedup, minhash, packing, quality, sharding, suffix_dedup, toxicity, warc
from tracegrid.llm.runtime import table

LONG = " ".join(f"word{i * 7919 % 10007}" for i in range(20_000))
NEAR = " ".join(f"w{i}" for i in range(200))
ODD = [
    (1, NEAR), (2, NEAR), (2, NEAR), (3, NEAR.replace("w150", "changed")), (4, None), (5, ""), (6, "   \n\n "), (7, LONG), (8, LONG + " end"), (9, "two words"), (10, "Two, WORDS!"),
    (11, "l1\nl2\nl3\nl4\n\nl1\nl2\nl3\nl5"), (12, "x\nl1\n l2 \nl3"), (None, NEAR), (13, "ünïcödé 文字 " * 30), (14, "a a a a a a a a a a a a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows with extra columns whose names the operators use inside."""
    rows = [(d, t, "en", "s", len(t or ""), "k", 1, 2, 3.5) for d, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h1 string, n long, bucket long, c double")


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("false")


def read(name):
    return duckdb.sql(f"SELECT * FROM '{SF}/{name}.parquet'")


# ---------------------------------------------------------------- 1


def test_minhash_odd_rows(odd, none):
    got = [(r["doc_id"], r["class_id"]) for r in minhash.near_duplicate_classes(odd).collect()]
    assert len(got) == len(ODD)
    c = dict(got)
    assert c[1] == c[2] == c[3] == 1 and c[7] == c[8] == 7 and c[9] == c[10] == 9 and c[None] is None
    assert all(c[d] == d for d in (4, 5, 6, 11, 12, 13, 14))
    kept = minhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 4, 5, 6, 7, 9, 11, 12, 13, 14, None]))
    assert minhash.near_duplicate_classes(none).count() == 0 and minhash.drop_near_duplicates(none).count() == 0


def brute_classes(rows):
    import pyarrow as pa

    from tracegrid.llm.textvec import shingles, words

    ids, texts = [r[0] for r in rows], [r[1] for r in rows]
    w, wp = words(pa.array(texts, pa.string()))
    s, sp = shingles(w, wp)
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index, same = defaultdict(set), defaultdict(list)
    for d in range(len(ids)):
        if wp[d + 1] > wp[d]:
            same[w[wp[d] : wp[d + 1]].tobytes()].append(d)
        for x in s[sp[d] : sp[d + 1]].tolist():
            index[x].add(d)
    pairs = {(a, b) for v in index.values() for a in v for b in v if a < b} | {(v[0], b) for v in same.values() for b in v[1:]}
    for a, b in pairs:
        own = [s[sp[d] : sp[d + 1]] for d in (a, b)]
        equal = w[wp[a] : wp[a + 1]].tobytes() == w[wp[b] : wp[b + 1]].tobytes()
        if equal or minhash.aligned_similarity(*own) >= 0.8 - 1e-9:
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return {ids[d]: ids[find(d)] for d in range(len(ids))}


def test_minhash_against_brute_force(spark):
    rows = read("documents").project("doc_id, text").order("doc_id").fetchall()
    got = entry.op1_order_minhash(spark, SF).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == brute_classes(rows)


def test_minhash_joins_strays_of_a_group(spark):
    """A hub with edited copies: copies far from each other meet through the hub, however buckets lead."""
    rng = np.random.default_rng(3)
    base = [f"t{i}" for i in range(160)]
    rows = [(0, " ".join(base))]
    for d in range(1, 120):
        own = list(base)
        for at in rng.choice(160, int(rng.integers(1, 8)), replace=False):
            own[at] = f"e{d}_{at}"
        rows.append((d, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicate_classes(docs).collect()}
    assert got == brute_classes(rows)


def test_minhash_keeps_texts_of_one_id_apart(spark):
    """Rows that share a doc_id but not the text are judged each for itself, whatever their order."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, a, "x"), (5, b, "y"), (5, b, "z"), (6, b + " tail", "u"), (7, a.upper(), "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra string")
    kept = sorted((r["doc_id"], r["text"]) for r in minhash.drop_near_duplicates(docs).collect())
    assert kept == [(5, a), (5, b)]
    got = sorted((r["doc_id"], r["class_id"], r["n_copies"], r["n_links"]) for r in minhash.near_duplicate_classes(docs).collect())
    assert got == [(5, 5, 2, 0), (5, 5, 2, 1), (5, 5, 2, 1), (6, 5, 1, 1), (7, 5, 2, 0)]


def test_minhash_of_short_texts(spark, monkeypatch):
    """Of short texts no pair is missed, and hot keys change nothing."""
    from tracegrid.llm import runtime

    monkeypatch.setattr(runtime, "HOT_ROWS", 2)
    monkeypatch.setattr(runtime, "SHARES", 8)
    rng = np.random.default_rng(4)
    rows = []
    for g in range(60):
        own = [f"g{g}w{i}" for i in range(int(rng.integers(5, 40)))]
        rows += [(3 * g, " ".join(own)), (3 * g + 1, " ".join(["before", *own])), (3 * g + 2, " ".join([*own, "after", "all"]))]
    rows += [(1000 + i, " ".join([*(f"hot{j}" for j in range(30)), f"end{i}"])) for i in range(60)]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows) and len(set(got.values())) < 150


# ---------------------------------------------------------------- 2


def test_warc_odd_pages(spark):
    page = "<p>" + "x" * 120 + "</p>"
    rows = [(3, "http://a/", page), (1, "http://b/?q=1", page), (1, "http://b/?q=1", page), (2, None, page), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (None, "u", page), (8, "bad\r\nWARC-Type: x", "WARC/1.1\r\n\r\n\r\nContent-Length: 5 é"), (9, "u", "y" * 300_000)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    for d, _, html in rows:
        data = (html or "").encode()
        assert by[d]["payload_bytes"] == len(data) and by[d]["payload_digest"] == hashlib.sha256(data).hexdigest()
    assert {d: (r["record_type"], r["refers_to"]) for d, r in by.items() if d in (1, 2, 3, None, 6, 7)} == {
        1: ("response", None), 2: ("revisit", 1), 3: ("revisit", 1), None: ("revisit", 1), 6: ("response", None), 7: ("response", None),
    }
    assert warc.round_trip(pages.filter("false")).count() == 0


def test_warc_of_one_hot_payload(spark, monkeypatch):
    """A payload that most pages share is spread over files and tasks, with the same rows."""
    from tracegrid.llm import runtime

    monkeypatch.setattr(runtime, "HOT_ROWS", 10)
    monkeypatch.setattr(runtime, "SHARES", 20)
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    rows = [(i, f"http://h/{i}", "<p>" + ("same " * 60 if i % 3 else f"own {i} " * 40) + "</p>") for i in range(300)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r["page_id"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == sorted(
        (i, hashlib.sha256(h.encode()).hexdigest(), "revisit" if i % 3 and i > 1 else "response", 1 if i % 3 and i > 1 else None) for i, _, h in rows
    )


def test_warc_nested_capture(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://h/x", "<b>é</b>")], "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "w"))
    one = warc.assemble(warc.read_records(spark, str(tmp_path / "w"))).collect()
    assert len(one) == 1 and bytes(one[0]["capture"]["payload"]).decode() == "<b>é</b>" and one[0]["capture"]["http_status"] == 200
    assert [r["warc_type"] for r in one[0]["requests"]] == ["request"] and one[0]["metadata"][0]["fields"]["page_id"] == "1"


# ---------------------------------------------------------------- 3


def shingle_list(text):
    w = re.findall("[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute_leaks(docs, items):
    out = {}
    for d, t in docs:
        s = shingle_list(t)
        have = set(s)
        for i, it in items:
            n = min(len(it), len(s))
            if not have & set(it):
                continue
            best = 0.0
            for at in range(len(s) - n + 1):
                common = sum((Counter(s[at : at + n]) & Counter(it)).values())
                best = max(best, common / (n + len(it) - common))
            if best >= 0.8 - 1e-9:
                out[d, i] = best
    return out


def test_decontamination_against_brute_force(spark):
    docs = read("documents").project("doc_id, text").fetchall()
    items = [(i, shingle_list(t)) for i, t in read("benchmark").project("item_id, text").fetchall()]
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in entry.op3_simhash_decontamination(spark, SF).collect()}
    want = brute_leaks(docs, items)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and want


def test_decontamination_odd_rows(spark, odd, none):
    item = " ".join(f"w{i}" for i in range(40, 80))
    bench = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "w1 w2", "x"), (4, "", "x"), (5, item.upper(), "x"), (None, item, "x")], "item_id long, text string, sh string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(odd, bench).collect()}
    assert got == {(d, i) for d in (1, 2, 3, None) for i in (1, 5, None)}
    kept = decontaminate.decontaminated(odd, bench)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14]
    assert decontaminate.leaks(none, bench).count() == 0 and decontaminate.leaks(odd, bench.filter("false")).count() == 0


def test_decontamination_of_rotated_and_edited_items(spark, monkeypatch):
    """Question before context, swapped halves and word edits: windows that no shared shingle's place in the item points to."""
    rng = np.random.default_rng(5)
    word = lambda tag, n: [f"{tag}{i}" for i in range(n)]
    items, docs = [], []
    for i in range(30):
        item = word(f"i{i}x", int(rng.integers(50, 110)))
        items.append((i, " ".join(item)))
        turn = [20, len(item) // 2, 60][i % 3] % len(item)
        edited = list(item)
        for k in range(int(rng.integers(1, 5))):
            at = int(rng.integers(len(edited)))
            edited[at : at + int(rng.integers(2))] = [f"e{k}"] * int(rng.integers(2))
        for d, held in enumerate((item[-turn:] + item[:-turn], edited)):
            docs.append((2 * i + d, " ".join(word("before", 37) + held + word("after", 23))))
    docs += [(100, docs[0][1] + " " + docs[6][1] + " " + docs[0][1]), (101, " ".join(t for _, t in docs))]
    monkeypatch.setattr(decontaminate, "SEGMENT", 1)  # the last document is then cut into many pieces
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in got.collect()}
    want = brute_leaks(docs, [(i, shingle_list(t)) for i, t in items])
    # two fingerprints find a window of just 0.8 with a probability of about 0.997
    assert {k for k, v in want.items() if v >= 0.82} <= got.keys() <= want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert sum(d % 2 == 0 for d, _ in want) > 20


def test_decontamination_in_blocks(spark, odd, monkeypatch):
    bench = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i, i + 30))) for i in range(0, 100, 10)], "item_id long, text string")
    whole = sorted((str(r["doc_id"]), r["item_id"]) for r in decontaminate.leaks(odd, bench).collect())
    monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", 40)
    assert sorted((str(r["doc_id"]), r["item_id"]) for r in decontaminate.leaks(odd, bench).collect()) == whole and len(whole) == 40


def test_decontamination_is_native(spark, odd):
    bench = spark.createDataFrame([(1, NEAR)], "item_id long, text string")
    plan = decontaminate.leaks(odd, bench)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---------------------------------------------------------------- 4


def brute_cut(texts, length):
    count = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        cover = [False] * len(b)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                cover[i : i + length] = [True] * length
        spans = sum(c and not p for c, p in zip(cover, [False, *cover]))
        kept = bytes(x for x, c in zip(b, cover) if not c)
        out.append((len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("group_contexts,range_bytes", [(20_000, 8 << 20), (2, 8 << 20), (20_000, 2000)])
def test_suffix_dedup_against_brute_force(spark, odd, monkeypatch, group_contexts, range_bytes):
    monkeypatch.setattr(suffix_dedup, "RANGE_BYTES", range_bytes)  # small ranges: common beginnings are split by anchor
    rng = np.random.default_rng(9)
    word = lambda n: "".join(chr(c) for c in rng.integers(97, 105, n))
    shared, periodic = word(900), "ab" * 600
    rows = [(i, word(int(rng.integers(0, 900))) + shared[int(rng.integers(0, 300)) :] + word(int(rng.integers(0, 500)))) for i in range(30)]
    rows += [(40, periodic), (41, periodic[:401]), (42, shared + word(10) + shared), (43, None), (44, "é" * 500), (45, "short"), (45, "short"), (46, shared), (46, shared), (None, shared[:450])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lo int")
    got = suffix_dedup.remove_repeats(docs, group_contexts=group_contexts).collect()
    mine = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got)
    want = brute_cut([(t or "").encode() for _, t in rows], 400)
    assert mine == sorted((str(d), *w) for (d, _), w in zip(rows, want))
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in got)


def test_suffix_dedup_on_documents(spark, none):
    rows = read("documents").project("doc_id, text").fetchall()
    got = {r["doc_id"]: tuple(r)[1:] for r in entry.op4_suffix_dedup(spark, SF).collect()}
    assert got == {d: w for (d, _), w in zip(rows, brute_cut([(t or "").encode() for _, t in rows], 400))}
    assert suffix_dedup.remove_repeats(none).count() == 0


# ---------------------------------------------------------------- 5 and 9


@pytest.mark.parametrize("run,target,least", [(entry.op5_counterfactual_toxicity, "toxic", 0.9), (entry.op9_gam_quality, "quality", 0.95)])
def test_classifiers_hold_out(spark, run, target, least):
    folder = "/root/testdata/sf0.1"
    labels = dict(duckdb.sql(f"SELECT doc_id, {target} FROM '{folder}/labels.parquet'").fetchall())
    got = run(spark, folder).collect()
    assert len(got) == 10_000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > least
    y, s = np.array([labels[r["doc_id"]] for r in held]), np.array([r["score"] for r in held])
    assert (s[y == 1][:, None] > s[y == 0][None, :]).mean() > least


@pytest.mark.parametrize("classify", [toxicity.classify, quality.classify])
def test_classifiers_on_odd_rows(spark, odd, none, classify):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (3, 1, 1), (7, 0, 0), (99, 1, 1), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    got = classify(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert classify(odd, labels.filter("false")).first()["score"] == 0.5 and classify(none, labels).count() == 0


@pytest.mark.parametrize("times", [1, 2, 4])
def test_group_names_move_no_score(spark, times):
    """A name with its own beginnings and counts goes with the label; swapping it must leave the score as it is."""
    rng = np.random.default_rng(11)
    rows, labels = [], []
    for d in range(1500):
        y = d % 2
        own = [f"filler{i}" for i in rng.integers(0, 300, 12)] + ["muslim" if rng.random() < 0.1 + 0.6 * y else "christian"] * times
        own += ["vileinsult"] if y and rng.random() < 0.8 else []
        rows.append((d, " ".join(rng.permutation(own))))
        labels.append((d, y))
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    import pyarrow as pa

    for n in {1, times}:
        scores = model.score(pa.array([f"{f'{group} ' * n}people met" for group in ("muslim", "Christian", "jewish", "buddhist", "sikh", "hindu")]))
        assert np.ptp(scores) < 0.02
    assert model.score(pa.array(["a vileinsult"]))[0] > 0.9
    assert np.mean((model.score(pa.array([t for _, t in rows])) > 0.5) == np.array([y for _, y in labels])) > 0.85
    rows, copies = toxicity.swapped_copies(pa.array(["A Muslim, a MUSLIM and Jews.", None, "none"]))
    assert rows.tolist() == [0] * toxicity.SWAPS and all("muslim" not in c and "jews" not in c and c.startswith("a ") and c.endswith(".") for c in copies.to_pylist())


def test_labels_of_held_out_rows_are_not_learned(spark, odd):
    ids = [i for i in range(1, 15) if zlib.crc32(str(i).encode()) % 5 == 0]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in ids], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.classify(odd, labels).collect()} == {0.5} == {r["score"] for r in toxicity.classify(odd, labels).collect()}


# ---------------------------------------------------------------- 6


def test_packing(spark, odd, none):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    inner = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    want = Counter()
    for d, t in ODD:
        ids = np.array([*inner.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.update((d, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids))))
    rows = packing.pack(packing.pieces(odd, keep_ids=True))
    got = rows.collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 1024
    filled = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(rows).collect()}
    assert {k: len(v) // 4 for k, v in filled.items()} == {k: sum(n for _, n in v) for k, v in by.items()}
    assert packing.pack(packing.pieces(none)).count() == 0


def test_packing_of_texts_with_added_tokens(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    inner = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, f"{end}x", f"x  {end}", f"{end}{end}", f"a\n\n{end}  {end}\n b", "<|endoftext|", f"<{end}>", f"<|ENDOFTEXT|> {end * 700}", f"{end}{' ' * 150_000}{end}z"]
    want = [np.array([*inner.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes() for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for path in (None, public.path("byte_bpe_50k.json")):
        got = defaultdict(bytes)
        for r in sorted(packing.pieces(docs, path, keep_ids=True).collect(), key=lambda r: r["piece"]):
            got[r["doc_id"]] += bytes(r["ids"])
        assert [got[d] for d in range(len(texts))] == want


def test_packing_partitions_exchange(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_PER_PARTITION", 60)
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 1025, 600)
    rows = spark.createDataFrame([(int(i), int(s)) for i, s in enumerate(sizes)], "doc_id long, length long")
    got = packing.pack(rows).collect()
    assert len(got) == 600
    n = len({r["sequence_id"] for r in got})
    assert packing.lower_bound(sizes) <= n <= packing.lower_bound(sizes) * 1.05 + 3
    by = defaultdict(int)
    for r in got:
        by[r["sequence_id"]] += r["length"]
    assert max(by.values()) <= 1024


# ---------------------------------------------------------------- 7


@pytest.mark.parametrize("block,group,nodes", [(1024, 16, 4096), (7, 2, 300)])
def test_search_recall_and_ties(spark, monkeypatch, block, group, nodes):
    monkeypatch.setattr(ann, "QUERY_BLOCK", block)
    monkeypatch.setattr(ann, "GROUP_BLOCKS", group)
    monkeypatch.setattr(ann, "SHARD_NODES", nodes)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(2000 + i, x[7].tolist(), 0) for i in range(40)] + [(7, x[7].tolist(), 0)]
    rows += [(3000, None, 0), (3100, [], 0), (3200, [0.0] * 16, 0), (3300, [float("nan")] * 16, 0), (3400, [None] * 16, 0), (3500, [float("inf")] * 16, 0), (None, x[1].tolist(), 0), (3600, [1.0, 2.0], 0)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int")
    got = defaultdict(list)
    for r in ann.nearest_neighbours(e, every=20).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    queries = ann.usable(e).filter("vec_id % 20 = 0").distinct().select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query_vector"))
    want = defaultdict(list)
    for r in ann.exact_search(e, queries).collect():
        want[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert got.keys() == want.keys() and 3600 not in got and not {3000, 3100, 3200, 3300, 3400, 3500} & got.keys()
    hits = sum(len({v for _, v, _ in got[q]} & {v for _, v, _ in want[q]}) for q in want)
    assert hits >= 0.95 * sum(len(v) for v in want.values())
    for q, own in got.items():
        own.sort()
        assert [r for r, _, _ in own] == list(range(1, len(own) + 1)) and [(s, v) for _, v, s in own] == sorted((s, v) for _, v, s in own)
    assert [v for _, v, _ in sorted(got[2000])] == [7, *range(2001, 2010)]
    assert ann.nearest_neighbours(e.filter("false")).count() == 0 and ann.nearest_neighbours(e.filter("vec_id IN (0, 1, 2)")).count() == 2


# ---------------------------------------------------------------- 8


def test_line_dedup(spark, odd, none):
    out = line_dedup.dedup_lines(odd)
    assert out.columns == [*odd.columns, "lines_total", "lines_removed"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[11]["text"] == "l1\nl2\nl3\nl4\n\nl5" and got[11]["lines_removed"] == 3
    assert got[12]["text"] == "x" and got[4]["text"] is None and got[5]["text"] == "" and got[7]["text"] == LONG
    assert out.count() == len(ODD) and line_dedup.dedup_lines(none).count() == 0


def test_line_dedup_of_long_texts(spark):
    """A document that loses most of 60,000 lines is cut in time linear in them."""
    lines = [f"line {i}" for i in range(60_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(["own", *lines, "tail"]))], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["lines_total"], r["lines_removed"]) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {1: ("\n".join(lines), 60_000, 0), 2: ("own\ntail", 60_002, 60_000)}


def test_line_dedup_against_duckdb(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.execute(line_dedup.ORACLE_SQL).fetchall()}
    assert {r["doc_id"]: tuple(r)[1:] for r in entry.op8_line_dedup(spark, SF).collect()} == want


# ---------------------------------------------------------------- 10


def brute_shards(texts, shards, key):
    groups = Counter()
    for t in texts:
        groups[t or ""] += len((t or "").encode()) + 8
    total, left = sum(groups.values()), shards
    alone = []
    for t, s in sorted(groups.items(), key=lambda x: -x[1])[: shards - 1]:
        if left <= 1 or s * left < total or s == total:
            break
        alone.append(t)
        total, left = total - s, left - 1
    sizes = np.array([groups[t] for t in sorted(groups.keys() - set(alone), key=key)], np.int64)
    return alone, left, sharding.smallest_capacity(sizes, left)


@pytest.mark.parametrize("bits", [16, 2])
def test_sharding(spark, odd, none, monkeypatch, bits):
    monkeypatch.setattr(sharding, "CELL_BITS", bits)
    monkeypatch.setattr(sharding, "MAX_GROUPS", 200_000 if bits == 16 else 5)
    monkeypatch.setattr(sharding, "ROWS_PER_SLOT_TASK", 50)
    docs = table(spark, SF, "documents").select("doc_id", "text")
    hot = spark.range(1000, 1150).select(F.col("id").alias("doc_id"), F.lit("hot " * 2000).alias("text"))
    heavy = spark.range(2000, 2036).select(F.col("id").alias("doc_id"), F.concat(F.lit("heavy"), (F.col("id") % 12).cast("string"), F.lit(" word" * 4000)).alias("text"))
    for d, k in ((docs, 24), (docs.unionByName(hot), 24), (docs.unionByName(heavy), 24), (odd.select("doc_id", "text"), 24), (docs, 1)):
        rows = d.collect()
        got = sharding.shard(d, k).collect()
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in rows)
        keys = {r["text"]: (r["a"], r["b"]) for r in d.select(F.coalesce("text", F.lit("")).alias("text")).distinct().select("text", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b")).collect()}
        alone, left, capacity = brute_shards([r["text"] for r in rows], k, keys.__getitem__)
        load, slots, home = Counter(), defaultdict(list), defaultdict(set)
        for r in got:
            load[r["shard"]] += r["size"]
            slots[r["shard"]].append(r["slot"])
            home[r["text_crc32"]].add(r["shard"])
        assert set(load) <= set(range(k)) and all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(h) == 1 for h in home.values())
        assert max(load[s] for s in load if s >= len(alone)) == capacity and {r["law"] for r in got} == {"bytes"}
    assert sharding.shard(none).count() == 0
