"""The pipeline's stages do what they say, each on all that the one before kept."""

from collections import Counter

import pytest

import corpus_pipeline
from tests.conftest import SF
from tests.llm.test_operators import brute_classes, brute_leaks, read, shingle_list
from tracegrid.llm import line_dedup
from tracegrid.llm.packing import lower_bound
from tracegrid.llm.quality import THRESHOLD, classify
from tracegrid.llm.runtime import materialised, table


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = materialised(stage(spark, docs, SF), f"test-{name}")
        before, after = docs.collect(), out.collect()
        if name != "packing":
            assert out.columns == columns
        if name == "quality":
            score = {r["doc_id"]: r["score"] for r in classify(docs, table(spark, SF, "labels")).collect()}
            assert {r["doc_id"] for r in after} == {d for d, s in score.items() if s >= THRESHOLD}
        elif name == "line_dedup":
            whole = line_dedup.dedup_lines(docs).collect()
            emptied = {r["doc_id"] for r in whole if r["lines_removed"] and not (r["text"] or "").strip()}
            assert Counter(r["doc_id"] for r in after) == Counter(r["doc_id"] for r in before if r["doc_id"] not in emptied) and emptied
            assert sum(len(r["text"]) for r in after) < sum(len(r["text"]) for r in before)
        elif name == "near_dedup":
            classes = brute_classes([(r["doc_id"], r["text"]) for r in sorted(before, key=lambda r: r["doc_id"])])
            assert {r["doc_id"] for r in after} == {d for d, c in classes.items() if d == c}
        elif name == "decontamination":
            items = [(i, shingle_list(t)) for i, t in read("benchmark").project("item_id, text").fetchall()]
            bad = {d for d, _ in brute_leaks([(r["doc_id"], r["text"]) for r in before], items)}
            assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before} - bad
        else:
            assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
            import numpy as np

            sizes = np.array([r["length"] for r in after])
            assert len({r["sequence_id"] for r in after}) <= lower_bound(sizes) * 1.05 + 2
        kept[name] = len(after)
        docs = out
    assert kept["quality"] > kept["near_dedup"] > 0


def test_empty_corpus(spark):
    docs = table(spark, SF, "documents").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


@pytest.fixture()
def odd_folder(spark, tmp_path):
    """A corpus of odd rows with clashing columns, its labels and its benchmark."""
    near = [f"w{i}" for i in range(200)]
    changed = [*near[:150], "changed", *near[151:]]
    rows = [
        (1, " ".join(near)), (1, " ".join(near)), (2, " ".join(changed)), (3, None), (4, ""), (5, "  \n \n "), (6, "head\nl1\nl2\nl3"), (7, "l1\nl2\nl3"), (None, " ".join(near)), (None, None),
        (8, "one text of its own with some more words behind it"), (8, "another text that shares nothing but the number it has"), (9, " ".join(f"v{i * 7919 % 10007}" for i in range(30_000))),
        (10, " ".join(["before", *[f"leak{i}" for i in range(60)], "after"])), (11, "a <|endoftext|> b"),
    ]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), 0.1, 7, "x", 3, "p") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, lines_total long, h1 string, salts int, piece string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(1, 12)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"leak{i}" for i in range(60))), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), docs


def test_odd_rows(spark, odd_folder):
    folder, docs = odd_folder
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = materialised(stage(spark, docs, folder), f"test-odd-{name}")
        seen[name] = Counter((r["doc_id"]) for r in docs.collect())
        if name != "packing":
            assert docs.columns == columns and docs.filter("score <> 0.1 OR lines_total <> 7 OR h1 <> 'x' OR salts <> 3 OR piece <> 'p'").isEmpty()
    assert sum(seen["quality"].values()) == 15  # labels of one kind reject nothing
    assert seen["line_dedup"] == seen["quality"] - Counter([7])
    assert seen["near_dedup"] == Counter([1, 3, 4, 5, 6, 8, 8, 9, 10, 11, None, None])
    assert seen["decontamination"] == seen["near_dedup"] - Counter([10])
    assert set(seen["packing"]) == set(seen["decontamination"]) and seen["packing"][9] > 1
