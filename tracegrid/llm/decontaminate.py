"""Benchmark decontamination: SimHash windows, multi-index Hamming search, exact verification.

Texts are lower-cased and cut into words (runs of ASCII letters and digits and of non-ASCII characters);
five consecutive words are a shingle. A document's windows have the word count of a benchmark item and are
compared with items of that count. The shared shingles only find the regions: a window of n shingles and an
item of m can reach similarity 0.8 only if at least 0.8 / 1.8 * (n + m) of the window's places hold a shingle
of some item of m shingles. All windows that do are laid, wherever the item has those shingles; the others
cannot be leaks. Each window gets two 64-bit SimHashes over its shingles, weighted by how often they occur.
Fingerprints are cut into ``BLOCKS`` blocks: two that differ in at most ``RADIUS`` bits differ in at most
RADIUS // BLOCKS bits of some block, and every such block value is looked up, so no fingerprint within the
radius is missed.
The candidates' exact similarity is the weighted Jaccard of both multisets of shingles, the sum of the
lesser counts over the sum of the greater ones; 0.8 or more is a leak.

Only DataFrame functions are used. Benchmark shingles are broadcast in blocks of at most
``BROADCAST_SHINGLES`` rows, however large the benchmark is; each block reads the documents once.

Defined cases: null and empty texts, and texts or items of fewer than five words, match nothing; a
document shorter than an item is one window; a null ``doc_id`` or ``item_id`` is carried as it is; rows
that repeat ``doc_id`` and text give the same matches once. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.llm.runtime import materialised

SHINGLE_WORDS = 5
SIMILARITY = 0.8
RADIUS = 14
BLOCK_BITS = (13, 13, 13, 13, 12)
BLOCKS = len(BLOCK_BITS)
BROADCAST_SHINGLES = 1_000_000
SEGMENT = 1024
WORD_GAP = "[^a-z0-9\\x{80}-\\x{10FFFF}]+"


def shingled(rows: DataFrame, keys: list[Column], text: Column) -> DataFrame:
    """``keys`` and ``sh``, the array of shingle hashes in text order; rows without a shingle are left out."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_GAP, -1)
    cut = rows.select(*keys, parts.alias("_p"))
    lead = (F.col("_p")[0] == "").cast("int")
    trail = F.when(F.size("_p") > 1, (F.element_at("_p", -1) == "").cast("int")).otherwise(0)
    names = [c for c in cut.columns if c != "_p"]
    words = cut.select(*names, F.slice("_p", lead + 1, F.size("_p") - lead - trail).alias("_w")).filter(F.size("_w") >= SHINGLE_WORDS)
    own = lambda x, i: F.xxhash64(x, *[F.get(F.col("_w"), i + F.lit(j)) for j in range(1, SHINGLE_WORDS)])
    return words.select(*names, F.transform(F.slice("_w", 1, F.greatest(F.lit(0), F.size("_w") - SHINGLE_WORDS + 1)), own).alias("sh"))


def fingerprint(hashes: str) -> Column:
    """The 64-bit SimHash of an array of hashes; a hash that occurs n times has weight n."""
    ones = f"aggregate({hashes}, 0, (s, x) -> s + cast(shiftright(x, b) & 1L as int))"
    return F.expr(f"aggregate(sequence(0, 63), 0L, (f, b) -> f | if(2 * {ones} > size({hashes}), shiftleft(1L, b), 0L))")


def with_fingerprints(rows: DataFrame) -> DataFrame:
    """Adds ``fp``, the two SimHashes of ``sh``."""
    names = rows.columns
    again = rows.select(*names, F.transform("sh", lambda x: F.xxhash64(x)).alias("_sh2"))
    return again.select(*names, F.array(fingerprint("sh"), fingerprint("_sh2")).alias("fp"))


def _masks(width: int, flips: int) -> list[int]:
    return [sum(1 << b for b in c) for k in range(flips + 1) for c in combinations(range(width), k)]


def _flipped(masks: Column, value: Column, block: int) -> Column:
    return F.transform(masks, lambda m: F.struct(F.lit(block).alias("block"), value.bitwiseXOR(m).alias("value")))


def block_keys(flips: int) -> Column:
    """Array of (block number, block value) of ``fp``, each value with up to ``flips`` bits flipped."""
    parts = []
    for t in range(2):
        shift = 0
        for k, width in enumerate(BLOCK_BITS):
            value = F.shiftright(F.col("fp")[t], shift).bitwiseAND(F.lit((1 << width) - 1))
            masks = F.array(*[F.lit(m).cast("long") for m in _masks(width, flips)])
            parts.append(_flipped(masks, value, t * BLOCKS + k))
            shift += width
    return F.concat(*parts)


def weighted_similarity() -> Column:
    """Weighted Jaccard of the multisets ``sh`` and ``item_sh``."""
    lesser = "aggregate(array_intersect(sh, item_sh), 0, (s, x) -> s + least(size(filter(sh, y -> y = x)), size(filter(item_sh, y -> y = x))))"
    common = F.expr(lesser)
    return common / (F.size("sh") + F.size("item_sh") - common)


def segments(docs: DataFrame, longest: int) -> DataFrame:
    """Documents in pieces: doc_id, text_hash, size (of the document), base, sh.

    A window of at most ``longest`` shingles that starts in a stretch of the document lies in that stretch's piece.
    Pieces bound what each shared shingle carries, however long the document is.
    """
    step = max(SEGMENT, 4 * longest)
    text = shingled(docs, [F.col("doc_id"), F.xxhash64("text").alias("text_hash")], F.col("text"))
    piece = F.transform(F.sequence(F.lit(0), F.size("sh") - 1, F.lit(step)), lambda x: F.struct(x.alias("base"), F.slice("sh", x + 1, step + longest - 1).alias("sh")))
    cut = text.select("doc_id", "text_hash", F.size("sh").alias("size"), F.explode_outer(piece).alias("p"))
    return cut.select("doc_id", "text_hash", "size", F.col("p.base").alias("base"), F.col("p.sh").alias("sh"))


def window_starts() -> Column:
    """Starts of all windows of ``n`` shingles in ``sh`` that hold at least ``need`` of the places ``at``.

    The windows that hold the places i to i + need - 1 start in one range; the ranges of all i are all such windows.
    """
    last = "get(at, i + need - 1)"
    low, high = f"greatest(0, {last} - n + 1)", "least(get(at, i), size(sh) - n)"
    ranges = f"transform(sequence(0, size(at) - need), i -> if({low} <= {high}, sequence({low}, {high}, 1), cast(array() as array<int>)))"
    return F.expr(f"if(size(at) < need, cast(array() as array<int>), array_distinct(flatten({ranges})))")


def windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """All item-sized windows that can reach the similarity: doc_id, text_hash, m, start, sh."""
    anchors = items.select("m", F.explode("item_sh").alias("h")).distinct()
    size = items.agg(F.max("m")).first()[0] or 1
    blocks = max(1, -(-anchors.count() // BROADCAST_SHINGLES))
    each = segments(docs, size).select("doc_id", "text_hash", "size", "base", "sh", F.posexplode_outer("sh").alias("pos", "h"))
    found = []
    for b in range(blocks):
        own = anchors.filter(F.pmod(F.xxhash64("h"), F.lit(blocks)) == b)
        found.append(each.join(F.broadcast(own), "h").select("doc_id", "text_hash", "size", "base", "m", "pos", "sh"))
    places = reduce(DataFrame.unionByName, found).groupBy("doc_id", "text_hash", "base", "m")
    places = places.agg(F.array_sort(F.collect_set("pos")).alias("at"), F.first("size").alias("size"), F.first("sh").alias("sh"))
    # lesser / (n + m - lesser) >= s only where lesser, and so the count of places, is at least s / (1 + s) * (n + m)
    need = F.ceil(SIMILARITY / (1 + SIMILARITY) * (F.col("n") + F.col("m")) - 1e-6).cast("int")
    places = places.withColumn("n", F.least("m", "size")).withColumn("need", need)
    laid = places.select("doc_id", "text_hash", "m", "n", "base", "sh", F.explode(window_starts()).alias("start"))
    return laid.select("doc_id", "text_hash", "m", (F.col("base") + F.col("start")).alias("start"), F.slice("sh", F.col("start") + 1, F.col("n")).alias("sh"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item it holds: the best window, its distance and its similarity."""
    items = shingled(benchmark, [F.col("item_id").alias("item_id")], F.col("text")).withColumnRenamed("sh", "item_sh")
    items = materialised(items.withColumn("m", F.size("item_sh")), "leak-items")
    found = materialised(
        windows(docs, items).withColumn("w1", F.hash("sh").cast("long")).withColumn("w2", F.xxhash64("sh")), "leak-windows"
    )
    prints = materialised(with_fingerprints(found.select("w1", "w2", "m", "sh").dropDuplicates(["w1", "w2", "m"])), "leak-prints")
    item_prints = materialised(with_fingerprints(items.withColumnRenamed("item_sh", "sh")).withColumnsRenamed({"sh": "item_sh", "fp": "item_fp"}), "leak-item-prints")
    per_block = RADIUS // BLOCKS
    left = prints.select("w1", "w2", "m", "fp", F.explode(block_keys(per_block - per_block // 2)).alias("k")).select("w1", "w2", "m", "fp", "k.*")
    right = item_prints.withColumnRenamed("item_fp", "fp").select("item_id", "m", "fp", F.explode(block_keys(per_block // 2)).alias("k"))
    right = right.select("item_id", "m", F.col("fp").alias("item_fp"), "k.*")
    apart = F.least(*[F.bit_count(F.col("fp")[t].bitwiseXOR(F.col("item_fp")[t])) for t in range(2)])
    near = left.join(right, ["m", "block", "value"]).select("w1", "w2", "m", "item_id", apart.alias("hamming")).filter(F.col("hamming") <= RADIUS).distinct()
    verified = (
        near.join(prints.select("w1", "w2", "m", "sh"), ["w1", "w2", "m"])
        .join(items, near["item_id"].eqNullSafe(items["item_id"]) & (near["m"] == items["m"]))
        .select("w1", "w2", near["m"], near["item_id"], "hamming", weighted_similarity().alias("similarity"), F.size("sh").alias("n"))
        .filter(F.col("similarity") >= SIMILARITY - 1e-9)
    )
    best = F.max_by(F.struct("start", "n", "hamming", "similarity"), F.struct("similarity", -F.col("hamming"), -F.col("start"), "n"))
    return (
        verified.join(found.select("w1", "w2", "m", "doc_id", "text_hash", "start"), ["w1", "w2", "m"])
        .groupBy("doc_id", "text_hash", "item_id")
        .agg(best.alias("b"))
        .select("doc_id", "item_id", F.col("b.start").cast("long").alias("first_word"), (F.col("b.n") + SHINGLE_WORDS - 1).cast("long").alias("n_words"), F.col("b.hamming").cast("long").alias("hamming"), F.col("b.similarity").alias("similarity"), "text_hash")
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold an item; columns as they were."""
    bad = leaks(docs, benchmark).select(F.col("doc_id").alias("__leak_id"), F.col("text_hash").alias("__leak_hash")).distinct()
    same = docs["doc_id"].eqNullSafe(bad["__leak_id"]) & (F.xxhash64(docs["text"]) == bad["__leak_hash"])
    return docs.join(bad, same, "left_anti")
