"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A text becomes its sequence of five-word shingles, each labelled with its occurrence number. For each of
``SKETCHES`` hash functions the ``PICKS`` smallest labelled shingles are taken and kept in text order;
two texts meet where such an ordered pick is the same, which rewards common order as edit similarity
does. A pair that met is aligned: the longest common subsequence of both shingle sequences within the
band that the threshold leaves, L, gives the similarity L / (n + m - L), and 0.8 or more makes a link.
Classes are the connected components of the links.

The work stays near linear in the size of groups. Texts with equal word sequences are one
representative. In a bucket all members are first compared with one leader, then with others in turn. After that,
members that stray from the main group of a bucket, and all texts of at most ``SHORT`` shingles, for which
sketches miss too much, are compared with the rest by an exact set-similarity join over their rarest shingles,
which finds every pair that can still be similar without listing the pairs of a group. Rows of hot keys (a
leader of a large group, a bucket that many share) are dealt over salts.

Defined cases: texts without a word and rows with a null ``doc_id`` are never grouped; texts of one to
four words are grouped with equal word sequences only; rows that repeat a ``doc_id`` are classed by their own
texts, each for itself. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracegrid.llm.components import components
from tracegrid.llm.runtime import hot_keys, materialised, salted_join, text_batches
from tracegrid.llm.textvec import U64, chunks, mix, shingles, signed, with_occurrence, words

SHINGLE_WORDS = 5
SIMILARITY = 0.8
SKETCHES = 20
PICKS = 4
SIZE_CLASS = 1.02
TURNS = 2
SHORT = 40
HAS_WORD = "[A-Za-z0-9\\x{80}-\\x{10FFFF}]"

_rng = np.random.default_rng(20240601)
_ADD = _rng.integers(0, 1 << 63, SKETCHES, dtype=np.int64).astype(U64)
_MUL = _rng.integers(0, 1 << 62, SKETCHES, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_PLACE = U64(0x9FB21C651E98DF25)

FEATURES = "doc_id long, th long, h1 long, h2 long, n_words long, n long, sketch array<long>"


def order_sketch(x: np.ndarray) -> np.ndarray:
    """The ``SKETCHES`` ordered picks of one text's labelled shingles; empty if there are too few."""
    if len(x) < PICKS:
        return np.zeros(0, U64)
    y = (x[None, :] ^ _ADD[:, None]) * _MUL[:, None]
    at = np.argpartition(y, PICKS - 1, axis=1)[:, :PICKS] if len(x) > PICKS else np.tile(np.arange(PICKS), (SKETCHES, 1))
    at.sort(axis=1)
    picked = x[at]
    out = _ADD.copy()
    for j in range(PICKS):
        out = mix(out * _PLACE + picked[:, j])
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, texts in chunks(batch.column(2)):
            w, wptr = words(texts)
            s, sptr = shingles(w, wptr, SHINGLE_WORDS)
            x = with_occurrence(s, sptr)
            n_words, n = np.diff(wptr), np.diff(sptr)
            place = mix(np.arange(1, int(n_words.max(initial=0)) + 1).astype(U64))
            h1, h2, sketches = [], [], []
            for d in range(len(n)):
                own = w[wptr[d] : wptr[d + 1]]
                h1.append(int(signed((own * (place[: len(own)] | U64(1))).sum(keepdims=True))[0]))
                h2.append(int(signed(mix(own + place[: len(own)]).sum(keepdims=True))[0]))
                sketches.append(signed(order_sketch(x[sptr[d] : sptr[d + 1]])))
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in sketches])]).astype(np.int32)
            flat = np.concatenate(sketches) if sketches else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(start, len(n)), batch.column(1).slice(start, len(n)), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                ["doc_id", "th", "h1", "h2", "n_words", "n", "sketch"],
            )


def banded_lcs(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Longest common subsequence over paths that stay within ``band`` of the diagonal.

    Common ends are matched first. The rest is filled row by row, a row's band as the bits of one
    integer; bits that leave the band on the left have counted what they gained.
    """
    m = min(len(a), len(b))
    same = a[:m] == b[:m]
    head = m if same.all() else int(np.argmin(same))
    a, b = a[head:], b[head:]
    m = min(len(a), len(b))
    same = a[len(a) - m :][::-1] == b[len(b) - m :][::-1]
    tail = m if same.all() else int(np.argmin(same)) if m else 0
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    places: dict[int, list[int]] = {}
    for j, v in enumerate(b.tolist()):
        places.setdefault(v, []).append(j)
    width = 2 * band + 1
    full = (1 << width) - 1
    row, gained, left = full, 0, -band
    for v in a.tolist():
        hits = 0
        own = places.get(v)
        if own:
            for j in own[bisect_left(own, left) :]:
                if j >= left + width:
                    break
                hits |= 1 << (j - left)
        if hits:
            u = row & hits
            row = ((row + u) | (row - u)) & full
        gained += 1 - (row & 1)
        row = (row >> 1) | (1 << (width - 1))
        left += 1
    return head + tail + gained + (width - row.bit_count())


def aligned_similarity(a: np.ndarray, b: np.ndarray, threshold: float = SIMILARITY) -> float:
    """L / (n + m - L) for the banded common subsequence L, or 0 where the threshold is out of reach."""
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    least = threshold / (1 + threshold) * (n + m)
    if min(n, m) < least - 1e-9:
        return 0.0
    common = np.intersect1d(with_occurrence(a, np.array([0, n])), with_occurrence(b, np.array([0, m])), assume_unique=True)
    if len(common) < least - 1e-9:
        return 0.0
    lcs = banded_lcs(a, b, int(n + m - 2 * least) + 1)
    return lcs / (n + m - lcs)


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [batch.column(0).to_numpy(), batch.column(1).to_numpy()]
        keep: list[int] = []
        for start, left in chunks(batch.column(2)):
            n = len(left)
            sl, pl = shingles(*words(left), SHINGLE_WORDS)
            sr, pr = shingles(*words(batch.column(3).slice(start, n)), SHINGLE_WORDS)
            for i in range(n):
                if aligned_similarity(sl[pl[i] : pl[i + 1]], sr[pr[i] : pr[i + 1]]) >= SIMILARITY - 1e-9:
                    keep.append(start + i)
        at = np.array(keep, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids[0][at]), pa.array(ids[1][at])], ["u", "v"])


def _links(pairs: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """The pairs ``(u, v)`` whose texts align well enough. A text that occurs in very many pairs is spread over tasks."""
    pairs = materialised(pairs, f"{name}-pairs")
    hot = hot_keys(pairs.groupBy("u").agg(F.count(F.lit(1)).alias("k")), ["u"], "k", pairs.count())
    left = texts.select(F.col("id").alias("u"), F.col("text").alias("text_u"))
    right = texts.select(F.col("id").alias("v"), F.col("text").alias("text_v"))
    both = salted_join(pairs.join(right, "v"), left, ["u"], ["v"], hot).select("u", "v", "text_u", "text_v")
    return materialised(both.mapInArrow(_aligned, "u long, v long"), name)


def _near(a: str, b: str) -> F.Column:
    """Two shingle counts between which the threshold is in reach."""
    return (F.col(a) * SIMILARITY <= F.col(b) + 1e-9) & (F.col(b) * SIMILARITY <= F.col(a) + 1e-9)


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, texts in chunks(batch.column(1)):
            x, sptr = shingles(*words(texts), SHINGLE_WORDS)
            at = start + np.repeat(np.arange(len(texts)), np.diff(sptr))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(signed(with_occurrence(x, sptr)))], ["id", "x"])


def _across(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of ``docs(id, n, c, seeks)`` of different groups c that can still be similar, at least one of which seeks.

    This is an exact set-similarity join. A text's labelled shingles are put in one order for all, rarest
    first. Similar texts of n and m shingles share at least t = 0.8 / 1.8 * (n + m); where their first shared
    shingle is at place i of the one, n - i >= t, and likewise for the other. So a shingle at place i
    concerns only partners of at most (n - i) * 1.8 / 0.8 - n shingles. Those sizes, in classes of a few
    hundredths, are part of the join key, so shingles that a whole group has in common meet almost nobody.
    Of the holders of a shingle, those outside the group with most of them meet the others: two texts of
    different groups cannot both be of that group.
    """
    ratio = (1 + SIMILARITY) / SIMILARITY
    own = texts.join(docs.select("id"), "id", "left_semi").select("id", "text").mapInArrow(_labelled, "id long, x long")
    own = materialised(own, "omh-shingles")
    often = own.groupBy("x").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    hot = hot_keys(often, ["x"], "f", own.count())
    rare = Window.partitionBy("id").orderBy("f", "x")
    placed = salted_join(own, often, ["x"], ["id"], hot, "left").withColumn("f", F.coalesce("f", F.lit(1))).withColumn("i", F.row_number().over(rare) - 1)
    placed = placed.filter("f > 1").join(docs, "id").withColumn("most", (F.col("n") - F.col("i")) * ratio - F.col("n") + 1e-6)
    placed = materialised(placed.filter(F.col("most") >= F.col("n") * SIMILARITY - 1e-6).select("id", "n", "c", "seeks", "x", "most"), "omh-places")
    kinds = placed.groupBy("x", "c").agg(F.count(F.lit(1)).alias("k"), F.max("seeks").alias("any"))
    most = kinds.groupBy("x").agg(F.max(F.struct("k", "c", "any")).alias("top"), F.count(F.lit(1)).alias("groups")).filter("groups > 1")
    placed = salted_join(placed, most.select("x", F.col("top.c").alias("main"), F.col("top.any").alias("main_seeks")), ["x"], ["id"], hot)
    placed = materialised(placed.withColumn("out", F.expr("c <> main AND (seeks OR main_seeks)")).drop("main", "main_seeks"), "omh-sides")
    size_class = lambda v: F.floor(F.log(v) / F.log(F.lit(SIZE_CLASS))).cast("int")
    reach = F.least(F.col("most"), F.col("n") / SIMILARITY + 1e-6)
    least = size_class(F.greatest(F.lit(1.0), F.col("n") * SIMILARITY - 1e-6))
    a = placed.filter("out").select("x", F.col("id").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"), F.col("seeks").alias("sa"), F.col("most").alias("most_a"), F.explode(F.sequence(least, F.greatest(least, size_class(reach)))).alias("size"))
    b = placed.select("x", size_class(F.col("n").cast("double")).alias("size"), F.col("id").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"), F.col("seeks").alias("sb"), F.col("most").alias("most_b"), F.col("out").alias("both"))
    met = a.join(b, ["x", "size"]).filter("ca <> cb AND (sa OR sb) AND (a < b OR NOT both) AND nb <= most_a AND na <= most_b")
    return met.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()


def _counted(rows: DataFrame, key: str) -> DataFrame | None:
    return hot_keys(rows.groupBy(key).agg(F.count(F.lit(1)).alias("k")), [key], "k", rows.count())


def _ends(label: DataFrame, links: DataFrame) -> DataFrame:
    """The links between different groups: ``cu, cv``."""
    first = salted_join(links, label.select(F.col("id").alias("u"), F.col("c").alias("cu")), ["u"], ["v"], _counted(links, "u"))
    return first.join(label.select(F.col("id").alias("v"), F.col("c").alias("cv")), "v").filter("cu <> cv").select("cu", "cv")


def _hooked(label: DataFrame, links: DataFrame) -> DataFrame:
    """``label(id, c)`` after each link has hooked the greater of its two groups to the lesser; hooks are followed twice."""
    hook = materialised(_ends(label, links).groupBy(F.greatest("cu", "cv").alias("c")).agg(F.min(F.least("cu", "cv")).alias("to")), "omh-hooks")
    for _ in range(2):
        label = salted_join(label, hook, ["c"], ["id"], _counted(label, "c"), "left").select("id", F.coalesce("to", "c").alias("c"))
        label = materialised(label, "omh-labels")
    return label


def _representatives(features: DataFrame) -> DataFrame:
    """A row for each word sequence: ``id``, its hashes, shingle count and sketch, its least row ``rep`` and its copies.

    ``id`` is 64 of the 128 bits that stand for the sequence; sequences that agree in them get another number.
    """
    exact = features.filter("doc_id IS NOT NULL AND n_words > 0").groupBy("h1", "h2", "n_words").agg(
        F.min(F.struct("doc_id", "th")).alias("rep"), F.count(F.lit(1)).alias("n_copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch")
    )
    exact = materialised(exact, "omh-exact")
    clash = materialised(exact.groupBy("h1").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"), "omh-clash")
    if clash.isEmpty():
        return exact.withColumn("id", F.col("h1"))
    both = exact.join(clash, "h1", "left").withColumn("id", F.when(F.col("k").isNull(), F.col("h1")).otherwise(F.xxhash64("h1", "h2", "n_words")))
    return materialised(both.drop("k"), "omh-exact")


def _texts_of(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """``id, text`` of the representatives ``picked(id, rep)``."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    # both sides grow with the corpus, so they are joined alike at every size
    found = own.join(picked.select("id", F.col("rep.doc_id").alias("doc_id"), F.col("rep.th").alias("th")).hint("merge"), ["doc_id", "th"])
    return materialised(found.select("id", "text").dropDuplicates(["id"]), "omh-texts")


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows' features, and for each word sequence its class: ``h1, h2, n_words, rep, class, n_copies, n_links``; ``class`` is its least row."""
    text_batches(docs.sparkSession)
    features = materialised(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text").mapInArrow(_features, FEATURES), "omh-features")
    exact = _representatives(features)
    rows = materialised(exact.filter("size(sketch) > 0").select("id", "n", F.posexplode("sketch").alias("j", "s")).select("id", "n", F.xxhash64("j", "s").alias("bucket")), "omh-buckets")
    shared = rows.groupBy("bucket").agg(F.min("id").alias("leader"), F.max("id").alias("last"), F.min_by("n", "id").alias("leader_n"), F.count(F.lit(1)).alias("k")).filter("leader <> last")
    shared = materialised(shared.drop("last"), "omh-shared")
    hot = hot_keys(shared, ["bucket"], "k", rows.count())
    members = materialised(salted_join(rows, shared.drop("k"), ["bucket"], ["id"], hot), "omh-members")
    hot = hot_keys(shared, ["bucket"], "k", members.count())  # buckets that are hot among the shared ones
    is_short = F.col("n").between(1, int(SHORT / SIMILARITY))
    met = members.select("id").distinct()
    picked = exact.join(met.withColumn("met", F.lit(True)), "id", "left").filter(F.col("met") | is_short)
    picked = materialised(picked.select("id", "rep", "n"), "omh-picked")
    texts = _texts_of(docs, picked)
    pairs = members.filter(F.col("id") != F.col("leader")).filter(_near("n", "leader_n")).select(F.col("leader").alias("u"), F.col("id").alias("v")).distinct()
    new = links = _links(pairs, texts, "omh-links")

    # Strays: members outside their bucket's main group, named by its least id. Other members of the
    # main group lead the bucket in turn, which settles most strays with one comparison for each bucket.
    # Groups are hooked to each other step by step here; full components follow once, at the end.
    label = picked.select("id", F.col("id").alias("c"))
    for turn in range(TURNS + 1):
        label = _hooked(label, new)
        named = materialised(members.drop("leader", "leader_n").join(label, "id"), "omh-named")
        mixed = named.groupBy("bucket").agg(F.min("c").alias("c_lead"), F.max("c").alias("c_last")).filter("c_lead <> c_last").select("bucket", "c_lead")
        own = materialised(salted_join(named, mixed, ["bucket"], ["id"], hot), "omh-mixed")
        if turn == TURNS:
            break
        lead = own.filter("c = c_lead").groupBy("bucket").agg(F.min_by("id", F.xxhash64("id", F.lit(turn))).alias("u"), F.min_by("n", F.xxhash64("id", F.lit(turn))).alias("nu"))
        strays = own.filter("c <> c_lead")
        again = salted_join(strays, lead, ["bucket"], ["id"], _counted(strays, "bucket")).filter(_near("n", "nu")).select("u", F.col("id").alias("v")).distinct()
        new = _links(again, texts, "omh-links")
        links = links.unionByName(new)
    strays = own.groupBy("id").agg(F.max(F.col("c") != F.col("c_lead")).alias("strays"))
    open_ = picked.join(label, "id").join(strays, "id", "left").filter(F.col("strays").isNotNull() | is_short)
    open_ = materialised(open_.select("id", "n", "c", (F.coalesce("strays", F.lit(False)) | (F.col("n") <= SHORT)).alias("seeks")), "omh-open")
    new = _links(_across(open_, texts), texts, "omh-links")
    links = links.unionByName(new)

    # what is left between groups is a small graph; a component's groups take its name
    of_group = components(_ends(label, links).select(F.col("cu").alias("u"), F.col("cv").alias("v")), "omh-components")
    label = salted_join(label, of_group.withColumnRenamed("node", "c"), ["c"], ["id"], _counted(label, "c"), "left").select("id", F.coalesce("component", "c").alias("c"))
    ends = links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().select(F.explode(F.array("u", "v")).alias("id"))
    linked = exact.join(label, "id", "left").join(ends.groupBy("id").agg(F.count(F.lit(1)).alias("n_links")), "id", "left")
    linked = linked.select("h1", "h2", "n_words", "rep", F.coalesce("c", "id").alias("c"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    linked = materialised(linked, "omh-linked")
    classes = linked.groupBy("c").agg(F.min("rep").alias("class"), F.count(F.lit(1)).alias("k"))
    hot = hot_keys(classes, ["c"], "k", linked.count())
    return features, salted_join(linked, classes.drop("k"), ["c"], ["h1", "h2"], hot).drop("c")


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, n_copies, n_links`` for every row of ``docs``.

    The class is named by its least doc_id; ``n_copies`` rows have the same words, and ``n_links`` other
    texts were aligned with this one and found similar (a class of n texts has at least n - 1 links).
    """
    features, classes = _classes(docs)
    keys = ["h1", "h2", "n_words"]
    hot = hot_keys(classes, keys, "n_copies", features.count())
    grouped = features.filter("doc_id IS NOT NULL AND n_words > 0").select("doc_id", "th", *keys)
    named = salted_join(grouped, classes.withColumn("class_id", F.col("class.doc_id")), keys, ["doc_id", "th"], hot)
    alone = features.filter("doc_id IS NULL OR n_words = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"))
    return named.select("doc_id", "class_id", "n_copies", "n_links").unionByName(alone)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each class stays, that with the least doc_id (ties by a hash of the row); columns as they were.

    Rows with a null doc_id and rows without a word are in no class and stay.
    """
    _, classes = _classes(docs)
    stays = classes.filter("rep = class").select(F.col("rep.doc_id").alias("__omh_id"), F.col("rep.th").alias("__omh_th"))
    in_class = F.col("doc_id").isNotNull() & F.coalesce(F.col("text"), F.lit("")).rlike(HAS_WORD)
    plain = [f"`{f.name}`" for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    own = docs.filter(in_class).withColumns({"__omh_id": F.col("doc_id").cast("long"), "__omh_th": F.xxhash64("text"), "__omh_row": F.xxhash64(*plain)})
    first = Window.partitionBy("__omh_id", "__omh_th").orderBy("__omh_row")
    kept = own.join(stays, ["__omh_id", "__omh_th"], "left_semi").withColumn("__omh_n", F.row_number().over(first)).filter("__omh_n = 1")
    return kept.select(*[f"`{c}`" for c in docs.columns]).unionByName(docs.filter(~in_class))
