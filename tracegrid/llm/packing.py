"""Best-fit packing of token pieces, certified by dual-feasible-function lower bounds.

Texts are tokenised, closed with an end id and cut: longer documents into pieces of the capacity, the
first piece taking what is left over. A piece that fills a sequence alone is placed at once. The others
are dealt by hash into partitions of about ``PIECES_PER_PARTITION``; each runs best-fit decreasing. The
greatest of a family of dual-feasible functions gives a number of sequences that no packing of the
partition's pieces can beat. A partition that meets its bound is certified and done. Partitions with a
gap give up the pieces of all sequences that are not full; these are dealt anew among such partitions
and packed again, as long as that saves sequences.

Defined cases: a null text is empty and its document is the end id alone; rows that repeat a ``doc_id`` are
packed as often as they occur; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrid.llm.runtime import materialised, text_batches

CAPACITY = 1024
END_ID = 2
PIECES_PER_PARTITION = 50_000
ROUNDS = 4
RANKS = "byte_bpe_50k.tiktoken"
VOCABULARY = "byte_bpe_50k.json"
LONG_SPACE = 100_000
ADDED = {"<|endoftext|>": 50256}
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"

_loaded: dict[tuple[str | None, bool], Callable[[str], bytes]] = {}


def _by_tokenizers(path: str, added: bool) -> Callable[[str], bytes]:
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    inner = Tokenizer.from_file(path)
    inner.encode_special_tokens = not added
    return lambda text: np.array(inner.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _by_ranks(added: bool) -> Callable[[str], bytes]:
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    bpe = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED if added else {})

    def encode(text: str) -> bytes:
        if len(text) > LONG_SPACE and any(m.end() - m.start() > LONG_SPACE for m in re.finditer(r"\s+", text)):
            return encoder(public_tokenizers.path(VOCABULARY), added)(text)
        if added and any(token in text for token in ADDED):
            return np.array(bpe.encode(text, allowed_special="all"), "<u4").tobytes()
        return np.array(bpe.encode_ordinary(text), "<u4").tobytes()

    return encode


def encoder(path: str | None = None, added: bool = False) -> Callable[[str], bytes]:
    """A function from a text to its ids, little-endian 32-bit numbers; loaded once in a process.

    A ``.json`` file is read by ``tokenizers``. By default the ids are those of the public byte-level BPE
    ``byte_bpe_50k.json``; the same vocabulary and pattern are read from its ``.tiktoken`` form, which encodes
    rare words several times faster to the same ids. That form fails on runs of a million whitespace characters,
    so texts with runs of more than ``LONG_SPACE`` go to ``tokenizers``. With ``added``, as ``pieces`` calls it, the
    strings of a vocabulary's added tokens (``ADDED``) get those tokens' ids; without, they are ordinary text.
    """
    if (path, added) not in _loaded:
        _loaded[path, added] = _by_ranks(added) if path is None else _by_tokenizers(path, added)
    return _loaded[path, added]


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """The token pieces of all documents; their ids come along only if asked for."""
    text_batches(docs.sparkSession)
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, added=True)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(batch.column(0), batch.column(1)):
                ids = encode(text.as_py() or "") + end
                for k, (s, n) in enumerate(cut(len(ids) // 4)):
                    part = ids[4 * s : 4 * (s + n)]
                    for col, v in zip(out, (doc.as_py(), k, s, n, zlib.crc32(part), part if keep_ids else None)):
                        col.append(v)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECE_SCHEMA)
    return found if keep_ids else found.drop("ids")


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size: largest first, each into the fullest bin that still holds it."""
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, count = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = mask >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                mask &= ~(1 << room)
        else:
            room, b = capacity, count
            count += 1
        bins[i], offsets[i] = b, capacity - room
        if room > s:
            with_room[room - s].append(b)
            mask |= 1 << (room - s)
    return bins, offsets


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY) -> int:
    """The greatest lower bound on bins that the dual-feasible functions u^(k) and f_0 give."""
    counts = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((counts * x).sum()) // capacity)
    for k in range(1, 64):
        whole = (k + 1) * x % capacity == 0
        total = int((counts * np.where(whole, k * x, (k + 1) * x // capacity * capacity)).sum())
        best = max(best, -(-total // (k * capacity)))
    above = np.cumsum(counts[::-1])[::-1]
    load = np.concatenate([[0], np.cumsum(counts * x)])
    for cut_ in range(1, capacity // 2 + 1):
        big = int(above[capacity - cut_ + 1]) if cut_ else 0
        middle = int(load[capacity - cut_ + 1] - load[cut_])
        best = max(best, big + -(-middle // capacity))
    return best


def _packed(rows: DataFrame, round_: int, capacity: int) -> DataFrame:
    """Deal (uid, length) into partitions and pack each: adds part, bin, offset, fill and the certificate."""
    parts = max(1, -(-rows.count() // PIECES_PER_PARTITION))

    def pack(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(batches)
        sizes = whole["length"].to_numpy().astype(np.int64)
        bins, offsets = best_fit_decreasing(sizes, capacity)
        fill = np.bincount(bins, weights=sizes).astype(np.int64)
        n, bound = len(fill), lower_bound(sizes, capacity)
        yield pa.RecordBatch.from_arrays(
            [whole["uid"].combine_chunks(), pa.array(sizes), pa.array(np.full(len(sizes), key[0].as_py())), pa.array(bins), pa.array(offsets), pa.array(fill[bins]), pa.array(np.full(len(sizes), n)), pa.array(np.full(len(sizes), bound))],
            ["uid", "length", "part", "bin", "offset", "fill", "bins", "bound"],
        )

    dealt = rows.withColumn("part", F.pmod(F.xxhash64("uid", F.lit(round_)), F.lit(parts)) + F.lit(round_) * F.lit(1 << 24))
    schema = "uid long, length long, part long, bin long, offset long, fill long, bins long, bound long"
    return materialised(dealt.groupBy("part").applyInArrow(pack, schema), "packed")


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` of at most ``capacity``."""
    keyed = materialised(found.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    spec = keyed.filter(F.col("length") < capacity).select("uid", "length")
    done: list[DataFrame] = []
    current = _packed(spec, 0, capacity)
    for round_ in range(1, ROUNDS):
        loose = (F.col("bins") > F.col("bound")) & (F.col("fill") < capacity)
        pieces_left = current.filter(loose).select("uid", "length")
        before = current.filter(loose).select("part", "bin").distinct().count()
        if before < 2:
            break
        again = _packed(pieces_left, round_, capacity)
        after = again.select("part", "bins").distinct().agg(F.sum("bins")).first()[0]
        if after >= before:
            break
        done.append(current.filter(~loose))
        current = again
    placed = current
    for other in done:
        placed = placed.unionByName(other)
    placed = placed.select("uid", (F.col("part") * F.lit(1 << 24) + F.col("bin")).alias("sequence_id"), "offset")
    alone = keyed.filter(F.col("length") >= capacity).withColumn("sequence_id", -F.col("uid") - 1).withColumn("offset", F.lit(0).cast("long"))
    return keyed.join(placed, "uid").unionByName(alone).drop("uid")


def sequences(packed: DataFrame) -> DataFrame:
    """The filled sequences: ``sequence_id``, its pieces in order and, where kept, all ids as one binary."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    out = packed.groupBy("sequence_id").agg(parts.alias("pieces"))
    ids = F.unhex(F.array_join(F.transform("pieces", lambda p: F.hex(p["ids"])), ""))
    return out.select("sequence_id", F.transform("pieces", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["offset"].alias("offset"), p["length"].alias("length"))).alias("pieces"), ids.alias("ids"))
