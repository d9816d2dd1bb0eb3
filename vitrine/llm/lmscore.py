"""Stupid-backoff scores of documents, computed as a join with n-gram counts.

Each document is scored under the counts of all *other* documents (its own n-grams
are taken off): for each word the longest n-gram that occurs elsewhere gives
count(n-gram) / count(its first n - 1 words), times ``alpha`` for each order given
up; at the end count(word) / words. A word met nowhere else counts as one in all
words and one. The score is the mean natural logarithm over the document's words.

The tables are relations keyed by n-gram hash, with many keys packed into one row:

1. Documents are dealt to blocks by hash. A block's distinct n-grams of all orders,
   pre-aggregated, are cut by hash range into parts: one row (part, block, sorted
   48-bit hashes, counts) for each.
2. Grouped by part, the rows of all blocks hold every occurrence of the part's
   n-grams: the counts are summed by hash, which is the count table of that hash
   partition, and joined back to the hashes that each block asked for: one row
   (block, part, totals).
3. Grouped by block, totals meet the block's documents again, whose n-grams find
   their counts by place; logarithms are summed per document.

A block and a part are of bounded size; their number grows with the input. No group
depends on how often an n-gram or a document occurs, as a block names an n-gram
once. Blocks grow from 4 to 64 million characters with the input, so that rows stay
large. Hashes of 48 bits mix up two n-grams once in 2**48 / (distinct n-grams).

Words are lower-cased runs of letters and digits.

Defined cases: NULL, empty and wordless texts have n_words 0, log_score 0 and a
NULL score; a corpus of one document scores each word as met nowhere else; repeated
rows count as other documents to each other; a NULL doc_id is kept; other columns
are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

ORDER = 3
ALPHA = 0.4
BLOCK_CHARS = (4_000_000, 64_000_000)
#: Blocks wanted before they grow.
MANY_BLOCKS = 4_000
#: N-grams of a part, about: characters of the corpus that it stands for.
PART_CHARS = 5_000_000

_HASH_BITS = 48
_KINDS = (np.uint8, np.uint16, np.uint32, np.uint64)


def pack(a: np.ndarray) -> bytes:
    """Unsigned numbers in the narrowest type, compressed."""
    top = int(a.max()) if len(a) else 0
    k = next(k for k, t in enumerate(_KINDS) if top <= np.iinfo(t).max)
    return bytes([k]) + zlib.compress(a.astype(_KINDS[k]).tobytes(), 1)


def unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b[1:]), dtype=_KINDS[b[0]]).astype(np.int64)


def pack_hashes(h: np.ndarray) -> bytes:
    """Sorted 48-bit hashes: steps of the upper 16 bits, then the lower 32 bits."""
    steps = pack(np.diff(h >> np.uint64(32), prepend=np.uint64(0)))
    return len(steps).to_bytes(4, "little") + steps + h.astype(np.uint32).tobytes()


def unpack_hashes(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:4], "little")
    high = np.cumsum(unpack(b[4:4 + n])).astype(np.uint64)
    return (high << np.uint64(32)) | np.frombuffer(b[4 + n:], dtype=np.uint32)


class Grams:
    """The n-grams of the documents of a block: for each order n, the 48-bit hash of
    the n-gram that ends at each word (where the document has n words by then)."""

    def __init__(self, texts: list[str | None], order: int):
        words, first = C.hashed_words(texts, True)
        self.first = first
        self.doc = np.repeat(np.arange(len(texts)), np.diff(first))
        self.place = np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))
        self.ends: list[np.ndarray] = []
        hashes: list[np.ndarray] = []
        for n in range(1, order + 1):
            end = np.flatnonzero(self.place >= n - 1)
            g = C.ngrams(words, n)[end - (n - 1)] if len(end) else np.zeros(0, np.uint64)
            self.ends.append(end)
            hashes.append(C.mix(g + np.uint64(n)) >> np.uint64(64 - _HASH_BITS))
        self.hashes = np.concatenate(hashes)


def part_bounds(parts: int) -> np.ndarray:
    """First hash of each part, and the end."""
    return np.array([(p << _HASH_BITS) // parts for p in range(parts + 1)], dtype=np.uint64)


def _requests(order: int, parts: int):
    bounds = part_bounds(parts)

    def run(group: pa.Table) -> pa.Table:
        g = Grams(group.column("text").to_pylist(), order)
        u, n = np.unique(g.hashes, return_counts=True)
        cut = np.searchsorted(u, bounds)
        return pa.table({
            "part": pa.array(range(parts), pa.int32()),
            "block": pa.array([group.column("block")[0].as_py()] * parts, pa.int32()),
            "words": pa.array([len(g.doc)] * parts, pa.int64()),
            "hashes": pa.array([pack_hashes(u[a:b]) for a, b in zip(cut[:-1], cut[1:])],
                               pa.binary()),
            "counts": pa.array([pack(n[a:b]) for a, b in zip(cut[:-1], cut[1:])], pa.binary())})
    return run


def _totals(group: pa.Table) -> pa.Table:
    hashes = [unpack_hashes(x.as_py()) for x in group.column("hashes")]
    counts = np.concatenate([unpack(x.as_py()) for x in group.column("counts")])
    u, inv = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(inv, weights=counts, minlength=len(u)).astype(np.int64)[inv]
    cut = np.cumsum([0, *map(len, hashes)])
    words = int(np.asarray(group.column("words")).sum())
    return pa.table({
        "block": group.column("block"), "part": group.column("part"),
        "words": pa.array([words] * group.num_rows, pa.int64()),
        "totals": pa.array([pack(total[a:b]) for a, b in zip(cut[:-1], cut[1:])], pa.binary())})


def score_block(texts: list[str | None], totals, n_all: int, order: int, alpha: float,
                ) -> tuple[np.ndarray, np.ndarray]:
    """Words and summed log scores of each text. ``totals`` maps the block's sorted
    distinct hashes to their counts over the corpus of ``n_all`` words."""
    g = Grams(texts, order)
    n_docs = len(texts)
    n_words = np.diff(g.first)
    if not len(g.doc):
        return n_words, np.zeros(n_docs)
    u, inv = np.unique(g.hashes, return_inverse=True)
    total = totals(u)
    doc = np.concatenate([g.doc[e] for e in g.ends])
    _, own_inv, own_n = np.unique(doc * len(u) + inv, return_inverse=True, return_counts=True)
    elsewhere = (total[inv] - own_n[own_inv]).astype(np.float64)
    counts = np.split(elsewhere, np.cumsum([len(e) for e in g.ends])[:-1])
    full = []
    for end, c in zip(g.ends, counts):  # by word; 0 where the document is too short
        x = np.zeros(len(g.doc))
        x[end] = c
        full.append(x)
    others = (n_all - n_words[g.doc]).astype(np.float64)
    uni = full[0]
    logs = np.where(uni > 0, np.log(np.maximum(uni, 1)) - np.log(np.maximum(others, 1)),
                    -np.log(others + 1))
    longest = np.minimum(g.place + 1, order)
    logs = logs + (longest - 1) * math.log(alpha)
    for n in range(2, order + 1):
        at = np.flatnonzero(full[n - 1] > 0)
        logs[at] = (np.log(full[n - 1][at]) - np.log(full[n - 2][at - 1])
                    + (longest[at] - n) * math.log(alpha))
    return n_words, np.bincount(g.doc, weights=logs, minlength=n_docs)


def _scores(order: int, alpha: float):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        replies = replies.sort_by("part")
        packed = replies.column("totals").to_pylist()
        n_all = replies.column("words")[0].as_py() if replies.num_rows else 0
        n_words, logs = score_block(
            docs.column("text").to_pylist(),
            lambda u: np.concatenate([unpack(x) for x in packed]), n_all, order, alpha)
        return pa.table({"doc_id": docs.column("doc_id"),
                         "n_words": pa.array(n_words.astype(np.int64)),
                         "log_score": pa.array(logs, pa.float64())})
    return run


def backoff_scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA,
                   block_chars: int | None = None, part_chars: int = PART_CHARS) -> DataFrame:
    """doc_id, n_words, log_score (sum of natural logarithms), score (their mean)."""
    C.text_session(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                    F.col("text").cast("string").alias("text"))
    chars = d.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if block_chars is None:
        block_chars = min(max(chars // MANY_BLOCKS, BLOCK_CHARS[0]), BLOCK_CHARS[1])
    blocks = max(1, math.ceil(chars / block_chars))
    parts = max(1, math.ceil(chars / part_chars))
    dealt = d.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    asked = dealt.groupBy("block").applyInArrow(
        _requests(order, parts),
        "part int, block int, words long, hashes binary, counts binary")
    replies = asked.groupBy("part").applyInArrow(
        _totals, "block int, part int, words long, totals binary")
    return (dealt.groupBy("block").cogroup(replies.groupBy("block"))
            .applyInArrow(_scores(order, alpha), "doc_id long, n_words long, log_score double")
            .withColumn("score", F.when(F.col("n_words") > 0,
                                        F.col("log_score") / F.col("n_words"))))


def op7(spark, sf_dir: str) -> DataFrame:
    return backoff_scores(C.table(spark, sf_dir, "documents"))
