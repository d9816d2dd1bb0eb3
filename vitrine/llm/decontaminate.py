"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming
search, exact weighted-shingle check.

Words are lower-cased runs of letters and digits; a shingle is five consecutive
words (a shorter item is one shingle of all its words). A document window is
compared with items of its own length in words; a document shorter than an item
is one window as a whole. The weighted-shingle similarity of a window with an item
is sum(min) / sum(max) over shingle multiplicities.

1. For each item length, windows that may reach the similarity are found by a
   bound that loses none: J >= s of two bags of n shingles needs
   ceil(2 s n / (1 + s)) shared shingles, so a window needs as many positions
   whose shingle occurs in some item of that length. A document of m < n shingles
   needs ceil(s (m + n) / (1 + s)).
2. Those windows get a 64-bit SimHash, each bit the sign of the sum of the
   shingles' +-1 bits.
3. The items' fingerprints are cut into four 16-bit blocks, and each block is
   indexed under every value within ``radius // 4`` bits. By the pigeonhole
   principle a window within ``radius`` of an item meets it in one block at
   least, so the lookup returns every fingerprint within the radius.
4. Candidates within the radius are verified on the shingles themselves. A document
   that is one window as a whole is verified with every item that shares as many
   shingles as the bound asks for, at whatever distance: bags of unequal size have
   tied bits, which would put short ones beyond the radius.

The radius of 19 of 64 bits is 3.2 standard deviations above the distance
expected at similarity 0.8 (cosine 0.89, 9.7 bits), so a pair just at the
threshold is met with probability over 0.999, and higher ones more surely.

Documents stay where they are read: one map, no shuffle. The items are sent to
the executors in groups of at most ``group_items`` items and
``group_words`` words; a larger benchmark takes more passes, so what is
broadcast never grows.

Defined cases: NULL or empty texts and items match nothing; equal items each
match; repeated documents each give their rows; a NULL doc_id or item_id is
kept; only doc_id, text, item_id are read; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SIMILARITY = 0.8
SHINGLE = 5
RADIUS = 19
GROUP_ITEMS = 1_000
GROUP_WORDS = 1_000_000
BLOCKS, BLOCK_BITS = 4, 16


def simhash(rows: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each row of shingle hashes (windows x shingles)."""
    out = np.zeros(len(rows), dtype=np.uint64)
    n = rows.shape[1]
    for bit in range(64):
        ones = ((rows >> np.uint64(bit)) & np.uint64(1)).sum(axis=1, dtype=np.int64)
        out |= (2 * ones > n).astype(np.uint64) << np.uint64(bit)
    return out


def near_values(radius: int) -> np.ndarray:
    """XOR masks of 16 bits with at most ``radius`` bits set."""
    v = np.arange(1 << BLOCK_BITS, dtype=np.uint16)
    return v[np.bitwise_count(v) <= radius]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted (multiset) Jaccard of two bags of shingle hashes."""
    u, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x = np.bincount(inv[:len(a)], minlength=len(u))
    y = np.bincount(inv[len(a):], minlength=len(u))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


class ItemIndex:
    """Items of one length in words."""

    def __init__(self, n_words: int, ids: list, bags: list[np.ndarray], s: float, radius: int):
        self.n_words, self.ids, self.bags = n_words, ids, bags
        self.n = len(bags[0])
        self.need = math.ceil(2 * s * self.n / (1 + s) - 1e-9)
        flat = np.concatenate(bags)
        self.known = np.unique(flat)
        order = np.argsort(flat, kind="stable")  # item numbers by shingle
        self.held = flat[order]
        self.holder = np.repeat(np.arange(len(ids), dtype=np.int32), self.n)[order]
        self.prints = simhash(np.stack(bags))
        masks = near_values(radius // BLOCKS)
        self.tables = []
        for k in range(BLOCKS):
            part = ((self.prints >> np.uint64(k * BLOCK_BITS)) & np.uint64(0xFFFF)).astype(np.uint16)
            keys = (part[:, None] ^ masks[None, :]).ravel()
            owner = np.repeat(np.arange(len(ids), dtype=np.int32), len(masks))
            order = np.argsort(keys, kind="stable")
            self.tables.append((keys[order], owner[order]))

    def candidates(self, fp: np.uint64, radius: int) -> list[int]:
        found: set[int] = set()
        for k, (keys, owner) in enumerate(self.tables):
            v = np.uint16((int(fp) >> (k * BLOCK_BITS)) & 0xFFFF)
            lo, hi = np.searchsorted(keys, v, "left"), np.searchsorted(keys, v, "right")
            found.update(owner[lo:hi].tolist())
        near = [i for i in found if int(self.prints[i] ^ fp).bit_count() <= radius]
        return sorted(near)

    def sharing(self, bag: np.ndarray, need: int) -> list[int]:
        """Items that hold the shingles of ``need`` positions of ``bag`` at least."""
        shingle, n = np.unique(bag, return_counts=True)
        shared = np.zeros(len(self.ids), dtype=np.int64)
        lo, hi = np.searchsorted(self.held, shingle, "left"), np.searchsorted(self.held, shingle, "right")
        for a, b, k in zip(lo.tolist(), hi.tolist(), n.tolist()):
            shared[np.unique(self.holder[a:b])] += k
        return np.flatnonzero(shared >= need).tolist()


def build_index(items: list[tuple], shingle: int, s: float, radius: int) -> list[ItemIndex]:
    words, first = C.hashed_words([t for _, t in items], True)
    by_len: dict[int, list[int]] = {}
    for i in range(len(items)):
        n = int(first[i + 1] - first[i])
        if n:
            by_len.setdefault(n, []).append(i)
    return [ItemIndex(n, [items[i][0] for i in of],
                      [C.shingles(words[first[i]:first[i + 1]], shingle) for i in of], s, radius)
            for n, of in sorted(by_len.items())]


def _short_grams(w: np.ndarray, n: int) -> np.ndarray:
    """The shingle of each window of n < SHINGLE words, as ``shingles`` makes it."""
    return C.ngrams(w, n) ^ np.uint64(n)


def _scan(items: list[tuple], shingle: int, s: float, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = build_index(items, shingle, s, radius)
        known = np.unique(np.concatenate([x.known for x in index])) if index else np.zeros(0, np.uint64)
        bits = np.zeros(1 << 22, dtype=bool)  # most shingles end at this test
        bits[(known >> np.uint64(42)).astype(np.int64)] = True
        shorts = sorted({x.n_words for x in index if x.n_words < shingle})
        for b in C.slices(batches):
            words, first = C.hashed_words(b.column("text").to_pylist(), True)
            full = C.ngrams(words, shingle)
            seen = np.flatnonzero(bits[(full >> np.uint64(42)).astype(np.int64)])
            seen = seen[np.isin(full[seen], known)]
            hit_docs = set((np.searchsorted(first, seen, side="right") - 1).tolist())
            short_hits = {}
            for n in shorts:
                g = _short_grams(words, n)
                at = np.flatnonzero(bits[(g >> np.uint64(42)).astype(np.int64)])
                at = at[np.isin(g[at], known)]
                short_hits[n] = g
                hit_docs |= set((np.searchsorted(first, at, side="right") - 1).tolist())
            out = []
            for d in sorted(hit_docs):
                lo, hi = int(first[d]), int(first[d + 1])
                sh = full[lo:max(lo, hi - shingle + 1)]
                for x in index:
                    if hi - lo < x.n_words:
                        m = len(sh) if hi - lo >= shingle else 0
                        if m < s * x.n - 1e-9:  # another length of shingle, or too few
                            continue
                        need = math.ceil(s * (m + x.n) / (1 + s) - 1e-9)
                        if np.isin(sh, x.known).sum() < need:
                            continue
                        fp = simhash(sh[None, :])[0]
                        for i in x.sharing(sh, need):
                            sim = similarity(sh, x.bags[i])
                            if sim >= s:
                                out.append((d, x.ids[i], 0, hi - lo,
                                            int(x.prints[i] ^ fp).bit_count(), sim))
                        continue
                    grams = sh if x.n_words >= shingle else short_hits[x.n_words][lo:hi - x.n_words + 1]
                    got = np.isin(grams, x.known)
                    if not got.any():
                        continue
                    cum = np.r_[0, np.cumsum(got)]
                    starts = np.flatnonzero(cum[x.n:] - cum[:-x.n] >= x.need)
                    best: dict[int, tuple] = {}
                    for at in range(0, len(starts), 4096):
                        part = starts[at:at + 4096]
                        bags = grams[part[:, None] + np.arange(x.n)]
                        fps = simhash(bags)
                        for start, bag, fp in zip(part.tolist(), bags, fps):
                            for i in x.candidates(fp, radius):
                                sim = similarity(bag, x.bags[i])
                                if sim >= s and sim > best.get(i, (0.0,))[0]:
                                    best[i] = (sim, start, int(x.prints[i] ^ fp).bit_count())
                    out += [(d, x.ids[i], start, x.n_words, dist, sim)
                            for i, (sim, start, dist) in best.items()]
            if out:
                d, ids, start, n, dist, sim = map(list, zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(d)), pa.array(ids, pa.int64()),
                     pa.array(start, pa.int64()), pa.array(n, pa.int64()),
                     pa.array(dist, pa.int32()), pa.array(sim, pa.float64())],
                    names=["doc_id", "item_id", "start_word", "n_words", "hamming", "similarity"])
    return run


def item_groups(benchmark: DataFrame, group_items: int, group_words: int) -> list[DataFrame]:
    """Split the items into hash groups of bounded size."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"),
                             F.col("text").cast("string").alias("text")).filter("text is not null")
    n, chars = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    # A word takes two characters at least; twice the mean leaves room for chance.
    parts = max(1, math.ceil(2 * n / group_items), math.ceil(2 * (chars / 2) / group_words)) \
        if n > group_items or chars / 2 > group_words else 1
    key = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    return [items.filter(key == p) for p in range(parts)] if n else []


def contaminated(docs: DataFrame, benchmark: DataFrame, s: float = SIMILARITY,
                 shingle: int = SHINGLE, radius: int = RADIUS,
                 group_items: int = GROUP_ITEMS, group_words: int = GROUP_WORDS) -> DataFrame:
    """doc_id, item_id, start_word, n_words, hamming, similarity: the best window
    of each document for each item it contains."""
    C.text_session(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.col("text").cast("string").alias("text"))
    schema = ("doc_id long, item_id long, start_word long, n_words long, hamming int, "
              "similarity double")
    found = []
    for group in item_groups(benchmark, group_items, group_words):
        items = sorted(((r.item_id, r.text) for r in group.collect()),
                       key=lambda x: (x[0] is None, x[0], x[1]))
        found.append(texts.mapInArrow(_scan(items, shingle, s, radius), schema))
    if not found:
        return docs.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionAll, found)


def op2(spark, sf_dir: str) -> DataFrame:
    return contaminated(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
