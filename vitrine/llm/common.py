"""Helpers shared by the training-data operators.

Text is hashed with numpy over whole Arrow slices: a byte-level word split, a
64-bit polynomial hash of every word, and rolling hashes of word n-grams. All
arithmetic is modulo 2**64 (numpy's unsigned wrap-around).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - makes pa.compute available
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Stands for a NULL doc_id inside joins; no table uses the smallest long.
NULL_ID = -(2 ** 63)
#: Sets the sign of a key made from a text.
_KEY_SIGN = -(2 ** 63)
#: Text taken into one numpy pass; bounds a worker's memory, not the results.
SLICE_BYTES = 2_000_000
#: Bytes of one polynomial pass (longer texts are cut at word ends).
HASH_BYTES = 1_000_000

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_session(spark: SparkSession) -> None:
    """Arrow batches of bounded bytes for long texts; shared checkpoint folder."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    ensure_checkpoint_dir(spark)


def held_out() -> Column:
    """Fold rule of the contracts: crc32(doc_id as text) mod 5 = 0.

    A NULL id has no remainder; it is never learned from and counts as held out.
    """
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))


def row_key() -> Column:
    """doc_id; for a NULL id a negative number from the text, so that documents
    without an id are told apart by what they say."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))
                      .bitwiseOR(F.lit(_KEY_SIGN)))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_fraction(n: int, bound: int) -> float:
    return 1.0 if n <= bound else bound / n


def in_fraction(key: Column, fraction: float, seed: int = 17) -> Column:
    """Deterministic sample by hash: the same rows whatever the partitioning."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) < F.lit(int(fraction * 1_000_000))


def slices(batches: Iterator[pa.RecordBatch], col: str = "text",
           size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that one slice holds about ``size`` bytes of text."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        lens = np.array(pa.compute.binary_length(b.column(col)).fill_null(0), dtype=np.int64)
        cum = np.cumsum(lens)
        lo = 0
        while lo < n:
            base = cum[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(cum, base + size, side="right")))
            yield b.slice(lo, hi - lo)
            lo = hi


# ---------------------------------------------------------------- word hashes

def _lut(seps: bytes) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(seps)] = True
    return t


#: Separators of the substring contract: blank and TAB..CR.
BLANKS = _lut(bytes([0x20, *range(0x09, 0x0E)]))
#: Normalised words: runs of ASCII letters and digits and of non-ASCII bytes.
NON_WORD = _lut(bytes(c for c in range(128) if not chr(c).isalnum()))

_pow: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _pow.get("p")
    if have is None or len(have) < n:
        n = max(n, HASH_BYTES + 1)
        inv = pow(_BASE, -1, 1 << 64)
        for k, base in (("p", _BASE), ("i", inv)):
            a = np.full(n, base, dtype=np.uint64)
            a[0] = 1
            _pow[k] = np.cumprod(a, dtype=np.uint64)
    return _pow["p"], _pow["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_spans(b: np.ndarray, seps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words in a byte array."""
    w = np.empty(len(b) + 2, dtype=bool)
    w[0] = w[-1] = False
    np.logical_not(seps[b], out=w[1:-1])
    edges = np.flatnonzero(w[1:] != w[:-1])
    return edges[0::2], edges[1::2]


def hash_spans(b: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; equal bytes, equal hash."""
    if not len(s):
        return np.zeros(0, dtype=np.uint64)
    out = np.empty(len(s), dtype=np.uint64)
    lo = 0
    while lo < len(s):
        hi = max(lo + 1, int(np.searchsorted(e, s[lo] + HASH_BYTES, side="right")))
        off, end = s[lo], e[hi - 1]
        p, inv = _powers(int(end - off) + 1)
        h = np.zeros(int(end - off) + 1, dtype=np.uint64)
        np.cumsum((b[off:end].astype(np.uint64) + np.uint64(1)) * p[:end - off], out=h[1:])
        ss, ee = s[lo:hi] - off, e[lo:hi] - off
        out[lo:hi] = mix((h[ee] - h[ss]) * inv[ss] + (ee - ss).astype(np.uint64))
        lo = hi
    return out


def hashed_words(texts: list[str | None], normal: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and the first word of each text
    (n + 1 offsets). ``normal``: lower-cased, punctuation parts words."""
    parts = [((t or "").lower() if normal else (t or "")).encode("utf-8", "surrogatepass")
             for t in texts]
    lens = np.fromiter((len(p) + 1 for p in parts), dtype=np.int64, count=len(parts))
    b = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8) if parts else np.zeros(0, np.uint8)
    s, e = word_spans(b, NON_WORD if normal else BLANKS)
    starts = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
    return hash_spans(b, s, e), np.searchsorted(s, starts)


def ngrams(w: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive words; shorter input gives none."""
    if len(w) < n:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(len(w) - n + 1, dtype=np.uint64)
    for j in range(n):
        h *= np.uint64(0xD6E8FEB86659FD93)
        h += w[j:j + len(h)]
        if j % 4 == 3:
            h ^= h >> np.uint64(29)
    return mix(h)


def shingles(w: np.ndarray, n: int = 5) -> np.ndarray:
    """Shingle hashes in order; a text of 1..n-1 words has one shingle of all."""
    if 0 < len(w) < n:
        return ngrams(w, len(w)) ^ np.uint64(len(w))
    return ngrams(w, n)


def signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 20_000,
         ) -> Iterator[pa.Table]:
    """Whole key groups from batches sorted by ``keys``: each table holds one or
    more complete groups, at least ``rows`` rows but for the last."""
    held: list[pa.RecordBatch] = []
    n = 0

    def last_start(t: pa.Table) -> int:
        same = np.ones(t.num_rows, dtype=bool)
        for k in keys:
            c = t.column(k).combine_chunks()
            same &= np.asarray(pa.compute.equal(c, c[t.num_rows - 1]).fill_null(False))
        return t.num_rows - int(same.sum())

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n >= rows:
            t = pa.Table.from_batches(held)
            cut = last_start(t)
            if cut:
                yield t.slice(0, cut)
                held, n = t.slice(cut).to_batches(), t.num_rows - cut
    if n:
        yield pa.Table.from_batches(held)
