"""Phrase collocation mining by top-order marginalisation.

Words of a piece of text are laid into lead-window columns ``w1 .. w5``: each word
opens one window, which holds it and the words that follow, padded with NULL where the
piece ends. Only these longest windows are counted; Spark's ROLLUP over (lang, w1, ...,
w5) then adds up the counts of all shorter phrases, as every phrase of k words is the
first k columns of the windows it opens. No n-gram is exploded for itself.

Before that, passes over the texts count words, pairs, triples and runs of four in hashed
buckets. A phrase that occurs ``min_count`` times has only parts that do, so a window is
padded from the first part on whose bucket stays below, and a word whose bucket stays
below counts towards n alone. A bucket holds at least the occurrences of each of its
runs, so this drops nothing that may be reported. Each pass counts only runs whose
parts passed the one before. The buckets that reach ``min_count`` leave Spark as bitmaps of at
most 2**MOST_BITS bits (16 MB) a pass, whatever the input; from some 10**10 words on the
buckets fill up, windows are padded less, and more of them are shuffled.

All counts are over whole words as text; no hash decides a count. Scores are taken in
decimal(38): exact while a language has fewer than 10**17 words.

Defined cases: NULL and empty texts have no words; a NULL lang is ``und``; repeated rows
count as often as they occur; doc_id and other columns are not read; ties go to the
smallest cut and to the phrase order of the contract; a language without a candidate
gives no rows, nor does an empty table. Very long words and texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

MOST_WORDS = 5
MIN_COUNT = 100
TOP = 2_000
ABSORB = 100  # per cent of a phrase's occurrences that a longer one must have
#: Bits of a pass: a bucket for each 64 characters of text, 2**MOST_BITS at most.
LEAST_BITS, MOST_BITS = 16, 27
CHARS_BITS = 6
#: The longest runs counted in buckets.
FILTERED = 4
#: Buckets of one bitmap row.
PART_BITS = 15
SALTS = 32
#: Text of one numpy pass over windows.
SLICE = 8_000_000
#: Bytes of distinct windows that a task holds, and of those it takes before adding them up.
HELD_BYTES = 48_000_000
#: Text of one task over windows, where there is more of it than that for each core.
TASK_CHARS = 1 << 32

_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_IS_END = np.zeros(256, dtype=bool)
_IS_END[list(_ENDS)] = True
_IS_SEP = _IS_END.copy()
_IS_SEP[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
COLUMNS = [f"w{k}" for k in range(1, MOST_WORDS + 1)]


class Words:
    """The words of some rows in order: ``names`` (distinct, as text), ``codes`` into
    them, ``joined`` (the next word is in the same piece), ``lang`` codes, hashes of
    the distinct words salted with the language."""

    def __init__(self, langs: list[str], texts: list[str]):
        raw = [t.encode("utf-8", "replace") for t in texts]
        b = _LOWER[np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)]
        s, e = C.word_spans(b, _IS_SEP)
        self.n = len(s)
        ends = np.cumsum([len(x) + 1 for x in raw])
        number: dict[str, int] = {}
        lang_of = np.array([number.setdefault(x, len(number)) for x in langs], dtype=np.int32)
        self.lang_names = list(number)
        self.lang = lang_of[np.searchsorted(ends, s, side="right")]
        offsets = np.zeros(self.n + 1, dtype=np.int64)
        np.cumsum(e - s, out=offsets[1:])
        words = pa.LargeStringArray.from_buffers(
            self.n, pa.py_buffer(offsets), pa.py_buffer(b[~_IS_SEP[b]]))
        coded = words.dictionary_encode()
        self.names = coded.dictionary
        self.codes = np.asarray(coded.indices)
        breaks = np.zeros(len(b) + 1, dtype=np.int32)
        np.cumsum(_IS_END[b], out=breaks[1:])
        self.joined = np.zeros(self.n, dtype=bool)
        if self.n:
            self.joined[:-1] = breaks[s[1:]] == breaks[e[:-1]]
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        """A hash of (lang, word) for each occurrence; used for buckets only."""
        if not self.n:
            return np.zeros(0, dtype=np.uint64)
        off = np.frombuffer(self.names.buffers()[1], dtype=np.int64)[:len(self.names) + 1]
        data = np.frombuffer(self.names.buffers()[2], dtype=np.uint8)
        of_word = C.hash_spans(data, off[:-1], off[1:])
        salt = np.array([C.mix(np.frombuffer(x.encode("utf-8", "replace").ljust(8, b"\0")[:8],
                                             dtype=np.uint64))[0] for x in self.lang_names],
                        dtype=np.uint64)
        return C.mix(of_word[self.codes] ^ salt[self.lang])

    def runs(self, k: int) -> np.ndarray:
        """A hash of the k words from each place on (those in one piece count)."""
        h = self.hash.copy()
        for j in range(1, k):
            h[:self.n - j] = C.mix(h[:self.n - j] * np.uint64(0xD6E8FEB86659FD93) + self.hash[j:])
        return h

    def passing(self, filters: list[np.ndarray], bits: int) -> list[np.ndarray]:
        """For k = 1, 2, ... whether the run of k words from each place on is in one piece
        and passes the bitmaps of its length and of all its parts. One more entry than
        ``filters``: its runs are those to be counted next."""
        out = [np.ones(self.n, dtype=bool)]
        for k, packed in enumerate(filters, 1):
            at = np.flatnonzero(out[-1])
            bucket = (self.runs(k)[at] >> np.uint64(64 - bits)).astype(np.int64)
            out[-1][at] = (packed[bucket >> 3] >> (bucket & 7).astype(np.uint8) & 1).astype(bool)
            more = np.zeros(self.n, dtype=bool)
            more[:-1] = out[-1][:-1] & out[-1][1:] & self.joined[:-1]
            out.append(more)
        return out


def _rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Words]:
    for b in C.slices(batches, size=size):
        yield Words(b.column("lang").to_pylist(), b.column("text").to_pylist())


# ------------------------------------------------------------- bucket counts

def _count_buckets(filters: list[np.ndarray], bits: int, min_count: int):
    """Counts of the buckets of the next longer runs, cut into rows of 2**15 buckets: their
    numbers and counts. A count over ``min_count`` decides no more than that number does."""
    unit = "<u1" if min_count < 256 else "<u4"
    k = len(filters) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            at, n = np.unique(np.concatenate(held), return_counts=True)
            n = np.minimum(n, min_count).astype(unit)
            part, first = np.unique(at >> PART_BITS, return_index=True)
            edges = [*first.tolist(), len(at)]
            low = (at & ((1 << PART_BITS) - 1)).astype("<u2")
            return pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()),
                 pa.array([low[i:j].tobytes() for i, j in zip(edges, edges[1:])], pa.binary()),
                 pa.array([n[i:j].tobytes() for i, j in zip(edges, edges[1:])], pa.binary())],
                names=["part", "at", "n"])

        for w in _rows(batches, C.SLICE_BYTES):
            if not w.n:
                continue
            take = w.passing(filters, bits)[-1]
            held.append((w.runs(k)[take] >> np.uint64(64 - bits)).astype(np.uint32))
            size += len(held[-1])
            if size > 6_000_000:
                yield counted()
                held, size = [], 0
        if size:
            yield counted()
    return run


def _sum_buckets(min_count: int):
    """Bitmaps of the buckets that reach ``min_count``. A task holds the counts of its own
    parts, 64 KB or 128 KB each."""
    unit = "<u1" if min_count < 256 else "<u4"
    wide = np.uint16 if min_count < 256 else np.uint64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for part, at, n in zip(*(b.column(c).to_pylist() for c in ("part", "at", "n"))):
                have = total.get(part)
                if have is None:
                    have = total[part] = np.zeros(1 << PART_BITS, dtype=wide)
                at = np.frombuffer(at, dtype="<u2")
                have[at] = np.minimum(have[at] + np.frombuffer(n, dtype=unit), min_count)
        for part, n in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()),
                 pa.array([np.packbits(n >= min_count, bitorder="little").tobytes()], pa.binary())],
                names=["part", "bits"])
    return run


def frequent_runs(docs: DataFrame, filters: list[np.ndarray], bits: int,
                  min_count: int) -> np.ndarray:
    """One bit for each bucket of the next longer runs: set where they reach ``min_count``."""
    counts = docs.mapInArrow(_count_buckets(filters, bits, min_count),
                             "part int, at binary, n binary")
    parts = max(16, C.partitions(docs.sparkSession))
    maps = (counts.repartition(parts, "part")
            .mapInArrow(_sum_buckets(min_count), "part int, bits binary")
            .collect())  # 2**(bits - 15) rows of 4 KB at most
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    step = 1 << (PART_BITS - 3)
    for r in maps:
        out[r.part * step:(r.part + 1) * step] = np.frombuffer(bytes(r.bits), dtype=np.uint8)
    return out


# -------------------------------------------------------------- lead windows

def _windows(filters: list[np.ndarray], bits: int):
    """The windows of a task with their counts, summed over all its rows as long as the
    distinct ones fit ``HELD_BYTES``; beyond that they leave in several sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", *COLUMNS]
        total: list[pa.Table] = []  # a sum, if any, and the windows met since
        met = 0

        def summed() -> pa.Table:
            return pa.concat_tables(total).group_by(names, use_threads=False).aggregate(
                [("n", "sum")]).select([*names, "n_sum"]).rename_columns([*names, "n"])

        for w in _rows(batches, SLICE):
            if not w.n:
                continue
            passing = w.passing(filters, bits)
            columns: list[pa.Array] = [pa.array(w.lang)]
            held = passing[0]
            for k in range(MOST_WORDS):
                if k:  # the longest run known to end with the word k places on
                    longest = min(k, len(filters) - 1)
                    last, lag = passing[longest], k - longest
                    step = np.zeros(w.n, dtype=bool)
                    step[:w.n - lag] = last[lag:]
                    held = held & step
                code = np.zeros(w.n, dtype=np.int32)
                code[:w.n - k] = w.codes[k:]  # the lead column by k words
                columns.append(pa.array(code, mask=~held))
            t = pa.table(columns, names=names).group_by(names, use_threads=False).aggregate(
                [([], "count_all")]).combine_chunks()
            langs = pa.array(w.lang_names, pa.string())
            out = [langs.take(t.column("lang").combine_chunks())]
            out += [w.names.take(t.column(c).combine_chunks()).cast(pa.string()) for c in COLUMNS]
            total.append(pa.Table.from_arrays(
                [*out, t.column("count_all").cast(pa.int64())], names=[*names, "n"]))
            met += total[-1].nbytes
            if met > HELD_BYTES:
                total, met = [summed()], 0
                if total[0].nbytes > HELD_BYTES:
                    yield from total.pop().to_batches(max_chunksize=50_000)
        if total:
            yield from summed().to_batches(max_chunksize=50_000)
    return run


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, filtered: int = FILTERED,
                  bits: int | None = None) -> DataFrame:
    """lang, k, phrase, f of each phrase of 1..5 words that occurs ``min_count`` times, and
    of each language with k = 0, phrase '' and all its words."""
    C.text_session(docs.sparkSession)
    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                      F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chars = own.agg(F.sum(F.length("text").cast("long")).alias("n")).first().n or 0
    if bits is None:
        bits = max(LEAST_BITS, min(MOST_BITS, int(chars).bit_length() - CHARS_BITS))
    filters: list[np.ndarray] = []
    for _ in range(filtered):
        filters.append(frequent_runs(own, filters, bits, min_count))
    # A task for each core: every task hands on a phrase once, so tasks that grew in number
    # with the input, as phrases do, would hand on rows with its square.
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-chars // TASK_CHARS))
    windows = own.coalesce(tasks).mapInArrow(
        _windows(filters, bits), "lang string, " + ", ".join(f"{c} string" for c in COLUMNS)
        + ", n long")
    rolled = windows.rollup("lang", *COLUMNS).agg(F.sum("n").alias("f"),
                                                  F.grouping_id().alias("level"))
    # The level with k words kept has the last 5 - k bits set. Padding ends a window, so
    # a row whose last kept word is NULL repeats a shorter phrase and is left out.
    size = F.lit(None).cast("int")
    for k in range(MOST_WORDS, 0, -1):
        size = F.when((F.col("level") == (1 << (MOST_WORDS - k)) - 1)
                      & F.col(COLUMNS[k - 1]).isNotNull(), F.lit(k)).otherwise(size)
    size = F.when(F.col("level") == (1 << MOST_WORDS) - 1, F.lit(0)).otherwise(size)
    return (rolled.withColumn("k", size).filter("k is not null")
            .filter((F.col("k") == 0) | (F.col("f") >= min_count))
            .select("lang", "k", F.concat_ws(" ", *COLUMNS).alias("phrase"), "f"))


# -------------------------------------------------------------------- scores

def _part(lo: Column, hi: Column) -> Column:
    """Words lo..hi (from 1) of the array ``words``, joined."""
    return F.array_join(F.slice("words", lo, hi - lo + 1), " ")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, absorb: int = ABSORB,
                 top: int | None = TOP, filtered: int = FILTERED,
                 bits: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score; ``top``: ranks kept of a language.
    ``filtered`` (2 to 5) and ``bits`` say how much is pruned, not what is returned."""
    if not 2 <= filtered <= MOST_WORDS or bits is not None and not PART_BITS <= bits <= 32:
        raise ValueError("filtered must be 2..5, bits 15..32")
    counts = phrase_counts(docs, min_count, filtered, bits).checkpoint()
    known = counts.filter("k > 0").select("lang", "phrase", "f")
    cand = (counts.filter("k >= 2").withColumn("words", F.split("phrase", " "))
            .withColumnRenamed("f", "a"))

    # A candidate goes where a longer one has its words and (all of) its occurrences.
    inner = F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("k") - 1),
        lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1),
                              lambda i: _part(i, i + m - 1)))))
    absorbing = (cand.filter("k >= 3").select("lang", inner.alias("phrase"), "a")
                 .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    left = (cand.join(absorbing, ["lang", "phrase"], "left")
            .filter(F.col("longer").isNull() | (100 * F.col("longer") < absorb * F.col("a"))))

    # n is joined over salted keys: one language may have most of the candidates.
    total = (counts.filter("k = 0").select("lang", F.col("f").alias("n"), F.explode(
        F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    left = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int"))
    cuts = (left.join(total, ["lang", "salt"])
            .select("lang", "phrase", "a", "n", "k", "words",
                    F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
            .select("lang", "phrase", "a", "n", "cut", _part(F.lit(1), F.col("cut")).alias("head"),
                    _part(F.col("cut") + 1, F.col("k")).alias("tail")))
    both = (cuts.join(known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")),
                      ["lang", "head"])
            .join(known.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")),
                  ["lang", "tail"]))
    score = F.expr("(cast(a as decimal(18,0)) * cast(n as decimal(18,0)) * 1000)"
                   " div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    lowest = (both.withColumn("score", score).groupBy("lang", "phrase")
              .agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("x")))
    scored = lowest.select("lang", "phrase", "x.a", "x.l", "x.r", "x.n", "x.score")
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(place))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l",
                         "r", "n", "score")


def op11(spark, sf_dir: str) -> DataFrame:
    return collocations(C.table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH docs AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws
  FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs)),
starts AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM pieces WHERE len(ws) > 0),
grams AS (
  SELECT lang, m.k, array_to_string(ws[i:i + m.k - 1], ' ') AS phrase
  FROM starts, (SELECT unnest(range(1, 6)) AS k) m WHERE i + m.k - 1 <= len(ws)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, count(*) AS n FROM starts GROUP BY lang),
cand AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, f AS a FROM f WHERE k >= 2),
inside AS (
  SELECT lang, array_to_string(ws[p.i:p.i + q.m - 1], ' ') AS phrase, max(a) AS longer
  FROM cand, (SELECT unnest(range(1, 5)) AS i) p, (SELECT unnest(range(2, 5)) AS m) q
  WHERE q.m < cand.k AND p.i + q.m - 1 <= cand.k GROUP BY ALL),
kept AS (
  SELECT cand.* FROM cand LEFT JOIN inside USING (lang, phrase)
  WHERE longer IS NULL OR 100 * longer < 100 * a),
cuts AS (
  SELECT kept.lang, kept.phrase, a, n, c.k AS cut, x.f AS l, y.f AS r,
         (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score
  FROM kept JOIN n ON n.lang = kept.lang
  JOIN (SELECT unnest(range(1, 5)) AS k) c ON c.k < kept.k
  JOIN f x ON x.lang = kept.lang AND x.phrase = array_to_string(ws[1:c.k], ' ')
  JOIN f y ON y.lang = kept.lang AND y.phrase = array_to_string(ws[c.k + 1:kept.k], ' ')),
best AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM cuts),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
         phrase, a, l, r, n, CAST(score AS BIGINT) AS score
  FROM best WHERE o = 1)
SELECT * FROM ranked WHERE rank <= 2000
"""
