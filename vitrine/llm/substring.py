"""Substring dedup by equality of windows bucketed by minimizer, in place of relative
Lempel-Ziv parsing (the README says why): no longest factors, no sources.

Contract: words are runs of bytes other than blank and TAB..CR. A word is
removed when some window of ``window`` consecutive words covers it whose word
sequence starts at another place too, in any document, the same one included.

Reference blocks are content-defined, so equal passages are cut into equal
blocks wherever they lie: the block of a window is its smallest ``gram``-word
hash (leftmost on ties). Every window has one block, equal windows have equal
blocks, and about one word in twelve starts a block.

1. Index: the blocks of all documents are counted. A window whose block occurs
   once cannot repeat, so only blocks seen twice or more are kept.
2. Windows: each document is read again against its kept blocks. The windows that
   share a block form one row (block, document, first window, window hashes):
   the stretch over which a repeat through this block may run.
3. They are checked window by window among the rows of one block; a window
   hash (64 bits within a 64-bit block) met twice marks the window. Runs of
   marked windows are the repeats of at least ``window`` words; they end exactly
   where the first window is met only once.
4. The marks come back to their document and the covered words go.

Hot blocks (over ``hot`` occurrences) are never gathered by block: their windows
are exploded, counted with map-side aggregation and joined back, where adaptive
execution splits large partitions. The others are streamed in sorted order, one
bounded group at a time.

Defined cases: NULL text has no words; fewer than ``window`` words: nothing is
removed; repeated rows repeat each other; NULL doc_id is kept as it is; columns
beyond doc_id and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW = 35
GRAM = 12
HOT = 20_000
_IDX = 24  # low bits of a packed gram that hold its place


def window_blocks(w: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Place (in ``w``) of the block of each window: leftmost smallest gram."""
    n = len(w) - window + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    span = window - gram + 1
    out = np.empty(n, dtype=np.int64)
    step = (1 << _IDX) - window
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        g = C.ngrams(w[lo:hi + window - 1], gram)
        low = np.uint64((1 << _IDX) - 1)
        m = (g & ~low) | np.arange(len(g), dtype=np.uint64)
        width = 1
        while width * 2 <= span:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        rest = span - width
        if rest:
            m = np.minimum(m[:-rest], m[rest:])
        out[lo:hi] = (m[:hi - lo] & low).astype(np.int64) + lo
    return out


def _keyed(docs: DataFrame, keep: list[str]) -> DataFrame:
    row = [F.struct(*[F.col(c) for c in keep]).alias("row")] if keep else []
    text = F.col("text").cast("string")
    # Documents without an id are told apart by 128 bits of their text, two texts under
    # one id by 64.
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text, F.lit(1))).alias("id"),
        F.xxhash64(text).alias("th"), text.alias("text"),
        F.col("doc_id").isNull().alias("no_id"), *row)


def _block_rows(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches):
            words, first = C.hashed_words(b.column("text").to_pylist(), False)
            hs, src = [], []
            for i in range(b.num_rows):
                w = words[first[i]:first[i + 1]]
                at = np.unique(window_blocks(w, window, gram))
                if len(at):
                    hs.append(C.ngrams(w, gram)[at])
                    src.append(np.full(len(at), i))
            if hs:
                take = pa.array(np.concatenate(src))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(C.signed(np.concatenate(hs))), b.column("id").take(take),
                     b.column("th").take(take)], names=["block", "id", "th"])
    return run


def _window_rows(window: int, gram: int):
    """Rows of one document and block: the hashes of the windows it serves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches):
            words, first = C.hashed_words(b.column("text").to_pylist(), False)
            kept, hot = b.column("kept"), b.column("hot")
            src, blocks, begin, hots, wins, lens = [], [], [], [], [], []
            for i in range(b.num_rows):
                w = words[first[i]:first[i + 1]]
                at = window_blocks(w, window, gram)
                if not len(at):
                    continue
                k = kept[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                hk = hot[i].values.to_numpy(zero_copy_only=False)
                order = np.argsort(k)
                k, hk = k[order], hk[order]
                start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                stop = np.r_[start[1:], len(at)]
                g = C.ngrams(w, gram)[at[start]]
                j = np.minimum(np.searchsorted(k, g), len(k) - 1)
                ok = np.flatnonzero(k[j] == g)
                if not len(ok):
                    continue
                wh = C.ngrams(w, window)
                start, stop = start[ok], stop[ok]
                for s, e in zip(start, stop):
                    wins.append(wh[s:e])
                lens.append(stop - start)
                src.append(np.full(len(ok), i))
                blocks.append(g[ok])
                begin.append(start)
                hots.append(hk[j[ok]])
            if src:
                take = pa.array(np.concatenate(src))
                off = np.r_[0, np.cumsum(np.concatenate(lens))].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(C.signed(np.concatenate(blocks))), b.column("id").take(take),
                     b.column("th").take(take), pa.array(np.concatenate(begin).astype(np.int64)),
                     pa.array(np.concatenate(hots)),
                     pa.ListArray.from_arrays(pa.array(off), pa.array(
                         C.signed(np.concatenate(wins))))],
                    names=["block", "id", "th", "begin", "hot", "wins"])
    return run


def _check_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mark window hashes met twice among the rows of a block."""
    for t in C.runs(batches, ["block"]):
        t = t.combine_chunks()
        lists = t.column("wins").combine_chunks()
        wh = lists.values.to_numpy(zero_copy_only=False)[
            lists.offsets[0].as_py():lists.offsets[-1].as_py()]
        lens = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(t.num_rows), lens)
        block = t.column("block").to_numpy()[row]
        order = np.lexsort((wh, block))
        same = (wh[order][1:] == wh[order][:-1]) & (block[order][1:] == block[order][:-1])
        dup = np.zeros(len(wh), dtype=bool)
        dup[order[1:][same]] = True
        dup[order[:-1][same]] = True
        hit = np.flatnonzero(dup)
        if not len(hit):
            continue
        place = np.arange(len(wh)) - np.repeat(np.cumsum(lens) - lens, lens)
        mask = np.zeros(t.num_rows, dtype=np.int64)
        np.bitwise_or.at(mask, row[hit], np.left_shift(np.int64(1), place[hit]))
        rows = np.flatnonzero(mask)
        take = pa.array(rows)
        yield pa.RecordBatch.from_arrays(
            [t.column("id").take(take).combine_chunks(), t.column("th").take(take).combine_chunks(),
             t.column("begin").take(take).combine_chunks(), pa.array(mask[rows])],
            names=["id", "th", "begin", "mask"])


def _cut(window: int):
    """Remove the covered words of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches):
            ns, gone, shas, kept_text = [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                arr = np.frombuffer(raw, dtype=np.uint8)
                s, e = C.word_spans(arr, C.BLANKS)
                cover = np.zeros(len(s) + 1, dtype=np.int64)
                marks = b.column("marks")[i].values
                if marks is not None and len(marks):
                    begin = marks.field("begin").to_numpy()
                    mask = marks.field("mask").to_numpy()
                    for j in range(window):
                        at = begin[(mask >> j) & 1 == 1] + j
                        np.add.at(cover, at, 1)
                        np.add.at(cover, at + window, -1)
                go = np.cumsum(cover)[:len(s)] > 0
                n_gone = int(go.sum())
                keep = np.flatnonzero(~go)
                kept = b" ".join([raw[x:y] for x, y in zip(s[keep].tolist(), e[keep].tolist())])
                ns.append(len(s))
                gone.append(n_gone)
                shas.append(hashlib.sha256(kept).hexdigest())
                kept_text.append(kept.decode("utf-8", "surrogatepass") if n_gone else text)
            row = ["row"] if "row" in b.schema.names else []
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("th"), b.column("no_id"), pa.array(ns, pa.int64()),
                 pa.array(gone, pa.int64()), pa.array(shas),
                 pa.array(kept_text, pa.string()), *[b.column(c) for c in row]],
                names=["id", "th", "no_id", "n_words", "n_removed", "kept_sha256", "kept_text",
                       *row])
    return run


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM,
                     hot: int = HOT, keep: list[str] | None = None) -> DataFrame:
    """(id, th, begin, mask): bit j of mask marks window ``begin + j``."""
    if not 0 < window - gram + 1 <= 62:
        raise ValueError("window - gram must be between 0 and 61")
    C.text_session(docs.sparkSession)
    n = C.partitions(docs.sparkSession)
    keyed = _keyed(docs, keep or [])
    blocks = keyed.select("id", "th", "text").mapInArrow(_block_rows(window, gram), "block long, id long, th long")
    # The second grouping key only makes the counted blocks be dealt out again for
    # the join, which adaptive execution can then split where a block is hot.
    index = (blocks.groupBy("block", F.hash("block").alias("again"))
             .agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
             .select("block", (F.col("n") > hot).alias("is_hot")))
    # One array entry for each block of one document, however often its row is repeated.
    per_doc = (blocks.join(index, "block").groupBy("id", "th")
               .agg(F.collect_set(F.struct("block", "is_hot")).alias("b"))
               .select("id", "th", F.col("b.block").alias("kept"), F.col("b.is_hot").alias("hot")))
    # All columns, though not all are used: the same exchange then serves the cut.
    rows = (keyed.join(per_doc, ["id", "th"]).select(*keyed.columns, "kept", "hot")
            .mapInArrow(_window_rows(window, gram),
                        "block long, id long, th long, begin long, hot boolean, wins array<long>"))
    cold = (rows.filter(~F.col("hot")).select("block", "id", "th", "begin", "wins")
            .repartition(n, "block").sortWithinPartitions("block")
            .mapInArrow(_check_blocks, "id long, th long, begin long, mask long"))
    open_rows = rows.filter("hot").select(
        "block", "id", "th", "begin", F.posexplode("wins").alias("j", "win"))
    # The third key, as in the index: a window met very often is split for the join.
    twice = (open_rows.groupBy("block", "win", F.hash("win").alias("again"))
             .agg(F.count(F.lit(1)).alias("n"))
             .filter("n > 1").select("block", "win"))
    warm = (open_rows.join(twice, ["block", "win"], "left_semi")
            .groupBy("id", "th", "begin")
            .agg(F.bit_or(F.expr("shiftleft(cast(1 as bigint), j)")).alias("mask")))
    return cold.unionByName(warm)


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM,
                    hot: int = HOT, keep: list[str] | None = None) -> DataFrame:
    """id (of the text where ``no_id``), th, no_id, n_words, n_removed, kept_sha256,
    kept_text for every row of ``docs``, and a struct ``row`` of the columns named in ``keep``. kept_text is the
    text as it was when nothing was removed."""
    marks = (repeated_windows(docs, window, gram, hot, keep).groupBy("id", "th")
             .agg(F.collect_set(F.struct("begin", "mask")).alias("marks")))
    # Repeated rows mark the same windows: a set per document is enough.
    keyed = _keyed(docs, keep or [])
    joined = (keyed.join(marks, ["id", "th"], "left")
              .withColumn("marks", F.coalesce("marks", F.expr(
                  "cast(array() as array<struct<begin: bigint, mask: bigint>>)"))))
    schema = ("id long, th long, no_id boolean, n_words long, n_removed long, kept_sha256 string, "
              "kept_text string")
    if keep:
        schema += f", row {keyed.schema['row'].dataType.simpleString()}"
    return joined.select(*keyed.columns, "marks").mapInArrow(_cut(window), schema)


def op4(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(C.table(spark, sf_dir, "documents"))
    return out.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"),
                      "n_words", "n_removed", "kept_sha256")
