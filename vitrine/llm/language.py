"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams, trained with FTRL and elastic-net penalties, then calibrated
with a temperature.

A text is lower-cased and every run of characters other than letters becomes one
blank. Its 1-, 2- and 3-grams are hashed into 2**16 buckets; a bucket's value is its
share of the text's n-grams times its inverse document frequency. Document
frequencies are counted over all documents that may be learned from, one table of
2**16 counts per task. The classifier is fitted in one task on a bounded,
hash-chosen sample of them (``per_class`` for each language); a fifth of the sample
is kept back for the temperature. All documents are scored on their whole text.

Defined cases: a NULL text or one without a letter is ``und`` with score 0; without
any document to learn from every prediction is ``und`` with score 0; a NULL lang or
doc_id is not learned from; repeated rows are scored each; a tie goes to the language
first in alphabetical order; other columns are not read; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .ftrl import Ftrl, temperature

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
PER_CLASS = 1_500
EPOCHS = 3
#: Brings shares of a text's n-grams to the size of one.
SCALE = 100.0
SLICE = 500_000

_letters: dict[str, np.ndarray] = {}


def _is_letter(codes: np.ndarray) -> np.ndarray:
    if "lut" not in _letters:
        _letters["lut"] = np.fromiter((chr(i).isalpha() for i in range(1 << 16)), dtype=bool,
                                      count=1 << 16)
    out = _letters["lut"][codes & 0xFFFF]
    for i in np.flatnonzero(codes >> 16):
        out[i] = chr(int(codes[i])).isalpha()
    return out


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all texts, their text's number (ascending), and
    whether each text has a letter."""
    low = [(t or "").lower() for t in texts]
    joined = " ".join(low)
    codes = np.frombuffer((" " + joined + " ").encode("utf-32-le", "replace"), dtype=np.uint32)
    lens = np.fromiter((len(t) + 1 for t in low), dtype=np.int64, count=len(low))
    owner = np.repeat(np.arange(len(low)), lens)
    owner = np.concatenate([[0], owner])[:len(codes)]
    letter = _is_letter(codes)
    # One blank between runs of letters: the first character after a run.
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    c = np.where(letter, codes, np.uint32(32))[keep]
    is_letter, owner = letter[keep], owner[keep]
    has = np.zeros(len(low), dtype=bool)
    has[owner[is_letter]] = True
    hashes, owners = [], []
    for n in ORDERS:
        m = len(c) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
        for j in range(n):
            h = (h ^ c[j:j + m]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
        # Blanks alone say nothing; an n-gram lies in one text.
        ok = is_letter[:m] | is_letter[n - 1:n - 1 + m]
        ok &= owner[:m] == owner[n - 1:n - 1 + m]
        hashes.append((h[ok] * np.uint32(0xC2B2AE35)) >> np.uint32(16))
        owners.append(owner[:m][ok])
    if not hashes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), has
    h = np.concatenate(hashes).astype(np.int64)
    o = np.concatenate(owners)
    order = np.argsort(o, kind="stable")
    return h[order], o[order], has


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(BUCKETS, dtype=np.int64)
    mark = np.zeros(BUCKETS, dtype=bool)
    for b in C.slices(batches, size=SLICE):
        h, o, _ = grams(b.column("text").to_pylist())
        first = np.searchsorted(o, np.arange(b.num_rows + 1))
        for i in range(b.num_rows):
            mine = h[first[i]:first[i + 1]]
            mark[mine] = True
            df += mark
            mark[mine] = False
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["bucket", "df"])


def example(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, _, _ = grams([text])
    idx, n = np.unique(h, return_counts=True)
    return idx, n / max(1, len(h)) * idf[idx] * SCALE


def _fit_task(idf: np.ndarray, classes: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b.column("text").to_pylist(),
                                                b.column("lang").to_pylist())]
        place = {c: k for k, c in enumerate(classes)}
        data = [(*example(t, idf), np.eye(len(classes))[place[c]]) for t, c in rows]
        back = [d for i, d in enumerate(data) if i % 5 == 0]
        learn = [d for i, d in enumerate(data) if i % 5] or data
        model = Ftrl(BUCKETS, len(classes), alpha=0.3, l1=0.5, l2=0.1).fit(learn, EPOCHS)
        w = model.weights()
        logits = np.array([np.append(x, 1.0) @ w[np.append(i, BUCKETS)] for i, x, _ in back])
        t = temperature(logits, np.array([int(y.argmax()) for *_, y in back])) if back else 1.0
        w /= t
        at, k = np.nonzero(w)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array(k), pa.array(w[at, k])], names=["bucket", "class", "weight"])
    return run


def train(docs: DataFrame, per_class: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, idf, and the calibrated weights (buckets and a bias x languages)."""
    known = docs.filter("text is not null and lang is not null").filter(~C.held_out())
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    found = {r.lang: r.n for r in counts.collect()}  # one row for each language
    classes = sorted(found)
    idf = np.zeros(BUCKETS)
    weights = np.zeros((BUCKETS + 1, len(classes)))
    if not classes:
        return classes, idf, weights
    df = np.zeros(BUCKETS)
    for r in (known.select("text").mapInArrow(_document_frequencies, "bucket long, df long")
              .groupBy("bucket").agg(F.sum("df").alias("df")).collect()):  # 2**16 rows at most
        df[r.bucket] = r.df
    idf = np.log((1 + sum(found.values())) / (1 + df)) + 0.1
    share = counts.select("lang", F.least(F.lit(1.0), F.lit(float(per_class)) / F.col("n"))
                          .alias("share"))
    sample = (known.join(F.broadcast(share), "lang")  # one row for each language
              .filter(F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1_000_000))
                      < F.col("share") * 1_000_000)
              .select("doc_id", "lang", "text").limit(2 * per_class * len(classes)))
    got = (sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "text")
           .mapInArrow(_fit_task(idf, classes), "bucket long, class long, weight double"))
    for r in got.collect():
        weights[r.bucket, r["class"]] = r.weight
    return classes, idf, weights


def _predict(classes: list[str], idf: np.ndarray, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = (weights[:-1] * idf[:, None] * SCALE).astype(np.float32)
        for b in C.slices(batches, size=SLICE):
            h, o, has = grams(b.column("text").to_pylist())
            n = np.bincount(o, minlength=b.num_rows)
            langs, scores = ["und"] * b.num_rows, [0.0] * b.num_rows
            if classes:
                logits = np.stack([np.bincount(o, weights=table[h, k], minlength=b.num_rows)
                                   for k in range(len(classes))], axis=1)
                logits = logits / np.maximum(n, 1)[:, None] + weights[-1]
                e = np.exp(logits - logits.max(axis=1, keepdims=True))
                p = e / e.sum(axis=1, keepdims=True)
                best = p.argmax(axis=1)
                langs = [classes[k] if x else "und" for k, x in zip(best, has)]
                scores = np.where(has, p[np.arange(len(p)), best], 0.0).tolist()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(langs), pa.array(scores, pa.float64())],
                names=["doc_id", "lang_pred", "score"])
    return run


def identify(docs: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``."""
    C.text_session(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                    F.col("text").cast("string").alias("text"),
                    F.col("lang").cast("string").alias("lang"))
    model = train(d.filter("doc_id is not null"), per_class)
    return (d.select("doc_id", "text")
            .mapInArrow(_predict(*model), "doc_id long, lang_pred string, score double")
            .select("doc_id", C.held_out().alias("held_out"), "lang_pred", "score"))


def op5(spark, sf_dir: str) -> DataFrame:
    return identify(C.table(spark, sf_dir, "documents"))
