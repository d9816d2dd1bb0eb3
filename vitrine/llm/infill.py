"""Fill-in-the-middle transformation over a piecewise-linear learned rank index.

A text's tokens are runs of ASCII letters and single other characters. Its boundary
offsets off[0] = 0 < ... < off[n] = length are not kept as a list but as an index: line
segments, fitted so that no boundary lies further than ``error`` characters from its
segment, and one signed byte for each boundary with what the line misses (two bytes
where ``error`` is over 127). Segments start at ``segment`` ranks and are halved until they keep within
the error. A cut asks the index: the segment of the rank is found, its line predicts the
offset, and the stored residual corrects it exactly.

Ranks of the two cuts, and the form (plain, prefix-suffix-middle or suffix-prefix-middle),
come from a hash of the document's id. Whole texts are read; an index lives for one slice
of some megabytes of text.

Defined cases: a NULL or empty text is plain; a NULL doc_id hashes as an empty number;
repeated rows are each transformed alike; other columns are not read; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM = 90  # h3 % 100 from which a text stays plain
SPM_BELOW = 20  # h4 % 100 below which the suffix comes first
SEED = "1"
ERROR = 31
SEGMENT = 256

_LETTER = np.zeros(128, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts end to end, and n + 1 offsets."""
    lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return flat, np.r_[0, np.cumsum(lens)]


def boundaries(flat: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Boundary offsets of each text, its two ends included, text after text, and where
    each text's begin (n + 1 numbers). A text of no characters has one boundary, 0."""
    low = np.minimum(flat, 127)
    letter = _LETTER[low]
    starts = np.ones(len(flat), dtype=bool)
    starts[1:] = ~(letter[1:] & letter[:-1])
    starts[first[:-1][np.diff(first) > 0]] = True
    at = np.flatnonzero(starts)
    per_text = np.searchsorted(at, first)
    count = np.diff(per_text)  # tokens of each text
    begin = np.r_[0, np.cumsum(count + 1)]
    out = np.empty(begin[-1], dtype=np.int64)
    of_text = np.repeat(np.arange(len(count)), count)
    out[np.arange(len(at)) + of_text] = at - first[of_text]
    out[begin[1:] - 1] = np.diff(first)
    return out, begin


@dataclass
class RankIndex:
    """Line segments over many sorted lists: ``start`` (first place of a segment), its
    line, and the residual of each place."""

    start: np.ndarray
    origin: np.ndarray
    slope: np.ndarray
    residual: np.ndarray

    def predict(self, place: np.ndarray) -> np.ndarray:
        s = np.searchsorted(self.start, place, side="right") - 1
        return np.rint(self.origin[s] + self.slope[s] * (place - self.start[s])).astype(np.int64)

    def select(self, place: np.ndarray) -> np.ndarray:
        """The exact value at each place."""
        return self.predict(place) + self.residual[place]


def fit(values: np.ndarray, begin: np.ndarray, error: int = ERROR,
        segment: int = SEGMENT) -> RankIndex:
    """Index of the lists values[begin[i]:begin[i + 1]], each ascending and not empty."""
    lens = np.diff(begin)
    parts = -(-lens // segment)
    of_list = np.repeat(np.arange(len(lens)), parts)
    nth = np.arange(len(of_list)) - np.repeat(np.cumsum(parts) - parts, parts)
    lo = begin[of_list] + nth * segment
    hi = np.minimum(lo + segment, begin[of_list + 1])
    residual = np.zeros(len(values), dtype=np.int8 if error <= 127 else np.int16)
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(lo):
        n = hi - lo
        slope = (values[hi - 1] - values[lo]) / np.maximum(n - 1, 1)
        seg = np.repeat(np.arange(len(lo)), n)
        step = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
        place = lo[seg] + step
        # The line runs through the ends and is moved to the middle of what it misses.
        miss = values[place] - slope[seg] * step
        edge = np.cumsum(n) - n
        most, least = np.maximum.reduceat(miss, edge), np.minimum.reduceat(miss, edge)
        origin = (most + least) / 2
        good = (most - least) / 2 <= error - 1
        ok = good[seg]
        line = np.rint(origin[seg[ok]] + slope[seg[ok]] * step[ok]).astype(np.int64)
        residual[place[ok]] = values[place[ok]] - line
        kept.append((lo[good], origin[good], slope[good]))
        half = lo[~good] + n[~good] // 2
        lo, hi = np.r_[lo[~good], half], np.r_[half, hi[~good]]
        order = np.argsort(lo, kind="stable")
        lo, hi = lo[order], hi[order]
    start, origin, slope = (np.concatenate(x) for x in zip(*kept))
    order = np.argsort(start, kind="stable")
    return RankIndex(start[order], origin[order], slope[order], residual)


def draws(doc_id: int | None, seed: str = SEED) -> tuple[int, int, int, int]:
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(h[8 * k:8 * k + 8], 16) for k in range(4))


def restore(output: str, form: str) -> str:
    """The text that ``output`` was made from. The markers occur in no cut text, so the
    first of each is the one put in."""
    if form == "plain":
        return output
    second, third = (SUFFIX, MIDDLE) if form == "psm" else (PREFIX, MIDDLE)
    head, rest = output[len(PREFIX if form == "psm" else SUFFIX):].split(second, 1)
    tail, middle = rest.split(third, 1)
    return head + middle + tail if form == "psm" else tail + middle + head


def _transform(error: int, segment: int, seed: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches):
            ids = b.column("doc_id").to_pylist()
            texts = [t or "" for t in b.column("text").to_pylist()]
            flat, first = code_points(texts)
            offsets, begin = boundaries(flat, first)
            index = fit(offsets, begin, error, segment)
            tokens = np.diff(begin) - 1
            del offsets
            rows = []
            drawn = [draws(d, seed) for d in ids]
            r1 = np.array([h[0] for h in drawn], dtype=np.int64) % (tokens + 1)
            r2 = np.array([h[1] for h in drawn], dtype=np.int64) % (tokens + 1)
            lo = index.select(begin[:-1] + np.minimum(r1, r2)).tolist()
            hi = index.select(begin[:-1] + np.maximum(r1, r2)).tolist()
            segments = np.diff(np.searchsorted(index.start, begin)).tolist()
            for t, h, i, j in zip(texts, drawn, lo, hi):
                if not t or h[2] % 100 >= PLAIN_FROM or any(
                        m in t for m in (PREFIX, SUFFIX, MIDDLE)):
                    rows.append(("plain", None, None, t))
                    continue
                p, m, s = t[:i], t[i:j], t[j:]
                rows.append(
                    ("spm", i, j - i, f"{SUFFIX}{s}{PREFIX}{p}{MIDDLE}{m}") if h[3] % 100 < SPM_BELOW
                    else ("psm", i, j - i, f"{PREFIX}{p}{SUFFIX}{s}{MIDDLE}{m}"))
            form, pre, mid, out = zip(*rows)
            back = [restore(o, f) for o, f in zip(out, form)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(tokens, pa.int64()), pa.array(form, pa.string()),
                 pa.array(pre, pa.int64()), pa.array(mid, pa.int64()), pa.array(out, pa.string()),
                 pa.array(back, pa.string()), pa.array(segments, pa.int64())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored",
                       "segments"])
    return run


def fill_in_middle(docs: DataFrame, error: int = ERROR, segment: int = SEGMENT,
                   seed: str = SEED) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output, restored (rebuilt from output
    and form) and segments of the index for every row of ``docs``."""
    if not 1 <= error < 2 ** 15 or segment < 2:
        raise ValueError("error must be 1..32767, segment 2 or more")
    C.text_session(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).mapInArrow(
        _transform(error, segment, seed),
        "doc_id long, n long, form string, prefix_chars long, middle_chars long, "
        "output string, restored string, segments long")


def op13(spark, sf_dir: str) -> DataFrame:
    out = fill_in_middle(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                      F.sha2("output", 256).alias("output_sha256"),
                      F.sha2("restored", 256).alias("restored_sha256"))


OP13_SQL = r"""
WITH toks AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS toks,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
drawn AS (
  SELECT *, len(toks) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM toks),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>')
                   OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT *, array_to_string(toks[1:i], '') AS p, array_to_string(toks[i + 1:j], '') AS m,
         array_to_string(toks[j + 1:n], '') AS s
  FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
