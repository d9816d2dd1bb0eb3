"""Harmonic packing of documents into sequences of a fixed capacity.

A piece of n tokens belongs to the class k = capacity // n: its length lies in
(capacity / (k + 1), capacity / k], so k pieces of the class always fit one bin. Each
worker fills the bins of its own partition in the order it reads, one open bin of a
class at a time, and closes a bin with its k-th document.

Documents are kept whole where that works. One of more than a sequence first fills whole
sequences; its rest, and documents of class 1 (over half a sequence), wait in a queue of
at most ``QUEUE`` sequences and fill what closed bins leave, being cut for it. When the
queue is empty the next document joins it, whatever its class. A gap of fewer than
``LEAST`` tokens stays padding, so that it makes no crumb.

At the end of a partition the open bins and the queue are laid end to end, longest
first, into full sequences; what does not fill one is closed as one sequence for each
binary digit of its length. Such a sequence has a power of two of tokens, which needs
no padding. No row is moved between workers, and a repeated task makes the same
sequences, as a partition is read in one order. A worker holds the ids of its open bins
(fewer than 2 * sqrt(capacity) bins) and of its queue, and nothing that grows with the
input.

``sequence_id`` is partition * 2**36 + a count within the partition.

Token ids come from a public tokenizer's file. Its normaliser and splitter never
join text across white space, so the ids of a text are those of its blank-parted
chunks in order; chunks are encoded once and kept in a bounded cache.

Defined cases: NULL or empty text is the end id alone; repeated rows are packed
each; a NULL doc_id is kept; only doc_id and text are read; an empty table gives
no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

CAPACITY = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
CACHE_CHUNKS = 800_000
SLICE = 1_000_000
#: Sequences' worth of tokens that may wait to fill gaps.
QUEUE = 64
#: A smaller gap stays padding.
LEAST = 16
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")
#: A word of Latin letters and its closing marks: one or two pieces for the
#: tokenizer's splitter.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@[-`{-~]*)")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of texts. Chunks are told apart by a 64-bit hash; each has a slot
    that names its ids. Most chunks are a word and closing marks: their ids are
    put together from those of the lower-cased word and of the marks, so that few
    strings need the tokenizer. Over ``cache_chunks`` slots, all start anew."""

    def __init__(self, path: str, end_id: int, cache_chunks: int = CACHE_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.end_id = end_id
        vocab = self.tok.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.cache_chunks = cache_chunks
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.slots = np.zeros(0, dtype=np.int64)
        self.atoms: dict[str, int] = {}
        self.flat = np.zeros(1 << 20, dtype="<u4")
        self.first = np.zeros(1 << 19, dtype=np.int64)
        self.count = np.zeros(1 << 19, dtype=np.int64)
        self.used = self.n = 0
        self._add(np.array([self.end_id], dtype="<u4"), np.array([1]))  # slot 0: the end
        self.atoms[""] = self._add(np.zeros(0, dtype="<u4"), np.array([0])).start

    def _add(self, flat: np.ndarray, lens: np.ndarray) -> range:
        n, total, more = self.n, len(flat), len(lens)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + more > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
            self.count = np.concatenate([self.count, np.zeros_like(self.count)])
        self.flat[self.used:self.used + total] = flat
        self.first[n:n + more] = self.used + np.cumsum(lens) - lens
        self.count[n:n + more] = lens
        self.used += total
        self.n += more
        return range(n, n + more)

    def _ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of slots, end to end, and each one's count."""
        n = self.count[at]
        total = int(n.sum())
        shift = self.first[at] - (np.cumsum(n) - n)
        return self.flat[np.repeat(shift, n) + np.arange(total)], n

    def _add_atoms(self, strings: list[str]) -> None:
        ids = [e.ids for e in self.tok.encode_batch(strings, add_special_tokens=False)]
        lens = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.fromiter((x for y in ids for x in y), dtype="<u4", count=int(lens.sum()))
        self.atoms.update(zip(strings, self._add(flat, lens)))

    def _learn(self, chunks: list[str]) -> np.ndarray:
        """New slots of new chunks."""
        atoms, match = self.atoms, _PLAIN.fullmatch
        parts = [(m[1].lower(), m[2]) if (m := match(c)) else (c, None) for c in chunks]
        odd = dict.fromkeys(w if m is None else m for w, m in parts)
        odd = [x for x in odd if x not in atoms]
        new = [w for w in dict.fromkeys(w for w, m in parts if m is not None) if w not in atoms]
        if new:
            flat = np.array(self.tok.encode(" ".join(new), add_special_tokens=False).ids,
                            dtype="<u4")
            ends = np.flatnonzero(self.closes[flat]) + 1
            if len(ends) == len(new):  # one closing token for each word
                atoms.update(zip(new, self._add(flat, np.diff(ends, prepend=0))))
            else:
                odd += new
        if odd:
            self._add_atoms(odd)
        pairs = np.array([[atoms[w], atoms[m or ""]] for w, m in parts], dtype=np.int64)
        flat, lens = self._ids(pairs.ravel())
        return np.array(self._add(flat, lens[0::2] + lens[1::2]))

    def _slots(self, hashes: np.ndarray, string) -> np.ndarray:
        """The slot of each chunk; ``string(i)`` gives the i-th chunk's text."""
        u, one, inv = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(u) > self.cache_chunks:
            self._clear()
        j = np.searchsorted(self.keys, u)
        known = j < len(self.keys)
        known[known] = self.keys[j[known]] == u[known]
        slots = np.empty(len(u), dtype=np.int64)
        slots[known] = self.slots[j[known]]
        new = np.flatnonzero(~known)
        if len(new):
            slots[new] = self._learn([string(i) for i in one[new].tolist()])
            self.keys = np.insert(self.keys, j[new], u[new])
            self.slots = np.insert(self.slots, j[new], slots[new])
        return slots[inv]

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, each followed by the end id, and n + 1 offsets."""
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        joined = b"\n".join(raw) + b"\n"
        b = np.frombuffer(joined, dtype=np.uint8)
        s, e = C.word_spans(b, C.BLANKS)
        chunk_slots = self._slots(C.hash_spans(b, s, e),
                                  lambda i: joined[s[i]:e[i]].decode()) if len(s) else s
        ends = np.cumsum([len(x) + 1 for x in raw])
        at = np.insert(chunk_slots, np.searchsorted(s, ends), 0)
        flat, n = self._ids(at)
        last = np.searchsorted(s, ends) + np.arange(len(raw))
        return flat, np.r_[0, np.cumsum(n)[last]]


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """One encoder for the life of a worker: its cache serves later tasks too."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def digits(n: int) -> list[int]:
    """The powers of two that add up to n, largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class Piece(NamedTuple):
    """Consecutive ids of one document, from ``start`` on."""

    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int

    def cut(self, n: int) -> tuple["Piece", "Piece"]:
        return (self._replace(ids=self.ids[:n]),
                self._replace(start=self.start + n, ids=self.ids[n:]))


class Packer:
    """Fills the sequences of one partition; ``done`` holds rows of closed ones."""

    def __init__(self, capacity: int, first_id: int, queue: int = QUEUE, least: int = LEAST):
        self.capacity, self.least, self.room = capacity, least, queue * capacity
        self.next_id = first_id
        self.bins: dict[int, list[Piece]] = {}
        self.queue: deque[Piece] = deque()
        self.waiting = 0  # tokens in the queue
        self.short: tuple[list[Piece], int] | None = None  # a closed bin and its gap
        self.done: list[tuple] = []

    def _emit(self, pieces: list[Piece]) -> None:
        at = 0
        for p in pieces:
            n = len(p.ids)
            self.done.append((p.doc_id, p.start, n, zlib.crc32(p.ids.tobytes()), p.doc_tokens,
                              self.next_id, at))
            at += n
        self.next_id += 1

    def _fill(self, held: list[Piece], gap: int) -> None:
        while gap >= self.least and self.queue:
            p = self.queue.popleft()
            if len(p.ids) > gap:
                p, rest = p.cut(gap)
                self.queue.appendleft(rest)
            held.append(p)
            gap -= len(p.ids)
            self.waiting -= len(p.ids)
        if gap >= self.least:
            self.short = held, gap
        else:
            self._emit(held)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        p = Piece(doc_id, 0, ids, len(ids))
        while len(p.ids) >= self.capacity:
            whole, p = p.cut(self.capacity)
            self._emit([whole])
        n = len(p.ids)
        if not n:
            return
        p = p._replace(ids=p.ids.copy())  # the slice's ids are not kept
        k = self.capacity // n
        if not self.waiting or (k == 1 or p.start) and self.waiting + n <= self.room:
            self.queue.append(p)
            self.waiting += n
            if self.short:
                short, self.short = self.short, None
                self._fill(*short)
            return
        held = self.bins.setdefault(k, [])
        held.append(p)
        if len(held) == k:
            del self.bins[k]
            self._fill(held, self.capacity - sum(len(x.ids) for x in held))

    def finish(self) -> None:
        rest = [p for held in self.bins.values() for p in held] + list(self.queue)
        rest.sort(key=lambda p: -len(p.ids))
        held, gap = self.short or ([], self.capacity)
        for p in rest:
            while len(p.ids) >= gap:
                full, p = p.cut(gap)
                self._emit(held + [full])
                held, gap = [], self.capacity
            if len(p.ids):
                held.append(p)
                gap -= len(p.ids)
        for size in digits(self.capacity - gap):
            part: list[Piece] = []
            while size:
                p = held.pop(0)
                if len(p.ids) > size:
                    p, more = p.cut(size)
                    held.insert(0, more)
                part.append(p)
                size -= len(p.ids)
            self._emit(part)
        self.bins, self.queue, self.waiting, self.short = {}, deque(), 0, None


def _pack(path: str, end_id: int, capacity: int):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, end_id)
        packer = Packer(capacity, TaskContext.get().partitionId() << 36)

        def rows() -> Iterator[pa.RecordBatch]:
            if packer.done:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*packer.done)], names=names)
                packer.done.clear()

        for b in C.slices(batches, size=SLICE):
            flat, first = enc.encode_all(b.column("text").to_pylist())
            for d, doc_id in enumerate(b.column("doc_id").to_pylist()):
                packer.add(doc_id, flat[first[d]:first[d + 1]])
            yield from rows()
        packer.finish()
        yield from rows()
    return run


def harmonic_pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY,
                  end_id: int = END_ID) -> DataFrame:
    """One row per piece; see the module's text. ``capacity``: a power of two."""
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    C.text_session(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).mapInArrow(
        _pack(path or tokenizer_path(), end_id, capacity), SCHEMA)


def op10(spark, sf_dir: str) -> DataFrame:
    return harmonic_pack(C.table(spark, sf_dir, "documents"))
