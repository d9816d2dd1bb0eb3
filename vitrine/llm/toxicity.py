"""Toxicity by noisy-channel deobfuscation.

1. A character language model: counts of trigrams over 29 symbol classes (a-z,
   blank, digit, other letter), added up over all documents. The table has 29**3
   rows whatever the input.
2. Each obfuscated token or run of spaced letters becomes a lattice: a look-alike
   sign may stand for its letters or itself, a sign between single letters may be
   nothing or a blank, a letter repeated twice may be one or two, and one repeated
   three times or more one, two or all of them. Viterbi decoding over pairs of
   symbols finds the likeliest text under channel and language model. '!' and '('
   around a word are punctuation on one path and letters on another. The form as
   written stays beside the decoded ones, as letters and signs at the ends of a word
   often mean what they are. Tokens without letters to restore have one path, the
   token itself, and are not decoded. Whole texts are read.
3. The restored text is scored: sparse logistic regression (FTRL, elastic net) on
   the words of all its forms and their first four to six letters, each counted once.

A run of spaced letters is three or more single letters, digits or look-alike signs
with blanks of any kind and width, one sign, or one sign among blanks between;
punctuation around it is left out. Runs of digits alone are numbers.

The classifier is fitted on a bounded, hash-chosen sample of labelled rows
(``per_class`` for each label); the language model and the scores cover all rows.

Defined cases: NULL and empty texts get the score of the intercept; without any
labelled row for learning every score is 0; a document with several labels counts
as toxic if one says so; NULL labels and NULL ids are not learned from; repeated
rows are scored each; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .ftrl import Ftrl

PER_CLASS = 4_000
EPOCHS = 6
MIN_DOCS = 4
#: Memory of a worker for tokens seen before, in bytes.
CACHE = 48_000_000

# What look-alike signs stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t",
    "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c",
    "<": "c", "€": "e", "£": "l", "*": "aeiou", "#": "aeiouh",
}
SYMBOLS = 29
BLANK, DIGIT, OTHER = 26, 27, 28

_LETTER = "a-zß-öø-ÿ"
_PLAIN = re.compile(f"[{_LETTER}'’-]*")
_TRIPLE = re.compile(f"([{_LETTER}])\\1\\1")
_DOUBLE = re.compile(f"([{_LETTER}])\\1")
_SIGN = "".join(re.escape(c) for c in LOOKALIKES)
_MIXED = re.compile(f"[{_LETTER}][{_SIGN}]|[{_SIGN}][{_LETTER}]")
_DOTTED = re.compile(r"(?:[^\W_][.\-_*]){2,}[^\W_]")
_EDGES = ".,;:?!\"'()[]{}«»“”…"
#: What surrounds a word without standing for a letter.
_OUTER = "".join(c for c in _EDGES if c not in LOOKALIKES)
_ENDS = "".join(c for c in LOOKALIKES if not c.isdigit())
_REPEATED = re.compile(r"(.)\1\1+")
#: One character of a run, with no word going on behind it.
_UNIT = rf"(?:[^\W_]|[{_SIGN}])(?!\w|['’@$!|+(<€£#]\w)"
_SPACED = re.compile(
    rf"(?<!\w)(?<!\w['’]){_UNIT}(?:(?:\s+(?:[.\-_*]\s+)?|[.\-_*]){_UNIT}){{2,}}+")
_GAP = re.compile(r"\s+(?:[.\-_]\s+)?")
_WORD = re.compile(r"[^\W\d_]+")
_RUN = re.compile(r"(.)\1*", re.S)
#: What a letter repeated three times and more is: one, two or all of them.
_HALF, _SOME, _FEW = math.log(0.5), math.log(0.4), math.log(0.1)


def _symbol(c: str) -> int:
    if "a" <= c <= "z":
        return ord(c) - 97
    if c.isdigit():
        return DIGIT
    return OTHER if c.isalpha() else BLANK


def _symbol_table() -> np.ndarray:
    return np.array([_symbol(chr(c)) if c < 128 else OTHER for c in range(256)], dtype=np.int64)


# ------------------------------------------------------------ language model

def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lut = _symbol_table()
    total = np.zeros(SYMBOLS ** 3, dtype=np.int64)
    for b in C.slices(batches):
        raw = "  ".join(t.lower() for t in b.column("text").to_pylist() if t)
        c = lut[np.frombuffer(f"  {raw}  ".encode("utf-8", "replace"), dtype=np.uint8)]
        total += np.bincount((c[:-2] * SYMBOLS + c[1:-1]) * SYMBOLS + c[2:],
                             minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])


def language_model(docs: DataFrame) -> np.ndarray:
    """log P(c | a, b) as a (29, 29, 29) table, interpolated with lower orders."""
    rows = (docs.select(F.col("text").cast("string").alias("text"))
            .mapInArrow(_count_trigrams, "gram long, n long")
            .groupBy("gram").agg(F.sum("n").alias("n")).collect())  # 29**3 rows at most
    n = np.zeros(SYMBOLS ** 3)
    for r in rows:
        n[r.gram] = r.n
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two = n.sum(axis=0)
    three = n / np.maximum(n.sum(axis=2, keepdims=True), 1)
    p2 = two / np.maximum(two.sum(axis=1, keepdims=True), 1)
    p1 = two.sum(axis=0) / max(two.sum(), 1)
    return np.log(0.9 * three + 0.08 * p2[None] + 0.015 * p1[None, None] + 0.005 / SYMBOLS)


# -------------------------------------------------------------------- lattice

def lattice(observed: str, whole: bool = False, part: float = 0.15, inside: bool = False,
            ) -> list[list[tuple[str, float]]]:
    """The choices at each place: emitted text and log channel probability. ``whole``:
    look-alike signs are letters; ``part``: how likely a sign or blank stays; ``inside``:
    letters stand before the first place."""
    places: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(observed):
        c = observed[i]
        j = i + 1
        while j < len(observed) and observed[j] == c:
            j += 1
        run = j - i
        if c.isalpha():
            if run >= 3:
                places.append([(c, _HALF), (c * 2, _SOME), (c * run, _FEW)])
            elif run == 2:
                places.append([(c, _HALF), (c * 2, _HALF)])
            else:
                places.append([(c, 0.0)])
            i = j
            continue
        choices = []
        letters = LOOKALIKES.get(c, "")
        between = (inside or i > 0) and i < len(observed) - 1
        parts = c in " .-_*"
        share = (1 - part) / max(1, len(letters) + 2 * (parts and between))
        choices += [(x, math.log(share)) for x in letters]
        if parts and between:
            choices.append(("", math.log(2 * share)))
        if not (whole and letters):
            choices.append((c if c.isdigit() else " ", math.log(part)))
        places.append(choices)
        i += 1
    return places


class Table(list):
    """The language model as nested lists, with the ends of words decoded so far."""

    def __init__(self, lm: np.ndarray):
        super().__init__(lm.tolist())
        self.ends: dict[tuple, str] = {}


#: Ends of words kept beside a table, and the longest one kept.
KEPT_ENDS, LONGEST_END = 20_000, 16


def viterbi(observed: str, lm: np.ndarray | list, whole: bool = False, part: float = 0.15) -> str:
    """The likeliest restored text; ties go to the choice listed first.

    Letters up to one that is not repeated leave one state, whatever the repeated ones
    among them are: ``decode_letters`` restores them, and the search goes on from there."""
    table = lm.tolist() if isinstance(lm, np.ndarray) else lm
    head = _WORD.match(observed)
    k = head.end() if head and head[0].isalpha() else 0
    if k and k == len(observed):
        return decode_letters(observed, table)
    while k > 1 and observed[k - 1] == observed[k - 2]:
        c = observed[k - 1]
        while k and observed[k - 1] == c:
            k -= 1
    x = _symbol(observed[k - 2]) if k > 1 else BLANK
    y = _symbol(observed[k - 1]) if k else BLANK
    rest = observed[k:]
    ends = getattr(table, "ends", None)
    if ends is None or len(rest) > LONGEST_END:
        return decode_letters(observed[:k], table) + _search(rest, table, whole, part, x, y, k > 0)
    key = rest, whole, part, x, y, k > 0
    end = ends.get(key)
    if end is None:
        if len(ends) >= KEPT_ENDS:
            ends.clear()
        end = ends[key] = _search(rest, table, whole, part, x, y, k > 0)
    return decode_letters(observed[:k], table) + end


def _search(observed: str, table: list, whole: bool, part: float, x: int, y: int,
            inside: bool) -> str:
    """``viterbi`` after the symbols x and y."""
    # state (last two symbols) -> (log probability, back pointer)
    states = {(x, y): (0.0, None)}
    for choices in lattice(observed, whole, part, inside):
        new: dict[tuple, tuple] = {}
        for text, cost in choices:
            syms = [_symbol(c) for c in text]
            for (a, b), (score, back) in states.items():
                total, x, y = score + cost, a, b
                for s in syms:
                    total += table[x][y][s]
                    x, y = y, s
                if (x, y) not in new or total > new[x, y][0]:
                    new[x, y] = (total, (text, back))
        states = new
    best = max(((score + table[a][b][BLANK], back) for (a, b), (score, back) in states.items()),
               key=lambda v: v[0])[1]
    out = []
    while best:
        out.append(best[0])
        best = best[1]
    return "".join(reversed(out))


def decode_letters(word: str, table: list) -> str:
    """``viterbi`` of a word of letters alone. What a repeated letter stands for changes
    only the trigrams from the letter before it to the letter behind it, so each one is
    decided by itself; the first of equals is taken, as there."""
    runs = [(m[0][0], len(m[0])) for m in _RUN.finditer(word)]
    out = []
    for i, (c, run) in enumerate(runs):
        if run == 1:
            out.append(c)
            continue
        x = _symbol(c)
        b = _symbol(runs[i - 1][0]) if i else BLANK
        d = _symbol(runs[i + 1][0]) if i + 1 < len(runs) else BLANK
        one = table[b][x][d]
        two = table[b][x][x] + table[x][x][d]
        if run == 2:
            out.append(c * 2 if two > one else c)
            continue
        _, n = max([(_HALF + one, -1), (_SOME + two, -2),
                    (_FEW + two + (run - 2) * table[x][x][x], -run)])
        out.append(c * -n)
    return "".join(out)


def _decoded(core: str, table: list) -> str:
    """The likeliest text of a token without punctuation around it."""
    if core.isalpha():
        return decode_letters(core, table) if _DOUBLE.search(core) else core
    if not core or _PLAIN.fullmatch(core) and not _DOUBLE.search(core) and not _DOTTED.search(core):
        return core
    if _DOUBLE.search(core) or _MIXED.search(core) or _DOTTED.search(core):
        return viterbi(core, table)
    return core


def restore_token(token: str, table: list) -> str:
    """A lower-cased token as it was meant, its punctuation taken as such."""
    core = token.strip(_EDGES)
    if _PLAIN.fullmatch(core) and not _TRIPLE.search(core) and not _DOTTED.search(core):
        return token
    text = _decoded(core, table)
    return token if text == core else text


def _ends(signs: str, lead: bool) -> list[str]:
    """What the look-alike signs before or behind a word may belong to it: none, the
    nearest one, or all (a sign repeated three times and more counts once)."""
    near = signs[-1:] if lead else signs[:1]
    return list(dict.fromkeys(["", near, _REPEATED.sub(r"\1", signs)]))


def token_forms(token: str, table: list, decoded=_decoded) -> list[str]:
    """The forms of a lower-cased token: as written, as decoded, and with look-alike
    signs at its ends as letters."""
    inner = token.strip(_OUTER)
    core = inner.strip(_ENDS)
    forms = [token, decoded(inner.strip(_EDGES), table)]
    if core != inner and any(c.isalpha() for c in core):
        at = inner.index(core)
        forms += [viterbi(a + core + b, table, whole=True)
                  for a in _ends(inner[:at], True)
                  for b in _ends(inner[at + len(core):], False) if a or b]
    return forms


def run_forms(run: str, table: list, decoded=_decoded) -> list[str]:
    """The forms of a run of single characters: signs at its ends as letters and as
    punctuation, blanks between words few or many, a first 'a' or 'i' for itself."""
    if not any(c.isalpha() or c in _ENDS for c in run):
        return []  # digits alone are numbers
    run = _GAP.sub(" ", run)
    seen = [run, run.strip(_ENDS + " .-_"), *([run[2:]] if run[0] in "ai" else [])]
    forms = [viterbi(x, table, part=part) for x in dict.fromkeys(seen) if len(x) > 2
             for part in (0.15, 0.6)]
    return forms + [" ".join(decoded(w, table) for w in x.split()) for x in dict.fromkeys(forms)]


# ------------------------------------------------------------------- features

def word_features(text: str) -> set[str]:
    """Words of a restored text and their beginnings, '^' marking the latter."""
    out: set[str] = set()
    for w in _WORD.findall(text):
        out.add(w)
        for n in (4, 5, 6):
            if len(w) > n:
                out.add("^" + w[:n])
    return out


_NONE: frozenset = frozenset()


class Scorer:
    """Features of whole texts, token by token. Two caches, of tokens and of words
    without their punctuation, hold about ``cache`` bytes together."""

    def __init__(self, lm: np.ndarray, known: dict[str, int] | None = None,
                 cache: int = CACHE):
        self.size = cache
        self.held = 0
        self.table = Table(lm)
        self.known = known
        self.cache: dict[str, frozenset] = {}
        self.before: dict[str, frozenset] = {}
        self.words: dict[str, str] = {}

    def _hold(self, size: int) -> None:
        """Over half the bytes, the caches become the older ones, the oldest go."""
        self.held += size
        if self.held > self.size // 2:
            self.before, self.cache = self.cache, {}
            self.words = {}
            self.held = size

    def _once(self, core: str, table: list) -> str:
        """``_decoded``, once for a word whatever punctuation is around it."""
        got = self.words.get(core)
        if got is None:
            got = _decoded(core, table)
            self._hold(250 + 4 * len(core))
            self.words[core] = got
        return got

    def _plain(self, word: str) -> set[int]:
        """Numbers of the known features of a word of letters and of what it decodes to."""
        known, out = self.known, set()
        forms = (word,)
        if _DOUBLE.search(word):
            forms = (word, decode_letters(word, self.table))
        for w in forms:
            n = len(w)
            names = (w,) if n < 5 else (w, "^" + w[:4]) if n < 6 else (
                w, "^" + w[:4], "^" + w[:5]) if n < 7 else (
                w, "^" + w[:4], "^" + w[:5], "^" + w[:6])
            for x in names:
                if x in known:
                    out.add(known[x])
        return out

    def _features(self, observed: str, spaced: bool) -> frozenset:
        key = "\n" * spaced + observed  # a token holds no line break
        got = self.before.get(key)
        if got is None:
            got = self._found(observed, spaced)
        self._hold(200 + 4 * len(key) + (300 + 90 * len(got) if got else 0))
        self.cache[key] = got
        return got

    def _found(self, observed: str, spaced: bool) -> frozenset:
        inner = "" if spaced else observed.strip(_OUTER)
        if self.known is not None and inner.isalpha():  # both of its forms are one word
            found = self._plain(inner)
        else:
            forms = (run_forms if spaced else token_forms)(observed, self.table, self._once)
            found = set().union(*map(word_features, dict.fromkeys(forms)))
            if self.known is not None:
                found = {self.known[x] for x in found if x in self.known}
        return frozenset(found) if found else _NONE

    def features(self, text: str | None) -> set:
        low = (text or "").lower()
        out: set = set()
        for token in set(low.split()):
            found = self.cache.get(token)
            if found is None:
                found = self._features(token, False)
            if found:
                out |= found
        for m in _SPACED.finditer(low):
            found = self.cache.get("\n" + m[0])
            out |= self._features(m[0], True) if found is None else found
        return out


# ---------------------------------------------------------------- the operator

def training_rows(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame | None:
    """doc_id, text, toxic of a bounded sample of the labelled learning fold."""
    lab = (labels.select(F.col("doc_id").cast("long").alias("doc_id"),
                         F.col("toxic").cast("int").alias("toxic"))
           .filter("doc_id is not null and toxic is not null").filter(~C.held_out())
           .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    n = {r.toxic: r["count"] for r in lab.groupBy("toxic").count().collect()}
    picked = [lab.filter((F.col("toxic") == t) & C.in_fraction(
        F.col("doc_id"), C.bounded_fraction(c, per_class))).limit(2 * per_class)
        for t, c in sorted(n.items()) if t in (0, 1)]
    if not picked:
        return None
    chosen = picked[0] if len(picked) == 1 else picked[0].unionByName(picked[1])
    # At most four times per_class rows: bounded, so it may be broadcast.
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.col("text").cast("string").alias("text"))
            .join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic"))


def decision_point(logits: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the logits that part the learning rows with the best F1: the
    penalties draw weights towards zero, which alone would reject too little."""
    cuts = np.linspace(-3, 1, 41)
    hits = [(logits >= t) for t in cuts]
    f1 = np.array([2 * (h & (labels == 1)).sum() / max(1, h.sum() + (labels == 1).sum())
                   for h in hits])
    return float(cuts[f1 >= f1.max() - 0.002].mean()) if f1.max() > 0 else 0.0


def fit(rows: list, lm: np.ndarray) -> tuple[dict[str, int], np.ndarray, float | None]:
    """Feature numbers, their weights, and the intercept (None: nothing to learn)."""
    if not rows:
        return {}, np.zeros(0), None
    scorer = Scorer(lm)
    number: dict[str, int] = {}
    found = [np.array(sorted(number.setdefault(f, len(number)) for f in scorer.features(t)),
                      dtype=np.int32) for t, _ in rows]
    df = np.bincount(np.concatenate(found), minlength=len(number))
    names = {f: k for k, f in enumerate(sorted(f for f, i in number.items() if df[i] >= MIN_DOCS))}
    renumber = np.full(len(number) + 1, -1)
    renumber[[number[f] for f in names]] = list(names.values())
    del number
    examples = []
    for old, (_, y) in zip(found, rows):
        idx = renumber[old]
        idx = idx[idx >= 0]
        examples.append((idx, np.ones(len(idx)), np.array([float(y)])))
    model = Ftrl(len(names), 1, alpha=1.0, l1=3.0, l2=1.0).fit(examples, EPOCHS)
    w = model.weights()[:, 0]
    logits = np.array([w[i].sum() + w[model.bias] for i, _, _ in examples])
    w[model.bias] -= decision_point(logits, np.array([y for _, y in rows]))
    keep = [f for f, i in names.items() if w[i] != 0.0]
    return ({f: k for k, f in enumerate(keep)},
            np.array([w[names[f]] for f in keep]), float(w[model.bias]))


def _fit_task(lm: np.ndarray):
    """``fit`` in one task: its input is bounded, only weights leave it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b.column("text").to_pylist(),
                                                b.column("toxic").to_pylist())]
        names, w, bias = fit(rows, lm)
        if bias is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([*names, ""]), pa.array([*w.tolist(), bias])],
                names=["feature", "weight"])
    return run


def train(docs: DataFrame, labels: DataFrame, lm: np.ndarray, per_class: int,
          ) -> tuple[dict[str, int], np.ndarray, float | None]:
    rows = training_rows(docs, labels, per_class)
    if rows is None:
        return {}, np.zeros(0), None
    got = (rows.repartition(1).sortWithinPartitions("doc_id", "text")
           .mapInArrow(_fit_task(lm), "feature string, weight double").collect())
    weights = {r.feature: r.weight for r in got}
    bias = weights.pop("", None)
    return ({f: k for k, f in enumerate(weights)},
            np.array(list(weights.values()), dtype=np.float64), bias)


def _score(lm: np.ndarray, known: dict[str, int], w: np.ndarray, bias: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lm, known)
        weight = w.tolist()
        for b in C.slices(batches):
            out = []
            for t in b.column("text").to_pylist():
                if bias is None:
                    out.append(0.0)
                    continue
                x = bias + math.fsum(weight[i] for i in scorer.features(t))
                out.append(1 / (1 + math.exp(-max(-35.0, min(35.0, x)))))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(out, pa.float64()), b.column("row")],
                names=["doc_id", "score", "row"])
    return run


def scores(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None,
           per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, score and the struct ``row`` of the columns named in ``keep``."""
    C.text_session(docs.sparkSession)
    lm = language_model(docs)
    known, w, bias = train(docs, labels, lm, per_class)
    kept = F.struct(*[F.col(c) for c in keep]) if keep else F.lit(0)
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                     F.col("text").cast("string").alias("text"), kept.alias("row"))
    row_type = df.schema["row"].dataType.simpleString()
    return df.mapInArrow(_score(lm, known, w, bias), f"doc_id long, score double, row {row_type}")


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    out = scores(docs, labels, per_class=per_class)
    return out.select("doc_id", C.held_out().alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1(spark, sf_dir: str) -> DataFrame:
    return toxicity(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
