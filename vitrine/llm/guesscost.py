"""Secret scan with password guess costs.

Base spans are found by three patterns: assignments (a key word, a separator, a value),
access key ids and long hexadecimal runs. The method adds spans of kind ``guess``: values
in a credential context (after a word such as password, secret, login or bearer, or as the
password in an address user:password@host) that are dear to guess. Words of prose and
weak placeholders in such places are cheap and stay unreported.

The guess cost of a value, in bits, is that of its cheapest segmentation into spans, found
by dynamic programming over its characters:

* a word of 3 to 24 letters: log2(all words / its occurrences) in the documents, credential
  values left out, and bits for its capitals and for digits or signs that stand for letters;
* a date: a year, or day, month and year in any of the usual orders and separators;
* a repeat: a block of 1 to 8 characters and how often it comes again;
* a keyboard walk: three and more neighbours on the keyboard;
* brute force: the bits of each character's class.

Each span costs SEGMENT bits beside its own. Repeats and walks are the longest ones from
where they start.

Word counts cover all documents. They meet the values in a join on the letter runs that
the values hold, so no dictionary is sent to the workers, and a value is priced once
however often it occurs.

Defined cases: NULL and empty texts have no spans; repeated rows, equal and NULL ids are
reported each (rows are told apart by a number of their own); other columns are not read;
an empty table gives no rows. Texts and values are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LEAST_BITS = 48.0
LEAST_CHARS = 8
SEGMENT = math.log2(5)  # which of five kinds comes next
WORD_CHARS = (3, 24)
MOST_PERIOD = 8
SALTS = 16
#: Distinct words held by a task before it hands on their counts.
HELD_WORDS = 400_000

# The base patterns; letters of the key words stand for either case.
KINDS = ("assign", "access", "hex", "guess")
_ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
    r"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?"""
    r"""([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")

# Words that announce a credential, and what may stand before its value.
_STEMS = ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "credential", "login",
          "://")
_CONTEXT = re.compile(
    r"""(?<![a-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|auth)"""
    r"""[_-]?key|auth(?:orization|[_-]?token)?|bearer|credentials?|login)["']?"""
    r"""(?:[ \t]*(?:=>|->|[:=])[ \t]*(?:(?:basic|bearer)[ \t]+)?|[ \t]+(?:is|was)[ \t]+|([ \t]+))"""
    r"""["'`]?([^\s"'`<>]+)""", re.I | re.A)
_ADDRESS = re.compile(r"[a-z][a-z0-9+.-]*://[^\s/:@]*:([^\s/@]+)@", re.I | re.A)
_TRAILING = ".,;:!?)]}"
_DIGIT = re.compile(r"\d")

# Keyboard rows as they stand above each other, and look-alike signs.
_ROWS = ("`1234567890-=", " qwertyuiop[]\\", " asdfghjkl;'", " zxcvbnm,./")
_SHIFTED = dict(zip('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./"))
_LEET = {"0": "o", "1": "l", "!": "i", "3": "e", "4": "a", "@": "a", "5": "s", "$": "s",
         "7": "t", "+": "t", "8": "b", "9": "g"}
_DATE = re.compile(
    r"(?=((?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\2(?:3[01]|[12]\d|0?[1-9])))?"
    r"(?=((?:3[01]|[12]\d|0?[1-9])([-/._]?)(?:0?[1-9]|1[0-2])\4(?:(?:19|20)\d\d|\d\d)))?"
    r"(?=((?:0?[1-9]|1[0-2])([-/._]?)(?:3[01]|[12]\d|0?[1-9])\6(?:(?:19|20)\d\d|\d\d)))?"
    r"(?=((?:19|20)\d\d))?")
_LETTERS = re.compile(r"[^\W\d_]+")

Span = tuple[int, int, int]  # start, kind, end


# ----------------------------------------------------------------- base spans

def base_spans(text: str) -> list[Span]:
    """Spans of the three base kinds, by start, then kind."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def credentials(text: str) -> list[tuple[int, int]]:
    """Start and end of each value in a credential context, in order, not overlapping."""
    low = text.lower()
    if not any(s in low for s in _STEMS):
        return []
    found = []
    for pattern in (_CONTEXT, _ADDRESS):
        for m in pattern.finditer(text):
            value = m[m.lastindex].rstrip(_TRAILING)
            # After a key word and nothing but blanks, prose goes on unless a digit comes.
            bare = pattern is _CONTEXT and m[1] is not None
            if len(value) >= LEAST_CHARS and not (bare and not _DIGIT.search(value)):
                found.append((m.start(m.lastindex), m.start(m.lastindex) + len(value)))
    out: list[tuple[int, int]] = []
    for s, e in sorted(found):
        if not out or s >= out[-1][1]:
            out.append((s, e))
    return out


# ----------------------------------------------------------------- guess costs

_AT = {c: (y, x) for y, row in enumerate(_ROWS) for x, c in enumerate(row) if c != " "}
#: A key touches its left and right neighbours and two keys in each row beside it.
_TOUCH = {(0, 1), (0, -1), (1, 0), (1, -1), (-1, 0), (-1, 1)}
_NEAR = {c: {d for d, (v, u) in _AT.items() if (v - y, u - x) in _TOUCH}
         for c, (y, x) in _AT.items()}
_KEYS = math.log2(len(_NEAR))
_TURN = math.log2(sum(map(len, _NEAR.values())) / len(_NEAR))


def char_bits(c: str) -> float:
    if c.isdigit():
        return math.log2(10)
    if "a" <= c <= "z" or "A" <= c <= "Z":
        return math.log2(26)
    return math.log2(33) if c < "\x7f" else math.log2(100)


def plain_letters(value: str) -> str:
    """Lower-cased, look-alike signs as their letters; as long as ``value``."""
    return "".join(_LEET.get(c, x if len(x := c.lower()) == 1 else c) for c in value)


def letter_runs(value: str) -> set[str]:
    """Every run of 3 to 24 letters of ``plain_letters``: the words it may hold."""
    low, (least, most) = plain_letters(value), WORD_CHARS
    return {low[i:j] for m in _LETTERS.finditer(low) for i in range(m.start(), m.end())
            for j in range(i + least, min(i + most, m.end()) + 1)}


def word_bits(written_as: str, count: int, total: int) -> float:
    """log2 of the guesses for a word with its capitals and look-alike signs."""
    bits = math.log2(total / count) if count < total else 0.0
    upper = sum(c.isupper() for c in written_as)
    if upper == len(written_as) or upper == 1 and written_as[0].isupper():
        bits += 1
    elif upper:
        bits += math.log2(sum(math.comb(len(written_as), k) for k in range(1, upper + 1)))
    return bits + sum(c in _LEET for c in written_as)


def walk_bits(length: int, turns: int, shifted: int) -> float:
    """A first key, a length, a direction for each straight part, and the shift key."""
    return (_KEYS + math.log2(length) + (turns + 1) * _TURN
            + (0 if not shifted else 1 if shifted == length else 2))


def _step(a: str, b: str) -> tuple[int, int]:
    (y, x), (v, u) = _AT[a], _AT[b]
    return v - y, u - x


def spans_from(value: str, words: dict[str, int], total: int) -> list[list[tuple[int, float]]]:
    """For each start the ends and bits of its words, dates, repeats and walks."""
    n = len(value)
    out: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    bits = [char_bits(c) for c in value]
    low, (least, most) = plain_letters(value), WORD_CHARS
    for i in range(n):
        for j in range(i + least, min(n, i + most) + 1):
            count = words.get(low[i:j])
            if count:
                out[i].append((j, word_bits(value[i:j], count, total)))
        if value[i].isdigit() and value[i].isascii():
            m = _DATE.match(value, i)
            for whole, sep in ((1, 2), (3, 4), (5, 6)):
                if m[whole]:
                    out[i].append((i + len(m[whole]),
                                   math.log2(366 * 130) + (2 if m[sep] else 0)))
            if m[7]:
                out[i].append((i + 4, math.log2(130)))
    for p in range(1, MOST_PERIOD + 1):
        same = 0  # characters from i on that are equal to those p later
        for i in range(n - p - 1, -1, -1):
            same = same + 1 if value[i] == value[i + p] else 0
            times = same // p + 1
            if times >= 2 and p * times >= 3:
                out[i].append((i + p * times, sum(bits[i:i + p]) + math.log2(times)))
    keys = "".join(_SHIFTED.get(c, c.lower() if c.isascii() else " ") for c in value)
    end, turns, shifted = n, 0, 0
    for i in range(n - 1, -1, -1):
        if i + 1 < n and keys[i + 1] not in _NEAR.get(keys[i], ()):
            end, turns, shifted = i + 1, 0, 0
        elif i + 2 < end:
            turns += _step(keys[i], keys[i + 1]) != _step(keys[i + 1], keys[i + 2])
        shifted += value[i] != keys[i]
        if end - i >= 3:
            out[i].append((end, walk_bits(end - i, turns, shifted)))
    return out


def guess_bits(value: str, words: dict[str, int], total: int) -> float:
    """Bits of the cheapest segmentation."""
    n = len(value)
    best = [0.0] + [math.inf] * n
    brute = math.inf  # cheapest start of a brute-force span, less the bits before it
    before = 0.0
    spans = spans_from(value, words, total)
    for i in range(n):
        brute = min(brute, best[i] - before)
        before += char_bits(value[i])
        best[i + 1] = min(best[i + 1], brute + before + SEGMENT)
        for j, bits in spans[i]:
            best[j] = min(best[j], best[i] + bits + SEGMENT)
    return best[n]


# ---------------------------------------------------------------- the operator

def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
    spans = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    for b in C.slices(batches):
        texts = [t or "" for t in b.column("text").to_pylist()]
        base = [base_spans(t) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"),
             pa.array([[{"start": s, "kind": k, "end": e} for s, k, e in x] for x in base], spans),
             pa.array([[{"start": s, "end": e, "value": t[s:e]} for s, e in credentials(t)]
                       for t in texts], at)],
            names=["doc_id", "base", "cred"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    least, most = WORD_CHARS
    held: Counter[str] = Counter()

    def counted() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
            names=["word", "n"])

    for b in C.slices(batches):
        for t in b.column("text").to_pylist():
            if not t:
                continue
            last, parts = 0, []
            for s, e in credentials(t):
                parts.append(t[last:s])
                last = e
            held.update(_LETTERS.findall(" ".join([*parts, t[last:]]).lower()))
            if len(held) > HELD_WORDS:
                yield counted()
                held.clear()
    if held:
        yield counted()


def _letter_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for v in b.column("value").to_pylist():
            runs = sorted(letter_runs(v))
            for k in range(0, len(runs), 50_000):
                part = runs[k:k + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v] * len(part), pa.string()), pa.array(part, pa.string())],
                    names=["value", "word"])


def _price(total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = [guess_bits(v, {w["word"]: w["n"] for w in ws or ()}, total)
                    for v, ws in zip(b.column("value").to_pylist(), b.column("words").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("value"), pa.array(bits, pa.float64())],
                                             names=["value", "bits"])
    return run


def priced(values: DataFrame, words: DataFrame) -> DataFrame:
    """value, bits for a table of distinct values and one of word, n (all words)."""
    total = words.agg(F.sum("n").alias("n")).first().n or 1
    runs = values.mapInArrow(_letter_runs, "value string, word string")
    held = (runs.join(words.hint("merge"), "word").groupBy("value")
            .agg(F.collect_list(F.struct("word", "n")).alias("words")))
    return (values.join(held.hint("merge"), "value", "left")
            .mapInArrow(_price(total), "value string, bits double"))


def secret_spans(docs: DataFrame, least_bits: float = LEAST_BITS) -> DataFrame:
    """doc_id, ``base`` and ``spans`` (arrays of start, kind number, end; by start, then
    kind) for every row of ``docs``. ``spans`` holds the base spans and those values in a
    credential context whose guess cost reaches ``least_bits``."""
    C.text_session(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                      F.col("text").cast("string").alias("text"))
    found = (own.mapInArrow(
        _scan, "doc_id long, base array<struct<start:long,kind:int,end:long>>, "
               "cred array<struct<start:long,end:long,value:string>>")
        .withColumn("row", F.monotonically_increasing_id()).checkpoint())
    words = (own.mapInArrow(_count_words, "word string, n long").groupBy("word")
             .agg(F.sum("n").alias("n")).checkpoint())
    cred = found.filter(F.size("cred") > 0).select("row", F.explode("cred").alias("c")).select(
        "row", "c.start", "c.end", "c.value")
    values = cred.select("value").distinct()
    dear = priced(values, words).filter(F.col("bits") >= least_bits)
    # One value may have many of the rows: both sides of the join are salted.
    dear = dear.select("value", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    # The joins name their kind: what comes of a table of values grows with the documents.
    guesses = (cred.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
               .join(dear.hint("merge"), ["value", "salt"])
               .groupBy("row").agg(F.collect_list(F.struct(
                   "start", F.lit(KINDS.index("guess")).alias("kind"), "end")).alias("more")))
    return (found.filter(F.size("cred") > 0).join(guesses.hint("merge"), "row", "left")
            .select("doc_id", "base", F.array_sort(F.concat(
                "base", F.coalesce("more", F.slice("base", 1, 0)))).alias("spans"))
            .unionByName(found.filter(F.size("cred") == 0)
                         .select("doc_id", "base", F.col("base").alias("spans"))))


def op12(spark, sf_dir: str) -> DataFrame:
    found = secret_spans(C.table(spark, sf_dir, "documents"))

    def joined(spans: str):
        name = F.array(*[F.lit(k) for k in KINDS])
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", F.element_at(name, s["kind"] + 1), s["start"], s["end"])), ",")

    def count(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"),
                        count(2).alias("n_hex"), F.sha2(joined("base"), 256).alias("base_sha256"),
                        joined("spans").alias("spans"))
