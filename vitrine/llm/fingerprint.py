"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Paragraphs are the pieces of a text between line breaks and the ends of sentences and
clauses.
Each is hashed to a wide vector of 64 numbers of 8 bits; a document's fingerprint is
the sum of its paragraphs' vectors, lane by lane modulo 2**31 or 2**30, and the count
of paragraphs. So it does not depend on their order, and paragraphs are added to or
taken from a fingerprint by adding or subtracting theirs (``combine``, ``remove``).
As lanes are centred random numbers, the cosine of two fingerprints estimates that
of the two multisets of paragraphs: ``likeness``, 0 to 1.

Two lanes share one long, at bits 0..30 and 32..61, each with a guard bit above that
a mask clears after every sum. Everything is DataFrame functions; nothing leaves the
JVM.

The next document in descending doc_id order is found without one global sort: ids
are put in buckets of 256 consecutive numbers, a window within the bucket finds
the next row, and the last row of a bucket is joined with the first of the next
bucket below that is not empty. That bucket is found the same way among bucket
numbers, level by level, until one bucket holds them all.

Defined cases: NULL text is the empty text, which has no paragraphs; two documents
without paragraphs are alike (1), one without and one with are not (0); equal ids
are ordered by their text's hash; a NULL doc_id comes after all others; a lone
document follows itself; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

LONGS = 32  # two lanes each
BUCKET_BITS = 8
_PAIR = 0x000000FF000000FF
_KEEP = 0x3FFFFFFF7FFFFFFF
_LOW = 0x7FFFFFFF
#: Line breaks, and blanks after the end of a sentence or clause.
PARAGRAPH_END = r"[\n\r]+|(?<=[.!?,;:])\s+"


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, PARAGRAPH_END), lambda p: F.trim(p)), lambda p: p != "")


def _vector(h: Column) -> list[Column]:
    out = []
    for seed in range(LONGS // 4):
        x = F.xxhash64(h, F.lit(seed))
        out += [F.shiftrightunsigned(x, 8 * k).bitwiseAND(F.lit(_PAIR)) for k in range(4)]
    return out


def fingerprint(text: Column) -> Column:
    """array<long>: the count of paragraphs, then the packed lanes."""
    hashes = F.transform(paragraphs(text), lambda p: F.xxhash64(p))
    lanes = F.aggregate(
        hashes, F.array_repeat(F.lit(0).cast("long"), LONGS),
        lambda acc, h: F.zip_with(acc, F.array(*_vector(h)),
                                  lambda a, b: (a + b).bitwiseAND(F.lit(_KEEP))))
    return F.concat(F.array(F.size(hashes).cast("long")), lanes)


def combine(a: Column, b: Column) -> Column:
    """The fingerprint of both documents' paragraphs together."""
    lanes = F.zip_with(F.slice(a, 2, LONGS), F.slice(b, 2, LONGS),
                       lambda x, y: (x + y).bitwiseAND(F.lit(_KEEP)))
    return F.concat(F.array(a[0] + b[0]), lanes)


def remove(a: Column, b: Column) -> Column:
    """The fingerprint of ``a`` without the paragraphs of ``b``."""
    guards = F.lit(~_KEEP & ((1 << 63) - 1))  # borrow from the guard bits
    lanes = F.zip_with(F.slice(a, 2, LONGS), F.slice(b, 2, LONGS),
                       lambda x, y: (x.bitwiseOR(guards) - y).bitwiseAND(F.lit(_KEEP)))
    return F.concat(F.array(a[0] - b[0]), lanes)


def text_form(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def _centred(fp: Column) -> Column:
    """array<double> of the 64 lanes less their expectation."""
    mean = fp[0] * F.lit(127.5)
    low = F.transform(F.slice(fp, 2, LONGS),
                      lambda x: x.bitwiseAND(F.lit(_LOW)).cast("double") - mean)
    high = F.transform(F.slice(fp, 2, LONGS),
                       lambda x: F.shiftrightunsigned(x, 32).cast("double") - mean)
    return F.concat(low, high)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def likeness(a: Column, b: Column, ca: Column, cb: Column) -> Column:
    """0 to 1 from two fingerprints and their centred lanes."""
    cosine = _dot(ca, cb) / F.sqrt(_dot(ca, ca) * _dot(cb, cb))
    return (F.when(a == b, F.lit(1.0)).when((a[0] == 0) | (b[0] == 0), F.lit(0.0))
            .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine))))


def lower_neighbours(values: DataFrame, low: int, high: int) -> DataFrame:
    """v, below: the next smaller value of a table of distinct longs ``v`` within
    low..high; the smallest one gets NULL."""
    bits = BUCKET_BITS
    # Shifting never joins -1 and 0: those two groups are one, of bounded size.
    last = (low >> bits, high >> bits) in ((-1, 0), (low >> bits, low >> bits))
    group = F.lit(0).cast("long") if last else F.shiftright("v", bits)
    w = Window.partitionBy("g").orderBy("v")
    inside = values.withColumn("g", group).withColumn("below", F.lag("v").over(w))
    if last:
        return inside.select("v", "below")
    tops = values.groupBy(group.alias("g")).agg(F.max("v").alias("top"))
    down = lower_neighbours(tops.select(F.col("g").alias("v")), low >> bits, high >> bits)
    other = (down.join(tops.withColumnRenamed("g", "below"), "below")
             .select(F.col("v").alias("g"), "top"))
    return (inside.join(other, "g", "left")
            .select("v", F.coalesce("below", "top").alias("below")))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` (id, th and others) with a struct ``next`` of the columns of the next
    row in descending id order, the first row after the last."""
    rows = docs.withColumn("bucket", F.shiftright("id", BUCKET_BITS))
    ends = rows.agg(F.min("bucket").alias("low"), F.max("bucket").alias("high")).first()
    if ends.low is None:
        ends = (0, 0)
    low, high = ends
    w = Window.partitionBy("bucket").orderBy(F.desc("id"), F.desc("th"))
    inside = (rows.withColumn("next", F.lead(F.struct(*columns)).over(w))
              .withColumn("place", F.row_number().over(w)))
    heads = inside.filter("place = 1").select(
        F.col("bucket").alias("below"), F.struct(*columns).alias("head"))
    buckets = rows.select(F.col("bucket").alias("v")).distinct()
    down = lower_neighbours(buckets, low, high).select(
        F.col("v").alias("bucket"), F.coalesce("below", F.lit(high)).alias("below"))
    after = down.join(heads, "below").select("bucket", "head")
    return (inside.join(after, "bucket", "left")
            .withColumn("next", F.coalesce("next", "head")).drop("bucket", "place", "head"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """The columns of the contract for every row of ``docs``."""
    own = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(C.NULL_ID)).alias("id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).withColumn("th", F.xxhash64("text"))
    after = with_next(own, ["text"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = (after.withColumn("half", half)
              .withColumn("n", F.length("text"))
              .withColumn("edited", F.concat(
                  F.expr("left(text, n - half)"), F.expr("left(next.text, half)")))
              .withColumn("fp", fingerprint(F.col("text")))
              .withColumn("efp", fingerprint(F.col("edited")))
              .withColumn("nfp", fingerprint(F.col("next.text"))))
    done = edited.select(
        "id", F.col("n").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"), "fp", "efp", "nfp",
        _centred(F.col("fp")).alias("c"), _centred(F.col("efp")).alias("ec"),
        _centred(F.col("nfp")).alias("nc"))
    col = F.col
    return done.select(
        F.when(col("id") != C.NULL_ID, col("id")).alias("doc_id"), "n_chars", "edited_sha256",
        text_form(col("fp")).alias("fingerprint"),
        text_form(col("efp")).alias("edited_fingerprint"),
        likeness(col("fp"), col("efp"), col("c"), col("ec")).alias("near_edited"),
        likeness(col("fp"), col("nfp"), col("c"), col("nc")).alias("near_next"))


def op3(spark, sf_dir: str) -> DataFrame:
    return fingerprints(C.table(spark, sf_dir, "documents"))
