"""N-gram Jaccard join by a MinHash LSH forest.

Two documents are linked when the Jaccard similarity of their sets of five-word
shingles (lower-cased words; a text of one to four words is one shingle) is at
least 0.8.

1. Documents with equal shingle sets form a class of copies, found by a 128-bit
   hash of the set; only its representative (smallest id) goes on.
2. Forest: ``trees`` labels of ``depth`` MinHash values each. The labels of a tree
   are sorted (range partitioning over tree, label and id, so that equal labels
   spread over tasks), which lays its prefix trie out in order: the matched prefix
   of two documents is the shortest common prefix between neighbours on the way.
3. Prefixes are shortened from ``depth`` until a pair just at the threshold is met
   in some tree with the probability ``recall``: 1 - (1 - s**k)**trees >= recall
   fixes k, the shortest prefix that still has to be followed. It is solved once from
   these constants (k = 6 as they stand) and never adapts to the data, so the forest
   amounts to ``trees`` bands of k values. Each run of
   documents that share k values is linked to its first one, a run cut by a
   partition boundary also through its prefix: never more than one edge for each
   document and tree.
4. Components of these edges hold every candidate pair. The texts of those with two
   members or more are gathered by component and *all* pairs in one are verified
   exactly on the shingles, so chance in the forest can add work but no wrong
   link. A component of over ``block`` members is cut into blocks, and each pair of
   blocks is verified in a task of its own. The counts of links leave the tasks
   summed per document, and the links as a spanning forest: no pair is ever a row.
5. Components of the verified links give the classes.

Output, one row per document: its key (the doc_id), class_key (smallest key of its
class of linked documents), copy_key (smallest key with the same shingle set),
n_links (other documents at 0.8 or more, copies included).

Defined cases: a text without words (NULL, empty) has no shingles and is a class
of its own with no links; repeated rows with one id are one document for classes,
each row is a copy in the counts, and each returns its row; texts that differ under
one id share its class; a NULL doc_id gets a negative key made from its text; other
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components

SIMILARITY = 0.8
SHINGLE = 5
TREES = 24
DEPTH = 10
RECALL = 0.999
BLOCK = 1000
#: Fixed seed of the MinHash functions.
SEED = 20_011


def prefix_length(s: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix at which a pair at similarity ``s`` is met in some tree
    with probability ``recall``, shortening from ``depth``."""
    for k in range(depth, 0, -1):
        if 1 - (1 - s ** k) ** trees >= recall:
            return k
    raise ValueError("too few trees for this recall")


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    words, first = C.hashed_words(texts, True)
    return [np.unique(C.shingles(words[first[i]:first[i + 1]], n)) for i in range(len(texts))]


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """Order-free 128-bit hash of a set of shingle hashes."""
    a = int(C.mix(s).sum(dtype=np.uint64)) ^ len(s)
    b = int(C.mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64))
    return a - (a >> 63 << 64), b - (b >> 63 << 64)


def _signatures(n: int, values: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(SEED)
        a = (rng.integers(0, 1 << 32, values, dtype=np.uint64).astype(np.uint32) | np.uint32(1))
        b = rng.integers(0, 1 << 32, values, dtype=np.uint64).astype(np.uint32)
        for batch in C.slices(batches):
            h1, h2, sigs = [], [], []
            for s in shingle_sets(batch.column("text").to_pylist(), n):
                x, y = set_hash(s)
                h1.append(x)
                h2.append(y)
                if not len(s):
                    sigs.append(None)
                    continue
                low = np.full(values, 0xFFFFFFFF, dtype=np.uint32)
                h = (s >> np.uint64(32)).astype(np.uint32)
                for at in range(0, len(h), 512):  # the working set stays in cache
                    part = a[:, None] * h[None, at:at + 512] + b[:, None]
                    part ^= part >> np.uint32(15)
                    part *= np.uint32(0x2C1B3C6D)
                    np.minimum(low, part.min(axis=1), out=low)
                sigs.append((low & np.uint32(0xFFFF)).astype(">u2").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
                 pa.array(sigs, pa.binary())], names=["id", "h1", "h2", "sig"])
    return run


def _trie_edges(k: int):
    """Edges of the runs of sorted labels that share k values (2 bytes each)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None  # (tree, prefix) and first id of the open run
        root = None
        for b in batches:
            if not b.num_rows:
                continue
            tree = b.column("tree").to_pylist()
            label = b.column("label").to_pylist()
            ids = b.column("id").to_pylist()
            kind, us, vs, trees, prefixes = [], [], [], [], []
            for t, x, i in zip(tree, label, ids):
                key = (t, x[:2 * k])
                if key != head:
                    # A run may begin before this partition or go on after it: its
                    # first document also stands for the prefix as a whole.
                    if head is None:
                        kind.append(1), us.append(i), vs.append(i)
                        trees.append(t), prefixes.append(key[1])
                    head, root = key, i
                elif i != root:
                    kind.append(0), us.append(i), vs.append(root)
                    trees.append(t), prefixes.append(None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind, pa.int32()), pa.array(us, pa.int64()), pa.array(vs, pa.int64()),
                 pa.array(trees, pa.int32()), pa.array(prefixes, pa.binary())],
                names=["kind", "u", "v", "tree", "prefix"])
        if head is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([1], pa.int32()), pa.array([root], pa.int64()),
                 pa.array([root], pa.int64()), pa.array([head[0]], pa.int32()),
                 pa.array([head[1]], pa.binary())],
                names=["kind", "u", "v", "tree", "prefix"])
    return run


def candidate_edges(reps: DataFrame, trees: int, depth: int, k: int) -> DataFrame:
    """(u, v) edges whose components hold all candidate pairs of ``id, sig``."""
    n = C.partitions(reps.sparkSession)
    labels = (reps.select("id", F.posexplode(F.expr(
        f"transform(sequence(0, {trees - 1}), t -> substring(sig, t * {2 * depth} + 1, {2 * depth}))"))
        .alias("tree", "label")).checkpoint())  # sampled for the ranges, then sorted
    ordered = (labels.repartitionByRange(n, "tree", "label", "id")
               .sortWithinPartitions("tree", "label", "id"))
    found = ordered.select("tree", "label", "id").mapInArrow(
        _trie_edges(k), "kind int, u long, v long, tree int, prefix binary").checkpoint()
    # At most two rows for each partition.
    ends = found.filter("kind = 1").select("tree", "prefix", F.col("u").alias("id"))
    first = ends.groupBy("tree", "prefix").agg(F.min("id").alias("v"))
    across = ends.join(first, ["tree", "prefix"]).select(F.col("id").alias("u"), "v")
    return found.filter("kind = 0").select("u", "v").unionByName(across).filter("u <> v")


def pair_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of a bounded list of sets."""
    n = len(sets)
    counts = np.zeros((n, n), dtype=np.float32)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    u, inv, df = np.unique(flat, return_inverse=True, return_counts=True)
    shared = df[inv] > 1
    col = np.cumsum(df > 1)[inv[shared]] - 1
    row = owner[shared]
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    width = max(64, min(4096, 8_000_000 // n))
    for at in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        lo, hi = np.searchsorted(col, at), np.searchsorted(col, at + width)
        m = np.zeros((n, width), dtype=np.float32)
        m[row[lo:hi], col[lo:hi] - at] = 1
        counts += m @ m.T
    return counts


def _verify(n: int, s: float):
    """Links of each group (comp, a, b): blocks a and b of one component."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in C.runs(batches, ["comp", "a", "b"], rows=512):
            d = {c: t.column(c).to_numpy(zero_copy_only=False)
                 for c in ("comp", "a", "b", "side", "id", "copies")}
            texts = t.column("text").to_pylist()
            cut = np.flatnonzero(np.r_[True, (np.diff(d["comp"]) != 0) | (np.diff(d["a"]) != 0)
                                       | (np.diff(d["b"]) != 0), True])
            us, vs, links = [], [], []
            for lo, hi in zip(cut[:-1], cut[1:]):
                sets = shingle_sets(texts[lo:hi], n)
                size = np.array([len(x) for x in sets], dtype=np.float64)
                inter = pair_counts(sets)
                union = size[:, None] + size[None, :] - inter
                with np.errstate(invalid="ignore", divide="ignore"):
                    link = inter >= s * union - 1e-6
                side = d["side"][lo:hi]
                if d["a"][lo] != d["b"][lo]:
                    link &= side[:, None] != side[None, :]
                np.fill_diagonal(link, False)
                near = link @ d["copies"][lo:hi].astype(np.float64)
                ids = d["id"][lo:hi]
                root = np.full(hi - lo, -1)
                for i in range(hi - lo):  # spanning forest by breadth-first search
                    if root[i] < 0:
                        root[i], front = i, np.array([i])
                        while len(front):
                            front = np.flatnonzero(link[front].any(axis=0) & (root < 0))
                            root[front] = i
                us.append(ids)
                vs.append(ids[root])
                links.append(near)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(us)), pa.array(np.concatenate(vs)),
                 pa.array(np.concatenate(links).astype(np.int64))], names=["u", "v", "links"])
    return run


def jaccard_classes(docs: DataFrame, s: float = SIMILARITY, shingle: int = SHINGLE,
                    trees: int = TREES, depth: int = DEPTH, recall: float = RECALL,
                    block: int = BLOCK) -> DataFrame:
    """key, class_key, copy_key, n_links for every row of ``docs``; keys are
    ``common.row_key``."""
    spark = docs.sparkSession
    C.text_session(spark)
    n = C.partitions(spark)
    k = prefix_length(s, trees, depth, recall)
    keyed = docs.select(C.row_key().alias("id"), F.col("text").cast("string").alias("text"))
    signed = keyed.mapInArrow(_signatures(shingle, trees * depth),
                              "id long, h1 long, h2 long, sig binary").checkpoint()
    copies = (signed.filter("sig is not null").groupBy("h1", "h2")
              .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"),
                   F.min("sig").alias("sig")).checkpoint())
    # Two texts under one id can both be the smallest of a class of copies; the
    # trie, the components and the check then hold that id once for each.
    cand = components(candidate_edges(copies.select("id", "sig"), trees, depth, k))
    roots = cand.select("root").distinct().select(F.col("root").alias("node"), "root")
    member = cand.unionByName(roots).select(F.col("node").alias("id"), F.col("root").alias("comp"))
    sized = member.join(
        member.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("nb")), "comp")
    # One row for each member and pair of blocks that it belongs to.
    dealt = (sized.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("nb")))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
             .select("id", "comp", F.least("mine", "other").alias("a"),
                     F.greatest("mine", "other").alias("b"), F.col("mine").alias("side")))
    reps = copies.join(member.select("id"), "id", "left_semi").select("id", "h1", "h2", "copies")
    # The text of a representative: one of its rows with that very shingle set.
    texts = (keyed.join(reps.select("id").distinct(), "id", "left_semi").distinct()
             .mapInArrow(_with_hash(shingle), "id long, text string, h1 long, h2 long")
             .join(reps, ["id", "h1", "h2"]).groupBy("id", "h1", "h2", "copies")
             .agg(F.min("text").alias("text")))
    groups = (texts.join(dealt, "id")
              .select("comp", "a", "b", "side", "id", "copies", "text")
              .repartition(n, "comp", "a", "b").sortWithinPartitions("comp", "a", "b"))
    verified = groups.mapInArrow(_verify(shingle, s), "u long, v long, links long").checkpoint()
    links = verified.groupBy("u").agg(F.sum("links").alias("links"))
    classes = components(verified.select("u", "v")).withColumnRenamed("root", "class")
    per_copy = (copies.select("h1", "h2", "copies", F.col("id").alias("rep"))
                .join(links, F.col("rep") == F.col("u"), "left")
                .join(classes, F.col("rep") == F.col("node"), "left")
                .select("h1", "h2", "rep", F.coalesce("class", "rep").alias("class"),
                        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    back = signed.select("id", "h1", "h2", F.col("sig").isNotNull().alias("has"))
    out = (back.filter("has").join(per_copy, ["h1", "h2"])
           .select("id", "class", "rep", "n_links")
           .unionByName(back.filter("not has").select(
               "id", F.col("id").alias("class"), F.col("id").alias("rep"),
               F.lit(0).cast("long").alias("n_links"))))
    return out.select(F.col("id").alias("key"), F.col("class").alias("class_key"),
                      F.col("rep").alias("copy_key"), "n_links")


def _with_hash(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches):
            h = [set_hash(x) for x in shingle_sets(b.column("text").to_pylist(), n)]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("text"), pa.array([x for x, _ in h], pa.int64()),
                 pa.array([y for _, y in h], pa.int64())], names=["id", "text", "h1", "h2"])
    return run


def op6(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    out = jaccard_classes(docs)
    # The ids of the table are numbers: keys are doc_ids.
    return out.select(F.col("key").alias("doc_id"), F.col("class_key").alias("class_id"),
                      F.col("copy_key").alias("copy_of"), "n_links")
