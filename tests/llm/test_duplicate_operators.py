"""Substring dedup, Jaccard join, decontamination, components."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from vitrine.llm import components, decontaminate, jaccard, substring

ODD = [(1, None), (2, ""), (3, " \t\n"), (None, "lonely"), (5, "same words here"),
       (5, "same words here"), (6, "x" * 50_000), (7, "again " * 3000)]


def norm(t):
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").lower())


def shingles(w):
    return [tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def corpus(seed, n=60):
    """Random texts with exact and near copies and shared passages."""
    rng = random.Random(seed)
    voc = [f"w{i}" for i in range(300)]
    passage = [rng.choice(voc) for _ in range(60)]
    out = []
    for i in range(n):
        w = [rng.choice(voc) for _ in range(rng.randrange(3, 160))]
        if i % 5 == 1 and out:
            w = out[rng.randrange(len(out))][1].split()
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = rng.choice(voc)
        if i % 7 == 2:
            a = rng.randrange(25)
            w[len(w) // 2:len(w) // 2] = passage[a:a + 35]
        out.append((i, " ".join(w)))
    return out


# ------------------------------------------------------------ substring dedup

def brute_cut(rows, window=35):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i:i + window]) for w in split for i in range(len(w) - window + 1))
    out = Counter()
    for (k, _), w in zip(rows, split):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[k, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("hot", [20_000, 1])
def test_substring_against_brute_force(docs, hot):
    period = " ".join(["a b c d e"] * 8)  # repeats itself within 40 words
    rows = corpus(1) + ODD + [(900, period), (901, "q " * 34), (902, "r " * 36)]
    got = substring.substring_dedup(docs(rows, extra=True), hot=hot).collect()
    assert Counter((None if r.no_id else r.id, r.n_words, r.n_removed, r.kept_sha256)
                   for r in got) == brute_cut(rows)


def test_a_window_met_very_often_is_split_for_the_join(spark, docs):
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        text = " ".join(f"w{i}" for i in range(35))
        marks = substring.repeated_windows(docs([(i, text) for i in range(4000)]), hot=100)
        assert len(marks.collect()) == 4000
        plan = marks._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    final = plan.split("Initial Plan")[0]
    assert any("skew=true" in x and "LeftSemi" in x for x in final.splitlines())


def test_substring_empty_table(docs):
    assert substring.substring_dedup(docs([])).count() == 0


def test_equal_windows_have_equal_blocks():
    rng = np.random.default_rng(2)
    w = rng.integers(0, 1 << 60, 400).astype(np.uint64)
    at = substring.window_blocks(w, 35, 12)
    moved = substring.window_blocks(np.concatenate([w[200:300], w[:200]]), 35, 12)
    assert (at[200:266] - 200 == moved[:66]).all()
    assert ((at >= np.arange(len(at))) & (at < np.arange(len(at)) + 24)).all()


# --------------------------------------------------------------- Jaccard join

def brute_links(rows):
    sets = [frozenset(shingles(norm(t))) for _, t in rows]
    links = [0] * len(rows)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                    links[i] += 1
                    links[j] += 1
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    classes = defaultdict(list)
    for i in range(len(rows)):
        classes[find(i)].append(rows[i][0])
    return Counter((rows[i][0], min(classes[find(i)]), links[i]) for i in range(len(rows)))


@pytest.mark.parametrize("block", [1000, 4])
def test_jaccard_against_brute_force(docs, block):
    base = corpus(5, 30)
    rng = random.Random(0)
    centre = [f"c{i}" for i in range(120)]
    near = []
    for i in range(12):  # one class of near copies, larger than a small block
        w = list(centre)
        w[rng.randrange(120)] = f"n{i}"
        near.append((100 + i, " ".join(w)))
    rows = base + near + [(200, "one two"), (201, "ONE, two"), (202, ""), (203, None), (204, "!"),
                          (205, base[3][1]), (206, base[3][1].upper())]
    got = jaccard.jaccard_classes(docs(rows, extra=True), block=block).collect()
    assert Counter((r.key, r.class_key, r.n_links) for r in got) == brute_links(rows)


def test_jaccard_odd_rows(docs):
    got = jaccard.jaccard_classes(docs(ODD)).collect()
    assert len(got) == len(ODD)
    assert [r.n_links for r in got if r.key == 5] == [1, 1]
    assert all(r.n_links == 0 and r.class_key == r.key for r in got if r.key != 5)
    assert jaccard.jaccard_classes(docs([])).count() == 0


def test_prefix_is_the_longest_that_reaches_the_recall():
    k = jaccard.prefix_length(0.8, 24, 10, 0.999)
    assert 1 - (1 - 0.8 ** k) ** 24 >= 0.999 > 1 - (1 - 0.8 ** (k + 1)) ** 24


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160))
                                                for _ in range(40)]
    got = {r.node: r.root for r in components.components(
        spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41))
    for u, v in edges:
        assert got.get(u, u) == got.get(v, v)
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# ------------------------------------------------------------ decontamination

def brute_contaminated(rows, items):
    out = {}
    for k, t in rows:
        w = norm(t)
        for i, x in items:
            b = norm(x)
            if not b or len(w) < len(b):
                continue
            want = Counter(shingles(b))
            for a in range(len(w) - len(b) + 1):
                have = Counter(shingles(w[a:a + len(b)]))
                s = sum((have & want).values()) / sum((have | want).values())
                if s >= 0.8:
                    out[k, i] = max(s, out.get((k, i), 0))
    return out


@pytest.mark.parametrize("group", [1000, 3])
def test_contamination_against_brute_force(spark, docs, group):
    rng = random.Random(4)
    voc = [f"v{i}" for i in range(200)]
    items = [(i, " ".join(rng.choice(voc) for _ in range(rng.choice([2, 5, 20, 45, 90]))))
             for i in range(12)] + [(50, ""), (51, None), (52, "a a a a a a a a a a a a")]
    rows = []
    for i in range(80):
        w = [rng.choice(voc) for _ in range(rng.randrange(120))]
        if i % 2:
            x = (items[i % 12][1]).split()
            if i % 4 == 1 and len(x) > 40:
                x[rng.randrange(2)] = "edited"
            w[len(w) // 2:len(w) // 2] = x
        rows.append((i, " ".join(w).title() if i % 3 else ", ".join(w)))
    rows += [(500, None), (501, ""), (502, "a " * 40), (None, items[4][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(docs(rows, extra=True), bench, group_items=group).collect()
    want = brute_contaminated(rows, items)
    assert {(r.doc_id, r.item_id): pytest.approx(r.similarity) for r in got} == want
    assert len(got) == len(want)


def brute_short(rows, items):
    """Every document shorter than an item is one window; nothing is left out."""
    out = {}
    for k, t in rows:
        w = norm(t)
        for i, x in items:
            b = norm(x)
            if w and len(w) < len(b):
                have, want = Counter(shingles(w)), Counter(shingles(b))
                s = sum((have & want).values()) / sum((have | want).values())
                if s >= 0.8:
                    out[k, i] = s
    return out


@pytest.mark.parametrize("group", [1000, 3])
def test_contamination_of_documents_shorter_than_the_item(spark, docs, group):
    rng = random.Random(6)
    voc = [f"v{i}" for i in range(200)]
    items = [(i, " ".join(rng.choice(voc) for _ in range(n)))
             for i, n in enumerate([3, 4, 5, 6, 9, 10, 11, 13, 20, 33, 60, 60])]
    items += [(50, "a a a a a a a a a a a a"), (51, "p q p q p q p q p")]
    rows = []
    for i, x in items:
        w = x.split()
        for a in range(4):
            for b in range(4):
                rows.append((len(rows), " ".join(w[a:len(w) - b])))
        odd = list(w[1:])
        odd[len(odd) // 2] = "edited"
        rows.append((len(rows), " ".join(odd)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(docs(rows), bench, group_items=group).collect()
    want = brute_contaminated(rows, items) | brute_short(rows, items)
    assert len(brute_short(rows, items)) > 40
    assert {(r.doc_id, r.item_id): pytest.approx(r.similarity) for r in got} == want
    assert len(got) == len(want)
    words = {k: len(norm(t)) for k, t in rows}
    for r in got:
        if (r.doc_id, r.item_id) in brute_short(rows, items):
            assert (r.start_word, r.n_words) == (0, words[r.doc_id])


def test_contamination_empty(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs([(1, "a b c")]), bench).count() == 0
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.contaminated(docs([]), bench).count() == 0


def test_index_returns_every_fingerprint_within_the_radius():
    rng = np.random.default_rng(1)
    bags = [rng.integers(0, 1 << 63, 30).astype(np.uint64) for _ in range(40)]
    index = decontaminate.ItemIndex(34, list(range(40)), bags, 0.8, 19)
    for i in range(40):
        for far in (0, 7, 19):
            bits = rng.choice(64, far, replace=False)
            fp = index.prints[i] ^ np.uint64(sum(1 << int(b) for b in bits))
            want = [j for j in range(40) if int(index.prints[j] ^ fp).bit_count() <= 19]
            assert index.candidates(fp, 19) == want


def test_substring_tells_rows_without_an_id_apart(spark, docs):
    """Texts whose 32-bit hashes are equal, without an id and under one id."""
    from pyspark.sql import functions as F

    from vitrine.llm import substring
    passage = " ".join(f"p{k}" for k in range(60))
    pair = (spark.range(250_000).select(F.concat(F.lit("w "), F.col("id").cast("string")).alias("t"))
            .groupBy(F.hash("t").alias("h")).agg(F.collect_list("t").alias("t"))
            .filter(F.size("t") > 1).orderBy("h").first().t[:2])
    texts = [f"{pair[0]} {passage} end of one", f"{pair[1]} two"]
    rows = [(None, texts[0]), (None, texts[1]), (None, pair[0]), (None, pair[1]), (7, pair[0]), (7, pair[1]),
            (8, passage), (None, None)] + [(None, f"x {passage}")] * 40
    got = {}
    for r in substring.substring_dedup(docs(rows)).collect():
        got.setdefault((None if r.no_id else r.id, r.kept_text), []).append(r.n_removed)
    assert len(pair) == 2 and got[None, pair[0]] == [0] and got[7, pair[1]] == [0]
    assert got[None, f"{pair[0]} end of one"] == [60] and got[None, texts[1]] == [0]
    assert got[8, ""] == [60] and got[None, ""] == [61] * 40 and got[None, None] == [0]
