"""Toxicity, language id, fingerprints, language-model scores."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.llm import fingerprint, language, lmscore, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "  \n "), (None, "a text without an id"), (None, None),
       (5, "same"), (5, "same"), (6, "é" * 30_000), (7, "word " * 20_000), (-8, "!!! 12 ...")]


# ------------------------------------------------------------------ toxicity

@pytest.fixture(scope="module")
def lm(spark):
    return toxicity.language_model(spark.read.parquet(f"{SF}/documents.parquet"))


@pytest.mark.parametrize("seen, meant", [
    ("1d10t", "idiot"), ("m0r0n", "moron"), ("stuuuupid", "stupid"), ("l o s e r", "loser"),
    ("tr@sh", "trash"), ("$cum", "scum")])
def test_deobfuscation(lm, seen, meant):
    got = toxicity.viterbi(seen, lm) if " " in seen else toxicity.restore_token(seen, lm.tolist())
    assert got == meant


def test_viterbi_is_the_best_path(lm):
    """Against every path of small lattices."""
    import itertools

    for seen in ("1d0", "a.b.c", "s33n", "xx1xxx"):
        best = -math.inf
        for path in itertools.product(*toxicity.lattice(seen)):
            a, b, score = toxicity.BLANK, toxicity.BLANK, 0.0
            for text, cost in path:
                score += cost
                for c in text:
                    s = toxicity._symbol(c)
                    score += lm[a, b, s]
                    a, b = b, s
            best = max(best, score + lm[a, b, toxicity.BLANK])
        got = toxicity.viterbi(seen, lm)
        again = -math.inf
        for path in itertools.product(*toxicity.lattice(seen)):
            if "".join(t for t, _ in path) != got:
                continue
            a, b, score = toxicity.BLANK, toxicity.BLANK, 0.0
            for text, cost in path:
                score += cost
                for c in text:
                    s = toxicity._symbol(c)
                    score += lm[a, b, s]
                    a, b = b, s
            again = max(again, score + lm[a, b, toxicity.BLANK])
        assert again == pytest.approx(best)


def test_plain_words_stay(lm):
    for w in ("hello", "wood", "été", "don't", "end."):
        assert toxicity.restore_token(w, lm.tolist()) == w


@pytest.mark.parametrize("sentence, meant", [
    ("what a s c u m.", "scum"), ("you $ t u p ! d, man", "stupid"), ("an i d i o t, really", "idiot"),
    ("you m o r o n!", "moron"), ('so "s t u p i d" it is', "stupid"), ("l  o \t s\ne r", "loser"),
    ("f o o l", "fool"), ("'s c u m'", "scum"), ("s . c . u . m", "scum"), ("s c u", "scu"),
    ("s t u p p i d", "stupid"), ("what a n i d i o t.", "idiot"), ("i a m a f o o l.", "fool"),
    ("you !diot", "idiot"), ("that (lown", "clown"), ("(!diot)", "idiot"), ("you dumba$$.", "dumbass"),
    ("such an a$$", "ass"), ("an iddiot", "idiot"), ("how stuppid!", "stupid"), ("mooron.", "moron"),
    ("wow!", "wow"), ("(really)", "really"), ("hello.", "hello"), ("well!!!", "well")])
def test_obfuscated_words_in_sentences(lm, sentence, meant):
    scorer = toxicity.Scorer(lm)
    assert meant in scorer.features(sentence)
    assert meant in scorer.features(sentence)  # from the cache


def test_runs_of_single_characters():
    runs = lambda t: [m[0] for m in toxicity._SPACED.finditer(t)]
    assert runs("s c u m. i a m") == ["s c u m", "i a m"]
    assert runs("a b cat, don't a b") == []
    assert runs("* " * 50_000 + "xy") and runs("no run here 12 34 5") == []
    assert toxicity.run_forms("1 2 3", []) == []


def test_toxicity_query(spark):
    rows = toxicity.op1(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    r = rows.select("held_out", "score", "predicted", "toxic").collect()
    held = [x for x in r if x.held_out]
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in r)
    clean = [x for x in held if not x.toxic]
    assert sum(x.predicted for x in clean) <= 0.05 * len(clean)
    pairs = [(a.score > b.score) + 0.5 * (a.score == b.score)
             for a in held if a.toxic for b in clean]
    assert np.mean(pairs) > 0.85


def test_toxicity_odd_rows(spark, docs):
    d = docs(ODD, extra=True)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(d, none).collect()
    assert len(got) == len(ODD) and all(r.score == 0.0 and r.predicted == 0 for r in got)
    labels = spark.createDataFrame([(5, 1, 1), (6, 1, None), (None, 1, 1), (7, 0, 0), (7, 0, 0),
                                    (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(d, labels).count() == len(ODD)
    assert toxicity.toxicity(docs([]), labels).count() == 0


# --------------------------------------------------------------- language id

def test_language_query(spark):
    got = language.op5(spark, SF).join(
        spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1000
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_grams_against_brute_force():
    for text in ("Ab 12 c", "é--é", "x", " a  b ", "", "12"):
        s = re.sub(r"[^\w]|[\d_]", "\0", text.lower())
        s = re.sub("\0+", " ", s)
        s = (" " + s.strip() + " ") if s.strip() else " "
        n = sum(len([g for g in (s[i:i + k] for i in range(len(s) - k + 1))
                     if g[0] != " " or g[-1] != " "]) for k in language.ORDERS)
        h, o, has = language.grams([text])
        assert len(h) == n and bool(has[0]) == any(c.isalpha() for c in text)


def test_language_odd_rows(docs):
    rows = [(i, "der hund und die katze " * 3, "de") for i in range(20)] + \
           [(i, "the dog and the cat " * 3, "en") for i in range(20, 40)] + \
           [(41, "the dog", None), (42, None, "en"), (43, "123 !?", "de"), (None, "die katze", "fr"),
            (44, "", "en")]
    got = {r.doc_id: r for r in language.identify(docs(rows, extra=True)).collect()}
    assert got[41].lang_pred == "en" and got[42].lang_pred == got[43].lang_pred == "und"
    assert got[44].score == 0.0 and got[None].held_out and got[None].lang_pred == "de"
    nothing = language.identify(docs([(1, "text", None)])).collect()
    assert [(r.lang_pred, r.score) for r in nothing] == [("und", 0.0)]
    assert language.identify(docs([])).count() == 0


# -------------------------------------------------------------- fingerprints

def brute_next(rows):
    d = sorted(rows, reverse=True)
    for i, (k, t) in enumerate(d):
        n = d[(i + 1) % len(d)][1] or ""
        t = t or ""
        h = len(t) // 2
        yield k, t, n, t[:len(t) - h] + n[:h]


@pytest.mark.parametrize("ids", [[7], [1, 2, 3], [0, 255, 256, 257, 70_000, 5_000_000_000, -300],
                                 list(range(0, 3000, 7))])
def test_fingerprint_edits(docs, ids):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["ab", "céd", "e.", "f\n", "🙂g,"]) for _ in range(
        rng.randrange(12)))) for i in ids]
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs(rows)).collect()}
    for k, t, _, e in brute_next(rows):
        assert got[k].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert got[k].n_chars == len(t)


def test_fingerprint_lanes_against_xxhash(spark):
    import xxhash

    text = "One two. Three\nfour,  five.\n\nOne two."
    pieces = [p.strip(" ") for p in re.split(r"[\n\r]+|(?<=[.!?,;:])\s+", text) if p.strip(" ")]

    def long_hash(data, seed):
        return xxhash.xxh64_intdigest(data, seed)

    want = [0] * fingerprint.LONGS
    for p in pieces:
        h = long_hash(p.encode(), 42)
        for seed in range(fingerprint.LONGS // 4):
            # Spark hashes several columns by chaining the seed.
            x = long_hash(seed.to_bytes(4, "little"), long_hash(h.to_bytes(8, "little"), 42))
            for k in range(4):
                j = seed * 4 + k
                want[j] = (want[j] + (x >> 8 * k & fingerprint._PAIR)) & fingerprint._KEEP
    got = spark.createDataFrame([(text,)], "t string").select(
        fingerprint.fingerprint(F.col("t")).alias("f")).first().f
    assert got == [len(pieces), *want]


def test_fingerprint_is_homomorphic(spark):
    df = spark.createDataFrame([("a.\nb.\nc.", "b.\nd.", "a.\nc.\nb.\nb.\nd.")], "x string, y string, z string")
    f = fingerprint.fingerprint
    both = fingerprint.combine(f(F.col("x")), f(F.col("y")))
    r = df.select(both.alias("both"), f(F.col("z")).alias("z"), f(F.col("x")).alias("x"),
                  fingerprint.remove(both, f(F.col("y"))).alias("less")).first()
    assert r.both == r.z and r.less == r.x


def test_fingerprint_odd_rows(docs):
    got = fingerprint.fingerprints(docs(ODD, extra=True)).collect()
    assert len(got) == len(ODD)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    same = {r.fingerprint for r in got if r.doc_id == 5}
    assert len(same) == 1
    assert len({r.fingerprint for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert fingerprint.fingerprints(docs([])).count() == 0


# ------------------------------------------------------------ stupid backoff

def words(t):
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").lower())


def test_backoff_against_brute_force(docs):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abcdefg") for _ in range(rng.randrange(40))))
            for i in range(60)] + [(100, None), (101, ""), (102, "!!"), (103, "zz"), (103, "zz"),
                                   (None, "a b c")]
    grams = [Counter(tuple(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))
             for w in (words(t) for _, t in rows)]
    total = sum(grams, Counter())
    n_all = sum(len(words(t)) for _, t in rows)
    want = Counter()
    for (k, t), own in zip(rows, grams):
        w, s = words(t), 0.0
        for i in range(len(w)):
            m = min(3, i + 1)
            for n in range(m, 0, -1):
                g = tuple(w[i - n + 1:i + 1])
                c = total[g] - own[g]
                if n == 1:
                    rest = n_all - len(w)
                    s += (m - 1) * math.log(0.4) + (math.log(c / rest) if c else -math.log(rest + 1))
                elif c:
                    s += (m - n) * math.log(0.4) + math.log(c / (total[g[:-1]] - own[g[:-1]]))
                    break
        want[k, len(w), round(s, 6)] += 1
    for block, part in ((50, 40), (4_000_000, 5_000_000)):
        got = lmscore.backoff_scores(docs(rows, extra=True), block_chars=block, part_chars=part)
        assert Counter((r.doc_id, r.n_words, round(r.log_score, 6)) for r in got.collect()) == want
    assert lmscore.backoff_scores(docs([])).count() == 0


def test_packed_hashes_round_trip():
    h = np.sort(np.random.default_rng(0).integers(0, 1 << 48, 5000).astype(np.uint64))
    assert (lmscore.unpack_hashes(lmscore.pack_hashes(h)) == h).all()
    assert len(lmscore.unpack_hashes(lmscore.pack_hashes(h[:0]))) == 0
    for top in (0, 200, 60_000, 1 << 40):
        a = np.array([0, top, 1])
        assert (lmscore.unpack(lmscore.pack(a)) == a).all()


def test_shortcuts_equal_the_whole_search():
    """Letters decided one by one, and kept ends of words, give what the search gives."""
    import random

    import numpy as np

    from vitrine.llm import toxicity as T
    rng = random.Random(5)
    lm = np.log(np.random.default_rng(5).random((T.SYMBOLS,) * 3))
    table = T.Table(lm)
    for _ in range(3000):
        word = "".join(rng.choice("abcé0$!.-#") * rng.choice([1, 1, 1, 2, 3, 5])
                       for _ in range(rng.randint(1, 7)))
        for whole in (False, True):
            want = T._search(word, table, whole, 0.15, T.BLANK, T.BLANK, False)
            assert T.viterbi(word, table, whole) == T.viterbi(word, lm, whole) == want
            assert T.viterbi(word, table, whole) == want  # from the kept ends


def test_scorer_caches_are_bounded():
    import numpy as np

    from vitrine.llm import toxicity as T
    lm = np.log(np.random.default_rng(5).random((T.SYMBOLS,) * 3))
    small, large = T.Scorer(lm, cache=20_000), T.Scorer(lm)
    text = " ".join(f"wo{'rd'[k % 2] * (k % 4)}{'x' * (k % 50)}!" for k in range(3000))
    assert small.features(text) == large.features(text)
    assert len(small.cache) + len(small.before) < 200
