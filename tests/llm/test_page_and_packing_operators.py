"""HTML extraction, WARC, packing, the pipeline."""

import itertools
import random
import struct
import zlib
from collections import defaultdict

import duckdb
import pytest

import corpus_pipeline
from vitrine.llm import mincut, packing, warc
from vitrine.llm import queries as llm_queries

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------ HTML extraction

def test_main_text():
    page = """<!DOCTYPE html><html><head><title>T</title></head><body class="has-sidebar">
    <header><h1>Site</h1><ul><li><a href=/>Home</a></ul></header>
    <div id="cookie-notice">We use cookies.</div>
    <div class="content"><h1>Head line</h1><p>First &amp; more text,<br>long enough to be
    content for sure.<p>ok</p><ul><li>point one of the list</li><li>two</ul>
    <div class="comments"><p>Great article, I liked it very much indeed, every word.</p></div></div>
    <aside>Side</aside><form><label>Name</label></form><footer>&copy; 2020</footer>
    <script>var a="<p>no</p>"</script><!-- <p>no</p> --><p unclosed"""
    assert mincut.main_text(page) == ("Head line\n\nFirst & more text, long enough to be content "
                                      "for sure.\n\nok\n\npoint one of the list\n\ntwo")


@pytest.mark.parametrize("html", [None, "", "<", "<p>", "</p></p>", "<script>never closed",
                                  "<nav>only menu</nav>", "<!-- open", "<a href='x"])
def test_pages_without_content(html):
    assert mincut.main_text(html) == ""


ARTICLE = ("This is the first sentence of the article. It goes on with a second one, and more "
           "words. The third sentence ends it.")


@pytest.mark.parametrize("body", [
    '<article class="post comments-open"><p>%s</p></article>',
    '<div class="content no-sidebar"><p>%s</p></div>',
    '<div class="fixed-header"><p>%s</p></div>',
    '<article class="article-social-issues"><p>%s</p></article>',
    "<p title=it's>%s</p><nav title='x'><a href=/>Home</a></nav>",
    '<article><p>%s <span class=ad>Buy</span><span style="display: none">x</span></p></article>',
    '<article><p class="x>%s</p></article>',
    "<article><p>%s</p><div id=comments><article class=comment><p>" + 3 * ARTICLE
    + "</p></article></div></article>",
    '<article><p>%s</p></article><div class="SideBar">' + ARTICLE + "</div>",
    "<aside><article><p>" + ARTICLE[:60] + "</p></article></aside><main><p>%s</p></main>",
    '<div class="post-comments"><p>' + 3 * ARTICLE + "</p></div><article><p>%s</p></article>"])
@pytest.mark.parametrize("frame", ["%s", "<form id=page>%s</form>", "<div class=menu>%s</div>"])
def test_article_shapes(body, frame):
    page = "<header><a href=/>Site</a></header>" + body % ARTICLE + "<footer>Imprint</footer>"
    assert mincut.main_text(frame % page) == ARTICLE


def test_less_than_in_text_is_text():
    assert mincut.main_text(f"<p>{ARTICLE} a <b and c < d, x<5 too.</p>") == (
        ARTICLE + " a <b and c < d, x<5 too.")


def test_names_are_signs_by_their_place():
    strong, hint = mincut.W_SIGN, mincut.W_HINT
    for names, sign in {"comments": strong, "postComments": strong, "comment-list": strong,
                        "comments-open": hint, "no-comments": 0.0, "entry-content": 0.0,
                        "commentary": 0.0, "x site-footer": strong, "": 0.0}.items():
        assert mincut.name_signs(names)[0] == sign, names


def test_the_cut_turns_doubtful_blocks():
    # Short lines cost less as boilerplate on their own, but follow the prose around them.
    page, chosen, turned = mincut.label(f"<div><p>{ARTICLE}</p><p>Yes</p><p>{ARTICLE}</p></div>")
    assert [b.text for b in page] == [ARTICLE, "Yes", ARTICLE]
    assert chosen == [True] * 3 and turned == 1
    # The same line between menus stays out, and a sign can be overturned as well.
    _, chosen, turned = mincut.label(
        "<nav><p>One</p></nav><p>Yes</p><nav><p>Two</p></nav>")
    assert chosen == [False] * 3 and turned == 0
    _, chosen, turned = mincut.label(
        f"<div><p>{ARTICLE}</p><p class=social-issues>{ARTICLE[:70]}</p><p>{ARTICLE}</p></div>")
    assert chosen == [True] * 3 and turned == 1


def test_broken_markup_takes_linear_time():
    for page in ["<p a=\"" * 50_000, "<a b " * 50_000, "<p a='x" * 50_000, "<" * 200_000,
                 "<div>" * 20_000 + "x", "<a b=c" + " d" * 200_000, "<!--" * 50_000]:
        mincut.main_text(page)


def test_min_cut_against_all_labellings():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randrange(1, 9)
        keep = [rng.randrange(9) + 0.25 for _ in range(n)]
        drop = [float(rng.randrange(9)) for _ in range(n)]
        smooth = [(i, j, float(rng.randrange(4))) for i in range(n) for j in range(i)
                  if rng.random() < 0.5]

        def cost(c):
            return (sum(d if x else k for x, k, d in zip(c, keep, drop))
                    + sum(w for i, j, w in smooth if c[i] != c[j]))
        best = min(cost(c) for c in itertools.product([True, False], repeat=n))
        assert cost(mincut.min_cut(keep, drop, smooth)) == pytest.approx(best)


def test_extract_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article><p>Some text.</p></article>"),
            (3, "u", "<p>" + "long words go on. " * 20_000), (3, "u", "<article>x.</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr(
        "*", "1 as text", "2 as n_chars")
    got = {(r.page_id, r.n_chars) for r in mincut.extract(df).collect()}
    assert got == {(1, 0), (2, 0), (None, 10), (3, 18 * 20_000 - 1), (3, 2)}
    assert mincut.extract(df.limit(0)).count() == 0


# ----------------------------------------------------------------------- WARC

PAGES = [(1, "http://a/ x\n", "é" * 60), (2, None, "é" * 60), (3, "u", "short"), (4, "u", "short"),
         (5, "u", None), (6, "u", ""), (7, "u", "x" * 100), (None, "u", "x" * 100),
         (8, "u", "y" * 99), (9, "u", "y" * 99), (10, "u", "\r\n\r\nWARC/1.1 z" * 30_000)]


def test_warc_round_trip(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr(
        "*", "'x' as digest", "'y' as refers_to").repartition(3)
    manifest = warc.write_archives(df, str(tmp_path / "w"), archive_bytes=300)
    assert manifest.count() > 1
    assert manifest.agg({"records": "sum"}).first()[0] == len(PAGES)
    (tmp_path / "w" / f"left-over{warc.SUFFIX}").write_bytes(b"of a task that was lost")
    got = warc.read_archives(spark, str(tmp_path / "w"), manifest).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(PAGES)
    assert (by[2].record_type, by[2].refers_to, by[2].payload_bytes) == ("revisit", 1, 120)
    assert (by[None].record_type, by[None].refers_to) == ("revisit", 7)
    for k, _, h in PAGES:
        if by[k].record_type == "response":
            assert by[k].html == (h or "") and by[k].refers_to is None
    assert {k for k in by if by[k].record_type == "revisit"} == {2, None}
    one = next(p for p in (tmp_path / "w").iterdir() if p.name == manifest.first().archive)
    assert struct.unpack_from("<I", one.read_bytes())[0] == warc.DICT_MAGIC


def test_warc_against_sql(spark):
    got = sorted(map(tuple, warc.op9(spark, SF).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    assert got == sorted(con.execute(warc.OP9_SQL).fetchall())


def test_warc_empty(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    manifest = warc.write_archives(df, str(tmp_path / "e"))
    assert warc.read_archives(spark, str(tmp_path / "e"), manifest).count() == 0


# -------------------------------------------------------------------- packing

def _packed(lengths, capacity=64, **kw):
    import numpy as np

    packer = packing.Packer(capacity, 0, **kw)
    for k, n in enumerate(lengths):
        packer.add(k, np.arange(n, dtype="<u4"))
    packer.finish()
    seqs = defaultdict(list)
    at = defaultdict(int)
    for doc, start, n, _, total, seq, offset in sorted(packer.done, key=lambda r: (r[0], r[1])):
        assert start == at[doc] and total == lengths[doc] and n > 0
        at[doc] += n
        seqs[seq].append((offset, doc, n))
    assert [at[k] for k in range(len(lengths))] == list(lengths)
    for pieces in seqs.values():
        end = 0
        for offset, _, n in sorted(pieces):
            assert offset == end
            end += n
        assert end <= capacity
    return [[n for _, _, n in sorted(x)] for x in seqs.values()]


def test_classes_hold_a_fixed_count_of_whole_documents():
    # 17..21 tokens: class 3 of 64. The first document waits to fill gaps.
    for seq in _packed([30] + [20] * 9, least=5):
        assert seq.count(20) == 3 or sum(seq) & (sum(seq) - 1) == 0
    # Lengths of exactly capacity / k leave no gap and cut nothing.
    assert sorted(_packed([64] + [16] * 8)) == [[16] * 4, [16] * 4, [64]]
    assert _packed([]) == []


def test_gaps_are_filled_and_padding_is_small():
    rng = random.Random(3)
    for seed in range(20):
        lengths = [rng.choice([1, 2, 3, 9, 20, 33, 60, 64, 65, 200, 1000])
                   for _ in range(rng.randrange(300))]
        for least in (1, 4):
            used = [sum(x) for x in _packed(lengths, least=least, queue=rng.choice([1, 64]))]
            odd = [u for u in used if u & (u - 1)]
            assert all(u > 64 - least for u in odd)
            assert sum(u < 64 and not u & (u - 1) for u in used) <= 6


def test_most_documents_stay_whole():
    rng = random.Random(4)
    lengths = [int(rng.lognormvariate(6, 1)) + 1 for _ in range(3000)]
    pieces = sum(len(x) for x in _packed(lengths, capacity=4096))
    long = sum(n // 4096 for n in lengths)
    assert pieces - long < 1.35 * len(lengths)


def test_encoder_against_the_tokenizer():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    texts = ["it's DON'T we'll 'tis", "a<|endoftext|>b <|startoftext|>", "x\x1cy z\xa0w", "ΣΑΣ ﬁ é ́x",
             "", None, " \n", "word... (word) word!? 12a 3,4", "İstanbul ÀÉ", "日本語 text", "a" * 3000]
    for cache in (800_000, 3):
        enc = packing.Encoder(packing.tokenizer_path(), 2, cache)
        for part in (texts, texts[::-1], texts):
            ids, first = enc.encode_all(part)
            for k, t in enumerate(part):
                want = tok.encode(t or "", add_special_tokens=False).ids + [2]
                assert ids[first[k]:first[k + 1]].tolist() == want


def test_packing(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["alpha", "Beta,", "gamma!", "q"]) for _ in range(
        rng.choice([0, 1, 50, 700, 9000])))) for i in range(40)] + [(None, None), (99, "t")]
    pieces = packing.harmonic_pack(docs(rows, extra=True)).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    for k, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        at = 0
        for p in sorted(by_doc[k], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            raw = struct.pack(f"<{p.length}I", *ids[at:at + p.length])
            assert p.ids_crc32 == zlib.crc32(raw)
            at += p.length
        assert at == len(ids)
    for seq in by_seq.values():
        at = 0
        for p in sorted(seq, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at & (at - 1) == 0 and at <= 4096 or 4096 - packing.LEAST < at < 4096
    assert packing.harmonic_pack(docs([])).count() == 0


# ------------------------------------------------------------------- pipeline

def test_pipeline_stages(spark, tmp_path):
    first = spark.read.parquet(f"{SF}/documents.parquet")
    read, kept = first, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / f"{k}.parquet")
        stage(spark, read, SF).write.parquet(out)
        read = spark.read.parquet(out)
        kept[name] = read
        if k < len(corpus_pipeline.STAGES) - 1:
            assert read.dtypes == first.dtypes
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in kept.items()}
    assert ids["ngram_jaccard_join"] <= ids["toxicity"] == {
        r.doc_id for r in llm_queries.queries()["op1_toxicity"](spark, SF)
        .filter("predicted = 0").collect()}
    assert ids["substring_dedup"] == ids["ngram_jaccard_join"]
    assert ids["packing"] == ids["benchmark_decontamination"] <= ids["substring_dedup"]


def test_pipeline_odd_rows(spark, docs, tmp_path):
    rows = [(1, None), (2, ""), (None, "no id here"), (None, "other text without id"),
            (5, "same text"), (5, "same text"), (6, "SAME text"), (7, "word " * 500)]
    read = docs(rows)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[1:3]):
        read = stage(spark, read, SF)
    got = sorted((r.doc_id or 0, (r.text or "")[:9]) for r in read.collect())
    assert got == [(0, "no id her"), (0, "other tex"), (1, ""), (2, ""), (5, "same text"),
                   (7, "")]


def test_texts_under_one_id_are_judged_apart(spark, docs):
    copy = " ".join(f"w{i}" for i in range(60))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(3, copy), (5, copy), (5, "an unrelated text that nobody copied at all"),
            (8, item), (8, "a clean text under the id of a contaminated one"), (9, "alone")]
    read = corpus_pipeline.keep_one_of_each_class(spark, docs(rows), SF)
    got = sorted((r.doc_id, r.text) for r in read.collect())
    assert got == sorted(r for r in rows if r != (5, copy))
    read = corpus_pipeline.drop_contaminated(spark, docs(rows), SF)
    assert sorted((r.doc_id, r.text) for r in read.collect()) == sorted(r for r in rows if r != (8, item))


def test_every_operator_is_registered():
    names = set(llm_queries.queries())
    assert "pipeline" in names
    assert sorted(int(n[2:n.index("_")]) for n in names if n.startswith("op")) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "packing"]
