import random
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from ridgeline.llm import embedding_dedup, queries, topk_search, url_filters
from ridgeline.llm.common import components

from .conftest import prose
from .test_tokens import check_packing

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label string"


def vectors():
    r = np.random.default_rng(11)
    base = r.normal(size=(220, 16))
    out = [base[i // 2] + r.normal(scale=0.05 + 0.1 * (i % 3), size=16) for i in range(440)]
    out += [out[5]] * 30 + [np.zeros(16), out[7] * 3, np.full(16, 1e-30), np.full(16, 1e30)]
    rows = [(i, [float(x) for x in np.float32(v)], "x") for i, v in enumerate(out)]
    nan = [float("nan")] + [1.0] * 15
    rows += [(900, None, None), (950, [], None), (901, nan, None), (902, [None] + [1.0] * 15, None), (903, [float("inf")] * 16, None), (904, [1.0, 2.0], None), (None, rows[9][1], None)]
    return rows


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


def test_links_equal_brute_force(spark):
    rows = vectors()
    good = [(i, np.array(v, np.float64)) for i, v, _ in rows if usable(v) and any(v)]
    links, label = defaultdict(int), {i: i for i, _, _ in rows if i is not None}
    for a, (i, x) in enumerate(good):
        for j, y in good[:a]:
            if len(x) == len(y) and (x / np.linalg.norm(x)) @ (y / np.linalg.norm(y)) >= 0.95:
                links[i] += 1
                links[j] += 1
                if i is not None and j is not None and label[i] != label[j]:
                    low, high = sorted((label[i], label[j]))
                    label = {k: low if v == high else v for k, v in label.items()}
    found = embedding_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS), rows_a_block=100).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.n_links == links[r.vec_id], r
        if r.vec_id is not None:
            assert r.component_id == label[r.vec_id] and r.kept == (r.vec_id == r.component_id)


def test_quantisation_bounds_hold():
    r = np.random.default_rng(3)
    q = embedding_dedup.Quantised(r.normal(size=(200, 24)))
    exact = q.unit @ q.unit.T
    approx = (q.real @ q.real.T) * q.scale[:, None] * q.scale[None, :]
    bound = q.size[:, None] * q.error[None, :] + q.error[:, None] * (q.size[None, :] + q.error[None, :])
    assert (np.abs(exact - approx) <= bound).all()


def test_top_k_equals_brute_force(spark):
    rows = vectors()
    good = [(i, np.floor(256 * np.array(v, np.float64))) for i, v, _ in rows if usable(v) and i is not None and max(map(abs, v)) < 1e6]
    want = {}
    for i, q in good:
        if i % 50 == 0:
            scored = sorted((-int(q @ x), j) for j, x in good if j != i and len(x) == len(q))
            want.update({(i, k + 1): (j, -s) for k, (s, j) in enumerate(scored[:5])})
    df = spark.createDataFrame([r for r in rows if r[1] is None or not usable(r[1]) or max(map(abs, r[1])) < 1e6], VECTORS)
    found = topk_search.top_k(df, df.vec_id % 50 == 0, rows_a_range=90).collect()
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in found} == want


def test_few_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 0.5], None), (1, [0.5, -0.25], None)], VECTORS)
    assert [tuple(r) for r in topk_search.op9(df).collect()] == [(0, 1, 1, 256 * 128 - 128 * 64)]
    assert topk_search.op9(df.limit(0)).count() == 0 and embedding_dedup.op5(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    c = duckdb.connect()
    for t in ("pages", "embeddings"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = c.sql(queries.ORACLE_SQL[name]).project(",".join(f'"{x}"' for x in columns)).fetchall()
    assert sorted((tuple(r) for r in df.select(columns).collect()), key=str) == sorted(want, key=str)


def test_url_rules_and_aliases(spark):
    link = '<html><head><LINK href="{}" rel="canonical"></head></html>'
    pages = [
        (1, "http://Shop.Example.COM/en/x?y", None),  # blocked by a rule
        (2, "http://mirror.org/a", link.format("http://shop.example.com/en/x?y")),  # alias of a blocked page
        (3, "http://mirror.org/b#top", '<meta http-equiv="refresh" content="0; url=http://mirror.org/a">'),  # by way of 2
        (4, "http://good.org/a", link.format("http://www.example.com/en/")),  # alias of an allowed page
        (5, "http://both.org/", link.format("http://net.net/es/1")),
        (6, "http://both.org/x", link.format("http://both.org/")),
        (7, "http://b.net/es/1", '<link rel=canonical href="//both.org/">'),
        (8, "http://ok.com/p", link.format("http://both.org/")),  # an explicit allow in 5's component
        (9, None, None), (10, "nothing", None), (11, "ftp://u@net/es/?q://", ""), (12, "http://a.com", None), (13, "http://xcom/", None), (1, "http://Shop.Example.COM/en/x?y", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = {r.page_id: r for r in url_filters.op2(df).collect()}
    assert (rows[1].host, rows[1].path, rows[1].rule, rows[1].verdict) == ("shop.example.com", "/en/x", "example.com/en/", "block")
    assert [rows[i].verdict for i in (2, 3, 4)] == ["block", "block", "allow"]
    assert [rows[i].verdict for i in (5, 6, 7, 8)] == ["allow", "allow", "block", "allow"]
    assert (rows[9].host, rows[9].path, rows[9].rule, rows[9].verdict) == ("", "", None, "allow") and rows[10].host == ""
    assert (rows[11].host, rows[11].path) == ("u@net", "/es/") and rows[12].rule is None and rows[13].rule is None
    extra = spark.createDataFrame([("http://free.org/", "http://mirror.org/b")], "a string, b string")
    more = spark.createDataFrame([(1, "http://free.org/", None), (2, "http://mirror.org/b", link.format("http://a.net/fr/"))], df.schema)
    assert {r.verdict for r in url_filters.judge(more, redirects=extra).collect()} == {"block"}
    assert url_filters.op2(df.limit(0)).count() == 0


def test_links_of_every_form_and_the_sql(spark):
    link = '<html><head><link href="{}" rel="nofollow canonical"></head></html>'
    bad = "http://a.net/es/dir/page"
    pages = [
        (0, bad, None),
        (1, "http://m1.org/x/y/z.html?q", link.format("../b.html")), (2, "http://m1.org/x/b.html", link.format(bad)),  # relative to the path
        (3, "http://m2.org/p", link.format("?a=1&amp;b=2")), (4, "http://m2.org/p?a=1&b=2", link.format(bad)),  # own path, entity
        (5, "http://m3.org", link.format("c/./d/..")), (6, "http://m3.org/c/", link.format(bad)),
        (7, "http://m4.org/", f"<link rel='canonical' href='http://m5.org/'><LINK REL=canonical href={bad}>"),  # the second tag blocks
        (8, "http://m6.org/", f"<meta content=\"0; URL='{bad}'\" http-equiv=refresh>"),
        (9, "http://m7.org/", link.format("mailto:x@a.net")), (10, "http://m8.org/", link.format("#top")), (11, "http://m9.org/", f'<link rel="alternate" href="{bad}">'),
        (12, "HTTP://ÄÖ.ORG/É", link.format("x")), (13, "http://äö.org/É", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = {r.page_id: r.asDict() for r in url_filters.op2(df).collect()}
    assert [i for i, r in found.items() if r["verdict"] == "block"] == [0, 1, 2, 3, 4, 5, 6, 7, 8]
    assert found[12]["host"] == "ÄÖ.org" and found[13]["host"] == "äö.org", "only A-Z are folded"
    c = duckdb.connect()
    c.register("pages", df.toPandas())
    columns = ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(c.sql(url_filters.SQL).project(",".join(columns)).fetchall()) == sorted(tuple(r[x] for x in columns) for r in found.values())


def test_components(spark):
    r = random.Random(3)
    order = [*range(40)]
    r.shuffle(order)
    edges = [*zip(order, order[1:]), (100, 101), (101, 102), (7, 7), (None, 3), (200, 200)]
    found = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(40)} | {100: 100, 101: 100, 102: 100}


def test_pipeline_stages(spark):
    """The stages on a small corpus: what goes, what stays, and that clean texts come through whole."""
    r = random.Random(21)
    clean = [prose(r, lang, 80) for lang in r.choices(["en", "fr", "de"], k=60)]
    passage = prose(r, "en", 90)
    rows = [(i, t, "en fr de".split()[i % 3], "s", len(t)) for i, t in enumerate(clean)]
    rows = [(i, t, lang, s, n) for i, t, lang, s, n in rows]
    near = clean[0].split()
    near[3] = "other"
    rows += [(100, clean[0], "en", "s", 1), (101, " ".join(near), "en", "s", 1), (102, "123 456", "en", "s", 1), (103, "kept words " + prose(r, "de", 150) + passage + " tail one", "en", "s", 1), (104, "more " + prose(r, "fr", 150) + passage + " end two", "en", "s", 1), (105, prose(r, "en", 40) + " password=abcdefgh99 " + prose(r, "en", 40), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        docs = stage(spark, docs, SF).persist()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], k
    kept = {x.doc_id: x for x in docs.collect()}
    assert {100, 101, 102}.isdisjoint(kept) and all(kept[i].text == t for i, t in enumerate(clean))
    assert passage not in kept[103].text and kept[103].text.startswith("kept words") and kept[103].n_chars == len(kept[103].text)
    assert "[assign]" in kept[105].text and "abcdefgh99" not in kept[105].text
    packed = corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()
    ids = sorted(kept)
    mapped = [type("Row", (), {**x.asDict(), "doc_id": ids.index(x.doc_id)}) for x in packed]
    check_packing(mapped, [kept[i].text for i in ids], Tokenizer.from_file(P.path("word_bpe_49k.json")))


@pytest.mark.parametrize("words", [51, 60, 75])
def test_passages_of_over_fifty_words_go(spark, words):
    r = random.Random(words)
    passage = " ".join(r.choice("alpha beta gamma delta omega".split()) + r.choice("abcdefgh") for _ in range(words))
    clean = [prose(r, "en", 120) for _ in range(6)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(clean)] + [(10 + i, f"{prose(r, 'fr', 60)} {passage} {prose(r, 'de', 60)}", "en", "s", 0) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {x.doc_id: x.text for x in corpus_pipeline.repeats(spark, docs, SF).collect()}
    assert all(passage[5:-5] not in kept[10 + i] for i in range(3)) and all(kept[i] == t for i, t in enumerate(clean))


def test_pipeline_on_an_empty_table_and_on_rows_without_ids(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
    r = random.Random(1)
    a, b = prose(r, "en", 60), prose(r, "de", 60)
    rows = [(None, a, None, None, 1), (None, a, None, None, 1), (3, b, None, None, 1), (3, b, None, None, 1), (4, b + " end", None, None, 1), (5, None, None, None, None), (5, None, None, None, None)]
    kept = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, schema), SF).collect()
    assert sorted((x.doc_id is None, x.doc_id or 0, x.text or "") for x in kept) == [(False, 3, b), (False, 5, ""), (False, 5, ""), (True, 0, a)]


def test_pipeline_runs_over_the_documents(spark):
    """Every piece comes from a document; documents are whole in their pieces, and no sequence overflows."""
    rows = corpus_pipeline.run(spark, SF).collect()
    known = {x.doc_id for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    pieces, bins = defaultdict(list), defaultdict(int)
    for x in rows:
        pieces[x.doc_id].append((x.piece, x.start, x.length))
        bins[x.sequence_id] += x.length
    assert len(pieces) > 100 and set(pieces) <= known and max(bins.values()) <= 4096
    assert all([p[1] for p in sorted(some)] == [4096 * k for k in range(len(some))] for some in pieces.values())
