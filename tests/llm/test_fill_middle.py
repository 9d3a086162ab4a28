"""Fill-in-the-middle against the plain definition by the standard library's matcher."""

import hashlib
import random
import re

import duckdb
import numpy as np

from ridgeline.llm import fill_middle, queries

SF = "/root/testdata/sf0.001"
UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def by_hand(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return len(units), "spm" if h[3] % 100 < 20 else "psm", len(p), len(m), out


def test_unit_ends_and_selection_in_words():
    r = random.Random(3)
    texts = ["", "a", "é", "abcdefgh", "abcdefghi", "a1" * 40, "\0a\0", "[@`{zZaA", "日本語abc😀😀x", "́́"]
    texts += ["".join(r.choice("abZ 1é日😀\n") for _ in range(r.randrange(60))) for _ in range(400)]
    units = fill_middle.Units([t.encode() for t in texts])
    split = [UNIT.findall(t) for t in texts]
    assert units.count.tolist() == [len(u) for u in split]
    for k in range(70):
        at = np.minimum(k, units.count)
        want = ["".join(u[:k]) for u in split]
        assert units.byte_after(at).tolist() == [len(w.encode()) for w in want]
        assert units.chars_before(units.byte_after(at)).tolist() == [len(w) for w in want]


def test_rows_equal_the_definition(spark, docs, texts):
    odd = ["a<P>b", "<S>", "<M", "<<P", "x<S", "S>y<P", "M>", ">", "<"] + ["<P <S <M " * 5] * 30
    more = spark.createDataFrame([(1000 + i, t, "en", "clash") for i, t in enumerate(odd)], docs.schema)
    both = docs.unionByName(more).withColumn("form", docs["lang"])  # clashes with a result
    made = fill_middle.fill_middle(both)
    assert made.columns == ["doc_id", "lang", "n_tokens", "n", "form", "prefix_chars", "middle_chars", "output"]
    back = made.withColumn("back", fill_middle.restored(made["output"], made["form"])).collect()
    forms = set()
    assert len(back) == len(texts) + 2 + len(odd)
    for r in back:
        t = texts[4] if r.doc_id is None else odd[r.doc_id - 1000] if r.doc_id >= 1000 else texts[r.doc_id]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == by_hand(r.doc_id, t)
        assert r.back == (t or "")
        forms.add(r.form)
    assert forms == {"plain", "psm", "spm"}


def test_shares_and_seed_are_parameters(spark, docs):
    whole = fill_middle.fill_middle(docs, plain=0, spm=100)
    assert {r.form for r in whole.where("n > 0").collect()} <= {"spm", "plain"}
    cuts = [[r.prefix_chars for r in fill_middle.fill_middle(docs, seed=s, plain=0).orderBy("doc_id", "n").collect()] for s in (1, 1, 2)]
    assert cuts[0] == cuts[1] != cuts[2]


def test_very_long_text_and_empty_table(spark, empty):
    text = "word, " * 900_000 + "é" * 50_000
    (r,) = fill_middle.fill_middle(spark.createDataFrame([(7, text)], "doc_id long, text string")).collect()
    assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == by_hand(7, text)
    assert fill_middle.op11(empty).count() == 0


def test_query_equals_sql(spark):
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    have = queries.op11_fill_middle(spark, SF)
    want = duck.sql(queries.ORACLE_SQL["op11_fill_middle"])
    assert have.columns == want.columns
    assert sorted(map(tuple, have.collect())) == sorted(want.fetchall())
