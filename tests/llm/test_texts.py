import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import language_id, minhash_dedup, secret_scan, suffix_dedup, words

from .conftest import DOCS, WORDS, prose


def covered(texts, length=400):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        mask = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                mask[i : i + length] = True
        out.append(mask)
    return data, out


def check_repeats(df, texts):
    data, masks = covered(texts)
    rows = sorted(suffix_dedup.op4(df).collect(), key=lambda r: r.doc_id)
    assert len(rows) == len(texts)
    for r, d, m in zip(rows, data, masks, strict=True):
        runs = int((np.diff(np.concatenate(([0], m.view(np.int8), [0]))) == 1).sum())
        kept = np.frombuffer(d, np.uint8)[~m].tobytes()
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(d), int(m.sum()), runs, hashlib.sha256(kept).hexdigest()), r.doc_id
        assert r.text == (None if texts[r.doc_id] is None else kept.decode(errors="ignore"))


@pytest.fixture(scope="module")
def repeating(texts):
    r = random.Random(7)
    shared = [prose(r, "en", 120) for _ in range(3)]
    out = [t for t in texts if not t or len(t) < 9000]
    out += [prose(r, "fr", r.randrange(1, 60)) + shared[k % 3][r.randrange(200) : -r.randrange(1, 200)] + prose(r, "de", 20) for k in range(30)]
    out += ["ab" * 300 + "c" + "ab" * 300, "z" * 399, "z" * 400, "z" * 401, shared[0][:399] + "!", "!" + shared[0][1:401], "é" * 300]
    return out


def test_repeats_equal_brute_force(spark, repeating):
    check_repeats(spark.createDataFrame([(i, t, None, None) for i, t in enumerate(repeating)], DOCS), repeating)


@pytest.mark.parametrize("group", [1, 2, 7])
def test_frequent_anchors_are_parted_exactly(spark, repeating, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(suffix_dedup, "FREQUENT", 1 / 50)
    check_repeats(spark.createDataFrame([(i, t, None, None) for i, t in enumerate(repeating)], DOCS), repeating)


def test_merged_transforms_find_what_comparison_finds():
    r = np.random.default_rng(2)
    for _ in range(20):
        n, side = int(r.integers(2, 40)), 12
        group = np.sort(r.integers(0, 4, n))
        left = r.integers(0, side + 1, n)
        texts = [bytes(r.integers(97, 99, int(a) + int(r.integers(0, side + 1))).astype(np.uint8)) for a in left]
        got = suffix_dedup.repeated_windows(group, left, texts, side)
        for i in range(n):
            for s in range(side + 1):
                own = lambda j: None if s < side - left[j] or s + side > side - left[j] + len(texts[j]) else texts[j][s - side + left[j] :][:side]  # noqa: B023, E731
                want = own(i) is not None and any(own(j) == own(i) for j in range(n) if j != i and group[j] == group[i])
                assert got[i, s] == want


def test_long_texts_are_cut_into_segments(spark, monkeypatch):
    r = random.Random(1)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1 << 10)
    a, b = prose(r, "en", 900), prose(r, "de", 700)
    texts = [a + b, b + a[:3000], a[5:]]
    runs = suffix_dedup.anchor_runs(np.frombuffer(texts[0].encode(), np.uint8), 400, 200)
    assert runs[3].tolist() == [0, *(runs[4][:-1] + 1).tolist()] and runs[4][-1] == len(texts[0].encode()) - 400


def test_removal_keeps_columns_and_characters(spark):
    r = random.Random(2)
    p = prose(r, "fr", 100)
    df = spark.createDataFrame([(1, "é" + p + "é", "fr", "x"), (2, "è" + p + "è", None, None), (3, None, None, None)], DOCS)
    rows = {x.doc_id: x for x in suffix_dedup.remove_repeats(df).collect()}
    # the first bytes of é and è are equal, so at the end the cut takes half a character, and the other half goes too
    assert (rows[1].text, rows[1].lang, rows[1].n_tokens) == ("é", "fr", "x") and rows[2].text == "è"
    assert rows[3].text is None


def brute_classes(texts):
    """Classes by the counted Jaccard similarity of five-word shingles, all pairs compared."""
    bags = []
    for t in texts:
        w = [x for x in re.split("[\t-\r\x1c-\x20]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None)
    label = list(range(len(texts)))
    for i, a in enumerate(bags):
        for j in range(i):
            b = bags[j]
            if a and b and (a & b).total() / (a | b).total() >= 0.8 and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


@pytest.mark.parametrize("block", [256, 1])
def test_near_copies_equal_brute_force(spark, texts, monkeypatch, block):
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    monkeypatch.setattr(minhash_dedup, "TILE", 8)
    r = random.Random(4)
    base = prose(r, "en", 120).split()
    many = list(texts)
    for _ in range(25):  # a chain of ever less similar copies, so that some of a bucket pass and some fail
        base[r.randrange(len(base))] = f"w{r.randrange(10**6)}"
        many.append(" ".join(base))
    want = brute_classes(many)
    df = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(many)], DOCS)
    rows = sorted(minhash_dedup.op10(df).collect(), key=lambda x: x.doc_id)
    assert [x.class_id for x in rows] == want and all(x.kept == (x.doc_id == x.class_id) for x in rows)


def test_repeated_ids_with_different_texts_join(spark):
    r = random.Random(6)
    a, b, c = (prose(r, "en", 60) for _ in range(3))
    rows = [(1, a, None, None), (1, b, None, None), (2, b + " extra", None, None), (4, c, None, None), (None, c, None, None), (None, None, None, None), (5, " ", None, None)]
    found = sorted(((x.doc_id, x.class_id, x.kept) for x in minhash_dedup.op10(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert found == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (4, 4, True), (None, 4, False), (None, None, True), (5, 5, True)], key=str)
    alone = minhash_dedup.op10(spark.createDataFrame(rows[1:3], DOCS)).collect()
    assert {(x.doc_id, x.class_id) for x in alone} == {(1, 1), (2, 1)}


def test_signatures_estimate_weighted_similarity():
    r = np.random.default_rng(1)
    for weighted in (False, True):
        got, want = [], []
        for _ in range(40):
            x = r.integers(0, 2**63, 300).astype(np.uint64)
            a, b = (r.integers(1, 9, 300).astype(float) if weighted else (r.random(300) < 0.8).astype(float) for _ in range(2))
            i, j = np.flatnonzero(a), np.flatnonzero(b)
            weights = np.concatenate((a[i], b[j])) if weighted else None
            s = minhash_dedup.signatures(np.concatenate((x[i], x[j])), np.repeat([0, 1], [len(i), len(j)]), 2, 128, weights)
            got.append((s[0] == s[1]).mean())
            want.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
        assert np.mean(got) == pytest.approx(np.mean(want), abs=0.02)


def test_counted_similarity():
    a, b = (words.shingle_hashes(words.text_bytes(t), 1) for t in ("x x y", "x y y"))
    assert minhash_dedup.exact_similarity(a, b, False) == 1 and minhash_dedup.exact_similarity(a, b, True) == 0.5


def test_batch_shingles_equal_single_ones(texts, monkeypatch):
    monkeypatch.setattr(words, "STRIDE", 1 << 12)
    h, of = words.shingles_of(texts, 5)
    for i, t in enumerate(texts):
        assert np.array_equal(h[of == i], words.shingle_hashes(words.text_bytes(t), 5)), i


def test_secrets_equal_the_plain_patterns(docs, texts):
    rows = secret_scan.op6(docs.where("doc_id is not null")).collect()
    for r in rows:
        t, spans = texts[r.doc_id] or "", []
        for i, rule in enumerate(secret_scan.RULES):
            spans += [(m.start(), i, m.end()) for m in re.finditer(rule.pattern, t, rule.flags) if len(m[rule.group]) >= rule.least]
        line = lambda some: ",".join(f"{secret_scan.RULES[i].kind}:{a}:{b}" for a, i, b in sorted(some))
        base = [s for s in spans if s[1] < 3]
        assert r.spans == line(spans) and r.base_sha256 == hashlib.sha256(line(base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3))
    assert sum(r.n_assign for r in rows) >= 2 and sum(r.n_access for r in rows) == 1 and any("github" in r.spans for r in rows)


def test_trigram_queries_are_necessary():
    rules = {r.kind: secret_scan.trigram_query(r) for r in secret_scan.RULES}
    assert rules["hex"] is True and rules["access"] == ("and", b"aki", b"kia")
    index = secret_scan.Index(secret_scan.trigrams(rules["assign"]))
    import pyarrow as pa

    found = index.postings(pa.array(["my PassWord", "passw ord", "", "API_KEY", "apikey", "pass", "word"]))
    assert index.candidates(rules["assign"], found).tolist() == [True, False, False, True, True, False, False]


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é password=abcdefgh12 end", "en", "x"), (2, "plain", None, None), (3, None, None, None)], DOCS)
    rows = {r.doc_id: r for r in secret_scan.redact_secrets(df).collect()}
    assert rows[1].text == "é [assign] end" and rows[1].n_tokens == "x" and rows[2].text == "plain" and rows[3].text is None


def test_languages_on_held_out_texts(spark):
    r = random.Random(9)
    rows = [(i, prose(r, lang, r.randrange(5, 150)), lang, None) for i, lang in enumerate(r.choices([*WORDS], k=240))]
    rows += [(1000, None, "en", None), (1001, "", "en", None), (1002, "12 !?", "fr", None), (None, prose(r, "de", 50), "de", None), (1003, prose(r, "fr", 30), None, None)]
    found = {x.doc_id: x for x in language_id.op3(spark.createDataFrame(rows, DOCS)).collect()}
    test = [(found[i].lang_pred, lang) for i, _, lang, _ in rows[:240] if found[i].held_out]
    assert len(test) > 50 and np.mean([a == b for a, b in test]) > 0.95
    assert all(found[i].lang_pred == "und" for i in (1000, 1001, 1002)) and found[None].lang_pred == "de" and found[1003].lang_pred == "fr"
    assert all(0 <= x.score <= 1 for x in found.values())


def gram_set(text):
    """The n-grams (n = 1 to 3) of a text's six-bit codes, as tuples."""
    codes = [int(language_id.alphabet()[ord(c)]) for c in text]
    return {tuple(codes[i : i + n]) for n in (1, 2, 3) for i in range(len(codes) - n + 1)}


def test_scores_equal_a_direct_kernel_regression(spark):
    """The model against kernels counted on Python sets and a ridge regression in double precision over the same landmarks."""
    r = random.Random(17)
    rows = [(i, prose(r, lang, r.randrange(8, 60)), lang, None) for i, lang in enumerate(r.choices([*WORDS], k=60))]
    df = spark.createDataFrame(rows, DOCS)
    sample = language_id.training_sample(df, F.lit(True), 25, "doc_id", "text", "lang")
    model = language_id.fit(df, F.lit(True), per_class=25, landmarks=12, ridge=1e-3)
    text_of = {}
    grams = language_id.Grams()
    for _, t, _, _ in rows:
        grams.fill(t)
        text_of[np.flatnonzero(grams.mark).astype(np.int32).tobytes()] = gram_set(t)
    sets = [(lang, text_of[c.tobytes()]) for lang, c in sample]
    languages = sorted({lang for lang, _ in sets})
    own = {x: [s for lang, s in sets if lang == x] for x in languages}
    marks = [s for turn in range(25) for x in languages for s in own[x][turn : turn + 1]][:12]
    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    k = np.array([[kernel(a, b) for b in marks] for _, a in sets])
    among = np.array([[kernel(a, b) for b in marks] for a in marks])
    target = np.array([[1.0 if lang == x else -1.0 for x in languages] for lang, _ in sets])
    weights = np.linalg.solve(k.T @ k + 1e-3 * len(sets) * among + 1e-8 * len(sets) * np.eye(len(marks)), k.T @ target)
    test = [prose(r, lang, 30) for lang in WORDS for _ in range(5)]
    want = np.array([[kernel(gram_set(t), b) for b in marks] for t in test]) @ weights
    presence, sizes = np.zeros((len(test), len(model.codes)), np.float32), np.zeros(len(test))
    for i, t in enumerate(test):
        _, sizes[i] = grams.fill(t)
        presence[i] = grams.mark[model.codes]
    assert model.languages == tuple(languages) and np.abs(model.scores(presence, sizes) - want).max() < 5e-3


def test_labels_of_held_out_rows_are_not_learned(spark):
    r = random.Random(9)
    rows = [(i, prose(r, lang, 60), lang, None) for i, lang in enumerate(r.choices([*WORDS], k=120))]
    df = spark.createDataFrame(rows, DOCS)
    lied = df.withColumn("lang", F.when(language_id.held_out(), "xx").otherwise(F.col("lang")))
    assert {x.lang_pred for x in language_id.op3(lied).collect()} <= {*WORDS}


def test_empty_tables(empty):
    assert suffix_dedup.op4(empty).count() == minhash_dedup.op10(empty).count() == secret_scan.op6(empty).count() == language_id.op3(empty).count() == 0


def test_ids_have_to_be_whole_numbers(spark):
    with pytest.raises(TypeError, match="whole number"):
        minhash_dedup.near_duplicates(spark.createDataFrame([("a", "some text")], "doc_id string, text string"))
    got = minhash_dedup.near_duplicates(spark.createDataFrame([(7, "some text"), (3, "some text")], "doc_id int, text string")).collect()
    assert sorted((r.doc_id, r.class_id, r.kept) for r in got) == [(3, 3, True), (7, 3, False)]


def test_cells_look_for_neighbours_not_their_members(spark, monkeypatch):
    """Around a large star, what lists neighbouring cells stands on the cells: no member is multiplied by nine."""
    r = random.Random(8)
    texts = [prose(r, "en", 60) for _ in range(40)]
    texts = [t for x in texts for t in (x, x + " more")]
    df = spark.createDataFrame([(0, 100 + i, t) for i, t in enumerate(texts)], "first long, node long, text string")
    members = df.withColumns({"label": F.col("node"), "asks": F.col("node") > 100, "elements_n": F.lit(60).cast("long"), "distance": F.lit(0.5)}).drop("text")
    plans, rows, stage = {}, {}, minhash_dedup.stage_table

    def spy(table, name):
        plans[name] = table._jdf.queryExecution().analyzed().toString()
        out = stage(table, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(minhash_dedup, "stage_table", spy)
    found = minhash_dedup.tile_links(members, df.select("node", "text"), 0.8, 5, True)
    assert all("struct(size" not in line for line in plans["tiles"].splitlines() if "Generate" in line)
    assert rows["sizes"] == 1 and rows["cells"] == 1
    assert {frozenset((x.a, x.b)) for x in found.collect()} == {frozenset((100 + i, 101 + i)) for i in range(0, 80, 2)}
