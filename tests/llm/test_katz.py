"""Katz scores against the model by hand, with dictionaries over all n-grams."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import katz

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*WORD.findall((text or "").encode().translate(LOWER)), "END"]


def factors(counts):
    n = [sum(c == r for c in counts) for r in range(1, 7)]
    try:
        common = 6 * n[5] / n[0]
        d = [((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common) for r in range(1, 6)]
    except ZeroDivisionError:
        d = [0.0]
    if not all(0 < x < 1 for x in d):
        d = [(r - (n[0] + 1) / (n[0] + 2 * n[1] + 2)) / r for r in range(1, 6)]
    return lambda c: c * d[c - 1] if c <= 5 else float(c)


class ByHand:
    def __init__(self, texts, order):
        self.counts = [Counter() for _ in range(order)]
        for t in texts:
            s = ["BEGIN", *tokens(t)]
            for i in range(1, len(s)):
                for k in range(min(order, i + 1)):
                    self.counts[k][tuple(s[i - k : i + 1])] += 1
        self.keep = [factors(c.values()) for c in self.counts]
        self.n = sum(self.counts[0].values())
        self.after = [defaultdict(list) for _ in range(order)]
        for k, c in enumerate(self.counts):
            for g in c:
                self.after[k][g[:-1]].append(g[-1])
        self.memo = {}

    def total(self, h):
        k = len(h)
        got = sum(self.counts[k][(*h, w)] for w in self.after[k][h])
        left = got - sum(self.keep[k](self.counts[k][(*h, w)]) for w in self.after[k][h])
        return (got, left / got) if left > 1e-9 else (got + 1, 1 / (got + 1))

    def weight(self, h):
        if h not in self.memo:
            _, left = self.total(h)
            self.memo[h] = left / (1 - sum(self.p(w, h[1:]) for w in self.after[len(h)][h]))
        return self.memo[h]

    def p(self, w, h):
        k = len(h)
        if not k:
            total, left = self.total(())
            c = self.counts[0][(w,)]
            return self.keep[0](c) / total if c else left
        if not self.after[k].get(h):
            return self.p(w, h[1:])
        c = self.counts[k][(*h, w)]
        return self.keep[k](c) / self.total(h)[0] if c else self.weight(h) * self.p(w, h[1:])

    def score(self, text):
        s = ["BEGIN", *tokens(text)]
        k = len(self.counts) - 1
        return sum(math.log10(self.p(s[i], tuple(s[max(0, i - k) : i]))) for i in range(1, len(s)))


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


@pytest.mark.parametrize(("order", "block", "part", "spread"), [(2, katz.BLOCK, katz.PART, katz.SPREAD), (2, 40_000, 5000, 200), (3, 90_000, 7000, 300)])
def test_scores_equal_the_model_by_hand(spark, docs, texts, order, block, part, spread, monkeypatch):
    for name, value in (("BLOCK", block), ("PART", part), ("SPREAD", spread)):
        monkeypatch.setattr(katz, name, value)
    given = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[4])]
    learned = [t for i, t in given if i is not None and not held(i)]
    model = ByHand(learned, order)
    single = model.counts[0]
    v = len(single)
    rows = katz.score_texts(docs.withColumnRenamed("n_tokens", "payload"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, order).collect()
    want = {}
    for i, t in given:
        w = tokens(t)
        base = sum(math.log10((single[(x,)] + 1) / (model.n + v + 1)) for x in w)
        want[i] = (len(w), sum(single[(x,)] > 0 for x in w), model.n, base, model.score(t))
    assert len(rows) == len(given)
    for r in rows:
        n, known, total, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)


def test_probabilities_sum_to_one(docs, texts):
    """The model by hand, which the scores equal, is normalised over its words and the unknown one."""
    model = ByHand(texts[:40], 3)
    words = [g[0] for g in model.counts[0]]
    for h in [(), ("BEGIN",), (tokens(texts[0])[0],), tuple(tokens(texts[0])[:2]), tuple(tokens(texts[1])[3:5]), (b"never", b"seen")]:
        assert math.fsum(model.p(w, h) for w in [*words, b"never seen"]) == pytest.approx(1, abs=1e-9)


def test_op12_columns_and_gain_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = katz.op12(docs).collect()
    assert list(rows[0].asDict()) == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert len(rows) == docs.count() and all(r.held_out == held(r.doc_id) for r in rows)
    out = [r for r in rows if r.held_out]
    assert out and sum(r.score for r in out) > sum(r.base_score for r in out)


def test_words_hash_alike_wherever_they_stand(monkeypatch):
    text = ("Word wOrd " + "x" * 300 + " é\x1cb\0 end\r\n").encode() * 3
    whole, at = katz.hashed_words(np.frombuffer(text, np.uint8))
    assert [text[i : i + 1] for i in at[:5].tolist()] == [b"W", b"w", b"x", b"\xc3", b"e"]
    assert whole[0] == whole[1] and len(set(whole.tolist())) == 4 and whole[:5].tolist() * 3 == whole.tolist()
    for stride in (16, 64, 333):
        monkeypatch.setattr(katz, "STRIDE", stride)
        monkeypatch.setattr(katz, "POWERS", katz.powers(stride))
        again, places = katz.hashed_words(np.frombuffer(text, np.uint8))
        assert again.tolist() == whole.tolist() and places.tolist() == at.tolist()


def test_empty_table_and_nothing_to_learn_from(spark, empty, docs):
    assert katz.op12(empty).collect() == []
    rows = katz.score_texts(docs, F.lit(False)).collect()
    assert all(r.score == 0 and r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in rows)
    with pytest.raises(ValueError, match="order"):
        katz.score_texts(docs, F.lit(True), order=1)
