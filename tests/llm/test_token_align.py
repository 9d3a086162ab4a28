"""Cross-tokenizer alignment against the definition, token by token over bytes."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ridgeline.llm import token_align
from ridgeline.llm.token_align import Windows

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = ["▁ marked", " two  spaces   three", "tab\tand\nline\r\n", "<unk> <s> </s> <|endoftext|>", "<0x41>", "\0nul", "x " * 700, "日本" * 300, "😀😀 é́", "a b　c", "trailing ", "ﬁ ligature ½"]


def tokens():
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    letter = {c: b for b, c in zip([*range(33, 127), *range(161, 173), *range(174, 256)], map(chr, [*range(33, 127), *range(161, 173), *range(174, 256)]), strict=True)}
    letter |= {chr(256 + i): b for i, b in enumerate([b for b in range(256) if b not in letter.values()])}

    def of(text):
        a = tok.encode(" " + text, add_special_tokens=False)
        left = [bytes(letter[c] for c in t) for t in a.tokens]
        b = sp.encode(text)
        pieces = [sp.id_to_piece(i) for i in b]
        right = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in pieces]
        want = b" " + text.encode()
        if not text or b"".join(left) != want or b"".join(right) != want:
            return [], [], [], []
        return a.ids, left, b, right

    return of


def by_hand(texts):
    """The contract's columns for each text."""
    of = tokens()
    rows, linked = [], []
    for t in texts:
        a, left, b, right = of(t or "")
        ends_a, ends_b = np.cumsum([len(x) for x in left]).tolist() if a else [], np.cumsum([len(x) for x in right]).tolist() if b else []
        both = sorted(set(ends_a) & set(ends_b))
        groups, i, j = [], 0, 0
        for e in both:
            k, m = ends_a.index(e, i) + 1, ends_b.index(e, j) + 1
            groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
            i, j = k, m
        links, low = [], 0
        for x, ex, lx in zip(a, ends_a, map(len, left), strict=True):
            while low < len(b) and ends_b[low] <= ex - lx:
                low += 1
            k = low
            while k < len(b) and ends_b[k] - len(right[k]) < ex:
                links.append((x, b[k]))
                k += 1
        linked.append(links)
        rows.append([len(a), len(b), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""])
    count = Counter(p for links in linked for p in set(links))
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    return [(*r[:4], sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), r[4]) for r, links in zip(rows, linked, strict=True)]


@pytest.mark.parametrize("block", [token_align.BLOCK, 3000])
def test_rows_equal_the_definition(spark, docs, texts, block, monkeypatch):
    more = spark.createDataFrame([(1000 + i, t, "en", "clash") for i, t in enumerate(ODD)], docs.schema)
    monkeypatch.setattr(token_align, "BLOCK", block)
    given = [*texts, texts[0], texts[4], *ODD]
    ids = [*range(len(texts)), 0, None, *range(1000, 1000 + len(ODD))]
    rows = token_align.op13(docs.unionByName(more).withColumnRenamed("lang", "count"), A, B).collect()
    want = [(i, *r) for i, r in zip(ids, by_hand(given), strict=True)]
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    zeros = [r for r in rows if not r.n_a]
    assert len(zeros) >= 3 and all(r.groups_sha256 == "" and r.n_links == 0 for r in zeros)


def test_windows_are_aligned_once_for_each_tuple(monkeypatch):
    sides = token_align.loaded(A, B)
    made = []
    monkeypatch.setattr(token_align, "Windows", lambda *x: made.append(Windows(*x)) or made[-1])
    got = token_align.Aligned(["the cat sat on the cat. " * 50, None, "the cat sat on the cat. " * 9], sides)
    assert len(made) == 1 and len(made[0].texts) < 12 and got.n_groups[0] > 200 and got.n_groups[1] == 0
    assert all(t.endswith(b";") for t in made[0].texts)


def test_codes_are_equal_for_equal_tuples_only():
    r = np.random.default_rng(1)
    tuples = [(tuple(r.integers(0, 3, n)), tuple(r.integers(0, 3, m))) for n, m in r.integers(1, 5, (3000, 2))]
    ids = np.array([x for a, b in tuples for x in (*a, *b)], dtype=np.int32)
    code = token_align.tuple_codes(ids, np.array([len(a) for a, _ in tuples]), np.array([len(b) for _, b in tuples]))
    assert len(set(code.tolist())) == len(set(tuples)) == len(set(zip(code.tolist(), tuples, strict=True)))


def test_empty_table(spark, empty):
    assert token_align.op13(empty, A, B).collect() == []
