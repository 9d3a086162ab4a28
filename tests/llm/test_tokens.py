import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer

from ridgeline.llm import byte_bpe, packing, token_counts

BYTES, WORDS, RANKS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")


def test_counts_equal_the_library(docs, texts):
    tok = Tokenizer.from_file(BYTES)
    rows = token_counts.op1(docs, BYTES).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        t = texts[4 if r.doc_id is None else r.doc_id] or ""
        n = len(tok.encode(t, add_special_tokens=False))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 512)


def test_whole_tokens_are_proven():
    whole = token_counts.whole_tokens(BYTES)
    assert len(whole) > 40_000 and " the" in whole and "<|endoftext|>" not in whole


def test_character_classes_agree_with_the_tokenizers():
    count = token_counts.text_counter(BYTES, token_counts.whole_tokens(BYTES))
    ids = packing.chunk_ids(WORDS).all
    a, b = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)
    for c in [*range(0x250), *range(0x2000, 0x2070), 0x20AC, 0x301, 0x1E9E]:
        for t in (f"a{chr(c)}b", f" {chr(c)}{chr(c)}", f"{chr(c)} 1{chr(c)} X'S"):
            assert count([t]) == [len(a.encode(t, add_special_tokens=False))], hex(c)
            assert next(ids([t])) == np.array(b.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes(), hex(c)


def test_encoding_equals_the_library_and_round_trips(docs, texts):
    vocab = byte_bpe.vocabulary(RANKS)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})
    rows = byte_bpe.op7(docs, RANKS).collect()
    for r in rows:
        t = texts[4 if r.doc_id is None else r.doc_id] or ""
        ids = enc.encode_ordinary(t)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    both = byte_bpe.decode(byte_bpe.encode(docs.select("doc_id", "text"), RANKS), RANKS).collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in both)


def test_long_words_merge_as_short_ones_do(monkeypatch):
    vocab = byte_bpe.vocabulary(RANKS)
    r = random.Random(2)
    words = [b"abababcabcabababd" * 30, b"theonionerandthat" * 40, b"a" * 999, bytes(r.choice(b"etaoinshrdlu") for _ in range(1024)), "é".encode() * 500]
    short = [vocab.merge_matrix([w], 1 << 10)[0].tolist() for w in words]
    for block in (1, 2, 7, 64, 4096):
        monkeypatch.setattr(byte_bpe, "BLOCK", block)
        assert [vocab.merge_blocks(w).tolist() for w in words] == short


def check_packing(rows, texts, tok):
    seen, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        seen[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        own = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in seen[i]})
        assert own == [(k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    return len(bins)


def test_packing(docs, texts):
    rows = packing.op8(docs, WORDS).collect()
    n = check_packing(rows, texts, Tokenizer.from_file(WORDS))
    assert n <= -(-sum(r.length for r in rows) // 4096) + 1


def test_packing_plans_hold_every_histogram():
    r = np.random.default_rng(3)
    for lengths in (r.integers(1, 4097, 3000), r.integers(1, 40, 5000), np.full(1000, 1366), np.full(77, 4096), np.full(500, 2049), r.choice([1500, 2500, 1000], 900)):
        values, counts = np.unique(lengths, return_counts=True)
        h = dict(zip(values.tolist(), counts.tolist(), strict=True))
        held = defaultdict(int)
        plan, bound = packing.pack_histogram(h, 4096)
        for config, n in plan:
            assert sum(k * v for k, v in config.items()) <= 4096
            for k, v in config.items():
                held[k] += v * n
        assert held == h
        # no plan can need fewer than the total, the pieces over half, or the most of the smallest pieces that fit ask for
        least = max(int((lengths > 2048).sum()), -(-int(lengths.sum()) // 4096), -(-len(lengths) // (4096 // int(lengths.min()))))
        used = sum(n for _, n in plan)
        assert least <= used and bound <= used + 1e-6, "a dual value bounds every packing"
        assert used <= max(bound, least) * 1.02 + 1
    assert packing.pack_histogram({}, 4096) == ([], 0.0)


def brute_price(lengths, values, limits, capacity):
    best = np.zeros(capacity + 1)
    for x, v, n in zip(lengths, values, limits, strict=True):
        for _ in range(min(n, capacity // x)):
            best[x:] = np.maximum(best[x:], best[:-x] + v)
    return best[-1]


def test_pricing_equals_a_plain_knapsack():
    r = np.random.default_rng(8)
    for _ in range(200):
        capacity = int(r.integers(5, 60))
        lengths = np.sort(r.choice(np.arange(1, capacity + 1), int(r.integers(1, min(capacity, 9))), replace=False))
        values, limits = r.random(len(lengths)), r.integers(1, 9, len(lengths))
        take, value = packing.price(lengths, values, limits, capacity)
        assert (take <= limits).all() and (take * lengths).sum() <= capacity
        assert abs(value - (take * values).sum()) < 1e-9 and abs(value - brute_price(lengths, values, limits.tolist(), capacity)) < 1e-9


def test_chunks_of_every_script_encode_as_the_library_does():
    r = random.Random(11)
    parts = ["a", "B", "É", "İ", "Σ", "ς", "\x1c", "\x1f", " ", "  ", "\n", "\xa0", "\u0301", "e", "<|endoftext|>", "'s", "'LL", "12", "½", "ſ", "K", "中文", "한", "ᄒ", "ᅡ", "🙂", ".,", "\u3000", "\x85", "</w>", "Ω"]
    tok, ids = Tokenizer.from_file(WORDS), packing.chunk_ids(WORDS).all
    for _ in range(2000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(25)))
        assert next(ids([t])) == np.array(tok.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes(), ascii(t)


def test_counts_of_every_script_and_special_string_equal_the_library():
    r = random.Random(12)
    parts = ["a", " the", "É", "İ", "Σ", "\x1c", " ", "  ", "\n", "\xa0", "\u0301", "<|endoftext|>", "'s", "12", "½", "中文", " 한국", "привет", "🙂", ".,", "\u3000", "\x85", "\u0558", "\u088f"]
    tok, count = Tokenizer.from_file(BYTES), token_counts.text_counter(BYTES, token_counts.whole_tokens(BYTES))
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(25))) for _ in range(2000)]
    assert count(texts) == [len(tok.encode(t, add_special_tokens=False)) for t in texts]


def test_very_long_texts_in_stretches(monkeypatch):
    """Texts beyond the stretch are cut where white space begins; with a small stretch the results stay the library's."""
    r = random.Random(13)
    texts = [" ".join(r.choice(["the", "straße,", " ", "\n", "x" * 70, "日本", "1234", "it's"]) for _ in range(3000)), "ab" * 3000, "é " * 4000]
    for module in (packing, token_counts, byte_bpe):
        monkeypatch.setattr(module, "STRETCH", 512)
    a, b = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)
    vocab = byte_bpe.vocabulary(RANKS)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})
    count = token_counts.text_counter(BYTES, token_counts.whole_tokens(BYTES))
    for t in texts:
        assert count([t]) == [len(a.encode(t, add_special_tokens=False))]
        assert next(packing.chunk_ids(WORDS).all([t])) == np.array(b.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert byte_bpe.encode_batch(byte_bpe.Pool(vocab), [t, "x"])[0].as_py() == enc.encode_ordinary(t)


def test_empty_tables(empty):
    assert token_counts.op1(empty, BYTES).count() == byte_bpe.op7(empty, RANKS).count() == packing.op8(empty, WORDS).count() == 0
