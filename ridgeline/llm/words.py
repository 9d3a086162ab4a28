"""Word shingles of whole batches of texts, by numpy over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

ODD = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0xD6E8FEB86659FD93)
STRIDE = 1 << 20
#: Bytes in lower case (A-Z only); 0 for white space.
FOLD = np.arange(256, dtype=np.uint64)
FOLD[ord("A") : ord("Z") + 1] += np.uint64(32)
FOLD[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = 0


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


SYMBOL = mix(FOLD * ODD)
POWERS, INVERSES = (
    np.cumprod(np.concatenate(([np.uint64(1)], np.full(STRIDE, b, dtype=np.uint64))), dtype=np.uint64)
    for b in (BASE, np.uint64(pow(int(BASE), -1, 1 << 64)))
)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of data (runs of bytes that aren't white space), A-Z in lower case, and where they begin."""
    parts, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    k = 0
    while k < len(data):
        e = min(len(data), k + STRIDE)
        if e < len(data):
            # cut at white space; a single word longer than the stride is cut inside, at places counted from its own start
            spaces = np.flatnonzero(FOLD[data[k:e]] == 0)
            e = k + int(spaces[-1]) + 1 if len(spaces) else e
        part = data[k:e]
        inside = FOLD[part] > 0
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
        start, end = edge[::2], edge[1::2]
        if len(start):
            # a polynomial in each word's own places: sums up to the word's end, moved back to its start
            sums = np.cumsum(SYMBOL[part] * POWERS[: len(part)], dtype=np.uint64)
            before = np.where(start > 0, sums[start - 1], np.uint64(0))
            parts.append(mix((sums[end - 1] - before) * INVERSES[start] ^ (end - start).astype(np.uint64) * ODD))
            places.append(start + k)
        k = e
    return np.concatenate(parts), np.concatenate(places)


def joined(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of `width` words."""
    out = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
    for i in range(width):
        out = out * BASE + words[i : i + len(out)]
    return mix(out + np.uint64(width))


def shingle_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every run of `width` words, repeats included; of all words together where there are fewer; none without words."""
    words, _ = word_hashes(data)
    return joined(words, min(width, len(words))) if len(words) else words


def shingles_of(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of all texts in a row, and the text that each belongs to, ascending: as shingle_hashes() for each text."""
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw), dtype=np.uint8)
    words, place = word_hashes(data)
    if not len(words):
        return words, np.empty(0, np.int64)
    ends = np.cumsum([len(r) + 1 for r in raw])
    owner = np.searchsorted(ends, place, side="right")
    full = joined(words, width)
    same = owner[: len(full)] == owner[len(words) - len(full) :]
    hashes, of = full[same], owner[: len(full)][same]
    counts = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(counts) - counts
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        hashes = np.concatenate([hashes, *(joined(words[first[i] : first[i] + counts[i]], int(counts[i])) for i in short)])
        of = np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        hashes, of = hashes[order], of[order]
    return hashes, of


def text_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), dtype=np.uint8)
