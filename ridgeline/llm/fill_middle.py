"""Fill-in-the-middle transformation, cut at units by word-parallel arithmetic.

A unit is a run of letters A-Z, a-z, or one other character. Texts are laid out as UTF-8 in 64-bit words, each text from a word of its
own. Arithmetic on whole words marks the bytes at which a unit ends, one bit a byte; the words' bit counts, summed up, tell in which word
the k-th unit ends (a binary search), and clearing lowest bits selects the byte within the word. No unit is ever made as an object.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm.common import append_columns

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ONES = np.uint64(0x0101010101010101)
HIGH = np.uint64(0x80) * ONES
ONE, EIGHT, TOP = np.uint64(1), np.uint64(8), np.uint64(56)
#: The marks of the first r bytes of a word, r = 0 to 8.
FIRST = np.array([(1 << 8 * r) - 1 & int(HIGH) for r in range(9)], dtype=np.uint64)


def of_next_byte(marks: np.ndarray) -> np.ndarray:
    """For each byte the mark of the byte after it (little-endian words)."""
    after = marks >> EIGHT
    after[:-1] |= marks[1:] << TOP
    return after


def letter_marks(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that is A-Z or a-z."""
    low = (words | np.uint64(0x20) * ONES) & ~HIGH
    from_a, beyond_z = low + np.uint64(0x80 - ord("a")) * ONES, low + np.uint64(0x7F - ord("z")) * ONES
    return from_a & ~beyond_z & ~words & HIGH


class Units:
    """Unit ends and characters of a list of UTF-8 texts."""

    def __init__(self, texts: list[bytes]):
        lens = np.array([len(t) for t in texts], dtype=np.int64)
        held = lens // 8 + 1  # at least one byte of zero follows a text, which neither continues a character nor is a letter
        self.first = np.cumsum(held) - held
        words = np.frombuffer(b"".join(t.ljust(int(8 * n), b"\0") for t, n in zip(texts, held, strict=True)), dtype=np.uint64)
        letters, within = letter_marks(words), words & ~(words << ONE) & HIGH  # bytes 10xxxxxx go on with a character
        last = self.first + held - 1
        self.ends = HIGH & ~(letters & of_next_byte(letters) | of_next_byte(within))
        self.starts = HIGH & ~within
        for marks in (self.ends, self.starts):
            marks[last] &= FIRST[lens % 8]
        self.units_to, self.chars_to = (np.concatenate(([0], np.cumsum(np.bitwise_count(m), dtype=np.int64))) for m in (self.ends, self.starts))
        self.count = self.units_to[last + 1] - self.units_to[self.first]

    def byte_after(self, k: np.ndarray) -> np.ndarray:
        """The byte offset in each text after its first k units."""
        target = self.units_to[self.first] + k
        word = np.maximum(np.searchsorted(self.units_to, target, side="left") - 1, self.first)
        left = target - self.units_to[word]
        marks = self.ends[word]
        for _ in range(7):  # all but the left-th lowest mark are cleared
            marks = np.where(left > 1, marks & (marks - ONE), marks)
            left = left - 1
        lowest = marks & (~marks + ONE)
        return np.where(k > 0, 8 * (word - self.first) + np.bitwise_count(lowest - ONE).astype(np.int64) // 8 + 1, 0)

    def chars_before(self, at: np.ndarray) -> np.ndarray:
        """How many characters begin before a byte offset of each text."""
        word = self.first + at // 8
        inside = np.bitwise_count(self.starts[word] & FIRST[at % 8]).astype(np.int64)
        return self.chars_to[word] + inside - self.chars_to[self.first]


def draws(seed: int, ids: list) -> np.ndarray:
    """Four hashed unsigned 32-bit numbers for each id: the first digits of the SHA-256 of seed:id."""
    raw = b"".join(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(raw, dtype=">u4").astype(np.int64).reshape(-1, 4)


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain: int = 10, spm: int = 20) -> DataFrame:
    """Adds n (units), form, prefix_chars, middle_chars and output to docs, dropping the text.

    Two hashed cuts between units part a text into prefix, middle and suffix. form is plain for `plain` of a hundred ids, and for texts that are
    empty or hold one of the marks, whose output is the text itself; the other texts are written with the marks as psm (prefix, suffix, middle)
    or, `spm` of a hundred of them, as spm (suffix, prefix, middle). Character counts are null where form is plain.
    A null text counts as empty, a null id as the word null; rows with equal ids and texts come out equal. Other columns pass through; one that has a
    result's name is replaced. An empty table gives an empty table. Rows stay in their partition, so no group of copies or source is gathered.
    Memory follows slices of a batch, or the longest text.
    """

    def make():
        def f(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = [t.encode() for t in batch.column(text_col).fill_null("").to_pylist()]
            units, h = Units(texts), draws(seed, batch.column(id_col).to_pylist())
            n = units.count
            cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
            a, b = units.byte_after(cuts[:, 0]), units.byte_after(cuts[:, 1])
            marked = np.array([not t or b"<P>" in t or b"<S>" in t or b"<M>" in t for t in texts], dtype=bool)
            form = np.where(marked | (h[:, 2] % 100 >= 100 - plain), "plain", np.where(h[:, 3] % 100 < spm, "spm", "psm"))
            chars_a, chars_b = units.chars_before(a), units.chars_before(b)
            out = []
            for t, kind, i, j in zip(texts, form.tolist(), a.tolist(), b.tolist(), strict=True):
                if kind == "psm":
                    t = b"".join((b"<P>", t[:i], b"<S>", t[j:], b"<M>", t[i:j]))
                elif kind == "spm":
                    t = b"".join((b"<S>", t[j:], b"<P>", t[:i], b"<M>", t[i:j]))
                out.append(t)
            none = form == "plain"
            written = pa.array(out, pa.binary()).cast(pa.string())
            return [pa.array(n), pa.array(form.tolist(), pa.string()), pa.array(chars_a, mask=none), pa.array(chars_b - chars_a, mask=none), written]

        return f

    added = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType(), "output": T.StringType()}
    return append_columns(docs, added, make, drop=[text_col])


def restored(output: Column, form: Column) -> Column:
    """The text that fill_middle() was given, from its output and form alone.

    A text with a mark in it is plain, and no mark ends as one begins, so the first of each mark is the one that was written.
    """

    def parted(rest: Column, mark: str) -> tuple[Column, Column]:
        head = F.substring_index(rest, mark, 1)
        return head, F.substr(rest, F.length(head) + len(mark) + 1)

    body = F.substr(output, F.lit(len(PREFIX) + 1))
    one, rest = parted(body, SUFFIX)
    two, middle = parted(rest, MIDDLE)
    psm = F.concat(one, middle, two)
    one, rest = parted(body, PREFIX)
    two, middle = parted(rest, MIDDLE)
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(two, middle, one))


def op11(docs: DataFrame) -> DataFrame:
    """The digest query: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    made = fill_middle(docs.select("doc_id", "text"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    )


SQL = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id::VARCHAR) AS h FROM documents
), drawn AS (
  SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS c2,
    ('0x' || substr(h, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS h4
  FROM t
), cut AS (
  SELECT *, array_to_string(list_slice(u, 1, least(c1, c2)), '') AS p, array_to_string(list_slice(u, least(c1, c2) + 1, greatest(c1, c2)), '') AS m,
    array_to_string(list_slice(u, greatest(c1, c2) + 1, n), '') AS s,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM cut
"""
