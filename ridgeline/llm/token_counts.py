"""Token counts with the whole-token shortcut.

Before the job, each vocabulary string is tried alone: if it is one pre-token and encodes to exactly its own id, then a
pre-token equal to it always counts one, because pre-tokens are encoded independently of each other. In the tasks, texts
are split into pre-tokens; those in the proven set count one without any merging, and only the rest are merged (by the
library, once for each distinct string that a worker meets while its bounded memo lasts).
"""

from __future__ import annotations

import functools
import itertools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from ridgeline.llm.common import append_columns, pieces, stretches

#: The pre-token pattern of byte-level vocabularies, for texts of Latin letters, digits, marks and common punctuation.
#: There the character classes are spelled out, so that the standard library's matcher, several times faster than
#: Unicode property lookup, agrees with the tokenizer's own one.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼-¾"
SPACES = "\t-\r \x85\xa0"
PRETOKEN = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)
#: A character outside the range in which PRETOKEN holds.
FOREIGN = re.compile("[^\x00-ɏ‐-‧‰-⁞€]")
#: The same for any text, for libraries whose character classes are those of the regex module.
ANY_PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
MEMO_ENTRIES, MEMO_CHARS, STRETCH = 400_000, 64, 1 << 20


@functools.lru_cache(maxsize=4)
def load(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def whole_tokens(path: str) -> frozenset[str]:
    """The vocabulary strings proven to be a single pre-token that encodes alone as one token, its own."""
    tok = load(path)
    special = {t.content for t in tok.get_added_tokens_decoder().values()}
    ids = sorted(tok.get_vocab(with_added_tokens=False).values())
    strings = tok.decode_batch([[i] for i in ids], skip_special_tokens=False)
    # a piece of a multi-byte character decodes to a replacement mark, whose encoding is not the piece: it drops out
    found = tok.encode_batch_fast(strings, add_special_tokens=False)
    return frozenset(
        s
        for i, s, e in zip(ids, strings, found, strict=True)
        if s and s not in special and e.ids == [i] and len(tok.pre_tokenizer.pre_tokenize_str(s)) == 1
    )


class Counts(dict):
    """Token counts by pre-token: the proven ones, and a bounded memo of merged ones."""

    def __init__(self, whole: frozenset[str], tok: Tokenizer):
        super().__init__(dict.fromkeys(whole, 1))
        self.tok, self.room = tok, len(whole) + MEMO_ENTRIES

    def merge(self, words: set[str]) -> None:
        """Memoises those of the words that aren't known; short ones only, so that the memo is bounded in bytes."""
        if len(self) > self.room:
            for k in [*itertools.islice(iter(self), self.room - MEMO_ENTRIES, None)]:
                del self[k]
        new = [w for w in words if w not in self and len(w) <= MEMO_CHARS]
        if new:
            self.update(zip(new, (len(e) for e in self.tok.encode_batch_fast(new, add_special_tokens=False)), strict=True))

    def __missing__(self, word: str) -> int:
        return len(self.tok.encode(word, add_special_tokens=False))


def pretokens(tok: Tokenizer, text: str) -> list[str]:
    """The pre-tokens of a text of any script; the library's own splitter takes over where PRETOKEN doesn't hold."""
    if FOREIGN.search(text) is None:
        return PRETOKEN.findall(text)
    return [text[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(text)]


def text_counter(path: str, whole: frozenset[str]):
    """A function from a list of texts to their token counts. A special string within a text is one token and parts what is around it."""
    tok = load(path)
    counts = Counts(whole, tok)
    special = [t.content for t in tok.get_added_tokens_decoder().values()]
    parting = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or "(?!)")
    one = counts.__getitem__

    def split(text: str) -> tuple[list[str], int]:
        if not any(s in text for s in special):
            return pretokens(tok, text), 0
        parts = parting.split(text)
        return [w for p in parts for w in pretokens(tok, p)], len(parts) - 1

    def of(texts: list[str]) -> list[int]:
        found = [*map(split, texts)]
        counts.merge(set().union(*(words for words, _ in found)))
        return [n + sum(map(one, words)) for words, n in found]

    def count(texts: list[str]) -> list[int]:
        out: list[int] = []
        for run in pieces(texts):
            *short, end = run
            out += of(short)
            out.append(sum(of([part])[0] for part in stretches(end, STRETCH)))
        return out

    return count


def count_tokens(docs: DataFrame, tokenizer_path: str, text_col: str = "text", limit: int = 512) -> DataFrame:
    """Adds n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) to docs, dropping the text.

    Counts equal the library's, without added tokens, whatever the script or length. Null and empty texts have 0 bytes
    and 0 tokens. Repeated rows are counted each; an empty table gives an empty table. Other columns pass through; one
    that has a result's name is replaced. Rows never leave their partition, so neither copies nor a hot source skew it.
    The proven set that is broadcast is bounded by the vocabulary.
    """
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(tokenizer_path))

    def make():
        count = text_counter(tokenizer_path, whole.value)

        def f(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = batch.column(text_col).fill_null("")
            n = np.array(count(texts.to_pylist()), dtype=np.int64)
            return [pc.binary_length(texts.cast(pa.large_binary())).cast(pa.int64()), pa.array(n), pa.array(n > limit)]

        return f

    return append_columns(
        docs,
        {"n_bytes": T.LongType(), "n_tokens": T.LongType(), "over_limit": T.BooleanType()},
        make,
        drop=[text_col],
    )


def op1(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """The digest query: doc_id, n_bytes, n_tokens, over_limit."""
    found = count_tokens(docs.select("doc_id", "text"), tokenizer_path)
    return found.select("doc_id", "n_bytes", "n_tokens", F.col("over_limit"))
