"""Secret scans over a trigram inverted index.

From each rule's pattern a Boolean query over trigrams is derived: what any match must contain. Each task indexes its texts
by the trigrams that the rules ask for (postings are bitmaps over the documents of the batch), intersects and unites the
postings as the queries say, and runs a rule's pattern over its candidates alone. A rule without mandatory trigrams, such
as a long run of hexadecimal digits, has no query: every text is its candidate.
"""

from __future__ import annotations

import dataclasses
import re
from re import _constants as op
from re import _parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm.common import append_columns


@dataclasses.dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of pattern count if `group` of them has at least `least` characters.

    scan: a pattern with the same accepted matches that is quicker to scan for, where there is one.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    flags: int = 0
    scan: str = ""


BASE_RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=8,
        flags=re.IGNORECASE | re.ASCII,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    # a run is matched whole, so a run of 32 or more is the same as a match of 32 or more
    Rule("hex", r"[0-9a-f]+", least=32, scan=r"[0-9a-f]{32,}"),
)
#: Well-known credential shapes that the base rules miss.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
RULES = BASE_RULES + MORE_RULES
MOST_STRINGS = 48

#: A query is True (anything may match), a trigram, or ("and" | "or", queries).


def both(a, b):
    return b if a is True else a if b is True else a if a == b else ("and", a, b)


def either(parts: list):
    parts = list(dict.fromkeys(parts))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", *parts)


def of_strings(strings: set[bytes]):
    """What a text holds that holds one of the strings."""
    found = []
    for s in sorted(strings):
        q = True
        for i in range(len(s) - 2):
            q = both(q, s[i : i + 3])
        found.append(q)
    return either(found)


def options(item) -> set[str] | None:
    """The characters of a class of a few."""
    chars: set[str] = set()
    for kind, x in item:
        if kind is op.LITERAL:
            chars.add(chr(x))
        elif kind is op.RANGE and x[1] - x[0] < 8:
            chars |= {chr(c) for c in range(x[0], x[1] + 1)}
        else:
            return None
    return chars if len(chars) <= 8 else None


def analyse(nodes) -> tuple[set[bytes] | None, object]:
    """(all strings that the nodes match, in lower case, if they are few; the query that every match fulfils)."""
    strings: set[bytes] = {b""}
    whole, query = True, True
    for kind, x in nodes:
        some, asked = None, True
        if kind is op.LITERAL:
            some = {chr(x).lower().encode()}
        elif kind is op.IN:
            chars = options(x)
            some = chars and {c.lower().encode() for c in chars}
        elif kind is op.SUBPATTERN:
            some, asked = analyse(x[3])
        elif kind is op.BRANCH:
            parts = [analyse(p) for p in x[1]]
            asked = either([q for _, q in parts])
            some = None if any(s is None for s, _ in parts) else set().union(*(s for s, _ in parts))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, most, inner = x
            some, asked = analyse(inner)
            if least == 0:
                asked = True
            if some is not None and least == most == 1:
                pass
            elif some is not None and (least, most) == (0, 1):
                some = some | {b""}
            else:
                if least and some is not None:
                    asked = both(asked, of_strings(some))
                some = None
        elif kind is op.AT:
            some = {b""}
        if some is not None and len(strings) * len(some) <= MOST_STRINGS:
            strings = {a + b for a in strings for b in some}
            continue
        query = both(both(query, of_strings(strings)), both(asked, True if some is None else of_strings(some)))
        strings, whole = {b""}, False
    if whole:
        return strings, of_strings(strings)
    return None, both(query, of_strings(strings))


def trigram_query(rule: Rule):
    """The Boolean trigram query of a rule, True if it has no mandatory trigrams. Trigrams are lower-case bytes."""
    return analyse(_parser.parse(rule.pattern, rule.flags))[1]


def trigrams(query) -> set[bytes]:
    return set() if query is True else {query} if isinstance(query, bytes) else set().union(*map(trigrams, query[1:]))


class Index:
    """Postings of the wanted trigrams, for batches of texts."""

    STRIDE = 1 << 21

    def __init__(self, wanted: set[bytes]):
        self.ids = {t: i + 1 for i, t in enumerate(sorted(wanted))}
        used = sorted({b for t in wanted for b in t})
        self.bits = max(1, len(used).bit_length())
        self.code = np.zeros(256, dtype=np.uint32)
        for i, b in enumerate(used):
            self.code[b] = i + 1
            self.code[ord(chr(b).upper()) if b < 128 else b] = i + 1
        self.table = np.zeros(1 << 3 * self.bits, dtype=np.uint16)
        for t, i in self.ids.items():
            a, b, c = (int(self.code[x]) for x in t)
            self.table[a << 2 * self.bits | b << self.bits | c] = i

    def postings(self, texts: pa.Array) -> np.ndarray:
        """found[i, d]: text d has the trigram with id i."""
        found = np.zeros((len(self.ids) + 1, len(texts)), dtype=bool)
        ends = np.concatenate(([0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)))).astype(np.int64)
        width = np.dtype(np.int64 if pa.types.is_large_string(texts.type) else np.int32)
        first = np.frombuffer(texts.buffers()[1], dtype=width)[texts.offset] if len(texts) else 0
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[first : first + ends[-1]]
        for k in range(0, max(0, len(data) - 2), self.STRIDE):
            c = self.code[data[k : k + self.STRIDE + 2]]
            ids = self.table[c[:-2] << np.uint32(2 * self.bits) | c[1:-1] << np.uint32(self.bits) | c[2:]]
            at = np.flatnonzero(ids)
            doc = np.searchsorted(ends, at + k, side="right") - 1
            inside = at + k + 2 < ends[doc + 1]
            found[ids[at[inside]], doc[inside]] = True
        return found

    def candidates(self, query, found: np.ndarray) -> np.ndarray:
        if query is True:
            return np.ones(found.shape[1], dtype=bool)
        if isinstance(query, bytes):
            return found[self.ids[query]]
        sides = [self.candidates(q, found) for q in query[1:]]
        return np.logical_and.reduce(sides) if query[0] == "and" else np.logical_or.reduce(sides)


def scanner(rules: tuple[Rule, ...]):
    """A function from an Arrow array of texts to the (kind, start, end) spans of each text, in code points."""
    queries = [trigram_query(r) for r in rules]
    patterns = [re.compile(r.scan or r.pattern, r.flags) for r in rules]
    index = Index(set().union(*map(trigrams, queries)))

    def scan(texts: pa.Array) -> list[list[tuple[int, int, int]]]:
        found = index.postings(texts)
        masks = [index.candidates(q, found) for q in queries]
        out = []
        for d in range(len(texts)):
            spans = []
            if own := [i for i, m in enumerate(masks) if m[d]]:
                text = texts[d].as_py()
                for i in own:
                    r = rules[i]
                    spans += [(m.start(), i, m.end()) for m in patterns[i].finditer(text) if m.end(r.group) - m.start(r.group) >= r.least]
                spans.sort()
            out.append(spans)
        return out

    return scan


SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
)
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", out: str = "spans") -> DataFrame:
    """Adds the spans of secrets in each whole text, by start and then in the order of the rules.

    Spans are code points with exclusive ends; spans of different rules may overlap, those of one rule don't. Null and empty
    texts have none. Other columns pass through; one with the name of the result is replaced. Rows stay in their
    partition; the index lives as long as its batch.
    """

    def make():
        scan = scanner(rules)

        def f(batch: pa.RecordBatch) -> list[pa.Array]:
            spans = scan(batch.column(text_col).fill_null(""))
            return [pa.array([[{"kind": rules[i].kind, "start": a, "end": b} for a, i, b in x] for x in spans], ARROW_SPANS)]

        return f

    return append_columns(docs, {out: SPANS}, make)


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Puts [kind] in the place of each secret (of overlapping ones, one mark for their union); other texts stay as they are."""

    def make():
        scan = scanner(rules)

        def f(batch: pa.RecordBatch) -> list[pa.Array]:
            column = batch.column(text_col)
            spans = scan(column.fill_null(""))
            if not any(spans):
                return [column]
            texts = column.to_pylist()
            for d, found in enumerate(spans):
                if found:
                    parts, end = [], 0
                    for a, i, b in found:
                        if a >= end:
                            parts += [texts[d][end:a], f"[{rules[i].kind}]"]
                        end = max(end, b)
                    texts[d] = "".join([*parts, texts[d][end:]])
            return [pa.array(texts, column.type)]

        return f

    return append_columns(docs, {text_col: T.StringType()}, make).select(docs.columns)


def op6(docs: DataFrame) -> DataFrame:
    """The digest query: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = scan_secrets(docs.select("doc_id", "text")).drop("text")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def line(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans")
    )
