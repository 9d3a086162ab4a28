"""Language identification with string kernels.

A text is the set of character n-grams (n = 1, 2, 3) that its letters form, non-letters being one blank (the blended
spectrum, presence only); the kernel of two texts is the cosine of their sets. Landmark texts from a bounded labelled sample
span a Nyström approximation, in which one kernel ridge regression for each language against the rest is solved. Texts are
scored in batches: presence matrix x landmark matrix, normed, x coefficient matrix.
"""

from __future__ import annotations

import dataclasses
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm.common import append_columns

#: Six bits a character: blank, the 26 letters, and 36 places that other letters share by code point.
BITS = 6
CODES = (1 << 3 * BITS) + (1 << 2 * BITS) + (1 << BITS)
SALT = 20_240_501


@functools.lru_cache(maxsize=1)
def alphabet() -> np.ndarray:
    """The six-bit code of each code point's lower-case form; 0 for all but letters."""
    table = np.zeros(0x110000, dtype=np.uint8)
    letters = np.array([c for c in range(0x110000) if chr(c).isalpha()])
    table[letters] = 28 + letters % 36
    lower = np.array([ord(x) if len(x := chr(c).lower()) == 1 else c for c in letters])
    table[letters] = 28 + lower % 36
    latin = (lower >= 97) & (lower <= 122)
    table[letters[latin]] = 2 + lower[latin] - 97
    return table


class Grams:
    """The distinct n-gram codes of one text after another, through one scratch bitmap."""

    STRIDE = 1 << 20

    def __init__(self):
        self.mark = np.zeros(CODES, dtype=bool)
        self.table = alphabet()

    def fill(self, text: str) -> tuple[bool, int]:
        """Marks the codes of text; returns whether it has a letter, and the number of distinct codes."""
        self.mark[:] = False
        letter = False
        for k in range(0, len(text), self.STRIDE):
            part = text[max(0, k - 2) : k + self.STRIDE]
            c = self.table[np.frombuffer(part.encode("utf-32-le"), dtype=np.uint32)].astype(np.int32)
            letter = letter or bool(c.any())
            two = c[:-1] << BITS | c[1:]
            self.mark[c] = True
            self.mark[(1 << BITS) + two] = True
            self.mark[(1 << BITS) + (1 << 2 * BITS) + (two[:-1] << BITS | c[2:])] = True
        return letter, int(np.count_nonzero(self.mark))


@dataclasses.dataclass(frozen=True)
class Model:
    """codes: the n-grams of the landmarks; landmarks: a column of presence for each landmark, over its norm; coefficients: landmark by language."""

    languages: tuple[str, ...]
    codes: np.ndarray
    landmarks: np.ndarray
    coefficients: np.ndarray

    def scores(self, presence: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        kernel = (presence @ self.landmarks) / np.sqrt(np.maximum(sizes, 1))[:, None]
        return kernel @ self.coefficients


def training_sample(docs: DataFrame, allowed: Column, per_class: int, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, np.ndarray]]:
    """About per_class labelled texts of each language, as distinct n-gram codes, chosen by a hash of the id.

    Only these sets reach the driver: at most 1.3 x per_class + 50 a language, each bounded by the number of codes.
    """
    labelled = docs.where(allowed & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = labelled.groupBy(F.col(lang_col).alias("lang")).count().collect()
    if not sizes:
        return []
    scale = 1 << 30
    share = {r["lang"]: min(scale, int(scale * (1.3 * per_class + 20) / r["count"])) for r in sizes}
    small = docs.sparkSession.createDataFrame([*share.items()], "lang string, share long")
    drawn = labelled.select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.lit(SALT), F.col(id_col)), F.lit(scale)).alias("draw")
    )
    chosen = drawn.join(F.broadcast(small), "lang").where("draw < share").drop("share")

    def make():
        grams = Grams()

        def codes(text: str) -> bytes:
            return np.flatnonzero(grams.mark).astype(np.int32).tobytes() if grams.fill(text)[0] else b""

        return lambda batch: [pa.array([codes(t) for t in batch.column("text").to_pylist()], pa.binary())]

    rows = append_columns(chosen, {"codes": T.BinaryType()}, make, drop=["text"]).where("length(codes) > 0").collect()
    out, taken = [], dict.fromkeys(share, 0)
    for r in sorted(rows, key=lambda r: (r["draw"], r["lang"], bytes(r["codes"]))):
        if taken[r["lang"]] < per_class:
            taken[r["lang"]] += 1
            out.append((r["lang"], np.frombuffer(bytes(r["codes"]), dtype=np.int32)))
    return out


def fit(
    docs: DataFrame,
    allowed: Column,
    per_class: int = 200,
    landmarks: int = 120,
    ridge: float = 1e-3,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> Model | None:
    """Fits the kernel regressions on a sample of the allowed rows that have a text with a letter and a language.

    per_class bounds the rows for each language, landmarks the number of landmark texts (shared out among the languages in
    turn). None if there is nothing to learn from.
    """
    sample = training_sample(docs, allowed, per_class, id_col, text_col, lang_col)
    if not sample:
        return None
    languages = tuple(sorted({lang for lang, _ in sample}))
    own = {lang: [c for x, c in sample if x == lang] for lang in languages}
    marks = [c for turn in range(per_class) for lang in languages for c in own[lang][turn : turn + 1]][: max(landmarks, len(languages))]
    codes = np.unique(np.concatenate(marks))

    def matrix(sets: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(sets), len(codes)), dtype=np.float32)
        for i, s in enumerate(sets):
            at = np.searchsorted(codes, s)
            at[at == len(codes)] = 0
            out[i, at[codes[at] == s]] = 1
        return out

    left = (matrix(marks) / np.sqrt([len(c) for c in marks])[:, None]).T.astype(np.float32)
    kernel = (matrix([c for _, c in sample]) @ left).astype(np.float64) / np.sqrt([len(c) for _, c in sample])[:, None]
    among = (matrix(marks) @ left).astype(np.float64) / np.sqrt([len(c) for c in marks])[:, None]
    target = np.where(np.array([lang for lang, _ in sample])[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    system = kernel.T @ kernel + ridge * len(sample) * among + 1e-8 * len(sample) * np.eye(len(marks))
    return Model(languages, codes, left, np.linalg.solve(system, kernel.T @ target).astype(np.float32))


def predictor(model: Model | None, rows: int = 256, sharpness: float = 2.0):
    """A function from texts to (language or 'und', score)."""
    grams = Grams()

    def predict(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        langs, scores = ["und"] * len(texts), np.zeros(len(texts))
        if model is None:
            return langs, scores
        presence, sizes = np.zeros((rows, len(model.codes)), dtype=np.float32), np.zeros(rows)
        waiting: list[int] = []

        def flush() -> None:
            n = len(waiting)
            if n:
                f = sharpness * model.scores(presence[:n], sizes[:n])
                p = np.exp(f - f.max(axis=1, keepdims=True))
                best = f.argmax(axis=1)
                scores[waiting] = 1 / p.sum(axis=1)
                for i, k in zip(waiting, best, strict=True):
                    langs[i] = model.languages[k]
                waiting.clear()

        for i, t in enumerate(texts):
            if t:
                letter, n = grams.fill(t)
                if letter:
                    presence[len(waiting)], sizes[len(waiting)] = grams.mark[model.codes], n
                    waiting.append(i)
                    if len(waiting) == rows:
                        flush()
        flush()
        return langs, scores

    return predict


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """Adds lang_pred and score (the softmax share of the best language, 0 to 1) from each whole text alone.

    Texts that are null or have no letter get 'und' and 0; so does every text if nothing could be learned. Copies get equal
    answers. Other columns pass through; those with the results' names are replaced. Rows stay in their partition; the model
    that is broadcast is bounded by the landmarks times the number of n-gram codes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        predict = predictor(shared.value)

        def f(batch: pa.RecordBatch) -> list[pa.Array]:
            langs, scores = predict(batch.column(text_col).to_pylist())
            return [pa.array(langs, pa.string()), pa.array(scores)]

        return f

    return append_columns(docs, {"lang_pred": T.StringType(), "score": T.DoubleType()}, make)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that never teach: crc32 of the id as text leaves 1 on division by 3. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def teaching(id_col: str = "doc_id") -> Column:
    """Rows that may teach; a null id may not, for its remainder isn't known."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1, F.lit(False))


def op3(docs: DataFrame) -> DataFrame:
    """The digest query: doc_id, held_out, lang_pred, score."""
    model = fit(docs.select("doc_id", "text", "lang"), teaching())
    found = identify(docs.select("doc_id", "text"), model).drop("text")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
