"""A training-data pipeline in five stages, each one operator over all that the stage before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import language_id, minhash_dedup, packing, secret_scan, suffix_dedup
from ridgeline.llm.common import stage_table, table

#: A text whose best language has a share below this many times chance (one by the number of languages) is as good as unidentified.
LEAST_LIFT = 1.2
#: Bytes of a repeated passage, and of the anchors that find it: passages of over fifty words are longer than that, licence lines shorter.
PASSAGE, ANCHOR = 240, 120


def counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """n_chars follows the text where a stage has changed it."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(columns)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an identified language; those without a letter, or like no language that was learned, go."""
    model = language_id.fit(docs.select("doc_id", "text", "lang"), language_id.teaching())
    found = language_id.identify(docs.withColumnsRenamed({c: f"in_{c}" for c in docs.columns}), model, text_col="in_text")
    least = LEAST_LIFT / len(model.languages) if model and len(model.languages) > 1 else 0.0
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return kept.select([F.col(f"in_{c}").alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, or of those without any id one. Texts without a word stay."""
    classes = stage_table(minhash_dedup.text_classes(docs.select("doc_id", "text")), "classes").withColumnsRenamed({"same": "_same", "head": "_head", "class_id": "_class", "n": "_n"})
    named = docs.withColumn("_same", minhash_dedup.text_digest(F.col("text")))
    heads = classes.where("_same = _head")
    kept = named.join(heads, (named["_same"] == heads["_same"]) & named["doc_id"].eqNullSafe(heads["_class"]), "left_semi").dropDuplicates(["doc_id", "_same"])
    return kept.select(docs.columns).unionByName(docs.where(~minhash_dedup.worded(F.col("text"))))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of PASSAGE bytes that stand anywhere else too; documents of which nothing is left go."""
    cut = suffix_dedup.remove_repeats(docs, length=PASSAGE, core=ANCHOR)
    return counted(cut.where(F.length(F.trim("text")) > 0), docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a mark in the place of each secret."""
    return counted(secret_scan.redact_secrets(docs), docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document goes in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", languages),
    ("minhash_near_dedup", near_copies),
    ("suffix_array_dedup", repeats),
    ("secret_scan", secrets),
    ("best_fit_packing", sequences),
]

#: String kernels, signatures, transforms and tokenisers aren't SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return docs
