import gc
import random
import tracemalloc

import public_tokenizers as P
import pyarrow as pa
from pyspark.sql import types as T

from ridgeline.llm import minhash_dedup, packing
from ridgeline.llm.common import append_columns, slices

from .conftest import prose


def test_workers_keep_nothing_for_an_operator_that_has_ended(spark):
    """Vocabularies and memo of the packing are gone in every worker where another operator's task begins."""
    r = random.Random(8)
    docs = spark.createDataFrame([(i, prose(r, "en", 40)) for i in range(64)], "doc_id long, text string").repartition(16)
    assert packing.token_pieces(docs, P.path("word_bpe_49k.json"), 4096, 1).count() == 64

    def make():
        held = sum(isinstance(x, packing.ChunkIds) for x in gc.get_objects())
        return lambda batch: [pa.array([held] * batch.num_rows, pa.int64())]

    seen = append_columns(docs, {"held": T.LongType()}, make).agg({"held": "max"}).first()[0]
    assert seen == 0


def test_the_packing_keeps_its_memo_from_task_to_task():
    path = P.path("word_bpe_49k.json")
    ids = packing.chunk_ids(path)
    assert packing.chunk_ids(path) is ids


def test_signing_takes_a_bounded_multiple_of_a_slice():
    r = random.Random(9)
    batch = pa.record_batch([[prose(r, "en", 400) for _ in range(1800)]], names=["text"])
    peaks = []
    for part in slices([batch], minhash_dedup.SIGNED):
        tracemalloc.start()
        minhash_dedup.sign_batch(part.column("text").to_pylist(), 5, 96, 24, True)
        peaks.append(tracemalloc.get_traced_memory()[1] >> 20)
        tracemalloc.stop()
    assert len(peaks) > 1 and max(peaks) < 60
