"""What Python workers keep for later stages."""

import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spendtrace.llm import kept, oddsketch, packing
from spendtrace.llm.membership import maybe_member
from tests.llm.fixtures import documents

PATH = P.path("word_bpe_49k.json")


def test_one_thing_is_kept_at_a_time():
    made = []
    for key in ("a", "a", "b", "b", "a"):
        assert kept.kept(key, lambda: made.append(key) or key) == key
    assert made == ["a", "b", "a"]
    kept.release()
    assert not kept._kept


def holding(spark):
    """What a worker of a new task keeps: one task at a time, so the worker is the one before."""

    @F.arrow_udf("long")
    def count(x: pa.Array) -> pa.Array:
        return pa.array([len(kept._kept)] * len(x), pa.int64())

    return max(r[0] for r in spark.range(0, 64, 1, 32).select(count("id")).collect())


@pytest.mark.parametrize("stage", ["sign", "maybe"])
def test_other_stages_release_the_tokenizer(spark, stage):
    docs = documents(spark).repartition(32).cache()
    packing.tokenized_pieces(docs, PATH).count()
    packing.tokenized_pieces(docs, PATH).write.format("noop").mode("overwrite").save()
    assert holding(spark) == 1
    for _ in range(4):  # more tasks than idle workers
        if stage == "sign":
            oddsketch.with_signatures(docs).write.format("noop").mode("overwrite").save()
        else:
            ids = spark.range(3)
            docs.select(maybe_member(ids, F.xxhash64("doc_id")).alias("m")).write.format("noop").mode("overwrite").save()
    docs.unpersist()
    assert holding(spark) == 0
