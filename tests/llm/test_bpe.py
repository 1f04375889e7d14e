import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from spendtrace.llm import bpe
from tests.llm.fixtures import document_rows, documents, no_documents

PATH = P.path("byte_bpe_multi_50k.tiktoken")
CODEC = bpe.codec(PATH, P.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})


def ids(texts):
    return [np.frombuffer(r, np.int32).tolist() for r in CODEC.encode_batch(pa.array(texts, pa.string()))]


def test_random_texts_match_the_library():
    rng = random.Random(7)
    parts = ["a", "B", " ", "  ", "\n", "\n\n", "\t", "é", "ß", "×", "1", "23", "'s", "'ll", "'", ".", "!?", "\x1c", "\x85", " ", "\r\n", "日本", "🙂", "the", " of", "<|endoftext|>", "é"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    assert ids(texts) == [LIBRARY.encode_ordinary(t) for t in texts]


def test_long_pieces_match_the_library():
    rng = random.Random(8)
    texts = ["a" * 5000, "ab" * 700 + "é" * 300, "!" * 1000, "".join(rng.choice("abcdetionshr") for _ in range(3000)), "x" * 255, "x" * 257, " " * 3000, "\n" * 400]
    assert ids(texts) == [LIBRARY.encode_ordinary(t) for t in texts]


def test_long_text_in_segments():
    text = "Some words, and (more) words. " * 120_000
    assert ids([text, None, text[:100]]) == [LIBRARY.encode_ordinary(text), [], LIBRARY.encode_ordinary(text[:100])]


def test_full_table_starts_anew():
    small = bpe.ByteBpe.from_file(PATH, P.PATTERN)
    small.known.limit = 40
    small.known._restart()
    rng = random.Random(9)
    for _ in range(20):
        texts = [" ".join("".join(rng.choice("abcde") for _ in range(3)) for _ in range(20)) for _ in range(3)]
        got = [np.frombuffer(r, np.int32).tolist() for r in small.encode_batch(pa.array(texts))]
        assert got == [LIBRARY.encode_ordinary(t) for t in texts]


def test_round_trip_of_a_table(spark):
    got = bpe.round_trip(documents(spark), PATH, P.PATTERN).collect()
    want = [(r[0], LIBRARY.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in document_rows()]
    assert sorted(repr((r.doc_id, r.ids, bytes(r.decoded))) for r in got) == sorted(map(repr, want))
    assert bpe.round_trip(no_documents(spark), PATH, P.PATTERN).collect() == []


def test_columns(spark):
    df = spark.createDataFrame([("Hello world",), (None,)], "t string")
    coded = df.select(bpe.encode(F.col("t"), PATH, P.PATTERN).alias("ids"))
    texts = [bytes(r[0]) for r in coded.select(bpe.decode(F.col("ids"), PATH, P.PATTERN)).collect()]
    assert texts == [b"Hello world", b""]
    odd = spark.createDataFrame([([None, 5],), (None,)], "ids array<int>")
    assert [len(r[0]) for r in odd.select(bpe.decode(F.col("ids"), PATH, P.PATTERN)).collect()] == [CODEC.lengths[5], 0]


def test_unknown_ids():
    for bad in (-1, 50_256, 10**6):
        with pytest.raises(ValueError):
            CODEC.decode(np.array([bad]))
