import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from spendtrace.llm import packing
from tests.llm.fixtures import document_rows, documents, no_documents

PATH = P.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [0]


def test_pieces_and_places(spark):
    got = packing.packed_documents(documents(spark), PATH).collect()
    want = []
    for row in document_rows():
        ids = ids_of(row[1])
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want.append(repr((row[0], k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))))
    assert sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got) == sorted(want)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= 1 + -(-sum(r.length for r in got) // 2048)


def test_no_documents(spark):
    assert packing.packed_documents(no_documents(spark), PATH).collect() == []
    bare = packing.tokenized_pieces(documents(spark).where("doc_id in (0, 1)"), PATH, closing=None)
    assert bare.collect() == []


def test_texts_are_tokenized_once(spark):
    """One Python worker a task: a second one would hold a tokenizer, too."""
    for closing in (0, None):
        plan = packing.tokenized_pieces(documents(spark), PATH, closing=closing)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1


def test_words_match_the_library():
    import random

    rng = random.Random(5)
    parts = ["a", "B", " ", "\n", "\t", "é", "ß", "×", "1", "23", "'s", "'", ".", "!?", "\x1c", "\x85", " ", "\r\n", "日本", "🙂", "the", "<|endoftext|>", "é", "İ", "Σ", "ﬁ", "क़", "<", ">"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + ["word, (other) " * 200_000]
    got = packing.word_ids(PATH).encode(pa.array(texts), 0)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [ids_of(t) for t in texts]


def brute_place(lengths, capacity, limit):
    """Tightest open bin by search; the fullest closes first."""
    bins, out, made = [], [], 0
    for n in lengths:
        fitting = [b for b in bins if b[0] >= n]
        if fitting:
            b = min(fitting, key=lambda b: b[0])
        else:
            if len(bins) == limit:
                bins.remove(min(bins, key=lambda b: b[0]))
            b = [capacity, made]
            bins.append(b)
            made += 1
        out.append(capacity - b[0])
        b[0] -= n
        if not b[0]:
            bins.remove(b)
    return out, made


def test_bins_follow_best_fit():
    rng = np.random.default_rng(1)
    for limit in (1, 3, 1000):
        lengths = rng.integers(1, 101, 500).tolist()
        bins = packing.OpenBins(100, limit)
        got = [bins.place(n)[1] for n in lengths]
        want, made = brute_place(lengths, 100, limit)
        assert got == want and bins.made == made and bins.open <= limit


def test_blocks_and_tasks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_PIECES", 50)
    pieces = spark.range(1000).selectExpr("id % 900 as doc_id", "0 as piece", "0L as start", "cast(1 + id * 37 % 97 as long) as length", "'kept' as note")
    got = packing.pack(pieces, capacity=100, blocks_per_task=4).collect()
    total = sum(r.length for r in got)
    assert len(got) == 1000 and got[0].note == "kept"
    assert len({r.sequence_id for r in got}) <= 1.1 * total / 100 + 5
    with pytest.raises(ValueError):
        packing.pack(pieces.withColumnRenamed("note", "offset"))
