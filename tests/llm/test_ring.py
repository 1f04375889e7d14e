import zlib
from collections import Counter

import pytest

from spendtrace.llm import ring
from tests.llm.fixtures import DOCS, document_rows, documents, no_documents


def test_sizes_checksums_and_balance(spark):
    rows = document_rows()
    got = ring.assign_shards(documents(spark), shards=8).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))


def test_only_full_homes_are_left(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "cast(id as string) as text")
    got = ring.assign_shards(df, shards=5, epsilon=0.05).collect()
    bound = ring.load_bounds(3000, 5, 0.05)[0]
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) <= bound
    for r in got:
        assert r.shard == r.home or counts[r.home] == bound


def test_few_rows_move_when_rows_are_added(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "'t' as text")
    before = {r.doc_id: r.shard for r in ring.assign_shards(df.where("doc_id < 3900"), epsilon=0.2).collect()}
    after = {r.doc_id: r.shard for r in ring.assign_shards(df, epsilon=0.2).collect()}
    assert sum(before[i] != after[i] for i in before) < 0.05 * len(before)


def test_grants_follow_the_walk_key_by_key():
    r = ring.Ring(4, 8)
    counts = {a: (a * 7) % 5 for a in range(32)}
    total = sum(counts.values())
    bounds = ring.load_bounds(total, 4, 0)
    where = {}
    for arc, low, high, shard, _ in r.grants(counts, bounds):
        where |= {(arc, k): shard for k in range(low, high)}
    # The same walk, one key and one step at a time.
    room, waiting, step = list(bounds), {a: list(range(n)) for a, n in counts.items()}, 0
    clockwise = {a: list(dict.fromkeys(r.owners[(a + k) % 32] for k in range(32))) for a in counts}
    want = {}
    while any(waiting.values()):
        for a in sorted(waiting):
            shard = clockwise[a][step]
            while waiting[a] and room[shard]:
                want[a, waiting[a].pop(0)] = shard
                room[shard] -= 1
        step += 1
    assert where == want
    with pytest.raises(ValueError):
        r.grants({0: 5}, [1, 1, 1, 1])


def test_cells_divide_an_arc(spark, monkeypatch):
    df = spark.range(2000).selectExpr("id % 1900 as doc_id", "'t' as text")
    whole = ring.assign_shards(df, shards=2, replicas=2)
    monkeypatch.setattr(ring, "CELL_ROWS", 50)
    parts = ring.assign_shards(df, shards=2, replicas=2).collect()
    assert whole.count() == len(parts) == 2000
    for s in (0, 1):
        assert sorted(r.slot for r in parts if r.shard == s) == list(range(1000))


def test_no_rows(spark):
    assert ring.assign_shards(no_documents(spark)).collect() == []
    assert DOCS
