import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spendtrace.llm import oddsketch
from tests.llm.fixtures import document_rows, documents, no_documents


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def components(rows):
    """All pairs; rows of one id are one node."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[a + 1 :]:
            both = len(s & t)
            if both and 100 * both >= 75 * (len(s) + len(t) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def check(spark, rows, got):
    want = components(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else r.component_id)
        assert r.kept == (r.component_id == r.doc_id)
    assert sorted(r.n_shingles for r in got) == sorted(len(shingles(t)) for _, t in rows)


def test_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in document_rows()]
    got = oddsketch.near_duplicates(documents(spark)).collect()
    check(spark, rows, got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[9].component_id == 6 and by_id[0].kept and by_id[4].component_id == 3


def test_no_documents(spark):
    assert oddsketch.near_duplicates(no_documents(spark)).collect() == []


def test_groups_chains_and_shared_passages(spark, monkeypatch):
    """A large near-copy group, chains at the threshold, and a passage in many documents, with large cells in blocks."""
    monkeypatch.setattr(oddsketch, "SMALL_CELL", 4)
    monkeypatch.setattr(oddsketch, "BLOCK_MEMBERS", 8)
    rng = random.Random(4)

    def prose(n):
        return [rng.choice("abcdefghij") + str(rng.randint(0, 400)) for _ in range(n)]

    texts = []
    group = prose(150)
    for _ in range(60):
        copy = list(group)
        copy[rng.randrange(150)] = f"u{rng.random()}"
        texts.append(copy)
    link = prose(120)
    for _ in range(25):
        link = link[4:] + prose(4)
        texts.append(list(link))
    passage = prose(80)
    texts += [prose(30) + passage + prose(20) for _ in range(60)]
    texts += [passage + prose(k) for k in range(8, 40)]
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = oddsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    check(spark, rows, got)


def test_estimates_are_close(spark):
    rng = np.random.default_rng(2)
    rows = []
    for j in (60, 75, 80, 90, 97):
        for _ in range(30):
            n = 400
            shared = rng.integers(0, 2**63, round(2 * n * j / (100 + j)), dtype=np.uint64)
            own = [rng.integers(0, 2**63, n - len(shared), dtype=np.uint64) for _ in range(2)]
            a, b = (np.concatenate([shared, o]) for o in own)
            sketches = [oddsketch.odd_sketch(oddsketch.min_hashes(s)).view(np.int64).tolist() for s in (a, b)]
            rows.append((j, *sketches))
    df = spark.createDataFrame(rows, "j int, a array<long>, b array<long>")
    df = df.select("j", *[F.col(x)[k].alias(f"s{k}_{x}") for x in "ab" for k in range(oddsketch.SKETCH_WORDS)])
    bits = oddsketch.differing_bits(range(oddsketch.SKETCH_WORDS))
    for r in df.select("j", oddsketch.estimate(bits).alias("e"), bits.alias("bits")).collect():
        assert abs(r.e - r.j / 100) < 0.12
        assert r.j < 75 or r.e >= oddsketch.FLOOR
        assert (r.e >= oddsketch.FLOOR) == (r.bits <= oddsketch.MOST_BITS)


def test_sketch_is_the_parity_of_sample_bits():
    least = oddsketch.min_hashes(np.arange(1, 50, dtype=np.uint64))
    assert sum(int(w).bit_count() for w in oddsketch.odd_sketch(least)) % 2 == oddsketch.SAMPLES % 2
    assert len(next(oddsketch.shingle_sets(pa.array(["a b c d e f"])))) == 2


def test_pair_whose_only_common_band_is_hot(spark):
    """Members of one bucket alone, many of them: the two that are near are found, whatever the bucket's size."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(700):
        sketch = rng.integers(-(2**63), 2**63 - 1, oddsketch.SKETCH_WORDS)
        rows.append((7, i, i, 100 + i % 60, sketch))
    near = rows[650][4].copy()
    near[0] ^= 5  # two bits
    rows.append((7, 900, 900, rows[650][3] + 1, near))
    rows.append((7, 901, 650, rows[650][3], rows[650][4]))  # the same component: not compared
    rows.append((8, 902, 902, rows[650][3], rows[650][4]))  # another bucket
    rows.append((7, 903, 903, 1000, rows[650][4]))  # too large a set
    columns = ["key", "rep", "component", "n_shingles", *[f"s{k}" for k in range(oddsketch.SKETCH_WORDS)]]
    flat = [(*r[:4], *map(int, r[4])) for r in rows]
    schema = ", ".join(f"{c} long" for c in columns)
    df = spark.createDataFrame(flat, schema).repartition(3)
    for block in (None, 90):
        got = {(r.a, r.b) for r in oddsketch._crossing(df, 75, block).collect()}
        assert got == {(650, 900), (900, 901)}


def test_rare_shingles_meet_every_pair_at_the_threshold(spark):
    rng, sets = random.Random(23), []
    while len(sets) < 160:
        base = rng.sample(range(4000), rng.randrange(1, 60))
        for _ in range(4):
            keep = [x for x in base if rng.random() < rng.choice((0.8, 0.93, 1))] or base
            sets.append(sorted(set(keep + rng.sample(range(4000), rng.randrange(0, 4)))))
    members = spark.createDataFrame([(i, i) for i in range(len(sets))], "rep long, component long")
    rows = oddsketch.rare_shingles(members, spark.createDataFrame(list(enumerate(sets)), "doc_id long, shingles array<long>"), 75).collect()
    held = {}
    for r in rows:
        held.setdefault(r.rep, {})[r.key] = r.leads
    links = 0
    for a in range(len(sets)):
        for b in range(a):
            x, y = set(sets[a]), set(sets[b])
            if 100 * len(x & y) < 75 * len(x | y):
                continue
            links += 1
            small, large = (a, b) if len(x) <= len(y) else (b, a)
            assert any(leads and key in held.get(large, {}) for key, leads in held.get(small, {}).items())
    assert links > 50
    assert len(rows) < sum(map(len, sets)) / 2
