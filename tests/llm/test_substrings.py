import hashlib
import random
import re

import numpy as np
import pytest

from spendtrace.llm import substrings
from spendtrace.llm.queries import QUERIES
from tests.llm.fixtures import document_rows, documents, no_documents


def expected(rows, window=20):
    """Brute force: the first place (id, start) of each window; every other one covers its words."""
    texts = [(float("inf") if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in texts:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, (i, k)), (i, k))
    out = []
    for (doc_id, _), (i, w) in zip(rows, texts):
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] != (i, k):
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def planted():
    rng = random.Random(6)

    def prose(n, size=400):
        return [rng.choice("abcdefghij") + str(rng.randint(0, size)) for _ in range(n)]

    passage, other = prose(70), prose(19)
    texts = [prose(30) + passage + prose(20) for _ in range(40)]
    texts += [prose(5) + other + prose(30) for _ in range(5)]  # one word too short
    texts += [prose(9) + passage[10:30] + prose(9), passage[10:30], passage[:19]]
    base = prose(200)
    for _ in range(30):
        copy = list(base)
        copy[rng.randrange(200)] = f"u{rng.random()}"
        texts.append(copy)
    texts += [["x"] * 50, ["x"] * 21, ["y", "z"] * 40, ["y", "z"] * 12, prose(100, 1), prose(300, 1)]
    again = prose(60)
    texts.append(again + prose(7) + again)
    texts += [list(base), prose(25), prose(20)]
    texts += [texts[3], texts[50]]
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("group, suffixes", [(4096, 1 << 15), (6, 50)])
def test_planted_repeats(spark, monkeypatch, group, suffixes):
    """With whole groups, and with grams divided into blocks and few suffixes at a time."""
    monkeypatch.setattr(substrings, "GROUP", group)
    monkeypatch.setattr(substrings, "SUFFIXES", suffixes)
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = substrings.without_repeats(df)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)


def test_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in document_rows()]
    rows += [(3, rows[6][1] + " and more"), (3, rows[6][1] + " and less"), (None, rows[9][1])]
    df = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], "doc_id long, text string, digest string, grams string, place long")
    got = substrings.without_repeats(df.repartition(4)).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)
    assert substrings.without_repeats(documents(spark)).count() == len(document_rows())


def test_other_windows(spark):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for window in (8, 50):
        assert sorted(map(tuple, substrings.without_repeats(df, window).collect()), key=str) == expected(rows, window)
    with pytest.raises(ValueError):
        substrings.without_repeats(df, 5)


def test_no_documents(spark):
    assert substrings.without_repeats(no_documents(spark)).collect() == []


def test_suffix_order():
    rng = np.random.default_rng(1)
    codes, group = rng.integers(0, 3, (200, 6)).astype(np.uint64), np.sort(rng.integers(0, 5, 200))
    order, common = substrings.suffix_order(codes, group)
    keys = [(group[i], *codes[i]) for i in order]
    assert keys == sorted(keys) and common[0] == -1
    for k in range(1, 200):
        a, b = keys[k - 1], keys[k]
        same = next((n for n, (x, y) in enumerate(zip(a[1:], b[1:])) if x != y), 6)
        assert common[k] == (same if a[0] == b[0] else -1)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op12_suffix_tree_dedup"](spark, sf).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)
