import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from spendtrace.llm import variants
from spendtrace.llm.queries import QUERIES
from tests.llm.fixtures import document_rows, documents, no_documents


def words_of(rows, least_length=5, least_count=3):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_length:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= least_count}


def near(words):
    """All pairs one edit apart, through the words' parts with one code point left out."""
    parts = {}
    for w in words:
        for k in range(len(w)):
            parts.setdefault((len(w) - 1, w[:k] + w[k + 1 :]), set()).add(w)
    found = {w: set() for w in words}
    for w in words:
        for k in range(len(w)):
            for other in parts[len(w) - 1, w[:k] + w[k + 1 :]]:
                same = [x for x, y in zip(w, other) if x != y]
                if len(same) == 1:
                    found[w].add(other)
            shorter = w[:k] + w[k + 1 :]
            if shorter in found:
                found[w].add(shorter)
                found[shorter].add(w)
    return found


def expected(words, dominance=2):
    links, rows = near(words), {}
    for w, n in words.items():
        best = min(links[w], key=lambda x: (-words[x], x.encode()), default=None)
        rows[w] = best if best is not None and words[best] >= dominance * n else None
    out = {}
    for w, n in words.items():
        root = w
        while rows[root] is not None:
            root = rows[root]
        out[w] = (w, rows[w], root, n, len(links[w]), words[rows[w]] if rows[w] else None)
    return out


def invented(seed, count, alphabet, lengths):
    rng = random.Random(seed)
    words = {}
    while len(words) < count:
        w = "".join(rng.choice(alphabet) for _ in range(rng.choice(lengths)))
        words[w] = rng.randint(3, 400)
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(w))
            w = rng.choice([w[:k] + rng.choice(alphabet) + w[k:], w[:k] + rng.choice(alphabet) + w[k + 1 :], w[:k] + w[k + 1 :]])
            if len(w) >= 5:
                words[w] = rng.randint(3, 400)
    return words


@pytest.mark.parametrize("alphabet, lengths, limit, most", [("ab", (5, 6, 9), 3, 1 << 16), ("abcé", (5, 6, 7, 8, 12), 8, 1 << 16), ("abcdefgh", (5, 7, 10), 40, 300)])
def test_links_are_complete(spark, monkeypatch, alphabet, lengths, limit, most):
    words = invented(len(alphabet), 600 if len(alphabet) > 2 else 150, alphabet, lengths)
    words["a" * 70], words["a" * 71], words["b" + "a" * 70] = 9, 5, 4
    words["ab" * 900], words["ab" * 899 + "a"] = 20, 7
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    monkeypatch.setattr(variants, "LIST", limit)
    grams = variants.gram_dictionary(df, limit, most)
    assert len(grams.joined.split("\n")) <= most and any(len(g) > 3 for g in grams.joined.split("\n"))
    got = {(r.a, r.b) for r in variants.links(df, grams, block=40).collect()}
    assert got == {(a, b) for a, others in near(words).items() for b in others if a < b}


def test_affected_bound(spark):
    """Near words share as many grams as each word's bound promises, in place or shifted by one."""
    words = invented(7, 400, "abc", (5, 6, 8, 11))
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    grams = variants.gram_dictionary(df, 5)
    found = {w: grams.decompose(w) for w in words}
    short = 0
    for a, others in near(words).items():
        for b in others:
            theirs = set(found[b][0])
            common = sum(any((g, p + k) in theirs for k in (-1, 0, 1)) for g, p in found[a][0])
            assert common >= len(found[a][0]) - found[a][1]
        short += len(found[a][0]) <= found[a][1]
    assert short  # some bounds are 0: the second index is needed


def test_words_of_other_letters_are_not_compared(monkeypatch):
    """In one cell only pairs that differ by two odd counts of code points (modulo 64) at most get to the comparison."""
    words = list(invented(3, 300, "abcdefghijklmnopqrstuvwxyzéÿ", (5, 6, 9, 12))) + ["a" * 60, "a" * 60 + "b", "aab", "ab", "ÿÿÿÿÿ", "ÿÿÿÿ"]
    size = len(words)
    home = [len(w) % 2 == 0 for w in words]
    columns = {"cell": [1] * size, "word": words, "n": [3] * size, "need": [1] * size, "grams": [[7]] * size, "home": home, "block": [0] * size, "two": [False] * size}
    types = {"cell": pa.int64(), "n": pa.int64(), "need": pa.int32(), "grams": pa.list_(pa.int32()), "block": pa.int32()}
    table = pa.table({k: pa.array(v, types.get(k)) for k, v in columns.items()})
    compared, verified = [], variants._verified
    monkeypatch.setattr(variants, "_verified", lambda i, j, *x: compared.extend(zip(i.tolist(), j.tolist())) or verified(i, j, *x))
    got = variants.near_pairs(table)
    place = {w: i for i, w in enumerate(words)}
    # A home meets homes of its length and visitors that are one shorter.
    want = {(a, b) for a, others in near(words).items() for b in others if home[place[a]] and len(b) in (len(a), len(a) - 1)}
    assert {frozenset(p) for p in zip(got["a"].to_pylist(), got["b"].to_pylist())} == {frozenset(p) for p in want}
    odd = [{c for c, n in Counter(ord(c) % 64 for c in w).items() if n % 2} for w in words]
    assert compared and all(len(odd[i] ^ odd[j]) <= 2 for i, j in compared)


def test_only_ascii_letters_are_lowered(spark):
    rows = [(i, "ÉCOLE École école ÉcOLE STRASSE Straße ABCD×E abcd÷e NAÏVETÉ abcdE1FGHI ĀBCDE") for i in range(120)]
    df = spark.createDataFrame(rows + [(None, "ÉCOLE ABCDE"), (5, None)], "doc_id long, text string")
    for least in (1, 4, 5):
        got = {r.word: r.n for r in variants.counted_words(df, least_length=least, least_count=1).collect()}
        assert got == words_of(rows + [(None, "ÉCOLE ABCDE")], least, 1)


def test_counts_forms_and_roots(spark):
    rows = [(r[0], r[1]) for r in document_rows()]
    rows += [(500, "colour " * 40 + "colouur " * 9 + "coluur " * 3 + "Colour COLOUR ÀÉÎõü ÀÉÎõü ÀÉÎõüx ÀÉÎõü ab1cdefg")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = variants.spelling_variants(variants.counted_words(df)).collect()
    assert {r.word: tuple(r) for r in got} == expected(words_of(rows)) and len(got) == len({r.word for r in got})
    assert {r.word: r.root for r in got}["coluur"] == "colour"


def test_deleted_code_points(spark):
    rows = [(i, "abcdefg hijklmn été-nouveau") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.word: r.n for r in variants.counted_words(df, least_count=1).collect()}
    assert got == words_of(rows, least_count=1) and len(got) > 10


def test_no_documents(spark):
    assert variants.spelling_variants(variants.counted_words(no_documents(spark))).collect() == []
    assert variants.counted_words(documents(spark), delete_one_in=None).count() > 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = QUERIES["op13_spelling_variants"](spark, sf)
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {r.word: tuple(r) for r in df.collect()} == expected(words_of(rows))
