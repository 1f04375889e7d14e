"""Near-duplicate documents by MinHash bands and odd sketches.

A document's set is its distinct five-word shingles. ``SAMPLES`` MinHash samples
of the set are folded into a parity bitmap, the odd sketch: each sample flips one
bit. The population count of the XOR of two sketches estimates how many samples
differ, so the similarity of a candidate pair is known closely from 128 bytes
each. The first ``BANDS * ROWS`` samples give bands for candidates. Pairs
that may reach the threshold are confirmed on the full sets.

Groups need no comparison of all their pairs:

* documents with the same set are one representative;
* first each representative is compared with the smallest one that any of its
  buckets has, then, within each bucket, the smallest of each component formed
  so far with the bucket's smallest; both give at most a pair per member;
* last, all members of buckets that hold several components are met by their
  rarest shingles: sets that reach the threshold share one among the first of
  both in order of frequency (prefix filtering, exact). Members of different
  components that share such a shingle are compared, by size class, in numpy and
  in blocks of bounded size; so a pair whose only common band is that of a
  passage many share is found too, while variants of one template, each with
  changes of its own, hardly meet.

A pair at similarity 0.75 has no common band with probability 5e-6, and a sketch
estimate below ``FLOOR`` with 1e-8.

Texts are not shuffled but for documents in some candidate pair: the scan
drops others by a bitmap sized by the candidates (up to a limit, beyond which more pass), and a join
drops those.

Defined results: a null or empty text, or one without words, has an empty set,
links with nothing and is its own component (repeated ids: one component per
id). An empty table gives no rows. A text of one to four words has its whole word sequence as only shingle.
A null doc_id is kept as a row, without links. Rows are returned one per input
row; columns other than those named are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendtrace.llm.components import connected_components
from spendtrace.llm.kept import release
from spendtrace.llm.membership import maybe_member
from spendtrace.llm.staging import bounded_batches, stored
from spendtrace.llm.textnum import mix, slices, window_hashes, words

SHINGLE = 5
BANDS, ROWS = 32, 4
SAMPLES = 512
SKETCH_BITS = 1024
SKETCH_WORDS = SKETCH_BITS // 64
#: Estimates have a standard deviation of about 0.023 at similarity 0.75.
FLOOR = 0.62
#: Members of a bucket's size class that are compared at once.
BLOCK_MEMBERS = 16384
#: Cells up to so many members are compared together, larger ones row block by row block.
SMALL_CELL = 256
_PAIRS = 1 << 17
_BLOCK = 1024

_RNG = np.random.default_rng(977)
_XOR = _RNG.integers(0, 2**32, SAMPLES, dtype=np.uint32)[:, None]
_MUL = (_RNG.integers(0, 2**31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_SAMPLE = np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
_BAND = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)
_ROW = _RNG.integers(0, 2**63, ROWS, dtype=np.uint64) | np.uint64(1)

SIGNATURE = T.StructType(
    [
        T.StructField("n_shingles", T.LongType()),
        T.StructField("digest", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("sketch", T.ArrayType(T.LongType())),
    ]
)


def shingle_sets(texts: pa.Array):
    """Sorted distinct shingle hashes of each text, in row order."""
    for a, b, joined, at in slices(texts):
        joined = joined.lower()  # bytes: A-Z only
        starts, _, hashes = words(np.frombuffer(joined, dtype=np.uint8))
        first = np.searchsorted(starts, at)
        windows = window_hashes(hashes, SHINGLE)
        for i in range(b - a):
            w0, w1 = first[i], first[i + 1]
            if w1 - w0 >= SHINGLE:
                yield np.unique(windows[w0 : w1 - SHINGLE + 1])
            elif w1 > w0:
                yield window_hashes(hashes[w0:w1], int(w1 - w0))
            else:
                yield hashes[:0]


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """Smallest value of each of ``SAMPLES`` hash functions, each over the shingle's 32 low bits."""
    least = np.full(SAMPLES, np.iinfo(np.uint32).max, dtype=np.uint32)
    low = shingles.astype(np.uint32)
    for k in range(0, len(low), _BLOCK):
        np.minimum(least, ((low[None, k : k + _BLOCK] ^ _XOR) * _MUL).min(axis=1), out=least)
    return least.astype(np.uint64)


def band_keys(least: np.ndarray) -> np.ndarray:
    return mix((least[: BANDS * ROWS].reshape(BANDS, ROWS) * _ROW).sum(axis=1, dtype=np.uint64) ^ _BAND)


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples: sample k flips the bit its (k, value) hashes to."""
    bit = (mix(least ^ _SAMPLE) % np.uint64(SKETCH_BITS)).astype(np.int64)
    parity = np.bincount(bit, minlength=SKETCH_BITS) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.uint64)


def signatures(texts: pa.Array) -> pa.Array:
    n, digests, bands, sketches = [], [], [], []
    for shingles in shingle_sets(texts):
        n.append(len(shingles))
        if len(shingles):
            least = min_hashes(shingles)
            digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
            bands.append(band_keys(least))
            sketches.append(odd_sketch(least))
        else:
            digests.append(None)
            bands.append(np.zeros(BANDS, dtype=np.uint64))
            sketches.append(np.zeros(SKETCH_WORDS, dtype=np.uint64))
    return pa.StructArray.from_arrays(
        [
            pa.array(n, pa.int64()),
            pa.array(digests, pa.binary()),
            _lists(bands, BANDS),
            _lists(sketches, SKETCH_WORDS),
        ],
        names=[f.name for f in SIGNATURE],
    )


def _lists(rows: list[np.ndarray], width: int) -> pa.Array:
    flat = np.concatenate(rows).view(np.int64) if rows else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(rows) * width + 1, width), pa.int32()), pa.array(flat))


def with_signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest, bands, sketch) of each row's whole text."""

    @F.arrow_udf(SIGNATURE)
    def sign(texts: pa.Array) -> pa.Array:
        release()
        return signatures(texts)

    return docs.select("doc_id", sign("text").alias("sig")).select("doc_id", *[f"sig.{f.name}" for f in SIGNATURE])


def estimate(differing: F.Column) -> F.Column:
    """Similarity from the number of bits in which two sketches differ (the odd sketch estimator)."""
    inner = F.lit(1.0) - 2.0 * differing / SKETCH_BITS
    return F.when(inner <= 0, F.lit(0.0)).otherwise(F.lit(1.0) + F.log(inner) * (SKETCH_BITS / (4.0 * SAMPLES)))


def differing_bits(words: range) -> F.Column:
    """Population count of the XOR of two sketches, over some of their words, from columns s0_a.., s0_b.."""
    counts = [F.bit_count(F.col(f"s{k}_a").bitwiseXOR(F.col(f"s{k}_b"))) for k in words]
    return sum(counts[1:], counts[0])


#: Greatest number of differing bits at which the estimate reaches FLOOR.
MOST_BITS = int(SKETCH_BITS / 2 * (1 - np.exp(-4 * SAMPLES * (1 - FLOOR) / SKETCH_BITS)))
#: A quarter of a sketch that may pass has at most so many (8 standard deviations above its share).
QUARTER = SKETCH_WORDS // 4
MOST_QUARTER_BITS = int(MOST_BITS / 4 + 8 * np.sqrt(MOST_BITS / 4 * (1 - MOST_BITS / SKETCH_BITS) * 0.75))


def possible(threshold: int) -> F.Column:
    """Pairs that sizes and sketches do not exclude; most fall by the first quarter of their sketches."""
    sizes = 100 * F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")
    return sizes & (differing_bits(range(QUARTER)) <= MOST_QUARTER_BITS) & (differing_bits(range(SKETCH_WORDS)) <= MOST_BITS)


def _ids(column: str) -> Column:
    return F.xxhash64(column)


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, shingles) of the documents whose doc_id is in ``ids``; only their texts are read into sets."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def full_set(texts: pa.Array) -> pa.Array:
        release()
        rows = list(shingle_sets(texts))
        ends = np.cumsum([0] + [len(r) for r in rows])
        flat = np.concatenate(rows).view(np.int64) if rows else np.zeros(0, dtype=np.int64)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))

    maybe = maybe_member(ids.select(_ids("doc_id").alias("id")), _ids("doc_id"))
    needed = docs.select("doc_id", "text").where(maybe).join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return stored(needed.select("doc_id", full_set("text").alias("shingles")), "sets")


def confirmed(pairs: DataFrame, docs: DataFrame, threshold: int, sets: DataFrame | None = None) -> DataFrame:
    """Those of the pairs (a, b) whose full sets reach the threshold (in hundredths).

    ``sets`` holds the sets of all documents in the pairs; where it is not given, they are made. A document in
    many pairs sends its set once per pair, which is no more than its partners'
    own sets, as sizes differ by a third at most.
    """
    pairs = stored(pairs.select("a", "b").distinct(), "candidates")
    if sets is None:
        sets = full_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("left", "right"))
    return both.where(100 * common >= threshold * (F.size("left") + F.size("right") - common)).select("a", "b")


def rare_shingles(members: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Shingles (``key``) that a member (rep, component) must share with any partner of another component.

    A pair's sets share at least threshold * n of the larger one's n shingles, and
    2 * threshold / (100 + threshold) * n of the smaller one's. So in any one order of
    shingles, here by the members that have them, the first n - that number + 1 of
    each have one in common; ``leads`` tells which of them are among the fewer ones
    that count when the set is the smaller. A member's shingles that no other has
    come first and are not returned, nor those of a single component.
    """
    n = F.col("n_shingles")
    rows = members.join(sets.withColumnRenamed("doc_id", "rep"), "rep")
    rows = rows.select("rep", "component", F.size("shingles").alias("n_shingles"), F.explode("shingles").alias("key"))
    seen = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members"), (F.min("component") != F.max("component")).alias("mixed"))
    # Written, so that the join can be split where many members share a shingle.
    rows = rows.join(stored(seen.where("members > 1"), "shared-shingles"), "key")
    order = F.array_sort(F.collect_list(F.struct("members", "key", "mixed"))).alias("shared")
    own = rows.groupBy("rep").agg(F.first("component").alias("component"), F.first("n_shingles").alias("n_shingles"), order)
    own = own.withColumn("alone", n - F.size("shared"))
    first = n - F.ceil(threshold * n / 100) + 1
    first_of_smaller = n - F.ceil(2 * threshold * n / (100 + threshold)) + 1
    own = own.withColumn("shared", F.slice("shared", F.lit(1), F.greatest(first - F.col("alone"), F.lit(0)).cast("int")))
    placed = own.select("rep", "component", n, first_of_smaller.alias("leading"), "alone", F.posexplode("shared").alias("place", "at"))
    place = F.col("alone") + F.col("place")
    return placed.where("at.mixed").select(
        F.col("at.key").alias("key"), "rep", "component", (place < F.col("leading")).alias("leads"), place.alias("place")
    )


def _side(members: DataFrame, side: str) -> DataFrame:
    """Members as one side of pairs: columns get the side's suffix, ``rep`` becomes the side itself."""
    return members.select(
        F.col("rep").alias(side),
        F.col("n_shingles").alias(f"n_{side}"),
        *[F.col(f"s{k}").alias(f"s{k}_{side}") for k in range(SKETCH_WORDS)],
    )


class _Cells:
    """Rows of cells (sorted by ``cell``) as arrays, and the tests that a pair of rows must pass."""

    def __init__(self, table: pa.Table, threshold: int):
        self.threshold = threshold
        names = ("cell", "rep", "component", "n_shingles", "leads", "place", "home", "block", "two")
        self.cell, self.rep, self.component, self.n, self.leads, self.place, self.home, self.block, self.two = (
            table[c].to_numpy(zero_copy_only=False) for c in names
        )
        self.sketch = np.stack([table[f"s{k}"].to_numpy() for k in range(SKETCH_WORDS)], axis=1).view(np.uint64)

    def passed(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Pairs (rep, rep), smaller first, of those rows that sizes and sketches do not exclude."""
        ok = (self.component[i] != self.component[j]) & (self.home[i] | self.home[j])
        ok &= ~self.two[i] | (self.block[i] != self.block[j])
        i, j = i[ok], j[ok]
        n, other = self.n[i], self.n[j]
        ok = (self.leads[i] & (n <= other)) | (self.leads[j] & (other <= n))
        # Where this is their first common shingle, no more than what follows it can be common.
        most = np.minimum(n - self.place[i], other - self.place[j])
        ok &= (100 + self.threshold) * most >= self.threshold * (n + other)
        i, j = i[ok], j[ok]
        for words, most in ((QUARTER, MOST_QUARTER_BITS), (SKETCH_WORDS, MOST_BITS)):
            ok = np.bitwise_count(self.sketch[i, :words] ^ self.sketch[j, :words]).sum(axis=1, dtype=np.int64) <= most
            i, j = i[ok], j[ok]
        return np.sort(np.stack([self.rep[i], self.rep[j]], axis=1), axis=1)

    def pairs(self) -> np.ndarray:
        size = len(self.cell)
        edges = np.flatnonzero(np.concatenate([[True], self.cell[1:] != self.cell[:-1], [True]]))
        last = np.repeat(edges[1:], np.diff(edges))
        after = last - np.arange(size) - 1
        after[last - np.repeat(edges[:-1], np.diff(edges)) > SMALL_CELL] = 0
        upto, found, start = np.cumsum(after), [np.zeros((0, 2), dtype=np.int64)], 0
        while start < size:
            done = upto[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(upto, done + _PAIRS, side="right")))
            counts = after[start:stop]
            i = np.repeat(np.arange(start, stop), counts)
            found.append(self.passed(i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts)))
            start = stop
        for a, b in zip(edges[:-1], edges[1:]):
            if b - a > SMALL_CELL:
                found += self._large(a, b)
        return np.unique(np.concatenate(found), axis=0)

    def _large(self, a: int, b: int) -> list[np.ndarray]:
        """Pairs of a large cell: blocks of rows against all after them, by the first words of their sketches."""
        found = []
        for k in range(a, b, 64):
            left = np.arange(k, min(k + 64, b))
            bits = np.bitwise_count(self.sketch[left, 0][:, None] ^ self.sketch[None, k:b, 0]).astype(np.int16)
            for w in range(1, QUARTER):
                bits += np.bitwise_count(self.sketch[left, w][:, None] ^ self.sketch[None, k:b, w])
            near = (bits <= MOST_QUARTER_BITS) & (self.component[left][:, None] != self.component[None, k:b])
            i, j = np.nonzero(near)
            later = j > i
            found.append(self.passed(left[i[later]], k + j[later]))
        return found


def _crossing(members: DataFrame, threshold: int, block: int | None = None) -> DataFrame:
    """Pairs (a, b) of different components in a bucket (``key``) that may reach the threshold.

    With a column ``leads``, the smaller set of a pair (one of two equally large) must have it true;
    with ``place``, the key's place among the set's shingles in the common order, only what follows can be common. Sets of sizes out of the threshold's ratio cannot, so a member meets its own size
    class and, as a visitor, the next. A class of more than ``block`` members is divided into
    blocks, each pair of which is a cell, so no task holds a bucket.
    """
    base = max(100 / threshold, 1.01) * (1 + 1e-9)
    size_class = F.floor(F.ln("n_shingles") / float(np.log(base))).cast("int")
    if "leads" not in members.columns:
        members = members.withColumn("leads", F.lit(True))
    if "place" not in members.columns:
        members = members.withColumn("place", F.lit(0))
    classed = members.withColumn("home", F.explode(F.array(F.lit(True), F.lit(False))))
    classed = stored(classed.withColumn("class", size_class + F.when(F.col("home"), 0).otherwise(1)), "cells")
    sizes = classed.groupBy("key", "class").agg(F.count(F.lit(1)).alias("size"), F.count_if("home").alias("homes"))
    # A pair needs a home member and another.
    sizes = sizes.where("homes > 0 and size > 1").select("key", "class", F.ceil(F.col("size") / (block or BLOCK_MEMBERS)).cast("int").alias("blocks"))
    dealt = classed.join(stored(sizes, "cell-sizes"), ["key", "class"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    sketch = [f"s{k}" for k in range(SKETCH_WORDS)]
    cell = F.xxhash64("key", "class", low, high).alias("cell")
    dealt = dealt.select(cell, "rep", "component", "n_shingles", "leads", "place", "home", "block", (low != high).alias("two"), *sketch)

    def compare(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # The last cell of a batch may go on in the next.
            final = batch.column("cell")[batch.num_rows - 1].as_py()
            cut = int(np.searchsorted(batch.column("cell").to_numpy(), final))
            held.append(batch.slice(0, cut))
            if cut:
                yield found_in(held)
                held = []
            held.append(batch.slice(cut))
        if held:
            yield found_in(held)

    def found_in(batches):
        pairs = _Cells(pa.Table.from_batches(batches), threshold).pairs()
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, threshold: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept, per row of ``docs``."""
    bounded_batches(docs.sparkSession, 256)
    docs = docs.select("doc_id", "text")
    signed = stored(with_signatures(docs), "signatures")
    reps = stored(
        signed.where("digest is not null and doc_id is not null")
        .groupBy("digest")
        .agg(
            F.min("doc_id").alias("rep"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("bands").alias("bands"),
            F.first("sketch").alias("sketch"),
        ),
        "representatives",
    )
    plain = reps.select("rep", "n_shingles", *[F.col("sketch")[k].alias(f"s{k}") for k in range(SKETCH_WORDS)])

    keyed = reps.select(F.explode("bands").alias("key"), "rep")
    buckets = keyed.groupBy("key").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("members"))
    shared = stored(keyed.join(buckets.where("members > 1"), "key").select("key", "rep", "leader"), "buckets")

    def links_of(pairs: DataFrame, name: str) -> DataFrame:
        sized = pairs.distinct().join(_side(plain, "a"), "a").join(_side(plain, "b"), "b")
        return stored(confirmed(sized.where(possible(threshold)), docs, threshold), name)

    def members_by(links: DataFrame) -> DataFrame:
        """Members of the buckets that hold several components of ``links``."""
        found = connected_components(links).withColumnRenamed("id", "rep")
        member = shared.join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        mixed = member.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        return stored(member.join(mixed.where("low <> high").select("key"), "key", "left_semi"), "open-buckets")

    nearest = shared.groupBy("rep").agg(F.min("leader").alias("leader")).where("leader < rep")
    links = links_of(nearest.select(F.col("leader").alias("a"), F.col("rep").alias("b")), "links-first")
    lows = members_by(links).groupBy("key", "component").agg(F.min("rep").alias("rep"), F.min("leader").alias("leader"))
    again = lows.where("leader < rep").select(F.col("leader").alias("a"), F.col("rep").alias("b"))
    links = links.union(links_of(again, "links-second"))

    members = stored(members_by(links).select("rep", "component").distinct(), "open-members")
    sets = full_sets(docs, members.select(F.col("rep").alias("doc_id")))
    cross = _crossing(rare_shingles(members, sets, threshold).join(plain, "rep"), threshold)
    more = stored(confirmed(cross, docs, threshold, sets), "links-cross")
    joined = connected_components(links.union(more))
    classes = reps.select("digest", "rep").join(joined.withColumnRenamed("id", "rep"), "rep", "left")
    classes = classes.select("digest", F.coalesce("component", "rep").alias("component"))
    rows = signed.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left")
    component = F.coalesce("component", "doc_id")
    return rows.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        component.eqNullSafe(F.col("doc_id")).alias("kept"),
    )
