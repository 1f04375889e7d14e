"""Exact substring dedup by prefix-partitioned suffix trees.

A suffix is what follows a word position; only those of at least ``window`` words
matter, and each removes words only if it shares its first ``window`` words with another.

* **Prefixes.** Suffixes are split by a prefix of varying length: up to the end of the
  least (by hash) ``GRAM``-word gram of their first ``window`` words. Neighbouring suffixes mostly
  share that gram, so a run of them travels as one stretch of words, and a
  gram that occurs once in the corpus drops all suffixes under it unread.
* **Groups.** A task gets whole grams, as many as fit in memory at a time. A gram of more than ``GROUP``
  stretches is divided into blocks; the first suffix of each class of a block goes on,
  under the longest prefix, all its ``window`` words, to be compared between blocks.
* **Subtrees.** A group's suffixes are sorted (its suffix array) and the common lengths of
  neighbours give the tree's internal nodes. A node at least ``window`` words deep is a repeat: its
  earliest suffix (smallest doc_id, then start) stays, the other leaves are removed spans.

Texts that occur before with a smaller id are not looked at: their words all go. Words
are compared by 64-bit hashes, twenty of them a suffix.

Defined results: a null or empty text has no words, and the hash of an empty
string; texts of fewer than ``window`` words stay whole. A null doc_id comes after all
others. Rows that share an id and start at the same place do not precede each other, so a row
repeated as a whole loses nothing by its copy. An empty table gives no rows. Columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendtrace.llm.membership import maybe_member
from spendtrace.llm.staging import bounded_batches, stored
from spendtrace.llm.textnum import mix, slices, window_hashes, words

WINDOW = 20
GRAM = 8
#: Stretches of one gram that are compared at once, and suffixes sorted at once where grams are small.
GROUP = 4096
SUFFIXES = 1 << 15
_LAST = (1 << 63) - 1
_FOLD = np.random.default_rng(12).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def least_grams(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all grams, for each window of words the place of its least gram, the leftmost of equals)."""
    grams = window_hashes(hashes, GRAM)
    span = window - GRAM + 1
    if len(grams) < span:
        return grams, np.zeros(0, dtype=np.int64)
    return grams, np.lib.stride_tricks.sliding_window_view(grams, span).argmin(axis=1) + np.arange(len(grams) - span + 1)


def _runs(hashes: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows within documents that share their least gram: (document, first window, last window, gram).

    ``first`` holds the place of each document's first word, and the end.
    """
    grams, least = least_grams(hashes, window)
    counts = np.maximum(np.diff(first) - window + 1, 0)
    at = np.repeat(first[:-1] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    doc, gram_at = np.repeat(np.arange(len(counts)), counts), least[at]
    begins = np.concatenate([[True], (doc[1:] != doc[:-1]) | (gram_at[1:] != gram_at[:-1])]) if len(at) else np.zeros(0, bool)
    begin = np.flatnonzero(begins)
    end = np.append(begin[1:], len(at)) - 1 if len(begin) else begin
    return doc[begin], at[begin], at[end], grams[gram_at[begin]]


SCANNED = "n_words long, whole binary, grams array<long>"


def scanned(texts: pa.Array, window: int) -> pa.Array:
    """Of each text: its number of words, SHA-256 of all words, and the grams of its runs."""
    counts, wholes, grams, ends = [], [], [], [0]
    for a, b, joined, at in slices(texts):
        starts, _, hashes = words(np.frombuffer(joined, dtype=np.uint8))
        first = np.searchsorted(starts, at)
        doc, _, _, gram = _runs(hashes, first, window)
        counts.append(np.diff(first))
        grams.append(gram.view(np.int64))
        ends.extend((ends[-1] + np.searchsorted(doc, np.arange(1, b - a + 1))).tolist())
        wholes += [hashlib.sha256(b" ".join(joined[at[i] : at[i + 1] - 1].split())).digest() for i in range(b - a)]
    flat = np.concatenate(grams) if grams else np.zeros(0, dtype=np.int64)
    n = np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64)
    return pa.StructArray.from_arrays(
        [pa.array(n, pa.int64()), pa.array(wholes, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
        names=["n_words", "whole", "grams"],
    )


STRETCH = "gram long, block int, blocks int, place long, digest binary, start long, codes array<long>"


def stretches(batch: pa.RecordBatch, window: int) -> Iterator[pa.RecordBatch]:
    """Runs of suffixes under a repeated gram, from rows (text, digest, place, repeated: (gram, blocks))."""
    repeated = batch.column("repeated")
    entries = repeated.flatten()
    held_gram = entries.field(0).to_numpy(zero_copy_only=False).view(np.uint64)
    held_blocks = entries.field(1).to_numpy(zero_copy_only=False)
    lengths = repeated.value_lengths().to_numpy()
    offset = np.concatenate([[0], np.cumsum(lengths)])
    salt = np.array([int.from_bytes(d[:8], "little") for d in batch.column("digest").to_pylist()], dtype=np.uint64)
    for a, b, joined, at in slices(batch.column("text")):
        starts, _, hashes = words(np.frombuffer(joined, dtype=np.uint8))
        first = np.searchsorted(starts, at)
        doc, low, high, gram = _runs(hashes, first, window)
        # Each run's gram among its document's repeated ones, by numbers for (document, gram).
        held, held_doc = held_gram[offset[a] : offset[b]], np.repeat(np.arange(b - a), lengths[a:b])
        known = np.unique(held)
        number = held_doc * len(known) + np.searchsorted(known, held)
        order = np.argsort(number)
        if not len(known) or not len(doc):
            continue
        at_known = np.minimum(np.searchsorted(known, gram), len(known) - 1)
        wanted = doc * len(known) + at_known
        found = np.minimum(np.searchsorted(number, wanted, sorter=order), len(number) - 1)
        ok = (known[at_known] == gram) & (number[order[found]] == wanted)
        doc, low, high, gram = doc[ok], low[ok], high[ok], gram[ok]
        blocks = held_blocks[offset[a] : offset[b]][order[found[ok]]].astype(np.int64)
        sizes = high - low + window
        take = np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        block = (mix(salt[a + doc] ^ mix(low.astype(np.uint64))) % blocks.astype(np.uint64)).astype(np.int32)
        rows = pa.array(a + doc)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(gram.view(np.int64)),
                pa.array(block),
                pa.array(blocks, pa.int32()),
                batch.column("place").take(rows),
                batch.column("digest").take(rows),
                pa.array(low - first[doc]),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(hashes[take].view(np.int64))),
            ],
            names=["gram", "block", "blocks", "place", "digest", "start", "codes"],
        )


def suffix_order(codes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array within groups, common length of each suffix with the one before; -1 where a group begins)."""
    order = np.lexsort((*codes.T[::-1], group))
    sorted_codes, sorted_group = codes[order], group[order]
    differ = sorted_codes[1:] != sorted_codes[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), codes.shape[1])
    common[sorted_group[1:] != sorted_group[:-1]] = -1
    return order, np.concatenate([[-1], common])[: len(order)]


FOUND = "digest binary, start long, stop long, place long, prefix long, gram long"


def repeats(table: pa.Table, window: int) -> pa.Table:
    """Removed spans of words, and of divided grams the first suffix of each class (``prefix`` not null), from stretches sorted by gram and block."""
    gram, block, blocks = (table[c].to_numpy() for c in ("gram", "block", "blocks"))
    place, start = table["place"].to_numpy(), table["start"].to_numpy()
    lists = table["codes"].combine_chunks()
    flat, lengths = lists.flatten().to_numpy().view(np.uint64), lists.value_lengths().to_numpy().astype(np.int64)
    group = np.cumsum(np.concatenate([[0], (gram[1:] != gram[:-1]) | (block[1:] != block[:-1])]))
    counts = lengths - window + 1
    row = np.repeat(np.arange(len(lengths)), counts)
    ahead = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    codes = flat[(np.cumsum(lengths) - lengths)[row][:, None] + ahead[:, None] + np.arange(window)]
    order, common = suffix_order(codes, group[row])
    # Deep nodes: neighbours that share the whole window hang under one.
    node = np.cumsum(common < window) - 1
    r = row[order]
    at_place, at_start = place[r], (start[row] + ahead)[order]
    rank = np.lexsort((at_start, at_place, node))  # within a node, earliest first
    node, r, at_place, at_start = node[rank], r[rank], at_place[rank], at_start[rank]
    begin = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
    leader = np.repeat(begin, np.diff(np.append(begin, len(node))))
    gone = (at_place != at_place[leader]) | (at_start != at_start[leader])
    # Neighbouring suffixes of a stretch make one span.
    g_row, g_start = r[gone], at_start[gone]
    tidy = np.lexsort((g_start, g_row))
    g_row, g_start = g_row[tidy], g_start[tidy]
    new = np.concatenate([[True], (g_row[1:] != g_row[:-1]) | (g_start[1:] != g_start[:-1] + 1)]) if len(g_row) else np.zeros(0, bool)
    lows = np.flatnonzero(new)
    highs = np.append(lows[1:], len(g_row)) - 1 if len(lows) else lows
    firsts = np.flatnonzero((blocks[r] > 1) & ~gone)
    prefix = mix((codes[order][rank][firsts] * _FOLD[:window]).sum(axis=1, dtype=np.uint64)).view(np.int64)
    rows = np.concatenate([g_row[lows], r[firsts]]).astype(np.int64)
    empty = pa.nulls(len(lows), pa.int64())
    return pa.table(
        {
            "digest": table["digest"].take(pa.array(rows)),
            "start": np.concatenate([g_start[lows], at_start[firsts]]),
            "stop": np.concatenate([g_start[highs] + window, at_start[firsts] + window]),
            "place": place[rows],
            "prefix": pa.concat_arrays([empty, pa.array(prefix)]),
            "gram": pa.concat_arrays([empty, pa.array(gram[r[firsts]])]),
        }
    )


def _groups(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Whole groups of sorted stretches, as many as make about ``SUFFIXES`` suffixes at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            room = max(1, SUFFIXES // (window - GRAM + 1))
            gram, block = batch.column("gram").to_numpy(), batch.column("block").to_numpy()
            if held:
                last = held[-1]
                ends = (last.column("gram")[-1].as_py(), last.column("block")[-1].as_py())
                same = int(((gram != ends[0]) | (block != ends[1])).argmax()) if (gram[-1], block[-1]) != ends else len(gram)
                if same:
                    held.append(batch.slice(0, same))
                    batch = batch.slice(same)
                    continue
                if sum(h.num_rows for h in held) >= room:
                    yield from repeats(pa.Table.from_batches(held), window).to_batches()
                    held = []
            cut = min(room, batch.num_rows)
            # Up to the end of the group that begins before the cut.
            while cut < batch.num_rows and gram[cut] == gram[cut - 1] and block[cut] == block[cut - 1]:
                cut += 1
            held.append(batch.slice(0, cut))
            batch = batch.slice(cut)
    if held:
        yield from repeats(pa.Table.from_batches(held), window).to_batches()


KEPT = "n_removed long, kept binary"


def kept_words(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Of each text: how many words its spans (start, stop) cover, and SHA-256 of the others."""
    removed, kept = [], []
    for text, own in zip(texts.to_pylist(), spans.to_pylist()):
        parts = (text or "").encode().split()
        change = np.zeros(len(parts) + 1, dtype=np.int64)
        np.add.at(change, [s["start"] for s in own], 1)
        np.add.at(change, [s["stop"] for s in own], -1)
        covered = np.cumsum(change[:-1]) > 0
        removed.append(int(covered.sum()))
        kept.append(hashlib.sha256(b" ".join(parts[i] for i in np.flatnonzero(~covered))).digest())
    return pa.StructArray.from_arrays([pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["n_removed", "kept"])


def _digest() -> Column:
    return F.substring(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)), 1, 16)


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: doc_id, digest, n_words, whole, place, first_place; texts: digest, text; spans: digest, start, stop).

    ``rows`` has each input row with the place of its text's first occurrence; ``spans`` are words to
    remove from the first occurrence of a text, ``texts`` those that may have spans.
    """
    if not GRAM <= window <= len(_FOLD):
        raise ValueError(f"window must be from {GRAM} to {len(_FOLD)} words")
    bounded_batches(docs.sparkSession)

    @F.arrow_udf(SCANNED)
    def scan(texts: pa.Array) -> pa.Array:
        return scanned(texts, window)

    keyed = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(_LAST)).cast("long").alias("place"), _digest().alias("digest"))
    rows = keyed.withColumn("s", scan("text")).select("doc_id", "place", "digest", "s.n_words", "s.whole", "s.grams")
    rows = stored(rows, "scanned")
    firsts = stored(rows.groupBy("digest").agg(F.min("place").alias("first_place")), "first-texts")
    occurring = rows.select(F.explode("grams").alias("gram"), "digest")
    counts = occurring.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Written, so that the engine can split a gram that many texts have.
    blocks = stored(counts.select("gram", F.ceil(F.col("n") / GROUP).cast("int").alias("blocks")), "grams-repeated")
    hits = occurring.join(blocks, "gram").groupBy("digest").agg(F.collect_set(F.struct("gram", "blocks")).alias("repeated"))
    hits = stored(hits.join(firsts, "digest"), "repeated-grams")
    # Only first occurrences of texts with repeated grams are read again.
    again = maybe_member(hits.select(F.xxhash64("digest", "first_place").alias("id")), F.xxhash64("digest", "place"))
    texts = keyed.where(again).select("digest", "place", "text").join(hits, "digest").where(F.col("place") == F.col("first_place"))
    texts = stored(texts.select("digest", "place", "text", "repeated").dropDuplicates(["digest"]), "texts-again")

    def stretch(batches):
        for batch in batches:
            yield from stretches(batch, window)

    def trees(batches):
        yield from _groups(batches, window)

    pieces = texts.mapInArrow(stretch, STRETCH).repartition("gram", "block").sortWithinPartitions("gram", "block")
    found = stored(pieces.mapInArrow(trees, FOUND), "subtrees")
    spans = found.where("prefix is null").select("digest", "start", "stop")
    # Blocks of a divided gram: the first suffixes of equal classes meet under their whole prefix.
    classes = found.where("prefix is not null").select("digest", "start", "stop", "place", "prefix", "gram")
    earliest = classes.groupBy("prefix", "gram").agg(F.min(F.struct("place", "start")).alias("e"), F.count(F.lit(1)).alias("met"))
    later = classes.join(earliest.where("met > 1"), ["prefix", "gram"]).where("struct(place, start) <> e")
    return rows.drop("grams").join(firsts, "digest"), texts.select("digest", "text"), spans.union(later.select("digest", "start", "stop"))


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 per row of ``docs``."""

    @F.arrow_udf(KEPT)
    def kept(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return kept_words(texts, spans)

    rows, texts, spans = repeated_spans(docs, window)
    own = spans.groupBy("digest").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    cut = texts.join(own, "digest").select("digest", kept("text", "spans").alias("k")).select("digest", "k.n_removed", "k.kept")
    cut = stored(cut, "cut-texts")
    copy = (F.col("place") > F.col("first_place")) & (F.col("n_words") >= window)
    nothing = F.unhex(F.sha2(F.lit(""), 256))
    sha = F.when(copy, nothing).otherwise(F.coalesce("kept", "whole"))
    return rows.join(cut, "digest", "left").select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.lower(F.hex(sha)).alias("kept_sha256"),
    )
