"""Spelling variants by a variable-length gram index.

Two words are near if they differ by one inserted, deleted or replaced code point.

* **Gram dictionary.** Grams of ``SHORTEST`` to ``LONGEST`` code points of the words,
  set between edge marks, are counted. A gram is extended only where it is
  frequent: the dictionary holds the shortest grams and those whose parts before
  the last code point occur more than ``LIST`` times. If that is over
  ``MOST_GRAMS`` grams, the limit is raised until it is not, so what tasks are
  sent is bounded whatever the words.
* **Decomposition.** From each place of a word the longest gram of the dictionary is
  taken, unless an earlier one covers it. Frequent places get long, selective grams.
* **Affected grams.** For each possible edit the grams that it can change are counted:
  those that touch it, those left of it from the first that may reach it, and
  those right of it that a gram across it may cover. At most ``affected`` are
  lost, so near words share ``len(grams) - affected`` of either's grams, in the same place or
  shifted by one.
* **Merging.** Of words that share so many grams, each has one of the shared among its
  ``affected + 1`` rarest. Only these are indexed, by gram, place and length. Lists
  are merged by counting the pairs' common grams against the greater bound,
  then pairs are verified on the words. A list over ``BLOCK`` entries becomes blocks,
  each pair of which is a cell of its own.

Two words whose bounds are both 0 may share no gram. Such words also enter a second
index by the shortest grams alone, where an edit affects two grams and words of
five code points have a bound of four. So no near pair is missed.

Defined results: a null or empty text, or an empty table, has no words; a null id
counts as an empty one in the rule that deletes code points; repeated rows count
each time. Columns other than those named are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from string import ascii_letters, ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendtrace.llm.staging import stored
from spendtrace.llm.textnum import mix

SHORTEST, LONGEST = 2, 6
LIST = 32
MOST_GRAMS = 1 << 16
BLOCK = 4096
#: Words up to so many code points, and gram counts, are compared as matrices; longer ones one by one.
WIDTH = 48
GRAMS = 24
_PAIRS = 1 << 17
_MARKS = "^", "$"
_KEY = np.random.default_rng(13).integers(1, 2**63, 4, dtype=np.uint64) | np.uint64(1)

#: A-Z, a-z and U+00C0 to U+00FF one by one: Java looks such a class up in one table, but tries ranges one after another.
LETTERS = f"[{ascii_letters}{''.join(map(chr, range(0xC0, 0x100)))}]"


def counted_words(docs: DataFrame, least_length: int = 5, least_count: int = 3, delete_one_in: int | None = 97) -> DataFrame:
    """(word, n) of runs of letters, A-Z lowered, after the rule that deletes a code point of some runs."""
    # Runs of the least length are found at once; each is a whole run, as the pattern takes all letters that follow.
    runs = F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{max(1, least_length)},}}"), F.lit(0))
    prefix = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"))
    runs = docs.select(prefix.alias("prefix"), F.explode(runs).alias("run"))
    # Of ASCII runs, which are nearly all, lower() changes just A-Z, and is cheaper.
    lowered = F.when(F.octet_length("run") == F.length("run"), F.lower("run")).otherwise(F.translate("run", ascii_uppercase, ascii_lowercase))
    runs = runs.select("prefix", lowered.alias("run"))
    word = F.col("run")
    if delete_one_in:
        runs = runs.withColumn("h", F.crc32(F.concat("prefix", "run").cast("binary")))
        at = F.pmod(F.col("h"), F.length("run")).cast("int")
        shorter = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2, F.length("run")))
        word = F.when(F.col("h") % delete_one_in == 0, shorter).otherwise(word)
    counts = runs.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= least_count)


class GramDictionary:
    """Grams, rarest first. Sent to tasks as one string; ``limit`` is the count above which a gram is extended."""

    def __init__(self, grams: list[str], extended: set[str]):
        self.joined, self.longer = "\n".join(grams), "\n".join(sorted(extended))
        self._rank: dict[str, int] | None = None

    def __getstate__(self):
        return {"joined": self.joined, "longer": self.longer, "_rank": None}

    def _built(self) -> None:
        grams = self.joined.split("\n")
        self._rank = {g: i for i, g in enumerate(grams)}
        self._extended = set(self.longer.split("\n"))
        # Ends of longer grams: what a gram across an edit may cover right of it.
        self._ends = {g[k:] for g in grams for k in range(1, len(g) - SHORTEST + 1)}

    def decompose(self, word: str, longest: int = LONGEST) -> tuple[list[tuple[int, int]], int]:
        """(rank, place) of the word's grams, and the greatest number that one edit affects."""
        if self._rank is None:
            self._built()
        s = _MARKS[0] + word + _MARKS[1]
        n, rank, extended = len(s), self._rank, self._extended
        ends = []
        for p in range(n - SHORTEST + 1):
            e = p + SHORTEST
            # Every longer part of a known word whose beginning is extended is a gram.
            while e < n and e - p < longest and s[p:e] in extended:
                e += 1
            ends.append(e)
        kept, reached = [], 0
        for p, e in enumerate(ends):
            if e > reached:
                kept.append((p, e))
                reached = e
        starts, affected = [p for p, _ in kept], 0
        for u in range(1, n):
            # First place before u whose gram goes past u: from there on grams may change.
            first = u - 1
            for p in range(max(0, u - longest + 1), u - 1):
                if ends[p] > u:
                    first = p
                    break
            for v in (u, u + 1):  # a code point comes in before s[u], or s[u] goes or changes
                if v > n - 1:
                    continue
                covered = v
                if longest > SHORTEST:
                    for e in range(min(n, v + longest - 1), v + SHORTEST - 1, -1):
                        if s[v:e] in self._ends:
                            covered = e
                            break
                near = kept[bisect_left(starts, u - longest) : bisect_left(starts, v + longest)]
                lost = sum(1 for p, e in near if (p >= first if e <= u else p < v or e <= covered))
                affected = max(affected, lost)
        return [(rank[s[p:e]], p) for p, e in kept], affected


def gram_dictionary(words: DataFrame, list_limit: int = LIST, most_grams: int = MOST_GRAMS) -> GramDictionary:
    """Frequency-pruned grams of the words (column ``word``)."""
    marked = F.concat(F.lit(_MARKS[0]), "word", F.lit(_MARKS[1]))

    def of_length(q: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("marked") - (q - 1)))
        parts = F.transform(places, lambda i: F.substring("marked", i, q))
        return F.when(F.length("marked") >= q, parts).otherwise(F.array().cast("array<string>"))

    each = [of_length(q) for q in range(SHORTEST, LONGEST + 1)]
    grams = words.select(marked.alias("marked")).select(F.explode(F.concat(*each)).alias("gram"))
    counts = stored(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("f")), "grams")
    begin = F.substring("gram", F.lit(1), F.length("gram") - 1)
    short = F.length("gram") == SHORTEST
    parents = counts.where(F.length("gram") < LONGEST).select(F.col("gram").alias("begin"), F.col("f").alias("begin_f"))
    longer = counts.where(~short).withColumn("begin", begin).join(parents.where(F.col("begin_f") > list_limit), "begin")
    longer = stored(longer.select("gram", "f", "begin", "begin_f"), "longer-grams")
    # How many grams each limit keeps, over steps of an eighth of a doubling: a few hundred rows.
    step = F.floor(F.log2("begin_f") * 8).cast("int")
    steps = longer.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("grams"), F.min("begin_f").alias("least")).orderBy(F.desc("step")).collect()
    room, limit = most_grams - counts.where(short).count(), None
    for r in steps:
        room -= r["grams"]
        if room < 0:
            break
        limit = r["least"]
    chosen = counts.where(short).select("gram", "f", F.lit(None).cast("string").alias("begin"))
    if limit is not None:
        chosen = chosen.union(longer.where(F.col("begin_f") >= limit).select("gram", "f", "begin"))
    rows = sorted((f, g, b) for g, f, b in chosen.collect())
    return GramDictionary([g for _, g, _ in rows], {b for _, _, b in rows if b is not None})


ENTRY = "word string, n long, need int, grams array<int>, home boolean, key long"


def entries(words: DataFrame, grams: GramDictionary) -> DataFrame:
    """Index entries of each word: under its rarest grams, at its own length, and as the shorter word of a pair one longer."""

    def index(batches):
        for batch in batches:
            out: list[tuple] = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, affected = grams.decompose(word)
                out.append((word, n, 0, found, affected))
                if len(found) <= affected:
                    found, affected = grams.decompose(word, SHORTEST)
                    out.append((word, n, 1, found, affected))
            yield from _entry_batches(out)

    return words.select("word", "n").mapInArrow(index, ENTRY)


def _entry_batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(rows), 2000):
        part = rows[a : a + 2000]
        needs, lists, owner, keys = [], [], [], []
        for i, (word, _, level, found, affected) in enumerate(part):
            need = max(1, len(found) - affected)
            seen: dict[int, int] = {}
            numbered = []  # the second occurrence of a gram is another element, and so on
            for rank, _ in found if len(found) <= GRAMS else ():  # longer lists are not counted
                numbered.append(rank + (seen.get(rank, 0) << 17))
                seen[rank] = seen.get(rank, 0) + 1
            needs.append(need)
            lists.append(numbered)
            for rank, place in sorted(found)[: len(found) - need + 1]:
                owner.append(i)
                keys.append((level, rank, place, len(word)))
        # Three entries each: at home, and as the shorter word left and right of the edit.
        key = np.repeat(np.array(keys, dtype=np.uint64).reshape(-1, 4), 3, axis=0)
        key[1::3, 3] += np.uint64(1)
        key[2::3, 2:] += np.uint64(1)
        key = (key * _KEY).sum(axis=1, dtype=np.uint64).view(np.int64)
        each = pa.array(np.repeat(np.array(owner, dtype=np.int64), 3))
        columns = [
            pa.array([r[0] for r in part]).take(each),
            pa.array([r[1] for r in part], pa.int64()).take(each),
            pa.array(needs, pa.int32()).take(each),
            pa.array(lists, pa.list_(pa.int32())).take(each),
            pa.array(np.arange(len(key)) % 3 == 0),
            pa.array(key),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "need", "grams", "home", "key"])


def one_edit(a: str, b: str) -> bool:
    """Whether two different words differ by one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k:] == b[k + 1 :] or a[k + 1 :] == b[k + 1 :]


def _matrices(table: pa.Table, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: code points (zero behind the end), numbered grams (-1 behind), whether they fit in that, a bit for
    each gram's hash, and a bit for each code point that occurs an odd number of times."""
    width = max(1, min(WIDTH, int(length.max(initial=0))))
    words = np.array([w[:width] for w in table["word"].to_pylist()], dtype=f"U{width}")
    points = words.view(np.uint32).reshape(len(words), width)
    lists = table["grams"].combine_chunks()
    lengths = lists.value_lengths().to_numpy()
    grams = np.full((len(words), max(1, lengths.max(initial=0))), -1, dtype=np.int32)
    flat, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    grams[owner, place] = flat
    fits = (length <= WIDTH) & (lengths > 0)
    bits = np.where(grams >= 0, np.uint64(1) << (mix(grams.astype(np.uint64)) >> np.uint64(58)), np.uint64(0))
    odd = np.where(points > 0, np.uint64(1) << (points & np.uint32(63)).astype(np.uint64), np.uint64(0))
    return points, grams, fits, np.bitwise_or.reduce(bits, axis=1), np.bitwise_xor.reduce(odd, axis=1)


def near_pairs(table: pa.Table) -> pa.Table:
    """Verified near pairs (a, n_a, b, n_b) of rows sorted by cell; within a cell, of two blocks if it is of two."""
    cells = table["cell"].to_numpy()
    size = len(cells)
    edges = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1], [True]]))
    last = np.repeat(edges[1:], np.diff(edges))
    words, length = table["word"], pa.compute.utf8_length(table["word"]).to_numpy()
    points, grams, fits, bits, odd = _matrices(table, length)
    all_fit = fits.all()
    home, need, block, two = (table[c].to_numpy(zero_copy_only=False) for c in ("home", "need", "block", "two"))
    # Common grams have common bits, but for those of a word that fall on one bit.
    least_bits = need.astype(np.int64) - ((grams >= 0).sum(axis=1) - np.bitwise_count(bits))
    after = last - np.arange(size) - 1
    upto = np.cumsum(after)
    found, start = [], 0
    while start < size:
        done = upto[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, done + _PAIRS, side="right")))
        counts = after[start:stop]
        i = np.repeat(np.arange(start, stop), counts)
        j = np.arange(len(i)) + np.repeat(np.arange(start, stop) + 1 - np.cumsum(counts) + counts, counts)
        # An edit brings in a code point, takes one out or both: it turns two of the bits at most.
        close = np.bitwise_count(np.repeat(odd[start:stop], counts) ^ odd[j]) <= 2
        if not all_fit:
            close |= ~(fits[i] & fits[j])
        i, j = i[close], j[close]
        start = stop
        # Two homes have one length, a home and a shorter word differ by one; hashed keys may bring others together.
        both = home[i] & home[j]
        ok = np.where(both, length[i] == length[j], (home[i] != home[j]) & (length[i] - length[j] == np.where(home[i], 1, -1)))
        ok &= ~two[i] | (block[i] != block[j])
        i, j = i[ok], j[ok]
        plain = fits[i] & fits[j]
        enough = np.bitwise_count(bits[i] & bits[j]) >= np.maximum(least_bits[i], least_bits[j])
        some = i[plain & enough], j[plain & enough]
        common = np.zeros(len(some[0]), dtype=np.int16)
        theirs = grams[some[1]]
        for k in range(grams.shape[1]):
            mine = grams[some[0], k]
            common += ((theirs == mine[:, None]).any(axis=1) & (mine >= 0)).astype(np.int16)
        enough = common >= np.maximum(need[some[0]], need[some[1]])
        found.append(_verified(some[0][enough], some[1][enough], points, length))
        long = [(a, b) for a, b in zip(i[~plain].tolist(), j[~plain].tolist()) if (x := words[a].as_py()) != (y := words[b].as_py()) and one_edit(x, y)]
        found.append(np.array(long, dtype=np.int64).reshape(-1, 2))
    pairs = np.concatenate(found) if found else np.zeros((0, 2), dtype=np.int64)
    left, right = pa.array(pairs[:, 0]), pa.array(pairs[:, 1])
    return pa.table({"a": words.take(left), "n_a": table["n"].take(left), "b": words.take(right), "n_b": table["n"].take(right)})


def _verified(i: np.ndarray, j: np.ndarray, points: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Those of the pairs that differ by one edit, as rows (i, j)."""
    swap = length[i] > length[j]
    x, y = points[np.where(swap, j, i)], points[np.where(swap, i, j)]
    differ = x != y
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), x.shape[1])
    replaced = (length[i] == length[j]) & (differ.sum(axis=1) == 1)
    shifted = (x[:, :-1] != y[:, 1:]) & (np.arange(x.shape[1] - 1) >= first[:, None])
    inserted = (length[i] != length[j]) & ~shifted.any(axis=1)
    ok = replaced | inserted
    return np.stack([i[ok], j[ok]], axis=1)


def links(words: DataFrame, grams: GramDictionary, block: int | None = None) -> DataFrame:
    """Near pairs (a, n_a, b, n_b) of ``words`` (word, n), each once with a < b."""
    block = block or BLOCK
    listed = stored(entries(words, grams), "gram-entries")
    hot = listed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.bool_or("home").alias("any_home"))
    # Lists without a home word, or of one entry, make no pair.
    useful = hot.where(F.col("any_home") & (F.col("size") > 1)).select("key", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    dealt = listed.join(useful, "key").withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    cell = F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", low, high))
    dealt = dealt.select("word", "n", "need", "grams", "home", cell.alias("cell"), "block", (low != high).alias("two"))

    def pairs(batches):
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # The last cell of a batch may go on in the next.
            final = batch.column("cell")[batch.num_rows - 1].as_py()
            cut = int(np.searchsorted(batch.column("cell").to_numpy(), final))
            rest.append(batch.slice(0, cut))
            if cut and sum(r.num_rows for r in rest):
                yield from near_pairs(pa.Table.from_batches(rest)).to_batches()
                rest = []
            rest.append(batch.slice(cut))
        if rest:
            yield from near_pairs(pa.Table.from_batches(rest)).to_batches()

    dealt = dealt.repartition("cell").sortWithinPartitions("cell")
    met = dealt.mapInArrow(pairs, "a string, n_a long, b string, n_b long")
    flip = F.col("a") > F.col("b")
    ordered = met.select(
        F.when(flip, F.col("b")).otherwise(F.col("a")).alias("a"),
        F.when(flip, F.col("n_b")).otherwise(F.col("n_a")).alias("n_a"),
        F.when(flip, F.col("a")).otherwise(F.col("b")).alias("b"),
        F.when(flip, F.col("n_a")).otherwise(F.col("n_b")).alias("n_b"),
    )
    return ordered.distinct()


def spelling_variants(words: DataFrame, dominance: int = 2) -> DataFrame:
    """word, form, root, n, n_near and form_n per row of ``words`` (word, n; words distinct).

    The form is the near word of largest n (ties: smallest) if that is at least ``dominance``
    times the word's own; the root is where following forms ends.
    """
    words = stored(words.select("word", "n"), "words")
    near = stored(links(words, gram_dictionary(words)), "near-words")
    directed = near.select(F.col("a").alias("word"), F.struct((-F.col("n_b")).alias("n"), F.col("b").alias("w")).alias("other")).union(
        near.select(F.col("b").alias("word"), F.struct((-F.col("n_a")).alias("n"), F.col("a").alias("w")).alias("other"))
    )
    best = directed.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("other").alias("best"))
    takes = -F.col("best.n") >= dominance * F.col("n")
    found = words.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(takes, F.col("best.w")).alias("form"),
        F.when(takes, -F.col("best.n")).alias("form_n"),
    )
    found = stored(found, "forms")
    # Counts double at least along forms, so chains are short; each round halves them.
    roots = stored(found.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = roots.join(onward, "root", "left")
        if not further.where("next is not null").limit(1).count():
            break
        roots = stored(further.select("word", F.coalesce("next", "root").alias("root")), "roots")
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
