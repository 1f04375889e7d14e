"""Near-duplicate embeddings by an inverted multi-index.

Unit vectors are halved; each half has a codebook, so a pair of codewords names
a cell of a product grid. A query visits cells in the order of a lower bound of
its distance to them (multi-sequence traversal over the two sorted lists of
half bounds) and stops when the bound passes the reach that the target recall
asks for. With ``target_recall=1`` the reach is the threshold's own distance, and
as the bound holds for every vector of a cell, no link is missed. What is visited
is verified by cosine in double precision. A link found from one side counts for both.

Below 1 the reach is calibrated: a bounded sample of vectors meets all rows of its
label, and each sampled vector that has links needs the reach at which the last of
them is found (from either side). The reach serves ``target_recall`` of those vectors
whole, whether they weigh the same, by their links or by group (a vector of a group
of ten weighs a tenth). If the sample is not the whole table, the greatest need counts
unless ten vectors need more than the quantile, and with too few vectors for the
quantile the threshold's own distance stays.

Codebooks are fitted on at most ``SAMPLE_ROWS`` vectors (those with the smallest
hashes of their ids); every vector is indexed. Equal vectors of a label are one
representative with a count. A cell's members and visitors are divided into
blocks of bounded size, so a cell with a third of all rows is many tasks, and a
block returns counts and a spanning forest of its links instead of all pairs.

Defined results: rows with a null id or label, or a null, empty or zero vector, or null or
non-finite components, link with nothing and are their own component. Vectors of
different lengths do not link. Repeated ids are rows of one vector each; a link
between copies counts. Columns other than those named are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendtrace.llm.components import connected_components
from spendtrace.llm.staging import stored

SAMPLE_ROWS = 4096
MEMBERS = 1024
VISITORS = 4096
#: Vectors that calibrate the reach; the second number where the first has too few with links.
CALIBRATION_ROWS = (16384, 65536)
#: Most components and bounds that they hold together.
CALIBRATION_VALUES = 1 << 23
_SLACK = 1e-9


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    # Divided by the greatest component first, so that squares neither overflow nor vanish.
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def k_means(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Codewords from a fixed seed; empty ones keep their place."""
    rng = np.random.default_rng(5)
    words = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        nearest = squared_distances(points, words).argmin(axis=1)
        for i in range(len(words)):
            own = points[nearest == i]
            if len(own):
                words[i] = own.mean(axis=0)
    return np.unique(words, axis=0)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


class MultiIndex:
    """Two codebooks over the halves of vectors of one length."""

    def __init__(self, sample: np.ndarray, k: int):
        self.half = sample.shape[1] // 2
        self.books = [k_means(sample[:, : self.half], k), k_means(sample[:, self.half :], k)]

    def cells(self, units: np.ndarray) -> np.ndarray:
        """Number of each vector's cell."""
        first, second = (squared_distances(h, b).argmin(axis=1) for h, b in zip(self._halves(units), self.books))
        return first * len(self.books[1]) + second

    def _halves(self, units: np.ndarray) -> list[np.ndarray]:
        return [units[:, : self.half], units[:, self.half :]]

    @staticmethod
    def half_bounds(half: np.ndarray, book: np.ndarray) -> np.ndarray:
        """Squared distance at least to anything nearest to each codeword.

        What is nearest to word i lies on its side of the plane between i and any
        other word b, so the distance to the farthest such plane is a bound.
        """
        d = squared_distances(half, book)
        apart = 2 * np.sqrt(squared_distances(book, book))
        np.fill_diagonal(apart, 1)
        bound = ((d[:, :, None] - d[:, None, :]) / apart[None]).max(axis=2)
        return np.maximum(bound, 0) ** 2

    def bounds(self, units: np.ndarray) -> list[np.ndarray]:
        """Half bounds of each vector to each codeword, for both halves."""
        block = max(1, int(2e6) // max(len(b) for b in self.books) ** 2)
        parts = [[self.half_bounds(h[k : k + block], b) for k in range(0, len(h), block)] for h, b in zip(self._halves(units), self.books)]
        return [np.concatenate(x) if x else np.zeros((0, len(b))) for x, b in zip(parts, self.books)]

    def traverse(self, units: np.ndarray, reach: float) -> list[list[tuple[int, float]]]:
        """(cell, bound) of the cells to visit for each vector, nearest first."""
        out = []
        block = max(1, int(2e6) // max(len(b) for b in self.books) ** 2)
        width = len(self.books[1])
        for k in range(0, len(units), block):
            bounds = [self.half_bounds(h, b) for h, b in zip(self._halves(units[k : k + block]), self.books)]
            orders = [b.argsort(axis=1, kind="stable") for b in bounds]
            for i in range(len(bounds[0])):
                lists = [bounds[s][i, orders[s][i]].tolist() for s in (0, 1)]
                out.append([(int(orders[0][i, a]) * width + int(orders[1][i, b]), d) for a, b, d in multi_sequence(*lists, reach)])
        return out


def multi_sequence(first: list[float], second: list[float], reach: float):
    """Pairs (a, b, first[a] + second[b]) of two sorted lists in ascending order of the sum, up to ``reach``."""
    heap = [(first[0] + second[0], 0, 0)]
    while heap:
        total, a, b = heapq.heappop(heap)
        if total > reach:
            return
        yield a, b, total
        if b + 1 < len(second):
            heapq.heappush(heap, (first[a] + second[b + 1], a, b + 1))
        if b == 0 and a + 1 < len(first):
            heapq.heappush(heap, (first[a + 1] + second[0], a + 1, 0))


def reach_for(needs: np.ndarray, links: np.ndarray, limit: float, target_recall: float, whole: bool) -> float:
    """Squared distance up to which cells are visited, from what the sampled vectors with links need and how many links they have.

    ``whole``: the sample is the whole table.
    """
    if not len(needs):
        return limit
    by_group = 1 / (1 + links)
    # Vectors of equal weight that say as much as these.
    supporters = by_group.sum() ** 2 / (by_group**2).sum()
    tail = 1 - target_recall
    if not whole and supporters * tail < 1 - 1e-9:
        return limit
    if not whole and supporters * tail < 10:
        return min(limit, float(needs.max()) + _SLACK)
    order = needs.argsort()
    found = 0.0
    for weights in (np.ones(len(needs)), links.astype(np.float64), by_group):
        served = np.cumsum(weights[order])
        at = np.searchsorted(served, target_recall * served[-1])
        found = max(found, float(needs[order[min(at, len(order) - 1)]]))
    return min(limit, found + _SLACK)


class Calibration:
    """Links and needed reach of sampled vectors, gathered over batches of all rows."""

    def __init__(self, index: MultiIndex, units: np.ndarray, reps: np.ndarray, labels: list, threshold: float):
        self.index, self.units, self.reps, self.threshold = index, units, reps, threshold
        self.codes = {label: i for i, label in enumerate(dict.fromkeys(labels))}
        code = np.array([self.codes[x] for x in labels], np.int64)
        self.of_code = [np.flatnonzero(code == i) for i in range(len(self.codes))]
        self.cells, self.bounds = index.cells(units), index.bounds(units)

    def gather(self, batches) -> tuple[np.ndarray, np.ndarray]:
        """(links, needed reach) per sampled vector from batches of (units, reps, labels)."""
        links, needs = np.zeros(len(self.units), np.int64), np.zeros(len(self.units))
        width = len(self.index.books[1])
        for units, reps, labels in batches:
            codes = np.array([self.codes.get(x, -1) for x in labels], np.int64)
            cells = self.index.cells(units)
            for c in np.unique(codes[codes >= 0]):
                rows, sampled = np.flatnonzero(codes == c), self.of_code[c]
                step = max(1, int(1e6) // len(rows))
                for k in range(0, len(sampled), step):
                    part = sampled[k : k + step]
                    near = (self.units[part] @ units[rows].T >= self.threshold) & (self.reps[part][:, None] != reps[rows][None])
                    if not near.any():
                        continue
                    links[part] += near.sum(axis=1)
                    q, m = np.nonzero(near)
                    met, m = np.unique(m, return_inverse=True)
                    theirs = self.index.bounds(units[rows[met]])
                    q, their_cell = part[q], cells[rows[met]][m]
                    out = self.bounds[0][q, their_cell // width] + self.bounds[1][q, their_cell % width]
                    back = theirs[0][m, self.cells[q] // width] + theirs[1][m, self.cells[q] % width]
                    np.maximum.at(needs, q, np.minimum(out, back))
        return links, needs


PREPARED = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("digest", T.BinaryType())])


def prepare(vectors: pa.Array) -> pa.Array:
    """(dim, digest of the components) of vectors that can link, else nulls."""
    dims, digests = [], []
    for row in vectors:
        values = row.values
        ok = values is not None and len(values) and not values.null_count
        v = values.to_numpy(zero_copy_only=False) if ok else None
        ok = ok and np.isfinite(v).all() and (v != 0).any()
        dims.append(len(v) if ok else None)
        digests.append(hashlib.blake2b((v + 0.0).tobytes(), digest_size=16).digest() if ok else None)
    return pa.StructArray.from_arrays([pa.array(dims, pa.int32()), pa.array(digests, pa.binary())], names=["dim", "digest"])


def stack(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Matrix of equally long lists."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def grid_size(rows: int) -> int:
    """Codewords per half: about 256 rows a cell over all labels, up to 256 codewords."""
    return int(min(256, max(4, np.ceil(np.sqrt(rows / 256)))))


BLOCK_LINKS = "rep long, links long, root long"


def block_links(block: pa.Table, threshold: float) -> pa.Table:
    """Link counts of a block, and a root per local component, from members x visitors similarities.

    A link counts for its visitor; for the member too, if that does not visit the
    visitor's cell (``seen``: the cells a member visits, or a visitor's own; null
    where all links are found from both sides).
    """
    visiting = block["visiting"].to_numpy(zero_copy_only=False).astype(bool)
    reps, copies = block["rep"].to_numpy(), block["copies"].to_numpy()
    units = unit_rows(stack(block["embedding"]))
    q, m = np.flatnonzero(visiting), np.flatnonzero(~visiting)
    linked = (units[q] @ units[m].T >= threshold) & (reps[q][:, None] != reps[m][None])
    links = linked @ copies[m].astype(np.int64) if len(m) else np.zeros(len(q), np.int64)
    links_m = np.zeros(len(m), np.int64)
    if linked.any() and not block["seen"].null_count:
        homes, home = np.unique(block["seen"].take(pa.array(q)).combine_chunks().flatten().to_numpy(), return_inverse=True)
        seen = block["seen"].take(pa.array(m)).combine_chunks()
        cells, owner = seen.flatten().to_numpy(), seen.value_parent_indices().to_numpy()
        at = np.minimum(np.searchsorted(homes, cells), len(homes) - 1)
        returns = np.zeros((len(m), len(homes)), dtype=bool)
        returns[owner[homes[at] == cells], at[homes[at] == cells]] = True
        links_m = copies[q].astype(np.int64) @ (linked & ~returns[:, home].T)
    root_q, root_m = reps[q].copy(), reps[m].copy()
    if linked.any():
        big = np.iinfo(np.int64).max
        while True:  # smallest id of each local component
            low_q = np.minimum(root_q, np.where(linked, root_m[None], big).min(axis=1))
            low_m = np.minimum(root_m, np.where(linked, low_q[:, None], big).min(axis=0))
            if (low_q == root_q).all() and (low_m == root_m).all():
                break
            root_q, root_m = low_q, low_m
    has_q, has_m = links > 0, linked.any(axis=0)
    return pa.table(
        {
            "rep": np.concatenate([reps[q][has_q], reps[m][has_m]]),
            "links": np.concatenate([links[has_q], links_m[has_m]]),
            "root": np.concatenate([root_q[has_q], root_m[has_m]]),
        }
    )


def similar_vectors(vectors: DataFrame, threshold: float = 0.93, target_recall: float = 1.0) -> DataFrame:
    """vec_id, n_links, component_id (smallest vec_id reachable) and kept, per row of ``vectors`` (vec_id, embedding, label)."""

    @F.arrow_udf(PREPARED)
    def prepared(column: pa.Array) -> pa.Array:
        return prepare(column)

    rows = vectors.select("vec_id", "embedding", "label", prepared("embedding").alias("p"))
    rows = stored(rows.select("vec_id", "embedding", "label", "p.dim", "p.digest"), "vectors")
    usable = F.col("digest").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    reps = (
        rows.where(usable)
        .groupBy("label", "dim", "digest")
        .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
    )
    reps = stored(reps, "vector-reps")
    parts = [_links_of_length(reps.where(F.col("dim") == d["dim"]), d["dim"], d["n"], threshold, target_recall) for d in _lengths(reps)]
    if not parts:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    found = stored(found, "vector-links")
    components = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = (
        reps.select("label", "dim", "digest", "rep", "copies")
        .join(counts, "rep", "left")
        .join(components.withColumnRenamed("id", "rep"), "rep", "left")
        .select(
            "label",
            "digest",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    linked = rows.select("vec_id", F.when(usable, F.col("digest")).alias("digest"), "label").join(classes, ["digest", "label"], "left")
    component = F.coalesce("component_id", "vec_id")
    return linked.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("vec_id")).alias("kept"),
    )


def _lengths(reps: DataFrame) -> list:
    """Lengths that occur; a table of embeddings has few."""
    return reps.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy("dim").collect()


def _links_of_length(reps: DataFrame, dim: int, n: int, threshold: float, target_recall: float) -> DataFrame:
    sample = reps.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE_ROWS).select("embedding").toArrow()
    units = unit_rows(stack(sample["embedding"]))
    if dim == 1:  # no second half
        units = np.concatenate([units, np.zeros_like(units)], axis=1)
    index = MultiIndex(units, grid_size(n))
    limit = 2 - 2 * threshold + _SLACK

    def padded(column: pa.Array) -> np.ndarray:
        u = unit_rows(stack(column))
        return np.concatenate([u, np.zeros_like(u)], axis=1) if dim == 1 else u

    reach = limit if target_recall >= 1 else _calibrated(reps, index, padded, dim, n, threshold, target_recall)

    @F.arrow_udf("int")
    def cell(column: pa.Array) -> pa.Array:
        return pa.array(index.cells(padded(column)) if len(column) else [], pa.int32())

    @F.arrow_udf("array<int>")
    def visited(column: pa.Array) -> pa.Array:
        found = index.traverse(padded(column), reach) if len(column) else []
        return pa.array([[c for c, _ in cells] for cells in found], pa.list_(pa.int32()))

    def entry(cell: Column, visiting: bool, seen: Column) -> Column:
        seen = seen if reach < limit else F.lit(None).cast("array<int>")
        return F.struct(cell.alias("cell"), F.lit(visiting).alias("visiting"), seen.alias("seen"))

    located = reps.select("label", cell("embedding").alias("home"), visited("embedding").alias("visits"), "rep", "copies", "embedding")
    own = F.array(entry(F.col("home"), False, F.col("visits")))
    visits = F.transform("visits", lambda c: entry(c, True, F.array("home")))
    placed = located.select("label", F.explode(F.concat(own, visits)).alias("e"), "rep", "copies", "embedding")
    rows = stored(placed.select("label", "e.cell", "rep", "copies", "embedding", "e.visiting", "e.seen"), "cells")
    sizes = rows.groupBy("label", "cell").agg(
        F.ceil(F.count_if(~F.col("visiting")) / MEMBERS).cast("int").alias("m_blocks"),
        F.ceil(F.count_if("visiting") / VISITORS).cast("int").alias("q_blocks"),
    )
    # Every member block meets every visitor block of its cell.
    dealt = rows.join(sizes.where("m_blocks > 0 and q_blocks > 0"), ["label", "cell"])
    part = F.xxhash64("rep", F.lit("block"))
    others = F.explode(F.when(F.col("visiting"), F.sequence(F.lit(0), F.col("m_blocks") - 1)).otherwise(F.sequence(F.lit(0), F.col("q_blocks") - 1)))
    blocks = dealt.withColumn("other", others)
    mine = F.when(F.col("visiting"), F.pmod(part, F.col("q_blocks"))).otherwise(F.pmod(part, F.col("m_blocks"))).cast("int")
    blocks = blocks.withColumn("mine", mine)
    m_block = F.when(F.col("visiting"), F.col("other")).otherwise(F.col("mine"))
    q_block = F.when(F.col("visiting"), F.col("mine")).otherwise(F.col("other"))
    blocks = blocks.select("label", "cell", m_block.alias("m"), q_block.alias("q"), "rep", "copies", "embedding", "visiting", "seen")
    return blocks.groupBy("label", "cell", "m", "q").applyInArrow(lambda t: block_links(t, threshold), BLOCK_LINKS)


def _calibrated(reps: DataFrame, index: MultiIndex, padded: Callable, dim: int, n: int, threshold: float, target_recall: float) -> float:
    """Reach for ``target_recall``, from a sample of the vectors against all rows."""
    limit = 2 - 2 * threshold + _SLACK
    most = max(1, CALIBRATION_VALUES // (dim + sum(len(b) for b in index.books)))
    for size in sorted({min(x, most) for x in CALIBRATION_ROWS}):
        reach = _calibrated_on(size, reps, index, padded, n, threshold, target_recall)
        if reach < limit or size >= n:
            break
    return reach


def _calibrated_on(size: int, reps: DataFrame, index: MultiIndex, padded: Callable, n: int, threshold: float, target_recall: float) -> float:
    sample = reps.orderBy(F.xxhash64("rep", F.lit("calibration")), "rep").limit(size).select("rep", "label", "embedding").toArrow()
    meeting = Calibration(index, padded(sample["embedding"]), sample["rep"].to_numpy(), sample["label"].to_pylist(), threshold)

    def gather(batches):
        parts = ((padded(b.column(2)), b.column(0).to_numpy(), b.column(1).to_pylist()) for b in batches if b.num_rows)
        links, needs = meeting.gather(parts)
        has = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(links[has]), pa.array(needs[has])], names=["at", "links", "need"])

    met = reps.select("rep", "label", "embedding").mapInArrow(gather, "at long, links long, need double")
    met = met.groupBy("at").agg(F.sum("links").alias("links"), F.max("need").alias("need")).toArrow()
    limit = 2 - 2 * threshold + _SLACK
    return reach_for(met["need"].to_numpy(), met["links"].to_numpy(), limit, target_recall, whole=len(sample) == n)
