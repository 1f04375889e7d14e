"""Quality classifier: a small convolutional network over the bytes of whole documents, in numpy.

A text's UTF-8 bytes are cut into chunks of ``CHUNK`` bytes that overlap by
``WIDTH - 1``, so that every window of ``WIDTH`` bytes lies in a chunk and the
whole document is covered. Bytes are embedded, learned filters slide over each
chunk, and each filter's greatest response in the chunk is kept (max-pool). The
mean and the greatest pooled response over all chunks give one probability.

Training reads at most ``sample_rows`` labelled rows (those with the smallest
hashes of their ids) of at most ``sample_bytes`` bytes each, so the driver's
work does not grow with the data. Only text bytes are inputs. Scoring is a
map over all rows; long texts are handled a block of chunks at a time.

Defined results: a null or empty text is one chunk of padding and gets a score
like any other; with no usable label (or labels of one kind only) every score is
0.5. Null labels and null ids are not learned from. Repeated labels of one id
count once (the smallest). Columns other than those named are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendtrace.llm.kept import release
from spendtrace.llm.staging import bounded_batches

CHUNK = 256
WIDTH = 6
EMBED = 5
FILTERS = 24
STEP = CHUNK - WIDTH + 1
PAD = 256
_BLOCK_CHUNKS = 512


def chunked(text: bytes) -> np.ndarray:
    """Overlapping chunks of a text, [chunks, CHUNK], padded at the end."""
    codes = np.frombuffer(text, dtype=np.uint8)
    n = max(1, -(-max(0, len(codes) - WIDTH + 1) // STEP))
    padded = np.full((n - 1) * STEP + CHUNK, PAD, dtype=np.int16)
    padded[: len(codes)] = codes
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]


@dataclass
class ByteConvNet:
    embedding: np.ndarray = field(default_factory=lambda: np.zeros((PAD + 1, EMBED), np.float32))
    filters: np.ndarray = field(default_factory=lambda: np.zeros((WIDTH * EMBED, FILTERS), np.float32))
    shift: np.ndarray = field(default_factory=lambda: np.zeros(FILTERS, np.float32))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(2 * FILTERS, np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(1, np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.shift, self.weight, self.bias]

    def pooled(self, chunks: np.ndarray, places: bool = False):
        """Greatest response of each filter in each chunk, [chunks, FILTERS]; with ``places`` also where."""
        windows = np.lib.stride_tricks.sliding_window_view(self.embedding[chunks], WIDTH, axis=1)
        flat = np.ascontiguousarray(windows.transpose(0, 1, 3, 2)).reshape(-1, WIDTH * EMBED)
        responses = (flat @ self.filters).reshape(len(chunks), STEP, FILTERS)
        if places:
            at = responses.argmax(axis=1)
            best = np.take_along_axis(responses, at[:, None, :], 1)[:, 0] + self.shift
            return np.maximum(best, 0), at
        return np.maximum(responses.max(axis=1) + self.shift, 0)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities of label 1; chunks of many texts share a block, a long text spans several."""
        total = np.zeros((len(texts), FILTERS), np.float64)
        top = np.zeros((len(texts), FILTERS), np.float32)
        count = np.zeros(len(texts), np.int64)
        block, owners, held = [], [], 0

        def flush() -> None:
            pooled = self.pooled(np.concatenate(block))
            owner = np.concatenate(owners)
            np.add.at(total, owner, pooled)
            np.maximum.at(top, owner, pooled)
            np.add.at(count, owner, 1)

        for i, text in enumerate(texts):
            chunks = chunked(text)
            for k in range(0, len(chunks), _BLOCK_CHUNKS):
                part = chunks[k : k + _BLOCK_CHUNKS]
                block.append(part)
                owners.append(np.full(len(part), i))
                held += len(part)
                if held >= _BLOCK_CHUNKS:
                    flush()
                    block, owners, held = [], [], 0
        if block:
            flush()
        features = np.concatenate([total / np.maximum(count, 1)[:, None], top], axis=1)
        logits = features @ self.weight.astype(np.float64) + float(self.bias[0])
        return 1 / (1 + np.exp(-np.clip(logits, -60, 60)))


def _gradients(net: ByteConvNet, texts: list[bytes], labels: np.ndarray) -> list[np.ndarray]:
    """Of the mean log loss; a maximum passes its gradient to the window that attained it."""
    parts = [chunked(t) for t in texts]
    sizes = np.array([len(p) for p in parts])
    chunks = np.concatenate(parts)
    owner = np.repeat(np.arange(len(texts)), sizes)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    blocks = [net.pooled(chunks[k : k + _BLOCK_CHUNKS], True) for k in range(0, len(chunks), _BLOCK_CHUNKS)]
    pooled, at = (np.concatenate(x) for x in zip(*blocks))
    mean = np.add.reduceat(pooled, first, axis=0) / sizes[:, None]
    top = np.maximum.reduceat(pooled, first, axis=0)
    features = np.concatenate([mean, top], axis=1)
    logits = np.clip(features @ net.weight + net.bias[0], -60, 60)
    error = ((1 / (1 + np.exp(-logits)) - labels) / len(texts)).astype(np.float32)
    d_features = error[:, None] * net.weight[None]
    d_pooled = d_features[owner, :FILTERS] / sizes[owner][:, None]
    greatest = pooled == top[owner]
    d_pooled += d_features[owner, FILTERS:] * greatest / np.add.reduceat(greatest, first, axis=0, dtype=np.int64)[owner]
    d_pooled = d_pooled.astype(np.float32) * (pooled > 0)
    rows, filters = np.nonzero(d_pooled)
    places = at[rows, filters]
    codes = chunks[rows[:, None], places[:, None] + np.arange(WIDTH)]
    g = d_pooled[rows, filters]
    inputs = net.embedding[codes].reshape(len(rows), -1)
    d_filters = np.zeros((FILTERS, WIDTH * EMBED), np.float32)
    np.add.at(d_filters, filters, inputs * g[:, None])
    d_embedding = np.zeros_like(net.embedding)
    np.add.at(d_embedding, codes.ravel(), (net.filters.T[filters] * g[:, None]).reshape(-1, EMBED))
    return [d_embedding, d_filters.T, d_pooled.sum(axis=0), features.T @ error, error.sum(keepdims=True)]


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.02) -> ByteConvNet:
    """Train with Adam from a fixed seed; constant 0.5 if the labels are of one kind."""
    net = ByteConvNet()
    if len(set(labels.tolist())) < 2:
        return net
    rng = np.random.default_rng(11)
    net.embedding[:] = rng.normal(0, 0.5, net.embedding.shape)
    net.filters[:] = rng.normal(0, (WIDTH * EMBED) ** -0.5, net.filters.shape)
    net.weight[:] = rng.normal(0, 0.1, net.weight.shape)
    net.bias[:] = np.log(labels.mean() / (1 - labels.mean()))
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    # A batch holds texts of similar length, so that its size in chunks varies little.
    by_length = np.argsort([len(t) for t in texts], kind="stable")
    groups = [by_length[k : k + batch] for k in range(0, len(texts), batch)]
    step = 0
    for epoch in range(epochs):
        lr = rate * (1 - epoch / epochs)
        for g in rng.permutation(len(groups)):
            step += 1
            ids = groups[g]
            gradients = _gradients(net, [texts[i] for i in ids], labels[ids])
            for p, d, (m, v) in zip(net.parameters(), gradients, moments):
                m += 0.1 * (d - m)
                v += 0.01 * (d * d - v)
                p -= (lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def held_out() -> F.Column:
    """Rows never learned from: crc32 of the id's decimal text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def train_classifier(
    docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = 1024, sample_bytes: int = 32768
) -> ByteConvNet:
    """Fit on a bounded sample of the labelled rows that are not held out."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    # Twice the rows wanted, as some texts may be too long; a bounded table, so it may be broadcast.
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample_rows)
    texts = docs.select("doc_id", "text").where(F.octet_length("text") <= sample_bytes)
    rows = texts.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample_rows)
    sample = rows.select("y", F.encode("text", "UTF-8").alias("bytes")).toArrow()
    return fit(sample["bytes"].to_pylist(), sample["y"].to_numpy().astype(np.float32))


def quality_scores(docs: DataFrame, net: ByteConvNet) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.5) of every row."""
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        release()
        return pa.array(net.scores([(t or "").encode() for t in texts.to_pylist()]))

    scored = docs.select("doc_id", score("text").alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
