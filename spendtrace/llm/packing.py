"""Best-fit packing of tokenized documents into sequences of at most ``capacity`` tokens.

Documents are cut into pieces of ``capacity`` tokens (the last may be shorter).
A task packs the pieces of its partition one by one: each goes to the open bin
with the least free space that still holds it. Open bins are kept in a bitset
keyed by free space (one integer with a bit per free size that some bin has), so
finding the bin is a shift and a lowest set bit. At most ``open_bins`` bins are
open; when one more is needed, the fullest closes first.

Pieces arrive in blocks of about ``BLOCK_PIECES``, formed by a hash, the longest of
a block first, so that short ones fill what long ones leave; bins stay open from
block to block. Tasks are independent, so a lost one is repeated alone, and the
order is fixed, so it gives the same sequences. A task of ``blocks_per_task``
blocks leaves few bins part full.

Defined results: null and empty texts have no piece (they pack nothing), or
one piece of the closing id where a closing id is set. Repeated rows are packed
as often as they occur. Columns of the pieces other than those named pass
through ``pack``; clashing names (sequence_id, offset) raise ``ValueError``.
"""

from __future__ import annotations

import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from spendtrace.llm.kept import kept
from spendtrace.llm.spans import LETTER, PUNCTUATION, SpanIds, letters
from spendtrace.llm.staging import bounded_batches, stored
from spendtrace.llm.textnum import SPACE, segments, slices

OPEN_BINS = 4096
BLOCK_PIECES = 8192
#: ASCII punctuation that never joins a letter before it.
TAIL = b"!#$%&()*+,-./:;=?@[]^_`{|}~\"\\"


class WordIds:
    """Ids of texts under a tokenizer that never joins what ASCII blanks divide, nor letters and punctuation.

    Texts are cut there, and the tokenizer encodes each distinct part not met
    yet. Parts of letters go to it many at once, joined by spaces; each gives
    one run of tokens, whose last carries the end-of-word mark, so the ids are
    told apart by it. Any other part is encoded alone.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, i in vocabulary.items():
            self.ends_word[i] = token.endswith("</w>")
        #: Texts with these strings are encoded whole, as they stand for single ids.
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Whether ASCII letters reach the model just lower-cased, so that it can be asked directly.
        probes = ["Abc", "token", "UNUSUALNESS", "q"]
        self.direct = all(self.tokenizer.encode(p, add_special_tokens=False).ids == self._model_ids(p) for p in probes)
        self.known = SpanIds(self._encode_parts)

    def _model_ids(self, word: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(word.lower())]

    def encode(self, texts: pa.Array, closing: int | None) -> list[bytes]:
        """Ids of each text, then the closing id, as packed little-endian unsigned 32-bit integers."""
        tail = b"" if closing is None else np.array([closing], dtype="<u4").tobytes()
        out: list[bytes] = []
        for a, b, joined, at in slices(texts):
            buf = np.frombuffer(joined, dtype=np.uint8)
            counts_of, parts = [], []
            for x, y in segments(buf, SPACE):
                starts, ends = _part_spans(buf[x:y])
                ids, counts = self.known.of(buf[x:y], starts, ends)
                parts.append(ids)
                counts_of.append((starts + x, counts))
            starts = np.concatenate([s for s, _ in counts_of])
            total = np.concatenate([[0], np.cumsum(np.concatenate([c for _, c in counts_of]))])
            cut = (4 * total[np.searchsorted(starts, at)]).tolist()
            flat = np.concatenate(parts).astype("<u4").tobytes()
            for i in range(b - a):
                out.append(flat[cut[i] : cut[i + 1]] + tail)
            for special in self.special:
                if special.encode() in joined:
                    for i in range(a, b):
                        if special in (texts[i].as_py() or ""):
                            out[i] = self._alone(texts[i].as_py()) + tail
        return out

    def _encode_parts(self, parts: list[bytes]) -> list[bytes]:
        out: dict[bytes, bytes] = {}
        plain = [p for p in parts if p.isalpha()] if self.direct else []
        for p in plain:
            out[p] = array("I", self._model_ids(p.decode())).tobytes()
        joinable = [p for p in parts if p not in out and _letters(p)]
        for k in range(0, len(joinable), 1024):
            group = joinable[k : k + 1024]
            ids = np.array(self.tokenizer.encode(b" ".join(group).decode(), add_special_tokens=False).ids, dtype="<u4")
            ends = (4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
            if len(ends) != len(group):
                raise ValueError("the tokenizer gives a word of letters several word ends")
            flat = ids.tobytes()
            start = 0
            for p, end in zip(group, ends):
                out[p] = flat[start:end]
                start = end
        return [out[p] if p in out else self._alone(p.decode()) for p in parts]

    def _alone(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def _part_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, cut between a letter and punctuation."""
    inside = ~SPACE[buf]
    letter, mark = letters(buf), PUNCTUATION[buf]
    cut = np.zeros(len(buf) + 1, dtype=bool)
    cut[1:-1] = (inside[1:] != inside[:-1]) | (letter[:-1] & mark[1:]) | (mark[:-1] & LETTER[buf[1:]])
    cut[0] = cut[-1] = True
    edges = np.flatnonzero(cut)
    starts, ends = edges[:-1], edges[1:]
    words = inside[starts]
    return starts[words], ends[words]


def _letters(word: bytes) -> bool:
    """Whether the word is letters only, also once composed and lower-cased."""
    text = word.decode()
    return text.isalpha() and (text.isascii() or unicodedata.normalize("NFC", text).lower().isalpha())


def word_ids(path: str) -> WordIds:
    return kept(("word ids", path), lambda: WordIds(path))


PIECE = T.StructType(
    [
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


def tokenized_pieces(docs: DataFrame, path: str, capacity: int = 2048, closing: int | None = 0) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) of each piece of each row's whole text."""
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("binary")
    def encoded(texts: pa.Array) -> pa.Array:
        return pa.array(word_ids(path).encode(texts, closing), pa.binary())

    # Else the filter on the ids goes below them, and each text is tokenized twice, by two workers a task.
    encoded = encoded.asNondeterministic()
    rows = docs.select("doc_id", encoded("text").alias("all_ids"))
    total = F.octet_length("all_ids") / 4
    piece = F.explode(F.sequence(F.lit(0), (F.ceil(total / capacity) - 1).cast("int")))
    cut = rows.where(F.octet_length("all_ids") > 0).select("doc_id", "all_ids", piece.alias("piece"))
    start = F.col("piece").cast("long") * capacity
    part = F.substring(F.col("all_ids"), (4 * start + 1).cast("int"), F.lit(4 * capacity))
    cut = cut.select("doc_id", "piece", start.alias("start"), part.alias("ids"))
    return cut.select("doc_id", "piece", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), "ids")


class OpenBins:
    """Bins by free space: a list of bins per free size, and a bit for each size that has any."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = 0
        self.open = 0
        self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece: the tightest open bin, or a new one."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if self.open == self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            number, free = self.made, self.capacity
            self.made += 1
        left = free - length
        if left:
            self.by_free[left].append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.capacity - free

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        number = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.open -= 1
        return number


def pack(
    pieces: DataFrame, capacity: int = 2048, open_bins: int = OPEN_BINS, blocks_per_task: int = 24
) -> DataFrame:
    """``pieces`` with sequence_id and offset: the place of each piece in its sequence, gapless from 0."""
    if {"sequence_id", "offset"} & set(pieces.columns):
        raise ValueError("pieces already have sequence_id or offset")
    blocks = max(1, -(-pieces.count() // BLOCK_PIECES))
    tasks = -(-blocks // blocks_per_task)
    # Hashed with all its columns, so that the pieces of a repeated id spread, too.
    block = F.pmod(F.xxhash64("doc_id", "piece", "start", "length"), F.lit(blocks))
    dealt = pieces.withColumn("pack_block", block).withColumn("pack_task", F.pmod("pack_block", F.lit(tasks)))
    order = ["pack_task", "pack_block", F.desc("length"), "doc_id", "piece"]
    dealt = dealt.repartition(tasks, "pack_task").sortWithinPartitions(*order)
    schema = T.StructType(
        pieces.schema.fields + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )

    width, names = len(pieces.columns), schema.fieldNames()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, bins = None, None
        for batch in batches:
            sequence, offset = [], []
            for t, length in zip(batch["pack_task"].to_pylist(), batch["length"].to_pylist()):
                if t != task:
                    task, bins = t, OpenBins(capacity, open_bins)
                number, at = bins.place(length)
                sequence.append((task << 40) | number)
                offset.append(at)
            kept = [batch.column(i) for i in range(width)]
            yield pa.RecordBatch.from_arrays(
                kept + [pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=names
            )

    return dealt.mapInArrow(fill, schema)


def packed_documents(docs: DataFrame, path: str, capacity: int = 2048, closing: int | None = 0) -> DataFrame:
    """Pieces of all documents with the checksum of their ids and their places; ids themselves are not shuffled."""
    pieces = tokenized_pieces(docs, path, capacity, closing)
    narrow = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(stored(narrow, "pieces"), capacity)
