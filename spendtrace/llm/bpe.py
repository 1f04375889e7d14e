"""Byte-level BPE encoding and decoding over a rank file, in padded numpy matrices.

Pieces of a text (matches of the split pattern) are encoded apart. Pieces that
are not a token themselves go, bucketed by length, into padded matrices of
token ids, one piece a row. In each round every row merges its leftmost pair of
minimum rank; ranks come from a hash table of token pairs. A merge takes one
column, so rows are compacted and finished ones leave. A piece longer than
``MATRIX_BYTES`` merges through a heap instead, as rounds would cost its square.

A worker keeps the ids of chunks of text in a table of bounded size, since words
repeat across texts.

Defined results: null and empty texts have no ids and decode to no bytes.
Special-token strings are ordinary text. Null ids in a list are skipped when decoding; ids outside the
vocabulary raise ``ValueError``.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendtrace.llm.kept import kept
from spendtrace.llm.spans import LETTER, PUNCTUATION, HashTable, SpanIds, letters
from spendtrace.llm.staging import bounded_batches
from spendtrace.llm.textnum import segments, slices

NONE = np.iinfo(np.int32).max
MATRIX_BYTES = 256
#: A text with none of these has runs of blanks of one space, or of newlines only.
_ODD_BLANKS = ["  ", "\n ", " \n", *"\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000"]
_ODD_BLANKS += [chr(c) for c in range(0x2000, 0x200B)]
_ONLY_SPACE = np.arange(256) == 0x20


def _without(matrix: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Each row without one of its entries."""
    keep = np.ones(matrix.shape, dtype=bool)
    keep[row, column] = False
    return matrix[keep].reshape(len(matrix), -1)


class PairTable:
    """Hash table from a pair of ids to the id of its merge."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.table = HashTable(2 * len(merged))
        self.table.put(self._key(left, right), merged.astype(np.int32))

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids; NONE for pairs that don't merge."""
        found = self.table.get(self._key(left, right))
        return np.where(found < 0, NONE, found)


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        self.pairs = PairTable(np.array(left, np.int64), np.array(right, np.int64), np.array(merged, np.int64))
        self.merge = dict(zip(zip(left, right), merged))
        size = max(ranks.values()) + 1
        tokens: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.is_id = np.zeros(size, dtype=bool)
        self.is_id[list(ranks.values())] = True
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.packed = {token: np.int32(rank).tobytes() for token, rank in ranks.items()}
        self.known = SpanIds(self._encode_chunks)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBpe:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, as packed 32-bit integers."""
        out = [self.packed.get(p) for p in pieces]
        buckets: dict[int, list[int]] = {}
        for i in (i for i, x in enumerate(out) if x is None):
            if len(pieces[i]) > MATRIX_BYTES:
                out[i] = self._merge_long(pieces[i])
            else:
                buckets.setdefault((len(pieces[i]) - 1).bit_length(), []).append(i)
        for members in buckets.values():
            for k in range(0, len(members), 4096):
                self._merge_matrix(pieces, members[k : k + 4096], out)
        return out

    def _merge_matrix(self, pieces: list[bytes], members: list[int], out: list) -> None:
        sizes = np.array([len(pieces[i]) for i in members])
        width = int(sizes.max())
        ids = np.full((len(members), width), -1, dtype=np.int32)
        ids[np.arange(width) < sizes[:, None]] = self.byte_ids[
            np.frombuffer(b"".join([pieces[i] for i in members]), dtype=np.uint8)
        ]
        owner = np.array(members)
        rank = np.full((len(members), width - 1), NONE, dtype=np.int32)
        real = np.arange(1, width) < sizes[:, None]
        rank[real] = self.pairs.ranks(ids[:, :-1][real], ids[:, 1:][real])
        while len(owner):
            if rank.shape[1]:
                at = rank.argmin(axis=1)
                best = rank[np.arange(len(at)), at]
                done = best == NONE
            else:
                done = np.ones(len(owner), dtype=bool)
            if done.any():
                self._finish(owner[done], ids[done], sizes[done], out)
                if done.all():
                    return
                live = ~done
                owner, ids, rank, sizes, at, best = owner[live], ids[live], rank[live], sizes[live], at[live], best[live]
            row = np.arange(len(owner))
            ids[row, at] = best
            ids = _without(ids, row, at + 1)
            rank = _without(rank, row, at)
            sizes = sizes - 1
            for place in (at - 1, at):
                ok = np.flatnonzero((place >= 0) & (place < sizes - 1))
                p = place[ok]
                rank[ok, p] = self.pairs.ranks(ids[ok, p], ids[ok, p + 1])

    @staticmethod
    def _finish(owner: np.ndarray, ids: np.ndarray, sizes: np.ndarray, out: list) -> None:
        flat = ids[np.arange(ids.shape[1]) < sizes[:, None]].tobytes()
        ends = np.cumsum(4 * sizes).tolist()
        start = 0
        for i, end in zip(owner.tolist(), ends):
            out[i] = flat[start:end]
            start = end

    def _merge_long(self, piece: bytes) -> bytes:
        """The same merges through a heap of (rank, place) over a linked list."""
        ids = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)].tolist()
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (rank := self.merge.get((ids[i], ids[j]))) is not None:
                heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        for i in range(n):
            offer(i)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return np.array([t for t in ids if t >= 0], dtype=np.int32).tobytes()

    def encode_batch(self, texts: pa.Array) -> list[bytes]:
        """Packed ids of whole texts."""
        rows = texts.to_pylist()
        odd = {i: t for i, t in enumerate(rows) if t and any(c in t for c in _ODD_BLANKS)}
        out: list[bytes] = []
        for a, b, joined, at in slices(pa.array([None if i in odd else t for i, t in enumerate(rows)], pa.string())):
            buf = np.frombuffer(joined, dtype=np.uint8)
            # Texts end at the byte that joins them; long ones are divided before a space.
            joint = np.zeros(len(buf), dtype=bool)
            joint[at[1:] - 1] = True
            parts, firsts, sizes = [], [], []
            for x, y in segments(buf[1:], _ONLY_SPACE):
                x, y = x and x, y if y < len(buf) - 1 else len(buf)
                starts, ends = self._chunk_spans(buf[x:y], joint[x:y])
                ids, counts = self.known.of(buf[x:y], starts, ends)
                parts.append(ids)
                firsts.append(starts + x)
                sizes.append(counts)
            if parts:
                starts = np.concatenate(firsts)
                total = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
                cut = (4 * total[np.searchsorted(starts, at)]).tolist()
                flat = np.concatenate(parts).astype("<u4").tobytes()
                out.extend([flat[cut[i] : cut[i + 1]] for i in range(b - a)])
            else:
                out.extend([b""] * (b - a))
        for i, text in odd.items():
            pieces = self.split.findall(text)
            distinct = list(set(pieces))
            code = dict(zip(distinct, self.encode_pieces([p.encode() for p in distinct])))
            out[i] = b"".join([code[p] for p in pieces])
        return out

    @staticmethod
    def _chunk_spans(buf: np.ndarray, joint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cuts that no piece spans in texts without odd blanks: at single spaces, before newlines, between letters and punctuation."""
        letter, mark, line = letters(buf), PUNCTUATION[buf], buf == 0x0A
        cut = np.ones(len(buf) + 1, dtype=bool)
        cut[1:-1] = (letter[:-1] & mark[1:]) | (mark[:-1] & LETTER[buf[1:]]) | (line[1:] & ~line[:-1]) | (buf[1:] == 0x20)
        cut[1:-1] |= joint[1:] | joint[:-1]
        edges = np.flatnonzero(cut)
        starts, ends = edges[:-1], edges[1:]
        text = ~joint[starts]
        return starts[text], ends[text]

    def _encode_chunks(self, chunks: list[bytes]) -> list[bytes]:
        """Chunks are split by the pattern; distinct pieces are merged together."""
        split = []
        for c in chunks:
            text = c.decode()
            # Letters behind at most one space are one piece of the pattern.
            split.append([text] if text.isalpha() or text[0] == " " and text[1:].isalpha() else self.split.findall(text))
        distinct = list({p for part in split for p in part})
        code = dict(zip(distinct, self.encode_pieces([p.encode() for p in distinct])))
        return [code[part[0]] if len(part) == 1 else b"".join([code[p] for p in part]) for part in split]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids' tokens, gathered from the flat vocabulary."""
        if not len(ids):
            return b""
        if ids.min() < 0 or ids.max() >= len(self.is_id) or not self.is_id[ids].all():
            raise ValueError("id outside the vocabulary")
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        where = np.arange(ends[-1]) + np.repeat(self.starts[ids] - ends + lengths, lengths)
        return self.flat[where].tobytes()


def codec(path: str, pattern: str) -> ByteBpe:
    return kept(("byte bpe", path, pattern), lambda: ByteBpe.from_file(path, pattern))


def encode(text: Column, path: str, pattern: str) -> Column:
    """array<int> of the ids of a text column."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        return _id_lists(codec(path, pattern).encode_batch(texts))

    return ids(text)


def _id_lists(rows: list[bytes]) -> pa.Array:
    ends = np.cumsum([0] + [len(r) // 4 for r in rows])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(rows), np.int32)))


def decode(ids: Column, path: str, pattern: str) -> Column:
    """binary of an array<int> column of ids."""

    @F.arrow_udf("binary")
    def text(lists: pa.Array) -> pa.Array:
        bpe = codec(path, pattern)
        return pa.array([bpe.decode(_ids(x)) for x in lists], pa.binary())

    return text(ids)


def _ids(row: pa.ListScalar) -> np.ndarray:
    if row.values is None:
        return np.zeros(0, np.int32)
    values = row.values.drop_null()
    return values.to_numpy(zero_copy_only=False).astype(np.int64)


ROUND_TRIP = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids of each row's whole text, and the bytes these ids decode to; each text is encoded once."""
    bounded_batches(docs.sparkSession)

    @F.arrow_udf(ROUND_TRIP)
    def both(texts: pa.Array) -> pa.Array:
        bpe = codec(path, pattern)
        rows = bpe.encode_batch(texts)
        decoded = [bpe.decode(np.frombuffer(r, np.int32)) for r in rows]
        return pa.StructArray.from_arrays([_id_lists(rows), pa.array(decoded, pa.binary())], names=["ids", "decoded"])

    return docs.select("doc_id", both("text").alias("both")).select("doc_id", "both.ids", "both.decoded")
