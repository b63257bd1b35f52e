"""Token-ID output: best-fit-decreasing packing into fixed-length sequences.

Texts are tokenised (an end token closes each document), documents longer than a sequence are split without loss into
full sequences and a rest, and the pieces are packed best-fit-decreasing: the longest piece first, always into the open
sequence with the least sufficient room, which a segment tree over the capacities finds.  Each packed sequence is one
row: a row of the id matrix and of the position matrix as little-endian binary, and the cumulative lengths of its
segments.

Documents are dealt by hash into blocks of about ``block_docs`` documents, and each block is packed by itself; a block that
comes to more than ``block_tokens`` tokens is packed in parts, so a task's memory is bounded however long the documents or
however hot a key.  Blocks depend on the rows alone, not on partitions, so reruns agree.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_partitions, slices, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenisation pattern that belongs to the byte-level vocabulary of 50,256 ranks.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PACKED = "block long, part int, seq int, n_tokens int, n_segments int, doc_ids array<long>, pieces array<int>, cu_seqlens array<int>, ids binary, position_ids binary"


class Encoder:
    """Token ids of texts as little-endian bytes."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.dtype = np.dtype("<u2" if self.end < 1 << 16 else "<u4")

    def encode(self, text: str) -> bytes:
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype(self.dtype).tobytes()

    def decode(self, ids: bytes) -> str:
        """The text of a document's ids, with or without its end token."""
        return self.encoding.decode([i for i in np.frombuffer(ids, self.dtype).tolist() if i != self.end])


class Capacities:
    """A segment tree over capacities 0..most: how many open sequences have that much room."""

    def __init__(self, most: int):
        self.half = 1 << most.bit_length()
        self.tree = [0] * (2 * self.half)

    def add(self, capacity: int, n: int) -> None:
        i, tree = capacity + self.half, self.tree
        while i:
            tree[i] += n
            i >>= 1

    def least(self, need: int) -> int:
        """The least capacity of ``need`` or more that an open sequence has, or -1."""
        tree, i = self.tree, need + self.half
        if tree[i]:
            return need
        while i > 1:
            if not i & 1 and tree[i + 1]:
                i += 1
                while i < self.half:
                    i = 2 * i if tree[2 * i] else 2 * i + 1
                return i - self.half
            i >>= 1
        return -1


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Indices of the pieces of each sequence; equal sizes keep their order."""
    room, open_, bins = Capacities(length), [[] for _ in range(length + 1)], []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        capacity = room.least(size)
        if capacity < 0:
            b, capacity = len(bins), length
            bins.append([])
        else:
            b = open_[capacity].pop()
            room.add(capacity, -1)
        bins[b].append(i)
        if capacity > size:
            open_[capacity - size].append(b)
            room.add(capacity - size, 1)
    return bins


_encoders: dict[int, Encoder] = {}


def _encoder(vocabulary: bytes, pattern: str) -> Encoder:
    """The encoder, built once in each Python worker."""
    key = hash((vocabulary, pattern))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary, pattern)
    return _encoders[key]


def _pack(sent, pattern: str, length: int, block_tokens: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value, pattern)
        width, end = encoder.dtype.itemsize, np.array([encoder.end], encoder.dtype).tobytes()
        schema = None

        def close(block, part, pieces):
            """Pack the pieces (doc_id, number, ids as bytes)."""
            bins = best_fit_decreasing([len(p[2]) // width for p in pieces], length)
            for at in range(0, len(bins), 256):
                rows = []
                for seq, own in enumerate(bins[at : at + 256], at):
                    sizes = [len(pieces[i][2]) // width for i in own]
                    total = sum(sizes)
                    positions = np.concatenate([*(np.arange(n) for n in sizes), np.zeros(length - total, int)]).astype(encoder.dtype)
                    ids = b"".join([*(pieces[i][2] for i in own), end * (length - total)])
                    rows.append((block, part, seq, total, len(own), [pieces[i][0] for i in own], [pieces[i][1] for i in own], np.r_[0, np.cumsum(sizes)].tolist(), ids, positions.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        schema = pa.schema(
            [("block", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("n_tokens", pa.int32()), ("n_segments", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())), ("cu_seqlens", pa.list_(pa.int32())), ("ids", pa.binary()), ("position_ids", pa.binary())]
        )
        now, part, pieces, held = None, 0, [], 0
        for batch in slices(batches):
            for block, doc, text in zip(batch.column("block").to_pylist(), batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if block != now or held >= block_tokens * width:
                    if pieces:
                        yield from close(now, part, pieces)
                    part = part + 1 if block == now else 0
                    now, pieces, held = block, [], 0
                ids = encoder.encode(text or "") + end
                held += len(ids)
                pieces += [(doc, i, ids[at : at + length * width]) for i, at in enumerate(range(0, len(ids), length * width))]
        if pieces:
            yield from close(now, part, pieces)

    return work


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, length: int = 2048, block_docs: int = 2048, block_tokens: int = 8_000_000, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Packed sequences of ``length`` token ids, one a row (``PACKED``).

    ``ids`` and ``position_ids`` are ``length`` little-endian integers (16 bits if the vocabulary allows, else 32): the
    rest behind ``n_tokens`` holds the end token and position 0.  Segment i has the ids ``cu_seqlens[i]`` to
    ``cu_seqlens[i + 1]``, piece ``pieces[i]`` of document ``doc_ids[i]``; positions start anew with each segment.
    Pieces of a document in order are its ids and the end token: null and empty texts have the end token alone.  Rows
    that repeat an id are documents of their own (their pieces carry the same id).  Null ids stay null; other columns are
    ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())  # a vocabulary file: about a megabyte
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = max(1, -(-rows.count() // block_docs))
    dealt = rows.withColumn("h", F.xxhash64("id", "text")).withColumn("block", F.pmod("h", F.lit(blocks)))
    dealt = dealt.repartition(min(blocks, 8 * shuffle_partitions(spark)), "block").sortWithinPartitions("block", "h", "id").select("block", "id", "text")
    return dealt.mapInArrow(_pack(sent, pattern, length, block_tokens), PACKED)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
