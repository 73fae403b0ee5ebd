"""Token packing: best-fit-decreasing bins with segment-tree capacity search, as binary id matrices.

Documents are encoded (bpe.Codec, so ids don't depend on partitions) where they are read. A text longer than a row is split
losslessly: full rows of its own, and the rest. Pieces are then placed longest first, each into the open row with the
least room that still holds it; a segment tree over capacities finds that row in log2(row length) steps. Packing works
on windows of `window` tokens of consecutive documents, so no token is shuffled and memory stays bounded at any size.

A row of the result is one row of the id matrix: input_ids, `length` little-endian unsigned integers padded with
`pad`; position_ids, as many positions that restart at 0 with each segment and are 0 in the padding; cu_seqlens, cumulative segment
lengths from 0; the segments' doc_ids and their first token's offset in the document. Documents are told apart by
their row (doc_id may be null or repeat). Defined results: null and empty texts have no tokens and are in no row; ties
go to the earlier document. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import chunks, plain, ragged, ranges
from .bpe import CHUNK, VOCABULARY, Codec, compiled, packed, read_ranks
from .common import put_file, read_table

LENGTH, WINDOW, PAD = 2048, 8 << 20, 50256
SCHEMA = "row_tokens int, input_ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<bigint>, doc_offsets array<int>"


class Capacities:
    """A segment tree over capacities 0..length: which is the least one >= x that an open row has."""

    def __init__(self, length: int):
        self.width = 1 << length.bit_length()
        self.tree = [0] * (2 * self.width)
        self.rows: list[list[int]] = [[] for _ in range(self.width)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        i = capacity + self.width
        tree = self.tree
        while i:
            tree[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, row) of the fullest row with room for need, which is then no longer open."""
        tree, i = self.tree, need + self.width
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.width:
                i *= 2
                if not tree[i]:
                    i += 1
        capacity = i - self.width
        while i:
            tree[i] -= 1
            i >>= 1
        return capacity, self.rows[capacity].pop()


def best_fit_decreasing(sizes: np.ndarray, length: int) -> tuple[np.ndarray, int]:
    """(row of each piece, number of rows); sizes are in 1..length, ties go in order."""
    row = np.zeros(len(sizes), np.int64)
    open_, n = Capacities(length), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        found = open_.take(size)
        capacity, r = found if found else (length, n)
        n += not found
        row[i] = r
        if capacity > size:
            open_.add(capacity - size, r)
    return row, n


def packed_rows(ids: np.ndarray, doc: list[tuple[int | None, int]], length: int, pad: int) -> pa.RecordBatch:
    """The rows of one window: doc has (doc_id, tokens) of each document with tokens, ids all their tokens."""
    count = np.array([n for _, n in doc], np.int64)
    parts = -(-count // length)
    owner = np.repeat(np.arange(len(doc)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    size = np.minimum(count[owner] - nth * length, length)
    source = (np.cumsum(count) - count)[owner] + nth * length
    row, n = best_fit_decreasing(size, length)
    order = np.argsort(row, kind="stable")
    owner, nth, size, source, row = owner[order], nth[order], size[order], source[order], row[order]
    per = np.bincount(row, minlength=n)
    upto = np.cumsum(size)
    first = np.cumsum(per) - per
    at = (upto - size) - np.repeat((upto - size)[first], per)  # in its row
    kind = np.dtype("<u2") if pad < 1 << 16 and (not len(ids) or int(ids.max()) < 1 << 16) else np.dtype("<u4")
    matrix, position = np.full(n * length, pad, kind), np.zeros(n * length, "<u4" if length > 1 << 16 else "<u2")
    target = ranges(row * length + at, size)
    matrix[target] = ids[ranges(source, size)]
    position[target] = ranges(np.zeros(len(size), np.int64), size)
    ends = np.zeros(len(size) + n, np.int32)
    ends[np.arange(len(size)) + row + 1] = at + size
    names = pa.array([d for d, _ in doc], pa.int64()).take(pa.array(owner))

    def binary(m: np.ndarray) -> pa.Array:
        step = m.dtype.itemsize * length
        return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, n * step + 1, step, dtype=np.int32)), pa.py_buffer(m)])

    lists = pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.bincount(row, weights=size, minlength=n).astype(np.int32)), binary(matrix), binary(position), ragged(ends, per + 1, pa.int32()), pa.ListArray.from_arrays(lists, names), pa.ListArray.from_arrays(lists, pa.array((nth * length).astype(np.int32)))],
        ["row_tokens", "input_ids", "position_ids", "cu_seqlens", "doc_ids", "doc_offsets"],
    )


def packed_documents(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, window: int = WINDOW, pad: int = PAD) -> DataFrame:
    """Rows of the packed id matrix of docs; see the module's docstring for the columns."""
    name = put_file(docs.sparkSession, "merges.bin", packed(compiled(read_ranks(vocabulary), [])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.on_executor(name)
        ids: list[np.ndarray] = []
        doc: list[tuple[int | None, int]] = []
        held = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            if doc:
                batch = packed_rows(np.concatenate(ids), doc, length, pad)
                for i in range(0, batch.num_rows, 500):
                    yield batch.slice(i, 500)

        for table in chunks(batches, "text", CHUNK):
            new, count = codec.encode(plain(table.column("text")))
            ids.append(new.astype(np.uint16) if codec.merges.size <= 1 << 16 else new)
            doc += [(d, n) for d, n in zip(table.column("doc_id").to_pylist(), count.tolist()) if n]
            held += len(new)
            if held >= window:
                yield from flushed()
                ids, doc, held = [], [], 0
        yield from flushed()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(read_table(spark, sf_dir, "documents"))


QUERIES = {"op3_packing": op3_packing}
