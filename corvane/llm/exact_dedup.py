"""Exact dedup: a tree merge of sorted digest runs.

Every partition sorts the digests of its texts into a run that keeps the smallest identifier of each. In each round the
partitions exchange halves of their runs along one bit of their number (a binomial exchange; `fan_in` above 2 makes it one
digit of that radix), merge what they get and again keep the smallest verified identifier, so after all rounds every partition
holds one finished range of digests. Rows are ordered by a 64-bit digest; two are the same text only if their SHA-256
and length agree too. A round moves each surviving digest once, never a text.

A run travels in cells of at most CELL records that carry their first digest. A task takes its cells in order of that
digest, so a merge streams: what is below the next cell's first digest is finished and leaves, and a task holds about
as many cells as it merges runs, however long they are.

Defined results: a null text or a null doc_id is never a duplicate and isn't compared. Empty texts equal each other; texts
are digested whole, however long. Rows that repeat a doc_id count as copies of one document and give no pair of a document
with itself. Ties go to the smallest doc_id. An empty table gives an empty one. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, partitions, read_table, written

CELL = 1 << 16
_RUN = "dest int, first decimal(20,0), run binary"
#: A run's record: sort digest, verification digest, length, smallest identifier, documents seen.
RECORD = np.dtype([("key", "<u8"), ("sha", "S32"), ("length", "<i8"), ("keep", "<i8"), ("n", "<i8")])


def merged(runs: list[np.ndarray]) -> np.ndarray:
    """Multiway merge of sorted runs; each verified digest keeps its smallest identifier and the sum of its counts."""
    rows = np.concatenate(runs) if runs else np.zeros(0, RECORD)
    if not len(rows):
        return rows
    key = rows["key"]
    rows = rows[np.argsort(key, kind="stable")]  # timsort: a merge of the runs that it finds
    key = rows["key"]
    tied = np.zeros(len(rows), bool)
    same = key[1:] == key[:-1]
    tied[1:] |= same
    tied[:-1] |= same
    if not tied.any():
        return rows
    t = rows[tied]
    sha = t["sha"].view("S32")
    t = t[np.lexsort((t["keep"], t["length"], sha, t["key"]))]
    first = np.ones(len(t), bool)
    first[1:] = (t["key"][1:] != t["key"][:-1]) | (t["sha"][1:] != t["sha"][:-1]) | (t["length"][1:] != t["length"][:-1])
    at = np.flatnonzero(first)
    kept = t[at].copy()
    kept["n"] = np.add.reduceat(t["n"], at)
    out = np.concatenate([rows[~tied], kept])
    return out[np.argsort(out["key"], kind="stable")]


def _streamed(cells: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """The merge of sorted cells that come in order of their first key, in sorted parts without a key in two of them."""
    held: list[np.ndarray] = []
    size = 0
    for cell in cells:
        if not len(cell):
            continue
        if size >= CELL:
            rows = merged(held)
            done = int(np.searchsorted(rows["key"], cell["key"][0]))
            if done:
                yield rows[:done]
            held, size = [rows[done:]], len(rows) - done
        held.append(cell)
        size += len(cell)
    if size:
        yield merged(held)


def _exchanged(parts: Iterator[np.ndarray], me: int, round_: int, fan_in: int, rounds: int) -> Iterator[pa.RecordBatch]:
    """The cells of a run and the partition that each goes to in this round: digit `round_` becomes the owner's."""
    width, step = fan_in**rounds, fan_in**round_
    base = me - me // step % fan_in * step
    open_: list[list[np.ndarray]] = [[] for _ in range(fan_in)]
    sizes = [0] * fan_in

    def cell(d: int) -> pa.RecordBatch:
        run = np.concatenate(open_[d])
        open_[d], sizes[d] = [], 0
        return pa.RecordBatch.from_arrays([pa.array([base + d * step], pa.int32()), pa.array([int(run["key"][0])], pa.decimal128(20)), pa.array([run.tobytes()], pa.binary())], ["dest", "first", "run"])

    for rows in parts:
        owner = (rows["key"] >> np.uint64(32)).astype(np.int64) * width >> 32
        digit = owner // step % fan_in
        for d in range(fan_in):
            mine = rows[digit == d]
            for i in range(0, len(mine), CELL):
                open_[d].append(mine[i : i + CELL])
                sizes[d] += len(open_[d][-1])
                if sizes[d] >= CELL:
                    yield cell(d)
    for d in range(fan_in):
        if sizes[d]:
            yield cell(d)


def _leaf(fan_in: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        def cells() -> Iterator[np.ndarray]:
            for b in batches:
                rows = np.zeros(b.num_rows, RECORD)
                rows["key"] = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) ^ np.uint64(1 << 63)
                rows["sha"] = np.frombuffer(b"".join(b.column(1).to_pylist()), "S32") if b.num_rows else b""
                rows["length"], rows["keep"], rows["n"] = b.column(2).to_numpy(), b.column(3).to_numpy(), 1
                yield merged([rows])

        yield from _exchanged(_streamed(cells()), TaskContext.get().partitionId() % fan_in**rounds, 0, fan_in, rounds)

    return run


def _cells(batches: Iterator[pa.RecordBatch], seen: list[int]) -> Iterator[np.ndarray]:
    for b in batches:
        for d, x in zip(b.column(0).to_pylist(), b.column(2)):
            seen[:] = [d]
            yield np.frombuffer(x.as_buffer(), RECORD)


def _exchange(round_: int, fan_in: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import chain

        seen: list[int] = []
        parts = _streamed(_cells(batches, seen))
        for first in parts:  # by then seen holds the partition's number
            yield from _exchanged(chain([first], parts), seen[0], round_, fan_in, rounds)

    return run


def _final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _streamed(_cells(batches, [])):
        rows = rows[rows["n"] > 1]
        if len(rows):
            sha = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, 32 * len(rows) + 1, 32, dtype=np.int32)), pa.py_buffer(rows["sha"].tobytes())])
            key = pa.array((rows["key"] ^ np.uint64(1 << 63)).view(np.int64))
            yield pa.RecordBatch.from_arrays([key, sha, pa.array(rows["length"].astype(np.int64)), pa.array(rows["keep"].astype(np.int64)), pa.array(rows["n"].astype(np.int64))], ["key", "sha", "length", "keep_id", "n_copies"])


def exact_duplicates(docs: DataFrame, fan_in: int = 2) -> DataFrame:
    """(doc_id, keep_id, n_copies): each document whose text an earlier one (keep_id, the smallest) also has."""
    digests = written(
        docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(
            F.xxhash64("text").alias("key"), F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").cast("bigint").alias("length"), F.col("doc_id").cast("bigint").alias("doc_id")
        ),
        "digests",
    )
    want, rounds = partitions(docs.sparkSession), 1
    while fan_in**rounds < want:
        rounds += 1
    width = fan_in**rounds
    runs = digests.coalesce(width).sortWithinPartitions("key").mapInArrow(_leaf(fan_in, rounds), _RUN)
    for i in range(rounds):
        runs = runs.repartitionById(width, F.col("dest")).sortWithinPartitions("first")
        if i + 1 < rounds:
            runs = runs.mapInArrow(_exchange(i + 1, fan_in, rounds), _RUN)
    kept = runs.mapInArrow(_final, "key bigint, sha binary, length bigint, keep_id bigint, n_copies bigint")
    result = written(digests.join(kept, ["key", "sha", "length"]).where("doc_id <> keep_id").select("doc_id", "keep_id", "n_copies").distinct(), "copies")
    discard(digests)
    return result


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = {
    "op8_exact_dedup": """
SELECT DISTINCT doc_id, keep_id, n_copies FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS n_copies
  FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL) t
WHERE doc_id <> keep_id"""
}
QUERIES = {"op8_exact_dedup": op8_exact_dedup}
