"""Near-duplicate search by DartMinHash signatures of weighted word shingles.

A document is a weighted set: its word n-grams (default 3) weighted by how often they occur. Each unit of an element's
weight throws darts: a Poisson process of intensity 1 along a rank axis, drawn by hashing (element, unit, dart), so equal
elements throw equal darts in every document. A document takes the darts with a rank below theta = t / weight, about
t = k (ln k + 3) whatever its size; each dart's hash names one of k coordinates, and every coordinate keeps its dart of
earliest rank. Two documents agree in a coordinate with probability equal to their weighted Jaccard similarity. If a
coordinate got no dart, theta is doubled for that document, so signatures are exact for every size.

Documents of equal signature are one before anything is joined. Signatures are cut into bands; documents that share a
band are compared with the band's smallest document by the whole signature, so a band of n copies costs n comparisons.
Members that aren't similar to that one are compared with every other member if the band has at most `wide` of them. In a
wider band that would be quadratic: where many documents share a passage, their signatures agree in the passage's darts and in
little else. There the darts themselves are counted, over all documents of such bands, and every document keeps its rarest ones:
as many as leave out one dart less than similar documents agree in, so two similar ones have one of these in common. Documents
that have such a dart in common are compared with the smallest of them, and those unlike it with every other one. If that makes
many pairs, the components found so far are taken first, and only documents of different ones are compared. All this is exact,
so nothing of a band is dropped, however wide it is: what limits recall is the one banding, which tests measure.
Groups are the connected components of the similar pairs.

Defined results: a null doc_id takes no part; null texts, empty ones and texts without a word are in no group; an empty table gives
an empty one; a text shorter than a shingle is one shingle; texts are taken whole, however long. Ties go to the smaller
doc_id: the smallest of a group stays. Rows that repeat a doc_id are compared by each of their texts, and the document
goes with the smallest keeper that any of these has. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import chunks, counts_by, mix, plain, words
from .common import discard, read_table, written

SHINGLE, COORDINATES, ROWS = 3, 160, 4
THRESHOLD = 0.5
WIDE = 64
CROSSED = 16  # pairs a document that are compared without regard to what is connected already
BROADCAST_IDS = 1 << 20  # 8 MB of ids
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.zeros(0, np.uint64)


def shingles(hashes: np.ndarray, doc: np.ndarray, n_docs: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each word n-gram; a shorter document's words are one shingle."""
    per = counts_by(doc, n_docs)
    begin = np.cumsum(per) - per
    size = np.minimum(per, n)
    grams = np.where(per > 0, per - size + 1, 0)
    owner = np.repeat(np.arange(n_docs), grams)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(grams) - grams, grams) + begin[owner]
    value = np.zeros(len(owner), np.uint64)
    for j in range(n):
        has = size[owner] > j
        value = np.where(has, mix(value * _GOLD + hashes[np.minimum(at + j, len(hashes) - 1)] + np.uint64(j)), value) if len(owner) else value
    return value, owner


def signatures(element: np.ndarray, doc: np.ndarray, n_docs: int, k: int = COORDINATES) -> np.ndarray:
    """Of fewer than 2^20 documents, an (n_docs, k) array of 32-bit dart names; repeated elements weigh as often as they occur. Rows of empty documents are 0."""
    weight = counts_by(doc, n_docs)
    out = np.zeros((n_docs, k), np.uint32)
    if not len(element):
        return out
    order = np.argsort((doc.astype(np.uint64) << np.uint64(44)) | (element >> np.uint64(20)), kind="stable")
    e, d = element[order] >> np.uint64(20), doc[order]
    start = np.ones(len(e), bool)
    start[1:] = (e[1:] != e[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(start)
    unit = np.arange(len(e)) - np.repeat(at, np.diff(np.append(at, len(e))))
    seed = mix(e * _GOLD + unit.astype(np.uint64) + np.uint64(1))
    theta = np.full(n_docs, k * (np.log(k) + 3.0)) / np.maximum(weight, 1)
    want = weight > 0
    while want.any():
        take = want[d]
        s, o = seed[take], d[take]
        limit = theta[o]
        rank = np.zeros(len(s))
        best = np.full(n_docs * k, np.inf)
        darts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        m = 0
        while len(s):
            m += 1
            u = mix(s + np.uint64(m * int(_GOLD) & 0xFFFFFFFFFFFFFFFF))
            rank = rank - np.log(((u >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53)
            live = rank < limit
            s, o, rank, limit, u = s[live], o[live], rank[live], limit[live], u[live]
            name = mix(u ^ s)
            cell = o * k + ((name >> np.uint64(32)) % np.uint64(k)).astype(np.int64)
            np.minimum.at(best, cell, rank)
            darts.append((cell, rank, name.astype(np.uint32)))
        flat = out.reshape(-1)
        for cell, rank, name in darts:
            first = best[cell] == rank
            flat[cell[first]] = name[first]
        missing = np.isinf(best).reshape(n_docs, k).any(axis=1) & want
        theta[missing] *= 2
        want = missing
    return out


def _binaries(rows: np.ndarray) -> pa.Array:
    size = rows.dtype.itemsize * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, size * len(rows) + 1, size, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _sketch(shingle: int, k: int, rows: int):
    bands = k // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, "text", 1 << 20):
            hashes, doc, _, _ = words(plain(table.column("text")))
            n = table.num_rows
            element, owner = shingles(hashes, doc, n, shingle)
            # As many darts are thrown for a short text as for a long one, so texts are signed in blocks.
            cut = np.searchsorted(owner, np.arange(0, n + 400, 400))
            sig = np.concatenate([signatures(element[a:b], owner[a:b] - 400 * i, min(400, n - 400 * i), k) for i, (a, b) in enumerate(zip(cut, cut[1:])) if n > 400 * i])
            some = np.flatnonzero(counts_by(owner, n) > 0)
            sig = sig[some]
            if not len(some):
                continue
            whole = np.zeros(len(some), np.uint64)
            band = np.zeros((len(some), bands), np.uint64)
            for j in range(k):
                v = sig[:, j].astype(np.uint64)
                b = band[:, j // rows]
                band[:, j // rows] = mix((b + v + np.uint64(1 + j)) * _GOLD)
            for b in range(bands):
                whole = mix(whole * _GOLD + band[:, b])
            ids = table.column("doc_id").combine_chunks().take(pa.array(some))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.cast(pa.int64()),
                    pa.array(whole.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, bands * len(some) + 1, bands, dtype=np.int32)), pa.array(band.reshape(-1).view(np.int64))),
                    _binaries(sig),
                    _binaries(sig.astype(np.uint16)),
                ],
                ["doc_id", "whole", "bands", "sig", "short"],
            )

    return run


def _similar(k: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            left, right = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(n, k) if n else np.zeros((0, k), np.uint16) for i in (2, 3))
            share = (left == right).sum(axis=1) / k
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(share), pa.array(share >= threshold)], ["a", "b", "share", "near"])

    return run


def _verified(pairs: DataFrame, sketches: DataFrame, k: int, threshold: float) -> DataFrame:
    """(a, b, share, near) of pairs of representatives, by 16 bits of each dart: one dart in 65,536 that differ looks equal."""
    sig = sketches.select("rep", "short")
    both = pairs.join(sig.withColumnsRenamed({"rep": "a", "short": "sa"}), "a").join(sig.withColumnsRenamed({"rep": "b", "short": "sb"}), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(_similar(k, threshold), "a bigint, b bigint, share double, near boolean")


def _shortened(k: int):
    """(rep, sig, short): 16 bits of each dart beside whole signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(b.num_rows, k)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _binaries(sig.astype(np.uint16))], ["rep", "sig", "short"])

    return run


def _darts(k: int):
    """(rep, dart) of all coordinates of signatures; a dart is named by its coordinate and its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 4000):
                part = b.slice(i, 4000)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(part.num_rows, k).astype(np.int64)
                dart = (np.arange(k, dtype=np.int64) << 32 | sig).reshape(-1)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), k)), pa.array(dart)], ["rep", "dart"])

    return run


def _pairs(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Distinct (a, b), a > b, of documents of left and right that share `on`."""
    both = left.select(on, F.col("rep").alias("x")).join(right.select(on, F.col("rep").alias("y")), on).where("x <> y")
    return both.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def _banded(banded: DataFrame, reps: DataFrame, k: int, threshold: float, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For (rep, band): (band, rep, head) of bands of several, (a, b, share, near) of members and heads, (band, rep, n) of those unlike their head; n: the band's size."""
    heads = banded.groupBy("band").agg(F.min("rep").alias("head"), F.count("*").alias("n")).where("n > 1")
    members = written(banded.join(heads, "band").where("rep <> head").distinct(), f"{name}-members")
    star = written(_verified(members.select(F.col("rep").alias("a"), F.col("head").alias("b")).distinct(), reps, k, threshold), f"{name}-star")
    unlike = members.join(star.where("NOT near").select(F.col("a").alias("rep"), F.col("b").alias("head")), ["rep", "head"], "left_semi")
    return members, star, written(unlike.select("band", "rep", "n"), f"{name}-unlike")


def _wide(members: DataFrame, unlike: DataFrame, reps: DataFrame, links: DataFrame, k: int, threshold: float, wide: int) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b) of similar documents: with links, they connect all similar documents of bands of more than `wide`, one at least unlike its head; tables that they need."""
    need = next(c for c in range(k + 1) if c / k >= threshold)
    odd = unlike.where(F.col("n") > wide)
    searched = written(odd.select("rep").distinct(), "searched")
    there = members.join(odd.select("band").distinct(), "band", "left_semi").select("rep").distinct()
    there = written(there, "there")
    # Ids alone, sent to all executors where they are counted to be few; else both sides are shuffled, the signatures without their short form.
    few = F.broadcast(there) if there.count() <= BROADCAST_IDS else there
    among = written(reps.select("rep", "sig").join(few, "rep").select("rep", "sig").mapInArrow(_shortened(k), "rep bigint, sig binary, short binary"), "among")
    discard(there)
    darts = written(among.select("rep", "sig").mapInArrow(_darts(k), "rep bigint, dart bigint"), "darts")
    counts = written(darts.groupBy("dart").agg(F.count("*").alias("n")).where("n > 1"), "dart-counts")
    listed = darts.join(counts, "dart").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "dart"))).alias("darts")).where(F.size("darts") >= need)
    rarest = written(listed.select("rep", F.explode(F.expr(f"slice(darts, 1, size(darts) - {need - 1}).dart")).alias("band")), "rarest")
    discard(darts)
    discard(counts)
    asked = rarest.join(rarest.join(searched, "rep", "left_semi").select("band").distinct(), "band", "left_semi")
    members, star, unlike = _banded(asked, among, k, threshold, "rare")
    discard(rarest)
    links = links.union(star.where("near").select("a", "b"))
    held = [searched, among, members, star, unlike]
    if (unlike.agg(F.sum("n")).first()[0] or 0) > CROSSED * among.count():
        roots = written(components(links), "roots")
        held.append(roots)
        pairs = _across(members, roots)
    else:
        asks = lambda df: df.join(searched, "rep", "left_semi")
        pairs = _pairs(asks(unlike), members, "band").union(_pairs(unlike, asks(members), "band")).distinct()
    return star.where("near").select("a", "b").union(_verified(pairs, among, k, threshold).where("near").select("a", "b")), held


def _across(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Distinct (a, b), a > b, of members of a band that are in different components: those outside the band's largest one with all."""
    placed = members.select("band", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("band", "rep", F.coalesce("root", "rep").alias("root"))
    main = placed.groupBy("band", "root").agg(F.count("*").alias("n")).groupBy("band").agg(F.max(F.struct("n", "root")).alias("m"), F.count("*").alias("roots")).where("roots > 1")
    rest = placed.join(main.select("band", F.col("m.root").alias("main")), "band").where("root <> main")
    both = rest.select("band", F.col("rep").alias("x"), F.col("root").alias("rx")).join(placed.select("band", F.col("rep").alias("y"), F.col("root").alias("ry")), "band").where("rx <> ry")
    return both.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node of its component.

    Alternates large-star and small-star steps; the number of rounds grows with the logarithm of the largest component.
    """
    e = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.where("a > m")).distinct()
        lows = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lows, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        new = written(small, "edges")
        mark = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        done = mark(new) == mark(e)
        discard(e)
        e = new
        if done:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, coordinates: int = COORDINATES, rows: int = ROWS, threshold: float = THRESHOLD, wide: int = WIDE) -> DataFrame:
    """(doc_id, keep_id) for each document of a near-duplicate group but its smallest, keep_id."""
    sketched = written(docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text").mapInArrow(_sketch(shingle, coordinates, rows), "doc_id bigint, whole bigint, bands array<bigint>, sig binary, short binary"), "sketches")
    same = written(sketched.groupBy("whole").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "same")
    reps = written(sketched.join(same.select("whole", F.col("rep").alias("doc_id"), "rep"), ["whole", "doc_id"]).select("rep", "bands", "sig", "short"), "reps")
    equal = written(sketched.select("doc_id", "whole").join(same.where("n > 1").select("whole", "rep"), "whole").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "equal")
    discard(sketched)
    discard(same)
    members, star, unlike = _banded(reps.select("rep", F.explode("bands").alias("band")), reps, coordinates, threshold, "band")
    candidates = _pairs(unlike.where(F.col("n") <= wide), members, "band")
    near = written(star.where("near").select("a", "b").union(_verified(candidates, reps, coordinates, threshold).where("near").select("a", "b")), "near")
    links, held = near, [reps, members, star, unlike]
    if not unlike.where(F.col("n") > wide).isEmpty():
        more, tables = _wide(members, unlike, reps, near, coordinates, threshold, wide)
        links, held = near.union(written(more, "near")), held + tables
    for t in held:
        discard(t)
    roots = written(components(links), "roots")
    # Equal documents hang on their representative: no more rounds for them.
    of_equal = equal.join(roots.withColumnRenamed("node", "b"), "b", "left").select(F.col("a").alias("node"), F.coalesce("root", "b").alias("root"))
    found = roots.union(of_equal)
    return found.where("node <> root").groupBy(F.col("node").alias("doc_id")).agg(F.min("root").alias("keep_id"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op5_near_dedup": op5_near_dedup}
