"""Benchmark decontamination with one FM-index per training shard.

Test phrases are the word n-grams (default 8) of every benchmark item; an item shorter than that is one phrase, unless it
has fewer than `least` words. A shard is about 4 MB of consecutive whole texts. Its words are coded by the phrases'
alphabet and cut at words outside of it, which no phrase can cross, so only runs as long as the shortest phrase are
indexed: suffix array by prefix doubling, Burrows-Wheeler transform in a wavelet matrix, suffix positions sampled every
few symbols. All phrases are searched backward at once; occurrences are located by walking to the next sample, and
overlapping or adjoining ones of a document merge into removal spans. Nothing is shuffled: shards are built, searched
and dropped where their texts are read. Phrases are collected in slices of bounded size and reach executors as files,
so neither the driver nor a task holds more than one slice: with several, a task reads one after the other for each shard.

Words are compared without case; see arrays.words(). Defined results: a null or empty text has no span; a null doc_id
gives spans with a null doc_id; rows that repeat have equal spans; benchmark rows with a null item_id or text are
ignored and repeated ones change nothing; items that share a phrase are all named; an empty benchmark or corpus gives no
spans. A text is never cut between shards, however long. Other columns, whatever their names, pass through decontaminate() untouched.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import buffers, chunks, plain, ranges, words
from .common import put_file, read_table

N, LEAST = 8, 5
SHARD_BYTES, SAMPLE = 4 << 20, 8
SLICE_WORDS = 4_000_000


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffixes of seq in order. Zeros are separators, each smaller than any symbol and than later zeros; the last is one."""
    n = len(seq)
    zero = seq == 0
    start = np.where(zero, np.cumsum(zero) - 1, zero.sum() + seq.astype(np.int64))
    sa = np.argsort(start, kind="stable")
    at = np.arange(n)

    def named(key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place of each equal-key group, for every member; whether the member's group has others."""
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        lone = new.copy()
        lone[:-1] &= new[1:]
        return np.maximum.accumulate(np.where(new, place, 0)), ~lone

    first, many = named(start[sa], at)
    rank = np.empty(n, np.int64)
    rank[sa] = first
    active, h = at[many], 1
    while len(active):
        i = sa[active]
        key = rank[i] * (n + 1) + rank[i + h]
        order = np.argsort(key, kind="stable")
        i, key = i[order], key[order]
        sa[active] = i
        first, many = named(key, active)
        rank[i] = first
        active = active[many]
        h *= 2
    return sa


class Wavelet:
    """A wavelet matrix: rank of a symbol before a place by one directory look-up a bit of the symbol."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.bits = max(1, int(alphabet - 1).bit_length())
        self.ones, self.zeros = [], []
        a = symbols
        for b in range(self.bits - 1, -1, -1):
            bit = (a >> b) & 1
            ones = np.zeros(len(a) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(a) - int(ones[-1]))
            a = np.concatenate([a[bit == 0], a[bit == 1]])
        self.base = self._down(np.arange(alphabet), np.zeros(alphabet, np.int64))

    def _down(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for level in range(self.bits):
            ones = self.ones[level][place]
            place = np.where((symbol >> (self.bits - 1 - level)) & 1, self.zeros[level] + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        return self._down(symbol, place) - self.base[symbol]


class FMIndex:
    """Counts and locates sequences of symbols 1..alphabet-1 in seq, whose zeros are separators (the last symbol is one)."""

    def __init__(self, seq: np.ndarray, alphabet: int, sample: int = SAMPLE):
        sa = suffix_array(seq)
        self.bwt = seq[sa - 1].astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=alphabet))])
        self.tree = Wavelet(self.bwt, alphabet)
        sampled = (sa % sample == 0) | (self.bwt[:] == 0)  # a walk never has to cross a separator
        self.sampled = sampled
        self.before = np.cumsum(sampled) - sampled
        self.held = sa[sampled]

    def count(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix array intervals [low, high) of phrases, an array with a phrase a row."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.bwt), np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, j]
            both = self.tree.rank(np.concatenate([c, c]), np.concatenate([low[live], high[live]]))
            low[live], high[live] = self.first[c] + both[: len(live)], self.first[c] + both[len(live) :]
            found = low[live] < high[live]
            high[live[~found]] = low[live[~found]]
            live = live[found]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        place, steps, todo = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        row = rows.copy()
        while len(todo):
            r = row[todo]
            done = self.sampled[r]
            place[todo[done]] = self.held[self.before[r[done]]] + steps[todo[done]]
            todo, r = todo[~done], r[~done]
            c = self.bwt[r]
            row[todo] = self.first[c] + self.tree.rank(c, r)
            steps[todo] += 1
        return place


def phrase_slices(benchmark: DataFrame, n: int, least: int, slice_words: int = SLICE_WORDS) -> Iterator[dict[str, np.ndarray]]:
    """Phrases by slices: vocabulary of word hashes, distinct phrases (codes, right-aligned), lengths, items of each."""

    def made(rows: list[tuple[int, str]]) -> dict[str, np.ndarray] | None:
        item = np.array([i for i, _ in rows], np.int64)
        hashes, doc, _, _ = words(plain(pa.array([t for _, t in rows], pa.string())))
        vocabulary, code = np.unique(hashes, return_inverse=True)
        per = np.bincount(doc, minlength=len(rows))
        begin = np.cumsum(per) - per
        size = np.minimum(per, n)
        grams = np.where(per >= min(least, n), per - size + 1, 0)
        owner = np.repeat(np.arange(len(rows)), grams)
        if not len(owner):
            return None
        at = ranges(begin, grams)
        out = np.zeros((len(owner), n), np.int32)
        for j in range(n):
            has = size[owner] > j
            out[has, n - size[owner[has]] + j] = code[at[has] + j] + 1
        phrases, which = np.unique(out, axis=0, return_inverse=True)
        link = np.unique(np.stack([which.reshape(-1), item[owner]], 1), axis=0)
        return {"vocabulary": vocabulary, "phrases": phrases, "length": (phrases > 0).sum(axis=1), "link_start": np.searchsorted(link[:, 0], np.arange(len(phrases) + 1)), "link_item": link[:, 1]}

    held: list[tuple[int, str]] = []
    total = 0
    rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("bigint"), "text")
    for item, text in rows.toLocalIterator():
        held.append((item, text))
        total += len(text) // 4
        if total >= slice_words:
            if (s := made(held)) is not None:
                yield s
            held, total = [], 0
    if held and (s := made(held)) is not None:
        yield s


def shipped(spark: SparkSession, slices: Iterator[dict[str, np.ndarray]]) -> list[str]:
    """Slices as files on every executor."""
    names = []
    for s in slices:
        out = io.BytesIO()
        np.savez(out, **s)
        names.append(put_file(spark, "phrases.npz", out.getvalue()))
    return names


def occurrences(hashes: np.ndarray, doc: np.ndarray, s: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, phrase) of every occurrence of a slice's phrases in the words of a shard."""
    none = np.zeros(0, np.int64)
    vocabulary, lengths = s["vocabulary"], s["length"]
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    code = np.where(vocabulary[at] == hashes, at + 1, 0).astype(np.int32)
    cut = np.ones(len(code) + 1, bool)  # a run ends before this word
    if len(code):
        cut[1:-1] = (code[1:] == 0) | (code[:-1] == 0) | (doc[1:] != doc[:-1])
    edge = np.flatnonzero(cut)
    begin, size = edge[:-1], np.diff(edge)
    keep = (size >= lengths.min()) & (code[begin] > 0) if len(begin) else np.zeros(0, bool)
    begin, size = begin[keep], size[keep]
    if not len(begin):
        return none, none
    end = np.cumsum(size + 1)
    seq = np.zeros(end[-1], np.int32)
    origin = np.full(end[-1], -1, np.int64)
    place, source = ranges(end - size - 1, size), ranges(begin, size)
    seq[place], origin[place] = code[source], source
    index = FMIndex(seq, len(vocabulary) + 1)
    starts, which = [], []
    n = s["phrases"].shape[1]
    for size_ in np.unique(lengths):
        those = np.flatnonzero(lengths == size_)
        low, high = index.count(s["phrases"][those][:, n - size_ :].astype(np.int64))
        found = high > low
        rows = ranges(low[found], (high - low)[found])
        starts.append(origin[index.locate(rows)])
        which.append(np.repeat(those[found], (high - low)[found]))
    return np.concatenate(starts), np.concatenate(which)


def merged_spans(start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, end, span of each input) after merging occurrences of a document that overlap or adjoin; sorted input."""
    reach = np.maximum.accumulate(end)  # starts grow with documents, so reach never passes on to the next document
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] > reach[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return start[at], np.maximum.reduceat(end, at) if len(at) else end, np.cumsum(new) - 1


def _spans(table: pa.Table, loaded: Iterable[dict[str, np.ndarray]]):
    """Removal spans of a shard in words, with what is needed to name or cut them."""
    hashes, doc, first, end = words(plain(table.column("text")))
    starts, ends, items = [], [], []
    for s in loaded:
        start, which = occurrences(hashes, doc, s)
        lists = (s["link_start"][which + 1] - s["link_start"][which]).astype(np.int64)
        starts.append(np.repeat(start, lists))
        ends.append(np.repeat(start + s["length"][which], lists))
        items.append(s["link_item"][ranges(s["link_start"][which], lists)])
    start, stop, item = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends, items))
    order = np.argsort(start, kind="stable")
    start, stop, item = start[order], stop[order], item[order]
    a, b, span = merged_spans(start, stop, doc[start]) if len(start) else (start, stop, start)
    return doc, first, end, a, b, span, item


class _Slices:
    """The slices of phrases, one after the other from files; a single one stays in memory."""

    def __init__(self, names: list[str]):
        self.names, self.held = names, None

    def __iter__(self) -> Iterator[dict[str, np.ndarray]]:
        from pyspark import SparkFiles

        for name in self.names:
            s = self.held
            if s is None:
                with np.load(SparkFiles.get(name)) as z:
                    s = {k: z[k] for k in z.files}
                self.held = s if len(self.names) == 1 else None
            yield s


def _report(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = _Slices(names)
        for table in chunks(batches, "text", SHARD_BYTES):
            doc, _, _, a, b, span, item = _spans(table, loaded)
            if not len(a):
                continue
            owner = doc[a]
            base = np.searchsorted(doc, owner, "left")
            pair = np.unique(np.stack([span, item], 1), axis=0)
            cut = np.searchsorted(pair[:, 0], np.arange(len(a) + 1))
            named = [",".join(map(str, pair[cut[i] : cut[i + 1], 1])) for i in range(len(a))]
            ids = table.column("doc_id").combine_chunks().take(pa.array(owner)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(a - base), pa.array(b - base), pa.array(named)], ["doc_id", "start_word", "end_word", "items"])

    return run


def _cut(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = _Slices(names)
        for table in chunks(batches, "text", SHARD_BYTES):
            column = plain(table.column("text"))
            doc, first, end, a, b, _, _ = _spans(table, loaded)
            if len(a):
                raw, offsets = buffers(column)
                edge = np.zeros(len(raw) + 1, np.int32)
                np.add.at(edge, first[a], 1)
                np.add.at(edge, end[b - 1], -1)
                stays = np.cumsum(edge[:-1]) == 0
                upto = np.concatenate([[0], np.cumsum(stays)])[offsets]
                text = pa.Array.from_buffers(pa.large_string(), len(column), [None, pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(raw[stays])])
                lost, had = np.bincount(doc[a], weights=b - a, minlength=len(column)), np.bincount(doc, minlength=len(column))
                at = table.schema.get_field_index("text")
                text = pa.chunked_array([text]).cast(table.schema.field(at).type)
                null = table.column("text").is_null()
                text = pa.compute.if_else(null, pa.scalar(None, text.type), text)
                table = table.set_column(at, table.schema.field(at), text).filter(pa.array((lost == 0) | (lost < had)))
            yield from table.to_batches()

    return run


def leak_spans(docs: DataFrame, benchmark: DataFrame, n: int = N, least: int = LEAST, slice_words: int = SLICE_WORDS) -> DataFrame:
    """(doc_id, start_word, end_word, items): words [start_word, end_word) of a text, counted from 0, are of these items."""
    names = shipped(docs.sparkSession, phrase_slices(benchmark, n, least, slice_words))
    return docs.select("doc_id", "text").mapInArrow(_report(names), "doc_id bigint, start_word bigint, end_word bigint, items string")


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, least: int = LEAST) -> DataFrame:
    """docs with their removal spans cut out of text; a document of which no word is left goes."""
    names = shipped(docs.sparkSession, phrase_slices(benchmark, n, least))
    return docs.mapInArrow(_cut(names), docs.schema)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_spans(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+')"
SQL = {
    "op7_decontamination": f"""
WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
phrase AS (
  SELECT DISTINCT item_id, CASE WHEN len(w) < {N} THEN w ELSE w[i:i + {N - 1}] END AS p
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - {N - 1}, 1))) AS i FROM item WHERE len(w) >= {LEAST}) t),
size AS (SELECT DISTINCT len(p) AS n FROM phrase),
doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
gram AS (
  SELECT r, doc_id, i - 1 AS s, i - 1 + n AS e, w[i:i + n - 1] AS p
  FROM (SELECT r, doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM doc, size WHERE len(w) >= n) t),
hit AS (SELECT r, doc_id, s, e, item_id FROM gram JOIN phrase USING (p)),
mark AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY r ORDER BY s, e, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM hit),
span AS (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY s, e, item_id ROWS UNBOUNDED PRECEDING) AS k FROM mark),
named AS (SELECT r, k, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, k, item_id FROM span) t GROUP BY r, k)
SELECT doc_id, start_word, end_word, items FROM (SELECT r, k, any_value(doc_id) AS doc_id, CAST(min(s) AS BIGINT) AS start_word, CAST(max(e) AS BIGINT) AS end_word FROM span GROUP BY r, k) x JOIN named USING (r, k)"""
}
QUERIES = {"op7_decontamination": op7_decontamination}
