"""Byte-level BPE encoding and decoding through a minimal acyclic transducer of frequent words.

Texts are cut into pieces by the public byte-level pattern, vectorised over whole buffers. The pieces of all documents are
counted; the most frequent are merged on the driver and compiled into a minimal acyclic automaton that shares
prefixes and suffixes. Every arc carries the number of words that sort before it, so a walk's sum is the word's
number, its output, which names its list of token ids. The automaton, the lists and the merge table are one file of plain arrays that
every executor memory-maps. A batch's distinct pieces walk it together; those that it doesn't hold are merged exactly,
again together, by the rank table. So ids never depend on what the lexicon holds.

Vocabularies are public files, given by path; nothing is trained. Defined results: a null text has null ids, an empty one no ids.
A null doc_id stays. Repeated rows repeat. Other columns are ignored by encoded(). Texts of any length are
cut and merged whole.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import buffers, chunks, plain, ragged, ranges
from .common import put_file, read_table, written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LEXICON = 1 << 16
CHUNK = 2 << 20
_LONG = 96


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """0 white space, 1 letter, 2 number, 3 other, of every code point."""
    import regex

    out = np.full(0x110000, 3, np.uint8)
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    where = np.r_[0:0xD800, 0xE000:0x110000]
    for kind, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (0, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, points):
            out[where[m.start() : m.end()]] = kind
    return out


def pieces(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First byte of each piece of the texts in raw (of UTF-8), by the pattern
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ ."""
    if not len(raw):
        return np.zeros(0, np.int64)
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    if len(at) == len(raw):
        point = raw.astype(np.uint32)
    else:
        point = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(point)
    kind = np.append(_kinds()[point], 9)  # one past the end, of no kind
    point = np.append(point, 0)
    head = np.zeros(n + 1, bool)  # of a text
    head[np.searchsorted(at, offsets[:-1][np.diff(offsets) > 0])] = True
    head[n] = True
    run = head.copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    lead = np.flatnonzero(run[1:] & ~head[1:] & (kind[1:] != 0) & (kind[:-1] == 0)) + 1  # after white space
    start[lead - 1] = True
    start[lead[point[lead - 1] == 32]] = False
    quote = np.flatnonzero((point[:-1] == 39) & run[:-1] & start[:-1])
    quote = quote[(kind[quote + 1] == 1) & ~head[quote + 1]]
    c1 = point[quote + 1]
    one = quote[np.isin(c1, (115, 116, 109, 100))]
    start[one + 1] = False
    start[one[(kind[one + 2] == 1) & ~head[one + 2]] + 2] = True
    two = quote[np.isin(c1, (114, 118, 108))]
    two = two[(two + 2 < n) & ~head[np.minimum(two + 2, n)]]
    c1, c2 = point[two + 1], point[two + 2]
    two = two[((c1 == 108) & (c2 == 108)) | ((c1 != 108) & (c2 == 101))]
    start[two + 1] = False
    start[two[(kind[two + 3] == 1) & ~head[two + 3]] + 3] = True
    return at[np.flatnonzero(start[:n])]


def hash_table(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Open addressing with linear probing at a load of at most a quarter: (keys or -1, values) by slot."""
    mask = (1 << max(4, int(4 * len(keys)).bit_length())) - 1
    slots, held = np.full(mask + 1, -1, np.int64), np.zeros(mask + 1, np.int32)
    todo, at = np.arange(len(keys)), _slot(keys, mask)
    while len(todo):
        free = slots[at] == -1
        slots[at[free]] = keys[todo[free]]  # of several that want a slot, the last gets it
        mine = slots[at] == keys[todo]
        held[at[mine]] = values[todo[mine]]
        todo, at = todo[~mine], (at[~mine] + 1) & mask
    return slots, held


def _slot(keys: np.ndarray, mask: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) & mask


def probed(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, default: int) -> np.ndarray:
    """Values of keys in a hash_table()."""
    slots, held = table
    mask = len(slots) - 1
    at = _slot(keys, mask)
    got = slots[at]
    out = np.where(got == keys, held[at], default).astype(np.int64)
    todo = np.flatnonzero((got != keys) & (got != -1))
    while len(todo):
        at_ = at[todo] = (at[todo] + 1) & mask
        got, want = slots[at_], keys[todo]
        hit = got == want
        out[todo[hit]] = held[at_[hit]]
        todo = todo[~hit & (got != -1)]
    return out


class Merges:
    """A rank file's merges: byte pairs of lowest rank first, as in any byte-level BPE."""

    def __init__(self, byte_ids: np.ndarray, keys: np.ndarray, ids: np.ndarray, size: int):
        self.byte_ids, self.keys, self.ids, self.size = byte_ids, keys, ids, size
        self.pairs = hash_table(keys, ids)

    @classmethod
    def of(cls, ranks: dict[bytes, int]) -> Merges:
        size = max(ranks.values()) + 1
        pairs = sorted((ranks[t[:i]] * size + ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks)
        both = np.array(pairs, np.int64).reshape(-1, 2)
        return cls(np.array([ranks[bytes([b])] for b in range(256)], np.int32), both[:, 0].copy(), both[:, 1].copy(), size)

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge, or size where there is none."""
        return probed(self.pairs, left.astype(np.int64) * self.size + right, self.size)

    @property
    def table(self) -> dict[int, int]:
        if not hasattr(self, "_table"):
            self._table = dict(zip(self.keys.tolist(), self.ids.tolist()))
        return self._table

    def one(self, piece: bytes) -> list[int]:
        """The merges of one piece of any length, by a heap."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n, table, size = len(ids), self.table, self.size
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := table.get(ids[i] * size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := table.get(r * size + ids[after[i]])) is not None:
                    heapq.heappush(heap, (x, i, r, ids[after[i]]))
            if (p := before[i]) >= 0 and (x := table.get(ids[p] * size + r)) is not None:
                heapq.heappush(heap, (x, p, ids[p], r))
        return [t for t in ids if t >= 0]

    def many(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after the other, number of each): merged together, one merge of every piece a step."""
        n = len(start)
        token, word = self.byte_ids[raw[ranges(start, size)]].astype(np.int64), np.repeat(np.arange(n), size)
        done_token, done_word = [], []

        def ranked(place: np.ndarray) -> np.ndarray:
            """Ranks of the merges of these places with the next."""
            out = np.full(len(place), self.size, np.int64)
            inner = np.flatnonzero(place + 1 < len(token))
            inner = inner[word[place[inner]] == word[place[inner] + 1]]
            out[inner] = self.joined(token[place[inner]], token[place[inner] + 1])
            return out

        rank = ranked(np.arange(len(token)))
        while len(token):
            new = np.ones(len(token), bool)
            new[1:] = word[1:] != word[:-1]
            first = np.flatnonzero(new)
            least = np.minimum.reduceat(rank, first)
            best = np.repeat(least, np.diff(np.append(first, len(token))))
            over = best == self.size
            done_token.append(token[over])
            done_word.append(word[over])
            hit = np.flatnonzero((rank == best) & ~over)
            if not len(hit):
                break
            hit = hit[np.append(True, word[hit][1:] != word[hit][:-1])]
            token[hit] = rank[hit]
            stay = ~over
            stay[hit + 1] = False
            place = (np.cumsum(stay) - 1)[hit]
            token, word, rank = token[stay], word[stay], rank[stay]
            rank[place] = ranked(place)
            before = place[place > 0] - 1
            rank[before] = ranked(before)
        token, word = np.concatenate(done_token or [token]), np.concatenate(done_word or [word])
        order = np.argsort(word, kind="stable")
        return token[order], np.bincount(word, minlength=n)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def minimal_automaton(words: Iterable[bytes]) -> dict[str, np.ndarray]:
    """The minimal acyclic automaton of sorted distinct words, as arrays: a hash table of arcs by state << 8 | byte,
    their target states and numbers of words before them; which states end a word; state 0 is where walks begin."""
    register: dict[tuple, int] = {}
    finals, arcs, counts = [], [], []

    def frozen(final: bool, edges: list[tuple[int, int]]) -> int:
        key = (final, tuple(edges))
        state = register.get(key)
        if state is None:
            state = register[key] = len(finals)
            finals.append(final)
            arcs.append(key[1])
            counts.append(final + sum(counts[t] for _, t in edges))
        return state

    path: list[list] = [[False, []]]  # unfinished states along the last word
    previous = b""
    for word in words:
        common = 0
        limit = min(len(word), len(previous))
        while common < limit and word[common] == previous[common]:
            common += 1
        for i in range(len(previous), common, -1):
            final, edges = path.pop()
            path[-1][1].append((previous[i - 1], frozen(final, edges)))
        for _ in range(common, len(word)):
            path.append([False, []])
        path[-1][0] = True
        previous = word
    for i in range(len(previous), 0, -1):
        final, edges = path.pop()
        path[-1][1].append((previous[i - 1], frozen(final, edges)))
    root = frozen(*path[0])
    swap = lambda s: root if s == 0 else 0 if s == root else s
    keys, targets, skipped = [], [], []
    for s, edges in enumerate(arcs):
        before = int(finals[s])
        for byte, t in edges:
            keys.append(swap(s) << 8 | byte)
            targets.append(swap(t))
            skipped.append(before)
            before += counts[t]
    ends = np.array(finals, bool)
    ends[[0, root]] = ends[[root, 0]]
    slots, held = hash_table(np.array(keys, np.int64), np.arange(len(keys)))
    return {"arc_slots": slots, "arc_held": held, "targets": np.array(targets, np.int32), "skipped": np.array(skipped, np.int64), "ends": ends}


def looked_up(a: dict[str, np.ndarray], raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Number of each piece in the automaton's order, -1 where it isn't a word of it."""
    out = np.full(len(start), -1, np.int64)
    slots, arcs, targets, skipped, ends = a["arc_slots"], a["arc_held"], a["targets"], a["skipped"], a["ends"]
    who, state, total, j = np.arange(len(start)), np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), 0
    begin, left = start.copy(), size.copy()
    while len(who):
        over = left == j
        if over.any():
            full = over & ends[state]
            out[who[full]] = total[full]
            go = ~over
            who, state, total, begin, left = who[go], state[go], total[go], begin[go], left[go]
            if not len(who):
                break
        key = state << 8 | raw[begin + j]
        i = probed((slots, arcs), key, -1)
        hit = i >= 0
        if not hit.all():
            i, who, total, begin, left = i[hit], who[hit], total[hit], begin[hit], left[hit]
        state, total = targets[i].astype(np.int64), total + skipped[i]
        j += 1
    return out


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    head, body, at = {}, [], 0
    for name, x in arrays.items():
        data = np.ascontiguousarray(x).tobytes()
        head[name] = [x.dtype.str, list(x.shape), at]
        body.append(data + b"\0" * (-len(data) % 64))
        at += len(body[-1])
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    return len(text).to_bytes(8, "little") + text + b"".join(body)


def mapped(path: str) -> dict[str, np.ndarray]:
    """The arrays of packed(), memory-mapped."""
    whole = np.memmap(path, np.uint8, "r")
    n = int.from_bytes(whole[:8].tobytes(), "little")
    out = {}
    for name, (kind, shape, at) in json.loads(whole[8 : 8 + n].tobytes()).items():
        size = np.dtype(kind).itemsize * int(np.prod(shape))
        out[name] = np.asarray(whole[8 + n + at : 8 + n + at + size]).view(kind).reshape(shape)
    return out


def compiled(ranks: dict[bytes, int], frequent: Iterable[bytes]) -> dict[str, np.ndarray]:
    """All that encoding and decoding need, as arrays."""
    merges = Merges.of(ranks)
    words = sorted(set(frequent) - {b""})
    data = np.frombuffer(b"".join(words), np.uint8)
    size = np.array([len(w) for w in words], np.int64)
    ids, per = merges.many(data, np.cumsum(size) - size, size)
    byte_at = np.zeros(merges.size + 1, np.int64)
    tokens = [b""] * merges.size
    for t, r in ranks.items():
        tokens[r] = t
    np.cumsum([len(t) for t in tokens], out=byte_at[1:])
    return minimal_automaton(words) | {
        "list_at": np.concatenate([[0], np.cumsum(per)]), "list_ids": ids.astype(np.int32),
        "byte_ids": merges.byte_ids, "pair_keys": merges.keys, "pair_ids": merges.ids,
        "token_at": byte_at, "token_bytes": np.frombuffer(b"".join(tokens), np.uint8),
    }


class Codec:
    """Encodes and decodes whole buffers with the arrays of compiled()."""

    def __init__(self, a: dict[str, np.ndarray]):
        self.a = a
        self.merges = Merges(a["byte_ids"], a["pair_keys"], a["pair_ids"], len(a["token_at"]) - 1)

    @classmethod
    def on_executor(cls, name: str) -> Codec:
        from pyspark import SparkFiles

        return cls(mapped(SparkFiles.get(name)))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of each text's)."""
        raw, offsets = buffers(column)
        begin = pieces(raw, offsets)
        if not len(begin):
            return np.zeros(0, np.int32), np.zeros(len(column), np.int64)
        edges = np.append(begin, len(raw))
        coded = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(edges), pa.py_buffer(raw)]).dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False)
        data, at = buffers(coded.dictionary.cast(pa.large_binary()))
        start, size = at[:-1], np.diff(at)
        number = looked_up(self.a, data, start, size)
        known = number >= 0
        per = np.zeros(len(start), np.int64)
        per[known] = self.a["list_at"][number[known] + 1] - self.a["list_at"][number[known]]
        rest = np.flatnonzero(~known & (size <= _LONG))
        ids, n = self.merges.many(data, start[rest], size[rest])
        per[rest] = n
        long = [(i, self.merges.one(data[at[i] : at[i + 1]].tobytes())) for i in np.flatnonzero(~known & (size > _LONG))]
        for i, x in long:
            per[i] = len(x)
        list_at = np.concatenate([[0], np.cumsum(per)])
        pool = np.zeros(list_at[-1], np.int32)
        k = np.flatnonzero(known)
        pool[ranges(list_at[k], per[k])] = self.a["list_ids"][ranges(self.a["list_at"][number[k]], per[k])]
        pool[ranges(list_at[rest], n)] = ids
        for i, x in long:
            pool[list_at[i] : list_at[i + 1]] = x
        each = per[which]
        out = pool[ranges(list_at[which], each)]
        upto = np.concatenate([[0], np.cumsum(each)])
        cut = upto[np.searchsorted(begin, offsets)]
        return out, np.diff(cut)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, one after the other."""
        at = self.a["token_at"]
        return self.a["token_bytes"][ranges(at[ids], at[ids + 1] - at[ids])]


def piece_counts(docs: DataFrame, flush: int = 400_000) -> DataFrame:
    """(piece, n): how often each piece occurs in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for table in chunks(batches, "text", CHUNK):
            raw, offsets = buffers(plain(table.column("text")))
            begin = pieces(raw, offsets)
            if not len(begin):
                continue
            coded = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(raw))), pa.py_buffer(raw)]).dictionary_encode()
            new = pa.table({"piece": coded.dictionary.cast(pa.binary()), "n": np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary))})
            held = new if held is None else pa.concat_tables([held, new]).group_by("piece", use_threads=False).aggregate([("n", "sum")]).rename_columns(["piece", "n"])
            if held.num_rows > flush:
                yield from held.combine_chunks().to_batches(max_chunksize=50_000)
                held = None
        if held is not None:
            yield from held.combine_chunks().to_batches(max_chunksize=50_000)

    return docs.select("text").mapInArrow(run, "piece binary, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, k: int) -> DataFrame:
    """The k pieces of largest n, ties by piece. A histogram of n finds the least n to take, so that only about k rows are sorted."""
    by_n = counts.groupBy("n").agg(F.count("*").alias("pieces"))
    above = F.sum("pieces").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1))
    least = by_n.withColumn("above", F.coalesce(above, F.lit(0))).where(F.col("above") < k).agg(F.min("n")).first()[0]
    return counts.where(F.col("n") >= F.lit(least)).orderBy(F.desc("n"), "piece").limit(k)


def prepared(docs: DataFrame, vocabulary: str = VOCABULARY, lexicon: int = LEXICON) -> str:
    """Count, compile and hand out the transducer of the `lexicon` most frequent pieces of docs; returns its file's name."""
    top = frequent(written(piece_counts(docs), "pieces"), lexicon).select("piece").toArrow().column("piece").to_pylist()
    return put_file(docs.sparkSession, "lexicon.bin", packed(compiled(read_ranks(vocabulary), top)))


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY, lexicon: int = LEXICON) -> DataFrame:
    """(doc_id, ids, n_tokens, exact): token ids of every text; exact: decoding them gives the text's bytes again."""
    name = prepared(docs, vocabulary, lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.on_executor(name)
        for table in chunks(batches, "text", CHUNK):
            null = table.column("text").combine_chunks().is_null().to_numpy(zero_copy_only=False)
            column = plain(table.column("text"))
            ids, count = codec.encode(column)
            raw, offsets = buffers(column)
            back = codec.decode(ids)
            if len(back) == len(raw) and (back == raw).all():
                exact = np.ones(len(count), bool)
            else:
                cut = np.concatenate([[0], np.cumsum(count)])
                exact = np.array([codec.decode(ids[cut[i] : cut[i + 1]]).tobytes() == raw[offsets[i] : offsets[i + 1]].tobytes() for i in range(len(count))])
            lists = ragged(ids, count, pa.int32())
            if null.any():
                lists = pc.if_else(pa.array(null), pa.scalar(None, lists.type), lists)
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), lists, pa.array(count, pa.int64(), mask=null), pa.array(exact, mask=null)], ["doc_id", "ids", "n_tokens", "exact"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, ids array<int>, n_tokens bigint, exact boolean")


def decoded(tokens: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); bytes that aren't UTF-8 become replacement characters, null ids a null text."""
    name = put_file(tokens.sparkSession, "lexicon.bin", packed(compiled(read_ranks(vocabulary), [])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.on_executor(name)
        for b in batches:
            texts = [None if x is None else codec.decode(np.array(x, np.int64)).tobytes().decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids").mapInArrow(run, "doc_id bigint, text string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(read_table(spark, sf_dir, "documents"))


QUERIES = {"op6_bpe": op6_bpe}
