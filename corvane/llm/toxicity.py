"""Toxicity by a support vector machine with a gap-weighted subsequence string kernel and Nyström landmarks.

A text's sentences are judged by their units: words cut at white space, with what is inserted in them, and runs of
single spelt-out letters ("i d i o t") as one. The kernel of two units sums, over the subsequences of 3 letters that they share,
decay^span, where a span counts gaps and inserted characters too (up to SPAN), normalised by lengths; so "id-iot" or
"idxiot" stays close to the insult. Besides, windows slide over each sentence's letters from word to word, with blanks and
symbols as gaps ("id iot", "i - d - i - o - t"): every run of its words of at most BLOCK letters and edges that has a gap inside.
There a gap counts in the span however long it is, only letters are bounded by SPAN, an accent counts with its letter, and
the kernel is normalised by the window's own gaps. A sentence ends at a blank line, or at a full stop, question or exclamation
mark after a word of two letters or more. Landmarks give a Nyström map in which a linear machine with squared hinge loss is
trained. A sentence scores as its worst unit or window and a document as its worst sentence. Labels are of documents: each
sentence of a clean one is clean; in a toxic one those sentences are taken as toxic that hold a unit found far more often
in toxic documents or, anew after each fit, the worst unit (multiple-instance learning). As kernel values against landmarks are linear in subsequences, the fitted machine folds into
one table of 32^3 numbers, and scoring is look-ups over whole buffers: one pass, no shuffle.

Training uses bounded samples of labelled documents (`toxic`, `clean`: lowest id hash, one text each). Of their units, positives are all
that qualify; negatives are the NEGATIVES most usual clean units, as many by hash, and after each fit the HARD clean units that score highest:
bounds on the labelled sample, for the driver's memory. The threshold is set on the third
of them that no fit saw; that of windows, which no fit sees, so that WINDOW_ALARMS of all clean ones in the sample pass it. Letters are in lower case, accents follow them as letters of
their own, and the bytes of other scripts share four classes.

Defined results: null and empty texts, and those without a unit of 3 letters, have score null and are not toxic; a null
doc_id stays; repeated rows score alike; a document labelled twice is toxic if either label says so; a score of exactly 0 is not
toxic; without labels of both kinds nothing is toxic; an empty table gives an empty one. Texts are read whole, however long: a
unit of more than BLOCK characters is normalised block by block, its subsequences cross the blocks. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import buffers, chunks, plain, ranges, spans
from .common import hash_order_sample, read_table

TOXIC, CLEAN = 2000, 4000
DECAY, SPAN, LANDMARKS, BLOCK = 0.8, 8, 384, 32
WINDOW_ALARMS, SLICE = 0.01, 200_000
NEGATIVES, HARD = 6000, 4000

_LETTER = np.zeros(256, np.int32)  # 0: a gap
_LETTER[97:123] = np.arange(1, 27)
_LETTER[65:91] = np.arange(1, 27)
_LETTER[128:192] = 27 + np.arange(64) % 4  # accents are letters of their own after decomposition
_EDGE = 31  # where a unit begins and ends
_INK = np.ones(256, bool)
_INK[[*range(9, 14), 32]] = False
_STOP, _CLOSE = np.zeros(256, bool), np.zeros(256, bool)
_STOP[list(b".!?")] = True
_CLOSE[list(b"\"')]}*_")] = True
_STEPS = [(d1, d2) for d2 in range(2, SPAN) for d1 in range(1, d2)]


def _norms(most: int = BLOCK) -> np.ndarray:
    """Square root of a unit's kernel with itself by its letters, were all its subsequences different."""
    out = np.array([sum(max(n - d2, 0) * DECAY ** (2 * (d2 + 1)) for _, d2 in _STEPS) for n in range(most + 1)])
    return np.sqrt(np.maximum(out, out[3]))


_NORM = _norms()


@dataclass
class Units:
    """Characters of all units, between two edges each, one after the other; long units are cut into blocks."""

    letter: np.ndarray
    left: np.ndarray  # characters to the unit's end
    start: np.ndarray  # of each block
    letters: np.ndarray  # in it, edges included
    judged: np.ndarray  # whether it has three without edges
    doc: np.ndarray


def units(column: pa.Array) -> Units:
    raw, offsets = buffers(pc.utf8_normalize(pc.utf8_lower(column), form="NFKD"))
    if (raw >= 0xC0).any():  # lead bytes say nothing
        stays = raw < 0xC0
        offsets = np.concatenate([[0], np.cumsum(stays)])[offsets]
        raw = raw[stays]
    s, e, doc = spans(raw, offsets, _INK)
    size = e - s
    new = np.ones(len(s), bool)
    own = _LETTER[raw[_INK[raw]]]
    if len(s):
        single = np.add.reduceat((own > 0).astype(np.int64), np.cumsum(size) - size) == 1
        new[1:] = ~(single[1:] & single[:-1] & (doc[1:] == doc[:-1]) & (s[1:] - e[:-1] == 1))
    first = np.flatnonzero(new)
    unit = np.repeat(np.cumsum(new) - 1, size)
    lettered = np.flatnonzero(own > 0)  # what stands before a unit's first letter and after its last is not part of it
    low, high = np.full(len(first), len(own)), np.full(len(first), -1)
    high[unit[lettered]] = lettered
    low[unit[lettered[::-1]]] = lettered[::-1]
    inside = np.arange(len(own))
    own = own[(inside >= low[unit]) & (inside <= high[unit])] if len(own) else own
    inner = np.maximum(high - low + 1, 0)
    total = inner + 2
    begin = np.cumsum(total) - total
    letter = np.full(int(total.sum()), _EDGE, np.int32)
    letter[ranges(begin + 1, inner)] = own
    left = np.repeat(begin + total, total) - np.arange(len(letter))
    blocks = -(-total // BLOCK)
    nth = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = np.repeat(begin, blocks) + nth * BLOCK
    count = lambda x: np.add.reduceat(x.astype(np.int64), start) if len(start) else start
    return Units(letter, left, start, count(letter > 0), count((letter > 0) & (letter < _EDGE)) >= 3, np.repeat(doc[first], blocks))


@dataclass
class Letters:
    """The letters of all texts, one after the other, with the words that they stand in."""

    letter: np.ndarray
    place: np.ndarray  # characters before it; an accent has its letter's
    low: np.ndarray  # of each word, its first letter
    high: np.ndarray  # and where its letters end
    sentence: np.ndarray
    doc: np.ndarray


def letters(column: pa.Array) -> Letters:
    raw, offsets = buffers(pc.utf8_normalize(pc.utf8_lower(column), form="NFKD"))
    kind, counts = _LETTER[raw], np.ones(len(raw), bool)
    if (raw >= 0x80).any():
        follows = (raw >= 0x80) & (raw < 0xC0)
        lead = raw[np.maximum.accumulate(np.where(follows, 0, np.arange(len(raw))))]
        kind[follows & ((lead == 0xC2) | (lead == 0xE2))] = 0  # dashes, quotes, invisible characters
        accent = (lead == 0xCC) | (lead == 0xCD) & (raw < 0xB0)
        counts = ~follows & ~accent
        counts[:-1] &= ~((raw[:-1] == 0xCD) & accent[1:])
    place = np.cumsum(counts)
    on = np.flatnonzero(kind > 0)
    s, e, doc = spans(raw, offsets, _INK)
    low, high = np.searchsorted(on, s), np.searchsorted(on, e)
    last = e - 1
    for _ in range(3):  # closing quotes and brackets stand after the stop
        last = np.where(_CLOSE[raw[last]] & (last > s), last - 1, last)
    lines = np.concatenate([[0], np.cumsum(raw == 10)])
    ends = _STOP[raw[last]] & (high - low > 1)
    if len(s):
        ends[:-1] |= (doc[1:] != doc[:-1]) | (lines[s[1:]] - lines[e[:-1]] > 1)
    sentence = np.cumsum(ends) - ends
    some = high > low
    return Letters(kind[on], place[on], low[some], high[some], sentence[some], doc[some])


def window_scores(x: Letters, table: np.ndarray, all_words: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first word, last word, score) of all windows: sums over subsequences in the table and their norms, by running sums.

    all_words: also words without a gap inside, which score as units do.
    """
    n, words, most = len(x.letter), len(x.low), BLOCK - 2
    if not n:
        return
    power = DECAY ** np.arange(1024)
    weight = lambda span: power[np.minimum(span, 1023)]
    whole, square = np.zeros((SPAN, n + 1)), np.zeros((SPAN, n + 1))  # by letters between the ends: sums over subsequences that begin before a letter
    code = x.letter.astype(np.int64)
    first = code << 10
    for d2 in range(2, min(SPAN, n)):
        ends = first[:-d2] | code[d2:]
        total = np.zeros(n - d2)
        for d1 in range(1, d2):
            total += table[ends | (code[d1 : n - d2 + d1] << 5)]
        w = weight(x.place[d2:] - x.place[:-d2] + 1)
        np.cumsum(total * w, out=whole[d2, 1 : n - d2 + 1])
        np.cumsum((d2 - 1) * w * w, out=square[d2, 1 : n - d2 + 1])
    padded, place = np.concatenate([np.zeros(SPAN, np.int64), code, np.zeros(SPAN, np.int64)]), np.concatenate([np.zeros(SPAN, np.int64), x.place, np.zeros(SPAN, np.int64)])
    begin, end = (np.zeros((2, SPAN, words)) for _ in range(2))  # subsequences with the edge before a word, after it, by letters reached
    for d in range(1, SPAN):
        begin[:, d], end[:, d] = begin[:, d - 1], end[:, d - 1]
        if d > 1:
            k, i = x.low + (SPAN - 1 + d), x.high + (SPAN - d)
            w, v = weight(np.maximum(place[k] - x.place[x.low], 0) + 2), weight(np.maximum(x.place[x.high - 1] - place[i], 0) + 2)
            mid = sum(table[_EDGE << 10 | padded[k - d + j] << 5 | padded[k]] for j in range(1, d))
            begin[:, d] += mid * w, (d - 1) * w * w
            mid = sum(table[padded[i] << 10 | padded[i + d - j] << 5 | _EDGE] for j in range(1, d))
            end[:, d] += mid * v, (d - 1) * v * v
    middle = np.concatenate([[0], np.cumsum(table[_EDGE << 10 | code << 5 | _EDGE])])
    first_part, last_part = begin[:, -1].copy(), end[:, -1].copy()  # of a long window: what its first and its last word bring
    for d2 in range(2, min(SPAN, n)):
        first_part -= whole[d2, x.low], square[d2, x.low]
        to = np.maximum(x.high - d2, 0)
        last_part += whole[d2, to], square[d2, to]
    least = weight(np.array([BLOCK]))[0]
    size = x.high - x.low
    holes = x.place[x.high - 1] - x.place[x.low]
    accents = np.concatenate([[0], np.cumsum(np.diff(x.place, prepend=x.place[0] - 1) == 0)])
    m = 0
    at = np.arange(words)
    while len(at):
        b_word = at + m
        a, b = x.low[at], x.high[b_word]
        count = b - a
        fits = (count <= most) & (x.sentence[b_word] == x.sentence[at])
        at, b_word, a, b, count = at[fits], b_word[fits], a[fits], b[fits], count[fits]
        if m:
            go = np.arange(len(at))
        else:
            base = count - (accents[b] - accents[a + 1])
            go = np.arange(len(at)) if all_words else np.flatnonzero(holes[at] >= base)
        go = go[count[go] >= 3]
        if len(go):
            f, t, lo, hi, c = at[go], b_word[go], a[go], b[go], count[go]
            value, norm = first_part[:, f] + last_part[:, t]
            k = np.flatnonzero(c < SPAN - 1)  # shorter than the longest subsequence
            if len(k):
                fk, tk, lo, hi, ck = f[k], t[k], lo[k], hi[k], c[k]
                v, q = begin[:, ck, fk] + end[:, ck, tk]
                for d2 in range(2, min(SPAN, n)):
                    to = np.maximum(hi - d2, lo)
                    v += whole[d2, to] - whole[d2, lo]
                    q += square[d2, to] - square[d2, lo]
                w = weight(x.place[hi - 1] - x.place[lo] + 3)
                value[k] = v + (middle[hi] - middle[lo]) * w
                norm[k] = q + ck * w * w
            yield f, t, value / np.sqrt(np.maximum(norm, least**2))
        m += 1
        at = at[at + m < words]


def _subsequences(u: Units) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(first character, code of the three letters, weight) of all subsequences, step by step; codes with a gap are included."""
    at = np.flatnonzero(u.left > 2)
    for d2 in range(2, SPAN):
        at = at[u.left[at] > d2]
        ends = (u.letter[at] << 10) | u.letter[at + d2]
        for d1 in range(1, d2):
            yield at, ends | (u.letter[at + d1] << 5), DECAY ** (d2 + 1)


def _solid() -> np.ndarray:
    """Which codes have three letters and no gap."""
    c = np.arange(32**3)
    return (c >> 10 > 0) & ((c >> 5) & 31 > 0) & (c & 31 > 0)


def unit_scores(u: Units, table: np.ndarray) -> np.ndarray:
    """Sum of the table over each block's subsequences, normalised; NaN for blocks without 3 letters."""
    total = np.zeros(len(u.letter))
    for at, code, weight in _subsequences(u):
        total[at] += table[code] * weight
    out = np.add.reduceat(total, u.start) / _NORM[np.minimum(u.letters, BLOCK)] if len(u.start) else np.zeros(0)
    out[~u.judged] = np.nan
    return out


def _sparse(u: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, code, weight) of all subsequences without a gap, normalised, in order of blocks."""
    block = np.repeat(np.arange(len(u.start)), np.diff(np.append(u.start, len(u.letter))))
    solid = _solid()
    parts = [(block[at[k]], code[k], np.full(int(k.sum()), w)) for at, code, w in _subsequences(u) for k in [solid[code]]]
    b, c, w = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0))
    order = np.argsort(b, kind="stable")
    b, c, w = b[order], c[order], w[order]
    return b, c, w / _NORM[np.minimum(u.letters[b], BLOCK)]


def kernel(u: Units, dense: np.ndarray) -> np.ndarray:
    """Kernel of each block with each landmark; dense: (codes, landmarks)."""
    b, c, w = _sparse(u)
    out, step = np.zeros((len(u.start), dense.shape[1]), np.float32), 8000
    w = w.astype(np.float32)
    for i in range(0, len(b), step):
        bb = b[i : i + step]
        first = np.flatnonzero(np.append(True, bb[1:] != bb[:-1]))
        part = dense[c[i : i + step]]
        part *= w[i : i + step, None]
        out[bb[first]] += np.add.reduceat(part, first)
    return out


def _machine(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-5, steps: int = 40) -> np.ndarray:
    """Weights (the last one the bias) of least ridge * |w|^2 / 2 + weighted squared hinge loss, by Newton's method."""
    z = np.hstack([z, np.ones((len(z), 1), z.dtype)])
    keep = np.full(z.shape[1], ridge)
    keep[-1] = 1e-8

    def loss(w: np.ndarray) -> float:
        return float((keep * w * w).sum() / 2 + (weight * np.maximum(0, 1 - y * (z @ w)) ** 2).sum())

    w = np.zeros(z.shape[1])
    now = loss(w)
    for _ in range(steps):
        slack = 1 - y * (z @ w)
        on = slack > 0
        gradient = keep * w - 2 * z.T @ np.where(on, weight * slack * y, 0)
        curve = np.diag(keep)
        for i in range(0, len(z), 4000):  # in blocks, for the driver's memory
            k = i + np.flatnonzero(on[i : i + 4000])
            part = z[k].astype(np.float64)
            curve += 2 * (part * weight[k, None]).T @ part
        step = np.linalg.solve(curve, gradient)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-7:
            break
    return w


@dataclass
class Model:
    table: np.ndarray  # by code of three letters
    bias: float
    threshold: float
    window: float = float("inf")  # threshold of windows


def _names(u: Units) -> list[bytes]:
    ends = np.append(u.start[1:], len(u.letter))
    text = (u.letter + 64).astype(np.uint8).tobytes()
    return [text[a:b] for a, b in zip(u.start.tolist(), ends.tolist())]


def distinct_units(column: pa.Array) -> pa.Array:
    """The distinct units with 3 letters of each text, by name (letter classes from 64 on)."""
    u = units(column)
    coded = pa.array(_names(u), pa.binary()).dictionary_encode()
    which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pair = np.unique((u.doc[u.judged] << 32) | which[u.judged])
    per = np.bincount(pair >> 32, minlength=len(column))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), coded.dictionary.take(pa.array(pair & 0xFFFFFFFF)))


def _gapped(name: bytes) -> list[bytes]:
    """The unit with something inserted after every letter, and only in its middle."""
    x = name.strip(b"_")
    return [b"_" + y + b"_" for y in (b"@".join(x[i : i + 1] for i in range(len(x))), x[: len(x) // 2] + b"@" + x[len(x) // 2 :])]


def fitted(lists: pa.Array, toxic: np.ndarray, rounds: int = 4) -> Model:
    """The machine of labelled documents, given by distinct_units(). Two thirds train; the last third sets the threshold."""
    coded = lists.flatten().dictionary_encode()
    lists_offsets = lists.offsets.to_numpy()
    name = np.array(coded.dictionary.to_pylist(), object)
    which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(lists)), np.diff(lists_offsets))
    held = np.arange(len(lists)) % 3 == 2
    train = ~held[owner]
    bad, fine_ = train & toxic[owner], train & ~toxic[owner]
    in_toxic, in_clean = np.bincount(which[bad], minlength=len(name)), np.bincount(which[fine_], minlength=len(name))
    share = max(1.0, (toxic & ~held).sum()) / max(1.0, (~toxic & ~held).sum())
    odds = (in_toxic + 0.5) / (in_clean * share + 0.5)
    merit = np.log(odds) * np.sqrt(np.minimum(in_toxic, 50))
    telling = np.flatnonzero((in_toxic >= 3) & (odds >= 8))  # in so many more toxic documents that chance is no reason
    rank, usual = np.argsort(-merit, kind="stable"), np.argsort(-in_clean, kind="stable")
    spread = np.argsort(np.array([zlib.crc32(x) for x in name.tolist()], np.int64), kind="stable")
    landmarks = np.unique(np.concatenate([rank[: LANDMARKS * 5 // 8], usual[: LANDMARKS * 3 // 16], spread[: LANDMARKS * 3 // 16]]))

    b, c, w = _sparse(named(name[landmarks].tolist()))
    dense = np.zeros((32**3, len(landmarks)), np.float32)
    np.add.at(dense, (c, b), w)
    value, vector = np.linalg.eigh((dense.T @ dense).astype(np.float64))
    some = value > 1e-5 * value.max()
    root = (vector[:, some] / np.sqrt(value[some])).astype(np.float32)
    known = np.flatnonzero(in_clean > 0)
    negative = np.union1d(usual[in_clean[usual] > 0][:NEGATIVES], spread[in_clean[spread] > 0][:NEGATIVES])
    score, table, bias = merit, np.zeros(32**3), 0.0
    for r in range(rounds):
        mine, its = owner[bad], which[bad]
        order = np.lexsort((-score[its], mine))
        worst = its[order][np.append(True, np.diff(mine[order]) > 0)] if len(order) else its
        witness, times = np.unique(worst, return_counts=True)
        positive = np.union1d(telling, witness[(times >= 3) & (odds[witness] >= 2) | (in_clean[witness] == 0) & (score[witness] > 0)])
        if not len(positive):
            break
        rest = np.setdiff1d(negative, positive)
        variants = [v for x in name[positive].tolist() for v in _gapped(x)]
        z = kernel(named([*name[positive].tolist(), *variants, *name[rest].tolist()]), dense) @ root
        mass = np.sqrt(np.maximum(in_toxic[positive], 1))
        mass /= mass.sum()
        clean_mass = np.sqrt(np.maximum(in_clean[rest], 0.5))
        weight = np.concatenate([mass, np.repeat(mass / 4, 2), 3 * clean_mass / max(clean_mass.sum(), 1e-9)])
        y = np.concatenate([np.ones(3 * len(positive)), -np.ones(len(rest))])
        solution = _machine(z, y, weight)
        table, bias = (dense @ (root @ solution[:-1].astype(np.float32))) * _solid(), float(solution[-1])
        every = np.concatenate([unit_scores(named(name[i : i + 50_000].tolist()), table) for i in range(0, len(name), 50_000)])
        score = np.nan_to_num(every, nan=-1e9) + bias
        if r + 1 < rounds:  # clean units that look worst join the negatives
            negative = np.union1d(negative, known[np.argsort(-score[known], kind="stable")][:HARD])
    top = np.full(len(lists), -1e9)
    np.maximum.at(top, owner, score[which])
    return Model(table.astype(np.float32), bias, _threshold(top[held], toxic[held]))


def _threshold(score: np.ndarray, toxic: np.ndarray, false_alarm: float = 1.0) -> float:
    """The threshold of least misses + false_alarm * false alarms, in the middle of its gap."""
    cut = np.unique(score[score > -1e8])
    if not len(cut) or not toxic.any():
        return float("inf")
    middle = np.concatenate([(cut[1:] + cut[:-1]) / 2, [cut[-1] + 1]])
    bad, fine = np.sort(score[toxic]), np.sort(score[~toxic])
    loss = np.searchsorted(bad, middle) + false_alarm * (len(fine) - np.searchsorted(fine, middle))
    return float(middle[np.argmin(loss)])


def named(names: list[bytes]) -> Units:
    """The units, one block each, that have these names."""
    size = np.array([len(x) for x in names], np.int64)
    letter = np.frombuffer(b"".join(names), np.uint8).astype(np.int32) - 64
    ends = np.cumsum(size)
    start = ends - size
    count = lambda x: np.add.reduceat(x.astype(np.int64), start) if len(start) else start
    return Units(letter, np.repeat(ends, size) - np.arange(len(letter)), start, count(letter > 0), count((letter > 0) & (letter < _EDGE)) >= 3, np.arange(len(names)))


def trained(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN) -> Model | None:
    """A model from bounded samples of labelled documents, or None without both kinds."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    chosen = hash_order_sample(known.where("toxic = 1"), "doc_id", toxic).union(hash_order_sample(known.where("toxic = 0"), "doc_id", clean))
    # At most toxic + clean ids: bounded by the parameters, so safe to broadcast.
    sample = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, "text", 1 << 20):
            names = distinct_units(plain(table.column("text")))
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), table.column("toxic").combine_chunks().cast(pa.int32()), names], ["doc_id", "toxic", "names"])

    rows = sample.mapInArrow(run, "doc_id bigint, toxic int, names array<binary>").toArrow().sort_by([("doc_id", "ascending")])
    flags = rows.column("toxic").to_numpy() == 1
    if not flags.any() or flags.all():
        return None
    model = fitted(rows.column("names").combine_chunks().cast(pa.list_(pa.binary())), flags)
    del rows

    def widest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, "text", 1 << 20):
            column = plain(table.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(_best_units(column, model)), pa.array(_best_windows(column, model, 0.0))], ["unit", "window"])

    top = sample.where("toxic = 0").select("text").mapInArrow(widest, "unit double, window double").toArrow()
    window = np.sort(top.column("window").to_numpy()[top.column("unit").to_numpy() <= model.threshold])
    if len(window):
        model.window = float(max(window[int((1 - WINDOW_ALARMS) * (len(window) - 1))], -1e8))
    return model


def _best_units(column: pa.Array, model: Model) -> np.ndarray:
    """Highest score of each text's units, -inf of none."""
    top = np.full(len(column), -np.inf)
    u = units(column)
    each = unit_scores(u, model.table)
    real = ~np.isnan(each)
    np.maximum.at(top, u.doc[real], each[real] + model.bias)
    return top


def _norms_of(x: Letters, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms of windows from low to high (letters): by the running sums' rule, in which all subsequences differ, and whole, repeats added up."""
    count = high - low
    nth = np.arange(BLOCK)
    inside = (nth > 0) & (nth <= count[:, None])
    at = np.where(inside, low[:, None] + nth - 1, low[:, None])
    code = np.where(inside, x.letter[at], 0).astype(np.int64)
    place = np.where(inside, x.place[at] - x.place[low][:, None] + 1, 0)
    rows = np.arange(len(low))
    code[:, 0] = code[rows, count + 1] = _EDGE
    place[rows, count + 1] = place[rows, count] + 1
    same, back = np.unique(np.hstack([code, place]), axis=0, return_inverse=True)
    code, place = same[:, :BLOCK], same[:, BLOCK:]
    rough, exact = np.zeros(len(same)), np.zeros(len(same))
    for r in range(0, len(same), 500):
        c, p = code[r : r + 500], place[r : r + 500]
        row = np.arange(len(c))[:, None]
        keys, weights = [], []
        for d2 in range(2, SPAN):
            w = np.where((c[:, :-d2] > 0) & (c[:, d2:] > 0), DECAY ** np.minimum(p[:, d2:] - p[:, :-d2] + 1.0, 1023), 0)
            for d1 in range(1, d2):
                keys.append((row << 15 | c[:, :-d2] << 10 | c[:, d1 : BLOCK - d2 + d1] << 5 | c[:, d2:]).ravel())
                weights.append(w.ravel())
        key, w = np.concatenate(keys), np.concatenate(weights)
        rough[r : r + 500] = np.bincount(key >> 15, w * w, len(c))
        key, which = np.unique(key, return_inverse=True)
        exact[r : r + 500] = np.bincount(key >> 15, np.bincount(which, w) ** 2, len(c))
    least = DECAY ** (2 * BLOCK)
    return np.sqrt(np.maximum(rough, least))[back.ravel()], np.sqrt(np.maximum(exact, least))[back.ravel()]


def _best_windows(column: pa.Array, model: Model, above: float) -> np.ndarray:
    """Highest score of each text's windows, -inf of none. Those above `above` are normalised again with their repeats, which only lowers them."""
    top = np.full(len(column), -np.inf)
    size = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False)) if len(column) else np.zeros(0)
    if len(column) > 1 and size[-1] > SLICE:  # working arrays that stay in the processor's cache
        half = min(max(int(np.searchsorted(size, size[-1] / 2)), 1), len(column) - 1)
        return np.concatenate([_best_windows(c, model, above) for c in (column.slice(0, half), column.slice(half))])
    x = letters(column)
    for first, last, score in window_scores(x, model.table):
        high = np.flatnonzero(score + model.bias > above)
        for i in range(0, len(high), 20_000):
            k = high[i : i + 20_000]
            rough, exact = _norms_of(x, x.low[first[k]], x.high[last[k]])
            score[k] *= np.where(score[k] > 0, rough / exact, 1)
        np.maximum.at(top, x.doc[first], score + model.bias)
    return top


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score, toxic) of every row; score is above 0 where toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, "text", 1 << 20):
            n = table.num_rows
            top = np.full(n, -np.inf)
            if model:
                column = plain(table.column("text"))
                top = np.maximum(_best_units(column, model) - model.threshold, _best_windows(column, model, model.window) - model.window)
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), pa.array(top, mask=~np.isfinite(top)), pa.array(top > 0)], ["doc_id", "score", "toxic"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double, toxic boolean")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return scored(docs, trained(docs, read_table(spark, sf_dir, "labels")))


QUERIES = {"op9_toxicity": op9_toxicity}
