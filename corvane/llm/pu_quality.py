"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are documents labelled good (quality = 1), a bounded sample of them (`positives`, lowest id hash, one text each);
unlabelled web text is every document; labels of bad documents are never used. A linear scorer over shape features (frequencies of pairs of
character classes, and lengths, repetition and vocabulary figures) minimises the non-negative unbiased risk
pi * R+(g) + max(0, R-(unlabelled) - pi * R-(positives)) with the logistic loss. As that loss's two sides differ by the score, the
risk is convex wherever the negative part isn't below 0, and Newton's method finds its least value: each step is one pass over all
documents' features, whose loss, gradient and curvature are summed by partition and then in a tree; a step that would make the negative
part negative is halved. The class prior pi is estimated first: the share of all documents to that of held-out
positives among the highest scores of a positive-versus-unlabelled scorer, least over thresholds with a confidence margin, from the
histogram of all scores. A document is rejected if its score is negative and below that of nearly all (`keep_share`) held-out trusted
positives: where good documents reach below 0, that quantile and not 0 is the limit.

Features are computed twice, for training (kept as half-precision blocks in the shared folder) and for scoring; nothing is shuffled
but the partial sums. The model is some 300 numbers.

Defined results: null and empty texts, and texts of white space only, have nothing to score: score null, keep false, and they train
nothing. A null doc_id is scored, and counts as unlabelled, like any other. Repeated rows score alike; a text counts as often as it
occurs; equal scores share their fate. Texts are read whole, however long. An empty table gives an empty one. With fewer than 8 positives none are
held out. Without any labelled positive nothing is rejected but those texts. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import buffers, chunks, counts_by, plain, words
from .common import discard, hash_order_sample, read_table, written

POSITIVES, KEEP_SHARE = 4000, 0.995
BLOCK, BINS, STEPS, RIDGE = 2000, 8192, 12, 20.0

_CLASSES = 18
_CLASS = np.full(256, 15, np.uint8)
for _i, _c in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r\v\f", b".", b",", b"'\"`", b"!", b"?", b":;", b"()[]{}<>", b"|", b"-_~", b"/\\@")):
    _CLASS[list(_c)] = _i
_CLASS[128:192], _CLASS[192:] = 16, 17
FEATURES = _CLASSES * _CLASSES + 9


def features(column: pa.Array) -> np.ndarray:
    """A row of FEATURES numbers for each text."""
    raw, offsets = buffers(column)
    n = len(column)
    size = np.diff(offsets)
    out = np.zeros((n, FEATURES), np.float32)
    doc = np.repeat(np.arange(n), size)
    kind = _CLASS[raw].astype(np.int64)
    if len(kind) > 1:
        inside = doc[1:] == doc[:-1]
        pair = np.bincount((doc[1:] * _CLASSES**2 + kind[:-1] * _CLASSES + kind[1:])[inside], minlength=n * _CLASSES**2)
        out[:, : _CLASSES**2] = np.sqrt(pair.reshape(n, -1) / np.maximum(size - 1, 1)[:, None])
    hashes, owner, first, end = words(column)
    count = counts_by(owner, n)
    some = np.maximum(count, 1)
    same = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    again = np.bincount(owner[1:][same], minlength=n)
    distinct = counts_by((np.unique((owner.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24))) >> np.uint64(40)).astype(np.int64), n)
    length = np.bincount(owner, weights=end - first, minlength=n)
    lines = np.bincount(doc[kind == 4], minlength=n) + 1
    tail = out[:, _CLASSES**2 :]
    tail[:, 0] = np.log1p(count) / 5
    tail[:, 1] = length / some / 8
    tail[:, 2] = again / some
    tail[:, 3] = np.minimum(distinct / some**0.8, 2)
    tail[:, 4] = np.log1p(count / lines) / 4
    tail[:, 5] = size > 0
    for j, c in enumerate((1, 2, 15)):
        tail[:, 6 + j] = np.bincount(doc[kind == c], minlength=n) / np.maximum(size, 1)
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    prior: float
    limit: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def nn_pu_risk(gp: np.ndarray, gu: np.ndarray, prior: float) -> float:
    """Non-negative PU risk of scores of positives and unlabelled, with the logistic loss."""
    loss = lambda z: np.logaddexp(0, -z)
    return float(prior * loss(gp).mean() + max(0.0, loss(-gu).mean() - prior * loss(-gp).mean()))


@dataclass
class Sums:
    """Over unlabelled documents: their number, loss as negatives, its gradient and curvature by weights and bias."""

    n: float
    loss: float
    gradient: np.ndarray
    curve: np.ndarray


def sums(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums of rows of x, flat: n, loss, gradient, curvature."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    g = x @ w.astype(x.dtype)
    s = _sigmoid(g)
    curve = (x * (s * (1 - s))[:, None]).T @ x
    return np.concatenate([[len(x), np.logaddexp(0, g.astype(np.float64)).sum()], (s @ x).astype(np.float64), curve.astype(np.float64).ravel()])


def _sums(flat: np.ndarray, k: int) -> Sums:
    return Sums(flat[0], flat[1] / flat[0], flat[2 : 2 + k] / flat[0], flat[2 + k :].reshape(k, k) / flat[0])


def minimised(p: np.ndarray, unlabelled: Callable[[np.ndarray], Sums], prior: float, start: np.ndarray | None = None, steps: int = STEPS, ridge: float = RIDGE) -> np.ndarray:
    """Weights, the bias last, of least non-negative PU risk with a penalty of ridge / positives; unlabelled(w) sums over all unlabelled documents."""
    p = np.hstack([p, np.ones((len(p), 1))])
    mean, ridge_ = p.mean(axis=0), np.append(np.full(p.shape[1] - 1, ridge / len(p)), 1e-9)

    def risk(w: np.ndarray, u: Sums) -> tuple[float, float]:
        """(risk with its ridge, its negative part)."""
        return u.loss - prior * float(mean @ w) + float((ridge_ * w * w).sum()) / 2, u.loss - prior * float(np.logaddexp(0, p @ w).mean())

    w = np.zeros(p.shape[1]) if start is None else start
    u = unlabelled(w)
    now, _ = risk(w, u)
    for _ in range(steps):
        gradient = u.gradient - prior * mean + ridge_ * w
        step = np.linalg.solve(u.curve + np.diag(ridge_), gradient)
        gain, size = float(gradient @ step), 1.0
        if gain < 2e-5:
            break
        while True:
            to = w - size * step
            at = unlabelled(to)
            least, negative = risk(to, at)
            if least < now and negative >= 0:
                break
            size /= 2
            if size < 0.1:
                return w
        w, u, now = to, at, least
    return w


def _bins(g: np.ndarray) -> np.ndarray:
    """Histogram of scores over BINS bins that cover all numbers, closer around 0."""
    return np.bincount(np.minimum(((np.arctan(g) / np.pi + 0.5) * BINS).astype(np.int64), BINS - 1), minlength=BINS)


def estimated_prior(gp: np.ndarray, histogram: np.ndarray, confidence: float = 0.1, bounds: tuple[float, float] = (0.05, 0.99)) -> float:
    """Share of positives among the unlabelled, given by their histogram: least ratio of upper confidence bounds over score thresholds, within bounds."""
    above = lambda h: np.cumsum(h[::-1])[::-1] / h.sum()
    qp, qu = above(_bins(gp)), above(histogram)
    slack = np.sqrt(np.log(4 / confidence) / 2) * (1 / np.sqrt(len(gp)) + 1 / np.sqrt(histogram.sum()))
    fine = np.flatnonzero(qp > 0)
    best = fine[np.argmin((qu[fine] + slack) / qp[fine])]
    return float(np.clip(qu[best] / qp[best], *bounds))


class Blocks:
    """All documents' features in the shared folder; what training asks of them is summed over partitions."""

    def __init__(self, docs: DataFrame):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in chunks(batches, "text", 1 << 20):
                column = plain(table.column("text"))
                x = features(column)[_inked(column)].astype(np.float16)
                for i in range(0, len(x), BLOCK):
                    yield pa.RecordBatch.from_arrays([pa.array([x[i : i + BLOCK].tobytes()], pa.binary())], ["x"])

        self.rows = written(docs.where("text IS NOT NULL").select("text").mapInArrow(run, "x binary"), "features")

    def summed(self, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
        """The sum of of(features) over all blocks: by partition, then in rounds over about the square root of the parts."""

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                for x in b.column(0):
                    value = of(np.frombuffer(x.as_buffer(), np.float16).reshape(-1, FEATURES).astype(np.float32))
                    total = value if total is None else total + value
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float64).tobytes()], pa.binary())], ["x"])

        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [np.frombuffer(x.as_buffer(), np.float64) for b in batches for x in b.column(0)]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array([np.sum(parts, axis=0).tobytes()], pa.binary())], ["x"])

        df, n = self.rows.mapInArrow(part, "x binary"), self.rows.rdd.getNumPartitions()
        while n > 12:
            n = int(np.ceil(n**0.5))
            df = df.repartition(n).mapInArrow(joined, "x binary")
        parts = [np.frombuffer(r.x, np.float64) for r in df.collect()]  # 12 at most
        return np.sum(parts, axis=0) if parts else None


def fitted(p: np.ndarray, summed: Callable[[Callable[[np.ndarray], np.ndarray]], np.ndarray | None], keep_share: float = KEEP_SHARE) -> Model | None:
    """The model from features of trusted positives, in rows, and sums over those of all documents; None without documents."""
    k = p.shape[1]
    total = summed(lambda x: np.concatenate([[len(x)], x.astype(np.float64).sum(axis=0), (x.astype(np.float64) ** 2).sum(axis=0)]))
    if total is None:
        return None
    centre = total[1 : k + 1] / total[0]
    scale = np.sqrt(np.maximum(total[k + 1 :] / total[0] - centre**2, 0)) + 0.02

    def scaled(x: np.ndarray) -> np.ndarray:
        return np.clip((x - centre) / scale, -8, 8).astype(np.float32)

    p = scaled(p).astype(np.float64)
    held = np.arange(len(p)) % 4 == 0 if len(p) >= 8 else np.zeros(len(p), bool)
    rest, trusted = p[~held], p[held] if held.any() else p
    unlabelled = lambda w: _sums(summed(lambda x: sums(scaled(x), w)), k + 1)
    w = minimised(rest, unlabelled, 0.5)
    histogram = summed(lambda x: _bins(scaled(x) @ w[:-1] + w[-1]).astype(np.float64))
    prior = estimated_prior(trusted @ w[:-1] + w[-1], histogram)
    w = minimised(rest, unlabelled, prior, w)
    reached = np.sort(trusted @ w[:-1] + w[-1])
    limit = min(0.0, float(reached[int((1 - keep_share) * len(reached))]))
    return Model(w[:-1] / scale, float(w[-1]) - float(centre @ (w[:-1] / scale)), prior, limit)


def trained(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, keep_share: float = KEEP_SHARE) -> Model | None:
    """A model, or None without any positive or document. The sample of positives is bounded, so their features are collected."""
    named = docs.where("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    # The id list is bounded by the parameter, which is what makes the broadcast safe; of rows that repeat an id one is taken.
    sample = named.join(F.broadcast(hash_order_sample(good, "doc_id", positives)), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, "text", 1 << 20):
            x = features(plain(table.column("text"))).astype(np.float32)
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "x"])

    rows = sample.mapInArrow(run, "doc_id bigint, x binary").toArrow().sort_by([("doc_id", "ascending")])
    if not rows.num_rows:
        return None
    blocks = Blocks(docs)
    model = fitted(np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(-1, FEATURES), blocks.summed, keep_share)
    discard(blocks.rows)
    return model


def _inked(column: pa.Array) -> np.ndarray:
    """Which texts have more than white space."""
    raw, offsets = buffers(column)
    return np.bincount(np.repeat(np.arange(len(column)), np.diff(offsets))[~np.isin(raw, (9, 10, 11, 12, 13, 32))], minlength=len(column)) > 0


def _scored(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, "text", 1 << 20):
            column = plain(table.column("text"))
            ink = _inked(column)
            score = model.score(features(column)) if model else np.ones(len(column))
            keep = ink & (score >= (model.limit if model else 0))
            table = table.append_column("score", pa.array(score, pa.float64(), mask=~ink)).append_column("keep", pa.array(keep))
            yield from table.to_batches()

    return run


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score, keep) of every row."""

    def run(batches):
        for b in _scored(model)(batches):
            yield b.select(["doc_id", "score", "keep"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double, keep boolean")


def kept(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs without those that the model rejects, their columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = None
        for table in chunks(batches, "text", 1 << 20):
            columns = table.num_columns
            narrow = table.select([table.schema.get_field_index("text")])
            flags = [x for b in _scored(model)(iter(narrow.combine_chunks().to_batches())) for x in b.column(2).to_pylist()]
            yield from table.select(range(columns)).filter(pa.array(flags, pa.bool_())).to_batches()

    return docs.mapInArrow(run, docs.schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return scored(docs, trained(docs, read_table(spark, sf_dir, "labels")))


QUERIES = {"op4_quality": op4_quality}
