"""Language identification by language-bitmask n-gram filters.

One Bloom filter a language over byte n-grams, stored bit-sliced: the m positions of all filters lie side by side, a
position being a bitmask with the bit of each language whose filter has it set (a word of 64 bits for each 64 languages). One look-up of an n-gram ANDs the masks
of its k positions and so gives all languages that contain it. A text's n-grams are counted by language (the
popcount of each mask bit over the text); as filter l answers wrongly for a share f_l = fill_l^k of the n-grams that it doesn't hold,
the count c_l of n n-grams is corrected to (c_l - n f_l) / (1 - f_l). The largest corrected share decides.

Filters are filled with the n-grams that occur at least twice in a bounded sample (`per_language` different documents of
lowest id and text hash for each language, a parameter) of rows with a language. All n-grams of all texts are looked up.

Defined results: a text without an n-gram (null, empty, or too short once padded by a blank at both ends) and one
none of whose languages keeps a positive corrected count are 'und', with share 0. Ties go to the language first in
alphabet. Null languages train nothing; without any language all is 'und'; an empty table gives an empty one. Null doc_ids
stay, and rows that repeat get equal rows; in the sample a repeated row counts once. Texts are read whole, however long.
Other columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import buffers, chunks, lower, mix, plain
from .common import put_file, read_table

N, PER_LANGUAGE, HASHES, BITS_PER_GRAM = 5, 400, 3, 12
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def grams(column: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of every byte n-gram of the texts in lower case, with a blank at both ends and digits, punctuation and white space as one blank."""
    low = pc.replace_substring_regex(lower(column), r"[\x00-\x60\x7b-\x7f]+", " ")
    raw, offsets = buffers(pc.binary_join_element_wise(pa.scalar("", pa.large_string()), pc.utf8_trim(low, " "), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())))
    if len(raw) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = np.zeros(len(raw) - n + 1, np.uint64)
    for j in range(n):
        value |= raw[j : len(raw) - n + 1 + j].astype(np.uint64) << np.uint64(8 * j)
    size = np.maximum(np.diff(offsets) - n + 1, 0)
    inside = np.zeros(len(raw) + 1, np.int8)
    np.add.at(inside, offsets[:-1][size > 0], 1)
    np.add.at(inside, (offsets[:-1] + size)[size > 0], -1)
    return mix(value[np.cumsum(inside[: len(value)]) > 0]), np.repeat(np.arange(len(size)), size)


@dataclass
class Filters:
    languages: list[str]
    masks: np.ndarray  # (words, m): of the m positions, 64 languages a word
    wrong: np.ndarray  # false-positive share by language

    def positions(self, h: np.ndarray) -> Iterator[np.ndarray]:
        step = (h >> np.uint64(32)) | np.uint64(1)
        for i in range(HASHES):
            yield ((h + np.uint64(i) * step) & np.uint64(self.masks.shape[1] - 1)).astype(np.int64)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """(words, n-grams): bitmask of the languages that contain each n-gram."""
        out = None
        for p in self.positions(h):
            out = self.masks[:, p] if out is None else out & self.masks[:, p]
        return out

    def counts(self, h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(corrected counts by text and language, n-grams of each text)."""
        total = np.bincount(doc, minlength=n).astype(np.float64)
        mask = self.lookup(h)
        out = np.zeros((n, len(self.languages)))
        edge = np.concatenate([[0], np.cumsum(total)]).astype(np.int64)
        for j in range(len(self.languages)):
            upto = np.concatenate([[0], np.cumsum((mask[j >> 6] >> np.uint64(j & 63)) & np.uint64(1), dtype=np.int64)])
            hits = upto[edge[1:]] - upto[edge[:-1]]
            out[:, j] = (hits - total * self.wrong[j]) / (1 - self.wrong[j])
        return out, total


def filled(samples: dict[str, np.ndarray]) -> Filters:
    """Filters of the n-grams (hashes) of any number of languages."""
    languages = sorted(samples)
    most = max((len(x) for x in samples.values()), default=0)
    m = 1 << max(10, int(BITS_PER_GRAM * most).bit_length())
    out = Filters(languages, np.zeros((max(1, -(-len(languages) // 64)), m), np.uint64), np.zeros(len(languages)))
    for j, language in enumerate(languages):
        for p in out.positions(samples[language]):
            np.bitwise_or.at(out.masks[j >> 6], p, np.uint64(1 << (j & 63)))
        out.wrong[j] = (((out.masks[j >> 6] >> np.uint64(j & 63)) & np.uint64(1)).mean()) ** HASHES
    return out


def trained(docs: DataFrame, per_language: int = PER_LANGUAGE, n: int = N) -> Filters:
    """Filters from the languages in column lang. A language's sample is bounded, so its n-grams are collected."""
    key = ["doc_id", "th"]
    w = Window.partitionBy("lang").orderBy(F.xxhash64(*key), *key)
    known = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL").select("lang", F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    chosen = known.select("lang", *key).distinct().withColumn("k", F.row_number().over(w)).where(F.col("k") <= per_language).drop("k")
    # At most per_language keys for each language: broadcast only if Spark finds them small. Of rows that repeat one is taken.
    sample = known.join(chosen, ["lang", *key], "left_semi").groupBy("lang", *key).agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, "text", 1 << 20):
            h, doc = grams(plain(table.column("text")), n)
            lang = np.array(table.column("lang").to_pylist(), object)
            for name in sorted(set(lang)):
                value, count = np.unique(h[np.isin(doc, np.flatnonzero(lang == name))], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(value), pa.string()), pa.array(value.view(np.int64)), pa.array(count, pa.int64())], ["lang", "h", "c"])

    rows = sample.select("lang", "text").mapInArrow(run, "lang string, h bigint, c bigint").groupBy("lang", "h").agg(F.sum("c").alias("c")).where("c > 1").select("lang", "h").toArrow()
    lang = rows.column("lang").combine_chunks().dictionary_encode()
    code, h = lang.indices.to_numpy(zero_copy_only=False), rows.column("h").to_numpy().view(np.uint64)
    return filled({str(name): np.sort(h[code == i]) for i, name in enumerate(lang.dictionary.to_pylist())})


def identified(docs: DataFrame, filters: Filters, n: int = N) -> DataFrame:
    """(doc_id, language, share, margin): the language, its corrected share of the n-grams, its lead over the next."""
    out = io.BytesIO()
    np.savez(out, masks=filters.masks, wrong=filters.wrong)
    file, languages = put_file(docs.sparkSession, "filters.npz", out.getvalue()), filters.languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import SparkFiles

        with np.load(SparkFiles.get(file)) as z:
            f = Filters(languages, z["masks"], z["wrong"])
        for table in chunks(batches, "text", 1 << 20):
            k = table.num_rows
            counts, total = f.counts(*grams(plain(table.column("text")), n), k)
            share = np.maximum(counts, 0) / np.maximum(total, 1)[:, None]
            if not languages:
                share = np.zeros((k, 1))
            best = share.argmax(axis=1)
            top = share.max(axis=1)
            second = np.sort(share, axis=1)[:, -2] if share.shape[1] > 1 else np.zeros(k)
            name = pa.array([*languages, "und"]).take(pa.array(np.where(top > 0, best, len(languages))))
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), name, pa.array(top), pa.array(top - second)], ["doc_id", "language", "share", "margin"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, language string, share double, margin double")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return identified(docs, trained(docs))


QUERIES = {"op1_language_id": op1_language_id}
