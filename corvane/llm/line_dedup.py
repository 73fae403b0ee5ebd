"""Line dedup by a suffix array over line-ID sequences, built by distributed prefix doubling.

A document is the sequence of its lines that aren't blank, each named by a hash of its trimmed text. Only lines that
occur at two places or more can be part of a repeated run, so only their places enter the suffix array. Places are
numbered in document order, with a free number between documents. A suffix's rank is the number of suffixes before its
group; round k splits groups of equal rank by the rank 2^k lines further on (or the end of the repeated lines, which
sorts first), so after it a group is an interval of longest common prefix of at least 2^(k+1) lines, or of suffixes
equal to their end. Rounds stop when no two places share a run as long as the next power of two.

Every interval keeps its first place, and every other place deletes the longest run that begins earlier elsewhere, if
that run has at least `min_words` words. How long it is follows from the intervals: the last round in which a place
isn't the first of its group bounds it by powers of two, and the tree of prefixes between the two is then halved with the
ranks of the smaller rounds. A node of that tree is kept as the first places of the classes it splits into, so each
halving step handles at most two rows for each class, however often a run is repeated.

Groups are split through counts of distinct (rank, next rank) pairs and two levels of running sums, so that no window
holds all occurrences of a line however common it is; a round of at most WINDOWED rows is split by windows, with the same ranks. Texts move once, when the lines are deleted.

Defined results: documents are in order of doc_id (null first), then of a hash of their text; rows that repeat both are
one document and share its fate. Null texts stay null and empty ones empty; an empty table gives an empty one. A run may overlap its
earlier copy in one document. Words are counted by single blanks. Blank lines are never deleted and don't end a run. A
document that loses every line that isn't blank has the text ''. Texts are taken whole, however long; a text's lines are in one
row, as the text is. Other columns, whatever their names, pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, partitions, read_table, written

MIN_WORDS = 7
WINDOWED = 1 << 20  # rows that one window may hold
_TRIMMED = r"trim(both ' \t\r' from x)"


def _lines(docs: DataFrame) -> DataFrame:
    """(place, d, ix, h, words, doc_id, th): the lines that aren't blank, numbered in document order. d: place of the document's first.

    The number after a document's last line is free.
    """
    per_doc = docs.where(F.col("text").isNotNull()).select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.xxhash64("text").alias("th"),
        F.expr(
            rf"""filter(transform(split(text, '\n'), (x, i) -> struct(i AS ix, xxhash64({_TRIMMED}) AS h,
                 length({_TRIMMED}) - length(replace({_TRIMMED}, ' ', '')) + 1 AS words, length({_TRIMMED}) = 0 AS blank)), s -> NOT s.blank)"""
        ).alias("lines"),
    )
    ordered = per_doc.dropDuplicates(["doc_id", "th"]).repartitionByRange(partitions(docs.sparkSession), "doc_id", "th").sortWithinPartitions("doc_id", "th")
    gap = F.expr("concat(lines, array(struct(-1 AS ix, 0L AS h, 0 AS words, true AS blank)))")
    exploded = ordered.select("doc_id", "th", F.posexplode(gap).alias("pos", "s"))
    numbered = exploded.select(F.monotonically_increasing_id().alias("place"), "pos", "s.ix", "s.h", "s.words", "doc_id", "th")
    return written(numbered.where("ix >= 0").withColumn("d", F.expr("place - pos")).drop("pos"), "lines")


def _starts(groups: DataFrame, within: list[str], by: str, bits: int) -> DataFrame:
    """groups with `start`: the sum of n over the groups before, in order of `by`, among equal `within`.

    Two levels of running sums, over slices of `by` and over the slices, keep windows small.
    """
    sliced = groups.withColumn("slice", F.shiftright(by, bits))
    keys = [*within, "slice"]
    inner = sliced.withColumn("inner", F.sum("n").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)))
    totals = sliced.groupBy(*keys).agg(F.sum("n").alias("total"))
    outer = totals.withColumn("outer", F.sum("total").over(Window.partitionBy(*within).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))).drop("total")
    joined = inner.join(outer, keys)
    return joined.withColumn("start", F.coalesce("inner", F.lit(0)) + F.coalesce("outer", F.lit(0))).drop("slice", "inner", "outer")


def _split(table: DataFrame, few: bool) -> DataFrame:
    """(place, d, rank, n, first, above): groups of equal rank split by next.

    Of few rows, by windows over a rank, all in one exchange: every exchange and broadcast costs the driver a thread.
    """
    if few:
        same = Window.partitionBy("rank", "next")
        before = F.rank().over(Window.partitionBy("rank").orderBy("next")) - 1
        ranked = table.repartition("rank").select("place", "d", (F.col("rank") + before).alias("new"), F.count("*").over(same).alias("n"), F.min("place").over(same).alias("low"), F.col("first").alias("above"))
        return ranked.withColumnsRenamed({"new": "rank", "low": "first"})
    pairs = table.groupBy("rank", "next").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    split = _starts(pairs, ["rank"], "next", 16).select("rank", "next", "n", "first", (F.col("rank") + F.col("start")).alias("new"))
    return table.select("place", "d", "rank", "next", F.col("first").alias("above")).join(split, ["rank", "next"]).select("place", "d", F.col("new").alias("rank"), "n", "first", "above")


def suffix_array(lines: DataFrame) -> list[DataFrame]:
    """Round by round, (place, d, rank, n, first, above): repeated lines in their suffix array after 2^k lines, ordered by (rank, place).

    n is the size of the suffix's group and first its smallest place; above is the group's first place in the round before, where that group had others.
    """
    repeated = lines.groupBy("h").agg(F.count("*").alias("n"), F.min("place").alias("first")).where("n > 1")
    ranked = _starts(repeated, [], "h", 52).withColumnRenamed("start", "rank")
    placed = lines.select("place", "d", "h").join(ranked, "h").select("place", "d", "rank", "n", "first", F.lit(None).cast("bigint").alias("above"))
    rounds: list[DataFrame] = []
    width = 1
    while True:
        w = Window.partitionBy("d").orderBy("place")
        following = F.when(F.lead("place", width).over(w) == F.col("place") + width, F.lead("rank", width).over(w)).otherwise(F.lit(-1))
        seen = Observation()
        table = written(placed.withColumn("next", following).observe(seen, F.count_if(F.expr("n > 1 AND next >= 0")).alias("open"), F.count_if(F.expr("n > 1")).alias("many")), "suffixes")
        rounds.append(table)
        if not seen.get["open"]:
            return rounds
        renamed = _split(table.where("n > 1"), seen.get["many"] <= WINDOWED)
        placed = renamed.unionByName(table.where("n = 1").select("place", "d", "rank", "n", "first", F.lit(None).cast("bigint").alias("above")))
        width *= 2


def _between(rounds: list[DataFrame]) -> DataFrame | None:
    """(place, size): the longest run that begins earlier elsewhere, of places that are first of their group in the last round.

    A row (m, node, place) stands for a class: node, the first place of all that share m lines, splits within the next
    2^j lines into classes of which place is the first. Halving gives the classes that share the first half's lines a
    node of their own and leaves the first class of each such group in the old one.
    """
    open_: DataFrame | None = None
    for j in range(len(rounds) - 2, -1, -1):
        new = rounds[j + 1].where("above IS NOT NULL AND place = first").select(F.lit(2**j).cast("bigint").alias("m"), F.col("above").alias("node"), "place")
        now = new if open_ is None else new.unionByName(open_)
        if j == 0:
            found = written(now.where("place > node").select("place", F.col("m").alias("size")), "between")
            if open_ is not None:
                discard(open_)
            return found
        half = 2 ** (j - 1)
        at = rounds[j - 1].select(F.col("place").alias("to"), F.col("rank").alias("b"))
        halved = now.withColumn("to", F.col("place") + F.col("m")).join(at, "to", "left").select("m", "node", "place", F.coalesce("b", F.lit(-1)).alias("b"))
        middle = halved.groupBy("m", "node", "b").agg(F.min("place").alias("mid"), F.count("*").alias("c"))
        low = middle.select("m", "node", F.col("mid").alias("place"))
        high = halved.join(middle.where("c > 1"), ["m", "node", "b"]).select((F.col("m") + half).alias("m"), F.col("mid").alias("node"), "place")
        table = written(low.unionByName(high), "between")
        if open_ is not None:
            discard(open_)
        open_ = table
    return None


def deleted_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, th, gone): the indexes of the lines that each document loses; th is the hash of its text."""
    lines = _lines(docs)
    rounds = suffix_array(lines)
    w = Window.partitionBy("d").orderBy("place")
    there = lines.select("place", "ix", "words").join(rounds[0].select("place", "d"), "place")
    counted = there.select("*", F.sum("words").over(w).alias("upto"), (F.col("place") - F.row_number().over(w)).alias("island"))
    base = written(counted.withColumn("end", F.max("place").over(Window.partitionBy("d", "island"))).drop("island"), "base")
    whole = rounds[-1].where("place > first").select("place", F.lit(None).cast("bigint").alias("size"))
    between = _between(rounds)
    runs = whole if between is None else whole.unionByName(between)
    begun = runs.join(base, "place").select("place", "d", F.coalesce(F.col("place") + F.col("size") - 1, "end").alias("last"), (F.col("upto") - F.col("words")).alias("before"))
    enough = begun.join(base.select(F.col("place").alias("last"), "upto"), "last").where(F.col("upto") - F.col("before") >= min_words).select("place", "last")
    reach = base.select("place", "d", "ix").join(enough, "place", "left").withColumn("reach", F.max("last").over(w))
    gone = reach.where("reach >= place").groupBy("d").agg(F.collect_list("ix").alias("gone"))
    heads = lines.where("place = d").select("d", "doc_id", "th")
    result = written(gone.join(heads, "d").select("doc_id", "th", "gone"), "gone")
    for t in (lines, *rounds, base, *([between] if between is not None else [])):
        discard(t)
    return result


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with repeated runs deleted from text and a column lines_removed (or, if that is taken, under the next free name)."""
    counted, d, t, g, l_ = (_free(docs, x) for x in ("lines_removed", "__d", "__t", "__g", "__l"))
    gone = deleted_lines(docs, min_words).select(F.col("doc_id").alias(d), F.col("th").alias(t), F.col("gone").alias(g))
    on = docs["doc_id"].cast("bigint").eqNullSafe(gone[d]) & (F.xxhash64(docs["text"]) == gone[t])
    joined = docs.join(gone.hint("shuffle_hash"), on, "left")
    cut = joined.withColumn(l_, F.when(F.col(g).isNotNull(), F.split("text", "\n")))
    rest = F.expr(f"array_join(transform(array_except(sequence(0, size({l_}) - 1), {g}), i -> {l_}[i]), '\\n')")
    text = F.when(F.col(g).isNull(), F.col("text")).otherwise(F.when(F.regexp_replace(rest, r"[ \t\r\n]+", "") == "", F.lit("")).otherwise(rest))
    return cut.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], F.when(F.col(g).isNull(), F.lit(0)).otherwise(F.size(g)).cast("bigint").alias(counted))


def _free(df: DataFrame, name: str) -> str:
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs without their repeated runs; a document that had lines and has none left goes."""
    counted = _free(docs, "lines_removed")
    return without_repeats(docs, min_words).where(f"text IS NULL OR text <> '' OR {counted} = 0").drop(counted)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = {
    "op10_line_dedup": rf"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS o, doc_id, text FROM documents),
raw AS (SELECT o, ix, trim(x, ' ' || chr(9) || chr(13)) AS x FROM (SELECT o, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS ix FROM d WHERE text IS NOT NULL) t),
line AS (SELECT o, ix, row_number() OVER (PARTITION BY o ORDER BY ix) AS pos, length(x) - length(replace(x, ' ', '')) + 1 AS words, dense_rank() OVER (ORDER BY x) AS id FROM raw WHERE x <> ''),
pair AS (SELECT a.o, a.pos, b.o AS q, a.pos - b.pos AS off FROM line a JOIN line b ON a.id = b.id AND (b.o < a.o OR b.o = a.o AND b.pos < a.pos)),
island AS (SELECT *, pos - row_number() OVER (PARTITION BY o, q, off ORDER BY pos) AS g FROM pair),
longest AS (SELECT o, pos, max(e) AS e FROM (SELECT o, pos, max(pos) OVER (PARTITION BY o, q, off, g) AS e FROM island) t GROUP BY o, pos),
later AS (SELECT r.o, r.pos AS i, r.e - r.pos + 1 AS n FROM longest r JOIN line l ON l.o = r.o AND l.pos BETWEEN r.pos AND r.e GROUP BY r.o, r.pos, r.e HAVING sum(l.words) >= {MIN_WORDS}),
gone AS (SELECT DISTINCT o, unnest(range(i, i + n)) AS pos FROM later),
cut AS (SELECT o, ix FROM gone JOIN line USING (o, pos)),
rest AS (SELECT d.o, string_agg(x, chr(10) ORDER BY ix) AS t, count(*) AS m FROM (SELECT o, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS ix FROM d WHERE text IS NOT NULL) l JOIN d USING (o) LEFT JOIN cut USING (o, ix) WHERE cut.ix IS NULL OR cut.o IS NULL GROUP BY d.o),
num AS (SELECT o, count(*) AS m FROM cut GROUP BY o)
SELECT d.doc_id, CASE WHEN num.m IS NULL THEN d.text WHEN trim(coalesce(rest.t, ''), ' ' || chr(9) || chr(13) || chr(10)) = '' THEN '' ELSE rest.t END AS text, coalesce(num.m, 0) AS lines_removed
FROM d LEFT JOIN num USING (o) LEFT JOIN rest USING (o)"""
}
QUERIES = {"op10_line_dedup": op10_line_dedup}
