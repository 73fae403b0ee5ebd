"""Quotation linking: quotes to their originals, and conversations in reply order without quotes.

A line's quote level is the number of '>' it begins with (blanks between them don't count). Lines of one level that follow each other are
a passage. Passages and the own lines of messages are normalised (case, blanks) and hashed; a passage is joined to
the earlier messages of its conversation by the hash of the whole (their whole own text, or one line of it) and of each
line. Its original is the message with a whole match, else with most matching lines; ties go to the latest. A message
replies to the original of its passage of lowest level, the latest if several; without one, to the message before it.
Conversations are put in reply order: each message after what it replies to, replies to one message by turn. The
joins carry hashes only and are keyed by conversation and hash, so nothing is broadcast and long threads don't skew them.

Defined results: rows without a conv_id or turn are left out; of several rows for one turn the least (role, text) counts
(nulls first), so repeated rows are one. A null text stays null; a message of nothing but quotes has the text ''. Passages of blank lines don't count.
Quotes that match nothing are dropped from the text all the same and counted in n_quotes, not in n_linked. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, written

_LINES = r"""transform(split(text, '\n'), x -> named_struct(
    'level', length(regexp_extract(x, r'^(?:[ \t]*>)*', 0)) - length(replace(regexp_extract(x, r'^(?:[ \t]*>)*', 0), '>', '')),
    'body', trim(both ' \t\r' from substring(x, length(regexp_extract(x, r'^(?:[ \t]*>)*', 0)) + 1))))"""
_NORMAL = r"lower(regexp_replace({}, r'[ \t\r\n]+', ' '))"


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reply order of conversations given as lists of turns (ascending) and parents."""
    for b in batches:
        conv, turn, parent, depth, position = [], [], [], [], []
        for c, turns, parents in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            children: dict[int | None, list[int]] = {}
            above = dict(zip(turns, parents))
            for t in turns:
                children.setdefault(above[t], []).append(t)
            stack, at = [(t, 0) for t in reversed(children.get(None, []))], 0
            while stack:
                t, d = stack.pop()
                conv.append(c)
                turn.append(t)
                parent.append(above[t])
                depth.append(d)
                position.append(at)
                at += 1
                stack += [(x, d + 1) for x in reversed(children.get(t, []))]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (conv, turn, parent, depth, position)], ["conv_id", "turn", "parent_turn", "depth", "position"])


def linked(conversations: DataFrame) -> DataFrame:
    """(conv_id, position, turn, role, text, parent_turn, depth, n_quotes, n_linked): messages in reply order, quotes removed; parent_turn is -1 at a root."""
    key = ["conv_id", "turn"]
    given = conversations.where("conv_id IS NOT NULL AND turn IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), "text")
    messages = written(given.groupBy(*key).agg(F.min(F.struct("role", "text")).alias("m")).select(*key, "m.*"), "messages")
    quoting = messages.where(F.col("text").rlike(r"(^|\n)[ \t]*>"))
    lines = quoting.select(*key, F.posexplode(F.expr(_LINES)).alias("i", "l")).select(*key, "i", "l.*")
    w = Window.partitionBy(*key).orderBy("i")
    new = F.when(F.col("level") == F.lag("level").over(w), 0).otherwise(1)
    numbered = lines.withColumn("new", new).withColumn("p", F.sum("new").over(w)).where("level > 0 AND body <> ''")
    passages = written(
        numbered.groupBy(*key, "p", "level").agg(F.sort_array(F.collect_list(F.struct("i", "body"))).alias("b")).select(
            *key, "p", "level", F.expr(f"xxhash64({_NORMAL.format('concat_ws(chr(32), b.body)')})").alias("whole"), F.expr(f"transform(b.body, x -> xxhash64({_NORMAL.format('x')}))").alias("parts")
        ),
        "passages",
    )
    own = "filter({}, l -> l.level = 0 AND l.body <> '').body".format(_LINES)
    threads = passages.select("conv_id").distinct()
    originals = (
        messages.join(threads, "conv_id", "left_semi").where("text IS NOT NULL").select("conv_id", F.col("turn").alias("target"), F.expr(own).alias("own"))
        .select("conv_id", "target", F.explode(F.expr(f"array_union(transform(own, x -> xxhash64({_NORMAL.format('x')})), array(xxhash64({_NORMAL.format('concat_ws(chr(32), own)')})))")).alias("h"))
    )
    keys = passages.select(*key, "p", "level", F.explode(F.expr("concat(array(named_struct('h', whole, 'w', 1000000L)), transform(parts, x -> named_struct('h', x, 'w', 1L)))")).alias("k")).select(*key, "p", "level", "k.*")
    votes = keys.join(originals, ["conv_id", "h"]).where("target < turn").groupBy(*key, "p", "level", "target").agg(F.sum("w").alias("w"))
    found = votes.groupBy(*key, "p", "level").agg(F.max(F.struct("w", "target")).alias("m")).select(*key, "p", "level", F.col("m.target").alias("target"))
    parents = found.groupBy(*key).agg(F.min(F.struct("level", (-F.col("target")).alias("back"))).alias("m"), F.count("*").alias("n_linked")).select(*key, (-F.col("m.back")).alias("linked_turn"), "n_linked")
    quotes = passages.groupBy(*key).agg(F.count("*").alias("n_quotes"))
    noted = messages.drop("text", "role").join(quotes, key, "left").join(parents, key, "left")
    placed = noted.withColumn("parent", F.coalesce("linked_turn", F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))))
    placed = written(placed.select(*key, "parent", F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked")), "placed")
    threaded = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "parent"))).alias("m")).select("conv_id", "m.turn", "m.parent")
    order = threaded.mapInArrow(_ordered, "conv_id bigint, turn bigint, parent_turn bigint, depth bigint, position bigint")
    clean = F.expr(rf"CASE WHEN text RLIKE r'(^|\n)[ \t]*>' THEN trim(both ' \t\r\n' from array_join(transform(filter({_LINES}, l -> l.level = 0), l -> l.body), '\n')) ELSE text END")
    out = messages.select(*key, "role", clean.alias("text")).join(order, key).join(placed.select(*key, "n_quotes", "n_linked"), key)
    return out.select("conv_id", "position", "turn", "role", "text", F.coalesce("parent_turn", F.lit(-1)).alias("parent_turn"), "depth", "n_quotes", "n_linked")


def conversations_of(messages: DataFrame) -> DataFrame:
    """(conv_id, messages): one row a conversation of linked(), its (role, text) in reply order; messages without text left are not in it."""
    said = messages.where("text IS NOT NULL AND text <> ''")
    return said.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("position", "role", "text"))).alias("m")).select("conv_id", F.expr("transform(m, x -> named_struct('role', x.role, 'text', x.text))").alias("messages"))


def op2_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(read_table(spark, sf_dir, "conversations"))


_B = "' ' || chr(9) || chr(13)"
SQL = {
    "op2_quote_links": rf"""
WITH RECURSIVE msg AS (
  SELECT conv_id, turn, role, text FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role NULLS FIRST, text NULLS FIRST) AS k
    FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL) t WHERE k = 1),
raw AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM msg WHERE text IS NOT NULL),
cut AS (SELECT *, regexp_extract(x, '^(?:[ \t]*>)*', 0) AS pre FROM raw),
line AS (SELECT conv_id, turn, i, length(pre) - length(replace(pre, '>', '')) AS level, trim(substr(x, length(pre) + 1), {_B}) AS body FROM cut),
mark AS (SELECT *, CASE WHEN level = lag(level) OVER (PARTITION BY conv_id, turn ORDER BY i) THEN 0 ELSE 1 END AS new FROM line),
num AS (SELECT *, sum(new) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS UNBOUNDED PRECEDING) AS p FROM mark),
norm AS (SELECT *, lower(regexp_replace(body, '[ \t\r\n]+', ' ', 'g')) AS b FROM num WHERE body <> ''),
passage AS (SELECT conv_id, turn, p, level, string_agg(b, ' ' ORDER BY i) AS whole, list(b ORDER BY i) AS parts FROM norm WHERE level > 0 GROUP BY conv_id, turn, p, level),
own AS (SELECT conv_id, turn AS target, string_agg(b, ' ' ORDER BY i) AS h FROM norm WHERE level = 0 GROUP BY conv_id, turn UNION SELECT conv_id, turn, b FROM norm WHERE level = 0),
key AS (SELECT conv_id, turn, p, level, whole AS h, 1000000 AS w FROM passage UNION ALL SELECT conv_id, turn, p, level, unnest(parts), 1 FROM passage),
vote AS (SELECT key.conv_id, key.turn, p, level, target, sum(w) AS w FROM key JOIN own ON key.conv_id = own.conv_id AND key.h = own.h AND target < key.turn GROUP BY ALL),
found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, p, level ORDER BY w DESC, target DESC) AS k FROM vote) t WHERE k = 1),
best AS (SELECT conv_id, turn, target, count(*) OVER (PARTITION BY conv_id, turn) AS n_linked, row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, target DESC) AS k FROM found),
quotes AS (SELECT conv_id, turn, count(*) AS n_quotes FROM passage GROUP BY conv_id, turn),
node AS (
  SELECT m.conv_id, m.turn, coalesce(best.target, lag(m.turn) OVER (PARTITION BY m.conv_id ORDER BY m.turn)) AS parent, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked
  FROM msg m LEFT JOIN best ON m.conv_id = best.conv_id AND m.turn = best.turn AND best.k = 1 LEFT JOIN quotes q ON m.conv_id = q.conv_id AND m.turn = q.turn),
tree AS (
  SELECT conv_id, turn, [turn] AS path FROM node WHERE parent IS NULL
  UNION ALL SELECT n.conv_id, n.turn, list_append(tree.path, n.turn) FROM tree JOIN node n ON n.conv_id = tree.conv_id AND n.parent = tree.turn),
clean AS (SELECT conv_id, turn, trim(string_agg(body, chr(10) ORDER BY i) FILTER (WHERE level = 0), {_B} || chr(10)) AS t, max(level) AS top FROM line GROUP BY conv_id, turn)
SELECT m.conv_id, row_number() OVER (PARTITION BY m.conv_id ORDER BY tree.path) - 1 AS position, m.turn, m.role,
  CASE WHEN clean.top > 0 THEN coalesce(clean.t, '') ELSE m.text END AS text, coalesce(node.parent, -1) AS parent_turn, CAST(len(tree.path) - 1 AS BIGINT) AS depth, node.n_quotes, node.n_linked
FROM msg m JOIN tree ON m.conv_id = tree.conv_id AND m.turn = tree.turn JOIN node ON m.conv_id = node.conv_id AND m.turn = node.turn LEFT JOIN clean ON m.conv_id = clean.conv_id AND m.turn = clean.turn"""
}
QUERIES = {"op2_quote_links": op2_quote_links}
