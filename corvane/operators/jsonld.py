"""JSON-LD: blocks of documents, validity, nodes of a graph, required fields by type, generated nodes and injection into documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..sources.parsers import ld_blocks
from .technical import REQUIRED, required_sql

CONTEXT = "https://schema.org"


def blocks(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, ord, source, json): values with a context in JSON fences, then script tags, of each document. Scanning balanced values needs a loop over characters."""
    kind = StructType([df.schema[key], StructField("ord", IntegerType()), StructField("source", StringType()), StructField("json", StringType())])
    target = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(k, i, *x) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for i, x in enumerate(ld_blocks(t))]
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, target)], schema=target)

    return df.select(key, content).mapInArrow(run, kind)


_ROOT = r"""CASE WHEN try_parse_json({0}) IS NULL OR NOT {0} RLIKE r'^\s*[\[{{"0-9tfn-]' THEN 'invalid' WHEN {0} RLIKE r'^\s*\{{' THEN 'object' WHEN {0} RLIKE r'^\s*\[' THEN 'array' WHEN {0} RLIKE r'^\s*null' THEN 'null' ELSE 'primitive' END"""


def rooted(found: DataFrame, json: str = "json") -> DataFrame:
    """found with root (object, array, primitive, null or invalid) and context_ok."""
    context = F.when(F.col("root") == "object", F.get_json_object(json, "$.@context"))
    return found.withColumn("root", F.expr(_ROOT.format(json))).withColumn("context_ok", F.coalesce(context == CONTEXT, F.lit(False)))


def nodes(found: DataFrame, json: str = "json") -> DataFrame:
    """rooted() blocks exploded into the nodes of their graph, or themselves: node_ord, node (JSON text), types (comma-separated or listed ones apart)."""
    graph = F.get_json_object(json, "$.@graph")
    listed = F.when(graph.rlike(r"^\s*\["), F.from_json(graph, "array<string>")).otherwise(F.array(F.col(json)))
    each = rooted(found, json).where("root = 'object'").select("*", F.posexplode(listed).alias("node_ord", "node"))
    raw = F.get_json_object("node", "$.@type")
    flat = F.when(raw.rlike(r"^\s*\["), F.array_join(F.from_json(raw, "array<string>"), ",")).otherwise(raw)
    return each.withColumn("types", F.filter(F.transform(F.split(F.coalesce(flat, F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != ""))


def errors(found: DataFrame, keys: list[str], json: str = "json") -> DataFrame:
    """(keys, node_ord, type, error): what is wrong with each block: 'invalid', a root that is no object, 'context', a graph without nodes, a node without 'type', and the name of each required field that is missing, null or ''.

    The registry of required fields is a fixed list of some 40 rows.
    """
    tops = rooted(found, json).select(*keys, F.lit(-1).alias("node_ord"), F.lit("").alias("type"), F.explode(F.expr(
        rf"""array_compact(array(CASE WHEN root = 'invalid' THEN 'invalid' WHEN root <> 'object' THEN 'root ' || root END, CASE WHEN root = 'object' AND NOT context_ok THEN 'context' END,
        CASE WHEN root = 'object' AND regexp_replace(get_json_object({json}, '$.@graph'), r'\s', '') = '[]' THEN 'no nodes' END))""")).alias("error"))  # fmt: skip
    each = nodes(found, json)
    untyped = each.where("size(types) = 0").select(*keys, "node_ord", F.lit("").alias("type"), F.lit("type").alias("error"))
    typed = each.select(*keys, "node_ord", "node", F.explode("types").alias("type"))
    required = found.sparkSession.sql(f"SELECT * FROM {required_sql()}")
    lacking = typed.join(required, "type").where(F.coalesce(F.expr("get_json_object(node, '$.' || field)"), F.lit("")) == "")
    return tops.unionByName(untyped).unionByName(lacking.select(*keys, "node_ord", "type", F.col("field").alias("error")))


def judged(found: DataFrame, keys: list[str], json: str = "json") -> DataFrame:
    """(keys, root, context_ok, nodes, unknown_types, errors, valid) of each block; unknown types are a note, not an error."""
    wrong = errors(found, keys, json).groupBy(*keys).agg(F.count("*").alias("errors"))
    held = nodes(found, json).groupBy(*keys).agg(F.count("*").alias("nodes"), F.sum(F.size(F.filter("types", lambda t: ~t.isin(list(REQUIRED))))).alias("unknown_types"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return rooted(found, json).select(*keys, "root", "context_ok").join(held, keys, "left").join(wrong, keys, "left").select(*keys, "root", "context_ok", zero("nodes"), zero("unknown_types"), zero("errors"), F.col("errors").isNull().alias("valid"))


def file_verdicts(found: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """(key, block_count, errors, valid) of every document: one without a block isn't valid, but has no error of a block."""
    per = judged(found, [key, "ord"]).groupBy(key).agg(F.count("*").alias("block_count"), F.sum("errors").alias("errors"))
    return documents.select(key).distinct().join(per, key, "left").select(key, F.coalesce("block_count", F.lit(0)).alias("block_count"), F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce(F.col("errors") == 0, F.lit(False)).alias("valid"))


def article(headline: Column, url: Column, author: Column, published: Column, kind: str = "Article") -> Column:
    """The JSON text of an article node; nulls are left out."""
    return F.to_json(F.struct(F.lit(CONTEXT).alias("@context"), F.lit(kind).alias("@type"), headline.alias("headline"), url.alias("url"), F.when(author.isNotNull(), F.struct(F.lit("Person").alias("@type"), author.alias("name"))).alias("author"), published.alias("datePublished")))


def faq(pairs: Column) -> Column:
    """The JSON text of a question page from an array of (question, answer); the first five questions that end in '?' with answers of 15 characters or more."""
    fine = F.slice(F.filter(pairs, lambda p: p["question"].endswith("?") & (F.length(p["answer"]) >= 15)), 1, 5)
    items = F.transform(fine, lambda p: F.struct(F.lit("Question").alias("@type"), p["question"].alias("name"), F.struct(F.lit("Answer").alias("@type"), p["answer"].alias("text")).alias("acceptedAnswer")))
    return F.to_json(F.struct(F.lit(CONTEXT).alias("@context"), F.lit("FAQPage").alias("@type"), items.alias("mainEntity")))


def injected(content: Column, json: Column, html: Column) -> Column:
    """content with its JSON-LD replaced, or put before </head>, else </body>, else at the end; Markdown gets a fenced block."""
    script = F.concat(F.lit('<script type="application/ld+json">'), F.replace(json, F.lit("</"), F.lit("<\\/")), F.lit("</script>"))
    old = r"(?i)<script[^>]*application/ld\\+json[^>]*>[\\s\\S]*?</script>"
    quoted = F.regexp_replace(script, r"([\\$])", r"\\$1")
    put = lambda pattern, by: F.regexp_replace(content, F.lit(pattern), by)
    page = F.when(content.rlike(old), put(old, quoted)).when(content.rlike("(?i)</head>"), put("(?i)</head>", F.concat(quoted, F.lit("</head>")))).when(content.rlike("(?i)</body>"), put("(?i)</body>", F.concat(quoted, F.lit("</body>")))).otherwise(F.concat(content, script))
    fence = F.concat(F.lit("```json\n"), json, F.lit("\n```"))
    block = r"```json\\s*\\n[\\s\\S]*?```"
    text = F.when(content.rlike(block), put(block, F.regexp_replace(fence, r"([\\$])", r"\\$1"))).otherwise(F.concat(content, F.lit("\n\n"), fence, F.lit("\n")))
    return F.when(html, page).otherwise(text)
