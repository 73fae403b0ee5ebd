"""Link indexes and full-text files: what a page brings to them, files with a size cut, and the audit of an index."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from ..sources.parsers import Tree, frontmatter_of
from ..sources.tables import slices
from .crawl import llms_entries

_GONE = [re.compile(p, re.I) for p in (r"<script[\s\S]*?</script>", r"<style[\s\S]*?</style>", r"<!--[\s\S]*?-->")]
_SHOWN = frozenset("h1 h2 h3 h4 h5 h6 p ul ol li table pre code blockquote".split())


def with_fields(content: str, fields: Sequence[str]) -> str:
    """The frontmatter's texts and lists of texts named by fields, in their order, and the body: paragraphs of their own."""
    if not fields:
        return ""
    data, body = frontmatter_of(content)
    values = json.loads(data)
    parts = []
    for name in fields:
        v = values.get(name)
        parts += [x.strip() for x in (v if isinstance(v, list) else [v]) if isinstance(x, str) and x.strip()]
    return "\n\n".join([*parts, *([body.strip()] if body.strip() else [])])


def structured(content: str) -> str:
    """A document for a full-text file: scripts, styles, comments and frontmatter go; a page becomes its main part's headings, items, quotations, code and paragraphs."""
    for p in _GONE:
        content = p.sub("", content) if "<" in content else content
    if re.search(r"<html[\s>]", content, re.I) or re.match(r"\s*<!DOCTYPE\s", content, re.I):
        content = _page(Tree(content))
    else:
        content = re.sub(r"\A---\n[\s\S]*?\n---\n", "", content)
    return re.sub(r"\n{4,}", "\n\n\n", content).strip()


def _text(tree: Tree, k: int, gone: set[int]) -> str:
    """The text in a node but for nodes that are gone. No function within _page, which would hold its tree until the next full collection."""
    return "".join(x if isinstance(x, str) else _text(tree, x, gone) for x in tree.kids[k] if isinstance(x, str) or x not in gone)


def _page(tree: Tree) -> str:
    gone: set[int] = set()
    for n in tree.nodes:
        style = n[4].get("style", "")
        if n[1] in gone or n[3] in ("script", "style", "noscript", "meta", "link", "head", "nav", "footer") or "hidden" in n[4] or n[4].get("aria-hidden") == "true" or "display:none" in style or "display: none" in style:
            gone.add(n[0])

    there = [k for k in tree.find("main") if k not in gone] or [k for k in tree.find("article") if k not in gone][:1] or [tree.body]
    seen, out = set(), []
    for top in there:
        for k in tree.within(top):
            tag = tree.nodes[k][3]
            if k in gone or k in seen or tag not in _SHOWN:
                continue
            seen.add(k)
            own = _text(tree, k, gone)
            flat = " ".join(own.split())
            if flat:
                out.append("\n" + "#" * int(tag[1]) + " " + flat + "\n" if tag[0] == "h" else "- " + flat if tag == "li" else "\n```\n" + own + "\n```\n" if tag in ("pre", "code") else "> " + flat if tag == "blockquote" else flat)
    return "\n\n".join(out)


def prepared(df: DataFrame, key: str, content: str = "content", fields: Sequence[str] = ()) -> DataFrame:
    """(key, full): structured() text of every document, of its frontmatter fields and body where fields are named; null stays null."""
    kind = StructType([df.schema[key], StructField("full", StringType())])
    target = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for b in batches for x in slices(b, 1)):
            out = [None if t is None else structured(with_fields(t, fields) if fields else t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(target.field(0).type), pa.array(out, pa.string())], schema=target)

    return df.select(key, content).mapInArrow(run, kind)


def full_pages(pages: DataFrame, site: str, order: str, most: int = 500_000) -> DataFrame:
    """(site, order, text, begins, cut): what each page (title, url, full) of a site adds to its single full-text file and where it begins there; the file ends with the first paragraph at which it reaches `most` characters.

    Places are running sums by site and order: a site's texts never meet in one row. A later page adds nothing; cut marks the page that the file ends in.
    """
    head = "## [' || replace(replace(replace(replace(title, '\\\\', '\\\\\\\\'), '[', '\\\\['), ']', '\\\\]'), '(', '\\\\(') || '](' || url || ')"
    paragraphs = "filter(transform(split(coalesce(full, ''), '\\n{2,}'), p -> regexp_replace(p, r'^\\s+|\\s+$', '')), p -> p <> '')"
    blocks = pages.select(site, order, F.expr(f"concat(array('---', '{head}'), {paragraphs})").alias("__b")).withColumn("__n", F.expr("aggregate(__b, 0L, (a, x) -> a + length(x) + 2)"))
    w = Window.partitionBy(site).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("begins", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    # How many blocks fit: the first that reaches `most` is the last.
    upto = f"aggregate(__b, named_struct('at', begins, 'n', 0), (a, x) -> CASE WHEN a.n > 2 AND a.at >= {most} THEN a ELSE named_struct('at', a.at + length(x) + 2, 'n', a.n + 1) END)"
    kept = placed.where(f"begins < {most}").withColumn("__u", F.expr(upto))
    text = F.expr("array_join(slice(__b, 1, __u.n), '\\n\\n')")
    return kept.select(site, order, text.alias("text"), "begins", F.expr(f"__u.at >= {most}").alias("cut"))


def index_audit(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, kind, rule, n) of each index: the error no_title; the notes no_summary, no_sections, no_description, optional_not_last, with the number of entries concerned. Rules that hold give no row."""
    entries = llms_entries(files, key, content)
    lines = files.select(key, F.posexplode(F.split(content, "\n")).alias("line", "s"))
    described = entries.join(lines, [key, "line"]).groupBy(key).agg(F.count_if(~F.col("s").rlike(r"\]\([^)]+\):")).cast("bigint").alias("bare"))
    heads = F.expr(r"transform(filter(split(%s, '\n'), l -> l RLIKE r'^##\s+.+$'), l -> lower(trim(regexp_extract(l, r'^##\s+(.+)$', 1))))" % content)
    facts = files.select(key, (~F.col(content).rlike(r"(?m)^#\s+\S")).alias("t"), (~F.col(content).rlike(r"(?m)^>\s+\S")).alias("q"), (~F.col(content).rlike(r"(?m)^##\s+\S")).alias("h"), heads.alias("heads")).join(described, key, "left")
    return facts.select(key, F.expr("""inline(array_compact(array(CASE WHEN t THEN named_struct('kind', 'error', 'rule', 'no_title', 'n', 1L) END, CASE WHEN q THEN named_struct('kind', 'note', 'rule', 'no_summary', 'n', 1L) END,
      CASE WHEN h THEN named_struct('kind', 'note', 'rule', 'no_sections', 'n', 1L) END, CASE WHEN bare > 0 THEN named_struct('kind', 'note', 'rule', 'no_description', 'n', bare) END,
      CASE WHEN array_position(heads, 'optional') BETWEEN 1 AND size(heads) - 1 THEN named_struct('kind', 'note', 'rule', 'optional_not_last', 'n', 1L) END)))"""))  # fmt: skip


def coverage(pages: DataFrame, listed: DataFrame, path: str = "path", url: str = "url") -> DataFrame:
    """Pages, but index pages at the root, that no listed address names: not by path, with or without a closing slash, nor as part of a longer path or by file name in one.

    Exact matches go by an anti-join; only what they leave, and the distinct paths, meet in the search for parts: by name, which every such path contains.
    """
    rel = F.regexp_replace(F.regexp_replace(F.concat(F.lit("/"), F.regexp_replace(F.col(path), r"^/+", "")), r"\.[^./]*$", ""), r"/index$", "")
    paths = listed.select(F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "").alias("__p")).where("__p IS NOT NULL").distinct()
    asked = pages.where(F.col(path).isNotNull()).withColumn("__rel", rel).where("__rel NOT IN ('', '/')")
    left = asked.join(paths.select(F.regexp_replace("__p", r"/$", "").alias("__rel")).distinct(), "__rel", "left_anti")
    name = left.withColumn("__name", F.regexp_extract(F.regexp_replace(path, r"\.[^./]*$", ""), r"([^/]*)$", 1))
    # What a path contains are its pieces: each path is cut into pieces of the lengths that are asked for.
    asked_for = name.select(F.explode(F.array("__name", "__rel")).alias("t")).where("t <> ''")
    sizes = asked_for.select(F.length("t").alias("n")).distinct()  # lengths of paths: some hundred at most
    pieces = paths.crossJoin(F.broadcast(sizes)).select(F.explode(F.expr("CASE WHEN length(__p) >= n THEN transform(sequence(1, length(__p) - n + 1), i -> substr(__p, i, n)) ELSE array() END")).alias("t")).join(asked_for.distinct(), "t", "left_semi").distinct()
    return name.join(pieces.withColumnRenamed("t", "__name"), "__name", "left_anti").join(pieces.withColumnRenamed("t", "__rel"), "__rel", "left_anti").drop("__rel", "__name")
