"""Documents from files, and reports back to files."""

from __future__ import annotations

import json
import os
import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.crawl import ignored, xml_escaped

EXTENSIONS = (".md", ".html", ".htm")


def discovered(spark: SparkSession, paths: list[str], extensions: tuple[str, ...] = EXTENSIONS, ignore: list[str] | None = None, root: str = "") -> DataFrame:
    """(path, content, status, error) of the documents under paths, in order of path. Hidden entries are skipped, the last ignore
    rule that matches a path (relative to root) decides, and a file that isn't UTF-8 is an error row, never a failure."""
    there = [p for p in paths if _exists(spark, p)]
    if not there:
        return spark.createDataFrame([], "path string, content string, status string, error string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(there).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")
    rel = f"regexp_replace(path, '^{root.rstrip('/')}/', '')" if root else "path"
    fine = files.where(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(list(extensions))).where(~F.expr(rel).rlike(r"(^|/)\.[^/]"))
    kept = fine.where(~F.expr(ignored(rel, ignore or [], lambda t, p: f"{t} RLIKE r'{p}'")))
    read = F.expr("try_validate_utf8(CAST(content AS STRING))")
    return kept.select("path", read.alias("content"), F.when(read.isNull(), "error").otherwise("success").alias("status"), F.when(read.isNull(), F.concat(F.lit("Read failed: not UTF-8: "), "path")).alias("error")).orderBy("path")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_reports(reports: DataFrame, path: str) -> None:
    """One JSON object a line; Spark's commit makes the output appear whole or not at all."""
    reports.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def gate(scores: DataFrame, threshold: float, score: str = "score") -> bool:
    """Whether a run passes: no error row and no score below threshold."""
    return scores.where(f"status = 'error' OR {score} < {threshold}").isEmpty()


def inside(path: str, root: str) -> bool:
    """Whether path, links resolved, lies within root."""
    real, base = os.path.realpath(path), os.path.realpath(root)
    return real == base or real.startswith(base.rstrip(os.sep) + os.sep)


def config(path: str | None) -> dict:
    """Settings from a JSON file: an explicit path has to exist and hold an object of known kinds; without one there are none."""
    if path is None:
        return {}
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    kinds = {"limits": dict, "acronyms": dict, "ignore": list, "profile": str, "model": str}
    if not isinstance(data, dict) or any(k in data and not isinstance(data[k], t) for k, t in kinds.items()):
        raise ValueError(f"{path}: not a configuration")
    return data


def sitemap_file(entries: DataFrame, by: str, order: str) -> DataFrame:
    """(by, xml): a urlset for each value of by, from entries (loc, lastmod, changefreq, priority) in order."""
    loc = xml_escaped("loc")
    one = f"""'  <url><loc>' || {loc} || '</loc>' || coalesce('<lastmod>' || lastmod || '</lastmod>', '') || '<changefreq>' || changefreq || '</changefreq><priority>' || format_number(priority, '0.0') || '</priority></url>'"""
    body = F.expr("array_join(transform(sort_array(collect_list(struct(__o, __x))), e -> e.__x), '\\n')")
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n'
    return entries.select(by, F.col(order).alias("__o"), F.expr(one).alias("__x")).groupBy(by).agg(F.concat(F.lit(head), body, F.lit("\n</urlset>\n")).alias("xml"))


def llms_file(pages: DataFrame, site: str, order: str) -> DataFrame:
    """(site, content): a link index a site from (title, url, description, section): sections by first page, Optional last."""
    title = "regexp_replace(title, r'([\\\\\\[\\](])', r'\\\\$1')"
    lines = pages.groupBy(site, "section").agg(F.min(order).alias("__f"), F.expr(f"array_join(transform(sort_array(collect_list(struct({order} AS o, concat('- [', {title}, '](', url, ')', coalesce(concat(': ', description), '')) AS x))), e -> e.x), '\\n')").alias("__x"))
    last = F.when(F.lower("section") == "optional", 1).otherwise(0)
    text = lines.select(site, F.struct(last.alias("l"), F.col("__f").alias("f"), F.concat(F.lit("## "), "section", F.lit("\n\n"), "__x", F.lit("\n")).alias("x")).alias("e"))
    return text.groupBy(site).agg(F.concat(F.lit("# "), F.col(site).cast("string"), F.lit("\n\n"), F.expr("array_join(transform(sort_array(collect_list(e)), s -> s.x), '\\n')")).alias("content"))


def report_html(title: str, rows: list[tuple[str, object]]) -> str:
    """A small page of figures; everything is escaped."""
    import html

    cells = "".join(f"<tr><th>{html.escape(str(k))}</th><td>{html.escape(str(v))}</td></tr>" for k, v in rows)
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table>{cells}</table></body></html>"


def common_base(paths: list[str]) -> str:
    """The longest folder that all paths share."""
    return posixpath.commonpath([posixpath.dirname(p) for p in paths]) if paths else ""
