"""Sitemaps, link indexes and discovery: ignore rules, page addresses, entries, packing, coverage and a bounded crawl."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import positions

MAX_URLS = 50_000


# Discovery
def ignore_rule(line: str) -> tuple[bool, str] | None:
    """(negated, pattern) of an ignore line, None of a blank or comment. Brackets are literal."""
    rule = line.strip()
    if not rule or rule.startswith("#"):
        return None
    negated, rule = rule.startswith("!"), rule.removeprefix("!")
    anchored, rule = rule.startswith("/"), rule.removeprefix("/")
    folder, rule = rule.endswith("/"), rule.removesuffix("/")
    out = []
    for part in re.split(r"(\*\*/|\*\*|\*|\?)", rule):
        out.append({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or re.sub(r"([.+^${}()|\[\]\\])", r"\\\1", part))
    body = ("^" if anchored else "(?:^|.*/)") + (f"(?:{''.join(out)}/.*|{''.join(out)}$)" if folder else "".join(out))
    return negated, body if folder else body + ("$" if body.endswith(".*") else "(?:/.*)?$")


def ignored(path: str, lines: list[str], matches: Callable[[str, str], str]) -> str:
    """Whether the last rule that matches path ignores it, as one CASE: rules are few and known, so it is pushed to the scan."""
    rules = [r for r in map(ignore_rule, lines) if r]
    return "CASE " + " ".join(f"WHEN {matches(path, p)} THEN {'false' if n else 'true'}" for n, p in reversed(rules)) + " ELSE false END" if rules else "false"


def page_url(path: str, site: str, strip: str = "") -> str:
    """Address of a page (Spark SQL): prefix and extension off, index to its folder, a closing slash, each segment encoded."""
    rel = f"regexp_replace({path}, '^{re.escape(strip.rstrip('/'))}/', '')" if strip else path
    bare = rf"regexp_replace(regexp_replace({rel}, r'\.[^./]*$', ''), r'(^|/)index$', '$1')"
    whole = f"CASE WHEN {bare} = '' OR {bare} RLIKE '/$' THEN {bare} ELSE {bare} || '/' END"
    encoded = f"array_join(transform(split({whole}, '/'), s -> replace(url_encode(s), '+', '%20')), '/')"
    return f"'{site.rstrip('/')}/' || {encoded}"


# Sitemaps
XML = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&apos;"))


def xml_escaped(x: str) -> str:
    for a, b in XML:
        x = f"replace({x}, '{a}' , '{b}')" if a != "''" else f"replace({x}, chr(39), '{b}')"
    return x


def chunked(entries: DataFrame, key: str, size: int = MAX_URLS) -> DataFrame:
    """entries with `chunk`, the sitemap file that each is in, by order of key."""
    return positions(entries, key, "__p").withColumn("chunk", F.floor(F.col("__p") / size)).drop("__p")


def resolved_entries(entries: DataFrame, base: str, url: str = "url") -> DataFrame:
    """entries with loc: addresses that begin with http stay, others follow the base."""
    return entries.withColumn("loc", F.when(F.col(url).startswith("http"), F.col(url)).otherwise(F.concat(F.lit(base), F.col(url))))


def lastmod(explicit: str, modified: str) -> str:
    """The date of an entry, in SQL: an explicit one that is a date, else the file's (a timestamp), else null."""
    return f"coalesce(CAST(TRY_CAST({explicit} AS DATE) AS STRING), CAST(CAST({modified} AS DATE) AS STRING))"


def index_entries(entries: DataFrame, key: str, base: str, size: int = MAX_URLS) -> DataFrame:
    """(chunk, loc, lastmod) of the files of an index: their addresses and the greatest date in each; one file needs no index, and then there is no row."""
    files = chunked(entries, key, size).groupBy("chunk").agg(F.max("lastmod").alias("lastmod"))
    many = files.agg(F.count("*").alias("__m"))  # one row
    return files.crossJoin(F.broadcast(many)).where("__m > 1").select("chunk", F.concat(F.lit(base.rstrip("/") + "/sitemap-"), (F.col("chunk") + 1).cast("string"), F.lit(".xml")).alias("loc"), "lastmod")


def image_entries(pages: DataFrame, key: str, html: str = "html", url: str = "url") -> DataFrame:
    """(key, ord, loc, image): http images of each page, once each, in the order of the page, for the image extension."""
    found = F.expr(rf"array_distinct(filter(regexp_extract_all({html}, r'(?i)<img\s[^>]*src=[\x22\x27]([^\x22\x27]*)[\x22\x27]', 1), i -> i RLIKE '(?i)^https?://'))")
    return pages.select(key, F.posexplode(found).alias("ord", "image"), F.col(url).alias("loc")).select(key, F.col("ord").cast("bigint").alias("ord"), "loc", "image")


def error_page(path: str) -> str:
    """Whether a path names an error page, which no sitemap lists (SQL)."""
    return f"(lower(regexp_extract({path}, '([^/]*)$', 1)) IN ('404.html', '404.md', '404.htm', '500.html'))"


def sitemap_entries(files: DataFrame, key: str, xml: str = "xml") -> DataFrame:
    """(key, ord, kind, loc, lastmod, issue) of what sitemaps list: kind is 'url' or 'sitemap'; issue is null, 'scheme' or 'invalid'. Entries without an address have no row.

    Broken markup is read as far as its tags go.
    """
    parts = F.expr(r"regexp_extract_all(%s, r'(?is)<(?:url|sitemap)(?:\s[^>]*)?>.*?</(?:url|sitemap)\s*>', 0)" % xml)
    each = files.select(key, F.posexplode(parts).alias("ord", "e"))
    value = lambda tag: F.expr(r"regexp_replace(regexp_extract(e, r'(?is)<%s(?:\s[^>]*)?>(?:\s*<!\[CDATA\[)?(.*?)(?:\]\]>\s*)?</%s\s*>', 1), r'^\s+|\s+$', '')" % (tag, tag))
    text = value("loc")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    rows = each.select(key, F.col("ord").cast("bigint").alias("ord"), F.when(F.col("e").rlike("(?i)^<sitemap"), "sitemap").otherwise("url").alias("kind"), text.alias("loc"), F.nullif(value("lastmod"), F.lit("")).alias("lastmod")).where("loc <> ''")
    issue = F.when(F.col("loc").rlike(r"(?i)^https?://[^\s/?#]+"), None).when(F.col("loc").rlike(r"(?i)^[a-z][a-z0-9+.-]*:") & ~F.col("loc").rlike(r"(?i)^https?:"), "scheme").otherwise("invalid")
    return rows.withColumn("issue", issue)


def sitemap_verdicts(files: DataFrame, key: str, xml: str = "xml", most: int = MAX_URLS) -> DataFrame:
    """(key, urls, sitemaps, skipped, no_root, over, valid) of each sitemap."""
    n = lambda c: F.count_if(c).cast("bigint")
    per = sitemap_entries(files, key, xml).groupBy(key).agg(n(F.col("issue").isNull() & (F.col("kind") == "url")).alias("urls"), n(F.col("issue").isNull() & (F.col("kind") == "sitemap")).alias("sitemaps"), n(F.col("issue").isNotNull()).alias("skipped"))
    rooted = files.select(key, (~F.col(xml).rlike(r"(?i)<(?:urlset|sitemapindex)[\s>]")).alias("no_root")).join(per, key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = rooted.select(key, zero("urls"), zero("sitemaps"), zero("skipped"), "no_root").withColumn("over", F.col("urls") > most)
    return out.withColumn("valid", F.expr("NOT no_root AND skipped = 0 AND urls + sitemaps > 0 AND NOT over"))


def site_pipeline(listed: DataFrame, fetched: DataFrame, disallowed: DataFrame, most: int = 50) -> DataFrame:
    """(url, state, content): addresses a sitemap lists (url, ord), in order, once each: those that robots.txt disallows (url) are 'blocked', of the others the first
    `most` (the budget of a run, a parameter) are 'audited' with their content or 'failed' without, and the rest are 'skipped'. What is fetched comes as a table."""
    once = listed.where("url IS NOT NULL").groupBy("url").agg(F.min("ord").alias("ord"))
    open_ = positions(once.join(disallowed.select("url").distinct(), "url", "left_anti"), "ord")
    blocked = once.join(disallowed.select("url").distinct(), "url", "left_semi").select("url", F.lit("blocked").alias("state"), F.lit(None).cast("string").alias("content"))
    taken = open_.where(F.col("position") < most).join(fetched.groupBy("url").agg(F.min("content").alias("content")), "url", "left")
    audited = taken.select("url", F.when(F.col("content").isNull(), "failed").otherwise("audited").alias("state"), "content")
    return audited.unionByName(open_.where(F.col("position") >= most).select("url", F.lit("skipped").alias("state"), F.lit(None).cast("string").alias("content"))).unionByName(blocked)


def sitemap_issues(d, xml: str) -> dict[str, str]:
    """Counts of what is wrong with a sitemap: declaration, root, namespace, addresses, frequencies, priorities, dates."""
    loc = d.every(xml, r"<loc>\s*([^<]*?)\s*</loc>", 1)
    return {
        "no_declaration": f"NOT {d.has(xml, r'^<\?xml\s+version=\x221\.0\x22')}",
        "no_root": f"NOT ({d.has(xml, '<urlset|<sitemapindex')})",
        "no_namespace": f"NOT contains({xml}, 'http://www.sitemaps.org/schemas/sitemap/0.9')",
        "urls": d.size(d.filter(loc, "u", d.has("u", r"^https?://[^\s/]+"))),
        "bad_urls": d.size(d.filter(loc, "u", f"NOT {d.has('u', r'^https?://[^\s/]+')}")),
        "bad_freqs": d.size(d.filter(d.every(xml, r"<changefreq>\s*([^<]*?)\s*</changefreq>", 1), "f", "f NOT IN ('always', 'hourly', 'daily', 'weekly', 'monthly', 'yearly', 'never')")),
        "bad_priorities": d.size(d.filter(d.every(xml, r"<priority>\s*([^<]*?)\s*</priority>", 1), "p", f"NOT {d.has('p', r'^(?:0(?:\.\d*)?|1(?:\.0*)?|\.\d+)$')}")),
        "bad_dates": d.size(d.filter(d.every(xml, r"<lastmod>\s*([^<]*?)\s*</lastmod>", 1), "m", f"NOT {d.has('m', r'^\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])')}")),
    }


def crawl(root: list[str], fetch: DataFrame, max_fetches: int = 100, max_urls: int = MAX_URLS) -> tuple[DataFrame, dict[str, int]]:
    """Distinct page addresses reached from sitemap indexes breadth first, with counts of what the caps left out.

    fetch has (sitemap, ord, loc, is_index): what each sitemap lists. A level is one join; the loop runs on the driver over
    levels only, and the frontier, at most max_fetches addresses, is what it holds.
    """
    spark = fetch.sparkSession
    level, seen, fetched, skipped, pages, depth = list(dict.fromkeys(root)), set(root), 0, 0, None, 0
    while level:
        take, left = level[: max_fetches - fetched], level[max_fetches - fetched :]
        fetched, skipped = fetched + len(take), skipped + len(left)
        if not take:
            break
        frontier = spark.createDataFrame(list(enumerate(take)), "rank bigint, sitemap string")
        listed = fetch.join(frontier, "sitemap")
        found = listed.where("NOT is_index").select(F.lit(depth).cast("bigint").alias("depth"), "rank", "ord", "loc")
        pages = found if pages is None else pages.unionByName(found)
        # One level's indexes: no more than can still be fetched are collected, and the rest are counted.
        new = listed.where("is_index").groupBy("loc").agg(F.min(F.struct("rank", "ord")).alias("first")).orderBy("first")
        room = max_fetches - fetched + len(seen) + 1
        level = [r.loc for r in new.limit(room).collect() if r.loc not in seen]
        seen |= set(level)
        depth += 1
    if pages is None:
        pages = spark.createDataFrame([], "depth bigint, rank bigint, ord bigint, loc string")
    first = pages.groupBy("loc").agg(F.min(F.struct("depth", "rank", "ord")).alias("first"))
    return first.orderBy("first").limit(max_urls).select("loc", "first.depth"), {"fetched": fetched, "skipped": skipped}


def capped_urls(pages: DataFrame, url: str, key: str, most: int = MAX_URLS) -> DataFrame:
    """(url, first, position, left_out): the first `most` distinct addresses in order of their least key (a unique bigint), and how many more there are."""
    first = pages.where(F.col(url).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(url).alias("url")).agg(F.min(key).alias("first"))
    left = first.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("left_out"))  # one row
    return positions(first, "first").where(F.col("position") < most).crossJoin(F.broadcast(left)).select("url", "first", "position", "left_out")


# Link indexes
def llms_entries(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, line, title, url, section, optional): listed links with the H2 section that they are in, 'Pages' before any."""
    lines = files.select(key, F.posexplode(F.split(content, "\n")).alias("line", "s"))
    head = F.expr(r"CASE WHEN s RLIKE r'^##\s+.+$' THEN trim(regexp_extract(s, r'^##\s+(.+)$', 1)) END")
    w = Window.partitionBy(key).orderBy("line")
    inside = lines.withColumn("section", F.last(head, ignorenulls=True).over(w)).where(F.col("s").rlike(r"^\s*-\s+\[[^\]]+\]\([^)]+\)"))
    link = r"^\s*-\s+\[([^\]]+)\]\(([^)]+)\)"
    return inside.select(key, F.col("line").cast("bigint").alias("line"), F.trim(F.regexp_extract("s", link, 1)).alias("title"), F.trim(F.regexp_extract("s", link, 2)).alias("url"), F.coalesce("section", F.lit("Pages")).alias("section"), F.coalesce(F.lower("section") == "optional", F.lit(False)).alias("optional"))


PRIVATE = r"/admin(?![0-9A-Za-z_])|/private(?![0-9A-Za-z_])|/internal(?![0-9A-Za-z_])|/\.|/_"


def llms_warnings(entries: DataFrame, key: str) -> DataFrame:
    """(key, line, url, odd_scheme, duplicate, private) of entries."""
    w = Window.partitionBy(key, "url").orderBy("line")
    path = F.expr(r"CASE WHEN url RLIKE r'^[A-Za-z][A-Za-z0-9+.-]*://' THEN regexp_extract(url, r'^[^:]*://[^/?#]*([^?#]*)', 1) ELSE url END")
    return entries.select(key, "line", "url", (F.col("url").rlike(r"(?i)^[a-z][a-z\d+.-]*:") & ~F.col("url").rlike(r"(?i)^https?:")).alias("odd_scheme"), (F.row_number().over(w) > 1).alias("duplicate"), path.rlike(PRIVATE).alias("private"))


def packed(pages: DataFrame, site: str, key: str, size: str, most: int = 500_000) -> DataFrame:
    """(site, key, file): next-fit packing in order of key; a page opens a new file when the current one isn't empty and would pass `most`.

    Next fit is sequential, so a site's sizes (16 bytes a page, never the pages) are folded in one pass.
    """
    listed = pages.groupBy(site).agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.col(size).cast("bigint").alias("s")))).alias("p"))
    files = F.expr(
        f"""aggregate(p, named_struct('file', 0L, 'used', 0L, 'any', false, 'all', CAST(array() AS ARRAY<BIGINT>)),
        (a, x) -> CASE WHEN a.any AND a.used + x.s > {most} THEN named_struct('file', a.file + 1, 'used', x.s, 'any', true, 'all', concat(a.all, array(a.file + 1)))
                  ELSE named_struct('file', a.file, 'used', a.used + x.s, 'any', true, 'all', concat(a.all, array(a.file))) END, a -> a.all)"""
    )
    return listed.select(site, F.explode(F.arrays_zip(F.col("p.k").alias("k"), files.alias("f"))).alias("z")).select(site, F.col("z.k").alias(key), F.col("z.f").alias("file"))


def uncovered(pages: DataFrame, listed: DataFrame, path: str = "path", url: str = "url") -> DataFrame:
    """Pages whose path no entry lists, as it is or with a closing slash: an anti-join on the normalised path."""
    norm = lambda c: F.regexp_replace(F.regexp_replace(c, r"^https?://[^/]*", ""), r"^/+|/+$", "")
    return pages.join(listed.select(norm(F.col(url)).alias("__u")).distinct(), norm(F.col(path)) == F.col("__u"), "left_anti")
