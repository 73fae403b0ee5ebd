"""The named queries of the audit engine and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.layers import Layer, apply, check_sql
from ..functions.order import positions
from ..operators import audit, crawl, evidence, graph, jsonld, linkindex, robots, site, technical
from ..operators import pages as page_data
from ..operators import scalar as S
from ..sources import files, parsers
from ..sources.tables import table
from . import scoring_sql
from .corpora import LD, MARKDOWN_FROM, PAGE, PAGE_HEAD, PAGES_FROM, PATH, ROBOTS, ROBOTS_FROM

TABLES = ("documents", "pages", "labels", "conversations", "benchmark")
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived pages, Markdown and markup: (doc_id, path, content)."""
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{PATH} AS path", f"{PAGE} AS content")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the derived head elements: (page_id, url, html, head)."""
    return table(spark, sf_dir, "pages").where("page_id IS NOT NULL").selectExpr("page_id", "url", "html", f"{PAGE_HEAD} AS head")


#: An edit of every page, for before/after diffs.
EDITED = "CASE WHEN doc_id % 4 = 2 THEN content || 'Source: https://example.org' ELSE replace(content, 'according to', 'as per') END"


def projection(name: str, source: Callable[[SparkSession, str], DataFrame], sql_from: str, layers: list[Layer], keep: list[str]) -> None:
    """Register a query that only projects, in both engines from one definition."""
    _QUERIES[name] = lambda spark, d: apply(source(spark, d), layers, keep)
    _SQL[name] = check_sql(sql_from, layers, keep)


def scored(spark: SparkSession, sf_dir: str, keep: list[str] | None = None) -> DataFrame:
    return audit.audited(markdown(spark, sf_dir), keep=keep)


def named(*expressions: str) -> list[str]:
    """The figures that expressions name: only these are made."""
    return [x for x in (*audit.INTS, *audit.FLAGS, *audit.TEXTS, *audit.REALS, *audit.LISTS) if any(re.search(rf"\b{x}\b", e) for e in expressions)]


def compared(spark: SparkSession, sf_dir: str, keep: list[str]) -> DataFrame:
    """(doc_id, side, figures): each page before and after the edit, in one pass that scores a page once which the edit leaves as it is."""
    sides = markdown(spark, sf_dir).selectExpr("doc_id", "path", f"inline(array(struct('before' AS side, content AS content), struct('after' AS side, {EDITED} AS content)))")
    return audit.audited(sides, ["doc_id", "side"], keep=keep)


#: The figures as the checking engine has them; those of a null content are null.
_SCORED = scoring_sql.sql(f"(SELECT * FROM {MARKDOWN_FROM} m WHERE content IS NOT NULL)")
_NULLS = f"SELECT doc_id, path FROM {MARKDOWN_FROM} m WHERE content IS NULL"


def figures(name: str, keep: list[str]) -> None:
    """Register figures of every page: by trees on one side, by patterns in SQL on the other."""
    _QUERIES[name] = lambda spark, d: scored(spark, d, keep).select("doc_id", *keep)
    nulls = ", ".join(f"'error' AS {c}" if c == "status" else f"NULL AS {c}" for c in keep)
    _SQL[name] = f"SELECT doc_id, {', '.join(chr(39) + 'success' + chr(39) + ' AS status' if c == 'status' else c for c in keep)} FROM ({_SCORED}) t UNION ALL SELECT doc_id, {nulls} FROM ({_NULLS}) n"


for _name, _keep in {
    "score_v2_dims": ["status", "profile", "confidence", "v2_structure", "v2_statistics", "v2_quotations", "v2_citations", "v2_clarity", "v2_score", "band"],
    "stat_attribution": ["stat_total", "stat_sourced"], "quote_attribution": ["quote_total", "quote_found", "quote_attributed", "attribution_status"], "heading_skips": ["heading_count", "heading_skips", "heading_repeats", "starts_late", "heading_status"],
    "sections_thin": ["section_count", "section_thin", "section_status"], "paragraph_stats": ["paragraph_count", "paragraph_min", "paragraph_max", "paragraph_median", "paragraph_long", "paragraph_status"],
    "intro_answer_first": ["intro", "intro_words", "intro_defines", "answer_status"], "freshness_dates": ["published", "reviewed", "fresh_status"], "link_quality_md": ["external", "internal", "sources_section", "link_status"],
    "acronyms_unexplained": ["acr_unexplained", "acr2_unexplained"], "semantic_html": ["is_html", "semantic_count", "semantic_status", "v1_dynamic"], "score_v1": ["v1_structure", "v1_statistics", "v1_quotations", "v1_citations", "v1_clarity", "v1_total"],
}.items():
    figures(_name, _keep)


projection(
    "tech_audit", pages, PAGES_FROM, technical.audit(),
    ["page_id", "title_count", "title_empty", "canonical_count", "canonical_conflict", "canonical_absolute", "unknown_directives", "directive_conflict", "noindex", "h1_count", "level_skips", "bad_languages", "repeated_languages",
     "relative_alternates", "link_count", "bad_links", "block_count", "visible_words", "app_shell", "f_title", "f_visible_main_text", "f_canonical", "f_meta_robots", "f_heading_order", "f_language_alternates", "f_internal_links", "f_empty_app_shell", "invalid_blocks", "unseen_names", "f_structured_data"],
)
projection("word_counts", documents, "documents", [lambda d: {"words": T.words(d, "text"), "blank_words": T.blank_words(d, "text")}], ["doc_id", "words", "blank_words"])
projection("strip_preprocess", markdown, MARKDOWN_FROM, [lambda d: {"body": T.body(d, "content"), "pre": T.preprocessed(d, "content")}], ["doc_id", "body", "pre"])
projection("html_detect", pages, PAGES_FROM, [lambda d: {"html_page": T.is_html(d, "html"), "html_head": T.is_html(d, "head"), "html_url": T.is_html(d, "url")}], ["page_id", "html_page", "html_head", "html_url"])
projection("visible_text", pages, PAGES_FROM, [lambda d: {"visible": T.visible(d, "html")}], ["page_id", "visible"])
projection("truncate_desc", documents, "documents", [lambda d: {"description": T.truncated(d, "text")}], ["doc_id", "description"])
projection("pronoun_density", documents, "documents", [lambda d: {"pronouns": d.count("text", T.PRONOUN), "points": T.density_points(d, "text", 0.02)}], ["doc_id", "pronouns", "points"])
projection("stats_density_v1", markdown, MARKDOWN_FROM, [lambda d: {"numeric": T.statistics_v1(d, "content"), "verbal": T.verbal(d, "content"), "quotes": T.quotes_v1(d, "content")}], ["doc_id", "numeric", "verbal", "quotes"])
projection("profile_detect", markdown, MARKDOWN_FROM, [lambda d: {"ext": d.first("lower(path)", r"\.([^./]*)$")}, *S.profiles()], ["doc_id", "profile", "confidence"])
projection(
    "badge_and_priority", markdown, MARKDOWN_FROM, [lambda d: {"score": "CAST(doc_id * 37 % 101 AS BIGINT)"}, lambda d: {"grade": S.grade("score"), "url": S.badge_url("score"), "priority": S.sitemap_priority("score"), "freq": S.changefreq("CASE WHEN doc_id % 9 = 0 THEN NULL ELSE doc_id END"), "band": S.band("score")}],
    ["doc_id", "score", "grade", "url", "priority", "freq", "band"],
)
projection(
    "ip_and_hop_policy", pages, PAGES_FROM,
    [lambda d: {"ip": "CASE WHEN page_id % 10 = 9 THEN CASE page_id % 4 WHEN 0 THEN '::1' WHEN 1 THEN 'fe80::1' WHEN 2 THEN 'fd00::2' ELSE '2606:4700::1' END ELSE CAST(page_id * 7 % 256 AS STRING) || '.' || CAST(page_id * 31 % 256 AS STRING) || '.0.1' END"},
     lambda d: {"blocked": S.blocked_ip("ip"), "hop": S.hop_allowed(d, "url", "CASE WHEN page_id % 2 = 0 THEN url ELSE 'https://example.org/' END")}],
    ["page_id", "ip", "blocked", "hop"],
)
projection("page_metadata", markdown, MARKDOWN_FROM, page_data.metadata(), ["doc_id", "title", "description", "section"])
IGNORES = ["# drafts", "blog/", "!blog/2024/", "*.html", "!/site/docs/**", "/site/docs/index.md", "page ?1.md"]
projection("ignore_last_match", markdown, MARKDOWN_FROM, [lambda d: {"ignored": crawl.ignored("path", IGNORES, d.has)}], ["doc_id", "path", "ignored"])
SITEMAP = """CASE WHEN page_id % 10 <> 0 THEN '<?xml version="1.0" encoding="UTF-8"?>' ELSE '' END || '<urlset' || CASE WHEN page_id % 7 <> 0 THEN ' xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"' ELSE '' END || '><url><loc>' || url
  || '</loc><lastmod>' || CASE WHEN page_id % 3 = 0 THEN '2024-05-01' ELSE 'soon' END || '</lastmod><changefreq>' || CASE WHEN page_id % 4 = 0 THEN 'often' ELSE 'daily' END || '</changefreq><priority>' || CASE WHEN page_id % 5 = 0 THEN '1.5' ELSE '0.8' END
  || '</priority></url><url><loc>ftp://x/' || CAST(page_id AS STRING) || '</loc></url></urlset>'"""
projection("sitemap_validate", pages, PAGES_FROM, [lambda d: {"xml": SITEMAP}, lambda d: crawl.sitemap_issues(d, "xml")], ["page_id", "no_declaration", "no_root", "no_namespace", "urls", "bad_urls", "bad_freqs", "bad_priorities", "bad_dates"])

def both(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    _QUERIES[name] = query
    if sql:
        _SQL[name] = sql


_FOUND = named("status", *(severity for _, _, severity in site.FINDINGS))
both("findings_fact", lambda s, d: site.findings(scored(s, d, _FOUND)), f"{site.findings_sql(_SCORED)} SELECT * FROM f")
both("findings_dedupe", lambda s, d: site.deduplicated(site.findings(scored(s, d, _FOUND)).withColumn("facts", F.regexp_extract("rule_id", r"([^.]*)$", 1)).withColumn("rule_id", F.regexp_extract("rule_id", r"^([^.]*)", 1)), "facts").select("doc_id", "rule_id", "facts", "ord"),
     f"{site.findings_sql(_SCORED)} SELECT doc_id, regexp_extract(rule_id, '^([^.]*)', 1) AS rule_id, regexp_extract(rule_id, '([^.]*)$', 1) AS facts, min(ord) AS ord FROM f GROUP BY ALL")
both("top_findings", lambda s, d: site.top_findings(site.findings(scored(s, d, _FOUND))),
     f"{site.findings_sql(_SCORED)} SELECT rule_id, occurrences, severity FROM (SELECT rule_id, count(*) AS occurrences, min(doc_id * 100 + ord) AS first, arg_min(severity, doc_id * 100 + ord) AS severity FROM f WHERE severity <> 'pass' GROUP BY rule_id) t ORDER BY occurrences DESC, first LIMIT 10")
_RECS = " UNION ALL ".join(f"SELECT doc_id, {i} AS ord, '{t}' AS recommendation FROM s WHERE {c}" for i, (c, t) in enumerate(site.RECOMMENDATIONS))
both("top_recommendations", lambda s, d: site.top_recommendations(site.recommendations(scored(s, d, named(*(c for c, _ in site.RECOMMENDATIONS))))),
     f"WITH s AS MATERIALIZED ({_SCORED}), r AS ({_RECS}) SELECT recommendation, documents FROM (SELECT recommendation, count(*) AS documents, min(doc_id * 100 + ord) AS first FROM r GROUP BY recommendation) t ORDER BY documents DESC, first LIMIT 10")
_RECS_V1 = " UNION ALL ".join(f"SELECT doc_id, CAST({i} AS BIGINT) AS ord, '{t}' AS recommendation FROM s WHERE {c}" for i, (c, t) in enumerate(site.RECOMMENDATIONS_V1))
both("recommendations_v1", lambda s, d: site.recommendations(scored(s, d, named(*(c for c, _ in site.RECOMMENDATIONS_V1))), site.RECOMMENDATIONS_V1).withColumn("ord", F.col("ord").cast("bigint")), f"WITH s AS MATERIALIZED ({_SCORED}) {_RECS_V1}")
_OBSERVED = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, {s} AS status, {' || $$ $$ || '.join(f'CAST({n} AS VARCHAR)' for n in names) or repr('')} AS facts FROM s WHERE {s} IS NOT NULL" for k, s, names in site.OBSERVATIONS)
both("observations_fact", lambda s, d: site.observations(scored(s, d, named(*(x for _, status, names in site.OBSERVATIONS for x in (status, *names))))).withColumn("facts", F.array_join(F.map_values("facts"), " ")), f"WITH s AS MATERIALIZED ({_SCORED}) {_OBSERVED}")
both("file_view", lambda s, d: site.view(scored(s, d, ["status", "v2_score", "band", "profile"])), f"SELECT doc_id, path, 'success' AS status, v2_score, band, profile, NULL AS error FROM ({_SCORED}) t UNION ALL SELECT doc_id, path, 'error', NULL, NULL, NULL, 'Read failed: ' || coalesce(path, '') FROM ({_NULLS}) n")
both("report_message", lambda s, d: site.message(scored(s, d, ["status", "v2_score"]), among=["true", "status = 'error'", "status = 'none'"]),
     f"SELECT CASE WHEN n = 0 THEN 'No documents found' WHEN k = 0 THEN 'No document could be scored' END AS message FROM (SELECT count(*) AS n, count(content) AS k FROM {MARKDOWN_FROM} m UNION ALL SELECT count(*), 0 FROM {MARKDOWN_FROM} m WHERE content IS NULL UNION ALL SELECT 0, 0) t")
both("batch_tally", lambda s, d: site.tally(scored(s, d, ["status"])), f"SELECT count(*) AS total, count(content) AS succeeded, count(*) - count(content) AS failed FROM {MARKDOWN_FROM} m")
_DIMS = [f"{m}_{k}" for m in ("v1", "v2") for k in S.DIMENSIONS] + ["v1_total", "v2_score"]
both("score_deltas", lambda s, d: site.deltas(compared(s, d, list(site.COMPARED))),
     f"""WITH a AS MATERIALIZED ({scoring_sql.sql(f"(SELECT doc_id, path, {EDITED} AS content FROM {MARKDOWN_FROM} m WHERE content IS NOT NULL)")}), b AS MATERIALIZED ({_SCORED}), n AS ({_NULLS})
     {' UNION ALL '.join(f"SELECT doc_id, '{x}' AS dimension, b.{x} AS before, a.{x} AS after, a.{x} - b.{x} AS delta FROM b JOIN a USING (doc_id) UNION ALL SELECT doc_id, '{x}', NULL, NULL, NULL FROM n WHERE doc_id IS NOT NULL" for x in _DIMS)}""")  # fmt: skip
both("site_summary", lambda s, d: site.summary(scored(s, d, ["v2_score"])),
     f"""SELECT count(*) AS total, count(v2_score) AS succeeded, count(*) - count(v2_score) AS failed, floor(avg(v2_score) * 100 + 0.5) / 100 AS average, floor(median(v2_score) * 100 + 0.5) / 100 AS median, min(v2_score) AS lowest, max(v2_score) AS highest,
     floor(stddev_pop(v2_score) * 100 + 0.5) / 100 AS deviation, count(*) FILTER (v2_score >= 80) AS excellent, count(*) FILTER (v2_score BETWEEN 50 AND 79) AS good, count(*) FILTER (v2_score < 50) AS needs_work FROM (SELECT v2_score FROM ({_SCORED}) t UNION ALL SELECT NULL FROM ({_NULLS}) n) t""")  # fmt: skip
both("worst_files", lambda s, d: site.worst(scored(s, d, ["v2_score"])), f"SELECT doc_id, path, v2_score FROM ({_SCORED}) t ORDER BY v2_score, doc_id LIMIT 5")
both("findings_diff", lambda s, d: site.changes(site.findings(compared(s, d, _FOUND), "side")),
     f"""WITH a AS MATERIALIZED ({scoring_sql.sql(f"(SELECT doc_id, path, {EDITED} AS content FROM {MARKDOWN_FROM} m WHERE content IS NOT NULL)")}), b AS MATERIALIZED ({_SCORED}),
     x AS (SELECT DISTINCT doc_id, rule_id FROM ({site.findings_sql('SELECT * FROM b')} SELECT * FROM f) t WHERE severity IN ('warn', 'fail')),
     y AS (SELECT DISTINCT doc_id, rule_id FROM ({site.findings_sql('SELECT * FROM a')} SELECT * FROM f) t WHERE severity IN ('warn', 'fail'))
     SELECT doc_id, rule_id, CASE WHEN y.k IS NULL THEN 'improved' WHEN x.k IS NULL THEN 'regressed' ELSE 'unchanged' END AS change FROM (SELECT *, 1 AS k FROM x) x FULL JOIN (SELECT *, 1 AS k FROM y) y USING (doc_id, rule_id)""")  # fmt: skip
both("quality_by_band", lambda s, d: scored(s, d, ["status", "profile", "band"]).where("status = 'success'").select("doc_id", "profile", "band").join(table(s, d, "labels").select("doc_id", "quality"), "doc_id").cube("profile", "band").agg(F.count("*").alias("documents"), F.sum("quality").alias("good"), F.grouping_id().alias("level")).select(F.coalesce("profile", F.lit("all")).alias("profile"), F.coalesce("band", F.lit("all")).alias("band"), "documents", "good", "level"),
     f"SELECT coalesce(profile, 'all') AS profile, coalesce(band, 'all') AS band, count(*) AS documents, CAST(sum(quality) AS BIGINT) AS good, grouping_id(profile, band) AS level FROM ({_SCORED}) t JOIN labels USING (doc_id) GROUP BY CUBE (profile, band)")

# Crawler policy
_ROBOTS_SQL = f"""
line AS (SELECT page_id, unnest(range(len(string_split(content, chr(10))))) AS line, unnest(string_split(content, chr(10))) AS raw FROM {ROBOTS_FROM} r),
said AS (SELECT page_id, line, regexp_replace(regexp_replace(raw, '#.*', ''), '^\\s+|\\s+$', '', 'g') AS s, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') = '' AS blank FROM line),
kind AS (SELECT page_id, line, CASE WHEN blank THEN 'blank' WHEN regexp_matches(s, '(?i)^user-agent:.*[^\\s,:]') AND len(list_filter(string_split(regexp_extract(s, '(?i)^user-agent:\\s*(.+)$', 1), ','), lambda t: trim(t) <> '')) > 0 THEN 'agent'
  WHEN regexp_matches(s, '(?i)^(allow|disallow):') THEN lower(regexp_extract(s, '(?i)^(allow|disallow):', 1)) END AS kind, regexp_extract(s, '^[^:]*:\\s*(.*)$', 1) AS value FROM said),
grp AS (SELECT *, sum(CASE WHEN kind = 'agent' AND coalesce(prev, '') <> 'agent' THEN 1 ELSE 0 END) OVER w AS grp, coalesce(max(CASE WHEN kind = 'agent' THEN line END) OVER w, -1) > coalesce(max(CASE WHEN kind = 'blank' THEN line END) OVER w, -1) AS open
  FROM (SELECT *, lag(kind) OVER (PARTITION BY page_id ORDER BY line) AS prev FROM kind WHERE kind IS NOT NULL) t WINDOW w AS (PARTITION BY page_id ORDER BY line)),
rules AS (SELECT page_id, line, grp, kind, value FROM grp WHERE kind <> 'blank' AND open),
agent AS (SELECT page_id, grp, trim(unnest(string_split(value, ','))) AS agent FROM rules WHERE kind = 'agent'),
crawler AS (SELECT * FROM {robots.CRAWLERS_SQL}),
best AS (SELECT page_id, token, grp, max(length(agent)) AS n FROM agent JOIN crawler ON agent = '*' OR contains(lower(token), lower(agent)) WHERE agent <> '' GROUP BY ALL),
chosen AS (SELECT page_id, token, grp FROM (SELECT *, rank() OVER (PARTITION BY page_id, token ORDER BY n DESC) AS r FROM best) t WHERE r = 1),
asked AS (SELECT page_id, unnest(['/', '/private/open', '/private/x', '/p/a.pdf?x=1']) AS path FROM pages),
rule AS (SELECT page_id, grp, line, kind, value AS rule, '^' || regexp_replace(replace(regexp_replace(value, '([.+?^${{}}()|\\[\\]\\\\])', '\\\\\\1', 'g'), '*', '.*'), '\\\\\\$$', '$') AS pattern FROM rules WHERE kind <> 'agent' AND value <> ''),
hit AS (SELECT c.page_id, c.token, a.path, r.* EXCLUDE (page_id, grp) FROM chosen c JOIN rule r USING (page_id, grp) JOIN asked a USING (page_id) WHERE regexp_matches(a.path, r.pattern)),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, token, path ORDER BY length(rule) DESC, kind = 'allow' DESC, CASE WHEN kind = 'allow' THEN -line ELSE line END) AS k FROM hit) t WHERE k = 1)"""
_PATHS = ["/", "/private/open", "/private/x", "/p/a.pdf?x=1"]


def robots_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where("page_id IS NOT NULL").selectExpr("page_id", f"{ROBOTS} AS content")


def _robots_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = robots.rules(robots_files(spark, sf_dir), "page_id")
    asked = table(spark, sf_dir, "pages").where("page_id IS NOT NULL").select("page_id", F.explode(F.array(*map(F.lit, _PATHS))).alias("path"))
    return robots.verdicts(parsed, robots.selected(parsed, robots.crawlers(spark), "page_id"), asked, "page_id")


both("robots_parse", lambda s, d: robots.rules(robots_files(s, d), "page_id").select("page_id", F.col("line").cast("bigint").alias("line"), "grp", "kind", "value"), f"WITH {_ROBOTS_SQL} SELECT page_id, line, CAST(grp AS BIGINT) AS grp, kind, value FROM rules")
both("robots_effective", _robots_effective, f"WITH {_ROBOTS_SQL} SELECT c.page_id, c.token, c.path, coalesce(top.kind = 'allow', true) AS allowed, coalesce(top.rule, '') AS rule FROM (SELECT DISTINCT page_id, token, path FROM chosen JOIN asked USING (page_id)) c LEFT JOIN top USING (page_id, token, path)")

both("robots_matched", lambda s, d: (lambda p: robots.matched_agents(p, robots.selected(p, robots.crawlers(s), "page_id"), "page_id"))(robots.rules(robots_files(s, d), "page_id")),
     f"""WITH {_ROBOTS_SQL}, a AS (SELECT page_id, grp, line, unnest(range(len(string_split(value, ',')))) AS pos, trim(unnest(string_split(value, ','))) AS agent FROM rules WHERE kind = 'agent'),
     f AS (SELECT c.page_id, token, min(line * 1000 + pos) AS k, arg_min(agent, line * 1000 + pos) AS agent FROM chosen c JOIN a USING (page_id, grp) WHERE agent <> '' GROUP BY c.page_id, token, lower(agent))
     SELECT page_id, token, string_agg(agent, ',' ORDER BY k) AS agents FROM f GROUP BY ALL""")  # fmt: skip
both("robots_registry", lambda s, d: robots.registry_audit(robots_files(s, d), "page_id"),
     f"""WITH {_ROBOTS_SQL.replace("crawler AS (SELECT * FROM " + robots.CRAWLERS_SQL + ")", "crawler AS (SELECT * FROM " + robots.CRAWLERS_SQL + " UNION ALL SELECT '*', '', '', true)")}
     SELECT p.page_id, c.token, coalesce(top.kind = 'allow', true) AS allowed, coalesce(top.rule, '') AS rule, array_to_string(list_filter([CASE WHEN NOT robots_applicable THEN 'may ignore robots.txt' END, CASE WHEN robots_applicable IS NULL OR purpose = 'legacy' THEN 'to be verified' END, CASE WHEN purpose = 'control' THEN 'control token' END], lambda x: x IS NOT NULL), '; ') AS warnings
     FROM (SELECT page_id FROM pages) p CROSS JOIN crawler c LEFT JOIN top ON top.page_id = p.page_id AND top.token = c.token AND top.path = '/'""")  # fmt: skip

# Link indexes and sitemaps
LLMS = """'# Site ' || source || chr(10) || string_agg(CASE WHEN doc_id % 7 = 0 THEN '## Part ' || CAST(doc_id % 21 AS STRING) || chr(10) WHEN doc_id % 11 = 0 THEN '## Optional' || chr(10) ELSE '' END
  || '- [Page ' || CAST(doc_id AS STRING) || '](' || CASE WHEN doc_id % 13 = 0 THEN 'ftp://x/' WHEN doc_id % 5 = 0 THEN '/admin/' ELSE 'https://example.org/' END || CAST(doc_id % 40 AS STRING) || ')' || CASE WHEN doc_id % 2 = 0 THEN ': text' ELSE '' END, chr(10) ORDER BY doc_id)"""


def llms_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "documents").where("source IS NOT NULL AND doc_id IS NOT NULL").createOrReplaceTempView("corvane_llms")
    return spark.sql("SELECT source, " + LLMS.replace("string_agg(", "listagg(").replace(", chr(10) ORDER BY doc_id)", ", '\n') WITHIN GROUP (ORDER BY doc_id)") + " AS content FROM corvane_llms GROUP BY source")


_ENTRIES_SQL = f"""
file AS (SELECT source, {LLMS} AS content FROM documents WHERE source IS NOT NULL AND doc_id IS NOT NULL GROUP BY source),
line AS (SELECT source, unnest(range(len(string_split(content, chr(10))))) AS line, unnest(string_split(content, chr(10))) AS s FROM file),
sect AS (SELECT *, last_value(CASE WHEN regexp_matches(s, '^##\\s+.+$') THEN trim(regexp_extract(s, '^##\\s+(.+)$', 1)) END IGNORE NULLS) OVER (PARTITION BY source ORDER BY line ROWS UNBOUNDED PRECEDING) AS section FROM line),
entry AS (SELECT source, line, trim(regexp_extract(s, '^\\s*-\\s+\\[([^\\]]+)\\]\\(([^)]+)\\)', 1)) AS title, trim(regexp_extract(s, '^\\s*-\\s+\\[([^\\]]+)\\]\\(([^)]+)\\)', 2)) AS url, coalesce(section, 'Pages') AS section, coalesce(lower(section) = 'optional', false) AS optional
  FROM sect WHERE regexp_matches(s, '^\\s*-\\s+\\[[^\\]]+\\]\\([^)]+\\)'))"""
both("llms_entries", lambda s, d: crawl.llms_entries(llms_files(s, d), "source"), f"WITH {_ENTRIES_SQL} SELECT * FROM entry")
both("llms_warnings", lambda s, d: crawl.llms_warnings(crawl.llms_entries(llms_files(s, d), "source"), "source"),
     f"""WITH {_ENTRIES_SQL} SELECT source, line, url, regexp_matches(url, '(?i)^[a-z][a-z\\d+.-]*:') AND NOT regexp_matches(url, '(?i)^https?:') AS odd_scheme, row_number() OVER (PARTITION BY source, url ORDER BY line) > 1 AS duplicate,
     regexp_matches(CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1) ELSE url END, '/admin\\b|/private\\b|/internal\\b|/\\.|/_') AS private FROM entry""")  # fmt: skip
both("llms_notes", lambda s, d: linkindex.index_audit(llms_files(s, d), "source"),
     rf"""WITH {_ENTRIES_SQL}, f AS (SELECT source, content, list_transform(list_filter(string_split(content, chr(10)), lambda l: l LIKE '## %'), lambda l: lower(trim(substr(l, 4)))) AS h FROM file),
     bare AS (SELECT e.source, count(*) AS n FROM entry e JOIN line l USING (source, line) WHERE NOT contains(l.s, '): ') GROUP BY 1)
     SELECT source, 'error' AS kind, 'no_title' AS rule, 1 AS n FROM f WHERE NOT regexp_matches(content, '(?m)^# \S') UNION ALL SELECT source, 'note', 'no_summary', 1 FROM f WHERE NOT regexp_matches(content, '(?m)^> \S') UNION ALL SELECT source, 'note', 'no_sections', 1 FROM f WHERE len(h) = 0
     UNION ALL SELECT source, 'note', 'no_description', n FROM bare UNION ALL SELECT source, 'note', 'optional_not_last', 1 FROM f WHERE list_position(h, 'optional') BETWEEN 1 AND len(h) - 1""")  # fmt: skip
both("page_fields", lambda s, d: linkindex.prepared(markdown(s, d), "doc_id", fields=["title", "tags"]).select("doc_id", F.length("full").cast("bigint").alias("size"), F.substring("full", 1, 12).alias("begins")), None)
both("page_text", lambda s, d: linkindex.prepared(markdown(s, d), "doc_id"), None)
FULL_SIZE = 20_000


def _full(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages_ = documents(spark, sf_dir).where("source IS NOT NULL AND doc_id IS NOT NULL").selectExpr("source", "doc_id", "'Page [' || CAST(doc_id AS STRING) || ']' AS title", "'https://example.org/' || CAST(doc_id AS STRING) AS url", "text AS full")
    return linkindex.full_pages(pages_, "source", "doc_id")


both("llms_full", _full,
     r"""WITH p AS (SELECT source, doc_id, list_concat(['---', '## [Page \[' || CAST(doc_id AS VARCHAR) || '\]](https://example.org/' || CAST(doc_id AS VARCHAR) || ')'], list_filter(list_transform(string_split_regex(coalesce(text, ''), '
{2,}'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')) AS b FROM documents WHERE source IS NOT NULL AND doc_id IS NOT NULL),
     q AS (SELECT source, doc_id, unnest(range(len(b))) AS i, unnest(b) AS x FROM p), r AS (SELECT *, coalesce(sum(length(x) + 2) OVER (PARTITION BY source ORDER BY doc_id, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM q),
     f AS (SELECT *, min(p) OVER (PARTITION BY source, doc_id) AS begins FROM r)
     SELECT source, doc_id, string_agg(x, chr(10) || chr(10) ORDER BY i) AS text, CAST(any_value(begins) AS BIGINT) AS begins, max(p + length(x) + 2) >= 500000 AS cut FROM f WHERE begins < 500000 AND (i <= 2 OR p < 500000) GROUP BY source, doc_id""".replace("\\\\", "\\"))  # fmt: skip
both("llms_coverage", lambda s, d: linkindex.coverage(markdown(s, d).select("doc_id", "path"), table(s, d, "documents").selectExpr("CASE WHEN doc_id % 3 = 0 THEN 'https://example.org/site/docs/page ' || CAST(doc_id AS STRING) || '/?x=1' WHEN doc_id % 3 = 1 THEN '/other/' || CAST(doc_id * 7 AS STRING) || '/page ' || CAST(doc_id AS STRING) || '-old' ELSE 'https://example.org/site/blog/2024' END AS url")),
     rf"""WITH l AS (SELECT DISTINCT CASE WHEN doc_id % 3 = 0 THEN '/site/docs/page ' || CAST(doc_id AS VARCHAR) || '/' WHEN doc_id % 3 = 1 THEN '/other/' || CAST(doc_id * 7 AS VARCHAR) || '/page ' || CAST(doc_id AS VARCHAR) || '-old' ELSE '/site/blog/2024' END AS p FROM documents),
     f AS (SELECT doc_id, path, regexp_replace(path, '\.[^./]*$', '') AS bare FROM {MARKDOWN_FROM} m), g AS (SELECT *, '/' || regexp_replace(bare, '/index$', '') AS rel, regexp_extract(bare, '([^/]*)$', 1) AS name FROM f)
     SELECT doc_id, path FROM g WHERE NOT EXISTS (SELECT 1 FROM l WHERE contains(l.p, g.name) OR contains(l.p, g.rel))""")  # fmt: skip
both("page_graph", lambda s, d: graph.generated(apply(markdown(s, d), page_data.metadata()), "doc_id", ["article", "faq", "product", "course", "event", "recipe", "howto"], {"publisher": {"name": "Example", "url": "https://example.org/"}, "author": {"name": "Ann"}, "event": {"startDate": "2026-01-01"}}).where("json IS NOT NULL").select("doc_id", F.get_json_object("json", "$.@graph[2].headline").alias("headline"), F.get_json_object("json", "$.@graph[6].name").alias("event"), F.get_json_object("json", "$.@graph[6].organizer.@id").alias("organizer")),
     f"""SELECT doc_id, CASE WHEN t = '' THEN NULL ELSE t END AS headline, CASE WHEN t = '' THEN NULL ELSE t END AS event, 'https://example.org/#organization' AS organizer FROM (SELECT doc_id, title AS t FROM ({check_sql(f"(SELECT * FROM {MARKDOWN_FROM} m WHERE content IS NOT NULL)", page_data.metadata())}) u) v""")
both("llms_packing", lambda s, d: crawl.packed(table(s, d, "documents").where("source IS NOT NULL AND doc_id IS NOT NULL").select("source", "doc_id", F.length("text").alias("n")), "source", "doc_id", "n", 20_000),
     """WITH RECURSIVE p AS (SELECT source, doc_id, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE source IS NOT NULL AND doc_id IS NOT NULL),
     f AS (SELECT source, doc_id, k, n AS used, CAST(0 AS BIGINT) AS file FROM p WHERE k = 1 UNION ALL
       SELECT p.source, p.doc_id, p.k, CASE WHEN f.used + p.n > 20000 THEN p.n ELSE f.used + p.n END, CASE WHEN f.used + p.n > 20000 THEN f.file + 1 ELSE f.file END FROM f JOIN p ON p.source = f.source AND p.k = f.k + 1)
     SELECT source, doc_id, file FROM f""")  # fmt: skip
both("llms_coverage_anti", lambda s, d: crawl.uncovered(markdown(s, d).select("doc_id", F.expr("regexp_replace(path, '[.](md|html)$', '')").alias("path")), markdown(s, d).where("doc_id % 3 <> 0").selectExpr("'https://example.org/' || regexp_replace(path, '[.](md|html)$', '') || '/' AS url")),
     f"""SELECT doc_id, p AS path FROM (SELECT doc_id, regexp_replace(path, '[.](md|html)$', '') AS p FROM {MARKDOWN_FROM} m) a WHERE p NOT IN (SELECT regexp_replace(path, '[.](md|html)$', '') FROM {MARKDOWN_FROM} m WHERE doc_id % 3 <> 0)""")
both("page_url_build", lambda s, d: markdown(s, d).select("doc_id", F.expr(crawl.page_url("path", "https://example.org/", "site")).alias("url")),
     rf"""SELECT doc_id, 'https://example.org/' || replace(CASE WHEN b = '' OR b LIKE '%/' THEN b ELSE b || '/' END, ' ', '%20') AS url FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(path, '^site/', ''), '\.[^./]*$', ''), '(^|/)index$', '\1') AS b FROM {MARKDOWN_FROM} m) t""")
both("sitemap_chunks", lambda s, d: crawl.chunked(table(s, d, "pages").where("page_id IS NOT NULL").select("page_id", "url"), "page_id", 60).groupBy("chunk").agg(F.count("*").alias("urls"), F.min("url").alias("first"), F.max("url").alias("last")),
     "SELECT chunk, count(*) AS urls, min(url) AS first, max(url) AS last FROM (SELECT url, CAST(floor((row_number() OVER (ORDER BY page_id) - 1) / 60) AS BIGINT) AS chunk FROM pages WHERE page_id IS NOT NULL) t GROUP BY chunk")
SITEMAP_INDEX = f"CASE WHEN page_id % 6 = 5 THEN '<sitemapindex><sitemap><loc>https://example.org/s-' || CAST(page_id AS STRING) || '.xml</loc><lastmod>2024-01-0' || CAST(page_id % 9 + 1 AS STRING) || '</lastmod></sitemap><sitemap><loc> not an address </loc></sitemap></sitemapindex>' WHEN page_id % 11 = 7 THEN 'no markup' ELSE replace({SITEMAP}, '/p/', '/p?a=1&amp;b=/') END"


def sitemap_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where("page_id IS NOT NULL").selectExpr("page_id", f"{SITEMAP_INDEX} AS xml")


_PARSED_SQL = rf"""x AS (SELECT page_id, url, {SITEMAP_INDEX} AS xml FROM pages WHERE page_id IS NOT NULL), u AS (
  SELECT page_id, 0 AS ord, 'url' AS kind, replace(url, '/p/', '/p?a=1&b=/') AS loc, CASE WHEN page_id % 3 = 0 THEN '2024-05-01' ELSE 'soon' END AS lastmod, NULL AS issue FROM x WHERE page_id % 6 <> 5 AND page_id % 11 <> 7
  UNION ALL SELECT page_id, 1, 'url', 'ftp://x/' || CAST(page_id AS VARCHAR), NULL, 'scheme' FROM x WHERE page_id % 6 <> 5 AND page_id % 11 <> 7
  UNION ALL SELECT page_id, 0, 'sitemap', 'https://example.org/s-' || CAST(page_id AS VARCHAR) || '.xml', '2024-01-0' || CAST(page_id % 9 + 1 AS VARCHAR), NULL FROM x WHERE page_id % 6 = 5 UNION ALL SELECT page_id, 1, 'sitemap', 'not an address', NULL, 'invalid' FROM x WHERE page_id % 6 = 5)"""
both("sitemap_entries", lambda s, d: crawl.sitemap_entries(sitemap_files(s, d), "page_id"), f"WITH {_PARSED_SQL} SELECT * FROM u")
both("sitemap_verdicts", lambda s, d: crawl.sitemap_verdicts(sitemap_files(s, d), "page_id"),
     f"WITH {_PARSED_SQL} SELECT page_id, count(*) FILTER (kind = 'url' AND issue IS NULL) AS urls, count(*) FILTER (kind = 'sitemap' AND issue IS NULL) AS sitemaps, count(issue) AS skipped, xml = 'no markup' AS no_root, false AS over, false AS valid FROM x LEFT JOIN u USING (page_id) GROUP BY page_id, xml")
both("sitemap_index", lambda s, d: crawl.index_entries(table(s, d, "pages").where("page_id IS NOT NULL").selectExpr("page_id", "CASE WHEN page_id % 5 > 0 THEN '2024-0' || CAST(page_id % 9 + 1 AS STRING) || '-01' END AS lastmod"), "page_id", "https://example.org", 60),
     "SELECT chunk, 'https://example.org/sitemap-' || CAST(chunk + 1 AS VARCHAR) || '.xml' AS loc, max(lastmod) AS lastmod FROM (SELECT CASE WHEN page_id % 5 > 0 THEN '2024-0' || CAST(page_id % 9 + 1 AS VARCHAR) || '-01' END AS lastmod, CAST(floor((row_number() OVER (ORDER BY page_id) - 1) / 60) AS BIGINT) AS chunk FROM pages WHERE page_id IS NOT NULL) t GROUP BY chunk QUALIFY count(*) OVER () > 1")
both("sitemap_files", lambda s, d: crawl.resolved_entries(markdown(s, d).where(f"NOT {crawl.error_page('path')}"), "https://example.org/", "path").select("doc_id", "loc", F.expr(crawl.lastmod("CASE WHEN doc_id % 3 = 0 THEN '2024-05-0' || CAST(doc_id % 9 + 1 AS STRING) WHEN doc_id % 3 = 1 THEN 'soon' END", "CASE WHEN doc_id % 2 = 0 THEN TIMESTAMP '2023-01-02 10:00:00' END")).alias("lastmod")),
     f"SELECT doc_id, 'https://example.org/' || path AS loc, CASE WHEN doc_id % 3 = 0 THEN '2024-05-0' || CAST(doc_id % 9 + 1 AS VARCHAR) WHEN doc_id % 2 = 0 THEN '2023-01-02' END AS lastmod FROM {MARKDOWN_FROM} m WHERE path IS NOT NULL")
both("site_pipeline", lambda s, d: crawl.site_pipeline(table(s, d, "pages").selectExpr("url", "page_id AS ord"), table(s, d, "pages").where("page_id % 7 <> 0").selectExpr("url", "html AS content"), table(s, d, "pages").where("page_id % 5 = 0").select("url")).select("url", "state", F.length("content").cast("bigint").alias("size")),
     """WITH l AS (SELECT url, min(page_id) AS ord FROM pages GROUP BY url), b AS (SELECT DISTINCT url FROM pages WHERE page_id % 5 = 0), o AS (SELECT url, row_number() OVER (ORDER BY ord) AS k FROM l WHERE url NOT IN (SELECT url FROM b)), f AS (SELECT url, min(html) AS content FROM pages WHERE page_id % 7 <> 0 GROUP BY url)
     SELECT url, 'blocked' AS state, NULL AS size FROM b UNION ALL SELECT url, CASE WHEN k > 50 THEN 'skipped' WHEN content IS NULL THEN 'failed' ELSE 'audited' END, CASE WHEN k <= 50 THEN length(content) END FROM o LEFT JOIN f USING (url)""")  # fmt: skip
both("url_cap_distinct", lambda s, d: (lambda p: positions(p, "first").where("position < 40").select("host", "first", "position"))(table(s, d, "pages").groupBy(F.regexp_extract("url", r"^https?://([^/]*)", 1).alias("host")).agg(F.min("page_id").alias("first"))),
     "SELECT host, first, row_number() OVER (ORDER BY first) - 1 AS position FROM (SELECT regexp_extract(url, '^https?://([^/]*)', 1) AS host, min(page_id) AS first FROM pages GROUP BY 1) t QUALIFY row_number() OVER (ORDER BY first) <= 40")
both("page_urls_capped", lambda s, d: crawl.capped_urls(table(s, d, "pages"), "url", "page_id"),
     f"""WITH u AS (SELECT url, min(page_id) AS first FROM pages WHERE url IS NOT NULL AND page_id IS NOT NULL GROUP BY url)
     SELECT url, first, row_number() OVER (ORDER BY first, url) - 1 AS position, greatest((SELECT count(*) FROM u) - {crawl.MAX_URLS}, 0) AS left_out FROM u QUALIFY row_number() OVER (ORDER BY first, url) <= {crawl.MAX_URLS}""")  # fmt: skip

# Structured data
_BLOCKS_SQL = f"block AS (SELECT page_id, unnest(range(len(x))) AS ord, unnest(x) AS json FROM (SELECT page_id, regexp_extract_all(head, {technical.JSON_LD!r}, 1) AS x FROM {PAGES_FROM} p) y)".replace("\\\\", "\\")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", F.posexplode(F.expr(f"regexp_extract_all(head, r'{technical.JSON_LD}', 1)")).alias("ord", "json"))


_NODES_SQL = f"""{_BLOCKS_SQL}, b AS (SELECT page_id, ord, json, CASE WHEN NOT json_valid(json) THEN 'invalid' WHEN json_type(json) = 'OBJECT' THEN 'object' WHEN json_type(json) = 'ARRAY' THEN 'array' WHEN json_type(json) = 'NULL' THEN 'null' ELSE 'primitive' END AS root FROM block),
  r AS (SELECT *, root = 'object' AND coalesce(json_extract_string(CASE WHEN root = 'object' THEN json END, '$."@context"') = 'https://schema.org', false) AS context_ok FROM b),
  o AS (SELECT page_id, ord, CASE WHEN json_type(json, '$."@graph"') = 'ARRAY' THEN json_extract(json, '$."@graph"[*]') ELSE [CAST(json AS JSON)] END AS g FROM r WHERE root = 'object'),
  n AS (SELECT page_id, ord, unnest(range(len(g))) AS node_ord, unnest(g) AS node FROM o),
  t AS (SELECT *, list_filter(list_transform(string_split(coalesce(CASE WHEN json_type(node, '$."@type"') = 'ARRAY' THEN array_to_string(json_extract_string(node, '$."@type"[*]'), ',') ELSE json_extract_string(node, '$."@type"') END, ''), ','), lambda x: trim(x)), lambda x: x <> '') AS types FROM n),
  e AS (SELECT page_id, ord, -1 AS node_ord, '' AS type, CASE WHEN root = 'invalid' THEN 'invalid' ELSE 'root ' || root END AS error FROM r WHERE root <> 'object'
    UNION ALL SELECT page_id, ord, -1, '', 'context' FROM r WHERE root = 'object' AND NOT context_ok UNION ALL SELECT page_id, ord, -1, '', 'no nodes' FROM o WHERE len(g) = 0 UNION ALL SELECT page_id, ord, node_ord, '', 'type' FROM t WHERE len(types) = 0
    UNION ALL SELECT page_id, ord, node_ord, u.type, field FROM (SELECT page_id, ord, node_ord, node, unnest(types) AS type FROM t) u JOIN {technical.required_sql()} ON u.type = required.type WHERE coalesce(json_extract_string(node, '$."' || field || '"'), '') = '')"""
_KNOWN = ", ".join(f"'{t}'" for t in technical.REQUIRED)
both("jsonld_errors", lambda s, d: jsonld.errors(_blocks(s, d), ["page_id", "ord"]), f"WITH {_NODES_SQL} SELECT * FROM e")
both("jsonld_blocks", lambda s, d: jsonld.judged(_blocks(s, d), ["page_id", "ord"]),
     f"""WITH {_NODES_SQL} SELECT r.page_id, r.ord, root, context_ok, (SELECT count(*) FROM t WHERE t.page_id = r.page_id AND t.ord = r.ord) AS nodes, (SELECT count(*) FROM (SELECT page_id, ord, unnest(types) AS y FROM t) u WHERE u.page_id = r.page_id AND u.ord = r.ord AND y NOT IN ({_KNOWN})) AS unknown_types,
     (SELECT count(*) FROM e WHERE e.page_id = r.page_id AND e.ord = r.ord) AS errors, NOT EXISTS (SELECT 1 FROM e WHERE e.page_id = r.page_id AND e.ord = r.ord) AS valid FROM r""")  # fmt: skip


def ld_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr("page_id", f"{LD} AS content")


_FENCED = """SELECT page_id, -1 AS ord, '{"@context":"https://schema.org","@type":"Person","name":"P' || CAST(page_id AS VARCHAR) || '"}' AS json FROM pages WHERE page_id % 3 = 0"""
both("jsonld_files", lambda s, d: jsonld.file_verdicts(jsonld.blocks(ld_pages(s, d), "page_id"), ld_pages(s, d), "page_id"),
     f"""WITH {_NODES_SQL.replace(_BLOCKS_SQL, _BLOCKS_SQL.replace("block AS (", "block AS (" + _FENCED + " UNION ALL ", 1))}
     SELECT page_id, count(r.ord) AS block_count, CAST(coalesce(sum((SELECT count(*) FROM e WHERE e.page_id = r.page_id AND e.ord = r.ord)), 0) AS BIGINT) AS errors, count(r.ord) > 0 AND coalesce(sum((SELECT count(*) FROM e WHERE e.page_id = r.page_id AND e.ord = r.ord)), 0) = 0 AS valid
     FROM (SELECT DISTINCT page_id FROM pages) p LEFT JOIN r USING (page_id) GROUP BY page_id""")  # fmt: skip
both("resolved_links", lambda s, d: pages(s, d).select("page_id", F.posexplode(F.expr(f"regexp_extract_all(html, r'{technical.LINK_TAG}', 1)")).alias("ord", "href"), "url").select("page_id", F.col("ord").cast("bigint").alias("ord"), "href", F.expr(technical.resolved("href", "url")).alias("resolved")),
     rf"""SELECT page_id, ord, href, CASE WHEN regexp_matches(href, '(?i)^[a-z][a-z\\d+.-]*:|^#') THEN href WHEN href LIKE '//%' THEN regexp_extract(url, '^(https?:)', 1) || href WHEN href LIKE '/%' THEN regexp_extract(url, '^(https?://[^/?#]*)', 1) || href
     ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '([^/])/[^/]*$', '\1/') || href END AS resolved
     FROM (SELECT page_id, url, unnest(h) AS href, unnest(range(len(h))) AS ord FROM (SELECT page_id, url, regexp_extract_all(html, {technical.LINK_TAG!r}, 1) AS h FROM pages) t) u""".replace("\\\\", "\\"))  # fmt: skip


# Evidence, generated files, parsers
_REFS = "CASE WHEN doc_id % 3 = 0 THEN 'geo-kdd-2024' WHEN doc_id % 3 = 1 THEN 'nowhere' ELSE 'google-hreflang-2025' END"
both("source_refs_anti", lambda s, d: evidence.missing_refs(documents(s, d).select("doc_id", F.array(F.expr(_REFS), F.lit("google-ai-guide-2025")).alias("source_refs")), "doc_id"),
     f"SELECT doc_id, ref FROM (SELECT DISTINCT doc_id, unnest([{_REFS}, 'google-ai-guide-2025']) AS ref FROM documents) t WHERE ref NOT IN (SELECT id FROM {evidence.EVIDENCE_SQL})")
both("stale_evidence", lambda s, d: evidence.stale(s, "2027-01-15"), f"SELECT id, date_diff('day', verified, DATE '2027-01-15') AS age FROM {evidence.EVIDENCE_SQL} WHERE date_diff('day', verified, DATE '2027-01-15') > 180")
_XML = crawl.xml_escaped("url")
both("sitemap_render", lambda s, d: files.sitemap_file(table(s, d, "pages").where("page_id IS NOT NULL").selectExpr("page_id", "CAST(page_id % 3 AS BIGINT) AS part", "url || '?a=1&b=<x>' AS loc", "'2024-05-01' AS lastmod", "'weekly' AS changefreq", "0.5e0 AS priority"), "part", "page_id"),
     f"""SELECT CAST(page_id % 3 AS BIGINT) AS part, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' || chr(10) || string_agg('  <url><loc>' || {crawl.xml_escaped("(url || '?a=1&b=<x>')")} ||
     '</loc><lastmod>2024-05-01</lastmod><changefreq>weekly</changefreq><priority>0.5</priority></url>', chr(10) ORDER BY page_id) || chr(10) || '</urlset>' || chr(10) AS xml FROM pages WHERE page_id IS NOT NULL GROUP BY 1""")  # fmt: skip
both("llms_generate", lambda s, d: files.llms_file(documents(s, d).where("source IS NOT NULL AND doc_id IS NOT NULL").selectExpr("doc_id", "source", "'Page [' || CAST(doc_id AS STRING) || ']' AS title", "'https://example.org/' || CAST(doc_id AS STRING) AS url", "CASE WHEN doc_id % 2 = 0 THEN 'text' END AS description", "CASE doc_id % 3 WHEN 0 THEN 'Optional' WHEN 1 THEN 'Blog' ELSE 'Docs' END AS section"), "source", "doc_id"),
     """WITH l AS (SELECT source, CASE doc_id % 3 WHEN 0 THEN 'Optional' WHEN 1 THEN 'Blog' ELSE 'Docs' END AS section, min(doc_id) AS f, string_agg('- [Page \\[' || CAST(doc_id AS VARCHAR) || '\\]](https://example.org/' || CAST(doc_id AS VARCHAR) || ')' || CASE WHEN doc_id % 2 = 0 THEN ': text' ELSE '' END, chr(10) ORDER BY doc_id) AS x
       FROM documents WHERE source IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1, 2)
     SELECT source, '# ' || source || chr(10) || chr(10) || string_agg('## ' || section || chr(10) || chr(10) || x || chr(10), chr(10) ORDER BY CASE WHEN section = 'Optional' THEN 1 ELSE 0 END, f) AS content FROM l GROUP BY source""")  # fmt: skip
# Parsers have no SQL: tests hold them against cases.
both("html_dom", lambda s, d: parsers.dom(pages(s, d), "page_id").select("page_id", "seq", "parent", "depth", "tag", "text"), None)
both("md_tokens", lambda s, d: parsers.tokens(markdown(s, d), "doc_id"), None)
both("frontmatter", lambda s, d: parsers.frontmatter(markdown(s, d), "doc_id"), None)
both("readability", lambda s, d: parsers.readability(documents(s, d), "doc_id"), None)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["score_v2_dims"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
