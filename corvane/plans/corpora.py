"""Derived corpora for queries: text in the formats that the audit reads, made from the tables by one SQL expression
that both engines run. They vary by row, so that every rule has rows on both sides."""

from __future__ import annotations

_ID = "CAST(doc_id AS STRING)"
_NL = "chr(10)"


def _when(cond: str, text: str) -> str:
    return f"CASE WHEN {cond} THEN {text} ELSE '' END"


def _lines(*x: str) -> str:
    return " || ".join(f"'{t}' || chr(10)" if t is not None else _NL for t in x)


_N = None
_ESCAPED = "replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


def _markup(cond: str, *lines: str) -> str:
    return _when(cond, " || ".join(f"'{x}' || {_NL}" for x in lines))


#: A page of markup of a document: head, landmarks or none, headings, paragraphs, lists, tables, quotations, links and its whole text.
HTML = " || ".join(
    [
        f"'<!DOCTYPE html><html lang=\"en\"><head><title>Page ' || {_ID} || '</title><style>h1 {{ margin: 0 }}</style></head><body>' || {_NL}",
        _markup("doc_id % 8 = 0", "<header>The site</header>", '<nav><a href="/">Home</a> <a href="#top">Top</a></nav>', "<main>"),
        _when("doc_id % 7 <> 3", f"'<h1>Page ' || {_ID} || '</h1>' || {_NL}"),
        _markup("doc_id % 5 = 1", '<div id="root">Loaded by script</div>', "<script>var html = 1; createApp(html)</script>"),
        _markup("doc_id % 3 = 0", "<p>A page is a unit of content that a site shows under one address, and this one here represents a longer answer of some fifty words, with a definition at its start, so that what follows can be read alone by people who come from a search and know nothing of the subject at all.</p>"),
        f"'<p>' || {_ESCAPED} || '</p>' || {_NL}",
        _markup("doc_id % 16 <> 4", "<h2>Findings</h2>"),
        _markup("doc_id % 3 = 0", "<p>Revenue grew 45% in 2023 according to Acme Institute and again 45% later.<br>One in five agree; version 22 on port 8080 served 1,200 users for $3.5M.</p>"),
        _markup("doc_id % 3 = 1", "<p>We counted 120 cases and <b>37.5%</b> losses with 120 repeats, 64 of them twice.</p>"),
        _markup("doc_id % 12 = 4", "<blockquote>The results were better than expected this year</blockquote>", "<p>&quot;This is a fairly long quotation&quot; said Sarah Chen today.</p>"),
        _markup("doc_id % 16 = 8", "<h4>Deep detail</h4>", "<p>Few words.</p>"),
        _markup("doc_id % 9 = 2", "<h2>Findings</h2>", "<p>Again the same heading with a handful of words below it for good measure today.</p>"),
        _markup("doc_id % 6 = 0", "<p>The API (Application Programming Interface) and the SLA and NASA data matter.</p>"),
        f"repeat('<p>See <a href=\"https://example.org/a\">a source</a> for it.</p>' || {_NL}, CAST(doc_id % 5 AS INT))",
        _markup("doc_id % 6 = 4", '<p>Also <a href="/docs/page">inside</a>, <a href="mailto:a@example.org">mail</a> and <a href="javascript:void(0)">more</a>.</p>'),
        _markup("doc_id % 11 = 0", "<table>", "<tr><td>a</td><td>b</td></tr>", "</table>"),
        _markup("doc_id % 11 = 1", "<ul>", "<li>first item</li>", "<li>second item</li>", "</ul>"),
        _markup("doc_id % 13 = 0", "<p>Add to cart for $20.00 and read customer reviews by verified buyer accounts.</p>"),
        _markup("doc_id % 10 <> 4", "<p>Published: 2024-05-01</p>"),
        _markup("doc_id % 3 = 2", "<p>Last updated: June 15, 2026</p>"),
        _markup("doc_id % 5 = 3", "<h2>Sources</h2>", "<p>None yet.</p>"),
        _markup("doc_id % 3 = 0", "<h2>References</h2>", "<ul>", '<li><a href="https://example.com/p">Paper</a></li>', "</ul>"),
        _markup("doc_id % 8 = 0", "</main>", "<footer>End</footer>"),
        "'</body></html>'",
    ]
)
#: A Markdown page of a document: frontmatter, headings, lists, links, statistics, quotations and dates, and its whole text.
MARKDOWN = " || ".join(
    [
        _when("doc_id % 5 = 0", f"'---' || {_NL} || 'title: Page ' || {_ID} || {_NL} || '---' || {_NL}"),
        _when("doc_id % 7 <> 3", f"'# Page ' || {_ID} || {_NL} || {_NL}"),
        _when("doc_id % 4 = 1", f"'A page is a unit of content. ' || replace(coalesce(text, ''), {_NL}, ' ') || {_NL} || {_NL}"),
        _when("doc_id % 4 <> 1", f"coalesce(text, '') || {_NL} || {_NL}"),
        _when("doc_id % 2 = 0", _lines("## Findings", _N)),
        _when("doc_id % 3 = 0", _lines("Revenue grew 45% in 2023 according to Acme Institute and again 45% later. One in five agree; version 22 on port 8080 served 1,200 users for $3.5M.", _N)),
        _when("doc_id % 3 = 1", _lines("We counted 120 cases and 37.5% losses with 120 repeats, 64 of them twice.", _N)),
        _when("doc_id % 4 = 0", _lines("> The results were better than expected this year", "> and they will stay so", "— Sarah Chen, Research Lead", _N)),
        _when("doc_id % 4 = 2", _lines('He noted "this is a fairly long inline quotation" in passing.', _N)),
        _when("doc_id % 8 = 1", _lines("#### Deep detail", _N, "Few words.", _N)),
        _when("doc_id % 9 = 2", _lines("## Findings", _N, "Again the same heading with a handful of words below it for good measure today.", _N)),
        _when("doc_id % 6 = 0", _lines("The API (Application Programming Interface) and the SLA and NASA data matter.", _N)),
        "repeat('See [a source](https://example.org/a) for it. ', CAST(doc_id % 6 AS INT)) || " + _NL,
        _when("doc_id % 6 = 4", _lines("Also [inside](/docs/page) and ![pic](img.png).", _N)),
        _when("doc_id % 10 = 7", _lines("```python", "x = 42  # [no](https://example.org/code)", "```", _N)),
        _when("doc_id % 11 = 0", _lines("| a | b |", "|---|---|", "| 1 | 2 |", _N)),
        _when("doc_id % 11 = 1", _lines("- first item", "- second item", _N)),
        _when("doc_id % 13 = 0", _lines("Privacy policy and terms of service: the data protection officer sets the retention period.", _N)),
        _when("doc_id % 13 = 1", _lines("Add to cart for $20.00 and read customer reviews by verified buyer accounts.", _N)),
        _when("doc_id % 13 = 2", _lines("The endpoint has a base url and a rate limit; authentication: token.", _N)),
        _when("doc_id % 13 = 3", _lines("Changelog and license: npm install tool, then the quickstart.", _N)),
        _when("doc_id % 13 = 4", _lines("Pricing: start free, trusted by many, monthly billing, certified.", _N)),
        _when("doc_id % 13 = 5", _lines("Our agency does consulting; contact us about our work and strategy.", _N)),
        _when("doc_id % 2 = 1", _lines("Published: 2024-05-01")),
        _when("doc_id % 3 = 2", _lines("**Last updated:** June 15, 2026")),
        _when("doc_id % 3 = 0", _lines("## References", _N, "- [Paper](https://example.com/p)")),
        _when("doc_id % 5 = 3", _lines("## Sources", _N, "None yet.")),
    ]
)
PATH = f"'site/' || CASE WHEN doc_id % 3 = 0 THEN 'docs/' WHEN doc_id % 3 = 1 THEN 'blog/2024/' ELSE '' END || CASE WHEN doc_id % 10 = 0 THEN 'index' ELSE 'page ' || {_ID} END || CASE WHEN doc_id % 4 = 0 THEN '.html' ELSE '.md' END"
#: A page of a document: markup where its path says so, else Markdown; nulls here and there.
PAGE = f"CASE WHEN doc_id % 97 = 50 THEN NULL WHEN doc_id % 4 = 0 THEN {HTML} ELSE {MARKDOWN} END"
MARKDOWN_FROM = f"(SELECT doc_id, {PATH} AS path, {PAGE} AS content FROM documents)"

_PID = "CAST(page_id AS STRING)"
#: A page with head elements that pages lack: canonical, meta robots, alternates, JSON-LD.
PAGE_HEAD = " || ".join(
    [
        "'<title>' || CASE WHEN page_id % 5 = 4 THEN '' ELSE 'Page ' || " + _PID + " END || '</title>'",
        _when("page_id % 7 = 0", "'<title>Second</title>'"),
        _when("page_id % 3 <> 0", f"'<link rel=\"canonical\" href=\"' || CASE WHEN page_id % 4 = 0 THEN '/p/' ELSE 'https://example.org/p/' END || {_PID} || '\">'"),
        _when("page_id % 11 = 0", "'<link rel=\"canonical\" href=\"https://example.org/other\">'"),
        _when("page_id % 4 = 1", "'<meta name=\"robots\" content=\"index, NoIndex, max-snippet:20, foo\">'"),
        _when("page_id % 4 = 2", "'<meta name=\"googlebot\" content=\"none\">'"),
        _when("page_id % 3 = 1", f"'<link rel=\"alternate\" hreflang=\"de\" href=\"https://example.org/de/' || {_PID} || '\"><link rel=\"alternate\" hreflang=\"' || CASE WHEN page_id % 2 = 0 THEN 'de' ELSE 'x-default' END || '\" href=\"/rel\">'"),
        _when("page_id % 6 = 5", "'<link rel=\"alternate\" hreflang=\"english!\" href=\"https://example.org/en\">'"),
        _when("page_id % 2 = 0", f"'<script type=\"application/ld+json\">{{\"@context\":\"https://schema.org\",\"@type\":\"' || CASE page_id % 3 WHEN 0 THEN 'Article' WHEN 1 THEN 'Event' ELSE 'Gizmo' END || '\",\"headline\":\"Page ' || {_PID} || '\"}}</script>'"),
        _when("page_id % 5 = 2", """'<script type="application/ld+json">{"@context":"https://schema.org","@graph":[{"@type":"Event","name":"Fair"},{"@type":"Article, NewsArticle","headline":"News"},{"name":"untyped"}' || CASE WHEN page_id % 2 = 0 THEN ',{"@type":["Person","Course"],"name":"","description":"d"}' ELSE '' END || ']}</script>'"""),
        _when("page_id % 8 = 3", """'<script type="application/ld+json">' || CASE page_id % 3 WHEN 0 THEN '[1]' WHEN 1 THEN 'null' ELSE '{"@context":"http://schema.org","@graph":[]}' END || '</script>'"""),
        _when("page_id % 9 = 1", "'<script type=\"application/ld+json\">{broken</script>'"),
    ]
)
PAGES_FROM = f"(SELECT page_id, url, html, {PAGE_HEAD} AS head FROM pages WHERE page_id IS NOT NULL)"

#: A text with JSON in fences and the page's scripts.
LD = f"""CASE WHEN page_id % 3 = 0 THEN '```json' || chr(10) || '{{"@context":"https://schema.org","@type":"Person","name":"P' || {_PID} || '"}}' || chr(10) || '{{"plain": "}}"}}' || chr(10) || '```' || chr(10) ELSE '' END || CASE WHEN page_id % 4 = 0 THEN '```JSON-LD' || chr(10) || 'text {{"@context":"x"}}' || chr(10) || '```' || chr(10) ELSE '' END || {PAGE_HEAD}"""
#: robots.txt of a page's host: several groups, comments, comma agents, wildcards.
ROBOTS = " || ".join(
    [
        "'# policy' || chr(10) || 'User-agent: *' || chr(10) || 'Disallow: /private' || chr(10) || 'Allow: /private/open$' || chr(10)",
        _when("page_id % 2 = 0", "'# note' || chr(10) || 'Disallow: /*.pdf' || chr(10)"),
        "chr(10) || 'Disallow: /orphan' || chr(10)",
        _when("page_id % 3 = 0", "'User-agent: GPTBot, CCBot' || chr(10) || 'Disallow: /' || chr(10) || 'Allow: /p' || chr(10)"),
        _when("page_id % 5 = 0", "chr(10) || 'user-agent: gptbot' || chr(10) || 'allow: /' || chr(10)"),
        _when("page_id % 7 = 1", "'User-agent: Claude' || chr(10) || 'User-agent: ,' || chr(10) || 'Disallow:' || chr(10) || 'Disallow: /x' || chr(10)"),
    ]
)
ROBOTS_FROM = f"(SELECT page_id, {ROBOTS} AS content FROM pages WHERE page_id IS NOT NULL)"
