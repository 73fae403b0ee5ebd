"""Behaviour by hand-made cases."""

import json

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions.layers import apply
from corvane.functions.order import positions
from corvane.operators import audit, crawl, evidence, jsonld, robots, site, technical
from corvane.sources import files, markdown, parsers
from corvane.streaming import landing


def scored(spark, *contents, path="a.md", keep=None):
    df = spark.createDataFrame([(i, path, c) for i, c in enumerate(contents)], "doc_id bigint, path string, content string")
    return [r.asDict() for r in audit.audited(df, keep=keep).orderBy("doc_id").collect()]


def test_attribution_follows_occurrences(spark):
    far = "x " * 150
    out = scored(
        spark, f"It rose 45% according to Acme. {far} And 45% again.", f"In 2023 {far} 1999 came.", "Use v22 on port 8080 with id: 77.", f"port 8080 is open {far} 8080 requests came, source: us", 'Quote "this is a long quotation here" said Sarah Chen today.',
        "> A quoted line\n> and more\n\n— Sarah Chen, Lead", f'"same quotation twice in text" said Ann Lee. {far} "same quotation twice in text"', "50 of them and 50% of it via mail", "",
        keep=["stat_total", "stat_sourced", "quote_total", "quote_found", "quote_attributed"],
    )
    assert [(r["stat_total"], r["stat_sourced"]) for r in out[:4]] == [(2, 1), (0, 0), (0, 0), (1, 0)]  # the 1st kept is judged at the 1st place
    assert [(r["quote_total"], r["quote_attributed"]) for r in out[4:7]] == [(1, 1), (2, 2), (2, 1)]
    assert (out[7]["stat_total"], out[7]["stat_sourced"]) == (2, 2) and out[8]["stat_total"] == 0


def test_headings_sections_and_levels(spark):
    out = scored(spark, "# A\n\n## B\n\n### C\n\ntext", "## A\n\n#### B", "# A\n\n## B\n\n## b\n", "no headings at all here", "```\n# not one\n```\n# Real\n", keep=["heading_status", "heading_count", "heading_skips", "heading_repeats", "section_status"])
    assert [r["heading_status"] for r in out] == ["pass", "fail", "warn", "fail", "pass"] and [r["heading_count"] for r in out] == [3, 2, 3, 0, 1] and out[2]["heading_repeats"] == 1


def test_scores_keep_their_bounds_and_order(spark):
    good = "# What is a widget\n\n" + "A widget is a small tool that helps people " + "do good work each day " * 8 + ".\n\n## Facts\n\n" + "According to Acme Institute 45% of 1,200 users and $3M more were seen, 37% too. " * 3 + '\n\n> We like it\n\n— Sarah Chen, Lead\n\n"A quotation of some length here" said Ann Lee.\n\n## Sources\n\n' + "- [a](https://a.org/1)\n" * 5 + "\nPublished: 2024-01-01\nLast updated: 2024-02-02\n"
    bad = "it this they them those " * 40
    a, b = scored(spark, good, bad)
    assert a["v2_score"] > b["v2_score"] and a["v1_total"] > b["v1_total"]
    for r in (a, b):
        assert all(0 <= r[f"v2_{k}"] <= 20 and 0 <= r[f"v1_{k}"] <= 20 for k in ("structure", "statistics", "quotations", "citations", "clarity")) and 0 <= r["v2_score"] <= 100
    assert a["sources_section"] and not b["sources_section"] and a["profile"] == "editorial"


PAGE = """<!DOCTYPE html><html><head><title>T</title><h1>not seen</h1></head><body><nav><a href="/">Home</a> <a href="#x">x</a> <a href="mailto:a@b.c">m</a></nav>
<h1>What is <b>X</b></h1><div><p>Not beside the heading</p></div><p>X is a &amp; b &lt;tag&gt;,
said with words.</p>
<h2>Part</h2><p>See <a href="https://a.org/1">one</a>, <a href="http://a.org/2">two</a>, <a href="https://a.org/3">three</a>, <a href="javascript:x()">no</a>. """ + "And so on and on with more words. " * 4 + """</p>
<blockquote>A quotation of some length</blockquote><table><tr><td>1</td></tr></table><ul><li>item</li></ul>
<h2>References</h2><div><a href="https://a.org/4">four</a></div><h4>Skipped</h4><script>document.write("<h2>no</h2>")</script></body></html>"""


def test_markup_is_judged_by_its_tree(spark):
    o = audit.document(PAGE, "p.html")
    # A heading in the head opens the body, as a browser has it.
    assert (o["heading_count"], o["heading_skips"], o["heading_status"], o["starts_late"]) == (5, 1, "fail", False)
    assert o["intro"] == "X is a & b <tag>, said with words." and o["intro_defines"] and o["answer_status"] == "warn"
    assert (o["external"], o["internal"], o["link_count"], o["sources_section"], o["link_status"]) == (4, 1, 4, True, "pass")
    assert (o["section_count"], o["section_headers"][1:]) == (6, ["not seen", "What is X", "Part", "References", "Skipped"])
    assert (o["v1_tables"], o["v1_lists"], o["v1_headers"], o["semantic_count"], o["semantic_status"], o["v1_dynamic"]) == (4, 3, 3, 1, "warn", False)
    assert audit.document(PAGE.replace("References", "Other"), "p.html")["sources_section"] is False
    assert audit.document("<h2>Sources</h2><p>none</p><h2>Next</h2><p><a href='https://x.y'>z</a></p>", "p.html")["sources_section"] is False
    bare = audit.document("<div>Home | About us and more</div><div>This line is long enough to be the opening of the page</div>", "p.html")
    assert bare["intro"].startswith("This line") and bare["heading_status"] == "fail" and bare["section_status"] == "pass"
    assert audit.document("<h1>T</h1><section><p>only p</p></section>", "x.html")["intro"] == "only p"
    assert audit.document("<div id=root></div><script>ReactDOM.render(x)</script>")["v1_dynamic"] and not audit.document("# plain")["is_html"]
    assert [audit.link_kind(x) for x in ("HTTPS://a", "/b", "c.html", "#d", "", "tel:1", "vbscript:x", " https://e ")] == ["external", "internal", "internal", "", "", "", "", "external"]


def test_trees_go_when_they_are_read():
    import gc
    import weakref

    from corvane.operators import linkindex

    gc.disable()
    try:
        tree = parsers.Tree(PAGE)
        seen = weakref.ref(tree)
        assert tree.visible() and linkindex._page(tree)
        del tree
        assert seen() is None  # with functions that hold it, it would wait for a full collection
    finally:
        gc.enable()


def test_workers_read_batches_in_slices():
    import pyarrow as pa

    from corvane.sources.tables import slices

    texts = ["a" * 10, None, "b" * 90, "c" * 300, "", *["d"] * 7]
    parts = [p.column(0).to_pylist() for p in slices(pa.record_batch({"t": texts}), 0, 5, 100)]
    assert [len(p) for p in parts] == [3, 1, 5, 3] and sum(parts, []) == texts and not list(slices(pa.record_batch({"t": pa.array([], "string")}), 0))


def test_only_kept_figures_are_made(monkeypatch):
    every = audit.document(PAGE, "p.html")
    monkeypatch.setattr(audit, "Tree", None)
    assert audit.document(PAGE, "p.html", keep=["status", "profile", "is_html"]) == {k: every[k] for k in ("status", "profile", "is_html")}
    monkeypatch.undo()
    assert all(audit.document(PAGE, "p.html", keep=[k]) == {k: v} for k, v in every.items())


def test_fast_patterns_equal_the_portable_ones():
    import random
    import re

    import pyarrow as pa

    from corvane.operators import scalar, signals

    bits = ["12", "1,234", "$5.5M", "%", "v", " ", "x", "\n", "3.5", "é", "\u212a", "\u0130", "one", "In", "ten", "out of", "third", "s", "-", "\u2014", "half", "data from", "study", " published", " in", "via", "\x0b", "(2020)", "[1, 2]", "port:", "(", ")", "NASA", "_", "Date: 2024-01-02", "last updated May 3, 2024", "contact us", "Quickstart", "estrategia"]
    drawn = random.Random(7)
    for _ in range(2000):
        t = "".join(drawn.choices(bits, k=drawn.randrange(1, 30)))
        for fast, slow in ((audit._STAT, T.STATISTIC), (audit._STAT_V1, T.STATISTIC_V1), (audit._PUBLISHED, T.PUBLISHED), (audit._REVIEWED, T.REVIEWED), (audit._ACRONYM, r"\b[A-Z]{2,}\b")):
            assert [m.span() for m in fast.finditer(t)] == [m.span() for m in audit._rx(slow).finditer(t)], t
        raw = t.encode().lower()
        assert audit.spelt(raw, raw.translate(T.BLANKS).split()) == sum(len(audit._rx(p).findall(t)) for p in T.VERBAL), t
        assert audit._identifies(t) == bool(re.search(audit._rx(signals.IDENTIFIER).pattern.replace("$", r"\Z"), t, re.A)), t
        assert list(audit._before_parentheses(t)) == re.findall(r"\b([0-9A-Za-z]+)[\s*_~]*\([^)]", t, re.A), t
        assert audit.detected(t, "a.md", audit.possible(pa.array([t]))[0]) == audit.detected(t, "a.md"), t
        near = [bool(audit._rx(signals.SOURCE).search(t[max(0, m.start() - 50) : m.start() + 200])) for m in audit._STAT.finditer(t)]
        total, sourced = audit.statistics(t)
        assert total or not sourced
        assert total < len(near) or sourced == sum(near), t
    assert {p for p in scalar.PROFILE_SIGNALS if p in audit.possible(pa.array(["GET  IN\x0bTOUCH", None]))[0]} == {"service"} and audit.possible(pa.array([None], "string")) == [frozenset()]


def test_markdown_is_judged_by_its_blocks():
    o = audit.document("Title\n=====\n\nA [x](https://a.org) and `[no](https://b.org)` but ![pic](https://c.org/i.png) and [in](/d).\n\nSub\n---\n\n- [e](https://e.org)\n\n> # Deep\n> quoted\n\nhttps://f.org and <https://g.org> and [ref].\n\n[ref]: https://h.org\n")
    assert (o["external"], o["internal"], o["heading_count"], o["quote_count"], o["v1_lists"]) == (6, 1, 3, 1, 3)
    assert (o["heading_skips"], o["heading_status"]) == (0, "pass")
    assert audit.document("# A\n\n    # code\n\n~~~\n# more\n~~~\n## B ##\n\n##C\n")["heading_count"] == 2
    assert audit.document("# A\n## a\n## A\n# b")["heading_repeats"] == 1
    assert [b.kind for b in markdown.walk(markdown.parsed("1. one\n2. two\n   more\n\n   para\n\ntext\n* * *\n| a | b |\n|:-|-:|\n| 1 | 2 |\n<div>\nx\n</div>\n"))] == ["list", "item", "paragraph", "item", "paragraph", "paragraph", "paragraph", "rule", "table", "markup"]
    assert markdown.rendered(markdown.parsed("A **b** `c` [d](e)\n\n- f\n- g\n\n| h | i |\n|---|---|\n| j | k |\n")) == "A b c d\nf\ng\nh - i\nj - k"
    assert markdown.headed(markdown.parsed("# T\n\nx\n\n## S\n\np\n\n- l\n\n### U\n")) == [("S", "p\nl"), ("U", "")]
    assert markdown.parsed(">" * 5000 + " x") and markdown.parsed("- " * 3000 + "x")


def test_sections_count_words_by_block():
    thin = lambda t: audit.document(t)["thin_headers"]
    assert thin("# A\n\none two three four five\n\n## References\n\n- [Paper](https://a.org/long/path/of/words)\n") == ["References"]
    assert thin("# A\n\n## B\n\none two three four five\n") == ["A"]
    assert thin("# A b c d e f g h i j\n") == [] and thin("one two three four five") == [] and thin("one two three four") == ["(document start)"]
    assert thin("# A\n\n| one | two | three | four | five |\n|---|---|---|---|---|\n") == ["A"]


def test_names_of_entities_are_no_words_of_a_section():
    page = "<html><body><h1>T</h1><p>one two three four five &quot;six&quot; seven eight %s</p></body></html>"
    assert audit.document(page % "", "p.html")["thin_headers"] == ["(document start)", "T"]
    assert audit.document(page % "nine &amp; ten", "p.html")["thin_headers"] == ["(document start)"]


def test_settings_and_odd_rows(spark):
    s = audit.Settings(profile="documentation", acronyms={"API": "Application Programming Interface", "SLA": "Service Level Agreement"}, limit_v1=0.5, limit_v2=0.5)
    text = "The API is here. " + "x " * 80 + "An SLA, a service level agreement, and NASA. It it it it."
    o = audit.document(text, "a.md", s)
    assert (o["profile"], o["confidence"], o["overridden"], o["unexplained"], o["pronoun_points"]) == ("documentation", 1.0, True, ["API ('Application Programming Interface')", "NASA"], 0)
    assert not audit.document(text, "a.md", audit.Settings(profile="nonsense"))["overridden"]
    rows = [(1, None, None, "x"), (2, None, "", "x"), (None, "a.md", "# A", "x"), (2, None, "", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, path string, content string, levels string")
    got = audit.audited(df).collect()
    by = {(r.doc_id, r.status): r for r in got}
    assert len(got) == 4 and by[1, "error"].v2_score is None and by[1, "error"].v1_total is None and by[2, "success"].heading_status == "fail" and by[None, "success"].heading_count == 1
    assert site.summary(audit.audited(df)).first().failed == 1 and audit.audited(df.limit(0)).count() == 0
    assert audit.audited(df, ["doc_id", "levels"], keep=["v2_score"]).columns == ["doc_id", "levels", "v2_score"]
    with pytest.raises(ValueError):
        audit.audited(df.withColumn("band", F.lit(1)), ["band"])


def test_attribution_is_linear():
    import time

    def took(n):
        text = " ".join(f"It rose 45% and {i % 7 + 10}% again, \"a quotation of this length\" he said." for i in range(n))
        began = time.process_time()
        o = audit.document(text)
        assert o["stat_total"] == 2 * n and o["quote_total"] == n
        return time.process_time() - began

    took(100)
    small, large = min(took(500) for _ in range(3)), min(took(2000) for _ in range(2))
    assert large < 6 * small, (small, large)


def test_site_summary_and_diff(spark):
    df = spark.createDataFrame([(1, 80), (2, 50), (3, 49), (4, None)], "doc_id bigint, v2_score bigint")
    r = site.summary(df).first()
    assert (r.total, r.succeeded, r.failed, r.excellent, r.good, r.needs_work, r.median, r.average, r.deviation) == (4, 3, 1, 1, 1, 1, 50.0, 59.67, 14.38)
    assert [x.doc_id for x in site.worst(df, 2).collect()] == [3, 2] and [x.doc_id for x in site.worst(df, 9).collect()] == [3, 2, 1]
    before, after = (spark.createDataFrame(x, "doc_id bigint, rule_id string, severity string") for x in ([(1, "a", "warn"), (1, "b", "fail"), (1, "c", "pass")], [(1, "b", "warn"), (1, "c", "warn")]))
    assert {(x.rule_id, x.change) for x in site.diff(before, after).collect()} == {("a", "improved"), ("b", "unchanged"), ("c", "regressed")}


def passes(spark, name):
    from corvane.plans import catalog

    return catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")


def test_messages_come_from_one_pass(spark):
    df = spark.createDataFrame([(1, "success", 5), (2, "error", None)], "doc_id bigint, status string, v2_score bigint")
    said = [r.message for r in site.message(df, among=["true", "status = 'error'", "status = 'none'"]).collect()]
    assert said == [None, "No document could be scored", "No documents found"] and site.message(df.limit(0)).first().message == "No documents found"
    assert passes(spark, "report_message") == 1


def test_both_sides_of_an_edit_come_from_one_pass(spark):
    found = spark.createDataFrame([(i, r, s, side) for i in (1, None) for r, s, side in [("a", "warn", "before"), ("b", "fail", "before"), ("b", "warn", "after"), ("b", "warn", "after"), ("c", "pass", "before"), ("c", "warn", "after")]], "doc_id bigint, rule_id string, severity string, side string")
    got = sorted((str(x.doc_id), x.rule_id, x.change) for x in site.changes(found).collect())
    assert got == [("1", "a", "improved"), ("1", "b", "unchanged"), ("1", "c", "regressed"), ("None", "a", "improved"), ("None", "b", "improved"), ("None", "b", "regressed"), ("None", "c", "regressed")]
    rows = [(1, side, *[n] * 12) for side, n in (("before", 1), ("before", 2), ("after", 5))] + [(None, "before", *[1] * 12), (None, "after", *[1] * 12), (2, "after", *[1] * 12), (3, "before", *[None] * 12), (3, "after", *[None] * 12)]
    out = site.deltas(spark.createDataFrame(rows, "doc_id bigint, side string, " + ", ".join(f"{x} bigint" for x in site.COMPARED))).where("dimension = 'v1_total'")
    assert sorted(tuple(map(str, x)) for x in out.collect()) == [("1", "v1_total", "1", "5", "4"), ("1", "v1_total", "2", "5", "3"), ("3", "v1_total", "None", "None", "None")]
    assert passes(spark, "findings_diff") == passes(spark, "score_deltas") == 1


def test_repeated_rows_are_read_once(spark):
    twice = spark.createDataFrame([(1, "a.md", "# A"), (2, "a.md", "# A"), (3, "b.html", "# A"), (4, None, None), (5, None, None), (6, "a.md", "# A")], "doc_id bigint, path string, content string").coalesce(1)
    assert [(r.doc_id, r.status, r.heading_count) for r in audit.audited(twice, ["doc_id"], keep=["status", "heading_count"]).orderBy("doc_id").collect()] == [(1, "success", 1), (2, "success", 1), (3, "success", 0), (4, "error", None), (5, "error", None), (6, "success", 1)]


def test_robots_groups_and_verdicts(spark):
    text = "Disallow: /orphan\nUser-agent: *\nDisallow: /a\n# note\nAllow: /a/b\n\nDisallow: /lost\nUser-agent: gptbot, CCBot\nUser-agent: GPT\nDisallow: /*.pdf$\nDisallow:\nAllow: /x\nDisallow: /x\n\nUser-agent: GPTBot\nDisallow: /y?q=1\n"
    parsed = robots.rules(spark.createDataFrame([(1, text)], "id bigint, content string"), "id")
    chosen = robots.selected(parsed, robots.crawlers(spark), "id")
    paths = spark.createDataFrame([(1, p) for p in ("/a", "/a/b", "/orphan", "/lost", "/f.pdf", "/f.pdfx", "/x", "/y?q=12", "/y")], "id bigint, path string")
    got = {(r.token, r.path): r.allowed for r in robots.verdicts(parsed, chosen, paths, "id").collect()}
    assert [got["Amazonbot", p] for p in ("/a", "/a/b", "/orphan", "/lost")] == [False, True, True, True]
    assert [got["GPTBot", p] for p in ("/a", "/f.pdf", "/f.pdfx", "/x", "/y?q=12", "/y")] == [True, False, True, True, False, True]
    assert "GPTBot" in robots.generated() and robots.generated("open", sitemap="https://e.org/s.xml").endswith("Sitemap: https://e.org/s.xml\n")


@pytest.mark.parametrize("lines, path, want", [(["blog/"], "site/blog/a.md", "true"), (["*.md", "!keep.md"], "x/keep.md", "false"), (["/a"], "b/a", "false"), (["/a"], "a/b", "true"), (["**/t?.md"], "q/w/t1.md", "true"), (["[ab].md"], "a.md", "false"), (["#x", "", "a*b"], "a/b", "false")])
def test_ignore_rules(spark, lines, path, want):
    assert str(spark.sql(f"SELECT {crawl.ignored(repr(path), lines, lambda t, p: f'{t} RLIKE ' + chr(114) + repr(p).replace(chr(92) * 2, chr(92)))} AS x").first().x).lower() == want


def test_crawl_is_bounded_and_breadth_first(spark):
    fetch = spark.createDataFrame([("r", 0, "s1", True), ("r", 1, "s2", True), ("r", 2, "p0", False), ("s1", 0, "p1", False), ("s1", 1, "r", True), ("s2", 0, "p1", False), ("s2", 1, "p2", False), ("s2", 2, "s3", True), ("s3", 0, "p3", False)], "sitemap string, ord bigint, loc string, is_index boolean")
    found, counts = crawl.crawl(["r"], fetch)
    assert [r["loc"] for r in found.orderBy("depth", "loc").collect()] == ["p0", "p1", "p2", "p3"] and counts == {"fetched": 4, "skipped": 0}
    found, counts = crawl.crawl(["r"], fetch, max_fetches=2)
    assert {r["loc"] for r in found.collect()} == {"p0", "p1"} and counts["fetched"] == 2 and counts["skipped"] == 1
    assert crawl.crawl(["r"], fetch, max_urls=2)[0].count() == 2 and crawl.crawl([], fetch)[0].count() == 0


def test_positions_do_not_need_one_window(spark):
    df = spark.range(1000).selectExpr("id * 7 AS k")
    assert all(r.position * 7 == r.k for r in positions(df, "k", width=64).collect())


def test_page_urls(spark):
    df = spark.createDataFrame([("site/index.md",), ("site/a b/c.md",), ("site/docs/index.html",), ("site/ü.md",)], "p string")
    assert [r.u for r in df.selectExpr(f"{crawl.page_url('p', 'https://e.org/', 'site')} AS u").collect()] == ["https://e.org/", "https://e.org/a%20b/c/", "https://e.org/docs/", "https://e.org/%C3%BC/"]


def test_technical_findings(spark):
    rows = [(1, "<title>T</title><link rel='canonical' href='https://e.org/'>", "<html><body><h1>A</h1><p>" + "word " * 30 + "</p></body></html>"), (2, "<title></title><title>x</title><meta name='robots' content='index,noindex'><link rel=\"alternate\" hreflang=\"de\" href=\"/x\">", "<html><body><div id='root'></div><script>x</script><a href='javascript:1'>z</a></body></html>")]
    out = [r.asDict() for r in apply(spark.createDataFrame(rows, "page_id bigint, head string, html string"), technical.audit()).orderBy("page_id").collect()]
    assert [out[0][f"f_{k}"] for k in ("title", "visible_main_text", "canonical", "meta_robots", "heading_order", "internal_links", "empty_app_shell")] == ["pass"] * 7
    assert [out[1][f"f_{k}"] for k in ("title", "visible_main_text", "canonical", "meta_robots", "heading_order", "language_alternates", "internal_links", "empty_app_shell")] == ["fail", "warn", "warn", "fail", "warn", "warn", "warn", "warn"]


def test_resolved_links(spark):
    for href, want in (("/x", "https://e.org/x"), ("y", "https://e.org/a/y"), ("//h/z", "https://h/z"), ("#f", "#f"), ("mailto:a@b", "mailto:a@b"), ("https://q", "https://q")):
        assert spark.sql(f"SELECT {technical.resolved(repr(href), repr('https://e.org/a/b?c=d'))} AS u").first().u == want


def test_structured_data(spark):
    ok = '"@context":"https://schema.org"'
    texts = [f'{{{ok},"@type":"Event","name":"x"}}', "{bad", '{"@type":"Gizmo"}', "[1]", "null", "3", f'{{{ok},"@graph":[{{"@type":"Event","name":"e"}},{{"@type":"Article, Event","headline":"h","name":"n","startDate":"2026"}},{{"name":"z"}}]}}', f'{{{ok},"@graph":[]}}', f'{{{ok},"@type":["Person","Course"],"name":"p","description":""}}', f'{{{ok},"@type":"Article","headline":0}}']
    found = spark.createDataFrame(list(enumerate(texts)), "page_id bigint, json string")
    wrong = sorted((r.page_id, r.node_ord, r.type, r.error) for r in jsonld.errors(found, ["page_id"]).collect())
    assert wrong == [(0, 0, "Event", "startDate"), (1, -1, "", "invalid"), (2, -1, "", "context"), (3, -1, "", "root array"), (4, -1, "", "root null"), (5, -1, "", "root primitive"), (6, 0, "Event", "startDate"), (6, 2, "", "type"), (7, -1, "", "no nodes"), (8, 0, "Course", "description")]
    got = {r.page_id: r for r in jsonld.judged(found, ["page_id"]).collect()}
    assert got[9].valid and got[2].unknown_types == 1 and got[6].nodes == 3 and got[7].nodes == 0 and got[5].root == "primitive"
    docs = spark.createDataFrame([(1, f"```json\n{texts[9]}\n```"), (2, "none"), (3, None), (4, f"<script type='application/ld+json'>{texts[0]}</script>")], "page_id bigint, content string")
    assert sorted((r.page_id, r.block_count, r.errors, r.valid) for r in jsonld.file_verdicts(jsonld.blocks(docs, "page_id"), docs, "page_id").collect()) == [(1, 1, 0, True), (2, 0, 0, False), (3, 0, 0, False), (4, 1, 1, False)]
    a = json.loads(spark.range(1).select(jsonld.article(F.lit("H"), F.lit("u"), F.lit("Ann"), F.lit(None).cast("string")).alias("j")).first().j)
    assert a["author"]["name"] == "Ann" and "datePublished" not in a
    page = spark.range(1).select(jsonld.injected(F.lit("<html><head></head><body></body></html>"), F.lit('{"a":"</x>$1"}'), F.lit(True)).alias("x"), jsonld.injected(F.lit("# Hi"), F.lit('{"a":1}'), F.lit(False)).alias("y")).first()
    assert '<\\/x>$1' in page.x and page.x.index("ld+json") < page.x.index("</head>") and page.y.startswith("# Hi\n\n```json")


def test_parsers(spark):
    tree = parsers.Tree("<!DOCTYPE html><title>T</title><p>one<p>two<br>x<ul><li>a<li>b</ul><script>'</p>'</script>")
    assert [(n[3], tree.nodes[n[1]][3]) for n in tree.nodes if n[3] in ("p", "li", "title", "br")] == [("title", "head"), ("p", "body"), ("p", "body"), ("br", "p"), ("li", "ul"), ("li", "ul")]
    blocks = parsers.markdown_blocks("# A\npara one\nmore\n\n> q\n> r\n- i\n```py\n# no\n```\n| a | b |\n---")
    assert [b[:2] for b in blocks] == [("heading", 1), ("paragraph", 0), ("quote", 0), ("item", 0), ("code", 0), ("row", 0), ("hr", 0)] and blocks[2][2] == "q\nr"
    assert parsers.frontmatter_of("---\na: yes\nb: 2024-01-01\nc: true\n---\nbody") == ('{"a": "yes", "b": "2024-01-01", "c": true}', "body")
    assert parsers.frontmatter_of("---\na: [\n---\nbody") == ("{}", "body") and parsers.frontmatter_of("no") == ("{}", "no") and parsers.frontmatter_of("---\n- x\n...\nb") == ("{}", "b")
    assert parsers.balanced(' {"a": "}\\""} x [1, [2]] {bad} {open') == ['{"a": "}\\""}', "[1, [2]]", "{bad}", "{open"] and parsers.balanced("x {}") == [] == parsers.balanced("")
    assert parsers.balanced('{"a": "}\\\\""} [1]') == ['{"a": "}\\\\""} [1]']  # an escaped backslash ends no escape: the next quote opens a string
    assert [b[0] for b in parsers.ld_blocks('```json\n{"@context": 1}\n{"b": 2}\n```\n<script type="application/ld+json">x</script>')] == ["fence", "script"]
    df = spark.createDataFrame([(1, "<p>x", None), (2, None, None)], "id bigint, html string, lang string")
    assert parsers.dom(df, "id").where("tag = 'p' AND text = 'x'").count() == 1 and parsers.dom(df.limit(0), "id").count() == 0


def test_readability(spark):
    assert [T.spanish_syllables(w) for w in ("casa", "leer", "país", "aire", "x", "poeta")] == [2, 2, 2, 2, 1, 3]
    df = spark.createDataFrame([(1, "Hola casa. Otra casa!", "es"), (2, "A cat sat.", "en-US"), (3, "Ein Hund.", "de"), (4, None, None)], "id bigint, text string, lang string")
    got = {r.id: r for r in parsers.readability(df, "id").collect()}
    assert got[1].huerta == pytest.approx(206.84 - 1.02 * 2 - 60 * 2) and got[2].flesch is not None and got[3].flesch is None and got[4].words == 0


def test_evidence(spark):
    found = spark.createDataFrame([(1, ["geo-kdd-2024", "zz"])], "id bigint, source_refs array<string>")
    assert [r.ref for r in evidence.missing_refs(found, "id").collect()] == ["zz"] and evidence.stale(spark, "2026-08-02").count() == 0
    bad = spark.createDataFrame([("c", "odd", "strong")], "category string, severity string, evidence_label string")
    with pytest.raises(Exception, match="unknown severity"):
        evidence.checked(bad).collect()


def test_files_in_and_out(spark, tmp_path):
    for name, data in (("a.md", b"# A"), (".hid.md", b"x"), ("b.txt", b"x"), ("sub/c.HTML", b"<p>"), ("sub/d.md", b"\xff\xfe"), ("skip/e.md", b"e")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = files.discovered(spark, [str(tmp_path), str(tmp_path / "missing")], ignore=["skip/"], root=str(tmp_path)).collect()
    assert [(r.path.split("/")[-1], r.status) for r in got] == [("a.md", "success"), ("c.HTML", "success"), ("d.md", "error")]
    assert files.discovered(spark, [str(tmp_path / "missing")]).count() == 0
    scores = spark.createDataFrame([("success", 80), ("success", 60)], "status string, score bigint")
    assert files.gate(scores, 60) and not files.gate(scores, 61)
    files.write_reports(scores, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    assert files.inside(str(tmp_path / "a"), str(tmp_path)) and not files.inside("/etc/passwd", str(tmp_path)) and "&lt;b&gt;" in files.report_html("t", [("<b>", 1)])
    assert files.config(None) == {} and files.common_base(["a/b/c.md", "a/d.md"]) == "a"
    (tmp_path / "c.json").write_text('{"limits": 3}')
    with pytest.raises(ValueError):
        files.config(str(tmp_path / "c.json"))


def test_stream_scores_each_path_once(spark, tmp_path):
    rows = [(1, "a.md", "# A\n\ntext", "2024-01-01 00:00:00"), (2, "a.md", "# A\n\ntext", "2024-01-01 00:01:00"), (3, "b.md", "plain", "2024-01-01 00:02:00")]
    spark.createDataFrame(rows, "doc_id bigint, path string, content string, t string").selectExpr("doc_id", "path", "content", "CAST(t AS TIMESTAMP) AS landed_at").write.parquet(str(tmp_path / "in"))
    query = landing.scores(landing.landed(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("scored_stream").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.path for r in spark.table("scored_stream").collect()) == ["a.md", "b.md"]


def test_page_metadata(spark):
    from corvane.operators import pages

    rows = [("site/docs/a.md", "---\ntitle: F\n---\n# Head\n\nFirst words here."), ("blog/b.md", "---\ntitle: 'F'\n---\nBody text."), ("x/c.html", "<h1>A <b>c</b></h1>"), ("z.md", ""), ("y/long.md", "w " * 100)]
    got = [r.asDict() for r in apply(spark.createDataFrame(rows, "path string, content string"), pages.metadata()).collect()]
    assert [(r["title"], r["section"]) for r in got] == [("Head", "Documentation"), ("F", "Blog"), ("A c", "x"), ("z", "Pages"), ("long", "y")]
    assert got[0]["description"] == "First words here." and got[3]["description"] == "" and len(got[4]["description"]) == 150 and got[4]["description"].endswith("...")


def test_structured_data_has_to_be_seen(spark):
    block = '<script type="application/ld+json">{"headline":"%s"}</script>'
    rows = [(1, "<title>My Page</title>" + block % "my page", "<p>x</p>"), (2, block % "gone", "<p>x</p>"), (3, block % "In Text", "<p>words in  text</p>"), (4, '<script type="application/ld+json">{bad</script>', "x"), (5, "", "x")]
    out = apply(spark.createDataFrame(rows, "page_id bigint, head string, html string"), technical.audit(), ["page_id", "f_structured_data"])
    assert [r.f_structured_data for r in out.orderBy("page_id").collect()] == ["pass", "warn", "pass", "fail", "not_applicable"]


def test_distinct_urls_are_capped_and_the_rest_is_counted(spark):
    rows = [(5, "https://a.example/1"), (1, "https://a.example/2"), (2, "https://a.example/1"), (3, "https://b.example/"), (4, None), (6, "https://a.example/3")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    got = sorted((r.position, r.first, r.url, r.left_out) for r in crawl.capped_urls(pages, "url", "page_id", 2).collect())
    assert [(p, f, u, n) for p, f, u, n in got] == [(0, 1, "https://a.example/2", 2), (1, 2, "https://a.example/1", 2)]
    assert {r.left_out for r in crawl.capped_urls(pages, "url", "page_id").collect()} == {0} and crawl.capped_urls(pages, "url", "page_id").count() == 4
