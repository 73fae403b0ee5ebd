"""The technical audit of markup and structured data, from tags found in place: a projection, and child tables for links."""

from __future__ import annotations

from ..functions import text as T
from ..functions.dialect import Spark
from ..functions.layers import Layer

ROBOTS_TOKENS = tuple("index follow all none noindex nofollow noarchive nosnippet notranslate noimageindex unavailable_after max-snippet max-image-preview max-video-preview".split())
LANGUAGE = r"^(?i:[a-z]{2,3}(?:-[a-z0-9]{2,8})*)$"
REQUIRED: dict[str, tuple[str, ...]] = {
    **{t: ("headline",) for t in ("Article", "BlogPosting", "TechArticle", "DiscussionForumPosting", "SocialMediaPosting")}, "NewsArticle": ("headline", "datePublished"), "FAQPage": ("mainEntity",), "QAPage": ("mainEntity",), "ItemList": ("itemListElement",),
    "BreadcrumbList": ("itemListElement",), **{t: ("name",) for t in ("Organization", "Person", "Product", "Service", "ProfessionalService", "LocalBusiness", "Corporation", "EducationalOrganization", "WebPage", "WebSite")}, "ImageObject": ("url",),
    "VideoObject": ("name", "description"), "Course": ("name", "description"), "SoftwareApplication": ("name", "applicationCategory"), "PostalAddress": ("streetAddress",), "ContactPoint": ("telephone",), "Event": ("name", "startDate"),
    "Recipe": ("name", "recipeIngredient", "recipeInstructions"), "HowTo": ("name", "step"),
}
JSON_LD = r"(?i)<script[^>]*type=[\x22\x27]application/ld\+json[\x22\x27][^>]*>([\s\S]*?)</script>"
LINK_TAG = r"(?i)<a\s[^>]*href=[\x22\x27]([^\x22\x27]*)[\x22\x27][^>]*>"


def _attr(d: Spark, tag: str, name: str) -> str:
    return d.first(tag, rf"(?i)\s{name}=[\x22\x27]([^\x22\x27]*)[\x22\x27]")


def audit(head: str = "head", html: str = "html", least_words: int = 20) -> list[Layer]:
    """Observations over head (head elements) and html (the page)."""

    def tags(d: Spark) -> dict[str, str]:
        links = d.every(head, r"(?i)<link\s[^>]*>")
        metas = d.filter(d.every(head, r"(?i)<meta\s[^>]*>"), "m", f"lower({_attr(d, 'm', 'name')}) IN ('robots', 'googlebot')")
        stripped = d.sub(html, r"(?i)<!--[\s\S]*?-->|<script[\s\S]*?</script>|<style[\s\S]*?</style>|<template[\s\S]*?</template>|<noscript[\s\S]*?</noscript>|<svg[\s\S]*?</svg>|<nav[\s>][\s\S]*?</nav>|<head[\s>][\s\S]*?</head>")
        heads = d.every(html, r"(?i)<h[1-6][\s>]")
        return {
            "titles": d.map(d.every(head, r"(?i)<title[^>]*>([\s\S]*?)</title>", 1), "t", d.trim("t")),
            "canonicals": d.map(d.filter(links, "l", d.has("l", r"(?i)rel=[\x22\x27][^\x22\x27]*\bcanonical\b")), "l", _attr(d, "l", "href")),
            "alternates": d.filter(links, "l", d.has("l", r"(?i)hreflang=")),
            "directives": d.filter(d.map(d.split(d.join(d.map(metas, "m", _attr(d, "m", "content")), ","), ","), "x", f"lower({d.trim('x')})"), "y", "y <> ''"),
            "blocks": d.every(head, JSON_LD, 1),
            "visible_low": f"lower({d.sub(d.sub(stripped, r'<[^>]*>', ' '), r'\s+', ' ')})",
            "visible_words": T.words(d, d.sub(stripped, r"<[^>]*>", " ")),
            "levels": d.map(heads, "h", f"CAST(substr(h, 3, 1) AS BIGINT)"),
            "hrefs": d.every(html, LINK_TAG, 1),
            "scripts": d.count(html, r"(?i)<script[\s>]"),
            "app_root": d.has(html, r"(?i)id=[\x22\x27](?:root|app|__next)[\x22\x27]|data-reactroot|data-react-root|data-v-app"),
        }

    def facts(d: Spark) -> dict[str, str]:
        if type(d) is Spark:
            skips = "CAST(size(filter(transform(levels, (l, i) -> i > 0 AND l > levels[i - 1] + 1), s -> s)) AS BIGINT)"
        else:
            skips = "CAST(len(list_filter(range(2, len(levels) + 1), lambda i: levels[i] > levels[i - 1] + 1)) AS BIGINT)"
        lang = d.map("alternates", "a", f"lower({_attr(d, 'a', 'hreflang')})")
        has = lambda x: f"{d.size(d.filter('directives', 'y', f'y = {x!r}'))} > 0"
        if type(d) is Spark:
            valid, named = "try_parse_json(b) IS NOT NULL", "get_json_object(b, '$.headline'), get_json_object(b, '$.name'), get_json_object(b, '$.description')"
            names = f"filter(flatten(transform(filter(blocks, b -> {valid}), b -> array({named}))), n -> n IS NOT NULL AND n <> '')"
        else:
            valid, named = "json_valid(b)", "json_extract_string(b, '$.headline'), json_extract_string(b, '$.name'), json_extract_string(b, '$.description')"
            names = f"list_filter(flatten(list_transform(list_filter(blocks, lambda b: {valid}), lambda b: [{named}])), lambda n: n IS NOT NULL AND n <> '')"
        title = f"lower({d.join('titles', ' ')})"
        unsafe = d.has("h", r"(?i)^\s*(?:javascript|data|vbscript|file|blob):")
        return {
            "title_count": d.size("titles"), "title_empty": f"{d.size(d.filter('titles', 't', chr(39) * 2 + ' <> t'))} = 0",
            "canonical_count": d.size("canonicals"), "canonical_conflict": f"{d.size(d.distinct('canonicals'))} > 1", "canonical_absolute": f"{d.size(d.filter('canonicals', 'c', d.has('c', r'^(?i:https?)://[^/\s]+')))} = {d.size('canonicals')}",
            "unknown_directives": d.size(d.distinct(d.filter("directives", "y", f"{d.first('y', r'^([^:]*?)\s*(?::|$)')} NOT IN ({', '.join(map(repr, ROBOTS_TOKENS))})"))),
            "directive_conflict": f"({has('index')} AND {has('noindex')}) OR ({has('follow')} AND {has('nofollow')}) OR ({has('all')} AND {has('none')})",
            "noindex": f"{has('noindex')} OR {has('none')}",
            "h1_count": d.size(d.filter("levels", "l", "l = 1")), "level_skips": skips,
            "bad_languages": d.size(d.filter(lang, "g", f"g <> 'x-default' AND NOT {d.has('g', LANGUAGE)}")), "repeated_languages": f"{d.size(lang)} - {d.size(d.distinct(lang))}",
            "relative_alternates": d.size(d.filter("alternates", "a", f"NOT {d.has(_attr(d, 'a', 'href'), r'^(?i:https?)://')}")),
            "link_count": d.size("hrefs"), "bad_links": d.size(d.filter("hrefs", "h", f"{d.trim('h')} = '' OR {unsafe}")),
            "invalid_blocks": d.size(d.filter("blocks", "b", f"NOT ({valid})")),
            # A name is consistent if the title or the visible text has it.
            "unseen_names": d.size(d.filter(names, "n", f"NOT contains({title}, lower(n)) AND NOT contains(visible_low, lower(n))")),
            "block_count": d.size("blocks"), "app_shell": f"visible_words < {least_words} AND scripts > 0 AND (app_root OR visible_words = 0)",
        }

    def findings(d: Spark) -> dict[str, str]:
        return {
            "f_title": "CASE WHEN title_count = 1 AND NOT title_empty THEN 'pass' WHEN title_count > 1 THEN 'fail' ELSE 'warn' END",
            "f_visible_main_text": f"CASE WHEN visible_words >= {least_words} THEN 'pass' ELSE 'warn' END",
            "f_canonical": "CASE WHEN canonical_count > 1 THEN 'fail' WHEN canonical_count = 1 AND canonical_absolute THEN 'pass' ELSE 'warn' END",
            "f_meta_robots": "CASE WHEN directive_conflict THEN 'fail' WHEN noindex OR unknown_directives > 0 THEN 'warn' ELSE 'pass' END",
            "f_heading_order": "CASE WHEN h1_count = 1 AND level_skips = 0 THEN 'pass' ELSE 'warn' END",
            "f_language_alternates": "CASE WHEN bad_languages + repeated_languages + relative_alternates = 0 THEN 'pass' ELSE 'warn' END",
            "f_internal_links": "CASE WHEN bad_links = 0 THEN 'pass' ELSE 'warn' END",
            "f_structured_data": "CASE WHEN block_count = 0 THEN 'not_applicable' WHEN invalid_blocks > 0 THEN 'fail' WHEN unseen_names > 0 THEN 'warn' ELSE 'pass' END",
            "f_empty_app_shell": "CASE WHEN app_shell THEN 'warn' ELSE 'pass' END",
        }

    return [tags, facts, findings]


def resolved(href: str, base: str) -> str:
    """An address against the page's, in SQL: absolute, protocol-relative, root-relative or relative to the page's folder; fragments stay."""
    origin, folder = f"regexp_extract({base}, r'^(https?://[^/?#]*)', 1)", f"regexp_replace(regexp_replace({base}, r'[?#].*$', ''), r'([^/])/[^/]*$', '$1/')"
    return f"CASE WHEN {href} RLIKE r'^(?i)[a-z][a-z0-9+.-]*:' OR {href} RLIKE r'^#' THEN {href} WHEN {href} RLIKE r'^//' THEN regexp_extract({base}, r'^(https?:)', 1) || {href} WHEN {href} RLIKE r'^/' THEN {origin} || {href} ELSE {folder} || {href} END"


def required_sql() -> str:
    return "(VALUES " + ", ".join(f"('{t}', '{f}')" for t, fs in REQUIRED.items() for f in fs) + ") AS required(type, field)"
