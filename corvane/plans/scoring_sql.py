"""The figures of operators.audit once more, as SQL that the checking engine runs: written against the derived corpus, by patterns over
text and tags where the operator walks trees, so that neither can repeat the other's mistakes."""

from __future__ import annotations

from ..functions import text as T
from ..functions.dialect import CHECK as d
from ..operators import scalar as S
from ..operators import signals as G

_BLOCK_END = r"(?i)</(?:p|div|section|article|header|footer|main|nav|aside|h[1-6]|li|blockquote|pre|figure|figcaption|table|tr|form|fieldset|details|summary|address|ol|ul|dl|dt|dd)\s*>"
_BARE = r"(?:^|[^(<\x22\x27=A-Za-z0-9])https?://[^\s<]"
_EMAIL = r"[0-9A-Za-z_.+-]+@[0-9A-Za-z_-]+(?:\.[0-9A-Za-z_-]*[A-Za-z0-9])+"


def _visible(t: str) -> str:
    out = d.sub(t, r"(?i)<script[\s\S]*?</script>|<style[\s\S]*?</style>|<noscript[\s\S]*?</noscript>")
    out = f"regexp_replace(regexp_replace(regexp_replace({out}, '{_BLOCK_END}', chr(10) || chr(10), 'g'), '(?i)<br\\s*/?>', chr(10), 'g'), '<[^>]*>', '', 'g')"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = f"replace({out}, '{a}', '{b}')"
    out = f"regexp_replace(regexp_replace(regexp_replace({out}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n[ \\t]+', chr(10), 'g')"
    return d.trim(out)


def _places(pattern: str) -> str:
    found, between = d.every("text", pattern), d.split("text", pattern)
    return f"list_transform(range(1, len({found}) + 1), lambda i: CAST(list_sum(list_transform(({between})[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(({found})[1:i - 1], lambda m: length(m))), 0) AS BIGINT))"


def _each(a: str, b: str, to: str) -> str:
    return f"list_transform(range(1, len({a}) + 1), lambda i: {to.replace('@x', f'({a})[i]').replace('@y', f'({b})[i]')})"


def layers(content: str = "content", path: str = "path", limit_v1: float = 0.02, limit_v2: float = 0.05) -> list[dict[str, str]]:
    """Columns by layer; later ones use earlier ones."""
    before = "substr(text, CAST(greatest(@y - 60, 0) + 1 AS INT), CAST(@y - greatest(@y - 60, 0) AS INT))"
    source = "substr(text, CAST(greatest(@y - 50, 0) + 1 AS INT), CAST(@y + 200 - greatest(@y - 50, 0) AS INT))"
    nth = "len(list_filter(stat_raw[1:i], lambda u: u = stat_raw[i]))"
    kept = "len(list_filter(range(1, len(stat_raw) + 1), lambda j: stat_raw[j] = stat_raw[i] AND stat_kept[j]))"
    qth = "len(list_filter(quote_raw[1:i], lambda u: u = quote_raw[i]))"
    qparts = "string_split(text, quote_raw[i])"
    named = "substr(text, CAST(greatest(@y - 80, 0) + 1 AS INT), CAST(@y + length(@x) + 150 - greatest(@y - 80, 0) AS INT))"
    segments = d.split("text", r"(?m)^#{1,6}[ \t]")
    real = f"len(list_filter(({segments})[2:], lambda s: {d.has('(string_split(s, chr(10)))[1]', G.KEYWORDS)} AND {d.has('array_to_string((string_split(s, chr(10)))[2:40], chr(10))', r'\[[^\]]+\]\([^)]+\)|(?i:href=[\x22\x27]https?://)')})) > 0"
    lines = lambda s: f"string_split({s}, chr(10))"
    words = lambda s: f"len(regexp_extract_all(regexp_replace({s}, '\\]\\([^)]*\\)', ']', 'g'), '\\w+'))"
    items = lambda s: f"list_filter({lines(s)}, lambda l: l LIKE '- %')"
    prose = lambda s: f"array_to_string(list_filter({lines(s)}, lambda l: NOT l LIKE '- %' AND NOT l LIKE '|%'), chr(10))"
    listed = lambda s: f"array_to_string({items(s)}, chr(10))"
    body = lambda s: f"(2 * {words(prose(s))} + 3 * {words(listed(s))} - greatest(len({items(s)}) - 1, 0))"
    loose = lambda c: f"regexp_replace({c}, '\\s+', ' ', 'g')"
    intro_lines = d.filter(d.map(d.split("text", r"\n"), "x", d.trim("x")), "y", "y <> '' AND substr(y, 1, 1) <> '#'")

    def acronyms(name: str, t: str) -> list[dict[str, str]]:
        found = d.filter(d.distinct(d.every(d.sub(t, r"(?m)^##+[^\n]*$"), r"\b[A-Z]{2,}\b")), "a", f"a NOT IN ({', '.join(map(repr, G.STOP))})")
        closed = d.first(t, r"^([\s\S]*\))")
        beside = f"list_concat({d.every(closed, r'\b([0-9A-Za-z]+)[\s*_~]*\([^)]', 1)}, {d.every(t, r'\([^)]+\)[\s*_~]*([0-9A-Za-z_]+)', 1)})"
        return [{f"{name}_all": found, f"{name}_beside": d.map(beside, "w", "upper(w)")}, {f"{name}_unexplained": d.size(d.filter(f"{name}_all", "a", f"length(a) > 2 AND NOT list_contains({name}_beside, a)"))}]

    acr, acr2 = acronyms("acr", "text"), acronyms("acr2", "pre_text")
    html_first = "coalesce(nullif(regexp_extract(inside, '<h1>[^<]*</h1>[\\s\\S]*?<p>([\\s\\S]*?)</p>', 1), ''), regexp_extract(inside, '<p>([\\s\\S]*?)</p>', 1))"
    decoded = f"replace(replace(replace(replace(regexp_replace({html_first}, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
    semantic = " + ".join(f"CASE WHEN is_html AND {d.has(content, rf'(?i)<{tag}[\s>]')} THEN 1 ELSE 0 END" for tag in G.SEMANTIC)
    sr, qr = "(CAST(stat_sourced AS DOUBLE) / greatest(stat_total, 1))", "(CAST(quote_attributed AS DOUBLE) / greatest(quote_found, 1))"
    lost = "CASE paragraph_status WHEN 'fail' THEN 8 WHEN 'warn' THEN CASE WHEN paragraph_min < 10 THEN least(5, (10 - paragraph_min) * 2) ELSE 0 END + least(3, paragraph_long) ELSE 0 END"
    on = {k: S.applicable(k, "profile") for k in S.DIMENSIONS}
    got, most = (" + ".join(f"CASE WHEN {c} THEN {v} ELSE 0 END" for k, c in on.items() for v in [x.format(k)]) for x in ("v2_{}", "20"))
    signals = {p: f"signals_{p.replace('-', '_')}" for p in S.PROFILE_SIGNALS}
    profile, confidence = S.profile(d, signals, "fences", "ext")
    return [
        {"is_html": f"({T.is_html(d, content)} OR {path} LIKE '%.html')", "pre_text": T.preprocessed(d, content), "ext": d.first(f"lower({path})", r"\.([^./]*)$"), "inside": f"regexp_extract({content}, '<body[^>]*>([\\s\\S]*)</body>', 1)", "low_content": f"lower({content})"},
        {"text": f"CASE WHEN is_html THEN {_visible('inside')} ELSE pre_text END", **{signals[p]: S.signals(d, p, content, "low_content") for p in signals}, "fences": d.count(content, "```")},
        {"stat_raw": d.every("text", T.STATISTIC), "stat_at": _places(T.STATISTIC), "quote_raw": d.map(f"list_concat({d.every('text', G.QUOTED_LINE)}, {d.every('text', G.QUOTED_TEXT)})", "q", d.trim("q"))},
        {"stat_kept": _each("stat_raw", "stat_at", f"NOT ({d.has('@x', T.YEAR)}) AND NOT ({d.has(before, G.IDENTIFIER)})"), "stat_near": _each("stat_raw", "stat_at", d.has(source, G.SOURCE)),
         "quote_at": f"list_transform(range(1, len(quote_raw) + 1), lambda i: CASE WHEN len({qparts}) > {qth} THEN CAST(list_sum(list_transform(({qparts})[1:{qth}], lambda g: length(g))) + ({qth} - 1) * length(quote_raw[i]) AS BIGINT) ELSE -1 END)"},
        {"stat_total": "CAST(len(list_filter(stat_kept, lambda k: k)) AS BIGINT)", "stat_sourced": f"CAST(len(list_filter(range(1, len(stat_raw) + 1), lambda i: stat_near[i] AND {nth} <= {kept})) AS BIGINT)",
         "quote_total": d.size("quote_raw"), "quote_found": d.size(d.filter("quote_at", "a", "a >= 0")), "quote_attributed": d.size(d.filter(_each("quote_raw", "quote_at", f"@y >= 0 AND ({' OR '.join(d.has(named, p) for p in G.ATTRIBUTION)})"), "h", "h"))},
        {"attribution_status": "CASE WHEN quote_found > quote_attributed THEN 'fail' WHEN stat_total > stat_sourced THEN 'warn' ELSE 'pass' END",
         "heading_lines": f"CASE WHEN is_html THEN list_transform(regexp_extract_all(inside, '<h([1-6]>[^<]*)</h', 1), lambda h: repeat('#', CAST(substr(h, 1, 1) AS INT)) || ' ' || trim({loose('substr(h, 3)')})) ELSE {d.every('text', G.HEADING)} END"},
        {"levels": d.map("heading_lines", "h", f"CAST(length({d.first('h', r'^(#+)')}) AS BIGINT)"), "heading_keys": d.map("heading_lines", "h", f"lower({d.trim(d.sub('h', r'#+[ \t]*$'))})"),
         "section_words": f"""CASE WHEN NOT is_html THEN list_transform(range(1, len({d.split('text', G.HEADING)}) + 1), lambda i: {body(f"({d.split('text', G.HEADING)})[i]")} + CASE WHEN i > 1 THEN len(regexp_extract_all(heading_lines[i - 1], '\\w+')) ELSE 0 END)
           WHEN inside LIKE '%<main>%' THEN [len(regexp_extract_all(regexp_replace(inside, '<[^>]*>', '', 'g'), '\\w+'))]
           ELSE list_transform(regexp_split_to_array(inside, '<h[1-6]>[^<]*</h[1-6]>'), lambda s: len(regexp_extract_all(regexp_replace(s, '<[^>]*>', '', 'g'), '\\w+'))) END"""},
        {"heading_count": d.size("levels"), "heading_skips": "CAST(len(list_filter(range(2, len(levels) + 1), lambda i: levels[i] > levels[i - 1] + 1)) AS BIGINT)", "heading_repeats": f"{d.size('heading_keys')} - {d.size(d.distinct('heading_keys'))}", "starts_late": "coalesce(levels[1] <> 1, false)",
         "sections": "CASE WHEN NOT is_html AND len(levels) > 0 AND section_words[1] = 0 THEN section_words[2:] ELSE section_words END",
         "paragraph_words": d.sort(T.paragraph_lengths(d, "text")), "intro": f"CASE WHEN is_html THEN trim({loose(decoded)}) ELSE coalesce(({intro_lines})[1], '') END",
         "published": d.first(d.sub("text", r"\*{1,3}"), T.PUBLISHED), "reviewed": d.first(d.sub("text", r"\*{1,3}"), T.REVIEWED), "hrefs": "regexp_extract_all(inside, '<a href=\"([^\"]*)\"', 1)"},
        {"heading_status": "CASE WHEN heading_count = 0 OR heading_skips > 0 THEN 'fail' WHEN starts_late OR heading_repeats > 0 THEN 'warn' ELSE 'pass' END",
         "section_count": d.size("sections"), "section_thin": d.size(d.filter("sections", "w", "w < 10")), "paragraph_count": d.size("paragraph_words"), "paragraph_min": "coalesce(paragraph_words[1], 0)", "paragraph_max": "coalesce(paragraph_words[-1], 0)",
         "paragraph_median": "CAST(floor(coalesce(list_median(paragraph_words), 0) + 0.5) AS BIGINT)", "paragraph_long": d.size(d.filter("paragraph_words", "w", "w > 200")),
         "intro_words": d.count("intro", r"\S+"), "intro_defines": T.defines(d, "intro"), "fresh_status": "CASE WHEN published <> '' AND reviewed <> '' THEN 'pass' ELSE 'warn' END",
         "external": f"CASE WHEN is_html THEN {d.size(d.filter('hrefs', 'h', d.has('h', '(?i)^https?://')))} ELSE {T.external_links(d, 'text')} + {d.count('text', _BARE)} END",
         "internal": f"CASE WHEN is_html THEN {d.size(d.filter('hrefs', 'h', 'NOT ' + d.has('h', '(?i)^https?://|^#|^$|^[a-z][a-z0-9+.-]*:')))} ELSE {T.internal_links(d, 'text')} + {d.count('text', _EMAIL)} END",
         "link_count": f"CASE WHEN is_html THEN {d.size(d.filter('hrefs', 'h', 'starts_with(h, $$http$$)'))} ELSE {T.external_links(d, 'text')} + {d.count('text', _BARE)} END", "word_count": T.words(d, "text"),
         "sources_section": f"CASE WHEN is_html THEN {d.has('inside', r'(?i)<h[1-6]>[^<]*(?:sources|references|citations|bibliography|further reading)[^<]*</h[1-6]>\n<ul>\n<li><a href=')} ELSE {real} END"},
        {"section_status": "CASE WHEN section_thin = 0 THEN 'pass' WHEN section_thin * 2 > section_count THEN 'fail' ELSE 'warn' END",
         "paragraph_status": "CASE WHEN paragraph_count = 0 THEN 'fail' WHEN paragraph_long = 0 AND paragraph_min >= 10 THEN 'pass' ELSE 'warn' END",
         "answer_status": "CASE WHEN intro = '' THEN 'fail' WHEN intro_words BETWEEN 40 AND 90 AND intro_defines THEN 'pass' ELSE 'warn' END",
         "link_farm": "external > 30 AND word_count < 500", "link_status": "CASE WHEN external > 30 AND word_count < 500 THEN 'fail' WHEN external >= 3 THEN 'pass' ELSE 'warn' END",
         "semantic_count": f"CAST({semantic} AS BIGINT)", **acr[0], **acr2[0]},
        {**acr[1], **acr2[1], "semantic_status": "CASE WHEN NOT is_html THEN NULL WHEN semantic_count >= 3 THEN 'pass' WHEN semantic_count > 0 THEN 'warn' ELSE 'fail' END",
         "v1_answer": "CASE WHEN intro <> '' AND intro_words BETWEEN 40 AND 90 THEN CASE WHEN intro_defines THEN 10 ELSE 7 END ELSE 0 END",
         "v1_tables": f"CASE WHEN (is_html AND inside LIKE '%<table>%') OR (NOT is_html AND {d.has('text', r'(?m)^\|---\|---\|$')}) THEN 4 ELSE 0 END",
         "v1_lists": f"CASE WHEN (is_html AND inside LIKE '%<ul>%') OR (NOT is_html AND {d.has('text', r'(?m)^- ')}) THEN 3 ELSE 0 END",
         "v1_headers": f"CASE WHEN (is_html AND {d.has('inside', '<h[23]>')}) OR {d.has('text', r'(?m)^##+[ \t]+\S')} THEN 3 ELSE 0 END",
         "v1_unsemantic": "is_html AND semantic_count < 3", "v1_dynamic": f"is_html AND {d.has(content, r'(?i)id=\x22(?:app|root)\x22|createapp\(|reactdom\.render\(')}",
         "stat_count": f"({T.statistics_v1(d, 'text')} + {T.verbal(d, 'text')})", "quote_count": T.quotes_v1(d, "text"), "has_sources": d.has("text", "(?i)bibliography|citations|references|sources"),
         "pronoun_points": T.density_points(d, "text", limit_v1), "v2_pronoun_points": T.density_points(d, "pre_text", limit_v2), "profile": profile, "confidence": confidence},
        {"v1_structure": "CAST(greatest(v1_answer + v1_tables + v1_lists + v1_headers - CASE WHEN v1_unsemantic THEN 4 ELSE 0 END, 0) AS BIGINT)", "v1_statistics": "CAST(CASE WHEN stat_count >= 3 THEN 20 WHEN stat_count > 0 THEN 10 ELSE 0 END AS BIGINT)",
         "v1_quotations": "CAST(CASE WHEN quote_count >= 2 THEN 20 WHEN quote_count > 0 THEN 10 ELSE 0 END AS BIGINT)", "v1_citations": "CAST(CASE WHEN link_count >= 3 THEN 15 WHEN link_count >= 1 THEN 8 ELSE 0 END + CASE WHEN has_sources THEN 5 ELSE 0 END AS BIGINT)",
         "v1_clarity": "CAST(20 - pronoun_points - least(5, acr_unexplained) AS BIGINT)",
         "v2_structure": """CAST(least(20, CASE heading_status WHEN 'pass' THEN 7 WHEN 'warn' THEN 4 ELSE 0 END + CASE section_status WHEN 'pass' THEN 5 WHEN 'warn' THEN 2 ELSE 0 END + CASE answer_status WHEN 'pass' THEN 5 WHEN 'warn' THEN 2 ELSE 0 END
            + CASE WHEN paragraph_median >= 10 AND paragraph_long = 0 THEN 3 WHEN paragraph_status = 'pass' THEN 2 ELSE 1 END) AS BIGINT)""",
         "v2_statistics": f"""CAST(CASE WHEN stat_total = 0 THEN 0 ELSE CASE WHEN {sr} >= 0.8e0 AND stat_total >= 3 THEN 15 WHEN {sr} >= 0.5e0 AND stat_total >= 2 THEN 10 WHEN stat_sourced > 0 AND stat_total >= 3 THEN 6 ELSE 2 END
            + CASE WHEN stat_total >= 5 AND {sr} >= 0.7e0 THEN 5 WHEN stat_total >= 3 AND {sr} >= 0.5e0 THEN 3 WHEN {sr} >= 0.5e0 THEN 1 ELSE 0 END END AS BIGINT)""",
         "v2_quotations": f"""CAST(CASE WHEN quote_found = 0 THEN 0 ELSE CASE WHEN quote_attributed = quote_found AND quote_found >= 2 THEN 12 WHEN {qr} >= 0.7e0 THEN 8 WHEN quote_attributed > 0 THEN 4 ELSE 0 END
            + CASE WHEN quote_found >= 3 AND {qr} >= 0.8e0 THEN 8 WHEN quote_found >= 2 AND {qr} >= 0.7e0 THEN 5 ELSE 2 END END AS BIGINT)""",
         "v2_citations": """CAST(CASE WHEN link_farm THEN 0 ELSE least(20, CASE WHEN external >= 5 THEN 12 WHEN external >= 3 THEN 9 WHEN external >= 1 THEN 5 ELSE 0 END + CASE WHEN sources_section THEN 5 WHEN external >= 3 THEN 3 ELSE 0 END
            + CASE WHEN fresh_status = 'pass' THEN 3 WHEN published <> '' OR reviewed <> '' THEN 1 ELSE 0 END) END AS BIGINT)""",
         "v2_clarity": f"CAST(greatest(0, least(20, 20 - {lost} - least(5, v2_pronoun_points) - least(3, acr2_unexplained))) AS BIGINT)"},
        {"v1_total": "v1_structure + v1_statistics + v1_quotations + v1_citations + v1_clarity", "v2_score": f"CAST(floor(CAST({got} AS DOUBLE) / ({most}) * 100 + 0.5) AS BIGINT)"},
        {"band": S.band("v2_score")},
    ]


def sql(source: str, keep: list[str] | None = None, **settings) -> str:
    """The figures of source, a table or subquery of (doc_id, path, content)."""
    for i, layer in enumerate(layers(**settings)):
        source = f"(SELECT *, {', '.join(f'{e} AS {n}' for n, e in layer.items())} FROM {source} AS l{i})"
    return f"SELECT {', '.join(keep) if keep else '*'} FROM {source} AS result"
