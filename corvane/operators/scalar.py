"""Operators that are projections: one row in, one row out, nothing shuffled. Each is a dict of SQL expressions by dialect."""

from __future__ import annotations

import re

from ..functions import text as T
from ..functions.dialect import Spark
from ..functions.layers import Layer

_any, _words = T.any_of, T.any_word


class Signal(str):
    """A pattern, and words of which a text in lower case has to contain one if the pattern is to match: a cheap test that most texts fail."""

    needles: tuple[str, ...] = ()

    @classmethod
    def of(cls, pattern: str, phrases: tuple[str, ...]) -> Signal:
        out = cls(pattern)
        plain = (re.sub(r"\\x\{[0-9a-f]+\}\??|\(\?:[^)]*\)\??|\w\?|\\.", " ", p.lower()) for p in phrases)
        out.needles = tuple(dict.fromkeys(max(re.findall(r"[a-z0-9]+", p), key=len) for p in plain))
        return out


def _said(*phrases: str) -> str:
    """Any of the phrases, whole words, in any case."""
    return Signal.of(rf"(?i)\b{_any(*phrases)}\b", phrases)


def _has(*phrases: str) -> str:
    return Signal.of(rf"(?i){_any(*phrases)}", phrases)


PROFILE_SIGNALS: dict[str, tuple[str, ...]] = {
    "regulated": (
        _has("privacy policy"), Signal.of(rf"(?i)terms\s*{_words('and of')}\s*{_words('conditions use service')}", ("terms",)), Signal.of(r"(?i)forward[-\s]looking\s*statements", ("statements",)), Signal.of(rf"(?i)securities\s*{_words('& and')}\s*exchange\s*commission", ("securities",)),
        _has("securities exchange act", "securities act"), _has("medical review"), _has("last reviewed :"), _has("data protection officer"), _has("gdpr article"),
        _has("standard contractual clauses"), _has("subprocessors"), Signal.of(r"(?i)legal\s*basis\s*(?:\x{2014}|:|for)", ("basis",)), _has("retention period"), _said("fiscal quarter", "fiscal year", "quarterly report", "earnings report"),
    ),
    "ecommerce": (
        _said(*(f"add to {x}" for x in ("basket", "bag", "cart")), "shop now", "buy now"), r"\$\d+(?:\.\d{2})?\b", _said(*(f"verified {x}" for x in ("owner", "buyer", "purchase"))), _has("customer reviews"),
        _has("frequently bought together"), _has("shipping and returns", "shipping & returns"), _has("weight capacity"),
    ),
    "documentation": (
        _said("sdk", "endpoint", "cli reference", "api reference", "configuration schema"), r"```[a-z]*\n[\s\S]*?```", Signal.of(rf"(?i)\b{_words('authentication authorization')}\s*:", ("authentication", "authorization")),
        Signal.of(rf"(?i)\b{_words('request response')}\s*{_words('code headers body')}:", ("request", "response")), _has("base url"), _has("rate limit"), _said("query optimization", "execution plan", "query planner"),
        _said("minor release", "regression suite", "backward compatibility"), Signal.of(rf"(?i)\b{_words('fixed changed added removed deprecated syntax')}\s*{_words('since in')}\s*{_words('version v')}\s*\d", tuple("fixed changed added removed deprecated syntax".split())), Signal.of(rf"(?i)\b{_any('since', 'throws', 'parameter', 'return type')}\s*:", ("since", "throws", "parameter", "return")),
    ),
    "open-source": (
        _said("license", "changelog", "contributing", "architecture decision"), r"\[!\[[^\n]*\]\([^\n]*\)\]\([^\n]*\)", Signal.of(rf"(?i)npm\s+{_words('install i')}\s+", ("npm",)), Signal.of(r"(?i)pip\s+install\s+", ("pip",)), _said(r"contributing\.md", "code of conduct"),
        _said("commit conventions", "conventional commits"), _said("getting started", "quickstart"), _has("pull request process", "pull request checklist"),
    ),
    "commercial": (
        _said("pro plan", "plan", "enterprise", "price", "pricing"), _has("no credit card", "free trial", "start free"), _said("testimonial", "customer story", "case study"),
        _has("trusted by"), _has("annual billing", "monthly billing"), _said("soc 2", "compliance", "certified"),
    ),
    "service": (
        _said("agency", "agencia", "consulting", "consultancy", r"consultor(?:\x{ed}a|es)?", "professional services?", "servicios? profesionales?"),
        _said("our clients", "client testimonials", "nuestros? clientes?", "testimonios? de clientes?", "case stud(?:y|ies)", r"casos? de \x{e9}?xito"),
        _said("get in touch", "contact us", "schedule a call", r"cont\x{e1}ct?anos?", *(f"agenda una? {x}" for x in ("llamada", r"reuni\x{f3}n", "consulta")), *(rf"solicita (?:una\s*)?{x}" for x in ("consulta", "demo", "llamada", "presupuesto"))),
        _said("strategy", "estrategia", "digital transformation", r"transformaci\x{f3}n digital", "consulting services", r"servicios? de consultor\x{ed}a", "ofrecemos? servicios"),
        _said("our work", "nuestro trabajo", "portfolio", "portafolio", "proyectos?"),
    ),
}


def signals(d: Spark, profile: str, t: str, lowered: str) -> str:
    """How many of a profile's signals t has; lowered: t in lower case."""

    def one(p: str) -> str:
        needles = getattr(p, "needles", ())
        return (f"({' OR '.join(f'contains({lowered}, {n!r})' for n in needles)}) AND " if needles else "") + d.has(t, p)

    return "(" + " + ".join(f"CASE WHEN {one(p)} THEN 1 ELSE 0 END" for p in PROFILE_SIGNALS[profile]) + ")"


def profile(d: Spark, counts: dict[str, str], fences: str, ext: str) -> tuple[str, str]:
    """(profile, confidence) by ordered first match of signal counts."""
    c = counts
    rules = [
        (f"{c['regulated']} >= 3", "regulated", f"least(0.95e0, 0.6e0 + 0.1e0 * {c['regulated']})"),
        (f"{c['ecommerce']} >= 3 AND {ext} = 'md'", "ecommerce", f"least(0.9e0, 0.5e0 + 0.1e0 * {c['ecommerce']})"),
        (f"{c['ecommerce']} >= 2 AND {ext} = 'html'", "ecommerce", "0.7e0"),
        (f"{c['documentation']} >= 3 OR ({fences} >= 2 AND {c['documentation']} >= 2)", "documentation", f"least(0.95e0, 0.5e0 + 0.1e0 * {c['documentation']})"),
        (f"{c['open-source']} >= 3", "open-source", f"least(0.9e0, 0.5e0 + 0.1e0 * {c['open-source']})"),
        (f"{c['commercial']} >= 3", "commercial", f"least(0.85e0, 0.5e0 + 0.1e0 * {c['commercial']})"),
        (f"{c['service']} >= 3", "service", f"least(0.85e0, 0.5e0 + 0.1e0 * {c['service']})"),
    ]
    case = lambda k, other: "CASE " + " ".join(f"WHEN {r[0]} THEN {repr(r[1]) if k == 1 else r[2]}" for r in rules) + f" ELSE {other} END"
    return case(1, "'editorial'"), case(2, "0.2e0")


def profiles(content: str = "content") -> list[Layer]:
    def counts(d: Spark) -> dict[str, str]:
        return {f"signals_{p.replace('-', '_')}": signals(d, p, content, "lowered") for p in PROFILE_SIGNALS} | {"fences": d.count(content, "```")}

    def chosen(d: Spark) -> dict[str, str]:
        p, c = profile(d, {k: f"signals_{k.replace('-', '_')}" for k in PROFILE_SIGNALS}, "fences", "ext")
        return {"profile": p, "confidence": c}

    return [lambda d: {"lowered": f"lower({content})"}, counts, chosen]


#: Which dimensions a profile has; unknown profiles have all.
DIMENSIONS = tuple("structure statistics quotations citations clarity".split())
PROFILES = {
    "documentation": ("structure", "citations", "clarity"),
    "open-source": ("structure", "citations", "clarity"),
    "editorial": DIMENSIONS,
    "ecommerce": DIMENSIONS,
    "commercial": ("structure", "statistics", "citations", "clarity"),
    "service": ("structure", "statistics", "citations", "clarity"),
    "regulated": ("structure", "statistics", "citations", "clarity"),
}


def applicable(dimension: str, profile_: str) -> str:
    without = [p for p, dims in PROFILES.items() if dimension not in dims]
    return f"({profile_} NOT IN ({', '.join(map(repr, without))}))" if without else "true"


def band(score: str) -> str:
    return f"CASE WHEN {score} >= 85 THEN 'production-ready' WHEN {score} >= 65 THEN 'solid' WHEN {score} >= 45 THEN 'needs-work' ELSE 'at-risk' END"


def grade(score: str) -> str:
    return f"CASE WHEN {score} >= 90 THEN 'A' WHEN {score} >= 76 THEN 'B' WHEN {score} >= 61 THEN 'C' WHEN {score} >= 41 THEN 'D' ELSE 'F' END"


def colour(score: str) -> str:
    return f"CASE WHEN {score} >= 90 THEN 'brightgreen' WHEN {score} >= 76 THEN 'green' WHEN {score} >= 61 THEN 'yellow' WHEN {score} >= 41 THEN 'orange' ELSE 'red' END"


def badge_url(score: str, label: str = "AI readiness") -> str:
    return f"'https://img.shields.io/badge/{label.replace(' ', '_')}-' || CAST({score} AS STRING) || '%2F100-' || {colour(score)}"


def sitemap_priority(score: str) -> str:
    return "CASE WHEN " + score + " IS NULL THEN 0.5e0 " + " ".join(f"WHEN {score} >= {lo} THEN {p}e0" for lo, p in zip(range(90, 0, -10), ("1.0", "0.9", "0.8", "0.7", "0.6", "0.5", "0.4", "0.3", "0.2"))) + " ELSE 0.1e0 END"


def changefreq(age: str) -> str:
    return f"CASE WHEN {age} IS NULL THEN 'monthly' WHEN {age} <= 7 THEN 'daily' WHEN {age} <= 30 THEN 'weekly' WHEN {age} <= 180 THEN 'monthly' ELSE 'yearly' END"


def v1_text_scores(d: Spark, t: str) -> dict[str, str]:
    """Statistics, quotations and citations of the v1 model, and what they rest on."""
    stats = f"({T.statistics_v1(d, t)} + {T.verbal(d, t)})"
    return {
        "stat_count": stats,
        "quote_count": T.quotes_v1(d, t),
        "link_count": T.external_links(d, t),
        "has_sources": d.has(t, f"(?i){_words('bibliography citations references sources')}"),
    }


def blocked_ip(ip: str) -> str:
    """Whether an address is private, loopback, link-local or shared: never to be fetched."""
    o = [f"CAST(split_part({ip}, '.', {i}) AS INT)" for i in (1, 2)]
    v6 = f"(lower({ip}) = '::1' OR substr(lower({ip}), 1, 3) IN ('fe8', 'fe9', 'fea', 'feb') OR substr(lower({ip}), 1, 2) IN ('fc', 'fd') OR substr(lower({ip}), 1, 7) = '::ffff:')"
    v4 = f"({o[0]} IN (0, 10, 127) OR ({o[0]} = 172 AND {o[1]} BETWEEN 16 AND 31) OR ({o[0]} = 192 AND {o[1]} = 168) OR ({o[0]} = 169 AND {o[1]} = 254) OR ({o[0]} = 100 AND {o[1]} BETWEEN 64 AND 127))"
    return f"CASE WHEN contains({ip}, ':') THEN {v6} ELSE {v4} END"


def hop_allowed(d: Spark, url: str, root: str, allow_http: bool = False, cross_origin: bool = False) -> str:
    """Whether a redirect to url keeps to the policy of a crawl that began at root."""
    secure = "true" if allow_http else f"substr({url}, 1, 8) = 'https://'"
    host = lambda u: d.first(f"lower({u})", r"^https?://([^/?#]*)")
    return f"({secure}" + ("" if cross_origin else f" AND {host(url)} = {host(root)}") + ")"
