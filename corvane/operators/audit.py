"""Observations and both scores of whole documents, from their structure: the markup tree of a page, the block tree of a Markdown text.

Trees are what the JVM has no operator for, so a document is read once, in Arrow batches, and leaves as one row of figures; nothing is
shuffled and every step is linear in the text. Scores describe style markers, not truth.

Defined results: a null content has status 'error' and null figures; an empty one is scored as an empty text. A null path reads as ''. Rows that repeat
give equal rows; texts are read whole; other columns than the keys are dropped, and a key that is called like a figure is refused.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Collection, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyarrow import compute
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..functions import text as T
from ..sources import markdown as M
from ..sources.parsers import Tree
from ..sources.tables import slices
from . import scalar as S
from . import signals as G


def _rx(pattern: str) -> re.Pattern:
    """A pattern of the portable subset, for this engine."""
    return re.compile(re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: chr(int(m[1], 16)), pattern), re.A)


@dataclass(frozen=True)
class Settings:
    """What a run may set: pronoun limits of the two models, known acronyms with their expansions, a profile instead of the detected one."""

    limit_v1: float = 0.02
    limit_v2: float = 0.05
    acronyms: dict[str, str] = field(default_factory=dict)
    profile: str | None = None
    least_section: int = 10
    most_paragraph: int = 200


INTS = (
    "stat_total stat_sourced quote_total quote_found quote_attributed heading_count heading_skips heading_repeats section_count section_thin paragraph_count paragraph_min paragraph_max paragraph_median paragraph_long "
    "intro_words external internal word_count acr_unexplained acr2_unexplained semantic_count stat_count quote_count link_count pronoun_points "
    "v1_answer v1_tables v1_lists v1_headers v1_structure v1_statistics v1_quotations v1_citations v1_clarity v1_total v2_pronoun_points v2_structure v2_statistics v2_quotations v2_citations v2_clarity v2_score"
).split()
FLAGS = "is_html starts_late intro_defines sources_section link_farm v1_unsemantic v1_dynamic has_sources overridden".split()
TEXTS = "status heading_status section_status paragraph_status intro answer_status published reviewed fresh_status attribution_status link_status semantic_status profile band".split()
REALS = ["confidence", "pronoun_share"]
LISTS = ["section_headers", "thin_headers", "unexplained"]
SCHEMA = ", ".join([*(f"{c} bigint" for c in INTS), *(f"{c} boolean" for c in FLAGS), *(f"{c} string" for c in TEXTS), *(f"{c} double" for c in REALS), *(f"{c} array<string>" for c in LISTS)])

_FRONT = re.compile(r"^\ufeff?---[\t ]*\r?\n(?:[\s\S]*?\r?\n)?(?:---|\.\.\.)[\t ]*(?:\r?\n|\Z)")
_DROPPED = [re.compile(p, re.I) for p in (r"<script[\s\S]*?</script>", r"<style[\s\S]*?</style>", r"<!--[\s\S]*?-->")]
_DOCTYPE, _HTML, _STRUCTURAL = re.compile(r"\s*<!DOCTYPE\s", re.I), re.compile(r"<html[\s>]", re.I), _rx(T.STRUCTURAL_TAG)
#: Statistics, as T.STATISTIC and T.STATISTIC_V1 find them, but with the first character told before anything else: places without it are skipped at once.
_STAT, _STAT_V1 = (re.compile(rf"[$0-9](?:(?<=\$)\d+(?:\.\d+)?[kKmMbB]?|(?<!\$)(?<!\w\d)(?:\d*(?:\.\d+)?%{x}|\d+(?:,\d{{3}})*(?:\.\d+)?\b))", re.A) for x in ("", r"|\d*(?:\.\d+)?[xX]\b"))
_YEAR = re.compile(r"(?:19|20)\d{2}\Z")
_NAMED, _IDENTIFIERS = [_rx(p) for p in G.ATTRIBUTION], frozenset(G.IDENTIFIERS)
#: G.SOURCE for a text in lower case, up to where it is one for sure; apart, as they may overlap with others.
_SOURCES = [re.compile(p, re.A) for p in (r"(?:data\s+from|survey\s+by|study\s+(?:by|published)|source:|reported\s+by|according\s+to|via\s|\(\d{4}\)|\[[\d,\s]*\])", r"published\s+(?:in|by)")]
_SPACE, _LAST_WORD = " \t\n\r\f\v", re.compile(r"\w+\Z", re.A)
_QUOTED_LINE, _QUOTED = re.compile(r"^>\s*[^\n]+$", re.M | re.A), re.compile("[\"\u201c][^\"\u201d]{15,}[\"\u201d]")

def _low(pattern: str) -> re.Pattern:
    """A pattern for any case, for encoded text whose ASCII letters are in lower case: the same matches, in half the time."""
    return re.compile(re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: f"(?:{chr(int(m[1], 16))})", pattern.removeprefix("(?i)")).encode())


_PARTS, _COUNTS = "third quarter fifth sixth seventh eighth ninth tenth".split(), "one two three four five six seven eight nine ten".split()
_encoded = lambda words: frozenset(w.encode() for w in words)
_LISTED = [[f"{n}{p}{s}" for p in _PARTS for s in ("", "s") for n in ("", *_COUNTS)], [f"{a}{b}{c}" for c in _COUNTS[1:] for b in ("", "of", "in", "outof") for a in ("", *_COUNTS)]]
#: Statistics that are spelt out: by pattern, with words of which one is in every text that has such; the last two kinds of T.VERBAL are single words.
_SPELT = [(_low(T.VERBAL[0]), _encoded(_LISTED[0])), (_low(T.VERBAL[1]), _encoded(_LISTED[0])), (re.compile(rb"[0-9](?<!\w\d)\d*\s*(?:out\s*of|in)\s*\d+\b"), None), (_low(T.VERBAL[3]), _encoded(_LISTED[1]))]
_SPELT_WORDS = _encoded("half double twice triple quadruple majority minority plurality".split())
_SPELT_HINTS = _SPELT_WORDS.union(*(x for _, x in _SPELT if x))
_STRAIGHT, _HREF = re.compile(r'"[^"]{15,}"'), re.compile(r"href=[\"']https?://[^\"']+[\"']")
_PRONOUNS = _encoded("it they them this these those".split())
_STARS, _BETWEEN, _HTTP_TARGET = re.compile(r"\*{1,3}"), re.compile(r"\n\s*\n", re.A), re.compile(r"https?://")
_PUBLISHED, _REVIEWED = re.compile(rf"[dDpP](?i:(?<=d)ate|(?<=p)(?:osted|ublished))\s*:?\s*{T.DATE}", re.A), re.compile(rf"[lL](?i:ast\s*(?:modified|reviewed|updated))\s*:?\s*{T.DATE}", re.A)
_KEYWORDS, _HEADED = _rx(G.KEYWORDS), re.compile(r"#{1,6}\s")
_LINKED = re.compile(r"\[[^\]]+\]\([^)]+\)|(?i:href=[\"']https?://)")
_SUBHEAD, _SUBHEADER = re.compile(r"^##+.*$", re.M), re.compile(r"^##+\s+\S", re.M)
_ACRONYM, _AFTER = re.compile(r"[A-Z](?<!\w[A-Z])[A-Z]+\b", re.A), re.compile(r"\([^)]+\)[\s*_~]*([0-9A-Za-z_]+)", re.A)
_NAV = re.compile(r"[A-Z][a-z]+(\s+[A-Z][a-z]+)*\s*[|\-\u2014\u2013]")
_SCHEME, _HTTP = re.compile(r"[a-z][a-z0-9+.-]*:", re.I), re.compile(r"https?://", re.I)
_ALNUM = frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_GLUE = frozenset(_SPACE + "*_~")
#: Signals: with words of which one has to be there, for encoded text in lower case; else for the text as it is.
_SIGNALS = {p: [(_low(s), tuple(n.encode() for n in s.needles)) if getattr(s, "needles", ()) else (_rx(s), ()) for s in listed] for p, listed in S.PROFILE_SIGNALS.items()}
#: All of a profile's signals that have needles, for the automaton of Arrow, whose white space lacks the vertical tab.
_ANY_SIGNAL = {p: "|".join(re.sub(r"(?<!-)\\s", r"[\\s\\x0b]", s.removeprefix("(?i)").replace(r"[-\s]", r"[-\s\x0b]")) for s in listed if getattr(s, "needles", ())) for p, listed in S.PROFILE_SIGNALS.items()}
_HEADS = tuple(f"h{i}" for i in range(1, 7))


def is_html(content: str) -> bool:
    return bool(_DOCTYPE.match(content) or _HTML.search(content) or _STRUCTURAL.search(content)) if "<" in content else False


def preprocessed(content: str) -> str:
    out = _FRONT.sub("", content, count=1)
    if "```" in out:
        out = re.sub(r"```[\s\S]*?```", "", out)
    if "<" in out:
        for p in _DROPPED:
            out = p.sub("", out)
    return out


def _flat(text: str) -> str:
    return " ".join(text.split())


def _identifies(before: str) -> bool:
    """Whether what stands before a number makes it an identifier, as G.IDENTIFIER has it."""
    if before.endswith(("v", "V")):
        return True
    before = before.rstrip(_SPACE)
    if before.endswith(":"):
        before = before[:-1].rstrip(_SPACE)
    m = _LAST_WORD.search(before[-9:])  # the longest has eight letters
    return bool(m) and m[0].lower() in _IDENTIFIERS


def spelt(raw: bytes, words: Sequence[bytes]) -> int:
    """Statistics that are spelt out in an encoded text in lower case, and these are its words."""
    seen = not _SPELT_HINTS.isdisjoint(words)
    return sum(len(p.findall(raw)) for p, listed in _SPELT if not listed or seen and not listed.isdisjoint(words)) + (sum(map(_SPELT_WORDS.__contains__, words)) if seen else 0)


def statistics(text: str) -> tuple[int, int]:
    """(statistics, those with a source near): the k-th that counts of a value is judged at the k-th place of that value, counting or not."""
    places: dict[str, list[int]] = defaultdict(list)
    kept: dict[str, int] = defaultdict(int)
    for m in _STAT.finditer(text):
        value, at = m[0], m.start()
        places[value].append(at)
        if not _YEAR.match(value) and not _identifies(text[max(0, at - 60) : at]):
            kept[value] += 1
    low = text.lower() if kept else ""
    if len(low) != len(text):  # a letter whose lower case is longer
        low = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
    sources = sorted((m.start(), m.end()) for p in _SOURCES for m in p.finditer(low)) if kept else []
    begins = [a for a, _ in sources]

    def near(at: int) -> bool:
        return any(b <= at + 200 for _, b in sources[bisect_left(begins, at - 50) : bisect_left(begins, at + 200)])

    return sum(kept.values()), sum(near(at) for value, n in kept.items() for at in places[value][:n])


def quotations(text: str) -> tuple[int, int, int]:
    """(quotations, those found in the text, those with a name near): the k-th of equal ones is judged at its k-th occurrence."""
    needles = [m[0].strip() for m in _QUOTED_LINE.finditer(text)] if text.startswith(">") or "\n>" in text else []
    if '"' in text or "\u201c" in text:
        needles += [m[0].strip() for m in _QUOTED.finditer(text)]
    asked: dict[str, int] = defaultdict(int)
    for x in needles:
        asked[x] += 1
    found = named = 0
    for x, n in asked.items():
        at = -len(x)
        for _ in range(n):
            at = text.find(x, at + len(x))
            if at < 0:
                break
            found += 1
            near = text[max(0, at - 80) : at + len(x) + 150]
            named += any(p.search(near) for p in _NAMED)
    return len(needles), found, named


def headings(levels: Sequence[int], names: Sequence[str]) -> tuple[int, int, int, bool, str]:
    """(headings, skipped levels, repeats, whether the first isn't of level 1, status)."""
    if not levels:
        return 0, 0, 0, False, "fail"
    skips = sum(b > a + 1 for a, b in zip(levels, levels[1:]))
    repeats = len(levels) - len({(a, n.lower()) for a, n in zip(levels, names)})
    late = levels[0] != 1
    return len(levels), skips, repeats, late, "fail" if skips else "warn" if late or repeats else "pass"


def _before_parentheses(text: str) -> Iterator[str]:
    """The words right before parentheses, as \\b([0-9A-Za-z]+)[\\s*_~]*\\([^)] finds them one after the other, read backwards from each."""
    done, at = 0, text.find("(")
    while at >= 0:
        if text[at + 1 : at + 2] not in ("", ")"):
            end = at
            while end > done and text[end - 1] in _GLUE:
                end -= 1
            begin = end
            while begin > done and text[begin - 1] in _ALNUM:
                begin -= 1
            if begin < end and (not begin or not (text[begin - 1] in _ALNUM or text[begin - 1] == "_")):
                yield text[begin:end]
                done = at + 2
        at = text.find("(", max(at + 1, done))


def unexplained(text: str, known: dict[str, str], any_case: bool) -> list[str]:
    """Acronyms outside of headings of level 2 and below that have neither their known expansion within 120 characters nor, or if unknown, parentheses beside them."""
    found = [a for a in dict.fromkeys(_ACRONYM.findall(_SUBHEAD.sub("", text) if "##" in text else text)) if a not in G.STOP]
    if not found:
        return []
    closed = text[: text.rfind(")") + 1]
    beside = {w.upper() for w in _before_parentheses(closed)} | {w.upper() for w in _AFTER.findall(closed)} if closed else set()
    out = []
    for a in found:
        if a in known:
            full = known[a].lower()
            at = (m.start() for m in re.finditer(rf"\b{re.escape(a)}\b", text, re.A | (re.I if any_case else 0)))
            adjacent = rf"\b{a}[\s*_~]*\([^)]{{10,}}\)|\([^)]{{10,}}\)[\s*_~]*{a}\b"
            if not any(full in text[max(0, i - 120) : i + 120].lower() for i in at) and not re.search(adjacent, text, re.I | re.A):
                out.append(f"{a} ('{known[a]}')")
        elif len(a) > 2 and a not in beside:
            out.append(a)
    return out


def possible(contents: pa.Array) -> list[frozenset[str]]:
    """The profiles of which each content may have a signal with needles: an automaton reads all patterns at once. Without one no profile has enough."""
    found = [compute.match_substring_regex(contents, p, ignore_case=True).to_pylist() for p in _ANY_SIGNAL.values()]
    return [frozenset(p for p, hit in zip(_ANY_SIGNAL, hits) if hit) for hits in zip(*found)]


def detected(content: str, path: str, maybe: Collection[str] = tuple(S.PROFILE_SIGNALS)) -> tuple[str, float]:
    """(profile, confidence) of the first profile that has enough signals; maybe: those that can have them."""
    raw = content.encode("utf-8", "surrogatepass").lower() if maybe else b""
    c = {p: sum(any(n in raw for n in needles) and bool(rx.search(raw)) if needles else bool(rx.search(content)) for rx, needles in listed) if p in maybe else 0 for p, listed in _SIGNALS.items()}
    m = re.search(r"\.([^./]*)\Z", path.lower())
    ext = m[1] if m else ""
    if c["regulated"] >= 3:
        return "regulated", min(0.95, 0.6 + 0.1 * c["regulated"])
    if c["ecommerce"] >= 3 and ext == "md":
        return "ecommerce", min(0.9, 0.5 + 0.1 * c["ecommerce"])
    if c["ecommerce"] >= 2 and ext == "html":
        return "ecommerce", 0.7
    if c["documentation"] >= 3 or c["documentation"] >= 2 and content.count("```") >= 2:
        return "documentation", min(0.95, 0.5 + 0.1 * c["documentation"])
    for p, most in (("open-source", 0.9), ("commercial", 0.85), ("service", 0.85)):
        if c[p] >= 3:
            return p, min(most, 0.5 + 0.1 * c[p])
    return "editorial", 0.2


def _sources_in_lines(text: str, low: str) -> bool:
    if not any(x in low for x in ("sources", "references", "citations", "bibliography", "further reading")):
        return False
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if _HEADED.match(line) and _KEYWORDS.search(line):
            for below in lines[i + 1 : i + 40]:
                if _HEADED.match(below):
                    break
                if _LINKED.search(below):
                    return True
    return False


def _sources_in_tree(tree: Tree) -> bool:
    for h in tree.find(*_HEADS):
        if not _KEYWORDS.search(tree.text(h)):
            continue
        for k in tree.following(h)[:5]:
            tag, attrs = tree.nodes[k][3:5]
            if tag == "a" and "href" in attrs:
                return True
            if tag in _HEADS:
                break
            if tag in ("ul", "ol", "div", "section", "article", "main", "p", "li") and any(tree.nodes[x][3] == "a" and "href" in tree.nodes[x][4] for x in tree.within(k)):
                return True
    return False


def link_kind(href: str) -> str:
    """external, internal, or '' of an address that is neither: a fragment, an unsafe scheme, mail and telephone."""
    href = href.strip()
    if _HTTP.match(href):
        return "external"
    return "" if not href or href.startswith("#") or _SCHEME.match(href) else "internal"


def _fine(value: int, *steps: tuple[int, int]) -> int:
    return next((points for least, points in steps if value >= least), 0)


class _Read:
    """A document as it is read. Its parts, and the figures by group, are made when they are first asked for: what nobody keeps costs nothing."""

    def __init__(self, content: str, path: str, s: Settings, maybe: Collection[str]):
        self.content, self.path, self.s, self.maybe = content, path, s, maybe

    # Parts

    @cached_property
    def html(self) -> bool:
        return self.path.endswith(".html") or is_html(self.content)

    @cached_property
    def pre(self) -> str:
        return preprocessed(self.content)

    @cached_property
    def tree(self) -> Tree | None:
        return Tree(self.content) if self.html else None

    @cached_property
    def text(self) -> str:
        return self.tree.visible() if self.tree else self.pre

    @cached_property
    def low(self) -> str:
        return self.text.lower()

    @cached_property
    def low_content(self) -> str:
        return self.content.lower()

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass").lower()

    @cached_property
    def low_words(self) -> list[bytes]:
        return T.spaced(self.low).split()

    @cached_property
    def raw_words(self) -> list[bytes]:
        """As low_words, but for the two letters that aren't ASCII and whose lower case is."""
        return self.raw.translate(T.BLANKS).split() if "\u0130" in self.text or "\u212a" in self.text else self.low_words

    @cached_property
    def pre_words(self) -> list[bytes]:
        return T.spaced(self.pre.lower()).split() if self.tree else self.low_words

    @cached_property
    def _parsed(self) -> tuple[list[M.Block], dict[str, str]]:
        targets: dict[str, str] = {}
        return M.parsed(self.text, targets), targets

    @cached_property
    def kinds(self) -> list[str]:
        return [b.kind for b in M.walk(self._parsed[0])]

    @cached_property
    def tags(self) -> set[str]:
        return {n[3] for n in self.tree.nodes} if self.tree else set()

    # Figures by group

    @cached_property
    def base(self) -> dict:
        return {"status": "success"}

    @cached_property
    def markup(self) -> dict:
        return {"is_html": self.html}

    @cached_property
    def stats(self) -> dict:
        total, sourced = statistics(self.text)
        return {"stat_total": total, "stat_sourced": sourced}

    @cached_property
    def quotes(self) -> dict:
        total, found, named = quotations(self.text)
        return {"quote_total": total, "quote_found": found, "quote_attributed": named}

    @cached_property
    def attribution(self) -> dict:
        loose_quotes = self.quotes["quote_found"] - self.quotes["quote_attributed"]
        return {"attribution_status": "fail" if loose_quotes else "warn" if self.stats["stat_total"] - self.stats["stat_sourced"] else "pass"}

    @cached_property
    def heads(self) -> dict:
        if tree := self.tree:
            heads = [(int(tree.nodes[k][3][1]), _flat(tree.text(k))) for k in tree.within(tree.body) if tree.nodes[k][3] in _HEADS]
            heads = [(n, t) for n, t in heads if t]
        else:
            heads = [(b.level, M.plain(b.text)) for b in M.walk(self._parsed[0]) if b.kind == "heading"]
        return dict(zip(("heading_count", "heading_skips", "heading_repeats", "starts_late", "heading_status"), headings([n for n, _ in heads], [t for _, t in heads])))

    @cached_property
    def sections(self) -> dict:
        if tree := self.tree:
            found = [M.Section("(document start)", 0, 0)]
            for k in tree.kids[tree.body]:
                if isinstance(k, int):
                    if tree.nodes[k][3] in _HEADS:
                        found.append(M.Section(_flat(tree.text(k)), int(tree.nodes[k][3][1]), 0))
                    else:
                        found[-1].words += T.word_count(tree.text(k))
        else:
            found = M.sections(self._parsed[0])
        every, thin = [x.header for x in found], [x.header for x in found if x.words < self.s.least_section]
        return {"section_headers": every, "thin_headers": thin, "section_count": len(every), "section_thin": len(thin), "section_status": "pass" if not thin else "fail" if 2 * len(thin) > len(every) else "warn"}

    @cached_property
    def paragraphs(self) -> dict:
        sizes = sorted(T.word_count(p) for p in map(str.strip, _BETWEEN.split(self.text)) if p and not p.startswith(("#", "```")))
        n = len(sizes)
        half = (sizes[(n - 1) // 2] + sizes[n // 2]) / 2 if n else 0
        least, most, long = sizes[0] if n else 0, sizes[-1] if n else 0, n - bisect_right(sizes, self.s.most_paragraph)
        return {"paragraph_count": n, "paragraph_min": least, "paragraph_max": most, "paragraph_median": int(half + 0.5), "paragraph_long": long, "paragraph_status": "fail" if not n else "pass" if not long and least >= 10 else "warn"}

    @cached_property
    def opening(self) -> dict:
        if tree := self.tree:
            first = next((k for h in tree.find("h1")[:1] for k in tree.following(h) if tree.nodes[k][3] == "p"), None)
            if first is None:
                first = next(iter(tree.find("p")), None)
            intro = _flat(tree.text(first)) if first is not None else next((x for x in map(str.strip, self.text.split("\n")) if len(x) > 20 and not _NAV.match(x)), "")
        else:
            intro = next((x for x in map(str.strip, self.text.split("\n")) if x and not x.startswith("#")), "")
        low, n = intro.lower(), len(intro.split())
        defines = any(x in low for x in T.DEFINITIONS)
        return {"intro": intro, "intro_words": n, "intro_defines": defines, "answer_status": "fail" if not intro else "pass" if 40 <= n <= 90 and defines else "warn"}

    @cached_property
    def dates(self) -> dict:
        bare, out = _STARS.sub("", self.text) if "*" in self.text else self.text, {}
        for name, rx, needles in (("published", _PUBLISHED, ("date", "posted", "published")), ("reviewed", _REVIEWED, ("last",))):
            m = rx.search(bare) if any(x in self.low for x in needles) else None
            out[name] = m[1] if m else ""
        return out | {"fresh_status": "pass" if out["published"] and out["reviewed"] else "warn"}

    @cached_property
    def links(self) -> dict:
        if tree := self.tree:
            hrefs = [n[4]["href"] for n in tree.nodes if n[3] == "a" and "href" in n[4]]
            kinds = [link_kind(n[4]["href"]) for n in tree.nodes[tree.body + 1 :] if n[3] == "a" and "href" in n[4]]
            return {"external": kinds.count("external"), "internal": kinds.count("internal"), "link_count": sum(h.startswith("http") for h in hrefs)}
        blocks, targets = self._parsed
        found = [x for b in M.walk(blocks) for t in ([b.text] if b.kind in ("paragraph", "heading") else [c for r in b.rows for c in r]) for x in M.links(t, targets)]
        http = [bool(_HTTP_TARGET.match(x.target)) for x in found]
        outside = sum(http) + (len(_HREF.findall(self.text)) if "href=" in self.text else 0)
        return {"external": outside, "internal": sum(not h and not x.image for h, x in zip(http, found)), "link_count": outside}

    @cached_property
    def sources(self) -> dict:
        return {"sources_section": _sources_in_tree(self.tree) if self.tree else _sources_in_lines(self.text, self.low)}

    @cached_property
    def words(self) -> dict:
        return {"word_count": len(self.low_words)}

    @cached_property
    def farm(self) -> dict:
        external = self.links["external"]
        farm = external > 30 and self.words["word_count"] < 500
        return {"link_farm": farm, "link_status": "fail" if farm else "pass" if external >= 3 else "warn"}

    @cached_property
    def semantics(self) -> dict:
        n = sum(t in self.tags for t in G.SEMANTIC)
        judged = self.html and (self.path.endswith(".html") or "<html" in self.low_content)
        dynamic = bool(self.tree) and (any(x in self.low_content for x in ("createapp(", "reactdom.render(")) or any(x[4].get("id") in ("app", "root") for x in self.tree.nodes))
        return {"semantic_count": n, "semantic_status": None if not judged else "pass" if n >= 3 else "warn" if n else "fail", "v1_unsemantic": self.html and n < 3, "v1_dynamic": dynamic}

    # The first model.

    @cached_property
    def structure1(self) -> dict:
        shown: set[str] = set()
        if tree := self.tree:
            unseen = {x for k in tree.find("script", "style", "noscript") for x in tree.within(k)}
            shown = {n[3] for n in tree.nodes if n[0] not in unseen}
        intro = self.opening
        answer = (10 if intro["intro_defines"] else 7) if intro["intro"] and 40 <= intro["intro_words"] <= 90 else 0
        tables = 4 if "table" in shown or (not self.tree and "<table>" in self.low) or "table" in self.kinds else 0
        lists = 3 if shown & {"ul", "ol"} or "list" in self.kinds else 0
        headers = 3 if shown & {"h2", "h3"} or ("##" in self.text and _SUBHEADER.search(self.text)) else 0
        return {"v1_answer": answer, "v1_tables": tables, "v1_lists": lists, "v1_headers": headers, "v1_structure": max(0, answer + tables + lists + headers - 4 * self.semantics["v1_unsemantic"])}

    @cached_property
    def statistics1(self) -> dict:
        n = sum(not _YEAR.match(m[0]) for m in _STAT_V1.finditer(self.text)) + spelt(self.raw, self.raw_words)
        return {"stat_count": n, "v1_statistics": _fine(n, (3, 20), (1, 10))}

    @cached_property
    def quotations1(self) -> dict:
        n = self.kinds.count("quote") + len(_STRAIGHT.findall(self.text))
        return {"quote_count": n, "v1_quotations": _fine(n, (2, 20), (1, 10))}

    @cached_property
    def citations1(self) -> dict:
        named = any(x in self.low for x in ("sources", "references", "citations", "bibliography"))
        return {"has_sources": named, "v1_citations": _fine(self.links["link_count"], (3, 15), (1, 8)) + 5 * named}

    @cached_property
    def pronouns1(self) -> dict:
        count, limit = self.words["word_count"], self.s.limit_v1
        share = sum(map(_PRONOUNS.__contains__, self.low_words)) / count if count else 0.0
        return {"pronoun_share": share, "pronoun_points": min(15, int((share - limit) * 100)) if share > limit else 0}

    @cached_property
    def acronyms1(self) -> dict:
        found = unexplained(self.text, self.s.acronyms, False)
        return {"unexplained": found, "acr_unexplained": len(found)}

    @cached_property
    def clarity1(self) -> dict:
        return {"v1_clarity": 20 - self.pronouns1["pronoun_points"] - min(5, self.acronyms1["acr_unexplained"]) if self.words["word_count"] else 20}

    @cached_property
    def total1(self) -> dict:
        return {"v1_total": sum(getattr(self, f"{k}1")[f"v1_{k}"] for k in S.DIMENSIONS)}

    # The second.

    @cached_property
    def profiled(self) -> dict:
        given = self.s.profile in S.PROFILES
        profile, confidence = (self.s.profile, 1.0) if given else detected(self.content, self.path, self.maybe)
        return {"overridden": given, "profile": profile, "confidence": confidence}

    @cached_property
    def structure2(self) -> dict:
        p = self.paragraphs
        rich = p["paragraph_count"] > 0 and p["paragraph_median"] >= 10 and not p["paragraph_long"]
        points = {"pass": 7, "warn": 4}.get(self.heads["heading_status"], 0) + {"pass": 5, "warn": 2}.get(self.sections["section_status"], 0) + {"pass": 5, "warn": 2}.get(self.opening["answer_status"], 0)
        return {"v2_structure": min(20, points + (3 if rich else 2 if p["paragraph_status"] == "pass" else 1))}

    @cached_property
    def statistics2(self) -> dict:
        total, some, points = self.stats["stat_total"], self.stats["stat_sourced"], 0
        ratio = some / total if total else 0.0
        if total:
            points = 15 if ratio >= 0.8 and total >= 3 else 10 if ratio >= 0.5 and total >= 2 else 6 if some and total >= 3 else 2
            points += 5 if total >= 5 and ratio >= 0.7 else 3 if total >= 3 and ratio >= 0.5 else 1 if ratio >= 0.5 else 0
        return {"v2_statistics": min(20, points)}

    @cached_property
    def quotations2(self) -> dict:
        total, some, points = self.quotes["quote_found"], self.quotes["quote_attributed"], 0
        ratio = some / total if total else 0.0
        if total:
            points = 12 if some == total and total >= 2 else 8 if ratio >= 0.7 else 4 if some else 0
            points += 8 if total >= 3 and ratio >= 0.8 else 5 if total >= 2 and ratio >= 0.7 else 2
        return {"v2_quotations": points}

    @cached_property
    def citations2(self) -> dict:
        external, dates = self.links["external"], self.dates
        linked = _fine(external, (5, 12), (3, 9), (1, 5)) + (5 if self.sources["sources_section"] else 3 if external >= 3 else 0)
        return {"v2_citations": 0 if self.farm["link_farm"] else min(20, linked + (3 if dates["fresh_status"] == "pass" else 1 if dates["published"] or dates["reviewed"] else 0))}

    @cached_property
    def pronouns2(self) -> dict:
        count, limit = len(self.pre_words), self.s.limit_v2
        share = (sum(map(_PRONOUNS.__contains__, self.pre_words)) / count if self.tree else self.pronouns1["pronoun_share"]) if count else 0.0
        return {"v2_pronoun_points": min(15, int((share - limit) * 100)) if share > limit else 0}

    @cached_property
    def acronyms2(self) -> dict:
        if not self.tree and not self.s.acronyms:
            return {"acr2_unexplained": self.acronyms1["acr_unexplained"]}
        return {"acr2_unexplained": len(unexplained(self.pre, self.s.acronyms, True))}

    @cached_property
    def clarity2(self) -> dict:
        p, lost = self.paragraphs, min(5, self.pronouns2["v2_pronoun_points"]) + min(3, self.acronyms2["acr2_unexplained"])
        if p["paragraph_status"] == "fail":
            lost += 8
        elif p["paragraph_status"] == "warn":
            lost += (min(5, (10 - p["paragraph_min"]) * 2) if p["paragraph_min"] < 10 else 0) + min(3, p["paragraph_long"])
        return {"v2_clarity": max(0, 20 - lost)}

    @cached_property
    def score(self) -> dict:
        dims = S.PROFILES.get(self.profiled["profile"], S.DIMENSIONS)
        score = int(sum(getattr(self, f"{k}2")[f"v2_{k}"] for k in dims) / (20 * len(dims)) * 100 + 0.5)
        return {"v2_score": score, "band": next((b for least, b in ((85, "production-ready"), (65, "solid"), (45, "needs-work")) if score >= least), "at-risk")}


#: The group of each figure.
_GROUP = {f: g for g, listed in {
    "base": "status", "markup": "is_html", "stats": "stat_total stat_sourced", "quotes": "quote_total quote_found quote_attributed", "attribution": "attribution_status", "heads": "heading_count heading_skips heading_repeats starts_late heading_status",
    "sections": "section_headers thin_headers section_count section_thin section_status", "paragraphs": "paragraph_count paragraph_min paragraph_max paragraph_median paragraph_long paragraph_status", "opening": "intro intro_words intro_defines answer_status",
    "dates": "published reviewed fresh_status", "links": "external internal link_count", "sources": "sources_section", "words": "word_count", "farm": "link_farm link_status", "semantics": "semantic_count semantic_status v1_unsemantic v1_dynamic",
    "structure1": "v1_answer v1_tables v1_lists v1_headers v1_structure", "statistics1": "stat_count v1_statistics", "quotations1": "quote_count v1_quotations", "citations1": "has_sources v1_citations", "pronouns1": "pronoun_share pronoun_points",
    "acronyms1": "unexplained acr_unexplained", "clarity1": "v1_clarity", "total1": "v1_total", "profiled": "overridden profile confidence", "structure2": "v2_structure", "statistics2": "v2_statistics", "quotations2": "v2_quotations",
    "citations2": "v2_citations", "pronouns2": "v2_pronoun_points", "acronyms2": "acr2_unexplained", "clarity2": "v2_clarity", "score": "v2_score band",
}.items() for f in listed.split()}


def document(content: str, path: str = "", s: Settings = Settings(), keep: Sequence[str] | None = None, maybe: Collection[str] = tuple(S.PROFILE_SIGNALS)) -> dict:
    """All figures of one document by name, or those to keep; maybe: the profiles that it can have signals of, if that is known."""
    read = _Read(content, path, s, maybe)
    return {x: getattr(read, _GROUP[x])[x] for x in (_GROUP if keep is None else keep)}


def audited(df: DataFrame, keys: Sequence[str] = ("doc_id", "path"), content: str = "content", path: str = "path", settings: Settings = Settings(), keep: Sequence[str] | None = None) -> DataFrame:
    """The keys and the figures of every row; keep: only these figures are made, and what they need."""
    names = [*INTS, *FLAGS, *TEXTS, *REALS, *LISTS]
    keys = [k for k in keys if k in df.columns]
    if taken := [k for k in keys if k in names]:
        raise ValueError(f"keys are called like figures: {', '.join(taken)}")
    names = [x for x in names if keep is None or x in keep]
    figures = _parse_datatype_string(SCHEMA)
    kind = StructType([*(df.schema[k] for k in keys), *(figures[x] for x in names)])
    target = to_arrow_schema(kind)
    judged = bool({"profile", "confidence", "v2_score", "band"} & {*names})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))
        last: tuple = ()
        for b in batches:
            for part in slices(b, len(keys)):
                contents, paths = part.column(len(keys)), part.column(len(keys) + 1)
                maybe = possible(contents) if judged else [()] * part.num_rows
                rows = []
                for c, p, m in zip(contents.to_pylist(), paths.to_pylist(), maybe):
                    if last[:2] != (c, p):  # a row that repeats the one before isn't read again
                        last = (c, p, {"status": "error"} if c is None else document(c, p or "", settings, names, m))
                    rows.append(last[2])
                yield pa.RecordBatch.from_arrays([*(part.column(j).cast(target.field(j).type) for j in range(len(keys))), *(pa.array([r.get(x) for r in rows], target.field(x).type) for x in names)], schema=target)

    return df.selectExpr(*(f"`{k}`" for k in keys), f"CAST({content} AS STRING) AS __content", f"CAST({path} AS STRING) AS __path").mapInArrow(run, kind)
