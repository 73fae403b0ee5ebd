"""Text preparation and per-document measures, as SQL expressions over one text column in either dialect."""

from __future__ import annotations

from .dialect import Spark

FRONTMATTER = r"^\x{FEFF}?---[\t ]*\r?\n(?:[\s\S]*?\r?\n)?(?:---|\.\.\.)[\t ]*(?:\r?\n|$)"


def any_of(*phrases: str, space: str = r"\s*") -> str:
    """A group that matches any of the phrases, with any white space in place of theirs."""
    return "(?:" + "|".join(space.join(p.split(" ")) for p in phrases) + ")"


def any_word(listed: str) -> str:
    return any_of(*listed.split())


_TAGS = "a p div span section article nav main footer header ul ol li table img h[1-6] style script link meta body head"
STRUCTURAL_TAG = rf"(?i)<{any_word(_TAGS)}[\s>]"
_NUMBER, _GROUPED = r"\d+(?:\.\d+)?", r"\d\d+(?:,\d{3})*(?:\.\d+)?"
_MONEY = rf"\${_NUMBER}[kKmMbB]?"
STATISTIC = "|".join((rf"\b{_NUMBER}%", _MONEY, rf"\b{_GROUPED}\b"))
STATISTIC_V1 = "|".join((rf"\b{_NUMBER}%", _MONEY, rf"\b{_NUMBER}[xX]\b", rf"\b{_GROUPED}\b"))
_COUNTS = "one two three four five six seven eight nine ten".split()
_TEN, _FIVE, _FROM_TWO = (any_of(*x) for x in (_COUNTS, _COUNTS[:5], _COUNTS[1:]))
_PARTS = any_word("third quarter fifth sixth seventh eighth ninth tenth")
_OF = any_of("out of", "in")
VERBAL = (
    rf"(?i)\b{_TEN}\s*(?:-|\x{{2014}})\s*{_PARTS}s?\b",
    rf"(?i)\b{_FIVE}\s*-?\s*{any_word('third quarter fifth')}s?\b",
    rf"(?i)\b\d+\s*{_OF}\s*\d+\b",
    rf"(?i)\b{_TEN}\s*{_OF}\s*{_FROM_TWO}\b",
    rf"(?i)\b{any_word('half double twice triple quadruple')}\b",
    rf"(?i)\b{any_word('plurality minority majority')}\b",
)
PRONOUN = rf"(?i)\b{any_word('those these this them they it')}\b"
DEFINITIONS = tuple(f" {x} " for x in ("represents", "refers to", "is a", "is an", "is the strategic"))
DATE = r"(\d{4}(?:-\d\d){2}|\w+\s+\d\d?,?\s*\d{4})"
PUBLISHED = rf"(?i){any_word('date posted published')}\s*:?\s*{DATE}"
REVIEWED = rf"(?i)last\s*{any_word('modified reviewed updated')}\s*:?\s*{DATE}"
YEAR = r"^(?:19|20)\d{2}$"


def body(d: Spark, t: str) -> str:
    """Text without its frontmatter block, whether or not that is valid."""
    return d.sub(t, FRONTMATTER)


def preprocessed(d: Spark, t: str) -> str:
    """Body without fenced code, scripts, styles and comments."""
    out = body(d, t)
    for p in (r"```[\s\S]*?```", r"(?i)<script[\s\S]*?</script>", r"(?i)<style[\s\S]*?</style>", r"<!--[\s\S]*?-->"):
        out = d.sub(out, p)
    return out


def is_html(d: Spark, t: str) -> str:
    return f"({d.has(t, r'(?i)^\s*<!DOCTYPE\s')} OR {d.has(t, r'(?i)<html[\s>]')} OR {d.has(t, STRUCTURAL_TAG)})"


def visible(d: Spark, t: str) -> str:
    """Visible text of markup: block ends become line ends, other tags go, the common entities are resolved."""
    out = d.sub(t, r"(?i)<!--[\s\S]*?-->|<(?:script)[\s\S]*?</script>|<style[\s\S]*?</style>|<noscript[\s\S]*?</noscript>|<head[\s>][\s\S]*?</head>")
    out = d.sub(out, rf"(?i)</{any_word('h[1-6] pre blockquote table ol ul nav main footer header article section div p')}\s*>", "\n\n")
    out = d.sub(d.sub(out, r"(?i)<br\s*/?>|</(?:li|tr)\s*>", "\n"), r"<[^>]*>")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = f"replace({out}, '{a}', '{b}')"
    return d.trim(d.sub(d.sub(out, r"[ \t]*\n[ \t]*", "\n"), r"\n{3,}", "\n\n"))


def words(d: Spark, t: str) -> str:
    return d.count(t, r"\w+")


def blank_words(d: Spark, t: str) -> str:
    """Words between white space."""
    return d.count(t, r"\S+")


def truncated(d: Spark, t: str, most: int = 150) -> str:
    return f"CASE WHEN length({t}) > {most} THEN concat(substr({t}, 1, {most - 3}), '...') ELSE {t} END"


def intro(d: Spark, t: str) -> str:
    """First line that isn't blank and isn't a heading, or ''."""
    lines = d.filter(d.map(d.split(t, r"\n"), "x", d.trim("x")), "y", "y <> '' AND substr(y, 1, 1) <> '#'")
    return f"coalesce({d.at(lines, '1')}, '')"


def defines(d: Spark, t: str) -> str:
    return "(" + " OR ".join(f"contains(lower({t}), '{x}')" for x in DEFINITIONS) + ")"


def paragraph_lengths(d: Spark, t: str) -> str:
    """Words of each paragraph but headings and code."""
    parts = d.filter(d.map(d.split(t, r"\n\s*\n"), "p", d.trim("p")), "q", "q <> '' AND substr(q, 1, 1) <> '#' AND substr(q, 1, 3) <> '```'")
    return d.map(parts, "r", words(d, "r"))


def statistics_v1(d: Spark, t: str) -> str:
    return d.size(d.filter(d.every(t, STATISTIC_V1), "s", f"NOT {d.has('s', YEAR)}"))


def verbal(d: Spark, t: str) -> str:
    return "(" + " + ".join(d.count(t, p) for p in VERBAL) + ")"


def quotes_v1(d: Spark, t: str) -> str:
    """Runs of quoted lines and straight quotations of 15 characters or more."""
    return f"({d.count(t, r'(?m)^>[^\n]*(?:\n>[^\n]*)*')} + {d.count(t, r'\x22[^\x22]{15,}\x22')})"


MARKDOWN_LINK = r"!?\[[^\]]*\]\(https?://[^)\s]+[^)]*\)"
HREF_LINK = r"href=[\x22\x27]https?://[^\x22\x27]+[\x22\x27]"


def external_links(d: Spark, t: str) -> str:
    return f"({d.count(t, MARKDOWN_LINK)} + {d.count(t, HREF_LINK)})"


def internal_links(d: Spark, t: str) -> str:
    """Links (not images) whose target is not http."""
    all_links = d.count(t, r"(?:^|[^!])\[[^\]]*\]\([^)\s]+[^)]*\)")
    return f"({all_links} - {d.count(t, r'(?:^|[^!])\[[^\]]*\]\(https?://[^)\s]+[^)]*\)')})"


def density_points(d: Spark, t: str, limit: float, most: int = 15) -> str:
    """Points lost to pronouns beyond limit."""
    n, k = words(d, t), d.count(t, PRONOUN)
    share = f"({d.div(k, f'greatest({n}, 1)')})"
    return f"CASE WHEN {share} > {limit}e0 THEN least({most}, {d.floor(f'({share} - {limit}e0) * 100')}) ELSE 0 END"


BLANKS = bytes(c if c < 128 and chr(c).isalnum() or c == 95 else 32 for c in range(256))


def spaced(text: str) -> bytes:
    """The ASCII words of a text, with blanks for all else: what a pattern of words finds, at a fraction of its time."""
    return text.encode("utf-8", "surrogatepass").translate(BLANKS)


def word_count(text: str) -> int:
    return len(spaced(text).split())


def spanish_syllables(word: str) -> int:
    """Syllables of a Spanish word: two vowels are one unless both are open, one is closed with an accent, or they are equal;
    of three in a row the last two decide whether the third is taken too."""
    vowels, strong, accented = "aeiouáéíóúü", "aeoáéó", "íú"
    n, i = 0, 0

    def parted(x: str, y: str) -> bool:
        return (x in strong and y in strong) or x == y or x in accented or y in accented

    while i < len(word):
        if word[i] not in vowels:
            i += 1
            continue
        n += 1
        group = [c for c in word[i : i + 3]]
        second = len(group) > 1 and group[1] in vowels
        third = second and len(group) > 2 and group[2] in vowels
        if not second:
            i += 1
        elif third:
            i += 2 if parted(group[1], group[2]) else 3
        else:
            i += 1 if parted(group[0], group[1]) else 2
    return max(1, n)


def english_syllables(word: str) -> int:
    """Vowel groups of an English word, without a silent final e; a heuristic, as no dictionary is at hand."""
    w, n, before = word.lower(), 0, False
    for c in w:
        now = c in "aeiouy"
        n += now and not before
        before = now
    if w.endswith("e") and not w.endswith(("le", "ee")) and n > 1:
        n -= 1
    return max(1, n)
