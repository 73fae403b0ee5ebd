"""Patterns that the detectors share, in the portable subset of regular expressions."""

from __future__ import annotations

from ..functions import text as T

HEADING = r"(?m)^#{1,6}[ \t]+[^\n]*$"
_said = lambda *x: T.any_of(*x, space=r"\s+")
SOURCE = rf"(?i){_said('data from', 'survey by', 'reported by', 'according to', 'study by', 'study published', 'published in', 'published by')}|via\s+|source:|\(\d{{4}}\)|\[[\d,\s]*\]"
_DASH = r"[\x{2014}\x{2013}-]"
_NAME = r"[A-Z][a-z]+"
_TITLE = T.any_word(r"Ms\. Mrs\. Mr\. Prof\. Dr\.")
_BODY = T.any_word(r"Survey Study Report LLC Inc\.? Corporation Association Foundation University Institute")
ATTRIBUTION = (
    "|".join((rf"{_DASH}\s*{_NAME}\s+{_NAME}", rf"{_DASH}\s*{_TITLE}\s+{_NAME}", rf"said\s+{_NAME}\s+{_NAME}", rf"writes?\s+{_NAME}\s+[A-Z]")),
    "(?i)" + "|".join((rf"according\s+to\s+{_NAME}", r"told\s+the\s+", rf"{_said('per', 'reported by', 'according to')}\s+(?:the\s+)?{_NAME}(?:\s+{_NAME})*\s+{_BODY}")),
)
IDENTIFIERS = tuple("code status issue commit branch build release node api ids id endpoint port versions version v".split())
IDENTIFIER = rf"(?i)v$|\b{T.any_of(*IDENTIFIERS)}\b\s*:?\s*$"
QUOTED_LINE, QUOTED_TEXT = r"(?m)^>\s*[^\n]+$", r"[\x22\x{201C}][^\x22\x{201D}]{15,}[\x22\x{201D}]"
STOP = tuple("AND BUT FOR HOW NOT OFF OUR OUT THE WHO WHY YES YOU".split())
SEMANTIC = tuple("section nav footer header main article".split())
_LISTS = "bibliography citations references sources".split()
KEYWORDS = f"(?i){T.any_of(*_LISTS, 'further reading', space=' ')}"
