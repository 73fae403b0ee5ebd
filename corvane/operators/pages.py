"""What a page is called, about and filed under, for link indexes and sitemaps."""

from __future__ import annotations

from ..functions import text as T
from ..functions.dialect import Spark
from ..functions.layers import Layer

#: Folder names and the section that each stands for.
FOLDERS = {
    "Documentation": "docs documentation", "API Reference": "api", "Guides": "guide guides", "Tutorials": "tutorial tutorials", "Blog": "blog", "Articles": "articles posts", "News": "news", "Reference": "reference",
    "Legal": "legal privacy terms", "About": "about", "Products": "products", "Pricing": "pricing", "Changelog": "changelog", "Releases": "releases",
}


def metadata(content: str = "content", path: str = "path") -> list[Layer]:
    """title: first-level heading, else <h1>, else the frontmatter's, else the file's name. description: first paragraph, else the
    page's meta description, cut to 150 characters. section: by the first folder that is known, else the last folder."""

    def found(d: Spark) -> dict[str, str]:
        matter = d.first(content, r"^\x{FEFF}?---[\t ]*\r?\n((?:[^\n]*\n)*?)(?:---|\.\.\.)[\t ]*(?:\r?\n|$)")
        name = d.first(path, r"([^/]*?)(?:\.[^./]*)?$")
        tests = " ".join(f"WHEN {d.has(f'lower({path})', '(?:^|/)' + T.any_word(folders) + '/')} THEN '{section}'" for section, folders in FOLDERS.items())
        body = T.body(d, content)
        heading, tag = d.trim(d.first(body, r"(?m)^#[ \t]+([^\n]+)$")), d.trim(d.sub(d.first(body, r"(?i)<h1[^>]*>([\s\S]*?)</h1>"), r"<[^>]*>"))
        meta = d.first(content, r"(?i)<meta\s+name=[\x22\x27]description[\x22\x27]\s+content=[\x22\x27]([^\x22\x27]*)[\x22\x27]")
        return {
            "title": f"coalesce(nullif({heading}, ''), nullif({tag}, ''), nullif({d.trim(d.first(matter, r'(?m)^title:[ \t]*[\x22\x27]?([^\n\x22\x27]*)'))}, ''), {name})",
            "described": f"coalesce(nullif({T.intro(d, body)}, ''), nullif({meta}, ''), '')",
            "section": f"CASE {tests} ELSE coalesce(nullif({d.first(path, r'([^/]+)/[^/]*$')}, ''), 'Pages') END",
        }

    return [found, lambda d: {"description": T.truncated(d, "described")}]
