"""Parsers that the JVM has no built-in for, over Arrow batches: markup trees, Markdown blocks, frontmatter, JSON values, readability."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame

from ..functions.text import english_syllables, spanish_syllables
from .tables import slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD_ONLY = frozenset("base link meta title script style noscript template".split())
#: Tags whose start ends an open tag of the same group within its scope.
IMPLIED = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select"})}
UNSEEN = frozenset("script style noscript meta link head".split())
ENDS_BLOCK = frozenset("p div section article header footer main nav aside h1 h2 h3 h4 h5 h6 li blockquote pre figure figcaption table tr form fieldset details summary address ol ul dl dt dd".split())
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class Tree(HTMLParser):
    """Nodes (seq, parent, depth, tag, attrs, text) of a page in document order, with html, head and body where they are missing."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.nodes: list[list] = []
        self.kids: list[list[str | int]] = []
        self.stack: list[int] = []
        for tag in ("html", "head"):
            self._open(tag, {})
        self.in_body = False
        self.feed(page)
        self.close()
        if not self.in_body:
            self._body()

    def _open(self, tag: str, attrs: dict[str, str]) -> None:
        if self.stack:
            self.kids[self.stack[-1]].append(len(self.nodes))
        self.nodes.append([len(self.nodes), self.stack[-1] if self.stack else -1, len(self.stack), tag, attrs, []])
        self.kids.append([])
        if tag not in VOID:
            self.stack.append(len(self.nodes) - 1)

    def _body(self, attrs: dict[str, str] | None = None) -> None:
        if self.in_body:
            self.nodes[self.body][4].update(attrs or {})
            return
        del self.stack[1:]
        self._open("body", attrs or {})
        self.body, self.in_body = len(self.nodes) - 1, True

    def _close(self, tags: set[str], scope: set[str]) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.nodes[self.stack[i]][3]
            if tag in scope:
                return
            if tag in tags:
                del self.stack[i:]
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        found = {k: v or "" for k, v in attrs}
        if tag in ("html", "head"):
            self.nodes[0 if tag == "html" else 1][4].update(found)
        elif tag == "body":
            self._body(found)
        else:
            if not self.in_body and tag not in HEAD_ONLY:
                self._body()
            if tag in ENDS_P:
                self._close({"p"}, {"button", "td", "th", "li", "table", "body"} - {tag})
            if tag in IMPLIED:
                self._close(*IMPLIED[tag])
            self._open(tag, found)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack and self.nodes[self.stack[-1]][3] == tag:
            self.stack.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag == "head" and not self.in_body:
            self._body()
        elif tag not in ("html", "head", "body"):
            self._close({tag}, set())

    def handle_data(self, data: str) -> None:
        if not self.in_body and data.strip() and self.nodes[self.stack[-1]][3] in ("html", "head"):
            self._body()
        self.nodes[self.stack[-1]][5].append(data)
        self.kids[self.stack[-1]].append(data)

    def text(self, node: int) -> str:
        """All text in a node."""
        return "".join(k if isinstance(k, str) else self.text(k) for k in self.kids[node])

    def find(self, *tags: str) -> list[int]:
        return [n[0] for n in self.nodes if n[3] in tags]

    def within(self, node: int) -> Iterator[int]:
        """All nodes in a node: those after it that are deeper, as nodes are in document order."""
        for k in range(node + 1, len(self.nodes)):
            if self.nodes[k][2] <= self.nodes[node][2]:
                return
            yield k

    def following(self, node: int) -> list[int]:
        """The elements after a node under the same parent."""
        beside = [k for k in self.kids[self.nodes[node][1]] if isinstance(k, int)]
        return beside[beside.index(node) + 1 :]

    def _put(self, node: int, out: list[str]) -> None:
        for k in self.kids[node]:
            if isinstance(k, str):
                out.append(k)
            elif (tag := self.nodes[k][3]) not in UNSEEN:
                self._put(k, out)
                if tag == "br":
                    out.append("\n")
                elif tag in ENDS_BLOCK:
                    out.append("\n\n")

    def visible(self) -> str:
        """Text of the body as a reader sees it: blocks end in a blank line, br in a line end."""
        out: list[str] = []
        self._put(self.body, out)
        text = re.sub(r"\n{3,}", "\n\n", "".join(out))
        return "\n".join(x.strip(" \t") for x in text.split("\n")).strip()


def _mapped(df: DataFrame, key: str, text: str, schema: str, rows: Callable[[str], list[tuple]]) -> DataFrame:
    """key and each of rows(text), one parse a text; a null text has no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for b in batches for x in slices(b, 1, 100, 1 << 20)):
            out = [(k, *r) for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if t is not None for r in rows(t)]
            columns = list(zip(*out)) or [() for _ in target]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind = StructType([df.schema[key], *_parse_datatype_string(schema).fields])
    target = to_arrow_schema(kind)
    return df.select(key, text).mapInArrow(run, kind)


def dom(df: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, seq, parent, depth, tag, attrs, text): the nodes of each page, with their own text."""
    return _mapped(df, key, html, "seq int, parent int, depth int, tag string, attrs map<string,string>, text string", lambda t: [(s, p, d, tag, list(a.items()), "".join(x)) for s, p, d, tag, a, x in Tree(t).nodes])


_BLOCKS = (("heading", re.compile(r"(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$")), ("hr", re.compile(r"[ \t]*(?:-{3,}|\*{3,}|_{3,})[ \t]*$")), ("quote", re.compile(r">[ \t]?(.*)")), ("item", re.compile(r"[ \t]*(?:[-*+]|\d+[.)])[ \t]+(.*)")), ("row", re.compile(r"\|(.*)\|[ \t]*$")))
_FENCE = re.compile(r"[ \t]*(`{3,}|~{3,})[ \t]*(\S*)")


def markdown_blocks(text: str) -> list[tuple[str, int, str, int]]:
    """(type, level, text, line) of the blocks of a Markdown text, read line by line."""
    out: list[list] = []
    fence, opened = None, False
    for i, line in enumerate(text.split("\n")):
        mark = _FENCE.match(line)
        if fence:
            if mark and line.strip().startswith(fence) and not mark[2]:
                fence = None
            else:
                out[-1][2] += line + "\n"
            continue
        if mark:
            fence, opened = mark[1], False
            out.append(["code", 0, "", i])
            continue
        if not line.strip():
            opened = False
            continue
        for kind, pattern in _BLOCKS:
            if m := pattern.match(line):
                level, body = (len(m[1]), m[2]) if kind == "heading" else (0, m[1].strip() if m.lastindex else "")
                if kind == "quote" and opened and out[-1][0] == "quote":
                    out[-1][2] += "\n" + body
                else:
                    out.append([kind, level, body, i])
                opened = kind == "quote"
                break
        else:
            if opened and out[-1][0] == "paragraph":
                out[-1][2] += "\n" + line.strip()
            else:
                out.append(["paragraph", 0, line.strip(), i])
            opened = True
    return [tuple(x) for x in out]


def tokens(df: DataFrame, key: str, text: str = "content") -> DataFrame:
    """(key, seq, type, level, text, line): the blocks of each Markdown text."""
    return _mapped(df, key, text, "seq int, type string, level int, text string, line int", lambda t: [(i, *b) for i, b in enumerate(markdown_blocks(t))])


class _Core(yaml.SafeLoader):
    """Scalars by the 1.2 core rules: yes, no and dates are text."""


_Core.yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t not in ("tag:yaml.org,2002:timestamp", "tag:yaml.org,2002:bool")] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
_Core.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))


def frontmatter_of(text: str) -> tuple[str, str]:
    """(fields as JSON, body): invalid YAML or anything but a mapping has no fields, yet is no part of the body."""
    m = re.match(r"^﻿?---[\t ]*\r?\n(?:([\s\S]*?)\r?\n)?(?:---|\.\.\.)[\t ]*(?:\r?\n|$)", text)
    if not m:
        return "{}", text
    try:
        data = yaml.load(m[1] or "", _Core)  # noqa: S506 - a safe loader
        fields = json.dumps(data if isinstance(data, dict) else {}, ensure_ascii=False, default=str)
    except (yaml.YAMLError, ValueError):
        fields = "{}"
    return fields, text[m.end() :]


def frontmatter(df: DataFrame, key: str, text: str = "content") -> DataFrame:
    """(key, fields, body); fields is JSON, to be read with variant or JSON functions."""
    return _mapped(df, key, text, "fields string, body string", lambda t: [frontmatter_of(t)])


def balanced(body: str) -> list[str]:
    """The JSON objects and arrays that a text consists of: none if it begins with anything else; an open one reaches to the end."""
    out: list[str] = []
    i, n = 0, len(body)
    while i < n:
        c = body[i]
        if c not in "{[":
            if not out and c not in " \t\n\r":
                break
            i += 1
            continue
        depth, start = 0, i
        for m in _MARKS.finditer(body, i):
            depth += 1 if m[0] in "{[" else -1 if m[0] in "}]" else 0
            i = m.end()
            if not depth:
                break
        else:
            i = n
        out.append(body[start:i])
    return out


_MARKS = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\Z)|[{}\[\]]', re.S)
_LD_FENCE = re.compile(r"```(?:jsonld|json-ld|json)\s*([\s\S]*?)\s*```", re.I)
_LD_SCRIPT = re.compile(r"<script[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>([\s\S]*?)</script>", re.I)


def ld_blocks(content: str) -> list[tuple[str, str]]:
    """(source, JSON text) of a document's JSON-LD: values with a "@context" in JSON fences, then script tags as they are."""
    out = [("fence", v) for m in _LD_FENCE.finditer(content) for v in balanced(m[1]) if '"@context"' in v] if "```" in content else []
    return out + [("script", m[1]) for m in _LD_SCRIPT.finditer(content)]


def readability(df: DataFrame, key: str, text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, words, sentence_length, flesch, grade, fog, huerta, szigriszt): English and Spanish indices, null for other languages.

    As words are joined without punctuation for them, the English indices see one sentence.
    """

    def figures(t: str, language: str | None) -> tuple:
        found = re.findall(r"[0-9A-Za-z_]+", t)
        sentences = sum(1 for s in re.split(r"[.!?]+", t) if s.strip())
        if not found or not sentences:
            return (0, 0.0, None, None, None, None, None)
        n, per = len(found), len(found) / sentences
        tag = (language or "").lower().split("-")[0]
        if tag == "en":
            syllables = [english_syllables(w) for w in found]
            each, hard = sum(syllables) / n, sum(s >= 3 for s in syllables) / n
            return (n, per, 206.835 - 1.015 * n - 84.6 * each, 0.39 * n + 11.8 * each - 15.59, 0.4 * (n + 100 * hard), None, None)
        if tag == "es":
            each = sum(spanish_syllables(w) for w in re.findall(r"[a-záéíóúü]+", " ".join(found).lower())) / n
            return (n, per, None, None, None, 206.84 - 1.02 * per - 60.0 * each, 207 - 62.3 * each - per)
        return (n, per, None, None, None, None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for b in batches for x in slices(b, 1)):
            rows = [(k, *figures(t or "", g)) for k, t, g in zip(*(c.to_pylist() for c in b.columns))]
            columns = list(zip(*rows)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], b.schema[0].type), pa.array(columns[1], pa.int64()), *[pa.array(c, pa.float64()) for c in columns[2:]]], [key, "words", "sentence_length", "flesch", "grade", "fog", "huerta", "szigriszt"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text, lang).mapInArrow(run, f"`{key}` {kind}, words bigint, sentence_length double, flesch double, grade double, fog double, huerta double, szigriszt double")
