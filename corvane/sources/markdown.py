"""Markdown as a tree of blocks with their links: what the structural detectors and the plain-text renderer walk.

Blocks: headings (with '#' or underlined), paragraphs, lists, quotations, tables, code, raw markup, rules. Inline: links and images
(inline, by reference, in angle brackets, bare addresses), code spans. A block's nesting is that of its lines; nothing is rendered.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.text import word_count as words

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})[ \t]*([^`]*)$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_UNDER = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_QUOTE = re.compile(r" {0,3}> ?")
_ITEM = re.compile(r"( {0,3})([-*+]|\d{1,9}[.)])([ \t]+|$)")
_MARKUP = re.compile(r" {0,3}<(?:/?[A-Za-z][A-Za-z0-9-]*[\s/>]|/?[A-Za-z][A-Za-z0-9-]*$|!--|\?|![A-Z])")
_CELLS = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_TARGET = re.compile(r" {0,3}\[([^\]]+)\]:[ \t]*<?(\S+?)>?(?:[ \t]+[\"'(].*)?[ \t]*$")

_CODE = re.compile(r"(?<!`)(`+)(?!`)(.*?)(?<!`)\1(?!`)", re.S)
_INLINE = re.compile(r"(!?)\[((?:\\.|!?\[(?:\\.|[^\[\]\\])*\](?:\([^()]*\))?|[^\[\]\\])*)\]\(\s*(?:<([^<>\n]*)>|((?:\\.|[^\s()\\]|\((?:\\.|[^\s()\\])*\))*))(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*\)")
_NAMED = re.compile(r"(!?)\[((?:\\.|[^\[\]\\])+)\](?:\[([^\]]*)\])?(?!\()")
_ANGLE = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.+-]+@[\w-]+(?:\.[\w-]+)+)>")
_BARE = re.compile(r"(?<![\w/.@+-])(?:https?://|www\.)[^\s<]*[^\s<?!.,:*_~'\")]|(?<![\w/.+-])[\w.+-]+@[\w-]+(?:\.[\w-]*[A-Za-z0-9])+(?![-_])")


@dataclass
class Block:
    kind: str
    text: str = ""
    level: int = 0
    blocks: list[Block] = field(default_factory=list)
    rows: list[list[str]] = field(default_factory=list)
    line: int = 0


def _cells(line: str) -> list[str]:
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", re.sub(r"(?<!\\)\|$", "", line.strip().removeprefix("|")))]


DEEPEST = 60  # levels of nested quotations and lists that are told apart


def parsed(text: str, targets: dict[str, str] | None = None, first: int = 0, depth: int = 0) -> list[Block]:
    """The blocks of a text; reference targets that it defines are added to targets."""
    out: list[Block] = []
    lines = text.split("\n")
    targets = {} if targets is None else targets
    n, i = len(lines), 0
    open_: Block | None = None  # a paragraph that may go on
    while i < n:
        line = lines[i].rstrip("\r").expandtabs(4) if "\t" in lines[i] else lines[i].rstrip("\r")
        bare = line.strip()
        if not bare:
            open_ = None
            i += 1
            continue
        head = bare[0]
        if open_ is not None and head in "=-" and (m := _UNDER.match(line)):
            open_.kind, open_.level, open_ = "heading", 1 if m[1][0] == "=" else 2, None
            i += 1
            continue
        if open_ is None and line.startswith("    "):
            code = []
            while i < n and (lines[i].startswith("    ") or not lines[i].strip()):
                code.append(lines[i][4:])
                i += 1
            out.append(Block("code", "\n".join(code).strip("\n"), line=first + i - len(code)))
            continue
        if head == "#" and (m := _ATX.match(line)):
            out.append(Block("heading", (m[2] or "").strip(), len(m[1]), line=first + i))
            open_ = None
        elif head in "`~" and (m := _FENCE.match(line)):
            fence, code, at = m[1], [], i
            i += 1
            while i < n and not re.match(rf" {{0,3}}{re.escape(fence[0])}{{{len(fence)},}}[ \t]*$", lines[i]):
                code.append(lines[i])
                i += 1
            out.append(Block("code", "\n".join(code), line=first + at))
            open_ = None
        elif head in "*-_" and _RULE.match(line):
            out.append(Block("rule", line=first + i))
            open_ = None
        elif head == ">" and depth < DEEPEST and _QUOTE.match(line):
            at, inner = i, []
            while i < n and lines[i].strip() and (_QUOTE.match(lines[i]) or (inner and inner[-1].strip() and not _starts(lines[i]))):
                inner.append(_QUOTE.sub("", lines[i], count=1))
                i += 1
            out.append(Block("quote", "\n".join(inner), blocks=parsed("\n".join(inner), targets, first + at, depth + 1), line=first + at))
            open_ = None
            continue
        elif depth < DEEPEST and (m := _ITEM.match(line)) and (open_ is None or m[3] and (m[2] in "-*+" or m[2][:-1] == "1") and line[m.end() :].strip()):
            i, block = _list(lines, i, targets, first, depth)
            out.append(block)
            open_ = None
            continue
        elif open_ is None and head == "[" and (m := _TARGET.match(line)):
            targets.setdefault(m[1].lower(), m[2])
        elif head == "<" and (open_ is None or re.match(r" {0,3}</?(?:address|article|aside|blockquote|body|center|details|dialog|div|dl|dt|dd|fieldset|footer|form|h[1-6]|head|header|hr|html|li|link|main|meta|nav|ol|p|pre|script|section|style|summary|table|td|th|tr|ul)[\s/>]", line, re.I)) and _MARKUP.match(line):
            at = i
            while i < n and lines[i].strip():
                i += 1
            out.append(Block("markup", "\n".join(lines[at:i]), line=first + at))
            open_ = None
            continue
        elif "|" in line and i + 1 < n and "-" in lines[i + 1] and _CELLS.match(lines[i + 1]) and len(_cells(line)) == len(_cells(lines[i + 1])):
            at, rows = i, [_cells(line)]
            i += 2
            while i < n and lines[i].strip() and not _starts(lines[i]) and not _MARKUP.match(lines[i]):
                rows.append(_cells(lines[i]))
                i += 1
            out.append(Block("table", rows=rows, line=first + at))
            open_ = None
            continue
        elif open_ is not None:
            open_.text += "\n" + bare
        else:
            open_ = Block("paragraph", bare, line=first + i)
            out.append(open_)
        i += 1
    return out


def _starts(line: str) -> bool:
    """Whether a line begins a block of its own and so ends a paragraph."""
    return bool(_ATX.match(line) or _FENCE.match(line) or _RULE.match(line) or _QUOTE.match(line) or ((m := _ITEM.match(line)) and m[3]))


def _list(lines: list[str], i: int, targets: dict[str, str], first: int, depth: int) -> tuple[int, Block]:
    out, n = Block("list", line=first + i), len(lines)
    mark = _ITEM.match(lines[i])[2][-1]
    while i < n:
        line = lines[i].expandtabs(4)
        m = _ITEM.match(line)
        if not m or m[2][-1] != mark or _RULE.match(line):
            break
        indent, at = m.end() if len(m[3]) <= 4 and m[3] else len(m[1]) + len(m[2]) + 1, i
        inner = [line[indent:] if m[3] else ""]
        i += 1
        blank = False
        while i < n:
            raw = lines[i].expandtabs(4) if "\t" in lines[i] else lines[i]
            if not raw.strip():
                blank = True
                inner.append("")
            elif raw.startswith(" " * indent):
                inner.append(raw[indent:])
                blank = False
            elif blank or _starts(raw):
                break
            else:
                inner.append(raw.strip())
            i += 1
        item = Block("item", "\n".join(inner).strip(), blocks=parsed("\n".join(inner), targets, first + at, depth + 1), line=first + at)
        out.blocks.append(item)
    return i, out


def walk(blocks: list[Block]):
    """All blocks, each before those in it."""
    for b in blocks:
        yield b
        if b.blocks:
            yield from walk(b.blocks)


@dataclass
class Link:
    target: str
    image: bool
    text: str


def links(text: str, targets: dict[str, str]) -> list[Link]:
    """Links and images of a run of text, without those in code spans; a linked image is two."""
    if "](" not in text and "://" not in text and "@" not in text and "www." not in text and not (targets and "[" in text):
        return []
    text = _CODE.sub(lambda m: " " * len(m[0]), text) if "`" in text else text
    out: list[Link] = []

    def inline(m: re.Match) -> str:
        target = m[3] if m[3] is not None else m[4]
        out.append(Link(target, m[1] == "!", m[2]))
        if "](" in m[2]:
            _INLINE.sub(inline, m[2])
        return " "

    if "](" in text:
        text = _INLINE.sub(inline, text)
    if targets and "[" in text:

        def named(m: re.Match) -> str:
            target = targets.get((m[3] or m[2]).lower())
            if target is None:
                return m[0]
            out.append(Link(target, m[1] == "!", m[2]))
            return " "

        text = _NAMED.sub(named, text)
    if "<" in text:

        def angle(m: re.Match) -> str:
            out.append(Link(m[1] if ":" in m[1] else "mailto:" + m[1], False, m[1]))
            return " "

        text = _ANGLE.sub(angle, text)
        text = re.sub(r"<[^<>]*>", " ", text)
    if "://" in text or "www." in text or "@" in text:
        for m in _BARE.finditer(text):
            t = m[0]
            out.append(Link("http://" + t if t.startswith("www.") else t if "://" in t else "mailto:" + t, False, t))
    return out


def plain(text: str) -> str:
    """A run of text without its inline marks: link and image texts, code, emphasised words stay."""
    if "](" in text:
        for _ in range(3):
            new = _INLINE.sub(lambda m: m[2], text)
            if new == text:
                break
            text = new
    if "`" in text:
        text = _CODE.sub(lambda m: m[2].strip() or m[2], text)
    text = re.sub(r"<[^<>]*>", "", text) if "<" in text else text
    text = re.sub(r"(?<![\w*])(\*{1,3}|_{1,3}|~~)(?=\S)(.+?)(?<=\S)\1(?![\w*])", r"\2", text) if "*" in text or "_" in text or "~" in text else text
    return re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", text) if "\\" in text else text


@dataclass
class Section:
    header: str
    level: int
    words: int


def _plain(b: Block, shown: dict[int, str]) -> str:
    if (t := shown.get(id(b))) is None:
        t = shown[id(b)] = plain(b.text)
    return t


def _inner(b: Block, shown: dict[int, str]) -> str:
    return _plain(b, shown) if b.kind in ("paragraph", "heading") else "".join(_inner(x, shown) for x in b.blocks) if b.blocks else b.text


def sections(blocks: list[Block]) -> list[Section]:
    """Sections by headings, wherever they are, with the words found in them: a paragraph's count as the block's and as its text's, a
    list's besides as the list's, a heading's words once; tables, code and raw markup have none. Text before the first heading is a section if it has words."""
    out = [Section("(document start)", 0, 0)]
    shown: dict[int, str] = {}  # plain texts by block: those in a list are asked for again

    def text_of(t: str) -> int:
        return words(plain(_CODE.sub(" ", t)))

    for b in walk(blocks):
        if b.kind == "heading":
            out.append(Section(_plain(b, shown), b.level, text_of(b.text) if "`" in b.text else words(_plain(b, shown))))
        elif b.kind == "paragraph":
            n = words(_plain(b, shown))
            out[-1].words += n + (text_of(b.text) if "`" in b.text else n)
        elif b.kind == "list":
            out[-1].words += words(_inner(b, shown))
    return out[1:] if len(out) > 1 and not out[0].words else out


def rendered(blocks: list[Block]) -> str:
    """Plain text of blocks: a paragraph, item or row a line, cells with dashes between, no marks."""
    out: list[str] = []
    for b in blocks:
        if b.kind in ("paragraph", "heading"):
            out.append(plain(b.text) + ("\n" if b.kind == "paragraph" else ""))
        elif b.kind == "list":
            out += [rendered(item.blocks) + "\n" for item in b.blocks]
        elif b.kind == "quote":
            out.append(rendered(b.blocks))
        elif b.kind == "table":
            out += [" - ".join(plain(c) for c in row) + "\n" for row in b.rows]
        elif b.kind == "markup":
            out.append(re.sub(r"<[^<>]+>", "", b.text))
    return re.sub(r"[ \t]+", " ", re.sub(r"<[^<>]+>", "", "".join(out))).strip()


def headed(blocks: list[Block]) -> list[tuple[str, str]]:
    """(header, body) of the top-level sections that headings of level 2 and below begin: raw texts, one block a line."""
    out: list[tuple[str, list[str]]] = []
    for b in blocks:
        if b.kind == "heading" and b.level >= 2:
            out.append((b.text, []))
        elif out and b.kind in ("paragraph", "quote", "code"):
            out[-1][1].append(b.text)
        elif out and b.kind == "list":
            out[-1][1].extend(item.text for item in b.blocks)
        elif out and b.kind == "table":
            out[-1][1].append("\n".join(" | ".join(r) for r in b.rows))
    return [(h, "\n".join(x).strip()) for h, x in out]
