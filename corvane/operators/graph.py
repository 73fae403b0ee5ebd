"""Structured data generated from documents: a graph of publisher, author and the typed nodes asked for. Nothing is inferred: what neither the
document nor the settings say is left out."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from ..sources import markdown as M
from .audit import preprocessed
from .jsonld import CONTEXT

TYPES = ("article", "news-article", "faq", "product", "course", "event", "recipe", "howto")
_LISTS = ("sources", "references", "citations", "bibliography")
_NO_STEPS = frozenset((*_LISTS[:2], "bibliography", "introduction", "overview", "summary", "conclusion"))
_BULLET, _STEP = re.compile(r"^[-*+]\s+(.+)$", re.M), re.compile(r"^\d+\.\s+(.+)$", re.M)


def named_section(content: str, *names: str) -> str:
    """The lines under the first heading of level 2 or below that has one of the names, up to the next of its level or above."""
    depth, out = 0, []
    for line in content.split("\n"):
        m = re.match(r"(#{1,6})\s+(.+)$", line)
        if m and not depth and len(m[1]) >= 2 and m[2].strip().lower() in names:
            depth = len(m[1])
            continue
        if m and depth and len(m[1]) <= depth:
            break
        if depth:
            out.append(line)
    return "\n".join(out)


def _some(**fields) -> dict:
    return {k.replace("at_", "@"): v for k, v in fields.items() if v not in (None, "")}


def graph(content: str, title: str, description: str, kinds: Sequence[str], settings: dict) -> dict:
    """The graph of one document. settings: publisher, author, datePublished, dateModified, product, course, event, recipe, howto."""
    if unknown := [k for k in kinds if k not in TYPES]:
        raise ValueError(f"unknown types: {', '.join(unknown)}")
    if "news-article" in kinds and not settings.get("datePublished"):
        raise ValueError("news-article needs datePublished")
    publisher, author = settings.get("publisher") or {}, settings.get("author") or {}
    site = str(publisher.get("url") or "").strip().rstrip("/")
    name_of = lambda part: f"{site}/#{part}" if site else None
    org = person = None
    if publisher.get("name") or site:
        org = _some(at_type="Organization", at_id=name_of("organization"), name=publisher.get("name"), url=site, logo={"@type": "ImageObject", "url": publisher["logo"]} if publisher.get("logo") else None)
    if author.get("name"):
        person = _some(at_type="Person", at_id=name_of("author"), name=author["name"], jobTitle=author.get("jobTitle"), sameAs=author.get("sameAs"))
    said = lambda node: node and ({"@id": node["@id"]} if "@id" in node else node)
    out = [n for n in (org, person) if n and "@id" in n]
    sections = M.headed(M.parsed(preprocessed(content))) if {"faq", "howto"} & set(kinds) else []
    spoken = lambda t: M.rendered(M.parsed(t))
    for kind in kinds:
        own = settings.get(kind) or {}
        if kind in ("article", "news-article"):
            out.append(_some(at_type="NewsArticle" if kind[0] == "n" else "Article", at_id=name_of("article"), headline=title, description=description, datePublished=settings.get("datePublished"), dateModified=settings.get("dateModified") if kind[0] == "n" else None, author=said(person), publisher=said(org)))
        elif kind == "faq":
            asked = [(h.strip(), b) for h, b in sections[:5] if len(b) >= 15 and h.strip().lower() not in _LISTS and h.strip().endswith("?")]
            out.append({**_some(at_type="FAQPage", at_id=name_of("faq")), "mainEntity": [{"@type": "Question", "name": h, "acceptedAnswer": {"@type": "Answer", "text": spoken(b)}} for h, b in asked]})
        elif kind == "product":
            offer = own.get("offer") or {}
            priced = _some(at_type="Offer", price=str(offer["price"]), priceCurrency=offer["priceCurrency"], availability=offer.get("availability"), seller=said(org)) if offer.get("price") is not None and offer.get("priceCurrency") else None
            out.append(_some(at_type="Product", at_id=name_of("product"), name=title, description=description, brand=said(org), offers=priced))
        elif kind == "course":
            out.append(_some(at_type="Course", at_id=name_of("course"), name=title, description=description, provider={"@type": "Organization", "name": own["provider"]} if own.get("provider") else said(org), author=said(person)))
        elif kind == "event":
            out.append(_some(at_type="Event", at_id=name_of("event"), name=title, description=description, startDate=own.get("startDate"), endDate=own.get("endDate"), location={"@type": "Place", "name": own["location"]} if own.get("location") else None, organizer=said(org)))
        elif kind == "recipe":
            how = named_section(content, "instructions", "steps", "method", "directions", "how to make")
            steps = _STEP.findall(how) or _BULLET.findall(how)
            parts = {"recipeIngredient": [x.strip() for x in _BULLET.findall(named_section(content, "ingredients", "what you'll need", "what you need"))], "recipeInstructions": [{"@type": "HowToStep", "position": i, "text": x.strip()} for i, x in enumerate(steps, 1)]}
            out.append({**_some(at_type="Recipe", at_id=name_of("recipe"), name=title, description=description, totalTime=own.get("totalTime"), recipeYield=own.get("recipeYield"), recipeCategory=own.get("recipeCategory"), author=said(person)), **parts})
        else:
            steps = [{"@type": "HowToStep", "name": h, "text": spoken(b)} for h, b in sections if h.lower() not in _NO_STEPS] or [{"@type": "HowToStep", "position": i, "text": x.strip()} for i, x in enumerate(_STEP.findall(content), 1)]
            out.append({**_some(at_type="HowTo", at_id=name_of("howto"), name=title, description=description, totalTime=own.get("totalTime"), estimatedCost=own.get("estimatedCost")), "step": steps})
    return {"@context": CONTEXT, "@graph": out}


def generated(df: DataFrame, key: str, kinds: Sequence[str], settings: dict, content: str = "content", title: str = "title", description: str = "description") -> DataFrame:
    """(key, json): the graph of every document that has a content, from its metadata (pages.metadata) and text."""
    graph("", "", "", kinds, settings)  # what is wrong with the arguments shows at once
    kind = StructType([df.schema[key], StructField("json", StringType())])
    target = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if c is None else json.dumps(graph(c, t or "", d or "", kinds, settings), ensure_ascii=False) for c, t, d in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(target.field(0).type), pa.array(out, pa.string())], schema=target)

    return df.select(key, content, title, description).mapInArrow(run, kind)
