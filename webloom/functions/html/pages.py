"""Text, Markdown, metadata, links and articles of parsed pages, and the Arrow
functions that run a compiled extraction over a column of pages."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from datetime import datetime, timezone
from typing import Any
from urllib.parse import unquote, urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.html import selectors
from webloom.functions.html.dom import BLOCKS, Node, parse
from webloom.functions.values import chain

SKIPPED = frozenset("script style noscript template svg head nav footer aside form".split())


def to_text(root: Node, selector: str | None = None, path: str | None = None, own: bool = False) -> str | None:
    """The matches' text pieces, stripped and joined by blanks; null if empty. Texts directly
    within a match of a CSS selector are left out, as ``css *::text`` does, unless ``own``
    is set; selectors of texts or attributes and XPath take all."""
    if path:
        parts = selectors.xpath(root, path if path.endswith("text()") else path + "//text()")
    elif selector and "::" in selector:
        parts = selectors.css(root, selector)
    else:
        parts = [t for n in selectors.css_nodes(root, selector) for t in n.texts(own)]
    joined = " ".join(p.strip() for p in parts if p.strip())
    return joined or None


def to_markdown(node: Node) -> str:
    """ATX headings, emphasis, links, lists, quotes and code of an element."""

    def inline(n: Node) -> str:
        out = ""
        for c in n.children:
            if isinstance(c, str):
                out += re.sub(r"\s+", " ", c)
            elif c.tag in SKIPPED - {"nav", "footer", "aside", "form"}:
                continue
            elif c.tag in ("b", "strong"):
                out += f"**{inline(c).strip()}**"
            elif c.tag in ("i", "em"):
                out += f"*{inline(c).strip()}*"
            elif c.tag == "code":
                out += f"`{c.text()}`"
            elif c.tag == "a" and c.attrs.get("href"):
                out += f"[{inline(c).strip()}]({c.attrs['href']})"
            elif c.tag == "img":
                out += f"![{c.attrs.get('alt', '')}]({c.attrs.get('src', '')})"
            elif c.tag == "br":
                out += "  \n"
            else:
                out += inline(c)
        return out

    def block(n: Node, depth: int = 0) -> list[str]:
        if depth > 200:
            return [n.text().strip()]
        if re.fullmatch(r"h[1-6]", n.tag):
            return ["#" * int(n.tag[1]) + " " + inline(n).strip()]
        if n.tag == "pre":
            return ["```\n" + n.text().strip("\n") + "\n```"]
        if n.tag in ("ul", "ol"):
            items = [c for c in n.children if isinstance(c, Node) and c.tag == "li"]
            return ["\n".join(f"{'*' if n.tag == 'ul' else f'{i}.'} {inline(c).strip()}" for i, c in enumerate(items, 1))]
        if n.tag == "blockquote":
            return ["> " + "\n\n".join(b for c in [n] for b in inside(c, depth)).replace("\n", "\n> ")]
        return inside(n, depth)

    def inside(n: Node, depth: int) -> list[str]:
        out, run = [], Node("span")

        def close() -> None:
            if text := inline(run).strip():
                out.append(text)
            run.children.clear()

        for c in n.children:
            if isinstance(c, Node) and (c.tag in BLOCKS or c.tag in ("li", "body", "html")):
                close()
                out.extend(block(c, depth + 1))
            else:
                run.children.append(c)
        close()
        return [b for b in out if b.strip()]

    return "\n\n".join(block(node))


def _json_ld(root: Node) -> list[Any]:
    out = []
    for n in root.walk():
        if n.tag == "script" and n.attrs.get("type", "").lower() == "application/ld+json":
            try:
                out.append(json.loads(n.text()))
            except ValueError:
                continue
    return out


def _first(root: Node, test) -> str | None:
    return next((v for n in root.walk() if (v := test(n))), None)


def meta_date(root: Node) -> str | None:
    """The publication time in UTC (ISO): Open Graph, JSON-LD, microdata, meta, the
    first ``<time>``. A source that cannot be read gives null; none follows it."""
    from dateutil import parser

    from webloom.functions.records import find_key

    raw = _first(root, lambda n: n.tag == "meta" and n.attrs.get("property") == "article:published_time" and n.attrs.get("content"))
    raw = raw or next((v for j in _json_ld(root) if isinstance(v := find_key(j, "datePublished"), str)), None)
    raw = raw or _first(root, lambda n: n.attrs.get("itemprop") == "datePublished" and (n.attrs.get("content") or n.attrs.get("datetime") or n.text().strip()))
    raw = raw or _first(root, lambda n: n.tag == "time" and n.attrs.get("datetime"))
    if not raw:
        return None
    try:
        return _utc(parser.parse(raw.strip()))
    except (ValueError, OverflowError):
        return None


def _utc(when: datetime) -> str:
    """A time in UTC; one without zone is taken as UTC."""
    when = when.replace(tzinfo=timezone.utc) if when.tzinfo is None else when.astimezone(timezone.utc)
    return when.strftime("%Y-%m-%dT%H:%M:%S")


def author_names(value: Any) -> str | None:
    """A name, an object with a name or a list of them as ``A, B``; URLs are no names."""
    values = value if isinstance(value, list) else [value]
    names = [(v.get("name") if isinstance(v, dict) else v) for v in values]
    kept = dict.fromkeys(n.strip() for n in names if isinstance(n, str) and n.strip() and not n.strip().startswith("http"))
    return ", ".join(kept) or None


def meta_author(root: Node) -> str | None:
    from webloom.functions.records import find_key

    for j in _json_ld(root):
        if (found := find_key(j, "author")) and (names := author_names(found)):
            return names
    return author_names([n.attrs.get("content") or n.text() for n in root.walk() if n.attrs.get("itemprop") == "author"])


def media(root: Node) -> dict[str, list[dict[str, str]]]:
    nodes = list(root.walk())
    return {
        "images": [{"src": n.attrs["src"], "alt": n.attrs.get("alt", "")} for n in nodes if n.tag == "img" and n.attrs.get("src")],
        "videos": [{"src": n.attrs["src"], "type": n.tag} for n in nodes if n.tag in ("video", "iframe") and n.attrs.get("src")],
    }


def links(root: Node, base: str = "", within: str | list[str] | None = None, paths: list[str] | None = None, tags: tuple[str, ...] = ("a", "area")) -> list[str]:
    """The distinct targets of links, absolute, in order; optionally within the regions of
    CSS selectors or XPaths."""
    tops = [root]
    if within or paths:
        chosen = [within] if isinstance(within, str) else list(within or [])
        tops = [n for s in chosen for n in selectors.css_nodes(root, s)] + [n for p in paths or [] for n in selectors.xpath_nodes(root, p)]
    found = [n.attrs["href"].strip() for t in tops for n in [t, *t.walk()] if n.tag in tags and n.attrs.get("href", "").strip()]
    return list(dict.fromkeys(urljoin(base, h) for h in found))


def pdf_links(root: Node, base: str) -> list[dict[str, str]]:
    """PDF targets with the titles their file names give."""
    found = [u for u in links(root, base, tags=("a",)) if re.sub(r"[?#].*", "", u).lower().endswith(".pdf")]
    return [{"url": u, "title": unquote(re.sub(r"[?#].*", "", u).rsplit("/", 1)[-1]) or u} for u in found]


def pdf_items(root: Node, base: str) -> list[dict[str, Any]]:
    """Items of the PDFs a page links to, known by their addresses alone."""
    return [link | {"content": "", "metadata": {"content_type": "pdf", "found_on": base}} for link in pdf_links(root, base)]


def title_hint(root: Node) -> str | None:
    """The text of the page's first title tag."""
    return _first(root, lambda n: n.tag == "title" and n.text())


def _densest(root: Node) -> Node | None:
    """The element whose own paragraphs hold most text, links counting against it."""
    best, score = None, 0.0
    for n in root.walk():
        if n.tag in SKIPPED or n.tag not in ("article", "main", "div", "section", "body", "td"):
            continue
        paragraphs = [c for c in n.children if isinstance(c, Node) and c.tag in ("p", "h2", "h3", "blockquote", "ul", "ol", "pre")]
        length = sum(len(c.text()) for c in paragraphs)
        linked = sum(len(a.text()) for c in paragraphs for a in c.walk() if a.tag == "a")
        own = length - 2 * linked + (50 if n.tag in ("article", "main") and length else 0)
        if own > score:
            best, score = n, own
    return best


def _metas(root: Node) -> dict[str, list[str]]:
    """The contents of meta tags by name or property."""
    out: dict[str, list[str]] = {}
    for n in root.walk():
        if n.tag == "meta" and n.attrs.get("content"):
            out.setdefault((n.attrs.get("property") or n.attrs.get("name") or "").lower(), []).append(n.attrs["content"])
    return out


#: What an article record holds; metadata, images and videos are JSON in columns.
ARTICLE = ("title", "content", "author", "published_date", "source", "metadata", "markdown", "top_image", "images", "videos", "html")


def article(root: Node, hint: str | None = None) -> dict[str, Any]:
    """Title, text, author, date, Markdown, media and metadata of the page's densest part."""
    title = _first(root, lambda n: n.tag == "h1" and n.text().strip()) or _first(root, lambda n: n.tag == "title" and n.text().strip()) or (hint or "").strip() or None
    best, text = _densest(root), None
    if best is not None:
        parts = [re.sub(r"\s+", " ", c.text()).strip() for c in best.children if isinstance(c, Node) and c.tag not in SKIPPED]
        text = "\n\n".join(p for p in parts if p) or None
    metas = _metas(root)
    first = lambda *names: next((metas[n][0] for n in names if n in metas), None)
    own = media(best) if best is not None else {"images": [], "videos": []}
    return {
        "title": title,
        "content": text,
        "author": meta_author(root),
        "published_date": meta_date(root),
        "metadata": {
            "description": first("description", "og:description"),
            "sitename": first("og:site_name"),
            "categories": metas.get("article:section", []),
            "tags": metas.get("article:tag", []),
            "keywords": [k.strip() for v in metas.get("keywords", []) for k in v.split(",") if k.strip()],
            "fingerprint": hashlib.sha256(text.encode()).hexdigest()[:16] if text else None,
            "license": _first(root, lambda n: n.tag in ("a", "link") and "license" in n.attrs.get("rel", "").split() and n.attrs.get("href")),
        },
        "markdown": to_markdown(best) if best is not None else None,
        "top_image": first("og:image"),
        **own,
    }


def _strict(root: Node, hint: str | None) -> dict[str, Any] | None:
    """An article with title and text; images of the whole page follow those of its body."""
    got = article(root, hint)
    seen = {i["src"] for i in got["images"]}
    others = [{"src": i["src"], "alt": ""} for i in media(root)["images"] if not (i["src"] in seen or seen.add(i["src"]))]
    meta = got["metadata"]
    return got | {"images": got["images"] + others, "metadata": {"keywords": meta["keywords"], "summary": meta["description"] or ""}} if got["title"] and got["content"] else None


def _text_only(root: Node, hint: str | None) -> dict[str, Any] | None:
    """An article with text; a missing title is empty."""
    got = article(root, hint)
    meta = {k: v for k, v in got["metadata"].items() if k != "keywords"}
    return got | {"title": got["title"] or "", "metadata": meta} if got["content"] else None


def _by_selectors(root: Node, hint: str | None, chosen: dict[str, str]) -> dict[str, Any] | None:
    """Title and text by selectors; author and date from the page's metadata where theirs
    find none; other selectors that find something are metadata."""
    from dateutil import parser

    def one(name: str) -> str | None:
        found = selectors.css_nodes(root, chosen[name])[:1] if chosen.get(name) else []
        return " ".join(p.strip() for n in found for p in n.texts() if p.strip()) or None

    title, content, stamp = one("title") or (hint or "").strip() or None, one("content"), one("date")
    if not title or not content:
        return None
    when = None
    for fuzzy in (False, True):
        if stamp and when is None:
            try:
                when = parser.parse(stamp, fuzzy=fuzzy)
            except (ValueError, OverflowError):
                continue
    extra = {f: v for f in chosen if f not in ("title", "author", "content", "date") and (v := one(f))}
    return {"title": title, "content": content, "author": one("author") or meta_author(root), "published_date": _utc(when) if when else meta_date(root), "metadata": extra, "markdown": None, "top_image": None, "images": [], "videos": []}


# The names of strategies in configurations; rendered pages are recorded, so
# theirs is the text strategy.
STRATEGIES = {"trafilatura": _text_only, "newspaper": _strict, "playwright": _text_only}
SOURCES = {"newspaper": "newspaper4k", "playwright": "trafilatura"}
DEFAULT_ORDER = ("trafilatura", "newspaper")


def first_accepted(root: Node, order: tuple[str, ...] | list[str] = DEFAULT_ORDER, hint: str | None = None, chosen: dict[str, str] | None = None) -> dict[str, Any] | None:
    """The record of the first strategy that accepts the page; ``custom`` takes selectors
    and is skipped without them, unknown names are skipped."""
    hint = hint or title_hint(root)
    for name in order:
        if name == "custom":
            got = _by_selectors(root, hint, chosen) if chosen else None
        else:
            got = STRATEGIES[name](root, hint) if name in STRATEGIES else None
        if got:
            return got | {"source": SOURCES.get(name, name)}
    return None


def compared(root: Node) -> dict[str, Any]:
    """Two strategies side by side: length and start of their texts, with the page's own date
    and author."""
    out: dict[str, Any] = {"date": meta_date(root), "author": meta_author(root)}
    for name in DEFAULT_ORDER:
        got = first_accepted(root, (name,))
        out[name] = {"title": got["title"], "length": len(got["content"]), "preview": got["content"][:300]} if got else None
    return out


def nested(root: Node, config: dict[str, Any], depth: int = 0) -> list[dict[str, Any]]:
    """Rows under ``selector``, each with the fields of ``extract`` run through their
    processors; below three levels, and without either, nothing."""
    if depth >= 3 or not config.get("selector") or not config.get("extract"):
        return []
    return [
        {name: nested(n, f, depth + 1) if f.get("type") == "nested_list" else chain(field(n, f), f.get("processors") or []) for name, f in config["extract"].items()}
        for n in selectors.css_nodes(root, config["selector"])
    ]


def nested_under(rows: list[dict[str, Any]], key: str = "comment_id", parent: str = "parent_id", replies: str = "replies") -> list[dict[str, Any]]:
    """Rows with those that answer them in ``replies``; rows without a known parent are left
    at the top, rows without a key get no replies."""
    by = {r[key]: r for r in rows if r.get(key) is not None}
    for r in by.values():
        r[replies] = []
    top = []
    for r in rows:
        above = by.get(r[parent]) if r.get(parent) else None
        (top if above is None else above[replies]).append(r)
    return top


def field(root: Node, config: dict[str, Any], depth: int = 0) -> Any:
    """One field of a page: nested rows, text, Markdown, all or the first value."""
    if config.get("type") == "nested_list":
        rows = nested(root, config, depth)
        return nested_under(rows, *(config.get(k) or d for k, d in (("comment_id_field", "comment_id"), ("parent_id_field", "parent_id"), ("replies_field", "replies")))) if config.get("nest_replies") else rows
    css_, path = config.get("css"), config.get("xpath")
    if not css_ and not path:
        return None
    if config.get("to_text"):
        return to_text(root, css_, None if css_ else path, bool(config.get("own_text")))
    if config.get("to_markdown"):
        found = selectors.css_nodes(root, css_) if css_ else selectors.xpath_nodes(root, path)
        return to_markdown(found[0]) if found else None
    values = selectors.css(root, css_) if css_ else selectors.xpath(root, path)
    return values if config.get("get_all") else (values[0] if values else None)


def _plain(value: Any) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def extract(html: Column, fields: dict[str, dict[str, Any]], reader: dict[str, Any] | None = None) -> Column:
    """A struct with one text a field (lists and rows as JSON) from each page. With a
    ``reader`` (order, selectors, include_html) also the parts of an article, as
    ``a_title`` and so on, all null where no strategy accepts the page. The page is parsed once."""
    names = list(fields)
    parts = [f"a_{p}" for p in ARTICLE] if reader is not None else []

    @F.pandas_udf(", ".join(f"`{n}` string" for n in [*names, *parts]))
    def run(pages: pd.Series) -> pd.DataFrame:
        out: dict[str, list] = {n: [] for n in [*names, *parts]}
        for html in pages:
            root = parse(html)
            for n in names:
                out[n].append(_plain(field(root, fields[n])))
            if reader is not None:
                got = first_accepted(root, reader.get("order") or DEFAULT_ORDER, None, reader.get("selectors")) or {}
                got = got | {"html": html if got and reader.get("include_html") else None}
                for p in ARTICLE:
                    out[f"a_{p}"].append(_plain(got.get(p)))
        return pd.DataFrame(out, dtype=object)

    return run(html)


def articles(html: Column, order: tuple[str, ...] = DEFAULT_ORDER, chosen: dict[str, str] | None = None, include_html: bool = False) -> Column:
    """A struct of ``ARTICLE`` for each page, all null where no strategy accepts it."""
    got = extract(html, {}, {"order": list(order), "selectors": chosen, "include_html": include_html})
    return F.get(F.transform(F.array(got), lambda x: F.struct(*[x[f"a_{p}"].alias(p) for p in ARTICLE])), F.lit(0))


def per_page(html: Column, make: Callable[[Node], Any], kind: str = "string") -> Column:
    """What a function of the parsed page gives, as JSON where it is no text."""

    @F.pandas_udf(kind)
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([_plain(make(parse(p))) for p in pages], dtype=object)

    return run(html)


def listing(url: Column, html: Column, config: dict[str, Any]) -> Column:
    """An array of JSON rows for the rows of a listing page that name a page to follow: its
    absolute address as ``follow_url``, and the row's fields."""
    rows, follow, fields = config["iterate"]["selector"], config["iterate"]["follow"]["url"], config.get("extract") or {}

    @F.pandas_udf("array<string>")
    def run(urls: pd.Series, pages: pd.Series) -> pd.Series:
        out = []
        for url, page in zip(urls, pages):
            own = []
            for n in selectors.css_nodes(parse(page), rows):
                if target := field(n, follow):
                    values = {name: field(n, f) if f.get("type") == "nested_list" else chain(field(n, f), f.get("processors") or []) for name, f in fields.items()}
                    own.append(json.dumps({"follow_url": urljoin(url or "", target), "fields": values}, ensure_ascii=False))
            out.append(own)
        return pd.Series(out, dtype=object)

    return run(url, html)


def page_links(url: Column, html: Column, within: str | list[str] | None = None, paths: list[str] | None = None, tags: tuple[str, ...] = ("a", "area")) -> Column:
    @F.pandas_udf("array<string>")
    def run(urls: pd.Series, pages: pd.Series) -> pd.Series:
        return pd.Series([links(parse(p), u or "", within, paths, tags) for u, p in zip(urls, pages)], dtype=object)

    return run(url, html)


def found_by_text(root: Node, needle: str, limit: int = 8) -> list[dict[str, str]]:
    """The tightest elements below 200 characters that hold a text, once a selector."""
    want = needle.strip().lower()
    hits = [(len(t), n, t) for n in root.walk() if (t := re.sub(r"\s+", " ", n.text()).strip()) and len(t) < 200 and want in t.lower()]
    out: dict[str, str] = {}
    for _, n, t in sorted(hits, key=lambda h: h[0]):
        out.setdefault(selector_for(n), t[:120])
    return [{"selector": s, "text": t} for s, t in list(out.items())[:limit]]


def selector_for(node: Node) -> str:
    if node.attrs.get("id"):
        return f"{node.tag}#{node.attrs['id']}"
    return ".".join([node.tag, *node.classes])


def found_by_keyword(root: Node, keyword: str, limit: int = 10) -> list[dict[str, str]]:
    """Elements below 200 characters whose class or id holds a keyword."""
    want = keyword.lower()
    out = []
    for n in root.walk():
        name = f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}".lower()
        text = re.sub(r"\s+", " ", n.text()).strip()
        if want in name and text and len(text) < 200:
            out.append({"selector": selector_for(n), "text": text})
    return out[:limit]


def structure(root: Node) -> dict[str, Any]:
    """What a page offers to selectors: headings, the largest containers, dates, authors."""
    nodes = list(root.walk())
    text = {id(n): re.sub(r"\s+", " ", n.text()).strip() for n in nodes}
    named = lambda n, *words: any(w in f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}".lower() for w in words)
    containers = [n for n in nodes if (n.tag in ("article", "main") or named(n, "content", "article", "body", "post", "text")) and len(text[id(n)]) > 200]
    return {
        "h1": [text[id(n)] for n in nodes if n.tag == "h1"][:5],
        "h2": [text[id(n)] for n in nodes if n.tag == "h2"][:5],
        "containers": [{"selector": selector_for(n), "characters": len(text[id(n)])} for n in sorted(containers, key=lambda n: -len(text[id(n)]))[:5]],
        "dates": [{"selector": selector_for(n), "text": text[id(n)]} for n in nodes if (n.tag == "time" or named(n, "date", "time", "publish")) and 0 < len(text[id(n)]) < 50][:5],
        "authors": [{"selector": selector_for(n), "text": text[id(n)]} for n in nodes if named(n, "author", "byline") and 0 < len(text[id(n)]) < 100][:5],
    }
