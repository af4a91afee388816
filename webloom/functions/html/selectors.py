"""The subsets of CSS and XPath that extraction configurations use."""

from __future__ import annotations

import re

from webloom.functions.html.dom import Node, to_html

_STEP = re.compile(r"(?P<tag>[\w-]+|\*)?(?P<rest>(?:[.#][\w-]+|\[[^\]]+\]|:first-child|:last-child|:nth-child\(\d+\))*)")
_PART = re.compile(r"([.#])([\w-]+)|\[([\w-]+)(?:([~^$*|]?=)[\"']?([^\"'\]]*)[\"']?)?\]|:(first-child|last-child|nth-child)(?:\((\d+)\))?")


def _matches(node: Node, tag: str | None, parts: list[tuple]) -> bool:
    if tag and tag != "*" and node.tag != tag.lower():
        return False
    for mark, name, attr, op, value, pseudo, n in parts:
        if mark == "." and name not in node.classes:
            return False
        if mark == "#" and node.attrs.get("id") != name:
            return False
        if attr:
            own = node.attrs.get(attr)
            tests = {"": True, "=": own == value, "^=": (own or "").startswith(value), "$=": (own or "").endswith(value), "*=": value in (own or ""), "~=": value in (own or "").split(), "|=": own == value or (own or "").startswith(value + "-")}
            if own is None or not tests[op or ""]:
                return False
        if pseudo:
            kin = [c for c in node.parent.children if isinstance(c, Node)] if node.parent else [node]
            at = kin.index(node) + 1
            if not (at == 1 if pseudo == "first-child" else at == len(kin) if pseudo == "last-child" else at == int(n)):
                return False
    return True


def _compile(selector: str) -> list[tuple[str, str | None, list[tuple]]]:
    """[(combinator, tag, parts)] of one selector without pseudo-elements."""
    out, combinator = [], " "
    for token in re.findall(r"[>+~]|(?:[^\s>+~\[]|\[[^\]]*\])+", selector.strip()):
        if token in ">+~":
            combinator = token
            continue
        m = _STEP.fullmatch(token)
        if not m:
            raise ValueError(f"selector not supported: {selector}")
        out.append((combinator, m["tag"], _PART.findall(m["rest"] or "")))
        combinator = " "
    return out


def _fits(node: Node, steps: list, at: int, top: Node) -> bool:
    combinator, tag, parts = steps[at]
    if not _matches(node, tag, parts):
        return False
    if at == 0:
        return True
    if combinator == ">":
        return node.parent is not None and node.parent is not top.parent and _fits(node.parent, steps, at - 1, top)
    if combinator in "+~":
        kin = [c for c in node.parent.children if isinstance(c, Node)] if node.parent else []
        before = kin[: kin.index(node)]
        return any(_fits(k, steps, at - 1, top) for k in (before[-1:] if combinator == "+" else before))
    above = node.parent
    while above is not None and above is not top.parent:
        if _fits(above, steps, at - 1, top):
            return True
        above = above.parent
    return False


def css_nodes(root: Node, selector: str) -> list[Node]:
    """Elements of a selector list, in document order."""
    compiled = [_compile(s) for s in selector.split(",") if s.strip()]
    return [n for n in root.walk() if any(_fits(n, c, len(c) - 1, root) for c in compiled)]


def css(root: Node, selector: str) -> list[str]:
    """Texts for ``::text``, values for ``::attr(name)``, else the elements' HTML."""
    out: list[str] = []
    for one in selector.split(","):
        m = re.match(r"^(.*?)::(text|attr\(([\w-]+)\))\s*$", one.strip())
        if not m:
            out += [to_html(n) for n in css_nodes(root, one)]
            continue
        base = m[1].strip()
        deep = m[1].endswith("*") or m[1].endswith(" ")
        nodes = [root] if not base else css_nodes(root, base)
        if not base and deep:
            nodes = [root, *root.walk()]
        for n in nodes:
            if m[3]:
                if m[3] in n.attrs:
                    out.append(n.attrs[m[3]])
            else:
                out += [c for c in n.children if isinstance(c, str)]
    return out


_AXIS = re.compile(r"(//|/|^)(?:(following-sibling|descendant|child|parent)::)?(text\(\)|\*|[\w-]+|\.\.|\.|@[\w-]+)((?:\[[^\]]*\])*)")


def xpath(root: Node, path: str) -> list[str]:
    """Texts, attribute values and the elements' HTML of a path."""
    return [x if isinstance(x, str) else to_html(x) for x in _walked(root, path)]


def xpath_nodes(root: Node, path: str) -> list[Node]:
    """Elements of a path."""
    return [x for x in _walked(root, path) if isinstance(x, Node)]


def _walked(root: Node, path: str) -> list:
    """Paths of child and descendant steps, predicates on attributes, positions,
    ``contains`` and text, a following-sibling axis, and text() or @name at the end."""
    nodes: list = [root]
    text = path.strip().removeprefix(".")
    at = 0
    while at < len(text):
        m = _AXIS.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"path not supported: {path}")
        at = m.end()
        slash, axis, name, predicates = m.groups()
        found: list = []
        for n in nodes:
            if name == "text()":
                found += n.texts() if slash == "//" else [c for c in n.children if isinstance(c, str)]
                continue
            if name.startswith("@"):
                found += [x.attrs[name[1:]] for x in ([n, *n.walk()] if slash == "//" else [n]) if name[1:] in x.attrs]
                continue
            if name in (".", ".."):
                found += [n if name == "." else n.parent] if n.parent or name == "." else []
                continue
            if axis == "following-sibling":
                kin = [c for c in n.parent.children if isinstance(c, Node)] if n.parent else []
                own = kin[kin.index(n) + 1 :] if n in kin else []
            elif slash == "//" or axis == "descendant":
                own = list(n.walk())
            else:
                own = [c for c in n.children if isinstance(c, Node)]
            own = [x for x in own if name in ("*", x.tag)]
            for p in re.findall(r"\[([^\]]*)\]", predicates or ""):
                own = _filtered(own, p.strip(), by_parent=slash == "//" and axis is None)
            found += own
        seen: set[int] = set()
        nodes = [x for x in found if isinstance(x, str) or not (id(x) in seen or seen.add(id(x)))]
    return nodes


def _filtered(nodes: list[Node], test: str, by_parent: bool) -> list[Node]:
    if test.isdigit() or test == "last()":
        groups: dict[int, list[Node]] = {}
        for n in nodes:
            groups.setdefault(id(n.parent) if by_parent else 0, []).append(n)
        k = -1 if test == "last()" else int(test) - 1
        return [g[k] for g in groups.values() if k < len(g)]
    if m := re.fullmatch(r"@([\w-]+)(?:\s*=\s*[\"'](.*)[\"'])?", test):
        return [n for n in nodes if m[1] in n.attrs and (m[2] is None or n.attrs[m[1]] == m[2])]
    if m := re.fullmatch(r"contains\(\s*(?:@([\w-]+)|text\(\)|\.)\s*,\s*[\"'](.*)[\"']\s*\)", test):
        return [n for n in nodes if m[2] in (n.attrs.get(m[1], "") if m[1] else n.text())]
    if m := re.fullmatch(r"(?:text\(\)|\.)\s*=\s*[\"'](.*)[\"']", test):
        return [n for n in nodes if n.text() == m[1]]
    raise ValueError(f"predicate not supported: {test}")
