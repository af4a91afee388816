"""A tolerant HTML tree on the standard library's tokenizer."""

from __future__ import annotations

from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag closes open tags of these names.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLOCKS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class Node:
    """An element: tag, attributes, children (nodes and texts), parent."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: "Node | None" = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], parent

    def walk(self):
        """The elements below, in document order; iterative, so depth is no limit."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def texts(self, own: bool = True):
        """Text pieces in order; without ``own`` those of elements below only."""
        stack: list = [(c, own) for c in reversed(self.children)]
        while stack:
            part, take = stack.pop()
            if isinstance(part, str):
                if take:
                    yield part
            else:
                stack += [(c, True) for c in reversed(part.children)]

    def text(self) -> str:
        return "".join(self.texts())

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        shut = CLOSES.get(tag, set()) | ({"p"} if tag in BLOCKS else set())
        while len(self.open) > 1 and self.open[-1].tag in shut:
            self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs}, self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag):
        for n in range(len(self.open) - 1, 0, -1):
            if self.open[n].tag == tag:
                del self.open[n:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str | None) -> Node:
    """The tree of a page; broken and empty pages give what they hold."""
    builder = _Builder()
    try:
        builder.feed(html or "")
        builder.close()
    except (AssertionError, ValueError):
        pass
    return builder.root


def to_html(node: Node) -> str:
    """An element's own HTML."""
    from html import escape

    out: list[str] = []
    stack: list = [node]
    while stack:
        part = stack.pop()
        if isinstance(part, tuple):
            out.append(part[0])
        elif isinstance(part, str):
            out.append(escape(part, quote=False))
        else:
            attrs = "".join(f' {k}="{escape(v)}"' for k, v in part.attrs.items())
            out.append(f"<{part.tag}{attrs}>")
            if part.tag not in VOID:
                stack.append((f"</{part.tag}>",))
                stack += reversed(part.children)
    return "".join(out)
